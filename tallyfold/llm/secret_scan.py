"""Secret scans: pattern spans, plus spans found by a battery of randomness tests.

Base spans (code points, end exclusive) come from three kinds of patterns, each matched leftmost
and without overlap; matches that are too short are dropped. The battery adds spans of kind
`random`: runs of 20 or more encoding characters that no base span touches. Their encoding is
inferred (hex, base32 or base64; pure numbers and single-class words are left out) and four tests
give a p-value for "drawn uniformly from that alphabet": chi-squared over the counts of all its
symbols (with the exact mean and variance for the token's length, as symbols are fewer than the
usual approximation asks for) and over its quarters (which has power where tokens are short), the
runs test about the middle of the alphabet, and the first serial correlation, combined by Sidak's
rule, so that random strings have even p-values. Ordinary words pile up near zero, random strings spread evenly; so for every encoding
and length class a histogram over all documents gives, for each threshold, the share of text among
what lies above it, and the lowest threshold whose share is within `fdr` is used. Short classes,
where the tests are weak, thereby get stricter thresholds or none.

Texts are scanned once: base spans and candidates are written to the shared folder, where the
histogram and the result read them.

Null or empty texts have no spans; repeated rows are judged alike, each for itself; an empty table
gives an empty result. Native: every step is a DataFrame function, no text is ever shuffled, and
the driver sees only the histogram (at most 18 classes of 64 bins).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import common

# Fixed values of the base patterns: kind, pattern, pattern of group 2 or None, least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Candidates of the battery.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
LENGTHS = (20, 24, 32, 48, 64, 128)
BINS = 64
MARK = "[SECRET]"
_SPAN = "array<struct<s:int,e:int,kind:string>>"


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """All matches that pass keep(match), with their places. The pieces between matches and the
    matches themselves alternate, so their lengths add up to the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, hit: F.struct(F.char_length(gap).alias("gap"), F.char_length(hit).alias("size"), keep(hit).alias("ok")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + x["size"]
        span = F.array(F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("kind")))
        return F.struct(e.alias("at"), F.when(x["ok"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _upper_tail(z: Column) -> Column:
    """P(|N(0,1)| > z) for z >= 0, by a rational approximation with error below 2e-7."""
    t = 1.0 / (1.0 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2.0 * poly * F.exp(-z * z / 2.0) * (1.0 / math.sqrt(2.0 * math.pi)))


def _encoding(token: Column) -> Column:
    mixed = token.rlike("[0-9]") & token.rlike("[A-Za-z]")
    return (
        F.when(~mixed, F.lit(None))
        .when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(token.rlike("^[A-Za-z0-9+/_-]+={0,2}$"), "base64")
    )


def _values(token: Column, encoding: Column) -> Column:
    """The symbols as numbers from 0 to below 1."""
    bare = F.rtrim(token, F.lit("="))

    def of(name: str) -> Column:
        alphabet = ALPHABETS[name]
        text = F.lower(bare) if name == "hex" else F.translate(bare, "-_", "+/") if name == "base64" else bare
        return F.transform(F.split(text, "(?<=.)(?=.)"), lambda c: _place(c, alphabet))

    return F.when(encoding == "hex", of("hex")).when(encoding == "base32", of("base32")).otherwise(of("base64"))


def _place(c: Column, alphabet: str) -> Column:
    return (F.position(c, F.lit(alphabet)) - 1) / F.lit(float(len(alphabet)))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is, an inlined column is not."""
    return F.transform(F.array(value), body)[0]


def p_random(values: Column, symbols: Column) -> Column:
    """Combined p-value of the four tests for an array of at least two numbers in [0, 1), each one
    of `symbols` equally spaced ones."""
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    size = lambda xs: F.size(xs).cast("double")

    def square_counts(v: Column) -> Column:
        """The sum of the squared counts of all symbols: the k-th equal one adds 2k - 1."""
        start = F.struct(F.lit(-1.0).alias("x"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum"))

        def step(acc: Column, x: Column) -> Column:
            k = F.when(x == acc["x"], acc["k"] + 1.0).otherwise(1.0)
            return F.struct(x.alias("x"), k.alias("k"), (acc["sum"] + 2.0 * k - 1.0).alias("sum"))

        return F.aggregate(F.array_sort(v), start, step, lambda acc: acc["sum"])

    def part(v: Column, k: int) -> Column:
        return size(F.filter(v, lambda x: F.floor(x * 4) == k)).alias(f"c{k}")

    def sums(v: Column) -> Column:
        pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct((a * b).alias("p"), (a + b).alias("q"), ((a >= 0.5) != (b >= 0.5)).alias("turn")))
        return _let(pairs, lambda w: F.struct(
            size(v).alias("n"), symbols.alias("symbols"), *[part(v, k) for k in range(4)], square_counts(v).alias("counts"), add(v).alias("sum"), add(F.transform(v, lambda x: x * x)).alias("squares"),
            add(F.transform(w, lambda x: x["p"])).alias("products"), add(F.transform(w, lambda x: x["q"])).alias("ends"), (1.0 + size(F.filter(w, lambda x: x["turn"]))).alias("runs"),
        ))

    def tests(m: Column) -> Column:
        n, high, low, average, free = m["n"], m["c2"] + m["c3"], m["c0"] + m["c1"], m["sum"] / m["n"], m["symbols"] - 1.0
        chi = m["counts"] * m["symbols"] / n - n
        off = [(m[f"c{k}"] - n / 4) * (m[f"c{k}"] - n / 4) for k in range(4)]
        # the cube root of a gamma variable is nearly normal (Wilson and Hilferty); this one has mean
        # `free` and variance 2 free (n - 1) / n
        spread = 2.0 * (n - 1.0) / (9.0 * free * n)
        mean = 1.0 + 2.0 * high * low / n
        variance = m["squares"] - n * average * average
        shared = m["products"] - average * (m["ends"] - (n - 1.0) * average)
        return F.struct(
            ((off[0] + off[1] + off[2] + off[3]) * 4 / n).alias("quarters"),
            ((F.cbrt(F.greatest(F.lit(0.0), chi) / free) - 1.0 + spread) / F.sqrt(spread)).alias("z_chi"),
            F.when((high > 0) & (low > 0), F.abs(m["runs"] - mean) / F.sqrt(F.greatest(F.lit(1e-9), (mean - 1.0) * (mean - 2.0) / (n - 1.0)))).alias("z_runs"),
            F.when(variance >= 1e-9, F.abs(shared / variance + 1.0 / n) * F.sqrt(n)).alias("z_serial"),
        )

    def combined(z: Column) -> Column:
        above = _upper_tail(F.abs(z["z_chi"])) / 2.0
        p_chi = F.when(z["z_chi"] > 0, above).otherwise(1.0 - above)
        # three degrees of freedom
        p_quarters = F.least(F.lit(1.0), _upper_tail(F.sqrt(z["quarters"])) + F.sqrt(2.0 * z["quarters"] / math.pi) * F.exp(-z["quarters"] / 2.0))
        tail = lambda name: F.when(z[name].isNull(), 0.0).otherwise(_upper_tail(z[name]))
        return 1.0 - F.pow(1.0 - F.least(p_chi, p_quarters, tail("z_runs"), tail("z_serial")), 4.0)

    return _let(_let(_let(values, sums), tests), combined)


def _length_class(size: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS):
        out = F.when(size >= least, i).otherwise(out)
    return out


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carry: str) -> DataFrame:
    """doc_id, __text, base (spans by start, then kind) and candidates of the battery, one row per
    row of docs, with the columns named in carry."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = _spans(F.col("__text"), ASSIGN, "assign", lambda hit: F.char_length(F.regexp_extract(hit, ASSIGN, 2)) >= LEAST_ASSIGN)
    access = _spans(F.col("__text"), ACCESS, "access", lambda hit: F.char_length(hit) >= LEAST_ACCESS)
    plain = _spans(F.col("__text"), HEX, "hex", lambda hit: F.lit(True))
    order = {k: i for i, k in enumerate(KINDS)}
    rank = lambda kind: F.when(kind == "assign", order["assign"]).when(kind == "access", order["access"]).otherwise(order["hex"])
    keyed = F.transform(F.concat("assign", "access", "hex"), lambda x: F.struct(x["s"].alias("s"), rank(x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))
    # explode() of one struct is a barrier: what follows reads its fields instead of repeating the scans
    found = F.struct(text.alias("__text"), *[F.col(c) for c in carry])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(found)).alias("r")).select("doc_id", "r.*")
    tokens = _spans(F.col("__text"), TOKEN, "random", lambda hit: _encoding(hit).isNotNull())
    spans = F.struct(assign.alias("assign"), access.alias("access"), plain.alias("hex"), tokens.alias("tokens"))
    rows = rows.select("*", F.explode(F.array(spans)).alias("r")).select("*", "r.*").drop("r")
    rows = rows.select("*", F.explode(F.array(F.array_sort(keyed))).alias("base"))
    clear = F.filter("tokens", lambda t: ~F.exists(F.col("base"), lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))

    def tested(t: Column) -> Column:
        token = F.substring(F.col("__text"), t["s"] + 1, t["e"] - t["s"])
        known = _let(token, lambda x: F.struct(x.alias("token"), _encoding(x).alias("enc")))
        symbols = lambda k: F.when(k["enc"] == "hex", 16.0).when(k["enc"] == "base32", 32.0).otherwise(64.0)
        p = lambda k: p_random(_values(k["token"], k["enc"]), symbols(k))
        return _let(known, lambda k: F.struct(t["s"].alias("s"), t["e"].alias("e"), k["enc"].alias("enc"), _length_class(t["e"] - t["s"]).alias("len"), F.least(F.lit(BINS - 1), F.floor(p(k) * BINS)).cast("int").alias("bin")))

    return rows.select("*", F.explode(F.array(F.transform(clear, tested))).alias("candidates"))


def thresholds(found: DataFrame, fdr: float = 0.1) -> dict[tuple[str, int], int]:
    """Lowest accepted bin by encoding and length class, from the candidates of all documents."""
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.enc", "c.len", "c.bin").count().collect()
    table: dict[tuple[str, int], list[int]] = {}
    for enc, size, place, n in counts:
        table.setdefault((enc, size), [0] * BINS)[place] += n
    return {key: best for key, bins in table.items() if (best := _lowest_bin(bins, fdr)) is not None}


def _lowest_bin(bins: list[int], fdr: float) -> int | None:
    """Random strings give even p-values and text small ones, so the uppermost quarter tells how many
    random ones there are; what exceeds them above a bin is text."""
    random_total = 4 * sum(bins[BINS - BINS // 4 :])
    above, best = 0, None
    for k in range(BINS - 1, -1, -1):
        above += bins[k]
        expected = random_total * (BINS - k) / BINS
        if above and expected > 0 and 1 - expected / above <= fdr:
            best = k
    return best


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *carry: str, fdr: float = 0.1) -> DataFrame:
    """doc_id, the columns named in carry, n_ of each base kind, base, candidates and `spans` (base and
    accepted random spans by start, then kind), one row per row of docs."""
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    found = common.durable(scanned(docs, id_col, text_col, *carry).select("doc_id", *carry, *sizes, "base", "candidates"), "secrets")
    passed = lambda c: F.lit(False)
    for (enc, size), place in sorted(thresholds(found, fdr).items()):
        passed = (lambda prior, enc, size, place: lambda c: prior(c) | ((c["enc"] == enc) & (c["len"] == size) & (c["bin"] >= place)))(passed, enc, size, place)
    extra = F.transform(F.filter("candidates", passed), lambda c: F.struct(c["s"].alias("s"), F.lit(len(KINDS)).alias("k"), c["e"].alias("e"), F.lit("random").alias("kind")))
    return found.withColumn("spans", F.array_sort(F.concat("base", extra)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) and n_random."""
    rows = secret_spans(docs, id_col, text_col)
    return rows.select(
        "doc_id",
        *[f"n_{k}" for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every found span replaced by MARK (overlapping spans by one mark); texts without
    spans, null ones included, stay as they are. n_chars, if there, follows the text."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*[docs[c] for c in others], F.lit(1).alias(common.fresh("pad", docs)))
    safe = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__raw"), rest.alias("__rest"))
    rows = secret_spans(safe, "__id", "__raw", "__raw", "__rest")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col("__raw"), acc["at"] + 1, F.greatest(F.lit(0), x["s"] - acc["at"]))
        fresh = x["s"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(MARK))).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("__raw"), acc["at"] + 1, F.char_length("__raw"))))
    text = F.when(F.size("spans") > 0, masked).otherwise(F.col("__raw"))
    out = rows.select(F.col("doc_id").alias(id_col), text.alias(text_col), *[F.col("__rest")[c].alias(c) for c in others])
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.char_length(text_col).cast("long"))
    return out.select(*docs.columns)
