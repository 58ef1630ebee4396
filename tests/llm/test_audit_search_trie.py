import hashlib
import math
import random
import re
import zlib
from collections import Counter

from helpers import CLASHING

from tallyfold.llm import divergence, max_score, prefix_trie

EXTRA = [c for c in CLASHING if c not in ("n", "id", "term", "part")]


def audited(rows, least, top):
    """Every contract column, restated with dictionaries and whole numbers."""
    found, out = {}, []
    for lang, source, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found.setdefault(lang or "", {}).setdefault(source or "", []).append(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered))
    for lang, sources in found.items():
        docs = Counter(t for texts in sources.values() for words in texts for t in set(words))
        kept = [t for t, n in docs.items() if n >= least]
        counts = {s: Counter(w for words in texts for w in words if docs[w] >= least) for s, texts in sources.items()}
        counts[None] = sum(counts.values(), Counter())
        share = {s: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = sorted((-sum(far(share[s][t], share[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-far(share[s][t], share[None][t]), t.encode()) for t in kept if counts[s][t] and share[s][t] > share[None][t])[:top]
            out += [(lang, s, part, item.decode(), -v, r + 1) for part, values in (("pair", pairs), ("term", terms)) for r, (v, item) in enumerate(values)]
    return sorted(out)


def audit_rows():
    rng = random.Random(3)
    words = ["Alpha", "beta", "x", "ÉTÉ", "日本", "naïve", "a1b", "Ωmega"] + [f"w{c}{d}" for c in "abcdef" for d in "ghij"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice([f"s{i}" for i in range(7)] + [None, "ü"]), " ".join(rng.choices(words, k=rng.randrange(12)))) for _ in range(150)]
    return rows + [("en", "s0", "hot words " * 3000), ("en", "s0", None), ("de", "only", ""), ("it", "p", "one"), ("it", "q", "two"), ("en", "quiet", "  ")] + [rows[0]] * 3


def test_divergence_matches_brute_force(spark):
    rows = audit_rows()
    extra = ", ".join(f"{c} string" for c in EXTRA)
    table = spark.createDataFrame([(i, t, lang, s, *EXTRA) for i, (lang, s, t) in enumerate(rows)], f"doc_id long, text string, lang string, source string, {extra}").repartition(3)
    for least, terms, tile in ((10, 2048, 256), (2, 5, 2), (1, 7, 3)):
        got = divergence.source_divergence(table, least=least, terms=terms, tile=tile).collect()
        assert sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in got) == audited(rows, least, 10)
    assert divergence.source_divergence(table.limit(0)).collect() == []


def test_divergence_passes_sums_on_when_its_dictionaries_fill(spark, monkeypatch):
    rows = audit_rows()
    table = spark.createDataFrame([(t, lang, s) for lang, s, t in rows], "text string, lang string, source string")
    want = {tuple(r) for r in divergence.count_terms(table).collect()}
    monkeypatch.setattr(divergence, "ROOM", 3)
    assert {tuple(r) for r in divergence.count_terms(table).collect()} == want


def test_shares_are_exact_for_very_large_counts():
    import numpy as np

    rng = random.Random(1)
    for _ in range(300):
        total, kept = rng.randrange(1, 9 * 10**15), rng.randrange(1, 10**7)
        count = rng.randrange(0, total + 1)
        assert divergence.shares(np.array([count]), np.array([total]), kept)[0] == 1 + 1_000_000_000 * (count + 2) // (total + 2 * kept)


def searched(rows, k, step):
    good = [(i, [math.floor(x) * 1024 if abs(x) > 1e300 else math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    raw = {}
    for i, v in rows:
        if i is not None and i % step == 0 and v is not None and all(x is not None and math.isfinite(x) for x in v):
            raw[i] = min(raw.get(i, v), v)
    out = []
    for q, v in raw.items():
        quantised = [math.floor(x) * 1024 if abs(x) > 1e300 else math.floor(1024 * x) for x in v]
        clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        scores = sorted((-clip(sum(a * b for a, b in zip(quantised, e))), i) for i, e in good if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def vector_rows(kind):
    rng = random.Random(kind)
    draw = {"dense": lambda: rng.gauss(0, 0.125), "sparse": lambda: rng.choice([0.0] * 6 + [0.5, 1.0, -1.0]), "below": lambda: -abs(rng.gauss(0, 1)) if rng.random() < 0.5 else 0.0}[kind]
    rows = [(i, [draw() for _ in range(12)]) for i in range(400)]
    rows += [rows[7], rows[20], rows[20], (20, rows[21][1]), (500, [0.0] * 12), (520, []), (521, [1.0, -1.0]), (None, [1.0] * 12), (540, None), (541, [None] * 12), (542, [float("nan")] * 12), (543, [float("inf")] * 12)]
    return rows


def test_max_score_matches_brute_force(spark, monkeypatch):
    extra = ", ".join(f"{c} string" for c in CLASHING)
    for kind in ("dense", "sparse", "below"):
        rows = vector_rows(kind)
        table = spark.createDataFrame([(i, v, *CLASHING) for i, v in rows], f"vec_id long, embedding array<double>, {extra}")
        for size, seeds in ((4 << 20, 4096), (4000, 40)):
            monkeypatch.setattr(max_score, "SHARD", size)
            monkeypatch.setattr(max_score, "SEEDS", seeds)
            got = max_score.top_products(table, lambda i: i % 20 == 0).collect()
            assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == searched(rows, 10, 20)
    assert max_score.top_products(table.limit(0), lambda i: i % 20 == 0).collect() == []


def test_max_score_with_very_large_components(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([1e300, -1e300, 1e12, 3.0, -1e9, 1.7e308, 0.0]) for _ in range(3)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = max_score.top_products(table, lambda i: i % 20 == 0, k=4).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == searched(rows, 4, 20)


def test_a_shard_skips_what_cannot_compete():
    import numpy as np

    values = np.array([[900.0, 0, 1], [0, 900, 1], [1, 1, 900], [800, 1, 1]])
    lists, query = max_score.Postings(values), np.array([100.0, 2.0, 1.0])
    # the lists of the second and third dimension are not needed to reach the threshold
    lists.lists[1:] = [None, None]
    rows, scores = lists.search(query, lists.bounds(query[None, :])[0], 80_000.0, slice(0, 0))
    assert rows.tolist() == [0, 3] and scores.tolist() == [90_001.0, 80_003.0]


def trie_by_hand(rows, spread, cuts):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % cuts
        full[c] = tuple(convs.get(c - int(math.fmod(c, spread)), [])[:h] + own[h:])
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = lambda n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n]
        ends = ",".join(str(c) for c in sorted(inside) if len(full[c]) == len(node))
        out.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children(node)), sum(not children(n) for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def conversation_rows():
    rng, rows = random.Random(5), []
    for c in [*range(40), 100, 101, 137, 205, 300, -3, -101, 10_000_000_007]:
        for k in range(rng.choice([1, 2, 3, 4, 6, 9])):
            rows.append((c, rng.choice([None, k, k]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "", None, "é日👍"])))
    rows += [rows[0], rows[5], (None, 0, "user", "x"), *[(77, k, "user", f"t{k}") for k in range(300)]]
    return rows


def test_trie_matches_brute_force(spark, monkeypatch):
    rows = conversation_rows()
    extra = ", ".join(f"{c} string" for c in CLASHING)
    table = spark.createDataFrame([(*r, *CLASHING) for r in rows], f"conv_id long, turn long, role string, text string, {extra}").repartition(3)
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    order = lambda found: sorted(found, key=lambda r: r[:2])
    for block, spread, cuts in ((4096, 100, 6), (2, 10, 3)):
        monkeypatch.setattr(prefix_trie, "BLOCK", block)
        got = prefix_trie.prefix_trie(prefix_trie.rebuilt(table, spread, cuts)).collect()
        assert order(tuple(r[n] for n in names) for r in got) == order(trie_by_hand(rows, spread, cuts))
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(table.limit(0))).collect() == []


def test_many_conversations_end_in_one_node(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 30_000, 3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.depth: r for r in prefix_trie.prefix_trie(prefix_trie.rebuilt(table, cuts=1)).collect()}
    assert got[1].ends_sha256 == hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
    assert (got[1].n_convs, got[1].n_leaves, got[1].saved_tokens, got[0].n_children) == (10_000, 1, 9_999 * 4, 1)
