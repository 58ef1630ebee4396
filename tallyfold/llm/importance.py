"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (unigrams and bigrams in a fixed number of
buckets) are estimated: one from target texts (labelled as good and not toxic), one from the raw
table. A document's log weight is the sum of its n-grams' log ratios; adding Gumbel noise and
keeping the k largest draws k documents without replacement in proportion to their weights.
k is the number of documents times the share of quality 1 among the labelled ones (toxic ones
count there by their quality too).

A second pair of models, of toxic labelled texts and of the target, is compared word by word: words
whose log ratio is MARKED or more even DEVIATIONS below its estimate are markers. A drawn document
is rejected all the same if its markers (each distinct one counts once, by its log ratio) outweigh
the prior odds of being good by SURE. Equal labelled texts count once there.

The raw model counts every document; the target and the toxic model use at most TARGETS labelled
documents each (those of smallest hash), a documented bound that keeps the id lists small enough to
broadcast.
Both models are vectors of BUCKETS numbers, whatever the input. The k-th largest key is found by
refining histograms on the executors: the driver sees BINS counts a round.

Null and empty texts have no n-grams, so weight 0. Keys come from ids: repeated rows get equal
keys and stay or go together, as do all ties at the border. Labels without a row are ignored, and so
are labels with a null. An empty table gives an empty result; without usable
labels everything stays. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import common
from tallyfold.llm.divergence import terms_of

BUCKETS = 10_000
TARGETS = 20_000
BINS = 4096
SEED = 20
#: Added to each bucket's count in both models.
SMOOTH = 1.0
#: Least log ratio of a marker, and how many deviations below its estimate it must hold.
MARKED, DEVIATIONS = math.log(4.0), 3.0
#: Log odds from which a document is taken to be toxic (19 to 1).
SURE = math.log(19.0)


def ngram_buckets(words: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all unigrams and bigrams of a text's word hashes."""
    one = common.mix64(words)
    two = common.mix64(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words[:0]
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def _label_ids(labels: DataFrame, docs: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ids of good labelled documents and of toxic ones (at most limit each, by smallest hash), and
    the share of quality 1 among the labels of docs (doc_id)."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("fine"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"), (F.col("toxic") == 1).alias("toxic"),
    )
    known = known.join(docs, "doc_id", "left_semi")
    share = known.agg(F.avg(F.col("fine").cast("double"))).first()[0]
    ids = []
    for wanted in ("good", "toxic"):
        rows = known.where(wanted).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
        ids.append(np.array(sorted({r[0] for r in rows}), np.int64))
    return ids[0], ids[1], 1.0 if share is None else share


def marker_words(docs: DataFrame, target: np.ndarray, toxic: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> dict[bytes, float]:
    """Words (runs of letters) that mark toxic texts, and their log ratios."""
    if not len(target) or not len(toxic):
        return {}
    spark = docs.sparkSession
    # both lists are bounded
    chosen = spark.createDataFrame([(int(i), 0) for i in target] + [(int(i), 1) for i in toxic], "marked_id bigint, side int")
    texts = docs.select(F.col(id_col).cast("long").alias("marked_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "marked_id").select("side", "text").dropDuplicates()

    def count(batches):
        for batch in batches:
            for side, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(terms_of(text))
                # a row of its own, with word null, counts the document
                yield pa.record_batch([pa.array([side] * (len(words) + 1), pa.int32()), pa.array([None, *words], pa.binary())], names=["side", "word"])

    rows = common.map_arrow(texts, count, "side int, word binary")
    held = lambda side: F.count_if(F.col("side") == side).cast("double")
    sides = common.durable(rows.groupBy("word").agg(held(1).alias("t"), held(0).alias("c")), "words")
    n_toxic, n_good = (sides.where("word is null").select("t", "c").first() or (0.0, 0.0))
    ratio = F.log((F.col("t") + SMOOTH) / (n_toxic + SMOOTH)) - F.log((F.col("c") + SMOOTH) / (n_good + SMOOTH))
    deviation = F.sqrt(1.0 / (F.col("t") + SMOOTH) + 1.0 / (F.col("c") + SMOOTH))
    found = sides.where("word is not null").select("word", ratio.alias("ratio"), deviation.alias("dev")).where(F.col("ratio") - DEVIATIONS * F.col("dev") >= MARKED).select("word", "ratio").collect()
    return {bytes(r["word"]): r["ratio"] for r in found}


def log_ratios(docs: DataFrame, target: np.ndarray, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(target / raw) by bucket, from one pass over all documents."""

    def count(batches):
        seen, raw, good = common.WordHash(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            # a null would turn all ids of its batch into floats
            column = batch.column(0)
            chosen = np.isin(column.fill_null(0).to_numpy(zero_copy_only=False), target) & column.is_valid().to_numpy(zero_copy_only=False)
            for i, text in enumerate(batch.column(1)):
                words = common.ascii_lower_words(text.as_py())
                if words:
                    found = np.bincount(ngram_buckets(seen.of(words), buckets), minlength=buckets)
                    raw += found
                    if chosen[i]:
                        good += found
        block = 4096
        for at in range(0, buckets, block):
            yield pa.record_batch({"at": pa.array([at], pa.int32()), "raw": pa.array([raw[at : at + block]], pa.list_(pa.int64())), "good": pa.array([good[at : at + block]], pa.list_(pa.int64()))})

    parts = common.map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), count, "at int, raw array<bigint>, good array<bigint>")
    rows = parts.select("at", F.posexplode(F.arrays_zip("raw", "good"))).groupBy((F.col("at") + F.col("pos")).alias("b")).agg(F.sum("col.raw").alias("raw"), F.sum("col.good").alias("good")).collect()
    raw, good = np.full(buckets, SMOOTH), np.full(buckets, SMOOTH)
    for b, r, g in rows:
        raw[b] += r
        good[b] += g
    return np.log(good / good.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", markers: dict[bytes, float] | None = None) -> DataFrame:
    """doc_id, log_weight and marked (the sum of the log ratios of its distinct markers) for every row."""
    buckets, markers = len(ratios), markers or {}

    def score(batches):
        seen = common.WordHash()
        for batch in batches:
            weights, marked = [], []
            for text in batch.column(1).to_pylist():
                words = seen.of(common.ascii_lower_words(text))
                weights.append(float(ratios[ngram_buckets(words, buckets)].sum()))
                marked.append(math.fsum(markers[w] for w in markers.keys() & terms_of(text)) if markers else 0.0)
            yield pa.record_batch({"doc_id": batch.column(0), "log_weight": pa.array(weights, pa.float64()), "marked": pa.array(marked, pa.float64())})

    return common.map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col)), score, "doc_id bigint, log_weight double, marked double")


def gumbel_keys(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """weights with `key`: log weight plus Gumbel noise drawn from the id."""
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double")
    return weights.withColumn("key", F.col("log_weight") - F.log(-F.log((bits + 0.5) / float(1 << 53))))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value (1 <= k <= number of rows), by histograms that halve nothing
    but the value range: each round keeps the bin that holds it."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0
    while low < high:
        width = (high - low) / BINS
        inside = rows.where(F.col(column).between(low, high))
        place = F.least(F.lit(BINS - 1), F.floor((F.col(column) - low) / width)).cast("int")
        bins = inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for row in sorted(bins, key=lambda r: -r["b"]):
            if above + row["n"] >= k:
                low, high = row["lo"], row["hi"]
                break
            above += row["n"]
        if width <= math.ulp(high):
            break
    return high


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: int = TARGETS, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, marked, key, toxic and kept for every row of docs."""
    target, toxic, share = _label_ids(labels, docs.select(F.col(id_col).cast("long").alias("doc_id")), targets)
    ratios = log_ratios(docs, target, BUCKETS, id_col, text_col) if len(target) else np.zeros(BUCKETS)
    markers = marker_words(docs, target, toxic, id_col, text_col)
    # what the markers must outweigh
    odds = max(math.log(len(target) / len(toxic)), 0.0) + SURE if markers else 0.0
    weights = log_weights(docs, ratios, id_col, text_col, markers)
    scored = common.durable(gumbel_keys(weights, seed).withColumn("toxic", F.col("marked") > odds), "importance")
    total = scored.count()
    k = min(total, round(share * total)) if len(target) else total
    if k == 0:
        return scored.withColumn("kept", F.lit(False))
    return scored.withColumn("kept", (F.col("key") >= F.lit(kth_largest(scored, "key", k))) & ~F.col("toxic"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps."""
    return common.without(docs, classify(docs, labels).where("not kept").select("doc_id"), "doc_id")
