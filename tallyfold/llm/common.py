"""Helpers shared by the corpus operators: the shared folder, durable tables, hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.shipping import ship

#: At most so many keys are broadcast by join_groups.
HOT_KEYS = 4096


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint
    folder. Without either, a local session (whose executor is the driver) gets one of its own and
    any other one is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    root = context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tallyfold-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/tallyfold/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, and a lost
    executor costs no recomputation of what came before. The table goes when the application ends."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """As durable, but dealt by the hash of key once: later joins and groups by key move nothing of
    it. The catalog knows the table only while it is written."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    table = f"tallyfold_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return found


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(run, schema)


def map_tables(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """run(table) -> table for the Arrow table of each group."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: int, size: int, rows: int):
    """The batch in runs of at most `rows` rows and (unless one row is longer) `size` bytes of a column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        stop = min(max(stop, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, stop - at)
        at = stop


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists of the given sizes, laid end to end in values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def fresh(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of docs whose id is not in the first column of gone; a null id is in none."""
    name = fresh("gone", docs)
    return docs.join(gone.toDF(name), docs[id_col] == F.col(name), "left_anti")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups, which has one row per key and the number of rows of that key in
    `size`; total is their sum. Keys that more than one in HOT_KEYS rows has are broadcast (there
    are fewer than HOT_KEYS), so a task of the exchange gets at most that many rows of one key."""
    least = F.lit(total / HOT_KEYS)
    hot, others = groups.where(F.col(size) > least), groups.where(F.col(size) <= least)
    often = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(others, keys, how)
    return often.unionByName(rest)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hash of each distinct word, remembered up to `room` words."""

    def __init__(self, room: int = 150_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased; other letters keep their case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every run of `width` words, or of the whole sequence if it is shorter.
    A shorter sequence is salted by its length, so it never equals a full shingle."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width, short = min(width, n), n < width
    total = np.full(n - width + 1, np.uint64((n if short else 0) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    for i in range(width):
        step = np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF)
        total = mix64(total + words[i : n - width + 1 + i] * (step | np.uint64(1)))
    return total
