"""Bar sources: CSV files named ASSET_TF_START_END.csv, and ticks aggregated into bars."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.functions.kernels import KEYS
from tallyfold.staging import staged

# File name pattern, separators in the order tried, headers of one exporter.
FILE_NAME = r"^([A-Za-z0-9]+)_([A-Za-z0-9]+)_(\d{12})_(\d{12})\.csv$"
SEPARATORS = (",", ";", "\t", "|")
HEADERS = {"<DATE>": "date", "<TIME>": "time", "<OPEN>": "open", "<HIGH>": "high", "<LOW>": "low", "<CLOSE>": "close", "<TICKVOL>": "tick_vol", "<VOL>": "volume", "<SPREAD>": "spread"}
PRICES = ("open", "high", "low", "close")
OPTIONAL = ("tick_vol", "volume", "spread")
RESAMPLED_SOURCES = ("M1", "M5", "M15", "M30")
RULES = {"1min": "1 minute", "5min": "5 minutes", "15min": "15 minutes", "30min": "30 minutes", "1h": "1 hour", "4h": "4 hours", "1D": "1 day"}


@dataclass(frozen=True)
class DatasetMeta:
    asset: str
    timeframe: str
    start: str
    end: str
    path: str
    group: str = ""


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _listed(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(path, is folder) of what a folder holds, sorted; empty if there is no such folder."""
    fs, place = _folder(spark, path)
    return sorted((s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(place)) if fs.exists(place) else []


def parse_file_name(path: str, group: str = "") -> DatasetMeta | None:
    found = re.match(FILE_NAME, path.rsplit("/", 1)[-1])
    return DatasetMeta(found[1], found[2], found[3], found[4], path, group) if found else None


def discover_datasets(spark: SparkSession, data_dir: str) -> list[DatasetMeta]:
    """Files of the folder, then of its sub-folders (a sub-folder's name is the group), without
    reading rows. Of equal (asset, timeframe) the later file counts."""
    out: dict[tuple[str, str], DatasetMeta] = {}
    top = _listed(spark, data_dir)
    files = [(p, "") for p, folder in top if not folder]
    for folder in [p for p, is_folder in top if is_folder]:
        files += [(p, folder.rstrip("/").rsplit("/", 1)[-1]) for p, is_folder in _listed(spark, folder) if not is_folder]
    for path, group in files:
        meta = parse_file_name(path, group)
        if meta is not None:
            out[meta.asset, meta.timeframe] = meta
    return list(out.values())


def split_header(header: str) -> tuple[str, list[str]] | None:
    """The first separator that gives at least four columns, and the names under it."""
    for sep in SEPARATORS:
        names = header.split(sep)
        if len(names) >= 4:
            return sep, [n.strip() for n in names]
    return None


def headers_of(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The first line of each file, from one job over all of them; empty files have none."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")).where("start = 0")
    first = lines.withColumn("place", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "place").alias("header"))
    # as many rows as the catalog has files
    return {r["path"]: r["header"] for r in first.collect()}


def separator_of(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """The separator and the column names of a file."""
    found = split_header(next(iter(headers_of(spark, [path]).values()), ""))
    if found is None:
        raise ValueError(f"cannot parse {path}: no separator gives four columns")
    return found


def _time(df: DataFrame) -> Column:
    text = lambda c: F.trim(F.col(c).cast("string"))
    parsed = lambda c: F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy.MM.dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy.MM.dd HH:mm")), F.try_to_timestamp(c, F.lit("yyyy.MM.dd"))).cast("timestamp_ntz")
    have = set(df.columns)
    if "datetime" in have:
        return parsed(text("datetime"))
    if {"date", "time"} <= have:
        return parsed(F.concat_ws(" ", text("date"), text("time")))
    for name in ("timestamp", "date"):
        if name in have:
            return parsed(text(name))
    raise ValueError("no datetime column (datetime, date and time, timestamp or date)")


def normalise(df: DataFrame, keys=KEYS) -> DataFrame:
    """Bars with ts and double prices: rows without a time or a price go, and of rows with equal
    time the first in the input stays (in a column `_start`: the offset of the part of a file that
    a row was read with; inside a part rows are numbered as they are read)."""
    df = df.withColumnsRenamed(HEADERS)
    missing = [c for c in PRICES if c not in df.columns]
    ts = _time(df)
    if missing:
        raise ValueError(f"missing price columns: {missing}")
    number = lambda c: F.col(c).try_cast("double")
    start = F.col("_start") if "_start" in df.columns else F.lit(0)
    df = df.withColumns({"ts": ts, "_place": F.struct(start.alias("start"), F.monotonically_increasing_id().alias("row"))})
    rows = df.select(*keys, "ts", *[number(c).alias(c) for c in PRICES], *[number(c).alias(c) for c in OPTIONAL if c in df.columns], "_place").dropna(subset=["ts", *PRICES])
    first = F.row_number().over(Window.partitionBy(*keys, "ts").orderBy("_place"))
    return rows.withColumn("_r", first).where("_r = 1").drop("_r", "_place")


#: What is taken of the file a row comes from.
_PATH, _START = "_metadata.file_path", "_metadata.file_block_start"


def _read(spark: SparkSession, paths: list[str], sep: str, names: list[str]) -> DataFrame:
    """Files of one separator and header as strings, with _path and _start."""
    raw = spark.read.csv(paths, sep=sep, header=True, inferSchema=False)
    named = raw.select(*raw.columns, F.col(_PATH).alias("_path"), F.col(_START).alias("_start"))
    return named.toDF(*names, "_path", "_start") if len(raw.columns) == len(names) else named


def load_csv(spark: SparkSession, path: str, group: str = "", asset: str = "", tf: str = "") -> DataFrame:
    raw = _read(spark, [path], *separator_of(spark, path))
    meta = parse_file_name(path, group)
    asset, tf = asset or (meta.asset if meta else ""), tf or (meta.timeframe if meta else "")
    return normalise(raw.withColumns({"group": F.lit(group), "asset": F.lit(asset), "tf": F.lit(tf)}))


def load_all(spark: SparkSession, data_dir: str) -> DataFrame:
    """All files of the catalog as one long table. Files of equal header are one scan, and a row's
    keys come from its file's path, so the plan does not grow with the number of files."""
    catalog = discover_datasets(spark, data_dir)
    if not catalog:
        raise ValueError(f"no bar files in {data_dir}")
    headers = headers_of(spark, [m.path for m in catalog])
    shapes: dict[str, list[str]] = {}
    for path, header in headers.items():
        shapes.setdefault(header, []).append(path)
    top = _folder(spark, data_dir)[1].getName()
    parts = []
    for header, paths in shapes.items():
        found = split_header(header)
        if found is None:
            raise ValueError(f"cannot parse {paths[0]}: no separator gives four columns")
        name, folder = F.substring_index("_path", "/", -1), F.element_at(F.split("_path", "/"), -2)
        keys = {"group": F.when(folder == top, "").otherwise(folder), "asset": F.regexp_extract(name, FILE_NAME, 1), "tf": F.regexp_extract(name, FILE_NAME, 2)}
        parts.append(normalise(_read(spark, paths, *found).withColumns(keys)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def save_csv(bars: DataFrame, data_dir: str, sep: str = "\t") -> list[str]:
    """Writes each series as one file ASSET_TF_START_END.csv in its group's folder, under the headers
    of the exporter, and gives the paths. One job writes all series, each by one task; the driver
    only names the files, as many as there are series."""
    spark = bars.sparkSession
    there = [c for c in OPTIONAL if c in bars.columns]
    titles = {v: k for k, v in HEADERS.items()}
    stamp = lambda c: F.date_format(c, "yyyyMMddHHmm")
    spans = bars.groupBy(*KEYS).agg(stamp(F.min("ts")).alias("start"), stamp(F.max("ts")).alias("end")).collect()
    columns = [F.date_format("ts", "yyyy.MM.dd").alias("<DATE>"), F.date_format("ts", "HH:mm:ss").alias("<TIME>"), *[F.col(c).alias(titles[c]) for c in (*PRICES, *there)]]
    work = f"{data_dir.rstrip('/')}/_writing"
    ordered = bars.repartition(*KEYS).sortWithinPartitions(*KEYS, "ts").select(*[F.col(c).alias(f"_{c}") for c in KEYS], *columns)
    ordered.write.mode("overwrite").partitionBy(*[f"_{c}" for c in KEYS]).option("header", True).option("sep", sep).csv(work)
    fs, place = _folder(spark, work)
    jvm, out = spark.sparkContext._jvm, []
    for r in spans:
        part = [p for p, _ in _listed(spark, f"{work}/_group={r['group']}/_asset={r['asset']}/_tf={r['tf']}") if p.endswith(".csv")]
        target = f"{data_dir.rstrip('/')}/{r['group']}/{r['asset']}_{r['tf']}_{r['start']}_{r['end']}.csv"
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(target).getParent())
        fs.rename(jvm.org.apache.hadoop.fs.Path(part[0]), jvm.org.apache.hadoop.fs.Path(target))
        out.append(target)
    fs.delete(place, True)
    return out


def resample_ohlc(df: DataFrame, rule: str, keys=KEYS) -> DataFrame:
    """Bars of left-closed buckets named by their start; volumes and spread are summed."""
    bucket = F.window("ts", RULES.get(rule, rule))
    sums = [F.sum(c).alias(c) for c in OPTIONAL if c in df.columns]
    out = df.groupBy(*[k for k in keys if k != "tf"], bucket.alias("w")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), *sums)
    named = out.withColumns({"tf": F.lit(rule), "ts": F.col("w.start")})
    return named.select(*keys, "ts", *PRICES, *[c for c in OPTIONAL if c in df.columns]).dropna(subset=list(PRICES))


def ticks_to_bars(ticks: DataFrame, asset: str, ts: str, price: str, rule: str, order: tuple[str, ...] = (), volume: str | None = None, group: str = "ticks") -> DataFrame:
    """Bars of single prices; `order` breaks ties of equal times; tick_vol counts rows or sums volume."""
    rank = F.struct(F.col(ts), *[F.col(c) for c in order])
    bucket = F.window(F.col(ts), RULES.get(rule, rule))
    size = F.count(F.lit(1)) if volume is None else F.sum(volume)
    out = ticks.groupBy(F.col(asset).alias("asset"), bucket.alias("w")).agg(F.min_by(price, rank).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, rank).alias("close"), size.cast("double").alias("tick_vol"))
    return out.select(F.lit(group).alias("group"), "asset", F.lit(rule).alias("tf"), F.col("w.start").alias("ts"), *PRICES, "tick_vol")


def ticks_to_frames(ticks: DataFrame, asset: str, ts: str, price: str, rules: Iterable[str], order: tuple[str, ...] = (), volume: str | None = None, group: str = "ticks") -> DataFrame:
    """ticks_to_bars for several of RULES as one table. Each of RULES divides the next, so the ticks
    are read once, for the shortest; the others are made of its bars, which are written once and are
    no more than the assets have buckets of it."""
    shortest, *longer = sorted(set(rules), key=list(RULES).index)
    fine = ticks_to_bars(ticks, asset, ts, price, shortest, order, volume, group)
    if not longer:
        return fine
    fine = staged(fine, "bars")
    return reduce(DataFrame.unionByName, [fine, *[_longer(fine, rule) for rule in longer]])


def _longer(fine: DataFrame, rule: str) -> DataFrame:
    """Bars of a longer rule; like those of ticks they keep missing prices."""
    out = fine.groupBy("group", "asset", F.window("ts", RULES[rule]).alias("w")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("tick_vol").alias("tick_vol"))
    return out.select("group", "asset", F.lit(rule).alias("tf"), F.col("w.start").alias("ts"), *PRICES, "tick_vol")


class LazyDataset:
    """A file of the catalog; rows are read on load, and small timeframes resampled if asked."""

    def __init__(self, spark: SparkSession, meta: DatasetMeta, resample_to: str | None = None):
        self.spark, self.meta, self.resample_to, self._frame = spark, meta, resample_to, None

    @property
    def timeframe(self) -> str:
        return self.resample_to if self.resample_to and self.meta.timeframe in RESAMPLED_SOURCES else self.meta.timeframe

    @property
    def is_loaded(self) -> bool:
        return self._frame is not None

    def load(self) -> DataFrame:
        if self._frame is None:
            frame = load_csv(self.spark, self.meta.path, self.meta.group)
            if self.timeframe != self.meta.timeframe:
                frame = resample_ohlc(frame, self.timeframe)
            self._frame = frame.persist()
        return self._frame

    def unload(self) -> None:
        if self._frame is not None:
            self._frame.unpersist()
            self._frame = None

    def __enter__(self) -> DataFrame:
        return self.load()

    def __exit__(self, *_) -> None:
        self.unload()

    using = property(lambda self: self)


def load_all_lazy(spark: SparkSession, data_dir: str, resample_to: str | None = None) -> dict[tuple[str, str], LazyDataset]:
    return {(m.asset, m.timeframe): LazyDataset(spark, m, resample_to) for m in discover_datasets(spark, data_dir)}


def build_lazy_grid(spark: SparkSession, data_dir: str, group_timeframes: dict[str, list[str]] | None = None) -> dict[tuple[str, str, str], LazyDataset]:
    """(group, tf, asset) to dataset; files at the top, which have no group, are left out."""
    grid = {}
    for meta in discover_datasets(spark, data_dir):
        if meta.group:
            for tf in (group_timeframes or {}).get(meta.group, [meta.timeframe]):
                grid[meta.group, tf, meta.asset] = LazyDataset(spark, meta, tf)
    return grid


@dataclass(frozen=True)
class GridSpec:
    """One cell of a grid as plain values: it can be stored or sent, and loads its bars anywhere."""

    group: str
    timeframe: str
    asset: str
    path: str
    source_timeframe: str

    @classmethod
    def from_lazy(cls, key: tuple[str, str, str], data: LazyDataset) -> GridSpec:
        return cls(*key, data.meta.path, data.meta.timeframe)

    @property
    def key(self) -> tuple[str, str, str]:
        return self.group, self.timeframe, self.asset

    def load(self, spark: SparkSession) -> DataFrame:
        bars = load_csv(spark, self.path, self.group)
        return resample_ohlc(bars, self.timeframe) if self.source_timeframe in RESAMPLED_SOURCES and self.timeframe != self.source_timeframe else bars


def reshape_grid_results(flat: dict[tuple[str, str, str], object]) -> dict[str, dict[str, dict[str, object]]]:
    """Results by (group, tf, asset) as nested dictionaries, in the order given."""
    groups = dict.fromkeys(g for g, _, _ in flat)
    frames = {g: dict.fromkeys(t for h, t, _ in flat if h == g) for g in groups}
    return {g: {t: {a: found for (h, u, a), found in flat.items() if (h, u) == (g, t)} for t in frames[g]} for g in groups}


def folder_bars(spark: SparkSession, data_dir: str) -> Callable[[str, list[str]], DataFrame | None]:
    """bars_for(group, timeframes) over the files of a folder, for run_all_strategies."""

    def bars_for(group: str, frames: list[str]) -> DataFrame | None:
        cells = {k: d for k, d in build_lazy_grid(spark, data_dir, {group: frames}).items() if k[0] == group}
        return grid_bars(cells) if cells else None

    return bars_for


def grid_bars(grid: dict[tuple[str, str, str], LazyDataset]) -> DataFrame:
    """A grid as one long table; its keys are columns."""
    parts = [data.load().withColumn("tf", F.lit(tf)) for (_, tf, _), data in grid.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
