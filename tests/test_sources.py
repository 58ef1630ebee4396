import datetime

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import compare
from tallyfold.operators import strategies as st
from tallyfold.operators.walkforward import split_folds
from tallyfold.sources import bars as src
from tallyfold.sources.cache import ResultCache
from tallyfold.streaming.bars import stream_bars
from test_kernels import WALK, bars

NAME = "EURUSD_M30_202401010000_202401020000.csv"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "forex").mkdir()
    lines = ["<DATE>\t<TIME>\t<OPEN>\t<HIGH>\t<LOW>\t<CLOSE>\t<TICKVOL>\t<VOL>\t<SPREAD>"]
    for i in range(6):
        lines.append(f"2024.01.01\t{i // 2:02d}:{30 * (i % 2):02d}:00\t{i}\t{i + 2}\t{i - 1}\t{i + 1}\t10\t0\t2")
    lines += ["2024.01.01\t00:00:00\t9\t9\t9\t9\t1\t0\t1", "2024.01.01\t05:00:00\tx\t9\t9\t9\t1\t0\t1", "nonsense\t\t1\t1\t1\t1\t1\t0\t1"]
    (tmp_path / "forex" / NAME).write_text("\n".join(lines) + "\n")
    (tmp_path / "XAU_H1_202401010000_202401020000.csv").write_text("datetime;open;high;low;close\n2024-01-01 01:00:00;1;2;0;1\n")
    (tmp_path / "notes.csv").write_text("a,b\n1,2\n")
    return str(tmp_path)


def test_catalog_and_loading(spark, folder):
    found = {(m.group, m.asset, m.timeframe) for m in src.discover_datasets(spark, folder)}
    assert found == {("", "XAU", "H1"), ("forex", "EURUSD", "M30")}
    rows = src.load_all(spark, folder).orderBy("asset", "ts").collect()
    assert [r.asset for r in rows] == ["EURUSD"] * 6 + ["XAU"]
    # of equal times the first row stays; rows without a price or a time go
    assert rows[0].open == 0.0 and rows[0].tick_vol == 10.0 and rows[6].tick_vol is None
    with pytest.raises(ValueError):
        src.separator_of(spark, folder + "/notes.csv")
    assert src.discover_datasets(spark, folder + "/nowhere") == []


def test_missing_columns(spark):
    frame = spark.createDataFrame([("g", "a", "1h", "2024-01-01", "1")], "`group` string, asset string, tf string, datetime string, open string")
    with pytest.raises(ValueError, match="price"):
        src.normalise(frame)
    with pytest.raises(ValueError, match="datetime"):
        src.normalise(frame.drop("datetime"))


def test_lazy_grid_resamples_small_timeframes(spark, folder):
    grid = src.build_lazy_grid(spark, folder, {"forex": ["1h"]})
    assert list(grid) == [("forex", "1h", "EURUSD")]
    data = grid["forex", "1h", "EURUSD"]
    assert not data.is_loaded
    with data as frame:
        rows = frame.orderBy("ts").collect()
        assert [(r.open, r.high, r.low, r.close, r.spread) for r in rows] == [(0, 3, -1, 2, 4), (2, 5, 1, 4, 4), (4, 7, 3, 6, 4)]
    assert not data.is_loaded
    assert src.LazyDataset(spark, src.DatasetMeta("a", "H1", "", "", ""), "4h").timeframe == "H1"


def test_cache_needs_all_three_tables(spark, tmp_path):
    series = bars(spark, WALK)
    registry = [compare.StrategyRegistration("SMA + x", "01", st.SMACrossoverStrategy, st.SMACrossoverParams, {"g": ["1h"]}, {"fast": 2, "slow": 5}, {})]
    cache = ResultCache(spark, str(tmp_path / "cache"))
    assert cache.read(registry[0]) is None
    metrics, equity, trades = compare.run_all_strategies(lambda group, frames: series, registry, cache)
    assert metrics.count() == 1 and equity.count() == len(WALK) and trades.count() > 0
    again = compare.run_all_strategies(lambda group, frames: None, registry, cache)
    assert again[2].count() == trades.count()
    import shutil

    shutil.rmtree(cache.path(registry[0], "equity"))
    assert cache.read(registry[0]) is None


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"k{i % 2}", start + datetime.timedelta(minutes=7 * i), float(i % 11)) for i in range(200)]
    ticks = spark.createDataFrame(rows, "k string, t timestamp_ntz, p double")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    running = stream_bars(stream, "k", "t", "p", "1h").writeStream.format("memory").queryName("made").outputMode("complete").start()
    running.processAllAvailable()
    running.stop()
    batch = src.ticks_to_bars(ticks, "k", "t", "p", "1h")
    columns = ["asset", "ts", "open", "high", "low", "close", "tick_vol"]
    assert sorted(map(tuple, spark.table("made").select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
    assert batch.agg(F.sum("tick_vol")).first()[0] == 200


def test_grid_specs_load_and_results_reshape(spark, folder):
    grid = src.build_lazy_grid(spark, folder, {"forex": ["1h"]})
    (key, data), = grid.items()
    spec = src.GridSpec.from_lazy(key, data)
    assert spec.key == ("forex", "1h", "EURUSD") and spec.load(spark).count() == data.load().count() == 3
    assert src.reshape_grid_results({spec.key: 1, ("forex", "4h", "X"): 2, ("b3", "1h", "Y"): 3}) == {"forex": {"1h": {"EURUSD": 1}, "4h": {"X": 2}}, "b3": {"1h": {"Y": 3}}}
    bars_for = src.folder_bars(spark, folder)
    assert bars_for("b3", ["1h"]) is None and {r["tf"] for r in bars_for("forex", ["1h", "4h"]).select("tf").distinct().collect()} == {"1h", "4h"}


def test_first_parts_are_cut_by_the_truncated_product(spark):
    for rows, ratio, want in ((90, 0.3, 62), (50, 0.9, 4), (80, 0.25, 60)):
        day = [(("g", "a", "1h"), i) for i in range(rows)]
        table = spark.createDataFrame([(*k, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=i)) for k, i in day], "`group` string, asset string, tf string, ts timestamp_ntz")
        assert split_folds(table, 1, ratio).where("segment = 'is'").count() == want


def test_files_written_by_the_sink_are_read_back(spark, tmp_path):
    table = bars(spark, WALK).withColumn("spread", F.lit(2.0)).unionByName(bars(spark, WALK[::-1], "B").withColumns({"group": F.lit("h"), "spread": F.lit(1.0)}))
    paths = src.save_csv(table, str(tmp_path / "out"))
    assert sorted(p.rsplit("out/", 1)[-1] for p in paths) == ["g/A_1h_202401010000_202401052300.csv", "h/B_1h_202401010000_202401052300.csv"]
    columns = ["group", "asset", "tf", "ts", *src.PRICES, "tick_vol", "spread"]
    got = sorted(map(tuple, src.load_all(spark, str(tmp_path / "out")).select(*columns).collect()))
    assert got == sorted(map(tuple, table.select(*columns).collect()))


def test_the_first_row_of_a_file_in_several_parts_stays(spark, tmp_path):
    lines = ["datetime,open,high,low,close"] + [f"2024-01-01 {i % 20:02d}:00:00,{i},{i},{i},{i}" for i in range(4000)]
    (tmp_path / "A_H1_202401010000_202401020000.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        table = src.load_all(spark, str(tmp_path))
        assert src._read(spark, [str(tmp_path)], ",", ["datetime", *src.PRICES]).select("_start").distinct().count() > 5
        assert sorted((r.ts.hour, r.open) for r in table.collect()) == [(i, float(i)) for i in range(20)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_files_are_one_scan_per_header(spark, tmp_path):
    for i in range(12):
        sep = ";" if i % 3 == 0 else ","
        (tmp_path / f"A{i}_H1_202401010000_202401020000.csv").write_text(sep.join(["datetime", "open", "high", "low", "close"]) + "\n" + sep.join(["2024-01-01 01:00:00", str(i), "99", "0", "1"]) + "\n")
    table = src.load_all(spark, str(tmp_path))
    assert sorted((r.asset, r.open) for r in table.collect()) == sorted((f"A{i}", float(i)) for i in range(12))
    assert table._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2


def test_registry_run_takes_folders(spark, folder, tmp_path):
    registry = [compare.StrategyRegistration("SMA", "01", st.SMACrossoverStrategy, st.SMACrossoverParams, {"forex": ["1h"]}, {"fast": 2, "slow": 3}, {})]
    metrics, equity, _ = compare.run_all_strategies(folder, registry, cache=str(tmp_path / "kept"))
    assert metrics.count() == 1 and equity.count() == 3
    assert compare.run_all_strategies(folder + "/nowhere", registry, cache=str(tmp_path / "kept"))[1].count() == 3


def test_longer_bars_made_of_shorter_ones_equal_those_of_ticks(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(f"k{i % 2}" if i % 9 else None, start + datetime.timedelta(seconds=(37 * i) % 200_000 // 60 * 60) if i % 50 else None, float(i * 31 % 17) if i % 3 else None, i) for i in range(700)]
    ticks = spark.createDataFrame(rows, "k string, t timestamp_ntz, p double, n long").repartition(3)
    frames = ("4h", "1min", "1D", "15min")
    made = src.ticks_to_frames(ticks, "k", "t", "p", frames, ("n",), group="g")
    assert sorted(map(str, made.collect())) == sorted(str(r) for f in frames for r in src.ticks_to_bars(ticks, "k", "t", "p", f, ("n",), group="g").select(*made.columns).collect())
