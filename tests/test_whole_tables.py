"""Registered queries run over all series of their tables."""

import pytest

from tallyfold.operators import compare, ml
from tallyfold.plans import QUERIES
from tallyfold.plans import queries as plans
from tallyfold.sources.bars import ticks_to_bars
from __spark_entry__ import SMALLEST


@pytest.fixture
def assets(spark):
    return {r[0] for r in plans.table(spark, SMALLEST, "events").select("event_type").distinct().collect()}


def test_classifier_overlay_takes_all_series_with_the_operators_own_folds_and_trees(spark, assets, monkeypatch):
    seen = {}
    monkeypatch.setattr(ml, "classifier_walk_forward", lambda bars, strategy, params, *rest, **named: seen.update(bars=bars, rest=rest, named=named))
    QUERIES["classifier_overlay"](spark, SMALLEST)
    assert {r[0] for r in seen["bars"].select("asset").distinct().collect()} == assets
    assert not seen["rest"] and not seen["named"]


def test_group_sets_whole_takes_every_nation(spark):
    def rows(name):
        return plans.table(spark, SMALLEST, name).collect()

    reached = {r["s_nationkey"] for r in rows("supplier")}
    nations = {r["n_nationkey"]: r for r in rows("nation")}
    shared = {("nation", nations[n]["n_name"]) for n in reached} | {("region", r["r_name"]) for r in rows("region") if r["r_regionkey"] in {nations[n]["n_regionkey"] for n in reached}}
    every = {("nation", n["n_name"]) for n in nations.values()} | {("region", r["r_name"]) for r in rows("region")}
    got = [tuple(r) for r in QUERIES["group_sets_whole"](spark, SMALLEST).collect()]
    assert sorted(got) == sorted([(t, "shared", n) for t, n in shared] + [(t, "missing", n) for t, n in every - shared])


def test_metrics_by_timeframe_gives_every_series(spark, assets):
    rows = QUERIES["metrics_by_timeframe"](spark, SMALLEST).collect()
    assert {r["asset"] for r in rows} == assets
    assert len({(r["asset"], r["metric"]) for r in rows}) == len(rows) == len(assets) * len({r["metric"] for r in rows})


def test_registry_run_reads_its_ticks_once(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(compare, "run_all_strategies", lambda bars_for: seen.update({(g, f): bars_for(g, [f]) for reg in compare.STRATEGY_REGISTRY for g, frames in reg.group_timeframes.items() for f in frames}) or (None,))
    QUERIES["registry_run"](spark, SMALLEST)
    assert not any(p.startswith(f"file://{SMALLEST}") for df in seen.values() for p in df.inputFiles())
    events = plans.table(spark, SMALLEST, "events")
    for (group, frame), df in seen.items():
        if group == "forex":
            want = ticks_to_bars(events, "event_type", "ts", "value", frame, ("event_id",), group=group)
            assert sorted(map(str, df.collect())) == sorted(map(str, want.select(*df.columns).collect()))
    assert ("b3", "1min") in seen and seen["b3", "1min"].count() > seen["b3", "1h"].count() > 0
