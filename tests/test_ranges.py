"""Work that is cut into ranges and blocks gives what whole groups give."""

from __future__ import annotations

import random
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from lattix.operators import folds, intervals, timeseries
from lattix.plans import ranking


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Rows in several files; one user has a third of them, and one is null."""
    r = random.Random(3)
    rows = []
    for k in range(3000):
        user = 1 if k % 3 == 0 else None if k % 17 == 0 else r.randrange(40)
        rows.append((k * 7 % 3001, r.choice([None, 1.5, float("nan"), -2.0, 8.25]), user, r.choice("abc"), r.random(), f"p{k % 9}"))
    path = str(tmp_path_factory.mktemp("events") / "e")
    spark.createDataFrame(rows, "id long, ts double, user long, kind string, value double, props string").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_places_and_folds_keep_all_rows_and_columns(spark, events, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        same(folds.subdivide(events, 7, ["id"]), events.withColumn("fold", F.ntile(7).over(Window.orderBy("id"))))
        same(folds.subdivide(events, 7, ["ts", "id"], ["user"]), events.withColumn("fold", F.ntile(7).over(Window.partitionBy("user").orderBy("ts", "id"))))
        same(folds.partition_within_labels(events, "kind", "id", 4), events.withColumn("fold", F.ntile(4).over(Window.partitionBy("kind").orderBy("id"))))
        for ranges in (2, 90):
            w = Window.partitionBy("user")
            want = events.withColumn("i", (F.row_number().over(w.orderBy("ts", "id")) - 1).cast("long")).withColumn("n", F.count("*").over(w))
            same(ranking.with_group_index(events, ["user"], ["ts", "id"], "i", "n", ranges), want)
            same(ranking.with_global_index(events, ["ts", "id"], "i", ranges), events.withColumn("i", (F.row_number().over(Window.orderBy("ts", "id")) - 1).cast("long")))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert ranking.with_global_index(events.limit(0), ["id"], "i").count() == 0


def test_range_numbers_follow_the_order_of_keys(events):
    marks = ranking.splitters(events, ["ts", "id"], 12)
    assert 8 <= len(marks) <= 11
    rows = events.select("ts", "id", ranking.range_of(events, ["ts", "id"], marks).alias("r")).collect()
    key = lambda ts, i: ((0, 0.0) if ts is None else (2, 0.0) if ts != ts else (1, ts), i)  # noqa: E731  nulls first, NaN last
    bounds = [key(*m) for m in marks]
    assert all(x.r == bisect_left(bounds, (key(x.ts, x.id)[0], x.id + 0.5)) for x in rows)


def test_leave_one_out_has_every_row_for_every_group(events):
    out = folds.leave_one_out(events.select("id", "kind"), "kind").collect()
    assert len(out) == 9000 and {r.fold for r in out} == set("abc") and all(r.is_test == (r.kind == r.fold) for r in out)


def test_lags_taps_and_places_of_a_series_in_fifty_blocks(events):
    keys, order, block = ["user"], ["ts", "id"], 20
    one = events.withColumn("features", F.array("value", F.col("value") * 2))
    steps = [0, 1, 5, -2, 45]
    same(timeseries.lag_columns(one, "value", steps, keys, order, block=block), timeseries.lag_columns(one, "value", steps, keys, order))
    same(timeseries.lag_stack(one, "features", [0, 1, -2], keys, order, block=block), timeseries.lag_stack(one, "features", [0, 1, -2], keys, order))
    same(timeseries.structure_lag(one, "features", 3, keys, order, block=block), timeseries.structure_lag(one, "features", 3, keys, order))
    same(timeseries.series_places(one, keys, order, block=block), timeseries.series_places(one, keys, order))
    taps = {"hanning_width": 0.2, "dur": 0.6}
    same(timeseries.hanning_feature(one, "features", keys, order, block=block, **taps), timeseries.hanning_feature(one, "features", keys, order, **taps))


def test_islands_are_stitched_at_block_edges(events):
    w = Window.partitionBy("user").orderBy("id")
    rows = events.withColumn("t_idx", F.row_number().over(w).cast("long") - 500).where("id % 11 <> 3").withColumn("label", F.when(F.col("id") % 50 == 0, "b").otherwise("a"))
    runs: dict = {}
    for r in sorted(rows.select("user", "label", "t_idx").collect(), key=lambda r: (str(r.user), r.label, r.t_idx)):
        ends = runs.setdefault((r.user, r.label), [])
        if ends and ends[-1][1] == r.t_idx - 1:
            ends[-1][1] = r.t_idx
        else:
            ends.append([r.t_idx, r.t_idx])
    want = sorted((str(u), x, a / 100, b / 100) for (u, x), ends in runs.items() for a, b in ends)
    for block in (1, 7, 1 << 16):
        assert sorted((str(r.user), r.label, r.onset, r.offset) for r in timeseries.islands(rows, ["user"], "label", block=block).collect()) == want


def test_alignment_in_blocks_equals_the_whole_series(spark):
    r = np.random.default_rng(0)
    rows = [(k, float(round(t0 + i / sr, 8)), r.normal(size=2).tolist()) for k, n, sr, t0 in (("a", 900, 50.0, 0.0), ("b", 1300, 64.0, -1.0)) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, t double, features array<double>").repartition(5)
    for new, ratio in ((timeseries.regular_times(75, -0.5, 17.0), {"a": (3, 2), "b": (75, 64)}), (timeseries.regular_times(20, 1, 16.0), {"a": (2, 5), "b": (5, 16)})):
        rate = (len(new) - 1) / (new[-1] - new[0])
        got = {b: sorted((x.id, round(x.t, 7), *(round(v, 9) + 0.0 for v in x.features)) for x in timeseries.align_time(df, ["id"], new, block=b).collect()) for b in (37, 1 << 16)}
        assert got[37] == got[1 << 16] and len(got[37]) == 2 * len(new)
        for name, (up, down) in ratio.items():
            mine = [x for x in rows if x[0] == name]
            y = timeseries.resample(np.array([x[2] for x in mine]), up, down)
            at = mine[0][1] + np.arange(len(y)) / rate
            inside = [x for x in got[37] if x[0] == name and at[0] <= x[1] <= at[-1]]
            assert np.allclose([x[2:] for x in inside], np.stack([np.interp([x[1] for x in inside], at, c) for c in y.T], 1), atol=1e-4)
    for rest in ({"interpolate": False}, {"resample_first": False}, {"resample_first": False, "interpolate": False}):
        a, b = (sorted((x.id, round(x.t, 7), *(round(v, 9) + 0.0 for v in x.features)) for x in timeseries.align_time(df, ["id"], new, block=k, **rest).collect()) for k in (41, 1 << 16))
        assert a == b


@pytest.mark.parametrize("width", [0.01, 300.0])
def test_range_join_over_seven_orders_of_length(spark, width):
    r = random.Random(8)
    spans = [(k, g, a, a + length) for k in range(300) for g in [r.choice("xy")] for a in [r.uniform(-2e5, 2e5)] for length in [10 ** r.uniform(-2, 5)]]
    spans += [(900, "x", 5.0, 5.0), (901, "x", 6.0, 4.0), (902, "x", None, 3.0), (903, None, 0.0, 9.0)]
    points = [(k, r.choice("xyz"), r.uniform(-2e5, 3e5)) for k in range(400)] + [(900, "x", 5.0), (901, "x", 5.0), (902, None, 1.0), (903, "x", None)]
    a = spark.createDataFrame(points, "p long, g string, t double").repartition(3)
    b = spark.createDataFrame(spans, "s long, g string, onset double, offset double").repartition(3)
    want = {(p, s) for p, g, t in points for s, h, x, y in spans if g is not None and g == h and t is not None and x is not None and x <= t <= y}
    got = intervals.range_join(a, b, "t", "onset", "offset", width, ["g"]).collect()
    assert sorted((x.p, x.s) for x in got) == sorted(want)
    left = intervals.range_join(a, b, "t", "onset", "offset", width, ["g"], "left").collect()
    assert sorted((x.p, x.s or -1) for x in left) == sorted([*want, *((p, -1) for p, *_ in points if p not in {q for q, _ in want})])


def test_bins_of_an_interval_do_not_grow_with_its_length(spark):
    spans = spark.createDataFrame([(float(k) / 7, float(k) / 7 + 10.0**e) for k in range(50) for e in range(-2, 6)], "onset double, offset double")
    width = F.pow(F.lit(4.0), intervals.bin_level(F.col("offset") - F.col("onset"), 0.5)) * 0.5
    bins = F.floor(F.col("offset") / width) - F.floor(F.col("onset") / width) + 1
    assert spans.select(F.max(bins)).first()[0] <= 2
