import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackmeter.functions.geo import EARTH_RADIUS_M, haversine_m, utm, wrap_180
from trackmeter.operators.fixes import DAY_US, dated_records, in_blocks, placed_records, with_neighbours
from trackmeter.operators.quantile import grouped_quantile, quantile_in_rows, summary_quantiles
from trackmeter.operators.tracks import gap_bursts

CLASH = ["entity", "blk", "ts_us", "lat", "_seen", "step"]


def hav(p, q):
    a, b = math.radians(p[0]), math.radians(q[0])
    x = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(1, x)))


def test_haversine_known_values_and_null(spark):
    rows = [(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0, 180.0), (0.0, 0.0, None, 1.0)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double").select(haversine_m("a", "b", "c", "d").alias("m")).collect()
    got = [r.m for r in d]
    assert got[0] == 0 and got[3] is None
    assert got[1] == pytest.approx(2 * math.pi * EARTH_RADIUS_M / 360)
    assert got[2] == pytest.approx(math.pi * EARTH_RADIUS_M)


def test_utm_and_wrap(spark):
    e, n = utm(F.lit(-19.0), F.lit(15.0))
    e2, _ = utm(F.lit(-19.0), F.lit(16.0))
    r = spark.range(1).select(e.alias("e"), n.alias("n"), e2.alias("e2"), wrap_180(F.lit(190.0)).alias("w")).first()
    assert r.e == pytest.approx(500000, abs=1e-3)
    assert r.n == pytest.approx(7899107, abs=400)
    assert 104_000 < r.e2 - r.e < 106_500 and r.w == -170


def test_copies_nulls_and_clashing_columns(make_fixes):
    rows = [
        (1, 5, 1.0, 1.0, " Ann ", 100),
        (1, 9, 2.0, 2.0, "ann", 50),
        (1, 9, 2.0, 2.0, "ann", 50),
        (2, None, 1.0, 1.0, "ann"),
        (3, 1, 1.0, 1.0, None),
        (None, 1, 1.0, 1.0, "ann"),
        (4, 1, None, 1.0, "ANN"),
        (5, 1, float("nan"), 1.0, "ann"),
    ]
    f = make_fixes(rows, CLASH)
    got = {(r.event_id, r.entity) for r in dated_records(f).collect()}
    assert got == {(1, "ann"), (4, "ann"), (5, "ann")}
    placed = placed_records(f).collect()
    assert [(r.event_id, r.lat) for r in placed] == [(1, 2.0)]
    assert dated_records(make_fixes([])).count() == 0


def test_neighbours_across_blocks(make_fixes):
    rng = random.Random(3)
    rows = [(i, rng.randrange(0, 40 * 86400), rng.random(), rng.random(), f"a{rng.randrange(3)}") for i in range(300)]
    df = with_neighbours(in_blocks(placed_records(make_fixes(rows)), ["lat"], DAY_US), ["lat"], before=3, after=2)
    got = {r.event_id: [r.p3_event_id, r.p2_event_id, r.p1_event_id, r.n1_event_id, r.n2_event_id] for r in df.collect()}
    want = {}
    for a in {r[4] for r in rows}:
        own = [r[0] for r in sorted((x for x in rows if x[4] == a), key=lambda x: (x[1], x[0]))]
        for i, e in enumerate(own):
            want[e] = [own[j] if 0 <= j < len(own) else None for j in (i - 3, i - 2, i - 1, i + 1, i + 2)]
    assert got == want


def test_bursts_across_blocks(make_fixes):
    rng = random.Random(5)
    t, rows = 0, []
    for i in range(200):
        t += rng.choice([0, 30, 60, 61, 4000, 90000])
        rows.append((i, t, 1.0, 1.0, "a"))
    df = gap_bursts(placed_records(make_fixes(rows)), 60, block_us=3600 * 1_000_000)
    got = {r.event_id: (r.island, r["rank"], r["size"]) for r in df.collect()}
    runs, last = [], None
    for e, s, *_ in rows:
        if last is None or s - last > 60:
            runs.append([])
        runs[-1].append(e)
        last = s
    assert got == {e: (k + 1, i, len(run)) for k, run in enumerate(runs) for i, e in enumerate(run)}


def test_quantile_is_exact_with_ties_and_negatives(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=501) * 100, "b": np.repeat([0.0, 5.0], [90, 10]), "c": np.array([1.0, 2.0, 4.0, 10.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("d", None)], "k string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.q for r in grouped_quantile(df, ["k"], "v", q).collect()}
        assert got == pytest.approx({k: float(np.quantile(vs, q)) for k, vs in groups.items()})
    one = summary_quantiles(df, {"m": (F.col("v"), 0.5), "none": (F.lit(None).cast("double"), 0.5)}).collect()
    assert one[0].m == pytest.approx(float(np.quantile(np.concatenate(list(groups.values())), 0.5))) and one[0].none is None


def test_scratch_removes_what_operators_wrote(spark):
    import os

    from trackmeter.session import Written, scratch

    kept = Written(spark)
    kept.put(spark.range(3), "t")
    with scratch(spark):
        inner = Written(spark)
        assert inner.put(spark.range(5), "t").count() == 5
        assert os.path.isdir(inner.root.removeprefix("file://"))
    assert not os.path.isdir(inner.root.removeprefix("file://")) and kept.get("t").count() == 3


def test_quantile_of_written_rows(spark):
    rng = random.Random(1)
    rows = [("a", rng.choice([0.0, rng.random(), -3.0, 1e6])) for _ in range(500)] + [("b", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for most in (0, 1000):
        got = {r.k: (r.q, r.n) for r in quantile_in_rows(df, ["k"], "v", 0.95, most_broadcast=most).collect()}
        assert got == {"a": (pytest.approx(np.quantile([v for k, v in rows if k == "a"], 0.95)), 500), "b": (1.0, 1)}
