import io
import json
import math
import struct
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import FIX, at
from trackmeter import sinks
from trackmeter.functions.geo import utm
from trackmeter.functions.stats import mann_whitney, spearman, upper_tail, wilson
from trackmeter.operators import accel, bursts, conformance, corpus, declare, drift, export, fence, fleet, noise, sheets, wind
from trackmeter.operators.tracks import track_table, unmarked
from trackmeter.plans import bench_queries
from trackmeter.sources import exports, shapes
from trackmeter.streaming.bursts import gap_sessions, windowed_counts

M = 1 / 111195.08  # a metre of latitude in degrees


def tracks(spark, rows, extra="", kinds=""):
    """(event_id, entity, seconds, lat, lon, ...)"""
    data = [(e, a, int(s * 1_000_000), float(la), float(lo), *x) for e, a, s, la, lo, *x in rows]
    return spark.createDataFrame(data, "event_id bigint, entity string, ts_us bigint, lat double, lon double" + extra)


def test_wilson_published_intervals(spark):
    rows = [(15, 79), (3, 53), (99, 29446), (0, 55), (0, 0)]
    lo, hi = wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame(rows, "k int, n int").select(lo.alias("a"), hi.alias("b")).collect()
    assert [round(100 * x, 1) for x in (got[0].a, got[0].b, got[1].a, got[1].b)] == [11.9, 29.0, 1.9, 15.4]
    assert round(100 * got[2].a, 2) == 0.28 and round(100 * got[2].b, 2) == 0.41
    assert round(100 * got[3].b, 2) == 6.53 and got[4].a is None


def upper_tail_of(spark, z):
    return spark.range(1).select(upper_tail(F.lit(float(z)))).first()[0]


def test_upper_tail_against_the_error_function(spark):
    for z in (-6.0, -1.3, 0.0, 0.7, 3.1, 4.4, 12.0):
        assert upper_tail_of(spark, z) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=2e-7)
    assert spark.range(1).select(upper_tail(F.lit(None).cast("double"))).first()[0] is None


def test_rank_statistics(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 20, 60), rng.integers(3, 25, 40)
    df = spark.createDataFrame([("lo", float(x)) for x in a] + [("hi", float(x)) for x in b] + [("hi", None)], "g string, v double")
    r = mann_whitney(df, "v", "g", "hi", "lo").first()
    u = sum((x > y) + 0.5 * (x == y) for x in b for y in a)
    assert r.u == u and (r.n_high, r.n_low) == (40, 60) and 0 < upper_tail_of(spark, r.z) < 0.5
    p = pd.DataFrame({"x": a[:40], "y": b})
    s = spearman(spark.createDataFrame([(float(x), float(y)) for x, y in p.values], "x double, y double"), "x", "y").first()
    assert s.rho == pytest.approx(p.x.rank().corr(p.y.rank()))
    hot = [(0.0, float(i % 7)) for i in range(200)] + [(float(i), float(i)) for i in range(30)]
    want = pd.DataFrame(hot).rank().corr().iloc[0, 1]
    for most in (0, 1000):  # by salts, and by broadcast
        s = spearman(spark.createDataFrame([*hot, (None, 1.0)], "x double, y double"), "x", "y", most_broadcast=most).first()
        assert s.rho == pytest.approx(want) and s.n == 230
    one = spearman(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "x double, y double"), "x", "y").first()
    none = spearman(spark.createDataFrame([], "x double, y double"), "x", "y").first()
    assert (one.rho, one.n) == (None, 2) and (none.rho, none.n) == (None, 0)


def test_pair_window_burst_break_and_first_fix(spark):
    rows, e = [], 0
    for k, start in enumerate((0, 1000, 2000)):
        for i in range(4):
            e += 1
            rows.append((e, "d", start + 10 * i, 1.0 + (250 * M if i == 0 and k < 2 else 0), 1.0))
    rows += [(50, "e", 0, 1, 1), (51, "e", 4, 1, 1), (52, "e", 9, 1, 1), (53, "e", 69, 1, 1), (54, "e", 130, 1, 1)]
    t = tracks(spark, rows)
    p = fleet.intra_burst_pairs(t)
    assert [r.dt_s for r in p.filter("entity = 'e'").orderBy("end_us").collect()] == [5, 60]
    rank = {r.start_rank: (r.pairs, r.flagged) for r in fleet.rate(p.filter("entity = 'd'"), "start_rank").collect()}
    assert rank == {0: (3, 2), 1: (3, 0), 2: (3, 0)}
    assert sorted(r.event_id for r in fleet.flagged_fixes(p).collect()) == [1, 5]
    assert sorted(r.event_id for r in fleet.flagged_fixes(p, "end").collect()) == [2, 6]
    four = fleet.four_fix_bursts(t, p).collect()
    assert len(four) == 2 and all(r.fix1_m > 240 > 1 > r.fix2_m for r in four)
    ref = spark.createDataFrame([("D", "AB0099", "x"), ("e", "AB100", "y"), ("f", None, "z")], "`animal-id` string, `tag-id` string, taxon string")
    health = fleet.fleet_health(p, ref)
    assert {r.entity: r.batch for r in health.collect()} == {"d": "batch 2008", "e": "batch 2009"}
    assert conformance.cross_check(health, fleet.rate(p, "start_rank")) == 2
    with pytest.raises(conformance.GuardError):
        conformance.cross_check(health, fleet.rate(p.filter("start_rank = 1"), "start_rank"))
    s = fleet.subsampling(t, p).first()
    assert (s.n_bursts, s.n_first, s.above_8_mps) == (5, 2, 0)


def test_spike_detector_flags_only_the_planted_fix(spark):
    rows = [(i, "d", i * 600, 1 + (5000 * M if i == 30 else 0), 1 + i * 100 * M) for i in range(60)]
    t = tracks(spark, rows)
    assert [r.event_id for r in corpus.spike_fixes(t).collect()] == [30]
    m = corpus.measure(t).first()
    assert (m.n_fixes, m.n_triplets, m.gap_mode_s) == (60, 58, 600) and m.pct_spikes == pytest.approx(100 / 58)
    empty = corpus.measure(t.limit(0)).first()
    assert empty.n_fixes == 0 and empty.pct_spikes is None


def test_mode_takes_the_smallest_of_several(spark):
    t, s = [], 0
    for i, g in enumerate((0, 1, 1, 2, 2, 3)):
        s += g
        t.append((i, "d", s, 1, 1))
    r = corpus.cadence(tracks(spark, t)).first()
    assert r.gap_mode_s == 1 and r.gap_median_s == 2


def test_decimals(spark):
    rows = [("-19.1234",), ("-19",), ("-19.00001",), ("0.00001",)]
    got = [r.d for r in spark.createDataFrame(rows, "s string").select(corpus.decimals(F.col("s")).alias("d")).collect()]
    assert got == [4, 0, 5, 5]


def test_burst_fit(spark):
    rows = [(i, "a", i * 10, 0.0, i * 10 * M) for i in range(6)] + [(100 + i, "b", i * 10, (0.5 if i % 2 else -0.5) * M, i * 10 * M) for i in range(6)]
    got = {r.entity: r for r in bursts.burst_features(tracks(spark, rows)).collect()}
    assert got["a"].v_mps == pytest.approx(1, abs=1e-4) and got["a"].resid_m == pytest.approx(0, abs=1e-3)
    t, y = np.arange(6) * 10.0, np.array([-0.5, 0.5] * 3)
    res = y - np.polyval(np.polyfit(t, y, 1), t)
    assert got["b"].resid_m == pytest.approx(math.sqrt(res @ res / 8), rel=1e-3)
    s = bursts.rest_and_move(bursts.burst_features(tracks(spark, rows))).first()
    assert (s.n_bursts, s.n_rest, s.n_move) == (2, 0, 2)


def test_fence_runs_crossings_and_bins(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    xs = [5, 5, 15, 5, 700, 12, 5]
    rows = [(i, "d", 600 * i, 5, x, False) for i, x in enumerate(xs)] + [(99, "e", 0, 5, 20, True)]
    t = tracks(spark, rows, ", flagged boolean")
    p = t.withColumn("inside", fence.in_polygon(F.col("lon"), F.col("lat"), square)).withColumn("d_m", fence.ring_distance(F.col("lon"), F.col("lat"), square))
    exc = fence.excursions(p)
    got = sorted((r.entity, r.n_fixes, r.max_d_m, r.deep, r.n_flagged) for r in exc.collect())
    assert got == [("d", 1, 5, False, 0), ("d", 2, 690, True, 0), ("e", 1, 10, False, 1)]
    c = {r.interval_s: (r.crossings, r.devices) for r in fence.crossings(p, (0, 1200)).collect()}
    assert c == {0: (4, 1), 1200: (2, 1)}  # slots keep fixes 0, 2, 4, 6
    s = fence.excursion_summary(exc).first()
    assert (s.n_excursions, s.n_single, s.n_single_flagged, s.n_deep) == (3, 2, 1, 1)
    many = [(math.cos(a), math.sin(a)) for a in np.linspace(0, 2 * math.pi, 300, endpoint=False)]
    q = spark.createDataFrame([(0.0, 0.5), (0.0, 1.5), (None, 0.0)], "x double, y double").select(fence.in_polygon(F.col("x"), F.col("y"), many).alias("i"))
    assert [r.i for r in q.collect()] == [True, False, None]


def test_unrolled_and_long_rings_agree(spark, monkeypatch):
    ring = [((3 if k % 2 else 5) * math.cos(k * math.pi / 15), (3 if k % 2 else 5) * math.sin(k * math.pi / 15)) for k in range(30)]
    rng = np.random.default_rng(4)
    pts = spark.createDataFrame([(float(x), float(y)) for x, y in rng.uniform(-6, 6, (200, 2))] + [(None, 1.0), (3.0, 0.0)], "x double, y double").coalesce(1)
    look = lambda: [(r.i, r.d) for r in pts.select(fence.in_polygon(F.col("x"), F.col("y"), ring).alias("i"), fence.ring_distance(F.col("x"), F.col("y"), ring).alias("d")).collect()]
    short = look()
    monkeypatch.setattr(fence, "MOST_UNROLLED", 5)
    long = look()
    assert [a for a, _ in short] == [a for a, _ in long] and 50 < sum(bool(a) for a, _ in short) < 150
    assert [b for _, b in short] == pytest.approx([b for _, b in long]) and short[200] == (None, None)


def test_fixes_beyond_the_projection_stay(spark):
    rows = [(1, "d", 0, 1.0, 3.0, False), (2, "d", 60, 1.0, 120.0, False), (3, "d", 120, 89.0, 3.0, True), (4, "d", 180, 1.0, 3.1, False)]
    e, n = utm("lat", "lon", 3.0, south=False)
    t = tracks(spark, rows, ", flagged boolean").withColumns({"e": e, "n": n})
    p = t.withColumn("inside", fence.in_polygon(F.col("e"), F.col("n"), [(0, 0), (505_000, 0), (505_000, 1e6), (0, 1e6)]))
    assert {r.event_id: r.inside for r in p.collect()} == {1: True, 2: None, 3: None, 4: False}
    s = fence.inside_share(p).first()
    assert (s.n_fixes, s.n_inside, s.inside_pct) == (4, 1, 50.0)
    x = fence.excursions(p.withColumn("d_m", F.lit(1.0))).collect()
    assert [(r.first_event_id, r.n_fixes) for r in x] == [(4, 1)]
    assert [(r.flagged, r.n, r.outside) for r in fence.outside_rates(p).collect()] == [(False, 2, 1)]


def test_lines_come_in_parts(spark):
    rows = [(i, "d", 60 * i, 1.0, i / 8, False) for i in range(11)] + [(50, "solo", 0, 1.0, 1.0, False)]
    pts = export.points(tracks(spark, rows, ", flagged boolean"))
    whole = export.tracks_layer(pts).collect()
    assert [(r.part, r.n_fix) for r in whole] == [(0, 11)]
    for layer in (export.tracks_layer(pts, 4), export.day_paths(pts, 4)):
        parts = sorted((r.part, r.n_fix, r.wkt) for r in layer.collect())
        assert [p[:2] for p in parts] == [(0, 5), (1, 5), (2, 3)]  # neighbours share a vertex
        joined = [v for p in parts for v in p[2][12:-1].split(", ")]
        assert [v for k, v in enumerate(joined) if not k or joined[k - 1] != v] == whole[0].wkt[12:-1].split(", ")
    assert export.tracks_layer(export.points(tracks(spark, [(1, "d", 0, 1e-7, -77400000.0, False), (2, "d", 1, 1.0, 1.0, False)], ", flagged boolean"))).first().wkt == "LINESTRING (-77400000.0 0.0000001, 1.0 1.0)"


def test_survey_of_datasets(spark):
    """Each dataset's row equals the measures of that dataset alone; an animal in two of them is two."""
    rng = np.random.default_rng(5)
    rows = [(int(1000 * k + i), a, 600 * i, round(1 + 1e-3 * rng.random(), 5), 2.0, k) for k in (1, 2) for a in ("x", "y") for i in range(60)]
    rows += [(9000, "x", 0, 1.0, 1.0, 3)]
    t = tracks(spark, rows, ", dataset int")
    got = {r.dataset: r.asDict() for r in corpus.measure_by(t, "dataset").collect()}
    assert set(got) == {1, 2, 3} and got[3]["pct_spikes"] is None and got[3]["n_fixes"] == 1
    for k in (1, 2):
        want = corpus.measure(t.filter(F.col("dataset") == k)).first().asDict()
        assert {c: got[k][c] for c in want} == pytest.approx(want)
    assert corpus.measure_by(t.limit(0), "dataset").count() == 0
    files = spark.createDataFrame([("u", "a", 5, "ok"), ("u", "b", 9, "ok"), ("u", "c", 9, "unreadable"), ("v", "d", None, "no position"), ("w", "e", None, "unreadable")], "uuid string, file string, n_fixes int, status string")
    assert {(r.uuid, r.file) for r in corpus.best_file(files).collect()} == {("u", "b"), ("v", "d"), ("w", "e")}
    assert {(r.uuid, r.status, r.n_files) for r in corpus.dataset_status(files).collect()} == {("u", "ok", 3), ("v", "no position", 1), ("w", "unreadable", 1)}


def test_sizes_join_items(spark):
    files = spark.createDataFrame([("u", "ORIGINAL", 2, "b.csv", 5), ("u", "ORIGINAL", 1, "a.csv", None), ("u", "TEXT", 3, "c.txt", 9), (None, "ORIGINAL", 1, "z", 1)], "uuid string, bundle string, seq int, name string, bytes bigint")
    items = spark.createDataFrame([("u", 1), ("none", 2)], "uuid string, seq int")
    got = {r.uuid: (r.bytes_published, r.fichiers) for r in corpus.with_sizes(items, corpus.file_sizes(files)).collect()}
    assert got == {"u": (5, "a.csv | b.csv"), "none": (0, "")}


def test_four_fix_and_gate_summaries(spark):
    rows, e = [], 0
    for k in range(6):
        for i in range(4):
            e += 1
            rows.append((e, "d", 2000 * k + 10 * i, 1.0 + (300 * M if i == 0 and k % 2 else 0), 1.0 + i * M))
    t = tracks(spark, rows)
    p = fleet.intra_burst_pairs(t)
    s = fleet.four_fix_summary(fleet.four_fix_bursts(t, p)).first()
    assert s.n_bursts == 3 and s.fix1_is_outlier_pct == 100 and s.fix1_median_m == pytest.approx(300, abs=1) and s.fix2_median_m < 3
    j = fleet.contaminated_jumps(p).first()
    assert j.n == 3 and j.median_mps == pytest.approx(300 / 1200, abs=1e-3) and j.p90_jump_m <= j.max_jump_m
    from trackmeter.operators.tracks import consecutive_pairs

    g = fleet.speed_gate_summary(consecutive_pairs(t)).first()
    assert (g.n_pairs, g.n_flagged) == (23, 3) and g.median_jump_m == pytest.approx(300, abs=1)
    none = fleet.contaminated_jumps(fleet.intra_burst_pairs(t.limit(0))).first()
    assert none.n == 0 and none.median_mps is None and fleet.speed_gate_summary(consecutive_pairs(t.limit(0))).first().pct is None


def test_detector_report_states_both_arms(spark):
    rows = [("gps", float(i % 5)) for i in range(30)] + [("argos-doppler-shift", float(4 + i % 3)) for i in range(12)] + [("gnss", None), ("other", 9.0)]
    r = {x.labels: x for x in corpus.detector_report(spark.createDataFrame(rows, "sensor string, pct_spikes double"), (("gps",), ("gnss",))).collect()}
    assert (r["gps"].n_high, r["gps"].n_low, r["gps"].median_high, r["gps"].median_low) == (12, 30, 5.0, 2.0) and r["gps"].p < 1e-5
    assert (r["gnss"].n_high, r["gnss"].n_low, r["gnss"].median_low, r["gnss"].p) == (12, 0, None, None)
    conformance.require_robust([r["gps"].p])


def test_thermal_pairs_by_cell_are_all_near_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(f"b{i % 9}", i, int(rng.integers(0, 900)), float(rng.choice([10.0, 89.9, -60.0])) + float(rng.uniform(-0.02, 0.02)), float(rng.choice([20.0, 179.99])) + float(rng.uniform(-0.02, 0.02)), 100.0, 1.0, 2.0, 2.2) for i in range(150)]
    rows = [(*r[:4], r[4] - 360 if r[4] > 180 else r[4], *r[5:]) for r in rows]
    sp = spark.createDataFrame(rows, "entity string, island int, start_s int, lat double, lon double, altitude_m double, wind_east double, wind_north double, wind double")
    key = lambda d: {(r.a_island, r.b_island) for r in d.collect()}
    every, near = key(wind.same_thermal(wind.spiral_pairs(sp))), key(wind.spiral_pairs(sp, km=2.0))
    assert near == every and len(every) > 100
    a = wind.agreement(wind.spiral_pairs(sp, km=2.0)).first()
    assert (a.n_pairs, a.max_gap) == (len(every), 0.0)


def test_noise_battery_and_device_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "d", i, rng.normal() * M, rng.normal() * M, 0.05, 5.0) for i in range(60)]
    w = noise.still_windows(tracks(spark, rows, ", speed_mps double, h_accuracy_m double"), 0, 0).collect()
    assert len(w) == 1 and 0.7 < w[0].sigma_m < 1.3 and w[0].acc_m == 5
    classes = spark.createDataFrame([(0.0,), (3.0,), (5.0,), (41.0,)], "a double").select(noise.accuracy_class(F.col("a")).alias("c"))
    assert [r.c for r in classes.collect()] == [None, "<3", "3-5", ">40"]
    days = [(i, "d", i * 86400, 0, 0, 4000.0 - 2 * i, 3900.0 - 5 * i) for i in range(10)]
    s = noise.battery_slopes(noise.battery_days(tracks(spark, days, ", x_battery_mv double, x_fix_battery_mv double"))).first()
    assert s.rest_slope == pytest.approx(-2) and s.sag_slope == pytest.approx(3)
    both = [(i * 2 + k, "ab"[k], i, (k * 10 + rng.normal()) * M, rng.normal() * M) for i in range(200) for k in (0, 1)]
    pr = noise.device_pairs(tracks(spark, both), 0, 0, least=100).first()
    assert (pr.a, pr.b, pr.n_seconds) == ("a", "b", 200) and 0.8 < pr.sigma_each_m < 1.2


def test_all_device_pairs_come_out(spark):
    rows = [(100 * k + i, f"d{k:02}", i, k * M, i * M) for k in range(12) for i in range(3)]
    p = noise.device_pairs(tracks(spark, rows), 0, 0, least=3)
    assert p.count() == 66  # of 12 devices
    assert [(r.a, r.b) for r in noise.device_pairs(tracks(spark, rows), 0, 0, least=3, most=2).collect()] == [("d00", "d01"), ("d00", "d02")]


def test_sphere_spectrum_and_classes(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 3))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) * 420 + [2000, 2050, 1980]
    f = spark.createDataFrame([("d", *map(float, x)) for x in v], "entity string, ax_mean double, ay_mean double, az_mean double")
    c = accel.calibrate(f).first()
    assert [c.off_x, c.off_y, c.off_z, c.counts_per_g] == pytest.approx([2000, 2050, 1980, 420], abs=1e-3) and c.residual_pct < 1e-6
    sig = [(k, 0, [float(math.sin(2 * math.pi * hz * i / 12)) for i in range(240)]) for k, hz in ((1, 2.0), (2, 2.05))] + [(3, 0, [1.0] * 240), (4, 0, [1.0] * 50)]
    fr = accel.frames(spark.createDataFrame(sig, "k int, class int, signal array<double>"), ["k", "class"])
    assert fr.filter("k = 1").count() == (240 - 96) // 48 + 1 and fr.filter("k = 4").count() == 0
    sp = accel.spectra(fr, ["k", "class"], 96)
    for k in (1, 2):
        assert accel.mean_spectra(sp.filter(f"k = {k}"), 96, 12.0, least=0).first().stride_hz == 2.0
    assert sp.filter("k = 3").count() == 0
    vs = spark.createDataFrame([(0.0,), (0.25,), (-0.1,), (7.0,), (None,)], "v double").select(accel.speed_class(F.col("v")).alias("c"))
    assert [r.c for r in vs.collect()] == [0, 1, None, None, None]
    xyz = spark.createDataFrame([("1 2 3 4 5 6 7 8 9 10",), ("1 2 3",), ("1 x 3 4 5 6 7 8 9",), (None,)], "t string").select(accel.text_samples(F.col("t")).alias("s"))
    assert [len(r.s) if r.s else None for r in xyz.collect()] == [3, None, None, None]


def test_frames_span_the_bursts_of_a_stretch(spark):
    wave = lambda s, n=12: [float(math.sin(2 * math.pi * 2.5 * (12 * s + i) / 12)) for i in range(n)]
    edge = 8 * 86400 * 2000  # the edge of a block
    rows = [("d", edge - 20 + s, wave(s), 1.0 + (s % 2) if s < 30 else None) for s in range(40)]  # 40 s over the edge
    rows += [("d", edge + 100 + s, wave(s), 1.0) for s in range(7)]  # too short
    rows += [("d", edge + 200 + s, None if s == 9 else wave(s), 1.0) for s in range(18)]  # broken by a burst without signal
    rows += [("e", edge + s, wave(0, 5 + s % 3), 3.0) for s in range(20)]  # bursts of uneven length
    data = [(i, a, s * 1_000_000 + 500, x, v) for i, (a, s, x, v) in enumerate(rows)]
    data += [(1000, "d", (edge - 20) * 1_000_000 + 900, wave(3), 9.0)]  # a second burst in one second
    df = spark.createDataFrame(data, "event_id bigint, entity string, ts_us bigint, signal array<double>, v double")
    got = {(r.entity, r.stretch, r.frame): (r.seg, r.v) for r in accel.spliced_frames(df).collect()}
    want = {}
    for a in "de":
        own, runs = [r for r in rows if r[0] == a and r[2]], []
        for r in own:
            if not runs or r[1] != runs[-1][-1][1] + 1:
                runs.append([])
            runs[-1].append(r)
        for k, run in enumerate(runs, 1):
            flat = [(x, j) for j, r in enumerate(run) for x in r[2]]
            for f in range((len(flat) - 96) // 48 + 1):
                seg = flat[48 * f : 48 * f + 96]
                vs = [run[j][3] for j in {j for _, j in seg} if run[j][3] is not None]
                want[a, k, f] = ([x for x, _ in seg], sum(vs) / len(vs) if vs else None)
    assert got.keys() == want.keys() and len(want) == 9 + 1 + 1 + 1
    for k, (seg, v) in want.items():
        assert got[k] == (seg, pytest.approx(v))
    sp = accel.spectra(accel.spliced_frames(df).filter("entity = 'd'").withColumn("class", F.lit(0)), ["entity", "stretch", "class"], 96)
    assert accel.mean_spectra(sp, 96, 12.0, least=0).first().stride_hz == 2.5  # in bursts of 12 alone there is no frame of 96


def test_wind_from_a_planted_circle(spark):
    rows, x, y = [], 0.0, 0.0
    for i in range(130):
        rows.append((i, "bird", i, y * M, x * M, 100.0 + i))
        a = math.radians(12 * i)
        x, y = x + 10 * math.sin(a) + 3, y + 10 * math.cos(a) + 4
    s = wind.spirals(tracks(spark, rows, ", altitude_gps_m double")).collect()
    assert len(s) == 1
    assert s[0].wind_east == pytest.approx(3, abs=0.6) and s[0].wind_north == pytest.approx(4, abs=0.6) and s[0].airspeed == pytest.approx(10, abs=0.6)
    items = [("a", 1, 0, 0.0, 0.0, 100.0, 1.0, 1.0, 1.4), ("b", 1, 300, 0.0, 0.01, 399.0, 1.0, 2.0, 2.2), ("c", 1, 301, 0.0, 0.0, 100.0, 1.0, 1.0, 1.4), ("a", 2, 5, 0.0, 0.0, 100.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(items, "entity string, island int, start_s bigint, lat double, lon double, altitude_m double, wind_east double, wind_north double, wind double")
    pairs = sorted((r.a_entity, r.a_island, r.b_entity) for r in wind.spiral_pairs(df).collect())
    assert pairs == [("a", 1, "b"), ("a", 2, "b"), ("a", 2, "c"), ("b", 1, "c")]


def test_declarations(spark):
    rule = "\n------\n"
    t = [
        (1, "[dc.title] Duplicated fixes\n[dc.other] spike\n\n===README===\nclean" + rule + "manually marked outlier"),
        (2, "[dc.title] x\n\n===README===\nhello" + rule + "THIS DATASET: coordinates were rounded, rounded again and truncated and rounding then jittered"),
        (3, None),
        (4, ""),
    ]
    got = {r.doc_id: r for r in declare.scan(spark.createDataFrame(t, "doc_id int, text string"), with_passages=True).collect()}
    assert got[1].says_repetition and not got[1].says_spikes and got[1].template_spikes and got[1].readme
    assert got[2].says_truncation and got[2].note and got[2].passages_truncation.count(" || ") == 2
    assert not got[3].readme and got[3].n_chars == 0 and not got[4].says_spikes
    q = spark.createDataFrame([("a", 6.0, 4, 0.0), ("b", 1.0, 7, 0.1), ("c", None, None, None)], "uuid string, pct_repeated double, decimals_lat int, pct_spikes double")
    p = declare.properties(q).withColumns({f"{k}_{f}": F.lit(True) for k in ("says", "template") for f in declare.FAMILIES})
    c = {r.family: (r.n_case, r.n_control) for r in declare.case_control(p, list(declare.FAMILIES)).collect()}
    assert c == {"repetition": (1, 1), "truncation": (1, 1), "spikes": (1, 1)}


def test_guards_can_fail(spark):
    with pytest.raises(conformance.GuardError):
        conformance.require_robust([1e-7, 1e-3])
    conformance.require_robust([1e-7, 1e-6])
    t = tracks(spark, [(1, "d", 10, 1, 1, 0.1), (2, "d", 5, 91, 1, -1.0), (3, "e", 1, 1, 1, None)], ", speed_mps double")
    rep = {r.entity: r for r in conformance.device_report(t).collect()}
    assert (rep["d"].off_globe, rep["d"].backwards, rep["d"].negative_speed, rep["d"].ok, rep["e"].ok) == (1, 1, 1, False, True)
    with pytest.raises(conformance.GuardError):
        conformance.require_valid(conformance.device_rules(t))
    assert conformance.mapping_for(["timestamp", "location-lat", "height-above-msl"]) is None
    m = conformance.mapping_for(["timestamp", "location-lat", "location-long", "height-above-msl", "height-above-ellipsoid"])
    assert m["altitude_gps_m"] == ("height-above-ellipsoid", "m")
    causes = spark.createDataFrame([("x", c) for c in "aaabbccd"] + [("y", None)], "status string, detail string")
    assert [(r.detail, r.n) for r in conformance.top_causes(causes).orderBy("rank").collect()] == [("a", 3), ("b", 2), ("c", 2)]
    warn = spark.createDataFrame([("p | q",), ("q",), (None,)], "warnings string")
    assert [(r.warning, r.n) for r in conformance.top_warnings(warn).collect()] == [("q", 2), ("p", 1)]


def test_every_value_of_a_file_is_looked_at(spark):
    head = "timestamp,location-lat,location-long,ground-speed,height-above-msl,height-above-ellipsoid"
    body = {
        "clean": ["2020-01-01 00:00:00,1,2,3.5,x,7", "01/02/2020 10:11:12,1,2,,,NaN", "2020-01-01T00:00:00Z,1,2,1e-3,,"],
        "comma": ['2020-01-01 00:00,1,2,"5,11",,7'],
        "unit": ["2020-01-01 00:00,1,2,3,,1060.2 m"],
        "time": ["soon,1,2,3,,7", "10:11:12,1,2,3,,7"],
        "globe": ["2020-01-01 00:00:00,91,2,3,,7", "2020-01-01 00:00:00,-1,181,3,,7"],
        "short": ["2020-01-01 00:00:00,1,2"],
        "long": ["2020-01-01 00:00:00,1,2,3,,7,8"],
        "cut": ["2020-01-01 00:00:00,1,2,3,,7"],
        "empty": [],
    }
    lines = [(f, i, x) for f, b in body.items() for i, x in enumerate([head, *b])] + [("scope", 0, "timestamp,place"), ("scope", 1, "t,p"), ("bare", 1, "1,2"), ("blank", 0, " ")]
    lines += [("twice", 0, head + ",timestamp"), ("twice", 1, "2020-01-01 00:00:00,1,2,3,,7,x")]
    files = [(f, len(b) + (f == "cut")) for f, b in body.items()] + [("scope", 1), ("bare", 1), ("gone", 3), ("blank", 0), ("twice", 1)]
    df = spark.createDataFrame(lines, "file_id string, line_no int, line string")
    heads = drift.headers(df, spark.createDataFrame([("timestamp", "text")], "field string, value_type string"))
    rep = conformance.file_report(df, drift.parsed(df, heads), heads, spark.createDataFrame(files, "file_id string, n_records int"))
    assert {r.file_id: (r.status, r.errors, r.detail) for r in rep.collect()} == {
        "clean": ("conformant", 0, None),
        "comma": ("conversion failed", 1, "1 values that do not cast"),
        "unit": ("conversion failed", 1, "1 values that do not cast"),
        "time": ("conversion failed", 2, "2 unreadable times"),
        "globe": ("non-conformant", 2, "2 points off the globe"),
        "short": ("non-conformant", 1, "1 short lines"),
        "long": ("conversion failed", 1, "1 long lines"),
        "cut": ("damaged archive", 0, "1 of 2 lines"),
        "scope": ("out of scope", 0, "neither time nor position among the columns"),
        "bare": ("unreadable", 0, "no header line"),
        "empty": ("validation failed", 0, None),
        "blank": ("no usable file", 0, "no text"),
        "twice": ("mapping refused", 0, "a column comes twice"),
        "gone": ("damaged archive", 0, "0 of 3 lines"),
    }


def test_sheets(spark):
    q = spark.createDataFrame(
        [("t", 0.06, 6.0, 4, 11.1, 50.0, 100, 3, 10.0, 89.0, 5400.0, 172800.0), ("u", 0.0, 0.0, 6, 0.1, 99.0, 100, 3, 10.0, 90.0, 5399.0, None)],
        "title string, pct_spikes double, pct_repeated double, decimals_lat int, least_step_m double, regular_pct double, n_fixes int, n_individuals int, days double, gap_median_s double, gap_mode_s double, gap_p95_s double",
    )
    lic = spark.createDataFrame([("t", "CC0")], "uuid string, licence string")
    got = {r.title: r for r in sheets.sheet_text(sheets.with_licence(q.withColumn("uuid", F.col("title")), lic)).collect()}
    assert len(got["t"].limits) == 4 and got["u"].limits == ["None found by these tests"]
    assert "89 s" in got["t"].sheet and "1.5 h" in got["t"].sheet and "2.0 d" in got["t"].sheet and "CC0" in got["t"].sheet
    assert "90 min" in got["u"].sheet and "unknown" in got["u"].sheet and "not declared" in got["u"].sheet


def test_grain_by_device_is_not_hidden_by_one_fine_fix(spark):
    rows = [(i, "cut", i, 1 + i * 0.001, 1) for i in range(9)] + [(20, "cut", 20, 1.1234567, 1)]
    rows += [(30, "one", 0, 1.5, 1), (40, "even", 0, 1.25, 1), (41, "even", 1, 1.123456, 1)]
    got = {r.entity: (r.decimals_lat, r.least_step_m and round(r.least_step_m, 3)) for r in corpus.grain_by_device(tracks(spark, rows)).collect()}
    assert got == {"cut": (3, 111.32), "one": (1, None), "even": (4, 14086.878)}
    kinds = "entity string, pct_spikes double, pct_repeated double, decimals_lat int, least_step_m double, regular_pct double"
    df = spark.createDataFrame([("cut", 0.0, 0.0, 3, 111.32, 99.0), ("one", 0.0, 0.0, 1, None, 99.0)], kinds)
    read = {r.entity: (r.read_grain, r.limits) for r in sheets.readings(df).collect()}
    assert read["cut"] == ("truncated at export, grid of about 111 m", ["Any analysis finer than 111 m"])
    assert read["one"] == ("truncated at export, grid of about unknown size", ["Any analysis finer than unknown size"])


def test_sheets_show_the_median_grain(spark, tmp_path):
    rows = [(i, at(i * 600), 1 + (i % 7) * 0.001 if i != 5 else 1.1234567, 2.0, "a", at(10**6)) for i in range(12)]
    spark.createDataFrame(rows, FIX).write.parquet(str(tmp_path / "position_fixes.parquet"))
    sheet = bench_queries.quality_sheets(spark, str(tmp_path)).first().sheet
    assert "| Coordinate grain | 3 decimals, truncated at export, grid of about 111 m |" in sheet


def test_sources_sinks_and_export(spark, tmp_path):
    head = "timestamp,location-lat,location-long,individual-local-identifier,sensor-type,event-id"
    body = [f"2020-01-01 00:{i:02d}:00.000,{1 + i / 1000},2.0,Ann,gps,{i}" for i in range(30)] + ["short,line"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("\n".join([head, *body]))
    with zipfile.ZipFile(tmp_path / "in/b.zip", "w") as z:
        z.writestr("x.csv", "\n".join([head, *body[:5]]))
    (tmp_path / "in/c.csv").write_text("timestamp,light\n1,2")
    (tmp_path / "in/d.zip").write_bytes(b"no archive")
    rows = exports.read_archives(spark, str(tmp_path / "in"))
    got = {r.file.rsplit("/", 1)[-1]: (r.status, r.n_rows) for r in exports.archive_status(rows, least=10).collect()}
    assert got == {"a.csv": ("ok", 30), "b.zip": ("unreadable", 5), "c.csv": ("no position", 0), "d.zip": ("unreadable", 0)}
    df = exports.typed_export(exports.read_export(spark, str(tmp_path / "in/a.csv")))
    t = unmarked(track_table(df, ("lat", "lon", "x_manual_outlier", "sensor")))
    assert t.count() == 30 and t.filter("sensor = 'gps'").count() == 30
    sinks.write_validated(t, conformance.device_rules(t.withColumn("speed_mps", F.lit(1.0))), str(tmp_path / "out"), "entity")
    assert spark.read.parquet(str(tmp_path / "out")).filter("entity = 'ann'").count() == 30
    with pytest.raises(conformance.GuardError):
        sinks.write_validated(t, conformance.device_rules(t.withColumn("speed_mps", F.lit(-1.0))), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    pts = export.points(t.withColumn("flagged", F.lit(False)))
    line = export.geojson(export.tracks_layer(pts)).first()
    assert line.n_fix == 30 and line.wkt.startswith("LINESTRING (2.0 1.0, 2.0 1.001") and len(json.loads(line.feature)["geometry"]["coordinates"]) == 30
    sinks.write_keyed_csv(t.select("entity", "event_id"), str(tmp_path / "csv"), ["entity", "event_id"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 30
    sinks.write_report(conformance.with_provenance(t.groupBy().count()), str(tmp_path / "rep"))
    assert exports.read_report(spark, str(tmp_path / "rep/*.txt")).first()["count"] == 30
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    rec = struct.pack("<i4d2i", 5, 0, 0, 1, 1, 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp = struct.pack(">i", 9994) + b"\0" * 96 + struct.pack(">2i", 1, len(rec) // 2) + rec
    (tmp_path / "p.shp").write_bytes(shp)
    assert shapes.read_rings(str(tmp_path / "p.shp")) == [ring] == [fence.closed(fence.largest_ring([ring[:3], ring[:1]]))]
    assert shapes.read_regions(spark, str(tmp_path / "p.shp")).count() == 1


def test_small_parts(spark):
    names = spark.createDataFrame([("a.CSV",), ("a readme.csv",), ("b.zip",), ("c.txt",), (None,)], "name string")
    assert [r.name for r in names.filter(exports.wanted_file(F.col("name"))).collect()] == ["a.CSV", "b.zip"]
    long = sinks.spectra_long(spark.createDataFrame([("a", [0.25, 0.75])], "entity string, power array<double>"), ["entity"]).collect()
    assert [tuple(r) for r in long] == [("a", 0, 0.25), ("a", 1, 0.75)]
    df = spark.createDataFrame([("t", 1.0, 2.0, 3.0, "x")], "timestamp string, `location-lat` double, `location-long` double, `height-above-msl` double, other string")
    assert conformance.project(df).columns == ["ts", "lat", "lon", "altitude_gps_m"] and conformance.project(df.drop("timestamp")) is None
    assert accel.transition_speed() == pytest.approx(1.4006, abs=1e-3)
    meta = spark.createDataFrame([({"k": ["v", "", None], "e": []},), (None,)], "m map<string,array<string>>").select(declare.flatten_metadata(F.col("m")).alias("t"))
    assert [r.t for r in meta.collect()] == ["[k] v", None]
    p = spark.createDataFrame([("x" * 200 + " repeated and\tstale " + "y" * 200 + " duplicated",), ("nothing",), (None,)], "t string").select(declare.passages(F.col("t"), declare.FAMILIES["repetition"]).alias("p"))
    got = [r.p for r in p.collect()]
    a, b, c = got[0].split(" || ")
    assert a == "x" * 89 + " repeated and stale " + "y" * 79 and b == "x" * 76 + " repeated and stale " + "y" * 89 and c == "y" * 89 + " duplicated" and got[1:] == [None, None]


def test_counts_by_window_of_a_stream(spark, tmp_path):
    rows = [("a", 10.0, 1.0), ("a", 3599.0, 4.0), ("a", 3600.0, 2.0), ("b", 5.0, None), ("a", 900_000.0, 1.0)]
    spark.createDataFrame([(e, at(s), v) for e, s, v in rows], "entity string, ts timestamp_ntz, speed_mps double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity string, ts timestamp_ntz, speed_mps double").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.format("memory").queryName("by_window").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.entity, r.n_fixes, r.fastest_mps) for r in spark.table("by_window").collect())
    assert got == [("a", 1, 1.0), ("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, None)]


def test_a_device_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "entity string, lat double").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).filter("entity = 'a'").select("lat")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(entity,a)" in plan and "ReadSchema: struct<entity:string,lat:double>" in plan


def test_csv_files_in_many_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\ufefftimestamp,location-lat,location-long,individual-local-identifier,note\r\n" + "".join(f'{i},1.{i},2,Ann,"a, b"\r\n' for i in range(400)))
    (tmp_path / "b.CSV").write_text("location-long,individual-local-identifier,timestamp,location-lat\n5,Bo,7,6\n5,Bo\n")
    (tmp_path / "c.csv").write_text("\n")
    (tmp_path / "d.csv").write_text("timestamp,location-lat,location-long\n1,2,3\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        df = exports.read_csv_files(spark, str(tmp_path), (*exports.NEEDED, "note", "argos:lc"))
        rows = df.collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    by = {}
    for r in rows:
        by.setdefault(r.file.rsplit("/", 1)[-1], []).append(r)
    assert {r.timestamp for r in by["a.csv"]} == {str(i) for i in range(400)} and len(by["a.csv"]) == 400
    assert all(r["note"] == "a, b" and r["argos:lc"] is None and r.problem is None for r in by["a.csv"])
    assert [(r.timestamp, r["location-lat"], r["location-long"], r["individual-local-identifier"]) for r in by["b.CSV"]] == [("7", "6", "5", "Bo")]
    assert [r.problem for r in by["c.csv"]] == ["no position"] and [r.problem for r in by["d.csv"]] == ["unreadable: no individual-local-identifier"]


def test_what_is_written_is_what_is_judged(spark, tmp_path):
    t = tracks(spark, [(1, "d", 10, 1, 1, 0.1)], ", speed_mps double")
    assert sinks.write_then_validate(t, str(tmp_path / "good"), conformance.device_rules).count() == 1
    with pytest.raises(conformance.GuardError):
        sinks.write_then_validate(t.withColumn("lat", F.lit(91.0)), str(tmp_path / "bad"), conformance.device_rules)
    assert not (tmp_path / "bad").exists()
    sinks.spectra_long(spark.createDataFrame([("a", [0.25, 0.5, 0.25])], "entity string, power array<double>"), ["entity"]).write.parquet(str(tmp_path / "s"))
    assert [tuple(r) for r in exports.read_spectra(spark, str(tmp_path / "s"), ["entity"]).collect()] == [("a", [0.25, 0.5, 0.25])]


def test_streamed_sessions_match_gaps(spark, tmp_path):
    secs = [0, 59, 119.9, 180, 400, 461]
    spark.createDataFrame([("a", at(s)) for s in secs] + [("a", at(10**6))], "entity string, ts timestamp_ntz").write.parquet(str(tmp_path / "s"))
    q = gap_sessions(spark.readStream.schema("entity string, ts timestamp_ntz").parquet(str(tmp_path / "s")))
    run = q.writeStream.outputMode("append").format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = sorted(r.n_fixes for r in spark.sql("select * from sessions_out").collect())
    assert got == [1, 1, 3, 1] or got == sorted([3, 1, 1, 1])
