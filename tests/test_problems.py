import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_core import CLASH, hav
from trackmeter.functions.geo import EARTH_RADIUS_M
from trackmeter.operators import drift, spatial, spikes
from trackmeter.operators.fixes import BLOCK_US, DAY_US
from trackmeter.operators.packed import all_bursts, odd_bursts
from trackmeter.operators.sessions import sessions
from trackmeter.operators.spatial import Grid, HotNodes, ear_clip, near_pairs, region_candidates, regions_of_points
from trackmeter.operators.spikes import SPARSE, Steps, chosen_cells, implausible, robust_components
from trackmeter.plans import problem_queries


def brute_implausible(rows):
    own, bad = {}, set()
    for e, s, la, lo, a, *_ in rows:
        own.setdefault(a, []).append((s, e, la, lo))
    for recs in own.values():
        recs.sort()
        pos = [(r[2], r[3]) for r in recs]
        steps = [hav(p, q) for p, q in zip(pos, pos[1:])]
        for r in recs:
            if abs(r[2]) > 90 or abs(r[3]) > 180 or (r[2] == 0 and r[3] == 0):
                bad.add(r[1])
        if not steps:
            continue
        lim = 10 * np.quantile(steps, 0.95)
        for i in range(1, len(recs)):
            for k in (1, 2, 3):
                if i + k < len(recs) and hav(pos[i - 1], pos[i + k]) <= lim:
                    if all(hav(pos[i - 1], pos[j]) > lim and hav(pos[i + k], pos[j]) > lim for j in range(i, i + k)):
                        bad |= {recs[j][1] for j in range(i, i + k)}
        if sum(s == 0 for s in steps) < 0.1 * len(steps):
            i = 0
            while i < len(pos):
                j = i
                while j + 1 < len(pos) and pos[j + 1] == pos[i]:
                    j += 1
                if j - i >= 5:
                    bad |= {recs[x][1] for x in range(i, j + 1)}
                i = j + 1
    return bad


@pytest.mark.parametrize("seed", [1, 2])
def test_implausible_against_brute_force(make_fixes, seed):
    rng = random.Random(seed)
    rows, e = [], 0
    for a in ("x", "y", "still"):
        la, lo, t = 1.0, 2.0, 0
        for i in range(260):
            e += 1
            t += rng.choice([600, 600, 3600, 40000])
            if a != "still":
                la += rng.uniform(-1, 1) * 1e-3
                lo += rng.uniform(-1, 1) * 1e-3
            far = a == "x" and i in (40, 41, 90, 120, 121, 122, 200, 201, 202, 203)
            where = (0.0, 0.0) if i == 150 else (95.0, lo) if i == 151 else (la + far * (1 + i), lo)
            if a == "y" and 60 <= i < 66:
                where = (la if i > 60 else la, 7.0)
                la_keep = la if i == 60 else la_keep
                where = (la_keep, 7.0)
            rows.append((e, t, *where, a))
    rows += rng.sample(rows, 20)
    got = {r.event_id for r in implausible(make_fixes(rows, CLASH), block_us=4 * DAY_US).collect()}
    assert got == brute_implausible(list(dict.fromkeys(rows)))
    assert len(got) > 15


def test_frozen_run_from_a_lone_record_before_a_block_edge(make_fixes):
    edge = 2 * 86400  # 8-day blocks since 1970 begin two days after the first of March 2004
    rows = [(1, edge - 60, 1.0, 2.0, "a")] + [(2 + i, edge + 60 * i, 1.0, 2.0, "a") for i in range(5)]
    rows += [(100 + i, edge + 1000 + 600 * i, 1.0 + 0.001 * i, 2.001, "a") for i in range(80)]
    got = {r.event_id for r in implausible(make_fixes(rows)).filter("reason = 'frozen'").collect()}
    assert got == {1, 2, 3, 4, 5, 6} == brute_implausible(rows)


def test_implausible_without_broadcasts(make_fixes, monkeypatch):
    """With more entities than may be broadcast, their facts are joined by block: the same records."""
    rows, fixes = rhythm(make_fixes)
    monkeypatch.setattr(spikes, "MOST_BROADCAST", 0)
    frozen = [(5000 + i, 60 * i, 40.0, 9.0, "x") for i in range(7)]
    want = brute_implausible(rows + frozen)
    assert {r.event_id for r in implausible(make_fixes(rows + frozen)).collect()} == want and len(want) == 10


def test_implausible_of_nothing(make_fixes):
    assert implausible(make_fixes([])).count() == 0
    assert [r.reason for r in implausible(make_fixes([(1, 0, 0.0, 0.0, "a")])).collect()] == ["impossible"]


def pursuit(d, rounds=20):
    """Principal component pursuit of one matrix by full singular value decomposition."""
    r, c = d.shape
    lam, mu = 1 / max(r, c) ** 0.5, 1.25 * r**0.5 / np.linalg.norm(d)
    sparse, dual = np.zeros_like(d), np.zeros_like(d)
    for _ in range(rounds):
        u, s, v = np.linalg.svd(d - sparse + dual / mu, full_matrices=False)
        low = u @ np.diag(np.maximum(s - 1 / mu, 0)) @ v
        y = d - low + dual / mu
        sparse = np.sign(y) * np.maximum(np.abs(y) - lam / mu, 0)
        dual, mu = dual + mu * (d - low - sparse), mu * 1.5
    return low, d - low


def rhythm(make_fixes):
    """Two sources with a daily rhythm over 16 days and a few spikes; and what the pursuit makes of their blocks."""
    rng, rows, e = random.Random(8), [], 0
    for a in ("x", "y"):
        lo = 2.0
        for h in range(24 * 16):
            e += 1
            lo += (1e-3 if 6 <= h % 24 < 20 else 1e-4) * rng.uniform(0.8, 1.2)
            rows.append((e, h * 3600 + 60 * rng.randrange(30), 1.0 + (0.7 if h in (100, 231, 300) and a == "x" else 0.0), lo, a))
    return rows, make_fixes(rows)


def brute_cells(rows):
    out = {}
    for a in {r[4] for r in rows}:
        recs = sorted((r[1], r[0], r[2], r[3]) for r in rows if r[4] == a)
        steps = [(q[0], hav(p[2:], q[2:])) for p, q in zip(recs, recs[1:])]
        y = np.quantile([s for _, s in steps], 0.95)
        start = 1078099200  # seconds of 2004-03-01
        mats = {}
        for t, s in steps:
            blk, cell = divmod(start + t, 8 * 86400)
            m = mats.setdefault(blk, {})
            m[cell // 3600] = max(m.get(cell // 3600, 0), s)
        for blk, m in mats.items():
            d = np.zeros(192)
            d[list(m)] = np.log1p(np.array(list(m.values())) / y)
            low, sparse = pursuit(d.reshape(8, 24))
            out |= {(a, blk, c): (low.ravel()[c], sparse.ravel()[c]) for c in m}
    return out


def test_profile_cells_against_brute_force(make_fixes):
    rows, fixes = rhythm(make_fixes)
    want = brute_cells(rows)
    cells_of = lambda **kernel: {(r.entity, r.blk, r.cell): (r.low, r.sparse) for r in Steps(fixes, 0.95, 3, BLOCK_US, **kernel).cells.collect()}
    got = cells_of()
    same = lambda got: got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    assert same(got)
    assert max(v[0] for v in got.values()) > 0.3  # the rhythm is in L
    spiking = {k for k, v in got.items() if v[1] > SPARSE}
    assert 3 <= len(spiking) < 20 and len({k[0] for k in spiking}) == 1
    noise = np.random.default_rng(1)
    assert not same(cells_of(kernel=lambda d: (np.zeros_like(d), d)))
    assert not same(cells_of(kernel=lambda d: (lambda low: (low, d - low))(noise.uniform(0, 2, d.shape))))


def test_the_sparse_part_chooses_the_rows(make_fixes):
    rows, fixes = rhythm(make_fixes)
    want = brute_implausible(rows)
    ids = lambda **kernel: {r.event_id for r in implausible(fixes, **kernel).collect()}
    assert ids() == want and len(want) == 3
    # a low-rank part that takes half of everything leaves no sparse cell, and so no row to test
    assert ids(kernel=lambda d: (np.minimum(d - 0.3, 1.7), d * 0)) == set()


def test_recurring_excursions_are_found_without_a_pursuit(make_fixes, monkeypatch):
    """Over 8 whole days, an excursion in each of six hours a day, and one by itself."""
    rng, rows, lo = random.Random(5), [], 2.0
    for i in range(8 * 288):
        day, slot = divmod(i, 288)
        lo += 1e-3 * rng.uniform(0.8, 1.2)
        far = (72 <= slot < 144 and slot % 12 == 6) or (day, slot) == (3, 246)
        rows.append((i, 2 * 86400 + 300 * i, 1.0 + 0.7 * far, lo, "a"))
    fixes = make_fixes(rows)
    sparse = {r.event_id for r in implausible(fixes, kernel=robust_components).collect()}
    assert sparse == {3 * 288 + 246}  # the rest recurs: with a pursuit it counts as the rhythm
    monkeypatch.setattr(spikes, "profile_cells", None)  # the definition's answer takes no matrix apart
    assert {r.event_id for r in implausible(fixes).collect()} == brute_implausible(rows) == {r[0] for r in rows if r[2] > 1}


def test_robust_components_keep_spikes_sparse():
    rng = np.random.default_rng(0)
    base = np.outer(np.ones(8), 0.5 + 0.4 * np.sin(np.arange(24) / 4))[None] + rng.normal(0, 0.01, (1, 8, 24))
    spiked = base.copy()
    spiked[0, 3, 7] += 3
    low, sparse = robust_components(spiked)
    assert np.allclose(low + sparse, spiked)
    assert sparse[0, 3, 7] > 2 and np.abs(np.delete(sparse.ravel(), 3 * 24 + 7)).max() < 0.4


def test_recurring_spikes_are_a_second_pass(spark):
    low, sparse = robust_components(np.full((1, 8, 24), 5.0))
    assert sparse.max() < SPARSE  # the pursuit takes what recurs in every hour of every day for normal
    cells = spark.createDataFrame([("a", 1, 2, float(low[0, 0, 2]), float(sparse[0, 0, 2])), ("a", 1, 3, 0.1, 0.9), ("a", 1, 4, 0.9, 0.1)], "entity string, blk int, cell int, low double, sparse double")
    assert {(r.cell, r.chosen_by) for r in chosen_cells(cells).collect()} == {(2, "low"), (3, "sparse")}


def test_sessions_against_brute_force(make_fixes):
    rng = random.Random(9)
    rows = [(i, rng.randrange(0, 20 * 86400) // 1800 * 1800, 1.0, 1.0, f"a{rng.randrange(2)}") for i in range(400)] + [(1000, 0, None, None, "solo"), (1001, None, 1.0, 1.0, "a0")]
    got = {(r.first_event_id, r.last_event_id, r.n_records, r.duration_s) for r in sessions(make_fixes(rows, CLASH), 3600, block_us=DAY_US).collect()}
    want = set()
    for a in ("a0", "a1", "solo"):
        run = []
        for s, e in sorted((r[1], r[0]) for r in rows if r[4] == a and r[1] is not None) + [(10**12, -1)]:
            if run and s - run[-1][0] > 3600:
                want.add((run[0][1], run[-1][1], len(run), float(run[-1][0] - run[0][0])))
                run = []
            run.append((s, e))
    assert got == want
    assert sessions(make_fixes([])).count() == 0


def test_near_pairs_against_brute_force(make_fixes):
    rng = random.Random(4)
    rows, e = [], 0
    for centre in ((0.001, 0.001), (60.0, 10.0), (-89.9999, 30.0), (10.0, 180.0), (89.9998, -100.0)):
        for _ in range(40):
            e += 1
            la = max(-90.0, min(90.0, centre[0] + rng.uniform(-4, 4) * 1e-4))
            lo = centre[1] + rng.uniform(-4, 4) * (1e-4 if abs(la) < 80 else 30)
            lo = (lo + 180) % 360 - 180
            rows.append((e, rng.randrange(10**6), la, lo, f"a{rng.randrange(3)}"))
    rows += [(900, 1, 1.0, 1.0, "a0"), (901, 1, 1.0, 1.0, "a1"), (902, 2, 1.0, 1.0, "a1"), (903, 2, None, 1.0, "a2"), (904, 2, 0.0, 0.0, "a2"), (904, 2, 0.0, 0.0, "a2")]
    got = [(r.event_id_a, r.event_id_b) for r in near_pairs(make_fixes(rows, CLASH), 30.0).collect()]
    ok = [r for r in dict.fromkeys(rows) if r[2] is not None and not (r[2] == 0 and r[3] == 0)]
    want = {(min(p[0], q[0]), max(p[0], q[0])) for i, p in enumerate(ok) for q in ok[:i] if p[4] != q[4] and hav(p[2:4], q[2:4]) <= 30}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert near_pairs(make_fixes([])).count() == 0


def test_triangles_decide_the_candidates(make_fixes):
    """Points in the box of a region, near its north-eastern corner: those beyond the slanted side are no candidates."""
    dlat = math.degrees(30 / EARTH_RADIUS_M)
    dlon = dlat / math.cos(math.radians(60))
    spots = [(0.99, 0.2), (0.3, 0.99), (0.7, 0.7), (0.72, 0.68), (0.75, 0.75), (0.95, 0.9), (-0.9, 0.9), (-0.6, 0.6), (0.0, 0.5)]
    rows = [(1, 0, 60.0, 10.0, "a")] + [(10 + k, 0, 60.0 + v * dlat, 10.0 + u * dlon, "b") for k, (u, v) in enumerate(spots)]
    got = {r.id_b - 10 for r in region_candidates(make_fixes(rows)).collect() if r.id_a == 1}
    assert got == {k for k, (u, v) in enumerate(spots) if abs(u) + v <= 1.4156} == {0, 1, 2, 3, 7, 8}


def test_hot_nodes_are_split(make_fixes, monkeypatch):
    """One animal rests where others pass: its rows are split, never multiplied by themselves, and no pair is lost."""
    rng = random.Random(6)
    spot = lambda: (60.0 + rng.uniform(-2, 2) * 1e-4, 10.0 + rng.uniform(-4, 4) * 1e-4)
    rows = [(e, e, *spot(), "rests" if e <= 150 else f"a{e % 5}" if e <= 190 else "too") for e in range(1, 260)]
    fixes = make_fixes(rows + rows[:20], CLASH)
    want = {(p[0], q[0]) for i, q in enumerate(rows) for p in rows[:i] if p[4] != q[4] and hav(p[2:4], q[2:4]) <= 30}
    for most in (16, 10_000):
        got = [(r.event_id_a, r.event_id_b) for r in near_pairs(fixes, hot_rows=most).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    monkeypatch.setattr(spatial, "MOST_HOT", 0)  # by shuffle
    assert {(r.event_id_a, r.event_id_b) for r in near_pairs(fixes, hot_rows=16).collect()} == want
    raw = fixes.selectExpr("`individual-local-identifier` entity", "`location-lat` lat", "`location-long` lon", "`event-id` event_id").distinct()
    grid = Grid(30.0, 3.0)
    hot = HotNodes(raw, grid, 16)
    table = {r.node: r for r in hot.table.collect()}
    assert hot.some and any("rests" in r.own for r in table.values())
    sent = hot.split(grid.points(raw), "cb", "ca").filter("entity = 'rests'").groupBy("node", "event_id").count().collect()
    assert all(r["count"] == (table[r.node].chunks - (table[r.node].own["rests"].k if "rests" in table[r.node].own else 0) if r.node in table else 1) for r in sent)


def test_ear_clip_covers_the_ring():
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)]
    tri = ear_clip(ring)
    area = lambda p: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, [*p[1:], p[0]]))) / 2
    assert sum(area(t) for t, _ in tri) == pytest.approx(area(ring[:-1])) and len(tri) == 3
    star = [((5 if k % 2 else 2 + k % 7 / 9) * math.cos(k * math.pi / 150), (5 if k % 2 else 2 + k % 7 / 9) * math.sin(k * math.pi / 150)) for k in range(300)]
    assert sum(area(t) for t, _ in ear_clip(star[::-1])) == pytest.approx(area(star)) and len(ear_clip(star)) == 298
    with pytest.raises(ValueError):
        ear_clip([(0, 0), (4, 4), (4, 0), (0, 4), (-1, 2)])
    assert ear_clip([(0, 0), (1, 1)]) == [] and ear_clip([(0, None), (1, 1), (2, 0)]) == []


def test_regions_of_points(spark):
    ring = lambda pts: [{"lon": float(x), "lat": float(y)} for x, y in pts]
    regions = spark.createDataFrame(
        [("L", ring([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)])), ("R", ring([(4, 0), (8, 0), (8, 4), (4, 4)])), ("tiny", ring([(1, 0.1), (1.01, 0.1), (1, 0.11)])), ("none", None)],
        "region_id string, ring array<struct<lon:double,lat:double>>",
    )
    pts = [(1, 2.0, 0.5), (2, 2.0, 3.0), (3, 4.0, 2.0), (4, 6.0, 1.0), (5, 1.002, 0.102), (6, 9.0, 9.0), (7, None, 1.0), (1, 2.0, 0.5)]
    df = spark.createDataFrame(pts, "point_id bigint, lon double, lat double")
    for most in (0, 1000):  # by shuffle over salts, and by broadcast
        got = sorted((r.point_id, r.region_id) for r in regions_of_points(df, regions, most_broadcast=most).collect())
        assert got == [(1, "L"), (3, "L"), (3, "R"), (4, "R"), (5, "L"), (5, "tiny")]
    assert regions_of_points(df, regions.limit(0)).count() == 0 and regions_of_points(df.limit(0), regions).count() == 0


CASES = {
    "1 2 3": None,
    "1,2, 3": [(1, 1), (2, 2), (3, 3)],
    "[1;-2;+3]": [(1, 1), (2, -2), (3, 3)],
    '"1","2,204","x"': [(1, 1), (2, 2204)],
    "1||3": [(1, 1), (3, 3)],
    "|1|2|": [(1, 1), (2, 2)],
    "||1": [(2, 1)],
    "1 2\r\n3  4": [(1, 1), (2, 2), (3, 3), (4, 4)],
    "7 , null , 9": [(1, 7), (3, 9)],
    "1 2 3 / 4 5 6": [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6)],
    "( 5 6 )": [(1, 5), (2, 6)],
    "1.5;99999999999999999999;8": [(3, 8)],
    "": [],
    "  ": [],
    "-": [],
    " 4 ": [(1, 4)],
}


def test_packed_fields(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(500, None), (None, "1,2"), (0, "1 2 3")] + [(600, ",".join(map(str, range(5000))))]
    acc = spark.createDataFrame(rows, "`event-id` bigint, `eobs:accelerations-raw` string").selectExpr("*", "'c' as skeleton", "'c' as pos")
    got = {}
    for r in odd_bursts(acc).collect():
        got.setdefault(r.event_id, []).append((r.pos, r.value))
    want = {i: v for i, v in enumerate(CASES.values()) if v} | {600: [(i + 1, i) for i in range(5000)]}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert sorted((r.pos, r.value) for r in all_bursts(acc.filter("`event-id` = 0")).collect()) == [(1, 1), (2, 2), (3, 3)]
    assert odd_bursts(acc.limit(0)).count() == 0


def test_a_trailing_line_end_is_odd(spark):
    acc = spark.createDataFrame([(1, "1 2 3\n"), (2, "1 2 3\r\n"), (3, "1 2 3")], "`event-id` bigint, `eobs:accelerations-raw` string")
    assert sorted(tuple(r) for r in odd_bursts(acc).collect()) == [(e, i, i) for e in (1, 2) for i in (1, 2, 3)]
    assert sorted(tuple(r) for r in all_bursts(acc).collect()) == [(e, i, i) for e in (1, 2, 3) for i in (1, 2, 3)]


def test_schema_drift(spark):
    lines = [
        ("f1", 0, "event-id,timestamp,ground-speed,manually-marked-outlier,odd"),
        ("f1", 1, '1,2020-01-01 00:00,1.5,true,"a,b"'),
        ("f1", 2, "2,,2,FALSE,z"),
        ("f1", 2, "2,,2,FALSE,z"),
        ("f1", 3, "3,2020"),
        ("f2", 0, "Timestamp ;EVENT-ID;Ground Speed (m/s);heading"),
        ("f2", 1, "t;4;2,5 m/s;10"),
        ("f2", 2, 't;5;1.0;"11"'),
        ("f3", 0, "event-id\ttimestamp\tground-speed"),
        ("f3", 1, "6\tt\t3"),
        ("f4", 0, ""),
        ("f5", 1, "no header"),
        ("f6", 0, None),
    ]
    df = spark.createDataFrame(lines, "file_id string, line_no int, line string").selectExpr("*", "'x' as names", "1 as field")
    fields = [("event-id", "integer"), ("timestamp", "text"), ("ground-speed", "decimal"), ("heading", "decimal"), ("manually-marked-outlier", "boolean")]
    dic = spark.createDataFrame(fields, "field string, value_type string")
    approvals = spark.createDataFrame([("Speed [kn]", "ground-speed"), ("nothing", "no field"), (None, "heading")], "header string, field string")
    heads = drift.headers(df, dic, approvals)
    table = drift.ingest(df, heads, dic)
    r = {(x.file_id, x.line_no): x for x in table.collect()}
    assert r["f1", 1]["ground-speed"] == 1.5 and r["f1", 1]["manually-marked-outlier"] is True and r["f1", 1]["_rescued"] == '{"odd":"a,b"}'
    assert r["f1", 3]["ground-speed"] is None and r["f1", 3]["_rescued"] is None
    assert r["f2", 1]["ground-speed"] is None and "2,5 m/s" in r["f2", 1]["_rescued"]
    again = {(x.file_id, x.line_no): x for x in drift.replay(table, heads, dic).collect()}
    assert again["f2", 1]["ground-speed"] == 2.5 and again["f2", 1]["_rescued"] is None and again["f2", 2]["heading"] == 11.0
    assert again["f1", 1]["_rescued"] == '{"odd":"a,b"}'
    files = spark.createDataFrame([("f1", "u", "2020-01-01"), ("f2", "u", "2020-01-02"), ("f3", "u", "2020-01-03"), ("f5", None, "2020-01-01")], "file_id string, uuid string, exported_at string")
    got = {(x.file_id, x.field, x.change_kind) for x in drift.changes(files, drift.profile(drift.replay(table, heads, dic), heads, dic)).collect()}
    assert got == {
        ("f2", "ground-speed", "renamed"), ("f2", "ground-speed", "retyped"), ("f2", "heading", "added"), ("f2", "manually-marked-outlier", "removed"),
        ("f3", "ground-speed", "renamed"), ("f3", "ground-speed", "retyped"), ("f3", "heading", "removed"),
    }
    none = df.limit(0)
    no_heads = drift.headers(none, dic)
    assert drift.profile(drift.replay(drift.ingest(none, no_heads, dic), no_heads, dic), no_heads, dic).count() == 0


def test_what_does_not_cast_is_kept(spark, tmp_path):
    lines = [("f", 0, "event-id,ground-speed"), ("f", 1, "1,fast"), ("f", 2, "2,1.5")]
    spark.createDataFrame(lines, "file_id string, line_no int, line string").write.parquet(str(tmp_path / "export_lines.parquet"))
    fields = [("event-id", "integer"), ("ground-speed", "decimal")]
    spark.createDataFrame(fields, "field string, value_type string").write.parquet(str(tmp_path / "field_dictionary.parquet"))
    got = [tuple(r) for r in problem_queries.QUERIES["p2_rescued"](spark, str(tmp_path)).collect()]
    assert got == [("f", 1, '{"ground-speed":"fast"}')]


def test_extra_and_doubled_headers_are_preserved(spark):
    lines = [("f", 0, "event-id,x,x,ground-speed"), ("f", 1, "1,a,b,2.5,more"), ("f", 2, "2,,c,"), ("f", 3, 'no,"q""r",,9')]
    df = spark.createDataFrame(lines, "file_id string, line_no int, line string")
    dic = spark.createDataFrame([("event-id", "integer"), ("ground-speed", "decimal")], "field string, value_type string")
    heads = drift.headers(df, dic)
    got = {r.line_no: r._rescued for r in drift.ingest(df, heads, dic).collect()}
    assert got == {1: '{"x":"a","x_2":"b","_extra_4":"more"}', 2: '{"x_2":"c"}', 3: r'{"event-id":"no","x":"q\"r"}'}
    again = {r.line_no: r for r in drift.replay(drift.ingest(df, heads, dic), heads, dic).collect()}
    assert again[3]._rescued == got[3] and again[3]["event-id"] is None and again[3]._spelled == [drift.TEXT, drift.INTEGER]


def test_changes_come_from_the_rescued_values(spark):
    """Without the rescued values a field under an approved header would have no type, and so no retyping."""
    lines = [("f1", 0, "event-id,ground-speed"), ("f1", 1, "1,2.5"), ("f2", 0, "event-id,Speed"), ("f2", 1, "2,fast"), ("f2", 2, "3,4.5")]
    df = spark.createDataFrame(lines, "file_id string, line_no int, line string")
    dic = spark.createDataFrame([("event-id", "integer"), ("ground-speed", "decimal")], "field string, value_type string")
    files = spark.createDataFrame([("f1", "u", "2020-01-01"), ("f2", "u", "2020-01-02")], "file_id string, uuid string, exported_at string")
    heads = drift.headers(df, dic, spark.createDataFrame([("speed", "ground-speed")], "header string, field string"))
    table = drift.replay(drift.ingest(df, heads, dic), heads, dic)
    found = lambda t: {(r.field, r.change_kind, r.before, r.after) for r in drift.changes(files, drift.profile(t, heads, dic)).collect()}
    assert found(table) == {("ground-speed", "renamed", "ground-speed", "speed"), ("ground-speed", "retyped", "decimal", "text")}
    assert found(drift.replay(drift.ingest(df, heads, dic).withColumn("_rescued", F.lit(None).cast("string")), heads, dic)) == {("ground-speed", "renamed", "ground-speed", "speed")}
