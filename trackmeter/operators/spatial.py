"""Points near other points or inside regions (problem 6).

Regions are triangulated by ear clipping. Triangles are distributed through a hierarchy of bounding
volumes: the nodes of a quadtree over longitude and latitude, a triangle at the deepest level whose
cells are no smaller than its bounding box, so it touches at most four nodes there. A point is looked
up in its node of every level in use. Candidate triangles are tested exactly. An edge between two
triangles of a region belongs to one of them only, and so no point is found twice in a region.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.functions.geo import EARTH_RADIUS_M, haversine_m
from trackmeter.operators.fixes import entity_key, impossible_position, placed_records
from trackmeter.session import Written

Point = tuple[float, float]
DEEPEST = 24


def _cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _corners(ring: Sequence[Point]) -> list[Point]:
    """A ring's corners counter-clockwise, repeated ones dropped; none if a coordinate is missing."""
    pts: list[Point] = []
    for x, y in ring:
        if x is None or y is None or x != x or y != y:
            return []
        if not pts or (x, y) != pts[-1]:
            pts.append((float(x), float(y)))
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1], strict=True)) < 0:
        pts.reverse()
    return pts


def ear_clip(ring: Sequence[Point]) -> list[tuple[tuple[Point, Point, Point], tuple[bool, bool, bool]]]:
    """Triangles (counter-clockwise) of a simple ring, each with a flag per edge: does it own that edge?

    Edge k runs from corner k to the next. Of an edge between two triangles the one clipped first is
    the owner; outer edges are owned. Repeated and collinear corners are dropped; fewer than three
    corners, or a null coordinate, give no triangle. A ring that crosses itself raises ValueError.

    Only reflex corners can lie in an ear; they are kept in arrays and tested all at once, so a ring
    of n corners takes about n steps over its reflex ones.
    """
    pts = _corners(ring)
    n = left = len(pts)
    if n < 3:
        return []
    before, behind = [i - 1 for i in range(n)], [(i + 1) % n for i in range(n)]
    before[0] = n - 1
    turn_at = lambda i: _cross(pts[before[i]], pts[i], pts[behind[i]])
    xs, ys = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
    reflex = np.array([turn_at(i) <= 0 for i in range(n)])
    taken: set[tuple[Point, Point]] = set()
    out = []
    i = stale = 0
    while left >= 3:
        a, b, c = pts[before[i]], pts[i], pts[behind[i]]
        turn = _cross(a, b, c)
        if turn > 0:
            near = np.flatnonzero(reflex)
            x, y = xs[near], ys[near]
            inside = np.ones(len(near), bool)
            for p, q in ((a, b), (b, c), (c, a)):
                inside &= (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= 0
                inside &= (x != p[0]) | (y != p[1])
            if not inside.any():
                own = []
                for e in ((a, b), (b, c), (c, a)):
                    own.append((e[1], e[0]) not in taken)
                    taken.add(e)
                out.append(((a, b, c), tuple(own)))
        if turn == 0 or (turn > 0 and not inside.any()):
            p, q = before[i], behind[i]
            behind[p], before[q], reflex[i] = q, p, False
            left, stale = left - 1, 0
            for k in (p, q):
                reflex[k] = turn_at(k) <= 0
            i = p
        else:
            i, stale = behind[i], stale + 1
            if stale > left:
                raise ValueError("the ring crosses itself")
    return out


def in_triangle(x: Column, y: Column, corners: Sequence[tuple[Column | float, Column | float]], own: Sequence[Column | bool]) -> Column:
    """Exact test against a counter-clockwise triangle; a point on an edge counts if the edge is owned.

    An edge is always measured from its western (then southern) end, so the two triangles that share it
    get opposite signs to the last bit: rounding can put no point into both or neither.
    """
    tests = []
    for k in range(3):
        (ax, ay), (bx, by) = corners[k], corners[(k + 1) % 3]
        cross = lambda px, py, qx, qy: (F.lit(qx) - F.lit(px)) * (y - F.lit(py)) - (F.lit(qy) - F.lit(py)) * (x - F.lit(px))
        if isinstance(ax, float):
            side = cross(ax, ay, bx, by) if (ax, ay) < (bx, by) else -cross(bx, by, ax, ay)
        else:
            onward = (ax < bx) | ((ax == bx) & (ay < by))
            side = F.when(onward, cross(ax, ay, bx, by)).otherwise(-cross(bx, by, ax, ay))
        if isinstance(own[k], bool):
            tests.append(side >= 0 if own[k] else side > 0)
        else:
            tests.append((side > 0) | ((side == 0) & own[k]))
    return reduce(lambda a, b: a & b, tests)


def triangles(regions: DataFrame, key: str = "region_id", ring: str = "ring") -> DataFrame:
    """``key, tri, ax .. cy, own0 .. own2`` for rings given as arrays of struct(lon, lat)."""
    names = ["ax", "ay", "bx", "by", "cx", "cy"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, r in zip(pdf[key], pdf[ring], strict=True):
                pts = [] if r is None else [tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in r]
                try:
                    clipped = ear_clip(pts)
                except ValueError as e:
                    raise ValueError(f"region {k}: {e}") from None
                rows += [[k, n, *[v for p in t for v in p], *own] for n, (t, own) in enumerate(clipped)]
            yield pd.DataFrame(rows, columns=[key, "tri", *names, "own0", "own1", "own2"])

    kind = regions.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, tri int, " + ", ".join(f"{n} double" for n in names) + ", own0 boolean, own1 boolean, own2 boolean"
    return regions.select(key, ring).mapInPandas(run, schema)


def _node(level: Column, x: Column, y: Column) -> Column:
    cells = F.pow(F.lit(2.0), level) / 360.0
    return F.floor((y + 90) * cells) * F.lit(2**31) + F.floor((x + 180) * cells)


def regions_of_points(
    points: DataFrame, regions: DataFrame, point_key: str = "point_id", region_key: str = "region_id", most_broadcast: int = 100_000, salts: int = 64
) -> DataFrame:
    """``point_key, region_key`` of the points (lon, lat) in regions (ring of struct(lon, lat), degrees).

    A point on the border of a region is in it; on the border of two regions it is in both. Null or
    impossible coordinates: in none. A point or region that comes twice counts once. Rings are not
    wrapped at 180 degrees: split such regions. A ring that crosses itself raises an error.

    The triangles are written and counted. Up to ``most_broadcast`` of them (under 20 MB) are broadcast,
    so no point is shuffled by node; more are repeated over ``salts``, and the points of a node spread
    over these, so that neither a coarse node nor a dense one is one task.
    """
    t = Written(regions.sparkSession).put(triangles(regions.dropDuplicates([region_key]), region_key), "triangles")
    lo = {c: F.least(f"a{c}", f"b{c}", f"c{c}") for c in "xy"}
    hi = {c: F.greatest(f"a{c}", f"b{c}", f"c{c}") for c in "xy"}
    extent = F.greatest(hi["x"] - lo["x"], hi["y"] - lo["y"], F.lit(360.0 / 2**DEEPEST))
    level = F.least(F.floor(F.log2(F.lit(360.0) / extent)), F.lit(DEEPEST)).cast("int")
    corners = F.array_distinct(F.array(*[_node(F.col("level"), x, y) for x in (lo["x"], hi["x"]) for y in (lo["y"], hi["y"])]))
    boxes = t.withColumn("level", level).withColumn("node", F.explode(corners))
    used = t.select(level.alias("level")).distinct().agg(F.collect_set("level").alias("levels"))  # at most DEEPEST + 1
    few = t.count() <= most_broadcast
    if few:
        boxes = F.broadcast(boxes.withColumn("salt", F.lit(0)))
    else:
        boxes = boxes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pts = (
        points.select(point_key, F.col("lon").alias("_x"), F.col("lat").alias("_y"))
        .filter("abs(_x) <= 180 and abs(_y) <= 90")
        .dropDuplicates([point_key])
        .crossJoin(F.broadcast(used))  # one row
        .withColumn("level", F.explode("levels"))
        .withColumn("node", _node(F.col("level"), F.col("_x"), F.col("_y")))
        .withColumn("salt", F.lit(0) if few else F.pmod(F.xxhash64(point_key), F.lit(salts)).cast("int"))
    )
    ring = [(F.col(f"{p}x"), F.col(f"{p}y")) for p in "abc"]
    within = F.col("_x").between(lo["x"], hi["x"]) & F.col("_y").between(lo["y"], hi["y"])
    hit = in_triangle(F.col("_x"), F.col("_y"), ring, [F.col(f"own{k}") for k in range(3)])
    return pts.join(boxes, ["level", "node", "salt"]).filter(within & hit).select(point_key, region_key)


#: rows of an entity in a pack, the lowest bounding volume
PACK = 64
#: region rows of a node beyond which it is split
HOT_ROWS = 8_192
#: hot nodes whose table may be broadcast (under 50 MB); they are counted first
MOST_HOT = 100_000


def packs(df: DataFrame, keys: Sequence[str], entity: str, columns: Sequence[str], name: str) -> DataFrame:
    """``keys, entity, name`` and the bounds ``name_s, name_n, name_w, name_e`` of arrays of up to PACK neighbouring rows.

    columns: id, lat, lon and others. ``df`` lies together by the keys.
    """
    w = Window.partitionBy(*keys, entity).orderBy(columns[1], columns[0])
    d = df.withColumn("_pack", F.floor((F.row_number().over(w) - 1) / PACK))
    bounds = [f(c).alias(f"{name}_{to}") for f, c, to in ((F.min, columns[1], "s"), (F.max, columns[1], "n"), (F.min, columns[2], "w"), (F.max, columns[2], "e"))]
    return d.groupBy(*keys, entity, "_pack").agg(F.collect_list(F.struct(*columns)).alias(name), *bounds).drop("_pack")


class Grid:
    """Rows of latitude and cells of longitude, wide enough for the regions around points within ``metres``.

    The level of the hierarchy follows the latitude, row by row: towards the poles a row has fewer
    cells, down to one. A region touches at most two rows and two cells of each. Longitudes wrap.
    """

    def __init__(self, metres: float, roomy: float):
        self.angle = metres / EARTH_RADIUS_M
        self.tall = math.degrees(self.angle) * (1 + 1e-9)
        self.row, self.roomy = self.tall * roomy, roomy

    def wide(self, lat: Column) -> Column:
        """Most degrees of longitude from a point at this latitude to any within reach."""
        s = F.lit(math.sin(self.angle)) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
        return F.when(s < 1, F.degrees(F.asin(s)) * (1 + 1e-9)).otherwise(180.0)

    def y(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.row)

    def cells(self, y: Column) -> Column:
        highest = F.least(F.greatest(F.abs(y * self.row - 90), F.abs((y + 1) * self.row - 90)) + self.tall, F.lit(90.0))
        return F.greatest(F.floor(360.0 / (2 * self.roomy * self.wide(highest))), F.lit(1))

    def _key(self, lon: Column) -> Column:
        return F.col("_y") * F.lit(2**32) + F.pmod(F.floor((lon + 180) / 360 * F.col("_n")), F.col("_n"))

    def _in_row(self, df: DataFrame, y: Column) -> DataFrame:
        return df.withColumn("_y", y).withColumn("_n", self.cells(F.col("_y")))

    def points(self, df: DataFrame) -> DataFrame:
        """``df`` with the ``node`` of each point."""
        return self._in_row(df, self.y(F.col("lat"))).withColumn("node", self._key(F.col("lon"))).drop("_y", "_n")

    def discs(self, df: DataFrame) -> DataFrame:
        """``df`` with a row for each ``node`` that the disc around a point touches."""
        return self._touched(df, -1)

    def regions(self, df: DataFrame) -> DataFrame:
        """``df`` with a row for each ``node`` that a point's region, the northern half of its disc, touches."""
        return self._touched(df, 0)

    def _touched(self, df: DataFrame, south: int) -> DataFrame:
        lat, lon = F.col("lat"), F.col("lon")
        rows = self._in_row(df, F.explode(F.array_distinct(F.array(self.y(lat + south * self.tall), self.y(lat + self.tall)))))
        rows = rows.withColumn("_w", self.wide(lat))
        at = [self._key(lon + d * F.col("_w")) for d in (-1, 1)]  # cells are wider than a region
        return rows.withColumn("node", F.explode(F.array_distinct(F.array(*at)))).drop("_y", "_n", "_w")


class HotNodes:
    """How the nodes with more than ``most`` region rows are split into chunks.

    An entity with more than ``most`` rows in a node has chunks of its own there, the others share some.
    A row of one side is sent to all chunks of the other side but those of its own entity, so an entity
    that rests in a node is never multiplied by itself. Counts come from the rows as delivered: they
    only steer, and copies do no harm.
    """

    def __init__(self, rows: DataFrame, grid: Grid, most: int):
        stage = Written(rows.sparkSession)
        at = grid.regions(rows)
        counts = stage.put(at.groupBy("node").agg(F.count(F.lit(1)).alias("n")).agg(
            F.sum("n").alias("rows"), F.sum((F.col("n") > most).cast("bigint")).alias("hot")), "counts").first()
        self.rows, self.some, self.small = counts.rows or 0, bool(counts.hot), (counts.hot or 0) <= MOST_HOT
        if not self.some:
            return
        hot = at.groupBy("node").count().filter(F.col("count") > most).select("node")
        by = at.join(F.broadcast(hot) if self.small else hot, "node").groupBy("node", "entity").agg(F.count(F.lit(1)).alias("n"))
        big = F.col("n") > most
        sized = by.groupBy("node").agg(
            F.ceil(F.sum(F.when(~big, F.col("n")).otherwise(0)) / most).cast("int").alias("light"),
            F.array_sort(F.collect_list(F.when(big, F.struct("entity", F.ceil(F.col("n") / most).cast("int").alias("k"))))).alias("big"),
        )  # of an entity's rows in a node, more than ``most`` make one entry
        ends = F.aggregate(
            "big",
            F.struct(F.col("light").alias("c"), F.array().cast("array<struct<entity:string,start:int,k:int>>").alias("own")),
            lambda a, x: F.struct(
                (a["c"] + x["k"]).alias("c"),
                F.concat(a["own"], F.array(F.struct(x["entity"].alias("entity"), a["c"].alias("start"), x["k"].alias("k")))).alias("own"),
            ),
        )
        self.table = stage.put(
            sized.withColumn("e", ends).select(
                "node", "light", F.col("e.c").alias("chunks"),
                F.map_from_entries(F.transform("e.own", lambda x: F.struct(x["entity"], F.struct(x["start"].alias("start"), x["k"].alias("k"))))).alias("own"),
            ),
            "hot",
        )

    def split(self, df: DataFrame, own: str, other: str) -> DataFrame:
        """``df`` with its row's chunk and the chunk it meets, one row for each of these; as it is if no node is hot."""
        if not self.some:
            return df
        df = df.join(F.broadcast(self.table) if self.small else self.table, "node", "left")
        h, mine = F.xxhash64("event_id"), F.col("own")[F.col("entity")]
        chunk = F.when(mine.isNotNull(), mine["start"] + F.pmod(h, mine["k"]).cast("int")).otherwise(F.pmod(h, F.greatest("light", F.lit(1))).cast("int"))
        first, end = F.coalesce(mine["start"], F.lit(0)), F.coalesce(mine["start"] + mine["k"], F.lit(0))
        partners = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: (c < first) | (c >= end))
        meets = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(partners)
        return df.withColumn(own, F.coalesce(chunk, F.lit(0))).withColumn(other, F.explode(meets)).drop("light", "chunks", "own")


def region_candidates(fixes: DataFrame, metres: float = 30.0, roomy: float = 3.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``id_a, lat_a, lon_a, id_b, lat_b, lon_b``: records b in a triangle of the region north of a record a.

    The region is a hexagon around the northern half of the disc of ``metres``, ear-clipped once as a
    template that each record scales to its latitude; where meridians converge so fast that the disc's
    sides bend (within about a degree of the poles) it is the half of the bounding box. Looking north
    only finds each pair once (equal latitudes: from the smaller event-id).

    Bounding volumes, from large to small: the node of a grid whose level follows the latitude; in it
    packs of up to 64 neighbouring records of one entity with their bounds, opened only where two
    entities' bounds meet; the box of a record's region; then its triangles, which decide.
    """
    grid = Grid(metres, roomy)
    m = math.sqrt(2) * 1.001 - 1  # the slanted sides touch the disc, with a margin for its distortion
    shapes = {
        "hexagon": ear_clip([(-1.0, 0.0), (1.0, 0.0), (1.0, m), (m, 1.0), (-m, 1.0), (-1.0, m)]),
        "box": ear_clip([(-1.0, 0.0), (1.0, 0.0), (1.0, 1.0), (-1.0, 1.0)]),
    }
    straight = F.tan(F.radians(F.least(F.abs(F.col("lat")), F.lit(89.9999)))) * grid.angle < 5e-4

    lat, lon = (F.col(f"`location-{c}`").cast("double") for c in ("lat", "long"))
    raw = fixes.select(entity_key(F.col("`individual-local-identifier`")).alias("entity"), lat.alias("lat"), lon.alias("lon"))
    raw = raw.filter(F.col("entity").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon") & ~impossible_position(F.col("lat"), F.col("lon")))
    hot = HotNodes(raw, grid, hot_rows)
    tasks = max(int(fixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(hot.rows / 250_000))

    pts = placed_records(fixes).filter(~impossible_position(F.col("lat"), F.col("lon")))
    # columns that can't be null: the code that opens packs stays short enough to be compiled
    pts = pts.select("entity", *[F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) for c, t in (("event_id", "bigint"), ("lat", "double"), ("lon", "double"))])
    keys = ["node", "ca", "cb"] if hot.some else ["node"]
    together = lambda df: df.repartition(tasks, *keys)
    about = {"w": F.coalesce(grid.wide(F.col("lat")), F.lit(180.0)), "straight": F.coalesce(straight, F.lit(False))}
    a = packs(together(hot.split(grid.regions(pts), "ca", "cb")).withColumns(about), keys, "entity", ["event_id", "lat", "lon", "w", "straight"], "a")
    a = a.withColumn("far", F.array_max(F.transform("a", lambda x: x["w"]))).withColumnRenamed("entity", "ent_a")
    b = packs(together(hot.split(grid.points(pts), "cb", "ca")), keys, "entity", ["event_id", "lat", "lon"], "b").withColumnRenamed("entity", "ent_b")
    east, west = F.col("a_e") + F.col("far"), F.col("a_w") - F.col("far")
    overlap = (F.col("a_s") <= F.col("b_n")) & (F.col("b_s") <= F.col("a_n") + grid.tall)
    overlap = overlap & (((F.col("b_w") <= east) & (F.col("b_e") >= west)) | (east > 180) | (west < -180))
    meet = a.join(b, keys).filter((F.col("ent_a") != F.col("ent_b")) & overlap).select("a", "b")
    pairs = meet.select(F.explode("a").alias("a"), "b")
    pairs = pairs.select(F.col("a.event_id").alias("id_a"), F.col("a.lat").alias("lat_a"), F.col("a.lon").alias("lon_a"), F.col("a.w").alias("w"), F.col("a.straight").alias("straight"), F.explode("b").alias("b"))
    pairs = pairs.select("id_a", "lat_a", "lon_a", "w", "straight", F.col("b.event_id").alias("id_b"), F.col("b.lat").alias("lat_b"), F.col("b.lon").alias("lon_b"))
    dx, dy, w = F.col("lon_b") - F.col("lon_a"), F.col("lat_b") - F.col("lat_a"), F.col("w")
    box = (dy >= 0) & (dy <= grid.tall) & ((F.abs(dx) <= w) | (F.abs(dx) >= 360 - w))
    once = (dy > 0) | (F.col("id_a") < F.col("id_b"))
    turn = F.when(dx > 180, dx - 360.0).when(dx < -180, dx + 360.0).otherwise(dx)
    scaled = F.explode(F.array(F.struct((turn * (1.0 / w)).alias("u"), (dy * (1.0 / grid.tall)).alias("v")))).alias("at")  # evaluated once
    boxed = pairs.filter(box & once).select("*", scaled)
    inside = {k: reduce(lambda a, b: a | b, [in_triangle(F.col("at.u"), F.col("at.v"), t, own) for t, own in shape]) for k, shape in shapes.items()}
    return boxed.filter((F.col("straight") & inside["hexagon"]) | (~F.col("straight") & inside["box"])).drop("w", "straight", "at")


def near_pairs(fixes: DataFrame, metres: float = 30.0, roomy: float = 3.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``event_id_a < event_id_b, metres`` of placed records of two entities at most ``metres`` apart.

    The points found in the triangles of ``region_candidates`` are tested by great-circle distance.

    Nulls, and readings beyond the globe or at 0, 0, pair with nothing. Copies of an event-id: one.
    Two records of one entity never pair. Empty input: no rows.
    """
    d = haversine_m("lat_a", "lon_a", "lat_b", "lon_b")
    return (
        region_candidates(fixes, metres, roomy, hot_rows)
        .withColumn("metres", d)
        .filter(F.col("metres") <= metres)
        .select(F.least("id_a", "id_b").alias("event_id_a"), F.greatest("id_a", "id_b").alias("event_id_b"), "metres")
    )
