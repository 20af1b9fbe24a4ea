"""Polygons as array literals: containment, distance, crossings at several cadences, excursions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.functions.stats import wilson
from trackmeter.operators.fixes import BLOCK_US, in_blocks, with_neighbours
from trackmeter.operators.quantile import summary_quantiles
from trackmeter.operators.tracks import islands

Ring = Sequence[tuple[float, float]]
#: rings with more edges are worked through edge by edge in Arrow batches: an unrolled expression of them
#: would be too long to compile; both ways give the same
MOST_UNROLLED = 40


def closed(ring: Ring) -> list[tuple[float, float]]:
    """The ring with its first corner repeated at the end."""
    ring = [(float(x), float(y)) for x, y in ring]
    return ring if ring and ring[0] == ring[-1] else [*ring, *ring[:1]]


def largest_ring(rings: Sequence[Ring]) -> Ring:
    """The ring with most corners; of several the first."""
    return max(rings, key=len)


def _edges(ring: Ring) -> list[tuple[float, float, float, float]]:
    r = closed(ring)
    return [(*a, *b) for a, b in zip(r, r[1:], strict=False)]


def in_polygon(x: Column, y: Column, ring: Ring) -> Column:
    """Even-odd rule; NULL where a coordinate is."""
    edges = _edges(ring)
    if len(edges) > MOST_UNROLLED:

        @F.pandas_udf("boolean")
        def inside(xs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for px, py in xs:
                hit = pd.Series(False, index=px.index)
                for x1, y1, x2, y2 in edges:
                    if y1 != y2:
                        hit ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
                yield hit.astype(object).where(px.notna() & py.notna(), None)

        return inside(x, y)
    crossed = [
        F.when((F.lit(y1) > y) != (F.lit(y2) > y), x < F.lit(x2 - x1) * (y - y1) / F.lit(y2 - y1) + x1).otherwise(False)
        for x1, y1, x2, y2 in edges
        if y1 != y2
    ]
    odd = reduce(lambda a, b: a != b, crossed, F.lit(False))
    return F.when(x.isNotNull() & y.isNotNull(), odd)


def ring_distance(x: Column, y: Column, ring: Ring) -> Column:
    """Distance to the nearest edge, in the ring's units; NULL where a coordinate is."""
    edges = _edges(ring)
    if len(edges) > MOST_UNROLLED:

        @F.pandas_udf("double")
        def nearest(xs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for px, py in xs:
                best = pd.Series(float("inf"), index=px.index)
                for x1, y1, x2, y2 in edges:
                    dx, dy = x2 - x1, y2 - y1
                    n = dx * dx + dy * dy
                    t = (((px - x1) * dx + (py - y1) * dy) / n).clip(0.0, 1.0) if n else 0.0
                    best = best.where(best <= (d := np.hypot(px - (x1 + t * dx), py - (y1 + t * dy))), d)
                yield best.astype(object).where(px.notna() & py.notna(), None)

        return nearest(x, y)

    def to(e: tuple[float, float, float, float]) -> Column:
        x1, y1, x2, y2 = e
        dx, dy = x2 - x1, y2 - y1
        n = dx * dx + dy * dy
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x1) * dx + (y - y1) * dy) / n)) if n else F.lit(0.0)
        return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))

    parts = [to(e) for e in edges]
    least = F.least(*parts) if len(parts) > 1 else parts[0]
    return F.when(x.isNotNull() & y.isNotNull(), least)


def inside_share(points: DataFrame) -> DataFrame:
    """``n_fixes, n_inside, inside_pct`` of rows with a boolean ``inside``; the share is of those where it is not NULL."""
    k = F.sum(F.col("inside").cast("int"))
    return points.agg(F.count(F.lit(1)).alias("n_fixes"), k.alias("n_inside"), (100 * F.avg(F.col("inside").cast("int"))).alias("inside_pct"))


def resampled(points: DataFrame, intervals_s: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """``interval_s``, the first fix of each entity and interval (0: every fix), with its columns.

    Intervals count from midnight UTC if they divide a day. Rows are explode once per interval, and
    reduced to one per interval map-side before they move.
    """
    iv = F.explode(F.array(*[F.lit(i) for i in intervals_s])).alias("interval_s")
    d = points.select("entity", "ts_us", "event_id", *columns, iv)
    slot = F.when(F.col("interval_s") > 0, F.floor(F.col("ts_us") / (F.col("interval_s") * F.lit(1_000_000).cast("bigint")))).otherwise(F.col("event_id"))
    first = F.min(F.struct("ts_us", "event_id", *columns)).alias("f")
    return d.groupBy("interval_s", "entity", slot.alias("slot")).agg(first).select("interval_s", "entity", "f.*")


def crossings(points: DataFrame, intervals_s: Sequence[int], least: int = 3) -> DataFrame:
    """``interval_s, crossings, devices, pct_of_native``: changes of ``inside`` seen at each cadence.

    Entities with fewer than ``least`` samples at a cadence do not count there.
    """
    s = resampled(points, intervals_s, ["inside"])
    key = F.concat_ws("|", F.col("interval_s").cast("string"), "entity").alias("entity")
    flag = F.col("inside").cast("int").alias("flag")
    d = with_neighbours(in_blocks(s.select(key, "ts_us", "event_id", flag), ["flag"], BLOCK_US), ["flag"], before=1)
    by = d.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("flag") != F.col("p1_flag")).cast("int")).alias("k"))
    by = by.filter(F.col("n") >= least).withColumn("interval_s", F.split_part("entity", F.lit("|"), F.lit(1)).cast("int"))
    t = by.groupBy("interval_s").agg(F.sum("k").alias("crossings"), F.count(F.lit(1)).alias("devices"))
    native = F.max(F.when(F.col("interval_s") == 0, F.col("crossings"))).over(Window.partitionBy(F.lit(1)))  # one row a cadence
    return t.withColumn("pct_of_native", F.try_divide(100.0 * F.col("crossings"), native))


def excursions(points: DataFrame, deep_m: float = 500.0) -> DataFrame:
    """``entity, run, first_event_id, last_event_id, start_us, end_us, n_fixes, n_flagged, max_d_m, deep``.

    An excursion is a longest run of consecutive fixes outside. ``points`` has ``inside``, ``flagged``
    and ``d_m`` (distance to the fence). A fix of which it is not known (NULL) ends a run.
    """
    cols = ["inside", "flagged", "d_m"]
    d = with_neighbours(in_blocks(points, cols), cols, before=1)
    d = islands(d, F.col("p1_event_id").isNull() | (F.col("inside") != F.col("p1_inside"))).filter(~F.col("inside"))
    at = F.struct("ts_us", "event_id")
    runs = d.groupBy("entity", F.col("island").alias("run")).agg(
        F.min(at).alias("a"), F.max(at).alias("b"), F.count(F.lit(1)).alias("n_fixes"), F.sum(F.col("flagged").cast("int")).alias("n_flagged"), F.max("d_m").alias("max_d_m")
    )
    return runs.select(
        "entity",
        "run",
        F.col("a.event_id").alias("first_event_id"),
        F.col("b.event_id").alias("last_event_id"),
        F.col("a.ts_us").alias("start_us"),
        F.col("b.ts_us").alias("end_us"),
        "n_fixes",
        "n_flagged",
        "max_d_m",
        (F.col("max_d_m") > deep_m).alias("deep"),
    )


def outside_rates(points: DataFrame) -> DataFrame:
    """``flagged, n, outside, rate, low, high`` with Wilson bounds: the control against the flagged fixes, where known."""
    d = points.filter("inside is not null").groupBy("flagged").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("inside")).cast("int")).alias("outside"))
    low, high = wilson(F.col("outside"), F.col("n"))
    return d.select("flagged", "n", "outside", (F.col("outside") / F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def excursion_summary(exc: DataFrame) -> DataFrame:
    """Counts of excursions (all, of one fix, deep), the upper quartile of depth, the busiest entity's share."""
    by = exc.groupBy("entity").agg(F.sum("n_fixes").alias("k"))
    share = by.agg((F.max("k") / F.sum("k")).alias("top_share"), F.count(F.lit(1)).alias("entities"))
    n = exc.agg(
        F.count(F.lit(1)).alias("n_excursions"),
        F.sum((F.col("n_fixes") == 1).cast("int")).alias("n_single"),
        F.sum(((F.col("n_fixes") == 1) & (F.col("n_flagged") == 1)).cast("int")).alias("n_single_flagged"),
        F.sum(F.col("deep").cast("int")).alias("n_deep"),
    )
    q = summary_quantiles(exc, {"q75_max_d_m": (F.col("max_d_m"), 0.75)})
    return n.join(share, how="left").join(q, how="left")  # one row each
