"""Pairing records with the nearest in time of the same entity (problem 4), by tick expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.operators.fixes import dated_records, placed_records


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance_s: float = 60.0) -> DataFrame:
    """``left_id, right_id, entity, lag_us`` for rows of ``event_id, entity, ts_us`` (event_id unique on each side).

    A tick is as long as the tolerance, so a right record is within reach of its own tick and the two
    beside it: it is exploded to these three. Of what reaches an (entity, tick) from before only the
    latest is kept, of what reaches it from behind only the earliest, and of its own one per instant.
    Left records then meet the right ones of their tick in order of time, and take the nearer of the
    last before and the first behind; nothing of a tick is gathered, however many instants it has.
    Before the explosion the right records are reduced to ticks within reach of any left record (a
    semi-join).

    Exactly ``tolerance_s`` away still pairs. Of right records at one instant the smallest id is taken;
    of two equally far, the earlier. Left records without a partner, and nulls, give no row.
    """
    tol = round(tolerance_s * 1e6)
    tick = lambda c: F.floor(F.col(c) / F.lit(tol))
    three = lambda: F.explode(F.array(*[F.col("_k") + F.lit(d) for d in (-1, 0, 1)])).alias("tick")
    ls = left.select("entity", F.col("event_id").alias("left_id"), F.col("ts_us").alias("lt"), tick("ts_us").alias("_k")).dropna()
    reach = ls.select("entity", "_k").distinct().select("entity", three()).distinct()
    rs = right.select("entity", F.col("event_id").alias("id"), "ts_us", tick("ts_us").alias("tick")).dropna()
    rs = rs.join(reach, ["entity", "tick"], "left_semi").withColumnRenamed("tick", "_k")
    rs = rs.groupBy("entity", "_k", "ts_us").agg(F.min("id").alias("id"))
    role = F.col("tick") - F.col("_k")
    beside = (
        rs.select("entity", "ts_us", "id", "_k", three())
        .filter(role != 0)
        .groupBy("entity", "tick")
        .agg(F.max(F.when(role == 1, F.struct("ts_us", "id"))).alias("b"), F.min(F.when(role == -1, F.struct("ts_us", "id"))).alias("a"))
        .select("entity", "tick", F.explode(F.array_compact(F.array("b", "a"))).alias("r"))
    )
    none = F.lit(None).cast("bigint")
    rights = rs.select("entity", F.col("_k").alias("tick"), F.struct("ts_us", "id").alias("r")).unionByName(beside)
    rights = rights.select("entity", "tick", F.col("r.ts_us").alias("t"), "r", none.alias("left_id"))
    lefts = ls.select("entity", F.col("_k").alias("tick"), F.col("lt").alias("t"), F.lit(None).cast(rights.schema["r"].dataType).alias("r"), "left_id")
    along = Window.partitionBy("entity", "tick").rowsBetween(Window.unboundedPreceding, 0)
    met = rights.unionByName(lefts).withColumns(
        {
            "_before": F.last("r", True).over(along.orderBy("t", F.col("left_id").asc_nulls_first())),
            "_behind": F.last("r", True).over(along.orderBy(F.desc("t"), F.col("left_id").asc_nulls_first())),
        }
    )
    lag = lambda c: F.when(F.abs(F.col(c)["ts_us"] - F.col("t")) <= tol, F.struct(F.abs(F.col(c)["ts_us"] - F.col("t")).alias("lag_us"), F.col(c)["ts_us"].alias("ts_us"), F.col(c)["id"].alias("id")))
    return (
        met.filter("left_id is not null")
        .withColumn("r", F.least(lag("_before"), lag("_behind")))
        .filter("r is not null")
        .select("left_id", F.col("r.id").alias("right_id"), "entity", F.col("r.lag_us").alias("lag_us"))
    )


def bursts_with_fixes(acc: DataFrame, fixes: DataFrame, tolerance_s: float = 60.0) -> DataFrame:
    """Each acceleration burst (one per event-id, with time and identifier) with its nearest placed fix."""
    return nearest_in_time(dated_records(acc), placed_records(fixes), tolerance_s)
