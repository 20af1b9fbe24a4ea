"""Runs of the same or almost the same consecutive position (problem 3), by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmeter.functions.geo import haversine_m
from trackmeter.operators.fixes import BLOCK_US, in_blocks, placed_records, with_neighbours
from trackmeter.session import Written


def run_starts(pairs: DataFrame) -> DataFrame:
    """``id, ptr, ptr_ts, ts``: pointers to direct predecessors, replaced by pointers to the run's start.

    Each round joins the pointers still moving with the pointers they point to, which doubles their
    reach; a pointer rests once its target has no pointer. So a run of n takes about log2(n) rounds.
    Both sides of each join have unique keys: a moving pointer's target is pointed to by one record
    only, however long the run. Each round writes the pointers it moved to the shared folder; those at
    rest stay where they were written.
    """
    stage = Written(pairs.sparkSession)
    moving, resting, k = stage.put(pairs, "r0"), [], 0
    cols = ["id", "ptr", "ptr_ts", "ts"]
    while True:
        target = reduce(DataFrame.unionByName, [moving, *resting]).select(F.col("id").alias("ptr"), F.col("ptr").alias("_to"), F.col("ptr_ts").alias("_to_ts"))
        moved = moving.join(target, "ptr", "left").select(
            "id", F.coalesce("_to", "ptr").alias("ptr"), F.coalesce("_to_ts", "ptr_ts").alias("ptr_ts"), "ts", F.col("_to").isNotNull().alias("moving")
        )
        k += 1
        new = stage.put(moved, f"r{k}")
        resting.append(new.filter("not moving").select(*cols))
        moving = new.filter("moving").select(*cols)
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, resting)


def near_runs(fixes: DataFrame, metres: float = 5.0, block_us: int = BLOCK_US) -> DataFrame:
    """``first_event_id, last_event_id, n_records, start_us, end_us, duration_s`` of each longest run.

    A run: two or more consecutive placed records of an entity, each at most ``metres`` from the
    record before it, whatever time lies between. Nulls in identifier, time or coordinates: no placed
    record, so they neither join nor break a run. Copies of an event-id: one. Ties in time: by
    event-id. Records in no run give no row; an empty input gives none.
    """
    df = with_neighbours(in_blocks(placed_records(fixes), ["lat", "lon"], block_us), ["lat", "lon"], before=1)
    pairs = df.filter(haversine_m("p1_lat", "p1_lon", "lat", "lon") <= metres).select(
        F.col("event_id").alias("id"), F.col("p1_event_id").alias("ptr"), F.col("p1_ts_us").alias("ptr_ts"), F.col("ts_us").alias("ts")
    )
    return (
        run_starts(pairs)
        .groupBy("ptr", "ptr_ts")
        .agg(F.max(F.struct("ts", "id")).alias("l"), (F.count(F.lit(1)) + 1).alias("n_records"))
        .select(
            F.col("ptr").alias("first_event_id"),
            F.col("l.id").alias("last_event_id"),
            "n_records",
            F.col("ptr_ts").alias("start_us"),
            F.col("l.ts").alias("end_us"),
            ((F.col("l.ts") - F.col("ptr_ts")) / 1e6).alias("duration_s"),
        )
    )
