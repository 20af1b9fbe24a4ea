"""Spells of activity parted by silences (problem 5), as a sweep over interval deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.operators.fixes import BLOCK_US, block_window, blocks_window, dated_records, in_blocks


def sessions(fixes: DataFrame, gap_s: float = 3600.0, block_us: int = BLOCK_US) -> DataFrame:
    """``entity, session_no, first_event_id, last_event_id, start_us, end_us, duration_s, n_records``.

    Each record adds one at its instant and takes one away ``gap_s`` later; a session opens where the
    running sum leaves zero and closes where it returns there. At equal instants additions come first,
    so a silence of exactly ``gap_s`` does not part. The sum runs within blocks of time; what is still
    open at a block's edge comes in as one more delta, from a table of one row per entity and block.
    Partial sessions are then joined across blocks: at most one per gap, so the calendar bounds them.

    Nulls in identifier, time or event-id: left out. Copies of an event-id: one. Ties in time: by
    event-id. Single records are sessions of no duration. Empty input: no rows.
    """
    gap_us = round(gap_s * 1e6)
    if not 0 < gap_us <= block_us:
        raise ValueError("the gap must be positive and no longer than a block")
    base = in_blocks(dated_records(fixes), block_us=block_us)
    open_until = (
        base.groupBy("entity", "blk")
        .agg(F.max("ts_us").alias("_last"))
        .select("entity", "blk", (F.lag("_last").over(blocks_window()) + gap_us).alias("_open"))
    )
    deltas = base.select(
        "entity",
        "blk",
        F.explode(
            F.array(
                F.struct(F.col("ts_us").alias("t"), F.lit(1).alias("delta"), F.col("event_id").alias("id")),
                F.struct((F.col("ts_us") + gap_us).alias("t"), F.lit(-1).alias("delta"), F.lit(None).cast("bigint").alias("id")),
            )
        ).alias("d"),
    ).select("entity", "blk", "d.*")
    sweep = block_window("t", F.col("delta").desc(), "id")
    carried = F.coalesce(
        ((F.col("t") < F.col("_open")) | ((F.col("t") == F.col("_open")) & (F.col("delta") > 0))).cast("int"), F.lit(0)
    )
    swept = (
        deltas.withColumn("_sum", F.sum("delta").over(sweep))
        .join(open_until, ["entity", "blk"], "left")
        .withColumn("_opens", ((F.col("delta") > 0) & (F.col("_sum") + carried == 1)).cast("int"))
        .withColumn("_local", F.sum("_opens").over(sweep))
        .filter("delta > 0")
    )
    event = F.struct("t", "id")
    parts = swept.groupBy("entity", "blk", "_local").agg(
        F.min(event).alias("_first"), F.max(event).alias("_end"), F.count(F.lit(1)).alias("_n")
    )
    along = Window.partitionBy("entity").orderBy("blk", "_local")
    numbered = parts.withColumn("session_no", F.sum(F.when(F.col("_local") > 0, 1).otherwise(0)).over(along))
    return (
        numbered.groupBy("entity", "session_no")
        .agg(F.min("_first").alias("f"), F.max("_end").alias("l"), F.sum("_n").alias("n_records"))
        .select(
            "entity",
            "session_no",
            F.col("f.id").alias("first_event_id"),
            F.col("l.id").alias("last_event_id"),
            F.col("f.t").alias("start_us"),
            F.col("l.t").alias("end_us"),
            ((F.col("l.t") - F.col("f.t")) / 1e6).alias("duration_s"),
            "n_records",
        )
    )
