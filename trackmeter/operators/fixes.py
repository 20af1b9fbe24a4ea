"""Records of positions: identity, order within an entity, and neighbours across time blocks.

One entity may hold a third of all rows, so nothing here puts an entity into one task. Rows are
partitioned by (entity, block of time); what crosses a block's edge travels in a small table with
one row per entity and block, which the calendar bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLANKS = " \t\r\n\u00a0"
DAY_US = 86_400_000_000
#: width of a time block
BLOCK_US = 8 * DAY_US


def entity_key(c: Column) -> Column:
    """An identifier trimmed and in lower case."""
    return F.lower(F.trim(c, F.lit(BLANKS)))


def micros(c: Column) -> Column:
    """A timestamp (with or without zone, in UTC) as microseconds since 1970."""
    return F.unix_micros(c.cast("timestamp"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key, by ``order``; one shuffle on the keys, one sort."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_seen", F.lag(F.lit(1)).over(w)).filter(F.col("_seen").isNull()).drop("_seen")


def dated_records(fixes: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """``event_id, entity, ts_us`` (and ``extra``) of the rows with event-id, timestamp and identifier.

    Each event-id counts once: of copies that differ, the one delivered first (then the smallest by
    time, entity and the extra columns). Rows without event-id, timestamp or identifier are left out.
    Other columns of the input, whatever their names, play no part.
    """
    extra = extra or {}
    names = {c.lower() for c in fixes.columns}
    delivered = micros(F.col("`delivered_at`")) if "delivered_at" in names else F.lit(None).cast("bigint")
    df = fixes.select(
        F.col("`event-id`").cast("bigint").alias("event_id"),
        entity_key(F.col("`individual-local-identifier`")).alias("entity"),
        micros(F.col("`timestamp`")).alias("ts_us"),
        delivered.alias("_delivered"),
        *[c.alias(k) for k, c in extra.items()],
    ).filter("event_id is not null and entity is not null and ts_us is not null")
    order = [F.col("_delivered").asc_nulls_last(), F.col("ts_us"), F.col("entity"), *[F.col(k) for k in extra]]
    return first_of(df, ["event_id"], order).drop("_delivered")


def placed_records(fixes: DataFrame) -> DataFrame:
    """Dated records with both coordinates: ``event_id, entity, ts_us, lat, lon``. NaN counts as null."""
    number = lambda c: F.when(~F.isnan(c), c)
    lat = F.col("`location-lat`").cast("double")
    lon = F.col("`location-long`").cast("double")
    df = dated_records(fixes, {"lat": number(lat), "lon": number(lon)})
    return df.filter("lat is not null and lon is not null")


def impossible_position(lat: Column, lon: Column) -> Column:
    """Beyond the globe, or both coordinates exactly zero."""
    return (F.abs(lat) > 90) | (F.abs(lon) > 180) | ((lat == 0) & (lon == 0))


def in_blocks(df: DataFrame, payload: Sequence[str] = (), block_us: int = BLOCK_US) -> DataFrame:
    """``entity, blk, ts_us, event_id`` and the payload; keys that can't be null keep plans reusable."""
    return df.select(
        F.coalesce(F.col("entity"), F.lit("")).alias("entity"),
        F.coalesce(F.floor(F.col("ts_us") / F.lit(block_us)).cast("int"), F.lit(0)).alias("blk"),
        "ts_us",
        "event_id",
        *payload,
    )


def block_window(*order: Column | str) -> WindowSpec:
    """Within one entity's block."""
    w = Window.partitionBy("entity", "blk")
    return w.orderBy(*order) if order else w


def blocks_window() -> WindowSpec:
    """Over the blocks of one entity, for tables with one row a block."""
    return Window.partitionBy("entity").orderBy("blk")


def with_neighbours(blocked: DataFrame, payload: Sequence[str], before: int = 1, after: int = 0) -> DataFrame:
    """Adds ``p{k}_{c}`` and ``n{k}_{c}``: column c of the k-th record before and after, in the entity's order.

    ``blocked`` is the result of ``in_blocks``; the neighbours hold across blocks. c is each of
    ``payload`` plus event_id and ts_us. Beyond the entity's first and last record they are NULL.
    """
    cols = ["event_id", "ts_us", *payload]
    in_block, blocks = block_window("ts_us", "event_id"), blocks_window()
    ranks = {"_rn": F.row_number().over(in_block), "_n": F.count(F.lit(1)).over(block_window())}
    record = F.struct("ts_us", "event_id", *payload)
    pick = lambda cond: F.array_sort(F.collect_list(F.when(cond, record)))
    edges = (
        blocked.withColumns(ranks)
        .filter((F.col("_rn") <= after) | (F.col("_rn") > F.col("_n") - before))
        .groupBy("entity", "blk")
        .agg(pick(F.col("_rn") > F.col("_n") - before).alias("_tail"), pick(F.col("_rn") <= after).alias("_head"))
        .select(
            "entity",
            "blk",
            F.flatten(F.collect_list("_tail").over(blocks.rowsBetween(-max(before, 1), -1))).alias("_prev"),
            F.flatten(F.collect_list("_head").over(blocks.rowsBetween(1, max(after, 1)))).alias("_next"),
        )
    )
    shifts = {}
    for k in range(1, before + 1):
        shifts |= {f"p{k}_{c}": F.lag(c, k).over(in_block) for c in cols}
    for k in range(1, after + 1):
        shifts |= {f"n{k}_{c}": F.lead(c, k).over(in_block) for c in cols}
    df = blocked.withColumns(ranks | shifts).join(edges, ["entity", "blk"], "left")
    out = {}
    for k in range(1, before + 1):
        far = F.get("_prev", F.size("_prev") + F.col("_rn") - k - 1)
        out |= {f"p{k}_{c}": F.when(F.col("_rn") > k, F.col(f"p{k}_{c}")).otherwise(far[c]) for c in cols}
    for k in range(1, after + 1):
        far = F.get("_next", (F.col("_rn") + k - F.col("_n")).cast("int") - 1)
        inside = F.col("_rn") + k <= F.col("_n")
        out |= {f"n{k}_{c}": F.when(inside, F.col(f"n{k}_{c}")).otherwise(far[c]) for c in cols}
    return df.withColumns(out).drop("_rn", "_n", "_prev", "_next")
