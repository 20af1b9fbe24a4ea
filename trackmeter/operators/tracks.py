"""The canonical track table and the relations derived from an entity's order of fixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.functions.columns import settled
from trackmeter.functions.geo import haversine_m
from trackmeter.operators.fixes import BLANKS, BLOCK_US, block_window, dated_records, in_blocks, with_neighbours


def text_flag(c: Column) -> Column:
    """Text to boolean: true if it says true in any case, null if null or blank."""
    t = F.lower(F.trim(c, F.lit(BLANKS)))
    return F.when(t != "", t == "true")


#: column of an export -> (column of the track table, type); absent columns become null
TELEMETRY = {
    "location-lat": ("lat", "double"),
    "location-long": ("lon", "double"),
    "ground-speed": ("speed_mps", "float"),
    "heading": ("heading_deg", "float"),
    "height-above-ellipsoid": ("altitude_gps_m", "float"),
    "eobs:horizontal-accuracy-estimate": ("h_accuracy_m", "float"),
    "external-temperature": ("x_external_temp_c", "float"),
    "eobs:battery-voltage": ("x_battery_mv", "float"),
    "eobs:fix-battery-voltage": ("x_fix_battery_mv", "float"),
    "eobs:temperature": ("x_temperature_c", "float"),
    "eobs:used-time-to-get-fix": ("x_ttff_s", "float"),
    "eobs:speed-accuracy-estimate": ("x_speed_accuracy_mps", "float"),
    "tag-local-identifier": ("x_tag_id", "string"),
    "eobs:type-of-fix": ("x_type_of_fix", "string"),
    "eobs:status": ("x_status", "string"),
    "sensor-type": ("sensor", "string"),
    "argos:lc": ("argos_lc", "string"),
}
MARKS = {"manually-marked-outlier": "x_manual_outlier", "visible": "x_visible"}


def track_table(fixes: DataFrame, columns: Sequence[str] = ("lat", "lon"), positioned: bool = True) -> DataFrame:
    """``event_id, entity, ts_us`` and the wanted columns of the canonical record, each event-id once.

    A missing sensor is NULL, never zero: absent columns, NaN and text that is no number alike. Text
    marks become booleans and keep null. With ``positioned``, rows without both coordinates are left out.
    """
    have = {c.lower(): c for c in fixes.columns}
    extra: dict[str, Column] = {}
    for src, (dst, kind) in TELEMETRY.items():
        if dst in columns or (positioned and dst in ("lat", "lon")):
            c = F.col(f"`{have[src]}`").try_cast(kind) if src in have else F.lit(None).cast(kind)
            extra[dst] = F.when(~F.isnan(c), c) if kind in ("float", "double") and src in have else c
    for src, dst in MARKS.items():
        if dst in columns:
            extra[dst] = text_flag(F.col(f"`{have[src]}`").cast("string")) if src in have else F.lit(None).cast("boolean")
    df = dated_records(fixes, extra)
    return df.filter("lat is not null and lon is not null") if positioned else df


def unmarked(tracks: DataFrame) -> DataFrame:
    """Without fixes a curator marked as outliers; null is unmarked."""
    return tracks.filter(~F.coalesce("x_manual_outlier", F.lit(False)))


def seconds(us: str | Column) -> Column:
    """Whole seconds since 1970, floored."""
    return F.floor((F.col(us) if isinstance(us, str) else us) / F.lit(1_000_000)).cast("bigint")


def consecutive_pairs(tracks: DataFrame, payload: Sequence[str] = (), block_us: int = BLOCK_US) -> DataFrame:
    """Each fix with the one before it: ``p1_*``, ``dt_s`` (whole seconds), ``dist_m``, ``v_mps`` (over at least 1 s)."""
    cols = list(dict.fromkeys(["lat", "lon", *payload]))
    df = with_neighbours(in_blocks(tracks, cols, block_us), cols, before=1)
    dt = seconds("ts_us") - seconds("p1_ts_us")
    return df.withColumns({"dt_s": dt, "dist_m": haversine_m("p1_lat", "p1_lon", "lat", "lon")}).withColumn(
        "v_mps", F.when(F.col("dt_s").isNotNull(), F.col("dist_m") / F.greatest("dt_s", F.lit(1)))
    )


def triplets(tracks: DataFrame, block_us: int = BLOCK_US) -> DataFrame:
    """Three consecutive fixes A, B, C at C: ``excursion_m`` = (AB + BC - AC) / 2, and the step BC."""
    df = with_neighbours(in_blocks(tracks, ["lat", "lon"], block_us), ["lat", "lon"], before=2)
    df = settled(df, {"step_m": haversine_m("p1_lat", "p1_lon", "lat", "lon")})
    df = settled(df, {"_ab": haversine_m("p2_lat", "p2_lon", "p1_lat", "p1_lon"), "_ac": haversine_m("p2_lat", "p2_lon", "lat", "lon")})
    return df.withColumn("excursion_m", (F.col("_ab") + F.col("step_m") - F.col("_ac")) / 2).drop("_ab", "_ac")


def islands(df: DataFrame, breaks: Column) -> DataFrame:
    """Adds ``island`` (per entity, from 1), ``rank`` (from 0) and ``size`` of runs that begin where ``breaks``.

    ``df`` is keyed by (entity, blk); an entity's first row begins a run in any case. Counts run within
    blocks, and what they need of other blocks (rows and breaks so far, the nearest break on either
    side) comes from a table with one row a block, so a run may span any number of blocks.
    """
    w = block_window("ts_us", "event_id")
    # what lies ahead is a running frame over the opposite order: a frame that ends unbounded costs n squared
    ahead = block_window(F.desc("ts_us"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_brk", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn("_row", F.row_number().over(w))
    at = F.when(F.col("_brk") == 1, F.col("_row"))
    blocks = d.groupBy("entity", "blk").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("_brk").alias("_brks"), F.max(at).alias("_last"), F.min(at).alias("_first")
    )
    b = Window.partitionBy("entity").orderBy("blk")
    before = b.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("entity").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    blocks = blocks.select(
        "entity",
        "blk",
        "_off",
        F.coalesce(F.sum("_brks").over(before), F.lit(0)).alias("_boff"),
        F.coalesce(F.last(F.col("_last") + F.col("_off"), True).over(before), F.lit(1)).alias("_prev"),
        F.coalesce(F.last(F.col("_first") + F.col("_off"), True).over(after), F.sum("_rows").over(Window.partitionBy("entity")) + 1).alias("_next"),
    )
    d = d.withColumns({"_runs": F.sum("_brk").over(so_far), "_begin": F.max(at).over(so_far), "_end": F.min(at).over(ahead)})
    d = d.join(blocks, ["entity", "blk"])
    begin = F.coalesce(F.col("_begin") + F.col("_off"), "_prev")
    end = F.coalesce(F.col("_end") + F.col("_off"), "_next")
    return d.withColumns(
        {"island": F.col("_boff") + F.col("_runs"), "rank": F.col("_off") + F.col("_row") - begin, "size": end - begin}
    ).drop("_brk", "_row", "_runs", "_begin", "_end", "_off", "_boff", "_prev", "_next")


def gap_bursts(tracks: DataFrame, gap_s: float = 60, payload: Sequence[str] = (), block_us: int = BLOCK_US) -> DataFrame:
    """Pairs with ``island, rank, size``: a burst ends where more than ``gap_s`` whole seconds pass."""
    df = consecutive_pairs(tracks, payload, block_us)
    return islands(df, F.col("dt_s").isNull() | (F.col("dt_s") > gap_s))


def first_per_second(tracks: DataFrame) -> DataFrame:
    """One fix per entity and whole second: the first by time, then event-id."""
    w = Window.partitionBy("entity", "tsec").orderBy("ts_us", "event_id")
    df = tracks.withColumn("tsec", seconds("ts_us")).withColumn("_again", F.lag(F.lit(1)).over(w))
    return df.filter("_again is null").drop("_again")
