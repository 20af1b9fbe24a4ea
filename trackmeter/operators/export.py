"""Trajectory export: points, tracks and day paths as text geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.operators.corpus import plain_number
from trackmeter.operators.tracks import gap_bursts


#: vertices of a row of text geometry
MOST_VERTICES = 20_000


def iso(us: str) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss")


def points(tracks: DataFrame, gap_h: float = 6.0) -> DataFrame:
    """``entity, event_id, ts_us, ts, lon, lat, flagged, seg, rank``: segments break where over ``gap_h`` hours pass."""
    d = gap_bursts(tracks, gap_h * 3600, ["flagged"])
    return d.select("entity", "event_id", "ts_us", iso("ts_us").alias("ts"), "lon", "lat", "flagged", F.col("island").alias("seg"), "rank")


def lines(pts: DataFrame, key: str, most: int = MOST_VERTICES) -> DataFrame:
    """Lines of each entity and ``key`` with at least two vertices, in order of time and event-id, as WKT.

    A line of more than ``most`` vertices comes in parts, numbered from 0, each of which begins at the
    last vertex of the one before; so a device that never pauses is many rows of bounded size. ``rank``
    is a vertex's place in its line, from 0.
    """
    part = F.floor(F.col("rank") / most)
    parts = F.when((F.col("rank") > 0) & (F.col("rank") % most == 0), F.array(part - 1, part)).otherwise(F.array(part))
    pts = pts.withColumn("part", F.explode(parts.cast("array<int>")))
    v = F.array_sort(F.collect_list(F.struct("ts_us", "event_id", "lon", "lat")))
    g = pts.groupBy("entity", F.col(key).cast("string").alias("seg"), "part").agg(
        v.alias("v"), F.count(F.lit(1)).alias("n_fix"), F.min("ts_us").alias("a"), F.max("ts_us").alias("b"), (100.0 * F.avg(F.col("flagged").cast("int"))).alias("pct_flag")
    )
    xy = F.transform("v", lambda p: F.concat(plain_number(p["lon"]), F.lit(" "), plain_number(p["lat"])))
    wkt = F.concat(F.lit("LINESTRING ("), F.array_join(xy, ", "), F.lit(")"))
    return g.filter("n_fix >= 2").select(
        "entity", "seg", "part", iso("a").alias("start"), iso("b").alias("end"), "n_fix", ((F.col("b") - F.col("a")) / 3.6e9).alias("dur_h"), "pct_flag", wkt.alias("wkt")
    )


def tracks_layer(pts: DataFrame, most: int = MOST_VERTICES) -> DataFrame:
    return lines(pts, "seg", most)


def day_paths(pts: DataFrame, most: int = MOST_VERTICES) -> DataFrame:
    """As ``tracks_layer``, by UTC day: a vertex's place is counted within its entity's day."""
    w = Window.partitionBy("entity", "day").orderBy("ts_us", "event_id")
    return lines(pts.withColumn("day", F.substring("ts", 1, 10)).withColumn("rank", F.row_number().over(w) - 1), "day", most)


def geojson(layer: DataFrame) -> DataFrame:
    """Adds ``feature``: the line as a GeoJSON feature."""
    inner = F.regexp_replace(F.regexp_replace("wkt", r"LINESTRING \(|\)", ""), r"([^ ,]+) ([^ ,]+)", "[$1,$2]")
    props = F.to_json(F.struct("entity", "seg", "part", "start", "end", "n_fix", "dur_h", "pct_flag"))
    return layer.withColumn(
        "feature", F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"LineString","coordinates":['), inner, F.lit("]}}"))
    )
