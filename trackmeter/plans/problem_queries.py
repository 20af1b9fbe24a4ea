"""Queries of the general data-preparation problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmeter.operators import drift
from trackmeter.operators.packed import all_bursts, odd_bursts
from trackmeter.operators.sessions import sessions
from trackmeter.operators.spatial import near_pairs, regions_of_points
from trackmeter.operators.fixes import BLOCK_US, placed_records
from trackmeter.operators.spikes import Steps, chosen_cells, implausible
from trackmeter.plans import problem_oracles as sql
from trackmeter.session import Written
from trackmeter.sources.tables import Tables


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible(Tables(spark, sf_dir).position_fixes).select("event_id").distinct()


def p1_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that stand out in the pursuit: low-rank and sparse part, and which of them chose."""
    return chosen_cells(Steps(Tables(spark, sf_dir).position_fixes, 0.95, 3, BLOCK_US).cells)


#: headers approved for promotion into a field of the dictionary; case, blanks, marks and units do not matter
APPROVALS = (
    ("speed over ground", "ground-speed"),
    ("vitesse sol", "ground-speed"),
    ("height ellipsoid", "height-above-ellipsoid"),
    ("ellipsoid height", "height-above-ellipsoid"),
    ("hauteur ellipsoide", "height-above-ellipsoid"),
    ("manual outlier", "manually-marked-outlier"),
    ("marked outlier manually", "manually-marked-outlier"),
    ("outlier", "manually-marked-outlier"),
    ("aberrant marque main", "manually-marked-outlier"),
    ("heading degrees", "heading"),
    ("ext temperature", "external-temperature"),
)


def approvals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(APPROVALS), "header string, field string")


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All lines of all files in one typed table after the replay of rescued values; and the files' headers."""
    t = Tables(spark, sf_dir)
    heads = drift.headers(t.export_lines, t.field_dictionary, approvals(spark))
    return drift.replay(drift.ingest(t.export_lines, heads, t.field_dictionary), heads, t.field_dictionary), heads


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    table, heads = _ingested(spark, sf_dir)
    fields = Written(spark).put(drift.profile(table, heads, t.field_dictionary), "fields")  # met twice: as now and as before
    return drift.changes(t.export_files, fields).select("file_id", "field", "change_kind")


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table with what has no place in it, as JSON from header to raw text."""
    return _ingested(spark, sf_dir)[0].drop("_spelled")


def p2_preserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ingestion alone preserves by line, before headers are promoted."""
    t = Tables(spark, sf_dir)
    heads = drift.headers(t.export_lines, t.field_dictionary)
    return drift.ingest(t.export_lines, heads, t.field_dictionary).filter("_rescued is not null").select("file_id", "line_no", "_rescued")


def p2_rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has no place in ``p2_table``, by line, as JSON from header to raw text."""
    return _ingested(spark, sf_dir)[0].filter("_rescued is not null").select("file_id", "line_no", "_rescued")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(Tables(spark, sf_dir).position_fixes).select("first_event_id", "last_event_id")


def p5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session with its start, end, duration and number of records."""
    return sessions(Tables(spark, sf_dir).position_fixes)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(Tables(spark, sf_dir).position_fixes).select("event_id_a", "event_id_b")


def tiles(spark: SparkSession) -> DataFrame:
    """``region_id, ring``: regions over the country of the tables, in 1/64 degrees, exact in binary.

    A raster of tiles an eighth of a degree wide, each a notched region and the wedge that fills the
    notch, so neighbours share borders; a small square in each wedge; one large region over all.
    """
    x, y = F.lit(12.875) + F.pmod("id", F.lit(9)) / 8, F.lit(-8.0) + F.floor(F.col("id") / 9) / 8
    ring = lambda *pts: F.array(*[F.struct((x + a / 64).alias("lon"), (y + b / 64).alias("lat")) for a, b in pts])
    shapes = {"notched": ring((0, 0), (8, 0), (8, 8), (3.53125, 2.28125), (0, 8)), "wedge": ring((0, 8), (3.53125, 2.28125), (8, 8)), "square": ring((3, 6), (5, 6), (5, 7), (3, 7))}
    each = F.explode(F.array(*[F.struct(F.concat(F.lit(f"{k}-"), F.col("id")).alias("region_id"), r.alias("ring")) for k, r in shapes.items()])).alias("r")
    whole = [(12.5, -9.0), (14.5, -9.0), (14.5, -6.5), (13.75, -7.25), (13.5, -6.5), (12.5, -6.5)]
    large = spark.createDataFrame([("large", [{"lon": a, "lat": b} for a, b in whole])], "region_id string, ring array<struct<lon:double,lat:double>>")
    return spark.range(90).select(each).select("r.*").unionByName(large)


def p6_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions each placed record lies in."""
    fixes = placed_records(Tables(spark, sf_dir).position_fixes)
    return regions_of_points(fixes, tiles(spark), "event_id").select("event_id", "region_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_bursts(Tables(spark, sf_dir).acc_records)


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every burst, however written."""
    return all_bursts(Tables(spark, sf_dir).acc_records)


QUERIES = {
    "p1_found": p1_found,
    "p1_cells": p1_cells,
    "p2_found": p2_found,
    "p2_table": p2_table,
    "p2_preserved": p2_preserved,
    "p2_rescued": p2_rescued,
    "p5_found": p5_found,
    "p5_sessions": p5_sessions,
    "p6_found": p6_found,
    "p6_regions": p6_regions,
    "p7_found": p7_found,
    "p7_values": p7_values,
}
ORACLES = {
    "p1_found": sql.P1_FOUND,
    "p2_found": sql.P2_FOUND,
    "p2_table": sql.P2_TABLE,
    "p2_preserved": sql.P2_PRESERVED,
    "p2_rescued": sql.P2_RESCUED,
    "p5_found": sql.P5_FOUND,
    "p5_sessions": sql.P5_SESSIONS,
    "p6_found": sql.P6_FOUND,
    "p6_regions": sql.P6_REGIONS,
    "p7_found": sql.P7_FOUND,
    "p7_values": sql.P7_VALUES,
}
