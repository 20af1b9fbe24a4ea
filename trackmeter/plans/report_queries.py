"""Summaries, reports and surveys of the measuring bench, each over its whole tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trackmeter.operators import conformance, corpus, declare, fence, fleet
from trackmeter.operators.drift import headers, ingest, replay
from trackmeter.operators.tracks import consecutive_pairs, track_table
from trackmeter.plans.bench_queries import _in_park, _pairs, _sound, _tracks, r, rounded
from trackmeter.plans.problem_queries import approvals
from trackmeter.session import Written
from trackmeter.sources.exports import mixed_timestamp
from trackmeter.sources.tables import Tables

#: a ring of many corners about the park, in whole metres
STAR = tuple(
    (float(round(550_000 + (300_000 if k % 2 else 450_000) * math.cos(k * math.pi / 120))), float(round(400_000 + (300_000 if k % 2 else 450_000) * math.sin(k * math.pi / 120))))
    for k in range(240)
)
#: exports here hold about 40 lines: a device is judged from 5 fixes on, a file read from 10 rows on
LEAST_FIXES, LEAST_ROWS = 5, 10


def speed_gate_summary(spark, d):
    return rounded(fleet.speed_gate_summary(consecutive_pairs(_sound(spark, d))), pct=6, median_jump_m=3)


def contaminated_jumps(spark, d):
    return rounded(fleet.contaminated_jumps(_pairs(spark, d)), max_jump_m=3, median_jump_m=3, p90_jump_m=3, median_mps=6, p90_mps=6)


def four_fix_summary(spark, d):
    return rounded(fleet.four_fix_summary(fleet.four_fix_bursts(_sound(spark, d), _pairs(spark, d))), fix1_is_outlier_pct=6, fix1_median_m=3, fix2_median_m=3)


def detector_report(spark, d):
    """Spike rates of Argos devices against GPS devices under two sets of labels, with both medians and the level."""
    t = Written(spark).put(_tracks(spark, d, "sensor"), "tracks")
    n = t.groupBy("entity", F.lower("sensor").alias("sensor")).agg(F.count(F.lit(1)).alias("n"))
    main = n.groupBy("entity").agg(F.max(F.struct("n", "sensor"))["sensor"].alias("sensor"))
    q = corpus.spikes(corpus.sized(t, 50)).withColumn("pct_spikes", 100 * F.col("spikes") / F.col("triplets"))
    q = Written(spark).put(q.join(main, "entity"), "quality")
    return rounded(corpus.detector_report(q, (("gps",), ("gps", "gnss", "solar-geolocator"))), median_high=6, median_low=6, z=4, p=6)


def device_report(spark, d):
    """Rules by device, order of delivery (by event-id) among them."""
    return conformance.device_report(track_table(Tables(spark, d).position_fixes, ("lat", "lon", "speed_mps"), positioned=False))


def fence_large_ring(spark, d):
    """Containment in, and distance to, a ring of 240 corners."""
    p = _in_park(spark, d).select("event_id", fence.in_polygon(F.col("e"), F.col("n"), STAR).alias("inside"), fence.ring_distance(F.col("e"), F.col("n"), STAR).alias("metres"))
    return rounded(p, metres=1)


def inventory_sizes(spark, d):
    """Deposits with the bytes and first names of their export files; items without files have none."""
    t = Tables(spark, d)
    size = t.export_lines.groupBy("file_id").agg(F.sum(F.length("line") + 1).alias("bytes"))
    files = t.export_files.join(size, "file_id", "left").withColumns({"bundle": F.lit("ORIGINAL"), "name": F.concat("file_id", F.lit(".csv"))})
    return corpus.with_sizes(t.deposits.select("uuid"), corpus.file_sizes(files.withColumn("seq", F.unix_micros(F.col("exported_at").cast("timestamp")))))


def metadata_lines(spark, d):
    """Each deposit's metadata as bracketed lines, empty values left out."""
    one = lambda c: F.array(F.col(c).cast("string"))
    m = F.create_map(F.lit("dc.title"), one("titre"), F.lit("dc.description"), one("description"), F.lit("dc.subject"), one("taxon"), F.lit("dc.date"), one("date_published"))
    return Tables(spark, d).deposits.select("uuid", declare.flatten_metadata(m).alias("metadata"))


def property_counts(spark, d):
    """Quality sheets that show each property, or any of them."""
    from trackmeter.plans.bench_queries import parsed_sheets

    q = declare.properties(parsed_sheets(spark, d))
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(c)
    return q.agg(F.count(F.lit(1)).alias("sheets"), *[n(c) for c in ("has_repetition", "has_truncation", "has_spikes", "has_any")])


def _file_tracks(spark, d):
    """The positions of every export file: ``file_id, entity, ts_us, event_id`` (the line), ``lat, lon``; written once."""
    t = Tables(spark, d)
    heads = headers(t.export_lines, t.field_dictionary, approvals(spark))
    table = Written(spark).put(replay(ingest(t.export_lines, heads, t.field_dictionary), heads, t.field_dictionary), "ingested")
    ts = F.unix_micros(mixed_timestamp(F.col("timestamp")))
    p = table.select("file_id", F.lower(F.trim("`individual-local-identifier`")).alias("entity"), ts.alias("ts_us"), F.col("line_no").cast("bigint").alias("event_id"), F.col("`location-lat`").alias("lat"), F.col("`location-long`").alias("lon"))
    return Written(spark).put(p.dropna().dropDuplicates(["file_id", "event_id"]), "tracks"), heads


def _file_measures(spark, d):
    tracks, heads = _file_tracks(spark, d)
    return corpus.measure_by(tracks, "file_id", least=LEAST_FIXES), heads


def corpus_files(spark, d):
    """The quality row of every export file."""
    m, _ = _file_measures(spark, d)
    return rounded(m, days=3, pct_repeated=6, pct_spikes=6, gap_p95_s=6, regular_pct=6, least_step_m=6)


def corpus_items(spark, d):
    """Each deposit's largest file with its measures, and whether any of its files could be used."""
    m, heads = _file_measures(spark, d)
    t = Tables(spark, d)
    has = heads.select("file_id", (F.array_contains("resolved", F.lit("location-lat")) & F.array_contains("resolved", F.lit("location-long"))).alias("placed"))
    files = t.export_files.select("file_id", "uuid").join(has, "file_id", "left").join(m, "file_id", "left")
    files = files.withColumn("status", corpus.file_status(F.col("placed").isNotNull(), F.col("placed"), F.col("n_fixes"), LEAST_ROWS))
    files = Written(spark).put(files, "files")
    best = corpus.best_file(files, "uuid", "file_id").select("uuid", "file_id", "n_fixes", r("pct_spikes", 6).alias("pct_spikes"))
    return corpus.dataset_status(files).join(best, "uuid")


_HELPERS = {"r", "rounded", "approvals", "headers", "ingest", "replay"}
QUERIES = {k: f for k, f in list(globals().items()) if getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in _HELPERS}
