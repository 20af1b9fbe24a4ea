"""Guards and conformance: rules by device, refusals to publish, status lattices, provenance."""

from __future__ import annotations

from collections.abc import Sequence

import pyspark
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import trackmeter
from trackmeter.sources.exports import mixed_timestamp

#: fixed values: export columns, the pivot column they stand for and its unit, in order of preference
CANON = (
    ("timestamp", "ts", "iso8601"),
    ("location-lat", "lat", "deg"),
    ("location-long", "lon", "deg"),
    ("ground-speed", "speed_mps", "m/s"),
    ("heading", "heading_deg", "deg"),
    ("height-above-ellipsoid", "altitude_gps_m", "m"),
    ("height-above-msl", "altitude_gps_m", "m"),
    ("gps:hdop", "hdop", None),
    ("gps:satellite-count", "n_satellites", None),
    ("eobs:horizontal-accuracy-estimate", "h_accuracy_m", "m"),
    ("individual-local-identifier", "device_id", None),
)

#: fixed values: words that stand for a missing value, and what a number looks like
MISSING = ("na", "n/a", "#n/a", "nan", "null", "none")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


class GuardError(AssertionError):
    """Two figures that must agree do not, or a file breaks a rule: nothing is published."""


def mapping_for(columns: Sequence[str]) -> dict[str, tuple[str, str | None]] | None:
    """Pivot column -> (export column, unit) from the columns present; the first present wins. None if out of scope."""
    out: dict[str, tuple[str, str | None]] = {}
    for src, dst, unit in CANON:
        if src in columns and dst not in out:
            out[dst] = (src, unit)
    return out if {"ts", "lat", "lon"} <= out.keys() else None


def project(df: DataFrame) -> DataFrame | None:
    """The mapped columns under their pivot names, as they are; None if out of scope."""
    m = mapping_for(df.columns)
    return None if m is None else df.select(*[F.col(f"`{src}`").alias(dst) for dst, (src, _) in m.items()])


def device_report(tracks: DataFrame, order: str = "event_id", width: int = 1_000_000) -> DataFrame:
    """Rules by device: ``entity, n, no_position, off_globe, backwards, negative_speed, ok``.

    backwards: fixes whose time is before that of some fix preceding them in ``order`` (a whole number
    that gives delivery or file order), found by a running maximum of time within blocks of ``width``
    numbers and over the blocks' maxima. A device is ok if it breaks no rule.
    """
    d = tracks.withColumn("_blk", F.floor(F.col(order) / width))
    own = Window.partitionBy("entity", "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy("entity").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    tops = d.groupBy("entity", "_blk").agg(F.max("ts_us").alias("_top")).select("entity", "_blk", F.max("_top").over(blocks).alias("_top"))
    d = d.withColumn("_own", F.max("ts_us").over(own)).join(tops, ["entity", "_blk"])
    d = d.withColumn("_before", F.greatest("_own", "_top"))
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("int"))
    r = d.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"),
        n(F.col("lat").isNull() | F.col("lon").isNull()).alias("no_position"),
        n((F.abs("lat") > 90) | (F.abs("lon") > 180)).alias("off_globe"),
        n(F.col("ts_us") < F.col("_before")).alias("backwards"),
        n(F.col("speed_mps") < 0).alias("negative_speed"),
    )
    bad = F.col("no_position") + F.col("off_globe") + F.col("backwards") + F.col("negative_speed")
    return r.withColumn("ok", bad == 0)


def device_rules(tracks: DataFrame) -> DataFrame:
    """Rules that need no order, counted by device map-side: ``entity, n, no_position, off_globe, negative_speed, ok``."""
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("int"))
    r = tracks.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"),
        n(F.col("lat").isNull() | F.col("lon").isNull()).alias("no_position"),
        n((F.abs("lat") > 90) | (F.abs("lon") > 180)).alias("off_globe"),
        n(F.col("speed_mps") < 0).alias("negative_speed"),
    )
    return r.withColumn("ok", F.col("no_position") + F.col("off_globe") + F.col("negative_speed") == 0)


def require_valid(report: DataFrame) -> DataFrame:
    """The report, or GuardError naming some devices that fail. Run before anything is written."""
    bad = report.filter(~F.col("ok")).select("entity").orderBy("entity").limit(5).collect()
    if bad:
        raise GuardError(f"devices break a rule: {[r.entity for r in bad]}")
    return report


def require_equal(what: str, a: float, b: float) -> None:
    """Refuses if two independently computed totals differ."""
    if a != b:
        raise GuardError(f"inconsistent {what}: {a} against {b}")


def cross_check(pairs_total: DataFrame, by_rank: DataFrame) -> int:
    """Total flags by device against total flags by rank, from two plans; the total if they agree."""
    a = pairs_total.agg(F.coalesce(F.sum("flagged"), F.lit(0))).first()[0]
    b = by_rank.agg(F.coalesce(F.sum("flagged"), F.lit(0))).first()[0]
    require_equal("flag total", a, b)
    return a


def require_robust(p_values: Sequence[float], limit: float = 1e-5) -> None:
    """Refuses a conclusion that does not hold under every label set."""
    if not p_values or max(p_values) >= limit:
        raise GuardError(f"not below {limit} under every label set: {list(p_values)}")


def with_provenance(df: DataFrame) -> DataFrame:
    """Which instrument measured this: version and path of the engine, version of Spark."""
    return df.withColumns(
        {
            "engine_version": F.lit(trackmeter.__version__),
            "engine_path": F.lit(trackmeter.__path__[0]),
            "spark_version": F.lit(pyspark.__version__),
        }
    )


def conformance_status(
    readable: Column, intact: Column, in_scope: Column, converted: Column, errors: Column, usable: Column | None = None, mapped: Column | None = None, rows: Column | None = None
) -> Column:
    """The status of a file, in order: no usable file, damaged archive, unreadable, out of scope, mapping refused,
    conversion failed, validation failed (no row to validate), not finished (errors were not counted),
    non-conformant, conformant."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    yes = F.lit(True)
    return (
        F.when(no(yes if usable is None else usable), "no usable file")
        .when(no(intact), "damaged archive")
        .when(no(readable), "unreadable")
        .when(no(in_scope), "out of scope")
        .when(no(yes if mapped is None else mapped), "mapping refused")
        .when(no(converted), "conversion failed")
        .when(no(yes if rows is None else rows > 0), "validation failed")
        .when(errors.isNull(), "not finished")
        .when(errors > 0, "non-conformant")
        .otherwise("conformant")
    )


def file_report(raw: DataFrame, lines: DataFrame, heads: DataFrame, files: DataFrame) -> DataFrame:
    """``file_id, status, errors, n_lines, detail``: every file of ``files`` and ``raw``, every canonical value looked at.

    ``raw`` (``file_id, line_no, line``) are the lines, ``lines`` (``file_id, names, vals``) those under a
    header, parsed, with blank values null; ``heads`` (``file_id, names``) has the files with a header;
    ``files`` has ``file_id, n_records``. Of headers that stand for
    one pivot column the first present of ``CANON`` counts, under its exact name.

    Errors are lines of another length than the header, values that do not cast to a number, unreadable
    times and coordinates off the globe. A value or time that does not cast, or a line longer than its
    header, stops the conversion. A file with fewer lines than ``n_records`` is cut, hence damaged; one
    without header is unreadable, one without any text no usable file. A header that names a canonical
    column twice refuses the mapping; one without lines below leaves nothing to validate.
    """
    low = lambda x: F.when(~F.lower(x).isin(*MISSING), x)
    places: dict[str, Column] = {}
    for src, dst, _ in CANON:
        at = F.nullif(F.array_position("names", F.lit(src)).cast("int"), F.lit(0))
        places[dst] = F.coalesce(places[dst], at) if dst in places else at
    text = {dst: low(F.get("vals", at - 1)) for dst, at in places.items()}
    numbers = [dst for dst in text if dst not in ("ts", "device_id")]
    number = {dst: F.when(text[dst].rlike(NUMBER), text[dst].try_cast("double")) for dst in ("lat", "lon")}
    dated = text["ts"].rlike("^[0-9]{1,4}[-/]") & mixed_timestamp(text["ts"]).isNotNull()
    n = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("int"))
    uncast = F.size(F.filter(F.array(*[text[dst] for dst in numbers]), lambda x: x.isNotNull() & ~x.rlike(NUMBER)))
    text_there = F.trim(F.coalesce("line", F.lit(""))) != ""
    sizes = raw.groupBy("file_id").agg(n((F.col("line_no") > 0) & F.col("line").isNotNull()).alias("n_lines"), F.max(text_there).alias("usable"))
    far = F.exists(F.array(F.abs(number["lat"]), F.abs(number["lon"]) - 90), lambda x: x > 90)
    body = lines.groupBy("file_id").agg(
        n(F.size("vals") < F.size("names")).alias("short"),
        n(F.size("vals") > F.size("names")).alias("long"),
        F.sum(uncast).alias("uncast"),
        n(text["ts"].isNotNull() & ~dated).alias("undated"),
        n(far).alias("off_globe"),
    )
    core, mapped = F.lit(True), F.lit(True)
    for src, dst, _ in CANON:
        if dst in ("ts", "lat", "lon"):
            core = core & F.array_contains("names", F.lit(src))
        mapped = mapped & (F.size(F.filter("names", lambda x: x == src)) < 2)
    listed = files.groupBy("file_id").agg(F.max("n_records").alias("n_records"))
    d = sizes.join(listed, "file_id", "full").join(heads.select("file_id", core.alias("in_scope"), mapped.alias("mapped")), "file_id", "left").join(body, "file_id", "left")
    d = d.filter("file_id is not null").fillna(0, ["n_lines", "short", "long", "uncast", "undated", "off_globe"])
    d = d.withColumns(
        {
            "errors": F.when(F.col("in_scope"), F.col("short") + F.col("long") + F.col("uncast") + F.col("undated") + F.col("off_globe")).otherwise(0),
            "intact": F.col("n_lines") >= F.coalesce("n_records", F.lit(0)),
            "readable": F.col("in_scope").isNotNull(),
        }
    )
    part = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}")))
    named = {"short": "short lines", "long": "long lines", "uncast": "values that do not cast", "undated": "unreadable times", "off_globe": "points off the globe"}
    found = F.concat_ws(", ", *[part(c, what) for c, what in named.items()])
    detail = (
        F.when(~F.col("intact"), F.concat_ws(" of ", F.col("n_lines").cast("string"), F.concat(F.col("n_records").cast("string"), F.lit(" lines"))))
        .when(~F.coalesce("usable", F.lit(False)), "no text")
        .when(~F.col("readable"), "no header line")
        .when(~F.col("in_scope"), "neither time nor position among the columns")
        .when(~F.col("mapped"), "a column comes twice")
        .when(F.col("errors") > 0, found)
    )
    status = conformance_status(
        F.col("readable"), F.col("intact"), F.col("in_scope"), F.col("long") + F.col("uncast") + F.col("undated") == 0, F.col("errors"),
        usable=F.col("usable") | ~F.col("intact"), mapped=F.col("mapped"), rows=F.col("n_lines"),
    )
    return d.select("file_id", status.alias("status"), "errors", "n_lines", detail.alias("detail"))


def status_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def top_causes(files: DataFrame, top: int = 3, detail: str = "detail") -> DataFrame:
    """``status, detail, n, rank``: the most frequent causes (first 90 characters) of each status; ties by text."""
    c = files.filter(F.col(detail).isNotNull()).groupBy("status", F.substring(detail, 1, 90).alias("detail")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("status").orderBy(F.desc("n"), "detail")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)


def top_warnings(files: DataFrame, column: str = "warnings", top: int = 10) -> DataFrame:
    """``warning, n``: the most frequent parts of bar-separated warnings (first 80 characters)."""
    w = files.select(F.explode(F.split(column, r" \| ")).alias("w")).filter("w <> ''")
    return w.groupBy(F.substring("w", 1, 80).alias("warning")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "warning").limit(top)
