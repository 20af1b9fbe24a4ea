"""Quality sheets: readings of the measures and the text of a sheet, as string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duration_text(s: Column) -> Column:
    """Seconds in the largest fitting unit; ``unknown`` for NULL."""
    f = lambda pattern, x: F.format_string(pattern, x.cast("double"))
    return (
        F.when(s.isNull(), "unknown")
        .when(s < 90, f("%.0f s", s))
        .when(s < 5400, f("%.0f min", s / 60))
        .when(s < 172800, f("%.1f h", s / 3600))
        .otherwise(f("%.1f d", s / 86400))
    )


#: fixed values below: the wording of the readings and their limits
def readings(quality: DataFrame) -> DataFrame:
    """Adds ``read_spikes, read_repeats, read_grain`` and ``limits``, an array of what the data do not support."""
    p, q, d, m, r = (F.col(c) for c in ("pct_spikes", "pct_repeated", "decimals_lat", "least_step_m", "regular_pct"))
    metres = F.when(m.isNull(), "unknown size").otherwise(F.format_string("%.0f m", m.cast("double")))
    limits = F.array_compact(
        F.array(
            F.when(d <= 4, F.concat(F.lit("Any analysis finer than "), metres)),
            F.when(q > 5, F.lit("Counts of fixes as a measure of effort")),
            F.when(p > 0.05, F.lit("Path length without a filter")),
            F.when(r < 60, F.lit("Distances compared between individuals without resampling")),
        )
    )
    return quality.withColumns(
        {
            "read_spikes": F.when(p.isNull(), "not measured").when(p < 0.01, "nothing notable").when(p < 0.05, "a few isolated outliers").otherwise("high rate"),
            "read_repeats": F.when(q.isNull(), "not measured").when(q < 1, "nothing notable").when(q < 5, "frequent repeats").otherwise("major share without a new position"),
            "read_grain": F.when(d.isNull(), "not measured").when(d >= 6, "precision preserved").when(d == 5, "acceptable grain").otherwise(
                F.concat(F.lit("truncated at export, grid of about "), metres)
            ),
            "limits": F.when(F.size(limits) > 0, limits).otherwise(F.array(F.lit("None found by these tests"))),
        }
    )


def with_licence(quality: DataFrame, licences: DataFrame) -> DataFrame:
    """Left join on uuid; ``not declared`` where there is none. Of several licences of an item the first by name."""
    one = licences.groupBy("uuid").agg(F.min("licence").alias("licence"))
    return quality.join(one, "uuid", "left").withColumn("licence", F.coalesce("licence", F.lit("not declared")))


#: how the measures were taken, at the foot of each sheet
METHOD = (
    "\nMethod:\n\n"
    "For three consecutive fixes A, B, C the excursion is (AB + BC - AC) / 2. It counts as a spike beyond ten times the 0.95 quantile of the device's own steps, "
    "so no species and no scale is assumed. A repeat is a step of exactly zero. The grain is the median number of decimals of the latitude."
)


def sheet_text(quality: DataFrame, title: str = "title") -> DataFrame:
    """Adds ``sheet``: Markdown of one dataset's measures, readings and limits."""
    d = readings(quality)
    row = lambda name, value: F.concat(F.lit(f"| {name} | "), F.coalesce(value, F.lit("unknown")), F.lit(" |"))
    num = lambda pattern, c: F.format_string(pattern, F.col(c).cast("double"))
    licence = F.col("licence") if "licence" in d.columns else F.lit("not declared")
    lines = [
        F.concat(F.lit("# "), F.coalesce(F.col(title), F.lit("untitled"))),
        F.lit(""),
        F.concat(F.lit("Source licence: "), licence, F.when(F.contains(licence, F.lit("NonCommercial")), F.lit(" (this sheet inherits the non-commercial terms)")).otherwise("")),
        F.lit("\n| Measure | Value |\n|---|---|"),
        row("Dominant sensor", F.coalesce("sensor", F.lit("not declared")) if "sensor" in d.columns else F.lit("not declared")),
        row("Fixes", F.format_number("n_fixes", 0)),
        row("Individuals", F.format_number("n_individuals", 0)),
        row("Span", F.concat(num("%.0f", "days"), F.lit(" days"))),
        row("Median cadence", duration_text(F.col("gap_median_s"))),
        row("Dominant cadence", duration_text(F.col("gap_mode_s"))),
        row("Regularity", F.concat(num("%.0f", "regular_pct"), F.lit(" % of gaps at the dominant cadence"))),
        row("95th percentile of gaps", duration_text(F.col("gap_p95_s"))),
        row("Position spikes", F.concat(num("%.3f", "pct_spikes"), F.lit(" %, "), F.col("read_spikes"))),
        row("Repeated positions", F.concat(num("%.2f", "pct_repeated"), F.lit(" %, "), F.col("read_repeats"))),
        row("Coordinate grain", F.concat(F.col("decimals_lat").cast("string"), F.lit(" decimals, "), F.col("read_grain"))),
        F.lit("\nNot supported:\n"),
        F.concat(F.lit("- "), F.array_join("limits", "\n- ")),
        F.lit(METHOD),
    ]
    return d.withColumn("sheet", F.concat_ws("\n", *lines))
