"""A burst read as one measurement: speed of the fitted line, residual, path and chord."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmeter.functions.geo import EARTH_RADIUS_M
from trackmeter.operators.quantile import summary_quantiles
from trackmeter.operators.tracks import gap_bursts, seconds


def burst_features(tracks: DataFrame, gap_s: float = 60, least: int = 4, span_s: float = 5) -> DataFrame:
    """``entity, island, start_s, n_fixes, span_s, v_mps, resid_m, path_m, chord_m`` of bursts of at least ``least`` fixes.

    Metres east and north of the burst's mean. The fit needs moments only, so it is two aggregations by
    burst and no matrix: the first gives the centre, the second the moments about it.
    """
    b = gap_bursts(tracks, gap_s).filter(F.col("size") >= least).withColumn("t", seconds("ts_us").cast("double"))
    centre = b.groupBy("entity", "island").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"), F.avg("t").alias("t0"))
    d = b.join(centre, ["entity", "island"])
    per_m = F.cos(F.radians("lat0")) * EARTH_RADIUS_M
    d = d.withColumns(
        {
            "x": F.radians(F.col("lon") - F.col("lon0")) * per_m,
            "y": F.radians(F.col("lat") - F.col("lat0")) * EARTH_RADIUS_M,
            "tc": F.col("t") - F.col("t0"),
            "dx": F.when(F.col("rank") > 0, F.radians(F.col("lon") - F.col("p1_lon")) * per_m),
            "dy": F.when(F.col("rank") > 0, F.radians(F.col("lat") - F.col("p1_lat")) * EARTH_RADIUS_M),
        }
    )
    end = lambda f, c: f(F.struct("rank", c))[c]
    n, stt = F.count(F.lit(1)), F.sum(F.col("tc") * F.col("tc"))
    moments = {
        "n_fixes": n,
        "start_s": F.min("t").cast("bigint"),
        "span_s": F.max("t") - F.min("t"),
        "stt": stt,
        "stx": F.sum(F.col("tc") * F.col("x")),
        "sty": F.sum(F.col("tc") * F.col("y")),
        "sxx": F.sum(F.col("x") * F.col("x")),
        "syy": F.sum(F.col("y") * F.col("y")),
        "sx": F.sum("x"),
        "sy": F.sum("y"),
        "path_m": F.sum(F.hypot("dx", "dy")),
        "chord_m": F.hypot(end(F.max, "x") - end(F.min, "x"), end(F.max, "y") - end(F.min, "y")),
    }
    m = d.groupBy("entity", "island").agg(*[c.alias(k) for k, c in moments.items()]).filter(F.col("span_s") >= span_s)
    bx, by = F.col("stx") / F.col("stt"), F.col("sty") / F.col("stt")
    c = lambda k: F.col(k)
    ssr = c("sxx") - c("sx") * c("sx") / c("n_fixes") - bx * c("stx") + c("syy") - c("sy") * c("sy") / c("n_fixes") - by * c("sty")
    return m.select(
        "entity",
        "island",
        "start_s",
        "n_fixes",
        "span_s",
        F.hypot(bx, by).alias("v_mps"),
        F.sqrt(F.greatest(ssr, F.lit(0.0)) / (2 * F.greatest(c("n_fixes") - 2, F.lit(1)))).alias("resid_m"),
        "path_m",
        "chord_m",
    )


def rest_and_move(features: DataFrame, rest_mps: float = 0.15, move_mps: float = 0.6) -> DataFrame:
    """Counts of bursts at rest and on the move, median residuals, and median path over chord on the move."""
    rest, move = F.col("v_mps") < rest_mps, F.col("v_mps") > move_mps
    middle = summary_quantiles(
        features,
        {
            "median_span_s": (F.col("span_s"), 0.5),
            "resid_rest_m": (F.when(rest, F.col("resid_m")), 0.5),
            "resid_move_m": (F.when(move, F.col("resid_m")), 0.5),
            "v_move_mps": (F.when(move, F.col("v_mps")), 0.5),
            "tortuosity": (F.when(move, F.col("path_m") / F.greatest("chord_m", F.lit(1e-3))), 0.5),
        },
    )
    counts = features.agg(F.count(F.lit(1)).alias("n_bursts"), F.sum(rest.cast("int")).alias("n_rest"), F.sum(move.cast("int")).alias("n_move"))
    return counts.join(middle, how="left")  # one row each
