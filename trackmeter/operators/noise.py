"""Receiver noise at rest, declared accuracy, battery wear, agreement between devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmeter.functions.geo import local_xy
from trackmeter.functions.stats import spearman
from trackmeter.operators.fixes import in_blocks, with_neighbours
from trackmeter.operators.quantile import grouped_quantile, summary_quantiles
from trackmeter.operators.tracks import first_per_second


def still_windows(tracks: DataFrame, lat0: float, lon0: float, still_mps: float = 0.10, window_s: int = 60, least: int = 20) -> DataFrame:
    """``entity, window_s, n, sigma_m, acc_m, vmax``: dispersion of position where the device says it does not move.

    Metres about a fixed origin. Windows with fewer than ``least`` still fixes are left out. The declared
    accuracy's median per window is of at most a window's fixes.
    """
    slot = (F.floor(F.col("ts_us") / (window_s * 1_000_000)) * window_s).alias("window_s")
    x, y = local_xy("lat", "lon", lat0, lon0)
    g = tracks.filter(F.col("speed_mps") < still_mps).select("entity", slot, x.alias("x"), y.alias("y"), "h_accuracy_m", "speed_mps")
    w = g.groupBy("entity", "window_s").agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.expr("percentile(h_accuracy_m, 0.5)").alias("acc_m"), F.max("speed_mps").alias("vmax")
    )
    return w.filter((F.col("n") >= least) & F.col("vx").isNotNull() & F.col("vy").isNotNull()).select(
        "entity", "window_s", "n", F.sqrt((F.col("vx") + F.col("vy")) / 2).alias("sigma_m"), "acc_m", "vmax"
    )


def noise_by_device(windows: DataFrame) -> DataFrame:
    """Windows, median and p90 of the noise, median declared accuracy and their ratio, by device."""
    q = summary_quantiles(
        windows, {"sigma_median_m": (F.col("sigma_m"), 0.5), "sigma_p90_m": (F.col("sigma_m"), 0.9), "acc_median_m": (F.col("acc_m"), 0.5)}, ["entity"]
    )
    n = windows.groupBy("entity").agg(F.count(F.lit(1)).alias("n_windows"))
    return n.join(q, "entity").withColumn("ratio", F.try_divide("sigma_median_m", "acc_median_m"))


def accuracy_class(acc: Column) -> Column:
    """Right-closed classes of declared accuracy in metres; none at or below 0."""
    c = F.when(acc <= 0, None)
    for top, name in ((3, "<3"), (5, "3-5"), (8, "5-8"), (12, "8-12"), (20, "12-20"), (40, "20-40")):
        c = c.when(acc <= top, name)
    return c.when(acc > 40, ">40")


def declared_against_measured(windows: DataFrame) -> DataFrame:
    """Noise by class of declared accuracy: ``class, n, acc_m, sigma_m, sigma_p90_m, ratio``."""
    d = windows.filter("acc_m is not null and sigma_m is not null").withColumn("class", accuracy_class(F.col("acc_m"))).filter("class is not null")
    q = summary_quantiles(d, {"acc_m": (F.col("acc_m"), 0.5), "s": (F.col("sigma_m"), 0.5), "sigma_p90_m": (F.col("sigma_m"), 0.9)}, ["class"])
    n = d.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    return n.join(q.withColumnRenamed("s", "sigma_m"), "class").withColumn("ratio", F.try_divide("sigma_m", "acc_m"))


def declared_rank_correlation(windows: DataFrame) -> DataFrame:
    return spearman(windows, "acc_m", "sigma_m")


def constant_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, n_values, constant``: a field with one value says nothing. Nulls count as a value."""
    row = df.agg(*[(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns])
    cell = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).alias("n_values"), (F.col(c) == 1).alias("constant"))
    return row.select(F.explode(F.array(*[cell(c) for c in columns])).alias("c")).select("c.*")


def battery_days(tracks: DataFrame) -> DataFrame:
    """``entity, day, sag_mv, rest_mv, n``: medians per device and day; sag = resting less loaded voltage.

    Voltages are whole millivolts of a cell, so a group has few distinct values however many rows.
    """
    d = tracks.filter("x_battery_mv is not null").withColumn("day", F.floor(F.col("ts_us") / 86_400e6).cast("int"))
    half = lambda e: F.expr(f"percentile({e}, 0.5)")
    return d.groupBy("entity", "day").agg(
        half("x_battery_mv - x_fix_battery_mv").alias("sag_mv"), half("x_battery_mv").alias("rest_mv"), F.count(F.lit(1)).alias("n")
    )


def battery_slopes(days: DataFrame, least: int = 7) -> DataFrame:
    """Slopes of daily sag and resting voltage in mV a day, for devices with at least ``least`` days."""
    return days.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_days"), F.regr_slope("sag_mv", "day").alias("sag_slope"), F.regr_slope("rest_mv", "day").alias("rest_slope")
    ).filter(F.col("n_days") >= least)


def device_pairs(tracks: DataFrame, lat0: float, lon0: float, near_m: float = 100.0, least: int = 5000, most: int | None = None, contiguous: bool = False) -> DataFrame:
    """``a, b, n_seconds, dist_median_m, sigma_rel_m, sigma_each_m`` of devices side by side at the same second.

    The second difference of their relative position leaves the noise of two receivers: its variance is
    six times theirs. ``contiguous`` keeps differences over consecutive seconds only. One equi-join on
    the second and on a cell of ``near_m``, whose neighbours the one side is sent to as well, so devices
    far apart never meet. For reports, the first ``most`` pairs by name.
    """
    x, y = local_xy("lat", "lon", lat0, lon0)
    s = first_per_second(tracks).select("entity", "tsec", x.alias("x"), y.alias("y"))
    cell = lambda c: F.floor(F.col(c) / near_m)
    side = lambda p: s.select("tsec", cell("x").alias("cx"), cell("y").alias("cy"), *[F.col(c).alias(f"{c}_{p}") for c in ("entity", "x", "y")])
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    m = side("a").withColumn("cx", around("cx")).withColumn("cy", around("cy")).join(side("b"), ["tsec", "cx", "cy"]).filter("entity_a < entity_b")
    m = m.select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b"), "tsec", (F.col("x_a") - F.col("x_b")).alias("rx"), (F.col("y_a") - F.col("y_b")).alias("ry"))
    d = m.withColumn("d", F.hypot("rx", "ry")).filter(F.col("d") < near_m)
    # a pair of devices is an entity of its own, in blocks of time like any other
    d = d.withColumns({"entity": F.concat_ws("\u0001", "a", "b"), "event_id": F.col("tsec"), "ts_us": F.col("tsec") * 1_000_000})
    d = with_neighbours(in_blocks(d, ["rx", "ry", "d"]), ["rx", "ry"], before=2)
    second = lambda c: F.col(c) - 2 * F.col(f"p1_{c}") + F.col(f"p2_{c}")
    d = d.withColumns(
        {"a": F.split_part("entity", F.lit("\u0001"), F.lit(1)), "b": F.split_part("entity", F.lit("\u0001"), F.lit(2)),
         "dx": second("rx"), "dy": second("ry"), "span": F.col("event_id") - F.col("p2_event_id")}
    )
    use = (F.col("span") == 2) if contiguous else F.lit(True)
    stats = d.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n_seconds"), F.var_pop(F.when(use, F.col("dx"))).alias("vx"), F.var_pop(F.when(use, F.col("dy"))).alias("vy")
    ).filter(F.col("n_seconds") >= least)
    middle = grouped_quantile(d, ["a", "b"], "d", 0.5, "dist_median_m").select("a", "b", "dist_median_m")
    sigma = F.sqrt((F.col("vx") + F.col("vy")) / 2 / 6)
    out = stats.join(middle, ["a", "b"]).select("a", "b", "n_seconds", "dist_median_m", sigma.alias("sigma_rel_m"), (sigma / 2**0.5).alias("sigma_each_m"))
    return out if most is None else out.orderBy("a", "b").limit(most)


def origin(tracks: DataFrame) -> tuple[float, float]:
    """Median latitude and longitude: the origin of local metres (two numbers, exact, by distributed quantiles)."""
    r = summary_quantiles(tracks, {"lat": (F.col("lat"), 0.5), "lon": (F.col("lon"), 0.5)}).first()
    return (r.lat, r.lon) if r is not None and r.lat is not None else (0.0, 0.0)


