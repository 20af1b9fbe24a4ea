"""Fleet health and burst ranks: impossible pairs inside bursts, by device, rank, batch and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmeter.functions.geo import haversine_m
from trackmeter.operators.fixes import entity_key, in_blocks, with_neighbours
from trackmeter.operators.quantile import grouped_quantile, summary_quantiles
from trackmeter.operators.tracks import gap_bursts, seconds


def batches(reference: DataFrame, first_serials: int = 100) -> DataFrame:
    """``entity, batch`` from animal and tag ids (two letters and a serial); one row an animal.

    Animals without a readable tag are of batch ``?``; of several rows for an animal the smallest batch counts.
    """
    serial = F.expr("try_cast(substring(`tag-id`, 3) as int)")
    batch = F.when(serial < first_serials, "batch 2008").when(serial >= first_serials, "batch 2009")
    df = reference.select(entity_key(F.col("`animal-id`")).alias("entity"), batch.alias("batch"))
    return df.filter("entity is not null").groupBy("entity").agg(F.coalesce(F.min("batch"), F.lit("?")).alias("batch"))


def with_batch(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Left join on the animal; unknown animals are of batch ``?``. Small tables are broadcast by their measured size."""
    return df.join(batches(reference), "entity", "left").withColumn("batch", F.coalesce("batch", F.lit("?")))


def intra_burst_pairs(tracks: DataFrame, low_s: float = 5, high_s: float = 60, ceiling_mps: float = 8.0, gap_s: float = 60) -> DataFrame:
    """Pairs ``low_s <= dt <= high_s`` of one device, with ``flagged`` where the implied speed exceeds the ceiling.

    A pair is keyed by its second fix; ``start_id``/``start_us`` name its first. ``start_rank`` counts the
    first fix within its burst from 0, ``from_end`` from the burst's end.
    """
    df = gap_bursts(tracks, gap_s).filter(F.col("dt_s").between(low_s, high_s))
    joined = F.col("rank") > 0  # else the pair spans two bursts: its first fix ends one of unknown rank here
    return df.select(
        "entity",
        F.col("p1_event_id").alias("start_id"),
        F.col("event_id").alias("end_id"),
        F.col("p1_ts_us").alias("start_us"),
        F.col("ts_us").alias("end_us"),
        "dt_s",
        "dist_m",
        "v_mps",
        "island",
        F.when(joined, F.col("rank") - 1).cast("int").alias("start_rank"),
        F.when(joined, F.col("size") - F.col("rank")).cast("int").alias("from_end"),
        F.when(joined, F.col("size")).cast("int").alias("burst_size"),
        (F.col("v_mps") > ceiling_mps).alias("flagged"),
    )


def rate(df: DataFrame, *keys: str) -> DataFrame:
    """``keys, pairs, flagged, share_pct``."""
    n = F.count(F.lit(1))
    k = F.sum(F.col("flagged").cast("int"))
    return df.groupBy(*keys).agg(n.alias("pairs"), k.alias("flagged"), (100 * k / n).alias("share_pct"))


def fleet_health(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """Flag rate by device, with its batch."""
    return with_batch(rate(pairs, "entity"), reference)


def fleet_summary(pairs: DataFrame) -> DataFrame:
    """``n_pairs, n_flagged, pct, median_jump_m, p99_jump_m, max_jump_m``; jumps are NULL if nothing is flagged."""
    total = pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.coalesce(F.sum(F.col("flagged").cast("int")), F.lit(0)).alias("n_flagged"),
        F.max(F.when(F.col("flagged"), F.col("dist_m"))).alias("max_jump_m"),
    ).withColumn("k", F.lit(1))
    jumps = pairs.filter("flagged").select(F.lit(1).alias("k"), "dist_m")
    q = lambda p, name: grouped_quantile(jumps, ["k"], "dist_m", p, name).select("k", name)
    out = total.join(q(0.5, "median_jump_m"), "k", "left").join(q(0.99, "p99_jump_m"), "k", "left")
    return out.select("n_pairs", "n_flagged", F.try_divide(100 * F.col("n_flagged"), "n_pairs").alias("pct"), "median_jump_m", "p99_jump_m", "max_jump_m")


def by_batch(health: DataFrame) -> DataFrame:
    """Least, median and greatest device rate of each batch."""
    return health.groupBy("batch").agg(
        F.count(F.lit(1)).alias("devices"), F.min("share_pct").alias("min"), F.expr("percentile(share_pct, 0.5)").alias("median"), F.max("share_pct").alias("max")
    )


def pivot_batch_size(pairs: DataFrame, reference: DataFrame, sizes: tuple[int, ...] = (2, 3, 4, 5, 6)) -> DataFrame:
    """First pairs by batch (rows) and burst size (columns): rate in percent and count of flags."""
    first = with_batch(pairs.filter("start_rank = 0"), reference)
    bad = F.col("flagged").cast("int")
    return first.groupBy("batch").pivot("burst_size", list(sizes)).agg((100 * F.avg(bad)).alias("pct"), F.sum(bad).alias("n"))


def by_year(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """Rate of first pairs by year of the first fix and batch."""
    year = F.year(F.timestamp_micros("start_us"))
    return rate(with_batch(pairs.filter("start_rank = 0").withColumn("year", year), reference), "year", "batch")


def first_fix_delays(pairs: DataFrame, reference: DataFrame, period_s: int = 1200, low_s: int = -120, high_s: int = 300) -> DataFrame:
    """Delay of a burst's first fix against the previous burst's plus the wake period, by batch and size.

    Delays are whole seconds within a fixed span, so their quartiles need few distinct values a group.
    """
    first = pairs.filter("start_rank = 0").select("entity", F.col("start_us").alias("ts_us"), F.col("start_id").alias("event_id"), "burst_size")
    first = with_neighbours(in_blocks(first, ["burst_size"]), ["burst_size"], before=1)
    delay = seconds("ts_us") - seconds("p1_ts_us") - period_s
    d = with_batch(first.withColumn("delay", delay).filter(F.col("delay").between(low_s, high_s)), reference)
    q = F.expr("percentile(delay, array(0.25, 0.5, 0.75))")
    return (
        d.groupBy("batch", "burst_size")
        .agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
        .select("batch", "burst_size", "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))
    )


def flagged_fixes(pairs: DataFrame, which: str = "start") -> DataFrame:
    """The fixes to discard: of each flagged first pair its first fix (``start``), or its second (``end``)."""
    side = {"start": ("start_id", "start_us"), "end": ("end_id", "end_us")}[which]
    return pairs.filter("start_rank = 0 and flagged").select(
        "entity", F.col(side[0]).alias("event_id"), F.col(side[1]).alias("ts_us"), F.lit(1 if which == "start" else 2).alias("rank_in_burst")
    )


def four_fix_bursts(tracks: DataFrame, pairs: DataFrame, gap_s: float = 60) -> DataFrame:
    """Complete four-fix bursts whose first pair is flagged: distance of fix 1 and fix 2 to the centroid of those after."""
    bad = pairs.filter("start_rank = 0 and flagged and burst_size = 4").select("entity", "island").distinct()
    q = gap_bursts(tracks, gap_s).filter("size = 4").join(bad, ["entity", "island"], "left_semi")
    at = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{c}{k}")
    p = q.groupBy("entity", "island").agg(*[at(c, k) for c in ("lat", "lon") for k in range(4)])
    mean = lambda c, ks: sum((F.col(f"{c}{k}") for k in ks), F.lit(0.0)) / len(ks)
    return p.select(
        "entity",
        "island",
        haversine_m("lat0", "lon0", mean("lat", (1, 2, 3)), mean("lon", (1, 2, 3))).alias("fix1_m"),
        haversine_m("lat1", "lon1", mean("lat", (2, 3)), mean("lon", (2, 3))).alias("fix2_m"),
    )


def subsampling(tracks: DataFrame, pairs: DataFrame, gap_s: float = 60, period_s: float = 1200, speeds: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """What a first-of-burst subsample keeps, whether speed filters see it, and what either remedy costs."""
    bursts = gap_bursts(tracks, gap_s).agg(F.count(F.lit(1)).alias("n_fixes"), F.sum((F.col("rank") == 0).cast("int")).alias("n_bursts"))
    bad = F.col("flagged").cast("int")
    first = F.col("start_rank") == 0
    jump = F.when(F.col("flagged") & first, F.col("dist_m"))
    seen = [F.sum((jump / period_s > v).cast("int")).alias(f"above_{v}_mps") for v in speeds]
    flags = pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(bad).alias("n_flagged"), F.sum(F.when(first, bad)).alias("n_first"), F.max(jump).alias("max_jump_m"), *seen)
    df = bursts.crossJoin(flags)  # one row each
    n, b, f = F.col("n_fixes"), F.col("n_bursts"), F.col("n_first")
    return df.withColumns(
        {
            "first_pair_share_pct": F.try_divide(100 * f, "n_flagged"),
            "contaminated_share_pct": F.try_divide(100 * f, b),
            "residue_after_targeted_remedy": F.col("n_flagged") - f,
            "blanket_remedy_pct": F.try_divide(100 * b, n),
            "targeted_remedy_pct": F.try_divide(100 * f, n),
            "sound_positions_lost_if_blanket": b - f,
        }
    )


def gap_class(dt: Column) -> Column:
    """Right-closed classes of a gap in seconds; none at or below 0."""
    edges = [(15, "<=15s"), (60, "15-60s"), (300, "1-5min"), (1800, "5-30min"), (3600, "30-60min")]
    c = F.when(dt <= 0, None)
    for top, name in edges:
        c = c.when(dt <= top, name)
    return c.when(dt > 3600, ">1h")


def speed_gate(pairs: DataFrame, ceiling_mps: float = 7.0) -> DataFrame:
    """Consecutive pairs over the ceiling by class of gap: ``gap_class, pairs, flagged``."""
    d = pairs.filter("dt_s > 0").withColumns({"gap_class": gap_class(F.col("dt_s")), "flagged": F.col("v_mps") > ceiling_mps})
    return d.groupBy("gap_class").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("flagged").cast("int")).alias("flagged"))


def speed_gate_summary(pairs: DataFrame, ceiling_mps: float = 7.0, short_s: int = 15) -> DataFrame:
    """``n_pairs, n_flagged, pct, median_jump_m``: the share over the ceiling, and the median jump of those within ``short_s``."""
    d = pairs.filter("dt_s > 0").withColumn("flagged", F.col("v_mps") > ceiling_mps)
    n, k = F.count(F.lit(1)), F.coalesce(F.sum(F.col("flagged").cast("int")), F.lit(0))
    q = summary_quantiles(d, {"median_jump_m": (F.when(F.col("flagged") & (F.col("dt_s") <= short_s), F.col("dist_m")), 0.5)})
    return d.agg(n.alias("n_pairs"), k.alias("n_flagged"), F.try_divide(100.0 * k, n).alias("pct")).join(q, how="left")  # one row each


def contaminated_jumps(pairs: DataFrame, period_s: float = 1200) -> DataFrame:
    """What a first-of-burst subsample carries of its flagged first pairs: jumps, and the speeds they imply over the wake period."""
    jump = F.when(F.col("flagged") & (F.col("start_rank") == 0), F.col("dist_m"))
    q = summary_quantiles(pairs, {"median_jump_m": (jump, 0.5), "p90_jump_m": (jump, 0.9)})
    out = pairs.agg(F.count(jump).alias("n"), F.max(jump).alias("max_jump_m")).join(q, how="left")  # one row each
    return out.withColumns({"median_mps": F.col("median_jump_m") / period_s, "p90_mps": F.col("p90_jump_m") / period_s})


def four_fix_summary(bursts: DataFrame) -> DataFrame:
    """``n_bursts, fix1_m, fix2_m`` (medians) and ``fix1_is_outlier_pct``: how often fix 1 lies farther off than fix 2."""
    q = summary_quantiles(bursts, {"fix1_median_m": (F.col("fix1_m"), 0.5), "fix2_median_m": (F.col("fix2_m"), 0.5)})
    own = bursts.agg(F.count(F.lit(1)).alias("n_bursts"), (100.0 * F.avg((F.col("fix1_m") > F.col("fix2_m")).cast("int"))).alias("fix1_is_outlier_pct"))
    return own.join(q, how="left")  # one row each
