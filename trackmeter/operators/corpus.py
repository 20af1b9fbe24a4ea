"""Dataset surveys: quality measures, capability, inventory, status, detector validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.functions.geo import METRES_PER_DEGREE
from trackmeter.functions.stats import mann_whitney, upper_tail
from trackmeter.operators.fixes import BLANKS
from trackmeter.operators.quantile import quantile_of_counts, summary_quantiles, value_counts
from trackmeter.operators.tracks import consecutive_pairs, triplets
from trackmeter.session import Written


#: parts a dataset from an entity in a composed identifier
_PART = "\u0001"


def decimals(text: Column) -> Column:
    """Digits behind the last point of a number's text; 0 without a point."""
    return F.when(F.contains(text, F.lit(".")), F.length(F.element_at(F.split(text, r"\."), -1))).otherwise(F.lit(0))


def plain_number(c: Column) -> Column:
    """A coordinate's shortest decimal text without exponent, however many places."""
    fixed = F.regexp_replace(c.cast("string").cast("decimal(38,20)").cast("string"), "0+$", "")
    return F.when(F.endswith(fixed, F.lit(".")), F.concat(fixed, F.lit("0"))).otherwise(fixed)


def repeated_positions(pairs: DataFrame, *keys: str) -> DataFrame:
    """``keys, steps, repeats``: consecutive fixes at exactly the same position."""
    d = pairs.filter("dist_m is not null")
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("steps"), F.sum((F.col("dist_m") == 0).cast("int")).alias("repeats"))


def sized(tracks: DataFrame, least: int) -> DataFrame:
    """The fixes of entities with at least ``least`` fixes (a semi-join with a table of one row an entity)."""
    big = tracks.groupBy("entity").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") >= least).select("entity")
    return tracks.join(big, "entity", "left_semi")


def spikes(tracks: DataFrame, factor: float = 10.0, quantile: float = 0.95) -> DataFrame:
    """``entity, triplets, spikes``: excursions over ``factor`` times the entity's own quantile of steps.

    Entities whose yardstick is 0 are not judged.
    """
    t = triplets(tracks)
    yard = quantile_of_counts(value_counts(t, ["entity"], "step_m"), ["entity"], quantile, "yardstick").filter("yardstick > 0")
    d = t.filter("excursion_m is not null").join(yard.select("entity", "yardstick"), "entity")
    hit = F.col("excursion_m") > factor * F.col("yardstick")
    return d.groupBy("entity").agg(F.count(F.lit(1)).alias("triplets"), F.sum(hit.cast("int")).alias("spikes"))


def spike_fixes(tracks: DataFrame, factor: float = 10.0, quantile: float = 0.95) -> DataFrame:
    """``entity, event_id, excursion_m``: the middle fix of each triplet over the limit."""
    t = triplets(tracks)
    yard = quantile_of_counts(value_counts(t, ["entity"], "step_m"), ["entity"], quantile, "yardstick").filter("yardstick > 0")
    d = t.join(yard.select("entity", "yardstick"), "entity").filter(F.col("excursion_m") > factor * F.col("yardstick"))
    return d.select("entity", F.col("p1_event_id").alias("event_id"), "excursion_m")


def cadence(tracks: DataFrame, keys: Sequence[str] = (), round_to: int | None = None) -> DataFrame:
    """``keys, n_gaps, gap_median_s, gap_p05_s, gap_p95_s, gap_mode_s, regular_pct`` of the positive gaps between fixes.

    Mode: the most frequent whole-second gap (rounded to ``round_to`` digits if given), the smallest of
    several. Regular: within a tenth of the mode, or a second. Gaps are counted by value first.
    """
    return cadence_of_pairs(consecutive_pairs(tracks), keys, round_to)


def cadence_of_pairs(pairs: DataFrame, keys: Sequence[str] = (), round_to: int | None = None) -> DataFrame:
    """As ``cadence``, from pairs that carry ``keys`` and ``dt_s``."""
    keys = list(keys)
    group = keys or ["_all"]
    pairs = pairs.filter("dt_s > 0")
    counts = value_counts(pairs if keys else pairs.withColumn("_all", F.lit(1)), group, "dt_s")
    counts = Written(pairs.sparkSession).put(counts, "gaps")  # read once per statistic
    shown = F.bround("v", round_to) if round_to is not None else F.col("v")
    by_value = counts.groupBy(*group, shown.alias("g")).agg(F.sum("c").alias("c"))
    mode = by_value.groupBy(*group).agg(F.max(F.struct("c", (-F.col("g")).alias("g"))).alias("m")).select(*group, (-F.col("m.g")).alias("gap_mode_s"))
    near = F.abs(F.col("v") - F.col("gap_mode_s")) <= F.greatest(0.1 * F.col("gap_mode_s"), F.lit(1.0))
    regular = counts.join(mode, group).groupBy(*group).agg(
        F.sum("c").alias("n_gaps"), F.max("gap_mode_s").alias("gap_mode_s"), (100 * F.sum(F.when(near, F.col("c")).otherwise(0)) / F.sum("c")).alias("regular_pct")
    )
    for q, name in ((0.5, "gap_median_s"), (0.05, "gap_p05_s"), (0.95, "gap_p95_s")):
        regular = regular.join(quantile_of_counts(counts, group, q, name).select(*group, name), group)
    return regular.select(*keys, "n_gaps", "gap_median_s", "gap_p05_s", "gap_p95_s", "gap_mode_s", "regular_pct")


def grain(tracks: DataFrame) -> DataFrame:
    """One row ``decimals_lat, least_step_m``: median decimals of the latitudes, least difference of two latitudes in order.

    The order is that of the whole file by entity and time, so the first fix of an entity meets the last
    of the one before. That needs no global sort: within entities the neighbours are at hand, and
    between them one row an entity suffices.
    """
    n = decimals(plain_number(F.col("lat")))
    digits = tracks.groupBy(n.alias("d")).agg(F.count(F.lit(1)).alias("c"))  # a handful of rows
    middle = digits.select(F.lit(1).alias("_all"), F.lit(0).alias("bucket"), F.col("d").cast("double").alias("v"), "c")
    middle = quantile_of_counts(middle, ["_all"], 0.5, "decimals_lat").select(F.floor("decimals_lat").cast("int").alias("decimals_lat"))
    inner = consecutive_pairs(tracks).select(F.abs(F.col("lat") - F.col("p1_lat")).alias("d"))
    order = F.struct("ts_us", "event_id", "lat")
    ends = tracks.groupBy("entity").agg(F.min(order).alias("a"), F.max(order).alias("b"))
    w = Window.partitionBy(F.lit(1)).orderBy("entity")  # one row an entity
    outer = ends.select(F.abs(F.col("a.lat") - F.lag("b.lat").over(w)).alias("d"))
    least = inner.unionByName(outer).filter("d > 0").agg((F.min("d") * METRES_PER_DEGREE).alias("least_step_m"))
    return middle.crossJoin(least)  # one row each


def grain_by_device(tracks: DataFrame) -> DataFrame:
    """``entity, decimals_lat, least_step_m``: as ``grain``, for each entity's own fixes; NULL step if its latitude never changes."""
    digits = tracks.groupBy("entity", decimals(plain_number(F.col("lat"))).cast("double").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    middle = quantile_of_counts(digits.select("entity", F.lit(0).alias("bucket"), F.col("d").alias("v"), "c"), ["entity"], 0.5, "decimals_lat")
    step = F.abs(F.col("lat") - F.col("p1_lat"))
    least = consecutive_pairs(tracks).filter(step > 0).groupBy("entity").agg((F.min(step) * METRES_PER_DEGREE).alias("least_step_m"))
    return middle.select("entity", F.floor("decimals_lat").cast("int").alias("decimals_lat")).join(least, "entity", "left")


def measure(tracks: DataFrame, factor: float = 10.0, least: int = 50) -> DataFrame:
    """The quality row of one dataset: size, span, cadence, repeats, spikes, grain. Empty tracks give NULL measures."""
    span = (F.max("ts_us") - F.min("ts_us")) / 86_400e6
    size = tracks.agg(F.count(F.lit(1)).alias("n_fixes"), F.countDistinct("entity").alias("n_individuals"), span.alias("days"))
    judged = sized(tracks, least)
    reps = repeated_positions(consecutive_pairs(judged)).select(F.try_divide(100 * F.col("repeats"), "steps").alias("pct_repeated"))
    sp = spikes(judged, factor).agg(
        F.coalesce(F.sum("triplets"), F.lit(0)).alias("n_triplets"), F.try_divide(100 * F.sum("spikes"), F.sum("triplets")).alias("pct_spikes")
    )
    pace = cadence(judged).select("gap_median_s", "gap_mode_s", "gap_p95_s", "regular_pct")
    return size.join(reps, how="left").join(sp, how="left").join(pace, how="left").join(grain(tracks), how="left")  # one row each


def measure_by(tracks: DataFrame, key: str, factor: float = 10.0, least: int = 50) -> DataFrame:
    """The quality row of every dataset at once: ``key`` and the columns of ``measure``.

    An entity of two datasets is two entities. Datasets without a judged entity have NULL measures.
    """
    t = tracks.withColumn("entity", F.concat_ws(_PART, F.col(key).cast("string"), "entity"))
    own = F.split_part("entity", F.lit(_PART), F.lit(1)).alias(key)
    span = (F.max("ts_us") - F.min("ts_us")) / 86_400e6
    size = t.groupBy(key).agg(F.count(F.lit(1)).alias("n_fixes"), F.countDistinct("entity").alias("n_individuals"), span.alias("days"))
    pairs = consecutive_pairs(sized(t, least)).select(own, "dt_s", "dist_m")
    reps = repeated_positions(pairs, key).select(key, F.try_divide(100 * F.col("repeats"), "steps").alias("pct_repeated"))
    sp = spikes(sized(t, least), factor).groupBy(own).agg(
        F.sum("triplets").alias("n_triplets"), F.try_divide(100 * F.sum("spikes"), F.sum("triplets")).alias("pct_spikes")
    )
    pace = cadence_of_pairs(pairs, [key]).select(key, "gap_median_s", "gap_mode_s", "gap_p95_s", "regular_pct")
    digits = t.groupBy(key, decimals(plain_number(F.col("lat"))).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")).withColumn("bucket", F.lit(0))
    middle = quantile_of_counts(digits, [key], 0.5, "decimals_lat").select(key, F.floor("decimals_lat").cast("int").alias("decimals_lat"))
    inner = consecutive_pairs(t).select(own, F.abs(F.col("lat") - F.col("p1_lat")).alias("d"))
    order = F.struct("ts_us", "event_id", "lat")
    ends = t.groupBy(key, "entity").agg(F.min(order).alias("a"), F.max(order).alias("b"))
    outer = ends.select(key, F.abs(F.col("a.lat") - F.lag("b.lat").over(Window.partitionBy(key).orderBy("entity"))).alias("d"))  # one row an entity
    least_step = inner.unionByName(outer).filter("d > 0").groupBy(key).agg((F.min("d") * METRES_PER_DEGREE).alias("least_step_m"))
    out = size
    for part in (reps, sp, pace, middle, least_step):
        out = out.join(part, key, "left")
    return out.fillna(0, ["n_triplets"])


def capabilities(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``field, filled_pct, state``: what the columns carry; state is absent, empty or filled. One pass."""
    have = set(df.columns)
    present = [c for c in wanted if c in have]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(present)])
    at = {c: F.try_divide(100.0 * F.col(f"_{i}"), "_n") for i, c in enumerate(present)}
    cell = lambda c: F.struct(
        F.lit(c).alias("field"),
        at.get(c, F.lit(None).cast("double")).alias("filled_pct"),
        (F.when(at[c] > 0, "filled").otherwise("empty") if c in at else F.lit("absent")).alias("state"),
    )
    return row.select(F.explode(F.array(*[cell(c) for c in wanted])).alias("c")).select("c.*")


def category_shares(df: DataFrame, column: str, top: int = 6) -> DataFrame:
    """``value, n, share``: the most frequent values in lower case; ties by value. Nulls do not count."""
    counts = df.select(F.lower(F.trim(F.col(f"`{column}`"), F.lit(BLANKS))).alias("value")).filter("value is not null")
    counts = counts.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    return counts.crossJoin(total).select("value", "n", (F.col("n") / F.col("t")).alias("share")).orderBy(F.desc("n"), "value").limit(top)


def best_file(measures: DataFrame, item: str = "uuid", file: str = "file", size: str = "n_fixes") -> DataFrame:
    """The file with most fixes of each item; of several the first by name. One row an item."""
    w = Window.partitionBy(item).orderBy(F.desc_nulls_last(size), file)
    return measures.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def file_sizes(files: DataFrame, bundle: str = "ORIGINAL", names: int = 6) -> DataFrame:
    """``uuid, bytes_published, fichiers``: bytes of an item's published files and its first names."""
    own = files.filter((F.col("bundle") == bundle) & F.col("uuid").isNotNull())
    listed = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"]), 1, names)
    return own.groupBy("uuid").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_published"), F.concat_ws(" | ", listed).alias("fichiers"))


def with_sizes(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """Items with ``bytes_published, fichiers`` of ``file_sizes``; 0 and an empty text for items without files."""
    d = items.join(sizes, "uuid", "left")
    return d.withColumns({"bytes_published": F.coalesce("bytes_published", F.lit(0)), "fichiers": F.coalesce("fichiers", F.lit(""))})


def inventory(deposits: DataFrame) -> DataFrame:
    """Deposits with ``year`` (from the date's first four characters, if a number), ``mb`` and a short title."""
    return deposits.select(
        "uuid",
        F.substring("titre", 1, 78).alias("title"),
        F.substring("date_published", 1, 4).try_cast("int").alias("year"),
        F.round(F.col("bytes_published") / 1e6, 1).alias("mb"),
        "bytes_published",
        F.substring("description", 1, 400).alias("description"),
        "taxon",
    )


def inventory_totals(inv: DataFrame) -> DataFrame:
    return inv.agg(
        F.count(F.lit(1)).alias("items"),
        F.sum((F.col("bytes_published") > 0).cast("int")).alias("items_with_files"),
        F.sum("bytes_published").alias("bytes"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def usable(inv: DataFrame, most_mb: float = 50.0) -> DataFrame:
    """Size gate: some bytes, and under the limit."""
    return inv.filter((F.col("bytes_published") > 0) & (F.col("mb") < most_mb))


def largest(inv: DataFrame, n: int, since: int | None = None) -> DataFrame:
    d = inv if since is None else inv.filter(F.col("year") >= since)
    return d.orderBy(F.desc_nulls_last("bytes_published"), "uuid").limit(n)


def files_by_suffix(deposits: DataFrame, ignored: Sequence[str] = ("readme", "reference")) -> DataFrame:
    """``suffix, files, deposits``: the data files named in the inventory; names with an ignored word are left out."""
    names = deposits.select("uuid", F.explode(F.split("fichiers", r"\s*\|\s*")).alias("name")).filter("name <> ''")
    low = F.lower("name")
    for word in ignored:
        names = names.filter(~F.contains(low, F.lit(word)))
    return names.groupBy(F.regexp_extract(low, r"\.([a-z0-9]+)$", 1).alias("suffix")).agg(
        F.count(F.lit(1)).alias("files"), F.countDistinct("uuid").alias("deposits")
    )


def file_status(readable: Column, has_position: Column, rows: Column, least: int = 200) -> Column:
    """ok, no position or unreadable (too few rows count as unreadable)."""
    return F.when(~F.coalesce(readable, F.lit(False)), "unreadable").when(~F.coalesce(has_position, F.lit(False)), "no position").when(
        F.coalesce(rows, F.lit(0)) < least, "unreadable"
    ).otherwise("ok")


def dataset_status(files: DataFrame) -> DataFrame:
    """``uuid, status, n_files``: ok if any file is, else no position if any file lacks one, else unreadable."""
    any_ = lambda s: F.max((F.col("status") == s).cast("int")) == 1
    status = F.when(any_("ok"), "ok").when(any_("no position"), "no position").otherwise("unreadable")
    return files.groupBy("uuid").agg(status.alias("status"), F.count(F.lit(1)).alias("n_files"))


def most_affected(quality: DataFrame, n: int = 15, by: str = "pct_spikes") -> DataFrame:
    return quality.orderBy(F.desc_nulls_last(by), *[c for c in ("entity", "uuid") if c in quality.columns]).limit(n)


def rate_spread(quality: DataFrame, column: str) -> DataFrame:
    """Quartiles and maximum of a rate."""
    q = summary_quantiles(quality, {"p25": (F.col(column), 0.25), "p50": (F.col(column), 0.5), "p75": (F.col(column), 0.75)})
    return q.join(quality.agg(F.max(column).alias("max")), how="left")  # one row each


def detector_report(quality: DataFrame, label_sets: Sequence[Sequence[str]] = (("gps",), ("gps", "gnss")), sensor: str = "sensor", value: str = "pct_spikes", high: str = "argos-doppler-shift") -> DataFrame:
    """``labels, n_high, n_low, median_high, median_low, u, z, p``: the validation under each set of labels.

    Both arms are stated, so that a set with an empty arm shows as such (its p is NULL).
    """
    out = None
    for low in label_sets:
        arm = lambda of: F.when(of, F.col(value))
        q = summary_quantiles(quality, {"median_high": (arm(F.col(sensor) == high), 0.5), "median_low": (arm(F.col(sensor).isin(*low)), 0.5)})
        row = detector_validation(quality, sensor, value, high, low).join(q, how="left").select(  # one row each
            F.lit("+".join(low)).alias("labels"), "n_high", "n_low", "median_high", "median_low", "u", "z", upper_tail(F.col("z")).alias("p")
        )
        out = row if out is None else out.unionByName(row)
    return out


def detector_validation(quality: DataFrame, sensor: str = "sensor", value: str = "pct_spikes", high: str = "argos-doppler-shift", low: Sequence[str] = ("gps",)) -> DataFrame:
    """Mann-Whitney of the spike rates of one sensor against another's (labels in ``low`` count as one)."""
    label = F.when(F.col(sensor).isin(*low), "low").when(F.col(sensor) == high, "high")
    return mann_whitney(quality.withColumn("_label", label), value, "_label", "high", "low")
