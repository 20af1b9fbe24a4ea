"""Exact grouped quantiles that no hot group can overload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.functions.stats import value_bucket
from trackmeter.session import Written


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, bucket, v, c``: equal values counted map-side, with a bucket that rises with the value."""
    v = F.col(value).cast("double")
    return (
        df.filter(v.isNotNull())
        .select(*keys, value_bucket(v).alias("bucket"), v.alias("v"))
        .groupBy(*keys, "bucket", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )


def _ranked(totals: DataFrame, keys: list[str], q: float) -> DataFrame:
    """Of ``keys, bucket, _n``: the buckets that hold the ranks below and above the quantile, with their offsets."""
    by_key = Window.partitionBy(*keys)
    ranked = totals.select(
        *keys,
        "bucket",
        (F.sum("_n").over(by_key.orderBy("bucket")) - F.col("_n")).alias("_off"),
        "_n",
        F.sum("_n").over(by_key).alias("n"),
    ).withColumn("_h", F.lit(float(q)) * (F.col("n") - 1))
    ranked = ranked.withColumns({"_lo": F.floor("_h"), "_hi": F.ceil("_h")})
    has = lambda r: (F.col("_off") <= F.col(r)) & (F.col(r) < F.col("_off") + F.col("_n"))
    return ranked.filter(has("_lo") | has("_hi")).drop("_n")


def _picked(cells: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The quantile from the counted values of the chosen buckets."""
    in_bucket = Window.partitionBy(*keys, "bucket").orderBy("v")
    cells = cells.withColumn("_end", F.col("_off") + F.sum("c").over(in_bucket))
    at = lambda r: F.max(F.when((F.col(r) >= F.col("_end") - F.col("c")) & (F.col(r) < F.col("_end")), F.col("v")))
    picked = cells.groupBy(*keys).agg(
        at("_lo").alias("_a"), at("_hi").alias("_b"), F.max(F.col("_h") - F.col("_lo")).alias("_f"), F.max("n").alias("n")
    )
    return picked.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(out), "n")


def quantile_in_rows(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "q", most_broadcast: int = 100_000) -> DataFrame:
    """``keys, out, n``, as ``grouped_quantile``, for a table that is cheap to read twice (a written one).

    The first reading counts buckets map-side; the second takes only the values of the one or two
    buckets a key needs, so hardly a value is shuffled. The table of those buckets is broadcast if its
    count, taken first, is at most ``most_broadcast`` rows; otherwise it is joined by shuffle.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.filter(v.isNotNull()).select(*keys, value_bucket(v).alias("bucket"), v.alias("v"))
    totals = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("_n"))
    chosen = Written(df.sparkSession).put(_ranked(totals, keys, q), "chosen")
    small = F.broadcast(chosen) if chosen.count() <= most_broadcast else chosen
    cells = rows.join(small, [*keys, "bucket"]).groupBy(*keys, "bucket", "v", "_off", "_lo", "_hi", "_h", "n").agg(F.count(F.lit(1)).alias("c"))
    return _picked(cells, keys, out)


def quantile_of_counts(counts: DataFrame, keys: Sequence[str], q: float, out: str = "q") -> DataFrame:
    """The q-quantile of each key, linearly interpolated, exact.

    Buckets are ranked by their counts alone (at most about 2,000 a key); only the one or two buckets
    that hold the wanted ranks are sorted. A key holding a third of all rows so sorts a small part of
    its values, whereas the built-in ``percentile`` gathers them all in one task.
    """
    keys = list(keys)
    totals = counts.groupBy(*keys, "bucket").agg(F.sum("c").alias("_n"))
    return _picked(counts.join(_ranked(totals, keys, q), [*keys, "bucket"]), keys, out)


def grouped_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "q") -> DataFrame:
    """``keys, out, n`` for the non-null values of each key; keys without values give no row."""
    return quantile_of_counts(value_counts(df, keys, value), keys, q, out)


def summary_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], keys: Sequence[str] = ()) -> DataFrame:
    """``keys`` and one column per name: the quantile of each expression's non-null values; NULL where there are none.

    Without keys it is one row over all of ``df``. All expressions share one pass over the rows.
    """
    keys = list(keys)
    base = df if keys else df.withColumn("_all", F.lit(1))
    group = keys or ["_all"]
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("m"), e.cast("double").alias("v")) for n, (e, _) in wanted.items()]))
    counts = value_counts(base.select(*group, cells.alias("c")).select(*group, "c.m", "c.v"), [*group, "m"], "v")
    counts = Written(df.sparkSession).put(counts, "counts")  # read once per quantile
    out = counts.select(*group).distinct()
    for q in dict.fromkeys(q for _, q in wanted.values()):
        names = [n for n, (_, p) in wanted.items() if p == q]
        part = quantile_of_counts(counts.filter(F.col("m").isin(*names)), [*group, "m"], q, "q")
        out = out.join(part.groupBy(*group).agg(*[F.max(F.when(F.col("m") == n, F.col("q"))).alias(n) for n in names]), group, "left")
    return out.select(*keys, *wanted)
