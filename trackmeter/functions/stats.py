"""Statistics as column expressions and small aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.session import Written


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a proportion; NULL if n is 0."""
    p = F.try_divide(k.cast("double"), n)
    z2 = z * z
    scale = 1 + F.try_divide(F.lit(z2), n)
    middle = p + F.try_divide(F.lit(z2), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), 4.0 * n * n))
    return F.try_divide(middle - half, scale), F.try_divide(middle + half, scale)


def value_bucket(v: Column) -> Column:
    """A bucket number that never falls as the value rises, about 2,000 over the usual range."""
    size = F.floor(F.log2(F.abs(v) + F.lit(1e-3)) * 32).cast("int") + 400
    return F.when(v < 0, -size).otherwise(size)


def average_ranks(counts: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``counts`` (``keys, value, c``: how often each distinct value comes) with ``r``, the average rank of its value.

    Ranks within buckets of values, and offsets from a table of bucket counts, so no task sorts all values.
    """
    base = counts.withColumn("_b", value_bucket(F.col(value)))
    totals = base.groupBy(*keys, "_b").agg(F.sum("c").alias("_n"))
    along = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_b")  # one row a bucket
    totals = totals.withColumn("_off", F.sum("_n").over(along) - F.col("_n")).drop("_n")
    w = Window.partitionBy(*keys, "_b").orderBy(value)
    ranked = base.withColumn("_end", F.sum("c").over(w)).join(totals, [*keys, "_b"])
    return ranked.withColumn("r", F.col("_off") + F.col("_end") - F.col("c") + (F.col("c") + 1) / 2).drop("_b", "_end", "_off")


def _with_rank(d: DataFrame, value: str, rank: str, most_broadcast: int, salts: int) -> DataFrame:
    """The rows with the average rank of a value, however many rows share one.

    Ranks are of distinct values. They are broadcast if their count, taken first, is small (a value
    that many rows share leaves few others); otherwise they are repeated over salts.
    """
    counts = Written(d.sparkSession).put(d.groupBy(value).agg(F.sum("c").alias("c")), "counts")
    ranks = average_ranks(counts, value).select(value, F.col("r").alias(rank))
    if counts.count() <= most_broadcast:
        return d.join(F.broadcast(ranks), value)
    ranks = ranks.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return d.withColumn("_s", F.pmod(F.xxhash64(*d.columns), F.lit(salts)).cast("int")).join(ranks, [value, "_s"]).drop("_s")


def spearman(df: DataFrame, a: str, b: str, most_broadcast: int = 200_000, salts: int = 32) -> DataFrame:
    """One row ``rho, n``: correlation of average ranks of the rows with both values; NULL rho if a side is constant.

    Equal pairs are counted first, and the correlation is weighted by these counts.
    """
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    d = _with_rank(_with_rank(d, a, "_ra", most_broadcast, salts), b, "_rb", most_broadcast, salts)
    c = F.col("c").cast("double")
    total = lambda e: F.sum(c * e)
    m = d.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    middle = (F.col("n") + 1) / 2  # of any ranks
    x, y = F.col("_ra") - middle, F.col("_rb") - middle
    sums = d.crossJoin(F.broadcast(m)).agg(total(x * y).alias("xy"), total(x * x).alias("xx"), total(y * y).alias("yy"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))  # one row
    return sums.select(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"), "n")


def mann_whitney(df: DataFrame, value: str, group: str, high: str, low: str) -> DataFrame:
    """One row ``n_high, n_low, u, z``: does ``high`` exceed ``low``? One-sided, with tie and continuity correction.

    Rows are counted by value and group first, so a value that most rows share is one row.
    """
    d = df.filter(F.col(group).isin(high, low) & F.col(value).isNotNull())
    one = lambda name: F.sum((F.col(group) == name).cast("bigint"))
    counts = d.groupBy(value).agg(one(high).alias("_h"), one(low).alias("_l"), F.count(F.lit(1)).alias("c"))
    ranks = average_ranks(counts, value)
    df = ranks.agg(
        F.sum("_h").alias("n_high"),
        F.sum("_l").alias("n_low"),
        F.sum(F.col("_h") * F.col("r")).alias("rs"),
        F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).cast("double").alias("ties"),
    )
    n1, n2 = F.col("n_high").cast("double"), F.col("n_low").cast("double")
    n = n1 + n2
    u = F.col("rs") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    return df.select("n_high", "n_low", u.alias("u"), F.try_divide(u - n1 * n2 / 2 - 0.5, F.sqrt(var)).alias("z"))


#: fixed values: a Chebyshev fit of the complementary error function, within 1.2e-7 of its value
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of the standard normal, within 1.2e-7 of its value; NULL for NULL."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    fit = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        fit = fit * t + c
    tail = t * F.exp(-x * x + fit) / 2
    return F.when(z >= 0, tail).when(z < 0, 1 - tail)
