"""Mixing sources to target weights (problem 9), by apportioning equal-token blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.llm.tokens import VOCABULARY, n_tokens
from trackmeter.session import Written

#: children of a node in the tree of shards
FAN = 1_024


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Integer quotas by highest quotients weight / (2 s + 1); ties go to the earlier; never above ``most``.

    A common divisor found by bisection gives all quotas but a few at once; the rest are given one by
    one to the highest quotients, so the number of seats may be very large.
    """
    w = np.asarray(weights, dtype=float)
    room = np.where(w > 0, np.full(len(w), seats) if most is None else np.asarray(most), 0).astype("int64")
    seats = int(min(seats, room.sum()))
    if seats <= 0:
        return [0] * len(w)
    given = lambda d: np.minimum(room, np.floor(np.minimum(w / d, 1e18) + 0.5)).astype("int64")
    low, high = 0.0, 2 * float(w.max()) + 1e-300
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if mid == 0 or given(mid).sum() > seats else (low, mid)
    quotas = given(high)
    rest = seats - int(quotas.sum())
    if rest:
        heap = [(-w[i] / (2 * quotas[i] + 1), i) for i in np.flatnonzero(quotas < room)]
        heapq.heapify(heap)
        for _ in range(rest):
            _, i = heapq.heappop(heap)
            quotas[i] += 1
            if quotas[i] < room[i]:
                heapq.heappush(heap, (-w[i] / (2 * quotas[i] + 1), i))
    return quotas.tolist()


def _dividing(own: list[str]):
    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(own)
        pdf["quota"] = sainte_lague(pdf["weight"].tolist(), int(pdf["quota"].iloc[0]), pdf["most"].tolist())
        return pdf[["source", *own, "quota"]]

    return divide


def shard_quotas(strata: DataFrame, quotas: DataFrame, shards: int, block_tokens: int, fan: int = FAN) -> DataFrame:
    """``source, cap, shard, n, blocks``: each source's blocks apportioned to its shards.

    strata: ``source, cap, shard, n`` (tokens); quotas: ``source, quota`` (blocks). Shards are the
    leaves of a tree in which a node has up to ``fan`` children; each node's quota is apportioned to
    its children by Sainte-Lague, so no task sees more than ``fan`` times the caps in use, whatever the
    number of shards.
    """
    room = F.col("n") * F.col("cap")
    leaves = strata.withColumns({"weight": room.cast("double"), "most": F.ceil(room / block_tokens).cast("bigint")})
    depth = 1
    while fan**depth < shards:
        depth += 1
    node = lambda level: F.floor(F.col("shard") / F.lit(fan**level)).cast("bigint")
    given = quotas.select("source", F.lit(0).cast("bigint").alias("parent"), "quota")
    for level in range(depth - 1, -1, -1):
        own = ["shard", "cap", "n"] if level == 0 else ["shard"]
        kids = leaves
        if level:
            kids = leaves.groupBy("source", node(level).alias("shard")).agg(F.sum("weight").alias("weight"), F.sum("most").alias("most"))
        parent = node(1) if level == 0 else F.floor(F.col("shard") / F.lit(fan)).cast("bigint")
        kids = kids.select("source", parent.alias("parent"), *[F.col(c).cast("bigint").alias(c) for c in own], "weight", "most")

        schema = "source string, " + ", ".join(f"{c} bigint" for c in own) + ", quota bigint"
        given = kids.join(given, ["source", "parent"]).groupBy("source", "parent").applyInPandas(_dividing(own), schema)
        if level:
            given = given.withColumnRenamed("shard", "parent")
    return given.withColumnRenamed("quota", "blocks")


def distinct_texts(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, cap, n``: one row per distinct text of a wanted source.

    A text under several ids is one text: it stands under its smallest id, and its cap is the smallest
    ``max_repeats`` of the sources it occurs in.
    """
    rows = docs.select(
        "doc_id", "source", F.md5("text").alias("digest"), n_tokens(docs.sparkSession, F.col("text"), vocabulary).alias("n")
    ).filter("doc_id is not null and n > 0")
    texts = (
        rows.join(targets.select("source", "max_repeats"), "source")
        .groupBy("digest")
        .agg(F.min(F.struct("doc_id", "source")).alias("d"), F.min("max_repeats").alias("cap"), F.max("n").alias("n"))
    )
    return texts.select("d.doc_id", "d.source", "cap", "n")


def mix(
    docs: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    block_tokens: int = 512,
    seed: int = 7,
    shard_texts: int = 50_000,
    vocabulary: str = VOCABULARY,
    fan: int = FAN,
) -> DataFrame:
    """``doc_id, source, n_tokens, uses``: the chosen texts and how often each is used.

    The total is ``total_tokens``, or the most the sources can give at their target shares and caps. It
    is cut into blocks of ``block_tokens``, apportioned to the sources by Sainte-Lague, and each source's
    quota likewise to its shards. A shard's texts stand in seeded order; its quota covers them in that
    order, over again up to their cap, and ends within half a text of the quota.

    Sources without a target, or whose target or cap is not positive, are not used; of repeated targets
    the first by share counts; sources with a target but no text get nothing and the others keep their
    proportions. Null and empty texts have no tokens and are not used. Empty input: no rows.
    """
    spark = docs.sparkSession
    stage = Written(spark)
    goals = targets.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(
        F.min(F.struct("target_share", "max_repeats")).alias("g")
    ).select("source", "g.*")
    texts = stage.put(distinct_texts(docs, goals, vocabulary), "texts")
    shards = max(1, math.ceil(texts.count() / shard_texts))
    order = F.xxhash64(F.lit(seed), "doc_id")
    # high bits choose the shard, so the order within a shard by the whole hash remains random
    texts = texts.withColumns({"shard": F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(shards)).cast("bigint"), "_o": order})
    strata = stage.put(texts.groupBy("source", "cap", "shard").agg(F.sum("n").alias("n")), "strata")
    room = strata.groupBy("source").agg(F.sum(F.col("n") * F.col("cap")).alias("room")).join(goals, "source")
    rows = room.select("source", "room", "target_share").orderBy("source").collect()  # one a source with a target
    names, share = [r.source for r in rows], [r.target_share for r in rows]
    whole = sum(share) or 1.0
    most = min((r.room / (r.target_share / whole) for r in rows), default=0.0)
    total = most if total_tokens is None else min(float(total_tokens), most)
    blocks = sainte_lague(share, int(total // block_tokens), [r.room // block_tokens for r in rows])
    quotas = spark.createDataFrame(list(zip(names, blocks, strict=True)), "source string, quota bigint")
    want = F.least(F.col("blocks") * block_tokens, F.col("n") * F.col("cap"))
    chosen = shard_quotas(strata, quotas, shards, block_tokens, fan).select(
        "source", F.col("cap").cast("int").alias("cap"), "shard", F.floor(want / F.col("n")).alias("rounds"), (want % F.col("n")).alias("rest")
    )
    w = Window.partitionBy("source", "cap", "shard").orderBy("_o", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        texts.withColumn("_end", F.sum("n").over(w))
        .join(chosen, ["source", "cap", "shard"])
        .withColumn("uses", F.col("rounds") + (F.col("_end") - F.col("n") / 2 < F.col("rest")).cast("int"))
        .filter("uses > 0")
        .select("doc_id", "source", F.col("n").alias("n_tokens"), F.col("uses").cast("int").alias("uses"))
    )


def mix_check(mixed: DataFrame, docs: DataFrame, targets: DataFrame, block_tokens: int = 512, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row about a mix: what it must not hold, and whether the shares are reached.

    n_sources: sources used; over_cap: texts used more often than their source allows; repeated_texts:
    chosen texts with the same content; foreign: chosen ids that are not a text of that source;
    shares_reached: no source is off its share of all tokens by more than two blocks, its longest text
    for each number of uses, and its part of what the other sources' longest texts shift the total.
    """
    facts = docs.filter("doc_id is not null").select("doc_id", "source", F.md5("text").alias("digest")).distinct()
    used = mixed.join(facts, ["doc_id", "source"], "left")
    caps = targets.groupBy("source").agg(F.max("max_repeats").alias("max_repeats"))
    bad = used.join(caps, "source", "left").agg(
        F.countDistinct("source").alias("n_sources"),
        F.sum((F.col("uses") > F.coalesce("max_repeats", F.lit(0))).cast("bigint")).alias("over_cap"),
        (F.count("digest") - F.countDistinct("digest")).alias("repeated_texts"),
        F.sum(F.col("digest").isNull().cast("bigint")).alias("foreign"),
    )
    own = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n"), F.max("n_tokens").alias("longest"), F.countDistinct("uses").alias("parts"))
    own = own.join(targets.groupBy("source").agg(F.min("target_share").alias("target_share")), "source")
    every = Window.partitionBy(F.lit(1))  # one row a source
    total, shares_sum = F.sum("n").over(every), F.sum("target_share").over(every)
    off = F.abs(F.col("n") - F.col("target_share") / shares_sum * total)
    allowed = 2 * block_tokens + F.col("longest") * F.col("parts") + F.sum("longest").over(every) * F.col("target_share") / shares_sum
    near = own.select((off <= allowed).alias("ok")).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("shares_reached"))
    return bad.crossJoin(near)  # one row each


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, max_repeats, n_texts, n_tokens, share, most_uses``: what was reached."""
    used = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"), F.max("uses").alias("most_uses")
    )
    df = targets.dropDuplicates(["source"]).join(used, "source", "left").fillna(0, ["n_texts", "n_tokens", "most_uses"])
    every = Window.partitionBy(F.lit(1))  # one row a source
    return df.withColumn("share", F.try_divide("n_tokens", F.sum("n_tokens").over(every)))
