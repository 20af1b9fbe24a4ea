"""Filling containers of fixed capacity with texts (problem 8), by best-two-fit."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.llm.tokens import VOCABULARY, n_tokens
from trackmeter.session import Written


class Stock:
    """Unpacked items by size, with the largest size up to a bound found by one bit operation."""

    def __init__(self, sizes: list[int]):
        self.at: dict[int, list[int]] = defaultdict(list)
        self.mask = 0
        for i in range(len(sizes) - 1, -1, -1):
            self.add(i, sizes[i])

    def add(self, item: int, size: int) -> None:
        self.at[size].append(item)
        self.mask |= 1 << size

    def take(self, size: int) -> int:
        item = self.at[size].pop()
        if not self.at[size]:
            self.mask &= ~(1 << size)
        return item

    def up_to(self, bound: int) -> int:
        """The largest size in stock that is at most ``bound``; -1 if there is none."""
        return (self.mask & ((1 << (bound + 1)) - 1)).bit_length() - 1 if bound >= 0 else -1

    def best_two(self, bound: int) -> tuple[int, int]:
        """Two sizes in stock with the largest sum up to ``bound``; (0, 0) if there are none."""
        best, pair = 0, (0, 0)
        a = self.up_to(bound)
        while a * 2 > best and a > 0:
            b = self.up_to(min(bound - a, a))
            if b == a and len(self.at[a]) < 2:
                b = self.up_to(a - 1) if a <= bound - a else -1
            if b > 0 and a + b > best:
                best, pair = a + b, (a, b)
                if best == bound:
                    break
            a = self.up_to(a - 1)
        return pair


def best_two_fit(sizes: list[int], capacity: int) -> list[int]:
    """A bin number for each item; sizes are 1 to capacity.

    A bin is filled greedily with the largest items that fit. While it has a gap, its smallest item is
    then replaced by two unpacked ones that fill that item's place and the gap more tightly.
    """
    stock, out, n = Stock(sizes), [-1] * len(sizes), 0
    while stock.mask:
        items: list[tuple[int, int]] = []
        gap = capacity
        while (s := stock.up_to(gap)) > 0:
            items.append((s, stock.take(s)))
            gap -= s
        while gap > 0:
            small = min(items)
            a, b = stock.best_two(gap + small[0])
            if a + b <= small[0]:
                break
            items.remove(small)
            items += [(a, stock.take(a)), (b, stock.take(b))]
            stock.add(small[1], small[0])
            gap -= a + b - small[0]
            while (s := stock.up_to(gap)) > 0:
                items.append((s, stock.take(s)))
                gap -= s
        for _, i in items:
            out[i] = n
        n += 1
    return out


def packed(
    docs: DataFrame, capacity: int = 2048, shard_items: int = 8192, vocabulary: str = VOCABULARY
) -> DataFrame:
    """``doc_id, piece_no, first_token, n_tokens, container_id``: every token of every document in a container.

    Documents longer than a container are cut into full pieces, which take a container each, and a rest;
    no other document is cut. Whole documents and rests are spread by hash over shards of about
    ``shard_items``, whose number follows the data, and each shard is packed by itself; what partly
    filled containers it leaves are few against the thousands it fills.

    Null and empty texts have no tokens and give no row. doc_id names an item: of rows with one doc_id
    the longest text counts; rows without doc_id are left out. Equal lengths are taken in order of hash.
    """
    spark = docs.sparkSession
    counts = (
        docs.select("doc_id", n_tokens(spark, F.col("text"), vocabulary).alias("n"))
        .filter("doc_id is not null and n > 0")
        .groupBy("doc_id")
        .agg(F.max("n").alias("n"))
    )
    counts = Written(spark).put(counts, "counts")
    n_items = counts.filter(F.col("n") % capacity != 0).count()
    shards = max(1, round(n_items / shard_items))
    whole = counts.filter(F.col("n") >= capacity).select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / capacity).cast("int") - 1)).alias("piece_no"), F.lit(capacity).alias("n_tokens")
    )
    h = F.xxhash64("doc_id")
    rest = counts.filter(F.col("n") % capacity != 0).select(
        "doc_id",
        F.floor(F.col("n") / capacity).cast("int").alias("piece_no"),
        (F.col("n") % capacity).cast("int").alias("n_tokens"),
        F.pmod(h, F.lit(shards)).cast("int").alias("shard"),
        h.alias("h"),
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"])
        pdf["bin"] = best_two_fit(pdf["n_tokens"].tolist(), capacity)
        return pdf[["doc_id", "piece_no", "n_tokens", "shard", "bin"]]

    key = docs.schema["doc_id"].dataType.simpleString()
    binned = rest.groupBy("shard").applyInPandas(fill, f"doc_id {key}, piece_no int, n_tokens int, shard int, bin int")
    first = (F.col("piece_no") * capacity).alias("first_token")
    name = lambda *c: F.concat_ws("-", *c).alias("container_id")
    return whole.select("doc_id", "piece_no", first, "n_tokens", name(F.lit("d"), "doc_id", "piece_no")).unionByName(
        binned.select("doc_id", "piece_no", first, "n_tokens", name(F.lit("s"), "shard", "bin"))
    )


def fill_report(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``n_containers, n_pieces, n_tokens, fill_share`` of a packing."""
    bins = pieces.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"))
    return bins.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("k").alias("n_pieces"),
        F.sum("n").alias("n_tokens"),
        (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("fill_share"),
    )


def packing_check(pieces: DataFrame, docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row about a packing: what it must not hold, and whether it is full.

    n_docs: documents with a piece; over_full: containers above capacity; wrong_length: documents whose
    pieces together are not as long as they are; gaps: pieces that do not begin where the piece before
    ends; needless_cuts: documents in more pieces than their length asks for; well_filled: at most one
    token in 200 is left unused.
    """
    lengths = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(n_tokens(docs.sparkSession, F.col("text"), vocabulary)).alias("n"))
    w = Window.partitionBy("doc_id").orderBy("piece_no")
    ends = pieces.withColumn("_due", F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = ends.groupBy("doc_id").agg(
        F.sum("n_tokens").alias("got"), F.count(F.lit(1)).alias("k"), F.sum((F.col("_due") != F.col("first_token")).cast("bigint")).alias("gaps")
    )
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("bigint")), F.lit(0))
    by_doc = lengths.filter("n > 0").join(own, "doc_id", "full").agg(
        F.count("k").alias("n_docs"),
        n(F.coalesce("got", F.lit(0)) != F.coalesce("n", F.lit(0))).alias("wrong_length"),
        F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"),
        n(F.col("k") > F.ceil(F.col("n") / capacity)).alias("needless_cuts"),
    )
    bins = pieces.groupBy("container_id").agg(F.sum("n_tokens").alias("b"))
    by_bin = bins.agg(
        n(F.col("b") > capacity).alias("over_full"),
        # besides one container that ends the packing
        F.coalesce(F.sum("b") >= 0.995 * capacity * (F.count(F.lit(1)) - 1), F.lit(True)).alias("well_filled"),
    )
    return by_doc.crossJoin(by_bin)  # one row each
