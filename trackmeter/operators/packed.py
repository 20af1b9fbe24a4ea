"""Several values packed in one field (problem 7), by delimiter skeletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmeter.operators.fixes import first_of
from trackmeter.session import Written

#: blanks of any kind, as a regex class body
BLANK = r"\s\p{Z}\x{0085}\x{200b}\x{feff}"
#: what belongs to a value: letters, digits, signs and points
ORDINARY = r"\p{L}\p{N}\p{M}+.\-_\x{2212}"
#: integers parted by single spaces
PLAIN = r"^[+-]?[0-9]+( [+-]?[0-9]+)*\z"
QUOTES = "'“”„«»"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def skeleton(text: Column) -> Column:
    """The text with each value masked as v, keeping its start, its end and each separator once."""
    masked = F.regexp_replace(F.translate(_trim(text), QUOTES, '"' * len(QUOTES)), f"[{ORDINARY}]+", "v")
    parts = F.split(masked, "v")
    inner = F.array_sort(F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))))
    return F.concat(parts[0], F.lit("v"), F.array_join(inner, "v"), F.lit("v"), F.element_at(parts, -1))


def rules(skeletons: DataFrame) -> DataFrame:
    """For each ``skeleton``: is the whole bracketed, are values quoted, and the regexes of separators and outer marks."""
    s = _trim(F.col("skeleton"))
    bracketed = F.coalesce(
        F.array_contains(F.array(F.lit("()"), F.lit("[]"), F.lit("{}"), F.lit("<>")), F.concat(F.left(s, F.lit(1)), F.right(s, F.lit(1)))),
        F.lit(False),
    )
    inner = F.when(bracketed, F.expr("substring(skeleton, 2, length(skeleton) - 2)")).otherwise(F.col("skeleton"))
    marks = F.array_distinct(F.regexp_extract_all(F.regexp_replace(inner, '"', ""), F.lit(r"([\p{P}\p{S}])")))
    cls = F.concat(F.lit("["), F.array_join(F.transform(marks, lambda m: F.concat(F.lit("\\"), m)), ""), F.lit("]"))
    some = F.size(marks) > 0
    gap = F.lit(f"[{BLANK}]*")
    return skeletons.select(
        "skeleton",
        bracketed.alias("bracketed"),
        F.contains(F.col("skeleton"), F.lit('"')).alias("quoted"),
        F.when(some, F.concat(gap, cls, gap, F.lit(f"|[{BLANK}]+"))).otherwise(F.lit(f"[{BLANK}]+")).alias("separator"),
        F.when(some, F.concat(F.lit("^"), cls, gap, F.lit("|"), gap, cls, F.lit("$"))).otherwise(F.lit("^(?!)")).alias("outer"),
    )


def _requoted(t: Column) -> Column:
    """Quoted stretches as single values: commas inside dropped; what is no integer then becomes a word."""
    parts = F.split(t, '"')

    def one(x: Column, i: Column) -> Column:
        inside = _trim(F.regexp_replace(x, ",", ""))
        word = F.when(inside.rlike(r"^[+-]?[0-9]+$"), inside).otherwise(F.lit("x"))
        return F.when((i % 2 == 1) & (i < F.size(parts) - 1), word).otherwise(x)

    return F.array_join(F.transform(parts, one), "")


def unpack(rows: DataFrame, key: str, text: str, most_rules: int = 20_000) -> DataFrame:
    """``key, pos, value`` (bigint): one row per value of each ``text``, with its place from 1.

    Blanks of any kind and punctuation marks (with or without blanks around) part places; a minus and a
    point belong to values; brackets around the whole text are ignored; quotes enclose one value, whose
    commas are part of the number; an unpaired quote is ignored. An empty place, or one that holds no
    integer that fits 64 bits, takes a position but gives no row; one mark at the very start or end
    makes no place. Null, empty and blank texts give no row.

    Rules are resolved once per distinct skeleton. They are broadcast only if their count, which is
    taken first, is at most ``most_rules`` (under 5 MB); otherwise they are joined by shuffle.
    """
    df = rows.select(key, F.col(text).alias("_t")).filter(F.col("_t").isNotNull() & ~F.col("_t").rlike(f"^[{BLANK}]*$"))
    kinds = Written(rows.sparkSession).put(df.select(skeleton(F.col("_t")).alias("skeleton")).distinct(), "skeletons")
    table = rules(kinds)
    if kinds.count() <= most_rules:
        table = F.broadcast(table)
    df = df.withColumn("skeleton", skeleton(F.col("_t"))).join(table, "skeleton")
    t = F.translate(_trim(F.col("_t")), QUOTES + "−", '"' * len(QUOTES) + "-")
    t = F.when(F.col("bracketed"), _trim(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)
    t = F.when(F.col("quoted"), _requoted(t)).otherwise(t)
    places = F.split(F.regexp_replace(t, F.col("outer"), F.lit("")), F.col("separator"))
    out = df.select(key, F.posexplode(places).alias("pos", "v")).filter(F.col("v").rlike(r"^[+-]?[0-9]+$"))
    return out.select(key, (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("v").try_cast("bigint").alias("value")).dropna()


def bursts(acc: DataFrame) -> DataFrame:
    """``event_id, raw``: each event-id once (of copies that differ, the first by raw text, nulls last)."""
    df = acc.select(F.col("`event-id`").cast("bigint").alias("event_id"), F.col("`eobs:accelerations-raw`").alias("raw"))
    return first_of(df.filter("event_id is not null"), ["event_id"], [F.col("raw").asc_nulls_last()])


def odd_bursts(acc: DataFrame) -> DataFrame:
    """The values of bursts whose raw text is anything else than integers parted by single spaces."""
    return unpack(bursts(acc).filter(~F.col("raw").rlike(PLAIN)), "event_id", "raw")


def all_bursts(acc: DataFrame) -> DataFrame:
    """The values of every burst; plainly written ones need no rule."""
    b = bursts(acc)
    plain = b.filter(F.col("raw").rlike(PLAIN)).select("event_id", F.posexplode(F.split("raw", " ")).alias("pos", "v"))
    plain = plain.select("event_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("v").try_cast("bigint").alias("value")).dropna()
    return plain.unionByName(odd_bursts(acc))
