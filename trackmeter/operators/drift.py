"""Schemas that drift between files (problem 2): rescue-column ingestion of delimited lines.

Fields whose header is the target schema's own name and whose value casts go to typed columns at
once; everything else is kept as JSON in ``_rescued``. Approved headers are then promoted, and the
rescued values replayed into the typed columns. How each value was spelled is kept beside it, so the
changes between a deposit's files are read from the ingested table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackmeter.functions.columns import settled
from trackmeter.session import Written

#: words that stand for true and false besides these themselves
TRUE_WORDS = ("true", "yes", "1", "outlier")
FALSE_WORDS = ("false", "no", "0", "ok")
DELIMITERS = (",", ";", "\t", "|")
SQL_TYPES = {"boolean": "boolean", "integer": "bigint", "decimal": "double", "text": "string"}
MOST_FIELDS = 5_000
#: spellings of a value, as bits
BOOLEAN, INTEGER, DECIMAL, TEXT = 1, 2, 4, 8
INTEGER_RE = r"^[+-]?[0-9]+$"
DECIMAL_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
HIDDEN, DOUBLED = "\u0001", "\u0002"


def fields_of(dictionary: DataFrame) -> list[tuple[str, str]]:
    """(field, value_type) of the dictionary; refuses one too long to be a schema."""
    rows = dictionary.select("field", "value_type").filter("field is not null").distinct().orderBy("field").limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields")
    return [(r.field.strip().lower(), r.value_type if r.value_type in SQL_TYPES else "text") for r in rows]


def header_key(name: Column) -> Column:
    """A header's letters and digits in lower case, without bracketed units and leading name space."""
    return F.regexp_replace(F.lower(name), r"\(.*?\)|\[.*?\]|^\s*[a-z]+:|[^\p{L}\p{N}]", "")


def split_line(line: Column, delimiter: Column) -> Column:
    """The values of a delimited line; quotes protect delimiters, doubled quotes stand for one."""
    pattern = F.concat(F.lit("\\"), delimiter)
    quoted = F.transform(
        F.split(F.replace(line, F.lit('""'), F.lit(DOUBLED)), '"'),
        lambda x, i: F.when(i % 2 == 1, F.replace(x, delimiter, F.lit(HIDDEN))).otherwise(x),
    )
    values = F.transform(
        F.split(F.array_join(quoted, ""), pattern),
        lambda x: F.when(x == DOUBLED, F.lit("")).otherwise(
            F.replace(F.replace(x, F.lit(HIDDEN), delimiter), F.lit(DOUBLED), F.lit('"'))
        ),
    )
    return F.when(F.contains(line, F.lit('"')), values).otherwise(F.split(line, pattern))


def approved_fields(approvals: DataFrame | None, own: Sequence[str]) -> dict[str, str]:
    """Header key -> field of a table ``header, field``; a header approved twice stands for the smallest field."""
    if approvals is None:
        return {}
    rows = approvals.filter("header is not null and field is not null").groupBy(header_key(F.col("header")).alias("k")).agg(F.min("field").alias("field"))
    rows = rows.limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} approved headers")
    return {r.k: r.field.strip().lower() for r in rows if r.field.strip().lower() in own}


def headers(lines: DataFrame, dictionary: DataFrame, approvals: DataFrame | None = None) -> DataFrame:
    """``file_id, delimiter, names, exact, resolved, own_at, header_of, keys``: one row a file, from its line 0.

    names: headers as written, trimmed and in lower case; exact: the field of that very name; resolved:
    the field it stands for, by its own name or by ``approvals`` (``header, field``). If two headers of
    a file stand for one field the first counts. For each field of the dictionary in turn, own_at is the
    place of the header of its own name and header_of the header that stands for it; keys name what is
    rescued from each place. The delimiter is the candidate most frequent outside quotes. Files without a header line give no row.
    """
    own = [f for f, _ in fields_of(dictionary)]
    lit_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.lit(None).cast("map<string,string>")
    keys = lines.sparkSession.range(1).select(F.array(*[header_key(F.lit(f)) for f in own]).alias("k")).first().k if own else []
    known = lit_map(approved_fields(approvals, own) | dict(zip(keys, own, strict=True)))
    exact = lit_map({f: f for f in own})
    bare = F.regexp_replace("line", '"[^"]*"', "q")
    count = lambda d: F.struct(F.length(bare) - F.length(F.replace(bare, F.lit(d))), F.lit(d).alias("d"))
    head = lines.filter("line_no = 0 and file_id is not null and line is not null").groupBy("file_id").agg(F.min("line").alias("line"))
    head = head.withColumn("delimiter", F.greatest(*[count(d) for d in DELIMITERS])["d"])
    names = F.transform(split_line(F.col("line"), F.col("delimiter")), lambda x: F.lower(F.trim(x, F.lit(" \t\r\n﻿"))))
    once = lambda a: F.transform(a, lambda f, i: F.when(F.array_position(a, f) == i + 1, f))
    fields = F.array(*[F.lit(f) for f in own]).cast("array<string>")
    # step by step: an array that a lambda names would be computed anew for each element
    heads = settled(head, {"names": names})
    seen = {"_exact": F.transform("names", lambda x: exact[x]), "_resolved": F.transform("names", lambda x: F.coalesce(exact[x], known[header_key(x)]))}
    heads = settled(settled(heads, seen), {c.removeprefix("_"): once(F.col(c)) for c in seen})
    at = {
        "own_at": F.transform(fields, lambda f: F.nullif(F.array_position("exact", f).cast("int"), F.lit(0))),
        "header_of": F.transform(fields, lambda f: F.get("names", F.nullif(F.array_position("resolved", f).cast("int"), F.lit(0)) - 1)),
    }
    # under which name a value of each place is rescued: a header that comes again has its place behind it
    at["keys"] = F.transform("names", lambda x, i: F.when(F.array_position("names", x) - 1 < i, F.concat(x, F.lit("_"), i.cast("string"))).otherwise(x))
    heads = settled(heads, at).select("file_id", "delimiter", "names", "exact", "resolved", *at)
    return Written(lines.sparkSession).put(heads, "heads")  # read by each that looks at a line


def parsed(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """``file_id, line_no, vals`` and the file's header columns, for the lines under a header; blank values become null."""
    body = lines.filter("line_no > 0 and line is not null").select("file_id", "line_no", "line")
    value = lambda x: F.when(F.trim(x) != "", F.trim(x))
    vals = F.transform(split_line(F.rtrim(F.col("line"), F.lit("\r\n")), F.col("delimiter")), value)
    return settled(body.join(heads, "file_id"), {"vals": vals}).drop("line", "delimiter")


def strict_cast(value: Column, kind: str) -> Column:
    """The value in the field's type as the target schema spells it, else null."""
    if kind == "boolean":
        return F.when(F.lower(value) == "true", True).when(F.lower(value) == "false", False)
    if kind == "integer":
        return F.when(value.rlike(INTEGER_RE), value.try_cast("bigint"))
    if kind == "decimal":
        return F.when(value.rlike(DECIMAL_RE), value.try_cast("double"))
    return value


def lenient_cast(value: Column, kind: str, true_words: Sequence[str] = TRUE_WORDS, false_words: Sequence[str] = FALSE_WORDS) -> Column:
    """The value in the field's type in any known spelling: decimal commas, units behind, words for marks."""
    if kind == "boolean":
        word = F.lower(value)
        return F.when(word.isin(*true_words), True).when(word.isin(*false_words), False)
    if kind in ("integer", "decimal"):
        number = F.replace(F.regexp_extract(value, r"^([+-]?[0-9]*[.,]?[0-9]+)\s*\p{L}*(/\p{L}+)?$", 1), F.lit(","), F.lit("."))
        return strict_cast(F.when(number != "", number), kind)
    return value


def spelling(value: Column) -> Column:
    """How a value is spelled, as one bit; null stays null."""
    kind = F.when(F.lower(value).isin("true", "false"), BOOLEAN).when(value.rlike(INTEGER_RE), INTEGER).when(value.rlike(DECIMAL_RE), DECIMAL).otherwise(TEXT)
    return F.when(value.isNotNull(), kind)


def strict_spelling(value: Column, kind: str) -> Column:
    """``spelling`` of a value that ``strict_cast`` takes: its type tells most of it."""
    if kind == "boolean":
        return F.lit(BOOLEAN)
    if kind == "integer":
        return F.lit(INTEGER)
    if kind == "decimal":
        return F.when(F.contains(value, F.lit(".")), DECIMAL).otherwise(INTEGER)
    return spelling(value)


def ingest(lines: DataFrame, heads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``file_id, line_no``, a typed column per dictionary field, ``_spelled`` and ``_rescued``.

    ``_rescued`` is a JSON object from header to raw text of all that the target schema does not take:
    other headers, values that do not cast, and values beyond the header (under ``_extra_<place>``).
    Null where nothing was rescued. Lines cut short leave the missing fields null. ``_spelled`` holds
    the spelling of each typed value, by place in the dictionary.
    """
    fields = fields_of(dictionary)
    at = lambda i: F.get("vals", F.get("own_at", F.lit(i)) - 1)
    df = settled(parsed(lines, heads), {f"_{i}": strict_cast(at(i), k) for i, (_, k) in enumerate(fields)})
    uncast = F.array_compact(F.array(*[F.when(at(i).isNotNull() & F.col(f"_{i}").isNull(), F.lit(f)) for i, (f, _) in enumerate(fields)]).cast("array<string>"))
    spelled = F.array(*[F.when(F.col(f"_{i}").isNotNull(), strict_spelling(at(i), k)) for i, (_, k) in enumerate(fields)]).cast("array<int>")
    df = settled(df, {"_spelled": spelled, "_uncast": uncast})
    own = lambda i: F.get("exact", i)
    cells = F.transform(
        "vals",
        lambda v, i: F.when(
            v.isNotNull() & (own(i).isNull() | F.array_contains("_uncast", own(i))),
            F.struct(F.coalesce(F.get("keys", i), F.concat(F.lit("_extra_"), i.cast("string"))).alias("key"), v.alias("value")),
        ),
    )
    df = settled(df, {"_left": F.array_compact(cells)})
    df = settled(df, {"_rescued": F.when(F.size("_left") > 0, F.to_json(F.map_from_entries("_left")))})
    return df.select("file_id", "line_no", *[F.col(f"_{i}").alias(f) for i, (f, _) in enumerate(fields)], "_spelled", "_rescued")


def replay(table: DataFrame, heads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Promotes approved headers: rescued values that now cast move into their empty typed columns.

    ``heads`` resolves each file's headers once, with the approvals of the day; a line only looks up
    the header that stands for a field. What still has no place stays in ``_rescued``, but counts for
    ``_spelled`` where its header stands for a field. May be run again whenever headers are approved.
    """
    df = settled(table.join(heads.select("file_id", "header_of"), "file_id", "left"), {"_m": F.from_json("_rescued", "map<string,string>")})
    some = F.col("_m").isNotNull()
    out, moved = {}, []
    for i, (f, kind) in enumerate(fields_of(dictionary)):
        raw = F.col("_m")[F.get("header_of", F.lit(i))]
        cast = lenient_cast(raw, kind)
        out[f] = F.when(some & F.col(f"`{f}`").isNull(), cast).otherwise(F.col(f"`{f}`"))
        moved.append(F.when(F.col(f"`{f}`").isNull() & cast.isNotNull(), F.get("header_of", F.lit(i))))
    spelled = F.zip_with("_spelled", "header_of", lambda s, h: F.coalesce(s, spelling(F.col("_m")[h])))
    rest = F.map_filter("_m", lambda k, v: ~F.array_contains("_moved", k))
    df = settled(df, {"_moved": F.when(some, F.array_compact(F.array(*moved).cast("array<string>")))})
    new = {f"_{i}": v for i, v in enumerate(out.values())}
    new |= {"_how": F.when(some, spelled).otherwise(F.col("_spelled")), "_rest": F.when(some & (F.size(rest) > 0), F.to_json(rest))}
    return settled(df, new).select(
        "file_id", "line_no", *[F.col(f"_{i}").alias(f) for i, f in enumerate(out)], F.col("_how").alias("_spelled"), F.col("_rest").alias("_rescued")
    )


def profile(table: DataFrame, heads: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``file_id, field, header, kind``: the fields of each file as they are there, from the replayed table.

    kind: boolean if all values that aren't empty are true/false, else integer, decimal or text; null
    if there is no value. The spellings of a file are joined bit by bit before the shuffle, so a huge
    file is no hot spot.
    """
    fields = [f for f, _ in fields_of(dictionary)]
    bits = table.groupBy("file_id").agg(*[F.bit_or(F.get("_spelled", F.lit(i))).alias(f"_{i}") for i in range(len(fields))]) if fields else None
    masks = F.array(*[F.col(f"_{i}") for i in range(len(fields))]).cast("array<int>")
    found = heads.select("file_id", "header_of")
    found = found.join(bits.select("file_id", masks.alias("masks")), "file_id", "left") if fields else found.withColumn("masks", F.lit(None).cast("array<int>"))
    names = F.array(*[F.lit(f) for f in fields]).cast("array<string>")
    df = found.select("file_id", "masks", F.posexplode("header_of").alias("i", "header")).filter("header is not null")
    mask = F.get("masks", F.col("i"))
    kind = (
        F.when(mask == BOOLEAN, "boolean")
        .when(mask == INTEGER, "integer")
        .when(mask.bitwiseAND(F.lit(~(INTEGER | DECIMAL))) == 0, "decimal")
        .when(mask.isNotNull(), "text")
    )
    return df.select("file_id", F.get(names, F.col("i")).alias("field"), "header", kind.alias("kind"))


def changes(files: DataFrame, fields: DataFrame) -> DataFrame:
    """``file_id, field, change_kind, before, after`` against the deposit's previous file by export time.

    added / removed: the field is in one of the two files only; renamed: its header differs; retyped: its
    kind differs (a field without values has no kind, and so is not retyped). The first file of a deposit,
    and files without deposit or export time, report nothing. Equal times go by file_id.
    """
    w = Window.partitionBy("uuid").orderBy("exported_at", "file_id")
    steps = (
        files.select("file_id", "uuid", "exported_at")
        .dropna()
        .dropDuplicates(["file_id"])
        .withColumn("prev", F.lag("file_id").over(w))
        .filter("prev is not null")
    )
    now = steps.select("file_id").join(fields, "file_id").select("file_id", "field", F.col("header").alias("h1"), F.col("kind").alias("k1"))
    old = (
        steps.select(F.col("file_id").alias("next"), F.col("prev").alias("file_id"))
        .join(fields, "file_id")
        .select(F.col("next").alias("file_id"), "field", F.col("header").alias("h0"), F.col("kind").alias("k0"))
    )
    both = now.join(old, ["file_id", "field"], "full")
    entry = lambda cond, name, a, b: F.when(cond, F.struct(F.lit(name).alias("change_kind"), a.alias("before"), b.alias("after")))
    h0, h1, k0, k1 = (F.col(c) for c in ("h0", "h1", "k0", "k1"))
    kinds = F.array_compact(
        F.array(
            entry(h0.isNull(), "added", h0, h1),
            entry(h1.isNull(), "removed", h0, h1),
            entry(h0 != h1, "renamed", h0, h1),
            entry(k0 != k1, "retyped", k0, k1),
        )
    )
    return both.select("file_id", "field", F.explode(kinds).alias("c")).select("file_id", "field", "c.*")
