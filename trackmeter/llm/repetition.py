"""Repetition inside a document (problem 10): a threshold table compiled into one projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: consecutive words that make a phrase
PHRASE = 6
#: fixed values: frequent function words of the languages in use
STOP_WORDS = (
    "the a an of to and in is was it for on with as by at from that this "
    "le la les un une des du de et en est dans pour sur avec par que qui "
    "der die das ein eine und in ist war zu von mit auf den dem nicht "
    "el los las uno una y en es por para con del que se"
).split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Longest runs of letters and digits, in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def repeated_words(w: Column, phrase: int = PHRASE) -> Column:
    """How many of the words lie in a phrase that has occurred, starting earlier, in the same text.

    Phrases are compared by 64-bit hashes of word hashes. Equal hashes in a sorted list show which
    starts repeat an earlier one; what their phrases cover is summed over the ordered starts.
    """
    n = F.size(w)
    hashed = lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - phrase), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(phrase)])
    )

    def covered(g: Column) -> Column:
        by_hash = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        again = let(by_hash, lambda s: F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1)["g"] == x["g"])))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        adds = let(starts, lambda s: F.transform(s, lambda x, k: F.when(k == 0, phrase).otherwise(F.least(F.lit(phrase), x - F.get(s, k - 1)))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(F.aggregate(adds, F.lit(0), lambda a, x: a + x))

    return F.when(n > phrase, let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(hashed(h), covered))).otherwise(F.lit(0))


def duplicate_share(parts: Column) -> Column:
    """The share of characters in parts that have occurred before in the list."""
    def share(p: Column) -> Column:
        chars = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
        return F.when(F.size(F.array_distinct(p)) == F.size(p), F.lit(0.0)).otherwise(
            F.coalesce(1.0 - F.try_divide(chars(F.array_distinct(p)), chars(p)), F.lit(0.0))
        )

    return let(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), share)


def measures(t: Column, w: Column) -> dict[str, Column]:
    """Each measure of a text and its words as an expression of built-in functions; a rule table uses those it names.

    Empty texts have length 0 and ratios 0.
    """
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    removed = lambda cls: F.length(t) - F.length(F.regexp_replace(t, cls, ""))
    lines = F.split(t, r"\r\n|\r|\n")
    stop = F.array(*[F.lit(x) for x in sorted(set(STOP_WORDS))])
    return {
        "n_chars": F.length(t),
        "n_words": F.size(w),
        "repeated_word_share": ratio(repeated_words(w), F.size(w)),
        "symbol_ratio": ratio(removed(r"[\p{P}\p{S}]+"), F.length(t)),
        "stop_word_ratio": ratio(F.size(F.filter(w, lambda x: F.array_contains(stop, x))), F.size(w)),
        "duplicate_line_share": duplicate_share(lines),
        "duplicate_paragraph_share": duplicate_share(F.split(t, r"(?:\r\n|\r|\n)\s*(?:\r\n|\r|\n)")),
        "duplicate_sentence_share": duplicate_share(F.split(t, r"(?<=[.!?])\s+")),
        "mean_line_chars": ratio(F.length(t), F.size(lines)),
    }


MEASURES = (
    "n_chars", "n_words", "repeated_word_share", "symbol_ratio", "stop_word_ratio",
    "duplicate_line_share", "duplicate_paragraph_share", "duplicate_sentence_share", "mean_line_chars",
)


def _known(names: Sequence[str]) -> list[str]:
    if unknown := [m for m in names if m not in MEASURES]:
        raise ValueError(f"unknown measures {unknown}")
    return list(dict.fromkeys(names))


#: measure, comparison, limit: the rules reported one by one
RULES = (
    ("repeated_word_share", ">=", 0.30),
    ("duplicate_line_share", ">=", 0.30),
    ("duplicate_paragraph_share", ">=", 0.30),
    ("duplicate_sentence_share", ">=", 0.30),
    ("symbol_ratio", ">=", 0.50),
)
#: these and the limits of what is text at all
ALL_RULES = (
    *RULES,
    ("stop_word_ratio", "<=", 0.05),
    ("mean_line_chars", "<", 8.0),
    ("n_words", "<=", float(PHRASE)),
)
#: a document that holds all of these is repetitive, cheapest first. The definition knows the share of
#: words alone; the other limits are what follows from it (a phrase cannot recur within its own length, a
#: text of symbols has no words), so they spare work and reject nothing else.
REPETITIVE = (
    ("n_chars", ">", 2.0 * PHRASE),
    ("n_words", ">", float(PHRASE)),
    ("repeated_word_share", ">=", 0.30),
    ("symbol_ratio", "<", 1.0),
    ("stop_word_ratio", "<=", 1.0),
    ("mean_line_chars", ">", 0.0),
    ("duplicate_line_share", "<=", 1.0),
)
COMPARE = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}


def judged(docs: DataFrame, rules: Sequence[tuple[str, str, float]] = RULES, show: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the measures that the rules or ``show`` name, and ``broken``: the rules a text breaks.

    One projection without shuffle or user function, whatever the number of rules; one result row per
    input row. Repeated rows give repeated results; extra columns are ignored.
    """
    need = _known([*[m for m, _, _ in rules], *show])
    t = F.coalesce("text", F.lit(""))
    # words and measures are found once a text: the optimizer does not repeat what a generator gives
    found = F.transform(F.array(words(t)), lambda w: F.struct(*[measures(t, w)[m].alias(m) for m in need], F.lit(0).alias("_")))
    df = docs.select("doc_id", F.inline(found)).drop("_")
    broken = [F.when(COMPARE[op](F.col(m), F.lit(limit)), F.lit(f"{m} {op} {limit:g}")) for m, op, limit in rules]
    return df.withColumn("broken", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def repetitive(docs: DataFrame, table: Sequence[tuple[str, str, float]] = REPETITIVE) -> DataFrame:
    """``doc_id`` of the documents that hold all rules of the table, compiled into one condition.

    Rules are asked in the table's order; once one does not hold, no later measure is computed. Null
    and empty texts hold none with a positive lower limit.
    """
    _known([m for m, _, _ in table])
    t = F.coalesce("text", F.lit(""))

    def holds(rows: Sequence[tuple[str, str, float]], w: Column | None) -> Column:
        done = F.lit(True)
        for m, op, limit in reversed(rows):
            done = F.when(COMPARE[op](F.length(t) if m == "n_chars" else measures(t, w)[m], F.lit(limit)), done).otherwise(False)
        return done

    first = 0
    while first < len(table) and table[first][0] == "n_chars":
        first += 1  # these need no words
    rest = let(words(t), lambda w: holds(table[first:], w)) if first < len(table) else F.lit(True)
    return docs.filter(F.when(holds(table[:first], None), rest).otherwise(False)).select("doc_id")
