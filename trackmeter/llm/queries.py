"""Queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmeter.llm import oracles as sql
from trackmeter.llm.mixing import mix, mix_check, shares
from trackmeter.llm.nearest import bursts_with_fixes
from trackmeter.llm.packing import fill_report, packed, packing_check
from trackmeter.llm.repetition import ALL_RULES, judged, repetitive
from trackmeter.llm.runs import near_runs
from trackmeter.session import Written
from trackmeter.sources.tables import Tables


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_runs(Tables(spark, sf_dir).position_fixes).select("first_event_id", "last_event_id")


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run with its count, start, end and duration."""
    return near_runs(Tables(spark, sf_dir).position_fixes)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    pairs = bursts_with_fixes(t.acc_records, t.position_fixes)
    return pairs.select(F.col("left_id").alias("acc_event_id"), F.col("right_id").alias("fix_event_id"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(Tables(spark, sf_dir).documents)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(packed(Tables(spark, sf_dir).documents))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every token of every document lies in one container, none over-full and none cut without need."""
    docs = Tables(spark, sf_dir).documents
    return packing_check(Written(spark).put(packed(docs), "pieces"), docs)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return mix(t.documents, t.mix_targets)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares by source."""
    t = Tables(spark, sf_dir)
    return shares(mix(t.documents, t.mix_targets), t.mix_targets)


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mix keeps its caps, uses a text once, and reaches the shares."""
    t = Tables(spark, sf_dir)
    return mix_check(Written(spark).put(mix(t.documents, t.mix_targets), "mix"), t.documents, t.mix_targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitive(Tables(spark, sf_dir).documents)


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's length and share of repeated words."""
    shown = ("n_chars", "n_words", "repeated_word_share")
    return judged(Tables(spark, sf_dir).documents, rules=(), show=shown).select("doc_id", *shown)


def p10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the threshold table that each document breaks."""
    return judged(Tables(spark, sf_dir).documents, ALL_RULES).filter(F.size("broken") > 0).select("doc_id", F.concat_ws("; ", "broken").alias("broken"))


QUERIES = {
    "p3_found": p3_found,
    "p3_runs": p3_runs,
    "p4_found": p4_found,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p8_check": p8_check,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_check": p9_check,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
    "p10_rules": p10_rules,
}
ORACLES = {
    "p3_found": sql.P3_FOUND,
    "p4_found": sql.P4_FOUND,
    "p10_found": sql.P10_FOUND,
    "p3_runs": sql.P3_RUNS,
    "p8_check": sql.P8_CHECK,
    "p9_check": sql.P9_CHECK,
    "p10_shares": sql.P10_SHARES,
    "p10_rules": sql.P10_RULES,
}
