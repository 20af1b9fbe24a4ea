"""Writing tables, reports, sheets and geometry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmeter.operators.conformance import GuardError, require_valid
from trackmeter.session import remove


def write_validated(tracks: DataFrame, report: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet (zstd), only if every device passes: a file that breaks a rule must not exist."""
    require_valid(report)
    w = tracks.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_then_validate(tracks: DataFrame, path: str, rules: Callable[[DataFrame], DataFrame], partition: str | None = None) -> DataFrame:
    """Parquet (zstd), read back and judged by ``rules``; what was written is removed if a device fails.

    For tables whose making costs more than their reading: it is made once, and the file is what is judged.
    """
    w = tracks.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(partition) if partition else w).parquet(path)
    back = tracks.sparkSession.read.parquet(path)
    try:
        require_valid(rules(back))
    except GuardError:
        remove(tracks.sparkSession, path if "://" in path or path.startswith("file:") else f"file://{path}")
        raise
    return back


def write_keyed_csv(df: DataFrame, path: str, keys: list[str]) -> None:
    """CSV with header in order of the keys; as many files as the range sort gives, in that order by name."""
    df.orderBy(*keys).write.mode("overwrite").option("header", True).csv(path)


def write_report(row: DataFrame, path: str) -> None:
    """One JSON object a row."""
    row.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in row.columns])).alias("value")).write.mode("overwrite").text(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One text file per task, each row's text followed by a blank line (sheets, GeoJSON features)."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def spectra_long(spectra: DataFrame, keys: list[str], column: str = "power") -> DataFrame:
    """A spectrum array as rows ``keys, k, power``, for storage or plotting."""
    return spectra.select(*keys, F.posexplode(column).alias("k", "power"))
