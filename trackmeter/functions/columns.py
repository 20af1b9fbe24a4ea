"""Keeping long expressions short for the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed here and once.

    A projection may be merged into what uses it, and its expressions repeated there; a generator is
    not. Its code is a method of its own as well, and the JVM compiles methods up to 8,000 bytes only:
    beyond that they run interpreted, ten times slower and worse.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
