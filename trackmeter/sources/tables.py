"""Access to the named tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Tables of a folder by attribute: ``Tables(spark, dir).position_fixes``."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")
