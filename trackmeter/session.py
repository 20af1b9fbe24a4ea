"""Session helpers: a tuned local session, and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "trackmeter", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local master gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "trackmeter-shared")
    os.makedirs(path, exist_ok=True)
    return "file://" + path


class Written:
    """Tables written to the shared folder to cut lineage and to be read more than once.

    They outlive the operator that wrote them, as its result reads them. ``scratch`` removes them.
    """

    roots: list[str] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
        Written.roots.append(self.root)
        if not spark.conf.get("spark.checkpoint.dir", ""):  # our own local folder: nobody else clears it
            atexit.register(shutil.rmtree, self.root.removeprefix("file://"), ignore_errors=True)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder: a local one by itself, any other through the session's file system."""
    if path.startswith("file:"):
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
    elif (context := getattr(spark, "_sc", None)) is not None:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables that operators wrote within; write or collect results before."""
    before = len(Written.roots)
    try:
        yield
    finally:
        for root in Written.roots[before:]:
            remove(spark, root)
        del Written.roots[before:]
