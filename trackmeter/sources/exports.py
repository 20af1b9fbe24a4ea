"""Reading raw exports: CSV, CSV in zip archives, reference tables, JSON reports, file listings."""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackmeter.functions.columns import settled
from trackmeter.operators.corpus import file_status
from trackmeter.operators.drift import split_line

NEEDED = ("timestamp", "location-lat", "location-long", "individual-local-identifier")
OPTIONAL = (
    "event-id",
    "tag-local-identifier",
    "sensor-type",
    "argos:lc",
    "external-temperature",
    "manually-marked-outlier",
    "visible",
    "ground-speed",
    "heading",
    "height-above-ellipsoid",
    "eobs:horizontal-accuracy-estimate",
    "eobs:battery-voltage",
    "eobs:fix-battery-voltage",
    "eobs:temperature",
    "eobs:used-time-to-get-fix",
    "eobs:type-of-fix",
    "eobs:status",
    "eobs:speed-accuracy-estimate",
)


def read_export(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """A CSV export with all columns as text, reduced to those wanted that its header has."""
    df = spark.read.csv(path, header=True, mode="PERMISSIVE", multiLine=False, escape='"')
    wanted = [*NEEDED, *OPTIONAL] if columns is None else columns
    df = df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])
    return df if rows is None else df.limit(rows)


def mixed_timestamp(c: Column) -> Column:
    """ISO text with or without fraction, zone or T; day first with slashes; NULL if it is no time."""
    return F.coalesce(c.try_cast("timestamp"), F.try_to_timestamp(c, F.lit("dd/MM/yyyy HH:mm:ss")), F.try_to_timestamp(c, F.lit("dd/MM/yyyy HH:mm")))


def typed_export(df: DataFrame) -> DataFrame:
    """An export read as text with its time, event-id and coordinates typed; what does not cast is NULL."""
    out = {"timestamp": mixed_timestamp(F.col("timestamp")).cast("timestamp_ntz")}
    for name, kind in (("location-lat", "double"), ("location-long", "double"), ("event-id", "bigint")):
        if name in df.columns:
            out[name] = F.col(f"`{name}`").try_cast(kind)
    if "event-id" not in df.columns:
        out["event-id"] = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.withColumns(out)


def _problem(names: Column) -> Column:
    """Why a file with these headers can't be used; NULL if it can."""
    missing = F.filter(F.array(*[F.lit(c) for c in NEEDED]), lambda c: ~F.array_contains(names, c))
    placed = F.array_contains(names, F.lit("location-lat")) & F.array_contains(names, F.lit("location-long"))
    return F.when(~placed, "no position").when(F.size(missing) > 0, F.concat(F.lit("unreadable: no "), F.get(missing, F.lit(0))))


def _by_header(files: DataFrame, lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``file, problem`` and text columns of ``lines`` (``file, at, line``) by the header, the line of each file with the least ``at``."""
    head = lines.groupBy("file").agg(F.min(F.struct("at", "line")).alias("h"))
    bare = F.regexp_replace(F.rtrim(F.col("h.line"), F.lit("\r")), "^\ufeff", "")
    head = head.select("file", F.col("h.at").alias("_first"), split_line(bare, F.lit(",")).alias("_names"))
    named = files.join(head, "file", "left").withColumn("problem", _problem(F.coalesce("_names", F.array().cast("array<string>"))))
    text = F.lit(None).cast("string")
    bad = named.filter("problem is not null").select("file", "problem", *[text.alias(c) for c in columns])
    vals = split_line(F.rtrim(F.col("line"), F.lit("\r")), F.lit(","))
    rows = settled(lines.join(named.filter("problem is null"), "file").filter(F.col("at") > F.col("_first")), {"_vals": vals})
    rows = rows.filter(F.size("_vals") == F.size("_names"))
    value = lambda c: F.nullif(F.get("_vals", F.nullif(F.array_position("_names", F.lit(c)).cast("int"), F.lit(0)) - 1), F.lit(""))
    return rows.select("file", text.alias("problem"), *[value(c).alias(c) for c in columns]).unionByName(bad)


def read_csv_files(spark: SparkSession, path: str, columns: Sequence[str] = (*NEEDED, "sensor-type", "argos:lc")) -> DataFrame:
    """``file, problem`` and text columns of the CSV files in a folder, each by its own header.

    Files are split among tasks like any text, so their size does not matter; quoted values must not
    span lines. Lines of another length than the header are skipped. A file without positions, or
    without a needed column, gives one row with a ``problem`` and nulls. A file of no bytes gives none.
    """
    lines = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.col("value").alias("line")
    )
    # within a task lines come in the order of the file, so the first of the block at 0 is the header
    lines = lines.select("file", F.struct("_start", F.monotonically_increasing_id().alias("_id")).alias("at"), "line")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[cC][sS][vV]").load(path).select(F.col("path").alias("file"))
    plain = lambda d: d.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))
    return _by_header(plain(files), plain(lines), list(columns))


def read_archives(spark: SparkSession, path: str, columns: Sequence[str] = (*NEEDED, "sensor-type", "argos:lc"), batch: int = 50_000) -> DataFrame:
    """As ``read_csv_files``, with the first CSV of each zip archive in the folder besides.

    An archive can't be read from its middle, so each is one task's work and at most 2 GB; unpack larger
    ones beforehand. One that can't be read is a finding, not a failure.
    """
    columns = list(columns)
    needed = list(NEEDED)

    def table(content: bytes) -> Iterator[list[str]]:
        members = (m for m in zipfile.ZipFile(io.BytesIO(content)).infolist() if m.filename.lower().endswith(".csv"))
        if (first := next(members, None)) is None:
            raise ValueError("no csv in archive")
        with zipfile.ZipFile(io.BytesIO(content)).open(first) as member:
            yield from csv.reader(io.TextIOWrapper(member, encoding="utf-8-sig", errors="replace", newline=""))

    def parts(name: str, content: bytes) -> Iterator[list[list[str | None]]]:
        try:
            rows = table(content)
            names = next(rows, [])
            head = {c: names.index(c) for c in names}
            absent = [c for c in needed if c not in head]
            if absent:
                unplaced = "location-lat" in absent or "location-long" in absent
                yield [[name, "no position" if unplaced else f"unreadable: no {absent[0]}", *[None] * len(columns)]]
                return
            whole = (r for r in rows if len(r) == len(names))
            while block := [[name, None, *[(r[head[c]] or None) if c in head else None for c in columns]] for r in itertools.islice(whole, batch)]:
                yield block
        except zipfile.BadZipFile:
            yield [[name, "damaged archive", *[None] * len(columns)]]
        except Exception as e:
            yield [[name, f"unreadable: {type(e).__name__}: {e}"[:120], *[None] * len(columns)]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                for block in parts(name, content):
                    yield pd.DataFrame(block, columns=["file", "problem", *columns])

    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("file", "problem", *columns)])
    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path).select("path", "content").mapInPandas(run, schema)
    return read_csv_files(spark, path, columns).unionByName(zips)


def archive_status(rows: DataFrame, least: int = 200) -> DataFrame:
    """``file, status, detail, n_rows`` of what ``read_archives`` gave: ok, no position or unreadable.

    Rows count if time, identifier and both coordinates are there.
    """
    whole = F.lit(True)
    for c in NEEDED:
        whole = whole & F.col(f"`{c}`").isNotNull()
    g = rows.groupBy("file").agg(F.max("problem").alias("detail"), F.sum((F.col("problem").isNull() & whole).cast("int")).alias("n_rows"))
    p = F.coalesce(F.col("detail"), F.lit(""))
    status = file_status(~(p.startswith("unreadable") | (p == "damaged archive")), p != "no position", F.col("n_rows"), least)
    return g.select("file", status.alias("status"), "detail", "n_rows")


def wanted_file(name: Column, ignored: Sequence[str] = ("readme", "reference"), suffixes: Sequence[str] = (".csv", ".zip")) -> Column:
    """Data files by name: one of the suffixes, none of the ignored words, in any case."""
    low = F.lower(name)
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.endswith(low, F.lit(s))
    for word in ignored:
        keep = keep & ~F.contains(low, F.lit(word))
    return keep


def read_spectra(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Spectra stored in long form (``keys, k, power``) as one array a key, in order of k."""
    long = spark.read.parquet(path)
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "power"))), lambda x: x["power"]).alias("power"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A JSON report, one object a file."""
    return spark.read.json(path, multiLine=True)
