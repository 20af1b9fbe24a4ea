"""Polygons from ESRI shapefiles (shape type 5)."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

HEADER, POLYGON = 100, 5
MOST_BYTES = 64 << 20


def polygon_rings(content: bytes) -> list[list[tuple[float, float]]]:
    """All parts of all polygons of a .shp file, in order; records of other types are passed over."""
    if len(content) < HEADER or struct.unpack(">i", content[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    rings, at = [], HEADER
    while at + 8 <= len(content):
        words = struct.unpack(">i", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if len(body) < 44 or struct.unpack("<i", body[:4])[0] != POLYGON:
            continue
        parts, n = struct.unpack("<2i", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
        xy = struct.unpack(f"<{2 * n}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n])
        pts = list(zip(xy[::2], xy[1::2], strict=True))
        rings += [pts[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    return rings


def read_rings(path: str) -> list[list[tuple[float, float]]]:
    """The rings of one local file of bounded size, for use as a literal."""
    with open(path, "rb") as f:
        content = f.read(MOST_BYTES + 1)
    if len(content) > MOST_BYTES:
        raise ValueError("too large to be a literal; use read_regions")
    return polygon_rings(content)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """``region_id, ring`` of many shapefiles, one task a file."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [
                (f"{p}#{i}", [{"lon": x, "lat": y} for x, y in ring])
                for p, c in zip(pdf["path"], pdf["content"], strict=True)
                for i, ring in enumerate(polygon_rings(c))
            ]
            yield pd.DataFrame(rows, columns=["region_id", "ring"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "region_id string, ring array<struct<lon:double,lat:double>>")
