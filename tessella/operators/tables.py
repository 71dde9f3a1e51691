"""Detection tables: create, append, clear, read by extent, show."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DETECTION = "the_geom BINARY, class STRING, score DOUBLE, status INT"


def _name(name: str) -> str:
    if not re.fullmatch(r"\w+(\.\w+){0,2}", name):
        raise ValueError(f"not the name of a table: {name}")
    return name


def create_detection_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(name)} ({DETECTION}) USING parquet")


def nodes(spark: SparkSession) -> DataFrame:
    """The driver and the executors of the session: node_id, http_uri, node_version, coordinator, state."""
    sc = spark.sparkContext
    driver = f"{sc._conf.get('spark.driver.host')}:{sc._conf.get('spark.driver.port')}"
    others = sc._jsc.sc().getExecutorMemoryStatus().keySet().mkString(",").split(",")  # a name for each executor and one for the driver's block manager
    host = driver.split(":")[0]
    rows = [(sc.applicationId, sc.uiWebUrl or "", spark.version, True, "active")]
    rows += [(name, f"http://{name}", spark.version, False, "active") for name in others if len(others) > 1 and not name.startswith(f"{host}:")]
    return spark.createDataFrame(rows, "node_id string, http_uri string, node_version string, coordinator boolean, state string")


def wkb_rings(wkb):
    """Rings of WKB polygons, as array<array<struct<x, y>>>; null for other kinds of geometry."""

    @F.pandas_udf("array<array<struct<x: double, y: double>>>")
    def run(column: pd.Series) -> pd.Series:
        def rings(raw: bytes | None):
            if raw is None:
                return None
            order = "<" if raw[0] else ">"
            kind, n = struct.unpack_from(f"{order}2I", raw, 1)
            if kind != 3:
                return None
            at, out = 9, []
            for _ in range(n):
                (points,) = struct.unpack_from(f"{order}I", raw, at)
                xy = struct.unpack_from(f"{order}{2 * points}d", raw, at + 4)
                out.append([{"x": x, "y": y} for x, y in zip(xy[::2], xy[1::2])])
                at += 4 + 16 * points
            return out

        return column.map(rings)

    return run(wkb)


def wkb_box(xmin, ymin, xmax, ymax):
    """WKB of a box as a polygon, as a column, from double columns."""

    @F.pandas_udf("binary")
    def run(x0, y0, x1, y1):
        import struct

        import pandas as pd

        head = struct.pack("<BIII", 1, 3, 1, 5)
        return pd.Series([head + struct.pack("<10d", a, b, c, b, c, d, a, d, a, b) for a, b, c, d in zip(x0, y0, x1, y1)])

    return run(xmin, ymin, xmax, ymax)


def append_detections(df: DataFrame, name: str) -> None:
    """Append rows of the_geom, class, score and status; rows without geometry are left out."""
    rows = df.where(F.col("the_geom").isNotNull())
    rows.select("the_geom", F.col("class").cast("string"), F.col("score").cast("double"), F.col("status").cast("int")).write.insertInto(_name(name))


def clear_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {_name(name)}")


def scan_extent(table: DataFrame, box: list[str], extent: str | None) -> DataFrame:
    """All rows, or those whose box meets the extent `xmin,ymin,xmax,ymax`."""
    if extent is None:
        return table
    x0, y0, x1, y1 = (float(v) for v in extent.split(","))
    a, b, c, d = map(F.col, box)
    return table.where((a <= x1) & (c >= x0) & (b <= y1) & (d >= y0))


def decode_base64(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.unbase64(c) for c in columns})
