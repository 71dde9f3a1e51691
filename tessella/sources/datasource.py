"""Python data sources `tessella_raster` and `tessella_shapes`, and plain readers built on Spark's `binaryFile`.

The readers open files through Spark, so that any file system it knows will do; the data sources open local paths and are
for single files and tests.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessella.sources import geotiff, shapefile

TILE_SCHEMA = "path string, row int, col int, bands int, height int, width int, transform array<double>, crs string, px array<int>"
SHAPE_SCHEMA = "path string, fid long, rings array<array<struct<x: double, y: double>>>, xmin double, ymin double, xmax double, ymax double, props map<string, string>"


def _tiles(path: str, blob: bytes, size: int) -> Iterator[tuple]:
    """Tiles of a file; those at the right and lower edge are smaller."""
    raster = geotiff.decode(blob)
    a, b, c, d, e, f = raster.transform
    for row in range(0, raster.data.shape[1], size):
        for col in range(0, raster.data.shape[2], size):
            part = raster.data[:, row : row + size, col : col + size]
            transform = [a, b, a * col + b * row + c, d, e, d * col + e * row + f]
            yield path, row // size, col // size, *part.shape, transform, raster.crs, part.astype(np.int32).ravel().tolist()


def read_rasters(spark: SparkSession, path: str, tile: int = 256, pattern: str = "*.tif") -> DataFrame:
    """Tiles of all raster files below a path; the pattern's case counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in TILE_SCHEMA.split(", ")]
        for batch in batches:
            for name, blob in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(list(_tiles(name, blob, tile)), columns=names)

    return files.mapInPandas(run, TILE_SCHEMA)


def folders(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """Folders below a path that hold files of the pattern: folder, paths in order, n; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.sort_array(F.collect_list("path")).alias("paths"), F.count("*").alias("n"))


def _shapes(path: str, shp: bytes, dbf: bytes | None) -> Iterator[tuple]:
    shapes = shapefile.read_shp(shp)
    props = shapefile.read_dbf(dbf) if dbf else [{}] * len(shapes)
    for fid, (rings, row) in enumerate(zip(shapes, props)):
        points = [p for r in rings or [] for p in r]
        box = [min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)] if points else [None] * 4
        nested = [[{"x": x, "y": y} for x, y in ring] for ring in rings] if rings else None
        yield path, fid, nested, *box, {k: None if v is None else str(v) for k, v in row.items()}


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Features of all shapefiles below a path; each .shp is joined with the .dbf of its name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{shp,dbf}").load(path)
    stem = F.regexp_replace("path", r"\.\w+$", "")
    pairs = files.groupBy(stem.alias("stem")).agg(
        F.max(F.when(F.col("path").endswith(".shp"), F.col("content"))).alias("shp"), F.max(F.when(F.col("path").endswith(".dbf"), F.col("content"))).alias("dbf")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "fid", "rings", "xmin", "ymin", "xmax", "ymax", "props"]
        for batch in batches:
            for s, shp, dbf in zip(batch["stem"], batch["shp"], batch["dbf"]):
                yield pd.DataFrame(list(_shapes(f"{s}.shp", shp, dbf)), columns=names)

    return pairs.where(F.col("shp").isNotNull()).mapInPandas(run, SHAPE_SCHEMA)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of newline-delimited GeoJSON: id, type, coordinates as JSON text, properties."""
    schema = "id string, geometry struct<type: string, coordinates: string>, properties map<string, string>"
    return spark.read.schema(schema).json(path).select("id", F.col("geometry.type").alias("geom_type"), "geometry.coordinates", F.col("properties").alias("props"))


def write_geojson(df: DataFrame, path: str, rings: str = "rings", props: str = "props") -> None:
    coordinates = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    df.select(F.lit("Feature").alias("type"), F.col("fid").cast("string").alias("id"), geometry.alias("geometry"), F.col(props).alias("properties")).write.mode("overwrite").json(path)


def explode_polygons(df: DataFrame) -> DataFrame:
    """A row for each polygon of a feature, with its holes; null geometries and polygons of under three points go."""

    kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

    @F.arrow_udf("array<array<array<struct<x: double, y: double>>>>")
    def split(features: pa.Array) -> pa.Array:
        out = []
        for rings in features.to_pylist():
            grouped = shapefile.polygons([[(p["x"], p["y"]) for p in ring] for ring in rings])
            out.append([[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in grouped if len(set(polygon[0])) > 2])
        return pa.array(out, kind)

    return df.where(F.col("rings").isNotNull()).withColumn("rings", F.explode(split("rings")))


def look_up_documents(df: DataFrame, match: Column | None = None, fields: list[str] | None = None, post: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Documents that match, some of their fields, after one pass of a function over the result; all pushed to the scan where it can."""
    out = df if match is None else df.where(match)
    out = out.select("_id", *fields) if fields else out
    return post(out) if post else out


def fetch_tiles(urls: DataFrame, get: Callable[[str], bytes], workers: int = 200) -> DataFrame:
    """url, row, col and the bytes of each tile; `get` runs in threads in the tasks, and empty answers are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                body = list(pool.map(get, batch["url"]))
                out = batch[["url", "row", "col"]].assign(image=body)
                yield out[[bool(b) for b in body]]

    return urls.select("url", "row", "col").mapInPandas(run, "url string, row long, col long, image binary")


class _Files(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class RasterSource(DataSource):
    """format("tessella_raster"): tiles of .tif files below `path`, of `tile` pixels; written rows become files."""

    @classmethod
    def name(cls) -> str:
        return "tessella_raster"

    def schema(self) -> str:
        return TILE_SCHEMA

    def reader(self, schema):
        return _RasterReader(self.options)

    def writer(self, schema, overwrite):
        return _RasterWriter(self.options)


class _RasterReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.tile = options["path"], int(options.get("tile", 256))

    def partitions(self):
        if os.path.isfile(self.path):
            return [_Files(self.path)]
        return [_Files(os.path.join(d, n)) for d, _, names in sorted(os.walk(self.path)) for n in sorted(names) if n.endswith(".tif")]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            yield from _tiles(partition.path, f.read(), self.tile)


class _RasterWriter(DataSourceWriter):
    """A file for each tile, named by its row and column."""

    def __init__(self, options):
        self.path, self.plain = options["path"], options.get("georef", "true") == "false"

    def write(self, rows):
        os.makedirs(self.path, exist_ok=True)
        for r in rows:
            data = np.array(r["px"], dtype=np.int64).reshape(r["bands"], r["height"], r["width"])
            kind = np.uint8 if data.min(initial=0) >= 0 and data.max(initial=0) < 256 else np.int32
            raster = geotiff.Raster(data.astype(kind), tuple(r["transform"]), r["crs"] or "")
            stem = os.path.splitext(os.path.basename(r["path"] or "tile"))[0]
            with open(f"{self.path}/{stem}_{r['row']}_{r['col']}.tif", "wb") as f:
                f.write(geotiff.encode(raster, not self.plain))
        return WriterCommitMessage()


class ShapeSource(DataSource):
    """format("tessella_shapes"): features of the shapefile at `path`."""

    @classmethod
    def name(cls) -> str:
        return "tessella_shapes"

    def schema(self) -> str:
        return SHAPE_SCHEMA

    def reader(self, schema):
        return _ShapeReader(self.options)


class _ShapeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def read(self, partition):
        dbf = os.path.splitext(self.path)[0] + ".dbf"
        with open(self.path, "rb") as f:
            shp = f.read()
        table = open(dbf, "rb").read() if os.path.exists(dbf) else None  # noqa: SIM115
        yield from _shapes(self.path, shp, table)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterSource)
    spark.dataSource.register(ShapeSource)
