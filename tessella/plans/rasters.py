"""Queries on chips and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.geometry import ring_area, ring_contains
from tessella.operators import dataset, raster
from tessella.plans.views import BOX, FEATURES, PIXELS, chips, features, pixels, query, table

GRID = 100  # pixels of 10 units over the extent
CODE = "CASE cls WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 WHEN 'Brand#13' THEN 3 ELSE 4 END"


def raster_mask_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.transform("px", lambda p: (p > 128).cast("int"))
    return chips(spark, sf_dir).select("vec_id", F.posexplode(raster.apply_mask(F.col("px"), mask)).alias("pos", "px"))


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(GRID * GRID).select(F.expr(f"id div {GRID}").alias("row"), (F.col("id") % GRID).alias("col"))


def rasterize_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.rasterize(_grid(spark), features(spark, sf_dir), BOX, 10.0)


def rasterize_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.rasterize(_grid(spark), features(spark, sf_dir).withColumn("code", F.expr(CODE)), BOX, 10.0, "fid", "code")


def mask_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lengths of chips over 128, column by column."""
    p = pixels(spark, sf_dir).withColumn("flag", (F.col("px") > 128).cast("int"))
    return raster.run_lengths(p, "vec_id", "flag", F.col("pos") % 8 * 8 + F.expr("pos div 8"))


def mask_rle_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one text a chip."""
    columns = F.transform(F.array(*[F.lit(r * 8 + c) for c in range(8) for r in range(8)]), lambda i: (F.element_at("px", i + 1) > 128).cast("int"))
    runs = raster.run_length_array(columns)
    return chips(spark, sf_dir).select("vec_id", F.array_join(F.transform(runs, lambda r: r.cast("string")), ",").alias("counts"))


def chip_resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chips(spark, sf_dir).select("vec_id", F.posexplode(raster.resample_nearest(F.col("px"), 8, 8, 4, 4)).alias("pos", "px"))


def chip_rotate_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = raster.rotate_nearest(F.col("px"), 8, 8, (F.col("vec_id") % 4) * 90)
    return chips(spark, sf_dir).select("vec_id", F.posexplode(turned).alias("pos", "px"))


def band_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips read as four bands of 16 pixels, with the bands of a pixel together and in reverse."""
    return chips(spark, sf_dir).select("vec_id", F.posexplode(raster.bands_last(F.col("px"), 4, 16, reverse=True)).alias("pos", "px"))


def valid_pixel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chips(spark, sf_dir).select("vec_id", dataset.nonzero_ratio(F.filter("px", lambda p: p >= 0)).alias("ratio"))


def grid_clip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips, less 76 and 0 at least, as windows of a grid 20 wide; kept if at least 95 % of their pixels are not zero."""
    dark = F.transform("px", lambda p: F.greatest(p - 76, F.lit(0)))
    w = chips(spark, sf_dir).select("vec_id", F.expr("vec_id div 20").alias("y"), dark.alias("px"))
    kept = w.where(dataset.nonzero_ratio(F.col("px")) >= 0.95)
    return raster.grid_names(w.drop("px"), kept, "vec_id", "y", "vec_id", "clip").select("vec_id", "name")


def gray_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.histogram(chips(spark, sf_dir), "vec_id", "px")


def histogram_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = chips(spark, sf_dir).select("vec_id", F.posexplode(raster.histogram_vector(F.col("px"))).alias("bin", "n"))
    return v.select("vec_id", "bin", F.col("n").cast("long").alias("n"))


def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("px", lambda p: p.cast("double"))
    return chips(spark, sf_dir).select("vec_id", F.posexplode(raster.l2_normalise(v)).alias("pos", "x")).withColumn("x", F.round("x", 9))


def folder_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of each folder in order; rows join the small table of folders."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    folders = d.select("source").distinct().withColumn("label", F.dense_rank().over(Window.orderBy("source")) - 1)
    return d.join(folders, "source").select("doc_id", "label")


def polygon_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of a triangle in each feature's box, whole and cut to the lower half of the box, and whether it has the centre."""
    f = features(spark, sf_dir)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = map(F.col, BOX)
    ring = F.array(point(x0, y0), point(x1, y0), point((x0 + x1) / 2, y1))
    cut = raster.clip_ring(F.col("ring"), [x0, y0, x1, (y0 + y1) / 2])
    f = f.withColumn("ring", ring)
    return f.select(
        "fid", F.round(ring_area(F.col("ring")), 6).alias("area"), F.round(ring_area(cut), 6).alias("cut"), ring_contains(F.col("ring"), (x0 + x1) / 2, (y0 + y1) / 2).alias("has_centre")
    )


QUERIES = {
    f.__name__: f
    for f in (
        raster_mask_apply, rasterize_binary, rasterize_multiclass, mask_rle, mask_rle_text, chip_resample_nearest, chip_rotate_nearest, band_reorder,
        valid_pixel_ratio, grid_clip_names, gray_histogram, histogram_vectors, l2_normalize, folder_labels, polygon_clip,
    )
}

_CELLS = """grid AS (SELECT r AS "row", c AS col, r * 10 + 5e0 AS cy, c * 10 + 5e0 AS cx FROM (SELECT unnest(range(100)) AS r), (SELECT unnest(range(100)) AS c))"""
_IN = "cx >= xmin AND cx < xmax AND cy >= ymin AND cy < ymax"
_RUNS = """flags AS (SELECT vec_id, pos % 8 * 8 + pos // 8 AS o, CAST(px > 128 AS INTEGER) AS flag FROM pixels),
changes AS (SELECT *, coalesce(CAST(flag <> lag(flag) OVER (PARTITION BY vec_id ORDER BY o) AS INTEGER), flag) AS change FROM flags),
numbered AS (SELECT vec_id, sum(change) OVER (PARTITION BY vec_id ORDER BY o) AS run FROM changes),
runs AS (SELECT vec_id, CAST(run AS BIGINT) AS run, count(*) AS length FROM numbered GROUP BY vec_id, run
         UNION ALL SELECT vec_id, 0, 0 FROM flags WHERE o = 0 AND flag = 1)"""
_TURN = {0: "pos", 1: "pos % 8 * 8 + 7 - pos // 8", 2: "63 - pos", 3: "(7 - pos % 8) * 8 + pos // 8"}

SQL = {
    "raster_mask_apply": query("SELECT vec_id, CAST(pos AS INTEGER) AS pos, CASE WHEN px > 128 THEN px ELSE 0 END AS px FROM pixels", PIXELS),
    "rasterize_binary": query(f'SELECT "row", col, CAST(EXISTS (SELECT 1 FROM features WHERE {_IN}) AS INTEGER) AS value FROM grid', FEATURES, _CELLS),
    "rasterize_multiclass": query(
        f"""SELECT "row", col, coalesce(max_by(CASE cls WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 WHEN 'Brand#13' THEN 3 ELSE 4 END, fid) FILTER (fid IS NOT NULL), 0) AS value
        FROM grid LEFT JOIN features ON {_IN} GROUP BY "row", col""", FEATURES, _CELLS),
    "mask_rle": query("SELECT vec_id, run, length FROM runs", PIXELS, _RUNS),
    "mask_rle_text": query("SELECT vec_id, string_agg(length, ',' ORDER BY run) AS counts FROM runs GROUP BY vec_id", PIXELS, _RUNS),
    "chip_resample_nearest": query(
        """SELECT vec_id, CAST((pos // 8 - 1) // 2 * 4 + (pos % 8 - 1) // 2 AS INTEGER) AS pos, px FROM pixels WHERE pos // 8 % 2 = 1 AND pos % 8 % 2 = 1""", PIXELS),
    "chip_rotate_nearest": query(
        """SELECT d.vec_id, CAST(d.pos AS INTEGER) AS pos, s.px FROM (SELECT vec_id, pos, CASE vec_id % 4 WHEN 0 THEN pos WHEN 1 THEN pos % 8 * 8 + 7 - pos // 8 WHEN 2 THEN 63 - pos ELSE (7 - pos % 8) * 8 + pos // 8 END AS src FROM pixels) d
        JOIN pixels s ON s.vec_id = d.vec_id AND s.pos = d.src""", PIXELS),
    "band_reorder": query("SELECT vec_id, CAST(pos % 16 * 4 + 3 - pos // 16 AS INTEGER) AS pos, px FROM pixels", PIXELS),
    "valid_pixel_ratio": query("SELECT vec_id, avg(CASE WHEN px <> 0 THEN 1e0 ELSE 0e0 END) AS ratio FROM pixels GROUP BY vec_id", PIXELS),
    "grid_clip_names": query(
        """SELECT vec_id, 'clip_' || y || '_' || (row_number() OVER (PARTITION BY y ORDER BY vec_id) - 1) || '.tif' AS name
        FROM (SELECT vec_id, vec_id // 20 AS y FROM pixels GROUP BY vec_id HAVING avg(CASE WHEN px > 76 THEN 1e0 ELSE 0e0 END) >= 0.95e0)""", PIXELS),
    "gray_histogram": query("SELECT vec_id, px AS bin, count(*) AS n FROM pixels GROUP BY vec_id, px", PIXELS),
    "histogram_vectors": query(
        """SELECT v.vec_id, CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT vec_id FROM embeddings) v, (SELECT unnest(range(256)) AS b)
        LEFT JOIN (SELECT vec_id, px, count(*) AS n FROM pixels GROUP BY vec_id, px) h ON h.vec_id = v.vec_id AND h.px = b""", PIXELS),
    "l2_normalize": query("SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(px / sqrt(sum(px * CAST(px AS DOUBLE)) OVER (PARTITION BY vec_id)), 9) AS x FROM pixels", PIXELS),
    "folder_labels": "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label FROM documents",
    "polygon_clip": query("SELECT fid, round((xmax - xmin) * (ymax - ymin) / 2, 6) AS area, round((xmax - xmin) * (ymax - ymin) * 3 / 8, 6) AS cut, true AS has_centre FROM features", FEATURES),
}
