"""Queries on windows, features and sample sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import crs
from tessella.functions.geometry import apply_affine, box_ring, inverse_affine, overlaps
from tessella.operators import dataset, raster, spatial, windows
from tessella.storage import materialise
from tessella.plans.views import BOX, EXTENT, FEATURES, GEO_POINTS, PIXELS, WINDOWS, ZONES, chips, features, geo_points, query, table, zones

SIZE, STEP = (100.0, 100.0), (90.0, 90.0)
WBOX, ZBOX = ["left", "bottom", "right", "top"], ["zxmin", "zymin", "zxmax", "zymax"]
CODES = {"Brand#11": 1, "Brand#12": 2, "Brand#13": 3}
_CASE = "CASE cls WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 WHEN 'Brand#13' THEN 3 ELSE 0 END"
_RECTS = 'rects AS (SELECT win_no, "row", col, x AS "left", y AS bottom, x + 100e0 AS "right", y + 100e0 AS top FROM windows)'
_MEET = 'xmin <= "right" AND xmax >= "left" AND ymin <= top AND ymax >= bottom'


def _windows(spark: SparkSession) -> DataFrame:
    return windows.sliding_windows(spark, EXTENT, SIZE, STEP)


def _rects(spark: SparkSession) -> DataFrame:
    return windows.rectangles(_windows(spark), SIZE)


def flagship_sample_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines of the windows that have features and a chip of at least half non-zero pixels; names count all candidates."""
    hit = spatial.with_any_overlap(_rects(spark), features(spark, sf_dir), WBOX, BOX, SIZE[0], "win_no")
    kept = dataset.keep_valid(hit.withColumn("chip_id", F.col("win_no")), chips(spark, sf_dir).withColumnRenamed("vec_id", "chip_id"), EXTENT)
    name = F.concat(F.lit("sample_"), F.col("win_no").cast("string"), F.lit(".tif"))
    return kept.select("win_no", F.bround("ratio", 6).alias("ratio"), dataset.manifest_lines(F.concat(F.lit("images/"), name), F.concat(F.lit("labels/"), name)).alias("line"))


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark)


def sliding_windows_per_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.zone_windows(zones(spark, sf_dir), ZBOX, (80.0, 80.0), (60.0, 60.0), ["zid"])


def spot_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.centred_windows(features(spark, sf_dir), BOX, SIZE, ["fid"])


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rectangles(spot_windows(spark, sf_dir), SIZE)


def dither_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.shifted(_spots(spark, sf_dir), "fid")


def rotate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.turned(_spots(spark, sf_dir), "fid")
    return out.select("fid", "angle", *[F.bround(f"{a}{i}", 6).alias(f"{a}{i}") for i in range(1, 5) for a in "xy"])


def train_aug_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training features (not in the validation list) with their planned copies."""
    f = features(spark, sf_dir)
    held = f.where("fid % 10 = 0").select("fid")
    return windows.training_plan(f.join(held, "fid", "left_anti"), "fid")


def rect_bounds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = _spots(spark, sf_dir)
    left, bottom, right, top = EXTENT
    return box.where((F.col("left") >= left) & (F.col("right") <= right) & (F.col("top") <= top) & (F.col("bottom") >= bottom))


def bbox_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where(overlaps([F.col(c) for c in BOX], (100, 200, 300, 450)))


def attr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where((F.col("cls") == "Brand#22") & (F.col("xmax") - F.col("xmin") > 5)).select("fid", "cls")


def in_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).where(F.col("cls").isin(list(CODES))).select("fid", "cls")


def null_geom_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    geom = F.when(F.col("fid") % 7 != 0, box_ring([F.col(c) for c in BOX]))
    return features(spark, sf_dir).withColumn("geom", geom).where(F.col("geom").isNotNull()).select("fid", F.size("geom").cast("long").alias("n_points"))


def window_feature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.join_overlapping(_rects(spark), features(spark, sf_dir), WBOX, BOX, SIZE[0]).select("win_no", "fid")


def window_feature_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.with_any_overlap(_rects(spark), features(spark, sf_dir), WBOX, BOX, SIZE[0], "win_no").select("win_no")


def window_in_zone_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.within_any(_spots(spark, sf_dir), zones(spark, sf_dir), WBOX, ZBOX, 200.0, "fid").select("fid")


def named_zone_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.within_any(_spots(spark, sf_dir), zones(spark, sf_dir).where(F.col("rkey").isin(1, 3)), WBOX, ZBOX, 200.0, "fid").select("fid")


def stack_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three sources has in each window, in the order of the sources."""
    w = _rects(spark)
    zone = spatial.join_overlapping(w, zones(spark, sf_dir), WBOX, ZBOX, 200.0).select("win_no", F.lit(1).alias("src_idx"), F.col("zid").cast("long").alias("item"))
    feature = window_feature_join(spark, sf_dir).select("win_no", F.lit(0).alias("src_idx"), F.col("fid").alias("item"))
    chip = w.join(chips(spark, sf_dir), w["win_no"] == F.col("vec_id")).select("win_no", F.lit(2).alias("src_idx"), F.col("vec_id").alias("item"))
    return feature.unionByName(zone).unionByName(chip)


def class_code_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.class_codes(features(spark, sf_dir), "cls", CODES).select("fid", "cls", "code")


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.annotate(_rects(spark), features(spark, sf_dir), WBOX, BOX, SIZE[0])


def coco_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _annotated(spark, sf_dir).select("win_no").distinct()
    name = F.concat(F.lit("image_"), F.col("win_no").cast("string"), F.lit(".tif"))
    return dataset.number_rows(used, ["win_no"], "id").select("id", "win_no", name.alias("file_name"), F.lit(100).alias("height"), F.lit(100).alias("width"))


def coco_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.categories(features(spark, sf_dir), "cls")


def coco_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = coco_categories(spark, sf_dir).select(F.col("id").alias("category_id"), F.col("name").alias("cls"))
    numbered = dataset.number_rows(_annotated(spark, sf_dir), ["win_no", "fid"], "id")
    known = F.when(F.col("category_id").isNull(), F.raise_error(F.concat(F.lit("no category is called "), F.col("cls"))).cast("long")).otherwise(F.col("category_id"))
    return numbered.join(F.broadcast(cats), "cls", "left").select(  # a row for each class
        "id", "win_no", "fid", known.alias("category_id"), "area", *[dataset.around(F.col(c), 1).alias(c) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")], F.lit(0).alias("iscrowd")
    )


def coco_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with masks of 100 x 100 pixels, read again: names, and sums over the annotations of each image."""
    images = materialise(coco_images(spark, sf_dir)).withColumnRenamed("id", "image_id")
    ring = F.transform(box_ring([F.col(c) for c in BOX]), lambda p: F.struct((p["x"] - F.col("left")).alias("x"), (F.col("top") - p["y"]).alias("y")))
    rings = features(spark, sf_dir).join(coco_annotations(spark, sf_dir), "fid").join(_rects(spark).select("win_no", "left", "top"), "win_no")
    marks = rings.withColumns({"counts": raster.ring_rle(ring, 100, 100), "mask_height": F.lit(100), "mask_width": F.lit(100)})
    marks = marks.join(images.select("image_id", "win_no"), "win_no")
    documents = dataset.coco_document(images, marks, coco_categories(spark, sf_dir))
    entry = "struct<id: bigint, image_id: bigint, category_id: bigint, segmentation: struct<counts: array<bigint>, size: array<int>>, area: double, bbox: array<double>>"
    schema = f"images array<struct<id: bigint, file_name: string, height: int, width: int>>, annotations array<{entry}>, categories array<struct<id: bigint, name: string>>"
    d = documents.select("image_id", F.from_json("document", schema).alias("d")).select("image_id", F.col("d.images")[0]["file_name"].alias("file_name"), "d.annotations", F.size("d.categories").alias("n_categories"))
    ones = F.transform(F.col("a.segmentation.counts"), lambda c, i: F.when(i % 2 == 1, c).otherwise(F.lit(0)))
    flat = d.select("image_id", "file_name", F.col("n_categories").cast("long").alias("n_categories"), F.explode("annotations").alias("a"))
    flat = flat.withColumns({"ones": F.aggregate(ones, F.lit(0).cast("long"), lambda s, x: s + x), "all": F.aggregate("a.segmentation.counts", F.lit(0).cast("long"), lambda s, x: s + x)})
    return flat.groupBy("image_id", "file_name", "n_categories").agg(
        F.count("*").alias("n_annotations"), F.round(F.sum("a.area"), 6).alias("area"), F.sum("ones").alias("mask_pixels"), F.sum("all").alias("all_pixels"), F.sum("a.category_id").alias("category_sum")
    )


def labelme_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read again: shapes of each image and sums over their corners."""
    pairs = spatial.join_overlapping(_rects(spark), features(spark, sf_dir), WBOX, BOX, SIZE[0])
    points = F.transform(box_ring([F.col(c) for c in BOX]), lambda p: F.array(p["x"] - F.col("left"), F.col("top") - p["y"]))
    documents = dataset.labelme_document(pairs.withColumn("points", points), "win_no", "cls", "points", 100, 100)
    schema = "version string, shapes array<struct<label: string, points: array<array<double>>, shape_type: string>>, imagePath string, imageHeight int, imageWidth int"
    shapes = documents.select("win_no", F.from_json("document", schema).alias("d")).select("win_no", "d.imagePath", F.explode("d.shapes").alias("s"))
    corners = shapes.select("win_no", "imagePath", "s.label", F.posexplode("s.points").alias("k", "p"))
    return corners.groupBy("win_no", F.col("imagePath").alias("image")).agg(
        F.sum((F.col("k") == 0).cast("long")).alias("n_shapes"), F.round(F.sum(F.col("p")[0]), 3).alias("x"), F.round(F.sum(F.col("p")[1]), 3).alias("y"), F.max("label").alias("last_label")
    )


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chips(spark, sf_dir).where(dataset.nonzero_ratio(F.col("px")) >= 0.5)


def manifest_csv_2col(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("chip_"), F.col("vec_id").cast("string"), F.lit(".tif"))
    return _valid(spark, sf_dir).select("vec_id", dataset.manifest_lines(F.concat(F.lit("images/"), name), F.concat(F.lit("labels/"), name)).alias("line"))


def change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips before and after, by window; pairs with a blank chip after are left out."""
    c = chips(spark, sf_dir)
    before = _valid(spark, sf_dir).where("vec_id % 2 = 0").select((F.col("vec_id") / 2).cast("long").alias("win"), F.col("vec_id").alias("before_id"))
    after = c.where("vec_id % 2 = 1").where(F.exists("px", lambda p: p != 0)).select(F.expr("vec_id div 2").alias("win"), F.col("vec_id").alias("after_id"))
    return before.join(after, "win")


def manifest_csv_3col(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [F.concat(F.lit(f"{d}/"), F.col("win").cast("string"), F.lit(".tif")) for d in ("before", "after", "labels")]
    return change_pairs(spark, sf_dir).select("win", dataset.manifest_lines(*names).alias("line"))


def crop_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affine transform of each window's crop, resampled to 50 x 50 pixels."""
    scale = SIZE[0] / 50
    return _rects(spark).select("win_no", F.lit(scale).alias("a"), F.lit(0.0).alias("b"), F.col("left").alias("c"), F.lit(0.0).alias("d"), F.lit(-scale).alias("e"), F.col("top").alias("f"))


_PIXEL = (0.5, 0.0, 100.0, 0.0, -0.5, 900.0)


def geo_to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = inverse_affine(_PIXEL, F.col("xmin"), F.col("ymax"))
    return features(spark, sf_dir).select("fid", x.alias("px"), y.alias("py"))


def geo_to_pixel_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_to_pixel(spark, sf_dir).select("fid", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"))


def pixel_to_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = apply_affine(_PIXEL, F.col("xmin"), F.col("ymax"))
    return features(spark, sf_dir).select("fid", x.alias("gx"), y.alias("gy"))


def region_reproject_mercator(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("lon"), F.col("lat")
    box = crs.reproject_box(4326, 3857, [x, y, x + 0.5, y + 0.25])
    return geo_points(spark, sf_dir).select("id", *[F.round(c, 3).alias(n) for c, n in zip(box, ("min_x", "min_y", "max_x", "max_y"))])


def layer_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def class_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship_sample_manifest, sliding_windows, sliding_windows_per_zone, spot_windows, dither_windows, rotate_windows, train_aug_plan,
        rect_bounds_filter, bbox_scan, attr_filter, in_list_filter, null_geom_filter, window_feature_join, window_feature_semi, window_in_zone_semi,
        named_zone_semi, stack_crop, class_code_join, coco_images, coco_categories, coco_annotations, coco_json, labelme_json, manifest_csv_2col,
        change_pairs, manifest_csv_3col, crop_transform, geo_to_pixel, geo_to_pixel_trunc, pixel_to_geo, region_reproject_mercator, layer_bounds,
        class_frequency,
    )
}

_SPOTS = """spots AS (SELECT fid, xmin + (xmax - xmin) / 2 - 50e0 AS "left", ymin + (ymax - ymin) / 2 - 50e0 AS bottom FROM features),
spot_rects AS (SELECT fid, "left", bottom, "left" + 100e0 AS "right", bottom + 100e0 AS top FROM spots)"""
_RATIO = "ratios AS (SELECT vec_id, avg(CASE WHEN px <> 0 THEN 1e0 ELSE 0e0 END) AS ratio, max(px) AS most FROM pixels GROUP BY vec_id)"
_MARKS = f"""marks0 AS (SELECT *, greatest(xmin, "left") - "left" AS x0, least(xmax, "right") - "left" AS x1, top - least(ymax, top) AS y0, top - greatest(ymin, bottom) AS y1
            FROM rects JOIN features ON {_MEET}),
marks AS (SELECT *, (x1 - x0) * (y1 - y0) AS part FROM marks0
          WHERE (xmin >= "left" AND xmax <= "right" AND ymin >= bottom AND ymax <= top)
             OR (x1 - x0) * (y1 - y0) / ((xmax - xmin) * (ymax - ymin)) > 0.7e0)"""
_CATS = "cats AS (SELECT row_number() OVER (ORDER BY cls) AS id, cls AS name FROM (SELECT DISTINCT cls FROM features))"


def _shift(prime: int) -> str:
    return f"([-50, -100, -150, 50, 100, 150])[fid * {prime} % 6 + 1]"


def _corner(i: int) -> str:
    sx, sy = ((-1, 1), (1, 1), (1, -1), (-1, -1))[i - 1]
    dx, dy = f"({sx * 50}e0)", f"({sy * 50}e0)"
    c, s = "cos(radians(angle))", "sin(radians(angle))"
    return f"round_even({dx} * {c} - {dy} * {s} + cx, 6) AS x{i}, round_even({dx} * {s} + {dy} * {c} + cy, 6) AS y{i}"


SQL = {
    "flagship_sample_manifest": query(
        f"""SELECT win_no, round_even(ratio, 6) AS ratio, 'images/sample_' || win_no || '.tif,labels/sample_' || win_no || '.tif' AS line
        FROM rects JOIN ratios ON vec_id = win_no WHERE ratio >= 0.5e0 AND EXISTS (SELECT 1 FROM features WHERE {_MEET})""",
        WINDOWS, _RECTS, FEATURES, PIXELS, _RATIO),
    "sliding_windows": query('SELECT win_no, "row", col, x, y FROM windows', WINDOWS),
    "sliding_windows_per_zone": query(
        """SELECT zid, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CASE WHEN c = 3 THEN zxmax - 80e0 ELSE zxmin + c * 60e0 END AS x,
        CASE WHEN r = 3 THEN zymax - 80e0 ELSE zymin + r * 60e0 END AS y FROM zones, (SELECT unnest(range(4)) AS r), (SELECT unnest(range(4)) AS c)""", ZONES),
    "spot_windows": query('SELECT fid, "left" AS x, bottom AS y FROM spots', FEATURES, _SPOTS),
    "dither_windows": query(f'SELECT fid, "left" + {_shift(7919)} AS "left", bottom + {_shift(104729)} AS bottom, "right" + {_shift(7919)} AS "right", top + {_shift(104729)} AS top FROM spot_rects', FEATURES, _SPOTS),
    "rotate_windows": query(f'SELECT fid, angle, {", ".join(map(_corner, range(1, 5)))} FROM (SELECT fid, ([30, 45, 60, 75])[fid * 7919 % 4 + 1] AS angle, ("left" + "right") / 2 AS cx, (bottom + top) / 2 AS cy FROM spot_rects)', FEATURES, _SPOTS),
    "train_aug_plan": query(
        """SELECT fid, kind, copy FROM (SELECT fid FROM features WHERE fid % 10 <> 0),
        (SELECT 'raw' AS kind, 0 AS copy UNION ALL SELECT kind, CAST(copy AS INTEGER) FROM (SELECT unnest(range(8)) AS copy), (SELECT unnest(['move', 'angle']) AS kind))""", FEATURES),
    "rect_bounds_filter": query('SELECT * FROM spot_rects WHERE "left" >= 0 AND "right" <= 1000 AND top <= 1000 AND bottom >= 0', FEATURES, _SPOTS),
    "bbox_scan": query("SELECT * FROM features WHERE xmin <= 300 AND xmax >= 100 AND ymin <= 450 AND ymax >= 200", FEATURES),
    "attr_filter": query("SELECT fid, cls FROM features WHERE cls = 'Brand#22' AND xmax - xmin > 5", FEATURES),
    "in_list_filter": query("SELECT fid, cls FROM features WHERE cls IN ('Brand#11', 'Brand#12', 'Brand#13')", FEATURES),
    "null_geom_filter": query("SELECT fid, CAST(4 AS BIGINT) AS n_points FROM features WHERE fid % 7 <> 0", FEATURES),
    "window_feature_join": query(f"SELECT win_no, fid FROM rects JOIN features ON {_MEET}", WINDOWS, _RECTS, FEATURES),
    "window_feature_semi": query(f"SELECT win_no FROM rects WHERE EXISTS (SELECT 1 FROM features WHERE {_MEET})", WINDOWS, _RECTS, FEATURES),
    "window_in_zone_semi": query('SELECT fid FROM spot_rects WHERE EXISTS (SELECT 1 FROM zones WHERE "left" >= zxmin AND "right" <= zxmax AND bottom >= zymin AND top <= zymax)', FEATURES, _SPOTS, ZONES),
    "named_zone_semi": query('SELECT fid FROM spot_rects WHERE EXISTS (SELECT 1 FROM zones WHERE rkey IN (1, 3) AND "left" >= zxmin AND "right" <= zxmax AND bottom >= zymin AND top <= zymax)', FEATURES, _SPOTS, ZONES),
    "stack_crop": query(
        f"""SELECT win_no, 0 AS src_idx, fid AS item FROM rects JOIN features ON {_MEET}
        UNION ALL SELECT win_no, 1, CAST(zid AS BIGINT) FROM rects JOIN zones ON zxmin <= "right" AND zxmax >= "left" AND zymin <= top AND zymax >= bottom
        UNION ALL SELECT win_no, 2, vec_id FROM rects JOIN embeddings ON vec_id = win_no""", WINDOWS, _RECTS, FEATURES, ZONES),
    "class_code_join": query(f"SELECT fid, cls, {_CASE} AS code FROM features", FEATURES),
    "coco_images": query("SELECT row_number() OVER (ORDER BY win_no) AS id, win_no, 'image_' || win_no || '.tif' AS file_name, 100 AS height, 100 AS width FROM (SELECT DISTINCT win_no FROM marks)", WINDOWS, _RECTS, FEATURES, _MARKS),
    "coco_categories": query("SELECT id, name FROM cats", FEATURES, _CATS),
    "coco_annotations": query(
        """SELECT row_number() OVER (ORDER BY win_no, fid) AS id, win_no, fid, (SELECT id FROM cats WHERE name = cls) AS category_id, round_even(round(part, 6) * 100e0, 0) / 100e0 AS area,
        bx0 AS bbox_x, by0 AS bbox_y, round_even(round(bx1 - bx0, 6) * 10e0, 0) / 10e0 AS bbox_w, round_even(round(by1 - by0, 6) * 10e0, 0) / 10e0 AS bbox_h, 0 AS iscrowd
        FROM (SELECT *, greatest(round_even(round(x0, 6) * 10e0, 0) / 10e0, 0e0) AS bx0, greatest(round_even(round(y0, 6) * 10e0, 0) / 10e0, 0e0) AS by0, greatest(round_even(round(x1, 6) * 10e0, 0) / 10e0, 0e0) AS bx1, greatest(round_even(round(y1, 6) * 10e0, 0) / 10e0, 0e0) AS by1 FROM marks)""",
        WINDOWS, _RECTS, FEATURES, _MARKS, _CATS),
    "coco_json": query(
        """SELECT image_id, 'image_' || win_no || '.tif' AS file_name, count(DISTINCT cls) AS n_categories, count(*) AS n_annotations, round(sum(round_even(round(part, 6) * 100e0, 0) / 100e0), 6) AS area,
        CAST(sum((ceil(x1 - 0.5e0) - ceil(x0 - 0.5e0)) * (ceil(y1 - 0.5e0) - ceil(y0 - 0.5e0))) AS BIGINT) AS mask_pixels, count(*) * 10000 AS all_pixels, CAST(sum(cats.id) AS BIGINT) AS category_sum
        FROM marks JOIN (SELECT win_no, row_number() OVER (ORDER BY win_no) AS image_id FROM (SELECT DISTINCT win_no FROM marks)) USING (win_no) JOIN cats ON name = cls GROUP BY image_id, win_no""",
        WINDOWS, _RECTS, FEATURES, _MARKS, _CATS),
    "labelme_json": query(
        f"""SELECT win_no, CAST(win_no AS VARCHAR) AS image, count(*) AS n_shapes, round(sum(2 * (xmin - "left") + 2 * (xmax - "left")), 3) AS x, round(sum(2 * (top - ymin) + 2 * (top - ymax)), 3) AS y, max(cls) AS last_label
        FROM rects JOIN features ON {_MEET} GROUP BY win_no""", WINDOWS, _RECTS, FEATURES),
    "manifest_csv_2col": query("SELECT vec_id, 'images/chip_' || vec_id || '.tif,labels/chip_' || vec_id || '.tif' AS line FROM ratios WHERE ratio >= 0.5e0", PIXELS, _RATIO),
    "change_pairs": query("SELECT b.vec_id // 2 AS win, b.vec_id AS before_id, a.vec_id AS after_id FROM ratios b JOIN ratios a ON b.vec_id % 2 = 0 AND a.vec_id = b.vec_id + 1 WHERE b.ratio >= 0.5e0 AND a.most <> 0", PIXELS, _RATIO),
    "manifest_csv_3col": query("SELECT win, 'before/' || win || '.tif,after/' || win || '.tif,labels/' || win || '.tif' AS line FROM (SELECT b.vec_id // 2 AS win FROM ratios b JOIN ratios a ON b.vec_id % 2 = 0 AND a.vec_id = b.vec_id + 1 WHERE b.ratio >= 0.5e0 AND a.most <> 0)", PIXELS, _RATIO),
    "crop_transform": query('SELECT win_no, 2e0 AS a, 0e0 AS b, "left" AS c, 0e0 AS d, -2e0 AS e, top AS f FROM rects', WINDOWS, _RECTS),
    "geo_to_pixel": query("SELECT fid, (xmin - 100) / 0.5e0 AS px, (ymax - 900) / -0.5e0 AS py FROM features", FEATURES),
    "geo_to_pixel_trunc": query("SELECT fid, CAST(trunc((xmin - 100) / 0.5e0) AS INTEGER) AS px, CAST(trunc((ymax - 900) / -0.5e0) AS INTEGER) AS py FROM features", FEATURES),
    "pixel_to_geo": query("SELECT fid, 0.5e0 * xmin + 100 AS gx, -0.5e0 * ymax + 900 AS gy FROM features", FEATURES),
    "region_reproject_mercator": query(
        """SELECT id, round(radians(lon) * 6378137e0, 3) AS min_x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137e0, 3) AS min_y,
        round(radians(lon + 0.5e0) * 6378137e0, 3) AS max_x, round(ln(tan(pi() / 4 + radians(lat + 0.25e0) / 2)) * 6378137e0, 3) AS max_y FROM geo_points""", GEO_POINTS),
    "layer_bounds": query("SELECT min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM features", FEATURES),
    "class_frequency": query("SELECT cls, count(*) AS n FROM features GROUP BY cls", FEATURES),
}
