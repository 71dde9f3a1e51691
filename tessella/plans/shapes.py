"""Queries on rings, projections, window plans and task parameters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import crs, text
from tessella.functions.geometry import box_ring, ring_area, ring_envelope, ring_in_ring, rotated_pixel_box
from tessella.operators import dataset, raster, spatial, windows
from tessella.operators import tasks as task_ops
from tessella.plans.rasters import _CELLS, CODE, _grid
from tessella.plans.sampling import _RECTS, SIZE, WBOX, ZBOX, _rects
from tessella.plans.views import BOX, EXTENT, FEATURES, PIXELS, TASKS, WINDOWS, ZONES, chips, features, query, table, tasks, zones
from tessella.sources.datasource import look_up_documents

#: Half the diagonal of a zone's diamond; no corner of a feature lies on an edge.
REACH = 90.03


def _triangle():
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = map(F.col, BOX)
    return F.array(point(x0, y0), point(x1, y0), point((x0 + x1) / 2, y1))


def ring_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of feature boxes, as degrees, in web Mercator and back."""
    degrees = [F.col(c) / 10 - 50 for c in BOX]
    ring = crs.reproject_ring(4326, 3857, box_ring(degrees))
    back = crs.reproject_ring(3857, 4326, ring)
    both = F.arrays_zip(ring.alias("there"), back.alias("back"))
    f = features(spark, sf_dir).select("fid", F.posexplode(both).alias("k", "p"))
    return f.select("fid", "k", F.round("p.there.x", 3).alias("x"), F.round("p.there.y", 3).alias("y"), F.round("p.back.x", 6).alias("lon"), F.round("p.back.y", 6).alias("lat"))


def raster_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips of half-degree pixels in web Mercator."""
    left, top = F.col("vec_id") % 100 - 50.0, F.col("vec_id") % 60 + 0.0
    zero = F.lit(0.0)
    px, _ = raster.reproject_nearest(F.col("px"), 8, 8, [F.lit(0.5), zero, left, zero, F.lit(-0.5), top], 4326, 3857)
    return chips(spark, sf_dir).select("vec_id", F.posexplode(px).alias("pos", "px"))


def rasterize_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = features(spark, sf_dir).select("fid", F.expr(CODE).alias("code"), _triangle().alias("ring"))
    return raster.rasterize_rings(_grid(spark), shapes, "ring", 10.0, "fid", "code")


def ring_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with more than 0.7 of their ring in a window, and the area there."""
    pairs = spatial.join_overlapping(_rects(spark), features(spark, sf_dir), WBOX, BOX, SIZE[0])
    ring = box_ring([F.col(c) for c in BOX])
    pairs = pairs.select("win_no", "fid", ring_area(raster.clip_ring(ring, [F.col(c) for c in WBOX])).alias("part"), ring_area(ring).alias("whole"))
    return pairs.where(F.round(F.col("part") / F.col("whole"), 9) > 0.7).select("win_no", "fid", F.round("part", 6).alias("area"))


def features_in_diamonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose ring lies in the diamond about a zone's centre."""
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    cx, cy = (F.col("zxmin") + F.col("zxmax")) / 2, (F.col("zymin") + F.col("zymax")) / 2
    diamond = F.array(point(cx, cy + REACH), point(cx + REACH, cy), point(cx, cy - REACH), point(cx - REACH, cy))
    pairs = spatial.join_overlapping(features(spark, sf_dir), zones(spark, sf_dir).withColumn("diamond", diamond), BOX, ZBOX, 200.0)
    return pairs.where(ring_in_ring(box_ring([F.col(c) for c in BOX]), F.col("diamond"))).select("fid", "zid")


def window_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 100 x 100 pixels of 1 unit every 90, shifted, inside the extent and in a zone of regions 0 to 3 or across."""
    wide = zones(spark, sf_dir).groupBy("rkey").agg(*[f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), ZBOX)])
    out = windows.sample_windows(spark, EXTENT, (100, 100), (1.0, -1.0), (90, 90), move=True, zones=wide, zone_box=ZBOX)
    return out.select("win_no", "left", "bottom", "right", "top")


def validation_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = features(spark, sf_dir).where("fid % 10 = 0")
    return windows.validation_plan(spark, held, BOX, "fid", EXTENT, SIZE, (90.0, 90.0))


def manifest_with_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines and lines of a manifest, numbered."""
    names = [r["cls"] for r in features(spark, sf_dir).select("cls").distinct().orderBy("cls").collect()]  # a row for each class
    header = dataset.manifest_header({n: i for i, n in enumerate(names, 1)}, "2024-01-01")
    head = spark.createDataFrame([(i - len(header), line) for i, line in enumerate(header)], "nth long, line string")
    lines = features(spark, sf_dir).select(F.col("fid").alias("nth"), dataset.manifest_lines(F.concat(F.lit("images/"), "fid"), F.concat(F.lit("labels/"), "cls")).alias("line"))
    return head.unionByName(lines)


def rotated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pixels around features turned by their number."""
    w, h = rotated_pixel_box(F.col("ymax") - F.col("ymin") + 0.3, F.col("xmax") - F.col("xmin") + 0.6, F.col("fid") % 90)
    return features(spark, sf_dir).select("fid", w.alias("w"), h.alias("h"))


def ring_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir).select("fid", _triangle().alias("ring"))
    return f.select("fid", *[c.alias(n) for c, n in zip(ring_envelope(F.col("ring")), BOX)])


def valid_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which event values, in tenths, are whole percents."""
    value = F.round("value", 1)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(task_ops.valid_progress(value), F.lit(False)).alias("valid"))


def parsed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of command lines; every fifth is None."""
    line = F.when(F.col("c_custkey") % 5 == 0, "None").otherwise(F.concat(F.col("c_name"), F.lit(","), F.col("c_mktsegment")))
    parts = text.parse_list(F.col("line"))
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("line")).select("c_custkey", F.size(F.coalesce(parts, F.array())).alias("n"), parts[1].alias("second"))


def hidden_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters as users see them: of an uploaded file only its first part."""
    raw = F.create_map(F.lit("file"), F.concat(F.lit('["/up/'), F.col("id").cast("string"), F.lit('.tif","shown"]')), F.lit("kind"), F.lit('"x"'), F.lit("three"), F.lit("[1,2,3]"))
    shown = task_ops.without_uploads(raw)
    return tasks(spark, sf_dir).select("id", F.element_at(shown, "file").alias("file"), F.element_at(shown, "kind").alias("kind"), F.element_at(shown, "three").alias("three"))


def task_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by service; one kind has none."""
    services = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("tasktype")).distinct().where("tasktype <> '5-LOW'").withColumn("service", F.concat(F.lit("run_"), F.lower("tasktype")))
    return task_ops.with_services(tasks(spark, sf_dir), services).groupBy("tasktype", "service", "known").agg(F.count("*").alias("n"))


def unfinished_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand tasks to be queued again, by their order."""
    back = task_ops.reset_unfinished(tasks(spark, sf_dir), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).limit(1000)
    return back.select("id", "status", "progress", "createtime")


def matching_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some fields of the documents that match, after a function over the result."""
    d = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "_id")
    return look_up_documents(d, F.col("lang") == "en", ["source", "n_chars"], lambda x: x.withColumn("n_chars", F.col("n_chars") * 2)).withColumnRenamed("_id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        ring_reproject, raster_reproject, rasterize_triangles, ring_cover, features_in_diamonds, window_pipeline, validation_plan, manifest_with_header, rotated_boxes,
        ring_envelopes, valid_progress, parsed_lists, hidden_uploads, task_services, unfinished_tasks, matching_documents,
    )
}

_R = crs.RADIUS
_MERC = lambda lat: f"ln(tan(pi() / 4 + radians({lat}) / 2)) * {_R}e0".replace(".0e0", "e0")
_SPOTS = """spots AS (SELECT fid, xmin + (xmax - xmin) / 2 - 50e0 AS "left", ymin + (ymax - ymin) / 2 - 50e0 AS bottom FROM features)"""
_SHIFT = "([-50, -100, -150, 50, 100, 150])[win_no * {} % 6 + 1]"

SQL = {
    "ring_reproject": query(
        f"""SELECT fid, CAST(k AS INTEGER) AS k, round(radians(x) * {int(_R)}e0, 3) AS x, round({_MERC("y")}, 3) AS y, round(x, 6) AS lon, round(y, 6) AS lat FROM
        (SELECT fid, k, (CASE WHEN k IN (0, 3) THEN xmin ELSE xmax END) / 10 - 50 AS x, (CASE WHEN k IN (0, 1) THEN ymax ELSE ymin END) / 10 - 50 AS y FROM features, (SELECT unnest(range(4)) AS k))""", FEATURES),
    "raster_reproject": query(
        """SELECT d.vec_id, CAST(d.pos AS INTEGER) AS pos, coalesce(s.px, 0) AS px FROM
        (SELECT vec_id, pos, pos % 8 AS col, CAST(floor((degrees(2 * atan(exp((y1 - (pos // 8 + 0.5e0) * (y1 - y0) / 8) / radius)) - pi() / 2) - top) / -0.5e0) AS BIGINT) AS r FROM spans, (SELECT unnest(range(64)) AS pos)) d
        LEFT JOIN pixels s ON s.vec_id = d.vec_id AND d.r BETWEEN 0 AND 7 AND s.pos = d.r * 8 + d.col""", PIXELS,
        f"spans AS (SELECT vec_id, vec_id % 60 AS top, {_MERC('(vec_id % 60)')} AS y1, {_MERC('(vec_id % 60 - 4)')} AS y0, {int(_R)}e0 AS radius FROM embeddings)"),
    "rasterize_triangles": query(
        f"""SELECT "row", col, coalesce(max_by({CODE}, fid) FILTER (fid IS NOT NULL), 0) AS value FROM grid LEFT JOIN
        (SELECT fid, cls, xmin, ymin, xmax, ymax, (xmin + xmax) / 2 AS xm FROM features) ON cx >= xmin AND cx <= xmax AND cy >= ymin AND cy <= ymax
        AND (CAST((ymin > cy) <> (ymax > cy) AND cx < (xm - xmax) * (cy - ymin) / (ymax - ymin) + xmax AS INTEGER)
           + CAST((ymax > cy) <> (ymin > cy) AND cx < (xmin - xm) * (cy - ymax) / (ymin - ymax) + xm AS INTEGER)) % 2 = 1 GROUP BY "row", col""", FEATURES, _CELLS),
    "ring_cover": query(
        """SELECT win_no, fid, round(part, 6) AS area FROM (SELECT win_no, fid, (least(xmax, "right") - greatest(xmin, "left")) * (least(ymax, top) - greatest(ymin, bottom)) AS part, (xmax - xmin) * (ymax - ymin) AS whole
        FROM rects JOIN features ON xmin <= "right" AND xmax >= "left" AND ymin <= top AND ymax >= bottom) WHERE round(part / whole, 9) > 0.7e0""", WINDOWS, _RECTS, FEATURES),
    "features_in_diamonds": query(
        f"""SELECT fid, zid FROM features JOIN zones ON greatest(abs(xmin - (zxmin + zxmax) / 2), abs(xmax - (zxmin + zxmax) / 2)) + greatest(abs(ymin - (zymin + zymax) / 2), abs(ymax - (zymin + zymax) / 2)) < {REACH}e0""",
        FEATURES, ZONES),
    "window_pipeline": query(
        f"""SELECT * FROM (SELECT win_no, x + dx AS "left", y + dy AS bottom, x + dx + 100 AS "right", y + dy + 100 AS top FROM (SELECT win_no, x, y, {_SHIFT.format(7919)} AS dx, {_SHIFT.format(104729)} AS dy FROM windows)) w
        WHERE "left" >= 0 AND bottom >= 0 AND "right" <= 1000 AND top <= 1000 AND EXISTS
        (SELECT 1 FROM (SELECT rkey, min(zxmin) AS a, min(zymin) AS b, max(zxmax) AS c, max(zymax) AS d FROM zones GROUP BY rkey) WHERE "left" >= a AND bottom >= b AND "right" <= c AND top <= d)""", WINDOWS, ZONES),
    "validation_plan": query(
        """SELECT 'val' AS kind, win_no AS fid, x AS "left", y AS bottom, x + 100 AS "right", y + 100 AS top FROM windows
        UNION ALL SELECT 'val2', fid, "left", bottom, "left" + 100, bottom + 100 FROM spots WHERE fid % 10 = 0""", WINDOWS, FEATURES, _SPOTS),
    "manifest_with_header": query(
        """SELECT CAST(-2 AS BIGINT) AS nth, '#,version,1.0,data_creator,2024-01-01' AS line
        UNION ALL SELECT -1, string_agg(',' || cls || ',' || n, '' ORDER BY cls) FROM (SELECT cls, row_number() OVER (ORDER BY cls) AS n FROM (SELECT DISTINCT cls FROM features))
        UNION ALL SELECT fid, 'images/' || fid || ',labels/' || cls FROM features""", FEATURES),
    "rotated_boxes": query(
        """SELECT fid, CAST(trunc(h * abs(sin(radians(fid % 90))) + w * abs(cos(radians(fid % 90)))) AS INTEGER) AS w, CAST(trunc(h * abs(cos(radians(fid % 90))) + w * abs(sin(radians(fid % 90)))) AS INTEGER) AS h
        FROM (SELECT fid, ymax - ymin + 0.3e0 AS h, xmax - xmin + 0.6e0 AS w FROM features)""", FEATURES),
    "ring_envelopes": query("SELECT fid, xmin, ymin, xmax, ymax FROM features", FEATURES),
    "valid_progress": "SELECT event_id, coalesce(round(value, 1) = trunc(round(value, 1)) AND round(value, 1) BETWEEN 0 AND 100, false) AS valid FROM events",
    "parsed_lists": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS second FROM customer",
    "hidden_uploads": query("""SELECT id, '/up/' || id || '.tif' AS file, '"x"' AS kind, '[1,2,3]' AS three FROM tasks""", TASKS),
    "task_services": query("SELECT tasktype, CASE WHEN tasktype <> '5-LOW' THEN 'run_' || lower(tasktype) END AS service, tasktype <> '5-LOW' AS known, count(*) AS n FROM tasks GROUP BY ALL", TASKS),
    "unfinished_tasks": query("SELECT id, 0 AS status, 0 AS progress, TIMESTAMP '2024-01-01 00:00:00' AS createtime FROM tasks WHERE status IN (0, 3) ORDER BY id LIMIT 1000", TASKS),
    "matching_documents": "SELECT doc_id, source, n_chars * 2 AS n_chars FROM documents WHERE lang = 'en'",
}
