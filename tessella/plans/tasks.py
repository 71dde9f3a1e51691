"""Queries on tasks, settings, tiles and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.client.errors import Delays
from tessella.functions import text, tiles
from tessella.functions.tiles import TILE_QUERY
from tessella.operators import raster
from tessella.operators import tasks as ops
from tessella.plans.views import GEO_POINTS, TASKS, geo_points, query, table, task_events, tasks

ZOOM, GAP = 12, 6 * 3600
NOW = "2024-01-01 00:00:00"


def task_page_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page(tasks(spark, sf_dir), 3, 50)


def task_page_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page(tasks(spark, sf_dir), 2, 25, ops.DONE)


def task_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).where("id = 42").limit(1)


def page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.page_info(tasks(spark, sf_dir), 30)


def task_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.reset_unfinished(tasks(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))


KIND = "CASE WHEN event_id % 5 IN (0, 1) THEN 'start' WHEN event_id % 5 = 2 THEN 'finish' WHEN event_id % 5 = 3 THEN 'fail' ELSE 'stop' END"


def task_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fold_states(task_events(spark, sf_dir).withColumn("kind", F.expr(KIND)), "task", ["ts", "event_id"], "kind")


def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.throttle(task_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "task", "ts", ["event_id"], GAP)


def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(500).select(F.col("id").alias("num"))
    return rows.withColumn("percent", F.round(ops.progress_percent(F.col("num"), F.lit(500), 0.5, 0.5), 6))


def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as local settings, suppliers over them as remote ones."""
    local = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    remote = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    return ops.overlay(local, remote, "key", "value")


def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the old settings and customers, under twice their key, as the new; half of the shared ones are equal."""
    old = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % 5).cast("string").alias("value"))
    new = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("key"), (F.col("c_custkey") * 2 % 10).cast("string").alias("value"))
    return ops.changes(old, new, "key", "value")


def download_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output parameters of tasks as addresses, as text."""
    raw = F.concat(F.lit('{"mask":"/cache/out/mask_'), F.col("id").cast("string"), F.lit('.tif","file_list":"x","shape":"/cache/out/shape.shp"}'))
    params = F.from_json(raw, "map<string,string>")
    urls = ops.download_urls(params, F.concat(F.lit("http://host/out/"), F.col("id").cast("string")))
    return tasks(spark, sf_dir).select("id", F.to_json(urls).alias("params"))


def params_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = F.create_map(F.lit("tasktype"), F.col("tasktype"))
    outputs = F.create_map(F.lit("status"), F.col("status").cast("string"), F.lit("tasktype"), F.lit("other"))
    found = [ops.look_up_params(inputs, outputs, k).alias(n) for k, n in (("tasktype", "a"), ("status", "b"), ("absent", "c"))]
    return tasks(spark, sf_dir).select("id", *found)


def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the query part of page addresses."""
    q = F.regexp_replace(F.regexp_extract("url", r"\?([^#]*)", 1), "&", ", ")
    return table(spark, sf_dir, "pages").select("page_id", F.explode(text.parse_pairs(q)).alias("name", "value"))


def cli_dict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options `k:v,k:v` from event properties, and `None`."""
    option = F.when(F.col("event_id") % 10 == 0, "None").otherwise(F.regexp_replace("props", '[{}" ]', ""))
    rows = table(spark, sf_dir, "events").select("event_id", text.none_to_null(option).alias("o"))
    return rows.select("event_id", F.explode_outer(text.parse_pairs(F.col("o"), ",", ":")).alias("name", "value"))


def filename_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/"), F.col("url"), F.lit(".v"), F.col("page_id").cast("string"), F.lit(".TIF"))
    return table(spark, sf_dir, "pages").select(
        "page_id", text.basename(path).alias("base"), text.stem(path).alias("stem"), text.suffix(path).alias("ext"), text.allowed_extension(path, ["tif", "shp"]).alias("allowed")
    )


def date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks(spark, sf_dir).select("id", F.date_format("createtime", "yyyy-MM-dd HH:mm:ss").alias("created"))


def hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.md5(F.col("c_name").cast("binary")).alias("hash"), text.cache_key(F.col("c_mktsegment"), F.col("c_name")).alias("cache_key"))


def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest delay before each further attempt, with base 5 and at most 1200 seconds."""
    wait = Delays(5.0, 1200.0, jitter=False)
    return spark.createDataFrame([(n, wait(n)) for n in range(1, 11)], "attempt long, delay double")


def tile_rowcol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_points(spark, sf_dir).select("id", tiles.tile_row(F.col("lat"), ZOOM).alias("row"), tiles.tile_col(F.col("lon"), ZOOM).alias("col"))


def tile_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = tiles.tile_extent(F.col("row"), F.col("col"), ZOOM)
    return tile_rowcol(spark, sf_dir).select("id", *[F.round(c, 9).alias(n) for c, n in zip(box, ("min_x", "min_y", "max_x", "max_y"))])


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tiles of a small extent at each point; extents turned about give none."""
    lon, lat = F.col("lon"), F.col("lat")
    p = geo_points(spark, sf_dir).withColumn("right", F.when(F.col("id") % 11 == 0, lon - 0.1).otherwise(lon + 0.1)).withColumn("low", lat - 0.1)
    p = p.where((F.col("right") >= lon) & (F.col("low") <= lat))
    rows = F.sequence(tiles.tile_row(lat, ZOOM), tiles.tile_row(F.col("low"), ZOOM))
    cols = F.sequence(tiles.tile_col(lon, ZOOM), tiles.tile_col(F.col("right"), ZOOM))
    return p.select("id", F.explode(rows).alias("row"), cols.alias("cols")).select("id", "row", F.explode("cols").alias("col"))


def tile_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select("id", "row", "col", tiles.tile_url(F.lit("http://tiles.example.org/wmts"), ZOOM, F.col("col"), F.col("row")).alias("url"))


def tile_mosaic_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.mosaic(_tiles(spark, sf_dir), ["id"])


QUERIES = {
    f.__name__: f
    for f in (
        task_page_desc, task_page_by_status, task_by_id, page_info, task_reset, task_state_fold, progress_throttle, progress_percent, config_overlay,
        config_diff, download_params, params_lookup, header_parse, cli_dict_parse, filename_parts, date_text, hash_keys, retry_delays, tile_rowcol,
        tile_extent, tile_urls, tile_mosaic_layout,
    )
}


def _row(lat: str) -> str:
    return f"CAST(trunc((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * 4096) AS BIGINT)"


def _col(lon: str) -> str:
    return f"CAST(trunc(({lon} + 180) / 360 * 4096) AS BIGINT)"


_ROWCOL = f"rc AS (SELECT id, {_row('lat')} AS r, {_col('lon')} AS c FROM geo_points)"
_TILES = f"""spans AS (SELECT id, {_row('lat')} AS r0, {_row('(lat - 0.1e0)')} AS r1, {_col('lon')} AS c0, {_col('(lon + 0.1e0)')} AS c1 FROM geo_points WHERE id % 11 <> 0),
tiles AS (SELECT id, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM spans))"""
_LAT = "degrees(atan((exp({0}) - exp(-({0}))) / 2))"
_KINDS = f"k AS (SELECT user_id AS task, ts, event_id, {KIND} AS kind FROM events)"

SQL = {
    "task_page_desc": query("SELECT * FROM tasks ORDER BY id DESC LIMIT 50 OFFSET 100", TASKS),
    "task_page_by_status": query("SELECT * FROM tasks WHERE status = 1 ORDER BY id DESC LIMIT 25 OFFSET 25", TASKS),
    "task_by_id": query("SELECT * FROM tasks WHERE id = 42", TASKS),
    "page_info": query("SELECT count(*) AS total, CAST(ceil(count(*) / 30) AS BIGINT) AS pages FROM tasks", TASKS),
    "task_reset": query(f"SELECT id, tasktype, 0 AS status, TIMESTAMP '{NOW}' AS createtime, 0 AS progress FROM tasks WHERE status IN (0, 3)", TASKS),
    "task_state_fold": query(
        """SELECT t.task, CASE WHEN f.kind IS NULL THEN 0 WHEN f.kind = 'stop' THEN 2 WHEN l.kind IS NULL THEN 3 WHEN l.kind = 'finish' THEN 1 ELSE 2 END AS status,
        CASE WHEN f.kind = 'stop' THEN 'Stopped Before Start' END AS content FROM (SELECT DISTINCT task FROM k) t
        LEFT JOIN f ON f.task = t.task LEFT JOIN l ON l.task = t.task""", _KINDS,
        "f AS (SELECT * FROM k WHERE kind IN ('start', 'stop') QUALIFY row_number() OVER (PARTITION BY task ORDER BY ts, event_id) = 1)",
        "l AS (SELECT k.* FROM k JOIN f ON f.task = k.task AND f.kind = 'start' WHERE k.kind <> 'start' AND (k.ts, k.event_id) > (f.ts, f.event_id) QUALIFY row_number() OVER (PARTITION BY k.task ORDER BY k.ts, k.event_id) = 1)"),
    "progress_throttle": f"""
        WITH RECURSIVE o AS (SELECT user_id AS task, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        f AS (SELECT task, n, event_id, ts AS last, true AS taken FROM o WHERE n = 1
              UNION ALL SELECT o.task, o.n, o.event_id, CASE WHEN epoch_us(o.ts) - epoch_us(f.last) >= {GAP}000000 THEN o.ts ELSE f.last END, epoch_us(o.ts) - epoch_us(f.last) >= {GAP}000000
              FROM f JOIN o ON o.task = f.task AND o.n = f.n + 1)
        SELECT task, event_id FROM f WHERE taken""",
    "progress_percent": "SELECT num, CASE WHEN num % 10 = 0 THEN round(num / 500 * 99e0 * 0.5e0 + 50e0, 6) END AS percent FROM (SELECT unnest(range(500)) AS num)",
    "config_overlay": "SELECT coalesce(s_suppkey, c_custkey) AS key, coalesce(s_name, c_mktsegment) AS value FROM customer FULL JOIN supplier ON s_suppkey = c_custkey",
    "config_diff": """
        WITH o AS (SELECT p_partkey AS key, CAST(p_partkey % 5 AS VARCHAR) AS v FROM part),
        n AS (SELECT c_custkey * 2 AS key, CAST(c_custkey * 2 % 10 AS VARCHAR) AS v FROM customer)
        SELECT * FROM (SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.v IS NULL THEN 'delete' WHEN o.v IS NULL THEN 'add' WHEN o.v <> n.v THEN 'update' END AS change,
                              CASE WHEN n.v IS NULL THEN o.v ELSE n.v END AS value FROM o FULL JOIN n ON o.key = n.key) WHERE change IS NOT NULL""",
    "download_params": query("""SELECT id, '{"mask":"http://host/out/' || id || '/mask_' || id || '.tif","shape":"http://host/out/' || id || '/shape.shp"}' AS params FROM tasks""", TASKS),
    "params_lookup": query("SELECT id, tasktype AS a, CAST(status AS VARCHAR) AS b, CAST(NULL AS VARCHAR) AS c FROM tasks", TASKS),
    "header_parse": """
        SELECT page_id, split_part(p, '=', 1) AS name, substr(p, strpos(p, '=') + 1) AS value
        FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS p FROM pages) WHERE contains(p, '=')""",
    "cli_dict_parse": """
        SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN split_part(p, ':', 1) END AS name, CASE WHEN event_id % 10 <> 0 THEN substr(p, strpos(p, ':') + 1) END AS value
        FROM (SELECT event_id, unnest(string_split(regexp_replace(props, '[{}" ]', '', 'g'), ',')) AS p FROM events) WHERE event_id % 10 = 0 OR contains(p, ':')""",
    "filename_parts": """
        WITH b AS (SELECT page_id, regexp_extract(url || '.v' || page_id || '.TIF', '([^/]*)$', 1) AS base FROM pages)
        SELECT page_id, base, left(base, len(base) - 4) AS stem, '.TIF' AS ext, true AS allowed FROM b""",
    "date_text": query("SELECT id, strftime(createtime, '%Y-%m-%d %H:%M:%S') AS created FROM tasks", TASKS),
    "hash_keys": "SELECT c_custkey, md5(c_name) AS hash, c_mktsegment || length(c_mktsegment) || c_name AS cache_key FROM customer",
    "retry_delays": "SELECT attempt, least(5e0 * pow(2, attempt), 1200e0) AS delay FROM (SELECT unnest(range(1, 11)) AS attempt)",
    "tile_rowcol": query('SELECT id, r AS "row", c AS col FROM rc', GEO_POINTS, _ROWCOL),
    "tile_extent": query(
        f"SELECT id, round(c / 4096 * 360e0 - 180e0, 9) AS min_x, round({_LAT.format('pi() * (1 - 2 * (r + 1) / 4096)')}, 9) AS min_y, round((c + 1) / 4096 * 360e0 - 180e0, 9) AS max_x, round({_LAT.format('pi() * (1 - 2 * r / 4096)')}, 9) AS max_y FROM rc",
        GEO_POINTS, _ROWCOL),
    "tile_urls": query(
        f"""SELECT id, r AS "row", c AS col, 'http://tiles.example.org/wmts{TILE_QUERY.format(zoom=12, col="' || c || '", row="' || r || '")}' AS url FROM tiles""",
        GEO_POINTS, _TILES),
    "tile_mosaic_layout": query(
        """SELECT id, r AS "row", c AS col, (r - min(r) OVER g) * 256 AS off_y, (c - min(c) OVER g) * 256 AS off_x, (max(r) OVER g - min(r) OVER g + 1) * 256 AS height,
        (max(c) OVER g - min(c) OVER g + 1) * 256 AS width FROM tiles WINDOW g AS (PARTITION BY id)""", GEO_POINTS, _TILES),
}
