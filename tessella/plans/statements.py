"""Queries that are SQL statements, tables written and read back, and a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.client import connect
from tessella.operators import tables
from tessella.plans.views import BOX, FEATURES, features, query, table, task_events
from tessella.storage import materialise
from tessella.streaming import progress


def _customer(spark: SparkSession, sf_dir: str) -> str:
    name = f"customer_{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").createOrReplaceTempView(name)
    return name


def sql_limit_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT count(*) AS n FROM (SELECT * FROM {_customer(spark, sf_dir)} LIMIT 1000)")


def sql_where_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT count(*) AS n FROM {_customer(spark, sf_dir)} WHERE false")


def sql_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT c_custkey, c_name FROM {_customer(spark, sf_dir)} WHERE c_mktsegment = ? AND c_acctbal > ?", args=["BUILDING", 500.0])


def tpch_customer_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT c_custkey, c_name FROM {_customer(spark, sf_dir)} ORDER BY c_custkey LIMIT 10")


def show_tables_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _customer(spark, sf_dir)
    return spark.sql("SHOW TABLES").where(F.col("tableName") == name).agg(F.count("*").alias("n"))


def session_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver and the executors as a table of nodes, counted by role."""
    return tables.nodes(spark).groupBy("coordinator", "state").agg(F.countDistinct("node_id").cast("long").alias("n")).where("coordinator")


def detection_table_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features appended to a detection table, which is cleared in between, and read back."""
    name = f"detections_{uuid.uuid4().hex}"
    tables.create_detection_table(spark, name)
    geom = F.when(F.col("fid") % 7 != 0, tables.wkb_box(*map(F.col, BOX)))
    rows = features(spark, sf_dir).select(geom.alias("the_geom"), F.col("cls").alias("class"), (F.col("fid") % 100 / F.lit(100.0)).alias("score"), F.lit(0).alias("status"))
    tables.append_detections(rows.where("score < 0.1"), name)
    tables.clear_table(spark, name)
    tables.append_detections(rows, name)
    found = materialise(spark.table(name).groupBy("class").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"), F.sum(F.octet_length("the_geom")).alias("bytes")))
    spark.sql(f"DROP TABLE {name}")
    return found


def binary_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.base64(F.col("c_name").cast("binary")).alias("b"))
    return tables.decode_base64(c, ["b"]).select("c_custkey", F.col("b").cast("string").alias("name"))


def extent_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_extent(features(spark, sf_dir), BOX, "100,200,300,450").select("fid")


def dbapi_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows fetched by a cursor: they come to the driver, which is what a cursor is for."""
    with connect(spark) as c:
        table(c.session, sf_dir, "nation").createOrReplaceTempView("nation_rows")
        cursor = c.cursor().execute("SELECT n_nationkey, n_name FROM nation_rows WHERE n_regionkey = ?", [1])
        return spark.createDataFrame(cursor.fetchall(), "n_nationkey int, n_name string")


def streaming_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted events of the whole table, as the stream operator finds them."""
    return progress.throttle_files(spark, f"{sf_dir}/events.parquet", 6 * 3600.0)


def wkb_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the polygons of a detection table, decoded again."""
    f = features(spark, sf_dir).select("fid", tables.wkb_rings(tables.wkb_box(*map(F.col, BOX))).alias("rings"))
    return f.select("fid", F.posexplode(F.col("rings")[0]).alias("k", "p")).groupBy("fid").agg(F.count("*").alias("n"), F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"), F.max("p.y").alias("y1"))


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by quarters of an hour and type."""
    counts = progress.windowed_counts(table(spark, sf_dir, "events"), size="15 minutes")
    return counts.select(F.unix_seconds("window.start").alias("begin"), "event_type", "n", F.round("total", 6).alias("total"))


def config_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of settings along a sequence of versions: each event writes its user's type as a setting."""
    log = task_events(spark, sf_dir).select(F.col("task").alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("value"))
    return progress.setting_changes(log, "key", "version", "value")


QUERIES = {
    f.__name__: f
    for f in (
        sql_limit_count, sql_where_false, sql_params, tpch_customer_limit, show_tables_count, session_nodes, detection_table_roundtrip, binary_decode,
        extent_scan, wkb_decoded, windowed_counts, dbapi_rows, streaming_progress, config_feed,
    )
}

SQL = {
    "sql_limit_count": "SELECT count(*) AS n FROM (SELECT * FROM customer LIMIT 1000)",
    "sql_where_false": "SELECT count(*) AS n FROM customer WHERE false",
    "sql_params": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 500e0",
    "tpch_customer_limit": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10",
    "session_nodes": "SELECT true AS coordinator, 'active' AS state, CAST(1 AS BIGINT) AS n",
    "show_tables_count": "SELECT CAST(1 AS BIGINT) AS n",
    "detection_table_roundtrip": query("SELECT cls AS class, count(*) AS n, round(sum(fid % 100 / 100e0), 6) AS score, CAST(sum(93) AS BIGINT) AS bytes FROM features WHERE fid % 7 <> 0 GROUP BY cls", FEATURES),
    "binary_decode": "SELECT c_custkey, c_name AS name FROM customer",
    "wkb_decoded": query("SELECT fid, CAST(5 AS BIGINT) AS n, xmin AS x0, xmax AS x1, ymin AS y0, ymax AS y1 FROM features", FEATURES),
    "windowed_counts": "SELECT epoch_us(ts) // 900000000 * 900 AS begin, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "extent_scan": query("SELECT fid FROM features WHERE xmin <= 300 AND xmax >= 100 AND ymin <= 450 AND ymax >= 200", FEATURES),
    "dbapi_rows": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1",
    "streaming_progress": """
        WITH RECURSIVE o AS (SELECT user_id AS task, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        f AS (SELECT task, n, event_id, ts AS last, true AS taken FROM o WHERE n = 1
              UNION ALL SELECT o.task, o.n, o.event_id, CASE WHEN epoch_us(o.ts) - epoch_us(f.last) >= 21600000000 THEN o.ts ELSE f.last END, epoch_us(o.ts) - epoch_us(f.last) >= 21600000000
              FROM f JOIN o ON o.task = f.task AND o.n = f.n + 1)
        SELECT task, event_id FROM f WHERE taken""",
    "config_feed": """
        SELECT key, version, CASE WHEN was IS NULL THEN 'add' ELSE 'update' END AS change, value
        FROM (SELECT user_id AS key, event_id AS version, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events)
        WHERE was IS NULL OR was <> value""",
}
