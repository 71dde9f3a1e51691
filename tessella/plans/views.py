"""Input views over the tables, as DataFrames and as the same in SQL (a list of WITH entries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = ["xmin", "ymin", "xmax", "ymax"]
EXTENT = (0.0, 0.0, 1000.0, 1000.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular features with a class."""
    part = table(spark, sf_dir, "part")
    x, y = F.col("p_partkey") * 7919 % 10000 / F.lit(10.0), F.col("p_partkey") * 104729 % 10000 / F.lit(10.0)
    return part.select(
        F.col("p_partkey").alias("fid"),
        x.alias("xmin"),
        y.alias("ymin"),
        (x + F.col("p_size") * 0.5).alias("xmax"),
        (y + F.col("p_size") * 0.25).alias("ymax"),
        F.col("p_brand").alias("cls"),
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 5 x 5 grid of zones of 200 x 200."""
    nation = table(spark, sf_dir, "nation")
    x, y = F.col("n_nationkey") % 5 * F.lit(200.0), F.expr("n_nationkey div 5") * F.lit(200.0)
    return nation.select(
        F.col("n_nationkey").alias("zid"), x.alias("zxmin"), y.alias("zymin"), (x + 200).alias("zxmax"), (y + 200).alias("zymax"), F.col("n_regionkey").alias("rkey")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips of 8 x 8 pixels, a row for each pixel."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    value = F.floor((F.col("v").cast("double") + 0.5) * 256)
    return e.select("vec_id", "pos", F.least(F.lit(255), F.greatest(F.lit(0), value)).cast("int").alias("px"))


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chips, a row with an array of pixels for each; no shuffle."""
    value = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.5) * 256))).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", value).alias("px"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with a split, two sequences and a label."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(F.col("vec_id") % 5 != 0, 1).otherwise(0).alias("split"),
        F.transform("embedding", lambda v: F.abs(v.cast("double")) * 400).alias("keys"),
        F.transform("embedding", lambda v: v.cast("double")).alias("query"),
        (F.col("label") * 12).alias("label"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"), "label")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(3)
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tasktype"), status.alias("status"), F.col("o_orderdate").alias("createtime"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), "ts", "event_id", "event_type", "value")


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("epoch"), F.col("event_id").alias("step"), F.col("value").alias("loss"))


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        (F.col("c_custkey") * 7919 % 36000 / F.lit(100.0) - 180).alias("lon"),
        (F.col("c_custkey") * 104729 % 16000 / F.lit(100.0) - 80).alias("lat"),
    )


# The same views in SQL.
FEATURES = """
features0 AS (SELECT p_partkey AS fid, (p_partkey * 7919 % 10000) / 10e0 AS xmin, (p_partkey * 104729 % 10000) / 10e0 AS ymin, p_size, p_brand AS cls FROM part),
features AS (SELECT fid, xmin, ymin, xmin + p_size * 0.5e0 AS xmax, ymin + p_size * 0.25e0 AS ymax, cls FROM features0)"""
ZONES = """
zones0 AS (SELECT n_nationkey AS zid, n_nationkey % 5 * 200e0 AS zxmin, n_nationkey // 5 * 200e0 AS zymin, n_regionkey AS rkey FROM nation),
zones AS (SELECT zid, zxmin, zymin, zxmin + 200e0 AS zxmax, zymin + 200e0 AS zymax, rkey FROM zones0)"""
PIXELS = """
pixels AS (SELECT vec_id, pos, CAST(least(255, greatest(0, floor((CAST(embedding[pos + 1] AS DOUBLE) + 0.5e0) * 256))) AS INTEGER) AS px
           FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS pos FROM embeddings))"""
VECTORS = """
vectors AS (SELECT vec_id, label, pos, CAST(embedding[pos + 1] AS DOUBLE) AS x
            FROM (SELECT vec_id, label, embedding, unnest(range(len(embedding))) AS pos FROM embeddings))"""
SIGNALS = """
signals AS (SELECT vec_id, CASE WHEN vec_id % 5 <> 0 THEN 1 ELSE 0 END AS split, pos, abs(CAST(embedding[pos + 1] AS DOUBLE)) * 400 AS k,
                   CAST(embedding[pos + 1] AS DOUBLE) AS q, label * 12 AS label
            FROM (SELECT vec_id, label, embedding, unnest(range(len(embedding))) AS pos FROM embeddings))"""
TASKS = """
tasks AS (SELECT o_orderkey AS id, o_orderpriority AS tasktype, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 3 END AS status, o_orderdate AS createtime FROM orders)"""
GEO_POINTS = """
geo_points AS (SELECT c_custkey AS id, (c_custkey * 7919 % 36000) / 100e0 - 180 AS lon, (c_custkey * 104729 % 16000) / 100e0 - 80 AS lat FROM customer)"""
#: 11 x 11 windows of 100 x 100, 90 apart, over EXTENT.
WINDOWS = """
windows AS (SELECT r * 11 + c AS win_no, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col,
                   CASE WHEN c = 10 THEN 900e0 ELSE c * 90e0 END AS x, CASE WHEN r = 10 THEN 900e0 ELSE r * 90e0 END AS y
            FROM (SELECT unnest(range(11)) AS r), (SELECT unnest(range(11)) AS c))"""


def query(select: str, *views: str) -> str:
    """SQL with the views it needs."""
    return "WITH RECURSIVE " + ",".join(views) + "\n" + select
