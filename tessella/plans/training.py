"""Queries on signals, training logs and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import signals as sig
from tessella.operators import training
from tessella.plans.views import SIGNALS, query, signals, table, train_log

LOOPS = 5000


def signal_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = signals(spark, sf_dir).where("split = 1").select("vec_id", sig.encode_array(F.col("keys")).alias("keys"))
    return coded.select("vec_id", F.posexplode(sig.decode_array(F.col("keys"))).alias("pos", "k"))


def signal_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).where("split = 0")
    return s.select("vec_id", sig.clip_label(F.col("label")).alias("target"), F.posexplode(sig.clip_keys(F.col("keys"))).alias("pos", "k"))


def sample_list_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a list of samples with repeats, each in one of two collections; many ids are missing in the second."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    listed = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("position"), F.when(F.col("o_orderstatus") == "F", "b").otherwise("a").alias("collection"), F.col("o_custkey").alias("key")
    )
    return training.look_up(listed, training.merge_collections({"a": a, "b": b}), "key")


def tolerance_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir).select("split", F.col("keys")[0].alias("predicted"), F.col("label").cast("double").alias("target"))
    out = training.tolerance_accuracy(s, "predicted", "target", ["split"])
    return out.select("split", F.round(F.col("accuracy") * 100, 2).alias("accuracy"), "n")


def epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.epoch_metrics(train_log(spark, sf_dir)).withColumn("loss", F.round("loss", 6))


def ewma_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.smoothed_loss(train_log(spark, sf_dir)).withColumn("ewma", F.round("ewma", 6))


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(LOOPS).select(F.col("id").alias("step"), F.round(sig.learning_rate(F.col("id"), LOOPS), 9).alias("factor"))


def conv_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    return s.select("vec_id", F.round(training.network_percentages(sig.clip_keys(F.col("keys")), F.col("query"), 64), 6).alias("percent"))


QUERIES = {
    f.__name__: f
    for f in (signal_decode, signal_clip, sample_list_lookup, tolerance_accuracy, epoch_metrics, ewma_loss, lr_schedule, conv_inference)
}

SQL = {
    "signal_decode": query("SELECT vec_id, CAST(pos AS INTEGER) AS pos, k FROM signals WHERE split = 1", SIGNALS),
    "signal_clip": query("SELECT vec_id, least(label, 100) AS target, CAST(pos AS INTEGER) AS pos, least(k, 100e0) / 100e0 AS k FROM signals WHERE split = 0", SIGNALS),
    "sample_list_lookup": """
        WITH c AS (SELECT 'a' AS collection, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 'b', s_suppkey, s_name FROM supplier),
        l AS (SELECT o_orderkey AS position, CASE WHEN o_orderstatus = 'F' THEN 'b' ELSE 'a' END AS collection, o_custkey AS key FROM orders)
        SELECT collection, key, position, name FROM l LEFT JOIN c USING (collection, key)""",
    "tolerance_accuracy": query(
        "SELECT split, round(avg(CASE WHEN abs(k - label) <= 5 THEN 1e0 WHEN abs(k - label) <= 10 THEN 0.6e0 ELSE 0e0 END) * 100, 2) AS accuracy, count(*) AS n FROM signals WHERE pos = 0 GROUP BY split", SIGNALS),
    "epoch_metrics": "SELECT user_id AS epoch, round(avg(value), 6) AS loss, count(*) AS steps FROM events GROUP BY user_id",
    "ewma_loss": """
        WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS steps FROM events),
        e AS (SELECT user_id, sum(pow(0.9e0, steps - n) * 0.1e0 * value) AS own, steps, row_number() OVER (ORDER BY user_id) AS nth FROM o GROUP BY user_id, steps),
        f AS (SELECT user_id, own AS s, steps, nth FROM e WHERE nth = 1
              UNION ALL SELECT e.user_id, pow(0.9e0, e.steps) * f.s + e.own, e.steps, e.nth FROM f JOIN e ON e.nth = f.nth + 1)
        SELECT user_id AS epoch, round(s, 6) AS ewma, steps FROM f""",
    "lr_schedule": f"""
        SELECT step, round(CASE WHEN step < {LOOPS // 100} THEN 0.5e0 * (cos(({LOOPS // 100} - 1 - step) / {LOOPS // 100}e0 * pi()) + 1)
               ELSE pow(0.5e0 * (cos((step - {LOOPS // 100}) / {LOOPS - LOOPS // 100}e0 * pi()) + 1), 2) END, 9) AS factor FROM (SELECT unnest(range({LOOPS})) AS step)""",
}
