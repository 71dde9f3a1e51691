"""Streams of progress reports and settings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tessella.storage import shared_dir


def throttle_stream(events: DataFrame, gap: float) -> DataFrame:
    """Accepted events (task, event_id) of a stream of task, ts, event_id: each that comes `gap` seconds after the last accepted.

    A task's state is one time. Events that are late behind an accepted one are not accepted.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        kept = []
        for us, event in zip(rows["us"].tolist(), rows["event_id"].tolist()):
            if last is None or us - last >= gap * 1_000_000:
                last = us
                kept.append(event)
        state.update((last,))
        yield pd.DataFrame({"task": [key[0]] * len(kept), "event_id": kept}).astype({"task": "int64", "event_id": "int64"})

    timed = events.select("task", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return timed.groupBy("task").applyInPandasWithState(run, "task long, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def throttle_files(spark: SparkSession, path: str, gap: float) -> DataFrame:
    """What the stream over a folder or file of events accepts, run until all files are read."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    out = shared_dir(spark)
    accepted = throttle_stream(source.select(F.col("user_id").alias("task"), "ts", "event_id"), gap)
    stream = accepted.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).queryName(f"throttle_{uuid.uuid4().hex}").start()
    stream.awaitTermination()
    return spark.read.schema("task long, event_id long").parquet(f"{out}/rows")


def setting_changes(log: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """add, update and delete along the versions of each setting; null values are deletions, equal ones no change."""
    was = F.lag(value).over(Window.partitionBy(key).orderBy(version))
    changed = log.withColumn("_was", was).where(~F.col("_was").eqNullSafe(F.col(value)))
    kind = F.when(F.col("_was").isNull(), "add").when(F.col(value).isNull(), "delete").otherwise("update")
    return changed.select(key, version, kind.alias("change"), value)


def setting_changes_stream(log: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """The same of a stream of (key, version, value); each setting's state is its last version and value. Late versions are passed over."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, was = state.get if state.exists else (None, None)
        out = []
        for at, now in sorted(((int(v), x) for b in batches for v, x in zip(b["_v"], b["_x"])), key=lambda r: r[0]):
            if last is not None and at <= last:
                continue
            now = None if pd.isna(now) else now
            if now != was:
                out.append((name[0], at, "add" if was is None else "delete" if now is None else "update", now))
            last, was = at, now
        state.update((last, was))
        yield pd.DataFrame(out, columns=["k", "v", "change", "x"]).astype({"v": "int64"})

    rows = log.select(F.col(key).cast("string").alias("_k"), F.col(version).cast("long").alias("_v"), F.col(value).cast("string").alias("_x"))
    found = rows.groupBy("_k").applyInPandasWithState(run, "k string, v long, change string, x string", "last long, was string", "append", GroupStateTimeout.NoTimeout)
    return found.select(F.col("k").alias(key), F.col("v").alias(version), "change", F.col("x").alias(value))


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts and sums by event time and type, with a bound on late events; for streams and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
