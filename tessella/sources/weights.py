"""Weights of a model as a table, a row for each array."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "name string, dtype string, shape array<int>, buf binary"


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    rows = [(name, str(a.dtype), list(a.shape), np.ascontiguousarray(a).tobytes()) for name, a in weights.items()]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays by name; a model is small, so they come to the driver."""
    rows: DataFrame = spark.read.schema(SCHEMA).parquet(path)
    return {r["name"]: np.frombuffer(r["buf"], dtype=r["dtype"]).reshape(r["shape"]) for r in rows.collect()}
