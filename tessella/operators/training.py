"""Lookup of signal samples, scores of a training run, and the forward pass of a fixed network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.signals import conv_forward, conv_weights, tolerance_score


def merge_collections(collections: dict[str, DataFrame]) -> DataFrame:
    """Rows of several collections with the collection's name; nothing is dropped as equal."""
    out: DataFrame | None = None
    for name, df in collections.items():
        named = df.withColumn("collection", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no collection is given")
    return out


def look_up(samples: DataFrame, collections: DataFrame, key: str) -> DataFrame:
    """Each listed sample (position, collection, key) with its row, or nulls; listed twice it is returned twice."""
    return samples.join(collections, ["collection", key], "left")


def tolerance_accuracy(df: DataFrame, predicted: str, target: str, by: list[str] | None = None) -> DataFrame:
    scored = df.withColumn("_s", tolerance_score(F.col(predicted), F.col(target)))
    return (scored.groupBy(*by) if by else scored.groupBy()).agg(F.avg("_s").alias("accuracy"), F.count("*").alias("n"))


def epoch_metrics(log: DataFrame) -> DataFrame:
    """Mean loss and number of steps of each epoch."""
    return log.groupBy("epoch").agg(F.avg("loss").alias("loss"), F.count("*").alias("steps"))


def smoothed_loss(log: DataFrame, keep: float = 0.9) -> DataFrame:
    """Exponentially weighted mean of the losses after each epoch, from 0 before the first: s = keep s + (1 - keep) loss.

    It goes on from epoch to epoch. Inside an epoch the fold is a weighted sum, a power of `keep` for each step that follows;
    the sums, a row for each epoch, are folded in the order of the epochs.
    """
    after = F.count("*").over(Window.partitionBy("epoch")) - F.row_number().over(Window.partitionBy("epoch").orderBy("step"))
    weighted = log.withColumn("_w", F.pow(F.lit(keep), after) * (1 - keep) * F.col("loss"))
    own = weighted.groupBy("epoch").agg(F.sum("_w").alias("ewma"), F.count("*").alias("steps"))

    def fold(epochs: pd.DataFrame) -> pd.DataFrame:
        epochs, s, out = epochs.sort_values("epoch", ignore_index=True), 0.0, []
        for mine, steps in zip(epochs["ewma"], epochs["steps"]):
            s = keep**steps * s + mine
            out.append(s)
        return epochs.assign(ewma=out)

    return own.groupBy().applyInPandas(fold, own.schema)  # a row for each epoch


def network_percentages(keys: Column, query: Column, length: int, seed: int = 1024) -> Column:
    """Percentages that the residual network with weights of a seed gives for signals of one length."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights = conv_weights(length, seed)
        for k, q in batches:
            parts = [conv_forward(weights, np.stack(q[i : i + 256].to_list()), np.stack(k[i : i + 256].to_list())) for i in range(0, len(k), 256)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return run(keys, query)
