"""Joins of boxes by overlap and containment, as equi-joins over grid cells."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.geometry import inside, overlaps

#: Cells that one box may be listed in, about; a box over more is listed in the cells of a coarser grid.
MOST_CELLS = 256
#: How much coarser each grid is than the one before, and how many there are beside the finest.
COARSER, LEVELS = 16, 6


def _level(box: list[str], cell: float) -> Column:
    """The finest grid in which the box is in few cells."""
    x0, y0, x1, y1 = map(F.col, box)
    fits = [((x1 - x0) / F.lit(cell * COARSER**k) + 1) * ((y1 - y0) / F.lit(cell * COARSER**k) + 1) <= MOST_CELLS for k in range(LEVELS)]
    return F.coalesce(*[F.when(f, F.lit(k)) for k, f in enumerate(fits)], F.lit(LEVELS))


def _cells(df: DataFrame, box: list[str], cell: float, own: str, other: str, others: list[int]) -> DataFrame:
    """df once for each level that the other side has and each cell, of the coarser grid of the two, that its box touches."""
    rows = df.withColumn(own, _level(box, cell)).withColumn(other, F.explode(F.array(*map(F.lit, others))))
    width = F.lit(float(cell)) * F.pow(F.lit(float(COARSER)), F.greatest(own, other))
    x0, y0, x1, y1 = (F.floor(F.col(c) / width) for c in box)
    return rows.withColumn("_cx", F.explode(F.sequence(x0, x1))).withColumn("_cy", F.explode(F.sequence(y0, y1)))


def join_overlapping(left: DataFrame, right: DataFrame, lbox: list[str], rbox: list[str], cell: float) -> DataFrame:
    """Inner join of boxes that share a point; the columns of both sides have different names.

    Boxes meet in grid cells of about the usual box's size. A box of either side over more than MOST_CELLS cells has a
    coarser grid, of LEVELS + 1, and two boxes meet in the coarser of their grids; a crowded cell is left to the
    skew join of adaptive execution.
    """
    levels = [sorted(r[0] for r in df.select(_level(box, cell)).distinct().collect()) for df, box in ((left, lbox), (right, rbox))]  # LEVELS + 1 at most
    a = _cells(left, lbox, cell, "_ll", "_rl", levels[1])
    b = _cells(right, rbox, cell, "_rl", "_ll", levels[0])
    # A pair that shares several cells is kept in the one with the lower-left corner of what both cover.
    width = F.lit(float(cell)) * F.pow(F.lit(float(COARSER)), F.greatest("_ll", "_rl"))
    owner = (F.floor(F.greatest(F.col(lbox[0]), F.col(rbox[0])) / width) == F.col("_cx")) & (F.floor(F.greatest(F.col(lbox[1]), F.col(rbox[1])) / width) == F.col("_cy"))
    joined = a.join(b, ["_ll", "_rl", "_cx", "_cy"])
    return joined.where(overlaps([F.col(c) for c in lbox], [F.col(c) for c in rbox]) & owner).drop("_ll", "_rl", "_cx", "_cy")


def with_any_overlap(left: DataFrame, right: DataFrame, lbox: list[str], rbox: list[str], cell: float, key: str) -> DataFrame:
    """Left rows (with a unique key) whose box shares a point with some right box."""
    boxes = right.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(rbox)])
    hits = join_overlapping(left.select(key, *lbox), boxes, lbox, [f"_r{i}" for i in range(4)], cell).select(key).distinct()
    return left.join(hits, key, "left_semi")


def within_any(left: DataFrame, right: DataFrame, lbox: list[str], rbox: list[str], cell: float, key: str) -> DataFrame:
    """Left rows whose box lies in some right box."""
    boxes = right.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(rbox)])
    names = [f"_r{i}" for i in range(4)]
    pairs = join_overlapping(left.select(key, *lbox), boxes, lbox, names, cell)
    hits = pairs.where(inside([F.col(c) for c in lbox], [F.col(c) for c in names])).select(key).distinct()
    return left.join(hits, key, "left_semi")


def class_codes(features: DataFrame, field: str, codes: dict[str, int]) -> DataFrame:
    """Features with the code of their class, 0 for classes that are not listed."""
    table = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])
    return features.withColumn("code", F.coalesce(F.element_at(table, F.col(field)), F.lit(0)))


def where_true(df: DataFrame, predicate: Callable[..., object], columns: list[str]) -> DataFrame:
    """Rows for which a Python predicate gives exactly True; a column expression is better where one can be written."""

    @F.pandas_udf("boolean")
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([predicate(*row) is True for row in zip(*(v.tolist() for v in values))], dtype=bool)

    return df.where(run(*columns))
