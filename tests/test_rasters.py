"""Run lengths of rings without their masks, and mosaics with places left open."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.operators import raster
from tessella.plans import catalogue
from tests.conftest import plain
from tests.test_plans import plan


def test_run_lengths_without_masks(spark):
    """No mask leaves the task that makes it: one function gives the run lengths, and they are those of the masks."""
    draw = random.Random(6)
    rings = [[(0.0, 0.0), (0.0, 0.0)], [(0.0, 0.0), (12.0, 0.0), (12.0, 9.0), (0.0, 9.0)]]
    rings += [[(draw.uniform(-3, 15), draw.uniform(-3, 12)) for _ in range(draw.randrange(3, 7))] for _ in range(40)]
    df = spark.createDataFrame([(n, r) for n, r in enumerate(rings)], "n int, ring array<struct<x: double, y: double>>")
    runs = df.select("n", raster.ring_rle(F.col("ring"), 9, 12).alias("counts"))
    assert plan(runs).count("- ArrowEvalPython (") == 1
    masks = dict(df.select("n", raster.ring_mask(F.col("ring"), 9, 12)).collect())
    for r in runs.collect():
        flat = [v for k, c in enumerate(r["counts"]) for v in [k % 2] * c]
        assert flat == [masks[r["n"]][y * 12 + x] for x in range(12) for y in range(9)] and all(r["counts"][1:])


@pytest.mark.parametrize("ids", [range(16), [3, 4, 8, 11, 27, 43, 44], [0, 1, 1, 1, 7, 12, 12, None, None], [-13, -9, -4, 0, 2, 9]])
def test_mosaics_with_places_left_open(spark, tmp_path, ids):
    """Mosaics that lack tiles, at their end, start or between, have no pixels there; chips of one place and chips without one count as in SQL."""
    draw = random.Random(7)
    rows = [(i, [draw.uniform(-0.6, 0.6) for _ in range(64)], 0) for i in ids] + [(900, None, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = catalogue.QUERIES["tile_mosaic"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.sql(catalogue.SQL["tile_mosaic"])
    assert df.columns == want.columns
    assert plain(tuple(r) for r in df.collect()) == plain(want.fetchall())
