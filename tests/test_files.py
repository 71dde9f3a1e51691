"""Single files, weights and settings as a stream."""

import json

import numpy as np
import pytest

from tessella.functions import signals
from tessella.operators import dataset, raster, spatial, tables
from tessella.plans import sampling
from tessella.plans.views import BOX, features
from tessella.sources import weights
from tessella.storage import shared_dir, write_text
from tessella.streaming import progress


def test_coco_file(spark, sf_dir, tmp_path):
    from pyspark.sql import functions as F

    images = sampling.coco_images(spark, sf_dir).withColumnRenamed("id", "image_id")
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 3.0), (0.0, 3.0))])
    marks = sampling.coco_annotations(spark, sf_dir).join(images.select("image_id", "win_no"), "win_no")
    marks = marks.withColumns({"counts": raster.ring_rle(ring, 4, 4), "mask_height": F.lit(4), "mask_width": F.lit(4)})
    path = f"{tmp_path}/set.json"
    dataset.coco_file(images, marks, sampling.coco_categories(spark, sf_dir), path, {"contributor": "me"})
    with open(path) as f:
        found = json.load(f)
    assert list(found) == ["info", "licenses", "images", "annotations", "categories"] and found["info"]["contributor"] == "me"
    assert [i["id"] for i in found["images"]] == list(range(1, images.count() + 1))
    assert [a["id"] for a in found["annotations"]] == list(range(1, marks.count() + 1))
    assert found["annotations"][0]["segmentation"] == {"counts": [0, 3, 1, 3, 9], "size": [4, 4]} and len(found["annotations"][0]["bbox"]) == 4
    assert [c["name"] for c in found["categories"]] == sorted(c["name"] for c in found["categories"])


def test_manifest_grows(spark, tmp_path):
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "k int, line string")
    header = dataset.manifest_header({"x": 1, "y": 2}, "2024-01-01")
    dataset.append_manifest(lines, f"{tmp_path}/m.csv", ["k"], header)
    dataset.append_manifest(lines, f"{tmp_path}/m.csv", ["k"])
    with open(f"{tmp_path}/m.csv") as f:
        assert f.read().split("\n") == ["#,version,1.0,data_creator,2024-01-01", ",x,1,y,2", "a", "b", "a", "b", ""]
    assert dataset.manifest_header(None, "2024-01-01") == []
    write_text(spark, f"{tmp_path}/t.txt", ["é", "x"])
    write_text(spark, f"{tmp_path}/t.txt", ["new"])
    with open(f"{tmp_path}/t.txt") as f:
        assert f.read() == "new"


def test_weights_come_back(spark):
    made, path = signals.conv_weights(16), shared_dir(spark)
    weights.save_weights(spark, made, path)
    back = weights.load_weights(spark, path)
    assert set(back) == set(made) and all(np.array_equal(back[n], made[n]) for n in made)


def test_settings_as_a_stream(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 4, None), ("a", 5, "y"), ("b", 1, None), ("b", 2, "z")]
    log = spark.createDataFrame(rows, "key string, version long, value string")
    log.write.parquet(f"{tmp_path}/log")
    stream = progress.setting_changes_stream(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"), "key", "version", "value")
    out = f"{tmp_path}/out"
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    want = sorted(map(tuple, progress.setting_changes(log, "key", "version", "value").collect()))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want and len(want) == 5


def test_nodes_have_one_coordinator(spark):
    rows = tables.nodes(spark).collect()
    assert [r["coordinator"] for r in rows].count(True) == 1


def test_wide_boxes_on_both_sides(spark, sf_dir):
    """Boxes of very different sizes meet once each, whichever side they are on."""
    rng = np.random.default_rng(2)
    size = 10.0 ** rng.uniform(-1, 5, 300)
    x, y = rng.uniform(-5e4, 5e4, (2, 300))
    a = spark.createDataFrame([(i, float(x[i]), float(y[i]), float(x[i] + size[i]), float(y[i] + size[i])) for i in range(150)], "a int, ax0 double, ay0 double, ax1 double, ay1 double")
    b = spark.createDataFrame([(i, float(x[i]), float(y[i]), float(x[i] + size[i]), float(y[i] + size[i])) for i in range(150, 300)], "b int, bx0 double, by0 double, bx1 double, by1 double")
    got = sorted((r["a"], r["b"]) for r in spatial.join_overlapping(a, b, ["ax0", "ay0", "ax1", "ay1"], ["bx0", "by0", "bx1", "by1"], 1.0).collect())
    meet = lambda i, j: x[i] <= x[j] + size[j] and x[j] <= x[i] + size[i] and y[i] <= y[j] + size[j] and y[j] <= y[i] + size[i]
    assert got == [(i, j) for i in range(150) for j in range(150, 300) if meet(i, j)]


def test_unknown_label_fails(spark, sf_dir):
    from pyspark.sql import functions as F

    marks = sampling.coco_annotations(spark, sf_dir)
    assert marks.count() > 0
    few = features(spark, sf_dir).where("cls <> 'Brand#11'")
    assert sampling.coco_categories(spark, sf_dir).count() > few.select("cls").distinct().count() and F and BOX
    original = sampling.coco_categories
    sampling.coco_categories = lambda s, d: original(s, d).where("name <> 'Brand#11'")
    try:
        with pytest.raises(Exception, match="no category is called"):
            sampling.coco_annotations(spark, sf_dir).collect()
    finally:
        sampling.coco_categories = original
