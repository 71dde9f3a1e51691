"""Sample manifests and annotation sets (COCO, LabelMe, CSV) from windows, features and chips."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.geometry import box_area, clip_box
from tessella.operators.spatial import join_overlapping
from tessella.storage import materialise, write_text

#: Part of a feature that must lie in a window, if not all does.
LEAST_COVER = 0.7


def number_rows(df: DataFrame, order: list[str], name: str, first: int = 1, parts: int | None = None) -> DataFrame:
    """Consecutive numbers in a total order, without bringing the rows to one task.

    Rows are range-partitioned in that order, written once so that the partitions stay as they are, and numbered inside
    each; the counts before each partition, a row for each, are added.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_in", inside).join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_in") + (first - 1)).drop("_part", "_in", "_base")


def keep_valid(windows: DataFrame, chips: DataFrame, extent: tuple[float, float, float, float], least: float = 0.5) -> DataFrame:
    """Windows inside the extent whose chip has at least `least` non-zero pixels; windows have left, bottom, right, top, chip_id."""
    left, bottom, right, top = (F.lit(float(v)) for v in extent)
    within = (F.col("left") >= left) & (F.col("right") <= right) & (F.col("top") <= top) & (F.col("bottom") >= bottom)
    filled = chips.withColumn("ratio", nonzero_ratio(F.col("px"))).where(F.col("ratio") >= least)
    return windows.where(within).join(filled, "chip_id")


def nonzero_ratio(px: Column) -> Column:
    return F.size(F.filter(px, lambda p: p != 0)) / F.size(px)


def around(c: Column, places: int) -> Column:
    """Half-even rounding of the scaled value; what binary fractions add beyond six places is cut first."""
    return F.rint(F.round(c, 6) * float(10**places)) / float(10**places)


def annotate(windows: DataFrame, features: DataFrame, wbox: list[str], fbox: list[str], cell: float, least: float = LEAST_COVER) -> DataFrame:
    """Window and feature pairs with the clipped box in window pixels, its area and bbox; y runs down from the window's top.

    A feature inside its window stays whole; another stays, clipped, if more than `least` of its area is inside.
    """
    pairs = join_overlapping(windows, features, wbox, fbox, cell)
    w, f = [F.col(c) for c in wbox], [F.col(c) for c in fbox]
    x0, y0, x1, y1 = clip_box(f, w)
    pairs = pairs.withColumns({"_x0": x0 - w[0], "_x1": x1 - w[0], "_y0": w[3] - y1, "_y1": w[3] - y0, "_all": box_area(f)})
    part = box_area([F.col("_x0"), F.col("_y0"), F.col("_x1"), F.col("_y1")])
    whole = (f[0] >= w[0]) & (f[2] <= w[2]) & (f[1] >= w[1]) & (f[3] <= w[3])
    pairs = pairs.withColumn("_part", part).where(whole | (F.col("_part") / F.col("_all") > least))
    corner = {c: F.greatest(around(F.col(c), 1), F.lit(0.0)) for c in ("_x0", "_y0", "_x1", "_y1")}
    return pairs.withColumns(
        {
            "area": around(F.col("_part"), 2),
            "bbox_x": corner["_x0"],
            "bbox_y": corner["_y0"],
            "bbox_w": corner["_x1"] - corner["_x0"],
            "bbox_h": corner["_y1"] - corner["_y0"],
        }
    ).drop("_x0", "_x1", "_y0", "_y1", "_all", "_part")


def categories(labels: DataFrame | None, label: str = "label") -> DataFrame:
    """id and name: positions from 1 in the order of the names."""
    order = Window.orderBy(label)
    return labels.select(label).distinct().select(F.row_number().over(order).cast("long").alias("id"), F.col(label).alias("name"))


# What is said of a data set and its licence where nothing else is given.
INFO = {"description": "COCO-format dataset", "url": "", "version": "1.0", "contributor": ""}
LICENCES = [{"id": 0, "name": "", "url": ""}]


def _entry() -> Column:
    """An annotation as it is written; segmentation is the run lengths (column by column, from zeros) and the size of the mask."""
    mask = F.struct("counts", F.array("mask_height", "mask_width").alias("size"))
    return F.struct(
        "id", "image_id", "category_id", mask.alias("segmentation"), "area", F.array("bbox_x", "bbox_y", "bbox_w", "bbox_h").alias("bbox"), F.lit(0).alias("iscrowd")
    )


def coco_document(images: DataFrame, annotations: DataFrame, cats: DataFrame) -> DataFrame:
    """One JSON text for each image: the image, its annotations in order, and the categories they use.

    A document for each image keeps every row small; `coco_file` writes the usual single file.
    """
    named = annotations.join(cats.withColumnRenamed("id", "category_id").withColumnRenamed("name", "category"), "category_id")
    entry = _entry()
    grouped = named.groupBy("image_id").agg(
        F.sort_array(F.collect_list(entry)).alias("annotations"), F.sort_array(F.collect_set(F.struct(F.col("category_id").alias("id"), F.col("category").alias("name")))).alias("categories")
    )
    image = F.struct(F.col("image_id").alias("id"), "file_name", "height", "width")
    return images.join(grouped, "image_id").select("image_id", F.to_json(F.struct(F.array(image).alias("images"), "annotations", "categories")).alias("document"))


def coco_file(images: DataFrame, annotations: DataFrame, cats: DataFrame, path: str, info: dict[str, str] | None = None, licences: list[dict] | None = None) -> None:
    """The whole set as one JSON file: info, licenses, images, annotations and categories, each in the order of ids.

    Entries are made and ordered by Spark and pass through the driver a partition at a time; nothing is held whole.
    """
    import datetime
    import json

    today = datetime.datetime.today()
    about = {**INFO, "year": today.year, "date_created": str(today), **(info or {})}
    image = F.struct(F.col("image_id").alias("id"), "file_name", "height", "width")
    lists = {
        "images": images.select(F.col("image_id").alias("k"), F.to_json(image).alias("j")),
        "annotations": annotations.select(F.col("id").alias("k"), F.to_json(_entry()).alias("j")),
        "categories": cats.select(F.col("id").alias("k"), F.to_json(F.struct("id", "name")).alias("j")),
    }

    def pieces() -> Iterator[str]:
        yield f'{{"info": {json.dumps(about)}, "licenses": {json.dumps(licences or LICENCES)}'
        for name, rows in lists.items():
            yield f', "{name}": ['
            for n, row in enumerate(rows.orderBy("k").toLocalIterator()):
                yield (", " if n else "") + row["j"]
            yield "]"
        yield "}"

    write_text(images.sparkSession, path, pieces())


def labelme_document(shapes: DataFrame, image: str, label: str, points: str, height: int, width: int) -> DataFrame:
    """One LabelMe JSON text for each image."""
    shape = F.struct(F.col(label).alias("label"), F.col(points).alias("points"), F.lit(None).cast("string").alias("group_id"), F.lit("polygon").alias("shape_type"))
    grouped = shapes.groupBy(image).agg(F.sort_array(F.collect_list(shape)).alias("shapes"))
    return grouped.select(
        image,
        F.to_json(
            F.struct(
                F.lit("4.2.10").alias("version"),
                F.create_map().cast("map<string,string>").alias("flags"),
                "shapes",
                F.col(image).cast("string").alias("imagePath"),
                F.lit(height).alias("imageHeight"),
                F.lit(width).alias("imageWidth"),
            )
        ).alias("document"),
    )


def manifest_header(classes: dict[str, int] | None, created: str) -> list[str]:
    """Lines before a manifest of several classes: its version and date, and the classes with their codes; none without classes."""
    if not classes:
        return []
    return [f"#,version,1.0,data_creator,{created}", "".join(f",{name},{code}" for name, code in classes.items())]


def append_manifest(lines: DataFrame, path: str, order: list[str], header: list[str] = (), column: str = "line") -> None:
    """Lines in an order, after the header, at the end of one text file, which is made if it is missing."""
    rows = (row[column] for row in lines.orderBy(*order).toLocalIterator())
    write_text(lines.sparkSession, path, (f"{text}\n" for text in chain(header, rows)), append=True)


def manifest_lines(*paths: Column) -> Column:
    return F.concat_ws(",", *paths)


def outline_text(name: Column, kind: str, ring: Column) -> Column:
    """`name:kind:x,y;x,y` of a ring."""
    points = F.transform(ring, lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string")))
    return F.concat(name, F.lit(f":{kind}:"), F.array_join(points, ";"))
