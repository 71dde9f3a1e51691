"""Chips as arrays of pixels: masks, histograms, run lengths, rasterizing, resampling, turning, naming.

A chip is row-major, `px[row * width + col]`; several bands follow one another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.crs import reproject, reproject_box
from tessella.functions.geometry import ring_contains, ring_envelope


def apply_mask(px: Column, mask: Column) -> Column:
    return F.zip_with(px, mask, lambda p, m: F.when(m > 0, p).otherwise(F.lit(0)))


def resample_nearest(px: Column, height: int, width: int, out_height: int, out_width: int) -> Column:
    """Nearest pixel for each output pixel's centre."""
    index = [
        int((r + 0.5) * height / out_height) * width + int((c + 0.5) * width / out_width) for r in range(out_height) for c in range(out_width)
    ]
    return F.transform(F.array(*[F.lit(i) for i in index]), lambda i: F.element_at(px, i + 1))


def bands_last(px: Column, bands: int, size: int, reverse: bool = False) -> Column:
    """Band-major pixels as pixel-major, the bands in reverse order if asked (RGB to BGR)."""
    order = range(bands - 1, -1, -1) if reverse else range(bands)
    index = [b * size + i for i in range(size) for b in order]
    return F.transform(F.array(*[F.lit(i) for i in index]), lambda i: F.element_at(px, i + 1))


def run_lengths(chips: DataFrame, key: str, flag: str, order: Column) -> DataFrame:
    """Run lengths of a mask, one row a run: key, run (from 0), length; runs alternate from zeros, the first may be 0.

    chips has a row for each pixel; a window never holds more than one chip.
    """
    by = Window.partitionBy(key).orderBy("_o")
    rows = chips.withColumn("_o", order)
    change = F.coalesce((F.col(flag) != F.lag(flag).over(by)).cast("int"), F.col(flag))
    runs = rows.withColumn("run", F.sum(change).over(by)).groupBy(key, "run").agg(F.count("*").alias("length"))
    starts_set = rows.where("_o = 0").where(F.col(flag) == 1).select(key, F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("length"))
    return runs.unionByName(starts_set)


def run_length_array(mask: Column) -> Column:
    """The same as an array, from a mask array in the wanted order, in one pass."""
    start = F.struct(F.lit(0).alias("last"), F.lit(0).cast("long").alias("n"), F.expr("cast(array() as array<bigint>)").alias("out"))

    def step(s: Column, v: Column) -> Column:
        same = s["last"] == v
        return F.struct(
            v.cast("int").alias("last"),
            F.when(same, s["n"] + 1).otherwise(F.lit(1)).cast("long").alias("n"),
            F.when(same, s["out"]).otherwise(F.concat(s["out"], F.array(s["n"]))).alias("out"),
        )

    return F.aggregate(mask, start, step, lambda s: F.concat(s["out"], F.array(s["n"])))


def rasterize(grid: DataFrame, shapes: DataFrame, box: list[str], pixel: float, order: str | None = None, code: str | None = None) -> DataFrame:
    """Pixels of a grid (row, col over `pixel` units) set by boxes: 1, or the code of the last shape in `order`.

    A pixel is set if its centre is in a box, counting the lower and left edge but not the upper and right. Each box lists
    the pixels it sets, so that no pair of pixel and box is made beyond those.
    """
    x0, y0, x1, y1 = (F.col(c) / F.lit(float(pixel)) - 0.5 for c in box)
    first_c, last_c = F.ceil(x0).cast("long"), F.ceil(x1).cast("long") - 1
    first_r, last_r = F.ceil(y0).cast("long"), F.ceil(y1).cast("long") - 1
    seq = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.expr("cast(array() as array<bigint>)"))
    hit = shapes.withColumn("col", F.explode(seq(first_c, last_c))).withColumn("row", F.explode(seq(first_r, last_r)))
    value = F.max(F.lit(1)) if order is None else F.max_by(code, order)
    burnt = hit.groupBy("row", "col").agg(value.cast("int").alias("value"))
    return grid.join(burnt, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def rasterize_rings(grid: DataFrame, shapes: DataFrame, ring: str, pixel: float, order: str | None = None, code: str | None = None) -> DataFrame:
    """As `rasterize`, for rings: a pixel is set if its centre is inside by the even-odd rule. Each ring lists the pixels of its own box."""
    x0, y0, x1, y1 = (c / F.lit(float(pixel)) - 0.5 for c in ring_envelope(F.col(ring)))
    seq = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.expr("cast(array() as array<bigint>)"))
    hit = shapes.withColumn("col", F.explode(seq(F.ceil(x0).cast("long"), F.floor(x1).cast("long")))).withColumn("row", F.explode(seq(F.ceil(y0).cast("long"), F.floor(y1).cast("long"))))
    hit = hit.where(ring_contains(F.col(ring), (F.col("col") + 0.5) * float(pixel), (F.col("row") + 0.5) * float(pixel)))
    value = F.max(F.lit(1)) if order is None else F.max_by(code, order)
    burnt = hit.groupBy("row", "col").agg(value.cast("int").alias("value"))
    return grid.join(burnt, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0)))


def reproject_nearest(px: Column, height: int, width: int, transform: list[Column], source: int, target: int) -> tuple[Column, list[Column]]:
    """A north-up chip in another projection, in as many pixels over the box of its reprojected corners, and its transform.

    Each pixel takes the nearest source pixel of its own centre, 0 outside.
    """
    a, _, c, _, e, f = transform
    x0, y0, x1, y1 = reproject_box(source, target, [c, f + e * height, c + a * width, f])
    step_x, step_y = (x1 - x0) / width, (y1 - y0) / height

    def take(i: Column) -> Column:
        x, y = reproject(target, source, x0 + (i % width + 0.5) * step_x, y1 - (F.floor(i / width) + 0.5) * step_y)
        col, row = F.floor((x - c) / a), F.floor((y - f) / e)
        inside = (col >= 0) & (col < width) & (row >= 0) & (row < height)
        return F.when(inside, F.get(px, (row * width + col).cast("int"))).otherwise(F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), take), [step_x, F.lit(0.0), x0, F.lit(0.0), -step_y, y1]


def histogram(chips: DataFrame, key: str, px: str, bins: int = 256) -> DataFrame:
    """Non-empty bins of each chip: key, bin, n."""
    return chips.select(key, F.explode(px).alias("bin")).groupBy(key, "bin").agg(F.count("*").alias("n"))


def histogram_vector(px: Column, bins: int = 256) -> Column:
    """Dense histogram of one array of pixels."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        # All arrays of a batch are counted at once, by array and value.
        sizes = np.diff(column.offsets.to_numpy())
        values = np.asarray(column.flatten()).astype(np.int64)
        row = np.repeat(np.arange(len(column)), sizes)
        kept = (values >= 0) & (values < bins)
        counts = np.bincount(row[kept] * bins + values[kept], minlength=len(column) * bins).astype(float)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * bins, pa.int32()), pa.array(counts))

    return run(px)


def l2_normalise(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / norm)


def rotate_nearest(px: Column, height: int, width: int, angle: Column) -> Column:
    """Chips turned about their centre, nearest pixel, 0 outside."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        row, col = np.mgrid[0:height, 0:width]
        y, x = row + 0.5 - height / 2, col + 0.5 - width / 2
        for pixels, angles in batches:
            out = []
            for a, turn in zip(pixels, angles):
                t = np.radians(float(turn))
                c = np.floor(x * np.cos(t) - y * np.sin(t) + width / 2).astype(int)
                r = np.floor(x * np.sin(t) + y * np.cos(t) + height / 2).astype(int)
                ok = (c >= 0) & (c < width) & (r >= 0) & (r < height)
                image = np.asarray(a).reshape(height, width)
                out.append(np.where(ok, image[r.clip(0, height - 1), c.clip(0, width - 1)], 0).ravel())
            yield pd.Series(out)

    return run(px, angle)


def clip_ring(ring: Column, box: list[Column]) -> Column:
    """A ring cut to a box, edge by edge; exact for convex rings, with edges along the box for others."""

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def run(rings: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        def cut(points, axis, limit, sign):
            kept = []
            for i, p in enumerate(points):
                q = points[i - 1]
                dp, dq = sign * (p[axis] - limit), sign * (q[axis] - limit)
                if (dp >= 0) != (dq >= 0):
                    t = dq / (dq - dp)
                    kept.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
                if dp >= 0:
                    kept.append(p)
            return kept

        out = []
        for ring_, *limits in zip(rings, x0, y0, x1, y1):
            points = [(p["x"], p["y"]) for p in ring_]
            for axis, limit, sign in ((0, limits[0], 1), (1, limits[1], 1), (0, limits[2], -1), (1, limits[3], -1)):
                points = cut(points, axis, limit, sign) if points else points
            out.append([{"x": x, "y": y} for x, y in points])
        return pd.Series(out)

    return run(ring, *box)


def grid_names(windows: DataFrame, kept: DataFrame, key: str, row_of: str, seq: str, stem: str) -> DataFrame:
    """Names stem_row_col.tif of the kept windows: row counts all windows' rows, col the kept ones of a row from 0."""
    rows = windows.select(row_of).distinct().withColumn("row_no", F.dense_rank().over(Window.orderBy(row_of)) - 1)
    joined = windows.join(kept.select(key), key, "left_semi").join(F.broadcast(rows), row_of)  # a row for each row of windows
    col = F.row_number().over(Window.partitionBy(row_of).orderBy(seq)) - 1
    return joined.withColumn("col_no", col).withColumn("name", F.format_string(f"{stem}_%d_%d.tif", F.col("row_no"), F.col("col_no")))


def mosaic(tiles: DataFrame, key: list[str], tile: int = 256) -> DataFrame:
    """Where each tile goes in its mosaic, and the mosaic's size: offsets from the first row and column of the group."""
    g = Window.partitionBy(*key)
    first_r, last_r, first_c, last_c = F.min("row").over(g), F.max("row").over(g), F.min("col").over(g), F.max("col").over(g)
    return tiles.withColumns(
        {
            "off_y": (F.col("row") - first_r) * tile,
            "off_x": (F.col("col") - first_c) * tile,
            "height": (last_r - first_r + 1) * tile,
            "width": (last_c - first_c + 1) * tile,
        }
    )


def _inside(points: list[dict], height: int, width: int) -> np.ndarray:
    """Whether each pixel's centre is in a ring, by the even-odd rule; an edge's place is worked out once for each row."""
    y, x = np.arange(height)[:, None] + 0.5, np.arange(width) + 0.5
    inside = np.zeros((height, width), dtype=bool)
    for i, p in enumerate(points):
        q = points[i - 1]
        if p["y"] != q["y"]:
            crossed = (p["y"] > y) != (q["y"] > y)
            inside ^= crossed & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])
    return inside


def ring_mask(ring: Column, height: int, width: int) -> Column:
    """Mask of a ring in pixel coordinates (y down): 1 where a pixel's centre is inside by the even-odd rule."""

    @F.pandas_udf("array<int>")
    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([_inside(points, height, width).astype(np.int32).ravel() for points in rings])

    return run(ring)


def ring_rle(ring: Column, height: int, width: int) -> Column:
    """Run lengths of a ring's mask column by column, from zeros; the ring is in pixel coordinates (y down).

    One mask is held at a time, and none leaves the task.
    """

    @F.pandas_udf("array<bigint>")
    def run(rings: pd.Series) -> pd.Series:
        out = []
        for points in rings:
            flat = _inside(points, height, width).T.ravel()
            runs = np.diff(np.r_[0, np.flatnonzero(flat[1:] != flat[:-1]) + 1, len(flat)])
            out.append(np.r_[0, runs] if flat[0] else runs)
        return pd.Series(out)

    return run(ring)


def column_major(px: Column, height: int, width: int) -> Column:
    """Pixels column by column, the order of annotation run lengths."""
    index = F.array(*[F.lit(r * width + c) for c in range(width) for r in range(height)])
    return F.transform(index, lambda i: F.element_at(px, i + 1))


def mosaic_strips(tiles: DataFrame, key: list[str], px: str, tile: int = 256) -> DataFrame:
    """Tiles put together to strips, one for each row of tiles: key, row, left, width, filled, px (row-major).

    left is the mosaic's first column of tiles, and filled has the offsets in the strip at which there is a tile; where there
    is none the pixels are 0. A strip is the largest piece of a mosaic that is held at once.
    """
    laid = mosaic(tiles, key, tile).withColumn("left", F.col("col") - F.expr(f"off_x div {tile}"))
    grouped = laid.groupBy(*key, "row", "left", "width").agg(F.sort_array(F.collect_list(F.struct("off_x", px))).alias("_t"))

    @F.pandas_udf("array<int>")
    def run(parts: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for row, width in zip(parts, widths):
            strip = np.zeros((tile, int(width)), dtype=np.int32)
            for part in row:
                strip[:, part["off_x"] : part["off_x"] + tile] = np.asarray(part[px]).reshape(tile, tile)
            out.append(strip.ravel())
        return pd.Series(out)

    return grouped.select(*key, "row", "left", "width", F.array_distinct("_t.off_x").alias("filled"), run("_t", "width").alias(px))


def vectorise(df: DataFrame, column: str, vector: Callable[[np.ndarray], np.ndarray], name: str = "v") -> DataFrame:
    """Vectors of a plug-in, a function from an array to a vector, beside the rows they come from."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda a: np.asarray(vector(np.asarray(a)), dtype=float))

    return df.withColumn(name, run(column))
