"""Window generators and their augmentation: sliding, per zone, feature-centred, shifted, turned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.geometry import lit, rotated_corners

# Shifts in pixels and angles in degrees of augmented windows.
SHIFTS = (-50, -100, -150, 50, 100, 150)
ANGLES = (30, 45, 60, 75)


def _steps(low: Column, high: Column, size: float, step: float, extra: int) -> tuple[Column, Column]:
    """Number of window starts along an axis, and an array of their indexes that is empty if there are none."""
    n = F.ceil((high - low - size) / F.lit(float(step))).cast("int") + extra
    return n, F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def _grid(areas: DataFrame, box: list[str], size: tuple[float, float], step: tuple[float, float], extra: int) -> DataFrame:
    """areas with row, col, x, y for each window start; the last row and column are moved back to the far edge."""
    left, bottom, right, top = (F.col(c).cast("double") for c in box)
    height, width = size
    n_rows, rows = _steps(bottom, top, height, step[0], extra)
    n_cols, cols = _steps(left, right, width, step[1], extra)
    out = areas.withColumns({"n_rows": n_rows, "n_cols": n_cols}).withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))
    y = F.when(F.col("row") == F.col("n_rows") - 1, top - height).otherwise(bottom + F.col("row") * F.lit(float(step[0])))
    x = F.when(F.col("col") == F.col("n_cols") - 1, right - width).otherwise(left + F.col("col") * F.lit(float(step[1])))
    return out.withColumns({"x": x, "y": y})


def sliding_windows(spark: SparkSession, extent: tuple[float, float, float, float], size: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """win_no, row, col and lower-left corner x, y; row-major from the bottom. Nothing if the extent is too small."""
    left, bottom, right, top = extent
    area = spark.range(1).select(*[F.lit(float(v)).alias(n) for v, n in zip((left, bottom, right, top), ("l", "b", "r", "t"))])
    grid = _grid(area, ["l", "b", "r", "t"], size, step, 1)
    return grid.select((F.col("row") * F.col("n_cols") + F.col("col")).cast("long").alias("win_no"), "row", "col", "x", "y")


def ground_sizes(out_shape: tuple[int, int], pixel: tuple[float, float], step: tuple[int, int] | None = None) -> tuple[tuple[float, float], tuple[float, float]]:
    """Size and step of windows in ground units, (height, width) each, from a shape and a step in pixels; the step is the shape if none is given."""
    dx, dy = pixel[0], abs(pixel[1])
    rows, cols = step or out_shape
    return (dy * out_shape[1], dx * out_shape[0]), (dy * rows, dx * cols)


def sample_windows(
    spark: SparkSession,
    extent: tuple[float, float, float, float],
    out_shape: tuple[int, int],
    pixel: tuple[float, float],
    step: tuple[int, int] | None = None,
    move: bool = False,
    angle: int | None = None,
    zones: DataFrame | None = None,
    zone_box: list[str] | None = None,
) -> DataFrame:
    """Windows of a raster in the order that samples are made: slid over the extent, shifted, turned, held to zones, and kept inside the extent."""
    from tessella.operators.spatial import within_any

    size, stride = ground_sizes(out_shape, pixel, step)
    out = rectangles(sliding_windows(spark, extent, size, stride), size)
    if move:
        out = shifted(out, "win_no", pixel)
    if angle is not None:
        out = turned(out, "win_no", angle)
    left, bottom, right, top = extent
    out = out.where((F.col("left") >= left) & (F.col("right") <= right) & (F.col("top") <= top) & (F.col("bottom") >= bottom))
    return out if zones is None else within_any(out, zones, ["left", "bottom", "right", "top"], zone_box, max(size), "win_no")


def zone_windows(zones: DataFrame, box: list[str], size: tuple[float, float], step: tuple[float, float], keys: list[str]) -> DataFrame:
    """Windows over each zone's own box, with one row and column more than fit; overlaps stay."""
    return _grid(zones, box, size, step, 2).select(*keys, "row", "col", "x", "y")


def centred_windows(features: DataFrame, box: list[str], size: tuple[float, float], keys: list[str]) -> DataFrame:
    """Lower-left corner of a window about the centre of each feature's box."""
    xmin, ymin, xmax, ymax = map(F.col, box)
    x = xmin + (xmax - xmin) / 2 - lit(size[1]) / 2
    y = ymin + (ymax - ymin) / 2 - lit(size[0]) / 2
    return features.select(*keys, x.alias("x"), y.alias("y"))


def rectangles(windows: DataFrame, size: tuple[float, float]) -> DataFrame:
    """The box of each window from its lower-left corner."""
    return windows.withColumns(
        {"left": F.col("x"), "bottom": F.col("y"), "right": F.col("x") + float(size[1]), "top": F.col("y") + float(size[0])}
    ).drop("x", "y")


def pick(values: tuple[int, ...], number: Column) -> Column:
    """One of the values for a whole number; equal numbers pick equal values, so that reruns agree."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(number, F.lit(len(values))) + 1).cast("int"))


def shifted(windows: DataFrame, key: str, pixel: tuple[float, float] = (1.0, 1.0), primes: tuple[int, int] = (7919, 104729)) -> DataFrame:
    """Boxes moved by 50, 100 or 150 pixels on each axis."""
    dx = pick(SHIFTS, F.col(key) * primes[0]) * F.lit(float(pixel[0]))
    dy = pick(SHIFTS, F.col(key) * primes[1]) * F.lit(float(abs(pixel[1])))
    move = {"left": dx, "right": dx, "bottom": dy, "top": dy}
    return windows.withColumns({c: F.col(c) + d for c, d in move.items()})


def turned(windows: DataFrame, key: str, angle: int | None = None, prime: int = 7919) -> DataFrame:
    """Boxes with an angle (given, or picked from 30, 45, 60 and 75) and the corners of the turned rectangle."""
    if angle is not None and not 0 <= angle <= 90:
        raise ValueError("an angle is from 0 to 90")
    turn = F.lit(angle) if angle is not None else pick(ANGLES, F.col(key) * prime)
    out = windows.withColumns(
        {"angle": turn, "cx": (F.col("left") + F.col("right")) / 2, "cy": (F.col("bottom") + F.col("top")) / 2}
    )
    corners = rotated_corners(F.col("cx"), F.col("cy"), F.col("top") - F.col("bottom"), F.col("right") - F.col("left"), F.col("angle"))
    return out.withColumns({f"{axis}{i + 1}": c for i, corner in enumerate(corners) for axis, c in zip("xy", corner)})


def validation_plan(spark: SparkSession, features: DataFrame, box: list[str], key: str, extent: tuple[float, float, float, float], size: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """What is cut for validation, without augmentation: windows slid over the extent (`val`), and one about each feature (`val2`)."""
    slid = rectangles(sliding_windows(spark, extent, size, step), size).select(F.lit("val").alias("kind"), F.col("win_no").alias(key), "left", "bottom", "right", "top")
    spots = rectangles(centred_windows(features, box, size, [key]), size).select(F.lit("val2").alias("kind"), key, "left", "bottom", "right", "top")
    return slid.unionByName(spots)


def training_plan(features: DataFrame, key: str, copies: int = 8) -> DataFrame:
    """What is cut for training: each feature once as it is, and `copies` times moved and as often turned."""
    variants = F.array(
        F.struct(F.lit("raw").alias("kind"), F.lit(0).alias("copy")),
        *[F.struct(F.lit(k).alias("kind"), F.lit(i).alias("copy")) for i in range(copies) for k in ("move", "angle")],
    )
    return features.select(key, F.explode(variants).alias("v")).select(key, "v.kind", "v.copy")
