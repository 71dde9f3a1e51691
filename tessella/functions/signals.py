"""Signals, scores and learning-rate schedules."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_keys(keys: Column, most: float = 100.0) -> Column:
    return F.transform(keys, lambda x: F.least(x, F.lit(most)) / F.lit(most))


def clip_label(label: Column, most: int = 100) -> Column:
    return F.least(label.cast("int"), F.lit(most))


def tolerance_score(predicted: Column, target: Column) -> Column:
    apart = F.abs(predicted - target)
    return F.when(apart <= 5, 1.0).when(apart <= 10, 0.6).otherwise(0.0)


def encode_array(values: Column, dtype: str = "float64") -> Column:
    """struct<buf, dtype, shape> of an array, C order."""

    @F.pandas_udf("struct<buf: binary, dtype: string, shape: string>")
    def run(column: pd.Series) -> pd.DataFrame:
        arrays = [np.asarray(v, dtype=dtype) for v in column]
        return pd.DataFrame({"buf": [a.tobytes() for a in arrays], "dtype": dtype, "shape": [",".join(map(str, a.shape)) for a in arrays]})

    return run(values)


def decode_array(encoded: Column) -> Column:
    """Values of an encoded array, flat."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.DataFrame) -> pd.Series:
        out = []
        for buf, dtype, shape in zip(rows["buf"], rows["dtype"], rows["shape"]):
            a = np.frombuffer(buf, dtype=dtype)
            if a.size != math.prod(int(x) for x in shape.split(",")):
                raise ValueError(f"{a.size} values do not have the shape {shape}")
            out.append(a.astype(float))
        return pd.Series(out)

    return run(encoded)


def learning_rate(step: Column, loops: int, warmup: float = 0.01, most: float = 1.0, least: float = 0.0, warmup_power: float | None = None, power: float | None = 2.0) -> Column:
    """Factor of the learning rate at a step: a cosine rise over the warm-up, then a cosine fall raised to a power."""
    if loops <= 0 or not 0.0 < warmup < 1.0 or most <= least:
        raise ValueError("loops above 0, a warm-up between 0 and 1 and most above least are needed")
    rise = int(loops * warmup)
    fall = loops - rise

    def curve(i: Column, n: int, p: float | None) -> Column:
        value = (F.cos(i / F.lit(float(n)) * F.lit(math.pi)) + 1.0) * 0.5
        return (value if p is None else F.pow(value, F.lit(float(p)))) * F.lit(most - least) + F.lit(least)

    falling = curve(step - rise, fall, power)
    return F.when(step < rise, curve(F.lit(rise - 1) - step, rise, warmup_power)).otherwise(falling) if rise else falling


def conv_forward(weights: dict[str, np.ndarray], query: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Forward pass of the residual 1-D network: (B, T) query and keys to percentages (B,).

    Layers: 2 to 32, 32 to 64 and 64 to 128 channels (the last two of stride 2), two residual blocks after each of these two,
    then two full layers and a sigmoid. Batch norms are folded into the weights.
    """

    def conv(x: np.ndarray, name: str, stride: int = 1, pad: int = 1) -> np.ndarray:
        w, b = weights[f"{name}.w"], weights[f"{name}.b"]
        x = np.pad(x, ((0, 0), (0, 0), (pad, pad)))
        view = np.lib.stride_tricks.sliding_window_view(x, w.shape[2], axis=2)[:, :, ::stride]
        y = np.einsum("bctk,ock->bot", view, w, optimize=True) + b[None, :, None]
        return np.where(y > 0, y, 0.01 * y)

    x = conv(np.stack([query, keys], axis=1), "conv1")
    for stage in (2, 3):
        x = conv(x, f"conv{stage}", stride=2)
        for block in (0, 1):
            x = x + conv(conv(x, f"res{stage}{block}a", pad=0), f"res{stage}{block}b")
    x = x.reshape(len(x), -1) @ weights["fc1.w"].T + weights["fc1.b"]
    x = x @ weights["fc2.w"].T + weights["fc2.b"]
    return 100.0 / (1.0 + np.exp(-x[:, 0]))


def conv_weights(length: int, seed: int = 1024) -> dict[str, np.ndarray]:
    """Random weights of the network for signals of one length."""
    rng = np.random.default_rng(seed)
    shapes = {"conv1": (32, 2, 3), "conv2": (64, 32, 3), "conv3": (128, 64, 3)}
    for stage, c in ((2, 64), (3, 128)):
        for block in (0, 1):
            shapes |= {f"res{stage}{block}a": (c // 2, c, 1), f"res{stage}{block}b": (c, c // 2, 3)}
    out = {}
    for name, shape in shapes.items():
        out[f"{name}.w"] = rng.normal(0, (2 / (shape[1] * shape[2])) ** 0.5, shape)
        out[f"{name}.b"] = np.zeros(shape[0])
    flat = 128 * ((length + 3) // 4)
    out |= {"fc1.w": rng.normal(0, flat**-0.5, (100, flat)), "fc1.b": np.zeros(100), "fc2.w": rng.normal(0, 0.1, (1, 100)), "fc2.b": np.zeros(1)}
    return out
