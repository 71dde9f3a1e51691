"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.storage import materialise, shared_dir

__all__ = ["as_bytes", "fresh_name", "in_slices", "join_groups", "materialise", "mix", "planned_bytes", "read", "shared_dir", "shuffle_width", "word_hashes"]

#: Keys whose group holds more than this share of all rows are joined by broadcast; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
#: Bytes of text whose words are hashed at once.
SLICE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_K1, _K2, _K3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, in order."""
    x = a * _K1 + (b ^ (b >> np.uint64(29))) * _K2
    x ^= x >> np.uint64(32)
    x *= _K3
    x ^= x >> np.uint64(29)
    return x


def _slices(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into slices of about SLICE_BYTES."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        space = _SPACE.search(text, at + SLICE_BYTES)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:] if at else text


def in_slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES together, at least one text each."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_BYTES:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K3
    x = (x ^ (x >> np.uint64(29))) * _K1
    return x ^ (x >> np.uint64(32))


def _hashed(line: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the words at `start` of `size` bytes; at least 8 bytes follow the last word."""
    eights = np.lib.stride_tricks.sliding_window_view(line, 8)
    salt = np.uint64(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    out = _final((eights[start].view("<u8")[:, 0] & _MASKS[np.minimum(size, 8)]) + salt)
    out += size.astype(np.uint64) * _K2
    more = np.flatnonzero(size > 8)
    tail = eights[start[more] + 8].view("<u8")[:, 0] & _MASKS[np.minimum(size[more] - 8, 8)]
    out[more] = out[more] * _K1 + _final(tail ^ salt)
    out = _final(out)
    long = np.flatnonzero(size > 16)
    if len(long):
        from xxhash import xxh64_intdigest

        raw = line.tobytes()
        ends = start[long] + size[long]
        out[long] = np.fromiter((xxh64_intdigest(raw[a:b], seed) for a, b in zip(start[long].tolist(), ends.tolist())), dtype=np.uint64, count=len(long))
    return out


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, and the number of words of each.

    Words of up to 16 bytes are mixed as two numbers, so that two of the same length up to 8 never have equal hashes;
    longer ones have their XXH64.
    """
    hashes, counts, parts, owners, size = [], np.zeros(len(texts), dtype=np.int64), [], [], 0

    def flush() -> None:
        line = np.frombuffer(b"\n".join(parts) + b"\n" + bytes(8), dtype=np.uint8)
        space = _IS_SPACE[line[:-8]]
        before = np.concatenate([[True], space[:-1]])
        start, end = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        hashes.append(_hashed(line, start, end - start, seed))
        limits = np.cumsum([len(p) + 1 for p in parts])
        np.add.at(counts, owners, np.diff(np.searchsorted(start, limits), prepend=0))
        parts.clear(), owners.clear()

    for k, text in enumerate(texts):
        for part in _slices(text):
            parts.append(part)
            owners.append(k)
            size += len(part) + 1
            if size >= SLICE_BYTES:
                flush()
                size = 0
    if parts:
        flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_width(spark: SparkSession, per_partition: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * per_partition


def planned_bytes(df: DataFrame) -> int:
    """Bytes that the planner takes a frame to have; 0 if it does not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of rows to one group row each, safe against a key that holds a large part of the rows.

    groups has unique non-null `key` and the group's row count in `count`; total is the number of rows. Groups of
    more than HOT_SHARE of the rows, of which there can be 1 / HOT_SHARE at most, are broadcast; the others are shuffled.
    """
    bound = max(1, int(total * HOT_SHARE))
    hot = groups.where(F.col(count) > bound)
    hot_rows = rows.join(F.broadcast(hot), key)
    # A key is told hot from a second small broadcast, so that hot rows never enter the shuffle of the others.
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(count) <= bound), key)
    return hot_rows.unionByName(cold_rows)


def as_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text; null becomes empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit("")).cast("binary")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that no column of the frame clashes with, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
