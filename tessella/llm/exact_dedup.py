"""Exact deduplication with two passes over a Bloom filter.

Pass 1 turns each text into a SHA-256 of its normalised form and sets bits in a segmented filter with two planes,
"seen" and "seen again"; the planes of all tasks are merged segment by segment. Pass 2 looks every row up: a row whose
bits are not all in "seen again" is certainly unique and passes straight through, only the rest is shuffled and grouped
by the full digest, which settles false positives exactly.

Defined results: null text equals the empty text; of rows that tie on text and id, one is kept; a null id is smaller
than any other and is kept only if all ids of its group are null; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, join_groups, materialise, shared_dir

#: Filter bits per row, bits set per row, and bytes of one plane of a segment.
BITS_PER_ROW, PROBES, SEGMENT_BYTES = 16, 3, 1 << 13
#: Most bytes of the plane that is broadcast.
MAX_FILTER_BYTES = 128 << 20
#: Copies of rows equal in text and id that one task makes rows of again.
SPREAD = 1 << 14


def _slots(digest: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each digest and its PROBES bit positions there; digest has rows of four 64-bit words."""
    segment = (digest[:, 0] % np.uint64(segments)).astype(np.int64)
    bits = np.stack([digest[:, 1 + i] % np.uint64(SEGMENT_BYTES * 8) for i in range(PROBES)], axis=1).astype(np.int64)
    return segment, bits


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 4)


def _digests(ranges: int):
    """id, digest and the range that the digest is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = [hashlib.sha256(text.as_py().lower()).digest() for text in batch.column("text")]
            at = [int.from_bytes(sha[-4:]) * ranges >> 32 for sha in shas]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shas, pa.binary()), pa.array(at, pa.int32())], names=["id", "sha", "at"])

    return run


def _planes(segments: int):
    """Sparse planes of one task: for each segment the sorted bit positions seen, and those seen again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            digest = _words(batch.column("sha"))
            segment, bits = _slots(digest, segments)
            rows, copies = np.unique(np.column_stack([segment, bits]), axis=0, return_counts=True)
            cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            ends = np.r_[cuts[1:], len(rows)]
            once, again = [], []
            for a, b in zip(cuts, ends):
                values, counts = np.unique(rows[a:b, 1:], return_counts=True)
                twice = np.union1d(values[counts > 1], rows[a:b, 1:][copies[a:b] > 1])
                once.append(values.astype("<u4").tobytes())
                again.append(twice.astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[cuts, 0]), pa.array(once, pa.binary()), pa.array(again, pa.binary())],
                names=["segment", "once", "again"],
            )

    return run


def _merge(parts):
    """Merged "seen again" plane of one segment, as packed bits."""
    import pandas as pd

    seen = np.zeros(SEGMENT_BYTES * 8, dtype=bool)
    again = np.zeros_like(seen)
    for once_bytes, again_bytes in zip(parts["once"], parts["again"]):
        once = np.frombuffer(once_bytes, "<u4")
        again[once[seen[once]]] = True
        seen[once] = True
        again[np.frombuffer(again_bytes, "<u4")] = True
    return pd.DataFrame({"segment": [int(parts["segment"].iloc[0])], "plane": [np.packbits(again).tobytes()]})


def _lookup(segments: int, planes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = planes.value
        for batch in batches:
            if not batch.num_rows:
                maybe = np.zeros(0, dtype=bool)
            else:
                segment, bits = _slots(_words(batch.column("sha")), segments)
                maybe = np.ones(len(segment), dtype=bool)
                for i in range(PROBES):
                    b = bits[:, i]
                    maybe &= (table[segment, b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sha"), pa.array(maybe)], names=["id", "sha", "maybe"])

    return run


def _spread(rows: DataFrame, spread: int) -> DataFrame:
    """Each row `copies` times, with `nth` from 1; the copies of one row are made in several tasks if they are many."""
    few = rows.where(F.col("copies") <= spread).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    chunks = rows.where(F.col("copies") > spread).withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {spread})"))).repartition("sha", "id", "chunk")
    many = chunks.withColumn("nth", F.explode(F.expr(f"sequence(chunk * {spread} + 1, least(copies, (chunk + 1) * {spread}))"))).drop("chunk")
    return few.unionByName(many)


def _looked_up(hashed: DataFrame, ranges: int, segments: int, id_type: str) -> DataFrame:
    """id, sha and `maybe`, whether the digest may be repeated: both passes of the filter, range by range."""
    spark, path = hashed.sparkSession, shared_dir(hashed.sparkSession)
    for k in range(ranges):
        rows = hashed.where(F.col("at") == k).select("id", "sha") if ranges > 1 else hashed.select("id", "sha")
        merged = (
            rows.select("sha")
            .mapInArrow(_planes(segments), "segment long, once binary, again binary")
            .groupBy("segment")
            .applyInPandas(_merge, "segment long, plane binary")
        )
        table = np.zeros((segments, SEGMENT_BYTES), dtype=np.uint8)
        for row in merged.collect():  # MAX_FILTER_BYTES at most
            table[row["segment"]] = np.frombuffer(row["plane"], dtype=np.uint8)
        planes = spark.sparkContext.broadcast(table)
        rows.mapInArrow(_lookup(segments, planes), f"id {id_type}, sha binary, maybe boolean").write.mode("append").parquet(path)
        planes.destroy()
    return spark.read.schema(f"id {id_type}, sha binary, maybe boolean").parquet(path)


def group_exact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = BITS_PER_ROW,
    max_filter_bytes: int = MAX_FILTER_BYTES,
    spread: int = SPREAD,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    id_type = docs.schema[id_col].dataType.simpleString()
    total = docs.count()
    segments = max(1, -(-total * bits_per_row // (SEGMENT_BYTES * 8)))
    ranges = -(-segments // max(1, max_filter_bytes // SEGMENT_BYTES))
    hashed = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text")).mapInArrow(_digests(ranges), f"id {id_type}, sha binary, at int")
    hashed = materialise(hashed.sortWithinPartitions("at") if ranges > 1 else hashed)
    looked = _looked_up(hashed, ranges, -(-segments // ranges), id_type)
    unique = looked.where(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    # Equal rows are counted before the join; each count is spread to rows again at the end.
    rows = materialise(looked.where("maybe").groupBy("sha", "id").agg(F.count("*").alias("copies")))
    groups = rows.groupBy("sha").agg(
        F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("members")
    )
    repeated = join_groups(rows, groups, "sha", "members", total)
    again = _spread(repeated, spread).select(
        "id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "sha"
    )
    return unique.unionByName(again).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )
