"""Removal of repeated word windows by level-wise doubling.

A window of `window` words that occurs twice holds, at any shorter length, a window that occurs twice. So short windows
are counted first; only where one is repeated is the window of twice its length looked at, and so on up to the full
length, or until nothing is left. At a length below the full one, each full window is represented by one short window
inside it, the one with the smallest hash (the leftmost of equals): equal full windows choose the same one at the same
place, so none is lost, and neighbours mostly share theirs, so few are counted.

Documents are dealt once into chunks, and every level reuses that exchange. A chunk sends each distinct hash once, with
a mark if it has it at two places, so a passage of very many documents counts once a chunk; hashes meet in ranges, and
back comes one bit for each. The smallest hash of a window is mixed once more before it is dealt, so that ranges are
filled evenly. The full length is compared by 96 bits, of two independent hashes of each word.

Words are [^\\x20\\x09-\\x0D]+, unchanged. Defined results: null texts have no words; documents shorter than the window
keep all; texts of any length are read whole (hashed a slice at a time, with some 40 bytes of memory a word of the
chunk); repeated rows repeat each other's windows, and rows without an id are dealt by their place too; windows that
overlap in one document count as two places; no result depends on an order, so there are no ties; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, mix, planned_bytes, shuffle_width, word_hashes

WINDOW = 35
#: Bytes of the source (as the planner knows them) that a chunk has and that a range of hashes stands for, about: where there
#: are fewer of them than shuffle partitions, they are made smaller, down to the second number.
CHUNK_BYTES, RANGE_BYTES = (4 << 20, 1 << 20), (32 << 20, 2 << 20)

def levels(window: int) -> list[int]:
    """Lengths counted in turn: about a quarter of the window, then doubled up to it."""
    out = [window]
    while out[0] > 8 and len(out) < 3:
        out.insert(0, -(-out[0] // 2))
    return out


def _window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each place; the last length - 1 places are missing."""
    now, have = words, 1
    while have < length:
        step = min(have, length - have)
        now = mix(now[: len(now) - step], now[step:])
        have += step
    return now


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest of the `width` values from each place."""
    at, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(h[left] <= h[right], left, right)
        have += step
    return at


class Chunk:
    """Window hashes of a chunk's documents, and which full windows may still be repeated."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.texts = window, texts
        self.words, self.counts = word_hashes(texts)
        ends = np.cumsum(self.counts)
        last = np.repeat(ends, self.counts)
        self.alive = np.flatnonzero(np.arange(len(self.words)) + window <= last)

    def entries(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows of this length that stand for live full windows: hash, check, whether at two places here; and
        for each live full window the index of its entry."""
        if not len(self.alive):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, bool), np.zeros(0, np.int64)
        h = _window_hashes(self.words, length)
        if length < self.window:
            at = _leftmost_least(h, self.window - length + 1)[self.alive]
            place, back = np.unique(at, return_inverse=True)
            dealt = mix(h[place], np.full(len(place), length, dtype=np.uint64))
            value, entry, n = np.unique(dealt, return_inverse=True, return_counts=True)
            return value, np.zeros(0, np.uint32), n > 1, entry[back]
        h, check = h[self.alive], self._checks()
        order = np.lexsort((check, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])]
        entry = np.empty(len(order), dtype=np.int64)
        entry[order] = np.cumsum(new) - 1
        first = order[new]
        return h[first], check[first], np.bincount(entry) > 1, entry

    def _checks(self) -> np.ndarray:
        """32 bits of a second hash of each live full window, from the texts that have one."""
        ends = np.cumsum(self.counts)
        text = np.searchsorted(ends, self.alive, side="right")
        mine, nth = np.unique(text, return_inverse=True)
        words, counts = word_hashes([self.texts[i] for i in mine.tolist()], seed=1)
        place = self.alive - (ends - self.counts)[text] + (np.cumsum(counts) - counts)[nth]
        return (_window_hashes(words, self.window)[place] >> np.uint64(32)).astype(np.uint32)

    def narrow(self, length: int, repeated: np.ndarray) -> None:
        """Keep the live windows whose entry of this length is repeated."""
        self.alive = self.alive[repeated[self.entries(length)[3]]] if len(repeated) else self.alive[:0]

    def covered(self) -> np.ndarray:
        """Words covered by live windows."""
        edge = np.bincount(self.alive, minlength=len(self.words) + 1) - np.bincount(self.alive + self.window, minlength=len(self.words) + 1)[: len(self.words) + 1]
        return np.cumsum(edge[: len(self.words)]) > 0


def _ranges(h: np.ndarray, n: int) -> np.ndarray:
    """Which of n ranges of hashes each is in; in the order of the hashes."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _repeated(marks: pa.Table | None) -> dict[int, np.ndarray]:
    """Bits by level, in the order of the entries, from the rows that came back to a chunk."""
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    if marks is not None:
        for level, part, n, bits in zip(*(marks.column(c).to_pylist() for c in ("level", "part", "n", "bits"))):
            out.setdefault(level, []).append((part, np.unpackbits(np.frombuffer(bits, np.uint8), count=n).view(bool)))
    return {level: np.concatenate([b for _, b in sorted(parts, key=lambda p: p[0])]) for level, parts in out.items()}


def _narrowed(docs: pa.Table, marks: pa.Table | None, window: int, done: list[int]) -> Chunk:
    chunk = Chunk([t.as_py() for t in docs.column("text").combine_chunks()] if docs.num_rows else [], window)
    repeated = _repeated(marks)
    for length in done:
        chunk.narrow(length, repeated.get(length, np.zeros(0, bool)))
    return chunk


_SENT = pa.schema([("chunk", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("sent", pa.binary())])
_MARKS = pa.schema([("chunk", pa.int32()), ("level", pa.int32()), ("part", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])


def _send(window: int, done: list[int], length: int, n_parts: int):
    def run(key, docs: pa.Table, marks: pa.Table | None) -> pa.Table:
        h, check, twice, _ = _narrowed(docs, marks, window, done).entries(length)
        part = _ranges(h, n_parts)
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        ends = np.r_[cuts[1:], len(part)]
        sent = [h[a:b].tobytes() + check[a:b].tobytes() + np.packbits(twice[a:b]).tobytes() for a, b in zip(cuts, ends)]
        chunk = key[0].as_py()
        return pa.table([pa.array([chunk] * len(cuts), pa.int32()), pa.array(part[cuts], pa.int32()), pa.array(ends - cuts, pa.int32()), pa.array(sent, pa.binary())], schema=_SENT)

    return run if done else lambda key, docs: run(key, docs, None)


def _count(length: int, full: bool):
    def run(rows: pa.Table) -> pa.Table:
        sizes = rows.column("n").to_pylist()
        hs, checks, counts = [], [], []
        for n, sent in zip(sizes, rows.column("sent")):
            raw = sent.as_py()
            hs.append(np.frombuffer(raw, "<u8", count=n))
            checks.append(np.frombuffer(raw, "<u4", count=n, offset=8 * n) if full else np.zeros(n, np.uint32))
            counts.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=(12 if full else 8) * n), count=n) + 1)
        h, check, count = np.concatenate(hs), np.concatenate(checks), np.concatenate(counts)
        order = np.lexsort((check, h)) if full else np.argsort(h)
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])]
        group = np.empty(len(order), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        repeated = (np.bincount(group, weights=count) > 1)[group]
        ends = np.cumsum(sizes)
        bits = [np.packbits(repeated[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
        return pa.table(
            [rows.column("chunk"), pa.array([length] * len(sizes), pa.int32()), rows.column("part"), rows.column("n"), pa.array(bits, pa.binary())],
            schema=_MARKS,
        )

    return run


def _keep(window: int, done: list[int], id_type: pa.DataType):
    def run(key, docs: pa.Table, marks: pa.Table) -> pa.Table:
        chunk = _narrowed(docs, marks, window, done)
        covered = chunk.covered()
        removed, kept, at = [], [], 0
        for text, n in zip(docs.column("text"), chunk.counts.tolist()):
            words, gone = text.as_py().split(), covered[at : at + n]
            removed.append(int(gone.sum()))
            kept.append(b" ".join(words if not removed[-1] else [w for w, g in zip(words, gone.tolist()) if not g]))
            at += n
        return pa.table(
            [docs.column("id"), pa.array(chunk.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
            schema=pa.schema([("id", id_type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())]),
        )

    return run


def _parts(docs: DataFrame) -> tuple[int, int]:
    """Chunks of documents and ranges of hashes, by the planner's size; as many as shuffle partitions if it does not know."""
    known, width = planned_bytes(docs), shuffle_width(docs.sparkSession)
    parts = lambda usual, least: max(1, known // usual, min(width, known // least)) if known else width
    return parts(*CHUNK_BYTES), parts(*RANGE_BYTES)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunks: int | None = None, ranges: int | None = None
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (the kept words, joined by one space)."""
    from pyspark.sql.pandas.types import to_arrow_type

    by_size = _parts(docs.select(id_col, text_col))
    n, n_ranges = chunks or by_size[0], ranges or by_size[1]
    kind = docs.schema[id_col].dataType
    nth = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    dealt = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id", "text", nth), F.lit(n)).cast("int"))
    marks: DataFrame | None = None
    done: list[int] = []
    for length in levels(window):
        send = _send(window, list(done), length, n_ranges)
        if marks is None:
            sent = dealt.groupBy("chunk").applyInArrow(send, "chunk int, part int, n int, sent binary")
        else:
            sent = dealt.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(send, "chunk int, part int, n int, sent binary")
        back = sent.groupBy("part").applyInArrow(_count(length, length == window), "chunk int, level int, part int, n int, bits binary")
        marks = back if marks is None else marks.unionByName(back)
        done.append(length)
    return (
        dealt.groupBy("chunk")
        .cogroup(marks.groupBy("chunk"))
        .applyInArrow(_keep(window, done, to_arrow_type(kind)), f"id {kind.simpleString()}, n_words long, n_removed long, kept binary")
        .select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
    )
