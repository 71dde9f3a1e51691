"""Benchmark decontamination by Wu-Manber search over words.

Test strings are windows of `window` consecutive words of the benchmark items; an item of fewer words is one string.
For each string length m a shift table maps a block of BLOCK words to the distance the search may jump, blocks that end
a string have shift 0 and lead to a bucket keyed by that suffix block, and the bucket's strings are compared word by
word. Documents stream through unshuffled. The benchmark is read once, in slabs of bounded bytes (an item longer than that is
a slab of its own); SLABS of them are searched in one pass over the documents, and what is found is written between passes.

Defined results: words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; null or wordless documents have
no hits, null or wordless items no strings; rows of one item_id count as one item, and so do those without an id, which
items_sha256 passes over; texts of any length are searched whole; no result depends on an order, so there are no ties;
repeated documents are each searched; extra columns are ignored; an empty benchmark hits nothing, an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, materialise

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW, BLOCK = 10, 2
#: Bytes of benchmark text whose tables are broadcast together.
SLAB_BYTES = 4 << 20
#: Slabs that one pass over the documents searches, each in a worker of its own.
SLABS = 4


def words_of(text: bytes) -> list[bytes]:
    return WORDS.findall(text.lower())


def _order(item: str | None) -> tuple[bool, str]:
    return item is not None, item or ""


def item_windows(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> dict[tuple[bytes, ...], list[str | None]]:
    """Each test string with the ids of the items that hold it."""
    found: dict[tuple[bytes, ...], set[str | None]] = {}
    for item, text in items:
        words = words_of(text)
        if words:
            m = min(window, len(words))
            for i in range(len(words) - m + 1):
                found.setdefault(tuple(words[i : i + m]), set()).add(item)
    return {k: sorted(v, key=_order) for k, v in found.items()}


class WuManber:
    """Shift and bucket tables for strings of one length."""

    def __init__(self, strings: list[tuple[bytes, ...]]):
        self.m = len(strings[0])
        self.block = min(BLOCK, self.m)
        self.far = self.m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[bytes, ...]]] = {}
        for s in strings:
            for end in range(self.block, self.m + 1):
                key = b" ".join(s[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.far), self.m - end)
            self.bucket.setdefault(key, []).append(s)
        # Strings of a bucket by their first word, which is compared before the rest.
        self.prefix = {k: self._by_first(v) for k, v in self.bucket.items()}

    @staticmethod
    def _by_first(strings: list[tuple[bytes, ...]]) -> dict[bytes, list[tuple[bytes, ...]]]:
        out: dict[bytes, list[tuple[bytes, ...]]] = {}
        for s in strings:
            out.setdefault(s[0], []).append(s)
        return out

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        m, block, far, shift, prefix = self.m, self.block, self.far, self.shift.get, self.prefix
        i, n = m, len(words)
        while i <= n:
            key = words[i - 1] if block == 1 else words[i - 2] + b" " + words[i - 1]
            step = shift(key, far)
            if step:
                i += step
                continue
            for s in prefix[key].get(words[i - m], ()):
                if tuple(words[i - m : i]) == s:
                    yield i - m, s
                    break
            i += 1


def _tables(windows: dict[tuple[bytes, ...], list[str | None]]) -> list[WuManber]:
    by_length: dict[int, list[tuple[bytes, ...]]] = {}
    for s in windows:
        by_length.setdefault(len(s), []).append(s)
    return [WuManber(v) for _, v in sorted(by_length.items())]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        tables = _tables(windows)
        for batch in batches:
            spans, items = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                found = [(at, s) for t in tables for at, s in t.occurrences(words)] if words else []
                spans.append([x for at, s in found for x in (at, at + len(s))])
                items.append(sorted({i for _, s in found for i in windows[s]}, key=_order))
            spans = [a + b for a, b in zip(batch.column("spans").to_pylist(), spans)]
            items = [a + b for a, b in zip(batch.column("items").to_pylist(), items)]
            columns = [batch.column("id"), batch.column("text"), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "spans", "items"])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_hit, n_items, digests = [], [], [], []
        for text, spans, items in zip(batch.column("text"), batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
            n_words.append(len(words_of(text.as_py())))
            hit, reach = 0, 0
            for a, b in sorted(zip(spans[::2], spans[1::2])):
                hit += max(0, b - max(a, reach))
                reach = max(reach, b)
            n_hit.append(hit)
            n_items.append(len(set(items)))
            ids = sorted({i for i in items if i is not None})
            digests.append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        own = [batch.column(n) for n in batch.schema.names if n not in ("text", "spans", "items")]
        names = [n for n in batch.schema.names if n not in ("text", "spans", "items")]
        yield pa.RecordBatch.from_arrays(
            [*own, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests)],
            names=[*names, "n_words", "n_hit", "n_items", "items_sha256"],
        )


def _slabs(benchmark: DataFrame, item_col: str, text_col: str, slab_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), as_bytes(text_col).alias("text"))
    slab, size = [], 0
    for row in items.toLocalIterator():  # a partition at a time
        slab.append((row["item"], bytes(row["text"])))
        size += len(slab[-1][1])
        if size >= slab_bytes:
            yield slab
            slab, size = [], 0
    if slab:
        yield slab


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slab_bytes: int = SLAB_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    context = docs.sparkSession.sparkContext
    id_type = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text"))
    found = found.select("id", "text", F.array().cast("array<bigint>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for k, slab in enumerate(_slabs(benchmark, item_col, item_text_col, slab_bytes)):
        if k and k % SLABS == 0:
            found = materialise(found)
        windows = context.broadcast(item_windows(slab, window))
        found = found.mapInArrow(_search(windows), f"id {id_type}, text binary, spans array<bigint>, items array<string>")
    out = found.mapInArrow(
        _totals, f"id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string"
    )
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated")
    )


def _is_hit(shared):
    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = _tables(shared.value)
        for texts in batches:
            hits = []
            for text in texts:
                words = words_of(text.as_py())
                hits.append(bool(words) and any(next(t.occurrences(words), None) for t in tables))
            yield pa.array(hits, pa.bool_())

    return run


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slab_bytes: int = SLAB_BYTES,
) -> DataFrame:
    """The documents without any occurrence of a test string, with all columns."""
    context = docs.sparkSession.sparkContext
    for k, slab in enumerate(_slabs(benchmark, item_col, item_text_col, slab_bytes)):
        if k and k % SLABS == 0:
            docs = materialise(docs)
        docs = docs.where(~_is_hit(context.broadcast(item_windows(slab, window)))(as_bytes(text_col)))
    return docs
