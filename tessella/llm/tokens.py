"""Token-id output: documents in ascending id order, encoded to wavelet-matrix shards, and read back from them.

Documents are range-partitioned by id (and a hash of the text, so that one id of many rows is split too), sorted, and
encoded in that order; a shard is closed when it holds `shard_tokens` tokens. A shard is one compressed file, kept as the
bytes of one row of a Parquet table, so that any file system Spark writes to can hold it. There are as many partitions as
the planner's size of the documents asks for, and one for each shuffle partition at least.

Texts of simple characters are encoded chunk by chunk: no piece that the tokenizer makes crosses white space, so a
chunk's ids are looked up in a bounded memo, and unknown chunks of a slice are encoded together. Other texts are
encoded whole. Both give the ids of `Tokenizer.encode(text, add_special_tokens=False)`.

Defined results: null texts are empty and have the end id alone; null document ids come first; rows that tie on id are
ordered by a hash of the text; texts of any length are encoded whole, and a document is never cut between shards; repeated
rows are documents of their own; ids may have any type; extra columns are ignored; an empty table gives no shard and no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import as_bytes, planned_bytes, shuffle_width
from tessella.llm.wavelet import pack, unpack

SHARD_TOKENS, END_ID = 1 << 20, 2
#: Bytes of the source, as the planner knows them, that a partition encodes, about.
PART_BYTES = 64 << 20
#: Characters encoded together, and chunks that the memo holds before it is trimmed.
SLICE_CHARS, MEMO = 1 << 20, 400_000
#: Texts with anything else, or with what may begin a special token, are encoded whole.
_ODD = re.compile("[^\t-\r -~\xa1-įı-ſ]|<\\|")


class Encoder:
    """Ids of texts by a lower-casing word BPE whose pieces end in a suffix; other kinds of tokenizer encode whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        import json

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [re.escape(t["content"]) for t in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(added) if added else "(?!)", re.I)
        suffix = spec["model"].get("end_of_word_suffix")
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.pattern = None
        if suffix and kinds == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["invert"]:
            import regex

            self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
            self.plain = Tokenizer(self.whole.model)
            self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(self.whole.get_vocab_size(), dtype=bool)
            for token, i in self.whole.get_vocab().items():
                self.ends[i] = token.endswith(suffix)
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            hidden = [b for b in range(256) if b not in shown]
            self.shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._start([])
        self.flat, self.start, self.size, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _start(self, chunks: list[str]) -> None:
        """A memo of these chunks, numbered from 0; what is asked for beyond them is numbered on and noted as fresh."""
        fresh: list[str] = []

        class Memo(dict):
            def __missing__(self, chunk: str) -> int:
                self[chunk] = n = len(self)
                fresh.append(chunk)
                return n

        self.memo, self.fresh = Memo(zip(chunks, range(len(chunks)))), fresh

    def _trim(self) -> None:
        """Keep the chunks used most often, at most half of MEMO and none used once; halve what is known of their use."""
        order = np.argsort(-self.used, kind="stable")[: MEMO // 2]
        kept = order[self.used[order] > 1]
        names = list(self.memo)
        self._start([names[i] for i in kept.tolist()])
        start, size = self.start[kept], self.size[kept]
        ends = np.cumsum(size)
        self.flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]
        self.start, self.size, self.used = ends - size, size, self.used[kept] // 2

    def _learn(self) -> bool:
        """Encode the chunks seen for the first time; False if pieces and tokens do not agree."""
        pieces, counts = [], []
        for chunk in self.fresh:
            # Letters alone are one piece, and a mark after letters another; the pattern finds the rest.
            if chunk.isalpha():
                found = [chunk]
            elif chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():
                found = [chunk[:-1], chunk[-1]]
            else:
                found = self.pattern.findall(chunk)
            counts.append(len(found))
            pieces += [p if p.isascii() else p.encode().decode("latin-1").translate(self.shown) for p in found]
        ids = np.array(self.plain.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, dtype=np.uint32)
        # A piece ends where a token with the suffix does; a chunk where its last piece does.
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(pieces):
            return False
        cuts = np.r_[0, ends][np.r_[0, np.cumsum(counts)].astype(np.int64)]
        self.start = np.r_[self.start, len(self.flat) + cuts[:-1]]
        self.size = np.r_[self.size, np.diff(cuts)]
        self.flat = np.r_[self.flat, ids]
        self.fresh.clear()
        return True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        codes: list[list[int]] = []
        simple = []
        for i, text in enumerate(texts):
            if self.pattern is None or _ODD.search(text) or self.special.search(text):
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                codes.append(list(map(self.memo.__getitem__, text.lower().split())))
                simple.append(i)
        if self.fresh and not self._learn():
            # The tokenizer is of another kind after all: all texts are encoded whole.
            self.pattern = None
            self._start([])
            return self.encode(texts)
        if simple:
            code = np.fromiter(chain.from_iterable(codes), dtype=np.int64)
            self.used = np.bincount(code, minlength=len(self.size)) + np.pad(self.used, (0, len(self.size) - len(self.used)))
            start, size = self.start[code], self.size[code]
            ends = np.cumsum(size)
            ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]
            words = np.cumsum([len(part) for part in codes])
            cut = np.r_[0, ends][np.r_[0, words]]
            for k, i in enumerate(simple):
                out[i] = ids[cut[k] : cut[k + 1]]
        if len(self.memo) > MEMO and self.pattern is not None:
            self._trim()
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _shards(path: str, shard_tokens: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        partition, nth = TaskContext.get().partitionId(), 0
        parts, documents, size = [], [], 0

        def close():
            nonlocal nth, parts, documents, size
            blob = pack(np.concatenate(parts), documents, id_type)
            row = [partition, nth, len(documents), size, blob]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            nth, parts, documents, size = nth + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["part", "nth", "documents", "tokens", "shard"])

        def slices(batch):
            ids, texts, chars = [], [], 0
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids.append(i)
                texts.append(text.as_py().decode("utf-8", "replace"))
                chars += len(texts[-1])
                if chars >= SLICE_CHARS:
                    yield ids, texts
                    ids, texts, chars = [], [], 0
            if ids:
                yield ids, texts

        for batch in batches:
            for ids, texts in slices(batch):
                for i, tokens in zip(ids, coder.encode(texts)):
                    parts += [tokens, np.array([END_ID], dtype=np.uint32)]
                    documents.append((i, len(tokens) + 1))
                    size += len(tokens) + 1
                    if size >= shard_tokens:
                        yield close()
        if documents:
            yield close()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("id"), as_bytes(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    width = max(shuffle_width(docs.sparkSession), planned_bytes(docs.select(id_col, text_col)) // PART_BYTES)
    ordered = rows.repartitionByRange(width, "id", "tie").sortWithinPartitions("id", "tie")
    kind = to_arrow_type(docs.schema[id_col].dataType)
    ordered.select("id", "text").mapInArrow(_shards(tokenizer, shard_tokens, kind), "part long, nth long, documents long, tokens long, shard binary").write.mode(
        "overwrite"
    ).parquet(path)


def _documents(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, nth, blob in zip(batch.column("part").to_pylist(), batch.column("nth").to_pylist(), batch.column("shard")):
                matrix, documents = unpack(blob.as_py())
                ids = matrix.decode().astype("<u4")
                sizes = np.array([n for _, n in documents], dtype=np.int64)
                starts = np.cumsum(sizes) - sizes
                sums = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(starts.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _ in documents], id_type),
                        pa.array(np.full(len(sizes), part)),
                        pa.array(np.full(len(sizes), nth)),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["id", "part", "nth", "inner", "n_tokens", "ids_crc32"],
                )

    return run


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """part, nth and `base`, the tokens of all shards before; in two levels, so that one task orders parts only."""
    shards = spark.read.parquet(path).select("part", "nth", "tokens")
    inside = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(across), F.lit(0)).alias("before"))
    own = shards.select("part", "nth", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("own"))
    return own.join(parts, "part").select("part", "nth", (F.col("own") + F.col("before")).alias("base"))


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """One row per document, from the shards: id, start, n_tokens, ids_crc32."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    rows = (
        spark.read.parquet(path)
        .select("part", "nth", "shard")
        .mapInArrow(
            _documents(to_arrow_type(_parse_datatype_string(id_type))),
            f"id {id_type}, part long, nth long, inner long, n_tokens long, ids_crc32 long",
        )
    )
    return rows.join(shard_starts(spark, path), ["part", "nth"]).select(
        F.col("id").alias(id_col), (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32"
    )


def _seek(token: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, nth, blob in zip(batch.column("part").to_pylist(), batch.column("nth").to_pylist(), batch.column("shard")):
                matrix, _ = unpack(blob.as_py())
                places = matrix.locate(token)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), part)), pa.array(np.full(len(places), nth)), pa.array(places, pa.int64())], names=["part", "nth", "inner"]
                )

    return run


def locate_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Places of a token id in the whole output, as a column `place`."""
    found = spark.read.parquet(path).select("part", "nth", "shard").mapInArrow(_seek(token), "part long, nth long, inner long")
    return found.join(shard_starts(spark, path), ["part", "nth"]).select((F.col("base") + F.col("inner")).alias("place"))


def token_documents(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", **args: int) -> DataFrame:
    """Write the shards, and return what `read_documents` finds in them."""
    write_shards(docs, path, tokenizer, id_col, text_col, **args)
    return read_documents(docs.sparkSession, path, id_col, docs.schema[id_col].dataType.simpleString())
