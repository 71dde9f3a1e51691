"""Chat formatting with offset-aligned loss masks.

Rows are range-partitioned by conversation and turn, so that a conversation of very many rows is dealt over several tasks,
and stream through in order. Each conversation is rendered whole, in parts of bounded length if it is very long, and
each part is encoded once with offsets. The spans of the assistants' texts are sorted, so the spans that each token
meets are found by binary search; a token is under the mask if it meets one.

A part is written with its token ids, their offsets, the mask and the spans. The reader rebuilds all from these: the ids
must decode to the formatted text, and the text under the loss mask is what the masked tokens have of the spans. It fails
if a character of a span has no masked token.

Rendered turn: `<turn role="ROLE">`, newline, text, `</turn>`, newline. Inside roles and texts a backslash becomes two,
`<turn` becomes `\\lturn`, `</turn` becomes `\\l/turn`, and in roles a quote becomes `\\q`, so that no marker can occur there.

Defined results: null texts and roles are empty; turns that tie are ordered by role, then text, repeated rows stay; null
turns come first; rows with a null conversation id form one conversation; texts of any length are formatted whole, a
turn is never cut; extra columns are ignored; an empty table gives no part and no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import as_bytes, shuffle_width

#: Code points of rendered turns that make a part full, and that are written or decoded together.
PART_CHARS, BATCH_CHARS = 1 << 18, 1 << 20
ASSISTANT = "assistant"
_TURN = re.compile(r'<turn role="([^"]*)">\n(.*?)</turn>\n', re.S)
_PLAIN = {"\\": "\\", "l": "<", "q": '"'}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn", "\\lturn").replace("</turn", "\\l/turn")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """Rendered text, and the spans of the assistants' texts as rows of (start, end)."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = '<turn role="' + escape(role).replace('"', "\\q") + '">\n', escape(text)
        if role == ASSISTANT and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(out), np.array(spans, dtype=np.int64).reshape(-1, 2)


def parse(rendered: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(rendered)]


def aligned(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token whether it meets a span; and the pieces of the text under the mask, merged where they touch."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), dtype=bool), np.zeros((0, 2), dtype=np.int64)
    first = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    last = np.searchsorted(spans[:, 0], offsets[:, 1], side="left")
    mask = last > first
    if not mask.any():
        return mask, np.zeros((0, 2), dtype=np.int64)
    token = np.repeat(np.flatnonzero(mask), (last - first)[mask])
    within = np.arange(len(token)) - np.repeat(np.cumsum((last - first)[mask]) - (last - first)[mask], (last - first)[mask])
    span = first[token] + within
    start = np.maximum(offsets[token, 0], spans[span, 0])
    end = np.minimum(offsets[token, 1], spans[span, 1])
    order = np.lexsort((end, start))
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    return mask, np.column_stack([start[new], end[np.r_[new[1:], True]]])


def masked_text(text: str, offsets: np.ndarray, mask: np.ndarray, spans: np.ndarray) -> str:
    """What the masked tokens have of the spans, unescaped; fails if a character of a span has no masked token."""
    _, pieces = aligned(offsets[mask], spans)
    covered = np.concatenate([np.arange(a, b) for a, b in pieces.tolist()]) if len(pieces) else np.zeros(0, np.int64)
    wanted = np.concatenate([np.arange(a, b) for a, b in spans.tolist()]) if len(spans) else np.zeros(0, np.int64)
    if not np.array_equal(covered, wanted):
        raise ValueError("the loss mask does not cover the assistants' texts")
    return "".join(unescape(text[a:b]) for a, b in pieces.tolist())


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer, which takes special tokens in a text for plain text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def encoded(tokenizer, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and offsets, as the library has them."""
    e = tokenizer.encode(text, add_special_tokens=False)
    ids = np.array(e.ids, dtype=np.int32)
    return ids, np.fromiter(chain.from_iterable(e.offsets), dtype=np.int32, count=2 * len(ids)).reshape(-1, 2)


_PART = "part long, alone boolean, turns long, formatted string, ids array<int>, token_start array<int>, token_end array<int>, mask array<boolean>, span_start array<int>, span_end array<int>"


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), kind))


def _formatter(path: str, part_chars: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, base = load(path), TaskContext.get().partitionId() << 32
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            conv, part, alone, turns, text, ids, offsets, mask, spans = zip(*done)
            arrays = [
                pa.array(conv, id_type), pa.array(part, pa.int64()), pa.array(alone, pa.bool_()), pa.array(turns, pa.int64()), pa.array(text, pa.string()),
                _lists(ids, pa.int32()), *(_lists([o[:, k] for o in offsets], pa.int32()) for k in (0, 1)), _lists(mask, pa.bool_()),
                *(_lists([x[:, k] for x in spans], pa.int32()) for k in (0, 1)),
            ]
            names = ["conv", "part", "alone", "turns", "formatted", "ids", "token_start", "token_end", "mask", "span_start", "span_end"]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def add(conv, part, alone, turns) -> int:
            text, spans = render(turns)
            ids, offsets = encoded(tokenizer, text)
            done.append((conv, base + part, alone, len(turns), text, ids, offsets, aligned(offsets, spans)[0], spans))
            return len(text)

        # The first and the last conversation of a partition may go on in another.
        conv, part, turns, size, begun, first, held = None, 0, [], 0, False, True, 0
        for batch in batches:
            for c, role, text in zip(batch.column("conv").to_pylist(), batch.column("role"), batch.column("text")):
                if begun and (c != conv or size >= part_chars):
                    held += add(conv, part, c != conv and not part and not first, turns)
                    first, part = first and c == conv, part + 1 if c == conv else 0
                    turns, size = [], 0
                    if held >= BATCH_CHARS:
                        yield flush()
                        held = 0
                conv, begun = c, True
                turns.append((role.as_py().decode("utf-8", "replace"), text.as_py().decode("utf-8", "replace")))
                size += len(turns[-1][1]) + len(turns[-1][0])
        if begun:
            add(conv, part, False, turns)
            yield flush()

    return run


def write_chats(rows: DataFrame, path: str, tokenizer: str, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", part_chars: int = PART_CHARS) -> None:
    """Formatted conversations: a row for each part, with token ids, their offsets, the mask, and the spans it was made of."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema[conv_col].dataType
    plain = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), as_bytes(role_col).alias("role"), as_bytes(text_col).alias("text"))
    ordered = plain.repartitionByRange(shuffle_width(rows.sparkSession), "conv", "turn").sortWithinPartitions("conv", "turn", "role", "text")
    parts = ordered.mapInArrow(_formatter(tokenizer, part_chars, to_arrow_type(kind)), f"conv {kind.simpleString()}, {_PART}")
    parts.write.mode("overwrite").parquet(path)


def _digest(tokenizer: str, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(tokenizer)
        conv, state = None, None

        def result(found: list[tuple]) -> pa.RecordBatch:
            names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*found), types)], names=names)

        def closed() -> tuple:
            n, turns, loss, loss_chars, chars = state
            return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            found = []
            numbers = {n: [np.asarray(v.values) for v in batch.column(n)] for n in ("ids", "token_start", "token_end", "span_start", "span_end")}
            masks = [v.values.to_numpy(zero_copy_only=False).astype(bool) for v in batch.column("mask")]
            texts = batch.column("formatted").to_pylist()
            for k, (c, text) in enumerate(zip(batch.column("conv").to_pylist(), texts)):
                if state and c != conv:
                    found.append(closed())
                    state = None
                if not state:
                    conv, state = c, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                if coder.decode(numbers["ids"][k].tolist(), skip_special_tokens=False) != text:
                    raise ValueError("the token ids do not decode to the formatted text")
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                offsets = np.column_stack([numbers["token_start"][k], numbers["token_end"][k]])
                loss = masked_text(text, offsets, masks[k], np.column_stack([numbers["span_start"][k], numbers["span_end"][k]]))
                state[2].update(loss.encode())
                state[3] += len(loss)
                state[4] += len(text)
            if found:
                yield result(found)
        if state:
            yield result([closed()])

    return run


def chat_digests(spark: SparkSession, path: str, tokenizer: str, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation, from the tokens, offsets and masks that `write_chats` has written.

    A conversation in one part is read where it lies; only those in several parts, and those that may be, are shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    parts = spark.read.parquet(path)
    kind = parts.schema["conv"].dataType
    schema = f"conv {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    run = _digest(tokenizer, to_arrow_type(kind))
    alone = parts.where("alone").drop("alone", "turns").mapInArrow(run, schema)
    others = parts.where("NOT alone").drop("alone", "turns").repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, schema)
    return alone.unionByName(others).withColumnRenamed("conv", conv_col)
