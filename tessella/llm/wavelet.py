"""Wavelet matrix over token ids, and the compressed shard file that holds one.

A shard has `width` bit-planes. Plane k holds bit k (from the top) of every id, in the order that a stable sort by the
bits above leaves; each plane comes with the number of ones before every BLOCK bits, so that rank is a lookup and a
count in one block, and select a binary search in that directory and a count in one block. Access to any token, counts
of an id in any range, and the places of an id need no other index.

File: MAGIC, then the header as little-endian unsigned 64-bit numbers (tokens, width, documents, bytes of the document
table), the document table, then for each plane its number of zeros, the length of its compressed bytes (both unsigned
64-bit) and those bytes (zstd of directory and bits). The document table is a zstd-compressed Arrow stream of ids, of
whatever type they have, and token counts.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard

MAGIC = b"TSLWM\x00\x00\x02"
BLOCK = 512


class Plane:
    """A bit vector with rank and select."""

    def __init__(self, bits: np.ndarray, n: int, ranks: np.ndarray | None = None):
        self.packed, self.n = bits, n
        if ranks is None:
            padded = np.zeros(-(-n // BLOCK) * BLOCK // 8, dtype=np.uint8)
            padded[: len(bits)] = bits
            ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
            ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        self.ranks = ranks

    @cached_property
    def flags(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n).view(bool)

    def bit(self, i: np.ndarray) -> np.ndarray:
        return (self.packed[i >> 3] >> (7 - (i & 7)).astype(np.uint8)) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first i bits."""
        block = i // BLOCK
        inside = self.packed[block * (BLOCK // 8) : -(-i // 8)]
        count = int(self.ranks[block]) + int(np.bitwise_count(inside).sum(dtype=np.int64))
        if i % 8:
            count -= int(inside[-1] & (0xFF >> (i % 8))).bit_count()
        return count

    def select(self, k: int, one: bool) -> int:
        """Place of the k-th (from 0) bit that is `one`."""
        before = self.ranks.astype(np.int64) if one else np.minimum(np.arange(len(self.ranks), dtype=np.int64) * BLOCK, self.n) - self.ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.packed[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - before[block]])


class WaveletMatrix:
    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros, self.width = n, planes, zeros, len(planes)

    @classmethod
    def of(cls, tokens: np.ndarray, width: int | None = None) -> WaveletMatrix:
        if width is None:
            width = max(1, int(tokens.max()).bit_length()) if len(tokens) else 1
        now = tokens.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(width):
            flags = (now & now.dtype.type(1 << (width - 1 - level))) != 0
            planes.append(Plane(np.packbits(flags), len(now)))
            low = now[~flags]
            zeros.append(len(low))
            now = np.concatenate([low, now[flags]])
        return cls(len(tokens), planes, zeros)

    def decode(self) -> np.ndarray:
        """All tokens in order, from the last plane up."""
        now = np.zeros(self.n, dtype=np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            flags, up = self.planes[level].flags, np.empty_like(now)
            up[~flags] = now[: self.zeros[level]]
            up[flags] = now[self.zeros[level] :] | now.dtype.type(1 << (self.width - 1 - level))
            now = up
        return now

    def access(self, i: int) -> int:
        value = 0
        for plane, zeros in zip(self.planes, self.zeros):
            one = int(plane.bit(np.array([i]))[0])
            ones = plane.rank1(i)
            value, i = value << 1 | one, zeros + ones if one else i - ones
        return value

    def _descend(self, token: int, a: int, b: int) -> tuple[int, int]:
        """Where the occurrences of a token in [a, b) end up below the last plane."""
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            x, y = plane.rank1(a), plane.rank1(b)
            a, b = (zeros + x, zeros + y) if token >> (self.width - 1 - level) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """Occurrences of a token among those from a to before b."""
        if token >> self.width:
            return 0
        x, y = self._descend(token, a, self.n if b is None else b)
        return y - x

    def locate(self, token: int) -> list[int]:
        """Places of a token, in order."""
        if token >> self.width:
            return []
        x, y = self._descend(token, 0, self.n)
        found = []
        for i in range(x, y):
            for level in range(self.width - 1, -1, -1):
                one = bool(token >> (self.width - 1 - level) & 1)
                i = self.planes[level].select(i - self.zeros[level] if one else i, one)
            found.append(i)
        return sorted(found)


def pack(tokens: np.ndarray, documents: list[tuple[object, int]], id_type: pa.DataType | None = None) -> bytes:
    """A shard file of the tokens of (id, number of tokens) documents."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.of(tokens)
    rows = pa.table({"id": pa.array([d for d, _ in documents], id_type), "n": pa.array([n for _, n in documents], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows)
    table = squeeze(sink.getvalue().to_pybytes())
    out = [MAGIC, struct.pack("<4Q", matrix.n, matrix.width, len(documents), len(table)), table]
    for plane, zeros in zip(matrix.planes, matrix.zeros):
        body = squeeze(plane.ranks.tobytes() + plane.packed.tobytes())
        out += [struct.pack("<2Q", zeros, len(body)), body]
    return b"".join(out)


def unpack(blob: bytes) -> tuple[WaveletMatrix, list[list]]:
    """The matrix and the document table of a shard file."""
    if blob[: len(MAGIC)] != MAGIC:
        raise ValueError("not a shard file")
    expand = zstandard.ZstdDecompressor().decompress
    n, width, documents, size = struct.unpack_from("<4Q", blob, len(MAGIC))
    at = len(MAGIC) + 32
    rows = pa.ipc.open_stream(expand(blob[at : at + size])).read_all()
    table = [list(r) for r in zip(rows.column("id").to_pylist(), rows.column("n").to_pylist())]
    if len(table) != documents:
        raise ValueError("the document table is cut short")
    at += size
    planes, zeros, ranks = [], [], 4 * (-(-n // BLOCK) + 1)
    for _ in range(width):
        zero, size = struct.unpack_from("<2Q", blob, at)
        body = expand(blob[at + 16 : at + 16 + size])
        planes.append(Plane(np.frombuffer(body, np.uint8, offset=ranks), n, np.frombuffer(body, "<u4", count=ranks // 4)))
        zeros.append(zero)
        at += 16 + size
    return WaveletMatrix(n, planes, zeros), table
