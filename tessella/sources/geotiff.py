"""Minimal GeoTIFF: uncompressed strips of 8, 16, 32 or 64 bit samples, with an affine transform and a CRS text."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}
_FORMATS = {"u": 1, "i": 2, "f": 3}
# Tags of the format.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _SAMPLES, _ROWS, _COUNTS, _PLANAR, _FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
_SCALE, _TIE, _MATRIX, _ASCII = 33550, 33922, 34264, 34737


@dataclass
class Raster:
    """Pixels as (bands, height, width), transform (a, b, c, d, e, f) and the text of the CRS."""

    data: np.ndarray
    transform: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    crs: str = ""


def encode(raster: Raster, georeferenced: bool = True) -> bytes:
    """Bytes of a file with one strip for each band. Plain images (not georeferenced) have one or three bands."""
    data = np.ascontiguousarray(raster.data)
    if data.ndim != 3:
        raise ValueError("a raster has bands, height and width")
    bands, height, width = data.shape
    if not georeferenced and bands not in (1, 3):
        raise ValueError("a plain image has one or three bands")
    kind = _FORMATS.get(data.dtype.kind)
    if kind is None or data.dtype.itemsize > 8:
        raise ValueError(f"no sample format for {data.dtype}")
    strips = [b.astype(data.dtype.newbyteorder("<")).tobytes() for b in data]
    tags: list[tuple[int, int, tuple]] = [
        (_WIDTH, 4, (width,)), (_HEIGHT, 4, (height,)), (_BITS, 3, (data.dtype.itemsize * 8,) * bands), (_COMPRESSION, 3, (1,)),
        (_PHOTOMETRIC, 3, (2 if bands == 3 else 1,)), (_OFFSETS, 4, (0,) * bands), (_SAMPLES, 3, (bands,)), (_ROWS, 4, (height,)),
        (_COUNTS, 4, tuple(map(len, strips))), (_PLANAR, 3, (2,)), (_FORMAT, 3, (kind,) * bands),
    ]
    if georeferenced:
        a, b, c, d, e, f = raster.transform
        tags.append((_MATRIX, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
        if raster.crs:
            tags.append((_ASCII, 2, (raster.crs.encode() + b"\0",)))

    def value(kind: int, values: tuple) -> bytes:
        return values[0] if kind == 2 else struct.pack(f"<{len(values)}{_TYPES[kind][0]}", *values)

    start = 8 + 2 + 12 * len(tags) + 4
    extra = sum(len(v) + len(v) % 2 for t, k, x in tags if len(v := value(k, x)) > 4)
    at, offsets = start + extra, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    entries, outside, place = [], [], start
    for tag, kind, values in tags:
        body = value(kind, tuple(offsets) if tag == _OFFSETS else values)
        count = len(body) if kind == 2 else len(values)
        if len(body) > 4:
            entries.append(struct.pack("<HHII", tag, kind, count, place))
            outside.append(body + b"\0" * (len(body) % 2))
            place += len(outside[-1])
        else:
            entries.append(struct.pack("<HHI", tag, kind, count) + body.ljust(4, b"\0"))
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(entries) + struct.pack("<I", 0) + b"".join(outside) + b"".join(strips)


def decode(blob: bytes) -> Raster:
    """The raster of an uncompressed file in strips, either byte order, bands apart or together."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if order is None or struct.unpack_from(f"{order}H", blob, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(f"{order}I", blob, 4)[0]
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack_from(f"{order}H", blob, at)[0]):
        tag, kind, count = struct.unpack_from(f"{order}HHI", blob, at + 2 + 12 * i)
        if kind not in _TYPES:
            continue
        code, size = _TYPES[kind]
        place = at + 10 + 12 * i if size * count <= 4 else struct.unpack_from(f"{order}I", blob, at + 10 + 12 * i)[0]
        tags[tag] = (blob[place : place + count],) if kind == 2 else struct.unpack_from(f"{order}{count * len(code)}{code[0]}", blob, place)
    if tags.get(_COMPRESSION, (1,))[0] != 1 or _OFFSETS not in tags:
        raise ValueError("only uncompressed strips are read")
    width, height, bands = tags[_WIDTH][0], tags[_HEIGHT][0], tags.get(_SAMPLES, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(_FORMAT, (1,))[0]]
    dtype = np.dtype(f"{order}{kind}{tags.get(_BITS, (8,))[0] // 8}")
    raw = b"".join(blob[o : o + n] for o, n in zip(tags[_OFFSETS], tags[_COUNTS]))
    flat = np.frombuffer(raw, dtype, count=width * height * bands)
    together = tags.get(_PLANAR, (1,))[0] == 1
    data = flat.reshape(height, width, bands).transpose(2, 0, 1) if together else flat.reshape(bands, height, width)
    if _MATRIX in tags:
        m = tags[_MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif _SCALE in tags and _TIE in tags:
        (sx, sy), (i, j, _, x, y) = tags[_SCALE][:2], tags[_TIE][:5]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        transform = (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    return Raster(data.astype(dtype.newbyteorder("=")), transform, tags[_ASCII][0].rstrip(b"\0").decode() if _ASCII in tags else "")


def window(raster: Raster, left: float, bottom: float, right: float, top: float, out: tuple[int, int] | None = None) -> Raster:
    """Crop of a north-up raster, nearest pixel, to `out` (height, width) pixels if given."""
    a, _, c, _, e, f = raster.transform
    x0, x1, y0, y1 = (left - c) / a, (right - c) / a, (top - f) / e, (bottom - f) / e
    height, width = out or (round(y1 - y0), round(x1 - x0))
    rows = np.floor(y0 + (np.arange(height) + 0.5) * (y1 - y0) / height).astype(int)
    cols = np.floor(x0 + (np.arange(width) + 0.5) * (x1 - x0) / width).astype(int)
    ok = ((rows >= 0) & (rows < raster.data.shape[1]))[:, None] & ((cols >= 0) & (cols < raster.data.shape[2]))[None]
    data = raster.data[:, rows.clip(0, raster.data.shape[1] - 1)][:, :, cols.clip(0, raster.data.shape[2] - 1)] * ok
    return Raster(data.astype(raster.data.dtype), ((right - left) / width, 0.0, left, 0.0, -(top - bottom) / height, top), raster.crs)
