"""Minimal shapefile: polygons in .shp with attributes in .dbf, read from bytes and written to bytes."""

from __future__ import annotations

import struct
from typing import Any

Ring = list[tuple[float, float]]


def _clockwise(ring: Ring) -> bool:
    return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:])) < 0


def read_shp(blob: bytes) -> list[list[Ring] | None]:
    """Rings of each record; null shapes are None."""
    if struct.unpack_from(">I", blob)[0] != 9994:
        raise ValueError("not a shapefile")
    out: list[list[Ring] | None] = []
    at = 100
    while at + 8 <= len(blob):
        size = struct.unpack_from(">I", blob, at + 4)[0] * 2
        kind = struct.unpack_from("<I", blob, at + 8)[0]
        if kind == 0:
            out.append(None)
        elif kind in (5, 15, 25):
            parts, points = struct.unpack_from("<2I", blob, at + 44)
            starts = [*struct.unpack_from(f"<{parts}I", blob, at + 52), points]
            flat = struct.unpack_from(f"<{2 * points}d", blob, at + 52 + 4 * parts)
            pairs = list(zip(flat[::2], flat[1::2]))
            out.append([pairs[a:b] for a, b in zip(starts, starts[1:])])
        else:
            raise ValueError(f"shapes of type {kind} are not read")
        at += 8 + size
    return out


def polygons(rings: list[Ring]) -> list[list[Ring]]:
    """Rings grouped to polygons: each clockwise ring begins one, the others are its holes."""
    out: list[list[Ring]] = []
    for ring in rings:
        if _clockwise(ring) or not out:
            out.append([ring])
        else:
            out[-1].append(ring)
    return out


def read_dbf(blob: bytes, encoding: str = "utf-8") -> list[dict[str, Any]]:
    records, head, size = struct.unpack_from("<IHH", blob, 4)
    fields, at = [], 32
    while blob[at] != 0x0D:
        name = blob[at : at + 11].split(b"\0")[0].decode("ascii")
        fields.append((name, chr(blob[at + 11]), blob[at + 16], blob[at + 17]))
        at += 32
    out = []
    for i in range(records):
        at = head + i * size + 1
        row: dict[str, Any] = {}
        for name, kind, length, decimals in fields:
            text = blob[at : at + length].decode(encoding).strip(" \0")
            at += length
            if kind in "NF":
                row[name] = None if not text or "*" in text else float(text) if decimals or "." in text else int(text)
            elif kind == "L":
                row[name] = None if text in ("", "?") else text in "YyTt"
            else:
                row[name] = text or None
        out.append(row)
    return out


def write_shp(shapes: list[list[Ring] | None]) -> bytes:
    body, box = [], [float("inf"), float("inf"), float("-inf"), float("-inf")]
    for i, rings in enumerate(shapes, 1):
        if not rings:
            content = struct.pack("<I", 0)
        else:
            points = [p for r in rings for p in r]
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            own = (min(xs), min(ys), max(xs), max(ys))
            box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
            starts = [sum(map(len, rings[:k])) for k in range(len(rings))]
            content = struct.pack("<I4d2I", 5, *own, len(rings), len(points)) + struct.pack(f"<{len(rings)}I", *starts)
            content += struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p])
        body.append(struct.pack(">2I", i, len(content) // 2) + content)
    data = b"".join(body)
    box = box if box[0] <= box[2] else [0.0] * 4
    return struct.pack(">7I", 9994, 0, 0, 0, 0, 0, (100 + len(data)) // 2) + struct.pack("<2I8d", 1000, 5, *box, 0, 0, 0, 0) + data


def write_dbf(rows: list[dict[str, Any]], encoding: str = "utf-8") -> bytes:
    names = list(dict.fromkeys(k for r in rows for k in r))
    fields = []
    for name in names:
        values = [r.get(name) for r in rows if r.get(name) is not None]
        if values and all(isinstance(v, bool) for v in values):
            fields.append((name, "L", 1, 0))
        elif values and all(isinstance(v, int) for v in values):
            fields.append((name, "N", max(len(str(v)) for v in values), 0))
        elif values and all(isinstance(v, (int, float)) for v in values):
            fields.append((name, "N", 24, 12))
        else:
            fields.append((name, "C", min(254, max([1, *(len(str(v).encode(encoding)) for v in values)])), 0))
    size = 1 + sum(f[2] for f in fields)
    out = [struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(fields), size)]
    for name, kind, length, decimals in fields:
        out.append(name.encode("ascii")[:10].ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([length, decimals]) + b"\0" * 14)
    out.append(b"\r")
    for row in rows:
        out.append(b" ")
        for name, kind, length, decimals in fields:
            v = row.get(name)
            if kind == "L":
                text = b"?" if v is None else b"T" if v else b"F"
            elif kind == "N":
                text = b"" if v is None else (f"{v:.{decimals}f}" if decimals else str(v)).encode()
                text = text.rjust(length)
            else:
                text = ("" if v is None else str(v)).encode(encoding)[:length].ljust(length)
            out.append(text)
    return b"".join(out) + b"\x1a"
