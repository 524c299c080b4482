"""WKB in and out. Binary decoding is the one thing Spark has no expression
for, so these are Arrow batch jobs; everything after them is Columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_LINE = T.ArrayType(T.ArrayType(_POINT))
_POLYGON = T.ArrayType(
    T.StructType(
        [T.StructField("shell", T.ArrayType(_POINT)), T.StructField("holes", T.ArrayType(T.ArrayType(_POINT)))]
    )
)
DECODED = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("point", _POINT), T.StructField("line", _LINE), T.StructField("polygon", _POLYGON)]
)

# Geometry type codes of the WKB format.
_KINDS = {1: "point", 2: "line", 3: "polygon", 4: "points", 5: "line", 6: "polygon", 7: "collection"}


def _coords(buf: bytes, at: int, order: str, n: int, dims: int):
    """``n`` vertices as an array of x and y, and where they end."""
    flat = np.frombuffer(buf, f"{order}f8", n * dims, at).reshape(n, dims)
    return flat[:, :2], at + 8 * n * dims


def _parse(buf: bytes, at: int = 0):
    """``kind, point, parts, polygons, end``: arrays of vertices, or None where the
    kind has none. Heights and measures are left out."""
    order = "<" if buf[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", buf, at + 1)
    at += 5
    if code & 0x20000000:  # EWKB carries an SRID after the type
        at += 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x1FFFFFFF
    if code >= 1000:  # ISO: 1000 adds z, 2000 adds m, 3000 adds both
        dims = 4 if code >= 3000 else 3
        code %= 1000
    kind = _KINDS.get(code, f"code {code}")
    if code == 1:
        xy, at = _coords(buf, at, order, 1, dims)
        return kind, xy[0] if xy[0, 0] == xy[0, 0] else None, None, None, at
    (n,) = struct.unpack_from(f"{order}I", buf, at)
    at += 4
    if code == 2:
        part, at = _coords(buf, at, order, n, dims)
        return kind, None, [part] if n else [], None, at
    if code == 3:
        rings = []
        for _ in range(n):
            (m,) = struct.unpack_from(f"{order}I", buf, at)
            ring, at = _coords(buf, at + 4, order, m, dims)
            rings.append(ring)
        return kind, None, None, [rings] if rings else [], at
    if code in (5, 6):
        parts, polygons = [], []
        for _ in range(n):
            _, _, some, others, at = _parse(buf, at)
            parts += some or []
            polygons += others or []
        return kind, None, parts if code == 5 else None, polygons if code == 6 else None, at
    # point sets and collections are named, but have no shape here
    return kind, None, None, None, at


def decode(buf: bytes | None) -> dict | None:
    """One geometry to nested coordinates. Kinds without points, lines or polygons of
    their own have NULL shapes."""
    if not buf:
        return None
    kind, point, parts, polygons, _ = _parse(bytes(buf))
    path = lambda xy: [{"x": x, "y": y} for x, y in xy.tolist()]
    return {
        "kind": kind,
        "point": None if point is None else path(point.reshape(1, 2))[0],
        "line": None if parts is None else [path(p) for p in parts],
        "polygon": None if polygons is None else [{"shell": path(r[0]), "holes": [path(h) for h in r[1:]]} for r in polygons],
    }


def _paths(paths: list[np.ndarray]) -> pa.Array:
    """Vertex lists, from one flat array and offsets."""
    flat = np.concatenate([np.empty((0, 2)), *paths])
    xy = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"])
    return pa.ListArray.from_arrays(_offsets(map(len, paths)), xy)


def _offsets(sizes) -> pa.Array:
    return pa.array(np.cumsum([0, *sizes]), pa.int32())


def _lists(rows: list[list | None], values: pa.Array) -> pa.Array:
    mask = pa.array([r is None for r in rows], pa.bool_())
    return pa.ListArray.from_arrays(_offsets(len(r or ()) for r in rows), values, mask=mask)


def decoded(blobs: list[bytes]) -> list[pa.Array]:
    """``kind, point, line, polygon`` of many geometries, as columns. Vertices are
    copied as arrays; only parts and rings are looked at one by one."""
    rows = [_parse(b) for b in blobs]
    points = [r[1] for r in rows]
    xy = np.array([(np.nan, np.nan) if p is None else p for p in points], float).reshape(-1, 2)
    point = pa.StructArray.from_arrays(
        [pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"], mask=pa.array([p is None for p in points], pa.bool_())
    )
    lines, polygons = [r[2] for r in rows], [r[3] for r in rows]
    rings = [g for some in polygons for g in some or ()]
    holes = [h for g in rings for h in g[1:]]
    shapes = pa.StructArray.from_arrays(
        [_paths([g[0] for g in rings]), pa.ListArray.from_arrays(_offsets(len(g) - 1 for g in rings), _paths(holes))],
        ["shell", "holes"],
    )
    return [
        pa.array([r[0] for r in rows], pa.string()),
        point,
        _lists(lines, _paths([p for some in lines for p in some or ()])),
        _lists(polygons, shapes),
    ]


def read_wkb(df: DataFrame, column: str) -> DataFrame:
    """Replace a WKB column by ``kind, point, line, polygon``; rows without
    geometry are dropped. The decoder only moves bytes, in Arrow batches."""
    kept = [f for f in df.schema if f.name != column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[f.name] for f in kept] + decoded(batch[column].to_pylist())
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in kept] + DECODED.names)

    schema = T.StructType([*kept, *DECODED.fields])
    return df.where(F.col(column).isNotNull() & (F.length(column) > 0)).mapInArrow(work, schema)


def _ring_bytes(ring) -> bytes:
    return struct.pack("<I", len(ring)) + b"".join(struct.pack("<2d", p["x"], p["y"]) for p in ring)


def encode_lines(parts) -> bytes:
    body = [b"\x01" + struct.pack("<I", 2) + _ring_bytes(p) for p in parts]
    return body[0] if len(body) == 1 else b"\x01" + struct.pack("<II", 5, len(body)) + b"".join(body)


def encode_polygons(polys) -> bytes:
    body = []
    for g in polys:
        rings = [g["shell"], *g["holes"]]
        body.append(b"\x01" + struct.pack("<II", 3, len(rings)) + b"".join(_ring_bytes(r) for r in rings))
    return body[0] if len(body) == 1 else b"\x01" + struct.pack("<II", 6, len(body)) + b"".join(body)


def write_wkb(df: DataFrame, column: str, kind: str, name: str = "geometry") -> DataFrame:
    """Replace a nested line or polygon column by WKB, for Parquet sinks."""
    encode = {"line": encode_lines, "polygon": encode_polygons}[kind]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shapes = [encode(g) if g is not None and len(g) else None for g in pdf[column]]
            out = pdf.drop(columns=[column])
            out[name] = shapes
            yield out

    schema = T.StructType([*[f for f in df.schema if f.name != column], T.StructField(name, T.BinaryType())])
    return df.mapInPandas(work, schema)
