"""Geometries as blobs of block files: points, lines and polygons with drawing order, area, box and kind of element."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from mapweave.sources.wire import fields, message, packed_deltas, unpacked_deltas, unzigzag, zigzag

_POINT, _LINE, _POLYGON, _MULTI = 1, 2, 3, 7
_RING = "array<struct<ref:bigint,lon:bigint,lat:bigint>>"
PARTS = f"orig_kind int, geom_type tinyint, coords {_RING}, polygons array<array<{_RING}>>, z_order bigint, way_area double, minx bigint, miny bigint, maxx bigint, maxy bigint"


def _ring(points: list[dict]) -> bytes:
    return message(*((i, packed_deltas(p[k] for p in points)) for i, k in enumerate(("ref", "lon", "lat"), 1)))


def _points(buf: bytes) -> list[dict]:
    got = dict(fields(buf))
    return [{"ref": a, "lon": b, "lat": c} for a, b, c in zip(*(unpacked_deltas(got.get(i, b"")) for i in (1, 2, 3)))]


def pack(orig_kind: int, geom_type: int, coords: list[dict] | None, polygons: list[list[list[dict]]] | None, z_order: int = 0, way_area: float = 0.0) -> bytes | None:
    """The blob of a geometry; None for one without points."""
    every = coords or [p for g in polygons or () for r in g for p in r]
    if not every:
        return None
    lons, lats = [p["lon"] for p in every], [p["lat"] for p in every]
    box = message((1, zigzag(min(lons))), (2, zigzag(min(lats))), (5, zigzag(max(lons) - min(lons))), (6, zigzag(max(lats) - min(lats))))
    area = (12, struct.unpack("<Q", struct.pack("<d", way_area or 0.0))[0])
    if geom_type == _POINT:
        p = every[0]
        return message((10, _POINT), (13, message((1, zigzag(p["ref"])), (2, zigzag(p["lon"])), (3, zigzag(p["lat"])))), (17, orig_kind))
    if geom_type == _LINE:
        return message((10, _LINE), (11, zigzag(z_order or 0)), (14, _ring(every)), (16, box), (17, orig_kind))
    bodies = [(15, message(*((1, _ring(r)) for r in rings))) for rings in polygons or ()]
    return message((10, geom_type), (11, zigzag(z_order or 0)), area, *bodies, (16, box), (17, orig_kind))


def unpack(blob: bytes) -> dict:
    """The parts of a blob, with the names of ``PARTS``; a point's box is the point."""
    out: dict = {"orig_kind": 0, "geom_type": 0, "coords": None, "polygons": None, "z_order": 0, "way_area": 0.0}
    for n, v in fields(blob):
        if n == 10:
            out["geom_type"] = v
        elif n == 11:
            out["z_order"] = unzigzag(v)
        elif n == 12:
            out["way_area"] = struct.unpack("<d", struct.pack("<Q", v))[0]
        elif n == 13:
            got = {k: unzigzag(x) for k, x in fields(v)}
            p = {"ref": got.get(1, 0), "lon": got.get(2, 0), "lat": got.get(3, 0)}
            out |= {"coords": [p], "minx": p["lon"], "maxx": p["lon"], "miny": p["lat"], "maxy": p["lat"]}
        elif n == 14:
            out["coords"] = _points(v)
        elif n == 15:
            out["polygons"] = [*(out["polygons"] or []), [_points(r) for k, r in fields(v) if k == 1]]
        elif n == 16:
            b = {k: unzigzag(x) for k, x in fields(v)}
            x, y = b.get(1, 0), b.get(2, 0)
            out |= {"minx": x, "miny": y, "maxx": x + b.get(5, 0), "maxy": y + b.get(6, 0)}
        elif n == 17:
            out["orig_kind"] = v
    return out


def order_and_area(blob: bytes) -> tuple[int, float]:
    """Drawing order and area, without reading the points."""
    got = dict(fields(blob))
    return unzigzag(got.get(11, 0)), struct.unpack("<d", struct.pack("<Q", got.get(12, 0)))[0]


def pack_column(orig_kind: Column, geom_type: Column, coords: Column, polygons: Column, z_order: Column, way_area: Column) -> Column:
    """Blobs of geometries as ``operators.geometry.generate`` gives them; null for those without points."""

    @arrow_udf(T.BinaryType())
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([pack(*row) if row[1] is not None else None for row in zip(*(c.to_pylist() for c in columns))], pa.binary())

    return run(orig_kind.cast("int"), geom_type.cast("int"), coords, polygons, z_order.cast("bigint"), way_area.cast("double"))


def unpack_column(blob: Column) -> Column:
    """The parts of blobs as a struct of ``PARTS``; null for null."""
    schema = T.StructType.fromDDL(PARTS)
    point = pa.struct([("ref", pa.int64()), ("lon", pa.int64()), ("lat", pa.int64())])
    kinds = [pa.int32(), pa.int8(), pa.list_(point), pa.list_(pa.list_(pa.list_(point))), pa.int64(), pa.float64(), *[pa.int64()] * 4]
    arrow = pa.struct(list(zip(schema.names, kinds)))

    @arrow_udf(schema)
    def run(blobs: pa.Array) -> pa.Array:
        return pa.array([None if b is None else {k: v for k, v in unpack(b).items()} for b in blobs.to_pylist()], arrow)

    return F.when(blob.isNotNull(), run(blob))
