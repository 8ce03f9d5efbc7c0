"""Boxes in 1e-7 degree: struct columns minx, miny, maxx, maxy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLANET = (-1_800_000_000, -900_000_000, 1_800_000_000, 900_000_000)


def box(minx, miny, maxx, maxy) -> Column:
    to = lambda c: F.lit(c).cast("bigint") if isinstance(c, int) else c
    return F.struct(to(minx).alias("minx"), to(miny).alias("miny"), to(maxx).alias("maxx"), to(maxy).alias("maxy"))


def parse_box(text: str) -> tuple[int, int, int, int]:
    """``planet``, or four numbers with commas: whole ones in 1e-7 degree, others in degrees."""
    if text.strip() == "planet":
        return PLANET
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != 4:
        raise ValueError(f"a box needs four numbers: {text!r}")
    return tuple(int(p) if p.lstrip("+-").isdigit() else round(float(p) * 1e7) for p in parts)  # type: ignore[return-value]


def is_empty(b: Column) -> Column:
    return (b["minx"] > b["maxx"]) | (b["miny"] > b["maxy"])


def intersects(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])


def contains(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["minx"]) & (a["maxx"] >= b["maxx"]) & (a["miny"] <= b["miny"]) & (a["maxy"] >= b["maxy"])


def contains_xy(a: Column, lon: Column, lat: Column) -> Column:
    return lon.between(a["minx"], a["maxx"]) & lat.between(a["miny"], a["maxy"])


def around(lon: Column, lat: Column) -> Column:
    """Aggregate: the box of a group's positions."""
    return F.struct(F.min(lon).alias("minx"), F.min(lat).alias("miny"), F.max(lon).alias("maxx"), F.max(lat).alias("maxy"))


def expand(a: Column, by: Column | int) -> Column:
    return box(a["minx"] - by, a["miny"] - by, a["maxx"] + by, a["maxy"] + by)
