"""Quadtree tiles as 64-bit integers, in column expressions that stay in generated code.

A tile of depth z holds z two-bit steps from bit 62 down and z itself in its lowest five bits; -1 is no tile. A step's
low bit is the east half, its high bit the south half, so a tile is the interleaving of its column and row number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_CIRCUMFERENCE_M = 20037508.3428
def _long(c: Column | int) -> Column:
    return F.lit(c).cast("bigint") if isinstance(c, int) else c.cast("bigint")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spread_bits(c: Column) -> Column:
    """The bits of a number, a zero before each: its binary digits read to base four."""
    return F.conv(F.bin(c), 4, 10).cast("bigint")


def _gather_bits(c: Column, high: bool) -> Column:
    """Every other bit of a number: of its digits to base four the low or the high bit."""
    return F.conv(F.translate(F.conv(c.cast("string"), 10, 4), "0123", "0011" if high else "0101"), 2, 10).cast("bigint")


def _shl(c: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", c, F.lit(by).cast("int") if isinstance(by, int) else by.cast("int"))


def _shr(c: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", c, F.lit(by).cast("int") if isinstance(by, int) else by.cast("int"))


def depth(q: Column) -> Column:
    return q.bitwiseAND(F.lit(31))


def from_tuple(x: Column, y: Column, z: Column) -> Column:
    """Tile of column x, row y (from the north) at depth z; (-1, -1, -1) is no tile."""
    path = _spread_bits(_long(x)).bitwiseOR(_shl(_spread_bits(_long(y)), 1))
    tile = F.when(z == 0, F.lit(0).cast("bigint")).otherwise(_shl(path, 63 - 2 * z).bitwiseOR(_long(z)))
    return F.when((x == -1) & (y == -1) & (z == -1), F.lit(-1).cast("bigint")).otherwise(tile)


def to_tuple(q: Column) -> Column:
    """Struct x, y, z of a tile."""
    z = depth(q)
    path = F.when(z == 0, F.lit(0).cast("bigint")).otherwise(_shr(q, 63 - 2 * z))
    none = F.lit(-1).cast("bigint")
    return F.struct(
        F.when(q == -1, none).otherwise(_gather_bits(path, False)).alias("x"),
        F.when(q == -1, none).otherwise(_gather_bits(path, True)).alias("y"),
        F.when(q == -1, none).otherwise(z).alias("z"),
    )


def round_to(q: Column, level: Column | int) -> Column:
    """The ancestor at ``level``; a tile that is not deeper stays."""
    level = F.lit(level) if isinstance(level, int) else level
    cut = F.when(level == 0, F.lit(0).cast("bigint")).otherwise(_shl(_shr(q, 63 - 2 * level), 63 - 2 * level) + _long(level))
    return F.when((q == -1) | (depth(q) < level), q).otherwise(cut)


def common(a: Column, b: Column) -> Column:
    """The deepest tile that holds both; no tile (-1) leaves the other."""
    same_steps = F.floor((63 - F.length(F.bin(a.bitwiseXOR(b)))) / 2).cast("bigint")
    level = F.least(depth(a), depth(b), same_steps)
    return F.when(a == -1, b).when(b == -1, a).when(a == b, a).otherwise(round_to(a, level))


def common_agg(q: Column) -> Column:
    """The deepest tile that holds all of a group, no tiles left out; null for a group without any.

    Tiles sort as their paths, a parent before its children, so the group's least and greatest have the same common
    tile as the whole group: two partial aggregates without an aggregator of our own.
    """
    real = F.when(q >= 0, q)
    return common(F.min(real), F.max(real))


def to_letters(q: Column) -> Column:
    """One letter per step, A to D; ``NULL`` for no tile."""
    steps = F.transform(F.sequence(F.lit(0), depth(q).cast("int")), lambda i: F.element_at(F.array(*map(F.lit, "ABCD")), (_shr(q, 61 - 2 * F.least(i, F.lit(30))).bitwiseAND(F.lit(3)) + 1).cast("int")))
    return F.when(q <= -1, F.lit("NULL")).otherwise(F.array_join(F.slice(steps, F.lit(1), depth(q).cast("int")), ""))


def from_letters(s: Column) -> Column:
    """Tile of a string of letters A to D; null where another character is among them."""
    path = F.conv(F.translate(s, "ABCD", "0123"), 4, 10).cast("bigint")
    n = F.length(s)
    return F.when(s == "", F.lit(0).cast("bigint")).when(s.rlike("^[A-D]{1,28}$"), _shl(path, 63 - 2 * n).bitwiseOR(_long(n)))


def ancestors(q: Column, deepest: int = 28) -> Column:
    """The tile and all its ancestors from the root down, as an array; empty for no tile."""
    levels = F.sequence(F.lit(0), F.least(depth(q), F.lit(deepest)).cast("int"))
    return F.when(q < 0, F.array().cast("array<bigint>")).otherwise(F.transform(levels, lambda i: round_to(q, i)))


def descendant_range(q: Column) -> Column:
    """Struct lo, hi: the tile and all below it are the tiles of one range, so files sorted by tile can be skipped."""
    return F.struct(q.alias("lo"), (q - depth(q) + _shl(F.lit(1).cast("bigint"), 63 - 2 * depth(q)) - 1).alias("hi"))


def to_float(c: Column) -> Column:
    return c / F.lit(1e7)


def to_int(c: Column) -> Column:
    """Degrees to 1e-7 degree, rounded half away from zero."""
    return F.round(c * F.lit(1e7), 0).cast("bigint")


def _merc(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi) * (1 + lat / 90.0) / 4)) * 90.0 / math.pi


def _unmerc(d: Column) -> Column:
    return (F.atan(F.exp(d * math.pi / 90.0)) * 4 / math.pi - 1) * 90.0


def mercator(lon: Column, lat: Column) -> Column:
    """Struct x, y in metres of a position in degrees."""
    return F.struct((lon * HALF_CIRCUMFERENCE_M / 180).alias("x"), (_merc(lat) * HALF_CIRCUMFERENCE_M / 90).alias("y"))


def unmercator(x: Column, y: Column) -> Column:
    return F.struct((x * 180 / HALF_CIRCUMFERENCE_M).alias("lon"), _unmerc(y * 90 / HALF_CIRCUMFERENCE_M).alias("lat"))


def bounds(q: Column, buffer: float = 0.0) -> Column:
    """Struct minx, miny, maxx, maxy (1e-7 degree) of a tile, widened on every side by ``buffer`` times its size."""
    def of(t: Column) -> Column:
        tiles = F.pow(F.lit(2.0), t["z"])
        x0, x1 = t["x"] * 360 / tiles - 180, (t["x"] + 1) * 360 / tiles - 180
        return F.struct(x0.alias("x0"), _unmerc(90 - (t["y"] + 1) * 180 / tiles).alias("y0"), x1.alias("x1"), _unmerc(90 - t["y"] * 180 / tiles).alias("y1"))

    def widened(b: Column) -> Column:
        dx, dy = (b["x1"] - b["x0"]) * buffer, (b["y1"] - b["y0"]) * buffer
        return F.struct(to_int(b["x0"] - dx).alias("minx"), to_int(b["y0"] - dy).alias("miny"), to_int(b["x1"] + dx).alias("maxx"), to_int(b["y1"] + dy).alias("maxy"))

    return let(let(to_tuple(q), of), widened)


def _fits(lo: Column, hi: Column, level: Column, buffer: float) -> Column:
    """Whether [lo, hi], in the span from -1 to 1, goes on into a half of its cell of the level above, give or take.

    The cell and the half are those of the middle of [lo, hi]. In the cell's own coordinates, again from -1 to 1, the
    box may reach beyond the cell, and beyond the half, by ``buffer``.
    """
    cells = F.pow(F.lit(2.0), level - 1)
    middle = (lo + hi) / 2
    centre = (2 * F.greatest(F.lit(0.0), F.least(F.floor((middle + 1) / 2 * cells).cast("double"), cells - 1)) + 1) / cells - 1
    a, b = (lo - centre) * cells, (hi - centre) * cells
    half = F.when(middle >= centre, a > -buffer).otherwise(b < buffer)
    return (a >= -1 - buffer) & (b <= 1 + buffer) & ((b <= 0) | (a >= 0) | half)


def calculate(minx: Column, miny: Column, maxx: Column, maxy: Column, buffer: float, max_level: int) -> Column:
    """The deepest tile, up to ``max_level``, that holds the box (1e-7 degree) or does so but for ``buffer`` of its size.

    An empty box (a minimum above its maximum) has no tile, nor has a null one a result. Both axes are halved on their
    own around the middle of the box, so a level's cell is known without those above it; the tile goes as deep as both
    axes fit. A box whose ends share a cell of ``max_level``, as nearly every point's do, is settled at once; for others
    the levels are looked at from the first at which the ends part.
    """
    if max_level == 0:
        return F.when((minx > maxx) | (miny > maxy), F.lit(-1)).otherwise(F.lit(0)).cast("bigint")
    widen = lambda lo, hi: F.when(lo == hi, to_float(hi) + 1e-7).otherwise(to_float(hi))
    # At the poles the projection runs off to infinity, where nothing fits a half; a number far outside stands for it.
    flat = lambda d: F.when(d >= 90, F.lit(1e3)).when(d <= -90, F.lit(-1e3)).otherwise(_merc(d) / 90)
    x0, x1, y0, y1 = to_float(minx) / 180, widen(minx, maxx) / 180, flat(to_float(miny)), flat(widen(miny, maxy))
    cells = float(2**max_level)
    # Numbers of the last level's cells; those outside the square are never equal.
    east = lambda v, out: F.when((v >= -1) & (v < 1), F.floor((v + 1) / 2 * cells).cast("bigint")).otherwise(F.lit(out).cast("bigint"))
    south = lambda v, out: F.when((v > -1) & (v < 1), F.floor((1 - v) / 2 * cells).cast("bigint")).otherwise(F.lit(out).cast("bigint"))
    quick = (east(x0, -1) == east(x1, -2)) & (south(y0, -1) == south(y1, -2))
    settled = from_tuple(east(x0, 0), south(y0, 0), F.lit(max_level).cast("bigint"))
    shared = lambda a, b: F.when((a < 0) | (b < 0), F.lit(0)).otherwise(F.lit(max_level) - F.when(a == b, 0).otherwise(F.length(F.bin(a.bitwiseXOR(b)))))
    box = F.struct(x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"), F.least(shared(east(x0, -1), east(x1, -1)), shared(south(y0, -1), south(y1, -1))).cast("int").alias("z"))

    def tile(b: Column) -> Column:
        deeper = lambda z, k: F.when((z == k - 1) & _fits(b["x0"], b["x1"], k, buffer) & _fits(b["y0"], b["y1"], k, buffer), k).otherwise(z)
        levels = F.when(b["z"] < max_level, F.sequence(b["z"] + 1, F.lit(max_level))).otherwise(F.array().cast("array<int>"))

        def at(z: Column) -> Column:
            n = F.pow(F.lit(2.0), z)
            place = lambda m: F.greatest(F.lit(0.0), F.least(F.floor(m / 2 * n).cast("double"), n - 1)).cast("bigint")
            return from_tuple(place((b["x0"] + b["x1"]) / 2 + 1), place(1 - (b["y0"] + b["y1"]) / 2), z)

        return let(F.aggregate(levels, b["z"], deeper), at)

    return F.when((minx > maxx) | (miny > maxy), F.lit(-1).cast("bigint")).when(quick, settled).otherwise(let(box, tile))
