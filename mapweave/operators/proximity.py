"""Points near other points, and points within regions, by grid cells.

The sphere is cut into latitude bands some times as high as the radius, and each band into cells some times as wide as a
circle of that radius can reach in it. A point lies in one cell; it looks for partners there and, where its circle
crosses a border, in the next cell of its band and in those cells of the next band that the circle reaches. So each pair
is met once, few points look into more than their own cell, and every candidate is then measured.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.operators.current import current_rows
from mapweave.session import written

EARTH_RADIUS_M = 6371008.8
_TURN = 3_600_000_000  # a full turn in units of 1e-7 degree
_WIDE = 4  # cells are so many times as wide and high as the circle's half width
_CROWD = 20_000  # points of one cell that one task takes together
_UNSET_LON, _UNSET_LAT = -1_800_000_000, -900_000_000  # what a reader stores where the file has no position


def node_positions(nodes: DataFrame) -> DataFrame:
    """``id, lon, lat`` of the current rows of nodes that exist and have a position.

    Null, out-of-range and unset positions are none. ``nodes`` needs ``id, vs, ts, visible, lon, lat``.
    """
    rows = current_rows(nodes, {"lon": F.col("lon").cast("bigint"), "lat": F.col("lat").cast("bigint")})
    placed = F.col("lon").between(-1_800_000_000, 1_800_000_000) & F.col("lat").between(-900_000_000, 900_000_000)
    unset = (F.col("lon") == _UNSET_LON) & (F.col("lat") == _UNSET_LAT)
    return rows.where(~F.col("deleted") & placed & ~unset).select("id", "lon", "lat")


def great_circle_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Great-circle distance in metres between positions in 1e-7 degree (haversine form)."""
    rad = lambda c: F.radians(c / F.lit(1e7))
    h = F.pow(F.sin(rad(lat_b - lat_a) / 2), 2) + F.cos(rad(lat_a)) * F.cos(rad(lat_b)) * F.pow(F.sin(rad(lon_b - lon_a) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _band_cells(band: Column, height: int, radius_m: float) -> Column:
    """Number of cells in a band, one where three or more of sufficient width do not fit."""
    top = F.greatest(F.abs(band * height), F.abs((band + 1) * height)).cast("double") / 1e7
    # Half the width of a circle's box: asin(sin(r) / cos(lat)), at the latitude farthest from the equator that it can touch.
    r = radius_m / EARTH_RADIUS_M
    cos_lat = F.cos(F.radians(F.least(top, F.lit(90.0)))) - F.lit(r * 1.01)
    reach = F.when(cos_lat > 4 * r, F.degrees(F.asin(F.lit(math.sin(r)) / cos_lat)) * 1e7 * 1.0001 + 1)
    n = F.floor(F.lit(float(_TURN)) / (reach * _WIDE)).cast("bigint")
    return F.when(n >= 3, n).otherwise(F.lit(1)).cast("bigint")


def _cell(lon: Column, n: Column) -> Column:
    """Cell of a longitude, taken around the turn, in a band of n cells; -180 and 180 degrees fall together."""
    return F.floor(F.pmod(lon + F.lit(1_800_000_000), F.lit(_TURN)).cast("double") * n / F.lit(float(_TURN))).cast("bigint")


def pairs_within(points: DataFrame, radius_m: float) -> DataFrame:
    """All pairs of points at most ``radius_m`` apart on the sphere: ``id_a < id_b``, each pair once.

    ``points``: ``id`` (unique), ``lon``, ``lat`` in range and not null. Pairs across the 180th meridian and around
    the poles are found. Points in the same place are pairs like any others. No points, no pairs. The radius may be
    up to some hundred kilometres.

    One shuffle of points, less than twice on the probing side, once on the other. Points are counted by cell first:
    those of a cell that holds more than ``_CROWD`` are dealt out over so many tasks that each has no more, and what
    looks into the cell goes to each of them. ``points`` is read three times and should be a written table.
    """
    base = math.ceil(math.degrees(radius_m / EARTH_RADIUS_M) * 1e7 * 1.0001) + 1
    height = base * _WIDE
    band_of = lambda lat: F.floor(lat.cast("double") / height).cast("bigint")
    home = points.select("id", "lon", "lat", band_of(F.col("lat")).alias("band"))
    home = home.withColumn("n", _band_cells(F.col("band"), height, radius_m)).withColumn("cell", _cell(F.col("lon"), F.col("n")))
    # The circle's half width at this latitude, with room to both sides.
    r = radius_m / EARTH_RADIUS_M
    cos_lat = F.cos(F.radians(F.abs(F.col("lat")) / 1e7)) - F.lit(r * 1.01)
    reach = F.when(cos_lat > 4 * r, F.degrees(F.asin(F.lit(math.sin(r)) / cos_lat)) * 1e7 * 1.0001 + 1)
    place = lambda b, c, own: F.struct(b.alias("band"), c.alias("cell"), F.lit(own).alias("own"))
    none = F.array().cast("array<struct<band:bigint,cell:bigint,own:boolean>>")
    to_east = F.coalesce(_cell(F.col("lon") + F.ceil(reach).cast("bigint"), F.col("n")), F.pmod(F.col("cell") + 1, F.col("n")))
    n_up = _band_cells(F.col("band") + 1, height, radius_m)
    around = F.array_distinct(F.array(*[_cell(F.col("lon") + F.ceil(F.lit(k) * reach).cast("bigint"), n_up) for k in (-1.0, 0.0, 1.0)]))
    every = F.sequence(F.lit(0).cast("bigint"), n_up - 1)
    above = F.when(n_up == 1, F.array(F.lit(0).cast("bigint"))).when(reach.isNull(), every).otherwise(around)
    probes = F.concat(
        F.array(place(F.col("band"), F.col("cell"), True)),
        F.when((F.col("n") > 1) & (to_east != F.col("cell")), F.array(place(F.col("band"), to_east, False))).otherwise(none),
        F.when(band_of(F.col("lat") + base) > F.col("band"), F.transform(above, lambda c: place(F.col("band") + 1, c, False))).otherwise(none),
    )
    probe = home.select("id", "lon", "lat", F.explode(probes).alias("p")).select(F.col("id").alias("id_p"), F.col("lon").alias("lon_p"), F.col("lat").alias("lat_p"), "p.*")
    home, keys = home.select("id", "lon", "lat", "band", "cell"), ["band", "cell"]
    crowded = home.groupBy("band", "cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > _CROWD)
    crowded = written(crowded.select("band", "cell", F.ceil(F.col("n") / _CROWD).cast("int").alias("shares")), "crowded")
    if crowded.take(1):
        home = home.join(crowded, ["band", "cell"], "left").withColumn("share", F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1))))
        probe = probe.join(crowded, ["band", "cell"], "left").withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("shares", F.lit(1)).cast("bigint") - 1)))
        keys.append("share")
    met = probe.join(home.select("id", "lon", "lat", *keys), keys)
    met = met.where(~F.col("own") | (F.col("id_p") < F.col("id"))).where(F.abs(F.col("lat_p") - F.col("lat")) <= base)
    # Far apart along the parallel is far apart; near the poles there is no saying so.
    cos_p, off = F.cos(F.radians(F.col("lat_p") / 1e7)), F.abs(F.col("lon_p") - F.col("lon"))
    met = met.where((cos_p <= 6 * r) | (F.least(off, F.lit(_TURN) - off) * cos_p <= base * 1.05))
    near = met.where(great_circle_m(F.col("lon_p"), F.col("lat_p"), F.col("lon"), F.col("lat")) <= radius_m)
    return near.select(F.least("id_p", "id").alias("id_a"), F.greatest("id_p", "id").alias("id_b"))


def crossings_odd(lon: Column, lat: Column, verts: Column) -> Column:
    """Even-odd rule: whether (lon, lat) lies within the ring ``verts``, closed or not, in exact integer arithmetic.

    A ring needs vertices without nulls; fewer than three hold nothing.
    """
    def step(i: Column) -> Column:
        a, b = F.element_at(verts, i), F.element_at(verts, F.when(i == F.size(verts), F.lit(1)).otherwise(i + 1))
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        left, right = (lon - a["lon"]) * (b["lat"] - a["lat"]), (b["lon"] - a["lon"]) * (lat - a["lat"])
        return F.when(straddles & ((b["lat"] > a["lat"]) == (left < right)), F.lit(1)).otherwise(F.lit(0))

    total = F.aggregate(F.sequence(F.lit(1), F.size(verts)), F.lit(0), lambda acc, i: acc + step(i))
    return F.when(F.size(verts) < 3, F.lit(False)).otherwise(total % 2 == 1)


def _ring_edges(polygons: DataFrame) -> DataFrame:
    """One row per edge that is not level: its ring, region, ends, and the least longitude of its ring."""
    clean = F.filter(F.col("verts"), lambda v: v.isNotNull() & v["lon"].isNotNull() & v["lat"].isNotNull())
    rings = polygons.where(F.col("region_id").isNotNull()).select(F.col("region_id").cast("bigint").alias("region_id"), F.coalesce(F.col("ring_label").startswith("!"), F.lit(False)).alias("hole"), clean.alias("vs"))
    rings = rings.where(F.size("vs") >= 3).withColumn("ring", F.monotonically_increasing_id())
    following = F.concat(F.slice("vs", F.lit(2), F.size("vs") - 1), F.slice("vs", F.lit(1), F.lit(1)))
    west = F.array_min(F.transform("vs", lambda v: v["lon"]))
    edges = rings.select("region_id", "ring", "hole", west.alias("west"), F.explode(F.arrays_zip(F.col("vs").alias("a"), following.alias("b"))).alias("e"))
    edges = edges.select("region_id", "ring", "hole", "west", *[F.col(f"e.{v}.{c}").cast("bigint").alias(v + c) for v in "ab" for c in ("lon", "lat")])
    return edges.toDF("region_id", "ring", "hole", "west", "ax", "ay", "bx", "by").where("ay <> by")


def points_in_regions(points: DataFrame, polygons: DataFrame, cell: int = 5_000_000) -> DataFrame:
    """``id, region_id`` of each point and each region that holds it.

    A region holds a point that lies by the even-odd rule in at least one ring that is no hole, and in no hole.
    ``points`` as for ``pairs_within``; ``polygons``: ``region_id, ring_label, verts``. A label that starts with ``!``
    marks a hole; a null label does not. Null vertices are left out of a ring, rings of fewer than three vertices and
    rows without a region id are ignored.

    Rings are clipped to grid cells (``cell`` in 1e-7 degree): of a ring's edges a cell keeps those that a ray to the
    east from one of its points may meet or miss, and the parity of those that all such rays meet. Points are joined to
    them by cell, by broadcast only while the clipped rings stay under the session's threshold.
    """
    at = lambda c: F.floor(c.cast("double") / cell).cast("bigint")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    edges = _ring_edges(polygons)
    edges = edges.withColumn("cy", F.explode(F.sequence(at(low), at(high - 1)))).withColumn("cx", F.explode(F.sequence(at(F.col("west")), at(F.greatest("ax", "bx")))))
    # Met by every ray: the edge lies east of the whole cell and reaches from below its lowest to above its highest line.
    always = (F.least("ax", "bx") >= (F.col("cx") + 1) * cell) & (low <= F.col("cy") * cell) & (high >= (F.col("cy") + 1) * cell)
    spread = edges.groupBy("region_id", "ring", "hole", "cx", "cy").agg((F.count_if(always) % 2).cast("int").alias("met"), F.collect_list(F.when(~always, F.struct("ax", "ay", "bx", "by"))).alias("edges"))
    spread = spread.where((F.col("met") == 1) | (F.size("edges") > 0)).groupBy("region_id", "cx", "cy").agg(F.collect_list(F.struct("hole", "met", "edges")).alias("rings"))
    spread = spread.where(F.exists("rings", lambda r: ~r["hole"]))
    lon, lat = F.col("lon"), F.col("lat")
    put = points.select("id", lon.cast("bigint").alias("lon"), lat.cast("bigint").alias("lat"), at(lon).alias("cx"), at(lat).alias("cy"))

    def crosses(e: Column) -> Column:
        left, right = (lon - e["ax"]) * (e["by"] - e["ay"]), (e["bx"] - e["ax"]) * (lat - e["ay"])
        return ((e["ay"] > lat) != (e["by"] > lat)) & ((e["by"] > e["ay"]) == (left < right))

    def holds(hole: bool) -> Column:
        return F.exists("rings", lambda r: (r["hole"] == F.lit(hole)) & (F.aggregate(r["edges"], r["met"], lambda n, e: n + F.when(crosses(e), 1).otherwise(0)) % 2 == 1))

    return put.join(spread, ["cx", "cy"]).where(holds(False) & ~holds(True)).select("id", "region_id")
