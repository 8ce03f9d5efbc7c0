"""From elements to points, lines and polygons: tags by style, coordinates, areas, parents, multipolygons, exports."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from mapweave.functions import boxes
from mapweave.functions import quadtree as qt
from mapweave.sources.style import Style

POINT, LINE, POLYGON, MULTI = 1, 2, 3, 7

# Rank of each highway class.
HIGHWAY_RANK = {
    "service": 1, "footway": 1, "path": 1, "footpath": 1, "cycleway": 1, "bridlepath": 1,
    "living_street": 2, "pedestrian": 2,
    "residential": 3, "unclassified": 3, "road": 3,
    "tertiary_link": 4, "tertiary": 4,
    "secondary_link": 6, "secondary": 6,
    "primary_link": 7, "primary": 7,
    "trunk_link": 8, "trunk": 8,
    "motorway_link": 9, "motorway": 9,
}


def _in(c: Column, values) -> Column:
    values = sorted(values)
    return c.isin(*values) if values else F.lit(False)


def tag_map(tags: Column) -> Column:
    """A list of (k, v) as a map; of a repeated key the last entry counts, null keys are left out; null stays null."""
    keyed = F.filter(tags, lambda e: e.isNotNull() & e["k"].isNotNull())
    last = F.filter(F.transform(keyed, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))), lambda e: ~F.exists(F.transform(keyed, lambda o, j: F.struct(o["k"].alias("k"), j.alias("j"))), lambda o: (o["k"] == e["k"]) & (o["j"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def _styled(tags: Column, keep, style: Style) -> Column:
    """The tags whose keys ``keep`` has; where the style asks for it, the others are packed as JSON into ``other_tags``."""
    kept = F.map_filter(tags, lambda k, v: _in(k, keep))
    if style.types.get("other_tags") != "json":
        return kept
    rest = F.map_filter(tags, lambda k, v: ~_in(k, keep))
    packed = F.map_concat(F.map_filter(kept, lambda k, v: k != "other_tags"), F.create_map(F.lit("other_tags"), F.to_json(rest)))
    return F.when((F.size(rest) > 0) | F.map_contains_key(tags, "other_tags"), packed).otherwise(kept)


def node_tags(tags: Column, style: Style) -> Column:
    return _styled(tags, style.node, style)


def is_node_feature(tags: Column, style: Style) -> Column:
    return F.coalesce(F.exists(F.map_keys(tags), lambda k: _in(k, style.node & style.feature)), F.lit(False))


def way_tags(tags: Column, style: Style) -> Column:
    return _styled(tags, style.way, style)


def is_way_feature(tags: Column, style: Style) -> Column:
    return F.coalesce(F.exists(F.map_keys(tags), lambda k: _in(k, style.way & style.feature)), F.lit(False))


def is_polygon(tags: Column, style: Style) -> Column:
    """Any kept key is one of areas, a kept ``area`` is true, or there is a ``boundary``."""
    poly = F.exists(F.map_keys(tags), lambda k: _in(k, style.poly & style.way))
    area = F.lower(tags["area"]).isin("1", "yes", "true") if "area" in style.way else F.lit(False)
    return F.coalesce(poly, F.lit(False)) | F.coalesce(area, F.lit(False)) | F.coalesce(F.map_contains_key(tags, "boundary"), F.lit(False))


def z_order(tags: Column) -> Column:
    """Drawing order: highway rank above 1, railway 5, the greater; plus ten times layer, bridge up, tunnel down.

    An explicit ``z_order`` replaces the base; one that is no integer gives 0 altogether.
    """
    ranks = F.create_map(*[F.lit(x) for k, v in HIGHWAY_RANK.items() if v > 1 for x in (k, v)])
    rank = F.coalesce(F.try_element_at(ranks, tags["highway"]), F.lit(0))
    base = F.greatest(rank, F.when(F.map_contains_key(tags, "railway"), 5).otherwise(0)).cast("bigint")
    number = lambda c: F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint"))
    there = lambda k: F.when(F.map_contains_key(tags, k) & ~F.coalesce(F.lower(tags[k]).isin("0", "no", "false"), F.lit(False)), 1).otherwise(0)
    layer = F.coalesce(number(tags["layer"]), F.lit(0)) + there("bridge") - there("tunnel")
    own = tags["z_order"]
    total = F.when(F.coalesce(own, F.lit("")) == "", base + 10 * layer).otherwise(number(own) + 10 * layer)
    return F.coalesce(total, F.lit(0)).cast("bigint")


def way_coordinates(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ways with ``coords``: their nodes in order as structs ref, lon, lat. Ways with a node that is missing drop out.

    ``ways``: id, refs and more; ``nodes``: id, lon, lat. Null refs count as missing. One join on node id; a way comes
    together again by its id, so the shuffle carries places and positions only, never tags. Neither join broadcasts: the
    planner takes ways for as small as their file is compressed and with one ref each, and would send them all.
    """
    refs = ways.select("id", F.posexplode("refs").alias("pos", "ref")).hint("merge")
    met = refs.join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref")
    lines = met.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "lon", "lat"))).alias("c"))
    lines = lines.select("id", F.transform("c", lambda p: F.struct(p["ref"].alias("ref"), p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("coords"))
    return ways.join(lines.hint("merge"), "id").where(F.size("coords") == F.size("refs"))


def relevant_elements(nodes: DataFrame, ways: DataFrame, relations: DataFrame, box: tuple[int, int, int, int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What geometries can come of, before any are made: (nodes, ways, relations) with the columns they had.

    Nodes (``tags`` a map, ``lon, lat``) with tags, within the box; ways (``coords``) whose own box meets it; relations
    that are boundaries, multipolygons or routes by their ``type``. Null tags are none.
    """
    tagged = nodes.where(F.coalesce(F.size("tags"), F.lit(0)) > 0)
    kept = relations.where(F.coalesce(F.col("tags")["type"].isin("boundary", "multipolygon", "route"), F.lit(False)))
    if box is None:
        return tagged, ways, kept
    area = boxes.box(*box)
    side = lambda f, c: f(F.transform("coords", lambda p: p[c]))
    own = boxes.box(side(F.array_min, "lon"), side(F.array_min, "lat"), side(F.array_max, "lon"), side(F.array_max, "lat"))
    return tagged.where(boxes.contains_xy(area, F.col("lon"), F.col("lat"))), ways.where(boxes.intersects(own, area)), kept


def _xy(p: Column) -> tuple[Column, Column]:
    m = qt.mercator(p["lon"] / 1e7, p["lat"] / 1e7)
    return m["x"], m["y"]


def drop_repeats(coords: Column) -> Column:
    """Successive points in the same place become one."""
    return F.filter(coords, lambda p, i: (i == 0) | (F.coalesce(F.get(coords, i - 1)["lon"] != p["lon"], F.lit(True))) | F.coalesce(F.get(coords, i - 1)["lat"] != p["lat"], F.lit(True)))


def signed_ring_area(coords: Column) -> Column:
    """Mercator square metres of a closed ring, positive if it runs counter-clockwise; 0 below three points."""
    def part(i: Column) -> Column:
        (x1, y1), (x2, y2) = _xy(F.element_at(coords, i)), _xy(F.element_at(coords, i + 1))
        return x1 * y2 - x2 * y1

    total = F.aggregate(F.sequence(F.lit(1), F.size(coords) - 1), F.lit(0.0), lambda a, i: a + part(i))
    return F.when(F.size(coords) < 3, F.lit(0.0)).otherwise(total / 2)


def ring_area(coords: Column) -> Column:
    """Area of a ring in Mercator square metres; 0 if it has fewer than four different points in a row."""
    clean = drop_repeats(coords)
    return F.when(F.size(clean) < 4, F.lit(0.0)).otherwise(F.abs(signed_ring_area(coords)))


def oriented(coords: Column, clockwise: bool) -> Column:
    area = signed_ring_area(coords)
    return F.when((area > 0) if clockwise else (area < 0), F.reverse(coords)).otherwise(coords)


def node_geometries(nodes: DataFrame, style: Style) -> DataFrame:
    """Points of tagged nodes that are features: ``id, tags, lon, lat, qt``. ``nodes``: id, lon, lat, qt, tags (a map)."""
    rows = nodes.where(F.size("tags") > 0).withColumn("tags", node_tags(F.col("tags"), style))
    return rows.where(is_node_feature(F.col("tags"), style)).select("id", "tags", "lon", "lat", "qt")


def way_geometries(ways: DataFrame, style: Style) -> DataFrame:
    """Every way with coordinates as a line or a polygon: ``id, geom_type, tags, coords, z_order, way_area, qt``.

    A polygon needs tags that say so and a ring of at least three coordinates closed by its refs; its ring runs
    clockwise. Ways without coordinates have no row. ``ways``: id, tags (a map), coords, qt.
    """
    rows = ways.where(F.size("coords") > 0).withColumn("tags_", way_tags(F.col("tags"), style))
    closed = (F.element_at("coords", 1)["ref"] == F.element_at("coords", -1)["ref"]) & (F.size("coords") >= 3)
    poly = is_polygon(F.col("tags_"), style) & closed
    ring = oriented(drop_repeats(F.col("coords")), True)
    return rows.select(
        "id",
        F.when(poly, POLYGON).otherwise(LINE).cast("tinyint").alias("geom_type"),
        F.col("tags_").alias("tags"),
        F.when(poly & (F.size(drop_repeats(F.col("coords"))) >= 4), ring).otherwise(F.col("coords")).alias("coords"),
        z_order(F.col("tags_")).alias("z_order"),
        F.when(poly, ring_area(F.col("coords"))).otherwise(0.0).alias("way_area"),
        "qt",
    )


def parent_highway(value: Column, n: Column) -> Column:
    """Of the highway values of a node's ways the one it takes, as an aggregate over the distinct ones with their counts.

    A single value as it is. Else the highest rank; at the same rank one that is no link, then the smaller text. If no
    value has a rank, one that is no link, then the most frequent one, then the smaller text.
    """
    rank = F.try_element_at(F.create_map(*[F.lit(x) for kv in HIGHWAY_RANK.items() for x in kv]), value)
    often = F.when(rank.isNull(), -n).otherwise(0)
    return F.min(F.struct((-F.coalesce(rank, F.lit(0))).alias("r"), value.endswith("link").cast("int").alias("link"), often.alias("n"), value.alias("v")))["v"]


def node_parent_highways(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """``id, parent_highway`` of nodes with a ``highway`` tag that lie on ways with one. Tags are maps."""
    on = ways.where(F.map_contains_key("tags", "highway")).select(F.col("tags")["highway"].alias("v"), F.explode("refs").alias("id")).where("id is not null")
    tagged = nodes.where(F.map_contains_key("tags", "highway")).select("id")
    # Values per node are counted before they move: a node on many ways costs one row per value and task.
    counted = on.join(tagged, "id", "left_semi").groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("id").agg(parent_highway(F.col("v"), F.col("n")).alias("parent_highway"))


def relation_value_range(relations: DataFrame, members: DataFrame, test: Column, key: str) -> DataFrame:
    """``way, values``: for each direct way member of the relations that pass ``test``, the sorted distinct values of ``key``."""
    picked = relations.where(test & F.map_contains_key("tags", key)).select(F.col("id").alias("relation_id"), F.col("tags")[key].alias("v"))
    met = members.where("mem_type = 1 and mem_ref is not null").select("relation_id", F.col("mem_ref").alias("way")).join(picked, "relation_id")
    return met.groupBy("way").agg(F.array_sort(F.collect_set("v")).alias("values"))


def admin_levels(relations: DataFrame, members: DataFrame) -> DataFrame:
    """``way, min_admin_level, max_admin_level`` from administrative boundaries; values that are no integer are left out."""
    test = (F.col("tags")["boundary"] == "administrative") & (F.col("tags")["type"] == "boundary")
    found = relation_value_range(relations, members, test, "admin_level")
    levels = F.filter(F.transform("values", lambda v: F.when(v.rlike(r"^[+-]?\d+$"), v.try_cast("bigint"))), lambda v: v.isNotNull())
    found = found.withColumn("levels", levels).where(F.size("levels") > 0)
    return found.select("way", F.array_min("levels").alias("min_admin_level"), F.array_max("levels").alias("max_admin_level"))


def route_list(relations: DataFrame, members: DataFrame, route: str, key: str) -> DataFrame:
    """``way, routes``: the values of ``key`` of the routes of one kind that run over the way, sorted, joined by ``;``."""
    test = (F.col("tags")["type"] == "route") & (F.col("tags")["route"] == route)
    return relation_value_range(relations, members, test, key).select("way", F.array_join("values", ";").alias("routes"))


# Rings of relations. A relation is one row with its ways as arrays, so these run over rows, without a shuffle of points.

Ring = list[tuple[int, int, int]]


def merge_rings(lines: list[Ring]) -> list[Ring]:
    """Lines joined end to end by their refs, turned around where need be; each comes out once, closed or not."""
    ends: dict[int, list[int]] = {}
    for i, line in enumerate(lines):
        if line and line[0][0] != line[-1][0]:
            ends.setdefault(line[0][0], []).append(i)
            ends.setdefault(line[-1][0], []).append(i)
    used, out = set(), []
    for i, line in enumerate(lines):
        if i in used or not line:
            continue
        used.add(i)
        ring = list(line)
        for _ in range(2):
            while ring[0][0] != ring[-1][0]:
                nxt = next((j for j in ends.get(ring[-1][0], ()) if j not in used), None)
                if nxt is None:
                    break
                used.add(nxt)
                more = lines[nxt]
                ring += more[1:] if more[0][0] == ring[-1][0] else more[-2::-1]
            if ring[0][0] == ring[-1][0]:
                break
            ring.reverse()
        out.append(ring)
    return out


def _cross(a, b, c) -> int:
    return (b[1] - a[1]) * (c[2] - a[2]) - (b[2] - a[2]) * (c[1] - a[1])


def _edges_meet(a, b, c, d) -> bool:
    """Whether two segments that are not parallel share a point."""
    if (b[1] - a[1]) * (d[2] - c[2]) == (b[2] - a[2]) * (d[1] - c[1]):
        return False
    p, q, r, s = _cross(a, b, c), _cross(a, b, d), _cross(c, d, a), _cross(c, d, b)
    return (p <= 0 <= q or q <= 0 <= p) and (r <= 0 <= s or s <= 0 <= r)


def point_in_ring(ring: Ring, lon: int, lat: int) -> bool:
    inside = False
    for (_, ax, ay), (_, bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > lat) != (by > lat) and (by > ay) == ((lon - ax) * (by - ay) < (bx - ax) * (lat - ay)):
            inside = not inside
    return inside


def ring_contains(outer: Ring, inner: Ring) -> bool:
    if any(_edges_meet(a, b, c, d) for a, b in zip(outer, outer[1:]) for c, d in zip(inner, inner[1:])):
        return False
    return point_in_ring(outer, inner[0][1], inner[0][2])


def group_rings(outers: list[Ring], inners: list[Ring]) -> list[list[Ring]]:
    """Polygons as lists of an outer ring and its holes; one outer takes all, of several each takes what it contains."""
    if len(outers) == 1:
        return [[outers[0], *inners]]
    return [[o, *[i for i in inners if ring_contains(o, i)]] for o in outers]


def _project(p) -> tuple[float, float]:
    lat = math.radians(p[2] / 1e7)
    return p[1] / 1e7 * qt.HALF_CIRCUMFERENCE_M / 180, math.log(math.tan(math.pi / 4 + lat / 2)) * qt.HALF_CIRCUMFERENCE_M / math.pi


def polygon_area(rings: list[Ring]) -> tuple[float, list[Ring]]:
    """Area of outer less holes, and the rings without repeats, outer clockwise, holes counter-clockwise; 0 if a ring is too short."""
    total, out, short = 0.0, [], False
    for n, ring in enumerate(rings):
        clean = [p for i, p in enumerate(ring) if not i or p[1:] != ring[i - 1][1:]]
        xy = [_project(p) for p in clean]
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(xy, xy[1:])) / 2
        short |= len(clean) < 4
        out.append(clean[::-1] if (area > 0) == (n == 0) and area else clean)
        total += abs(area) * (1 if n == 0 else -1)
    return 0.0 if short else total, out


def merged_tags(own: dict[str, str], outer: list[dict[str, str]]) -> dict[str, str]:
    """Relation tags joined by its outer ways' tags, among which conflicting values cancel a key; empty values count for nothing."""
    def add(to: dict[str, str], tags: dict[str, str]) -> None:
        for k, v in tags.items():
            if v:
                to[k] = v if k not in to else to[k] if to[k] in ("", v) else ""

    ways: dict[str, str] = {}
    for tags in outer:
        add(ways, tags)
    out = dict(own)
    add(out, ways)
    return {k: v for k, v in out.items() if v}


_POLYGONS = "array<array<array<struct<ref:bigint,lon:bigint,lat:bigint>>>>"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    point = pa.struct([("ref", pa.int64()), ("lon", pa.int64()), ("lat", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("polygons", pa.list_(pa.list_(pa.list_(point)))), ("way_area", pa.float64()), ("outer_ways", pa.list_(pa.int64()))])
    for batch in batches:
        out = []
        for rel in batch.to_pylist():
            own = dict(rel["tags"] or [])
            lines: dict[bool, list[Ring]] = {True: [], False: []}
            outer_tags, outer_ids = [], []
            for m in rel["ways"]:
                is_outer = m["role"] != "inner"
                lines[is_outer].append([(p["ref"], p["lon"], p["lat"]) for p in m["coords"]])
                if is_outer:
                    outer_ids.append(m["way"])
                    if "boundary" not in own:
                        outer_tags.append(dict(m["tags"] or []))
            outers, inners = ([r for r in merge_rings(lines[side]) if len(r) >= 4 and r[0][0] == r[-1][0]] for side in (True, False))
            if not outers:
                continue
            parts = [polygon_area(g) for g in group_rings(outers, inners)]
            polygons = [[[{"ref": a, "lon": b, "lat": c} for a, b, c in ring] for ring in rings] for _, rings in parts]
            out.append({"id": rel["id"], "tags": list(merged_tags(own, outer_tags).items()), "polygons": polygons, "way_area": sum(a for a, _ in parts), "outer_ways": outer_ids if "boundary" not in own else []})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def multipolygons(relations: DataFrame, members: DataFrame, ways: DataFrame, style: Style) -> tuple[DataFrame, DataFrame]:
    """Polygons of boundary and multipolygon relations, and the tags they take over from their ways.

    ``relations``: id, tags (a map); ``members``: relation_id, pos, mem_type, mem_ref, mem_role; ``ways``: id, tags,
    coords. First result: ``id, geom_type, tags, polygons, z_order, way_area``; relations without a closed outer ring,
    without tags that make a polygon, or without ways are left out. Second: ``way, key`` of tags that an outer way
    shares with a polygon made of it, which ``way_geometries`` may drop. Ways travel as one row with their coordinates
    as an array; a relation is one row.
    """
    heads = relations.where(F.col("tags")["type"].isin("boundary", "multipolygon")).select("id", "tags")
    lines = members.where("mem_type = 1").select(F.col("relation_id").alias("id"), "pos", F.col("mem_ref").alias("way"), F.coalesce("mem_role", F.lit("")).alias("role"))
    lines = lines.join(heads.select("id"), "id", "left_semi").join(ways.select(F.col("id").alias("way"), "tags", "coords"), "way")
    grouped = lines.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "way", "role", F.map_entries("tags").alias("t"), "coords"))).alias("ws"))
    grouped = grouped.select("id", F.transform("ws", lambda w: F.struct(w["way"].alias("way"), w["role"].alias("role"), F.map_from_entries(w["t"]).alias("tags"), w["coords"].alias("coords"))).alias("ways"))
    made = heads.join(grouped, "id").mapInArrow(_assemble, f"id bigint, tags map<string,string>, polygons {_POLYGONS}, way_area double, outer_ways array<bigint>")
    kept = made.withColumn("tags", way_tags(F.col("tags"), style))
    kept = kept.where((F.size("tags") > 0) & is_polygon(F.col("tags"), style))
    result = kept.select("id", F.when(F.size("polygons") == 1, POLYGON).otherwise(MULTI).cast("tinyint").alias("geom_type"), "tags", "polygons", z_order(F.col("tags")).alias("z_order"), "way_area")
    shared = kept.select(F.explode("outer_ways").alias("way"), F.col("tags").alias("rel_tags")).join(ways.select(F.col("id").alias("way"), "tags"), "way")
    shared = shared.select("way", F.explode(F.map_keys(F.map_filter("tags", lambda k, v: F.coalesce(F.try_element_at(F.col("rel_tags"), k) == v, F.lit(False))))).alias("key")).distinct()
    return result, shared


def without_shared_tags(ways: DataFrame, shared: DataFrame, style: Style) -> DataFrame:
    """Way geometries less the tags that polygons took over; what then is no feature any more is left out."""
    keys = shared.groupBy("way").agg(F.collect_set("key").alias("gone"))
    rows = ways.join(keys.withColumnRenamed("way", "id"), "id", "left")
    rows = rows.withColumn("tags", F.when(F.col("gone").isNull(), F.col("tags")).otherwise(F.map_filter("tags", lambda k, v: ~F.array_contains("gone", k))))
    return rows.where(F.col("gone").isNull() | is_way_feature(F.col("tags"), style)).drop("gone")


def partial_line(coords: Column, start: Column, end: Column) -> Column:
    """Points start to end (places from 0, both included) of a line; backwards if end lies before start."""
    low, high = F.least(start, end), F.greatest(start, end)
    piece = F.slice(coords, (low + 1).cast("int"), (high - low + 1).cast("int"))
    return F.when(end < start, F.reverse(piece)).otherwise(piece)


def is_valid_line(coords: Column) -> Column:
    return F.size(coords) >= 2


def is_valid_polygon(rings: Column) -> Column:
    return (F.size(rings) > 0) & F.forall(rings, lambda r: F.size(r) >= 4)


# Exports.


def _wkt_points(coords: Column, as_mercator: bool) -> Column:
    def one(p: Column) -> Column:
        x, y = _xy(p) if as_mercator else (p["lon"] / 1e7, p["lat"] / 1e7)
        return F.format_string("%f %f", x, y)

    return F.concat(F.lit("("), F.array_join(F.transform(coords, one), ","), F.lit(")"))


def wkt_point(lon: Column, lat: Column, as_mercator: bool = False) -> Column:
    return F.concat(F.lit("POINT"), _wkt_points(F.array(F.struct(lon.alias("lon"), lat.alias("lat"))), as_mercator))


def wkt_line(coords: Column, as_mercator: bool = False) -> Column:
    return F.concat(F.lit("LINESTRING"), _wkt_points(coords, as_mercator))


def wkt_polygon(rings: Column, as_mercator: bool = False) -> Column:
    return F.concat(F.lit("POLYGON("), F.array_join(F.transform(rings, lambda r: _wkt_points(r, as_mercator)), ","), F.lit(")"))


def wkt_polygons(polygons: Column, as_mercator: bool = False) -> Column:
    """Several polygons as a geometry collection."""
    return F.concat(F.lit("GEOMETRYCOLLECTION("), F.array_join(F.transform(polygons, lambda p: wkt_polygon(p, as_mercator)), ","), F.lit(")"))


def wkb(kind: int, body, srid: int | None = None) -> bytes:
    """Big-endian WKB; with ``srid`` as EWKB. ``body``: a point, a line's points, a polygon's rings, or polygons."""
    code = {POINT: 1, LINE: 2, POLYGON: 3, MULTI: 6}[kind]
    head = b"\x00" + struct.pack(">I", code | (0x20000000 if srid else 0)) + (struct.pack(">I", srid) if srid else b"")
    points = lambda ps: struct.pack(">I", len(ps)) + b"".join(struct.pack(">dd", *p) for p in ps)
    if kind == POINT:
        return head + struct.pack(">dd", *body)
    if kind == LINE:
        return head + points(body)
    if kind == POLYGON:
        return head + struct.pack(">I", len(body)) + b"".join(map(points, body))
    return head + struct.pack(">I", len(body)) + b"".join(wkb(POLYGON, p) for p in body)


def _wkb_of(polygons: pa.Array, lines: pa.Array, kinds: pa.Array, srid: int | None, as_mercator: bool) -> pa.Array:
    place = (lambda p: _project((0, p["lon"], p["lat"]))) if as_mercator else (lambda p: (p["lon"] / 1e7, p["lat"] / 1e7))
    out = []
    for kind, polys, line in zip(kinds.to_pylist(), polygons.to_pylist(), lines.to_pylist()):
        if kind in (POLYGON, MULTI) and polys:
            rings = [[[place(p) for p in r] for r in g] for g in polys]
            out.append(wkb(kind, rings[0] if kind == POLYGON else rings, srid))
        elif kind == LINE and line:
            out.append(wkb(LINE, [place(p) for p in line], srid))
        elif kind == POINT and line:
            out.append(wkb(POINT, place(line[0]), srid))
        else:
            out.append(None)
    return pa.array(out, pa.binary())


def wkb_column(kind: Column, coords: Column, polygons: Column, srid: int | None = None, as_mercator: bool = False) -> Column:
    """WKB of rows that hold points and lines in ``coords`` and polygons in ``polygons``."""
    udf = arrow_udf(lambda p, c, k: _wkb_of(p, c, k, srid, as_mercator), T.BinaryType())
    return udf(polygons, coords, kind)


def ewkb_per_polygon(polygons: list, srid: int) -> list[bytes]:
    return [wkb(POLYGON, p, srid) for p in polygons]


def generate(nodes: DataFrame, ways: DataFrame, relations: DataFrame, members: DataFrame, style: Style) -> DataFrame:
    """All geometries: ``orig_kind, id, geom_type, tags, coords, polygons, z_order, way_area, qt``.

    ``nodes``: id, lon, lat, qt, tags; ``ways``: id, refs, qt, tags; ``relations``: id, qt, tags; ``members`` as for
    ``multipolygons``. Tags are maps. Keys of the style switch steps on: ``parent_highway``, ``min_admin_level``,
    ``bus_routes``, ``cycle_routes``.
    """
    add = lambda df, key, values, on, col: df.join(values.select(F.col(on).alias("id"), F.col(col).cast("string").alias("v__")), "id", "left").withColumn("tags", F.when(F.col("v__").isNull(), F.col("tags")).otherwise(F.map_concat(F.map_filter("tags", lambda k, v: k != key), F.create_map(F.lit(key), F.col("v__"))))).drop("v__")
    if "parent_highway" in style.node:
        nodes = add(nodes, "parent_highway", node_parent_highways(nodes, ways), "id", "parent_highway")
    if "min_admin_level" in style.way:
        levels = admin_levels(relations, members)
        ways = add(ways, "min_admin_level", levels, "way", "min_admin_level")
        if "max_admin_level" in style.way:
            ways = add(ways, "max_admin_level", levels, "way", "max_admin_level")
    for key, route, source in (("bus_routes", "bus", "ref"), ("cycle_routes", "bicycle", "network")):
        if key in style.way:
            ways = add(ways, key, route_list(relations, members, route, source), "way", "routes")
    placed = way_coordinates(ways, nodes)
    polygons, shared = multipolygons(relations, members, placed, style)
    lines = without_shared_tags(way_geometries(placed, style), shared, style)
    points = node_geometries(nodes, style)
    none = F.lit(None)
    as_point = F.array(F.struct(F.col("id").alias("ref"), "lon", "lat"))
    point = points.select(F.lit(0).alias("orig_kind"), "id", F.lit(POINT).cast("tinyint").alias("geom_type"), "tags", as_point.alias("coords"), none.cast(_POLYGONS).alias("polygons"), F.lit(0).cast("bigint").alias("z_order"), F.lit(0.0).alias("way_area"), "qt")
    line = lines.select(F.lit(1).alias("orig_kind"), "id", "geom_type", "tags", F.when(F.col("geom_type") == LINE, F.col("coords")).alias("coords"), F.when(F.col("geom_type") == POLYGON, F.array(F.array("coords"))).alias("polygons"), "z_order", "way_area", "qt")
    area = polygons.join(relations.select("id", "qt"), "id").select(F.lit(2).alias("orig_kind"), "id", "geom_type", "tags", none.cast("array<struct<ref:bigint,lon:bigint,lat:bigint>>").alias("coords"), "polygons", "z_order", "way_area", "qt")
    return point.unionByName(line).unionByName(area)


def recalculated_tile(geoms: DataFrame, buffer: float = 0.025, level: int = 18) -> DataFrame:
    """Geometries with ``qt`` from their own boxes."""
    every = F.coalesce(F.col("coords"), F.flatten(F.flatten("polygons")))
    lons, lats = F.transform(every, lambda p: p["lon"]), F.transform(every, lambda p: p["lat"])
    return geoms.withColumn("qt", qt.calculate(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats), buffer, level))
