"""Queries over the map tables for the tiling, change, extract and geometry operators, and the SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions import boxes
from mapweave.functions import quadtree as qt
from mapweave.operators import changes as ch
from mapweave.operators import extract, geometry, store, tiles, update
from mapweave.operators.current import current_rows
from mapweave.operators.proximity import node_positions
from mapweave.session import fresh_path, table
from mapweave.sources import geojson
from mapweave.sources.style import style_from_table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Tables as the operators want them.


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return node_positions(table(spark, d, "full_nodes", "id", "vs", "ts", "visible", "lon", "lat"))


def ways(spark: SparkSession, d: str) -> DataFrame:
    rows = current_rows(table(spark, d, "full_ways", "id", "vs", "ts", "visible", "refs", "tags", "qt"), {"refs": F.col("refs"), "tags": F.col("tags"), "qt": F.col("qt")})
    return rows.where("not deleted").select("id", "refs", "tags", "qt")


def relations(spark: SparkSession, d: str) -> DataFrame:
    rows = current_rows(table(spark, d, "full_relations", "id", "vs", "ts", "visible", "tags", "qt"), {"tags": F.col("tags"), "qt": F.col("qt")})
    return rows.where("not deleted").select("id", "tags", "qt")


def members(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "rel_members").select("relation_id", "pos", F.col("mem_type").cast("int").alias("mem_type"), "mem_ref", "mem_role")
    return rows.join(relations(spark, d).select(F.col("id").alias("relation_id")), "relation_id", "left_semi")


_N = """n as (select id, lon, lat from (select id, max_by(coalesce(visible, true), (vs, ts)) as live, max_by({'v': lon}, (vs, ts)).v as lon, max_by({'v': lat}, (vs, ts)).v as lat from full_nodes group by id)
 where live and lon between -1800000000 and 1800000000 and lat between -900000000 and 900000000 and not (lon = -1800000000 and lat = -900000000))"""
_W = "w as (select id, refs, tags, qt from (select *, row_number() over (partition by id order by vs desc, ts desc) as k from full_ways) where k = 1 and coalesce(visible, true))"
_R = "r as (select id, tags, qt from (select *, row_number() over (partition by id order by vs desc, ts desc) as k from full_relations) where k = 1 and coalesce(visible, true))"
_M = "m as (select relation_id, pos, mem_type::integer as mem_type, mem_ref, mem_role from rel_members where relation_id in (select id from r))"
_QT = "(case when {q} < 0 then {q} when ({q} & 31) < {l} then {q} else (({q} >> (63 - 2 * {l})) << (63 - 2 * {l})) + {l} end)"


def _round_sql(q: str, level: int) -> str:
    return _QT.format(q=q, l=level) if level else f"(case when {q} < 0 then {q} else 0 end)"


def _common_sql(a: str, b: str) -> str:
    """The common tile of two columns, by trying all levels from the deepest."""
    tries = " ".join(f"when ({a} & 31) >= {z} and ({b} & 31) >= {z} and {_round_sql(a, z)} = {_round_sql(b, z)} then {_round_sql(a, z)}" for z in range(28, 0, -1))
    return f"(case when {a} is null or {a} = -1 then {b} when {b} is null or {b} = -1 then {a} {tries} else 0 end)"


_UV = "select id, (lon + 1800000000) >> 18 as x, (lat + 900000000) >> 17 as y, 14::bigint as z from n"


def _uv(spark, d):
    return nodes(spark, d).select("id", F.shiftright(F.col("lon") + 1_800_000_000, 18).alias("x"), F.shiftright(F.col("lat") + 900_000_000, 17).alias("y"), F.lit(14).cast("bigint").alias("z"))


_PATH = " + ".join(f"(((x >> {i}) & 1) + 2 * ((y >> {i}) & 1)) * {4**i}" for i in range(14))


@query(f"with {_N}, u as ({_UV}) select id, (({_PATH}) << 35) + 14 as q from u")
def qt_from_tuple(spark, d):
    return _uv(spark, d).select("id", qt.from_tuple(F.col("x"), F.col("y"), F.col("z")).alias("q"))


@query(f"with {_N} {_UV.replace('select id', ', u as (select id', 1)}) select id, x, y, z from u")
def qt_tuple(spark, d):
    q = _uv(spark, d).select("id", qt.from_tuple(F.col("x"), F.col("y"), F.col("z")).alias("q"))
    return q.select("id", qt.to_tuple(F.col("q")).alias("t")).select("id", "t.x", "t.y", "t.z")


@query(f"select id, qt, {_round_sql('qt', 5)} as at5, {_round_sql('qt', 12)} as at12 from full_nodes where qt is not null")
def qt_round(spark, d):
    rows = table(spark, d, "full_nodes", "id", "qt").where("qt is not null")
    return rows.select("id", "qt", qt.round_to(F.col("qt"), 5).alias("at5"), qt.round_to(F.col("qt"), 12).alias("at12"))


@query(f"select user_name, {_common_sql('min(case when qt >= 0 then qt end)', 'max(case when qt >= 0 then qt end)')} as q from full_nodes group by user_name")
def qt_common_of_group(spark, d):
    return table(spark, d, "full_nodes", "user_name", "qt").groupBy("user_name").agg(qt.common_agg(F.col("qt")).alias("q"))


@query("select id, qt, case when qt < 0 then 'NULL' else array_to_string(list_transform(range(0, qt & 31), lambda i: ['A','B','C','D'][((qt >> (61 - 2 * i)) & 3) + 1]), '') end as s, qt as back from full_ways where qt is not null")
def qt_string(spark, d):
    rows = table(spark, d, "full_ways", "id", "qt").where("qt is not null")
    rows = rows.withColumn("s", qt.to_letters(F.col("qt")))
    return rows.withColumn("back", F.coalesce(qt.from_letters(F.col("s")), F.lit(-1)).cast("bigint"))


# Beyond 89 degrees, where the projection runs off, metres are compared to a thousand only, at the poles not at all.
_MERC_Y = "ln(tan(pi() * (1 + (lat / 1e7) / 90) / 4)) * 20037508.3428 / pi()"


@query(f"with {_N} select id, round(lon / 1e7 * 20037508.3428 / 180, 4) as x, case when abs(lat) < 890000000 then round({_MERC_Y}, 3) when abs(lat) < 899999000 then round({_MERC_Y} / 1000) * 1000 end as y from n")
def mercator(spark, d):
    m = qt.mercator(F.col("lon") / 1e7, F.col("lat") / 1e7)
    y = F.when(F.abs("lat") < 890_000_000, F.round(m["y"], 3)).when(F.abs("lat") < 899_999_000, F.round(m["y"] / 1000) * 1000)
    return nodes(spark, d).select("id", F.round(m["x"], 4).alias("x"), y.alias("y"))


_LAT = "(atan(exp((90 - {y} * 180 / p) * pi() / 90)) * 4 / pi() - 1) * 90"
_COL = " + ".join(f"((qt >> (61 - 2 * {i})) & 1) * (case when (qt & 31) > {i} then 1::bigint << ((qt & 31) - 1 - {i}) else 0 end)" for i in range(19))
_ROW = " + ".join(f"((qt >> (62 - 2 * {i})) & 1) * (case when (qt & 31) > {i} then 1::bigint << ((qt & 31) - 1 - {i}) else 0 end)" for i in range(19))


@query(f"with t as (select distinct qt from full_nodes where qt >= 0), u as (select qt, {_COL} as x, {_ROW} as y, pow(2.0, qt & 31) as p from t) select qt, round((x * 360 / p - 180) * 1e7)::bigint as minx, round({_LAT.format(y='(y + 1)')} * 1e7)::bigint as miny, round(((x + 1) * 360 / p - 180) * 1e7)::bigint as maxx, round({_LAT.format(y='y')} * 1e7)::bigint as maxy from u")
def qt_bounds(spark, d):
    rows = table(spark, d, "full_nodes", "qt").where("qt >= 0").distinct()
    return rows.select("qt", qt.bounds(F.col("qt")).alias("b")).select("qt", "b.*")


@query(f"with {_N}, {_W}, x as (select id, unnest(refs) as node from w) select x.id as way, min(lon) as minx, min(lat) as miny, max(lon) as maxx, max(lat) as maxy from x join n on n.id = node group by x.id")
def way_bbox(spark, d):
    return tiles.way_boxes(ways(spark, d), nodes(spark, d))


@query()
def element_quadtrees(spark, d):
    return tiles.element_tiles(nodes(spark, d), ways(spark, d), relations(spark, d), members(spark, d))


# From the quadtrees of the tables, so that SQL can follow: ways as given, nodes and relations from their ways.
@query(f"with {_N}, {_W}, x as (select distinct id, unnest(refs) as node from w), g as (select node, min(qt) as lo, max(qt) as hi from x join w on w.id = x.id where w.qt >= 0 group by node) select n.id as node, {_common_sql('lo', 'hi')} as qt from n join g on g.node = n.id")
def node_qt_from_ways(spark, d):
    w = ways(spark, d)
    placed = w.where("qt >= 0").select(F.col("id").alias("way"), "qt")
    on = tiles.way_nodes(w).join(placed, "way", "left_semi").select("node").distinct()
    return tiles.node_tiles(nodes(spark, d), w, placed).join(on, "node", "left_semi")


@query(f"""with recursive {_N}, {_W}, {_R}, {_M},
 q as (select relation_id, w.qt from m join w on w.id = mem_ref where mem_type = 1 and w.qt >= 0),
 l as (select distinct relation_id as p, mem_ref as c from m where mem_type = 2 and mem_ref in (select id from r) and relation_id <> mem_ref),
 b as (select id as p, id as c from r union select b.p, l.c from b join l on l.p = b.c),
 g as (select b.p, min(q.qt) as lo, max(q.qt) as hi from b left join q on q.relation_id = b.c group by b.p)
 select p as relation, case when lo is null then 0 else {_common_sql('lo', 'hi')} end as qt from g""")
def relation_qt_nested(spark, d):
    w = ways(spark, d).select(F.col("id").alias("way"), "qt").where("qt >= 0")
    none = spark.createDataFrame([], "node bigint, qt bigint")
    rel = relations(spark, d)
    inside = members(spark, d).join(rel.select(F.col("id").alias("mem_ref"), F.lit(2).alias("mem_type")), ["mem_ref", "mem_type"], "left_semi")
    return tiles.relation_tiles(rel, members(spark, d).where("mem_type = 1").unionByName(inside.select("relation_id", "pos", "mem_type", "mem_ref", "mem_role")), none, w)


@query(f"select {_round_sql('qt', 10)} as qt, count(*) as n from full_nodes where qt >= 0 group by 1")
def tile_counts(spark, d):
    return tiles.tile_counts(table(spark, d, "full_nodes", "qt"), 10)


@query(f"with c as (select {_round_sql('qt', 10)} as q, count(*) as n from full_nodes where qt >= 0 group by 1), a as (select q, n, unnest(range(0, (q & 31) + 1)) as l from c), t as (select q, n, case when l = 0 then 0 else ((q >> (63 - 2 * l)) << (63 - 2 * l)) + l end as tile from a) select tile as qt, cast(sum(case when tile = q then n else 0 end) as bigint) as n, cast(sum(n) as bigint) as total from t group by tile")
def tile_totals(spark, d):
    return tiles.tile_totals(tiles.tile_counts(table(spark, d, "full_nodes", "qt"), 10))


@query()
def tile_groups(spark, d):
    return tiles.tile_groups(table(spark, d, "full_nodes", "qt"), 2000, 500)


_TILES = f"(select distinct {_round_sql('qt', 4)} as qt from full_ways where qt >= 0 union select 0)"


@query(f"with t as {_TILES}, a as (select distinct qt as q, unnest(range(0, (qt & 31) + 1)) as l from full_nodes where qt >= 0), b as (select q, l, case when l = 0 then 0 else ((q >> (63 - 2 * l)) << (63 - 2 * l)) + l end as tile from a), f as (select q, max_by(tile, l) as tile from b join t on t.qt = b.tile group by q) select id, full_nodes.qt, tile from full_nodes left join f on f.q = full_nodes.qt")
def tile_assign(spark, d):
    w = table(spark, d, "full_ways", "qt").where("qt >= 0").select(qt.round_to(F.col("qt"), 4).alias("qt")).distinct()
    return tiles.assign_tiles(table(spark, d, "full_nodes", "id", "qt"), w.union(spark.range(1).select(F.col("id").alias("qt"))).distinct())


@query("with e as (select 0 as kind, id from full_nodes union select 1, id from full_ways union select 2, id from full_relations) select kind, id, cast(floor((row_number() over (order by kind, id) - 1) / 1000) as bigint) as block from e")
def group_blocks(spark, d):
    every = [table(spark, d, t, "id").select(F.lit(k).alias("kind"), "id") for k, t in enumerate(("full_nodes", "full_ways", "full_relations"))]
    return tiles.group_blocks(every[0].union(every[1]).union(every[2]).distinct(), 1000)


@query("select 0 as kind, id, id >> 14 as alloc from full_nodes union all select 1, id, (id >> 11) + (1::bigint << 32) from full_ways union all select 2, id, (id >> 9) + (2::bigint << 32) from full_relations")
def alloc_by_id(spark, d):
    every = [table(spark, d, t, "id").select(F.lit(k).alias("kind"), "id") for k, t in enumerate(("full_nodes", "full_ways", "full_relations"))]
    e = every[0].union(every[1]).union(every[2])
    return e.select("kind", "id", tiles.alloc_by_id(F.col("kind"), F.col("id")).alias("alloc"))


# Changes.


def _feed(spark, d) -> DataFrame:
    return table(spark, d, "osc_changes").select(F.col("object_type").cast("int").alias("kind"), "id", F.col("change_type").cast("int").alias("change"), "vs", "seq", F.col("file_idx").cast("bigint").alias("start_date"), "file_idx")


def _base(spark, d) -> DataFrame:
    every = None
    for k, t in enumerate(("full_nodes", "full_ways", "full_relations")):
        rows = current_rows(table(spark, d, t, "id", "vs", "ts", "visible")).where("not deleted").select(F.lit(k).alias("kind"), "id", F.lit(0).alias("change"), "vs")
        every = rows if every is None else every.unionByName(rows)
    return every


_B = " union all ".join(f"select {k} as kind, id, 0 as change, vs from (select id, max_by(vs, (vs, ts)) as vs, max_by(coalesce(visible, true), (vs, ts)) as live from {t} group by id) where live" for k, t in enumerate(("full_nodes", "full_ways", "full_relations")))
_LAST = "(select object_type::integer as kind, id, change_type::integer as change, vs, seq, file_idx, row_number() over (partition by object_type, id order by seq desc) as k from osc_changes)"


@query(f"select kind, id, change, vs from {_LAST} where k = 1")
def change_last_in_file(spark, d):
    return ch.last_in_file(_feed(spark, d)).select("kind", "id", "change", "vs")


@query("with f as (select object_type::integer as kind, id, change_type::integer as change, vs, file_idx, row_number() over (partition by object_type, id, file_idx order by seq desc) as k from osc_changes), l as (select *, row_number() over (partition by kind, id order by file_idx desc) as j from f where k = 1) select kind, id, change, vs, file_idx from l where j = 1")
def change_latest(spark, d):
    feed = _feed(spark, d)
    per_file = feed.groupBy("kind", "id", "file_idx").agg(F.max_by(F.struct("change", "vs", "start_date"), "seq").alias("r")).select("kind", "id", "file_idx", "r.*")
    return ch.merge_changes(per_file).select("kind", "id", "change", "vs", "file_idx")


@query(f"with b as ({_B}), c as (select * from {_LAST} where k = 1) select coalesce(b.kind, c.kind) as kind, coalesce(b.id, c.id) as id, 0 as change, coalesce(c.vs, b.vs) as vs from b full join c on b.kind = c.kind and b.id = c.id where c.change is null or c.change > 2")
def change_apply(spark, d):
    return ch.apply_merged(_base(spark, d), ch.last_in_file(_feed(spark, d)).select("kind", "id", "change", "vs"))


@query(f"with b as ({_B}), c as (select * from {_LAST} where k = 1) select coalesce(b.kind, c.kind) as kind, coalesce(b.id, c.id) as id, b.vs as base_vs, c.vs as change_vs from b full join c on b.kind = c.kind and b.id = c.id")
def pair_full_outer(spark, d):
    pairs = ch.pair_elements(_base(spark, d), ch.last_in_file(_feed(spark, d)).select("kind", "id", "change", "vs"))
    return pairs.select("kind", "id", F.col("left.vs").alias("base_vs"), F.col("right.vs").alias("change_vs"))


@query(f"select kind, id, vs from {_LAST} where k = 1 and change not in (1, 2)")
def change_as_normal(spark, d):
    return ch.as_normal(ch.last_in_file(_feed(spark, d))).select("kind", "id", "vs")


@query(f"with b as ({_B}), t as (select 0 as kind, id, max(qt) as qt from full_nodes where qt >= 0 group by id union all select 1, id, max(qt) from full_ways where qt >= 0 group by id union all select 2, id, max(qt) from full_relations where qt >= 0 group by id) select b.kind, b.id, b.vs, t.qt from b join t on t.kind = b.kind and t.id = b.id")
def attach_qt(spark, d):
    every = [table(spark, d, t, "id", "qt").where("qt >= 0").groupBy("id").agg(F.max("qt").alias("qt")).select(F.lit(k).alias("kind"), "id", "qt") for k, t in enumerate(("full_nodes", "full_ways", "full_relations"))]
    return tiles.attach_tiles(_base(spark, d), every[0].union(every[1]).union(every[2])).select("kind", "id", "vs", "qt")


# Extracts: an eighth of the planet, and the first regions' polygons.
_BOX = (0, 300_000_000, 900_000_000, 700_000_000)
_IN = "lon between 0 and 900000000 and lat between 300000000 and 700000000"
_SEL = f"""with recursive {_N}, {_W}, {_R}, {_M}, i as (select id from n where {_IN}), x as (select id, unnest(refs) as node from w), hw as (select distinct x.id from x join i on i.id = node),
 o as (select id from i union select node from x where id in (select id from hw) and node is not null),
 rs as (select distinct relation_id as id from m where (mem_type = 0 and mem_ref in (select id from i)) or (mem_type = 1 and mem_ref in (select id from hw))
  union select m.relation_id from m join rs on m.mem_type = 2 and m.mem_ref = rs.id)"""


def _selected(spark, d) -> DataFrame:
    return extract.selected_ids(nodes(spark, d), ways(spark, d), members(spark, d), extract.Area(box=_BOX))


@query(f"with {_N} select id, lon, lat from n where {_IN}")
def extract_bbox_nodes(spark, d):
    return nodes(spark, d).where(extract.Area(box=_BOX).holds(F.col("lon"), F.col("lat")))


@query(f"{_SEL} select 0 as kind, id from o union all select 1, id from hw union all select 2, id from rs")
def extract_ids(spark, d):
    return _selected(spark, d)


@query(f"{_SEL} select m.relation_id, m.pos, m.mem_type, m.mem_ref, m.mem_role from m where relation_id in (select id from rs) and ((mem_type = 0 and mem_ref in (select id from o)) or (mem_type = 1 and mem_ref in (select id from hw)) or (mem_type = 2 and mem_ref in (select id from rs)))")
def extract_trim_members(spark, d):
    return extract.trimmed_members(members(spark, d), _selected(spark, d))


# Geometry.


def _tagged(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.coalesce(geometry.tag_map(F.col("tags")), F.create_map().cast("map<string,string>")))


def _nodes_with_tags(spark, d) -> DataFrame:
    rows = table(spark, d, "full_nodes", "id", "vs", "ts", "visible", "lon", "lat", "tags", "qt")
    cur = current_rows(rows, {"tags": F.col("tags"), "qt": F.col("qt")}).where("not deleted").select("id", "tags", "qt")
    return _tagged(nodes(spark, d).join(cur, "id"))


_LASTTAG = "list_filter(tags, lambda e, i: e.k is not null and len(list_filter(tags[i + 1:], lambda o: o.k = e.k)) = 0)"


@query(f"with {_W} select id, list_sort(list_transform(list_filter(coalesce({_LASTTAG}, []), lambda e: e.k in (select tag from style_entries where is_way)), lambda e: e.k || '=' || coalesce(e.v, ''))) as kept, coalesce(len(list_filter({_LASTTAG}, lambda e: e.k in (select tag from style_entries where is_way and is_feature))) > 0, false) as feature from w".replace("in (select tag from style_entries where is_way)", "in ('access','amenity','barrier','building','highway','layer','maxspeed','oneway','surface','name','note','addr_street','description','cuisine','destination','route_ref','alt_name','operator','sport','crop','bus_lines')").replace("in (select tag from style_entries where is_way and is_feature)", "in ('amenity','barrier','building','highway')"))
def tag_filter(spark, d):
    style = style_from_table(table(spark, d, "style_entries"))
    w = _tagged(ways(spark, d)).withColumn("tags", geometry.way_tags(F.col("tags"), style))
    kept = F.array_sort(F.transform(F.map_entries("tags"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    return w.select("id", kept.alias("kept"), geometry.is_way_feature(F.col("tags"), style).alias("feature"))


_T = f"t as (select id, list_filter(coalesce({_LASTTAG}, []), lambda e: true) as g from w)"
_V = "(list_filter(g, lambda e: e.k = '{k}')[1]).v"
_RANK = "case " + _V.format(k="highway") + " " + " ".join(f"when '{k}' then {v}" for k, v in geometry.HIGHWAY_RANK.items() if v > 1) + " else 0 end"


@query(f"with {_W}, {_T} select id, {_RANK} + 10 * coalesce(case when regexp_full_match({_V.format(k='layer')}, '[+-]?[0-9]+') then try_cast({_V.format(k='layer')} as bigint) end, 0) as z from t")
def z_order(spark, d):
    return _tagged(ways(spark, d)).select("id", geometry.z_order(F.col("tags")).alias("z"))


@query(f"with {_N}, {_W}, x as (select id, generate_subscripts(refs, 1) as p, unnest(refs) as node from w), y as (select x.id, count(*) as c, list(n.lon order by p) as lons, list(n.lat order by p) as lats from x join n on n.id = node group by x.id) select y.id, lons, lats from y join w on w.id = y.id where c = len(refs)")
def way_coords(spark, d):
    rows = geometry.way_coordinates(ways(spark, d), nodes(spark, d))
    return rows.select("id", F.transform("coords", lambda p: p["lon"]).alias("lons"), F.transform("coords", lambda p: p["lat"]).alias("lats"))


_ANYRANK = "case hw " + " ".join(f"when '{k}' then {v}" for k, v in geometry.HIGHWAY_RANK.items()) + " end"
_HW = "list_filter(tags, lambda e: e.k = 'highway')"


@query(f"""with {_N}, {_W}, g as (select id, tags from (select *, row_number() over (partition by id order by vs desc, ts desc) as k from full_nodes) where k = 1),
 h as (select n.id from n join g on g.id = n.id where len({_HW}) > 0), x as (select {_HW}[-1].v as hw, unnest(refs) as node from w where len({_HW}) > 0),
 c as (select node, hw, count(*) as n from x where node is not null group by all), r as (select *, {_ANYRANK} as rank from c join h on h.id = c.node)
 select id, arg_min(hw, (-coalesce(rank, 0), case when hw like '%link' then 1 else 0 end, case when rank is null then -n else 0 end, hw)) as parent_highway from r group by id""")
def parent_highway(spark, d):
    return geometry.node_parent_highways(_nodes_with_tags(spark, d), _tagged(ways(spark, d)))


@query(f"with {_R}, {_M}, v as (select id, list_filter(tags, lambda e: e.k = 'maxspeed')[-1].v as s from r where len(list_filter(tags, lambda e: e.k = 'maxspeed')) >= 1) select mem_ref as way, string_agg(distinct s, ';' order by s) as routes from m join v on v.id = relation_id where mem_type = 1 and mem_ref is not null group by mem_ref having string_agg(distinct s, ';' order by s) is not null")
def route_list(spark, d):
    found = geometry.relation_value_range(_tagged(relations(spark, d)), members(spark, d), F.lit(True), "maxspeed")
    return found.select("way", F.array_join("values", ";").alias("routes")).where(F.size("values") > 0)


_SIX = "(case when {c} < 0 then '-' else '' end || (abs({c}) + 5) // 10000000 || '.' || lpad((((abs({c}) + 5) // 10) % 1000000)::varchar, 6, '0'))"


@query(f"with {_N} select id, 'POINT(' || {_SIX.format(c='lon')} || ' ' || {_SIX.format(c='lat')} || ')' as wkt from n")
def wkt_point(spark, d):
    return nodes(spark, d).select("id", geometry.wkt_point(F.col("lon"), F.col("lat")).alias("wkt"))


@query()
def geometries(spark, d):
    style = style_from_table(table(spark, d, "style_entries"))
    rel = _tagged(relations(spark, d))
    out = geometry.generate(_nodes_with_tags(spark, d), _tagged(ways(spark, d)), rel, members(spark, d), style)
    return out.select("orig_kind", "id", "geom_type", "z_order", "way_area", "qt", geojson.geometry_json(F.col("geom_type"), F.col("coords"), F.col("polygons")).alias("geojson"))


@query(f"with {_N} select id from n where lon between -100000000 and 400000000 and lat between 350000000 and 600000000 order by id")
def store_scan_bbox(spark, d):
    n = nodes(spark, d).join(table(spark, d, "full_nodes", "id", "qt").groupBy("id").agg(F.max("qt").alias("qt")), "id")
    # Tiles of the tables are the reference grid's; the store's come from the positions themselves.
    spot = qt.calculate(F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat") + 1, 0.05, 18)
    geoms = n.select(F.lit(0).alias("orig_kind"), "id", F.lit(1).cast("tinyint").alias("geom_type"), F.create_map().cast("map<string,string>").alias("tags"), F.array(F.struct(F.col("id").alias("ref"), "lon", "lat")).alias("coords"), F.lit(None).cast("array<array<array<struct<ref:bigint,lon:bigint,lat:bigint>>>>").alias("polygons"), F.lit(0).cast("bigint").alias("z_order"), F.lit(0.0).alias("way_area"), spot.alias("qt"))
    path = fresh_path(spark, "store")
    store.add_features(geoms, path, level=3)
    return store.scan_box(store.open_store(spark, path), (-100_000_000, 350_000_000, 400_000_000, 600_000_000), "point", []).select(F.col("osm_id").alias("id"))


@query("with e as (select object_type::integer as kind, id, file_idx, max_by(case when change_type = 1 then -1 else 1000 + file_idx end, seq) as tile from osc_changes group by all) select kind, id, case when max_by(tile, file_idx) = -1 then -1 else max(file_idx) end as file_idx, max_by(tile, file_idx)::bigint as tile from e group by kind, id")
def loc_lookup(spark, d):
    feed = _feed(spark, d).groupBy("kind", "id", "file_idx").agg(F.max_by("change", "seq").alias("change"))
    rows = feed.select("kind", "id", F.when(F.col("change") == 1, 1).otherwise(4).alias("change"), (F.col("file_idx") + 1000).cast("bigint").alias("tile"), "file_idx")
    index = rows.select(update.packed_id(F.col("kind"), F.col("id")).alias("packed"), F.when(F.col("change") == 1, -1).otherwise(F.col("tile")).cast("bigint").alias("tile"), "file_idx")
    return update.find_tiles(index, rows.select("kind", "id"))


@query(f"with {_N}, b as (select id, lon >= -200000000 and lon <= 500000000 and lat >= 0 and lat <= 600000000 as hit, lon - 10 <= 0 and lon + 10 >= 0 as near from n) select * from b")
def bbox_predicates(spark, d):
    area = boxes.box(-200_000_000, 0, 500_000_000, 600_000_000)
    lon, lat = F.col("lon"), F.col("lat")
    strip = boxes.box(0, -900_000_000, 0, 900_000_000)
    return nodes(spark, d).select("id", boxes.contains_xy(area, lon, lat).alias("hit"), boxes.intersects(boxes.expand(boxes.box(lon, lat, lon, lat), 10), strip).alias("near"))


@query()
def update_rows(spark, d):
    cast = lambda k, df: df.select(F.lit(k).cast("tinyint").alias("kind"), "id", *[(F.col(c) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in (("lon", "bigint"), ("lat", "bigint"), ("refs", "array<bigint>"), ("members", "array<struct<type:tinyint,ref:bigint,role:string>>"), ("qt", "bigint"))])
    n = nodes(spark, d).join(table(spark, d, "full_nodes", "id", "qt").groupBy("id").agg(F.max("qt").alias("qt")), "id")
    base = cast(0, n).unionByName(cast(1, ways(spark, d))).unionByName(cast(2, relations(spark, d)))
    tile_list = table(spark, d, "full_ways", "qt").where("qt >= 0").select(qt.round_to(F.col("qt"), 6).alias("qt")).distinct()
    tile_list = tile_list.union(spark.range(1).select(F.col("id").alias("qt"))).distinct()
    base = tiles.assign_tiles(base, tile_list).withColumn("tile", F.coalesce("tile", F.lit(0)).cast("bigint"))
    c = table(spark, d, "osc_changes")
    zipped = F.transform(F.arrays_zip("mem_types", "refs", "mem_roles"), lambda m: F.struct(m["mem_types"].alias("type"), m["refs"].alias("ref"), m["mem_roles"].alias("role")))
    feed = c.select(F.col("object_type").alias("kind"), "id", "lon", "lat", F.when(F.col("object_type") == 1, F.col("refs")).alias("refs"), F.when(F.col("object_type") == 2, zipped).alias("members"), F.col("change_type").alias("change"), "seq")
    return update.calc_update(feed, base, tile_list)[0]
