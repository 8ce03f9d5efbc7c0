"""The queries over the map tables and their operators, on small tables."""

import random

from pyspark.sql import functions as F

from mapweave.operators import extract, geometry, tiles, update
from mapweave.plans import map_queries

ELEMENT = "id bigint, vs bigint, ts bigint, visible boolean, qt bigint"
TAGS = "tags array<struct<k:string,v:string>>"
MEMBER = "relation_id bigint, pos int, mem_type int, mem_ref bigint, mem_role string"


def tables(spark, folder, **named):
    """Writes tables, given as (rows, schema), where queries read them; returns the folder."""
    for name, (rows, schema) in named.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_route_list_takes_the_last_of_repeated_keys(spark, tmp_path):
    rels = [(1, 1, 1, True, 0, [("maxspeed", "30"), ("maxspeed", "50")]), (2, 1, 1, True, 0, [("maxspeed", "20")]), (3, 1, 1, True, 0, [("maxspeed", "20"), ("maxspeed", None)]), (4, 1, 1, True, 0, None)]
    mem = [(1, 0, 1, 10, ""), (1, 1, 1, 11, ""), (2, 0, 1, 11, ""), (3, 0, 1, 12, ""), (4, 0, 1, 12, "")]
    d = tables(spark, tmp_path, full_relations=(rels, f"{ELEMENT}, {TAGS}"), rel_members=(mem, MEMBER))
    assert {(r["way"], r["routes"]) for r in map_queries.route_list(spark, d).collect()} == {(10, "50"), (11, "20;50")}


def test_route_list_of_one_kind(spark):
    bus = {"type": "route", "route": "bus"}
    rels = spark.createDataFrame([(1, bus | {"ref": "7"}), (2, bus | {"ref": "12"}), (3, {"type": "route", "route": "bicycle", "ref": "9"}), (4, bus)], "id bigint, tags map<string,string>")
    mem = spark.createDataFrame([(i, 0, 1, 10, "") for i in (1, 2, 3, 4)], MEMBER)
    assert [tuple(r) for r in geometry.route_list(rels, mem, "bus", "ref").collect()] == [(10, "12;7")]


def test_attach_qt_of_all_kinds(spark, tmp_path):
    rows = [(1, 1, 1, True, 64), (1, 2, 2, True, 96), (2, 1, 1, True, -1), (3, 1, 1, False, 64)]
    d = tables(spark, tmp_path, **{t: (rows, ELEMENT) for t in ("full_nodes", "full_ways", "full_relations")})
    assert sorted(tuple(r) for r in map_queries.attach_qt(spark, d).collect()) == [(k, 1, 2, 96) for k in (0, 1, 2)]


def chain(spark, depth):
    """Relation 1 holds 2, 2 holds 3 and so on; the last holds way 7."""
    return spark.createDataFrame([(k, 0, 2, k + 1, "") for k in range(1, depth)] + [(depth, 0, 1, 7, "")], MEMBER)


def test_relation_tiles_however_deeply_nested(spark):
    rels, ways = spark.range(1, 24), spark.createDataFrame([(7, 96)], "way bigint, qt bigint")
    got = tiles.relation_tiles(rels, chain(spark, 23), spark.createDataFrame([], "node bigint, qt bigint"), ways)
    assert {(r["relation"], r["qt"]) for r in got.collect()} == {(k, 96) for k in range(1, 24)}


def test_selected_ids_however_deeply_nested(spark):
    nodes = spark.createDataFrame([(5, 1, 1), (6, 99, 99)], "id bigint, lon bigint, lat bigint")
    got = extract.selected_ids(nodes, spark.createDataFrame([(7, [5, 6])], "id bigint, refs array<bigint>"), chain(spark, 23), extract.Area(box=(0, 0, 9, 9)))
    assert {tuple(r) for r in got.collect()} == {(0, 5), (0, 6), (1, 7)} | {(2, k) for k in range(1, 24)}


def test_update_takes_the_tiles_of_unchanged_member_relations(spark):
    both = "kind tinyint, id bigint, lon bigint, lat bigint, refs array<bigint>, members array<struct<type:tinyint,ref:bigint,role:string>>"
    q = (1 << 61) + 1
    base = spark.createDataFrame([(2, 9, None, None, None, [], q, 0)], f"{both}, qt bigint, tile bigint")
    rows = [(2, 1, None, None, None, [(2, 9, "")], 4, 1), (2, 2, None, None, None, [(2, 1, "")], 4, 2), (2, 3, None, None, None, [(2, 4, "")], 4, 3)]
    out, _ = update.calc_update(spark.createDataFrame(rows, f"{both}, change tinyint, seq bigint"), base, spark.createDataFrame([(0,), (q,)], "qt bigint"))
    assert {(r["id"], r["tile"], r["qt"]) for r in out.where("kind = 2").collect()} == {(1, q, q), (2, q, q), (3, 0, 0)}


def test_parent_highway_counts_very_frequent_values(spark):
    ways = spark.range(20_003).select(F.create_map(F.lit("highway"), F.when(F.col("id") <= 10_000, "aaa").otherwise("zzz")).alias("tags"), F.array(F.lit(1).cast("bigint")).alias("refs"))
    few = spark.createDataFrame([({"highway": v}, [i]) for i, v in ((2, "service"), (2, "trunk"), (2, "trunk_link"), (3, "odd"))], "tags map<string,string>, refs array<bigint>")
    nodes = spark.createDataFrame([(i, {"highway": "crossing"}) for i in (1, 2, 3)], "id bigint, tags map<string,string>")
    got = geometry.node_parent_highways(nodes, ways.unionByName(few))
    assert {r["id"]: r["parent_highway"] for r in got.collect()} == {1: "zzz", 2: "trunk", 3: "odd"}


def test_geometries_of_ways_with_more_refs_than_can_be_broadcast(spark, tmp_path):
    head, ways = f"{ELEMENT}, {TAGS}", [(w, 1, 1, True, 0, None, list(range(1, 101))) for w in range(400)]
    style = ([("highway", False, True, None, "", True)], "tag string, is_node boolean, is_way boolean, is_poly string, tag_type string, is_feature boolean")
    d = tables(spark, tmp_path, full_nodes=([(i, 1, 1, True, 0, None, i, i) for i in range(1, 101)], f"{head}, lon bigint, lat bigint"), full_ways=(ways, f"{head}, refs array<bigint>"), full_relations=([], head), rel_members=([], MEMBER), style_entries=style)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    try:
        got = map_queries.geometries(spark, d).groupBy("orig_kind", F.size(F.split("geojson", r"\],\[")).alias("points")).count().collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert [tuple(r) for r in got] == [(1, 100, 400)]


def test_tile_choice_does_not_need_small_subtrees(spark):
    rng = random.Random(6)
    counts = {}
    for _ in range(400):
        z = rng.randrange(1, 9)
        path = rng.choice([0, rng.getrandbits(2 * z), rng.getrandbits(4)]) & (4**z - 1)
        counts[(path << (63 - 2 * z)) + z] = rng.randrange(1, 60)
    rows = [(q,) for q, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "qt bigint")
    want = tiles.choose_tiles(counts, 300, 100)
    got = {r["qt"]: r["n"] for r in tiles.tile_groups(df, 300, 100).collect()}
    assert got == want and sum(got.values()) == len(rows) and len(got) > 5
    assert tiles.tile_groups(df.limit(0), 300, 100).count() == 0
