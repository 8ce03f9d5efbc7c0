"""The p queries of the core: each applies one operator, with production parameters, to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.operators import change_log, heavy_keys, hierarchy, multivalue, orphans, proximity
from mapweave.session import table, written


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qt_entries", "quadtree", "entry_id", "qt_count", "block_idx").where("quadtree >= 0")
    return heavy_keys.half_sum_entries(rows, "quadtree", "entry_id", "qt_count", "block_idx")


def p2_tile_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qt_entries", "quadtree", "qt_count").where("quadtree >= 0")
    out = heavy_keys.key_totals(rows, "quadtree", "qt_count")
    return out.withColumn("total", F.col("total").cast("bigint"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "osc_changes", "change_type", "object_type", "id", "vs", "ts", "seq", "file_idx")
    base = {k: table(spark, d, n, "id", "vs", "ts", "visible") for k, n in enumerate(("full_nodes", "full_ways", "full_relations"))}
    n = 6  # runs of the log: enough for one to be compacted from others before the rest is merged
    lo, hi = changes.agg(F.min("file_idx"), F.max("file_idx")).first()
    run = None if lo is None else F.floor((F.col("file_idx") - lo) * n / (hi - lo + 1)).cast("int")
    return change_log.apply_changes(changes, base, run, n)


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return written(proximity.node_positions(table(spark, d, "full_nodes", "id", "vs", "ts", "visible", "lon", "lat")), "positions")


def p4_near(spark: SparkSession, d: str, points: DataFrame | None = None) -> DataFrame:
    return proximity.pairs_within(_positions(spark, d) if points is None else points, 30.0)


def p4_inside(spark: SparkSession, d: str, points: DataFrame | None = None) -> DataFrame:
    return proximity.points_in_regions(_positions(spark, d) if points is None else points, table(spark, d, "loc_test_polygons", "region_id", "ring_label", "verts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    points = _positions(spark, d)
    near = p4_near(spark, d, points).select(F.lit("near").alias("match_kind"), "id_a", "id_b")
    inside = p4_inside(spark, d, points).select(F.lit("inside").alias("match_kind"), F.col("id").alias("id_a"), F.col("region_id").alias("id_b"))
    return near.unionByName(inside)


def _relation_links(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "rel_members", "relation_id", "mem_type", "mem_ref")
    return hierarchy.existing_relation_links(members, table(spark, d, "full_relations", "id", "vs", "ts", "visible"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.hierarchies(_relation_links(spark, d), "relation_id", "mem_ref")
    return out.select(F.col("node").alias("relation_id"), F.col("root").alias("root_id"), "n_above", F.col("path").alias("id_path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.descendant_pairs(_relation_links(spark, d), "relation_id", "mem_ref")
    return out.select(F.col("node").alias("relation_id"), F.col("descendant").alias("descendant_id"), "steps")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cols = ("id", "vs", "ts", "visible", "loaded_at")
    members = table(spark, d, "rel_members", "relation_id", "mem_type", "mem_ref")
    # One pass over each table; what comes of it is looked at from several sides.
    nodes = written(orphans.element_rows(0, table(spark, d, "full_nodes", *cols)).drop("ts", "loaded"), "nodes")
    ways = written(orphans.element_rows(1, table(spark, d, "full_ways", *cols, "refs"), {"refs": F.col("refs")}), "ways")
    rels = written(orphans.element_rows(2, table(spark, d, "full_relations", *cols)), "relations")
    state = ("kind", "id", "deleted", "first")
    states = nodes.select(*state).unionByName(ways.select(*state)).unionByName(rels.select(*state))
    return orphans.orphan_references(orphans.element_references(ways, rels, members), states)


def p6_per_month(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("src_table", "ym", "reason").agg(F.count(F.lit(1)).alias("n_refs"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    style = table(spark, d, "style_entries", "tag", "is_list").where("is_list")
    return multivalue.split_list_values(table(spark, d, "osc_changes", "seq", "tag_keys", "tag_vals"), "seq", "tag_keys", "tag_vals", style, "tag")


QUERIES = {f.__name__: f for f in (p2_found, p2_tile_totals, p3_found, p4_found, p4_near, p4_inside, p5_found, p5_descendants, p6_found, p6_per_month, p7_found)}
