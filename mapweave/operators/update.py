"""Turning a change file into an update of the tiles, and the index of which element lies in which tile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions import quadtree as qt
from mapweave.operators import changes as ch
from mapweave.operators import tiles
from mapweave.session import written

GONE = -1


def packed_id(kind, id_):
    """One number per element: the kind above bit 59, the id below."""
    return F.shiftleft(kind.cast("bigint"), 59).bitwiseOR(id_)


def _location_rows(elements: DataFrame, *more: str) -> DataFrame:
    """``packed, tile``: a deleted element is gone; one that only left a tile (Remove) says nothing, its new tile having a row of its own."""
    rows, tile = elements, F.col("tile")
    if "change" in elements.columns:
        rows = rows.where(F.col("change") != ch.REMOVE)
        tile = F.when(F.col("change") == ch.DELETE, GONE).otherwise(tile).cast("bigint")
    return rows.select(packed_id(F.col("kind"), F.col("id")).alias("packed"), tile.alias("tile"), *more)


def append_locations(index_path: str, elements: DataFrame, file_idx: int) -> None:
    """Adds the tiles of a file's elements (``kind, id, tile`` and, in change files, ``change``) to the index."""
    _location_rows(elements).repartitionByRange("packed").sortWithinPartitions("packed").write.mode("overwrite").parquet(f"{index_path}/file_idx={file_idx}")


def append_location_files(index_path: str, elements: DataFrame) -> None:
    """As ``append_locations`` for many files in one pass; their numbers are in ``file_idx``."""
    rows = _location_rows(elements, "file_idx").repartitionByRange("file_idx", "packed").sortWithinPartitions("file_idx", "packed")
    rows.write.mode("append").partitionBy("file_idx").parquet(index_path)


def read_locations(spark: SparkSession, index_path: str) -> DataFrame:
    return spark.read.schema("packed bigint, tile bigint, file_idx int").parquet(index_path)


def find_tiles(index: DataFrame, ids: DataFrame) -> DataFrame:
    """``kind, id, file_idx, tile`` of wanted (kind, id): where the last file that has it puts it; (-1, -1) once deleted.

    Ids the index does not know have no row.
    """
    want = ids.select("kind", "id", packed_id(F.col("kind"), F.col("id")).alias("packed")).distinct()
    last = index.join(want.select("packed"), "packed", "left_semi").groupBy("packed").agg(F.max(F.struct("file_idx", "tile")).alias("l"))
    gone = F.col("l.tile") == GONE
    return want.join(last, "packed").select("kind", "id", F.when(gone, GONE).otherwise(F.col("l.file_idx")).cast("int").alias("file_idx"), F.col("l.tile").alias("tile"))


def calc_update(changes: DataFrame, base: DataFrame, tile_list: DataFrame, include_unchanged: bool = False) -> tuple[DataFrame, DataFrame]:
    """The update that a change file makes to the tiles. Returns (rows, report).

    Both inputs have ``kind, id, lon, lat, refs, members`` (structs type, ref, role); ``changes`` also ``change, seq``,
    ``base`` also ``qt, tile``; ``tile_list`` has the tiles in ``qt``. Rows: ``tile, kind, id, change, qt``. Of the
    changes to an element the last in the file counts.

    A changed way's tile comes from its nodes' positions, new over old; a node that is nowhere counts as (0, 0), which
    the report counts (``missing_nodes``). A node's is the common one of its changed ways and the tile it had before,
    or that of its position if it has neither. A relation's is the common one of all members, nested ones included.
    An element that leaves a tile gets a Remove there and its row in the new one; a deleted one a Delete where it was.
    Nodes of changed ways that did not change themselves come out as Unchanged if their quadtree did, or always with
    ``include_unchanged``.
    """
    new = written(ch.last_in_file(changes.select("kind", "id", "lon", "lat", "refs", "members", "change", "seq")), "changes")
    live = new.where(~F.col("change").isin(ch.DELETE, ch.REMOVE))
    way_refs = live.where("kind = 1").select("id", F.explode("refs").alias("node")).where("node is not null").distinct()
    members = live.where("kind = 2").select(F.col("id").alias("relation_id"), F.explode("members").alias("m")).select("relation_id", F.col("m.type").alias("mem_type"), F.col("m.ref").alias("mem_ref"))
    needed = new.select("kind", "id").unionByName(way_refs.select(F.lit(0).cast("tinyint").alias("kind"), F.col("node").alias("id")))
    needed = needed.unionByName(members.select(F.col("mem_type").cast("tinyint").alias("kind"), F.col("mem_ref").alias("id"))).distinct()
    old = written(base.select("kind", "id", "lon", "lat", "qt", "tile").join(needed, ["kind", "id"], "left_semi"), "old")

    spots = live.where("kind = 0").select("id", "lon", "lat", F.lit(1).alias("own"))
    spots = spots.unionByName(old.where("kind = 0").join(spots.select("id"), "id", "left_anti").select("id", "lon", "lat", F.lit(0).alias("own")))
    at = way_refs.join(spots.select(F.col("id").alias("node"), "lon", "lat"), "node", "left")
    placed = at.select("id", F.coalesce("lon", F.lit(0)).alias("lon"), F.coalesce("lat", F.lit(0)).alias("lat"))
    boxes = placed.groupBy(F.col("id").alias("way")).agg(F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"))
    way_qt = written(tiles.way_tiles(boxes).select("way", F.greatest("qt", F.lit(0)).alias("qt")), "way_qt")

    from_ways = way_refs.join(way_qt.withColumnRenamed("way", "id"), "id").groupBy("node").agg(qt.common_agg(F.col("qt")).alias("w"))
    prior = old.where("kind = 0").select(F.col("id").alias("node"), F.col("qt").alias("p"))
    none = F.lit(-1).cast("bigint")
    own = qt.calculate(F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat") + 1, tiles.WAY_BUFFER, tiles.NODE_LEVEL)
    node_qt = spots.select(F.col("id").alias("node"), "lon", "lat").join(from_ways, "node", "left").join(prior, "node", "left")
    common = qt.common(F.coalesce("w", none), F.coalesce("p", none))
    node_qt = node_qt.select("node", F.when(common == -1, own).otherwise(common).alias("qt"))

    others = old.where("kind = 2").join(live.where("kind = 2").select("id"), "id", "left_anti")
    old_ways = old.where("kind = 1").join(way_qt.select(F.col("way").alias("id")), "id", "left_anti").select(F.col("id").alias("way"), "qt")
    # Member relations that did not change stand for themselves, as members with a known tile.
    fixed = others.select(F.col("id").alias("relation"), "qt")
    rel_qt = tiles.relation_tiles(live.where("kind = 2").select("id"), members, node_qt, way_qt.unionByName(old_ways), fixed).withColumnRenamed("relation", "id")

    kind = lambda k, df, c: df.select(F.lit(k).cast("tinyint").alias("kind"), F.col(c).alias("id"), F.col("qt").alias("new_qt"))
    now = kind(0, node_qt, "node").unionByName(kind(1, way_qt, "way")).unionByName(kind(2, rel_qt, "id"))
    now = tiles.assign_tiles(now.withColumnRenamed("new_qt", "qt"), tile_list).select("kind", "id", F.col("qt").alias("new_qt"), F.coalesce("tile", F.lit(0)).cast("bigint").alias("new_tile"))
    touched = new.select("kind", "id", "change").unionByName(way_refs.select(F.lit(0).cast("tinyint").alias("kind"), F.col("node").alias("id"), F.lit(ch.UNCHANGED).cast("tinyint").alias("change")).distinct())
    touched = touched.groupBy("kind", "id").agg(F.min_by("change", F.when(F.col("change") == ch.UNCHANGED, 1).otherwise(0)).alias("change"))
    state = touched.join(now, ["kind", "id"], "left").join(old.select("kind", "id", F.col("qt").alias("old_qt"), F.col("tile").alias("old_tile")), ["kind", "id"], "left")
    row = lambda tile, change, q: F.struct(tile.alias("tile"), change.cast("tinyint").alias("change"), q.alias("qt"))
    gone = F.col("change").isin(ch.DELETE, ch.REMOVE)
    quiet = (F.col("change") == ch.UNCHANGED) & (F.col("new_qt").isNull() | (F.col("new_qt").eqNullSafe(F.col("old_qt")) & F.lit(not include_unchanged)))
    leave = F.col("old_tile").isNotNull() & ~F.col("old_tile").eqNullSafe(F.col("new_tile"))
    removed = F.when(leave, F.array(row(F.col("old_tile"), F.lit(ch.REMOVE), F.col("old_qt"))))
    out = F.when(gone, F.when(F.col("old_tile").isNotNull(), F.array(row(F.col("old_tile"), F.lit(ch.DELETE), F.col("old_qt"))))).when(quiet, None).otherwise(
        F.concat(F.array(row(F.coalesce("new_tile", F.lit(0)).cast("bigint"), F.col("change"), F.coalesce("new_qt", F.lit(0)).cast("bigint"))), F.coalesce(removed, F.array().cast("array<struct<tile:bigint,change:tinyint,qt:bigint>>")))
    )
    rows = state.select("kind", "id", F.explode(out).alias("r")).select("r.tile", "kind", "id", "r.change", "r.qt")
    report = at.agg(F.count_if(F.col("lon").isNull()).alias("missing_nodes"))
    return rows, report
