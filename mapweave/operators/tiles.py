"""Quadtrees for all elements, tile counts, tile choice, and putting elements into tiles and blocks."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions import quadtree as qt
from mapweave.session import fresh_path, remove, written

NODE_LEVEL, WAY_BUFFER = 18, 0.05


def way_nodes(ways: DataFrame) -> DataFrame:
    """``way, pos, node`` of every non-null ref, places from 0. ``ways``: id, refs."""
    return ways.select(F.col("id").alias("way"), F.posexplode("refs").alias("pos", "node")).where("node is not null")


def way_boxes(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """``way, minx, miny, maxx, maxy`` over the way's known nodes; ways without any have no row."""
    at = nodes.select(F.col("id").alias("node"), "lon", "lat")
    met = way_nodes(ways).select("way", "node").distinct().join(at, "node")
    return met.groupBy("way").agg(F.min("lon").alias("minx"), F.min("lat").alias("miny"), F.max("lon").alias("maxx"), F.max("lat").alias("maxy"))


def way_tiles(boxes: DataFrame, buffer: float = WAY_BUFFER, level: int = NODE_LEVEL) -> DataFrame:
    """``way, qt``: the deepest tile that holds the way's box, give or take ``buffer`` of its size."""
    return boxes.select("way", qt.calculate(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), buffer, level).alias("qt"))


def node_tiles(nodes: DataFrame, ways: DataFrame, tiles: DataFrame, level: int = NODE_LEVEL) -> DataFrame:
    """``node, qt``: the common tile of the node's ways or, without ways, the tile of its position.

    A node may be in very many ways: tiles are combined before they move.
    """
    used = way_nodes(ways).select("way", "node").distinct().join(tiles, "way").groupBy("node").agg(qt.common_agg(F.col("qt")).alias("common"))
    own = qt.calculate(F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat") + 1, WAY_BUFFER, level)
    return nodes.select(F.col("id").alias("node"), "lon", "lat").join(used, "node", "left").select("node", F.coalesce("common", own).alias("qt"))


def relation_tiles(relations: DataFrame, members: DataFrame, nodes: DataFrame, ways: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """``relation, qt``: the common tile of all members, members of member relations included.

    ``relations``: id; ``members``: relation_id, mem_type, mem_ref; ``nodes``: node, qt; ``ways``: way, qt;
    ``fixed``: relation, qt of member relations that are not among ``relations`` and stand as placed members. A relation
    without placed members gets the root, 0. Member relations pass their tiles up until nothing changes: a common tile
    only moves towards the root, so that settles, loops included; there is no cap on the rounds, which are as many as the nesting asks for.
    """
    direct = members.where("mem_type = 0").join(nodes.select(F.col("node").alias("mem_ref"), "qt"), "mem_ref").select("relation_id", "qt")
    direct = direct.unionByName(members.where("mem_type = 1").join(ways.select(F.col("way").alias("mem_ref"), "qt"), "mem_ref").select("relation_id", "qt"))
    if fixed is not None:
        direct = direct.unionByName(members.where("mem_type = 2").join(fixed.select(F.col("relation").alias("mem_ref"), "qt"), "mem_ref").select("relation_id", "qt"))
    base = direct.groupBy("relation_id").agg(qt.common_agg(F.col("qt")).alias("qt"))
    state = relations.select(F.col("id").alias("relation_id")).join(base, "relation_id", "left").select("relation_id", F.coalesce("qt", F.lit(-1)).cast("bigint").alias("qt"))
    links = members.where("mem_type = 2 and mem_ref is not null and relation_id <> mem_ref").select("relation_id", "mem_ref").distinct()
    links = written(links, "links")
    spark, path = relations.sparkSession, fresh_path(relations.sparkSession, "tiles")
    state = written(state, "tiles", path)
    changed = links.take(1)
    while changed:
        passed = links.join(state.select(F.col("relation_id").alias("mem_ref"), F.col("qt").alias("up")), "mem_ref").groupBy("relation_id").agg(qt.common_agg(F.col("up")).alias("up"))
        new = state.join(passed, "relation_id", "left").select("relation_id", qt.common(F.col("qt"), F.coalesce("up", F.lit(-1)).cast("bigint")).alias("new"), "qt")
        old, path = path, fresh_path(spark, "tiles")
        both = written(new, "tiles", path)
        state = both.select("relation_id", F.col("new").alias("qt"))
        changed = both.where("new <> qt").take(1)
        remove(spark, old)
    return state.select(F.col("relation_id").alias("relation"), F.greatest(F.col("qt"), F.lit(0)).alias("qt"))


def element_tiles(nodes: DataFrame, ways: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """``kind, id, qt`` of every element. ``nodes``: id, lon, lat; the others as above. Node id 0 is left out."""
    boxes = way_boxes(ways, nodes)
    tiles = written(way_tiles(boxes), "way_tiles")
    spots = written(node_tiles(nodes.where("id <> 0"), ways, tiles), "node_tiles")
    rels = relation_tiles(relations, members, spots, tiles)
    kind = lambda k, df, c: df.select(F.lit(k).cast("tinyint").alias("kind"), F.col(c).alias("id"), "qt")
    return kind(0, spots, "node").unionByName(kind(1, tiles, "way")).unionByName(kind(2, rels, "relation"))


def tile_counts(elements: DataFrame, level: int) -> DataFrame:
    """``qt, n`` of elements per tile, deeper tiles rounded to ``level``; elements without a tile are left out."""
    return elements.where("qt >= 0").groupBy(qt.round_to(F.col("qt"), level).alias("qt")).agg(F.count(F.lit(1)).alias("n"))


def tile_totals(counts: DataFrame) -> DataFrame:
    """``qt, n, total``: own count and that of the whole subtree, for every tile that counts or has a counting one below it.

    Each counted tile adds to its ancestors, at most 29 rows; the root's sum is combined before it moves.
    """
    up = counts.select("qt", "n", F.explode(qt.ancestors(F.col("qt"))).alias("tile"))
    own = F.sum(F.when(F.col("tile") == F.col("qt"), F.col("n")).otherwise(0))
    return up.groupBy(F.col("tile").alias("qt_")).agg(own.alias("n"), F.sum("n").alias("total")).select(F.col("qt_").alias("qt"), "n", "total")


def _parent(q: int) -> int:
    z = (q & 31) - 1
    return ((q >> (63 - 2 * z)) << (63 - 2 * z)) + z if z else 0


def choose_tiles(counts: dict[int, int], target: int, least: int, slack: int = 50, widest: int = 1_000_000, rest: int = 1000) -> dict[int, int]:
    """Tiles that split the counted ones into groups of about ``target`` elements: tile -> elements.

    The tree of tiles is walked from the root in passes. A tile whose subtree has fewer elements left than the lower
    bound is passed over with all below it. Otherwise it is taken if it counts elements of its own and either has no
    more than the upper bound, or nothing is left below it, or no child has more than ``least``; if it is not taken,
    its children are looked at. What is taken is taken off its ancestors. When a pass takes nothing, the bounds, at
    first ``slack`` to both sides of the target, move apart by ``slack``, the lower one not below ``least``. All ends
    when the root is taken, at most ``rest`` elements remain, or the upper bound passes ``widest``; what remains then
    goes to the root. The groups' sum always equals that of the counts.
    """
    own, total = defaultdict(int), defaultdict(int)
    for tile, n in counts.items():
        own[tile] += n
        total[tile] += n
        while tile & 31:
            tile = _parent(tile)
            total[tile] += n
    return _walk(own, total, target, least, slack, widest, rest)


def _walk(own: dict[int, int], total: dict[int, int], target: int, least: int, slack: int = 50, widest: int = 1_000_000, rest: int = 1000) -> dict[int, int]:
    """``choose_tiles`` from own and subtree counts. Tiles whose subtree has fewer than ``least`` may be missing: they are never taken."""
    own, total, kids = defaultdict(int, own), defaultdict(int, total), defaultdict(set)
    for tile in total:
        if tile & 31:
            kids[_parent(tile)].add(tile)
    groups: dict[int, int] = {}
    low, high = max(least, target - slack), target + slack
    while total[0] > rest and 0 not in groups and high <= widest:
        before, todo = len(groups), [0]
        while todo:
            tile = todo.pop()
            n = total[tile]
            if n < low or n <= 0:
                continue
            if not own[tile] or not (n == own[tile] or n <= high or all(total[k] <= least for k in kids[tile])):
                todo += sorted(kids[tile], reverse=True)
                continue
            groups[tile] = groups.get(tile, 0) + n
            if not tile & 31:
                total[0] = 0
                break
            up = tile
            kids[_parent(tile)].discard(tile)
            while up & 31:
                up = _parent(up)
                total[up] -= n
        if len(groups) == before:
            low, high = max(least, low - slack), high + slack
    if total[0] > 0:
        groups[0] = groups.get(0, 0) + total[0]
    return groups


def tile_groups(elements: DataFrame, target: int, least: int, level: int = 17) -> DataFrame:
    """``qt, n``: the tiles chosen for the elements; see ``choose_tiles``.

    Subtrees are summed up before anything comes to the driver, and only tiles with at least ``least`` elements in or
    below them do: the others are never taken. These are at most ``level`` + 1 for every ``least`` elements, two numbers
    each, so their number is set by the size of the groups asked for.
    """
    rows = tile_totals(tile_counts(elements, level)).where((F.col("total") >= least) | (F.col("qt") == 0)).collect()
    groups = _walk({r["qt"]: r["n"] for r in rows}, {r["qt"]: r["total"] for r in rows}, target, least)
    return elements.sparkSession.createDataFrame([(int(q), int(n)) for q, n in groups.items()], "qt bigint, n bigint")


def assign_tiles(elements: DataFrame, tiles: DataFrame) -> DataFrame:
    """The elements with ``tile``: the deepest of ``tiles`` (column qt) that holds the element's ``qt``; null where none does.

    Distinct element tiles are matched, not elements, by equality on their ancestors; then joined back.
    """
    own = elements.select("qt").distinct()
    up = own.select("qt", F.explode(qt.ancestors(F.col("qt"))).alias("tile"))
    found = up.join(tiles.select(F.col("qt").alias("tile")).distinct(), "tile").groupBy("qt").agg(F.max_by("tile", qt.depth(F.col("tile"))).alias("tile"))
    return elements.join(found, "qt", "left")


def by_tile(elements: DataFrame) -> DataFrame:
    """Repartitioned by tile and sorted within it, ready to be written; a huge tile is spread over several tasks."""
    return elements.repartitionByRange("tile", "kind", "id").sortWithinPartitions("tile", "kind", "id")


def alloc_by_id(kind: Column, id_: Column) -> Column:
    """Number of the block of ids an element falls in: nodes by 2^14, ways by 2^11, the others by 2^9."""
    shift = F.when(kind == 0, F.shiftright(id_, 14)).when(kind == 1, F.shiftright(id_, 11)).otherwise(F.shiftright(id_, 9))
    return shift + F.shiftleft(kind.cast("bigint"), 32)


def by_id(elements: DataFrame) -> DataFrame:
    return elements.repartitionByRange("kind", "id").sortWithinPartitions("kind", "id")


def group_blocks(elements: DataFrame, size: int) -> DataFrame:
    """The elements with ``block``: blocks of exactly ``size`` in (kind, id) order, the last one shorter.

    Numbers come from counts per range partition and places within them, never from one window over all rows.
    """
    spark = elements.sparkSession
    placed = written(by_id(elements).withColumn("part__", F.spark_partition_id()), "ranges")
    sizes = {r["part__"]: r["n"] for r in placed.groupBy("part__").agg(F.count(F.lit(1)).alias("n")).collect()}
    start, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, start))
        start += sizes[part]
    starts = spark.createDataFrame(rows, "part__ int, start__ bigint")
    nth = F.row_number().over(Window.partitionBy("part__").orderBy("kind", "id"))
    out = placed.join(F.broadcast(starts), "part__").withColumn("block", F.floor((F.col("start__") + nth - 1) / size).cast("bigint"))
    return out.drop("part__", "start__")


def attach_tiles(elements: DataFrame, tiles: DataFrame) -> DataFrame:
    """Elements with the ``qt`` of their (kind, id); elements without one are left out, and so are tiles without an element."""
    return elements.drop("qt").join(tiles.select("kind", "id", "qt"), ["kind", "id"])


def tile_tree(tiles: DataFrame) -> DataFrame:
    """``qt, parent`` of the distinct tiles of a table: the deepest other of them that holds the tile, null for a root.

    Null tiles and -1 are left out. Matched by equality on ancestors, at most 28 rows a tile.
    """
    own = tiles.where("qt >= 0").select("qt").distinct()
    up = own.select("qt", F.explode(qt.ancestors(F.col("qt"))).alias("tile")).where("tile <> qt")
    found = up.join(own.select(F.col("qt").alias("tile")), "tile").groupBy("qt").agg(F.max_by("tile", qt.depth(F.col("tile"))).alias("parent"))
    return own.join(found, "qt", "left")


def write_quadtrees(elements: DataFrame, path: str, block: int = 8000) -> None:
    """Block files of ``kind, id, qt`` alone, in (kind, id) order, blocks of ``block`` elements; a file for every task.

    ``sources.datasource.register`` must have been called.
    """
    by_id(elements.select(F.col("kind").cast("tinyint").alias("kind"), "id", "qt")).write.format("mapblocks").option("parts", "true").option("blockSize", str(block)).mode("append").save(path)
