"""Parent-child links to full hierarchies, by peeling, Euler tours and parallel list ranking.

Each child first keeps the link to its smallest parent. Peeling leaves off these links, in rounds that each peel twice
as many layers as the one before, leaves the nodes that lie on loops; the links between those are cut, so that trees are
left, some of them hanging on what was a loop. Every node of a tree gives two arcs, in and out; each arc knows the one
before it in the tour of its tree, so the tours are linked lists, and pointer jumping ranks all of them at once in as
many rounds as the longest list has binary digits. The places of a node's two arcs are its entry and exit: nodes entered
between them are its descendants, nodes that enclose them its ancestors, and the weights on the way give its depth.
Links to further parents are then laid over the trees: what they close into loops is told, and what they lead to gets
one more path each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.operators.current import current_rows
from mapweave.session import fresh_path, remove, written

_GROUP = 100_000  # children of one parent that are put in order by one task
_BLOCK = 50_000  # places of a tour that one group of the last step covers
_TOUR = "arc bigint, ptr bigint, done boolean, dist bigint, acc bigint, round int"
_LOOP = -(1 << 40)  # what depths start from in trees that hang on a loop


def clean_links(links: DataFrame, parent: str, child: str) -> DataFrame:
    """Distinct links ``p, c`` without nulls."""
    return links.select(F.col(parent).cast("bigint").alias("p"), F.col(child).cast("bigint").alias("c")).where("p is not null and c is not null").distinct()


def loop_nodes(links: DataFrame) -> DataFrame:
    """``node`` of every node on a loop of links ``p, c`` in which no child has two parents.

    Peels leaves: after round k a node is left only if it has a node 2**k links below and one 2**k links above it, and
    each row leads from a node to the one 2**k above. So round by round trees lose twice as many layers, and the rounds
    are as many as the height of the highest tree has binary digits. When a round peels nothing, the rows permute the
    nodes that are left: these are the loops.
    """
    spark = links.sparkSession
    state = written(links.select(F.col("c").alias("node"), F.col("p").alias("up")), "peeled", path := fresh_path(spark, "peeled"))
    n = state.count()
    while n:
        met = state.select(F.col("up").alias("node")).distinct()
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        old, path = path, fresh_path(spark, "peeled")
        state = written(state.join(met, "node", "left_semi").join(above, "up").select("node", F.col("up2").alias("up")), "peeled", path)
        remove(spark, old)
        before, n = n, state.count()
        if n == before:
            break
    return state.select("node")


def _arcs(links: DataFrame, loops: DataFrame) -> DataFrame:
    """``arc, prev, w`` of the trees: arc is 2 * node on the way in and 2 * node + 1 on the way out, w the change in depth.

    Prev is null where a tour begins. Trees that hang on a loop begin at a depth far below zero.
    """
    most = links.groupBy("p").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-most // _GROUP))
    kids = links.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(salts)))
    kids = kids.withColumn("sibling", F.lag("c").over(Window.partitionBy("p", "salt").orderBy("c")))
    last = kids.groupBy("p", "salt").agg(F.max("c").alias("last"))
    if salts > 1:
        last = last.withColumn("earlier", F.lag("last").over(Window.partitionBy("p").orderBy("salt")))
        kids = kids.join(last, ["p", "salt"]).withColumn("sibling", F.coalesce("sibling", "earlier"))
        last = last.groupBy("p").agg(F.max_by("last", "salt").alias("last"))
    one = F.lit(1).cast("bigint")
    enter = kids.select((F.col("c") * 2).alias("arc"), F.coalesce(F.col("sibling") * 2 + 1, F.col("p") * 2).alias("prev"), one.alias("w"))
    roots = links.select(F.col("p").alias("node")).distinct().join(links.select(F.col("c").alias("node")), "node", "left_anti")
    roots = roots.join(loops.withColumn("on_loop", F.lit(True)), "node", "left")
    begin = roots.select((F.col("node") * 2).alias("arc"), F.lit(None).cast("bigint").alias("prev"), F.when(F.col("on_loop"), _LOOP).otherwise(0).cast("bigint").alias("w"))
    every = links.select(F.col("c").alias("node")).unionByName(roots.select("node"))
    leave = every.join(last.select(F.col("p").alias("node"), "last"), "node", "left")
    leave = leave.select((F.col("node") * 2 + 1).alias("arc"), F.coalesce(F.col("last") * 2 + 1, F.col("node") * 2).alias("prev"), (-one).alias("w"))
    return enter.unionByName(begin).unionByName(leave)


def _ranked(arcs: DataFrame) -> DataFrame:
    """``arc, head, dist, depth`` of all arcs: the first arc of the list, arcs before it, sum of weights up to it.

    Each round doubles what a pointer skips. An arc whose pointer stands at the head is finished and stays in the table
    of its round; pointers of the others are all different, so no key is hot. Finished arcs that no pointer meets any
    more are not looked at again. A list of L arcs is ranked after log2(L) rounds.
    """
    spark, base = arcs.sparkSession, fresh_path(arcs.sparkSession, "tour")
    head = F.col("prev").isNull()
    first = arcs.select("arc", F.coalesce("prev", "arc").alias("ptr"), head.alias("done"), F.when(head, 0).otherwise(1).cast("bigint").alias("dist"), F.col("w").alias("acc"))
    first.write.parquet(f"{base}/round=0")
    # A table for each round, read together: rows of earlier rounds count where they were finished then.
    read = lambda rounds: spark.read.option("basePath", base).schema(_TOUR).parquet(*[f"{base}/round={k}" for k in rounds])
    k, seen, finished = 0, [], []
    left, look_n = read([0]).where(~F.col("done")).count(), read([0]).count()
    while True:
        finished.append(k)
        if not left:
            return read(finished).where("done").select("arc", F.col("ptr").alias("head"), "dist", F.col("acc").alias("depth"))
        other = read([*seen, k]).where(F.col("done") | (F.col("round") == k)).select(F.col("arc").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("done").alias("done2"), F.col("dist").alias("dist2"), F.col("acc").alias("acc2"))
        moved = read([k]).where(~F.col("done")).join(other, "ptr").select("arc", F.col("ptr2").alias("ptr"), F.col("done2").alias("done"), (F.col("dist") + F.col("dist2")).alias("dist"), (F.col("acc") + F.col("acc2")).alias("acc"))
        seen, k = [*seen, k], k + 1
        moved.write.parquet(f"{base}/round={k}")
        left = read([k]).where(~F.col("done")).count()
        if left * 4 < look_n:
            # Pointers only get longer: what none of them meets now, none will.
            met = read([k]).where(~F.col("done")).select(F.col("ptr").alias("arc"))
            kept = read(seen).where("done").drop("round").join(met, "arc", "left_semi")
            kept.write.parquet(f"{base}/round={-k}")
            seen, look_n = [-k], left


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths from rows sorted by (root, block, entry): the stack of open nodes is the path to the next one."""
    key, stack = None, []
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("root", "block", "entry", "leave", "node", "n_above", "open")]
        out: list[list] = [[], [], [], [], [], []]
        for root, block, entry, leave, node, above, is_open in zip(*cols):
            if key != (root, block):
                key, stack = (root, block), []
            while stack and stack[-1][0] < entry:
                stack.pop()
            path = f"{stack[-1][1]}/{node}" if stack else str(node)
            if is_open or leave > entry + 1:
                stack.append((leave, path))
            if not is_open:
                for a, v in zip(out, (node, root, above, entry, leave, path)):
                    a.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[i], pa.int64()) for i in range(5)] + [pa.array(out[5], pa.string())], names=["node", "root", "n_above", "entry", "leave", "path"])


def _trees(links: DataFrame, loops: DataFrame) -> DataFrame:
    """``node, root, n_above, entry, leave, path`` of every node of the trees; n_above is below zero on loops' trees."""
    ranked = _ranked(_arcs(links, loops))
    into = ranked.where(F.pmod("arc", F.lit(2)) == 0).select(F.shiftright("arc", 1).alias("node"), F.shiftright("head", 1).alias("root"), F.col("depth").alias("n_above"), F.col("dist").alias("entry"))
    out_of = ranked.where(F.pmod("arc", F.lit(2)) == 1).select(F.shiftright("arc", 1).alias("node"), F.col("dist").alias("leave"))
    nodes = written(into.join(out_of, "node"), "nodes")

    block = lambda c: F.floor(c / _BLOCK).cast("bigint")
    columns = ["root", "block", "entry", "leave", "node", "n_above"]
    own = nodes.withColumn("block", block(F.col("entry"))).select(*columns, F.lit(False).alias("open"))
    spans = nodes.where(block(F.col("leave")) > block(F.col("entry")))
    spans = spans.withColumn("block", F.explode(F.sequence(block(F.col("entry")) + 1, block(F.col("leave"))))).select(*columns, F.lit(True).alias("open"))
    placed = own.unionByName(spans).repartition("root", "block").sortWithinPartitions("root", "block", "entry")
    return placed.mapInArrow(_paths, "node bigint, root bigint, n_above bigint, entry bigint, leave bigint, path string")


def _with_further_parents(trees: DataFrame, looped: DataFrame, further: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trees' rows and the looped nodes, once links ``p, c`` to further parents are counted in.

    A further link leads on to those that start at or below its child. Links are peeled off from the top: those that
    stay lie on loops or below them, and so does all that hangs on their children. Each of the others gives what hangs
    on its child one more path for each path of its parent; as many rounds as there are further links on a path.
    """
    spark = trees.sparkSession
    trees = written(trees, "trees")
    ids = trees.select("node", F.posexplode(F.split("path", "/")).alias("at", "a")).select("node", "at", F.col("a").cast("bigint").alias("above"))
    further = written(further.join(looped.select(F.col("node").alias("c")), "c", "left_anti").withColumn("link", F.monotonically_increasing_id()), "further")
    on = written(ids.join(further.select(F.col("c").alias("above")).distinct(), "above", "left_semi"), "on")  # nodes at or below some link's child
    leads = further.select(F.col("p").alias("node"), F.col("link").alias("to")).join(on.select("node", F.col("above").alias("c")), "node").join(further.select("c", F.col("link").alias("of")), "c")
    leads = written(leads.select("of", "to").distinct(), "leads")
    bad = further.join(looped.select(F.col("node").alias("p")), "p", "left_semi").select("link")
    stay, path = None, fresh_path(spark, "stay")
    stay = written(further.select("link"), "stay", path)
    before, n = -1, stay.count()
    while n and n != before:
        held = leads.join(stay.select(F.col("link").alias("of")), "of", "left_semi").select(F.col("to").alias("link")).unionByName(bad).distinct()
        old, path = path, fresh_path(spark, "stay")
        stay = written(stay.join(held, "link", "left_semi"), "stay", path)
        remove(spark, old)
        before, n = n, stay.count()
    ends = further.join(stay, "link", "left_semi").select(F.col("c").alias("above"))
    more = on.join(ends, "above", "left_semi").select("node").distinct()
    looped = written(looped.unionByName(more).distinct(), "looped")
    rows = written(trees.join(looped, "node", "left_anti"), "rows")
    free = further.join(stay, "link", "left_anti").select("p", "c")
    below = on.select("node", F.col("above").alias("c"), F.col("at").alias("at")).join(rows.select("node", "entry", "leave", F.col("path").alias("own")), "node")
    parts, last = [rows], rows
    while last.take(1):
        start = last.select(F.col("node").alias("p"), "root", "path", "n_above").join(free, "p").select("c", "root", "path", "n_above")
        new = start.join(below, "c")
        tail = F.slice(F.split("own", "/"), F.col("at") + 1, F.size(F.split("own", "/")))
        new = new.select("node", "root", (F.col("n_above") + F.size(tail)).cast("bigint").alias("n_above"), "entry", "leave", F.concat_ws("/", F.col("path"), F.array_join(tail, "/")).alias("path"))
        last = written(new, "rows")
        parts.append(last)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, looped


def _hierarchies(links: DataFrame, parent: str, child: str) -> tuple[DataFrame, bool]:
    pairs = written(clean_links(links, parent, child), "links")
    kept = written(pairs.groupBy("c").agg(F.min("p").alias("p")).select("p", "c"), "kept")
    loops = loop_nodes(kept)
    trees = _trees(kept.join(loops.select(F.col("node").alias("c")), "c", "left_anti").select("p", "c"), loops)
    trees = written(trees, "trees")
    looped = trees.where("n_above < 0").select("node").unionByName(loops).distinct()
    rows = trees.where("n_above >= 0")
    further = pairs.join(kept, ["p", "c"], "left_anti")
    several = bool(further.take(1))
    if several:
        # A node all whose children hang on smaller parents is a tree of its own.
        alone = further.select(F.col("p").alias("node")).distinct().join(rows.select("node").unionByName(looped), "node", "left_anti")
        at = lambda n: F.lit(n).cast("bigint")
        rows = rows.unionByName(alone.select("node", F.col("node").alias("root"), at(0).alias("n_above"), at(0).alias("entry"), at(1).alias("leave"), F.col("node").cast("string").alias("path")))
        rows, looped = _with_further_parents(rows, looped, further)
    minus, none = F.lit(-1).cast("bigint"), F.lit(None).cast("bigint")
    out = rows.select("node", "root", "n_above", F.floor((F.col("leave") - F.col("entry") - 1) / 2).cast("bigint").alias("n_below"), "entry", "leave", "path")
    looped = looped.select("node", minus.alias("root"), minus.alias("n_above"), minus.alias("n_below"), none.alias("entry"), none.alias("leave"), F.lit("").alias("path"))
    return out.unionByName(looped), several


def hierarchies(links: DataFrame, parent: str, child: str) -> DataFrame:
    """``node, root, n_above, n_below, entry, leave, path`` of every node in any link, one row per path from a root to it.

    ``path`` has the ids from the root to the node, joined by ``/``; ``n_above`` is their number less one. A node in or
    below a loop has one row with root, n_above and n_below -1, an empty path and no interval. Where no child has
    several parents there is one row per node; a child of several parents, and all that hangs on it, has a row for each
    way down to it, so such rows can be many times the links. ``entry``, ``leave`` and ``n_below`` are those of the
    forest in which each child hangs on its smallest parent: descendants of a node there are those of its root entered
    between its two places. Repeated links count once, links with a null end not at all; a link to itself is a loop. No
    links give an empty result. Column names other than the two named do not matter; ids lie within plus or minus 2**62.

    Work: log2 of the greatest height rounds of peeling over what is not peeled yet; log2 of the longest tour rounds of
    one join over what is not ranked yet; one round for each further parent on a path. Each is written to the shared
    folder. Paths are made from blocks of tours, so neither a huge tree nor a huge family lies in one task; what a block
    needs of the tour before it are the nodes still open there, one row per level.
    """
    return _hierarchies(links, parent, child)[0]


def descendant_pairs(links: DataFrame, parent: str, child: str) -> DataFrame:
    """``node, descendant, steps`` for every node outside loops and each node below it, read off the paths.

    One row per node and level above it; the result is as large as that, but nothing is joined to make it. Where a
    child has several parents there is one row for each distinct number of steps.
    """
    rows, several = _hierarchies(links, parent, child)
    ids = rows.where("path <> ''").select(F.col("node").alias("descendant"), "n_above", F.posexplode(F.split("path", "/")).alias("level", "a"))
    pairs = ids.where(F.col("level") < F.col("n_above")).select(F.col("a").cast("bigint").alias("node"), "descendant", (F.col("n_above") - F.col("level")).cast("bigint").alias("steps"))
    return pairs.distinct() if several else pairs


def existing_relation_links(members: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct ``relation_id, mem_ref`` of relation members where both relations exist."""
    live = current_rows(relations).where(~F.col("deleted")).select("id")
    links = members.where((F.col("mem_type") == 2) & F.col("relation_id").isNotNull() & F.col("mem_ref").isNotNull()).select("relation_id", "mem_ref").distinct()
    links = links.join(live.withColumnRenamed("id", "relation_id"), "relation_id", "left_semi")
    return links.join(live.withColumnRenamed("id", "mem_ref"), "mem_ref", "left_semi").select("relation_id", "mem_ref")
