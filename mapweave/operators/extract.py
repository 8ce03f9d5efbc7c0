"""Cutting an area out of the elements, by box or polygons."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions import boxes
from mapweave.operators.proximity import crossings_odd
from mapweave.session import fresh_path, remove, written


@dataclass(frozen=True)
class Area:
    """A box, or outer rings and holes, in 1e-7 degree. A point is inside if an outer ring holds it and no hole does."""

    box: tuple[int, int, int, int] | None = None
    rings: list[list[tuple[int, int]]] = field(default_factory=list)
    holes: list[list[tuple[int, int]]] = field(default_factory=list)

    def bounds(self) -> tuple[int, int, int, int]:
        if self.box:
            return self.box
        xs, ys = [x for r in self.rings for x, _ in r], [y for r in self.rings for _, y in r]
        return min(xs), min(ys), max(xs), max(ys)

    def holds(self, lon: Column, lat: Column) -> Column:
        x0, y0, x1, y1 = self.bounds()
        within = lon.between(x0, x1) & lat.between(y0, y1)
        if self.box:
            return within

        def ring(points):
            verts = F.array(*[F.struct(F.lit(x).cast("bigint").alias("lon"), F.lit(y).cast("bigint").alias("lat")) for x, y in points])
            return crossings_odd(lon, lat, verts)

        inside, out = F.lit(False), F.lit(False)
        for r in self.rings:
            inside = inside | ring(r)
        for h in self.holes:
            out = out | ring(h)
        return within & inside & ~out

    def may_hold_tile(self, tile: Column) -> Column:
        """Whether a tile's bounds meet the area's box: put before the exact test, it prunes files by tile."""
        from mapweave.functions.quadtree import bounds

        return boxes.intersects(bounds(tile), boxes.box(*self.bounds()))


def area_from_text(text: str) -> Area:
    return Area(box=boxes.parse_box(text))


def selected_ids(nodes: DataFrame, ways: DataFrame, members: DataFrame, area: Area) -> DataFrame:
    """``kind, id`` of what belongs to the area.

    Nodes inside it; ways with at least one node inside; all other nodes of those ways, null refs left out; relations
    with a node inside, a selected way or a selected relation as member, however deeply nested. Nodes that only complete
    a way do not pull in relations. ``nodes``: id, lon, lat; ``ways``: id, refs; ``members``: relation_id, mem_type,
    mem_ref.
    """
    spark = nodes.sparkSession
    inside = written(nodes.where(area.holds(F.col("lon"), F.col("lat"))).select("id").distinct(), "inside")
    refs = ways.select("id", F.explode("refs").alias("node")).where("node is not null")
    hit = written(refs.join(inside.select(F.col("id").alias("node")), "node", "left_semi").select("id").distinct(), "ways")
    others = refs.join(hit, "id", "left_semi").select(F.col("node").alias("id"))
    picked = inside.select(F.lit(0).alias("kind"), "id").unionByName(hit.select(F.lit(1).alias("kind"), "id"))
    keyed = members.where("mem_ref is not null").select("relation_id", F.col("mem_type").cast("int").alias("kind"), F.col("mem_ref").alias("id"))
    path = fresh_path(spark, "relations")
    rels = written(keyed.join(picked, ["kind", "id"], "left_semi").select(F.col("relation_id").alias("id")).distinct(), "relations", path)
    nested = keyed.where("kind = 2").select("relation_id", "id").distinct()
    before, n = 0, rels.count()
    while n > before:
        old, path = path, fresh_path(spark, "relations")
        more = nested.join(rels, "id", "left_semi").select(F.col("relation_id").alias("id"))
        rels = written(rels.union(more).distinct(), "relations", path)
        remove(spark, old)
        before, n = n, rels.count()
    out = picked.unionByName(others.select(F.lit(0).alias("kind"), "id")).distinct()
    return out.unionByName(rels.select(F.lit(2).alias("kind"), "id"))


def union_ids(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def trimmed_members(members: DataFrame, ids: DataFrame) -> DataFrame:
    """Members of selected relations that are selected themselves; a relation left without members drops out."""
    heads = ids.where("kind = 2").select(F.col("id").alias("relation_id"))
    own = ids.select(F.col("kind").cast("int").alias("mem_type"), F.col("id").alias("mem_ref"))
    cast = members.withColumn("mem_type", F.col("mem_type").cast("int"))
    return cast.join(heads, "relation_id", "left_semi").join(own, ["mem_type", "mem_ref"], "left_semi").select(*members.columns)


def keep_selected(elements: DataFrame, ids: DataFrame) -> DataFrame:
    """The elements (``kind, id``) whose ids are selected; deleted and removed ones are skipped where ``change`` is there."""
    rows = elements.where("change not in (1, 2)") if "change" in elements.columns else elements
    return rows.join(ids.select(F.col("kind").cast(rows.schema["kind"].dataType).alias("kind"), "id"), ["kind", "id"], "left_semi")
