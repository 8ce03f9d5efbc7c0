"""Dated change sets over a base: merging, applying, pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NORMAL, DELETE, REMOVE, UNCHANGED, MODIFY, CREATE = range(6)
NAMES = {NORMAL: "", DELETE: "Delete", REMOVE: "Remove", UNCHANGED: "Unchanged", MODIFY: "Modify", CREATE: "Create"}


def change_name(change: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), change.cast("int"))


def _latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: that with the greatest order; combined before it moves."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row__"))
    return best.select(*keys, "row__.*").select(*df.columns)


def last_in_file(changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Of the changes of each (kind, id) the last in document order."""
    return _latest(changes, ["kind", "id"], [seq])


def merge_changes(changes: DataFrame) -> DataFrame:
    """Of several dated change sets the newest row per (kind, id): latest ``start_date``, then greatest ``file_idx``."""
    return _latest(changes, ["kind", "id"], ["start_date", "file_idx"])


def pair_elements(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer pairing by (kind, id): ``kind, id, left, right``, the absent side null."""
    a = left.select("kind", "id", F.struct(*left.columns).alias("left"))
    return a.join(right.select("kind", "id", F.struct(*right.columns).alias("right")), ["kind", "id"], "full_outer")


def apply_merged(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The base after one merged change set; both have ``kind, id, change`` and the same further columns.

    Modify, Create and Unchanged replace or add the row, as Normal; Delete and Remove take it away; a Normal row among
    the changes has no effect.
    """
    pairs = pair_elements(base, changes.where(F.col("change") != NORMAL))
    out = F.when(F.col("right.change") > REMOVE, F.col("right")).when(F.col("right").isNull(), F.col("left"))
    return pairs.select(out.alias("row__")).where("row__ is not null").select("row__.*").withColumn("change", F.lit(NORMAL).cast(base.schema["change"].dataType)).select(*base.columns)


def as_normal(elements: DataFrame) -> DataFrame:
    """A change set as plain elements: deletes and removes dropped, the rest Normal."""
    return elements.where(~F.col("change").isin(DELETE, REMOVE)).withColumn("change", F.lit(NORMAL).cast(elements.schema["change"].dataType))


def merge_by_tile(base: DataFrame, changes: DataFrame) -> DataFrame:
    """As ``apply_merged``, but an element is its (tile, kind, id): it may leave one tile and enter another."""
    keys = ["tile", "kind", "id"]
    newest = _latest(changes, keys, ["start_date", "file_idx"])
    a = base.select(*keys, F.struct(*base.columns).alias("left"))
    b = newest.where(F.col("change") != NORMAL).select(*keys, F.struct(*base.columns).alias("right"))
    pairs = a.join(b, keys, "full_outer")
    out = F.when(F.col("right.change") > REMOVE, F.col("right")).when(F.col("right").isNull(), F.col("left"))
    return pairs.select(out.alias("row__")).where("row__ is not null").select("row__.*").withColumn("change", F.lit(NORMAL).cast(base.schema["change"].dataType))


def single_file_blocks(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base and changes of a file in which the first block of a tile is the base and later ones are changes.

    ``elements`` have ``tile, block``; only distinct blocks are ranked, not elements.
    """
    blocks = elements.select("tile", "block").distinct()
    ranked = blocks.withColumn("nth__", F.row_number().over(Window.partitionBy("tile").orderBy("block")))
    joined = elements.join(ranked, ["tile", "block"])
    return joined.where("nth__ = 1").drop("nth__"), joined.where("nth__ > 1").drop("nth__")


def aligned(files: list[DataFrame]) -> DataFrame:
    """Rows of several files with the number of their file, in tile order and, within a tile, file order."""
    out = None
    for i, df in enumerate(files):
        df = df.withColumn("file_idx", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.repartitionByRange("tile").sortWithinPartitions("tile", "file_idx", "kind", "id")


def latest_time(changes: DataFrame, time: str = "ts") -> DataFrame:
    """``latest``: the greatest time of a change set, 0 for one without any; its end date. One row."""
    return changes.agg(F.coalesce(F.max(F.col(time).cast("bigint")), F.lit(0).cast("bigint")).alias("latest"))
