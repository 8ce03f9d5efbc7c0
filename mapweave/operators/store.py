"""A feature store: geometries in Parquet, a folder for each geometry class and tile, scanned by box or tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions import boxes
from mapweave.functions import quadtree as qt
from mapweave.operators.geometry import LINE, POINT, POLYGON

# Several polygons live with the polygons; a scan for their own class finds nothing.
CLASSES = {"point": POINT, "line": LINE, "polygon": POLYGON}


def geometry_class(kind: Column) -> Column:
    return F.when(kind == POINT, "point").when(kind == LINE, "line").when(kind.isNotNull(), "polygon")


def add_features(geoms: DataFrame, path: str, level: int = 8) -> None:
    """Appends geometries (as ``operators.geometry.generate`` gives them); rows without a geometry class are skipped.

    The folder's tile is the feature's, rounded to ``level``, so the number of folders does not grow with the data. A
    feature that reaches beyond its tile by more than the tile's size, as one whose ``qt`` is out of date may, goes to
    the root's folder, which every scan by box reads.
    """
    every = F.coalesce(F.col("coords"), F.flatten(F.flatten("polygons")))
    lons, lats = F.transform(every, lambda p: p["lon"]), F.transform(every, lambda p: p["lat"])
    rows = geoms.withColumn("geom_class", geometry_class(F.col("geom_type"))).where("geom_class is not null")
    rows = rows.withColumn("tile_qt", qt.round_to(F.greatest(F.col("qt"), F.lit(0)), level))
    rows = rows.withColumn("box", F.struct(F.array_min(lons).alias("minx"), F.array_min(lats).alias("miny"), F.array_max(lons).alias("maxx"), F.array_max(lats).alias("maxy")))
    near = boxes.contains(qt.bounds(F.col("tile_qt"), 1.0), F.col("box"))
    rows = rows.withColumn("tile_qt", F.when(F.coalesce(near, F.lit(False)), F.col("tile_qt")).otherwise(F.lit(0).cast("bigint")))
    # Tiles with very many features are spread over several tasks and files.
    rows.repartition("geom_class", "tile_qt", F.pmod("id", F.lit(16))).sortWithinPartitions("geom_class", "tile_qt", "qt").write.mode("append").partitionBy("geom_class", "tile_qt").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _features(rows: DataFrame, columns: list[str], sort_by: str | None) -> DataFrame:
    base = ["osm_id", "z_order", "way_area", "quadtree"]
    own = {"osm_id": F.col("id"), "z_order": F.col("z_order"), "way_area": F.col("way_area"), "quadtree": F.col("qt")}
    out = rows.select(*[own[c].alias(c) for c in base], "orig_kind", "geom_type", "coords", "polygons", *[F.col("tags")[c].alias(c) for c in columns if c not in own])
    return out.orderBy(F.col(f"`{sort_by}`").asc_nulls_last(), "osm_id") if sort_by else out


def scan_box(store: DataFrame, box: tuple[int, int, int, int], geom_class: str, columns: list[str], sort_by: str | None = None) -> DataFrame:
    """Features of one class whose box meets ``box``. Tiles are pruned by folder before any row is read."""
    if geom_class not in CLASSES:
        return _features(store.where(F.lit(False)), columns, sort_by)
    area = boxes.box(*box)
    # Features may overhang their tile a little, never by more than its size.
    near = store.where((F.col("geom_class") == geom_class) & boxes.intersects(qt.bounds(F.col("tile_qt"), 1.0), area))
    return _features(near.where(boxes.intersects(F.col("box"), area)), columns, sort_by)


def scan_tile(store: DataFrame, tile: int, geom_class: str, columns: list[str], sort_by: str | None = None) -> DataFrame:
    """Features of one class in one tile of the store."""
    if geom_class not in CLASSES:
        return _features(store.where(F.lit(False)), columns, sort_by)
    return _features(store.where((F.col("geom_class") == geom_class) & (F.col("tile_qt") == tile)), columns, sort_by)


def keys(store: DataFrame) -> DataFrame:
    return store.select("tile_qt").distinct()


def by_key(store: DataFrame, tile: int) -> DataFrame:
    return store.where(F.col("tile_qt") == tile)


def rows_as_tags(df: DataFrame, skip: tuple[str, ...] = ("osm_id", "way", "z_order", "way_area", "quadtree")) -> DataFrame:
    """Adds ``tags``: the row's columns as text, with ``!`` before integers, ``%`` before floats and ``$`` for nulls and others."""
    entries = []
    for name, kind in df.dtypes:
        if name in skip:
            continue
        c = F.col(f"`{name}`")
        mark = "!" if kind in ("tinyint", "smallint", "int", "bigint") else "%" if kind in ("float", "double") else "" if kind == "string" else None
        text = F.when(c.isNull() if mark is not None else F.lit(True), F.lit("$")).otherwise(F.concat(F.lit(mark or ""), c.cast("string")))
        entries += [F.lit(name), text]
    return df.withColumn("tags", F.create_map(*entries) if entries else F.create_map().cast("map<string,string>"))


def typed_value(text: Column) -> Column:
    """The value behind a marked text: struct ``int, float, text``, of which at most one is not null."""
    rest = F.substring(text, 2, 1_000_000_000)
    return F.struct(
        F.when(text.startswith("!"), rest.try_cast("bigint")).alias("int"),
        F.when(text.startswith("%"), rest.try_cast("double")).alias("float"),
        F.when(~text.startswith("!") & ~text.startswith("%") & (text != "$"), text).alias("text"),
    )
