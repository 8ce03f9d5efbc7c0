"""GeoJSON of geometries, made from columns."""

from __future__ import annotations

import gzip
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.operators.geometry import LINE, POINT, POLYGON


def _point(p: Column) -> Column:
    return F.array(p["lon"] / 1e7, p["lat"] / 1e7)


def _line(points: Column) -> Column:
    return F.transform(points, _point)


def geometry_json(kind: Column, coords: Column, polygons: Column) -> Column:
    """The GeoJSON geometry as text; null for rows without one."""
    make = lambda name, c: F.to_json(F.struct(F.lit(name).alias("type"), c.alias("coordinates")))
    rings = lambda p: F.transform(p, _line)
    return (
        F.when((kind == POINT) & (F.size(coords) > 0), make("Point", _point(F.get(coords, F.lit(0)))))
        .when(kind == LINE, make("LineString", _line(coords)))
        .when(kind == POLYGON, make("Polygon", rings(F.get(polygons, F.lit(0)))))
        .when(F.size(polygons) > 0, make("MultiPolygon", F.transform(polygons, rings)))
    )


def features(geoms: DataFrame) -> DataFrame:
    """``qt, feature`` of geometries as ``operators.geometry.generate`` gives them."""
    own = F.to_json(F.map_concat(F.transform_values("tags", lambda k, v: v), F.create_map(F.lit("osm_id"), F.col("id").cast("string"))))
    body = F.concat(F.lit('{"type":"Feature","id":'), F.col("id").cast("string"), F.lit(',"properties":'), own, F.lit(',"geometry":'), F.coalesce(geometry_json(F.col("geom_type"), F.col("coords"), F.col("polygons")), F.lit("null")), F.lit("}"))
    return geoms.select("qt", "orig_kind", "id", body.alias("feature"))


def collections(geoms: DataFrame, per_block: int = 8000) -> DataFrame:
    """``qt, part, collection``: FeatureCollections of at most ``per_block`` features of one tile each.

    A tile with more is dealt out by a hash over as many shares as it needs, each of which one task puts together.
    """
    per_block = max(1, per_block)
    rows = features(geoms)
    crowded = rows.groupBy("qt").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_block)
    rows = rows.join(crowded.withColumnRenamed("qt", "of"), F.col("qt").eqNullSafe(F.col("of")), "left")
    rows = rows.withColumn("share", F.pmod(F.xxhash64("orig_kind", "id"), F.coalesce(F.ceil(F.col("n") / per_block).cast("bigint"), F.lit(1))))
    nth = F.row_number().over(Window.partitionBy("qt", "share").orderBy("orig_kind", "id"))
    rows = rows.withColumn("nth", F.floor((nth - 1) / per_block).cast("bigint"))
    grouped = rows.groupBy("qt", "share", "nth").agg(F.sort_array(F.collect_list(F.struct("orig_kind", "id", "feature"))).alias("fs"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("fs", lambda f: f["feature"]), ","), F.lit("]}"))
    return grouped.select("qt", (F.col("share") * (1 << 20) + F.col("nth")).alias("part"), text.alias("collection"))


def write_parts(geoms: DataFrame, folder: str, nested: bool = True) -> None:
    """Text files, a FeatureCollection (or, not nested, a feature) on each line: every task writes its own."""
    lines = collections(geoms).repartitionByRange("qt", "part").sortWithinPartitions("qt", "part").select("collection") if nested else features(geoms).select("feature")
    lines.write.mode("overwrite").text(folder)


def write(geoms: DataFrame, path: str, nested: bool = True) -> None:
    """One GeoJSON file, gzipped if it ends in .gz: nested, its features are one FeatureCollection per block of a tile.

    The text is made by the tasks and comes to the driver one partition at a time: for what one file should hold.
    ``write_parts`` writes what is larger.
    """
    lines = collections(geoms).orderBy("qt", "part").select("collection") if nested else features(geoms).orderBy("qt", "orig_kind", "id").select("feature")
    with gzip.open(path + ".part", "wt", encoding="utf-8") if path.endswith(".gz") else open(path + ".part", "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[')
        for i, row in enumerate(lines.toLocalIterator()):
            f.write(("," if i else "") + row[0])
        f.write("]}")
    os.replace(path + ".part", path)
