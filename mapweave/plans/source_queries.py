"""Queries that write a source or sink and read it again, and the SQL that says what must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions import boxes, times
from mapweave.functions import quadtree as qt
from mapweave.operators import changes as ch
from mapweave.operators import geometry, store, tiles, update
from mapweave.operators.current import current_rows
from mapweave.plans import map_queries as mq
from mapweave.session import fresh_path, table
from mapweave.sources import datasource, geojson, geomblob

QUERIES, SQL = {}, {}
_TABLES = ("full_nodes", "full_ways", "full_relations")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """Current rows of existing elements as a block file has them, in tiles four levels deep."""
    out = None
    for kind, name in enumerate(_TABLES):
        rows = table(spark, d, name)
        cols = {c: F.col(c) for c in ("qt", "changeset", "uid", "user_name", "tags", *(("lon", "lat") if kind == 0 else ("refs",) if kind == 1 else ()))}
        cur = current_rows(rows, cols).where("not deleted")
        none = lambda c, t: F.col(c) if c in cols else F.lit(None).cast(t)
        cur = cur.select(F.lit(kind).cast("tinyint").alias("kind"), "id", "qt", F.col("vs").alias("version"), "ts", "changeset", "uid", F.col("user_name").alias("user"), "tags", none("lon", "bigint").alias("lon"), none("lat", "bigint").alias("lat"), none("refs", "array<bigint>").alias("refs"))
        out = cur if out is None else out.unionByName(cur)
    out = out.withColumn("refs", F.filter("refs", lambda r: r.isNotNull())).withColumn("tags", F.filter("tags", lambda t: t["k"].isNotNull()))
    return out.withColumn("qt", F.coalesce("qt", F.lit(-1)).cast("bigint")).withColumn("tile", qt.round_to(F.col("qt"), 4))


def _written(spark: SparkSession, d: str, **options: str) -> str:
    datasource.register(spark)
    path = fresh_path(spark, "blocks")
    writer = tiles.by_tile(_elements(spark, d)).write.format("mapblocks").option("parts", "true").option("blockSize", "1000").mode("append")
    writer.options(**options).save(path)
    return path


_CUR = "(select *, row_number() over (partition by id order by vs desc, ts desc) as k from {t})"
_E = " union all ".join(
    f"select {k} as kind, id, coalesce(qt, -1) as qt, vs, coalesce(user_name, '') as usr, {'lon, lat' if k == 0 else 'null::bigint as lon, null::bigint as lat'}, {'len(list_filter(refs, lambda r: r is not null))' if k == 1 else 'null'}::bigint as n_refs, coalesce(len(list_filter(tags, lambda e: e.k is not null)), 0)::bigint as n_tags from {_CUR.format(t=t)} where k = 1 and coalesce(visible, true)"
    for k, t in enumerate(_TABLES)
)
_BACK = f"select kind::tinyint as kind, id, qt, vs as version, usr as user, case when kind = 0 then coalesce(lon, 0) end as lon, case when kind = 0 then coalesce(lat, 0) end as lat, case when kind = 1 then coalesce(n_refs, 0) end as n_refs, n_tags, {mq._round_sql('qt', 4)} as tile from ({_E})"


def _back(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("mapblocks").load(path)
    return rows.select("kind", "id", "qt", "version", "user", "lon", "lat", F.when(F.col("kind") == 1, F.size("refs")).cast("bigint").alias("n_refs"), F.size("tags").cast("bigint").alias("n_tags"), "tile")


@query(_BACK)
def block_files(spark, d):
    return _back(spark, _written(spark, d))


@query(_BACK)
def block_files_tuple_form(spark, d):
    return _back(spark, _written(spark, d, tuple="true"))


@query(f"select * from ({_BACK}) where tile between 0 and 2305843009213693951")
def block_files_pruned(spark, d):
    """Blocks of the first quarter of the planet alone, picked by the headers' indices."""
    return _back(spark, _written(spark, d)).where("tile >= 0 and tile <= 2305843009213693951")


@query(f"select kind, id, qt from ({_BACK})")
def block_files_projected(spark, d):
    """Ids and tiles, nothing else decoded."""
    return spark.read.format("mapblocks").option("columns", "kind,id,qt").load(_written(spark, d))


@query(f"select id, lon, lat from ({_BACK}) where kind = 0")
def block_files_positions(spark, d):
    """Nodes with their positions; blocks of other kinds and all other values are passed over."""
    return spark.read.format("mapblocks").options(columns="id,lon,lat", ways="false", relations="false").load(_written(spark, d))


@query(f"select distinct tile, false as is_change from ({_BACK})")
def block_index(spark, d):
    return spark.read.format("mapblocks_index").load(_written(spark, d)).select("tile", "is_change").distinct()


@query(f"select kind, id, qt from ({_BACK})")
def quadtree_file(spark, d):
    datasource.register(spark)
    path = fresh_path(spark, "quadtrees")
    tiles.write_quadtrees(_elements(spark, d), path)
    return spark.read.format("mapblocks").option("columns", "kind,id,qt").load(path)


@query(mq.SQL["way_coords"])
def geometry_blobs(spark, d):
    """Ways' lines packed into blobs of geometries and unpacked again."""
    lines = geometry.way_coordinates(mq.ways(spark, d), mq.nodes(spark, d)).select("id", "coords")
    none = F.lit(None).cast("array<array<array<struct<ref:bigint,lon:bigint,lat:bigint>>>>")
    blob = geomblob.pack_column(F.lit(1), F.lit(2), F.col("coords"), none, F.lit(0), F.lit(0.0))
    back = lines.select("id", blob.alias("geom"), F.size("coords").alias("n")).select("id", "n", geomblob.unpack_column(F.col("geom")).alias("g"))
    points = F.when(F.col("n") > 0, F.col("g.coords")).otherwise(F.array().cast("array<struct<ref:bigint,lon:bigint,lat:bigint>>"))
    return back.select("id", F.transform(points, lambda p: p["lon"]).alias("lons"), F.transform(points, lambda p: p["lat"]).alias("lats"))


@query(f"with {mq._N} select id, lon, lat from n")
def geojson_points(spark, d):
    """Nodes as features in collections of a tile, written as text and parsed again."""
    rows = mq.nodes(spark, d)
    geoms = rows.select(qt.calculate(F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat") + 1, 0.05, 5).alias("qt"), F.lit(0).alias("orig_kind"), "id", F.lit(1).cast("tinyint").alias("geom_type"), F.create_map().cast("map<string,string>").alias("tags"), F.array(F.struct(F.col("id").alias("ref"), "lon", "lat")).alias("coords"), F.lit(None).cast("array<array<array<struct<ref:bigint,lon:bigint,lat:bigint>>>>").alias("polygons"))
    path = fresh_path(spark, "geojson")
    geojson.write_parts(geoms, path)
    form = "struct<features:array<struct<id:bigint,geometry:struct<type:string,coordinates:array<double>>>>>"
    found = spark.read.text(path).select(F.explode(F.from_json("value", form)["features"]).alias("f"))
    whole = lambda i: F.round(F.col("f.geometry.coordinates")[i] * 1e7).cast("bigint")
    return found.select(F.col("f.id").alias("id"), whole(0).alias("lon"), whole(1).alias("lat"))


_SPOT = "case when lon < 0 then case when lat > 0 then 1 else 4611686018427387905 end else case when lat > 0 then 2305843009213693953 else 6917529027641081857 end end"


def _store(spark, d) -> DataFrame:
    rows = mq.nodes(spark, d).where("lon <> 0 and lat <> 0 and abs(lon) < 1800000000 and abs(lat) < 850000000")
    spot = qt.from_tuple((F.col("lon") > 0).cast("bigint"), (F.col("lat") < 0).cast("bigint"), F.lit(1).cast("bigint"))
    geoms = rows.select(F.lit(0).alias("orig_kind"), "id", F.lit(1).cast("tinyint").alias("geom_type"), F.create_map().cast("map<string,string>").alias("tags"), F.array(F.struct(F.col("id").alias("ref"), "lon", "lat")).alias("coords"), F.lit(None).cast("array<array<array<struct<ref:bigint,lon:bigint,lat:bigint>>>>").alias("polygons"), F.lit(0).cast("bigint").alias("z_order"), F.lit(0.0).alias("way_area"), spot.alias("qt"))
    path = fresh_path(spark, "store")
    store.add_features(geoms, path, level=1)
    return store.open_store(spark, path)


_PLACED = "p as (select id, lon, lat from n where lon <> 0 and lat <> 0 and abs(lon) < 1800000000 and abs(lat) < 850000000)"


@query(f"with {mq._N}, {_PLACED} select id as osm_id, {_SPOT} as quadtree from p where lon > 0 and lat > 0")
def store_scan_tile(spark, d):
    return store.scan_tile(_store(spark, d), 2305843009213693953, "point", []).select("osm_id", "quadtree")


@query(f"with {mq._N}, {_PLACED} select distinct {_SPOT} as tile_qt from p")
def store_keys(spark, d):
    return store.keys(_store(spark, d)).select(F.col("tile_qt").cast("bigint").alias("tile_qt"))


@query(mq.SQL["loc_lookup"])
def location_index(spark, d):
    """The base is left out; every change file's elements are appended to the index, which is then asked for all of them."""
    feed = mq._feed(spark, d).groupBy("kind", "id", "file_idx").agg(F.max_by("change", "seq").alias("change"))
    rows = feed.select("kind", "id", F.when(F.col("change") == 1, ch.DELETE).otherwise(ch.MODIFY).alias("change"), (F.col("file_idx") + 1000).cast("bigint").alias("tile"), "file_idx")
    path = fresh_path(spark, "locations")
    update.append_location_files(path, rows)
    return update.find_tiles(update.read_locations(spark, path), rows.select("kind", "id"))


@query("select coalesce(max(ts), 0) as latest from osc_changes")
def change_latest_time(spark, d):
    return ch.latest_time(table(spark, d, "osc_changes", "ts"))


@query("select id, ts, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S') as t, strftime(make_timestamp(ts * 1000000), '%Y%m%d') as day, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H-%M-%S') as in_file, ts as back from full_ways")
def time_texts(spark, d):
    ts = F.col("ts")
    return table(spark, d, "full_ways", "id", "ts").select("id", "ts", times.time_text(ts).alias("t"), times.date_text(ts).alias("day"), times.file_text(ts).alias("in_file"), times.parse_time(times.time_text(ts)).alias("back"))


@query("with t as (select distinct qt from full_nodes where qt >= 0), a as (select qt, unnest(range(0, qt & 31)) as l from t), b as (select qt, l, case when l = 0 then 0 else ((qt >> (63 - 2 * l)) << (63 - 2 * l)) + l end as tile from a), f as (select b.qt, max_by(tile, l) as parent from b join t on t.qt = b.tile group by b.qt) select t.qt, coalesce(parent, -1) as parent from t left join f on f.qt = t.qt")
def tile_tree(spark, d):
    return tiles.tile_tree(table(spark, d, "full_nodes", "qt")).select("qt", F.coalesce("parent", F.lit(-1)).cast("bigint").alias("parent"))


_KEPT = "coalesce(list_filter(tags, lambda e: e.k = 'type')[-1].v in ('boundary', 'multipolygon', 'route'), false)"


@query(f"with {mq._N}, {mq._W}, {mq._R}, g as (select id, tags from {_CUR.format(t='full_nodes')} where k = 1), x as (select id, generate_subscripts(refs, 1) as p, unnest(refs) as node from w), y as (select x.id, count(*) as c, min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from x join n on n.id = node group by x.id) select 0 as kind, n.id from n join g on g.id = n.id where len(list_filter(tags, lambda e: e.k is not null)) > 0 and {mq._IN} union all select 1, y.id from y join w on w.id = y.id where c = len(refs) and x0 <= 900000000 and x1 >= 0 and y0 <= 700000000 and y1 >= 300000000 union all select 2, id from r where {_KEPT}")
def relevant_elements(spark, d):
    placed = geometry.way_coordinates(mq.ways(spark, d), mq.nodes(spark, d))
    parts = geometry.relevant_elements(mq._nodes_with_tags(spark, d), placed, mq._tagged(mq.relations(spark, d)), mq._BOX)
    rows = [df.select(F.lit(k).alias("kind"), "id") for k, df in enumerate(parts)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"with {mq._N} select id, lon * 0 + {boxes.PLANET[0]} <= lon as planet from n")
def planet_box(spark, d):
    return mq.nodes(spark, d).select("id", boxes.contains_xy(boxes.box(*boxes.parse_box("planet")), F.col("lon"), F.col("lat")).alias("planet"))
