"""Codecs, sources, sinks and helpers on small inputs written here."""

import gzip
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from mapweave import session
from mapweave.functions import quadtree as qt
from mapweave.functions import times
from mapweave.operators import changes, geometry, tiles
from mapweave.plans import dialect
from mapweave.sources import blockfile, changexml, datasource, geojson, geomblob, style

ROWS = [
    (0, 5, 4, (1 << 61) + 1, 3, 1_600_000_000, 9, 8, "é", True, [("k", "v"), ("k", "")], 7, -8, None, None, 2),
    (0, -6, 5, -1, 1, 0, 0, 0, "", False, [], -1_800_000_000, -900_000_000, None, None, 2),
    (1, 7, 4, 0, 2, 5, 1, 1, "u", True, [("n", "x" * 500)], None, None, [5, -6, 5], None, 2),
    (2, 2**61, 1, 3, 2, 5, 1, 1, "u", True, [], None, None, None, [(0, 5, "from"), (2, 2**61, ""), (1, -7, "to")], 2),
]
ELEMENT = "kind tinyint, id bigint, change tinyint, qt bigint, version bigint, ts bigint, changeset bigint, uid bigint, user string, visible boolean, tags array<struct<k:string,v:string>>, lon bigint, lat bigint, refs array<bigint>, members array<struct<type:tinyint,ref:bigint,role:string>>, tile bigint"


@pytest.mark.parametrize("options", [{}, {"tuple": "true"}, {"parts": "true"}, {"blockSize": "1", "parts": "true", "tuple": "true"}])
def test_block_files_come_back(spark, tmp_path, options):
    datasource.register(spark)
    tiles_of = (0, (1 << 61) + 1)
    rows = [(*r[:-1], t) for t in tiles_of for r in ROWS]
    df = spark.createDataFrame(rows, ELEMENT)
    path = f"{tmp_path}/file.pbfc" if "parts" not in options else f"file://{tmp_path}/parts"
    tiles.by_tile(df).write.format("mapblocks").options(change="true", **options).mode("append").save(path)
    back = spark.read.format("mapblocks").load(path)
    plain = lambda v: [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
    got = sorted((plain(r) for r in back.select(*df.columns).collect()), key=str)
    # Quadtrees below no tile lose their path as x, y, z: -1 stays, 3 is a tile of depth 3.
    assert got == sorted((plain(r) for r in rows), key=str)
    assert back.where(F.col("tile") == tiles_of[1]).count() == 4
    some = spark.read.format("mapblocks").option("columns", "id,tile").load(path)
    assert some.columns == ["id", "tile"] and sorted(r["id"] for r in some.collect()) == sorted(r[1] for r in rows)
    index = spark.read.format("mapblocks_index").load(path).collect()
    assert {r["tile"] for r in index} == set(tiles_of) and all(r["is_change"] for r in index)
    first = [r for r in index if r["file"] == index[0]["file"]]
    one = spark.read.format("mapblocks").option("offsets", str(first[0]["filepos"])).load(first[0]["file"].removeprefix("file://"))
    assert {r["tile"] for r in one.collect()} == {first[0]["tile"]}


def test_raw_and_cut_off_blocks(tmp_path):
    data = blockfile.write_block([{"kind": 0, "id": 1, "lon": 2, "lat": 3}])
    path = tmp_path / "raw"
    path.write_bytes(blockfile.frame("OSMHeader", blockfile.Header(box=(1, 2, 3, 4)).pack(), False) + blockfile.frame("OSMData", data, False))
    with open(path, "rb") as f:
        assert blockfile.read_header(f).box == (1, 2, 3, 4)
        frames = list(blockfile.read_frames(f))
        assert [e["id"] for e in blockfile.read_block(frames[1].data())[1]] == [1]
    path.write_bytes(path.read_bytes()[:-1])
    with open(path, "rb") as f, pytest.raises(ValueError):
        list(blockfile.read_frames(f))


OSC = """<osmChange version="0.6"><create><node id="1" version="2" timestamp="2020-01-02T03:04:05Z" lat="-1.5" lon="2.00000004" user="a&amp;b" uid="3" changeset="4"><tag k="x" v="y"/></node></create>
<modify><way id="2"><nd ref="1"/><nd ref="5"/></way><relation id="3"><member type="way" ref="2" role="r"/><member type="other" ref="9" role=""/></relation></modify><delete><node id="1"/></delete></osmChange>"""


def test_change_xml(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "a.osc").write_text(OSC)
    (tmp_path / "b.osc.gz").write_bytes(gzip.compress(OSC.encode()))
    rows = spark.read.format("osmchange").load(str(tmp_path)).orderBy("file_idx", "seq").collect()
    assert [(r["file_idx"], r["seq"], r["change"], r["kind"], r["id"]) for r in rows] == [(f, i, *x) for f in (0, 1) for i, x in enumerate([(5, 0, 1), (4, 1, 2), (4, 2, 3), (1, 0, 1)])]
    n, w, r, gone = rows[:4]
    assert (n["lat"], n["lon"], n["ts"], n["user"], n["tags"][0]["v"]) == (-15_000_000, 20_000_000, 1_577_934_245, "a&b", "y")
    assert w["refs"] == [1, 5] and [tuple(m) for m in r["members"]] == [(1, 2, "r")] and (gone["lon"], gone["visible"]) == (-1_800_000_000, False)
    assert changexml.parse_time("20200102") == 1_577_923_200


def test_polygon_file_style_and_settings(tmp_path):
    area = style.parse_poly("name\nouter\n 0 0\n 1E0 0\n 1 1\nEND\n!hole\n 0.2 0.1\n 0.3 0.1\n 0.3 0.2\nEND\nEND\n")
    assert area.rings == [[(0, 0), (10_000_000, 0), (10_000_000, 10_000_000)]] and len(area.holes) == 1 and area.bounds() == (0, 0, 10_000_000, 10_000_000)
    with pytest.raises(ValueError):
        style.parse_poly("name\nEND\n")
    files = [style.FileState(1, "20200101", "a.pbf", 7), style.FileState(2, "20200102", "b.pbfc")]
    style.write_file_list(f"{tmp_path}/list.json", files)
    assert style.read_file_list(f"{tmp_path}/list.json") == files and style.last_state(f"{tmp_path}/list.json").Filename == "b.pbfc"
    style.write_update_settings(f"{tmp_path}/s.json", style.UpdateSettings(InitialState=4, QuadtreeTuple=True))
    assert style.read_update_settings(f"{tmp_path}/s.json").InitialState == 4


def ring(*points):
    return [{"ref": i, "lon": x, "lat": y} for i, (x, y) in enumerate(points)]


SQUARE = ring((0, 0), (0, 10), (10, 10), (10, 0), (0, 0))


def test_geometry_blobs():
    cases = [(0, 1, ring((5, -6)), None, 0, 0.0), (1, 2, ring((1, 2), (-3, 4)), None, -7, 0.0), (1, 3, None, [[SQUARE, ring((2, 2), (3, 2), (3, 3), (2, 2))]], 4, 81.5), (2, 7, None, [[SQUARE], [ring((20, 0), (30, 0), (30, 9), (20, 0))]], 0, 1e12)]
    for case in cases:
        blob = geomblob.pack(*case)
        got = geomblob.unpack(blob)
        assert (got["orig_kind"], got["geom_type"], got["coords"], got["polygons"], got["z_order"], got["way_area"]) == case
        every = case[2] or [p for g in case[3] for r in g for p in r]
        assert (got["minx"], got["maxy"]) == (min(p["lon"] for p in every), max(p["lat"] for p in every))
        assert geomblob.order_and_area(blob) == (case[4], case[5])
    assert geomblob.pack(1, 2, [], None) is None and geomblob.pack(2, 3, None, []) is None


def test_wkb(spark):
    df = spark.createDataFrame([(1, [(1, 5 * 10**7, -(10**7))], None), (2, [(1, 0, 0), (2, 10**7, 0)], None), (3, None, [[[(1, 0, 0), (2, 0, 10**7), (3, 10**7, 0), (1, 0, 0)]]]), (1, None, None)], "k int, c array<struct<ref:bigint,lon:bigint,lat:bigint>>, p array<array<array<struct<ref:bigint,lon:bigint,lat:bigint>>>>")
    got = [r[0] for r in df.select(geometry.wkb_column(F.col("k"), F.col("c"), F.col("p"), 4326)).collect()]
    head = lambda code: b"\x00" + struct.pack(">II", code | 0x20000000, 4326)
    assert got[0] == head(1) + struct.pack(">dd", 5, -1) and got[1] == head(2) + struct.pack(">Idddd", 2, 0, 0, 1, 0)
    assert got[2] == head(3) + struct.pack(">II", 1, 4) + struct.pack(">8d", 0, 0, 0, 1, 1, 0, 0, 0) and got[3] is None


def test_geojson_collections_hold_no_more_than_they_promise(spark, tmp_path):
    rows = spark.range(2000).select(F.when(F.col("id") < 1900, 5).when(F.col("id") < 1999, 6).cast("bigint").alias("qt"), F.lit(0).alias("orig_kind"), "id", F.lit(1).cast("tinyint").alias("geom_type"), F.create_map(F.lit("n"), F.lit('a"b')).alias("tags"), F.array(F.struct(F.col("id").alias("ref"), F.col("id").alias("lon"), F.col("id").alias("lat"))).alias("coords"), F.lit(None).cast("array<array<array<struct<ref:bigint,lon:bigint,lat:bigint>>>>").alias("polygons"))
    found = geojson.collections(rows, 100).collect()
    texts = [json.loads(r["collection"]) for r in found]
    assert max(len(t["features"]) for t in texts) <= 100 and len({(r["qt"], r["part"]) for r in found}) == len(found)
    assert sorted(f["id"] for t in texts for f in t["features"]) == list(range(2000)) and texts[0]["features"][0]["properties"]["n"] == 'a"b'
    geojson.write(rows.where("qt = 6"), f"{tmp_path}/all.json.gz")
    whole = json.loads(gzip.open(f"{tmp_path}/all.json.gz").read())
    assert len(whole["features"]) == 1 and len(whole["features"][0]["features"]) == 99


def test_times_and_latest(spark):
    df = spark.createDataFrame([(0,), (1_577_934_245,), (None,)], "ts bigint")
    got = [tuple(r) for r in df.select(times.time_text(F.col("ts")), times.file_text(F.col("ts")), times.file_text(F.col("ts"), True), times.parse_time(times.time_text(F.col("ts"))), times.parse_time(times.date_text(F.col("ts")))).collect()]
    assert got[1] == ("2020-01-02T03:04:05", "2020-01-02T03-04-05", "20200102", 1_577_934_245, 1_577_923_200) and got[2] == (None,) * 5
    assert changes.latest_time(df).first()[0] == 1_577_934_245 and changes.latest_time(df.limit(0)).first()[0] == 0


def test_substr_in_the_middle_of_a_character(spark):
    df = spark.createDataFrame([("aüb",), (None,)], "s string")
    got = [r[0] for r in dialect.run("select substr(s, 1, 1) as a, substr(s, 2, 1) as b, substr(s, 2, 2) as c from t", {"t": df}, {}).select(F.concat_ws("|", "a", "b", "c")).collect()]
    assert got[0] == "a|�|ü"


def test_deepest_tile_holds_the_box(spark):
    rng = random.Random(2)
    boxes = []
    for _ in range(300):
        x, y, w = rng.randrange(-1_700_000_000, 1_700_000_000), rng.randrange(-800_000_000, 800_000_000), 10 ** rng.randrange(1, 8)
        boxes.append((x, y, x + rng.randrange(w), y + rng.randrange(w)))
    df = spark.createDataFrame(boxes, "x0 bigint, y0 bigint, x1 bigint, y1 bigint").withColumn("q", qt.calculate(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 0.0, 18))
    for r in df.withColumn("b", qt.bounds(F.col("q"))).withColumn("z", qt.depth(F.col("q"))).collect():
        b = r["b"]
        assert b["minx"] - 1 <= r["x0"] and r["x1"] <= b["maxx"] + 1 and b["miny"] - 1 <= r["y0"] and r["y1"] <= b["maxy"] + 1
        if r["z"] < 18:  # no child holds it
            mid_x = (b["minx"] + b["maxx"]) / 2
            assert r["x0"] <= mid_x + 1 and r["x1"] >= mid_x - 1 or r["y0"] < r["y1"]


def test_tile_tree(spark):
    q = lambda letters: spark.range(1).select(qt.from_letters(F.lit(letters))).first()[0]
    a, ab, abcd, c = q("A"), q("AB"), q("ABCD"), q("C")
    df = spark.createDataFrame([(x,) for x in (a, ab, abcd, c, c, -1, None)], "qt bigint")
    assert {tuple(r) for r in tiles.tile_tree(df).collect()} == {(a, None), (ab, a), (abcd, ab), (c, None)}


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        pass

    other = Session()
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]", None):
        other.conf = Conf(**{"spark.master": master})
        with pytest.raises(RuntimeError):
            session.shared_dir(other)
    other.conf = Conf(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///shared/"})
    assert session.shared_dir(other) == "hdfs:///shared"
