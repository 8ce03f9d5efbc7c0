"""The operators behind the p queries, on small tables with nulls, ties, repeats, nothing at all and clashing columns."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mapweave.operators import change_log, heavy_keys, hierarchy, multivalue, orphans, proximity
from mapweave.streaming import change_stream

ENTRIES = "quadtree bigint, entry_id bigint, qt_count bigint, block_idx bigint, key string, cum int, split int"


def entries(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], ENTRIES)


def half(rows):
    out, by = {}, {}
    for q, e, n, b in set(rows):
        if q is not None and n is not None:
            by.setdefault(q, []).append(((b is not None, b or 0), (e is not None, e or 0), n, e))
    for q, es in by.items():
        total, run = sum(x[2] for x in es), 0
        for *_, n, e in sorted(es, key=lambda x: x[:3]):
            run += n
            if run * 2 >= total:
                out[q] = e
                break
    return out


def test_half_sum_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice([7, 7, 7, 7, 1, 2, 3]), rng.randrange(400), rng.choice([0, 1, 5, 2**61, -3]), rng.randrange(50)) for _ in range(1500)]
    rows = list({(b, e): (q, e, n, b) for q, e, n, b in rows}.values())
    rows += rows[:200] + [(None, 1, 1, 1), (5, 2, None, 1), (6, None, 4, None), (6, 3, 4, None)]
    got = heavy_keys.half_sum_entries(entries(spark, rows), "quadtree", "entry_id", "qt_count", "block_idx")
    assert got.columns == ["quadtree", "entry_id"]
    assert {r[0]: r[1] for r in got.collect()} == half(rows)


def test_half_sum_of_nothing(spark):
    assert heavy_keys.half_sum_entries(entries(spark, []), "quadtree", "entry_id", "qt_count", "block_idx").count() == 0


def test_key_totals(spark):
    rows = [(1, i, 2**62, 0) for i in range(5)] + [(1, 9, -1, 0), (2, 0, 7, 0), (None, 0, 7, 0), (2, 0, None, 0)]
    got = {r["quadtree"]: (r["n_rows"], int(r["total"])) for r in heavy_keys.key_totals(entries(spark, rows), "quadtree", "qt_count").collect()}
    assert got == {1: (6, 5 * 2**62 - 1), 2: (1, 7)}
    assert heavy_keys.key_totals(entries(spark, []), "quadtree", "qt_count").count() == 0


FEED = "change_type int, object_type int, id bigint, vs bigint, ts bigint, seq bigint, dead string, fresh string"
BASE = "id bigint, vs bigint, ts bigint, visible boolean, object_type string"


def feed(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], FEED)


def base(spark, rows):
    return spark.createDataFrame([(*r, "a") for r in rows], BASE)


@pytest.mark.parametrize("runs", [1, 3, 6])
def test_apply_changes_against_replay(spark, runs):
    rng = random.Random(2)
    rows = [(rng.choice([1, 4, 5, None]), rng.choice([0, 1]), rng.randrange(12), rng.choice([None, -1, 0, 1, 2, 3]), rng.choice([None, 10, 20]), i) for i in range(150)]
    rows += rows[:20] + [(4, None, 1, 1, 1, 900), (4, 0, None, 1, 1, 901)]
    nodes = [(i, rng.choice([1, 2, 3]), rng.choice([10, 20, 30]), rng.choice([True, False, None])) for i in range(20) for _ in range(2)]
    best = {}
    for i, v, t, vis in nodes:
        best[i] = max(best.get(i, (-1, -1, False)), (v, t, vis is False))
    state = {(0, i): (v, t, -1, d) for i, (v, t, d) in best.items()}
    touched = set()
    for c, o, i, v, t, s in rows:
        if v is None or v < 1 or o is None or i is None:
            continue
        touched.add((o, i))
        state[o, i] = max(state.get((o, i), (-1,)), (v, -1 if t is None else t, s, c == 1))
    want = {(*k, state[k][0]) for k in touched if not state[k][3]}
    run = F.pmod("seq", F.lit(runs)) if runs > 1 else None
    got = change_log.apply_changes(feed(spark, rows), {0: base(spark, nodes), 1: base(spark, [])}, run, runs)
    assert {tuple(r) for r in got.collect()} == want


def test_apply_no_changes(spark):
    assert change_log.apply_changes(feed(spark, []), {0: base(spark, [(1, 1, 1, True)])}).count() == 0


def test_runs_are_compacted(spark, tmp_path):
    store = change_log.SortedRuns(spark, f"file://{tmp_path}/runs", fan_in=3)
    for i in range(4):
        store.append(change_log.change_rows(feed(spark, [(4, 0, k, i + 1, 5, i) for k in range(3)])))
    assert len(store.runs) == 2
    assert {(r["id"], r["vs"]) for r in store.merged().collect()} == {(0, 4), (1, 4), (2, 4)}


def test_store_is_opened_again(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    rows = lambda n, change=4: change_log.change_rows(feed(spark, [(change, 0, k, n, 5, n) for k in range(3)]))
    first = change_log.SortedRuns(spark, path, fan_in=3, buckets=2)
    first.append(rows(1), batch=0)
    first.append(rows(2, 1), batch=1)
    again = change_log.SortedRuns(spark, path)
    assert (again.state["buckets"], again.state["fan_in"], len(again.runs)) == (2, 3, 2)
    again.append(rows(9), batch=1)  # seen already
    assert {(r["vs"], r["dead"]) for r in again.merged().collect()} == {(2, True)}
    again.append(rows(3), batch=2)
    assert len(again.runs) == 1 and {(r["vs"], r["dead"]) for r in again.merged().collect()} == {(3, False)}


def test_runs_merge_in_key_order_piece_by_piece():
    rng = random.Random(8)
    rows = [(rng.choice([0, 1]), rng.randrange(300), rng.randrange(5), None if rng.random() < 0.2 else rng.randrange(3), i, rng.random() < 0.3, rng.random() < 0.5) for i in range(900)]
    best, runs = {}, {}
    for i, r in enumerate(rows):
        run = runs.setdefault(i % 5, {})
        rank = lambda x: (x[2], -1 if x[3] is None else x[3], x[4], x[5])
        for into in (run, best):
            old = into.get(r[:2], r)
            into[r[:2]] = (*max(old, r, key=rank)[:6], old[6] or r[6])
    streams = []
    for run in runs.values():
        table = pa.Table.from_pylist([dict(zip(change_log._ROWS.names, run[k])) for k in sorted(run)], schema=change_log._ROWS)
        streams.append(table.to_batches(max_chunksize=17))
    got = [tuple(r.values()) for b in change_log.merge_sorted(streams) for r in b.to_pylist()]
    assert got == [best[k] for k in sorted(best)]
    assert list(change_log.merge_sorted([])) == [] and list(change_log.merge_sorted([[], streams[0][:0]])) == []


def test_following_change_files(spark, tmp_path):
    schema = "change_type int, object_type int, id bigint, vs bigint, ts bigint, seq bigint"
    store = change_log.SortedRuns(spark, f"file://{tmp_path}/runs", fan_in=2, buckets=2)
    for n in (1, 2, 3):
        spark.createDataFrame([(4, 0, 7, n, 5, n), (1, 0, 8, n, 5, n)], schema).write.mode("append").parquet(f"{tmp_path}/feed")
        change_stream.follow_changes(spark, f"{tmp_path}/feed", schema, change_log.SortedRuns(spark, store.path), f"{tmp_path}/checkpoint").awaitTermination()
    got = {(r["id"], r["vs"], r["dead"]) for r in change_log.SortedRuns(spark, store.path).merged().collect()}
    assert got == {(7, 3, False), (8, 3, True)}


def meters(a, b):
    (x, y), (u, v) = [(math.radians(p[0] / 1e7), math.radians(p[1] / 1e7)) for p in (a, b)]
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * proximity.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("radius", [30.0, 5000.0])
def test_pairs_against_brute_force(spark, radius):
    rng = random.Random(3)
    scale = radius / 30
    spots = [(0, 0), (-1_799_999_900, 450_000_000), (1_799_999_950, 450_000_000), (1_800_000_000, 0), (-1_800_000_000, 0), (12, -900_000_000), (-1_799_999_000, -900_000_000), (5, 900_000_000), (777, 899_999_000), (-5_000_000, -899_998_000), (300_000_000, 600_000_000), (123, -600_000_000)]
    pts = []
    for x, y in spots:
        for _ in range(14):
            wide = 1 / max(0.001, math.cos(math.radians(y / 1e7)))
            lon = x + int(rng.uniform(-4000, 4000) * scale * wide)
            lon = (lon + 1_800_000_000) % 3_600_000_000 - 1_800_000_000
            pts.append((lon, max(-900_000_000, min(900_000_000, y + int(rng.uniform(-4000, 4000) * scale)))))
    pts += spots + spots[:3]
    df = spark.createDataFrame([(i, *p, 1, 2) for i, p in enumerate(pts)], "id bigint, lon bigint, lat bigint, band int, cell int")
    want = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if meters(pts[i], pts[j]) <= radius}
    rows = [tuple(r) for r in proximity.pairs_within(df, radius).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_pairs_in_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(proximity, "_CROWD", 7)
    rng = random.Random(5)
    pts = [(int(rng.gauss(0, 4000)), int(rng.gauss(0, 4000))) for _ in range(150)] + [(9, 9)] * 30
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id bigint, lon bigint, lat bigint")
    want = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if meters(pts[i], pts[j]) <= 30}
    rows = [tuple(r) for r in proximity.pairs_within(df, 30.0).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def in_ring(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and (by > ay) == ((x - ax) * (by - ay) < (bx - ax) * (y - ay)):
            odd = not odd
    return odd


@pytest.mark.parametrize("cell", [3, 40, 1000])
def test_regions_clipped_to_cells(spark, cell):
    rng = random.Random(cell)
    rings = [(k % 4, "!h" if k % 5 == 4 else "o", [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(rng.choice([3, 4, 9]))]) for k in range(12)]
    vert = "array<struct<lon:bigint,lat:bigint>>"
    pts = [(i, rng.randrange(-70, 70), rng.randrange(-70, 70)) for i in range(300)]
    got = {tuple(r) for r in proximity.points_in_regions(spark.createDataFrame(pts, "id bigint, lon bigint, lat bigint"), spark.createDataFrame(rings, f"region_id bigint, ring_label string, verts {vert}"), cell).collect()}
    want = {(i, q) for i, x, y in pts for q in range(4) if any(in_ring(r, x, y) for k, n, r in rings if k == q and n == "o") and not any(in_ring(r, x, y) for k, n, r in rings if k == q and n == "!h")}
    assert got == want


def test_positions_leave_out_what_is_none(spark):
    rows = [(1, 1, 1, None, 5, 5), (2, 1, 1, True, None, 5), (3, 1, 1, True, -1_800_000_000, -900_000_000), (4, 1, 1, True, 1_800_000_001, 0), (5, 1, 1, True, 3, 3), (5, 2, 0, False, 3, 3), (6, None, 1, True, 7, 7), (6, 1, None, True, 8, 8), (None, 1, 1, True, 1, 1), (7, 1, 1, True, -1_800_000_000, 0)]
    df = spark.createDataFrame(rows, "id bigint, vs bigint, ts bigint, visible boolean, lon bigint, lat bigint")
    assert {tuple(r) for r in proximity.node_positions(df).collect()} == {(1, 5, 5), (6, 8, 8), (7, -1_800_000_000, 0)}
    assert proximity.pairs_within(proximity.node_positions(df.limit(0)), 30).count() == 0


def test_points_in_regions(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    rings = [(1, "o", square(0, 100)), (1, "!h", square(40, 60)), (1, None, square(200, 300) + [(200, 200)]), (2, "x", square(50, 250) + [None]), (2, "y", [(0, 0), (1, 1)]), (None, "z", square(0, 300)), (3, "!only", square(0, 300)), (4, "n", None)]
    vert = "array<struct<lon:bigint,lat:bigint>>"
    polys = spark.createDataFrame(rings, f"region_id bigint, ring_label string, verts {vert}").withColumn("id", F.lit(5))
    pts = spark.createDataFrame([(1, 10, 10), (2, 50, 50), (3, 220, 220), (4, 500, 500), (5, 70, 70)], "id bigint, lon bigint, lat bigint")
    for cell in (7, 5_000_000):
        got = {tuple(r) for r in proximity.points_in_regions(pts, polys, cell).collect()}
        assert got == {(1, 1), (3, 1), (3, 2), (5, 1), (5, 2)}
    assert proximity.points_in_regions(pts, polys.limit(0)).count() == 0


def climb(links):
    up = {}
    for p, c in links:
        if p is not None and c is not None:
            up[c] = min(p, up.get(c, p))
    out = {}
    for n in {x for pair in up.items() for x in pair}:
        path, seen = [n], {n}
        while path[-1] in up and up[path[-1]] not in seen:
            path.append(up[path[-1]])
            seen.add(path[-1])
        loop = path[-1] in up
        out[n] = (-1, -1, "") if loop else (path[-1], len(path) - 1, "/".join(map(str, reversed(path))))
    return out


LINKS = "parent bigint, child bigint, p string, c string, node int, arc int"


@pytest.mark.parametrize("seed", range(3))
def test_hierarchies_against_climbing(spark, monkeypatch, seed):
    monkeypatch.setattr(hierarchy, "_GROUP", 5)
    monkeypatch.setattr(hierarchy, "_BLOCK", 7)
    rng = random.Random(seed)
    links = [(rng.randrange(max(1, i - rng.choice([1, 5, 60])), i), i) for i in range(2, 60)] + [(1, 100 + i) for i in range(30)] + [(500 + i, 501 + i) for i in range(40)]
    links += [(900, 901), (901, 902), (902, 900), (902, 903), (903, 904), (950, 950), (950, 951), (None, 7), (3, None)] + links[:5] + [(-5, -6), (-6, -7)]
    df = spark.createDataFrame([(p, c, "a", "b", 1, 2) for p, c in links], LINKS)
    rows = hierarchy.hierarchies(df, "parent", "child").collect()
    want = climb(links)
    assert {r["node"]: (r["root"], r["n_above"], r["path"]) for r in rows} == want
    below = {n: sum(f"/{n}/" in f"/{p[2]}" for p in want.values()) for n in want}
    assert all(r["n_below"] == below[r["node"]] for r in rows if r["path"])
    at = {r["node"]: r for r in rows if r["path"]}
    for a in at.values():
        inside = {b["node"] for b in at.values() if b["root"] == a["root"] and a["entry"] < b["entry"] < a["leave"]}
        assert inside == {n for n, p in want.items() if f"/{a['node']}/" in f"/{p[2]}/" and n != a["node"] and p[2]}
    pairs = {(r[0], r[1]) for r in hierarchy.descendant_pairs(df, "parent", "child").collect()}
    assert pairs == {(int(a), n) for n, p in want.items() if p[2] for a in p[2].split("/")[:-1]}


def descend(links):
    """All paths from roots, and the nodes in or below loops, by walking."""
    kids, nodes = {}, {n for link in links for n in link}
    for p, c in set(links):
        kids.setdefault(p, []).append(c)
    indegree = {n: 0 for n in nodes}
    for _, c in set(links):
        indegree[c] += 1
    todo = [n for n in nodes if not indegree[n]]
    roots = list(todo)
    free = set()
    while todo:
        n = todo.pop()
        free.add(n)
        for c in kids.get(n, ()):
            indegree[c] -= 1
            if not indegree[c]:
                todo.append(c)
    paths, stack = [], [(r,) for r in roots]
    while stack:
        path = stack.pop()
        paths.append(path)
        stack += [(*path, c) for c in kids.get(path[-1], ()) if c in free]
    return paths, nodes - free


@pytest.mark.parametrize("case", ["two", "ladder", "entered loop", "below", "random"])
def test_several_parents_give_several_paths(spark, case):
    rng = random.Random(4)
    links = {
        "two": [(1, 3), (2, 3), (3, 4)],
        "ladder": [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (5, 7), (6, 7), (7, 8), (2, 9)],
        "entered loop": [(1, 5), (5, 6), (6, 5), (1, 2), (6, 7), (2, 7), (8, 8), (3, 8), (8, 9)],
        "below": [(10, 11), (11, 10), (11, 20), (5, 20), (20, 21), (4, 30), (21, 30), (4, 31)],
        "random": [(rng.randrange(40), rng.randrange(20, 60)) for _ in range(60)],
    }[case]
    paths, looped = descend(links)
    df = spark.createDataFrame([(p, c, "a", "b", 1, 2) for p, c in links + links[:2]], LINKS)
    rows = hierarchy.hierarchies(df, "parent", "child").collect()
    want = [(p[-1], p[0], len(p) - 1, "/".join(map(str, p))) for p in paths] + [(n, -1, -1, "") for n in looped]
    assert sorted((r["node"], r["root"], r["n_above"], r["path"]) for r in rows) == sorted(want)
    pairs = [tuple(r) for r in hierarchy.descendant_pairs(df, "parent", "child").collect()]
    assert sorted(pairs) == sorted({(a, p[-1], len(p) - 1 - i) for p in paths for i, a in enumerate(p[:-1])})


def test_peeling_leaves_the_loops(spark):
    links = [(i, i + 1) for i in range(70)] + [(100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (300, 300)] + [(200 + i, 201 + i) for i in range(40)]
    df = spark.createDataFrame(links, "p bigint, c bigint")
    assert {r["node"] for r in hierarchy.loop_nodes(df).collect()} == {100, 101, 102, 300}


def test_hierarchies_of_nothing(spark):
    assert hierarchy.hierarchies(spark.createDataFrame([], LINKS), "parent", "child").count() == 0


def test_orphans_against_brute_force(spark):
    rng = random.Random(6)
    day = lambda n: "2020-01-01 00:00:00" if n is None else f"2020-{1 + n // 28:02d}-{1 + n % 28:02d} 00:00:00"
    states = [(rng.choice([0, 1]), i, rng.random() < 0.3, None if rng.random() < 0.1 else day(rng.randrange(100))) for i in range(-20, 120)]
    refs = [("t", rng.randrange(30), rng.choice([0, 1, 2, None]), rng.choice([None, 33_000 * 5]) if rng.random() < 0.1 else rng.randrange(-25, 140), "2020-01", None if rng.random() < 0.1 else day(rng.randrange(100))) for _ in range(600)]
    sdf = spark.createDataFrame(states, "kind int, id bigint, deleted boolean, first string").withColumn("first", F.to_timestamp("first"))
    rdf = spark.createDataFrame(refs + refs[:50], "src_table string, src_id bigint, mem_type int, ref_id bigint, ym string, loaded string").withColumn("loaded", F.to_timestamp("loaded")).withColumn("kind", F.lit(9))
    known = {(k, i): (d, f) for k, i, d, f in states}
    want = set()
    for t, s, k, r, ym, at in refs:
        if k is None or r is None:
            continue
        d, f = known.get((k, r), (None, None))
        why = "missing" if d is None else "deleted" if d else "late" if f and at and f > at else None
        if why:
            want.add((t, s, k, r, ym, why))
    got = {tuple(r) for r in orphans.orphan_references(rdf, sdf).distinct().collect()}
    assert got == want
    assert orphans.orphan_references(rdf.limit(0), sdf).count() == 0
    assert {r["reason"] for r in orphans.orphan_references(rdf, sdf.limit(0)).collect()} == {"missing"}


@pytest.mark.parametrize("n", [1, 4095, 4096, 4097, 65536])
def test_containers_come_out_as_they_went_in(n):
    rng = np.random.default_rng(n)
    ids = np.r_[rng.choice(65536, n, replace=False) - (5 << 16), [2**62, -(2**62)]]
    kind, period, asked = np.r_[np.zeros(n), [1, 2]].astype(np.int64), np.full(n + 2, 7), np.r_[np.ones(n), [0, 1]].astype(bool)
    batch = orphans.pack(*(np.r_[a, a] for a in (kind, ids, period, asked)))
    assert batch.num_rows == 3 and max(len(x) for x in batch.column("bits").to_pylist()) <= 8192
    for some in (batch, batch.slice(1)):
        got = sorted(zip(*(a.tolist() for a in orphans.unpack(some))))
        heads = set(zip(*(some.column(c).to_pylist() for c in ("kind", "bucket"))))
        assert got == sorted(x for x in zip(kind.tolist(), ids.tolist(), period.tolist(), asked.tolist()) if (x[0], x[1] >> 16) in heads)


def test_orphans_of_a_hot_range_and_of_far_apart_ids(spark, monkeypatch):
    monkeypatch.setattr(orphans, "_HOLD", 100)
    ids = [3] * 900 + list(range(0, 60_000, 7)) + [k << 40 for k in range(1, 300)]
    rdf = spark.createDataFrame([("t", n, 0, i, "2020-01", None) for n, i in enumerate(ids)], "src_table string, src_id bigint, mem_type int, ref_id bigint, ym string, loaded timestamp")
    sdf = spark.createDataFrame([(0, i, False, None) for i in set(ids) if i % 3 == 0], "kind int, id bigint, deleted boolean, first timestamp")
    got = [(r["src_id"], r["ref_id"]) for r in orphans.orphan_references(rdf, sdf).collect()]
    assert sorted(got) == [(n, i) for n, i in enumerate(ids) if i % 3]


CASES = {
    "a;b": ["a", "b"], "a": ["a"], "": [], " ; ,": [], "St. X-1, y": ["St. X-1", "y"], '"a;b";c': ["a;b", "c"], r"a\;b;c": ["a;b", "c"],
    'x "y ""z""";w': ['x y "z"', "w"], '"";a': ["a"], '"open; to the end': ["open; to the end"], r'a\"b;c': ['a"b', "c"], "a\\": ["a"], r"a\;b": ["a;b"],
    "a\uffffb;c\ufffed": ["a", "b", "c", "d"], '"a\uffffb\ufffe";c\uffffd': ["a\uffffb\ufffe", "c", "d"], "a\\\uffff;b\\\ufffe": ["a\uffff", "b\ufffe"], "\\\\;x": ["\\", "x"],
    "é́ü；b、c": ["é́ü", "b", "c"], " a　;b\t c\n": ["a", "b", "c"], '"a""b"': ['a"b'], 'p"q;r"s|t': ["pq;rs", "t"],
}


def test_packed_items(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "v string")
    assert {r[0]: r[1] for r in df.select("v", multivalue.packed_items(F.col("v"))).collect()} == CASES
    assert spark.createDataFrame([(None,)], "v string").select(multivalue.packed_items(F.col("v"))).first()[0] is None


def test_split_list_values(spark):
    rows = [(1, ["a", "b"], ["x;y", "x;y"]), (2, ["a"], None), (3, None, ["x;y"]), (4, ["a", None, "a"], [None, "x;y", "p,,q"]), (5, ["a"], ["one"]), (6, ["A"], ["x;y"]), (7, ["a"], ['"x;y"']), (8, ["a"], ["w;" * 5000 + "w"])]
    df = spark.createDataFrame(rows + rows[:1], "seq bigint, ks array<string>, vs array<string>").withColumn("k", F.lit(0)).withColumn("items", F.lit(0))
    keys = spark.createDataFrame([("a",), ("a",), (None,)], "tag string")
    got = sorted(tuple(r) for r in multivalue.split_list_values(df, "seq", "ks", "vs", keys, "tag").where("seq < 8").collect())
    assert got == sorted([(1, 1, 1, "x"), (1, 1, 2, "y")] * 2 + [(4, 3, 1, "p"), (4, 3, 2, "q")])
    assert multivalue.split_list_values(df, "seq", "ks", "vs", keys, "tag").where("seq = 8").count() == 5001
    assert multivalue.split_list_values(df.limit(0), "seq", "ks", "vs", keys, "tag").count() == 0
