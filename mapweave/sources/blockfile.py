"""Block files of map elements: the public PBF format with quadtrees, dates, changes and geometries as extensions.

Elements are plain dicts here, with the keys of ``SCHEMA``. A block's elements are read and written whole; a file is a
run of framed blocks, the first being the header, which may hold an index of the others.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import BinaryIO

from pyarrow import fs

from mapweave.sources.wire import fields, message, packed, packed_deltas, signed, unpacked, unpacked_deltas, unzigzag, zigzag

SCHEMA = (
    "block_idx int, tile bigint, start_date bigint, end_date bigint, kind tinyint, id bigint, change tinyint, qt bigint, version bigint, ts bigint, changeset bigint, uid bigint, "
    "user string, visible boolean, tags array<struct<k:string,v:string>>, lon bigint, lat bigint, refs array<bigint>, lons array<bigint>, lats array<bigint>, "
    "members array<struct<type:tinyint,ref:bigint,role:string>>, geom binary"
)
COLUMNS = [c.split()[0] for c in SCHEMA.replace("array<struct<k:string,v:string>>", "x").replace("members array<struct<type:tinyint,ref:bigint,role:string>>", "members x").split(", ")]
INFO = ("version", "ts", "changeset", "uid", "user", "visible")

NODE, WAY, RELATION, GEOMETRY = range(4)


@dataclass
class Frame:
    kind: str  # OSMHeader, OSMData, OSMChange
    at: int
    length: int
    blob: bytes

    def data(self) -> bytes:
        got = dict(fields(self.blob))
        return got[1] if 1 in got else zlib.decompress(got[3])


def read_frames(f: BinaryIO, start: int = 0, end: int | None = None) -> Iterator[Frame]:
    """Framed blocks that begin in [start, end); ``start`` must be the beginning of one."""
    f.seek(start)
    at = start
    while end is None or at < end:
        size = f.read(4)
        if len(size) < 4:
            return
        n = struct.unpack(">I", size)[0]
        head = dict(fields(f.read(n)))
        blob = f.read(head[3])
        if len(blob) < head[3]:
            raise ValueError(f"the block at {at} is cut off")
        yield Frame(head[1].decode(), at, 4 + n + head[3], blob)
        at += 4 + n + head[3]


def frame_offsets(f: BinaryIO) -> list[tuple[int, str, int]]:
    """(offset, kind, length) of every block, skipping over what they hold."""
    out, at = [], 0
    while True:
        f.seek(at)
        size = f.read(4)
        if len(size) < 4:
            return out
        n = struct.unpack(">I", size)[0]
        head = dict(fields(f.read(n)))
        length = 4 + n + head[3]
        out.append((at, head[1].decode(), length))
        at += length


def frame(kind: str, data: bytes, compress: bool = True) -> bytes:
    blob = message((2, len(data)), (3, zlib.compress(data))) if compress else message((1, data))
    head = message((1, kind), (3, len(blob)))
    return struct.pack(">I", len(head)) + head + blob


def tile_tuple(q: int) -> tuple[int, int, int]:
    if q == -1:
        return -1, -1, -1
    z, x, y = q & 31, 0, 0
    for i in range(z):
        step = q >> 61 - 2 * i & 3
        x, y = x << 1 | step & 1, y << 1 | step >> 1
    return x, y, z


def tuple_tile(x: int, y: int, z: int) -> int:
    if z < 0:
        return -1
    path = sum((x >> i & 1 | (y >> i & 1) << 1) << 2 * i for i in range(z))
    return path << 63 - 2 * z | z if z else 0


def _pack_tile(q: int) -> bytes:
    return message(*((i, v & (1 << 64) - 1) for i, v in enumerate(tile_tuple(q), 1)))


def _unpack_tile(buf: bytes) -> int:
    got = dict(fields(buf))
    return tuple_tile(*(signed(got.get(i, 0)) for i in (1, 2, 3)))


@dataclass
class IndexEntry:
    tile: int
    length: int
    is_change: bool
    filepos: int = 0


@dataclass
class Header:
    box: tuple[int, int, int, int] | None = None
    required: list[str] = field(default_factory=lambda: ["OsmSchema-V0.6", "DenseNodes"])
    optional: list[str] = field(default_factory=list)
    program: str = "mapweave"
    source: str | None = None
    index: list[IndexEntry] = field(default_factory=list)
    timestamp: int | None = None

    def pack(self) -> bytes:
        box = None
        if self.box:
            x0, y0, x1, y1 = (v * 100 for v in self.box)  # 1e-9 degree: left, right, top, bottom
            box = message((1, zigzag(x0)), (2, zigzag(x1)), (3, zigzag(y1)), (4, zigzag(y0)))
        index = [(22, message((1, _pack_tile(e.tile)), (2, int(e.is_change)), (3, zigzag(e.length)))) for e in self.index]
        return message((1, box), *((4, r) for r in self.required), *((5, o) for o in self.optional), (16, self.program), (17, self.source), *index, (32, self.timestamp))

    @staticmethod
    def unpack(data: bytes, end_of_header: int) -> Header:
        out, at = Header(required=[], program=""), end_of_header
        for n, v in fields(data):
            if n == 1:
                b = {k: unzigzag(x) // 100 for k, x in fields(v)}
                out.box = b.get(1, 0), b.get(4, 0), b.get(2, 0), b.get(3, 0)
            elif n in (4, 5):
                (out.required if n == 4 else out.optional).append(v.decode())
            elif n == 16:
                out.program = v.decode()
            elif n == 17:
                out.source = v.decode()
            elif n == 22:
                e = dict(fields(v))
                out.index.append(IndexEntry(_unpack_tile(e[1]) if 1 in e else -1, unzigzag(e.get(3, 0)), e.get(2) == 1, at))
                at += out.index[-1].length
            elif n == 32:
                out.timestamp = v
        return out


def read_header(f: BinaryIO) -> Header:
    first = next(read_frames(f))
    if first.kind != "OSMHeader":
        raise ValueError("the file does not begin with a header")
    return Header.unpack(first.data(), first.length)


# Blocks of elements.


def _info(buf: bytes, strings: list[str]) -> dict:
    got = dict(fields(buf))
    return {"version": signed(got.get(1, 0)), "ts": signed(got.get(2, 0)), "changeset": signed(got.get(3, 0)), "uid": signed(got.get(4, 0)), "user": strings[got.get(5, 0)], "visible": got.get(6, 1) == 1}


def _dense_info(buf: bytes, strings: list[str]) -> list[dict]:
    got = dict(fields(buf))
    versions = unpacked(got.get(1, b""))
    deltas = [unpacked_deltas(got.get(i, b"")) for i in (2, 3, 4, 5)]
    visible = unpacked(got.get(6, b"")) or [1] * len(versions)
    return [{"version": v, "ts": t, "changeset": c, "uid": u, "user": strings[s], "visible": bool(x)} for v, t, c, u, s, x in zip(versions, *deltas, visible)]


def _tags(keys: bytes, values: bytes, strings: list[str]) -> list[dict]:
    return [{"k": strings[k], "v": strings[v]} for k, v in zip(unpacked(keys), unpacked(values))]


# Columns that cost something to decode, and what else asks for them.
_COSTLY = {"tags": {"tags"}, "info": {"version", "ts", "changeset", "uid", "user", "visible"}, "refs": {"refs"}, "lons": {"lons", "lats"}, "members": {"members"}, "geom": {"geom"}, "place": {"lon", "lat"}, "qt": {"qt"}}


def wanted_parts(columns: Iterable[str] | None) -> frozenset[str]:
    """The parts of elements to decode for these columns; all without any given."""
    return frozenset(_COSTLY) if columns is None else frozenset(k for k, of in _COSTLY.items() if of & set(columns))


_ALL = wanted_parts(None)


def _single(kind: int, buf: bytes, strings: list[str], change: int, want: frozenset[str] = _ALL) -> dict:
    got = dict(fields(buf))
    number = got.get(1, 0)
    out = {"kind": kind, "id": unzigzag(number) if kind == NODE else signed(number), "change": change}
    if "tags" in want:
        out["tags"] = _tags(got.get(2, b""), got.get(3, b""), strings)
    if 4 in got and "info" in want:
        out |= _info(got[4], strings)
    if "qt" in want:
        out["qt"] = unzigzag(got[20]) if 20 in got else _unpack_tile(got[21]) if 21 in got else -1
    if kind == NODE:
        out["lat"], out["lon"] = unzigzag(got.get(8, 0)), unzigzag(got.get(9, 0))
    elif kind == WAY:
        if "refs" in want:
            out["refs"] = unpacked_deltas(got.get(8, b""))
        if 12 in got and "lons" in want:
            out["lons"], out["lats"] = unpacked_deltas(got[12]), unpacked_deltas(got.get(13, b""))
    elif kind == RELATION and "members" in want:
        roles, refs, types = unpacked(got.get(8, b"")), unpacked_deltas(got.get(9, b"")), unpacked(got.get(10, b""))
        out["members"] = [{"type": t, "ref": r, "role": strings[s]} for t, r, s in zip(types, refs, roles)]
    elif kind == GEOMETRY:
        out["geom"] = got.get(8, b"")
    return out


def _dense(buf: bytes, strings: list[str], change: int, want: frozenset[str] = _ALL) -> Iterator[dict]:
    got = dict(fields(buf))
    ids = unpacked_deltas(got.get(1, b""))
    lats, lons = (unpacked_deltas(got.get(i, b"")) if "place" in want else [None] * len(ids) for i in (8, 9))
    infos = _dense_info(got[5], strings) if 5 in got and "info" in want else []
    pairs = unpacked(got.get(10, b"")) if "tags" in want else []
    if "qt" not in want:
        tiles = []
    elif 20 in got:
        tiles = unpacked_deltas(got[20])
    else:
        tiles = [tuple_tile(*t) for t in zip(*(unpacked_deltas(got.get(i, b"")) for i in (21, 22, 23)))]
    p = 0
    for i, number in enumerate(ids):
        tags = []
        while p < len(pairs) and pairs[p]:
            tags.append({"k": strings[pairs[p]], "v": strings[pairs[p + 1]]})
            p += 2
        p += 1
        yield {"kind": NODE, "id": number, "change": change, "lon": lons[i], "lat": lats[i], "tags": tags, "qt": tiles[i] if i < len(tiles) else -1} | (infos[i] if i < len(infos) else {})


def read_block(data: bytes, is_change: bool = False, kinds: Iterable[int] = (NODE, WAY, RELATION, GEOMETRY), columns: Iterable[str] | None = None) -> tuple[dict, list[dict]]:
    """A block's own values (tile, start_date, end_date, block_tags) and its elements, of the given kinds only.

    With ``columns`` only what these need is decoded.
    """
    want = wanted_parts(columns)
    strings, groups, block = [], [], {"tile": -1, "start_date": 0, "end_date": 0, "block_tags": []}
    keys = values = b""
    for n, v in fields(data):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 31:
            block["tile"] = _unpack_tile(v)
        elif n in (33, 34):
            block["start_date" if n == 33 else "end_date"] = v
        elif n == 35:
            keys = v
        elif n == 36:
            values = v
    block["block_tags"] = _tags(keys, values, strings)
    wanted, out = set(kinds), []
    of = {1: NODE, 3: WAY, 4: RELATION, 20: GEOMETRY}
    for group in groups:
        parts = list(fields(group))
        change = next((v for n, v in parts if n == 10), 0) if is_change else 0
        for n, v in parts:
            if n == 2 and NODE in wanted:
                out += _dense(v, strings, change, want)
            elif n in of and of[n] in wanted:
                out.append(_single(of[n], v, strings, change, want))
    return block, out


class _Strings:
    def __init__(self) -> None:
        self.at: dict[str, int] = {"": 0}

    def __call__(self, s: str | None) -> int:
        return self.at.setdefault(s or "", len(self.at))

    def pack(self) -> bytes:
        return message(*((1, s) for s in self.at))


def _pack_dense(nodes: list[dict], put: _Strings, extra: bool, qt_tuple: bool) -> bytes:
    pairs = []
    for e in nodes:
        for t in e.get("tags") or ():
            pairs += [put(t["k"]), put(t["v"])]
        pairs.append(0)
    info = None
    if all(e.get("version") is not None for e in nodes):
        cols = [[e.get(k) or 0 for e in nodes] for k in ("ts", "changeset", "uid")] + [[put(e.get("user")) for e in nodes]]
        visible = [int(e.get("visible") is not False) for e in nodes]
        info = message((1, packed(e["version"] for e in nodes)), *((i, packed_deltas(c)) for i, c in enumerate(cols, 2)), (6, packed(visible) if not all(visible) else None))
    tiles = [e["qt"] if e.get("qt") is not None else -1 for e in nodes]
    ext: list[tuple[int, bytes]] = []
    if extra and qt_tuple:
        ext = [(21 + i, packed_deltas(c)) for i, c in enumerate(zip(*map(tile_tuple, tiles)))]
    elif extra:
        ext = [(20, packed_deltas(tiles))]
    return message((1, packed_deltas(e["id"] for e in nodes)), (5, info), (8, packed_deltas(e.get("lat") or 0 for e in nodes)), (9, packed_deltas(e.get("lon") or 0 for e in nodes)), (10, packed(pairs)), *ext)


def _pack_single(e: dict, put: _Strings, extra: bool, qt_tuple: bool) -> bytes:
    tags = e.get("tags") or []
    info = None
    if e.get("version") is not None:
        info = message((1, e["version"]), (2, e.get("ts") or 0), (3, e.get("changeset") or 0), (4, e.get("uid") or 0), (5, put(e.get("user"))), (6, 0 if e.get("visible") is False else None))
    own: list[tuple[int, bytes | None]] = []
    if e["kind"] == WAY:
        own = [(8, packed_deltas(e.get("refs") or ()))]
        if extra and e.get("lons"):
            own += [(12, packed_deltas(e["lons"])), (13, packed_deltas(e["lats"]))]
    elif e["kind"] == RELATION:
        members = e.get("members") or []
        own = [(8, packed(put(m["role"]) for m in members)), (9, packed_deltas(m["ref"] for m in members)), (10, packed(m["type"] for m in members))]
    else:
        own = [(8, bytes(e.get("geom") or b""))]
    q = e["qt"] if e.get("qt") is not None else -1
    tile = (21, _pack_tile(q)) if qt_tuple else (20, zigzag(q))
    return message((1, e["id"]), (2, packed(put(t["k"]) for t in tags)), (3, packed(put(t["v"]) for t in tags)), (4, info), *own, *([tile] if extra else []))


def write_block(elements: list[dict], tile: int = -1, start_date: int = 0, end_date: int = 0, block_tags: Iterable[dict] = (), is_change: bool = False, extra: bool = True, qt_tuple: bool = False) -> bytes:
    """A block of elements, a group for each run of the same change and kind. Null texts are written as empty ones."""
    put, groups = _Strings(), []
    for (change, kind), run in groupby(elements, key=lambda e: (e.get("change") or 0 if is_change else 0, e["kind"])):
        rows = list(run)
        if kind == NODE:
            body = message((2, _pack_dense(rows, put, extra, qt_tuple)))
        else:
            body = message(*(({WAY: 3, RELATION: 4, GEOMETRY: 20}[kind], _pack_single(e, put, extra, qt_tuple)) for e in rows))
        groups.append(body + (message((10, change)) if is_change else b""))
    tags = [(put(t["k"]), put(t["v"])) for t in block_tags]
    ext: list[tuple[int, int | bytes | None]] = []
    if extra:
        ext = [(31, _pack_tile(tile)), (33, start_date or None), (34, end_date or None)]
        if tags:
            ext += [(35, packed(k for k, _ in tags)), (36, packed(v for _, v in tags))]
    return message((1, put.pack()), *((2, g) for g in groups), *ext)


def write_file(path: str, blocks: Iterable[tuple[int, bool, bytes]], header: Header | None = None, indexed: bool = True) -> None:
    """A file of framed blocks given as (tile, is_change, frame bytes), behind a header that indexes them if asked to.

    The blocks go to a file of their own first, as the header with their lengths comes before them. ``path`` may be on
    any file system that pyarrow can open.
    """
    header = header or Header()
    where, inner = place(path)
    body = inner + ".body"
    with where.open_output_stream(body) as f:
        for tile, is_change, data in blocks:
            f.write(data)
            if indexed:
                header.index.append(IndexEntry(tile, len(data), is_change))
    with where.open_output_stream(inner + ".part") as out, where.open_input_stream(body) as f:
        out.write(frame("OSMHeader", header.pack()))
        while piece := f.read(1 << 20):
            out.write(piece)
    where.move(inner + ".part", inner)
    where.delete_file(body)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a path or URI."""
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else os.path.abspath(path))


def open_file(path: str) -> BinaryIO:
    where, inner = place(path)
    return where.open_input_file(inner)
