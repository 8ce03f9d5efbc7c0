"""Spark data sources: ``mapblocks`` (block files), ``mapblocks_index`` (their headers' index) and ``osmchange`` (change XML).

``register(spark)`` makes them known to ``spark.read.format`` and, for block files, ``df.write.format``.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from mapweave.sources import blockfile, changexml


def _files(path: str) -> list[str]:
    """Files of a path or URI: a file, the files of a folder, or those of a pattern in the last part of the path."""
    where, inner = blockfile.place(path)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) and ":" in path else ""
    info = where.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [scheme + inner]
    folder, pattern = (inner, "*") if info.type == fs.FileType.Directory else os.path.split(inner)
    found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    names = sorted(i.path for i in found if i.type == fs.FileType.File and fnmatch(i.base_name, pattern) and not i.base_name.startswith((".", "_")))
    if not names:
        raise FileNotFoundError(path)
    return [scheme + n for n in names]


@dataclass
class _Blocks(InputPartition):
    path: str
    places: list[tuple[int, int, str]]  # offset, block number, kind

    def __init__(self, path, places):
        super().__init__((path, tuple(places)))
        self.path, self.places = path, places


class BlockReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.tiles: set[int] | None = None
        self.low, self.high = None, None

    def pushFilters(self, filters: list[Filter]):
        """Filters on ``tile`` pick blocks by the header's index, so other blocks are not even read."""
        for f in filters:
            if f.attribute == ("tile",) and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tiles = values if self.tiles is None else self.tiles & values
            elif f.attribute == ("tile",) and isinstance(f, GreaterThanOrEqual):
                self.low = f.value if self.low is None else max(self.low, f.value)
            elif f.attribute == ("tile",) and isinstance(f, LessThanOrEqual):
                self.high = f.value if self.high is None else min(self.high, f.value)
            yield f  # kept: a file without an index is read whole

    def _wanted(self, tile: int) -> bool:
        return (self.tiles is None or tile in self.tiles) and (self.low is None or tile >= self.low) and (self.high is None or tile <= self.high)

    def partitions(self):
        per_task = int(self.options.get("blocksPerPartition", 64))
        offsets = self.options.get("offsets")
        picked = {int(o) for o in offsets.split(",")} if offsets else None
        out = []
        for path in _files(self.options["path"]):
            with blockfile.open_file(path) as f:
                header = blockfile.read_header(f)
                if header.index:
                    every = [(e.filepos, i, "OSMChange" if e.is_change else "OSMData", e.tile) for i, e in enumerate(header.index)]
                    places = [(at, i, kind) for at, i, kind, tile in every if self._wanted(tile)]
                else:
                    every = [x for x in blockfile.frame_offsets(f) if x[1] != "OSMHeader"]
                    places = [(at, i, kind) for i, (at, kind, _) in enumerate(every)]
            if picked is not None:
                places = [p for p in places if p[0] in picked]
            out += [_Blocks(path, places[i : i + per_task]) for i in range(0, len(places), per_task)]
        return out or [_Blocks("", [])]

    def read(self, partition) -> Iterator[tuple]:
        names = self.schema.names
        kinds = [k for k, n in enumerate(("nodes", "ways", "relations", "geometries")) if str(self.options.get(n, "true")).lower() != "false"]
        if not partition.places:
            return
        with blockfile.open_file(partition.path) as f:
            for at, number, kind in partition.places:
                frame = next(blockfile.read_frames(f, at))
                if frame.kind not in ("OSMData", "OSMChange"):
                    continue
                is_change = frame.kind == "OSMChange" or partition.path.endswith(".pbfc") or str(self.options.get("change", "false")).lower() == "true"
                block, elements = blockfile.read_block(frame.data(), is_change, kinds, names)
                block["block_idx"] = number
                for e in elements:
                    row = block | e
                    yield tuple(row.get(n) for n in names)


@dataclass
class _Part(WriterCommitMessage):
    path: str
    index: list[tuple[int, bool, int]]
    first: tuple


class BlockWriter(DataSourceWriter):
    """Each task writes its blocks to a part file.

    Rows come sorted by tile (or block), kind and id: repartition by range and sort before writing. Options: ``path``,
    ``change``, ``tuple`` (quadtrees as x, y, z), ``plain`` (no extensions), ``indexed``, ``blockSize``, ``parts``. With
    ``parts`` the path is a folder and every task's file a whole one with a header of its own, named by the task, so
    that nothing goes through the driver: the way to write anything large. Without, commit puts the parts behind one
    header, in tile order: the driver copies them, and one file comes out.
    """

    def __init__(self, schema: StructType, options: dict):
        self.names, self.options = schema.names, options
        self.path = options["path"].rstrip("/")

    def _on(self, key: str, default: str = "false") -> bool:
        return str(self.options.get(key, default)).lower() == "true"

    def write(self, iterator) -> _Part:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        part = f"{self.path}/_{name}.body" if self._on("parts") else f"{self.path}.{name}"
        where, inner = blockfile.place(part)
        where.create_dir(os.path.dirname(inner), recursive=True)
        size, change = int(self.options.get("blockSize", 8000)), self._on("change")
        index, first, rows, tile = [], (1, 0), [], None

        def flush(f):
            if not rows:
                return
            data = blockfile.write_block(rows, tile if tile is not None else -1, rows[0].get("start_date") or 0, rows[0].get("end_date") or 0, (), change, not self._on("plain"), self._on("tuple"))
            data = blockfile.frame("OSMChange" if change else "OSMData", data)
            f.write(data)
            index.append((tile if tile is not None else -1, change, len(data)))
            rows.clear()

        with where.open_output_stream(inner) as f:
            for r in iterator:
                e = dict(zip(self.names, r))
                e["tags"] = [t.asDict() for t in e.get("tags") or ()]
                if e.get("members"):
                    e["members"] = [m.asDict() for m in e["members"]]
                if rows and (e.get("tile") != tile or len(rows) >= size):
                    flush(f)
                tile = e.get("tile")
                if first == (1, 0):
                    first = (0, tile if tile is not None else -1)
                rows.append(e)
            flush(f)
        if self._on("parts"):
            # Named so that it does not count before the commit.
            whole = f"{self.path}/_{name}.pbf"
            if index:
                blockfile.write_file(whole, self._blocks([_Part(part, index, first)]), indexed=self._on("indexed", "true"))
            where.delete_file(inner)
            return _Part(whole if index else "", index, first)
        return _Part(part, index, first)

    @staticmethod
    def _blocks(parts: list[_Part]) -> Iterator[tuple[int, bool, bytes]]:
        for p in parts:
            with blockfile.open_file(p.path) as f:
                for tile, change, length in p.index:
                    yield tile, change, f.read(length)

    def commit(self, messages) -> None:
        parts = sorted((m for m in messages if m is not None and m.path), key=lambda m: (m.first, m.path))
        if self._on("parts"):
            for p in parts:
                where, inner = blockfile.place(p.path)
                where.move(inner, inner.replace("/_part-", "/part-"))
            return
        blockfile.write_file(self.path, self._blocks(parts), indexed=self._on("indexed", "true"))
        self.abort(parts)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.path:
                where, inner = blockfile.place(m.path)
                if where.get_file_info(inner).type == fs.FileType.File:
                    where.delete_file(inner)


class BlockSource(DataSource):
    """Elements of block files. ``path`` is a file, a folder or a pattern, plain or a URI.

    Options of reading: ``columns``, a list with commas of the columns there should be, all others are not decoded;
    ``offsets`` of the blocks to read; ``nodes``, ``ways``, ``relations``, ``geometries`` as false to leave them out;
    ``change`` for files of changes whose blocks do not say so; ``blocksPerPartition``. See also the writer's options.
    """

    @classmethod
    def name(cls) -> str:
        return "mapblocks"

    def schema(self) -> str:
        picked = self.options.get("columns")
        if not picked:
            return blockfile.SCHEMA
        # Each column with its type: the commas between columns are followed by a blank, those within types are not.
        every = {c.split()[0]: c for c in blockfile.SCHEMA.split(", ")}
        return ", ".join(every[c.strip()] for c in picked.split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlockReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BlockWriter(schema, dict(self.options))


class IndexReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(f) for f in _files(self.options["path"])]

    def read(self, partition) -> Iterator[tuple]:
        with blockfile.open_file(partition.value) as f:
            for e in blockfile.read_header(f).index:
                yield partition.value, e.tile, e.filepos, e.length, e.is_change


class IndexSource(DataSource):
    """The block index of block files' headers."""

    @classmethod
    def name(cls) -> str:
        return "mapblocks_index"

    def schema(self) -> str:
        return "file string, tile bigint, filepos bigint, length bigint, is_change boolean"

    def reader(self, schema: StructType) -> DataSourceReader:
        return IndexReader(dict(self.options))


class ChangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition((i, f)) for i, f in enumerate(_files(self.options["path"]))]

    def read(self, partition) -> Iterator[tuple]:
        file_idx, path = partition.value
        with blockfile.open_file(path) as raw:
            for seq, e in enumerate(changexml.read(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)):
                yield (file_idx, seq, *(e.get(c) for c in changexml.COLUMNS))


class ChangeSource(DataSource):
    """Elements of change XML files, plain or gzipped, with their place in the file as ``seq``."""

    @classmethod
    def name(cls) -> str:
        return "osmchange"

    def schema(self) -> str:
        return changexml.SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChangeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the sources known; filters on ``tile`` are pushed to them, which the session must allow."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (BlockSource, IndexSource, ChangeSource):
        spark.dataSource.register(source)
