"""A change feed kept as sorted runs and merged on read: a log-structured merge store in the shared folder.

``append`` writes a run: the last change per key, hashed to the store's buckets and sorted by key, one file per bucket.
``merged`` merges all runs on read, one task per bucket: the buckets' files are streamed side by side, and what is read
is always the piece up to the least key at which one of them needs more rows, so a task holds a batch of each run,
nothing is shuffled and nothing sorted but these pieces. Tombstones are rows like others and decide until they meet
what lies below. Every ``fan_in`` runs of one level are compacted into one of the next by the same merge. A manifest in
the store's folder says which runs count, so a store can be opened again, and a run that was not finished is no part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.operators.current import current_rows
from mapweave.session import fresh_path

_KEY = ["object_type", "id"]
_ORDER = ["vs", "ts", "seq", "dead"]
_SCHEMA = "object_type int, id bigint, vs bigint, ts bigint, seq bigint, dead boolean, fresh boolean"
_ROWS = pa.schema([("object_type", pa.int32()), ("id", pa.int64()), ("vs", pa.int64()), ("ts", pa.int64()), ("seq", pa.int64()), ("dead", pa.bool_()), ("fresh", pa.bool_())])
_BATCH = 1 << 16  # rows of one run that a merging task reads at a time
_LOWEST = np.iinfo(np.int64).min


def _last(rows: DataFrame, *more: str) -> DataFrame:
    """The deciding row per key: highest vs, then ts, then seq. ``fresh`` tells whether any change took part."""
    best = rows.groupBy(*more, *_KEY).agg(F.max(F.struct(*_ORDER)).alias("r"), F.max("fresh").alias("fresh"))
    return best.select(*more, *_KEY, "r.vs", "r.ts", "r.seq", "r.dead", "fresh")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Head:
    """The rows of one sorted stream that have been read but not taken."""

    def __init__(self, batches: Iterable[pa.RecordBatch]):
        self.batches, self.rows = iter(batches), None

    def fill(self) -> bool:
        while self.rows is None or not self.rows.num_rows:
            self.rows = next(self.batches, None)
            if self.rows is None:
                return False
            self.kind, self.id = (self.rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _KEY)
        return True

    def last(self) -> tuple[int, int]:
        return int(self.kind[-1]), int(self.id[-1])

    def take(self, bound: tuple[int, int]) -> pa.RecordBatch:
        """The rows up to the key ``bound``."""
        n = int(np.count_nonzero((self.kind < bound[0]) | ((self.kind == bound[0]) & (self.id <= bound[1]))))
        out, self.rows, self.kind, self.id = self.rows.slice(0, n), self.rows.slice(n), self.kind[n:], self.id[n:]
        return out


def _deciding(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The deciding row of each key of a piece that holds all rows of its keys."""
    keys = [rows.column(c).fill_null(_LOWEST if c not in ("dead", "object_type") else False if c == "dead" else -1).to_numpy() for c in (*_KEY, *_ORDER)]
    order = np.lexsort(keys[::-1])
    kind, id_ = keys[0][order], keys[1][order]
    first = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (id_[1:] != id_[:-1])])
    fresh = np.maximum.reduceat(rows.column("fresh").to_numpy()[order], first)
    best = rows.take(pa.array(order[np.r_[first[1:], len(order)] - 1]))
    yield from best.set_column(best.schema.get_field_index("fresh"), "fresh", pa.array(fresh)).combine_chunks().to_batches()


def merge_sorted(streams: Iterable[Iterable[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """K-way merge of streams of batches sorted by key: the deciding row of each key, in key order.

    Up to the least of the keys that the buffered pieces end with, every stream has all its rows in its buffer.
    """
    heads = [h for h in map(_Head, streams) if h.fill()]
    while heads:
        bound = min(h.last() for h in heads)
        yield from _deciding(pa.Table.from_batches([h.take(bound) for h in heads]))
        heads = [h for h in heads if h.fill()]


def _stream(path: str) -> Iterator[pa.RecordBatch]:
    where, inner = _place(path)
    with where.open_input_file(inner) as f:
        for b in pq.ParquetFile(f).iter_batches(_BATCH, columns=_ROWS.names):
            yield pa.RecordBatch.from_arrays([b.column(c) for c in _ROWS.names], schema=_ROWS)


class SortedRuns:
    """See the module. Rows: object_type, id, vs, ts, seq, dead (a tombstone), fresh (false for base rows).

    ``path`` is a folder that all executors see, on a file system pyarrow can open (file, hdfs, s3, gs); it may be that
    of an existing store, whose ``fan_in`` and buckets then hold. One process at a time may write to a store. A new
    store has as many buckets as the session has shuffle partitions: each is merged by one task.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = 4, buckets: int | None = None):
        self.spark, self.path = spark, path or fresh_path(spark, "runs")
        self._fs, self._root = _place(self.path)
        self.state = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "fan_in": fan_in, "batch": -1, "runs": []}
        if self._fs.get_file_info(self._manifest()).type == fs.FileType.File:
            with self._fs.open_input_stream(self._manifest()) as f:
                self.state = json.loads(f.readall())

    def _manifest(self) -> str:
        return f"{self._root}/manifest.json"

    def _commit(self) -> None:
        self._fs.create_dir(self._root, recursive=True)
        new = f"{self._manifest()}.{uuid.uuid4().hex}"
        with self._fs.open_output_stream(new) as f:
            f.write(json.dumps(self.state).encode())
        self._fs.move(new, self._manifest())

    @property
    def runs(self) -> list[str]:
        return [f"{self.path}/{name}" for name, _ in self.state["runs"]]

    def _new_run(self) -> str:
        return f"run-{uuid.uuid4().hex}"

    def append(self, rows: DataFrame, run_of: Column | None = None, batch: int | None = None) -> None:
        """Adds ``rows`` as a run or, with ``run_of`` (an integer; null is 0), as several in its order, in one pass.

        A ``batch`` with a number that the store has seen already is passed over.
        """
        if batch is not None and batch <= self.state["batch"]:
            return
        name = self._new_run()
        split = rows.withColumn("run__", F.lit(0) if run_of is None else F.coalesce(run_of, F.lit(0)).cast("int"))
        run = _last(split, "run__").repartition(self.state["buckets"], *_KEY).sortWithinPartitions("run__", *_KEY)
        run.write.partitionBy("run__").parquet(f"{self.path}/{name}")
        parts = [i.base_name for i in self._fs.get_file_info(fs.FileSelector(f"{self._root}/{name}")) if i.base_name.startswith("run__=")]
        self.state["runs"] += [[f"{name}/{p}", 0] for p in sorted(parts, key=lambda p: int(p.removeprefix("run__=")))]
        if batch is not None:
            self.state["batch"] = batch
        self._commit()
        self.compact()

    def compact(self) -> None:
        """Merges every ``fan_in`` runs of a level into one of the next level, until no level has so many."""
        while True:
            levels: dict[int, list[str]] = {}
            for name, level in self.state["runs"]:
                levels.setdefault(level, []).append(name)
            full = [(k, names[: self.state["fan_in"]]) for k, names in sorted(levels.items()) if len(names) >= max(2, self.state["fan_in"])]
            if not full:
                return
            level, old = full[0]
            name = self._new_run()
            # The merge's tasks are the buckets in order, so the run's files are those of its buckets again.
            self._merged(old).write.parquet(f"{self.path}/{name}")
            left = [r for r in self.state["runs"] if r[0] not in old]
            at = sum(1 for r in left if r[1] > level)
            self.state["runs"] = [*left[:at], [name, level + 1], *left[at:]]
            self._commit()
            for gone in old:
                self._fs.delete_dir(f"{self._root}/{gone}")

    def scan(self, *columns: str) -> DataFrame:
        """The runs' rows as they are, unmerged."""
        rows = self.spark.read.schema(_SCHEMA).parquet(*self.runs) if self.runs else self.spark.createDataFrame([], _SCHEMA)
        return rows.select(*columns) if columns else rows

    def _files(self, runs: list[str]) -> dict[int, list[str]]:
        """Files per bucket: a run's file of bucket i is that of the writing task i."""
        scheme = self.path[: len(self.path) - len(self._root)] if self.path.endswith(self._root) else ""
        out: dict[int, list[str]] = {}
        for run in runs:
            for info in self._fs.get_file_info(fs.FileSelector(f"{self._root}/{run}")):
                if info.base_name.startswith("part-"):
                    out.setdefault(int(info.base_name.split("-")[1]), []).append(scheme + info.path)
        return out

    def _merged(self, runs: list[str]) -> DataFrame:
        # One path per bucket and run is what is sent out: bounded by the store's buckets, whatever it holds.
        files = self.spark.sparkContext.broadcast(self._files(runs))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket in batch.column(0).to_pylist():
                    yield from merge_sorted(map(_stream, files.value.get(bucket, ())))

        n = self.state["buckets"]
        return self.spark.range(0, n, 1, n).mapInArrow(merge, _SCHEMA)

    def merged(self) -> DataFrame:
        """The deciding row of every key, tombstones included, merged from all runs."""
        return self._merged([name for name, _ in self.state["runs"]])


def change_rows(changes: DataFrame, *more: str) -> DataFrame:
    """Feed rows with a usable version (``vs`` >= 1) and a key, in the store's form, and columns ``more``.

    A null ``ts`` or ``seq`` sorts before any other. Only change type 1 is a delete; a null type is none.
    """
    usable = changes.where((F.col("vs") >= 1) & F.col("id").isNotNull() & F.col("object_type").isNotNull())
    dead = F.coalesce(F.col("change_type") == 1, F.lit(False))
    return usable.select(F.col("object_type").cast("int").alias("object_type"), F.col("id").cast("bigint").alias("id"), F.col("vs").cast("bigint").alias("vs"), F.col("ts").cast("bigint").alias("ts"), F.col("seq").cast("bigint").alias("seq"), dead.alias("dead"), F.lit(True).alias("fresh"), *more)


def apply_changes(changes: DataFrame, base: dict[int, DataFrame], run_of: Column | None = None, n_runs: int = 6) -> DataFrame:
    """The elements touched by the feed that live after all of it: ``object_type, id, vs``.

    ``changes`` needs ``change_type, object_type, id, vs, ts, seq``; ``base`` maps an object type to its base table
    (``id, vs, ts, visible``). Repeated and out-of-order changes do not matter: what decides is the highest vs, then
    the latest ts, then the highest seq, a base row coming before all changes of its vs and ts. The element lives
    unless a delete or a deleted base row decides. ``run_of`` gives the run (0 to n_runs - 1) that a change arrived
    in; null goes to run 0. Empty inputs are fine; without changes the result is empty.

    The feed is read once, whatever the number of runs, and shuffles one row per key, run and task. Base tables are read
    in narrow columns, cut down to touched keys, combined before the shuffle, and become the run at the bottom of the
    log; the result is the merge of the log's runs.
    """
    store = SortedRuns(changes.sparkSession)
    if run_of is None:
        store.append(change_rows(changes))
    else:
        run = F.greatest(F.lit(0), F.least(F.lit(n_runs - 1), F.coalesce(run_of.cast("int"), F.lit(0))))
        store.append(change_rows(changes.withColumn("run_no__", run), "run_no__"), F.col("run_no__"))
    below = None
    touched = store.scan(*_KEY)
    for object_type, table in base.items():
        cut = current_rows(table.select("id", "vs", "ts", "visible").join(touched.where(F.col("object_type") == object_type).select("id"), "id", "left_semi"))
        cut = cut.select(F.lit(object_type).cast("int").alias("object_type"), "id", "vs", "ts", F.lit(None).cast("bigint").alias("seq"), F.col("deleted").alias("dead"), F.lit(False).alias("fresh"))
        below = cut if below is None else below.unionByName(cut)
    if below is not None:
        store.append(below)
    return store.merged().where(F.col("fresh") & ~F.col("dead")).select("object_type", "id", "vs")
