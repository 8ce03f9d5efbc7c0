"""References to records that do not exist, by compressed bitmaps per key range and period.

A key range holds 2^16 ids of one element type. The live ids of a range by the period they were first loaded in, and the
referred ids by the period of the referring element, are kept as compressed containers: sorted 16-bit numbers where
there are few, a bitmap where that is smaller. Tasks make them from whole partitions before anything moves, so what is
shuffled are containers, and a key that a third of all references share is one number of one container a task. Where a
range comes together its keys are dictionary-encoded, so bitmaps are as long as there are keys, however far apart their
ids lie. A reference is settled if its id was live before its own period began: that is the AND-NOT of two bitmaps,
period by period. The few bits that survive are decoded and looked at exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.session import written

_LOW = 16
_DENSE = 4096  # numbers from which a container of 2^16 bits is no larger as a bitmap
_PERIOD_S = 7 * 86400
_ALWAYS, _NEVER = -(2**31), 2**31 - 1  # period of ids live at any time, and of references that are never late
_HOLD = 1 << 21  # numbers a task holds before it packs or settles them
_PACKED = "kind int, bucket bigint, period int, asked boolean, bits binary"
_NAMES = ["kind", "bucket", "period", "asked", "bits"]


def pack(kind: np.ndarray, ids: np.ndarray, period: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
    """Containers of the given numbers, one per (kind, range, period, asked); repeats are dropped."""
    order = np.lexsort((ids, asked, period, kind))
    kind, ids, period, asked = kind[order], ids[order], period[order], asked[order]
    bucket = ids >> _LOW
    new_key = np.r_[True, (kind[1:] != kind[:-1]) | (bucket[1:] != bucket[:-1]) | (period[1:] != period[:-1]) | (asked[1:] != asked[:-1])]
    keep = new_key | np.r_[True, ids[1:] != ids[:-1]]
    first = np.flatnonzero(new_key[keep])
    low = (ids[keep] & 0xFFFF).astype("<u2")
    n = np.diff(np.r_[first, len(low)])
    dense = np.flatnonzero(n >= _DENSE)
    size = n * 2
    size[dense] = 8192
    offsets = np.r_[0, np.cumsum(size)]
    if len(dense):
        parts, at = [], 0
        for i in dense.tolist():
            bits = np.zeros(1 << _LOW, np.uint8)
            bits[low[first[i] : first[i] + n[i]]] = 1
            parts += [low[at : first[i]].tobytes(), np.packbits(bits, bitorder="little").tobytes()]
            at = first[i] + n[i]
        data = b"".join([*parts, low[at:].tobytes()])
    else:
        data = low.tobytes()
    # A batch of numbers packs into less than they take themselves, so 32-bit offsets do.
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    heads = [a[keep][first] for a in (kind, bucket, period, asked)]
    return pa.RecordBatch.from_arrays([pa.array(heads[0], pa.int32()), pa.array(heads[1], pa.int64()), pa.array(heads[2], pa.int32()), pa.array(heads[3], pa.bool_()), packed], names=_NAMES)


def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, id, period, asked) of every number in the containers of a batch."""
    bits = batch.column("bits").cast(pa.large_binary())
    offsets = np.frombuffer(bits.buffers()[1], np.int64)[bits.offset : bits.offset + len(bits) + 1]
    data = np.frombuffer(bits.buffers()[2] or b"", np.uint8)
    size = np.diff(offsets)
    heads = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "bucket", "period", "asked")]
    dense = size == 8192
    low, n = [], []
    if not dense.any():
        low.append(data[offsets[0] : offsets[-1]].view("<u2"))
        n.append(size // 2)
    else:
        for i in range(len(size)):
            piece = data[offsets[i] : offsets[i + 1]]
            low.append(np.flatnonzero(np.unpackbits(piece, bitorder="little")) if dense[i] else piece.copy().view("<u2"))
            n.append([len(low[-1])])
    count = np.concatenate(n).astype(np.int64)
    kind, bucket, period, asked = (np.repeat(h, count) for h in heads)
    return kind.astype(np.int64), (bucket.astype(np.int64) << _LOW) + np.concatenate(low).astype(np.int64), period.astype(np.int64), asked.astype(bool)


def _packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of a partition's rows ``kind, id, period, asked``."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "id", "period", "asked")])
            n += batch.num_rows
        if n >= _HOLD:
            yield pack(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if held:
        yield pack(*(np.concatenate(x) for x in zip(*held)))


def _unsettled(kind: np.ndarray, ids: np.ndarray, period: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
    """The (kind, id, period) that are asked for and not live in an earlier period, of whole key ranges."""
    order = np.lexsort((ids, kind))
    kind, ids, period, asked = kind[order], ids[order], period[order], asked[order]
    new = np.r_[True, (kind[1:] != kind[:-1]) | (ids[1:] != ids[:-1])] if len(ids) else np.zeros(0, bool)
    code = np.cumsum(new) - 1  # the dictionary: numbers of the distinct keys, in key order
    keys = np.flatnonzero(new)
    known = np.zeros(len(keys), bool)
    by_period = np.argsort(period, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(period[by_period]) != 0]) if len(ids) else np.zeros(0, np.int64)
    left_code, left_period = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(ids)]):
        rows = by_period[a:b]
        want = np.zeros(len(keys), bool) if len(rows) * 8 > len(keys) else None
        codes = code[rows[asked[rows]]]
        if want is not None:
            want[codes] = True
            codes = np.flatnonzero(want & ~known)
        else:
            codes = np.unique(codes[~known[codes]])
        left_code.append(codes)
        left_period.append(np.full(len(codes), period[rows[0]]))
        known[code[rows[~asked[rows]]]] = True
    at = keys[np.concatenate(left_code)]
    return pa.RecordBatch.from_arrays([pa.array(kind[at], pa.int32()), pa.array(np.concatenate(left_period), pa.int32()), pa.array(ids[at], pa.int64())], names=["mem_type", "period", "ref_id"])


def _settling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers sorted by (kind, bucket), all of a range's together, to the references they leave open.

    Whole ranges are settled together as soon as there are enough numbers. A range that alone brings more than that is
    shortened on the way: what it can hold at once is each of its ids once per period.
    """
    held: list[tuple[np.ndarray, ...]] = []
    n, limit = 0, _HOLD
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(unpack(batch))
        n += len(held[-1][0])
        if n < limit:
            continue
        kind, ids, period, asked = (np.concatenate(x) for x in zip(*held))
        last = (kind == kind[-1]) & (ids >> _LOW == ids[-1] >> _LOW)
        if not last.all():
            yield _unsettled(*(a[~last] for a in (kind, ids, period, asked)))
        held = [unpack(pack(*(a[last] for a in (kind, ids, period, asked))))]
        n = len(held[0][0])
        limit = max(_HOLD, 2 * n)
    if held:
        yield _unsettled(*(np.concatenate(x) for x in zip(*held)))


def _period(c: Column) -> Column:
    return F.floor(F.unix_seconds(c.cast("timestamp")) / _PERIOD_S).cast("int")


def element_rows(kind: int, rows: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """``kind, id, deleted, first, ts, loaded`` and carried columns of every id of a base table, in one pass.

    ``deleted``, ``ts`` and what is carried are those of the current row; ``first`` is the id's earliest ``loaded_at``,
    ``loaded`` the earliest among the rows of the current version (same id, vs and ts). Null ids are left out.
    """
    carry = carry or {}
    # Of the rows of one version, which agree in all else, the one loaded first: the greatest by the negated time.
    version = F.struct(F.col("vs").cast("bigint").alias("vs"), F.col("ts").cast("bigint").alias("ts"), (-F.unix_micros(F.col("loaded_at").cast("timestamp"))).alias("early"), (~F.coalesce(F.col("visible"), F.lit(True))).alias("deleted"), *[c.alias(f"c_{n}") for n, c in carry.items()])
    one = rows.where("id is not null").select(F.col("id").cast("bigint").alias("id"), version.alias("r"), F.col("loaded_at").cast("timestamp").alias("at"))
    one = one.groupBy("id").agg(F.max("r").alias("r"), F.min("at").alias("first"))
    return one.select(F.lit(kind).cast("int").alias("kind"), "id", F.col("r.deleted").alias("deleted"), "first", F.col("r.ts").alias("ts"), F.timestamp_micros(-F.col("r.early")).alias("loaded"), *[F.col(f"r.c_{n}").alias(n) for n in carry])


def orphan_references(references: DataFrame, states: DataFrame) -> DataFrame:
    """The references that no live, early enough element answers, each with its reason.

    ``references``: ``src_table, src_id, mem_type, ref_id, ym, loaded`` (distinct or not); ``states``: ``kind, id,
    deleted, first``, one row per id; further columns do not matter. Both are read twice and should be written tables
    or cheap. Result, distinct: the references' columns but ``loaded``, and ``reason``: ``missing`` if the id has no row
    of that type, else ``deleted``, else ``late`` if it was first loaded later than ``loaded``. A null ``ref_id`` or
    ``mem_type`` is no reference. A null ``first`` or ``loaded`` is never late. Empty tables are fine.

    One shuffle of containers by key range; the exact look-up and the way back to the references join only what
    survives, by broadcast where the session finds that small enough.
    """
    refs = references.where("ref_id is not null and mem_type is not null").select("src_table", "src_id", F.col("mem_type").cast("int").alias("mem_type"), F.col("ref_id").cast("bigint").alias("ref_id"), "ym", "loaded")
    refs = refs.withColumn("period", F.coalesce(_period(F.col("loaded")), F.lit(_NEVER)))
    row = lambda kind, id_, period, asked: [F.col(kind).cast("int").alias("kind"), F.col(id_).cast("bigint").alias("id"), period.alias("period"), F.lit(asked).alias("asked")]
    live = states.where(~F.col("deleted") & F.col("id").isNotNull()).select(*row("kind", "id", F.coalesce(_period(F.col("first")), F.lit(_ALWAYS)), False))
    numbers = live.unionByName(refs.select(*row("mem_type", "ref_id", F.col("period"), True)))
    packed = numbers.mapInArrow(_packing, _PACKED).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    left = written(packed.mapInArrow(_settling, "mem_type int, period int, ref_id bigint"), "open")

    found = states.select(F.col("kind").cast("int").alias("mem_type"), F.col("id").cast("bigint").alias("ref_id"), "deleted", "first")
    known = found.join(left.select("mem_type", "ref_id").distinct(), ["mem_type", "ref_id"])
    open_ = left.join(known, ["mem_type", "ref_id"], "left").where(F.col("deleted").isNull() | F.col("deleted") | F.col("first").isNotNull())
    out = refs.join(open_, ["mem_type", "period", "ref_id"])
    reason = F.when(F.col("deleted").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("first") > F.col("loaded"), "late")
    return out.withColumn("reason", reason).where("reason is not null").select("src_table", "src_id", "mem_type", "ref_id", "ym", "reason").distinct()


def _month(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM")


def element_references(ways: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """References of existing ways to nodes, and of existing relations to members of types 0 to 2, for ``orphan_references``.

    ``ways`` and ``relations`` as ``element_rows`` gives them, ways with ``refs``.
    """
    own = ways.where(~F.col("deleted"))
    from_ways = own.select(F.lit("full_ways").alias("src_table"), F.col("id").alias("src_id"), F.lit(0).alias("mem_type"), F.explode(F.array_distinct("refs")).alias("ref_id"), _month(F.col("ts")).alias("ym"), "loaded")
    heads = relations.where(~F.col("deleted")).select(F.col("id").alias("relation_id"), "ts", "loaded")
    mem = members.where(F.col("mem_type").isin(0, 1, 2) & F.col("mem_ref").isNotNull()).select("relation_id", F.col("mem_type").cast("int").alias("mem_type"), F.col("mem_ref").alias("ref_id"))
    from_rels = mem.join(heads, "relation_id").select(F.lit("rel_members").alias("src_table"), F.col("relation_id").alias("src_id"), "mem_type", "ref_id", _month(F.col("ts")).alias("ym"), "loaded")
    return from_ways.unionByName(from_rels).where("ref_id is not null")
