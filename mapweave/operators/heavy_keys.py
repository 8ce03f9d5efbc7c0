"""Per-key results over ordered values when a few keys hold most rows.

The rows are put into equal splits of one global order, whatever their keys. Each split is read once: its keys are
dictionary-encoded, a dense accumulator array holds the running sum per code, and batches are added to it by
scatter-reduce. What a split contributes to a key is then one number per (split, key), and only those are reduced
across splits. No task ever holds more than one split, so a key with most of the rows costs what any other rows cost.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweave.session import written

_BIG = "decimal(38,0)"
_SAFE = float(2**62)


def _running(codes: np.ndarray, values: np.ndarray, acc: np.ndarray) -> np.ndarray:
    """Running sum per code, in place order, on top of ``acc``, which is brought up to date."""
    order = np.argsort(codes, kind="stable")
    c, v = codes[order], values[order]
    total = np.cumsum(v)
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    before = np.concatenate([np.zeros(1, dtype=total.dtype), total[first[1:] - 1]])
    length = np.diff(np.r_[first, len(c)])
    run = total - np.repeat(before, length) + np.repeat(acc[c[first]], length)
    acc[c[first]] = run[first + length - 1]
    out = np.empty(len(c), dtype=run.dtype)
    out[order] = run
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code_of: dict[int, int] = {}
    acc: np.ndarray = np.zeros(1024, dtype=np.int64)
    weight = 0.0  # sum of the absolute values so far: beyond 2**62 the arrays go over to unbounded integers
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, local = np.unique(batch.column("key").to_numpy(), return_inverse=True)
        codes = np.fromiter((code_of.setdefault(k, len(code_of)) for k in keys.tolist()), np.int64, len(keys))[local]
        if len(code_of) > len(acc):
            acc = np.concatenate([acc, np.zeros(max(len(acc), len(code_of) - len(acc)), dtype=acc.dtype)])
        values = batch.column("value").to_numpy()
        weight += float(np.abs(values.astype(np.float64)).sum())
        if weight >= _SAFE:
            acc, values = acc.astype(object), values.astype(object)
        run = _running(codes, values, acc)
        big = pa.decimal128(38, 0)
        cum = pa.array([Decimal(int(x)) for x in run], big) if run.dtype == object else pa.array(run).cast(pa.decimal128(19, 0)).cast(big)
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns)], cum], names=[*batch.schema.names, "cum"])


def half_sum_entries(df: DataFrame, key: str, entry: str, value: str, order: str) -> DataFrame:
    """For each key the entry at which the running sum of ``value`` by (order, entry) first reaches half the key's sum.

    All four columns are integers. Rows that agree in all four are one entry; rows with a null key or value are left
    out; a null order or entry sorts first. Entries that agree in (order, entry) but not in value follow by value.
    Negative values are allowed: the first entry at which the sum stands at half or more counts, and a key for which
    that never happens has no row. Sums are exact whatever their size. An empty table gives an empty result.
    Result: the key and entry columns under their own names.

    Shuffles: one to drop repeats (combined before it), one into the equal splits; what follows moves one row per
    (split, key). The split table is written to the shared folder, since it is read twice.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(entry).cast("bigint").alias("entry"), F.col(order).cast("bigint").alias("ord"), F.col(value).cast("bigint").alias("value"))
    rows = rows.where(F.col("key").isNotNull() & F.col("value").isNotNull()).distinct()
    ranged = rows.repartitionByRange("ord", "entry", "value").sortWithinPartitions("ord", "entry", "value")
    ranged = ranged.select(F.spark_partition_id().alias("split"), "key", "entry", "ord", "value")
    scanned = written(ranged.mapInArrow(_scan, f"split int, key bigint, entry bigint, ord bigint, value bigint, cum {_BIG}"), "splits")

    part = scanned.groupBy("key", "split").agg(F.sum(F.col("value").cast(_BIG)).alias("part"), F.max("cum").alias("peak"))
    by_split = Window.partitionBy("key").orderBy("split")
    part = part.withColumn("base", F.coalesce(F.sum("part").over(by_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(_BIG))
    part = part.withColumn("total", F.sum("part").over(Window.partitionBy("key")).cast(_BIG))
    reached = part.where((F.col("base") + F.col("peak")) * 2 >= F.col("total"))
    at = reached.groupBy("key").agg(F.min(F.struct("split", "base", "total")).alias("x")).select("key", "x.*")

    hit = scanned.join(at, ["key", "split"]).where((F.col("base") + F.col("cum")) * 2 >= F.col("total"))
    hit = hit.groupBy("key").agg(F.min(F.struct("ord", "entry", "value")).alias("e"))
    return hit.select(F.col("key").alias(key), F.col("e.entry").alias(entry))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dense count and sum arrays of one split, by dictionary code."""
    code_of: dict[int, int] = {}
    n = np.zeros(1024, dtype=np.int64)
    hi, lo = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
    for batch in batches:
        keys, local = np.unique(batch.column("key").to_numpy(), return_inverse=True)
        codes = np.fromiter((code_of.setdefault(k, len(code_of)) for k in keys.tolist()), np.int64, len(keys))
        if len(code_of) > len(n):
            more = max(len(n), len(code_of) - len(n))
            n, hi, lo = (np.concatenate([a, np.zeros(more, dtype=np.int64)]) for a in (n, hi, lo))
        values = batch.column("value").to_numpy()
        n[codes] += np.bincount(local, minlength=len(keys))
        for acc, part in ((hi, values >> 32), (lo, values & 0xFFFFFFFF)):
            here = np.zeros(len(keys), dtype=np.int64)
            np.add.at(here, local, part)
            acc[codes] += here
        hi += lo >> 32
        lo &= 0xFFFFFFFF
    size = len(code_of)
    if size:
        sums = [Decimal((int(a) << 32) + int(b)) for a, b in zip(hi[:size], lo[:size])]
        yield pa.RecordBatch.from_arrays([pa.array(list(code_of), pa.int64()), pa.array(n[:size]), pa.array(sums, pa.decimal128(38, 0))], names=["key", "n", "total"])


def key_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """Row count and exact sum per key, reduced from one dense array per input split.

    Null keys and values are left out; an empty table gives an empty result. Result: the key column, ``n_rows``,
    ``total`` as decimal(38,0). The splits are those of the input as it lies, so nothing is shuffled before the
    arrays are summed.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(value).cast("bigint").alias("value")).where("key is not null and value is not null")
    part = rows.mapInArrow(_totals, f"key bigint, n bigint, total {_BIG}")
    out = part.groupBy("key").agg(F.sum("n").alias("n_rows"), F.sum("total").cast(_BIG).alias("total"))
    return out.select(F.col("key").alias(key), "n_rows", "total")
