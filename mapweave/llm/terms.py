"""How often every distinct term occurs, and in how many records, over a whole collection."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def normal_term(text: str) -> str:
    """Unicode NFKC, lower case, blanks of any kind made one space, trimmed."""
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def _normal_lists(lists: pa.Array) -> pa.Array:
    lists = lists.cast(pa.list_(pa.string()))
    flat = lists.flatten().dictionary_encode()
    terms = [normal_term(t.as_py()) if t.is_valid else "" for t in flat.dictionary]
    words = pa.array([t or None for t in terms], pa.string()).take(flat.indices)
    lengths = np.asarray(lists.value_lengths().fill_null(0))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), words)


normal_lists = arrow_udf(_normal_lists, T.ArrayType(T.StringType()))


def term_counts(rows: DataFrame, record: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``field_name, term, n_occurrences, n_records, n_all_records`` for every distinct term of every field.

    ``fields`` are array columns, each element of which is one value; ``record`` names the columns that together tell
    records apart. Terms are compared as ``normal_term`` gives them; null and empty ones are none. Occurrences count
    in every row, repeated rows too; a record counts once for a term however many of its rows hold it. Null record
    columns are a value like any other, so rows without a key form one record; null arrays hold nothing but their
    record counts in ``n_all_records``. An empty table gives an empty result.

    Each row's terms are counted per record and combined by hash before the first shuffle, by (field, term, record);
    the second moves one partial count per term and task. No term, however common, meets in one task uncombined.
    """
    keys = [F.col(c).alias(f"r{i}") for i, c in enumerate(record)]
    lists = rows.select(*keys, *[normal_lists(F.col(f)).alias(f"f{i}") for i, f in enumerate(fields)])
    names = [f"r{i}" for i in range(len(record))]
    pair = lambda i, f: F.transform(F.filter(F.col(f"f{i}"), lambda t: t.isNotNull()), lambda t: F.struct(F.lit(f).alias("field_name"), t.alias("term")))
    terms = F.concat(*[F.coalesce(pair(i, f), F.array().cast("array<struct<field_name:string,term:string>>")) for i, f in enumerate(fields)])
    emitted = lists.select(*names, F.explode(terms).alias("t")).select(*names, "t.*")
    per_record = emitted.groupBy("field_name", "term", *names).agg(F.count(F.lit(1)).alias("n"))
    counts = per_record.groupBy("field_name", "term").agg(F.sum("n").alias("n_occurrences"), F.count(F.lit(1)).alias("n_records"))
    n_all = rows.select(*keys).distinct().agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("n_all_records", n_all.scalar())


def frequency_band(n_records: Column, n_all: Column, rare_at_most: int, common_percent: int) -> Column:
    """``rare`` in at most so many records, else ``common`` in more than so many percent of all, else null."""
    return F.when(n_records <= rare_at_most, "rare").when(n_records * 100 > n_all * common_percent, "common")


def banded_terms(rows: DataFrame, record: Sequence[str], fields: Sequence[str], rare_at_most: int = 2, common_percent: int = 2) -> DataFrame:
    """The terms outside the useful range, with their ``band``: see ``term_counts`` and ``frequency_band``."""
    counts = term_counts(rows, record, fields)
    band = frequency_band(F.col("n_records"), F.col("n_all_records"), rare_at_most, common_percent)
    return counts.withColumn("band", band).where("band is not null")
