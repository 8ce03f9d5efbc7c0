"""The current row of each element of a base table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per id: that with the highest ``vs``, then the latest ``ts``.

    ``df`` needs ``id, vs, ts, visible``; further columns do not matter. Result: ``id, vs, ts, deleted`` and one
    column per entry of ``carry``. Rows that agree in id, vs and ts are repeats of one another; were they ever to
    differ, the greatest row by (deleted, carried values) is kept, so the result does not depend on row order. A null
    ``vs`` or ``ts`` sorts before any other, a null ``visible`` counts as visible, rows with a null id are left out.
    One shuffle on id, after partial aggregation.
    """
    carry = carry or {}
    packed = F.struct(
        F.col("vs").cast("bigint").alias("vs"),
        F.col("ts").cast("bigint").alias("ts"),
        (~F.coalesce(F.col("visible"), F.lit(True))).alias("deleted"),
        *[c.alias(f"c_{n}") for n, c in carry.items()],
    )
    best = df.where(F.col("id").isNotNull()).select(F.col("id").cast("bigint").alias("id"), packed.alias("r"))
    best = best.groupBy("id").agg(F.max("r").alias("r"))
    return best.select("id", "r.vs", "r.ts", "r.deleted", *[F.col(f"r.c_{n}").alias(n) for n in carry])
