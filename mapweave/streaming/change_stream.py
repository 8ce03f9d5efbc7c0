"""Following a feed of change files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mapweave.operators.change_log import SortedRuns, change_rows


def follow_changes(spark: SparkSession, folder: str, schema: str, store: SortedRuns, checkpoint: str) -> StreamingQuery:
    """Every new Parquet file of changes in ``folder`` becomes part of a sorted run of ``store``; compaction is the store's.

    Columns as for ``change_rows``. The store keeps the number of the last batch in its manifest, so a batch that is run again
    after a failure is passed over if its run is there; ``checkpoint`` and store belong together. A store opened again
    goes on from its manifest.
    """

    def add(batch: DataFrame, number: int) -> None:
        store.append(change_rows(batch), batch=number)

    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
