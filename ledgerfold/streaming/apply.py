"""Structured Streaming: follow a change log and apply it with exactly-once
commits.

The log is a folder of Parquet files of canonical changes, one or more whole
transactions each.  A micro-batch is what is available; ``apply_batch`` skips
changes at or before the applied position, so a batch that is run again after a
crash changes nothing.  Order is the position, not event time: nothing is late,
out-of-order positions are corruption.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerfold.operators.fold import DivergenceError
from ledgerfold.plans.versioned import VersionedStore, apply_batch


def change_stream(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def follow(stream: DataFrame, store: VersionedStore, keys: dict[str, list[str]], values: dict[str, list[str]], generation: str, checkpoint: str,
           end: int | None = None, available_now: bool = True, interval: str = "2 seconds") -> StreamingQuery:
    """Apply the stream; with ``end`` nothing after that position (inclusive)."""
    gated = stream if end is None else stream.where(F.col("end_lsn") <= end)
    writer = gated.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch, keys, values, generation) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def drain(store: VersionedStore, query: StreamingQuery, end: int, stall: float = 120.0, poll: float = 0.5) -> dict:
    """Wait until the applied position reaches ``end``; stops if there is no
    progress for ``stall`` seconds.  Ends the query."""
    seen, since = -1, time.time()
    while (now := store.manifest())["remote_lsn"] < end:
        if query.exception() is not None:
            raise DivergenceError(str(query.exception()))
        if now["remote_lsn"] > seen:
            seen, since = now["remote_lsn"], time.time()
        if not query.isActive or time.time() - since > stall:
            raise TimeoutError(f"no progress beyond position {seen}, wanted {end}")
        time.sleep(poll)
    query.stop()
    return store.manifest()
