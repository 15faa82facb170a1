"""Starting streams: batch interval, checkpoint, state store, exactly-once files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

# Custom state needs the store that keeps state on disk and checkpoints changes.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def stream_settings(spark: SparkSession, state_partitions: int | None) -> Iterator[None]:
    """Settings a query takes with it when it starts; the session gets its own back.

    The number of state partitions cannot change once a checkpoint exists, so
    it is chosen here rather than inherited from whatever the session runs with.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        # A commit uploads what changed, not the whole store.
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    }
    if state_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_stream(
    df: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = "10 seconds",
    state_partitions: int | None = None,
    partition_by: tuple[str, ...] = (),
) -> StreamingQuery:
    """Append a stream to a Parquet folder in batches.

    ``every=None`` takes what is there and stops, for catch-up and replays. The
    file sink commits a batch once, so a restart repeats nothing.
    """
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    with stream_settings(df.sparkSession, state_partitions):
        return writer.start()


def export_batches(
    df: DataFrame,
    sinks: Mapping[str, Callable[[DataFrame], DataFrame]],
    checkpoint: str,
    every: str | None = "10 seconds",
    state_partitions: int | None = None,
) -> StreamingQuery:
    """Send every batch of a stream to several tables, each taking its own part of it.

    ``sinks`` gives each table's path what it takes of a batch. A batch is read
    once for all of them and goes to a ``batch=<number>`` folder of each table,
    which it overwrites. A batch that is repeated, because the stream stopped
    after some tables had it, therefore adds nothing twice. How much a batch
    holds is the source's limit, so memory stays bounded however much waits.

    ``every=None`` takes what is there and stops.
    """

    def export(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for path, take in sinks.items():
                take(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(export).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    with stream_settings(df.sparkSession, state_partitions):
        return writer.start()
