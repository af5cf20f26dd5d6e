"""Sessions of users in event time: rows of a key that follow each other within a gap.

A session is written once it is closed, when the watermark (the latest time seen, in milliseconds, less `delay`) has reached its last row plus the gap; it is never changed afterwards. Rows behind the watermark that belong to
no open session are late: they are dropped and counted. Rows without a time belong to no session; rows without a key have sessions of their own, as one key. Ties and repeated rows each count. An empty stream writes nothing.

Rows are merged into sessions in each task before the shuffle, so that of a hot user sessions move, not rows; state is kept by key in RocksDB, not on the heap, and is dropped as the watermark passes. State and progress are in the checkpoint,
a run that breaks off goes on from there, and the sink holds every session once. The backlog is read in one batch, in which nothing is late; with files_per_batch it is cut, and files should then come in the order of their times to within `delay`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """SETTINGS while a query starts; it keeps them."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def source(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files in a folder, or of those that match a pattern, with the schema they have now. A single file must be named by a pattern."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def sessions(rows: DataFrame, keys: list[str], time: str, gap: str, delay: str, aggregates: list[Column]) -> DataFrame:
    """keys, opened, closes (last row plus gap), n and the aggregates of each session. rows: a stream, or a table, of which all sessions are closed. time: a timestamp."""
    window = F.session_window(time, gap)
    found = rows.where(F.col(time).isNotNull()).withWatermark(time, delay).groupBy(*keys, window.alias("session")).agg(F.count("*").alias("n"), *aggregates)
    return found.select(*keys, F.col("session.start").alias("opened"), F.col("session.end").alias("closes"), *found.columns[len(keys) + 1 :])


def write_closed(closed: DataFrame, path: str, checkpoint: str) -> int:
    """Takes in all that has arrived, appends the sessions that closed to path (Parquet), and returns the number of late entries. Called again, it goes on where it stopped."""
    with _settings(closed.sparkSession):
        run = closed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
        run.awaitTermination()
    return sum(int(op.numRowsDroppedByWatermark) for p in run.recentProgress for op in p.stateOperators)
