"""Runs a streaming frame over what is there now and gives the emitted rows back as a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schemas import EVENTS
from ledgerlens.session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State store that ``transformWithState`` needs; the session setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def read_events(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None, marker: str | None = None) -> DataFrame:
    """Event stream with ``ts`` as a timestamp, as watermarks need it. ``marker``: a folder for rows that close the stream (see ``run_to_end``)."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    events = reader.option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    if marker:
        events = events.union(spark.readStream.schema(EVENTS).parquet(marker))
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def dealt_events(spark: SparkSession, sf_dir: str, files: int) -> DataFrame:
    """The event table as a stream of ``files`` micro-batches, rows dealt by a hash: an arrival that has nothing to do with time."""
    path = scratch_path(spark, "arrivals")
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")
    for k in range(files):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(files)) == k).coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", "1").parquet(f"{path}/*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def write_batches(path: str, outputs: Mapping[str, str] | None = None) -> Callable[[DataFrame, int], None]:
    """Writer of micro-batches for ``foreachBatch``: each output has a folder per batch id, so a repeated batch replaces itself.

    ``outputs``: name -> the condition of its rows; without it all rows go to ``out``. The batch is computed once for all outputs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if outputs is None:
            batch.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")
            return
        held = batch.persist()
        try:
            for name, rows in outputs.items():
                held.where(rows).write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        finally:
            held.unpersist()

    return write


def run_available(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Processes what is there and ends. Called again with the same folder it goes on where it stopped."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()


def run_now(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all available input, each micro-batch into its own folder: a repeated batch overwrites itself."""
    path = scratch_path(stream.sparkSession, name)
    run_available(stream, path, write_batches(path), mode)
    return stream.sparkSession.read.parquet(f"{path}/out")


#: A row behind all times: the watermark passes everything that waits. Its keys are negative.
MARKER = (-8, datetime(2200, 1, 1), -1, "signup", 0.0, "{}")


def marker_folder(spark: SparkSession) -> str:
    """An empty folder of events, to which ``run_to_end`` adds the marker."""
    path = scratch_path(spark, "marker")
    spark.createDataFrame([], EVENTS).write.parquet(path)
    return path


def run_to_end(stream: DataFrame, name: str, marker: str, mode: str = "append") -> DataFrame:
    """``run_now`` for a stream that is over: afterwards a marker row closes it, so rows that wait for the watermark come out, too.

    The stream must read ``marker``. Rows of the marker's own keys (below zero) are the caller's to drop.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    run_available(stream, path, write_batches(path), mode)
    spark.createDataFrame([MARKER], EVENTS).coalesce(1).write.mode("append").parquet(marker)
    run_available(stream, path, write_batches(path), mode)
    return spark.read.parquet(f"{path}/out")


def last_per_key(emitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest version of each key of an update-mode table."""
    rest = [c for c in emitted.columns if c not in (*keys, "batch_id")]
    return emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("r")).select(*keys, "r.*")
