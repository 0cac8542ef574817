"""Changes of entities in a stream of their versions, and payloads that are taken in exactly once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerlens.sources.ocr import parse_payloads, payload_fields

CHANGE = "entity_id long, event_id long, action string, before string, after string"


class ChangeTracker(StatefulProcessor):
    """Compares each version of an entity with the one before it, which is all the state it has. A deleted entity has none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        for pdf in rows:
            pdf = pdf.sort_values(["event_time", "event_id"])
            found = []
            for event_id, after in zip(pdf.event_id.tolist(), pdf.value.astype(object).where(pdf.value.notna(), None).tolist()):
                if before != after:
                    action = "insert" if before is None else "delete" if after is None else "update"
                    found.append((key[0], event_id, action, before, after))
                before = after
            if found:
                yield pd.DataFrame(found, columns=["entity_id", "event_id", "action", "before", "after"])
        if before is None:
            self.last.clear()
        else:
            self.last.update((before,))

    def close(self) -> None:
        pass


def version_changes(versions: DataFrame) -> DataFrame:
    """The stream form of ``operators.audit.version_changes``: versions of an entity come in order of time, in a micro-batch in any order.

    Needs the RocksDB state store.
    """
    return versions.select("entity_id", "event_id", "event_time", "value").groupBy("entity_id").transformWithStateInPandas(
        ChangeTracker(), CHANGE, "append", "none")


def payload_files(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Payloads that lie as JSON lines in a folder; received when their file was written."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.load(folder).select(F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("received_at"))


def ingest_once(path: str) -> Callable[[DataFrame, int], None]:
    """Writer for ``foreachBatch`` of payloads (``payload``, ``received_at``): one result per request_id for good, however late a copy comes.

    Of copies in one micro-batch the first received counts (then the smallest hash); requests that earlier batches took in are left out
    by an anti join with the list of request ids. Each batch writes ``requests`` and ``results`` in folders of its own number, and reads those of
    smaller numbers only, so a repeated batch gives the same files. Payloads without a request_id are left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = parse_payloads(batch.withColumn("tie", F.xxhash64("payload"))).withColumn("request_id", F.col("p.request_id")).where("request_id is not null")
        once = parsed.groupBy("request_id").agg(F.min_by("p", F.struct("received_at", "tie")).alias("p"))
        if batch_id > 0:
            schema = once.select("request_id").schema.add("batch_id", "long")
            known = spark.read.schema(schema).parquet(f"{path}/requests").where(F.col("batch_id") < batch_id).select("request_id")
            once = once.join(known, "request_id", "left_anti")
        held = once.persist()
        try:
            payload_fields(held).write.mode("overwrite").parquet(f"{path}/results/batch_id={batch_id}")
            held.select("request_id").write.mode("overwrite").parquet(f"{path}/requests/batch_id={batch_id}")
        finally:
            held.unpersist()

    return write
