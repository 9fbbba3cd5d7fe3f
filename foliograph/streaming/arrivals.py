"""Sections of documents that arrive over time. Every document is complete in itself, so no state or watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliograph.operators import content


def upsert_sections(arriving: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes the sections of each micro-batch of docs (doc_id, text) under path/batch=N. A replayed batch overwrites its own folder, so results are exactly once."""

    def put(batch: DataFrame, number: int) -> None:
        content.document_tree(content.sections(batch)).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    writer = arriving.select("doc_id", "text").writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_sections(stored: DataFrame) -> DataFrame:
    """Of documents that arrived more than once, the sections of the latest batch; stored has the partition column batch."""
    newest = stored.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return stored.join(newest, ["doc_id", "batch"], "left_semi")
