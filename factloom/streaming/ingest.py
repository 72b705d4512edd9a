"""Micro-batch ingest of raw facts into a fact store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factloom.store import RAW_SCHEMA, FactStore


def raw_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of raw facts as they arrive."""
    return spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, store: FactStore, checkpoint: str, name: str | None = None, replace_documents: bool = False, **trigger) -> StreamingQuery:
    """Keep each batch once; facts are keyed by content and not by time, so no watermark is needed.

    The store's manifest names the last batch of the stream ``name`` (its checkpoint), and is written together with the batch's rows, so a
    batch that is replayed after a failure changes nothing. With ``replace_documents`` a document that comes again replaces
    its earlier claims; all claims of a document must then come in one batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.append_batch(batch, name or checkpoint, number, replace_documents)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
