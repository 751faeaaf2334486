"""Resumable ingestion: a stream of chunk files appended to the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.vector import append


def stream_chunks(spark: SparkSession, path: str, schema: str | StructType, format: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(path)


def ingest(chunks: DataFrame, table: str, checkpoint: str, key: str = "chunk_id", embed=None, order: str | None = None) -> StreamingQuery:
    """Append new keys of every micro-batch, the first of each by ``order``; a restart skips what was committed.

    ``embed`` maps new rows to rows with vectors. A batch that is repeated after a failure adds
    nothing twice, as rows whose key is in the table are left out.
    """

    def one(batch: DataFrame, _: int) -> None:
        append(batch, table, key, order, embed)

    return chunks.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
