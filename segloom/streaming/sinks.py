"""Batches of a stream added to a table once each: a batch that comes again takes the place of what it wrote before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def replace_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """The rows of one batch, in a folder of the batch's number."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def append_once(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts writing ``stream`` below ``path``; a restart from ``checkpoint`` may do its last batch again."""
    return stream.writeStream.foreachBatch(lambda rows, batch_id: replace_batch(rows, batch_id, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """All batches, with the number of each in ``batch``."""
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long"))
