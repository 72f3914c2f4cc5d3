"""Documents as a stream: converted as they arrive, counted by time window with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.slots import explode_slots


def read_documents(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    schema = "doc_id long, work_id string, text string, lang string, source string, n_chars long, collected_at timestamp_ntz"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_slots(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Slots of each arriving document, appended; documents don't share state, so none is kept."""
    return explode_slots(documents, "doc_id", "text").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_counts(documents: DataFrame, late: str | None = None, window: str = "7 days") -> DataFrame:
    """Documents and characters by source and window of collection.

    Every row counts, however late; the state, one row for each source and
    window, stays, and results go out in update or complete mode. With ``late``
    windows that far behind the latest row seen are closed and given up: append
    mode is then possible, at the price of rows that come later still.
    """
    timed = documents.withColumn("collected_at", F.col("collected_at").cast("timestamp"))
    if late:
        timed = timed.withWatermark("collected_at", late)
    return timed.groupBy(F.window("collected_at", window), "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
