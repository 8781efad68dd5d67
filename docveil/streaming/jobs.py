"""The same operators over streams: files as they come, consistent labels with state, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def document_stream(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 200) -> DataFrame:
    """Documents of a folder of Parquet files, at most ``max_files`` in a batch; a checkpoint makes each file count once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def detected_counts(docs: DataFrame, options=None) -> DataFrame:
    """Running counts of matches by type."""
    from ..operators.detect import detect

    return detect(docs, options=options).select(F.explode("matches").alias("m")).groupBy(F.col("m.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet", single: bool = False) -> None:
    """Work off all that is there and stop; started again with the same checkpoint, only what is new is done.

    State that expires with the clock always asks for one more batch, so that such a stream stops only as a ``single`` one.
    """
    trigger = {"once": True} if single else {"availableNow": True}
    df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).start(path).awaitTermination()


def labelled_stream(keys: DataFrame, ttl_ms: int = 30 * 60 * 1000) -> DataFrame:
    """Labels numbered by first appearance in each scope, over a stream of (scope_id, base, key, …)."""
    from .state import labelled

    return labelled(keys, ttl_ms=ttl_ms)


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need timestamps with a zone; those without are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their total by type in windows; a stream waits ``late`` for late rows."""
    df = _watermarked(events, late) if events.isStreaming else events
    return df.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    df = _watermarked(events, late) if events.isStreaming else events
    return df.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("session_start"), "n")


def once(events: DataFrame, key: list[str], late: str = "30 minutes") -> DataFrame:
    """Rows of a stream whose key was not seen within ``late``."""
    return _watermarked(events, late).dropDuplicatesWithinWatermark(key)
