"""Structured Streaming forms of the keyed tables: an extension, the same semantics as the batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from spanforge.operators.persist import upserted


def deduplicated(stream: DataFrame, keys: list[str], stamp: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark; state is dropped behind it."""
    return stream.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, stamp: str, every: str, late: str, *groups: str) -> DataFrame:
    """(window, groups, rows) of tumbling windows; rows later than the watermark are left out."""
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, every), *groups).agg(F.count("*").alias("rows"))


def upsert_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str], kept: list[str], stamp: str) -> DataStreamWriter:
    """Merge each micro-batch into a keyed table, versions side by side under path; replaying a batch changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        (upserted(old, batch, keys, kept, stamp) if old is not None else upserted(batch, batch.limit(0), keys, kept, stamp)).write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def appended(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """An append-only log of the stream."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
