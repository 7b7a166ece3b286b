"""Screens as they arrive: a stream of image files, extracted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.extract import extract
from ..sources.images import stream


def extract_stream(spark: SparkSession, source: str, target: str, checkpoint: str, cfg: Config | None = None, mode: str = "general") -> StreamingQuery:
    """Writes the facts of new files as Parquet, one folder a batch, so that a batch that is run again replaces its own rows; takes what is there and stops."""

    def batch(files: DataFrame, number: int) -> None:
        extract(files.select("path", "content"), cfg, mode).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream(spark, source, "*.png").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
