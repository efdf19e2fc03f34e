"""Continuous extraction: files that arrive are extracted once each. Pages don't depend on each other, so there is no state but
the checkpoint of files seen, and a restarted query goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.extract import Config, extract


def page_stream(spark: SparkSession, folder: str, schema: StructType, source: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(source).load(folder)


def extract_stream(pages: DataFrame, target: str, checkpoint: str, config: Config = Config(), once: bool = True, interval: str = "10 seconds") -> StreamingQuery:
    """Starts the query. once: ends when what is there now is done; else it goes on until stopped."""
    writer = extract(pages, config).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
