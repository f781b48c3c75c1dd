"""Deliveries as a stream: late rows and repeats. An extension: the rest of the engine works on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def deliveries(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    """Parquet files as they appear in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def first_delivery(stream: DataFrame, key: list[str], received: str, late: str = "7 days") -> DataFrame:
    """Each key once, as long as its repeats come within ``late``; the state is dropped after that."""
    return stream.withColumn(received, F.col(received).cast("timestamp")).withWatermark(received, late).dropDuplicatesWithinWatermark(key)

