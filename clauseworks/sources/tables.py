"""Typed tables from files, JDBC, JSON bodies and object stores, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.functions.scalars import query_parameter
from clauseworks.schemas import SCHEMAS

FILE_FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Table ``name`` with its declared schema; only the columns that a query uses are read."""
    if fmt not in FILE_FORMATS:
        raise ValueError(f"format {fmt!r}: one of {', '.join(FILE_FORMATS)}")
    return spark.read.format(fmt).options(**options).schema(SCHEMAS[name]).load(path)


def read_jdbc(spark: SparkSession, name: str, url: str, **options) -> DataFrame:
    """Table ``name`` from a database; filters and columns are pushed down. With partitionColumn, lowerBound,
    upperBound and numPartitions the read is parallel."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options).load()


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", by: tuple[str, ...] = ()) -> None:
    """Write ``df``; ``by`` names partition columns of few values."""
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_jdbc(df: DataFrame, name: str, url: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode(mode).save()


def bodies(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON bodies as the columns of ``schema``; a malformed body gives nulls."""
    return df.withColumn("_body", F.from_json(column, schema)).select("*", "_body.*").drop("_body")


def parameters(df: DataFrame, url: str, *names: str) -> DataFrame:
    """The named parameters of a URL's query string as columns."""
    return df.withColumns({n: query_parameter(F.col(url), n) for n in names})


def responses(body: Column) -> Column:
    """A response's JSON; null fields are written as null."""
    return F.to_json(body, {"ignoreNullFields": "false"})


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of stored files, for a text extractor given as a pandas UDF over ``content``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def extract_text(files: DataFrame, extractor=None) -> DataFrame:
    """(path, text) of ``documents``; without an extractor the bytes are read as UTF-8. No PDF library is needed or bundled."""
    text = extractor(F.col("content")) if extractor else F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", text.alias("text"))
