"""Integrity rules as frames of violations; an empty frame means that the rule holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that several rows have, with their number. A null part of a key equals nothing, so such rows don't count."""
    return df.na.drop(subset=list(key)).groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str = "id") -> DataFrame:
    """Rows whose foreign key isn't null and has no parent."""
    keys = parent.select(F.col(parent_column).alias("_p"))
    return child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_p"), "left_anti")


def outside_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Rows with a value that isn't null and isn't in ``domain``."""
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*domain))


def missing_values(df: DataFrame, *columns: str) -> DataFrame:
    """(column, n) of the columns that must not be null and are, in one pass."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns))).alias("x")).select("x.*").filter("n > 0")

