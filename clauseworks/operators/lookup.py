"""Lookups, owner-scoped lists and their projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame, **key) -> DataFrame:
    """The rows whose columns equal ``key``: a unique key gives one row or none. A null key matches nothing.

    The equality is pushed down to the scan."""
    return df.filter(reduce(Column.__and__, (F.col(c) == F.lit(v) for c, v in key.items())))


def by_keys(df: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    """The rows whose columns ``key``, one or several, are among ``keys``. A null matches nothing."""
    return df.join(keys.select(*key).distinct(), list(key), "left_semi")


def owned_by(df: DataFrame, owner: str, column: str = "user_id", order: str = "uploaded_at", tie: str = "id") -> DataFrame:
    """One owner's rows, newest first, ties by ``tie``, null times last."""
    return df.filter(F.col(column) == F.lit(owner)).orderBy(F.desc_nulls_last(order), tie)


def newest_for_each(df: DataFrame, by: str, order: str, tie: str, k: int = 1) -> DataFrame:
    """The ``k`` newest rows of each owner with their place; the plan limits each group before it shuffles."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(F.desc_nulls_last(order), tie)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def once(df: DataFrame, *columns: str) -> DataFrame:
    """Rows delivered several times, all columns alike, once. ``columns`` are what is needed of them, a unique column among
    them: only these are read and compared."""
    return (df.select(*columns) if columns else df).distinct()
