"""Joins over declared relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def include(child: DataFrame, parent: DataFrame, column: str, prefix: str) -> DataFrame:
    """``child`` with its parent's columns, named with ``prefix``; the relation is mandatory, so the join is inner."""
    named = parent.select(*(F.col(c).alias(f"{prefix}{c}") for c in parent.columns))
    return child.join(named, F.col(column) == F.col(f"{prefix}id"))


def present(df: DataFrame, other: DataFrame, column: str, other_column: str) -> DataFrame:
    return df.join(other.select(F.col(other_column).alias("_k")), F.col(column) == F.col("_k"), "left_semi")


def absent(df: DataFrame, other: DataFrame, column: str, other_column: str) -> DataFrame:
    """Rows without a partner; a null key has none."""
    return df.join(other.select(F.col(other_column).alias("_k")), F.col(column) == F.col("_k"), "left_anti")


def chain(agreements: DataFrame, analyses: DataFrame, clauses: DataFrame) -> DataFrame:
    """Agreement, its analysis if any, and that one's clauses if any."""
    return (
        agreements.select(F.col("id").alias("agreement_id"), "user_id", "file_name")
        .join(analyses.select("agreement_id", F.col("id").alias("analysis_id"), F.col("status").alias("analysis_status")), "agreement_id", "left")
        .join(clauses, "analysis_id", "left")
    )


def link_decision(incoming: DataFrame, accounts: DataFrame, users: DataFrame) -> DataFrame:
    """``incoming`` (arrival, provider_id, account_id, email, ...) with ``branch`` and ``user_id``.

    "returning" if the account is known, else "link" if the e-mail is a user's or that of an earlier row of the batch,
    else "new". A batch is taken in order of arrival, as one after the other would be: rows after the first with one
    new account return, rows after the first with one new e-mail link. A new user's id is null here.
    """
    known = accounts.select("provider_id", "account_id", F.col("user_id").alias("account_user"))
    mail = users.filter("email is not null").select("email", F.col("id").alias("mail_user"))
    key = ["provider_id", "account_id"]
    # the first of each key is an aggregate, combined before the shuffle; rows without a key are first themselves
    first = incoming.na.drop(subset=key).groupBy(*key).agg(F.min("arrival").alias("account_first"))
    joined = incoming.join(known, key, "left").join(mail, "email", "left").join(first, key, "left")
    joined = joined.withColumn("returning", F.col("account_user").isNotNull() | F.coalesce(F.col("arrival") > F.col("account_first"), F.lit(False)))
    taken = joined.filter(~F.col("returning") & F.col("email").isNotNull()).groupBy("email").agg(F.min("arrival").alias("mail_first"))
    return (
        joined.join(taken, "email", "left")
        .withColumn("branch", F.when(F.col("returning"), "returning").when(F.col("mail_user").isNotNull() | (F.col("arrival") > F.col("mail_first")), "link").otherwise("new"))
        .withColumn("user_id", F.coalesce("account_user", "mail_user"))
        .drop("account_user", "mail_user", "account_first", "mail_first", "returning")
    )
