"""Counts and summaries by owner and analysis. None of them has a formula in the schema; the formulas are ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def uploads_by_owner(agreements: DataFrame) -> DataFrame:
    return agreements.groupBy("user_id").agg(F.count("*").alias("uploads"), F.max("uploaded_at").alias("last_upload"))


def analyses_by_month(analyses: DataFrame, agreements: DataFrame) -> DataFrame:
    """(user_id, month, analyses): analyses created by owner and month."""
    month = F.date_format("created_at", "yyyy-MM")
    owner = agreements.select(F.col("id").alias("agreement_id"), "user_id")
    return analyses.select("agreement_id", month.alias("month")).join(owner, "agreement_id").groupBy("user_id", "month").agg(F.count("*").alias("analyses"))


def judgments_by_analysis(results: DataFrame, clauses: DataFrame) -> DataFrame:
    """(analysis_id, answers, non_compliant, needs_review, worst): answers by status and the worst severity's rank."""
    status = F.lower(F.translate("status", "-", "_"))
    severity = F.array_position(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.col("severity"))
    return (
        results.select("clause_id", status.alias("status"), severity.alias("severity"))
        .join(clauses.select("clause_id", "analysis_id"), "clause_id")
        .groupBy("analysis_id")
        .agg(
            F.count("*").alias("answers"),
            F.count_if(F.col("status") == "non_compliant").alias("non_compliant"),
            F.count_if(F.col("status") == "needs_review").alias("needs_review"),
            F.coalesce(F.max("severity"), F.lit(0)).cast("bigint").alias("worst"),
        )
    )


def summaries(counts: DataFrame) -> DataFrame:
    """(analysis_id, risk_score, overall_summary) of ``judgments_by_analysis``: the answers that are non-compliant, and half of
    those that need review, in hundredths of all."""
    score = F.floor(50 * (2 * F.col("non_compliant") + F.col("needs_review")) / F.col("answers")).cast("int")
    text = F.concat(F.col("non_compliant").cast("string"), F.lit(" of "), F.col("answers").cast("string"), F.lit(" answers are non-compliant, "), F.col("needs_review").cast("string"), F.lit(" need review"))
    return counts.select("analysis_id", score.alias("risk_score"), text.alias("overall_summary"))


def durations(analyses: DataFrame) -> DataFrame:
    """(id, millis): time from start to end; null while one of them is missing."""
    return analyses.select("id", F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("completed_at")).alias("millis"))
