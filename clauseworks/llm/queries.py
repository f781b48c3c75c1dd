"""The queries of the training-data problems, by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.llm import citations, encoding, mixing, neardup, pairs, personal, scans, spam, splitting
from clauseworks.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scanned(table(spark, sf_dir, "analyze_clause", "clause_id", "clause")).select("clause_id").distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(table(spark, sf_dir, "analyze_clause", "clause_id", "clause"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = table(spark, sf_dir, "analyze_clause", "clause_id", "clause")
    return splitting.split(clauses, with_text=False).filter("pieces > 1").select("clause_id").distinct()


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(table(spark, sf_dir, "analyze_clause", "clause_id", "clause"))


def p2_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of all pieces: without their overlaps they are the clause, none is too long, each begins within the one before."""
    pieces = p2_pieces(spark, sf_dir)
    own = F.length("text") - F.col("overlap")
    fits = (F.length("text") <= splitting.LIMIT) & (F.col("overlap") <= splitting.OVERLAP) & ((F.col("piece") == 0) | (F.col("overlap") > 0))
    return pieces.groupBy("clause_id").agg(F.coalesce(F.sum(own), F.lit(0)).alias("chars"), F.bool_and(F.coalesce(fits, F.lit(True))).alias("fits"))


def _personal(spark: SparkSession, sf_dir: str, f: Callable) -> DataFrame:
    names = personal.known_names(table(spark, sf_dir, "users", "name"))
    clauses = f(table(spark, sf_dir, "analyze_clause", "clause_id", "clause"), "clause_id", "clause", names)
    reasons = f(table(spark, sf_dir, "compliance_result", "result_id", "reason"), "result_id", "reason", names)
    label = lambda df, key, field: df.withColumnRenamed(key, "row_id").withColumn("field", F.lit(field))
    return label(clauses, "clause_id", "clause").unionByName(label(reasons, "result_id", "reason"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir, personal.find).select("field", "row_id", "kind").distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir, personal.redacted).select("field", "row_id", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs(table(spark, sf_dir, "analyze_clause", "clause_id", "clause")).select("clause_id_a", "clause_id_b")


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "analyze_clause", "clause_id", "clause"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "compliance_result", "result_id", "citations")
    return citations.map_citations(results, table(spark, sf_dir, "statute_section")).select("result_id", "pos", "section_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "compliance_result", "result_id", "clause_id", "reason", "citations")
    return pairs.defects(results, table(spark, sf_dir, "analyze_clause", "clause_id", "clause")).distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts again from their ids, as digests, and the bytes of all their tokens."""
    return encoding.decoded(p7_ids(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"), "n_bytes")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sized = mixing.sized_once(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    target = table(spark, sf_dir, "mix_target")
    return mixing.mix(sized, target), sized, target


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mix(spark, sf_dir))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source with documents has its share of the mix, scaled to those sources, but for two of the largest
    documents, within its repeats."""
    mixed, sized, target = _mix(spark, sf_dir)
    shares = mixing.shares(mixed, sized, target)
    there = shares.filter("tokens > 0").agg(F.sum("target_share").alias("all_shares")).crossJoin(F.broadcast(sized.agg(F.max("n_tokens").alias("largest"))))  # one row each
    near = F.abs(F.col("used_tokens") - F.col("target_share") / F.col("all_shares") * F.col("mix_tokens")) <= 2 * F.col("largest")
    kept = F.when(F.col("tokens") > 0, near & (F.col("most_copies") <= F.col("max_repeats"))).otherwise(F.col("used_tokens") == 0)
    return shares.crossJoin(F.broadcast(there)).select("source", kept.alias("kept"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p1_repaired, p2_found, p2_pieces, p2_whole, p3_found, p3_redacted, p4_found, p4_groups, p5_found, p6_found, p7_ids, p7_decoded, p8_mix, p8_shares, p8_kept, p9_found)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "SELECT DISTINCT clause_id FROM analyze_clause WHERE length(clause) > 1500",
        "p2_whole": "SELECT clause_id, coalesce(length(clause), 0) AS chars, true AS fits FROM analyze_clause",
        "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest, coalesce(strlen(text), 0) AS n_bytes FROM documents",
        "p8_kept": "SELECT source, true AS kept FROM mix_target",
    }
