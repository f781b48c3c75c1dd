"""Clauses: segments, fan-out, prompts, judgments and their regrouping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUDGMENT = "status string, reason string, citations array<string>"
STATUSES = ["compliant", "non_compliant", "needs_review"]


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, clause_index, clause): the lines of each text that aren't blank, numbered from 0 by their line.

    A line is our choice of a segment. Null and blank texts give no row."""
    return (
        df.select(key, F.posexplode(F.split(text, "\r?\n", -1)).alias("clause_index", "clause"))
        .filter(F.trim("clause") != "")
    )


def fan_out(df: DataFrame, key: str, clauses: str) -> DataFrame:
    """(key, clause_index, clause) of an array of clauses; nulls within it keep their place."""
    return df.select(key, F.posexplode(clauses).alias("clause_index", "clause"))


def fan_in(df: DataFrame, key: str, index: str, *columns: str) -> DataFrame:
    """One row for each key with its rows' ``columns`` in an array ordered by ``index``."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(index, *columns))).alias("results"))


def context(snippets: Column) -> Column:
    """Snippets with an empty line between them; an empty array gives an empty string, nulls are left out."""
    return F.array_join(F.coalesce(snippets, F.array().cast("array<string>")), "\n\n")


# The headings of a prompt's parts, in the texts of ``prompt``.
def prompt(clause: Column, snippets: Column) -> Column:
    """The clause and its context under their headings."""
    return F.concat(F.lit("## Lease clause\n"), clause, F.lit("\n\n## Relevant legal context\n"), context(snippets))


def judgment(json: Column) -> Column:
    """A judgment read from JSON; null if it is malformed, misses a part or has another status."""
    read = F.from_json(json, JUDGMENT)
    return F.when(whole(read), read)


def whole(read: Column) -> Column:
    return read["status"].isin(*STATUSES) & read["reason"].isNotNull() & read["citations"].isNotNull()


def judgments(df: DataFrame, key: str, json: str) -> DataFrame:
    """(key, status, reason, citations) of the rows with a whole judgment; each JSON text is read once."""
    read = df.select(key, F.explode(F.array(F.from_json(json, JUDGMENT))).alias("j"))
    return read.filter(whole(F.col("j"))).select(key, "j.*")


def stored(results: DataFrame) -> DataFrame:
    """A judgment's columns (status, reason, citations) as the result table names them."""
    return (
        results.withColumn("compliance", F.upper("status"))
        .withColumnRenamed("reason", "explanation")
        .withColumnRenamed("citations", "rta_citations")
        .drop("status")
    )


def keyword_scorer(prompt: Column, clause: Column, snippets: Column) -> Column:
    """A judgment by fixed words of the clause. It stands in for a language model, isn't its judgment, and is the default
    only so that the pipeline runs without one."""
    text = F.lower(clause)
    bad = text.rlike(r"\b(may not|must not|forfeit|waives? all|penalty)\b")
    unsure = text.rlike(r"\b(reasonable|as needed|at the discretion)\b") | (F.length(F.trim(clause)) < 20)
    status = F.when(bad, "non_compliant").when(unsure, "needs_review").otherwise("compliant")
    reason = F.concat(F.lit("Fixed words: "), status)
    return F.struct(status.alias("status"), reason.alias("reason"), F.slice(F.coalesce(snippets, F.array().cast("array<string>")), 1, 1).alias("citations"))


#: (prompt, clause, snippets) -> a column of status, reason and citations; a pandas UDF over the prompt as well
Scorer = Callable[[Column, Column, Column], Column]


def judge(clauses: DataFrame, clause: str = "clause", snippets: str = "legal_context", scorer: Scorer = keyword_scorer) -> DataFrame:
    """``clauses`` with ``judgment``: the scorer's answer to each clause's prompt."""
    return clauses.withColumn("judgment", scorer(prompt(F.col(clause), F.col(snippets)), F.col(clause), F.col(snippets)))


def analyze(documents: DataFrame, key: str, text: str, retrieve: Callable[[DataFrame], DataFrame] | None = None, scorer: Scorer = keyword_scorer) -> DataFrame:
    """(key, clause_index, clause_text, compliance, explanation, rta_citations): documents through segments, context,
    prompts, the scorer and the check of its answers, in the result table's names.

    ``retrieve`` gives segments (key, clause_index, clause) their ``legal_context``; without it, that is empty. An answer
    that isn't whole leaves its clause with nulls: a clause is never lost. The scorer runs once for each clause.
    """
    parts = segments(documents, key, text)
    found = retrieve(parts) if retrieve else parts.withColumn("legal_context", F.array().cast("array<string>"))
    # the answer is made once, behind a generator, as it is used several times
    answered = judge(found, scorer=scorer).select(key, "clause_index", "clause", F.explode(F.array("judgment")).alias("j"))
    good = F.when(whole(F.col("j")), F.col("j"))
    return stored(answered.select(key, "clause_index", F.col("clause").alias("clause_text"), good.alias("j")).select(key, "clause_index", "clause_text", "j.*"))
