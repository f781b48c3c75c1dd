"""Spark-first engine for lease documents, clauses and their assessments."""
