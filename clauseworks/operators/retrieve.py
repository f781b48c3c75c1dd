"""Context retrieval: the empty default, and exact top-k neighbours of a query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048  # vectors of a block: a pair of blocks has 32 MB of scores


def no_context() -> Column:
    """The context when no index is there: an empty array."""
    return F.array().cast("array<string>")


def _matrix(rows: list) -> np.ndarray:
    """Rows of equal length as a matrix of unit vectors; a row that is null or has another length is all zero."""
    width = next((len(r) for r in rows if r), 0)
    out = np.array([[0.0 if x is None else x for x in r] if r is not None and len(r) == width else [0.0] * width for r in rows], np.float64).reshape(len(rows), width)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)


def _blocks(df: DataFrame, key: str, vector: str, name: str, blocks: int) -> DataFrame:
    """(name, name_ids, name_vectors): the rows in ``blocks`` by their keys' hash, a block in a row."""
    kind = df.schema[key].dataType.simpleString()
    hashed = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias(name), F.struct(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).alias("row"))
    packed = hashed.groupBy(name).agg(F.collect_list("row").alias("rows"))
    return packed.select(name, F.col("rows.id").cast(f"array<{kind}>").alias(f"{name}_ids"), F.col("rows.v").alias(f"{name}_vectors"))


def _nearest(k: int):
    """For each pair of blocks the ``k`` best matches of each query, itself left out, ties by the lower id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, v_ids = (batch.column(c)[row].values for c in ("q_ids", "v_ids"))
                a, b = (_matrix(batch.column(c)[row].as_py()) for c in ("q_vectors", "v_vectors"))
                own, other = (np.array(x.to_pylist()) for x in (q_ids, v_ids))
                score = np.round(a @ b.T, 9) if a.shape[1] == b.shape[1] else np.zeros((len(a), len(b)))
                score[own[:, None] == other[None, :]] = -np.inf
                least = np.partition(score, -min(k, len(b)), axis=1)[:, -min(k, len(b))] if len(b) else np.zeros(len(a))
                q, v = np.nonzero((score >= least[:, None]) & (score > -np.inf))
                order = np.lexsort((other[v], -score[q, v], q))
                q, v = q[order], v[order]
                first = np.searchsorted(q, q)
                keep = np.arange(len(q)) - first < k
                q, v = q[keep], v[keep]
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(q)), v_ids.take(pa.array(v)), pa.array(score[q, v])], ["query_id", "match_id", "similarity"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, match_id, similarity): each query's ``k`` nearest rows of ``vectors`` by cosine, itself left out.

    Exact. Both sides are cut into blocks of about ``BLOCK`` rows; every block of queries meets every block of rows in one
    product that sends on at most ``k`` rows for each query. No vector comes to the driver, and a task holds one pair of
    blocks. Ties go to the lower id. Null vectors, zero vectors and those of another length match with similarity 0.
    """
    kind = vectors.schema[key].dataType.simpleString()
    queries = queries.select(key, vector).distinct()
    n_queries, n_rows = (max(1, -(-df.select(key).count() // BLOCK)) for df in (queries, vectors))
    left = _blocks(queries, key, vector, "q", n_queries)
    right = _blocks(vectors, key, vector, "v", n_rows)
    pairs = left.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))).join(right, "v").select("q_ids", "q_vectors", "v_ids", "v_vectors")
    found = pairs.mapInArrow(_nearest(k), f"query_id {kind}, match_id {kind}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "match_id", "similarity")
