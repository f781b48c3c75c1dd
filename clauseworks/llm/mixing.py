"""Problem 8: one mix in which every source has its target share of the tokens.

Weighted fair queueing: the documents of a source are put in a shuffled order, and each gets a virtual finish time,
the tokens of its source up to and including it, divided by the source's share. A source that may be repeated
queues up again behind itself. In the order of these times every prefix of the mix has the target shares, but for one
document of each source; the mix is the prefix that fits the budget.

No group is ever ordered in one task. The shuffled order is a hash, cut into ranges; a range takes the sum of the
ranges before it from a table of (source, range) sums, and only what is within a range is sorted. The finish times
are cut into ranges in the same way.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseworks.llm.encoding import DEFAULT_TOKENIZER, count_tokens
from clauseworks.session import cut

MAX_SOURCES = 10_000
RANGE_ROWS = 50_000  # documents of a range, about; there are 2 ** 12 ranges at least
MIX = ["doc_id", "source", "copy", "n_tokens", "finish", "cum_tokens"]


def _targets(target: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and repeats by source; the table is read by the driver, so its size is checked."""
    rows = target.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    out: dict[str, tuple[float, int]] = {}
    for r in rows:
        if r["source"] is not None and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0:
            share, repeats = out.get(r["source"], (0.0, 0))
            out[r["source"]] = (max(share, float(r["target_share"])), max(repeats, int(r["max_repeats"])))
    return out


def sizes(docs: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every document that has a token."""
    return count_tokens(docs, ("doc_id", "source"), path=path).filter("n_tokens > 0")


def _before(sums: DataFrame, by: list[str], name: str) -> DataFrame:
    """To each range its tokens' sum before it; ``sums`` has a bounded number of ranges for each group."""
    w = Window.partitionBy(*by).orderBy(name) if by else Window.partitionBy(F.lit(0)).orderBy(name)
    return sums.withColumn("before", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"]).drop("tokens")


def mix(sized: DataFrame, target: DataFrame, budget: int | None = None, seed: int = 17, range_bits: int | None = None) -> DataFrame:
    """The mix of ``sized`` (doc_id, source, n_tokens): one row for each use of a document.

    ``budget`` is the mix's total size in tokens; without it, the largest for which every source still has its share
    within its repeats. Sources without documents are left out and the other shares are scaled to 1; a source that
    a given budget exhausts gives what it has. Documents without tokens and of other sources, null sources included,
    don't come out. A source named twice in ``target`` has its larger share and repeats. Rows that repeat a document
    count as documents. Ties of the shuffled order go by doc_id. An empty table gives an empty mix.
    """
    spark = sized.sparkSession
    wanted = _targets(target)
    sized = sized.select("doc_id", "source", "n_tokens").filter(F.col("source").isin(*wanted) if wanted else F.lit(False))
    counts = sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()
    have = {r["source"]: r["n"] for r in counts}
    if range_bits is None:
        range_bits = max(12, math.ceil(math.log2(1 + sum(r["docs"] for r in counts) / RANGE_ROWS)))
    total = sum(wanted[s][0] for s in have)
    plan = [(s, wanted[s][0] / total, wanted[s][1], n) for s, n in have.items()]
    if budget is None:
        budget = int(min((n * repeats / share for _, share, repeats, n in plan), default=0))
    bound = spark.createDataFrame(plan, "source string, share double, repeats int, have bigint") if plan else _none(spark)
    key = F.xxhash64(F.lit(seed), F.col("source"), F.col("doc_id"))
    docs = sized.withColumn("key", key).withColumn("range", F.shiftrightunsigned("key", 64 - range_bits).cast("int"))
    before = _before(docs.groupBy("source", "range").agg(F.sum("n_tokens").alias("tokens")), ["source"], "range")
    # unsigned order of the hash within a range is its signed order, as the top bits are alike
    w = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    once = (
        docs.join(before, ["source", "range"])
        .withColumn("cum", F.col("before") + F.sum("n_tokens").over(w))
        .drop("before", "range", "key")
        .join(F.broadcast(bound), "source")  # at most MAX_SOURCES rows
    )
    end = F.lit(float(budget))
    # one document more than the share at most, so that the cut below is the budget's
    uses = F.least(F.col("repeats"), F.ceil(end * F.col("share") / F.col("have")).cast("int") + 1)
    used = (
        once.withColumn("copy", F.explode(F.sequence(F.lit(1), uses)))
        .withColumn("finish", ((F.col("copy") - 1) * F.col("have") + F.col("cum")) / F.col("share"))
        .withColumn("slot", F.least(F.floor(F.col("finish") / F.greatest(end, F.lit(1.0)) * (1 << range_bits)), F.lit(2 << range_bits)).cast("int"))
    )
    slots = _before(used.groupBy("slot").agg(F.sum("n_tokens").alias("tokens")), [], "slot")
    w = Window.partitionBy("slot").orderBy("finish", "source", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    return (
        used.join(slots.filter(F.col("before") < budget), "slot")
        .withColumn("cum_tokens", F.col("before") + F.sum("n_tokens").over(w))
        .filter(F.col("cum_tokens") <= budget)
        .select(*MIX)
    )


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "source string, share double, repeats int, have bigint")


def shares(mixed: DataFrame, sized: DataFrame, target: DataFrame) -> DataFrame:
    """The share that each source of ``target`` really has in the mix; 0 for sources without documents."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("uses"), F.max("copy").alias("most_copies"))
    there = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    all_used = used.agg(F.sum("used_tokens").alias("mix_tokens"))
    return (
        target.select("source", "target_share", "max_repeats")
        .join(there, "source", "left")
        .join(used, "source", "left")
        .join(F.broadcast(all_used), how="left")  # one row
        .fillna(0, ["tokens", "documents", "used_tokens", "uses", "most_copies", "mix_tokens"])
        .withColumn("reached_share", F.when(F.col("mix_tokens") > 0, F.col("used_tokens") / F.col("mix_tokens")).otherwise(0.0))
        .select("source", "target_share", "max_repeats", "tokens", "documents", "used_tokens", "uses", "most_copies", "mix_tokens", "reached_share")
    )


def sized_once(docs: DataFrame, path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``sizes``, computed once and kept in the shared checkpoint folder."""
    return cut(sizes(docs, path))
