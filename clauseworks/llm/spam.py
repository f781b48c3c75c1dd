"""Problem 9: pages of repeated keywords, links or tags instead of sentences.

A page's words give a rank-frequency curve. SQL windows rank the curve and fit a line to it in logarithms; its
slope and residual, and the divergence of the page's words from its language's, are set against the prose of the same
language and a comparable length, and pages far beyond it are flagged. The parts of links are words here too, which no
prose has, so that lists of links are extreme. Inventories, contents and accounts are as extreme, so a check
confirms what is flagged: segments of keywords, links and tags must be more than half of the page's characters.

Everything that needs a page's words happens in one pass over the texts, so that only curves are shuffled: a curve
has a row for each distinct frequency, not for each word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.llm.arrow import per_batch, per_task, texts
from clauseworks.llm.languages import FUNCTION_WORDS, language

WORD = re.compile(r"[^\W_]+")
LINK = re.compile(r"(?:<a\s[^>]*>)|(?:\b(?:https?|ftp)://|\bwww\.)[^\s<>\"'()\[\]]+|</a>", re.I)
TAG = re.compile(r"(?<![^\s,;|(])[#@][^\W_][\w-]*")
BRACKETS = re.compile(r"\[(?=[^\[\]]*[^\W\d_])[^\[\]]+\](?!\()")  # tags in brackets; [12] is a number, and [a](b) a link
LINES = re.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+")
PARTS = re.compile(r"(?<=[.!?;,])\s+|\s+[|*•·–—/]+\s+")
SENTENCES = re.compile(r"(?<=[.!?])\s+")
LINE = 120  # a line up to this length is cut at the ends of sentences only
MODEL_SHARE = 1e-5  # words with a smaller share of their language count as this
OVER, PAGE_SHARE, TIMES = 8.0, 0.004, 2  # how much more often, how large a part of the page, and how often at least
COVER, SHARE = 0.5, 0.5  # of a segment, of a page
EXTREME = 5.0  # half interquartile ranges
KEPT, COPIES = 500_000, 2048  # words that a task counts before it gives them out; pages whose measures a task keeps
# One-letter words, which several languages have.
FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split()) | frozenset("a i s t d l o e y à é n".split())


def _without_links(text: str) -> str:
    return LINK.sub(" ", text) if "://" in text or "ww." in text.lower() or "</" in text else text


def segments(text: str):
    """The sentences of a text's lines, and the parts of long lines."""
    for line in LINES.split(text):
        yield from (PARTS if len(line) > LINE else SENTENCES).split(line)


def _counts(column: str):
    """Word counts by language of the prose of a task's texts: of lines with many function words. Lists of keywords
    have few, so they don't make their words usual."""
    by: dict[str, Counter[str]] = {}

    def add(batch: pa.RecordBatch) -> bool:
        for t in texts(batch.column(column)):
            prose = Counter()
            for line in LINES.split(_without_links(t).lower()):
                words = WORD.findall(line)
                if len(words) > 4 and sum(map(FUNCTION.__contains__, words)) * 4 >= len(words):
                    prose.update(words)
            lang = language(prose)
            if lang:
                by.setdefault(lang, Counter()).update(prose)
        return sum(map(len, by.values())) > KEPT

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
        by.clear()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    return add, flush


def word_shares(docs: DataFrame, text: str = "text") -> dict[str, dict[str, float]]:
    """The share of each word in all sentences of its language, of the words that have ``MODEL_SHARE``: at most
    1 / MODEL_SHARE words for each of the few languages, whatever the input. "und" has the shares in all languages."""
    counts = per_task(docs.select(text), "lang string, word string, n bigint", _counts, text).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(total), "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= MODEL_SHARE)
    out: dict[str, dict[str, float]] = {}
    for r in kept.select("lang", "word", "share").toLocalIterator():
        out.setdefault(r["lang"], {})[r["word"]] = r["share"]
    every: dict[str, float] = {}
    for shares in list(out.values()):
        for w, x in shares.items():
            every[w] = max(every.get(w, 0.0), x)
    return out | {"und": every}


def keywords(counts: Counter[str], n: int, shares: dict[str, float]) -> tuple[frozenset[str], frozenset[str]]:
    """Words that the page says far more often than its language does, and those that it says at every turn."""
    least = max(TIMES, PAGE_SHARE * n)
    keys = frozenset(w for w, c in counts.items() if c >= least and w not in FUNCTION and len(w) > 1 and not w.isdigit() and c / n >= OVER * shares.get(w, MODEL_SHARE))
    return keys, frozenset(w for w in keys if counts[w] >= max(5, 0.05 * n))


def is_spam(segment: str, keys: frozenset[str], main: frozenset[str] = frozenset()) -> bool:
    """Whether links, tags and keywords make up most of a segment that is neither a sentence nor a record.

    A sentence has function words for a third of its words, or for a quarter if it says nothing of what the page
    says at every turn, says no keyword twice, and something besides what the page says at every turn; a record has
    numbers.
    """
    links = sum(len(m) for m in LINK.findall(segment))
    rest = LINK.sub(" ", segment) if links else segment
    if "#" in rest or "@" in rest:
        links += sum(len(m) for m in TAG.findall(rest))
        rest = TAG.sub(" ", rest)
    if "[" in rest and len(tags := BRACKETS.findall(rest)) > 1:
        links += sum(map(len, tags))
        rest = BRACKETS.sub(" ", rest)
    words = [w.lower() for w in WORD.findall(rest)]
    letters = links + sum(map(len, words))
    if links >= COVER * max(letters, 1):
        return True
    said = [w for w in words if w in keys]
    if links + sum(map(len, said)) < COVER * max(letters, 1):
        return False
    if any(w.isdigit() for w in words):
        return False
    usual = sum(w in FUNCTION for w in words)
    if len(set(said)) < len(said) or len(words) > 2 and len(said) + usual == len(words) and not main.isdisjoint(said):
        return True
    if len(words) < 5:  # a phrase: "rent to own"
        return usual * 3 <= len(words)
    return usual * 3 < len(words) and (usual * 4 < len(words) or not main.isdisjoint(said))


def spam_share(text: str, keys: frozenset[str], main: frozenset[str] = frozenset()) -> float:
    """The part of the characters (white space aside) in segments that are mostly keywords, links or tags."""
    total = spam = 0
    for segment in segments(text):
        size = len("".join(segment.split()))
        if size:
            total += size
            if is_spam(segment, keys, main):
                spam += size
    return spam / total if total else 0.0


def divergence(counts: Counter[str], n: int, shares: dict[str, float]) -> float:
    """How far the page's words are from its language's, in nats for each word (Kullback-Leibler)."""
    return sum(c / n * math.log(c / n / shares.get(w, MODEL_SHARE)) for w, c in counts.items()) if n else 0.0


def _measure(key: str, column: str, shares):
    shares = shares.value
    kept: OrderedDict[bytes, tuple] = OrderedDict()  # by hash, so that long texts take no room here

    def one(t: str):
        name = blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        if name not in kept:
            if len(kept) >= COPIES:
                kept.popitem(last=False)
            kept[name] = measured(t)
        return kept[name]

    def measured(t: str):
        own = _without_links(t)
        counts = Counter(WORD.findall(own.lower()))
        n = sum(counts.values())
        lang = language(counts, least=max(2.0, 0.05 * n)) or "und"
        model = shares.get(lang) or shares["und"]
        keys, main = keywords(counts, n, model)
        links = len("".join(t.split())) - len("".join(own.split())) if own is not t else 0
        tags = sum(map(len, TAG.findall(own))) if "#" in own or "@" in own else 0
        tags += sum(map(len, BRACKETS.findall(t))) if "[" in t else 0
        covered = links + tags + sum(len(w) * counts[w] for w in keys)
        letters = links + sum(len(w) * c for w, c in counts.items())
        # segments of spam are covered for COVER at least, so that a page below this can't have the share
        share = spam_share(t, keys, main) if covered >= COVER * SHARE * letters > 0 else 0.0
        if own is not t:  # the curve and the divergence are those of the whole page, its links' parts among the words
            counts = Counter(WORD.findall(t.lower()))
            n = sum(counts.values())
        return lang, n, divergence(counts, n, model), share, sorted(Counter(counts.values()).items(), reverse=True)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [one(t) for t in texts(batch.column(column))]
        ends = [0]
        for o in out:
            ends.append(ends[-1] + len(o[4]))
        curve = pa.StructArray.from_arrays([pa.array([f for o in out for f, _ in o[4]], pa.int32()), pa.array([w for o in out for _, w in o[4]], pa.int32())], ["freq", "words"])
        return pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out]), pa.array([o[3] for o in out]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), curve)],
            [key, "lang", "n_words", "divergence", "spam_share", "curve"],
        )

    return run


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, n_words, divergence, spam_share, slope, residual) of each document."""
    shares = docs.sparkSession.sparkContext.broadcast(word_shares(docs, text))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, lang string, n_words int, divergence double, spam_share double, curve array<struct<freq:int,words:int>>"
    each = per_batch(docs.select(key, text), schema, _measure, key, text, shares).withColumn("row", F.monotonically_increasing_id())
    points = each.select("row", key, "lang", "n_words", "divergence", "spam_share", F.explode_outer("curve").alias("p")).select("*", F.col("p.freq").alias("freq"), F.col("p.words").alias("words")).drop("p")
    page = Window.partitionBy("row").orderBy(F.desc("freq"))
    # words of one frequency share ranks; their point is the geometric middle, with their number as its weight
    upto = F.sum("words").over(page)
    ranked = points.withColumn("x", F.log(F.sqrt((upto - F.col("words") + 1) * upto.cast("double")))).withColumn("y", F.log("freq")).withColumn("w", F.log(1.0 + F.col("words")))
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    sums = ranked.groupBy("row", key, "lang", "n_words", "divergence", "spam_share").agg(
        F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy")
    )
    sw, sx, sy, sxx, sxy, syy = map(F.col, ("sw", "sx", "sy", "sxx", "sxy", "syy"))
    spread, both, high = sxx - sx * sx / sw, sxy - sx * sy / sw, syy - sy * sy / sw
    slope = F.when(spread > 1e-9, both / spread).otherwise(0.0)
    residual = F.sqrt(F.greatest(F.when(spread > 1e-9, high - both * both / spread).otherwise(0.0), F.lit(0.0)) / sw)
    return sums.select(key, "lang", "n_words", "divergence", "spam_share", F.coalesce(slope, F.lit(0.0)).alias("slope"), F.coalesce(residual, F.lit(0.0)).alias("residual"))


def flags(measured: DataFrame, extreme: float = EXTREME) -> DataFrame:
    """``measured`` with ``flagged``: whether slope, residual or divergence is beyond ``extreme`` deviations of the prose
    of the same language and a comparable length.

    Prose are the pages with a language and without a share of spam. Where a language has none of the length, the
    prose of all languages stands for it; a page that no prose can be set against is flagged.
    """
    names = ("slope", "residual", "divergence")
    band = measured.withColumn("band", F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int"))
    prose = band.filter((F.col("lang") != "und") & (F.col("spam_share") == 0))
    quartiles = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000))
    # at most some tens of lengths for each of the few languages
    own = prose.groupBy("lang", "band").agg(*(quartiles(c).alias(f"{c}_q") for c in names))
    every = prose.groupBy("band").agg(*(quartiles(c).alias(f"{c}_e") for c in names))
    joined = band.join(F.broadcast(own), ["lang", "band"], "left").join(F.broadcast(every), "band", "left")
    out = F.col(f"{names[0]}_q").isNull() & F.col(f"{names[0]}_e").isNull()
    for c in names:
        q = F.coalesce(f"{c}_q", f"{c}_e")
        out = out | (F.abs(F.col(c) - q[1]) > extreme * F.greatest((q[2] - q[0]) / 2, F.lit(1e-3)))
    return joined.withColumn("flagged", F.coalesce(out, F.lit(True))).drop("band", *(f"{c}_{x}" for c in names for x in "qe"))


def chosen(measured: DataFrame, share: float = SHARE) -> DataFrame:
    """The pages of ``measured`` that their curve or divergence flags and their share of spam confirms."""
    return flags(measured).filter(F.col("flagged") & (F.col("spam_share") > share))


def spam(docs: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(key, lang, spam_share, slope, residual, divergence) of the pages that are spam; every copy has its row.

    Null, empty and blank texts aren't spam. An empty table gives an empty table.
    """
    return chosen(measures(docs, key, text), share).select(key, "lang", "spam_share", "slope", "residual", "divergence")
