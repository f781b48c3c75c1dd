"""Problem 2: oversized texts in numbered pieces under a limit, with overlap.

Pointer doubling: every boundary of a text is joined to its farthest legal successor, the end of the piece that
would begin with the overlap before that boundary. Squaring the successor table again and again marks all boundaries
that a greedy cut from the text's start would reach, for all texts of an Arrow batch at once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clauseworks.llm.arrow import per_batch, texts

LIMIT, OVERLAP = 1500, 150
PARAGRAPHS = re.compile(r"\n\s*\n\s*")
# What has a point and doesn't end a sentence, besides initials.
ABBREVIATIONS = "Mr Mrs Ms Dr Mme Mlle St Ste Inc Ltd Apt Ave Blvd Rd s ss S sec Sec subs par para art Art reg Reg No no cl p pp e.g i.e".split()
SENTENCES = re.compile(r"(?:[.!?…;](?<![\s.(][A-Z]\.)" + "".join(rf"(?<!\b{re.escape(a)}\.)" for a in ABBREVIATIONS) + r"[\"'”’»)\]]*\s+)|\n\s*")
WORDS = re.compile(r"\s+")


def boundaries(text: str, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``text`` where a piece may end, and how natural they are: 3 after a paragraph, 2 after a
    sentence or line, 1 after a word, 0 within a run without any (every ``overlap // 2`` characters). The end counts 3."""
    n = len(text)
    level = np.zeros(n + 1, np.int8)
    is_end = np.zeros(n + 1, bool)
    for k, pattern in ((1, WORDS), (2, SENTENCES), (3, PARAGRAPHS)):
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        level[ends], is_end[ends] = k, True
    level[n], is_end[n] = 3, True
    at = np.flatnonzero(is_end[1:]) + 1
    step = max(1, overlap // 2)
    gaps = np.diff(at, prepend=0)
    for k in np.flatnonzero(gaps > step):
        is_end[np.arange(at[k] - gaps[k] + step, at[k], step)] = True
    at = np.flatnonzero(is_end[1:]) + 1
    return at, level[at]


def cuts(lengths: np.ndarray, ends: list[np.ndarray], levels: list[np.ndarray], limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every piece of texts given by their lengths and boundaries, in order."""
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])  # one position more for each text, so that none are shared
    text = np.repeat(np.arange(len(lengths)), [len(e) + 1 for e in ends])
    at = np.concatenate([np.concatenate([[0], e]) + f for e, f in zip(ends, first)])
    level = np.concatenate([np.concatenate([[3], x]) for x in levels])
    root = at == first[text]
    last = first[text] + lengths[text]
    natural = at[level > 0]
    # the piece after a boundary begins at the first natural boundary of the overlap, or at the overlap's length
    begin = natural[np.minimum(np.searchsorted(natural, at - overlap), len(natural) - 1)]
    begin = np.where((begin < at) & (begin >= first[text]), begin, at - overlap)
    begin = np.where(root, at, np.maximum(begin, first[text]))
    reach = np.minimum(begin + limit, last)
    half = np.maximum(at, begin + limit // 2)
    end = np.full(len(at), -1)
    for k in (3, 2, 1, 0):
        there = at[level >= k]
        far = there[np.maximum(np.searchsorted(there, reach, "right") - 1, 0)]
        end = np.where((end < 0) & (far > (half if k else at)) & (far <= reach), far, end)
    end = np.where((end < 0) | (reach == last), reach, end)
    successor = np.searchsorted(at, end)
    successor = np.where(at == last, np.arange(len(at)), successor)  # a text's end is its own successor
    reached, jump = root.copy(), successor
    while True:
        more = reached.copy()
        more[jump[reached]] = True
        if (more == reached).all():
            break
        reached, jump = more, jump[jump]
    node = np.flatnonzero(reached & ((at < last) | (root & (lengths[text] == 0))))
    return text[node], begin[node] - first[text[node]], at[successor[node]] - first[text[node]]


def _split(key: str, column: str, limit: int, overlap: int, with_text: bool):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_texts = texts(batch.column(column))
        lengths = np.fromiter(map(len, all_texts), np.int64, len(all_texts))
        # a text within the limit is one piece, whatever its boundaries
        found = [boundaries(t, overlap) if len(t) > limit else (np.array([len(t)] * (len(t) > 0), np.int64), np.full(int(len(t) > 0), 3, np.int8)) for t in all_texts]
        text, start, end = cuts(lengths, [f[0] for f in found], [f[1] for f in found], limit, overlap)
        number = np.arange(len(text)) - np.searchsorted(text, text)
        count = np.bincount(text, minlength=len(all_texts))[text]
        shared = np.where(number > 0, np.roll(end, 1) - start, 0)
        out = [batch.column(key).take(pa.array(text)), *(pa.array(x, pa.int32()) for x in (number, count, start, end, shared))]
        names = [key, "piece", "pieces", "char_start", "char_end", "overlap"]
        if with_text:
            missing = batch.column(column).is_null().to_pylist()
            out.append(pa.array([None if missing[t] else all_texts[t][a:b] for t, a, b in zip(text, start, end)], pa.string()))
            names.append("text")
        return pa.RecordBatch.from_arrays(out, names)

    return run


def split(df: DataFrame, key: str = "clause_id", text: str = "clause", limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Every text of ``df`` in pieces of at most ``limit`` characters (code points).

    ``piece`` counts from 0; ``char_start`` and ``char_end`` are places in the text, and the first ``overlap``
    characters of a piece are the last of the one before. Without its overlaps, the pieces are the text. A text within
    the limit, also a null or empty one, is one piece. Rows that repeat a key are split each for itself; other
    columns of ``df`` aren't read. An empty table gives an empty table.
    """
    if not 0 < overlap < limit // 2:
        raise ValueError("the overlap must be above 0 and under half the limit")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, pieces int, char_start int, char_end int, overlap int" + ", text string" * with_text
    return per_batch(df.select(key, text), schema, _split, key, text, limit, overlap, with_text)
