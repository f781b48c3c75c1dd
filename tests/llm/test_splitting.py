from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from clauseworks.llm import splitting

TEXTS = st.lists(st.text(st.sampled_from("ab. \n!"), max_size=120) | st.text("x", max_size=90), min_size=1, max_size=5)


def pieces(all_texts, limit, overlap):
    found = [splitting.boundaries(t, overlap) if t else (np.zeros(0, np.int64), np.zeros(0, np.int8)) for t in all_texts]
    return splitting.cuts(np.array([len(t) for t in all_texts]), [f[0] for f in found], [f[1] for f in found], limit, overlap)


def greedy(text, limit, overlap):
    """One cut after the other, as the doubling must find them."""
    at, level = splitting.boundaries(text, overlap)
    natural = at[level > 0]
    out, start, done = [], 0, 0
    while True:
        reach = min(start + limit, len(text))
        end = reach
        if reach < len(text):
            for k in (3, 2, 1, 0):
                fit = at[(level >= k) & (at > (max(done, start + limit // 2) if k else done)) & (at <= reach)]
                if len(fit):
                    end = int(fit[-1])
                    break
        out.append((start, end))
        if end == len(text):
            return out
        begin = natural[natural >= end - overlap]
        start = int(begin[0]) if len(begin) and begin[0] < end else max(end - overlap, 0)
        done = end


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_doubling_finds_the_greedy_cuts(all_texts):
    text, start, end = pieces(all_texts, 40, 8)
    for k, t in enumerate(all_texts):
        got = [(int(a), int(b)) for a, b in zip(start[text == k], end[text == k])]
        assert got == (greedy(t, 40, 8) if t else [(0, 0)])
        assert all(b - a <= 40 for a, b in got)
        assert got[0][0] == 0 and got[-1][1] == len(t)
        rebuilt, at = "", 0
        for a, b in got:
            assert a <= at and at - a <= 8 and (b > at or not t)
            rebuilt += t[at:b]
            at = b
        assert rebuilt == t


def test_natural_boundaries_come_first():
    text = "One sentence here. Another one here.\n\nNew paragraph with a few words in it and more."
    assert splitting.boundaries("ab cd. ef\n\ngh")[0].tolist() == [3, 7, 11, 13]
    assert splitting.boundaries("ab cd. ef\n\ngh")[1].tolist() == [1, 2, 3, 3]
    assert greedy(text, 50, 10)[0] == (0, text.index("New"))


def test_frame_cases(spark):
    long = "Rent is due. " * 2_000
    rows = [(1, None, 1), (2, "", 1), (3, "a" * 1500, 1), (4, "a" * 1501, 1), (4, "a" * 1501, 1), (5, long, 1), (6, " " * 4000, 1)]
    df = spark.createDataFrame(rows, "clause_id bigint, clause string, piece int")
    got = splitting.split(df).collect()
    assert [r["text"] for r in got if r["clause_id"] == 1] == [None]
    assert [r["text"] for r in got if r["clause_id"] == 2] == [""]
    assert sum(r["clause_id"] == 3 for r in got) == 1
    assert sum(r["clause_id"] == 4 for r in got) == 4
    assert all(len(r["text"] or "") <= 1500 and r["overlap"] <= 150 for r in got)
    whole = "".join(r["text"][r["overlap"] :] for r in sorted((r for r in got if r["clause_id"] == 5), key=lambda r: r["piece"]))
    assert whole == long
    assert splitting.split(df.limit(0)).collect() == []


def test_points_of_abbreviations_end_no_sentence():
    text = "The rule of Mr. Wong under s. 22 and J. Doe holds. It is new."
    at, level = splitting.boundaries(text)
    sentences = [text[:a].rstrip()[-6:] for a, k in zip(at, level) if k == 2]
    assert sentences == ["holds."]
