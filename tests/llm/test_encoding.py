import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clauseworks.llm import encoding

pytestmark = pytest.mark.skipif(not os.path.exists(encoding.DEFAULT_TOKENIZER), reason="no vocabulary files")
ODD = st.text(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　​﻿ab1.'!<|>éß日🙂́"), max_size=14)


def whole(text):
    return encoding.encoder().tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@given(ODD | st.text(max_size=20))
def test_chunks_give_the_ids_of_the_whole_text(text):
    ids = encoding.encoder().ids(text)
    assert ids == whole(text)
    assert encoding.decode(ids) == text
    assert encoding.encoder().count(text) == len(ids)


def test_special_tokens_in_a_text_are_text():
    assert encoding.decode(encoding.encoder().ids("a <|endoftext|> b")) == "a <|endoftext|> b"
    assert 50256 not in encoding.encoder().ids("a <|endoftext|> b")


def test_split_characters_and_spans():
    ids = encoding.encoder().ids("🙂日")
    assert len(ids) > 2
    assert encoding.decode(ids) == "🙂日"
    assert "�" in encoding.decode(ids[:1])
    spans = encoding.character_spans("né 🙂")
    assert spans[0][1] == 0 and spans[-1][2] == 4
    assert all(a < b for _, a, b in spans)
    assert encoding.offsets("né 🙂")[-1][2] == len("né 🙂".encode())


def test_frame_cases(spark):
    long = "word " * 50_000 + "x" * 5_000
    rows = [(1, None, 7), (2, "", 7), (3, " \n", 7), (4, "The lease.", 7), (4, "The lease.", 7), (5, long, 7), (None, "a", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = encoding.encode(df).collect()
    assert len(got) == 7
    by = {r["doc_id"]: r["ids"] for r in got}
    assert by[1] == [] and by[2] == []
    assert by[4] == whole("The lease.") and by[5] == whole(long)
    assert encoding.encode(df.limit(0)).collect() == []
    assert dict(encoding.encode(df).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    counts = {r["doc_id"]: r["n_tokens"] for r in encoding.count_tokens(df, ("doc_id",)).collect()}
    assert counts == {k: len(v) for k, v in by.items()}
