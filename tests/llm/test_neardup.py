import random
import re

import numpy as np
import pytest

from clauseworks.llm import neardup

VOCABULARY = [f"word{k}" for k in range(900)]


def brute(texts, threshold=0.5, least=20):
    """All pairs by the definition: distinct runs of three words."""
    found = set()
    sets = {}
    for k, t in texts:
        words = re.findall(r"[^\W_]+", (t or "").lower())
        if len(words) >= least:
            sets[k] = set(zip(words, words[1:], words[2:]))
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                found.add((a, b))
    return found


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(len(words))
        kind = rng.randrange(4)
        if kind == 0:
            words[k] = rng.choice(VOCABULARY)
        elif kind == 1:
            del words[k]
        elif kind == 2:
            words.insert(k, rng.choice(VOCABULARY))
        else:
            j = min(len(words), k + 12)
            words = words[:k] + words[j:] + words[k:j]
    return words


@pytest.fixture(scope="module")
def families():
    rng = random.Random(5)
    texts = []
    for _ in range(120):
        base = [rng.choice(VOCABULARY) for _ in range(rng.choice([18, 25, 40, 90, 200, 700]))]
        for _ in range(rng.choice([1, 2, 4])):
            texts.append(edited(rng, base, rng.randrange(0, 1 + len(base) // 12)))
    return [(k, " ".join(w)) for k, w in enumerate(texts)]


def test_pairs_are_those_of_brute_force(spark, families):
    df = spark.createDataFrame(families, "clause_id bigint, clause string")
    got = {(r["clause_id_a"], r["clause_id_b"]): r["similarity"] for r in neardup.pairs(df).collect()}
    wanted = brute(families)
    assert set(got) <= wanted
    assert len(set(got) & wanted) >= 0.99 * len(wanted)
    assert all(0.5 <= s <= 1 for s in got.values())


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    words = " ".join(rng.choice(VOCABULARY, 300))
    other = words.replace("word1", "word2")
    import pyarrow as pa

    text, value, _ = neardup.sets([words, other], 3, 3)
    out = neardup._sketched(pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([words, other])], ["k", "t"]), "k", text, value)
    a, b = (np.array(x.as_py(), np.int64).view(np.uint64) for x in out.column("sketch"))
    hamming = sum(int(x).bit_count() for x in a ^ b)
    ta, tb = (set(neardup.sets([t])[1].tolist()) for t in (words, other))
    assert 0 < hamming <= len(ta ^ tb)
    half = [x[: len(x) // 2] ^ x[len(x) // 2 :] for x in (a, b)]
    assert sum(int(x).bit_count() for x in half[0] ^ half[1]) <= hamming


def test_groups_hold_chains_copies_and_a_hot_text(spark):
    rng = random.Random(2)
    base = [rng.choice(VOCABULARY) for _ in range(80)]
    step = base[:56] + [rng.choice(VOCABULARY) for _ in range(24)]
    far = step[24:] + [rng.choice(VOCABULARY) for _ in range(24)]
    texts = [(k, " ".join(base)) for k in range(60)] + [(100, " ".join(step).upper()), (101, " ".join(far)), (200, " ".join(rng.choice(VOCABULARY) for _ in range(80)))]
    df = spark.createDataFrame(texts, "clause_id bigint, clause string")
    got = {r["clause_id"]: r for r in neardup.groups(df).collect()}
    linked = brute(texts)
    assert (0, 100) in linked and (0, 101) not in linked and (100, 101) in linked
    assert {got[k]["group"] for k in [*range(60), 100, 101]} == {0}
    assert got[200]["group"] == 200 and got[200]["links"] == 0
    assert got[5]["copies"] == 60 and got[5]["links"] == 1 and got[100]["links"] == 2
    assert len({(r["clause_id_a"], r["clause_id_b"]) for r in neardup.pairs(df).collect()}) == len(linked)


def hot_group(rng, base, copies, shares):
    """Copies of a base that is hot among the texts, and copies with runs of their own."""
    texts = [(k, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(30, 200)))) for k in range(200)]
    texts += [(1000 + k, " ".join(base)) for k in range(copies)]
    return texts + [(2000 + k, " ".join(base + [rng.choice(VOCABULARY) for _ in range(int(len(base) * x))])) for k, x in enumerate(shares)]


@pytest.mark.parametrize("words", [30, 60, 102, 240])
def test_additions_to_a_hot_text_are_found(spark, words):
    rng = random.Random(words)
    texts = hot_group(rng, [rng.choice(VOCABULARY) for _ in range(words)], 60, [k / 100 for k in range(40, 96, 5)])
    wanted = brute(texts)
    assert sum(a >= 1000 for a, b in wanted) >= 60 * 59 // 2 + 60 * 12
    df = spark.createDataFrame(texts, "clause_id bigint, clause string")
    got = {(r["clause_id_a"], r["clause_id_b"]) for r in neardup.pairs(df).collect()}
    assert got <= wanted and len(got) >= 0.98 * len(wanted)


def test_hot_signatures_are_cut_into_blocks(spark):
    import pyarrow as pa

    n = 5 * neardup.BLOCK + 17
    planes = lambda x: neardup._planes(np.array(x, np.uint64), neardup.CLASS_BYTES)
    what = [0] * n + [2] * n + [11, 11, 12, 12, 14, 14]
    batch = pa.RecordBatch.from_arrays([pa.array([neardup._planes(np.diff(np.array(what, np.uint64), prepend=np.uint64(0)), 4)]), pa.array([planes([*range(1, n + 1)] * 2 + [3, 5000, 3, 6000, 3, 5000])])], ["signatures", "classes"])
    out = pa.Table.from_batches(list(neardup._bucket_met((pa.scalar(7, pa.int32()),), [batch])))
    # what a task gives out grows with the classes, not with their pairs
    hot = [x for x in out["classes"].to_pylist() if x]
    assert sum(map(len, hot)) == 2 * n and max(map(len, hot)) <= neardup.BLOCK
    met = spark.createDataFrame(out.to_pylist(), neardup.MET)
    pairs = [(r["short_a"], r["short_b"]) for r in neardup.met_pairs(met).collect()]
    # two equal blocks make a candidate, one alone doesn't
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for b in range(2, n + 1) for a in range(1, b)} | {(3, 5000)}


def test_frame_cases(spark):
    text = " ".join(VOCABULARY[:30])
    rows = [(1, None, "z"), (2, "", "z"), (3, "too short", "z"), (4, text, "z"), (5, text, "z"), (5, text, "z"), (None, text, "z")]
    df = spark.createDataFrame(rows, "clause_id bigint, clause string, class string")
    assert [(r[0], r[1]) for r in neardup.pairs(df).collect()] == [(4, 5)]
    assert neardup.pairs(df.limit(0)).collect() == []
    assert {r["clause_id"] for r in neardup.groups(df).collect()} == {4, 5}


def test_pairs_of_hot_blocks_are_given_out_in_parts(spark):
    """A task holds and gives out a bounded number of pairs, however many blocks meet in one Arrow batch (F1)."""
    blocks, size = 12, neardup.BLOCK
    of = lambda k: list(range(k * size, (k + 1) * size))
    rows = [(7, None, None, 5, k, blocks, of(k)) for k in range(blocks)] + [(7, None, None, 9, k, 3, of(k)) for k in range(3)]
    met = spark.createDataFrame(rows, neardup.MET)
    assert neardup.met_pairs(met).distinct().count() == 3 * size * (3 * size - 1) // 2
    joined = [(of(a), of(b), a == b) for a in range(blocks) for b in range(a, blocks)]
    crossings = spark.createDataFrame(joined, "left array<bigint>, right array<bigint>, same boolean").coalesce(1)
    out = neardup.parted(crossings, neardup._crossed_pairs, 8)
    held = [(len(x["left"]) // neardup.CLASS_BYTES, len(x["right"]) // neardup.CLASS_BYTES) for x in out.collect()]
    n = blocks * size
    assert sum(a for a, _ in held) == sum(b for _, b in held) == n * (n - 1) // 2
    assert max(a for a, _ in held) < neardup.PAIRS_AT_ONCE // 4


def test_signatures_grow_with_their_classes(spark):
    import pyarrow as pa

    n, size = 300, 200
    what = np.repeat(np.arange(n, dtype=np.uint64), size)
    of = np.tile(np.arange(1, size + 1, dtype=np.uint64), n)
    batch = pa.RecordBatch.from_arrays([pa.array([neardup._planes(np.diff(what, prepend=np.uint64(0)), 4)]), pa.array([neardup._planes(of, neardup.CLASS_BYTES)])], ["signatures", "classes"])
    out = pa.Table.from_batches(list(neardup._bucket_met((pa.scalar(7, pa.int32()),), [batch])))
    assert out.nbytes < 3 * n * size * neardup.CLASS_BYTES
    got = neardup.met_pairs(spark.createDataFrame(out.to_pylist(), neardup.MET)).collect()
    assert len(got) == len(set(got)) == size * (size - 1) // 2
