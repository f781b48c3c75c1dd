import random

from clauseworks.llm import mixing

TARGET = [("big", 0.5, 1), ("small", 0.3, 3), ("mid", 0.2, 2), ("absent", 0.1, 4)]


def frames(spark, rows, target=TARGET):
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint"), spark.createDataFrame(target, "source string, target_share double, max_repeats int")


def test_shares_repeats_and_budget(spark):
    rng = random.Random(1)
    rows = [(k, s, rng.randint(1, 40)) for k, s in enumerate(["big"] * 3000 + ["small"] * 120 + ["mid"] * 400 + ["other"] * 50 + [None] * 5)]
    sized, target = frames(spark, rows)
    mixed = mixing.mix(sized, target, range_bits=5).cache()
    got = mixed.collect()
    have = {s: sum(n for _, x, n in rows if x == s) for s in ("big", "small", "mid")}
    budget = int(min(have[s] * r / (w / 1.0) for s, w, r in TARGET[:3]))
    used = {s: sum(r["n_tokens"] for r in got if r["source"] == s) for s in have}
    assert 0 <= budget - sum(used.values()) <= 40
    for s, w, _ in TARGET[:3]:
        assert abs(used[s] - w * budget) <= 40
    assert len({(r["doc_id"], r["copy"]) for r in got}) == len(got)
    assert all(r["copy"] <= {"big": 1, "small": 3, "mid": 2}[r["source"]] for r in got)
    # in the order of the finish times, the running total is that of the rows before
    total = 0
    for r in sorted(got, key=lambda r: r["cum_tokens"]):
        total += r["n_tokens"]
        assert r["cum_tokens"] == total
    order = sorted(got, key=lambda r: r["cum_tokens"])
    assert all(a["finish"] <= b["finish"] + 1e-6 for a, b in zip(order, order[1:]))
    report = {r["source"]: r for r in mixing.shares(mixed, sized, target).collect()}
    assert report["absent"]["reached_share"] == 0.0 and abs(report["small"]["reached_share"] - 0.3) < 0.01
    # the number of ranges doesn't change the mix
    assert {(r["doc_id"], r["copy"]) for r in mixing.mix(sized, target, range_bits=9).collect()} == {(r["doc_id"], r["copy"]) for r in got}


def test_given_budget_exhausts_a_source(spark):
    sized, target = frames(spark, [(k, "big", 10) for k in range(10)] + [(100 + k, "small", 10) for k in range(100)])
    got = mixing.mix(sized, target, budget=400).collect()
    assert sum(r["n_tokens"] for r in got if r["source"] == "big") == 100
    assert all(r["copy"] == 1 for r in got if r["source"] == "big")


def test_cases_without_a_mix(spark):
    sized, target = frames(spark, [(1, "other", 5), (2, None, 5)])
    assert mixing.mix(sized, target).collect() == []
    assert mixing.mix(sized.limit(0), target).collect() == []
    assert {r["reached_share"] for r in mixing.shares(mixing.mix(sized, target), sized, target).collect()} == {0.0}
    docs = spark.createDataFrame([(1, None, "big"), (2, "", "big"), (3, "some text", "big")], "doc_id bigint, text string, source string")
    assert [r["doc_id"] for r in mixing.sizes(docs).collect()] == [3]
