import random

from clauseworks.llm import spam

PROSE = [
    "The tenant shall store the {a} in the pantry and return the {b} to the landlord before the end of the term.",
    "If the owner has not repaired the {a} within ten days, the tenant may ask the board for an order about the {b}.",
    "Most people keep the {a} near the door, because the {b} is too heavy to move.",
    "We had a long talk about the {a} last week, and it was not about the {b} at all.",
]
THINGS = "lamp chair ladder table heater cabinet basket mirror carpet window shelf bucket kettle blanket hammer".split()
CITIES = "Karrow Ostrey Sandrick Velde Tilverton Pellworth Holmstead".split()


def prose(rng, n):
    return " ".join(rng.choice(PROSE).format(a=rng.choice(THINGS), b=rng.choice(THINGS)) for _ in range(n))


def pages(rng):
    good = [prose(rng, rng.randrange(2, 40)) for _ in range(150)]
    good += ["\n".join(f"the {rng.choice(THINGS)} room: {rng.randrange(1, 9)} x old {rng.choice(THINGS)}, {rng.choice(['lost', 'sold', 'kept'])}" for _ in range(25)) for _ in range(5)]
    good += [prose(rng, 12) + "\nFurther reading:\n" + "\n".join(f"- {rng.choice(THINGS)}: https://www.pages.example/{rng.randrange(9999)}" for _ in range(4)) for _ in range(5)]
    good += ["\n".join(f"Q: Where is the {rng.choice(THINGS)}?\nA: It is in the hall, next to the {rng.choice(THINGS)}." for _ in range(12)) for _ in range(5)]
    keys = ["cheap flats", "downtown loft", "rent to own", "bad credit ok", "short stay"]
    bad = [" | ".join(rng.choice(keys) for _ in range(90)) for _ in range(4)]
    bad += ["\n".join(f"cheap flats in {rng.choice(CITIES)}" for _ in range(60)) for _ in range(4)]
    bad += ["\n".join(f"https://www.{rng.choice(THINGS)}.example/p/{rng.randrange(99999)}" for _ in range(40)) for _ in range(4)]
    bad += [" ".join("#" + rng.choice(["CheapFlats", "RentToOwn", "ShortStay"]) + rng.choice(CITIES) for _ in range(50)) for _ in range(4)]
    bad += [prose(rng, 2) + "\n" + " * ".join(rng.choice(keys) for _ in range(80)) for _ in range(4)]
    return good, bad


def test_spam_and_no_spam(spark):
    good, bad = pages(random.Random(4))
    rows = [(k, t) for k, t in enumerate(good)] + [(1000 + k, t) for k, t in enumerate(bad)] + [(2000, bad[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in spam.spam(df).collect()} == {k for k, _ in rows if k >= 1000}


def links(rng, size):
    out = []
    while sum(map(len, out)) < size:
        out.append(f"https://www.{rng.choice(THINGS)}-{rng.choice(CITIES).lower()}.example/{rng.choice(THINGS)}/{rng.randrange(99999)}")
    return "\n".join(out)


def test_links_with_ordinary_sentences(spark):
    rng = random.Random(8)
    rows = [(k, prose(rng, rng.randrange(1, 40))) for k in range(300)]
    for k in range(40):  # 60 to 95 % links
        text, part = prose(rng, rng.randrange(1, 12)), rng.choice([0.6, 0.75, 0.95])
        rows.append((1000 + k, text + "\n" + links(rng, len(text) * part / (1 - part))))
    for k in range(40):  # up to 25 % links
        text = prose(rng, rng.randrange(6, 20))
        rows.append((500 + k, text + "\n" + links(rng, len(text) * 0.15)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in spam.spam(df).collect()} == {1000 + k for k in range(40)}


def test_a_part_of_keywords_is_no_spam(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, 30)) for k in range(60)] + [(100, prose(rng, 30) + "\nTags: cheap flats, downtown loft, cheap flats, rent to own")]
    assert spam.spam(spark.createDataFrame(rows, "doc_id bigint, text string")).collect() == []


def test_curves_are_lines_in_logarithms(spark):
    words = [f"w{chr(97 + k)}" for k in range(20)]
    text = " ".join(w for k, w in enumerate(words) for _ in range(240 // (k + 1)))
    row = spam.measures(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()[0]
    assert abs(row["slope"] + 1) < 0.1 and row["residual"] < 0.1 and row["n_words"] == sum(240 // (k + 1) for k in range(20))


def test_frame_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "cheap flats " * 30_000, "x"), (4, "cheap flats " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert [r["doc_id"] for r in spam.spam(df).collect()] == [4, 4]
    assert spam.spam(df.limit(0)).collect() == []


def test_tags_in_brackets_are_tags_and_numbers_in_brackets_are_not(spark):
    rng = random.Random(5)
    tags = " ".join(f"[{rng.choice(['cheap flats', 'short stay', 'loft'])}] [sku-{rng.randrange(9999)} {rng.choice(THINGS)}]" for _ in range(40))
    decision = "\n".join(f"[{k}] {prose(rng, 1)}" for k in range(30))
    rows = [(k, prose(rng, rng.randrange(4, 30))) for k in range(100)] + [(500, tags), (501, prose(rng, 2) + "\n" + tags), (600, decision)]
    assert {r["doc_id"] for r in spam.spam(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {500, 501}


def test_the_curve_decides_and_the_share_confirms(spark):
    """Without the curve, or without the share, other pages would come out."""
    rng = random.Random(4)
    good, bad = pages(rng)
    rows = [(k, t) for k, t in enumerate(good)] + [(1000 + k, t) for k, t in enumerate(bad)]
    measured = spam.flags(spam.measures(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    by_share = {r["doc_id"] for r in measured if r["spam_share"] > spam.SHARE}
    by_curve = {r["doc_id"] for r in measured if r["flagged"]}
    assert by_share & by_curve == {1000 + k for k in range(len(bad))}
    assert by_curve - by_share and sum(k < 1000 for k in by_curve) <= 0.15 * len(good)  # the curve alone parts nearly all
    prose = [(k, "en", 100, 2.0 + 0.01 * (k % 9), 0.0, -0.6 + 0.01 * (k % 7), 0.1 + 0.01 * (k % 5)) for k in range(60)]
    cases = [(100, "en", 100, 2.05, 0.9, -0.57, 0.12), (101, "en", 100, 4.0, 0.9, -0.57, 0.12), (102, "en", 100, 2.05, 0.9, -1.5, 0.12), (103, "en", 100, 4.0, 0.4, -1.5, 0.9)]
    frame = spark.createDataFrame(prose + cases, "doc_id bigint, lang string, n_words int, divergence double, spam_share double, slope double, residual double")
    flagged = {r["doc_id"]: r["flagged"] for r in spam.flags(frame).collect()}
    assert [flagged[k] for k in (100, 101, 102, 103)] == [False, True, True, True]  # the first has the share of spam, and an ordinary curve
    assert {r["doc_id"] for r in spam.chosen(frame).collect()} == {101, 102}
