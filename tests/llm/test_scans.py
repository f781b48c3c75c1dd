import random

from hypothesis import given, settings
from hypothesis import strategies as st

from clauseworks.llm import scans

THINGS = "heater cabinet basket mirror carpet window shelf bucket kettle blanket hammer notice letter".split()
PEOPLE = ["tenant", "landlord", "owner", "caretaker", "agent"]


def sentence(rng):
    return f"The {rng.choice(PEOPLE)} shall return the {rng.choice(THINGS)} to the {rng.choice(PEOPLE)} for {rng.randrange(2, 90)} weeks and keep the {rng.choice(THINGS)} in the pantry."


def clause(rng, n):
    return " ".join(sentence(rng) for _ in range(n))


def wrapped(text, width=60):
    out = [""]
    for w in text.split():
        if len(out[-1]) + len(w) >= width:
            out.append("")
        out[-1] += " " * bool(out[-1]) + w
    return out


def corpus(spark):
    rng = random.Random(9)
    rows = [(k, clause(rng, 6)) for k in range(300)] + [(1000 + k, "\n".join(wrapped(clause(rng, 4)))) for k in range(50)]
    return rng, spark.createDataFrame(rows, "clause_id bigint, clause string")


def test_traces_and_repair(spark):
    rng, df = corpus(spark)
    known = scans.corpus_of(df)
    text = clause(rng, 5)
    lines = wrapped(text)
    assert scans.traces(text, known) == set() and scans.traces("\n".join(lines), known) == set()
    assert scans.traces("STORAGE RULES\n" + "\n".join(lines), known) == set()
    assert scans.traces("1. " + text.replace(". ", ".\n2. "), known) == set()
    assert scans.traces(text.replace(" ", "  "), known) == set()
    # a heading and a page number between the lines
    for furniture in (["Page 4"], ["- 12 -"], ["Standard Lease (rev. 3)", "17"], ["", "CONFIDENTIAL DRAFT COPY", ""], ["Page 3 of 20"]):
        scanned = "\n".join(lines[:3] + furniture + lines[3:])
        assert scans.traces(scanned, known) == {"heading"}, furniture
        assert scans.repair(scanned, known) == text
    # words broken over lines
    at = lines[2].rindex(" ") + 1
    word = lines[2][at:]
    for mark in ("-", "‐", "­", "¬"):
        broken = lines[:2] + [lines[2][: at + 2] + mark, lines[2][at + 2 :]] + lines[3:]
        if len(word) > 4:
            assert scans.traces("\n".join(broken), known) == {"broken"}
            assert scans.repair("\n".join(broken), known) == text
    # misread characters
    for wrong, right in (("landl0rd", "landlord"), ("harnmer", "hammer"), ("caretakcr", "caretaker"), ("wiridow", "window"), ("b|ucket", "bucket"), ("lefter", "letter"), ("k@rpet", "karpet")):
        assert known.meant(wrong) == ((right, known.meant(wrong)[1]) if right in known.words else None)
    spoilt = f"The landl0rd shall return the wiridow. {text}"
    assert scans.traces(spoilt, known) == {"misread"}
    assert scans.repair(spoilt, known) == f"The landlord shall return the window. {text}"


def test_traces_that_only_a_joint_reading_shows(spark):
    rng, df = corpus(spark)
    known = scans.corpus_of(df)
    text = clause(rng, 3)
    # a misreading in a part of a word that is broken without a hyphen
    for left, right in (("blan", "kct"), ("landl", "0rd"), ("carct", "aker")):
        broken = f"The tenant shall keep the {left}\n{right} in the pantry. {text}"
        assert scans.traces(broken, known) == {"broken"}, (left, right)
    # a short misread word at the end of a line
    assert scans.traces(f"The tenant shall return thc\nmirror to the agent. {text}", known) == {"misread"}
    # parts of broken words aren't misread words
    assert scans.traces(f"The tenant shall return the mir\nror to the agent. {text}", known) == {"broken"}


def test_words_torn_apart_and_run_together(spark):
    rng, df = corpus(spark)
    known = scans.corpus_of(df)
    text = clause(rng, 3)
    for spoilt, kind in ((f"The tenantshall return the mirror. {text}", "run together"), (f"The te nant shall return the mirror. {text}", "merged"), (f"The ten ant shall return the mirror. {text}", "merged")):
        assert scans.traces(spoilt, known) == {kind}, spoilt
        assert scans.repair(spoilt, known) == f"The tenant shall return the mirror. {text}"
    assert scans.repair("returntothelandlord", known) == "return to the landlord"
    # spaces in wrong places are mended where they stand and don't make a text a scanned one
    two = f"The tenantshall return the mirror.\n\n  {text}"
    assert scans.repair(two, known) == two.replace("tenantshall", "tenant shall")
    assert scans.scanned(spark.createDataFrame([(1, two)], "clause_id bigint, clause string").unionByName(df)).filter("clause_id = 1").isEmpty()
    # a misreading within a torn word, and words run together of which one is misread
    assert scans.repair(f"The land l0rd shall return the mirror. {text}", known).startswith("The landlord shall return")
    assert scans.repair(f"The tenantsha1l return the mirror. {text}", known).startswith("The tenant shall return")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def spoil(rng, text):
    """``text`` in lines, with words broken over them, characters misread and headings between."""
    lines = [""]
    for w in text.split():
        if len(lines[-1]) + len(w) > 58:
            k = rng.randrange(2, len(w) - 1) if len(w) > 5 and rng.random() < 0.4 else 0
            lines[-1] += (" " + w[:k] + rng.choice(["-", "", "¬"])) * bool(k)
            w = w[k:]
            lines.append("")
        lines[-1] += " " * bool(lines[-1]) + w
    out = []
    for line in lines:
        for k in range(len(line)):
            read = [r for r, m in scans.MEANT.items() if line.startswith(m[0], k)]
            if line[k : k + 1].isalpha() and read and rng.random() < 0.012:
                r = rng.choice(read)
                line = line[:k] + r + line[k + len(scans.MEANT[r][0]) :]
        out.append(line)
    out.insert(rng.randrange(1, len(out)), rng.choice(["Page 4", "- 12 -", "Standard Lease (rev. 3)"]))
    return "\n".join(out)


def test_planted_noise_is_undone(spark):
    rng, df = corpus(spark)
    known = scans.corpus_of(df)
    before = after = size = 0
    for _ in range(40):
        text = clause(rng, 4)
        noisy = spoil(rng, text)
        before += distance(text, noisy.replace("\n", " "))
        after += distance(text, scans.repair(noisy, known))
        size += len(text)
        assert scans.repair(text, known) == text and scans.traces(text, known) == set()
    assert before / size > 0.03 and after / size < 0.003, (before / size, after / size)


def test_a_corpus_is_sent_whole(spark):
    import pickle

    rng, df = corpus(spark)
    known = scans.corpus_of(df)
    again = pickle.loads(pickle.dumps(known))
    text = spoil(rng, clause(rng, 4))
    assert scans.repair(text, again) == scans.repair(text, known) and again.pair_cost("the", "tenant") == known.pair_cost("the", "tenant")


def test_numbers_on_a_line_of_their_own(spark):
    rng, df = corpus(spark)
    known = scans.corpus_of(df)
    assert scans.furniture(["The tenant shall return the heater to the owner for", "16", "weeks and keep it."], known) == []
    assert scans.furniture(["The tenant shall return the", "16", "heater to the owner."], known) == [1]


def test_paragraphs():
    assert scans.paragraphs(["One line that", "goes on here.", "", "A new one."]) == [["One line that", "goes on here."], ["A new one."]]
    assert scans.paragraphs(["One line that", "", "goes on here."]) == [["One line that", "", "goes on here."][::2]]
    assert scans.paragraphs([]) == [] and scans.paragraphs(["", " "]) == []


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab 1\n-.Page|@~"), max_size=60))
def test_any_text_is_decoded(text):
    known = scans.Corpus({"a": 0.5, "ab": 0.3, "page": 0.2}, frozenset(), frozenset())
    out = scans.repair(text, known)
    assert isinstance(out, str) and (scans.traces(text, known) or out == text)


def test_frame_cases(spark):
    rng, df = corpus(spark)
    long = clause(rng, 3000)
    extra = spark.createDataFrame([(5000, None), (5001, ""), (5002, " \n"), (5003, "x" * 20_000), (5004, long), (5005, long + "\nPage 7\n" + long), (5005, long + "\nPage 7\n" + long)], "clause_id bigint, clause string")
    both = df.unionByName(extra).selectExpr("*", "1 as text")
    assert sorted(r["clause_id"] for r in scans.scanned(both).collect()) == [5005, 5005]
    text = {r["clause_id"]: r["text"] for r in scans.repaired(both).filter("clause_id >= 5000").collect()}
    assert text[5000] is None and text[5001] == "" and text[5002] == " \n" and text[5004] == long
    assert "Page 7" not in text[5005]
    assert scans.scanned(both.limit(0)).collect() == []
