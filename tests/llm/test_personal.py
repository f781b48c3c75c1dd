import pickle
import random
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clauseworks.llm import personal

USERS = ["Maren Okaldenar", "Tobin Fioraworth", "Zofka Ushraesson", "Lucan Okaldworth", "Elske Fiorenar", "Jorvik Ushraworth-Okaldesson"]


@pytest.fixture(scope="module")
def model(spark):
    return personal.known_names(spark.createDataFrame([(n,) for n in USERS], "name string"))


CASES = {
    "Write to maren.okaldenar@mail.example.com at once.": {"email"},
    "E-mail: zofka dot fioraworth at tenants dot invalid": {"email"},
    "takes notices at fioraworth_54 [at] example [dot] net only.": {"email"},
    "copy (tobin+lease ＠ example.org) the same week": {"email"},
    "Tel. 541-555-0106": {"phone"},
    "Call +1(541)555-0106 before moving.": {"phone"},
    "En cas d'urgence, +999 9 12 53 58 11.": {"phone"},
    "answers 877 038 8676 ext. 53 after hours": {"phone"},
    "text three zero four, five five five, zero one zero four at once": {"phone"},
    "Identity was checked (SIN: 078 745 892) at signing.": {"id_number"},
    "The file shows driver's licence W3437-78022-47412.": {"id_number"},
    "Identification on file: health card 8153-898-625-ZX.": {"id_number"},
    "gave tax number 072796524 as proof": {"id_number"},
    "birth\ncertificate no. 1911-Z-441860": {"id_number"},
    "The unit is at 1292 Tilden Row Blvd.": {"address"},
    "lives at 676, rue du Moulin-Bas, Wexcombe Mills since": {"address"},
    "left at #693 - 63 Windrow Street and": {"address"},
    "at 1611 dovecote blvd, karrow after 88 reminders": {"address"},
    "Signed by Maren Okaldenar-Fioraworth.": {"name"},
    "Tenant: FIORAWORTH, Tobin": {"name"},
    "Signé par Mme Ushraesson au nom de": {"name"},
    "Contact t. okaldenar, tobin@x.example.": {"name", "email"},
    "signed by zofka fioraworth on": {"name"},
    "Mr. Okonkwo signed.": {"name"},
    "Signed by Ivan Petrovich.": {"name"},
    "During the tenancy, Xiomara Nguyen-Obi keeps the key.": {"name"},
    "During the tenancy, Maren Okaldenar may repaint it.": {"name"},
    "Signed by Maren Wong.": {"name"},
    "Mr. Li signed.": {"name"},
    "Call 0171 555 2311 now.": {"phone"},
    "Write to jean chez exemple point fr today.": {"email"},
    "We live at Bahnhofstrasse 12.": {"address"},
    "The owner answers 046-6316 after hours.": {"phone"},
    "About the claim form, text 722.071.1770 at once.": {"phone"},
    "Maren is a fine first name alone.": set(),
    "Invoice 47-6605-58 lists 7 @ $276.40 for the sign.": set(),
    "The meter bears serial 597 967 564-11 as of 2020-04-09.": set(),
    "See file TSL-83744-20, page 17, and form RL-31 of 2019-07-07.": set(),
    "Harrowgate Court is run by Pellworth Holdings Ltd.": set(),
    "up to 42\nBrackenmoor Terrace — Residential Tenancy Agreement\nitems": set(),
    "for 71 nights in a row, across the side lane": set(),
    "Unit 6A and stall P3-74 cost $2,967.55 from 1 June to 3 July.": set(),
    "The Saint-Orvin Tenancy Board may ask for it.": set(),
}


def test_kinds(model):
    wrong = {t: (k, got) for t, k in CASES.items() if (got := {s[2] for s in personal.segments(t, model)}) != k}
    assert not wrong


def test_held_out_text(model):
    """Texts with other names, numbers and places than those that the weights are fitted on."""
    found = true = both = 0
    for text, gold in personal.training(["solveig", "amadou"], ["quarnstrand", "dembelovic"], 400, seed=99):
        got = set(personal.segments(text, model))
        found, true, both = found + len(got), true + len(gold), both + len(got & set(gold))
    assert both / true > 0.8 and both / found > 0.93, (both / true, both / found)


def test_boundaries_and_kinds_are_chosen_together(model):
    text = "Contact Maren Okaldenar, 12 Windrow Street, tel. 541-555-0106, maren dot okaldenar at example dot org."
    spans = personal.candidates(text, model.names)
    assert len(spans) > 12 and any(a[0] < b[1] and b[0] < a[1] and a[2] != b[2] for a in spans for b in spans)
    assert [(text[a:b], k) for a, b, k in personal.segments(text, model)] == [
        ("Maren Okaldenar", "name"), ("12 Windrow Street", "address"), ("541-555-0106", "phone"), ("maren dot okaldenar at example dot org", "email"),
    ]


def test_decode_finds_the_best_of_all_segmentations():
    rng = random.Random(2)
    for _ in range(200):
        spans = [(a, a + rng.randrange(1, 6), rng.choice(["name", "phone"]), (str(rng.randrange(3)),)) for a in (rng.randrange(12) for _ in range(rng.randrange(1, 7)))]
        weights = {k: {"bias": rng.uniform(-1, 1)} | {str(f): rng.uniform(-1, 1) for f in range(3)} for k in ("name", "phone")} | {"follow": {f"{a} {b}": rng.uniform(-1, 1) for a in ("name", "phone") for b in ("name", "phone")}}

        def score(chosen):
            own = sum(weights[spans[k][2]]["bias"] + weights[spans[k][2]][spans[k][3][0]] for k in chosen)
            return own + sum(weights["follow"][f"{spans[a][2]} {spans[b][2]}"] for a, b in zip(chosen, chosen[1:]))

        def ways(after, left):
            yield []
            for k in left:
                if spans[k][0] >= after:
                    yield from ([k, *rest] for rest in ways(spans[k][1], [j for j in left if j != k]))

        best = max(score(w) for w in ways(0, list(range(len(spans)))))
        assert abs(score(personal.decode(spans, weights)) - best) < 1e-9


def test_more_users_take_no_more_time(spark, model):
    made = personal.Invented(1, [], [])
    text = "The tenant shall store the lamp in the pantry. Signed by Maren Okaldenar. " * 20
    many = personal.known_names(spark.createDataFrame([(f"{made.syllables(1, 4)} {made.syllables(2, 5)}",) for _ in range(30_000)], "name string"))
    took = []
    for m in (model, many):
        personal.segments(text, m)
        began = time.perf_counter()
        for _ in range(20):
            personal.segments(text, m)
        took.append(time.perf_counter() - began)
    assert took[1] < 3 * took[0] + 0.05
    words = "The tenant shall store heavy blankets and wooden baskets behind the green curtain during winter months".split()
    assert sum(many.names.kind(w.lower()) in "FS" for w in words) == 0
    assert personal.segments("Signed by Maren Okaldenar.", pickle.loads(pickle.dumps(many))) == personal.segments("Signed by Maren Okaldenar.", many)


def test_placeholders_keep_the_rest(model):
    text = "Signed by Maren Okaldenar (1292 Tilden Row Blvd.), tel. 541-555-0106; pay $12."
    assert personal.redact(text, model) == "Signed by [NAME] ([ADDRESS]), tel. [PHONE]; pay $12."


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([*CASES, "\n", "é ", "x@", "12 "]), max_size=5).map(" ".join) | st.text(max_size=40))
def test_segments_are_in_order_and_what_is_outside_stays(model, text):
    found = personal.segments(text, model)
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    rest = personal.redact(text, model)
    at = 0
    for start, end, kind in found:
        assert rest.startswith(text[at:start] + personal.PLACEHOLDER[kind])
        rest, at = rest[len(text[at:start]) + len(personal.PLACEHOLDER[kind]) :], end
    assert rest == text[at:]


def test_frame_cases(spark):
    users = spark.createDataFrame([("Maren Okaldenar",), ("Tobin Fioraworth",), (None,), ("",), (" ",), ("Solo",)], "name string")
    names = personal.known_names(users)
    assert names.names.has("maren", "f") and names.names.has("okaldenar", "s") and not names.names.has("okaldenar", "f") and not names.names.has("solo", "f")
    long = "The tenant pays. " * 20_000 + "Call 541-555-0106."
    rows = [(1, None, 0), (2, "", 0), (3, long, 0), (4, "a@b.example c@d.example", 0), (4, "a@b.example", 0)]
    df = spark.createDataFrame(rows, "id bigint, clause string, kind int")
    got = sorted((r["id"], r["kind"]) for r in personal.find(df, "id", "clause", names).collect())
    assert got == [(3, "phone"), (4, "email"), (4, "email"), (4, "email")]
    text = {r["id"]: r["text"] for r in personal.redacted(df.filter("id < 4"), "id", "clause", names).collect()}
    assert text == {1: None, 2: "", 3: long.replace("541-555-0106", "[PHONE]")}
    assert personal.find(df.limit(0), "id", "clause", names).collect() == []
    assert personal.segments("Mr. Okonkwo signed.", personal.known_names(None)) and personal.segments("Mr. Okonkwo signed.", personal.known_names(users.limit(0)))


def test_every_form_of_an_email_reaches_the_model(model):
    for form in ("name at host point ca", "jean ( at ) mail.ca", "jean {at} mail.ca", "nom arrobas host point es", "jean (a) mail.ca", "nom arobase host point ca"):
        assert [k for _, _, k in personal.segments(f"Write to {form} today.", model)] == ["email"], form
