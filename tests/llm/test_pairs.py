from hypothesis import given
from hypothesis import strategies as st

from clauseworks.llm import pairs
from clauseworks.llm.languages import of_text

CLAUSE = "The tenant shall store the garden hose in the shared pantry and return the spare key to the landlord before the end of the term, unless the owner agrees in writing."
GOOD = [
    "This clause on the garden hose respects the cited section.",
    "The part that lets the tenant keep the spare key does not go beyond the Act.",
    "Nothing in the text says who will store the garden hose.",
    "As written, the rule about the spare key may conflict with the provision listed.",
]
CASES = {
    "empty": [None, "", " \n", "​", "-", "n/a", "N/A", "[]", "(no answer)", "TBD", "null", "…"],
    "refusal": ["I'm sorry, but I can't assess this clause.", "Request declined.", "As an automated assistant, I must decline to review the passage.", "Je dois refuser cette demande ; consultez un juriste.", "No comment on the spare key from me.", "This falls outside my role; please try a legal clinic."],
    "copy": [CLAUSE, f'The clause states: "{CLAUSE}"', CLAUSE.lower(), CLAUSE[:120], CLAUSE.replace("garden", "water")],
    "other_language": ["La cláusula obliga al inquilino a entregar la llave, siempre que haya aviso previo.", "Die Klausel verpflichtet den Mieter, den Schlüssel zu übergeben, was zulässig erscheint.", "Ce passage sur la clé de rechange doit être revu par le locateur."],
    "truncated": ["This clause on the garden ho", "The part that lets the tenant keep the spare key does not go", "This clause on the garden hose respects the cited section. Nothing in the", "As written, the rule about the…", "Under RTA s."],
}


def frames(spark):
    rows = [(k, GOOD[k % len(GOOD)]) for k in range(80)]
    return pairs.sentence_frames(spark.createDataFrame(rows, "result_id bigint, reason string"))


def test_defects(spark):
    reasons = [(kind, r) for kind, rs in CASES.items() for r in rs] + [(None, g) for g in GOOD * 20] + [(None, g.rstrip(".")) for g in GOOD] + [(None, "Fine."), (None, "Allowed as written.")]
    results = spark.createDataFrame([(k, 1, r, ["RTA s. 4(1)"]) for k, (_, r) in enumerate(reasons)], "result_id bigint, clause_id bigint, reason string, citations array<string>")
    clauses = spark.createDataFrame([(1, CLAUSE)], "clause_id bigint, clause string")
    got = {r["result_id"]: r["defect"] for r in pairs.defects(results, clauses).collect()}
    wrong = [(reasons[k], got.get(k)) for k in range(len(reasons)) if got.get(k) != reasons[k][0]]
    assert not wrong


def test_a_quote_is_no_copy_and_words_of_refusal_are_no_refusal(spark):
    known, finals = frames(spark)
    quote = 'The clause says "The tenant shall store the garden hose in the" and more. This clause on the garden hose respects the cited section.'
    assert pairs.defect(quote, CLAUSE, None, 0.3, known, finals) is None
    assert not pairs.is_refusal("The guarantor may decline to store the hose, so the term does no harm.")
    assert not pairs.is_refusal("It is not possible for the tenant to store the garden hose as the text demands.")
    assert not pairs.is_refusal("I read the spare key rule as a duty on the tenant alone.")


def test_refusals_are_the_main_statement_of_any_sentence():
    for text in (
        "The clause sets the rent. It names a date. I cannot assess this clause.",
        "Evaluating this provision is something I am not going to do.",
        "Under s. 22 subs. 3, I can not, as things stand, judge the passage.",
        "My guidelines state that I can't comment on leases.",
        "I'm not prepared to give a view on the spare key.",
        "The rule names a key. Je ne suis pas en mesure d'évaluer cette clause.",
    ):
        assert pairs.is_refusal(text), text
    for text in (
        "The clause says I cannot be asked to assess damages, which is unfair.",
        "The clause says I cannot assess damages, which is unfair.",
        'The clause reads "I cannot assess damages" and is void.',
        "I read it twice. The tenant cannot assess the damages.",
        "I find that the landlord will not answer for the hose.",
        "I agree. Cannot be assessed by the tenant.",
    ):
        assert not pairs.is_refusal(text), text


def test_the_alignment_decides_on_copies(spark):
    known, finals = frames(spark)
    words = CLAUSE.split()
    some = " ".join("now" if k % 8 == 4 else w for k, w in enumerate(words))  # a word in eight is another
    other = " ".join(words[20:] + words[:20])
    shuffled = " ".join(sorted(words))
    assert pairs.defect(some, CLAUSE, None, 0.6, known, finals) == "copy" and pairs.defect(other, CLAUSE, None, 0.9, known, finals) == "copy"
    assert pairs.defect(some, CLAUSE, None, 0.3, known, finals) == "copy"
    assert pairs.defect(shuffled + ".", CLAUSE, None, 0.3, known, finals) != "copy"


def test_citations_that_break_off():
    for text in ("RTA s. (", "RTA se", "section", "R", "Resid", "RTA s. 50(1"):
        assert pairs.cut_citation([text]), text
    for text in ("RTA", "the Act", "RTA s. 50(1)", "see above", "common law", "75 RTA", "", None, "RTA, art. 6 par. 3"):
        assert not pairs.cut_citation([text]), text
    assert not pairs.cut_citation(None) and not pairs.cut_citation([]) and not pairs.cut_citation(["RTA s. (", "RTA s. 4"])


@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_lcs_is_that_of_the_table(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert pairs.lcs(a, b) == table[-1][-1]


def test_languages():
    assert of_text("The tenant is free to keep the key if the landlord agrees.") == "en"
    assert of_text("Le locataire peut garder la clé si le locateur consent par écrit.") == "fr"
    assert of_text("Ok.") is None and of_text("") is None


def test_frame_cases(spark):
    long = GOOD[0] + " " + "The tenant keeps the key. " * 4000
    rows = [(1, 1, None, None), (2, None, GOOD[0], []), (3, 9, GOOD[0], [None]), (4, 1, long, []), (5, 1, "", []), (5, 1, "", [])]
    results = spark.createDataFrame(rows, "result_id bigint, clause_id bigint, reason string, citations array<string>")
    clauses = spark.createDataFrame([(1, None), (2, "")], "clause_id bigint, clause string")
    got = sorted((r["result_id"], r["defect"]) for r in pairs.defects(results, clauses).collect())
    assert got == [(1, "empty"), (5, "empty"), (5, "empty")]
    assert pairs.defects(results.limit(0), clauses).collect() == []
    assert len(pairs.defects(results, clauses.limit(0)).collect()) == 3


def test_citations_that_break_off_behind_a_number():
    for cut in ("RTA s. 24 subs", "s. 22 of the Residential Ten", "RTA, art. 6 par"):
        assert pairs.cut_citation([cut]) and pairs.cut_citation([cut, None]), cut
    for whole in ("RTA s. 24", "s. 22 of the Residential Tenancies Act", "RTA s. 24 subs. 3", "s. 22(a)", "art. 6 RTA", "Section 5 - Rent"):
        assert not pairs.cut_citation([whole]), whole
