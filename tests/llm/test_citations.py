import pytest
from hypothesis import given
from hypothesis import strategies as st

from clauseworks.llm import citations
from clauseworks.llm.citations import meant, normalise, within

ACTS = frozenset({"rta"})
ENTRIES = [(1, "RTA s. 23(1)", "Costs of fire drills"), (2, "RTA s. 163", "Records of late charges"), (3, "RTA Reg. 17 s. 1", "Scope of rent receipts"), (4, "RTA s. 5(2)", "Costs of late charges")]
CASES = {
    "rta sec. 23(1).": 1, "RTA s 23 (1)": 1, "(RTA ss. 23(1))": 1, "23(1) RTA": 1, "section 23(1) of the RTA": 1, "RTA, subsection (1) of section 23": 1,
    "s. 23, subs. 1 RTA": 1, "RTA, art. 23 par. 1": 1, "RTA section twenty-three, subsection one": 1, "Resid. Ten. Act s. 23(1)": 1, "R.T.A. s. 23(l)": 1,
    "RTA s. 23(i)": 1, "RTA s.23（1）": 1, "Residental Tenancies Act s. 23(1)": 1, "RTA s. 23(1) - Costs of fire drills": 1, "residentialtenanciesact s. 163": 2,
    "RTA section one hundred and sixty-three": 2, "RTA §163": 2, "163 RTA": 2, "RTA Reg 17/s.1": 3, "Residential Tenancies Act, Regulation 17, s. 1": 3, "s. 1 of RTA Reg. 17": 3,
    "RTA s. 5O(2)": -1, "RTA s. 23": -1, "RTA s. 23(12)": -1, "RTA s. 163(1)": -1, "Dwelling Standards Act, section 23(1)": -1, "Fire By-law s. 163": -1, "file TSL-17-1": -1, "the Act": -1,
    "COSTS OF FIRE DRILLS": 1, "cots of firre drills (RTA)": 1, "fire drills (costs of)": 1, "re: fire drills, costs": 1, "RTA provision on late charges: records": 2, "Costs - late charges": 4,
    "Records of fire drills": -1, "Costs of road salt": -1, "see above": -1,
}


def test_edits():
    assert within("fire", "fier", 2) == 1 and within("fire", "fires", 1) == 1 and within("fire", "lease", 2) is None
    assert meant("drills fire csots", "costs of fire drills") == 1
    assert meant("records of fire drills", "costs of fire drills") is None
    assert meant("costs of fire drills today", "costs of fire drills") is None


@given(st.integers(1, 999), st.integers(1, 30))
def test_a_code_has_one_form(section, subsection):
    form = normalise(f"RTA s. {section}({subsection})", ACTS)
    assert form == ("number", f"rta s {section} {subsection}")
    assert normalise(f"section {section}({subsection}) of the Residential Tenancies Act", ACTS) == form


@given(st.text(max_size=30))
def test_any_text_has_a_form(text):
    assert normalise(text, ACTS)[0] in ("number", "words", "none")


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame(ENTRIES, "section_id int, code string, heading string")


def test_meaning(spark, entries):
    values = list(CASES)
    results = spark.createDataFrame([(k, [v]) for k, v in enumerate(values)], "result_id bigint, citations array<string>")
    got = {values[r["result_id"]]: r["section_id"] for r in citations.map_citations(results, entries).collect()}
    assert got == CASES


def test_frame_cases(spark, entries):
    rows = [(1, None, "x"), (2, [], "x"), (3, [None, " ", "​", "RTA s. 163", "RTA s 163"], "x"), (3, ["RTA s 163"], "x"), (4, ["a" * 20_000], "x"), (None, ["RTA s 163", "RTA s 163"], "x")]
    results = spark.createDataFrame(rows, "result_id bigint, citations array<string>, value string")
    got = sorted((r["result_id"] or 0, r["pos"], r["section_id"]) for r in citations.map_citations(results, entries).collect())
    assert got == [(0, 0, 2), (0, 1, 2), (3, 0, 2), (3, 4, 2), (4, 0, -1)]
    assert citations.map_citations(results.limit(0), entries).collect() == []
    assert {r["section_id"] for r in citations.map_citations(results, entries.limit(0)).collect()} == {-1}
