import datetime as dt

import pytest
from pyspark.sql import functions as F

from clauseworks.functions import scalars as S
from clauseworks.operators import clauses as C
from clauseworks.operators import identity, integrity, lookup, mutate, relations, retrieve, rollup, validation

T = dt.datetime(2026, 1, 2, 3, 4, 5, 678000)
NOW = "2026-01-02 03:04:05.678"
USERS = [
    ("u1", "test@example.com", "Test User", None, "hash", False),
    ("u2", "sso@example.com", None, "", None, False),
    ("u3", "empty@example.com", "", "img", "", False),
    (None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(USERS, "id string, email string, name string, image string, password_hash string, email_verified boolean")


def codes(df, key="request"):
    return {r[key]: r["code"] for r in df.collect()}


def test_signup(spark, users):
    rows = [(1, "new@example.com", "test1234", "Test User"), (2, "noname@example.com", "test1234", None), (3, "not-an-email", "test1234", None), (4, "short@example.com", "123", None), (5, "test@example.com", "test1234", "Duplicate"), (6, "new@example.com", "test1234", None), (7, None, "test1234", None), (8, "blank@example.com", "test1234", ""), (9, "space@example.com", "test1234", " "), (10, "emoji@example.com", "😀😀😀😀", None)]
    got = validation.signup(spark.createDataFrame(rows, "request int, email string, password string, name string"), users)
    assert codes(got) == {1: 201, 2: 201, 3: 400, 4: 400, 5: 409, 6: 409, 7: 400, 8: 400, 9: 201, 10: 201}
    issues = {r["request"]: r["issue"] for r in got.collect()}
    assert "8" in issues[4] and issues[3] == "Invalid email" and issues[8] == "Name is empty" and issues[1] is None
    assert validation.signup(got.select("request", "email", "password", "name").limit(0), users).collect() == []


def test_login(spark, users):
    rows = [(1, "test@example.com", "x"), (2, "sso@example.com", "x"), (3, "empty@example.com", "x"), (4, "nobody@example.com", "x"), (5, "test@example.com", ""), (6, None, None)]
    assert codes(validation.login(spark.createDataFrame(rows, "request int, email string, password string"), users)) == {1: 200, 2: 401, 3: 401, 4: 401, 5: 400, 6: 400}


def test_deletion_order(spark):
    agreements = spark.createDataFrame([("a", "u1"), ("a", "u1"), ("b", "u2")], "id string, user_id string")
    requests = spark.createDataFrame([(1, "a", "u1"), (2, "b", "u1"), (3, "c", "u1"), (4, "a", None), (5, None, "u1")], "request int, agreement_id string, caller string")
    assert codes(validation.deletion(requests, agreements)) == {1: 204, 2: 403, 3: 404, 4: 403, 5: 404}


def test_limits(spark):
    df = spark.createDataFrame([(20971520,), (20971521,), (None,)], "n long")
    assert [r[0] for r in df.select(validation.fits(F.col("n"))).collect()] == [True, False, False]


def test_lookup(spark, users):
    assert lookup.by_key(users, id="u1").count() == 1 and lookup.by_key(users, id=None).count() == 0
    rows = [("a", "u", T), ("b", "u", T), ("c", "u", None), ("d", "v", T), ("d", "v", T)]
    df = spark.createDataFrame(rows, "id string, user_id string, uploaded_at timestamp_ntz")
    assert [r["id"] for r in lookup.owned_by(df, "u").collect()] == ["a", "b", "c"]
    assert {(r["id"], r["place"]) for r in lookup.newest_for_each(lookup.once(df), "user_id", "uploaded_at", "id", 2).collect()} == {("a", 1), ("b", 2), ("d", 1)}
    assert lookup.owned_by(df, "none").isEmpty()


def test_link_decision(spark, users):
    accounts = spark.createDataFrame([("google", "g1", "u1")], "provider_id string, account_id string, user_id string")
    rows = [(1, "google", "g1", "other@example.com"), (2, "google", "g2", "sso@example.com"), (3, "google", "g3", "x@example.com"), (4, "google", "g4", "x@example.com"), (5, "google", "g3", "y@example.com"), (6, "google", "g5", None), (7, "google", "g6", None)]
    got = {r["arrival"]: (r["branch"], r["user_id"]) for r in relations.link_decision(spark.createDataFrame(rows, "arrival int, provider_id string, account_id string, email string"), accounts, users).collect()}
    assert got == {1: ("returning", "u1"), 2: ("link", "u2"), 3: ("new", None), 4: ("link", None), 5: ("returning", None), 6: ("new", None), 7: ("new", None)}


def test_mutations(spark, users):
    filled = {r["id"]: r for r in mutate.fill_profile(users, spark.createDataFrame([("sso@example.com", "N", "I"), ("empty@example.com", "M", "J")], "email string, name string, image string")).collect()}
    assert (filled["u2"]["name"], filled["u2"]["image"], filled["u2"]["email_verified"]) == ("N", "I", True)
    assert (filled["u3"]["name"], filled["u3"]["image"]) == ("M", "img") and filled["u1"]["email_verified"] is False
    tokens = spark.createDataFrame([(1, "a", "r"), (2, "a", "r"), (3, "a", "r")], "id int, access string, refresh string")
    changes = spark.createDataFrame([(1, "b", "s"), (2, "b", None)], "id int, access string, refresh string")
    assert {tuple(r) for r in mutate.update(tokens, changes, "id", keep_if_null=("refresh",)).collect()} == {(1, "b", "s"), (2, "b", "r"), (3, "a", "r")}
    once = mutate.insert_absent(tokens, spark.createDataFrame([(3, "z", "z"), (4, "n", "n"), (4, "m", "n")], tokens.schema), "id")
    assert {tuple(r) for r in once.collect()} == {(1, "a", "r"), (2, "a", "r"), (3, "a", "r"), (4, "m", "n")}
    assert {tuple(r) for r in mutate.insert_absent(once, once, "id").collect()} == {tuple(r) for r in once.collect()}


def test_sign_ins_one_after_the_other(spark):
    users = spark.createDataFrame([("u1", "known@x.org", "", None, False), ("u2", "other@x.org", "Other", "o.png", False)], "id string, email string, name string, image string, email_verified boolean")
    accounts = spark.createDataFrame([("k1", "u2", "g1", "google", "t0", "r0", T)], "id string, user_id string, account_id string, provider_id string, access_token string, refresh_token string, access_token_expires_at timestamp_ntz")
    rows = [
        (1, "google", "g1", "x@x.org", "X", "x.png", "t1", "r1", 60), (2, "google", "g1", "x@x.org", "X", "x.png", "t2", None, 10),  # returning twice: the refresh token stays
        (3, "google", "g2", "known@x.org", "", None, "t3", None, 10), (4, "other", "h2", "known@x.org", "Known", "k.png", "t4", "r4", 10),  # linked: empty fields are filled, first filled wins
        (5, "google", "g3", "new@x.org", None, None, "t5", "r5", 10), (6, "other", "h3", "new@x.org", "New", "n.png", "t6", None, 10), (7, "google", "g3", "else@x.org", "Else", None, "t7", None, 10),
        (8, "google", "g4", None, "Nobody", None, "t8", None, 10), (9, None, None, "z@x.org", "Z", None, "t9", None, 10),
    ]
    incoming = spark.createDataFrame(rows, "arrival int, provider_id string, account_id string, email string, name string, image string, access_token string, refresh_token string, expires_in int")
    new_users, new_accounts = identity.sign_in(users, accounts, incoming, NOW)
    u = {r["email"]: r for r in new_users.collect()}
    a = {(r["provider_id"], r["account_id"]): r for r in new_accounts.collect()}
    assert set(u) == {"known@x.org", "other@x.org", "new@x.org"} and len(a) == 5
    assert (u["known@x.org"]["name"], u["known@x.org"]["image"], u["known@x.org"]["email_verified"]) == ("Known", "k.png", True)
    assert (u["other@x.org"]["name"], u["other@x.org"]["email_verified"]) == ("Other", False)
    assert (u["new@x.org"]["name"], u["new@x.org"]["image"], u["new@x.org"]["email_verified"]) == ("New", "n.png", True)
    assert (a["google", "g1"]["access_token"], a["google", "g1"]["refresh_token"], a["google", "g1"]["access_token_expires_at"]) == ("t2", "r1", T + dt.timedelta(seconds=10))
    assert a["google", "g2"]["user_id"] == a["other", "h2"]["user_id"] == "u1" and a["google", "g3"]["user_id"] == a["other", "h3"]["user_id"] == u["new@x.org"]["id"]
    assert (a["google", "g3"]["access_token"], a["google", "g3"]["refresh_token"]) == ("t7", "r5")
    assert len({r["id"] for r in new_users.collect()}) == 3
    same = identity.sign_in(users, accounts, incoming.limit(0), NOW)
    assert same[0].count() == 2 and same[1].count() == 1


def test_creations(spark, users):
    agreements = mutate.with_defaults(spark.createDataFrame([("u1", "f.pdf", "k")], "user_id string, file_name string, s3_key string"), "agreements", NOW, ["s3_key"])
    first = agreements.collect()[0]
    assert (first["status"], first["is_generated"], first["s3_url"], first["uploaded_at"]) == ("PENDING", False, None, T)
    rows = [(1, "a.pdf", "n"), (2, "b.pdf", "n"), (3, "c.pdf", "k"), (4, "", "m"), (5, "d.pdf", None), (6, None, None), (7, "e.pdf", "")]
    requests = spark.createDataFrame(rows, "request int, file_name string, s3_key string")
    owner = spark.createDataFrame([("dev", "dev@x.org", "Dev")], "id string, email string, name string")
    for state in (users, mutate.create_agreements(users, agreements, requests, owner, NOW)[0]):  # a second run changes no user
        new_users, new_agreements, answers = mutate.create_agreements(state, agreements, requests, owner, NOW)
        assert codes(answers) == {1: 201, 2: 409, 3: 409, 4: 400, 5: 400, 6: 400, 7: 400}
        assert new_users.count() == 5 and {r["file_name"] for r in new_agreements.collect()} == {"f.pdf", "a.pdf"}
    assert {r["user_id"] for r in new_agreements.filter("file_name = 'a.pdf'").collect()} == {"dev"}
    one = spark.createDataFrame([("a",), ("b",)], "s3_key string")
    assert sorted(r[0] for r in mutate.insert_absent(one, spark.createDataFrame([("b",), ("c",), ("c",)], "s3_key string"), "s3_key").collect()) == ["a", "b", "c"]


def test_reasons_and_upload_checks(spark):
    rows = [("x", "c", True, True, True), (None, "", True, True, True), (None, "c", None, True, True), (None, "c", True, False, False), ("", "c", True, True, None), ("", "c", True, True, True)]
    df = spark.createDataFrame(rows, "error string, code string, a boolean, b boolean, c boolean")
    got = [r[0] for r in df.select(identity.callback_reason(*map(F.col, ("error", "code", "a", "b", "c")))).collect()]
    assert got == ["oauth_cancelled", "oauth_cancelled", "oauth_not_configured", "oauth_token_failed", "oauth_profile_failed", None]
    files = spark.createDataFrame([("application/pdf", 20971520), ("application/pdf", 20971521), ("text/plain", 99999999), (None, 1), ("application/pdf", None)], "t string, n long")
    assert [(r[0] or "")[:4] for r in files.select(validation.upload_issue(F.col("t"), F.col("n"))).collect()] == ["", "File", "Only", "Only", "File"]


def test_analyze_with_another_scorer(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("status string, reason string, citations array<string>")
    def model(prompts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"status": ["compliant" if "rent" in p else "unheard of" for p in prompts], "reason": list(prompts), "citations": [["s. 1"]] * len(prompts)})

    docs = spark.createDataFrame([(1, "The rent.\n\nThe dog."), (2, None), (3, "")], "doc_id int, text string")
    context = lambda parts: parts.withColumn("legal_context", F.array(F.lit("s. 1"), F.lit("s. 2")))
    got = {(r["doc_id"], r["clause_index"]): r for r in C.analyze(docs, "doc_id", "text", context, lambda prompt, clause, snippets: model(prompt)).collect()}
    assert set(got) == {(1, 0), (1, 2)}
    assert got[1, 0]["compliance"] == "COMPLIANT" and got[1, 0]["explanation"] == "## Lease clause\nThe rent.\n\n## Relevant legal context\ns. 1\n\ns. 2" and got[1, 0]["rta_citations"] == ["s. 1"]
    assert got[1, 2]["compliance"] is None and got[1, 2]["clause_text"] == "The dog."
    assert {r["compliance"] for r in C.analyze(docs, "doc_id", "text").collect()} == {"NEEDS_REVIEW"}


def test_json_is_read_once(spark):
    raw = spark.createDataFrame([(1, '{"status":"compliant","reason":"r","citations":[]}'), (2, "{")], "k int, json string")
    out = C.stored(C.judgments(raw, "k", "json"))
    assert [r["k"] for r in out.collect()] == [1]
    assert str(out._jdf.queryExecution().optimizedPlan()).count("from_json") <= 1


def test_cascade_leaves_no_orphan(spark):
    tables = {
        "users": spark.createDataFrame([("u1",), ("u2",)], "id string"),
        "accounts": spark.createDataFrame([("k1", "u1"), ("k2", "u2"), ("k3", None)], "id string, user_id string"),
        "agreements": spark.createDataFrame([("a1", "u1"), ("a2", "u2")], "id string, user_id string"),
        "analyses": spark.createDataFrame([("s1", "a1"), ("s2", "a2")], "id string, agreement_id string"),
        "clause_results": spark.createDataFrame([(1, "s1"), (2, "s2")], "clause_id int, analysis_id string"),
    }
    left = {k: sorted(str(r[0]) for r in v.collect()) for k, v in mutate.cascade(tables, "users", spark.createDataFrame([("u1",)], "id string")).items()}
    assert left == {"users": ["u2"], "accounts": ["k2", "k3"], "agreements": ["a2"], "analyses": ["s2"], "clause_results": ["2"]}


def test_integrity(spark):
    df = spark.createDataFrame([(1, "A"), (1, "B"), (None, "C"), (None, "C"), (2, None)], "k int, s string")
    assert [tuple(r) for r in integrity.repeated_keys(df, "k").collect()] == [(1, 2)]
    assert {r["s"] for r in integrity.outside_domain(df, "s", ["A", "B"]).collect()} == {"C"}
    assert {tuple(r) for r in integrity.missing_values(df, "k", "s").collect()} == {("k", 2), ("s", 1)}
    parent = spark.createDataFrame([(1,)], "id int")
    assert [r["k"] for r in integrity.orphans(df, "k", parent).collect()] == [2]
    assert integrity.repeated_keys(df.limit(0), "k").collect() == []


def test_scalars(spark):
    df = spark.createDataFrame([("", "b", T, "a b!'()~*&é"), (None, None, None, None)], "a string, b string, ts timestamp_ntz, name string")
    got = df.select(S.first_present(F.col("a"), F.col("b")).alias("p"), S.first_filled(F.col("a"), F.col("b")).alias("f"), S.epoch_millis(F.col("ts")).alias("m"), S.list_date(F.col("ts")).alias("d"), S.encode_component(F.col("name")).alias("e"), S.encode_form(F.col("name")).alias("q"), S.object_key(F.col("ts"), F.lit("x.pdf")).alias("k")).collect()
    assert got[0]["p"] == "" and got[0]["f"] == "b" and got[0]["d"] == "2026/1/2"
    assert got[0]["e"] == "a%20b!'()~*%26%C3%A9" and got[0]["q"].startswith("a+b")
    assert got[0]["k"] == f"uploads/{got[0]['m']}-x.pdf" and got[0]["m"] == 1767323045678
    assert all(v is None for v in got[1])
    assert spark.range(1).select(S.utf16_length(F.lit("a😀"))).first()[0] == 3
    assert spark.range(1).select(S.query_parameter(F.lit("https://x/y?a=b%20c&d=1"), "a")).first()[0] == "b c"
    assert spark.range(1).select(S.query_parameter(F.lit("https://x/y?a=b&d=%"), "a")).first()[0] is None
    assert [r[0] for r in spark.createDataFrame([("HIGH",), ("LOW",), ("X",)], "s string").select(S.rank_in(F.col("s"), ["LOW", "MEDIUM", "HIGH"])).collect()] == [3, 1, 0]


def test_clauses(spark):
    docs = spark.createDataFrame([(1, "a\n\n b\r\nc"), (2, None), (3, "")], "doc_id int, text string")
    assert {tuple(r) for r in C.segments(docs, "doc_id", "text").collect()} == {(1, 0, "a"), (1, 2, " b"), (1, 3, "c")}
    lists = spark.createDataFrame([(1, ["x", None, "x"]), (2, []), (3, None)], "k int, a array<string>")
    out = C.fan_out(lists, "k", "a")
    assert {tuple(r) for r in out.collect()} == {(1, 0, "x"), (1, 1, None), (1, 2, "x")}
    assert [r["clause"] for r in C.fan_in(out, "k", "clause_index", "clause").first()["results"]] == ["x", None, "x"]
    assert spark.range(1).select(C.prompt(F.lit("c"), F.array(F.lit("s"), F.lit("t")))).first()[0] == "## Lease clause\nc\n\n## Relevant legal context\ns\n\nt"
    assert spark.range(1).select(C.context(F.array().cast("array<string>"))).first()[0] == ""
    raw = ['{"status":"compliant","reason":"r","citations":[]}', '{"status":"fine","reason":"r","citations":[]}', "{bad", None, '{"status":"compliant","reason":"r"}']
    got = spark.createDataFrame([(x,) for x in raw], "j string").select(C.judgment(F.col("j")).alias("j")).collect()
    assert [r["j"] is not None for r in got] == [True, False, False, False, False]


def test_top_k_is_exact(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)] + [(300, None), (301, [0.0] * 8), (302, [1.0] * 8), (303, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    monkeypatch.setattr(retrieve, "BLOCK", 40)
    got = {}
    for r in retrieve.top_k(df, df.filter("vec_id % 30 = 2"), 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["match_id"]))
    unit = {k: np.array(v, np.float32).astype(float) / (np.linalg.norm(np.array(v, np.float32).astype(float)) or 1) if v else np.zeros(8) for k, v in rows}
    for q in got:
        best = sorted((-round(float(unit[q] @ unit[k]), 9), k) for k in unit if k != q)[:3]
        assert sorted(got[q]) == [(n + 1, k) for n, (_, k) in enumerate(best)]
    assert len(got) == 11
    assert retrieve.top_k(df, df.limit(0), 3).collect() == [] and retrieve.top_k(df.limit(0), df.limit(5), 3).collect() == []


def test_rollups(spark):
    analyses = spark.createDataFrame([("s", "a", T, T + dt.timedelta(seconds=2), T), ("t", "a", None, T, T)], "id string, agreement_id string, started_at timestamp_ntz, completed_at timestamp_ntz, created_at timestamp_ntz")
    assert {tuple(r) for r in rollup.durations(analyses).collect()} == {("s", 2000), ("t", None)}
    agreements = spark.createDataFrame([("a", "u", T)], "id string, user_id string, uploaded_at timestamp_ntz")
    assert [tuple(r) for r in rollup.analyses_by_month(analyses, agreements).collect()] == [("u", "2026-01", 2)]
