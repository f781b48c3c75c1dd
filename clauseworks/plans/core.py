"""Queries of the engine's own operators over the domain tables, and the SQL that says the same to DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseworks.functions import scalars as S
from clauseworks.operators import clauses as C
from clauseworks.operators import identity, integrity, lookup, mutate, relations, retrieve, rollup, validation
from clauseworks.schemas import AGREEMENT_STATUS, ANALYSIS_STATUS, SEVERITY, STATUS_LABEL, STATUS_VARIANT
from clauseworks.session import table
from clauseworks.sources import tables as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2026-01-01 00:00:00"
#: the rows of a table that was partly delivered twice
AGREEMENTS, ANALYSES = "(SELECT DISTINCT * FROM agreements)", "(SELECT DISTINCT * FROM analyses)"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _once(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The distinct rows of a table that was partly delivered twice; of ``columns``, its id among them, where given."""
    return lookup.once(table(spark, sf_dir, name), *columns)


def _case(column: str, labels: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


@query(f"""
SELECT id, file_name, status, {_case("status", STATUS_LABEL)} AS label, {_case("status", STATUS_VARIANT)} AS variant,
       strftime(uploaded_at, '%Y/%-m/%-d') AS uploaded
FROM {AGREEMENTS} WHERE user_id = (SELECT min(id) FROM users WHERE id IN (SELECT user_id FROM agreements)) ORDER BY uploaded_at DESC, id""")
def owner_list_desc(spark, sf_dir):
    agreements = table(spark, sf_dir, "agreements", "id", "user_id", "file_name", "status", "uploaded_at")
    users = table(spark, sf_dir, "users", "id")
    owner = relations.present(users, agreements, "id", "user_id").agg(F.min("id").alias("user_id"))  # one row
    mine = lookup.once(agreements.join(F.broadcast(owner), "user_id")).orderBy(F.desc_nulls_last("uploaded_at"), "id")
    return mine.select("id", "file_name", "status", S.labelled(F.col("status"), STATUS_LABEL).alias("label"), S.labelled(F.col("status"), STATUS_VARIANT).alias("variant"), S.list_date(F.col("uploaded_at")).alias("uploaded"))


@query(f"""
SELECT user_id, id, uploaded_at, row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at DESC NULLS LAST, id) AS place
FROM {AGREEMENTS} QUALIFY place <= 3""")
def newest_of_each_owner(spark, sf_dir):
    agreements = _once(spark, sf_dir, "agreements", "id", "user_id", "uploaded_at")
    return lookup.newest_for_each(agreements, "user_id", "uploaded_at", "id", 3).select("user_id", "id", "uploaded_at", "place")


@query("SELECT id, email, name FROM users WHERE id = (SELECT max(id) FROM users)")
def point_lookup(spark, sf_dir):
    users = table(spark, sf_dir, "users", "id", "email", "name")
    return lookup.by_keys(users, users.agg(F.max("id").alias("id")), "id")


@query("SELECT id AS user_id, email, name FROM users WHERE email = (SELECT min(email) FROM users)")
def email_lookup(spark, sf_dir):
    users = table(spark, sf_dir, "users", "id", "email", "name")
    return lookup.by_keys(users, users.agg(F.min("email").alias("email")), "email").withColumnRenamed("id", "user_id")


@query("""
SELECT a.analysis_id, a.clause_index, a.clause_id, a.clause_title FROM analyze_clause a
JOIN (SELECT analysis_id, max(clause_index) AS clause_index FROM analyze_clause GROUP BY analysis_id) k
ON a.analysis_id = k.analysis_id AND a.clause_index = k.clause_index""")
def composite_lookup(spark, sf_dir):
    """The last clause of each analysis by its two-column key."""
    clauses = table(spark, sf_dir, "analyze_clause", "analysis_id", "clause_index", "clause_id", "clause_title")
    keys = clauses.groupBy("analysis_id").agg(F.max("clause_index").alias("clause_index"))
    return lookup.by_keys(clauses, keys, "analysis_id", "clause_index")


@query(f"SELECT a.id, a.file_name, u.id AS user_id, u.email AS user_email, u.name AS user_name FROM {AGREEMENTS} a JOIN users u ON a.user_id = u.id")
def include_owner(spark, sf_dir):
    agreements = _once(spark, sf_dir, "agreements", "id", "file_name", "user_id").withColumnRenamed("user_id", "owner")
    users = table(spark, sf_dir, "users", "id", "email", "name")
    return relations.include(agreements, users, "owner", "user_").select("id", "file_name", "user_id", "user_email", "user_name")


@query(f"SELECT id, status FROM {AGREEMENTS} a WHERE EXISTS (SELECT 1 FROM analyses s WHERE s.agreement_id = a.id)")
def key_exists(spark, sf_dir):
    return relations.present(_once(spark, sf_dir, "agreements", "id", "status"), table(spark, sf_dir, "analyses", "agreement_id"), "id", "agreement_id")


@query(f"SELECT id, status FROM {AGREEMENTS} a WHERE NOT EXISTS (SELECT 1 FROM analyses s WHERE s.agreement_id = a.id)")
def key_absent(spark, sf_dir):
    return relations.absent(_once(spark, sf_dir, "agreements", "id", "status"), table(spark, sf_dir, "analyses", "agreement_id"), "id", "agreement_id")


@query(f"""
SELECT a.user_id, a.id AS agreement_id, s.id AS analysis_id, s.status AS analysis_status, c.clause_id, c.clause_index
FROM {AGREEMENTS} a LEFT JOIN {ANALYSES} s ON s.agreement_id = a.id LEFT JOIN analyze_clause c ON c.analysis_id = s.id""")
def agreement_chain(spark, sf_dir):
    clauses = table(spark, sf_dir, "analyze_clause", "analysis_id", "clause_id", "clause_index")
    return relations.chain(_once(spark, sf_dir, "agreements", "id", "user_id", "file_name"), _once(spark, sf_dir, "analyses", "id", "agreement_id", "status"), clauses).select("user_id", "agreement_id", "analysis_id", "analysis_status", "clause_id", "clause_index")


@query(f"""
SELECT a.id, a.prev_doc, p.status AS previous_status FROM {AGREEMENTS} a LEFT JOIN {AGREEMENTS} p ON a.prev_doc = p.id WHERE a.prev_doc IS NOT NULL""")
def previous_version(spark, sf_dir):
    agreements = _once(spark, sf_dir, "agreements", "id", "prev_doc", "status")
    old = agreements.select(F.col("id").alias("prev_doc"), F.col("status").alias("previous_status"))
    return agreements.filter("prev_doc is not null").join(old, "prev_doc", "left").select("id", "prev_doc", "previous_status")


_REQUESTS = f"""
(SELECT id AS agreement_id, user_id AS caller FROM {AGREEMENTS} WHERE status <> 'FAILED'
 UNION ALL SELECT id, (SELECT min(id) FROM users) FROM {AGREEMENTS} WHERE status = 'FAILED'
 UNION ALL SELECT agreement_id || '-gone', id FROM {ANALYSES})"""


@query(f"""
SELECT r.agreement_id, r.caller, CASE WHEN a.user_id IS NULL THEN 404 WHEN a.user_id <> r.caller THEN 403 ELSE 204 END AS code
FROM {_REQUESTS} r LEFT JOIN {AGREEMENTS} a ON a.id = r.agreement_id""")
def guarded_delete_outcome(spark, sf_dir):
    agreements, analyses = _once(spark, sf_dir, "agreements", "id", "user_id", "status"), _once(spark, sf_dir, "analyses", "id", "agreement_id")
    other = table(spark, sf_dir, "users", "id").agg(F.min("id").alias("other"))  # one row
    caller = F.when(F.col("status") == "FAILED", F.col("other")).otherwise(F.col("user_id"))
    requests = agreements.crossJoin(F.broadcast(other)).select(F.col("id").alias("agreement_id"), caller.alias("caller")).unionAll(analyses.select(F.concat("agreement_id", F.lit("-gone")), "id"))
    return validation.deletion(requests, agreements).select("agreement_id", "caller", "code")


def _left(spark, sf_dir):
    tables = {"users": table(spark, sf_dir, "users", "id"), "agreements": _once(spark, sf_dir, "agreements", "id", "user_id"), "analyses": _once(spark, sf_dir, "analyses", "id", "agreement_id"), "clause_results": table(spark, sf_dir, "analyze_clause", "clause_id", "analysis_id")}
    return mutate.cascade(tables, "users", table(spark, sf_dir, "users", "id", "name").filter("name is null").select("id"))


@query(f"""
WITH u AS (SELECT id FROM users WHERE name IS NOT NULL), a AS (SELECT id, user_id FROM {AGREEMENTS} WHERE user_id NOT IN (SELECT id FROM users WHERE name IS NULL)),
s AS (SELECT id FROM {ANALYSES} WHERE agreement_id NOT IN (SELECT id FROM {AGREEMENTS} WHERE user_id IN (SELECT id FROM users WHERE name IS NULL))),
c AS (SELECT clause_id, analysis_id FROM analyze_clause WHERE analysis_id NOT IN (SELECT id FROM {ANALYSES} WHERE agreement_id IN (SELECT id FROM {AGREEMENTS} WHERE user_id IN (SELECT id FROM users WHERE name IS NULL))))
SELECT 'user' AS kind, id AS row_id FROM u UNION ALL SELECT 'agreement', id FROM a UNION ALL SELECT 'analysis', id FROM s UNION ALL SELECT 'clause', CAST(clause_id AS VARCHAR) FROM c""")
def cascade_delete(spark, sf_dir):
    """What is left when all users without a name are deleted."""
    left = _left(spark, sf_dir)
    key = {"users": ("user", "id"), "agreements": ("agreement", "id"), "analyses": ("analysis", "id"), "clause_results": ("clause", "clause_id")}
    frames = [left[t].select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("row_id")) for t, (kind, c) in key.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("""
SELECT id, email FROM users UNION ALL
SELECT user_id, min(user_id || '@import.invalid') FROM analyze_clause WHERE user_id NOT IN (SELECT id FROM users) GROUP BY user_id""")
def upsert_noop(spark, sf_dir):
    """Users and those that clauses name and that aren't there yet; the others stay untouched."""
    users = table(spark, sf_dir, "users", "id", "email")
    wanted = table(spark, sf_dir, "analyze_clause", "user_id").distinct().select(F.col("user_id").alias("id"), F.concat("user_id", F.lit("@import.invalid")).alias("email"))
    return mutate.insert_absent(users, wanted, "id")


_PROFILES = "(SELECT email, 'Profile ' || id AS name, 'https://img.example/' || id AS image FROM users WHERE image IS NULL OR name IS NULL OR name = '')"


@query(f"""
SELECT u.id, CASE WHEN p.email IS NULL THEN u.name ELSE coalesce(nullif(u.name, ''), p.name) END AS name,
CASE WHEN p.email IS NULL THEN u.image ELSE coalesce(nullif(u.image, ''), p.image) END AS image, u.email_verified OR p.email IS NOT NULL AS email_verified
FROM users u LEFT JOIN {_PROFILES} p ON u.email = p.email""")
def fill_profile(spark, sf_dir):
    users = table(spark, sf_dir, "users")
    poor = users.filter("image is null or name is null or name = ''")
    profiles = poor.select("email", F.concat(F.lit("Profile "), "id").alias("name"), F.concat(F.lit("https://img.example/"), "id").alias("image"))
    return mutate.fill_profile(users, profiles).select("id", "name", "image", "email_verified")


@query(f"""
SELECT a.id, CASE WHEN s.id IS NULL THEN a.status ELSE s.status END AS status, CASE WHEN s.id IS NULL THEN a.prev_doc ELSE coalesce(s.error_message, a.prev_doc) END AS prev_doc
FROM {AGREEMENTS} a LEFT JOIN {ANALYSES} s ON s.agreement_id = a.id""")
def keyed_update(spark, sf_dir):
    """Agreements with their analysis' status; a null note keeps the old value (the token refresh's rule)."""
    agreements = _once(spark, sf_dir, "agreements", "id", "status", "prev_doc")
    changes = _once(spark, sf_dir, "analyses", "id", "agreement_id", "status", "error_message").select(F.col("agreement_id").alias("id"), "status", F.col("error_message").alias("prev_doc"))
    return mutate.update(agreements, changes, "id", keep_if_null=("prev_doc",))


#: sign-ins: each clause's owner with an e-mail of the analysis, and every user once more with another provider
_SIGN_INS = """accounts AS (SELECT 'google' AS provider_id, substr(id, 5) AS account_id, id AS user_id FROM users WHERE password_hash IS NULL),
incoming AS (SELECT clause_id AS arrival, 'google' AS provider_id, substr(user_id, 5) AS account_id, 'x' || substr(analysis_id, 1, 6) || '@example.org' AS email,
    clause_title AS name, CAST(NULL AS VARCHAR) AS image, 'a' || clause_id AS access_token, CASE WHEN clause_title IS NULL THEN NULL ELSE 'r' || clause_id END AS refresh_token, 3600 AS expires_in FROM analyze_clause
  UNION ALL SELECT CAST('0x' || substr(md5(id), 1, 12) AS BIGINT) + 100000000, 'other', substr(id, 5), email, name, image, 'a' || id, NULL, 60 FROM users)"""


def _sign_ins(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, accounts, incoming)"""
    users = table(spark, sf_dir, "users")
    account = lambda c: F.substring(c, 5, 1000)
    accounts = users.filter("password_hash is null").select(F.lit("google").alias("provider_id"), account("id").alias("account_id"), F.col("id").alias("user_id"))
    clauses = table(spark, sf_dir, "analyze_clause", "clause_id", "user_id", "analysis_id", "clause_title")
    mail = F.concat(F.lit("x"), F.substring("analysis_id", 1, 6), F.lit("@example.org"))
    number = F.col("clause_id").cast("string")
    incoming = clauses.select(
        F.col("clause_id").alias("arrival"), F.lit("google").alias("provider_id"), account("user_id").alias("account_id"), mail.alias("email"), F.col("clause_title").alias("name"), F.lit(None).cast("string").alias("image"),
        F.concat(F.lit("a"), number).alias("access_token"), F.when(F.col("clause_title").isNotNull(), F.concat(F.lit("r"), number)).alias("refresh_token"), F.lit(3600).alias("expires_in"),
    )
    at = F.conv(F.substring(F.md5("id"), 1, 12), 16, 10).cast("bigint") + 100000000
    second = users.select(at.alias("arrival"), F.lit("other").alias("provider_id"), account("id").alias("account_id"), "email", "name", "image", F.concat(F.lit("a"), "id").alias("access_token"), F.lit(None).cast("string").alias("refresh_token"), F.lit(60).alias("expires_in"))
    return users, accounts, incoming.unionByName(second)


@query(f"""
WITH {_SIGN_INS},
j AS (SELECT i.*, a.user_id AS au, u.id AS mu, row_number() OVER (PARTITION BY i.provider_id, i.account_id ORDER BY i.arrival) > 1 AS again
  FROM incoming i LEFT JOIN accounts a USING (provider_id, account_id) LEFT JOIN users u ON u.email = i.email),
k AS (SELECT *, row_number() OVER (PARTITION BY email, (au IS NULL AND NOT again) ORDER BY arrival) > 1 AS later FROM j)
SELECT arrival, CASE WHEN au IS NOT NULL OR again THEN 'returning' WHEN mu IS NOT NULL OR later THEN 'link' ELSE 'new' END AS branch, coalesce(au, mu) AS user_id FROM k""")
def link_decision(spark, sf_dir):
    users, accounts, incoming = _sign_ins(spark, sf_dir)
    return relations.link_decision(incoming.select("arrival", "provider_id", "account_id", "email"), accounts, users.select("id", "email")).select("arrival", "branch", "user_id")


#: what a batch of sign-ins leaves: by account its last tokens, by new account its first row, by e-mail of those the profile
_SIGNED_IN = f"""{_SIGN_INS},
had AS (SELECT provider_id || ':' || account_id AS id, user_id, account_id, provider_id, 'old' AS access_token, 'kept' AS refresh_token, TIMESTAMP '2025-01-01 00:00:00' AS access_token_expires_at FROM accounts),
l AS (SELECT provider_id, account_id, arg_max(access_token, arrival) AS access, arg_max(expires_in, arrival) AS secs, arg_max(refresh_token, arrival) FILTER (refresh_token IS NOT NULL) AS refresh, min(arrival) AS arrival FROM incoming GROUP BY ALL),
f AS (SELECT i.provider_id, i.account_id, i.email, i.name, i.image, i.arrival, l.access, l.secs, l.refresh FROM incoming i JOIN l USING (provider_id, account_id, arrival) WHERE (i.provider_id, i.account_id) NOT IN (SELECT (provider_id, account_id) FROM accounts) AND i.email IS NOT NULL),
p AS (SELECT email, coalesce(arg_min(name, arrival) FILTER (name <> ''), (array_agg(name ORDER BY arrival DESC))[1]) AS name, coalesce(arg_min(image, arrival) FILTER (image <> ''), (array_agg(image ORDER BY arrival DESC))[1]) AS image FROM f GROUP BY email)"""


def _signed_in(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    users, accounts, incoming = _sign_ins(spark, sf_dir)
    had = accounts.select(F.concat_ws(":", "provider_id", "account_id").alias("id"), "user_id", "account_id", "provider_id", F.lit("old").alias("access_token"), F.lit("kept").alias("refresh_token"), F.lit("2025-01-01").cast("timestamp_ntz").alias("access_token_expires_at"))
    return identity.sign_in(users.select("id", "email", "name", "image", "email_verified"), had, incoming, NOW)


@query(f"""
WITH {_SIGNED_IN}
SELECT u.id, u.email, CASE WHEN p.email IS NULL THEN u.name ELSE coalesce(nullif(u.name, ''), p.name) END AS name, CASE WHEN p.email IS NULL THEN u.image ELSE coalesce(nullif(u.image, ''), p.image) END AS image, u.email_verified OR p.email IS NOT NULL AS email_verified
FROM users u LEFT JOIN p ON p.email = u.email
UNION ALL SELECT sha256(email), email, name, image, true FROM p WHERE email NOT IN (SELECT email FROM users)""")
def oauth_users(spark, sf_dir):
    """The users after a batch of sign-ins."""
    return _signed_in(spark, sf_dir)[0]


@query(f"""
WITH {_SIGNED_IN}
SELECT h.id, h.user_id, h.account_id, h.provider_id, coalesce(l.access, h.access_token) AS access_token, coalesce(l.refresh, h.refresh_token) AS refresh_token,
  CASE WHEN l.account_id IS NULL THEN h.access_token_expires_at ELSE TIMESTAMP '{NOW}' + to_seconds(l.secs) END AS access_token_expires_at FROM had h LEFT JOIN l USING (provider_id, account_id)
UNION ALL SELECT sha256(provider_id || '|' || account_id), coalesce(u.id, sha256(f.email)), account_id, provider_id, access, refresh, TIMESTAMP '{NOW}' + to_seconds(secs) FROM f LEFT JOIN users u ON u.email = f.email""")
def oauth_accounts(spark, sf_dir):
    """The accounts after a batch of sign-ins."""
    return _signed_in(spark, sf_dir)[1]


@query("""
SELECT clause_id AS request, CASE WHEN coalesce(clause_title, '') = '' THEN 'oauth_cancelled' WHEN length(coalesce(clause, '')) = 0 THEN 'oauth_not_configured'
WHEN len(legal_context) IS NULL THEN 'oauth_token_failed' WHEN len(legal_context) = 0 THEN 'oauth_profile_failed' END AS reason FROM analyze_clause""")
def callback_reasons(spark, sf_dir):
    """Callbacks made of clauses: the code is the title, and what else may fail follows from the clause."""
    calls = table(spark, sf_dir, "analyze_clause", "clause_id", "clause_title", "clause", "legal_context")
    filled, there = F.length(F.coalesce("clause", F.lit(""))) > 0, F.col("legal_context").isNotNull()
    return calls.select(F.col("clause_id").alias("request"), identity.callback_reason(F.lit(None).cast("string"), F.col("clause_title"), filled, there, F.size("legal_context") > 0).alias("reason"))


@query("SELECT substr(id, 5) AS account_id, email, email_verified, name, image FROM users")
def profile_mapping(spark, sf_dir):
    """Profiles as a provider sends them, in the tables' names."""
    sent = table(spark, sf_dir, "users").select(F.to_json(F.struct(F.substring("id", 5, 1000).alias("sub"), "email", "email_verified", "name", F.col("image").alias("picture"))).alias("body"))
    return identity.from_profile(sources.bodies(sent, "body", "sub string, email string, email_verified boolean, name string, picture string").drop("body"))


#: creations: each agreement's file with a new key, once more with its old one, and bodies that aren't whole
_CREATIONS = f"""creations AS (SELECT id || '-1' AS request, file_name, 'uploads/new-' || file_name AS s3_key FROM {AGREEMENTS} UNION ALL SELECT id || '-2', file_name, s3_key FROM {AGREEMENTS}
  UNION ALL SELECT id || '-3', '', s3_key FROM {AGREEMENTS} UNION ALL SELECT id || '-4', file_name, NULL FROM {AGREEMENTS}),
answers AS (SELECT request, file_name, s3_key, CASE WHEN coalesce(file_name, '') = '' OR coalesce(s3_key, '') = '' THEN 400 WHEN s3_key IN (SELECT s3_key FROM agreements WHERE s3_key IS NOT NULL)
  OR row_number() OVER (PARTITION BY s3_key, coalesce(file_name, '') = '' ORDER BY request) > 1 THEN 409 ELSE 201 END AS code FROM creations)"""


def _created(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    agreements = _once(spark, sf_dir, "agreements", "id", "user_id", "file_name", "s3_key", "s3_url", "status", "is_generated", "prev_doc", "uploaded_at", "updated_at")
    body = lambda n, name, key: agreements.select(F.concat("id", F.lit(f"-{n}")).alias("request"), F.to_json(F.struct(name.alias("fileName"), key.alias("s3Key"))).alias("body"))
    name, key = F.col("file_name"), F.col("s3_key")
    bodies = body(1, name, F.concat(F.lit("uploads/new-"), name)).unionAll(body(2, name, key)).unionAll(body(3, F.lit(""), key)).unionAll(body(4, name, F.lit(None).cast("string")))
    requests = sources.bodies(bodies, "body", "fileName string, s3Key string").select("request", F.col("fileName").alias("file_name"), F.col("s3Key").alias("s3_key"))
    owner = spark.createDataFrame([("dev-user", "dev@example.org", "Dev User")], "id string, email string, name string")
    return mutate.create_agreements(table(spark, sf_dir, "users"), agreements, requests, owner, NOW)


@query(f"WITH {_CREATIONS} SELECT request, code FROM answers")
def create_agreement(spark, sf_dir):
    """The answers to requests that create agreements."""
    return _created(spark, sf_dir)[2].select("request", "code")


@query(f"""
WITH {_CREATIONS}
SELECT id, user_id, file_name, s3_key, s3_url, status, is_generated, prev_doc, uploaded_at, updated_at FROM {AGREEMENTS}
UNION ALL SELECT sha256(s3_key), 'dev-user', file_name, s3_key, NULL, 'PENDING', false, NULL, TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' FROM answers WHERE code = 201""")
def created_agreements(spark, sf_dir):
    """The agreements after them, with their defaults."""
    return _created(spark, sf_dir)[1]


@query("SELECT id, email, email_verified FROM users UNION ALL SELECT 'dev-user', 'dev@example.org', false")
def owner_upserted(spark, sf_dir):
    """The users after them: the owner is there, all others are as they were."""
    return _created(spark, sf_dir)[0].select("id", "email", "email_verified")


@query("""
SELECT doc_id, CASE WHEN (CASE WHEN title IS NULL THEN NULL WHEN lang = 'en' THEN 'application/pdf' ELSE 'text/plain' END) IS DISTINCT FROM 'application/pdf' THEN 'Only PDF files are supported'
WHEN NOT coalesce(n_chars * 10000 <= 20971520, false) THEN 'File size cannot be greater than 20MB' END AS issue FROM documents""")
def upload_issue(spark, sf_dir):
    """The first thing wrong with a file: its type, then its size."""
    docs = table(spark, sf_dir, "documents", "doc_id", "title", "lang", "n_chars")
    kind = F.when(F.col("title").isNotNull(), F.when(F.col("lang") == "en", "application/pdf").otherwise("text/plain"))
    return docs.select("doc_id", validation.upload_issue(kind, F.col("n_chars") * 10000).alias("issue"))


@query(f"""
SELECT id, CASE WHEN coalesce(file_name, '') = '' THEN 'fileName is empty' WHEN coalesce(s3_url, '') = '' THEN 'contentType is empty' END AS issue,
  '{{"url":"https://store.example/upload","key":' || CAST(to_json('uploads/' || epoch_ms(uploaded_at) || '-' || file_name) AS VARCHAR) || '}}' AS body FROM {AGREEMENTS}""")
def upload_key_responses(spark, sf_dir):
    """Requests for an upload key: what is missing, and the answer with its URL and key."""
    asked = _once(spark, sf_dir, "agreements", "id", "file_name", "s3_url", "uploaded_at")
    answer = F.struct(F.lit("https://store.example/upload").alias("url"), S.object_key(F.col("uploaded_at"), F.col("file_name")).alias("key"))
    return asked.select("id", validation.filled_issue({"file_name": "fileName is empty", "s3_url": "contentType is empty"}).alias("issue"), sources.responses(answer).alias("body"))


_EMAIL = validation.EMAIL.replace("'", "''")


@query(f"""
WITH r AS (SELECT id AS request, email, coalesce(password_hash, 'short') AS password, name FROM users)
SELECT request, CASE WHEN NOT coalesce(regexp_matches(email, '{_EMAIL}'), false) THEN 'Invalid email' WHEN length(password) < 8 THEN 'Password needs 8 characters'
WHEN name IS NOT NULL AND length(name) < 1 THEN 'Name is empty' END AS issue FROM r""")
def validate_rows(spark, sf_dir):
    users = table(spark, sf_dir, "users").withColumn("password", F.coalesce("password_hash", F.lit("short")))
    return users.select(F.col("id").alias("request"), validation.signup_issue().alias("issue"))


@query(f"""
WITH r AS (SELECT id AS request, lower(email) AS email, coalesce(password_hash, 'long enough') AS password, nullif(name, '') AS name FROM users),
k AS (SELECT *, CASE WHEN NOT coalesce(regexp_matches(email, '{_EMAIL}'), false) THEN 1 WHEN length(password) < 8 THEN 1 END AS bad FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY email, bad IS NULL ORDER BY request) AS rank FROM k)
SELECT request, CASE WHEN bad IS NOT NULL THEN 400 WHEN email IN (SELECT email FROM users) OR rank > 1 THEN 409 ELSE 201 END AS code FROM n""")
def signup_outcome(spark, sf_dir):
    """Every user signs up again with the e-mail in lower case: e-mails are compared as they are."""
    users = table(spark, sf_dir, "users")
    requests = users.select(F.col("id").alias("request"), F.lower("email").alias("email"), F.coalesce("password_hash", F.lit("long enough")).alias("password"), F.nullif("name", F.lit("")).alias("name"))
    return validation.signup(requests, users).select("request", "code")


@query("SELECT id AS request, CASE WHEN coalesce(password_hash, '') = '' THEN 401 ELSE 200 END AS code FROM users")
def login_outcome(spark, sf_dir):
    users = table(spark, sf_dir, "users")
    requests = users.select(F.col("id").alias("request"), "email", F.lit("a password").alias("password"))
    return validation.login(requests, users).select("request", "code")


@query("SELECT doc_id, n_chars, coalesce(n_chars <= 2048, false) AS fits FROM documents")
def size_limit(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "n_chars").withColumn("fits", validation.fits(F.col("n_chars"), 2048))


@query("""
SELECT 'agreements.id' AS rule, id AS key, count(*) AS n FROM agreements GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'agreements.s3_key', s3_key, count(*) FROM agreements WHERE s3_key IS NOT NULL GROUP BY s3_key HAVING count(*) > 1
UNION ALL SELECT 'analyses.agreement_id', agreement_id, count(*) FROM analyses GROUP BY agreement_id HAVING count(*) > 1
UNION ALL SELECT 'users.email', email, count(*) FROM users GROUP BY email HAVING count(*) > 1
UNION ALL SELECT 'clauses.analysis_id,clause_index', analysis_id || ',' || clause_index, count(*) FROM analyze_clause GROUP BY analysis_id, clause_index HAVING count(*) > 1
UNION ALL SELECT 'results.clause_id', CAST(clause_id AS VARCHAR), count(*) FROM compliance_result GROUP BY clause_id HAVING count(*) > 1""")
def unique_violations(spark, sf_dir):
    rules = [("agreements", ["id"], "agreements"), ("agreements", ["s3_key"], "agreements"), ("analyses", ["agreement_id"], "analyses"), ("users", ["email"], "users"), ("analyze_clause", ["analysis_id", "clause_index"], "clauses"), ("compliance_result", ["clause_id"], "results")]
    out = None
    for name, key, label in rules:
        bad = integrity.repeated_keys(table(spark, sf_dir, name, *key), *key).select(F.lit(f"{label}.{','.join(key)}").alias("rule"), F.concat_ws(",", *(F.col(k).cast("string") for k in key)).alias("key"), "n")
        out = bad if out is None else out.unionByName(bad)
    return out


@query("""
SELECT 'agreements.user_id' AS rule, id AS row_id FROM agreements WHERE user_id NOT IN (SELECT id FROM users)
UNION ALL SELECT 'analyses.agreement_id', id FROM analyses WHERE agreement_id NOT IN (SELECT id FROM agreements)
UNION ALL SELECT 'clauses.analysis_id', CAST(clause_id AS VARCHAR) FROM analyze_clause WHERE analysis_id NOT IN (SELECT id FROM analyses)
UNION ALL SELECT 'results.clause_id', CAST(result_id AS VARCHAR) FROM compliance_result WHERE clause_id NOT IN (SELECT clause_id FROM analyze_clause)
UNION ALL SELECT 'documents.agreement_id', CAST(doc_id AS VARCHAR) FROM documents WHERE agreement_id IS NOT NULL AND agreement_id NOT IN (SELECT id FROM agreements)""")
def fk_orphans(spark, sf_dir):
    rules = [("agreements", "id", "user_id", "users", "id", "agreements"), ("analyses", "id", "agreement_id", "agreements", "id", "analyses"), ("analyze_clause", "clause_id", "analysis_id", "analyses", "id", "clauses"), ("compliance_result", "result_id", "clause_id", "analyze_clause", "clause_id", "results"), ("documents", "doc_id", "agreement_id", "agreements", "id", "documents")]
    out = None
    for child, key, column, parent, parent_key, label in rules:
        bad = integrity.orphans(table(spark, sf_dir, child, key, column), column, table(spark, sf_dir, parent, parent_key), parent_key)
        bad = bad.select(F.lit(f"{label}.{column}").alias("rule"), F.col(key).cast("string").alias("row_id"))
        out = bad if out is None else out.unionByName(bad)
    return out


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(f"""
SELECT 'results.status' AS rule, status AS value, count(*) AS n FROM compliance_result WHERE status NOT IN ({_list(C.STATUSES)}) GROUP BY status
UNION ALL SELECT 'results.severity', severity, count(*) FROM compliance_result WHERE severity NOT IN ({_list(SEVERITY)}) GROUP BY severity
UNION ALL SELECT 'agreements.status', status, count(*) FROM agreements WHERE status NOT IN ({_list(AGREEMENT_STATUS)}) GROUP BY status
UNION ALL SELECT 'analyses.status', status, count(*) FROM analyses WHERE status NOT IN ({_list(ANALYSIS_STATUS)}) GROUP BY status""")
def enum_violations(spark, sf_dir):
    rules = [("compliance_result", "status", C.STATUSES, "results"), ("compliance_result", "severity", SEVERITY, "results"), ("agreements", "status", AGREEMENT_STATUS, "agreements"), ("analyses", "status", ANALYSIS_STATUS, "analyses")]
    out = None
    for name, column, domain, label in rules:
        bad = integrity.outside_domain(table(spark, sf_dir, name, column), column, domain).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
        bad = bad.select(F.lit(f"{label}.{column}").alias("rule"), "value", "n")
        out = bad if out is None else out.unionByName(bad)
    return out


@query("""
SELECT * FROM (SELECT 'name' AS "column", count(*) FILTER (name IS NULL) AS n FROM users UNION ALL SELECT 'email', count(*) FILTER (email IS NULL) FROM users
UNION ALL SELECT 'image', count(*) FILTER (image IS NULL) FROM users UNION ALL SELECT 'password_hash', count(*) FILTER (password_hash IS NULL) FROM users) WHERE n > 0""")
def missing_values(spark, sf_dir):
    return integrity.missing_values(table(spark, sf_dir, "users"), "name", "email", "image", "password_hash")


@query(f"""SELECT id, 'uploads/' || epoch_ms(uploaded_at) || '-' || file_name AS object_key, epoch_ms(uploaded_at) AS millis FROM {AGREEMENTS}""")
def object_key(spark, sf_dir):
    at = F.col("uploaded_at")
    return _once(spark, sf_dir, "agreements", "id", "uploaded_at", "file_name").select("id", S.object_key(at, F.col("file_name")).alias("object_key"), S.epoch_millis(at).alias("millis"))


@query(f"""
SELECT s.id, s.created_at + to_seconds(3600) AS expires_at, s.created_at + to_seconds(3600) > TIMESTAMP '{NOW}' AS valid FROM {ANALYSES} s""")
def expiry(spark, sf_dir):
    expires = S.plus_seconds(F.col("created_at"), F.lit(3600))
    return _once(spark, sf_dir, "analyses", "id", "created_at").select("id", expires.alias("expires_at"), (expires > F.lit(NOW).cast("timestamp_ntz")).alias("valid"))


@query(f"SELECT id, strftime(uploaded_at, '%Y/%-m/%-d') AS uploaded FROM {AGREEMENTS}")
def locale_date(spark, sf_dir):
    return _once(spark, sf_dir, "agreements", "id", "uploaded_at").select("id", S.list_date(F.col("uploaded_at")).alias("uploaded"))


@query("SELECT id, coalesce(name, email) AS present, coalesce(nullif(name, ''), email) AS filled FROM users")
def nullish_and_falsy(spark, sf_dir):
    name, email = F.col("name"), F.col("email")
    return table(spark, sf_dir, "users").select("id", S.first_present(name, email).alias("present"), S.first_filled(name, email).alias("filled"))


@query(f"""SELECT id, replace(replace(replace(replace(replace(replace(url_encode(file_name), '+', '%20'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%7E', '~') AS encoded FROM {AGREEMENTS}""")
def encoded_names(spark, sf_dir):
    return _once(spark, sf_dir, "agreements", "id", "file_name").select("id", S.encode_component(F.col("file_name")).alias("encoded"))


@query(f"SELECT id, file_name, 'application/pdf' AS content_type FROM {AGREEMENTS}")
def query_parameters(spark, sf_dir):
    """Upload requests as URLs, and their parameters read again."""
    url = F.concat(F.lit("https://app.example/api/upload/presigned?fileName="), S.encode_form(F.col("file_name")), F.lit("&contentType=application%2Fpdf"))
    urls = _once(spark, sf_dir, "agreements", "id", "file_name").select("id", url.alias("url"))
    return sources.parameters(urls, "url", "fileName", "contentType").select("id", F.col("fileName").alias("file_name"), F.col("contentType").alias("content_type"))


@query("SELECT id, '{\"user\":' || CAST(to_json({'id': id, 'email': email, 'name': name}) AS VARCHAR) || '}' AS body FROM users")
def user_responses(spark, sf_dir):
    user = F.struct("id", "email", "name").alias("user")
    return table(spark, sf_dir, "users").select("id", sources.responses(F.struct(user)).alias("body"))


@query("SELECT md5(s3_key) AS id_part, s3_key FROM agreements WHERE s3_url IS NULL GROUP BY s3_key")
def objects_without_url(spark, sf_dir):
    agreements = table(spark, sf_dir, "agreements", "s3_key", "s3_url")
    objects = agreements.select("s3_key").distinct()
    return mutate.stored_without_row(objects, agreements.filter("s3_url is not null")).select(F.md5("s3_key").alias("id_part"), "s3_key")


@query(r"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS clause_index, parts[i] AS clause FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS parts, unnest(range(1, len(regexp_split_to_array(text, '\r?\n')) + 1)) AS i FROM documents WHERE text IS NOT NULL)
WHERE trim(parts[i], ' ') <> ''""")
def clause_fanout(spark, sf_dir):
    return C.segments(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


@query("""
SELECT analysis_id, CAST(count(*) AS BIGINT) AS clauses, md5(string_agg(clause_index || ':' || coalesce(md5(clause), 'null'), ',' ORDER BY clause_index)) AS digest FROM analyze_clause GROUP BY analysis_id""")
def clause_fanin(spark, sf_dir):
    """The clauses of each analysis together again, in their order."""
    rows = table(spark, sf_dir, "analyze_clause", "analysis_id", "clause_index", "clause").withColumn("hash", F.coalesce(F.md5("clause"), F.lit("null")))
    parts = F.transform("results", lambda r: F.concat(r["clause_index"].cast("string"), F.lit(":"), r["hash"]))
    return C.fan_in(rows, "analysis_id", "clause_index", "hash").select("analysis_id", F.size("results").cast("bigint").alias("clauses"), F.md5(F.array_join(parts, ",")).alias("digest"))


@query(r"""
SELECT clause_id, md5('## Lease clause' || chr(10) || clause || chr(10) || chr(10) || '## Relevant legal context' || chr(10) || coalesce(array_to_string(list_filter(legal_context, lambda x: x IS NOT NULL), chr(10) || chr(10)), '')) AS digest,
length('## Lease clause' || chr(10) || clause || chr(10) || chr(10) || '## Relevant legal context' || chr(10) || coalesce(array_to_string(list_filter(legal_context, lambda x: x IS NOT NULL), chr(10) || chr(10)), '')) AS chars
FROM analyze_clause WHERE clause IS NOT NULL""")
def prompt_build(spark, sf_dir):
    prompts = table(spark, sf_dir, "analyze_clause", "clause_id", "clause", "legal_context").filter("clause is not null").select("clause_id", C.prompt(F.col("clause"), F.col("legal_context")).alias("p"))
    return prompts.select("clause_id", F.md5("p").alias("digest"), F.length("p").cast("bigint").alias("chars"))


@query(f"""
SELECT result_id, upper(status) AS compliance, reason AS explanation, CAST(len(citations) AS INTEGER) AS citations FROM compliance_result
WHERE status IN ({_list(C.STATUSES)}) AND reason IS NOT NULL AND citations IS NOT NULL""")
def judgment_struct(spark, sf_dir):
    """Answers written as JSON, read and checked again, in the result table's names."""
    raw = table(spark, sf_dir, "compliance_result", "result_id", "status", "reason", "citations").select("result_id", F.to_json(F.struct("status", "reason", "citations")).alias("json"))
    return C.stored(C.judgments(raw, "result_id", "json")).select("result_id", "compliance", "explanation", F.size("rta_citations").alias("citations"))


@query("SELECT result_id, citations[1] AS first FROM compliance_result")
def first_citation(spark, sf_dir):
    """The first entry of each answer's citations; null for a null or empty array."""
    return table(spark, sf_dir, "compliance_result", "result_id", "citations").select("result_id", F.try_element_at("citations", F.lit(1)).alias("first"))


@query("SELECT result_id, CAST(i - 1 AS INTEGER) AS pos, citations[i] AS citation FROM (SELECT result_id, citations, unnest(range(1, len(citations) + 1)) AS i FROM compliance_result)")
def citation_rows(spark, sf_dir):
    return C.fan_out(table(spark, sf_dir, "compliance_result", "result_id", "citations"), "result_id", "citations").toDF("result_id", "pos", "citation")


@query("""
SELECT clause_id, CASE WHEN clause IS NULL THEN 'compliant'
WHEN regexp_matches(lower(clause), '\\b(may not|must not|forfeit|waives? all|penalty)\\b') THEN 'non_compliant'
WHEN regexp_matches(lower(clause), '\\b(reasonable|as needed|at the discretion)\\b') OR length(trim(clause, ' ')) < 20 THEN 'needs_review' ELSE 'compliant' END AS status FROM analyze_clause""".replace("\\\\", "\\"))
def keyword_judgments(spark, sf_dir):
    clauses = table(spark, sf_dir, "analyze_clause", "clause_id", "clause", "legal_context")
    return C.judge(clauses).select("clause_id", F.col("judgment.status").alias("status"))


_STATUS_OF = r"""CASE WHEN regexp_matches(lower(clause), '\b(may not|must not|forfeit|waives? all|penalty)\b') THEN 'NON_COMPLIANT'
WHEN regexp_matches(lower(clause), '\b(reasonable|as needed|at the discretion)\b') OR length(trim(clause, ' ')) < 20 THEN 'NEEDS_REVIEW' ELSE 'COMPLIANT' END"""


@query(rf"""
WITH parts AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS clause, unnest(range(0, len(regexp_split_to_array(text, '\r?\n')))) AS i FROM documents WHERE text IS NOT NULL),
judged AS (SELECT doc_id, CAST(i AS INTEGER) AS clause_index, clause, {_STATUS_OF} AS compliance FROM parts WHERE trim(clause, ' ') <> '')
SELECT doc_id, clause_index, md5(clause) AS digest, compliance, 'Fixed words: ' || lower(compliance) AS explanation, 0 AS citations FROM judged""")
def analyze_agreement(spark, sf_dir):
    """Whole documents through segments, context, prompts, the scorer, the check and the result table's names."""
    done = C.analyze(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return done.select("doc_id", "clause_index", F.md5("clause_text").alias("digest"), "compliance", "explanation", F.size("rta_citations").alias("citations"))


@query("SELECT clause_id, 0 AS snippets FROM analyze_clause")
def retrieve_none(spark, sf_dir):
    """The default context: nothing is retrieved."""
    return table(spark, sf_dir, "analyze_clause", "clause_id").select("clause_id", F.size(retrieve.no_context()).alias("snippets"))


@query("""
WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS match_id, round(list_cosine_similarity(q.e, v.e), 9) AS similarity FROM q, v WHERE q.vec_id <> v.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, match_id) AS INTEGER) AS rank, match_id, round(similarity, 6) AS similarity FROM s)
SELECT * FROM r WHERE rank <= 3""")
def retrieve_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    found = retrieve.top_k(vectors, vectors.filter("vec_id % 100 = 0"), 3)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT user_id, count(*) AS uploads, max(uploaded_at) AS last_upload FROM {AGREEMENTS} GROUP BY user_id")
def uploads_by_owner(spark, sf_dir):
    return rollup.uploads_by_owner(_once(spark, sf_dir, "agreements", "id", "user_id", "uploaded_at"))


@query(f"""
SELECT a.user_id, strftime(s.created_at, '%Y-%m') AS month, count(*) AS analyses FROM {ANALYSES} s JOIN {AGREEMENTS} a ON s.agreement_id = a.id GROUP BY ALL""")
def analyses_by_month(spark, sf_dir):
    return rollup.analyses_by_month(_once(spark, sf_dir, "analyses", "id", "agreement_id", "created_at"), _once(spark, sf_dir, "agreements", "id", "user_id"))


@query("""
SELECT c.analysis_id, count(*) AS answers, count(*) FILTER (lower(replace(r.status, '-', '_')) = 'non_compliant') AS non_compliant,
count(*) FILTER (lower(replace(r.status, '-', '_')) = 'needs_review') AS needs_review,
CAST(coalesce(max(CASE r.severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN NULL THEN 0 END), 0) AS BIGINT) AS worst
FROM compliance_result r JOIN analyze_clause c ON r.clause_id = c.clause_id GROUP BY c.analysis_id""")
def judgments_by_analysis(spark, sf_dir):
    return rollup.judgments_by_analysis(table(spark, sf_dir, "compliance_result"), table(spark, sf_dir, "analyze_clause"))


@query("""
SELECT c.analysis_id, CAST(50 * (2 * count(*) FILTER (lower(replace(r.status, '-', '_')) = 'non_compliant') + count(*) FILTER (lower(replace(r.status, '-', '_')) = 'needs_review')) // count(*) AS INTEGER) AS risk_score,
  count(*) FILTER (lower(replace(r.status, '-', '_')) = 'non_compliant') || ' of ' || count(*) || ' answers are non-compliant, ' || count(*) FILTER (lower(replace(r.status, '-', '_')) = 'needs_review') || ' need review' AS overall_summary
FROM compliance_result r JOIN analyze_clause c ON r.clause_id = c.clause_id GROUP BY c.analysis_id""")
def analysis_summaries(spark, sf_dir):
    results, clauses = table(spark, sf_dir, "compliance_result", "clause_id", "status", "severity"), table(spark, sf_dir, "analyze_clause", "clause_id", "analysis_id")
    return rollup.summaries(rollup.judgments_by_analysis(results, clauses))


@query("SELECT id AS user_id, id NOT IN (SELECT user_id FROM agreements) AS is_empty FROM users")
def empty_lists(spark, sf_dir):
    """Whether each user's list of agreements is empty."""
    owners = table(spark, sf_dir, "agreements", "user_id").distinct().select(F.col("user_id").alias("id"), F.lit(False).alias("none"))
    return table(spark, sf_dir, "users", "id").join(owners, "id", "left").select(F.col("id").alias("user_id"), F.coalesce("none", F.lit(True)).alias("is_empty"))


@query(f"SELECT id, '{{\"id\":\"' || id || '\",\"s3Key\":' || CAST(to_json(s3_key) AS VARCHAR) || '}}' AS body FROM {AGREEMENTS} WHERE s3_key IS NOT NULL")
def upload_results(spark, sf_dir):
    """What an upload gives back."""
    stored = _once(spark, sf_dir, "agreements", "id", "s3_key").filter("s3_key is not null")
    return stored.select("id", sources.responses(F.struct("id", F.col("s3_key").alias("s3Key"))).alias("body"))


@query(f"SELECT id, date_diff('millisecond', started_at, completed_at) AS millis FROM {ANALYSES}")
def analysis_durations(spark, sf_dir):
    return rollup.durations(_once(spark, sf_dir, "analyses", "id", "started_at", "completed_at"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
