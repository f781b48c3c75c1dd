"""Row checks with the first failing rule, and outcome codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseworks.functions.scalars import utf16_length
from clauseworks.schemas import MAX_UPLOAD_BYTES, MIN_PASSWORD

# The type of file that can be uploaded.
UPLOAD_TYPE = "application/pdf"
# A local part without spaces or @ and a domain of labels with a point; our choice, as the format has no one definition.
EMAIL = r"^[A-Za-z0-9._%+'-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}$"


def is_email(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL), F.lit(False))


def has_length(c: Column, least: int) -> Column:
    """At least ``least`` UTF-16 units; white space counts."""
    return F.coalesce(utf16_length(c) >= least, F.lit(False))


def is_filled(c: Column) -> Column:
    return has_length(c, 1)


def optional(c: Column, rule: Column) -> Column:
    return c.isNull() | rule


def fits(size: Column, most: int = MAX_UPLOAD_BYTES) -> Column:
    """A size up to and including ``most``."""
    return F.coalesce(size <= most, F.lit(False))


def in_domain(c: Column, domain: list[str]) -> Column:
    return F.coalesce(c.isin(*domain), F.lit(False))


def first_issue(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule that doesn't hold, null if all do. A rule that gives null doesn't hold."""
    return F.coalesce(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(message)) for rule, message in rules), F.lit(None).cast("string"))


def outcome(*cases: tuple[Column, int], otherwise: int) -> Column:
    """The code of the first case that holds, in order."""
    return F.coalesce(*(F.when(F.coalesce(case, F.lit(False)), F.lit(code)) for case, code in cases), F.lit(otherwise))


def filled_issue(columns: dict[str, str]) -> Column:
    """The message of the first of ``columns`` (name: message) that is null or empty, null if none is."""
    return first_issue(*((is_filled(F.col(c)), message) for c, message in columns.items()))


def upload_issue(content_type: Column, size: Column, most: int = MAX_UPLOAD_BYTES) -> Column:
    """What is wrong with a file to upload: its type, else its size; null if nothing is. The type is compared as it is."""
    return first_issue((content_type == F.lit(UPLOAD_TYPE), "Only PDF files are supported"), (fits(size, most), "File size cannot be greater than 20MB"))


def signup_issue(email: str = "email", password: str = "password", name: str = "name") -> Column:
    return first_issue(
        (is_email(F.col(email)), "Invalid email"),
        (has_length(F.col(password), MIN_PASSWORD), f"Password needs {MIN_PASSWORD} characters"),
        (optional(F.col(name), is_filled(F.col(name))), "Name is empty"),
    )


def signup(requests: DataFrame, users: DataFrame) -> DataFrame:
    """``requests`` (email, password, name) with ``issue`` and ``code``: 400 for an issue, 409 for a known e-mail, else 201.

    Requests with one e-mail are taken in the order of ``request``: the second of two good ones finds the first."""
    known = users.select(F.col("email").alias("known")).filter("known is not null").distinct()
    checked = requests.withColumn("issue", signup_issue())
    # only good requests take an e-mail; the first of each is an aggregate, combined before the shuffle
    first = checked.filter("issue is null").groupBy(F.col("email").alias("wanted")).agg(F.min("request").alias("first"))
    return (
        checked.join(known, F.col("email") == F.col("known"), "left")
        .join(first, F.col("email") == F.col("wanted"), "left")
        .withColumn("code", outcome((F.col("issue").isNotNull(), 400), (F.col("known").isNotNull() | (F.col("request") > F.col("first")), 409), otherwise=201))
        .drop("known", "wanted", "first")
    )


def login(requests: DataFrame, users: DataFrame) -> DataFrame:
    """``requests`` (email, password) with ``code``: 400 for a bad form, 401 for an unknown e-mail or a user without a
    password, else 200. Comparing the password itself is left to the caller."""
    known = users.filter("email is not null").groupBy("email").agg(F.max(F.coalesce(F.nullif("password_hash", F.lit("")), F.lit(""))).alias("hash"))
    form = is_email(F.col("email")) & is_filled(F.col("password"))
    return requests.join(known, "email", "left").withColumn("code", outcome((~form, 400), (F.coalesce("hash", F.lit("")) == "", 401), otherwise=200)).drop("hash")


def deletion(requests: DataFrame, agreements: DataFrame) -> DataFrame:
    """``requests`` (agreement_id, caller) with ``code``: 404 for a missing agreement, then 403 for another's, else 204."""
    owners = agreements.select(F.col("id").alias("agreement_id"), F.col("user_id").alias("owner")).distinct()
    return requests.join(owners, "agreement_id", "left").withColumn(
        "code", outcome((F.col("owner").isNull(), 404), (~F.col("owner").eqNullSafe(F.col("caller")), 403), otherwise=204)
    )
