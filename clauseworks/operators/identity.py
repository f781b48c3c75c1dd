"""Sign-in through an identity provider, as new states of users and accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseworks.functions.scalars import plus_seconds, stable_id
from clauseworks.operators import mutate

# The reasons with which a callback ends, in the order in which they are looked at.
REASONS = ("oauth_cancelled", "oauth_not_configured", "oauth_token_failed", "oauth_profile_failed")


def callback_reason(error: Column, code: Column, configured: Column, token_ok: Column, profile_ok: Column) -> Column:
    """The reason with which a callback fails, the first that holds; null if it goes on. An empty error or code is none."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    holds = (filled(error) | ~filled(code), ~F.coalesce(configured, F.lit(False)), ~F.coalesce(token_ok, F.lit(False)), ~F.coalesce(profile_ok, F.lit(False)))
    return F.coalesce(*(F.when(h, F.lit(r)) for h, r in zip(holds, REASONS)), F.lit(None).cast("string"))


def from_profile(profiles: DataFrame) -> DataFrame:
    """A provider's profiles in the tables' names: sub is account_id, picture is image."""
    named = {"sub": "account_id", "picture": "image"}
    return profiles.select(*(F.col(c).alias(named.get(c, c)) for c in profiles.columns))


def sign_in(users: DataFrame, accounts: DataFrame, incoming: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(users, accounts) after a batch of sign-ins (arrival, provider_id, account_id, email, name, image, access_token,
    refresh_token, expires_in), as if they came one after the other in order of arrival.

    A known account gets the last access token and its time, and the last refresh token that isn't null. A new account
    is linked to the user with its e-mail, who is verified then and gets a name and image if they were empty, or makes
    a new user. Several rows of one new account make one account; new accounts of one e-mail share one user. Rows
    without an account, and new accounts without an e-mail, change nothing. All that is needed of a key's rows are
    aggregates, so a key with many rows is combined before it is shuffled.
    """
    rows = incoming.filter(F.col("provider_id").isNotNull() & F.col("account_id").isNotNull())
    key = ["provider_id", "account_id"]
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    last = rows.groupBy(*key).agg(
        F.max_by("access_token", "arrival").alias("_access"),
        F.max_by("expires_in", "arrival").alias("_expires"),
        F.max_by("refresh_token", F.when(F.col("refresh_token").isNotNull(), F.col("arrival"))).alias("_refresh"),
        *(F.min_by(c, "arrival").alias(c) for c in ("email", "name", "image")),
        F.min("arrival").alias("arrival"),
    )
    expires = plus_seconds(F.lit(now).cast("timestamp_ntz"), F.col("_expires"))
    kept = accounts.join(last.select(*key, "_access", "_expires", "_refresh", F.lit(True).alias("_hit")), key, "left").select(
        *(
            {
                "access_token": F.when(F.col("_hit"), F.col("_access")).otherwise(F.col("access_token")),
                "refresh_token": F.coalesce("_refresh", "refresh_token"),
                "access_token_expires_at": F.when(F.col("_hit"), expires).otherwise(F.col("access_token_expires_at")),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in accounts.columns
        )
    )
    new = last.join(accounts.select(*key), key, "left_anti").filter(F.col("email").isNotNull())
    # the first name that isn't empty, else the last row's; a user's own comes before them
    first = lambda c: F.coalesce(F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col("arrival"))), F.max_by(c, "arrival"))
    by_mail = new.groupBy("email").agg(first("name").alias("_name"), first("image").alias("_image"))
    changed = mutate.fill_profile(users, by_mail.select("email", F.col("_name").alias("name"), F.col("_image").alias("image")))
    born = by_mail.join(users.select("email"), "email", "left_anti").select("email", F.col("_name").alias("name"), F.col("_image").alias("image"), F.lit(True).alias("email_verified"))
    added = mutate.with_defaults(born, "users", now, ["email"]).select(*(F.col(c) for c in users.columns if c in mutate.SCHEMAS["users"].names))
    owner = new.join(users.select("email", F.col("id").alias("_user")), "email", "left").withColumn("user_id", F.coalesce("_user", stable_id(F.col("email"))))
    made = owner.select(*key, "user_id", F.col("_access").alias("access_token"), F.col("_refresh").alias("refresh_token"), expires.alias("access_token_expires_at"))
    made = mutate.with_defaults(made, "accounts", now, key).select(*accounts.columns)
    return changed.unionByName(added), kept.unionByName(made)

