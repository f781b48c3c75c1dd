"""Mutations as functions from the old state to the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.functions.scalars import first_filled, stable_id
from clauseworks.schemas import DEFAULTS, FOREIGN, SCHEMAS


def with_defaults(rows: DataFrame, name: str, now: str, natural_key: list[str]) -> DataFrame:
    """``rows`` in table ``name``'s columns: given values, else the defaults, times ``now`` and an id of the natural key."""
    times = {"created_at", "updated_at", "uploaded_at"}
    given = {f.name for f in rows.schema.fields}
    out = []
    for f in SCHEMAS[name].fields:
        if f.name == "id":  # a given id stays
            value = stable_id(*map(F.col, natural_key))
        elif f.name in times:
            value = F.lit(now).cast("timestamp_ntz")
        else:
            value = F.lit(DEFAULTS.get(name, {}).get(f.name))
        out.append((F.coalesce(F.col(f.name), value) if f.name in given else value).cast(f.dataType).alias(f.name))
    return rows.select(*out)


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows)


def update(table: DataFrame, changes: DataFrame, key: str, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with ``changes``' other columns put in where the keys meet; ``changes`` has a key once.

    A null change of a column in ``keep_if_null`` leaves the old value."""
    new = changes.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in changes.columns if c != key))
    changed = [c for c in changes.columns if c != key]
    value = lambda c: F.coalesce(F.col(f"_{c}"), F.col(c)) if c in keep_if_null else F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c))
    return table.join(new, key, "left").select(*((value(c) if c in changed else F.col(c)).alias(c) for c in table.columns))


def fill_profile(users: DataFrame, profiles: DataFrame, key: str = "email") -> DataFrame:
    """Users with empty names and images filled from ``profiles`` (key, name, image), and marked verified if they have one."""
    new = profiles.select(key, F.col("name").alias("_name"), F.col("image").alias("_image"), F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False))
    return users.join(new, key, "left").select(
        *(
            {
                "name": F.when(hit, first_filled(F.col("name"), F.col("_name"))).otherwise(F.col("name")),
                "image": F.when(hit, first_filled(F.col("image"), F.col("_image"))).otherwise(F.col("image")),
                "email_verified": F.col("email_verified") | hit,
            }
            .get(c, F.col(c))
            .alias(c)
            for c in users.columns
        )
    )


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and those of ``rows`` whose key it doesn't have, one for each key; rows that are there stay as they are."""
    # the least of a key's rows, combined before the shuffle
    first = rows.groupBy(key).agg(F.min(F.struct(*(c for c in rows.columns if c != key))).alias("_first")).select(key, "_first.*") if len(rows.columns) > 1 else rows.distinct()
    return table.unionByName(first.join(table.select(key), key, "left_anti").select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, column: str = "id") -> DataFrame:
    """``table`` without the rows whose ``column`` is in ``keys`` (id); rows with a null there stay."""
    gone = keys.select(F.col("id").alias("_gone"))
    return table.join(gone, F.col(column) == F.col("_gone"), "left_anti")


def cascade(tables: dict[str, DataFrame], name: str, keys: DataFrame) -> dict[str, DataFrame]:
    """``tables`` after the rows ``keys`` (id) of table ``name`` and all that depends on them are gone."""
    out = dict(tables)
    todo = [(name, keys)]
    while todo:
        parent, gone = todo.pop(0)
        out[parent] = delete(out[parent], gone)
        for child, column, of in FOREIGN:
            if of == parent and child in out:
                lost = out[child].join(gone.select(F.col("id").alias("_p")), F.col(column) == F.col("_p"), "left_semi")
                if "id" in out[child].columns:
                    todo.append((child, lost.select("id").distinct()))
                else:
                    out[child] = delete(out[child], gone, column)
    return out


def stored_without_row(objects: DataFrame, agreements: DataFrame) -> DataFrame:
    """Stored objects (s3_key) that no agreement names any more."""
    return objects.join(agreements.select("s3_key"), "s3_key", "left_anti")


def create_agreements(users: DataFrame, agreements: DataFrame, requests: DataFrame, owner: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, agreements, responses) after requests (request, file_name, s3_key) of one ``owner`` (one row of id, email,
    name): 400 without a file name or key, 409 for a key that is there already or that an earlier request took, else 201.

    The owner is inserted if it isn't there. The 409 is ours: the key is unique, and nothing says what a second use of it gives.
    """
    good = requests.filter(F.coalesce(F.length("file_name"), F.lit(0)) > 0).filter(F.coalesce(F.length("s3_key"), F.lit(0)) > 0)
    taken = agreements.filter("s3_key is not null").select("s3_key", F.lit(True).alias("_taken")).distinct()
    first = good.groupBy("s3_key").agg(F.min("request").alias("_first"))
    checked = good.select("request").withColumn("_good", F.lit(True))
    answered = (
        requests.join(checked, "request", "left").join(taken, "s3_key", "left").join(first, "s3_key", "left")
        .withColumn("code", F.when(F.col("_good").isNull(), 400).when(F.col("_taken").isNotNull() | (F.col("request") > F.col("_first")), 409).otherwise(201))
        .drop("_good", "_taken", "_first")
    )
    own = owner.select(F.col("id").alias("user_id"))
    rows = with_defaults(answered.filter("code = 201").crossJoin(F.broadcast(own)).select("user_id", "file_name", "s3_key"), "agreements", now, ["s3_key"])  # one row
    inserted = insert_absent(users, with_defaults(owner, "users", now, ["id"]).select(*users.columns), "id")
    return inserted, agreements.unionByName(rows.select(*agreements.columns)), answered.select("request", "file_name", "s3_key", "code")
