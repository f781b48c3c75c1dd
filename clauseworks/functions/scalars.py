"""Scalar functions; all stay in the JVM. Null in gives null out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_present(*columns: Column) -> Column:
    """The first value that isn't null; an empty string is a value."""
    return F.coalesce(*columns)


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor an empty string, else the last one."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns[:-1]), columns[-1])


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units; a character beyond U+FFFF counts two."""
    return F.length(c) + F.regexp_count(c, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def encode_component(c: Column) -> Column:
    """Percent encoding of a URI component: a space is %20, and ! ' ( ) ~ * stay."""
    kept = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
    return reduce(lambda x, k: F.replace(x, F.lit(k), F.lit(kept[k])), kept, F.url_encode(c))


def encode_form(c: Column) -> Column:
    """Form encoding: a space is +."""
    return F.url_encode(c)


def query_parameter(url: Column, name: str) -> Column:
    """A decoded parameter of a URL's query string; null if it is missing or can't be decoded."""
    return F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, read as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def object_key(ts: Column, file_name: Column) -> Column:
    """The key under which an upload is stored."""
    return F.concat(F.lit("uploads/"), epoch_millis(ts).cast("string"), F.lit("-"), file_name)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def list_date(ts: Column) -> Column:
    """Year/month/day without padding."""
    return F.date_format(ts, "yyyy/M/d")


def stable_id(*natural_key: Column) -> Column:
    """An id that depends on the natural key alone, so that a rerun gives the same one. Nulls count as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in natural_key)), 256)


def labelled(c: Column, labels: dict[str, str]) -> Column:
    """The label of a value; null for a value without one."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), c)


def rank_in(c: Column, domain: list[str]) -> Column:
    """The place of an enumerated value in its declared order, from 1; 0 if it isn't in the domain."""
    return F.array_position(F.array(*map(F.lit, domain)), c)
