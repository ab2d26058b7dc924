"""Expressions over the parsed record: username, password, url, extra_fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import normalize_url

RECORD_SCHEMA = "username string, password string, url string, extra_fields array<string>, normalized_username string, normalized_url string"
#: Fixed value: bytes that a record is reckoned to take besides its text.
RECORD_OVERHEAD = 256


def dedup_key(username: Column, second: Column, case_sensitive: bool = False) -> Column:
    """username:second as one string; the name is lowered unless the case counts."""
    name = username if case_sensitive else F.lower(username)
    return F.concat(F.coalesce(name, F.lit("")), F.lit(":"), F.coalesce(second, F.lit("")))


def record_key(kind: str = "username", case_sensitive: bool = False, normalize_urls: bool = True) -> Column:
    """The key column of a record: username:password, or username:url (normalised or as it is)."""
    if kind == "username":
        return dedup_key(F.col("username"), F.col("password"), case_sensitive)
    if kind == "username_url":
        return dedup_key(F.col("username"), normalize_url(F.col("url")) if normalize_urls else F.col("url"), case_sensitive)
    raise ValueError(f"no key named {kind}")


def field_count(url: Column, extra: Column) -> Column:
    return F.lit(2) + (url != "").cast("int") + F.size(extra)


def estimated_size(username: Column, password: Column, url: Column, extra: Column) -> Column:
    """Bytes of all fields and the overhead."""
    tail = F.aggregate(F.transform(extra, lambda x: F.octet_length(x)), F.lit(0), lambda a, x: a + x)
    return F.octet_length(username) + F.octet_length(password) + F.octet_length(url) + tail + RECORD_OVERHEAD


def to_csv_line(username: Column, password: Column, url: Column, extra: Column) -> Column:
    """Fields joined by commas without quoting; an empty url is left out."""
    return F.concat_ws(",", username, password, F.when(url != "", url), extra)


def to_quoted_line(username: Column, password: Column, url: Column, extra: Column) -> Column:
    """Like to_csv_line, but the url's place is kept and fields that hold a separator or quote are quoted."""
    quote = lambda c: F.when(c.rlike('[",:\\s]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    tail = F.when((url != "") | (F.size(extra) > 0), quote(url))
    return F.concat_ws(",", quote(username), quote(password), tail, F.transform(extra, quote))


def record_json() -> Column:
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
    return F.to_json(F.struct(*names))


def record_from_json(c: Column) -> Column:
    return F.from_json(c, RECORD_SCHEMA)
