"""Normalisation of names and addresses as Catalyst expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest host that is kept, in bytes, and the e-mail form.
MAX_HOST_BYTES = 255
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


#: Fixed value: Unicode White_Space.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim_unicode(c: Column) -> Column:
    """Strip Unicode white space from both ends; no pattern is run."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def normalize_username(c: Column) -> Column:
    return F.lower(c)


def ascii_lower(c: Column) -> Column:
    """Lower A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def normalize_url(c: Column) -> Column:
    """Lower-case, without one scheme and one final slash; of android addresses the part before the first @."""
    low = F.lower(c)
    app = F.substring_index(low.substr(F.lit(11), F.length(low)), "@", 1)
    web = F.regexp_replace(low, r"^(https?://|ftp://|mailto:)", "")
    return F.regexp_replace(F.when(low.startswith("android://"), app).otherwise(web), r"/\z", "")


def detect_protocol(c: Column) -> Column:
    """The length of the scheme that an address begins with, 0 if none; the case counts."""
    return F.length(F.regexp_extract(c, r"^(https?://|android://|ftp://|mailto:/)", 1))


def normalize_host(c: Column) -> Column:
    """The host: scheme (in lower case only) and one www. off, up to /, ? or #, A-Z lowered, at most 255 bytes.

    Of android addresses the part after the last @ counts. A code point that the byte limit cuts is
    replaced by U+FFFD.
    """
    app = F.regexp_replace(c.substr(F.lit(11), F.length(c)), r"(?s)^.*@", "")
    web = F.regexp_replace(c, r"^(https?://|ftp://|mailto:/)", "")
    rest = F.regexp_replace(F.when(c.startswith("android://"), app).otherwise(web), r"^www\.", "")
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    cut = F.make_valid_utf8(F.substring(host.cast("binary"), 1, MAX_HOST_BYTES).cast("string"))
    return F.when(F.octet_length(host) > MAX_HOST_BYTES, cut).otherwise(host)


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def starts_with(c: Column, prefix: str) -> Column:
    return c.startswith(prefix)


def find_char(c: Column, sign: str) -> Column:
    """Place of the first sign from 0, -1 if there is none."""
    return F.instr(c, sign) - 1


def find_last_char(c: Column, sign: str) -> Column:
    """Place of the last sign from 0, -1 if there is none."""
    back = F.instr(F.reverse(c), sign)
    return F.when(back > 0, F.length(c) - back).otherwise(F.lit(-1))
