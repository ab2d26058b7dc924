"""From raw lines to records.

A line is trimmed, and rejected if it is empty, too long or binary. Then it is cut to fields: commas
separate; a colon does where the field already has an @ (name@host:secret); a space does once two
fields are complete. Quotes may open anywhere and protect separators; a doubled quote within them
is a quote; an open quote runs to the end. Every field is trimmed, and a blank last one is no field.

The native form never walks characters: separators within quotes are first replaced by control
characters (which can't occur, as binary lines are gone), then the first two fields are cut at their
separators, and one linear pattern takes the rest. The mask is only computed for lines that have a quote. Null lines are
empty ones. parse_lines adds columns and keeps those of its input; names of the record win clashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import WHITE_SPACE, normalize_url, normalize_username, trim_unicode
from ..plans.shipping import ship
from .names import fresh

#: Limits of the grammar, in bytes, and the fewest fields.
MAX_LINE_BYTES = 40_960
MAX_FIELD_BYTES = 4_096
MIN_FIELDS = 2
#: A control character that makes a line binary; a field of the tail.
CONTROL = r"[\p{Cc}&&[^\t\r\n]]"
TAIL = r"([^,@ ]*(?:@[^,: ]*)?)([,: ]|\z)"
_MASKED, _MASKS = ",: ", "\x01\x02\x03"

RECORD = ("username", "password", "url", "extra_fields")


def line_fault(line: Column) -> Column:
    """Why a trimmed line can't be parsed: empty, long or binary; else null."""
    return F.when(line == "", "empty").when(F.octet_length(line) > MAX_LINE_BYTES, "long").when(line.rlike(CONTROL), "binary")


def clean_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """df with column trimmed, without lines that can't be parsed."""
    trimmed = df.withColumn(column, trim_unicode(F.coalesce(F.col(column), F.lit(""))))
    return trimmed.where(line_fault(F.col(column)).isNull())


def mask_quotes(line: Column) -> Column:
    """line without its quote signs, with separators that they protect masked."""
    parts = F.split(line, '"', -1)
    last = F.size(parts) - 1
    piece = lambda x, i: F.when(i % 2 == 1, F.translate(x, _MASKED, _MASKS)).when((x == "") & (i > 0) & (i < last), F.lit('"')).otherwise(x)
    return F.when(line.contains('"'), F.array_join(F.transform(parts, piece), "")).otherwise(line)


def lead_field(c: Column) -> Column:
    """What stands before the first comma, or before the first colon that follows an @ there."""

    def at_colon(part: Column) -> Column:
        at = F.instr(part, "@")
        colon = F.call_function("locate", F.lit(":"), part, F.greatest(at, F.lit(1)))
        return F.when((at > 0) & (colon > 0), part.substr(F.lit(1), colon - 1)).otherwise(part)

    return let(F.substring_index(c, ",", 1), at_colon)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it (a plain alias would be inlined by the optimizer)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_fields(line: Column) -> Column:
    """The array of a clean line's fields."""
    none = F.array().cast("array<string>")
    quoted = line.contains('"')
    after = lambda whole, part: whole.substr(F.length(part) + 2, F.length(whole))
    opened = lambda c: trim_unicode(F.when(quoted, F.translate(c, _MASKS, _MASKED)).otherwise(c))
    kept = lambda part, done: let(opened(part), lambda f: F.when(done | (f != ""), F.array(f)).otherwise(none))

    def tail(rest: Column) -> Column:
        # the pattern always matches once more, emptily, at the end; a blank last field that no separator ended is no field
        def drop_blank(raw: Column) -> Column:
            last = F.element_at(raw, -2)
            real = F.size(raw) - 1
            blank = (last != "") & (opened(last) == "") & rest.endswith(last)
            return F.transform(F.slice(raw, 1, F.when(blank, real - 1).otherwise(real)), opened)

        return F.when(rest == "", none).otherwise(let(F.regexp_extract_all(rest, F.lit(TAIL), 1), drop_blank))

    def second(first: Column, rest: Column) -> Column:
        def with_second(f: Column) -> Column:
            done = F.length(rest) > F.length(f)
            return F.concat(F.array(opened(first)), kept(f, done), F.when(done, let(after(rest, f), tail)).otherwise(none))

        return let(lead_field(rest), with_second)

    def whole(masked: Column) -> Column:
        def with_first(f: Column) -> Column:
            done = F.length(masked) > F.length(f)
            return F.when(done, let(after(masked, f), lambda rest: second(f, rest))).otherwise(kept(f, F.lit(False)))

        return let(lead_field(masked), with_first)

    return let(mask_quotes(line), whole)


def split_fields(df: DataFrame, column: str = "value", name: str = "_fields") -> DataFrame:
    """df (clean lines) with the array of a line's fields as the column name."""
    return df.select("*", F.explode(F.array(line_fields(F.col(column)))).alias(name))  # a generator: what follows can't be pushed into it


def split_line(line: str) -> list[str]:
    """The fields of one clean line, for the pandas form and for tests."""
    fields, held, quoted, at = [], [], False, 0
    while at < len(line):
        sign = line[at]
        at += 1
        if sign == '"':
            if quoted and line[at : at + 1] == '"':
                held.append(sign)
                at += 1
            else:
                quoted = not quoted
            continue
        parts = not quoted and (sign == "," or (sign == ":" and "@" in held) or (sign == " " and len(fields) >= 2))
        if parts:
            fields.append("".join(held))
            held = []
        else:
            held.append(sign)
    if _strip("".join(held)):
        fields.append("".join(held))
    return [_strip(f) for f in fields]


def _strip(text: str) -> str:
    return text.strip(WHITE_SPACE)


def split_fields_pandas(df: DataFrame, column: str = "value", name: str = "_fields") -> DataFrame:
    """split_fields by an Arrow batch function instead of expressions."""
    ship(df.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            yield lines.map(split_line)

    return df.withColumn(name, cut(F.col(column)))


def project_fields(df: DataFrame, fields: str = "_fields", fault: str = "_fault") -> DataFrame:
    """df with the record's columns taken by place from the column fields; rows with a fault have it in the column fault."""
    f = F.col(fields)
    get = lambda i: F.coalesce(F.try_element_at(f, F.lit(i)), F.lit(""))
    out = df.withColumns({"username": get(1), "password": get(2), "url": get(3), "extra_fields": F.slice(f, 4, F.greatest(F.size(f) - 3, F.lit(0)))})
    over = (F.octet_length("username") > MAX_FIELD_BYTES) | (F.octet_length("password") > MAX_FIELD_BYTES) | (F.octet_length("url") > MAX_FIELD_BYTES)
    return out.withColumn(fault, F.when(F.size(f) < MIN_FIELDS, "fields").when(F.col("username") == "", "username").when(over, "field_length")).drop(fields)


def with_normalized(df: DataFrame) -> DataFrame:
    return df.withColumns({"normalized_username": normalize_username(F.col("username")), "normalized_url": normalize_url(F.col("url"))})


def parse_lines(df: DataFrame, column: str = "value", form: str = "native") -> DataFrame:
    """df's parsable lines with the record's columns. form: native (expressions) or pandas.

    Columns of df that are named like the record's are replaced; others, whatever their names, stay.
    """
    clean = clean_lines(df.drop(*[c for c in (*RECORD, "normalized_username", "normalized_url") if c != column]), column)
    fields, fault = fresh(clean, "_fields"), fresh(clean, "_fault")
    cut = (split_fields if form == "native" else split_fields_pandas)(clean, column, fields)
    return with_normalized(project_fields(cut, fields, fault).where(F.col(fault).isNull()).drop(fault))


def reject_reasons(df: DataFrame, column: str = "value") -> DataFrame:
    """df with reason: why a line is rejected, ok if it is not. Lines that can't be parsed are cut as empty lines."""
    before, whole, fields, fault = (fresh(df, c) for c in ("_line_fault", "_safe", "_fields", "_fault"))
    trimmed = df.withColumn(column, trim_unicode(F.coalesce(F.col(column), F.lit("")))).withColumn(before, line_fault(F.col(column)))
    safe = trimmed.withColumn(whole, F.when(F.col(before).isNull(), F.col(column)).otherwise(F.lit("")))
    parsed = project_fields(split_fields(safe, whole, fields), fields, fault)
    return parsed.withColumn("reason", F.coalesce(before, fault, F.lit("ok"))).drop(before, whole, fault, *[c for c in RECORD if c not in df.columns])

