"""Text values of a relational dump as document values, by SQL type. What does not parse stays as it was.

The typed functions give null there; `convert` falls back to the text.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = ("int", "smallint", "bigint", "serial", "bigserial", "smallserial")
FLOATS = ("real", "double", "float")
TRUE, FALSE = ["t", "true", "TRUE", "1"], ["f", "false", "FALSE", "0"]
STAMP = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[ T]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?(?:Z|[+-][0-9:]+)?)?$"


def integer(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def minor_units(text: Column, scale: int) -> Column:
    """Exact: digits beyond the scale are cut off, beyond 64 bits gives null."""
    clean = F.regexp_replace(F.trim(text), r"[$,]", "")
    whole = F.regexp_extract(clean, r"^([+-]?[0-9]*)(?:\.[0-9]*)?$", 1)
    part = F.regexp_extract(clean, r"^[+-]?[0-9]*\.([0-9]*)$", 1)
    digits = F.concat(whole, F.substring(F.rpad(part, max(scale, 1), "0"), 1, scale))
    return F.when(clean.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"), digits.try_cast("bigint"))


def floating(text: Column) -> Column:
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def boolean(text: Column) -> Column:
    return F.when(text.isin(TRUE), True).when(text.isin(FALSE), False)


def epoch_ms(text: Column) -> Column:
    """Milliseconds since 1970, the zone dropped and digits beyond milliseconds cut off."""
    part = lambda i: F.regexp_extract(text, STAMP, i)
    days = F.datediff(F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.concat_ws("-", part(1), part(2), part(3)).try_cast("date"), F.lit("1970-01-01").cast("date"))
    number = lambda i: F.coalesce(part(i).try_cast("bigint"), F.lit(0))
    fraction = F.substring(F.rpad(part(7), 3, "0"), 1, 3).try_cast("bigint")
    ms = ((days.cast("bigint") * 24 + number(4)) * 60 + number(5)) * 60000 + number(6) * 1000 + F.coalesce(fraction, F.lit(0))
    return F.when(text.rlike(STAMP) & (number(4) < 24) & (number(5) < 60) & (number(6) < 60), ms)


def array_items(literal: str | None):
    """`{a,"b c",NULL,{d}}` as a list of strings, nulls and lists; None if it isn't one."""
    if literal is None or not literal.startswith("{"):
        return None
    at = 0

    def items():
        nonlocal at
        out, at = [], at + 1
        if literal[at : at + 1] == "}":
            at += 1
            return out
        while True:
            if literal[at : at + 1] == "{":
                out.append(items())
            elif literal[at : at + 1] == '"':
                own, at_ = [], at + 1
                while literal[at_] != '"':
                    at_ += literal[at_] == "\\"
                    own.append(literal[at_])
                    at_ += 1
                out.append("".join(own))
                at = at_ + 1
            else:
                m = re.match(r"(?:\\.|[^,{}\"])+", literal[at:])
                if not m:
                    raise ValueError
                at += m.end()
                out.append(None if m[0] == "NULL" else re.sub(r"\\(.)", r"\1", m[0]))
            c = literal[at : at + 1]
            at += 1
            if c == "}":
                return out
            if c != ",":
                raise ValueError

    try:
        got = items()
        return got if at == len(literal) else None
    except (ValueError, IndexError):
        return None


@F.pandas_udf(T.StringType())
def array_json(texts: pd.Series) -> pd.Series:
    """Array literals as JSON text; null where they aren't any. Nothing built in reads their quoting."""
    return texts.map(lambda t: None if (own := array_items(t)) is None else json.dumps(own))


@F.pandas_udf(T.StringType())
def fnv1a(texts: pd.Series) -> pd.Series:
    """FNV-1a, 64 bits, in hex: a stable id for rows without a key."""

    def own(t):
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return f"{h:016x}"

    return texts.map(lambda t: None if t is None else own(t))


def stable_id(columns: list[Column]) -> Column:
    """Of all fields in order; a null differs from an empty text."""
    return fnv1a(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), c), F.lit("~")) for c in columns]))


def new_id(now_ms: Column | None = None) -> Column:
    """48 bits of time, 80 random ones, in hex: ids sort by time of making."""
    now = now_ms if now_ms is not None else F.unix_millis(F.current_timestamp())
    return F.lower(F.concat(F.lpad(F.hex(now), 12, "0"), F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 20)))


def scale_of(kind: str) -> int | None:
    if kind.startswith("money"):
        return 2
    m = re.match(r"(?:numeric|decimal)\s*\(\s*\d+\s*(?:,\s*(\d+)\s*)?\)", kind)
    return int(m[1]) if m and m[1] is not None else None


def family(kind: str) -> str:
    """Which function reads the SQL type: integer, minor, float, bool, time, json, array or text."""
    k = kind.lower().strip()
    if k.endswith("[]") or k.startswith("_"):
        return "array"
    if k.startswith(INTEGERS) and not k.startswith("interval"):
        return "integer"
    if k.startswith(("numeric", "decimal", "money")):
        return "minor" if scale_of(k) is not None else "text"
    if k.startswith(FLOATS):
        return "float"
    if k.startswith("bool"):
        return "bool"
    if k.startswith(("timestamp", "date")):
        return "time"
    return "json" if k.startswith("json") else "text"


def convert(text: Column, kind: str) -> Column:
    """A VARIANT: the value by the SQL type, or the text where it doesn't parse; SQL null stays a null."""
    how = family(kind)
    as_variant = lambda c: F.variant_get(F.to_variant_object(F.struct(c.alias("v"))), "$.v", "variant")
    plain = as_variant(text)
    if how == "text":
        return plain
    if how in ("json", "array"):
        return F.coalesce(F.try_parse_json(text if how == "json" else array_json(text)), plain)
    own = {"integer": integer, "float": floating, "bool": boolean, "time": epoch_ms, "minor": lambda c: minor_units(c, scale_of(kind.lower()))}[how](text)
    return F.when(own.isNotNull(), as_variant(own)).otherwise(plain)
