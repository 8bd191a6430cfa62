"""The filter language: a parsed tree, then one Column.

A compiled filter is for WHERE: it is true where the document matches, false or null elsewhere. Negations are of
`coalesce(..., false)`, so the logic has two values, while positive conjuncts stay plain enough to reach the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from docloom.errors import BadFilter
from docloom.functions.values import Element, Root, Value, segments

TYPES = ("string", "number", "bool", "null", "array", "object", "binary")
COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")
MOST_PATTERN = 256
MOST_DEPTH = 64


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any_:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Atom:
    path: str
    op: str
    value: Any


def parse(filt: Any, depth: int = 0):
    """The tree of a filter, or BadFilter."""
    if depth > MOST_DEPTH:
        raise BadFilter("filter is nested too deeply")
    if filt is None:
        return All(())
    if not isinstance(filt, dict):
        raise BadFilter("a filter is an object")
    parts = []
    for key, value in filt.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list):
                raise BadFilter(f"{key} takes an array")
            own = tuple(parse(x, depth + 1) for x in value)
            parts.append(All(own) if key == "$and" else Any_(own))
        elif key == "$not":
            parts.append(Not(parse(value, depth + 1)))
        elif key.startswith("$"):
            raise BadFilter(f"unknown operator {key}")
        else:
            parts.extend(_field(key, value, depth))
    return parts[0] if len(parts) == 1 else All(tuple(parts))


def _field(path: str, value: Any, depth: int) -> list:
    try:
        segments(path)
    except Exception as e:
        raise BadFilter(str(e)) from e
    if not isinstance(value, dict) or not any(k.startswith("$") for k in value):
        return [Atom(path, "$eq", value)]
    if not all(k.startswith("$") for k in value):
        raise BadFilter("operators and plain keys are mixed")
    out = []
    for op, x in value.items():
        if op in COMPARISONS:
            out.append(Atom(path, op, x))
        elif op in ("$in", "$nin", "$all"):
            if not isinstance(x, list):
                raise BadFilter(f"{op} takes an array")
            out.append(Atom(path, op, x))
        elif op == "$exists":
            if not isinstance(x, bool):
                raise BadFilter("$exists takes a bool")
            out.append(Atom(path, op, x))
        elif op == "$type":
            if x not in TYPES:
                raise BadFilter(f"unknown type {x!r}")
            out.append(Atom(path, op, x))
        elif op == "$elemMatch":
            if not isinstance(x, dict) or (x and all(k.startswith("$") and k not in ("$and", "$or", "$not") for k in x)):
                raise BadFilter("$elemMatch takes a filter over fields")
            out.append(Atom(path, op, parse(x, depth + 1)))
        elif op == "$regex":
            out.append(Atom(path, op, regex(x, value.get("$options", ""))))
        elif op == "$options":
            if "$regex" not in value:
                raise BadFilter("$options needs $regex")
        else:
            raise BadFilter(f"unknown operator {op}")
    return out


NESTED = re.compile(r"[*+}]\)+[*+{]|\([^()]*[*+][^()]*\)[*+{]")


def regex(pattern: Any, options: Any) -> str:
    """The pattern in Java's dialect: Unicode classes, `$` at the very end only, `.` all but a line feed."""
    if not isinstance(pattern, str) or not 1 <= len(pattern.encode()) <= MOST_PATTERN:
        raise BadFilter(f"a pattern has 1 to {MOST_PATTERN} bytes")
    if options not in ("", "i"):
        raise BadFilter(f"unknown options {options!r}")
    if NESTED.search(pattern):
        raise BadFilter("nested quantifiers")
    if re.search(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<", pattern):
        raise BadFilter("look-around and back-references are not supported")
    out, i, in_class = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class += (c == "[") - (c == "]" and in_class > 0)
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    body = ("(?iuUd)" if options else "(?Ud)") + "".join(out)
    spark = SparkSession.getActiveSession()
    try:  # Java's matcher runs the pattern, so it judges it; Python's does where there is no session
        spark._jvm.java.util.regex.Pattern.compile(body) if spark else re.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException, re.error) as e:
        raise BadFilter(f"bad pattern {pattern!r}") from e
    return body


def compile_filter(filt: Any, root: Root | Element) -> Column:
    """The Column of a filter, parsed or not."""
    return _compile(filt if isinstance(filt, (All, Any_, Not, Atom)) else parse(filt), root)


def matches(filt: Any, root: Root | Element) -> Column:
    """As compile_filter, but never null."""
    return F.coalesce(compile_filter(filt, root), F.lit(False))


def _compile(node: Any, root: Root | Element) -> Column:
    if isinstance(node, All):
        return reduce(and_, [_compile(x, root) for x in node.parts], F.lit(True)) if len(node.parts) != 1 else _compile(node.parts[0], root)
    if isinstance(node, Any_):
        return reduce(or_, [F.coalesce(_compile(x, root), F.lit(False)) if len(node.parts) == 1 else _compile(x, root) for x in node.parts]) if node.parts else F.lit(False)
    if isinstance(node, Not):
        return ~F.coalesce(_compile(node.part, root), F.lit(False))
    return _atom(root.get(node.path), node)


def _atom(value: Value, atom: Atom) -> Column:
    op, x = atom.op, atom.value
    no = lambda p: ~F.coalesce(p, F.lit(False))
    if op == "$eq":
        return value.equals(x)
    if op == "$ne":
        return no(value.equals(x))
    if op in COMPARISONS:
        return value.compare(op, x)
    if op == "$in":
        return value.is_in(x)
    if op == "$nin":
        return no(value.is_in(x))
    if op == "$exists":
        return value.present() if x else ~value.present()
    if op == "$type":
        return value.is_type(x)
    if op == "$all":
        return value.has_all(x)
    if op == "$regex":
        return value.matches(x)
    return value.any_item(lambda item: _compile(x, Element(item)))


def equalities(node: Any) -> dict[str, Any]:
    """Top-level equalities of a filter, as an upsert's new document starts with; BadFilter if it has anything else."""
    parts = node.parts if isinstance(node, All) else (node,)
    out: dict[str, Any] = {}
    for p in parts:
        if isinstance(p, All):
            out |= equalities(p)
        elif isinstance(p, Atom) and p.op == "$eq":
            out[p.path] = p.value
        else:
            raise BadFilter("an upsert's filter has equalities only")
    return out
