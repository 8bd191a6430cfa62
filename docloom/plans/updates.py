"""Update documents: $set, $unset, $inc, $push, $setOnInsert, and $set of one array element, as one projection.

Operators apply in alphabetical order, $setOnInsert (on an insert only) first. An update is one pass over the table:
matching rows get the new value, others keep theirs. Nothing is joined or collected, but for update_one's single id.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import BadUpdate
from docloom.functions.values import Dynamic, Element, Typed, checked, let

OPERATORS = ("$inc", "$push", "$set", "$setOnInsert", "$unset")
MOST_SEGMENTS, MOST_DEPTH = 64, 256
ELEMENT = re.compile(r"^\$\[([^=\]]+)=(.*)\]$")


@dataclass(frozen=True)
class Op:
    op: str
    path: tuple[str, ...]
    value: object = None


def depth(value) -> int:
    if isinstance(value, dict):
        return 1 + max(map(depth, value.values()), default=0)
    return 1 + max(map(depth, value), default=0) if isinstance(value, list) else 0


def split_path(path: str) -> tuple[str, ...]:
    """Segments; `$[field=value]` is one, dots in it and all."""
    parts, own = [], ""
    for piece in path.split("."):
        own = f"{own}.{piece}" if own else piece
        if not own.startswith("$[") or own.endswith("]"):
            parts.append(own)
            own = ""
    if own:
        parts.append(own)
    if not all(parts) or len(parts) > MOST_SEGMENTS:
        raise BadUpdate(f"bad path {path!r}")
    return tuple(parts)


def parse(update) -> list[Op]:
    if not isinstance(update, dict) or not update:
        raise BadUpdate("an update has operators")
    out = []
    for op in sorted(update):
        fields = update[op]
        if op not in OPERATORS:
            raise BadUpdate(f"unknown operator {op}" if op.startswith("$") else "a plain document is no update")
        if not isinstance(fields, dict) or not fields:
            raise BadUpdate(f"{op} takes an object of fields")
        for path, value in fields.items():
            parts = split_path(path)
            if parts[0] == "_id":
                raise BadUpdate("_id does not change")
            elements = [p for p in parts if p.startswith("$")]
            if any(not ELEMENT.match(p) for p in elements):
                raise BadUpdate(f"unsupported positional path {path!r}")
            if elements and (op != "$set" or len(elements) > 1 or parts[0] == elements[0]):
                raise BadUpdate("one element, of an array, with $set only")
            if op == "$inc" and (isinstance(value, bool) or not isinstance(value, (int, float))):
                raise BadUpdate("$inc takes a number")
            if len(parts) + depth(value) > MOST_DEPTH:
                raise BadUpdate("document too deep")
            out.append(Op(op, parts, value))
    return out


def element(segment: str) -> tuple[str, object]:
    """The field and the value of `$[field=value]`: JSON, or else a bare word."""
    field, text = ELEMENT.match(segment).groups()
    try:
        return field, json.loads(text)
    except ValueError:
        return field, text


def fail(message: str, kind: str) -> Column:
    """A column of any type that raises where it is reached."""
    return checked(F.lit(False), message, F.lit(None).cast(kind))


# --- typed columns


def literal(value, kind: T.DataType | None = None) -> Column:
    """A literal as the column's type, so that a table's schema holds."""
    if isinstance(value, dict):
        if isinstance(kind, T.StructType):
            unknown = set(value) - set(kind.names)
            if unknown:
                raise BadUpdate(f"the type has no field {sorted(unknown)[0]!r}")
            return F.struct(*[literal(value.get(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.struct(*[literal(v).alias(k) for k, v in value.items()])
    if isinstance(value, list):
        own = kind.elementType if isinstance(kind, T.ArrayType) else None
        out = F.array(*[literal(v, own) for v in value])
        return out.cast(kind) if kind is not None else out
    if isinstance(kind, T.VariantType):
        return variant_literal(value)
    return F.lit(value).cast(kind) if kind is not None else F.lit(value)


def typed(column: Column | None, kind: T.DataType | None, path: tuple[str, ...], op: str, value) -> Column:
    """The new value of a column (None: it isn't there) after one operator at the path below it."""
    if isinstance(kind, T.VariantType):
        return dynamic(column, path, op, value)
    if path:
        head, rest = path[0], path[1:]
        if head.startswith("$["):
            return _typed_element(column, kind, head, rest, value)
        if kind is None:
            if op == "$unset":
                return F.lit(None)
            return F.struct(typed(None, None, rest, op, value).alias(head))
        if not isinstance(kind, T.StructType):
            return column if op == "$unset" else fail(f"{head!r} is below a value that is no object", kind.simpleString())
        known = head in kind.names
        if op == "$unset":
            if not known:
                return column
            if not rest:
                return F.when(column.isNotNull(), column.dropFields(f"`{head}`")) if len(kind.names) > 1 else column
        below = typed(column.getField(head) if known else None, kind[head].dataType if known else None, rest, op, value)
        base = F.coalesce(column, F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields]))
        return base.withField(f"`{head}`", below)
    if op in ("$set", "$setOnInsert"):
        return literal(value, kind)
    if op == "$unset":
        return F.lit(None).cast(kind) if kind is not None else F.lit(None)
    if op == "$inc":
        if kind is None or not isinstance(kind, T.NumericType):
            return F.lit(value) if kind is None else fail("$inc of a column that holds no numbers", kind.simpleString())
        if isinstance(value, int) and isinstance(kind, T.IntegralType):
            return (F.coalesce(column, F.lit(0)).cast("bigint") + value).cast(kind)
        if isinstance(kind, T.IntegralType):
            return F.coalesce(column, F.lit(0)).cast("double") + float(value)
        return (F.coalesce(column, F.lit(0)) + value).cast(kind)
    if kind is None:
        return F.array(literal(value))
    if not isinstance(kind, T.ArrayType):
        return fail("$push to a value that is no array", kind.simpleString())
    return F.array_append(F.coalesce(column, F.array().cast(kind)), literal(value, kind.elementType))


def _typed_element(column, kind, segment, rest, value) -> Column:
    if not isinstance(kind, T.ArrayType):
        return fail("an element of a value that is no array", kind.simpleString())
    field, x = element(segment)
    own = lambda e: F.coalesce(Element(Typed(e, kind.elementType)).get(field).equals(x), F.lit(False))
    new = lambda e: typed(e, kind.elementType, rest, "$set", value)
    changed = F.transform(column, lambda e: F.when(own(e), new(e)).otherwise(e))
    hits = F.size(F.filter(column, own))
    return checked(hits == 1, "not exactly one element matches", changed)


# --- VARIANT bodies


def variant_literal(value) -> Column:
    return F.parse_json(F.lit(json.dumps(value)))


def as_variant(column: Column) -> Column:
    return F.variant_get(F.to_variant_object(F.struct(column.alias("v"))), "$.v", "variant")


def _with_key(fields: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(fields, lambda k, _: k != key), F.create_map(F.lit(key), value))


EMPTY = "map<string,variant>"


def dynamic(column: Column, path: tuple[str, ...], op: str, value) -> Column:
    """The new VARIANT after one operator at the path below it; a missing column counts as missing."""
    return let(column, lambda c: _dynamic(c, path, op, value))


def _fields(column: Column) -> Column:
    """Null for what is no object."""
    return F.try_variant_get(column, "$", EMPTY)


def _with_fields(column: Column, new: dict[str, tuple[tuple[str, ...], str, object]]) -> Column:
    """The object with the fields that operators (not $unset) make of its own: taken apart and put together once."""

    def made(fields: Column) -> Column:
        have = F.coalesce(fields, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
        pairs = [x for head, (rest, op, value) in new.items() for x in (F.lit(head), dynamic(F.try_element_at(fields, F.lit(head)), rest, op, value))]
        out = F.to_variant_object(F.map_concat(F.map_filter(have, lambda k, _: ~k.isin(list(new))), F.create_map(*pairs)))
        return checked(column.isNull() | fields.isNotNull(), f"{next(iter(new))!r} is below a value that is no object", out)

    return let(_fields(column), made)


def _dynamic(column: Column, path: tuple[str, ...], op: str, value) -> Column:
    own = Dynamic(column)
    if path:
        head, rest = path[0], path[1:]
        if head.startswith("$["):
            return _dynamic_element(column, head, rest, value)
        fields = _fields(column)
        below = F.try_element_at(fields, F.lit(head))
        if op == "$unset":
            if not rest:
                return F.when(fields.isNotNull(), F.to_variant_object(F.map_filter(fields, lambda k, _: k != head))).otherwise(column)
            return F.when(below.isNotNull(), F.to_variant_object(_with_key(fields, head, dynamic(below, rest, op, value)))).otherwise(column)
        return _with_fields(column, {head: (rest, op, value)})
    if op in ("$set", "$setOnInsert"):
        return variant_literal(value)
    if op == "$inc":
        whole = own.whole()
        total = F.coalesce(own.number(), F.lit(0.0)) + float(value)
        integral = (total == F.floor(total)) & (F.abs(total) < float(1 << 53))
        exact = F.coalesce(whole, F.lit(0).cast("bigint")) + int(value) if isinstance(value, int) else F.lit(None).cast("bigint")
        made = F.when(integral, as_variant(F.coalesce(F.when(whole.isNotNull() & (F.abs(whole) < (1 << 53)), exact), total.try_cast("bigint")))).otherwise(as_variant(total))
        if not isinstance(value, int) or abs(value) >= 1 << 53:
            return made
        # the same for whole numbers that doubles hold, with the type read once
        small = lambda n: (n > -(1 << 53)) & (n < (1 << 53))
        return let(whole, lambda n: F.when(small(n) & small(n + value), as_variant(n + value)).otherwise(made))
    items = F.when(own.is_type("array"), F.try_variant_get(column, "$", "array<variant>"))
    made = F.coalesce(items, F.array().cast("array<variant>"))
    pushed = as_variant(F.concat(made, F.array(variant_literal(value))))
    return checked(column.isNull() | items.isNotNull(), "$push to a value that is no array", pushed)


def _dynamic_element(column: Column, segment: str, rest: tuple[str, ...], value) -> Column:
    field, x = element(segment)
    items = F.when(Dynamic(column).is_type("array"), F.try_variant_get(column, "$", "array<variant>"))
    own = lambda e: F.coalesce(Element(Dynamic(e)).get(field).equals(x) & Element(Dynamic(e)).get(field).present(), F.lit(False))
    changed = F.transform(items, lambda e: F.when(own(e), dynamic(e, rest, "$set", value)).otherwise(e))
    hits = F.size(F.filter(items, own))
    return checked(hits == 1, "not exactly one element matches", as_variant(changed))


def apply_typed(columns: dict[str, tuple[Column, T.DataType]], ops: list[Op], inserting: bool = False) -> dict[str, Column]:
    """The columns that change, after all operators; types of new fields follow the literals."""
    out: dict[str, Column] = {}
    for op in sorted(ops, key=lambda o: o.op != "$setOnInsert"):
        if op.op == "$setOnInsert" and not inserting:
            continue
        first, rest = op.path[0], op.path[1:]
        column, kind = columns.get(first, (None, None))
        if column is None and op.op == "$unset":
            continue
        if first in out and kind is not None:
            column = out[first]
        out[first] = typed(column, kind, rest, op.op, op.value)
    return out


def apply_dynamic(body: Column, ops: list[Op], inserting: bool = False) -> Column:
    run: dict = {}  # operators on different fields, which are applied together

    def applied(body: Column) -> Column:
        own = dict(run)
        run.clear()
        return let(body, lambda c: _with_fields(c, own)) if own else body

    for op in sorted(ops, key=lambda o: o.op != "$setOnInsert"):
        if op.op == "$setOnInsert" and not inserting:
            continue
        if op.op == "$unset":
            body = dynamic(applied(body), op.path, op.op, op.value)
            continue
        if op.path[0] in run:
            body = applied(body)
        run[op.path[0]] = (op.path[1:], op.op, op.value)
    return applied(body)

