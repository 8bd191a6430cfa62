"""Fields as values with one defined order across types, over typed columns or VARIANT bodies.

The order is null < bool < number < string; arrays and objects sort as null. A Value makes the Columns that filters,
sorts, groups and updates are built from. Typed columns fold their type at plan time, so plain comparisons reach the
scan; VARIANT fields branch on their type at run time. In typed tables null and missing are the same.

Predicates may be null where they are not true. They are meant for WHERE; a negation must coalesce them to false first.
"""

from __future__ import annotations

import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import BadQuery

NULL, BOOL, NUMBER, STRING = range(4)
EXACT = 1 << 53
KEY = "struct<rank:tinyint,num:double,str:string>"


def name(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def segments(path: str) -> list[str]:
    parts = path.split(".")
    if not path or not all(parts):
        raise BadQuery(f"empty path segment in {path!r}")
    return parts


def rank_of(literal) -> int | None:
    """The literal's place in the order of types; None for arrays and objects."""
    if literal is None:
        return NULL
    if isinstance(literal, bool):
        return BOOL
    if isinstance(literal, (int, float)):
        return NUMBER
    if isinstance(literal, str):
        return STRING
    if isinstance(literal, (datetime.datetime, datetime.date)):
        return NUMBER
    return None


def millis(literal) -> int | float:
    if isinstance(literal, datetime.datetime):
        return int(literal.replace(tzinfo=literal.tzinfo or datetime.timezone.utc).timestamp() * 1000)
    if isinstance(literal, datetime.date):
        return millis(datetime.datetime(literal.year, literal.month, literal.day))
    return literal


def key_struct(rank, num, text) -> Column:
    return F.struct(rank.cast("tinyint").alias("rank"), num.cast("double").alias("num"), text.cast("string").alias("str"))


def literal_key(literal) -> Column:
    rank = rank_of(literal)
    return key_struct(F.lit(rank or 0), F.lit(float(millis(literal)) if rank in (BOOL, NUMBER) else None), F.lit(literal if rank == STRING else None))


COMPARE = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def let(value: Column, body) -> Column:
    """`body(value)` with `value` written and evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def checked(ok: Column, message: str, value: Column) -> Column:
    """`value` where `ok` is true; elsewhere an error, which no optimiser rule folds away."""
    return F.when(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit(message)).isNull(), value)


def _equals(literal):
    return lambda value: value.equals(literal)


class Value:
    """One field of a document."""

    def get(self, path: list[str]) -> Value:
        raise NotImplementedError

    def is_in(self, literals: list) -> Column:
        return reduce(lambda a, b: a | b, [F.coalesce(self.equals(x), F.lit(False)) for x in literals], F.lit(False))

    def has_all(self, literals: list) -> Column:
        found = [self.any_item(_equals(v)) for v in literals]
        return reduce(and_, found, self.is_type("array"))


class Missing(Value):
    """A field that no row has."""

    def get(self, path):
        return self

    def column(self):
        return F.lit(None).cast("string")

    present = lambda self: F.lit(False)
    is_type = lambda self, kind: F.lit(False)
    equals = lambda self, literal: F.lit(literal is None)
    compare = lambda self, op, literal: F.lit(False)
    matches = lambda self, pattern: F.lit(False)
    any_item = lambda self, predicate: F.lit(False)
    key = lambda self: literal_key(None)
    sort_column = lambda self: F.lit(0)
    scalar = lambda self: F.lit(True)

    def number(self):
        return F.lit(None).cast("double")

    integral = True


class Typed(Value):
    """A column (or nested field) of a known Spark type."""

    def __init__(self, column: Column, kind: T.DataType):
        self.c, self.kind = column, kind
        if isinstance(kind, T.BooleanType):
            self.rank = BOOL
        elif isinstance(kind, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)):
            self.rank = NUMBER
        elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
            self.rank = STRING
        else:
            self.rank = None

    @property
    def timed(self) -> bool:
        return isinstance(self.kind, (T.TimestampType, T.TimestampNTZType, T.DateType))

    @property
    def integral(self) -> bool:
        return isinstance(self.kind, T.IntegralType) or self.timed

    def column(self) -> Column:
        return self.c

    def get(self, path):
        v: Value = self
        for i, segment in enumerate(path):
            if isinstance(v, Typed) and isinstance(v.kind, T.StructType) and segment in v.kind.names:
                v = Typed(v.c.getField(segment), v.kind[segment].dataType)
            elif isinstance(v, Typed) and isinstance(v.kind, T.MapType):
                v = Typed(F.try_element_at(v.c, F.lit(segment)), v.kind.valueType)
            elif isinstance(v, Typed) and isinstance(v.kind, T.VariantType):
                return Dynamic(v.c).get(path[i:])
            else:
                return Missing()
        return Dynamic(v.c) if isinstance(v, Typed) and isinstance(v.kind, T.VariantType) else v

    def present(self):
        return self.c.isNotNull()

    def scalar(self):
        return F.lit(True) if self.rank is not None else self.c.isNull()

    def is_type(self, kind):
        own = {BOOL: "bool", NUMBER: "number", STRING: "string"}.get(self.rank) or ("array" if isinstance(self.kind, T.ArrayType) else "object")
        return self.present() if own == kind else F.lit(False)

    def number(self):
        if self.rank != NUMBER:
            return F.lit(None).cast("double")
        return F.unix_millis(self.c.cast("timestamp")) if self.timed else self.c

    def _against(self, literal):
        """The two sides of a comparison of equal rank, the column bare where the numbers allow it."""
        if self.rank != NUMBER:
            return self.c, F.lit(literal)
        if self.timed and isinstance(literal, (datetime.datetime, datetime.date)):
            return self.c, F.lit(literal)
        number, x = self.number(), millis(literal)
        if isinstance(x, int) and abs(x) < EXACT or isinstance(x, float) and not self.integral:
            return number, F.lit(x)
        return number.cast("double"), F.lit(float(x))

    def equals(self, literal):
        if literal is None:
            return self.c.isNull()
        rank = rank_of(literal)
        if rank is not None:
            if rank != self.rank:
                return F.lit(False)
            a, b = self._against(literal)
            return a == b
        if isinstance(literal, list) and isinstance(self.kind, T.ArrayType):
            items = [F.coalesce(Typed(F.get(self.c, F.lit(i)), self.kind.elementType).equals(x), F.lit(False)) for i, x in enumerate(literal)]
            return reduce(and_, items, F.size(self.c) == len(literal))
        if isinstance(literal, dict) and isinstance(self.kind, T.StructType):
            if not set(literal) <= set(self.kind.names):
                return F.lit(False)
            same = [F.coalesce(self.get([k]).equals(x), F.lit(False)) for k, x in literal.items()]
            return reduce(and_, same + [self.c.getField(k).isNull() for k in self.kind.names if k not in literal], self.present())
        if isinstance(literal, dict) and isinstance(self.kind, T.MapType):
            same = [F.coalesce(self.get([k]).equals(x), F.lit(False)) for k, x in literal.items()]
            return reduce(and_, same, F.size(self.c) == len(literal))
        return F.lit(False)

    def is_in(self, literals):
        """One IN list for the plain values of the column's own type, so that it reaches the scan."""
        plain = [x for x in literals if rank_of(x) == self.rank and self.rank is not None and (self.rank != NUMBER or (isinstance(x, int) and abs(x) < EXACT) or (isinstance(x, float) and not self.integral))]
        rest = [x for x in literals if not any(x is y for y in plain)]
        found = ([self.number().isin(plain) if self.rank == NUMBER else self.c.isin(plain)] if plain else []) + [self.equals(x) for x in rest]
        return reduce(lambda a, b: a | b, found, F.lit(False)) if len(found) != 1 else found[0]

    def compare(self, op, literal):
        rank = rank_of(literal)
        if rank is None or self.rank is None:
            return F.lit(False)
        if rank != self.rank:
            return self.present() if COMPARE[op](self.rank, rank) else F.lit(False)
        a, b = self._against(literal)
        return COMPARE[op](a, b)

    def matches(self, pattern):
        return self.c.rlike(pattern) if self.rank == STRING else F.lit(False)

    def any_item(self, predicate):
        if not isinstance(self.kind, T.ArrayType):
            return F.lit(False)
        element = self.kind.elementType
        make = (lambda x: Dynamic(x)) if isinstance(element, T.VariantType) else (lambda x: Typed(x, element))
        return F.exists(self.c, lambda x: F.coalesce(predicate(make(x)), F.lit(False)))

    def key(self):
        if self.rank is None:
            return literal_key(None)
        number = self.number().cast("double") if self.rank == NUMBER else self.c.cast("double") if self.rank == BOOL else F.lit(None)
        return key_struct(F.when(self.c.isNull(), 0).otherwise(self.rank), number, self.c if self.rank == STRING else F.lit(None))

    def sort_column(self):
        """As key(), but the column itself: within one type the order is the same."""
        return self.c if self.rank is not None else F.lit(0)


class Dynamic(Value):
    """A VARIANT value: SQL null is missing, a variant null is an explicit null. `kind`: a column that has its type, if there is one."""

    integral = False

    def __init__(self, column: Column, kind: Column | None = None):
        self.c, self.kind = column, kind

    def column(self):
        return self.c

    def get(self, path):
        keys = "".join("['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']" for s in path)
        return Dynamic(F.try_variant_get(self.c, "$" + keys, "variant"))

    def _schema(self):
        return F.schema_of_variant(self.c) if self.kind is None else self.kind

    def present(self):
        return self.c.isNotNull()

    def is_type(self, kind):
        s = self._schema()
        if kind == "number":
            return s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL")
        start = {"null": "VOID", "bool": "BOOLEAN", "string": "STRING", "array": "ARRAY<", "object": "OBJECT<"}.get(kind)
        return s.startswith(start) if start else F.lit(False)

    def rank(self):
        s = self._schema()
        return F.when(s == "VOID", NULL).when(s == "BOOLEAN", BOOL).when(self.is_type("number"), NUMBER).when(s == "STRING", STRING)

    def scalar(self):
        return self.c.isNull() | self._schema().rlike("^(VOID$|BOOLEAN$|STRING$|BIGINT|DECIMAL|DOUBLE|FLOAT)")

    def number(self):
        return F.when(self.is_type("number"), F.try_variant_get(self.c, "$", "double"))

    def whole(self):
        """The number as a long where it is one."""
        return F.when(self._schema() == "BIGINT", F.try_variant_get(self.c, "$", "bigint"))

    def text(self):
        return F.when(self._schema() == "STRING", F.try_variant_get(self.c, "$", "string"))

    def flag(self):
        return F.when(self._schema() == "BOOLEAN", F.try_variant_get(self.c, "$", "boolean"))

    def _own(self, rank):
        return {BOOL: lambda: self.flag(), NUMBER: lambda: self.number(), STRING: lambda: self.text()}[rank]()

    def equals(self, literal):
        if literal is None:
            return self.c.isNull() | (self._schema() == "VOID")
        rank = rank_of(literal)
        if rank == STRING:  # the type is only asked of equal texts
            return (F.try_variant_get(self.c, "$", "string") == F.lit(literal)) & (self._schema() == "STRING")
        if rank is not None:
            return self._own(rank) == F.lit(float(millis(literal)) if rank == NUMBER else literal)
        false = F.lit(False)
        if isinstance(literal, list):
            items = F.when(self.is_type("array"), F.try_variant_get(self.c, "$", "array<variant>"))
            each = [F.coalesce(Dynamic(F.get(items, F.lit(i))).equals(x) & F.get(items, F.lit(i)).isNotNull(), false) for i, x in enumerate(literal)]
            return reduce(and_, each, F.size(items) == len(literal))
        fields = F.when(self.is_type("object"), F.try_variant_get(self.c, "$", "map<string,variant>"))
        each = [F.coalesce(Dynamic(F.try_element_at(fields, F.lit(k))).equals(x) & F.array_contains(F.map_keys(fields), k), false) for k, x in literal.items()]
        return reduce(and_, each, F.size(fields) == len(literal))

    def compare(self, op, literal):
        rank = rank_of(literal)
        if rank is None:
            return F.lit(False)
        other = COMPARE[op](self.rank(), F.lit(rank))
        if rank == NULL:
            return other
        return F.coalesce(COMPARE[op](self._own(rank), F.lit(float(millis(literal)) if rank == NUMBER else literal)), other)

    def against(self, number: float) -> tuple[Column, Column, Column]:
        """Whether the key is below, above or at a number's."""
        own, text = self.number(), F.coalesce(self.is_type("string"), F.lit(False))
        return F.coalesce(own < number, ~text), F.coalesce(own > number, text), F.coalesce(own == number, F.lit(False))

    def matches(self, pattern):
        return self.text().rlike(pattern)

    def any_item(self, predicate):
        items = F.when(self.is_type("array"), F.try_variant_get(self.c, "$", "array<variant>"))
        return F.exists(items, lambda x: F.coalesce(predicate(Dynamic(x)), F.lit(False)))

    def key(self):
        """The type is read from the value once."""

        def of(s):
            kind = F.when(s == "STRING", STRING).when(s == "BIGINT", NUMBER).when(s == "BOOLEAN", BOOL).when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), NUMBER).otherwise(NULL)
            number = F.when(s == "BOOLEAN", F.try_variant_get(self.c, "$", "boolean").cast("double")).when(kind == NUMBER, F.try_variant_get(self.c, "$", "double"))
            return key_struct(kind, number, F.when(s == "STRING", F.try_variant_get(self.c, "$", "string")))

        kind = F.coalesce(self._schema(), F.lit("VOID"))
        return let(kind, of) if self.kind is None else of(kind)

    sort_column = key


class Root:
    """Where the fields of a table's documents are: typed columns, or a VARIANT `body`; `_id` is the key column."""

    def __init__(self, schema: T.StructType, id_column: str = "_id", body: str | None = None):
        self.schema, self.id_column, self.body = schema, id_column, body

    def get(self, path: str) -> Value:
        first, *rest = segments(path)
        if first == "_id" and not rest and self.id_column in self.schema.names:
            return Typed(name(self.id_column), self.schema[self.id_column].dataType)
        if self.body:
            return Dynamic(name(self.body)).get([first, *rest])
        if first not in self.schema.names:
            return Missing()
        own = Typed(name(first), self.schema[first].dataType)
        return own.get(rest) if rest or isinstance(own.kind, T.VariantType) else own


class Element:
    """The fields of an array's element."""

    def __init__(self, value: Value):
        self.value = value

    def get(self, path: str) -> Value:
        return self.value.get(segments(path))
