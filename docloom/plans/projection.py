"""Projections: include paths, or exclude paths, never both; `_id` stays unless it is excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.errors import BadQuery
from docloom.functions.values import Root, name, segments

MOST_PATHS = 256


def parse(projection) -> tuple[str, list[str]] | None:
    """("include" or "exclude", paths); None for the whole document."""
    if not projection:
        return None
    if isinstance(projection, (list, tuple)):
        projection = dict.fromkeys(projection, 1)
    kinds = {bool(v) for k, v in projection.items() if k != "_id"}
    if len(kinds) > 1:
        raise BadQuery("a projection includes or excludes paths, not both")
    if len(projection) > MOST_PATHS:
        raise BadQuery("too many projected paths")
    for path in projection:
        segments(path)
    include = kinds == {True} or (not kinds and bool(projection["_id"]))
    if include:
        if projection.get("_id", 1) in (0, False):
            raise BadQuery("a projection that includes paths always has _id")
        return "include", [p for p in projection if p != "_id"]
    return "exclude", list(projection)


def _tree(paths: list[str]) -> dict:
    root: dict = {}
    for path in paths:
        node = root
        *heads, last = segments(path)
        for s in heads:
            node = node.setdefault(s, {})
            if node is True:
                break
        else:
            node[last] = True
    return root


def _rebuilt(column: Column, kind: T.DataType, tree: dict) -> Column | None:
    """The struct with only the tree's fields; null stays null."""
    if not isinstance(kind, T.StructType):
        return None
    fields = []
    for k in kind.names:
        if k in tree:
            own = column.getField(k) if tree[k] is True else _rebuilt(column.getField(k), kind[k].dataType, tree[k])
            if own is not None:
                fields.append(own.alias(k))
    return F.when(column.isNotNull(), F.struct(*fields)) if fields else None


def _variant_include(body: Column, tree: dict) -> Column:
    """The object with only the tree's fields, those that are there."""
    fields = F.try_variant_get(body, "$", "map<string,variant>")
    kept = []
    for k, sub in tree.items():
        own = F.try_element_at(fields, F.lit(k))
        if sub is not True:
            own = F.when(F.schema_of_variant(own).startswith("OBJECT<"), _variant_include(own, sub))
        kept.append(F.struct(F.lit(k).alias("key"), own.alias("value")))
    present = F.filter(F.array(*kept), lambda e: e["value"].isNotNull())
    return F.to_variant_object(F.map_from_entries(present))


def _variant_exclude(body: Column, tree: dict) -> Column:
    fields = F.try_variant_get(body, "$", "map<string,variant>")
    whole = [k for k, sub in tree.items() if sub is True]
    out = F.map_filter(fields, lambda k, _: ~k.isin(whole)) if whole else fields
    for k, sub in tree.items():
        if sub is not True:
            own = F.try_element_at(fields, F.lit(k))
            out = F.transform_values(out, _replacing(k, F.when(F.schema_of_variant(own).startswith("OBJECT<"), _variant_exclude(own, sub)).otherwise(own)))
    return F.to_variant_object(out)


def _replacing(key: str, value: Column):
    return lambda k, v: F.when(k == key, value).otherwise(v)


def project(df: DataFrame, projection, root: Root) -> DataFrame:
    own = parse(projection)
    if own is None:
        return df
    kind, paths = own
    system = [c for c in (root.id_column, "_rev") if c in df.columns]
    if root.body:
        tree = _tree(paths if kind == "exclude" else ["_id", *paths])
        body = name(root.body)
        new = _variant_include(body, tree) if kind == "include" else _variant_exclude(body, tree)
        keep = [c for c in system if not (kind == "exclude" and "_id" in paths and c == root.id_column)]
        return df.select(*map(name, keep), new.alias(root.body))
    if kind == "include":
        tree = _tree(paths)
        out = [name(c) for c in system if c not in tree]
        for field in df.schema:
            if field.name in tree:
                c = name(field.name) if tree[field.name] is True else _rebuilt(name(field.name), field.dataType, tree[field.name])
                if c is not None:
                    out.append(c.alias(field.name))
        return df.select(*out)
    for path in paths:
        first, *rest = segments(path)
        first = root.id_column if path == "_id" else first
        if first not in df.columns:
            continue
        if not rest:
            df = df.drop(first)
        elif isinstance(df.schema[first].dataType, T.StructType) and _has(df.schema[first].dataType, rest):
            df = df.withColumn(first, name(first).dropFields(".".join(f"`{s}`" for s in rest)))
    return df


def _has(kind: T.DataType, path: list[str]) -> bool:
    for s in path:
        if not isinstance(kind, T.StructType) or s not in kind.names:
            return False
        kind = kind[s].dataType
    return True
