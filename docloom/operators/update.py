"""update, upsert, replace and delete as tables to tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.errors import BadUpdate
from docloom.functions.values import Root, name
from docloom.plans import filters, updates


@dataclass
class Result:
    """The table after the write, and what was written: rows are counted when asked for."""

    table: DataFrame
    changed: DataFrame
    upserted_id: object = None

    def counts(self) -> dict:
        n = self.changed.count()
        own = 0 if self.upserted_id is not None else n
        return {"matched": own, "modified": own} | ({"upserted_id": self.upserted_id} if self.upserted_id is not None else {})


def _target(df: DataFrame, filt, root: Root, one: bool) -> Column:
    """Which rows are written: all matches, or the one with the lowest id."""
    hit = filters.matches(filt, root)
    if not one:
        return hit
    first = df.filter(filters.compile_filter(filt, root)).agg(F.min(name(root.id_column))).first()[0]
    return name(root.id_column) == F.lit(first) if first is not None else F.lit(False)


def _written(df: DataFrame, hit: Column, ops: list, root: Root, inserting: bool = False) -> DataFrame:
    if root.body:
        return df.withColumn(root.body, F.when(hit, updates.apply_dynamic(name(root.body), ops, inserting)).otherwise(name(root.body)))
    columns = {f.name: (name(f.name), f.dataType) for f in df.schema}
    new = {}
    for c, value in updates.apply_typed(columns, ops, inserting).items():
        if c not in columns:
            new[c] = F.when(hit, value)
            continue
        kind = columns[c][1]
        old = name(c)
        new[c] = F.when(hit, value).otherwise(old) if not _reshaped(c, ops, kind) else _aligned(df, c, value, hit)
    return df.withColumns(new)


def _reshaped(column: str, ops: list, kind) -> bool:
    return any(o.path[0] == column and len(o.path) > 1 for o in ops) and kind.typeName() == "struct"


def _aligned(df: DataFrame, column: str, value: Column, hit: Column) -> Column:
    """Old and new structs with the fields of both."""
    probe = df.select(value.alias("v"), name(column).alias("o")).schema
    new, old = probe["v"].dataType, probe["o"].dataType
    if new == old:
        return F.when(hit, value).otherwise(name(column))
    kinds = {f.name: f.dataType for f in old.fields} | {f.name: f.dataType for f in new.fields}
    part = lambda c, kind: F.when(c.isNotNull(), F.struct(*[(c.getField(k) if k in kind.names else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]))
    return F.when(hit, part(value, new)).otherwise(part(name(column), old))


def update(df: DataFrame, filt, change, one: bool = False, upsert: bool = False, new_id=None, root: Root | None = None) -> Result:
    root, ops, node = root or Root(df.schema), updates.parse(change), filters.parse(filt)
    hit = _target(df, node, root, one)
    if upsert and df.filter(filters.compile_filter(node, root)).isEmpty():
        row, key = _inserted(df, filters.equalities(node), ops, new_id, root)
        return Result(df.unionByName(row, allowMissingColumns=True), row, key)
    out = _written(df, hit, ops, root)
    return Result(out, _written(df.filter(hit), F.lit(True), ops, root))


def _inserted(df: DataFrame, start: dict, ops: list, new_id, root: Root) -> tuple[DataFrame, object]:
    spark = df.sparkSession
    key = start.pop("_id", start.pop(root.id_column, new_id))
    if key is None:
        from docloom.functions.convert import new_id as make

        key = spark.range(1).select(make().alias("k")).first()["k"]
    sets = [updates.Op("$setOnInsert", updates.split_path(p), v) for p, v in start.items()]
    one = spark.range(1).select(F.lit(key).cast(df.schema[root.id_column].dataType).alias(root.id_column))
    if root.body:
        empty = F.parse_json(F.lit("{}"))
        return one.withColumn(root.body, updates.apply_dynamic(updates.apply_dynamic(empty, sets, True), ops, True)), key
    others = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name != root.id_column}
    row = one.select(name(root.id_column), *others.values())
    row = _written(row, F.lit(True), sets, root, True) if sets else row
    return _written(row, F.lit(True), ops, root, True), key


def delete(df: DataFrame, filt, one: bool = False, root: Root | None = None) -> Result:
    root = root or Root(df.schema)
    hit = _target(df, filters.parse(filt), root, one)
    return Result(df.filter(~hit), df.filter(hit))


def put(df: DataFrame, rows: DataFrame, root: Root | None = None) -> DataFrame:
    """Insert or replace by id: rows that are put, and the table's rows of other ids."""
    key = (root or Root(df.schema)).id_column
    if key not in rows.columns:
        raise BadUpdate(f"rows need {key}")
    return df.join(rows.select(name(key)), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def put_if(df: DataFrame, key, revision: int, row: DataFrame, rev: str = "_rev", id_column: str = "_id") -> Result:
    """Replace iff the revision is still the same; `changed` is empty if it isn't, or the document is gone."""
    hit = (name(id_column) == F.lit(key)) & (name(rev) == F.lit(revision))
    ok = df.filter(hit).select(name(id_column))
    new = row.join(ok, id_column, "left_semi")
    return Result(df.join(new.select(id_column), id_column, "left_anti").unionByName(new, allowMissingColumns=True), new)
