"""Nesting of related tables: children into parents, snapshots of shared rows, join tables into id lists, uniqueness.

Children are grouped by their key before the join, so the join moves each parent once; shared tables are broadcast only
where Spark's own size estimate allows it (no hint), since they may grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.errors import LimitExceeded
from docloom.functions.values import Root, name


def _keys(columns: list[str]) -> list[Column]:
    return [name(c) for c in columns]


def _joined(parent: DataFrame, child: DataFrame, pk: list[str]) -> DataFrame:
    """Left join on parent.pk = child.__k0.. ; null keys never match."""
    on = [parent[f"`{p}`"] == child[f"__k{i}"] for i, p in enumerate(pk)]
    return parent.join(child, on, "left").drop(*[f"__k{i}" for i in range(len(pk))])


def _bounded(child: DataFrame, fk: list[str], most: int | None) -> None:
    if most is not None and not child.dropna(subset=fk).groupBy(*map(name, fk)).count().filter(F.col("count") > most).isEmpty():
        raise LimitExceeded(f"a parent has more than {most} children")


def _in_order(items: Column) -> Column:
    """By `at` alone, since items may have fields (VARIANT) without an order."""
    return F.array_sort(items, lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0))


def nest_many(parent: DataFrame, child: DataFrame, pk: list[str], fk: list[str], into: str, position: list[str], fields: list[str] | None = None, most: int | None = None) -> DataFrame:
    """1:N: the children as an array in the order of `position`; empty if there is none or the key is null.

    `most`: a parent with more children is an error, found by a count before any list is made.
    """
    _bounded(child, fk, most)
    own = fields or [c for c in child.columns if c not in fk]
    item = F.struct(F.struct(*map(name, position)).alias("at"), F.struct(*map(name, own)).alias("item"))
    lists = child.dropna(subset=fk).groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(_keys(fk))]).agg(F.transform(_in_order(F.collect_list(item)), lambda x: x["item"]).alias(into))
    kind = lists.schema[into].dataType
    return _joined(parent, lists, pk).withColumn(into, F.coalesce(name(into), F.array().cast(kind)))


def nest_one(parent: DataFrame, child: DataFrame, pk: list[str], fk: list[str], into: str, position: list[str], fields: list[str] | None = None) -> DataFrame:
    """1:1: the first matching child as an object, else null."""
    own = fields or [c for c in child.columns if c not in fk]
    first = F.min_by(F.struct(*map(name, own)), F.struct(*map(name, position))).alias(into)
    return _joined(parent, child.dropna(subset=fk).groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(_keys(fk))]).agg(first), pk)


def snapshot_lookup(rows: DataFrame, shared: DataFrame, fk: list[str], pk: list[str], into: str, position: list[str], fields: list[str] | None = None) -> DataFrame:
    """The first matching shared row as an object; null on a miss."""
    return nest_one(rows, shared, fk, pk, into, position, fields or shared.columns)


def dissolve(host: DataFrame, links: DataFrame, pk: list[str], host_fk: list[str], other_fk: list[str], into: str, position: list[str], most: int | None = None) -> DataFrame:
    """M:N: the ids of the other side, in the order of `position`; composite ids are joined with `:`. `most` as in nest_many."""
    _bounded(links, host_fk, most)
    other = F.concat_ws(":", *[k.cast("string") for k in _keys(other_fk)])
    item = F.struct(F.struct(*map(name, position)).alias("at"), other.alias("id"))
    lists = links.dropna(subset=[*host_fk, *other_fk]).groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(_keys(host_fk))]).agg(F.transform(_in_order(F.collect_list(item)), lambda x: x["id"]).alias(into))
    return _joined(host, lists, pk).withColumn(into, F.coalesce(name(into), F.array().cast("array<string>")))


def unique_violations(df: DataFrame, paths: list[str], root: Root | None = None) -> DataFrame:
    """The keys that more than one document has, and how many; null, missing, arrays and objects are one key."""
    root = root or Root(df.schema)
    keys = [root.get(p).key().alias(f"k{i}") for i, p in enumerate(paths)]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
