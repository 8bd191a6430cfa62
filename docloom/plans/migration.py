"""From relational tables to collections of documents: which tables stay, which fold into others, and how.

A table with exactly two foreign keys and at most one column beside them is a join table and becomes a list of ids. A
table becomes part of its owner (the parent with the fewest children a row) if nothing refers to it, its
children are few or 1:1, and it has no index of its own fields; other parents are copied into it as snapshots. All
others are collections. The decisions are made on the driver from the schema and one aggregate a foreign key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.errors import AlreadyExists
from docloom.functions import convert
from docloom.functions.values import name
from docloom.operators import aggregate, nest
from docloom.sources.pgdump import POSITION, ForeignKey, Table
from docloom.sources.store import Engine

MOST_EMBEDDED = 1000


@dataclass
class Relation:
    child: str
    key: ForeignKey
    average: float
    most: int
    one_to_one: bool


@dataclass
class Embed:
    child: str
    key: ForeignKey
    one_to_one: bool
    snapshots: list[ForeignKey]


@dataclass
class Dissolve:
    join_table: str
    host: ForeignKey
    other: ForeignKey
    field: str


@dataclass
class CollectionPlan:
    name: str
    id_columns: list[str]
    embeds: list[Embed] = field(default_factory=list)
    dissolves: list[Dissolve] = field(default_factory=list)
    indexes: list[tuple[list[tuple[str, int]], bool]] = field(default_factory=list)


@dataclass
class Plan:
    collections: dict[str, CollectionPlan] = field(default_factory=dict)  # in the order of loading
    embedded: list[str] = field(default_factory=list)
    joins: list[str] = field(default_factory=list)
    dropped_foreign_keys: int = 0
    preserved_unique: list[tuple[str, list[str]]] = field(default_factory=list)
    dropped_unique: list[tuple[str, list[str]]] = field(default_factory=list)
    not_null: list[tuple[str, str]] = field(default_factory=list)


def is_join(t: Table) -> bool:
    linked = {c for fk in t.foreign_keys for c in fk.columns}
    return len(t.foreign_keys) == 2 and len(set(t.columns) - linked) <= 1


def relations(tables: dict[str, Table]) -> list[Relation]:
    out = []
    for t in tables.values():
        for fk in t.foreign_keys:
            if fk.table in tables:
                stats = aggregate.fan_out(t.rows, fk.columns).first()
                single = any(sorted(fk.columns) == sorted(u) for u in [t.primary_key, *t.unique] if u)
                out.append(Relation(t.name, fk, stats["avg_fanout"], stats["max_fanout"], single))
    return out


def classify(tables: dict[str, Table], links: list[Relation] | None = None) -> Plan:
    links = relations(tables) if links is None else links
    owner = {n: min((r for r in links if r.child == n), key=lambda r: (r.most, r.average), default=None) for n in tables}
    referred = {r.key.table for r in links}
    plan, parent_of = Plan(), {}
    for t in tables.values():
        own = owner[t.name]
        if is_join(t):
            plan.joins.append(t.name)
            continue
        keys = [sorted(t.primary_key), *[sorted(fk.columns) for fk in t.foreign_keys]]
        queried = any(sorted(i.fields) not in keys for i in t.indexes)
        if own and t.name not in referred and (own.one_to_one or own.most <= MOST_EMBEDDED) and not queried:
            parent_of[t.name] = own.key.table
            plan.embedded.append(t.name)
    kept = [t for t in tables.values() if t.name not in plan.joins and t.name not in parent_of]
    for t in _loading_order(kept, links):
        c = plan.collections[t.name] = CollectionPlan(t.name, t.primary_key)
        for r in links:
            if r.key.table == t.name and parent_of.get(r.child) == t.name and r is owner[r.child]:
                shared = [fk for fk in tables[r.child].foreign_keys if fk is not r.key and fk.table != t.name and fk.table in tables]
                c.embeds.append(Embed(r.child, r.key, r.one_to_one, shared))
        for n in plan.joins:
            c.dissolves += _dissolve(tables[n], t.name, links)
        if owner[t.name]:
            c.indexes.append(([(f, 1) for f in owner[t.name].key.columns], False))
        c.indexes += [(list(zip(i.fields, i.directions)), False) for i in t.indexes]
        for u in t.unique:
            c.indexes.append(([(f, 1) for f in u], True))
            plan.preserved_unique.append((t.name, u))
        c.indexes = [x for i, x in enumerate(c.indexes) if x not in c.indexes[:i]]
        plan.not_null += [(t.name, f) for f in t.not_null]
    plan.dropped_unique = [(n, u) for n in [*parent_of, *plan.joins] for u in tables[n].unique]
    plan.dropped_foreign_keys = sum(len(t.foreign_keys) for t in tables.values())
    return plan


def _loading_order(kept: list[Table], links: list[Relation]) -> list[Table]:
    """Parents before children; what is left of cycles comes as it stands."""
    left, out = list(kept), []
    while left:
        names = {t.name for t in left}
        ready = [t for t in left if not any(r.child == t.name and r.key.table in names - {t.name} for r in links)] or left[:1]
        out += ready
        left = [t for t in left if t not in ready]
    return out


def _dissolve(join: Table, host: str, links: list[Relation]) -> list[Dissolve]:
    mine = next((fk for fk in join.foreign_keys if fk.table == host), None)
    other = next((fk for fk in join.foreign_keys if fk.table != host), None)
    if not mine or not other:
        return []
    most = {r.key.table: r.most for r in links if r.child == join.name}
    if most.get(host, 0) > most.get(other.table, 0):
        return []
    singular = other.table[:-1] if other.table.endswith("s") else other.table
    return [Dissolve(join.name, mine, other, f"{singular}_ids")]


def converted(t: Table, columns: list[str] | None = None) -> list[Column]:
    return [convert.convert(name(c), kind).alias(c) for c, kind in t.columns.items() if columns is None or c in columns]


def _with_present(doc: Column, more: dict[str, Column]) -> Column:
    """The object with those of the fields that aren't null; a miss leaves no field behind."""
    if not more:
        return doc
    part = lambda c: F.variant_get(F.to_variant_object(F.struct(c.alias("v"))), "$.v", "variant")
    kept = lambda k, c: F.map_filter(F.create_map(F.lit(k), part(c)), lambda _, v: c.isNotNull())
    present = [kept(k, c) for k, c in more.items()]
    return F.to_variant_object(F.map_concat(F.variant_get(doc, "$", "map<string,variant>"), *present))


def documents(tables: dict[str, Table], plan: CollectionPlan) -> DataFrame:
    """`_id` (string) and `body` (VARIANT) of one collection."""
    t = tables[plan.name]
    out = t.rows
    for e in plan.embeds:
        child = tables[e.child]
        own = child.rows
        for fk in e.snapshots:
            ref = tables[fk.table]
            shared = ref.rows.select(POSITION, *[name(c).alias(f"__p{i}") for i, c in enumerate(fk.parent_columns)], F.struct(*converted(ref)).alias("__ref"))
            own = nest.snapshot_lookup(own, shared, fk.columns, [f"__p{i}" for i in range(len(fk.parent_columns))], f"__s_{fk.table}", [POSITION], ["__ref"])
        doc = _with_present(F.to_variant_object(F.struct(*converted(child))), {fk.table: F.col(f"`__s_{fk.table}`.__ref") for fk in e.snapshots})
        own = own.select(POSITION, *[name(c).alias(f"__f{i}") for i, c in enumerate(e.key.columns)], doc.alias("__doc"))
        keys = [f"__f{i}" for i in range(len(e.key.columns))]
        if e.one_to_one:
            out = nest.nest_one(out, own, e.key.parent_columns, keys, f"__e_{e.child}", [POSITION], ["__doc"])
        else:
            out = nest.nest_many(out, own, e.key.parent_columns, keys, f"__e_{e.child}", [POSITION], ["__doc"])
    for d in plan.dissolves:
        links = tables[d.join_table].rows.select(POSITION, *[name(c).alias(f"__h{i}") for i, c in enumerate(d.host.columns)], *[name(c).alias(f"__o{i}") for i, c in enumerate(d.other.columns)])
        out = nest.dissolve(out, links, d.host.parent_columns, [f"__h{i}" for i in range(len(d.host.columns))], [f"__o{i}" for i in range(len(d.other.columns))], f"__d_{d.field}", [POSITION])
    key = F.concat_ws(":", *[name(c) for c in plan.id_columns]) if plan.id_columns else convert.stable_id([name(c) for c in t.columns])
    embedded = [(F.col(f"`__e_{e.child}`.__doc") if e.one_to_one else F.transform(name(f"__e_{e.child}"), lambda x: x["__doc"])).alias(e.child) for e in plan.embeds]
    ids = [name(f"__d_{d.field}").alias(d.field) for d in plan.dissolves]
    out = out.withColumn("__id", key)
    return out.select(F.col("__id").alias("_id"), F.to_variant_object(F.struct(F.col("__id").alias("_id"), *converted(t), *embedded, *ids)).alias("body"))


def load(engine: Engine, tables: dict[str, Table], plan: Plan | None = None) -> dict[str, int]:
    """Writes every collection of the plan, after a check that the targets are empty; rows loaded by collection."""
    plan = plan or classify(tables)
    for n in plan.collections:
        if n in engine.catalog["collections"] and engine.collection(n).count_documents():
            raise AlreadyExists(n)
    out = {}
    for n, c in plan.collections.items():
        own = engine.collection(n)
        for fields, unique in c.indexes:
            if not any(i["name"] == "by_" + "_".join(f for f, _ in fields) for i in own.indexes):
                own.create_index(fields, unique)
        own.write(documents(tables, c).withColumn("op", F.lit("upsert")))
        out[n] = own.count_documents()
    return out
