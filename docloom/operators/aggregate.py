"""count, distinct, and the pipeline of an optional $match and one $group with $sum and $count.

One partial and one final hash aggregation; the order of the groups is a sort of the result only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.errors import BadPipeline, LimitExceeded
from docloom.functions.values import Dynamic, Missing, Root, Typed, Value, checked, name, segments
from docloom.plans import filters

MOST_ACCUMULATORS = 16


@dataclass(frozen=True)
class Limits:
    """Errors beyond these numbers; None: no limit."""

    candidates: int | None = None
    groups: int | None = None
    result_bytes: int | None = None  # of the result as JSON
    pipeline_bytes: int | None = None  # of the pipeline as JSON


@dataclass(frozen=True)
class Group:
    match: object
    key: str | None
    accumulators: tuple[tuple[str, str, str | None], ...]  # name, operator, path


def parse(pipeline) -> Group:
    if not isinstance(pipeline, list) or len(pipeline) not in (1, 2) or not all(isinstance(s, dict) and len(s) == 1 for s in pipeline):
        raise BadPipeline("a pipeline is [$group] or [$match, $group]")
    names = [next(iter(s)) for s in pipeline]
    if names not in (["$group"], ["$match", "$group"]):
        raise BadPipeline("a pipeline is [$group] or [$match, $group]")
    spec = pipeline[-1]["$group"]
    if not isinstance(spec, dict) or "_id" not in spec:
        raise BadPipeline("$group needs an _id")
    key = spec["_id"]
    accumulators = []
    for out, body in sorted((k, v) for k, v in spec.items() if k != "_id"):
        if out.startswith("$") or "." in out or not out:
            raise BadPipeline(f"bad accumulator name {out!r}")
        if not isinstance(body, dict) or len(body) != 1:
            raise BadPipeline("an accumulator has one operator")
        op, x = next(iter(body.items()))
        if op == "$sum":
            accumulators.append((out, op, _path(x)))
        elif op == "$count" and x == {}:
            accumulators.append((out, op, None))
        else:
            raise BadPipeline(f"unsupported accumulator {body!r}")
    if len(accumulators) > MOST_ACCUMULATORS:
        raise BadPipeline("too many accumulators")
    return Group(filters.parse(pipeline[0]["$match"] if len(pipeline) == 2 else {}), None if key is None else _path(key), tuple(accumulators))


def _path(x) -> str:
    if not isinstance(x, str) or not x.startswith("$") or x.startswith("$$"):
        raise BadPipeline(f"expected a field path, got {x!r}")
    try:
        segments(x[1:])
    except Exception as e:
        raise BadPipeline(str(e)) from e
    return x[1:]


def _sum(value: Value, out: str) -> Column:
    """Whole while all numbers are, else double; nothing numeric gives 0. A whole total beyond 64 bits is an error."""
    if isinstance(value, Missing) or (isinstance(value, Typed) and value.rank != 2):
        return F.lit(0).cast("bigint").alias(out) if isinstance(value, Missing) else F.coalesce(F.sum(F.lit(0).cast("bigint")), F.lit(0)).alias(out)
    if isinstance(value, Typed):
        if value.integral:
            return F.coalesce(F.sum(value.number().cast("bigint")), F.lit(0).cast("bigint")).alias(out)
        return F.coalesce(F.sum(value.number().cast("double")), F.lit(0.0)).alias(out)
    whole, number = value.whole(), value.number()
    parts, any_float = F.sum(whole), F.bool_or(number.isNotNull() & whole.isNull())
    as_double = F.coalesce(F.sum(number), F.lit(0.0))
    own = F.when(F.coalesce(any_float, F.lit(False)), F.to_variant_object(F.struct(as_double.alias("v")))).otherwise(F.to_variant_object(F.struct(F.coalesce(parts, F.lit(0).cast("bigint")).alias("v"))))
    return F.variant_get(own, "$.v", "variant").alias(out)


def read_once(rows: DataFrame, root: Root, paths: list[str]) -> tuple[DataFrame, dict[str, Value]]:
    """The values by path; VARIANT ones become columns, with their types beside them, so that a row's are worked out once."""
    values = {path: root.get(path) for path in paths}
    for i, (path, value) in enumerate(values.items()):
        if isinstance(value, Dynamic):
            own, kind = f"__value{i}", f"__type{i}"
            rows = rows.withColumn(own, value.column()).withColumn(kind, F.schema_of_variant(own))
            values[path] = Dynamic(F.col(own), F.col(kind))
    return rows, values


KEY = ["__rank", "__num", "__str"]


def _keyed(rows: DataFrame, key: Column, value: Value) -> tuple[DataFrame, Column]:
    """Rows with the fields of their key as columns, and an aggregate that tells the whole number of a group, null if none is written so.

    Keys and aggregate are of fixed width or plain strings, so groups are hashed, not sorted.
    """
    rows = rows.withColumn("__key", key)
    rows = rows.withColumns({"__rank": F.col("__key.rank"), "__num": F.col("__key.num"), "__str": F.col("__key.str")})
    own = value.whole() if isinstance(value, Dynamic) else F.lit(None).cast("bigint")
    return rows, F.min(own).alias("__whole")


def _represented() -> Column:
    """A group's key as VARIANT: a whole number if a member is written so."""
    part = lambda c: F.variant_get(F.to_variant_object(F.struct(c.alias("v"))), "$.v", "variant")
    number = F.when(F.col("__whole").isNotNull(), part(F.col("__whole"))).otherwise(part(F.col("__num")))
    return F.when(F.col("__rank") == 1, part(F.col("__num") == 1)).when(F.col("__rank") == 2, number).when(F.col("__rank") == 3, part(F.col("__str")))


def aggregate(df: DataFrame, pipeline, root: Root | None = None, limits: Limits = Limits()) -> DataFrame:
    """`_id` and the accumulators, in the order of `_id`. No rows give no group, not even for _id null."""
    if limits.pipeline_bytes is not None and len(json.dumps(pipeline, default=str).encode()) > limits.pipeline_bytes:
        raise LimitExceeded("the pipeline is too long")
    own, root = parse(pipeline), root or Root(df.schema)
    rows = df if own.match == filters.All(()) else df.filter(filters.compile_filter(own.match, root))
    if limits.candidates is not None and rows.limit(limits.candidates + 1).count() > limits.candidates:
        raise LimitExceeded("too many candidates")
    rows, values = read_once(rows, root, [path for _, op, path in own.accumulators if op != "$count"] + ([] if own.key is None else [own.key]))
    sums = [F.count(F.lit(1)).alias(out) if op == "$count" else _sum(values[path], out) for out, op, path in own.accumulators]
    sums = sums or [F.count(F.lit(1)).alias("_n")]
    names = [out for out, _, _ in own.accumulators]
    if own.key is None:
        out = rows.groupBy(F.lit(None).cast("string").alias("_id")).agg(*sums).select("_id", *map(name, names))
    else:
        value = values[own.key]
        if isinstance(value, Typed) and value.rank is not None:
            out = rows.groupBy(value.column().alias("_id")).agg(*sums).select("_id", *map(name, names)).orderBy(F.col("_id").asc_nulls_first())
        elif isinstance(value, Missing):
            out = rows.groupBy(F.lit(None).cast("string").alias("_id")).agg(*sums).select("_id", *map(name, names))
        else:
            key = checked(value.scalar(), "a group key is a scalar or null", value.key())
            keyed, whole = _keyed(rows, key, value)
            out = keyed.groupBy(*KEY).agg(whole, *sums).orderBy(*KEY).select(_represented().alias("_id"), *map(name, names))
    if limits.groups is not None and out.limit(limits.groups + 1).count() > limits.groups:
        raise LimitExceeded("too many groups")
    if limits.result_bytes is not None and (out.select(json_bytes(out).alias("n")).agg(F.sum("n")).first()[0] or 0) > limits.result_bytes:
        raise LimitExceeded("the result is too large")
    return out


def json_bytes(df: DataFrame) -> Column:
    """Bytes of a row as JSON."""
    return F.octet_length(F.to_json(F.struct(*map(name, df.columns)))).cast("bigint")


def count(df: DataFrame, filt=None, root: Root | None = None) -> DataFrame:
    """One row with `n`."""
    return df.filter(filters.compile_filter(filt, root or Root(df.schema))).agg(F.count(F.lit(1)).alias("n"))


def distinct(df: DataFrame, path: str, filt=None, root: Root | None = None) -> DataFrame:
    """`value`: one row for each distinct value, in order; missing, null, arrays and objects share one."""
    root = root or Root(df.schema)
    rows, values = read_once(df.filter(filters.compile_filter(filt, root)), root, [path])
    value = values[path]
    if isinstance(value, Typed) and value.rank is not None:
        return rows.select(value.column().alias("value")).distinct().orderBy(F.col("value").asc_nulls_first())
    keyed, whole = _keyed(rows, value.key(), value)
    return keyed.groupBy(*KEY).agg(whole).orderBy(*KEY).select(_represented().alias("value"))


def stats(df: DataFrame, filt=None, root: Root | None = None) -> DataFrame:
    """Scanned and matched rows and the bytes of these as JSON, in one pass."""
    hit = filters.matches(filt, root or Root(df.schema))
    return df.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(hit).alias("matched"), F.coalesce(F.sum(F.when(hit, json_bytes(df))), F.lit(0)).alias("result_bytes"))


def fan_out(df: DataFrame, fk: list[str]) -> DataFrame:
    """Mean and most children of a parent; null keys are no children."""
    some = df.dropna(subset=fk)
    return some.groupBy(*map(name, fk)).count().agg(F.coalesce(F.avg("count"), F.lit(0.0)).alias("avg_fanout"), F.coalesce(F.max("count"), F.lit(0)).alias("max_fanout"))
