"""Shared pieces of the training-data operators: reading, durable tables, prefix sums, native spans."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from `names` that `df` does not have (compared without case)."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def q(name: str) -> Column:
    """The column with exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session of one machine (master local) may do without the setting and gets a temporary folder; a cluster's
    executors could not read that, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "docloom-shared")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `durable` wrote. For those only that no later step can ask for again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_WORKER: dict = {}


def worker_cache(key, make):
    """What a Python worker keeps from task to task: one thing at a time, so that operators in turn don't add up."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(many: DataFrame, one: DataFrame, key: str | list[str], by: str, count: str, rows: int) -> DataFrame:
    """Left join of `many` to the one row of each key in `one`, whose column `count` says how often `many` has the key.

    Keys of more than a tenth of an even partition's rows are at most ten to a partition: so few can be broadcast.
    Their rows in `many` are dealt over SPLIT places by a hash of `by`, and their row in `one` goes to all of these.
    """
    spark, salt, hot = many.sparkSession, *fresh(many, "spread_salt", "spread_hot")
    least, on = max(200, rows // (10 * partitions(spark))), [key] if isinstance(key, str) else key
    keys = one.filter(q(count) >= least).select(*map(q, on), F.lit(True).alias(hot))
    dealt = many.join(F.broadcast(keys), on, "left").withColumn(salt, F.when(q(hot), F.pmod(F.xxhash64(by), F.lit(SPLIT))).otherwise(0).cast("int")).drop(hot)
    places = F.when(q(count) >= least, F.sequence(F.lit(0), F.lit(SPLIT - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(one.withColumn(salt, F.explode(places)), [*on, salt], "left").drop(salt)


def range_bounds(df: DataFrame, key: str, parts: int) -> tuple[list[int], list[int]]:
    """Ascending values of the integer column `key` that cut it into about `parts` equal ranges, and the hot ranges.

    One scan of a single column; the driver receives at most `parts` numbers. The values occur in the column. A range is
    hot if one value, or null, fills it more than twice over: no bounds of the column alone can split it further.
    """
    if parts < 2:
        return [], []
    found = F.percentile_approx(q(key), [i / parts for i in range(1, parts)], max(10_000, 10 * parts))
    got, nulls, rows = df.agg(found, F.count_if(q(key).isNull()), F.count(F.lit(1))).first()
    times = Counter(got or [])
    bounds = sorted(times)
    hot = [i for i, b in enumerate(bounds) if times[b] > 2]
    return bounds, sorted({0, *hot}) if nulls * parts > 2 * rows else hot


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """How many of `bounds` are below `key`, by binary search; null keys go with the smallest."""
    if not bounds:
        return F.lit(0)
    table = F.lit(np.array(bounds, dtype="int64"))
    n = len(bounds)
    steps = F.sequence(F.lit(1), F.lit(n.bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(table, mid) < key)
        return F.struct(
            F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"),
        )

    return F.when(key.isNull(), 0).otherwise(F.aggregate(steps, start, step, lambda s: s["lo"]))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


BLOCK, SPLIT = 256, 64


def matches(text: Column, pattern: str, before: int = 0, after: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches nothing: array<struct<s,e,m>>.

    `s` and `e` are code points, end exclusive. Java's matcher gives the matches and, by split, the gaps between
    them; running lengths of both, first by blocks and then within them, give the places without quadratic copying.
    With `before` or `after`, fields of these names have so many characters of the gaps around the match.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    kind = f"array<struct<s:int,e:int,m:string{',before:string' if before else ''}{',after:string' if after else ''}>>"

    def add(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["g"] + F.char_length(x["m"])
        more = ([x["before"].alias("before")] if before else []) + ([x["after"].alias("after")] if after else [])
        span = F.struct((acc["at"] + x["g"]).alias("s"), end.alias("e"), x["m"].alias("m"), *more)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def step(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def place(found: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: let(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda both: blocked(gaps, both)))

    def blocked(gaps: Column, both: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            more = ([F.right(x["g"], F.lit(before)).alias("before")] if before else []) + ([F.left(F.get(gaps, i + 1), F.lit(after)).alias("after")] if after else [])
            return F.struct(x["m"].alias("m"), F.char_length(x["g"]).alias("g"), *more)

        blocks = lambda pairs: F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK))
        return let(let(F.transform(both, pair), blocks), placed)

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["g"] + F.char_length(x["m"])))
        starts = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
        inner = lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), add, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, inner))

    return F.when(text.rlike(pattern), let(found, place)).otherwise(F.array().cast(kind))


def running(items: Column, start: Column, step, emit, kind: str) -> Column:
    """emit(state, item) of each item as an array of `kind`, the state being that before it; step(state, item) gives the next.

    States are worked out for blocks first and then within them, so that long arrays take time in proportion.
    """
    state = lambda x: F.struct(x.alias("at"))

    def blocked(items: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))
        return let(blocks, placed)

    def placed(blocks: Column) -> Column:
        over = lambda acc, b: F.struct(F.aggregate(b, acc["at"], step).alias("at"), F.concat(acc["out"], F.array(state(acc["at"]))).alias("out"))
        starts = F.aggregate(blocks, F.struct(start.alias("at"), F.slice(F.array(state(start)), 1, 0).alias("out")), over, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, starts, within))

    def within(block: Column, at: Column) -> Column:
        over = lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out"))
        return F.aggregate(block, F.struct(at["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out")), over, lambda acc: acc["out"])

    return let(items, lambda items: F.when(F.size(items) > 0, blocked(items)).otherwise(F.array().cast(f"array<{kind}>")))


def reach(spans: Column, others: Column, kind: str, by: str, least: int) -> Column:
    """Of each span that `others` has a part in: array<struct<far:int,x:kind>> in order of the span's field `by`.

    `far` is the largest end of the spans in `others` that begin before the span's `by`, or with `least` 1 at it, at the latest; -1
    if there is none. One merge of both by place, instead of comparing all pairs.
    """
    event = lambda at, after, e, x: F.struct(at.alias("at"), F.lit(after).alias("after"), e.alias("e"), x.alias("x"))
    own = F.transform(spans, lambda x: event(x[by], least, x["e"], x))
    all_ = F.concat(own, F.transform(others, lambda x: event(x["s"], 1 - least, x["e"], F.lit(None).cast(kind))))
    ordered = F.array_sort(all_, lambda a, b: F.when(a["at"] != b["at"], a["at"] - b["at"]).otherwise(a["after"] - b["after"]))
    found = running(ordered, F.lit(-1), lambda far, x: F.when(x["x"].isNull(), F.greatest(far, x["e"])).otherwise(far), lambda far, x: F.struct(far.alias("far"), x["x"].alias("x")), f"struct<far:int,x:{kind}>")
    return F.filter(found, lambda x: x["x"].isNotNull())


def joined(spans: Column) -> Column:
    """kind:start:end of array<struct<kind,s,e>>, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


