import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom.errors import BadFilter, BadPipeline, BadQuery, BadUpdate, LimitExceeded
from docloom.functions.values import Root
from docloom.operators import aggregate as A
from docloom.operators import find as Q
from docloom.operators import nest, update
from docloom.plans import filters, projection, updates
from tests import oracle

SCALARS = [None, True, False, 0, 1, -3, 2.5, 1.0, 1e3, "", "a", "ab", "B", "é", 9007199254740993]


def value(rnd, depth=0):
    kind = rnd.random()
    if depth < 2 and kind < 0.15:
        return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    if depth < 2 and kind < 0.3:
        return {k: value(rnd, depth + 1) for k in rnd.sample("abc", rnd.randint(0, 2))}
    return rnd.choice(SCALARS)


def document(rnd, i):
    return {"_id": f"d{i:03d}"} | {k: value(rnd) for k in rnd.sample("abcd", rnd.randint(0, 4))}


def condition(rnd):
    op = rnd.choice(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$type", "$all", "$elemMatch", "$regex", "plain"])
    if op in ("$in", "$nin", "$all"):
        return {op: [value(rnd) for _ in range(rnd.randint(0, 3))]}
    if op == "$exists":
        return {op: rnd.random() < 0.5}
    if op == "$type":
        return {op: rnd.choice(["string", "number", "bool", "null", "array", "object"])}
    if op == "$elemMatch":
        return {op: {rnd.choice("abc"): rnd.choice(SCALARS)}}
    if op == "$regex":
        return {op: rnd.choice(["^a", "b$", "A", "."]), "$options": rnd.choice(["", "i"])}
    return value(rnd) if op == "plain" else {op: value(rnd)}


def random_filter(rnd, depth=0):
    kind = rnd.random()
    if depth < 2 and kind < 0.3:
        return {rnd.choice(["$and", "$or"]): [random_filter(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]}
    if depth < 2 and kind < 0.4:
        return {"$not": random_filter(rnd, depth + 1)}
    return {rnd.choice(["a", "b", "c", "d", "a.b", "b.a.c"]): condition(rnd) for _ in range(rnd.randint(0, 2))}


def bodies(spark, docs):
    df = spark.createDataFrame([(d["_id"], json.dumps(d)) for d in docs], "_id string, j string").select("_id", F.parse_json("j").alias("body"))
    return df.cache(), Root(df.schema, "_id", "body")


@pytest.fixture(scope="module")
def docs():
    rnd = random.Random(11)
    return [document(rnd, i) for i in range(120)]


@pytest.fixture(scope="module")
def table(spark, docs):
    return bodies(spark, docs)


def test_random_filters_over_bodies(table, docs):
    df, root = table
    rnd = random.Random(5)
    filts = [random_filter(rnd) for _ in range(160)]
    for at in range(0, len(filts), 20):
        some = filts[at : at + 20]
        got = df.select("_id", *[filters.matches(f, root).alias(f"m{i}") for i, f in enumerate(some)]).collect()
        for r in got:
            doc = next(d for d in docs if d["_id"] == r["_id"])
            for i, f in enumerate(some):
                assert r[f"m{i}"] == oracle.matches(doc, f), (f, doc)


TYPED = "_id string, n long, x double, b boolean, s string, tags array<string>, o struct<a:long,b:string>, items array<struct<k:string,q:long>>"


def typed_rows():
    rnd = random.Random(3)
    maybe = lambda v: v if rnd.random() < 0.8 else None
    return [(f"d{i:03d}", maybe(rnd.choice([0, 1, 5, -2, 9007199254740993])), maybe(rnd.choice([0.0, 1.0, 2.5])), maybe(rnd.random() < 0.5), maybe(rnd.choice(["a", "ab", "B", "é"])), maybe([rnd.choice("xyz") for _ in range(rnd.randint(0, 3))]), maybe((maybe(rnd.randint(0, 3)), maybe(rnd.choice("pq")))), maybe([(rnd.choice("kl"), rnd.randint(0, 3)) for _ in range(rnd.randint(0, 2))])) for i in range(80)]


def plain(v):
    """A typed row as a document: null fields are missing."""
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items() if x is not None}
    return [plain(x) for x in v] if isinstance(v, list) else v


def test_typed_filters(spark):
    df = spark.createDataFrame(typed_rows(), TYPED)
    docs, root = {r["_id"]: plain(r) for r in df.collect()}, Root(df.schema)
    literals = [None, True, False, 0, 1, 5, 2.5, 1.0, "a", "B", "é", ["x"], ["x", "y"], [], {"a": 1}, {"a": 1, "b": "p"}, {}, {"z": 1}]
    some = [{p: {op: x}} for p in ("n", "x", "b", "s", "tags", "o", "o.a", "o.b", "zz", "n.a") for x in literals for op in ("$eq", "$ne", "$gt", "$lte", "$gte")]
    some += [{p: {op: xs}} for p in ("n", "s", "x", "tags", "zz") for op in ("$in", "$nin", "$all") for xs in ([], [1, "a"], [None, 5], ["x", "y"], [2.5, True])]
    some += [{p: {"$exists": e}} for p in ("n", "o.a", "zz") for e in (True, False)] + [{p: {"$type": t}} for p in ("n", "s", "b", "tags", "o", "zz") for t in filters.TYPES if t != "null"]
    some += [{"items": {"$elemMatch": {"k": "k", "q": {"$gt": 1}}}}, {"items": {"$elemMatch": {"q": {"$ne": 1}}}}, {"s": {"$regex": "^A", "$options": "i"}}, {"n": {"$regex": "1"}}, {"$not": {"n": {"$gt": 0}}}, {"$or": []}, {"$and": []}, {}, {"$not": {"o.a": 1, "s": "a"}}]
    for at in range(0, len(some), 100):
        part = some[at : at + 100]
        for r in df.select("_id", *[filters.matches(f, root).alias(f"m{i}") for i, f in enumerate(part)]).collect():
            for i, f in enumerate(part):
                assert r[f"m{i}"] == oracle.matches(docs[r["_id"]], f), (f, docs[r["_id"]])


def test_sorts_follow_the_order_of_types(table, docs):
    df, root = table
    for sort in ([("a", 1)], [("a", -1)], [("b", 1), ("a", -1)], [("a.b", -1), ("c", 1)]):
        got = [r["_id"] for r in Q.find(df, {}, sort, root=root).collect()]
        assert got == [d["_id"] for d in oracle.ordered(docs, sort)]


def test_pages_cover_everything_once(table, docs):
    df, root = table
    for sort in ([("a", 1)], [("b", -1), ("a", 1)]):
        seen, cursor = [], None
        while True:
            rows = Q.page(df, {}, sort, 37, cursor, root).collect()
            seen += [r["_id"] for r in rows]
            if len(rows) < 37:
                break
            cursor = Q.cursor_after(rows[-1], sort, root)
        assert seen == [d["_id"] for d in oracle.ordered(docs, sort)]
    with pytest.raises(BadQuery):
        Q.page(df, cursor="nonsense", root=root)


def test_groups_and_distinct_share_keys(spark):
    docs = [{"_id": "1", "k": 1, "v": 1}, {"_id": "2", "k": 1.0, "v": 2.5}, {"_id": "3", "v": True}, {"_id": "4", "k": None, "v": "x"}, {"_id": "5", "k": "s", "v": 3}, {"_id": "6", "k": "s"}]
    df, root = bodies(spark, docs)
    out = A.aggregate(df, [{"$group": {"_id": "$k", "t": {"$sum": "$v"}, "n": {"$count": {}}}}], root)
    got = [(r["k"] and json.loads(r["k"]), json.loads(r["t"]), r["n"]) for r in out.select(F.to_json("_id").alias("k"), F.to_json("t").alias("t"), "n").collect()]
    assert [(k, t, n) for k, t, n in got] == [(None, 0, 2), (1, 3.5, 2), ("s", 3, 2)]
    bad, root2 = bodies(spark, [{"_id": "1", "k": {"a": 1}}])
    with pytest.raises(PySparkException):
        A.aggregate(bad, [{"$group": {"_id": "$k"}}], root2).collect()
    values = [r["v"] for r in A.distinct(df, "k", root=root).select(F.to_json("value").alias("v")).collect()]
    assert values == [None, "1", '"s"']
    assert A.aggregate(df, [{"$match": {"k": "none"}}, {"$group": {"_id": None, "n": {"$count": {}}}}], root).collect() == []


def test_group_of_mixed_types(spark):
    """Whole and broken numbers, text and nothing under one path; keys that are missing, null and equal as numbers."""
    plants = [("p1", "fern", 4), ("p2", "moss", 0.25), ("p3", None, 7), ("p4", "moss", 2), ("p5", "fern", "tall"), ("p6", 3, 1), ("p7", 3.0, 1), ("p8", "moss", None)]
    docs = [{"_id": i, "wet": True} | ({"kind": k} if k is not None else {}) | ({"height": h} if h is not None else {}) for i, k, h in plants] + [{"_id": "p9", "wet": False, "kind": "fern", "height": 100}, {"_id": "q1", "wet": True, "kind": None, "height": 5}]
    df, root = bodies(spark, docs)
    out = A.aggregate(df, [{"$match": {"wet": True}}, {"$group": {"_id": "$kind", "sum": {"$sum": "$height"}, "rows": {"$count": {}}}}], root)
    got = [(r["i"] and json.loads(r["i"]), json.loads(r["t"]), r["rows"]) for r in out.select(F.to_json("_id").alias("i"), F.to_json("sum").alias("t"), "rows").collect()]
    assert got == [(None, 12, 2), (3, 2, 2), ("fern", 4, 2), ("moss", 2.25, 3)]


def test_long_overflow_is_an_error(spark):
    df = spark.createDataFrame([("1", (1 << 63) - 1), ("2", 1)], "_id string, n long")
    with pytest.raises(PySparkException):
        A.aggregate(df, [{"$group": {"_id": None, "t": {"$sum": "$n"}}}]).collect()


@pytest.mark.parametrize("bad", [[], [{"$match": {}}], [{"$group": {}}], [{"$group": {"_id": "x"}}], [{"$group": {"_id": {"x": 1}}}], [{"$group": {"_id": None, "a": {"$sum": 1}}}], [{"$group": {"_id": None, "a": {"$avg": "$x"}}}], [{"$group": {"_id": "$a..b"}}], [{"$group": {"_id": None}}, {"$match": {}}], [{"$match": {}}, {"$group": {"_id": None}}, {"$sort": {}}], "x", [{"$group": {"_id": None, "a": {"$count": 1}}}]])
def test_bad_pipelines(bad):
    with pytest.raises((BadPipeline, BadFilter)):
        A.parse(bad)


@pytest.mark.parametrize("bad", ["x", {"$nor": []}, {"a": {"$foo": 1}}, {"a": {"$gt": 1, "b": 2}}, {"a": {"$in": 1}}, {"$and": {}}, {"a": {"$exists": 1}}, {"a": {"$type": "int"}}, {"a": {"$options": "i"}}, {"a": {"$regex": ""}}, {"a": {"$regex": "x" * 257}}, {"a": {"$regex": "(a+)+"}}, {"a": {"$regex": "a", "$options": "x"}}, {"a": {"$regex": "(?=a)"}}, {"a": {"$elemMatch": {"$gt": 1}}}, {"a": {"$not": {"$gt": 1}}}, {"a..b": 1}, {"": 1}, {"a": {"$regex": "("}}])
def test_bad_filters(bad):
    with pytest.raises(BadFilter):
        filters.parse(bad)


@pytest.mark.parametrize("bad", [{}, {"a": 1}, {"$set": {}}, {"$foo": {"a": 1}}, {"$set": {"a..b": 1}}, {"$set": {"_id": 1}}, {"$set": {"a.$.b": 1}}, {"$set": {"a.$[].b": 1}}, {"$inc": {"a": "x"}}, {"$inc": {"a.$[k=1].b": 1}}, {"$set": {"a.$[k=1].b.$[j=2]": 1}}, "x"])
def test_bad_updates(bad):
    with pytest.raises(BadUpdate):
        updates.parse(bad)


def applied(spark, doc, change, filt=None):
    df, root = bodies(spark, [{"_id": "1", **doc}])
    out = update.update(df, filt or {}, change, root=root).table.select(F.to_json("body").alias("j")).first()["j"]
    return {k: v for k, v in json.loads(out).items() if k != "_id"}


def test_updates_of_bodies(spark):
    assert applied(spark, {"a": 1}, {"$set": {"b.c": [1, {"d": None}]}}) == {"a": 1, "b": {"c": [1, {"d": None}]}}
    assert applied(spark, {"a": {"b": 1, "c": 2}}, {"$unset": {"a.b": 1, "x.y": 1}}) == {"a": {"c": 2}}
    assert applied(spark, {"n": 1, "f": 1.5, "s": "x"}, {"$inc": {"n": 2, "f": 0.5, "m": 3, "s": 1}}) == {"n": 3, "f": 2, "m": 3, "s": 1}
    assert applied(spark, {"t": [1]}, {"$push": {"t": {"k": 2}, "u": 1}}) == {"t": [1, {"k": 2}], "u": [1]}
    assert applied(spark, {"i": [{"k": "A", "q": 1}, {"k": "B", "q": 2}]}, {"$set": {"i.$[k=B].q": 9}}) == {"i": [{"k": "A", "q": 1}, {"k": "B", "q": 9}]}
    assert applied(spark, {"a": 1, "b": 2}, {"$set": {"a": 5}, "$inc": {"b": 1}, "$setOnInsert": {"c": 1}}) == {"a": 5, "b": 3}
    for doc, change in [({"a": 1}, {"$set": {"a.b": 1}}), ({"t": None}, {"$push": {"t": 1}}), ({"i": [{"k": "A"}, {"k": "A"}]}, {"$set": {"i.$[k=A].q": 1}}), ({"i": []}, {"$set": {"i.$[k=A].q": 1}})]:
        with pytest.raises(PySparkException):
            applied(spark, doc, change)


def test_updates_of_columns(spark):
    df = spark.createDataFrame([("1", 5, ["x"], (1, "p")), ("2", None, None, None)], "_id string, n long, t array<string>, o struct<a:long,b:string>")
    got = update.update(df, {}, {"$inc": {"n": 2}, "$push": {"t": "y"}, "$set": {"o.a": 7, "new": "v"}}).table.orderBy("_id").collect()
    assert [tuple(r) for r in got] == [("1", 7, ["x", "y"], (7, "p"), "v"), ("2", 2, ["y"], (7, None), "v")]
    got = update.update(df, {"n": 5}, {"$unset": {"o.b": 1, "n": 1}, "$set": {"o.c": True}}).table.orderBy("_id").collect()
    assert got[0]["n"] is None and got[0]["o"]["a"] == 1 and got[0]["o"]["c"] is True and got[1]["o"] is None
    put = update.put(df, spark.createDataFrame([("2", 9), ("3", 1)], "_id string, n long"))
    assert sorted((r["_id"], r["n"]) for r in put.collect()) == [("1", 5), ("2", 9), ("3", 1)]
    assert update.delete(df, {"n": None}).counts()["matched"] == 1
    versioned = df.withColumn("_rev", F.lit(3))
    row = spark.createDataFrame([("1", 100)], "_id string, n long")
    assert update.put_if(versioned, "1", 3, row).changed.count() == 1 and update.put_if(versioned, "1", 2, row).changed.count() == 0


def test_projections(spark):
    df, root = bodies(spark, [{"_id": "1", "a": {"b": 1, "c": 2}, "d": 3}])
    body = lambda p: json.loads(Q.find(df, {}, project=p, root=root).select(F.to_json("body").alias("j")).first()["j"])
    assert body(["a.b", "zz", "d.x"]) == {"_id": "1", "a": {"b": 1}} and body({"a.b": 0, "_id": 0}) == {"a": {"c": 2}, "d": 3}
    typed = spark.createDataFrame([("1", (1, "p"), 2)], "_id string, o struct<a:long,b:string>, n long")
    assert Q.find(typed, project=["o.a"]).first().asDict(True) == {"_id": "1", "o": {"a": 1}}
    assert Q.find(typed, project={"o.a": 0}).first().asDict(True) == {"_id": "1", "o": {"b": "p"}, "n": 2}
    for bad in ({"a": 1, "b": 0}, {"a": 1, "_id": 0}, {"a..b": 1}):
        with pytest.raises(BadQuery):
            projection.parse(bad)


def test_index_ranges_with_prefixes_and_directions(spark):
    df = spark.createDataFrame([(str(i), "u" + str(i % 3), i) for i in range(12)], "_id string, o string, t long")
    ids = lambda *a, **k: [int(r["_id"]) for r in Q.index_range(df, *a, **k).collect()]
    assert ids([("o", 1), ("t", -1)], ["u1", 7], ["u2"]) == [7, 4, 1]
    assert ids([("t", -1)], [9], [6], ids_only=True) == [9, 8, 7] and ids([("o", 1)], None, ["u1"], limit=2) == [0, 3]
    assert ids([("t", 1)], ["x"]) == []


def test_limits(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(20)], "_id long, k long")
    for call in (lambda: Q.find(df, sort=[("k", 1)], most_sorted=10), lambda: Q.find_ids(df, {}, 10), lambda: A.aggregate(df, [{"$group": {"_id": "$k"}}], limits=A.Limits(groups=3)), lambda: A.aggregate(df, [{"$group": {"_id": "$k"}}], limits=A.Limits(candidates=3))):
        with pytest.raises(LimitExceeded):
            call()


def test_plans_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    root = Root(df.schema, "o_orderkey")
    own = plan(Q.find(df, {"o_orderstatus": "F", "o_custkey": {"$gte": 5}, "o_orderpriority": {"$in": ["1-URGENT", "5-LOW"]}}, project=["o_custkey"], root=root))
    assert "EqualTo(o_orderstatus,F)" in own and "GreaterThanOrEqual(o_custkey,5)" in own and "In(o_orderpriority" in own and "o_totalprice" not in own
    assert "TakeOrderedAndProject" in plan(Q.find(df, {}, [("o_totalprice", -1)], limit=5, root=root))
    assert "Window" not in plan(nest.nest_many(df, df.withColumnRenamed("o_orderkey", "k"), ["o_orderkey"], ["o_custkey"], "x", ["k"], ["k"]))


def test_increments_of_the_widest_whole_numbers(spark):
    df = spark.sql("SELECT parse_json(j) AS v FROM VALUES ('{\"n\": -9223372036854775808}'), ('{\"n\": 9007199254740991}'), ('{\"n\": 5}'), ('{\"n\": 1.5}') AS t(j)")
    own = df.select(F.to_json(updates.apply_dynamic(F.col("v"), updates.parse({"$inc": {"n": 1}, "$set": {"m.k": 1, "m.l": 2}}))).alias("j")).collect()
    assert [json.loads(r["j"]) for r in own] == [{"n": n, "m": {"k": 1, "l": 2}} for n in (-9223372036854775808, 9007199254740992, 6, 2.5)]
