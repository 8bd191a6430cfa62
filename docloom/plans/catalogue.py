"""The named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime
import math
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.errors import Conflict
from docloom.functions import convert
from docloom.functions.values import Root
from docloom.operators import aggregate as A
from docloom.operators import find as Q
from docloom.operators import kv, nest, update, versions
from docloom.plans import migration
from docloom.sources.pgdump import read_dump
from docloom.sources.store import Collection, Engine
from docloom.streaming.watch import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in a session of one machine without the setting."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at or "file://" + os.path.join(tempfile.gettempdir(), "docloom-shared")


def engine(spark: SparkSession) -> Engine:
    """A new store of its own in the shared folder."""
    return Engine(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df, Root(df.schema, "o_orderkey")


def parts(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("tags", F.split("p_name", " "))
    return df, Root(df.schema, "p_partkey")


def events(spark, sf_dir):
    """Events with their props as a VARIANT body."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", F.parse_json("props").alias("body"))
    return df, Root(df.schema, "event_id", "body")


def find_orders(spark, sf_dir, filt, columns=("o_orderkey", "o_totalprice"), **options):
    df, root = orders(spark, sf_dir)
    return Q.find(df, filt, root=root, **options).select(*columns)


def day(y, m, d):
    return datetime.datetime(y, m, d)


# --- scans


@query("SELECT * FROM region")
def scan_all_region(spark, sf_dir):
    df = table(spark, sf_dir, "region")
    return Q.find(df, {}, root=Root(df.schema, "r_regionkey"))


@query("SELECT * FROM orders WHERE o_orderkey = 42")
def find_by_id_order(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return Q.by_id(df, 42, root)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000 ORDER BY o_totalprice, o_orderkey LIMIT 500")
def index_range_price(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return Q.index_range(df, [("o_totalprice", 1)], [100000], [200000], 500, root=root).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE (o_orderpriority, o_totalprice) >= ('2-HIGH', 150000.0) AND o_orderpriority < '4-NOT SPECIFIED'")
def index_range_compound(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return Q.index_range(df, [("o_orderpriority", 1), ("o_totalprice", 1)], ["2-HIGH", 150000.0], ["4-NOT SPECIFIED"], root=root).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice <= 300000 AND o_totalprice > 250000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 300")
def index_range_desc(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return Q.index_range(df, [("o_totalprice", -1)], [300000], [250000], 300, ids_only=True, root=root)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def reverse_scan(spark, sf_dir):
    return find_orders(spark, sf_dir, {}, ["o_orderkey"], sort=[("o_orderkey", -1)], limit=100)


# --- filters


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def filter_eq_and(spark, sf_dir):
    return find_orders(spark, sf_dir, {"o_orderstatus": "F", "o_orderpriority": {"$eq": "1-URGENT"}})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def filter_ne(spark, sf_dir):
    return find_orders(spark, sf_dir, {"o_orderstatus": {"$ne": "F"}})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 150000.5 AND o_orderdate >= TIMESTAMP '1995-01-01'")
def filter_range(spark, sf_dir):
    return find_orders(spark, sf_dir, {"o_totalprice": {"$gt": 100000, "$lte": 150000.5}, "o_orderdate": {"$gte": day(1995, 1, 1)}})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def filter_in(spark, sf_dir):
    return find_orders(spark, sf_dir, {"o_orderpriority": {"$in": ["1-URGENT", "5-LOW", None, 7]}})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def filter_nin(spark, sf_dir):
    return find_orders(spark, sf_dir, {"o_orderpriority": {"$nin": ["1-URGENT", "5-LOW"]}})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 20000 OR o_orderstatus = 'P'")
def filter_or(spark, sf_dir):
    return find_orders(spark, sf_dir, {"$or": [{"o_totalprice": {"$lt": 20000}}, {"o_orderstatus": "P"}]})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'O' AND o_totalprice > 50000)")
def filter_not(spark, sf_dir):
    return find_orders(spark, sf_dir, {"$not": {"o_orderstatus": "O", "o_totalprice": {"$gt": 50000}}})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR (o_totalprice > 200000 AND NOT o_orderpriority = '5-LOW')) AND o_custkey < 500")
def filter_nested_logic(spark, sf_dir):
    return find_orders(spark, sf_dir, {"$and": [{"$or": [{"o_orderstatus": "F"}, {"$and": [{"o_totalprice": {"$gt": 200000}}, {"$not": {"o_orderpriority": "5-LOW"}}]}]}, {"o_custkey": {"$lt": 500}}]})


@query("SELECT event_id FROM events WHERE event_type = 'click' OR value < 0.5")
def filter_cross_type(spark, sf_dir):
    """Text under the path is above every number, numbers are compared."""
    e = table(spark, sf_dir, "events")
    mixed = F.to_variant_object(F.struct(F.col("value").alias("v"))), F.to_variant_object(F.struct(F.col("event_type").alias("v")))
    df = e.select("event_id", F.when(F.col("event_type") == "click", mixed[1]).otherwise(mixed[0]).alias("body"))
    return Q.find(df, {"$or": [{"v": {"$gt": 10**12}}, {"v": {"$lt": 0.5}}]}, root=Root(df.schema, "event_id", "body")).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def filter_exists(spark, sf_dir):
    df, root = events(spark, sf_dir)
    return Q.find(df, {"k": {"$exists": True}, "zzz": {"$exists": False}}, root=root).select("event_id")


@query("SELECT event_id FROM events WHERE json_extract(props, '$.zzz') IS NULL AND CAST(json_extract(props, '$.k') AS BIGINT) <> 3")
def filter_missing_eq_null(spark, sf_dir):
    df, root = events(spark, sf_dir)
    return Q.find(df, {"zzz": None, "k": {"$ne": 3}}, root=root).select("event_id")


@query("SELECT event_id FROM events WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract(props, '$.k') AS DOUBLE) >= 50")
def filter_type(spark, sf_dir):
    df, root = events(spark, sf_dir)
    return Q.find(df, {"k": {"$type": "number", "$gte": 50}}, root=root).select("event_id")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), (SELECT min(string_split(p_name, ' ')[1]) FROM part)) AND len(string_split(p_name, ' ')) = 2")
def filter_array_all(spark, sf_dir):
    df, root = parts(spark, sf_dir)
    word = df.agg(F.min(F.get("tags", F.lit(0)))).first()[0]
    return Q.find(df, {"tags": {"$all": [word], "$type": "array"}}, root=root).select("p_partkey")


@query("SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders)")
def filter_elem_match(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    own = nest.nest_many(df, table(spark, sf_dir, "lineitem"), ["o_orderkey"], ["l_orderkey"], "items", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], ["l_quantity", "l_returnflag"])
    return Q.find(own, {"items": {"$elemMatch": {"l_quantity": {"$gte": 45}, "l_returnflag": "R"}}}, root=Root(own.schema, "o_orderkey")).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].* .*e$')")
def filter_regex(spark, sf_dir):
    df, root = parts(spark, sf_dir)
    return Q.find(df, {"p_name": {"$regex": "^[a-m].* .*e$"}}, root=root).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(lower(p_type), 'e')")
def filter_regex_i(spark, sf_dir):
    df, root = parts(spark, sf_dir)
    return Q.find(df, {"p_type": {"$regex": "E", "$options": "i"}}, root=root).select("p_partkey", "p_type")


# --- projections, sorts, pages


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'")
def project_include(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return Q.find(df, {"o_orderstatus": "P"}, project=["o_custkey", "o_orderstatus"], root=root)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def project_exclude(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return Q.find(df, {"o_orderstatus": "P"}, project={"o_orderdate": 0, "o_orderpriority": 0}, root=root)


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 1000")
def sort_multi(spark, sf_dir):
    return find_orders(spark, sf_dir, {}, ["o_orderkey", "o_orderpriority", "o_totalprice"], sort=[("o_orderpriority", 1), ("o_totalprice", -1)], limit=1000)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def topk(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return Q.find(df, {}, sort=[("c_acctbal", -1)], limit=10, root=Root(df.schema, "c_custkey")).select("c_custkey", "c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def skip_limit(spark, sf_dir):
    return find_orders(spark, sf_dir, {"o_orderstatus": "O"}, ["o_orderkey"], sort=[("o_totalprice", 1)], skip=100, limit=50)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_orderkey LIMIT 100 OFFSET 100")
def page_keyset(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    last = Q.page(df, sort=[("o_orderpriority", -1)], size=100, root=root).collect()[-1]
    return Q.page(df, sort=[("o_orderpriority", -1)], size=100, cursor=Q.cursor_after(last, None, root), root=root).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25 OFFSET 75")
def page_offset(spark, sf_dir):
    return find_orders(spark, sf_dir, {}, ["o_orderkey"], sort=[("o_orderdate", 1)], skip=75, limit=25)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice, o_orderkey LIMIT 1")
def find_one(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return Q.find_one(df, {"o_orderstatus": "P"}, sort=[("o_totalprice", 1)], root=root).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 400000")
def find_ids(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return Q.find_ids(df, {"o_totalprice": {"$gt": 400000}}, root=root)


# --- aggregations

FLAGSHIP = [
    {"$match": {"o_orderstatus": "F", "o_totalprice": {"$gte": 100000}}},
    {"$group": {"_id": "$o_orderpriority", "total": {"$sum": "$o_totalprice"}, "n": {"$count": {}}}},
]


@query("""SELECT o_orderpriority AS "_id", count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 GROUP BY 1""")
def group_sum_count(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return A.aggregate(df, FLAGSHIP, root).withColumn("total", F.round("total", 2))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_sum_count(spark, sf_dir)


@query("""SELECT CAST(NULL AS VARCHAR) AS "_id", count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem""")
def group_null(spark, sf_dir):
    return A.aggregate(table(spark, sf_dir, "lineitem"), [{"$group": {"_id": None, "n": {"$count": {}}, "total": {"$sum": "$l_linenumber"}}}])


@query("""SELECT CAST(NULL AS VARCHAR) AS "_id", count(*) AS n FROM orders WHERE o_orderkey < 0 HAVING count(*) > 0""")
def group_null_empty(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return A.aggregate(df, [{"$match": {"o_orderkey": {"$lt": 0}}}, {"$group": {"_id": None, "n": {"$count": {}}}}], root)


@query("""SELECT l_returnflag AS "_id", round(sum(l_quantity), 2) AS quantity, CAST(0 AS BIGINT) AS text FROM lineitem GROUP BY 1""")
def group_float_promote(spark, sf_dir):
    out = A.aggregate(table(spark, sf_dir, "lineitem"), [{"$group": {"_id": "$l_returnflag", "quantity": {"$sum": "$l_quantity"}, "text": {"$sum": "$l_linestatus"}}}])
    return out.withColumn("quantity", F.round("quantity", 2))


@query("""SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS "_id", count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1""")
def group_dotted(spark, sf_dir):
    df, root = events(spark, sf_dir)
    out = A.aggregate(df, [{"$group": {"_id": "$k", "n": {"$count": {}}, "total": {"$sum": "$k"}}}], root)
    return out.select(F.col("_id").cast("bigint").alias("_id"), "n", F.col("total").cast("bigint").alias("total"))


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def count_docs(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return A.count(df, {"o_totalprice": {"$gt": 100000}}, root)


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderstatus <> 'P'")
def distinct_sorted(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return A.distinct(df, "o_orderpriority", {"o_orderstatus": {"$ne": "P"}}, root)


@query("SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def distinct_dynamic(spark, sf_dir):
    df, root = events(spark, sf_dir)
    return A.distinct(df, "k", root=root).select(F.col("value").cast("bigint").alias("value"))


@query("SELECT count(*) AS scanned, count(*) FILTER (o_orderstatus = 'F') AS matched FROM orders")
def execution_stats(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return A.stats(df, {"o_orderstatus": "F"}, root).select("scanned", "matched")


@query("SELECT round(avg(n), 6) AS avg_fanout, max(n) AS max_fanout FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def fanout_stats(spark, sf_dir):
    return A.fan_out(table(spark, sf_dir, "orders"), ["o_custkey"]).withColumn("avg_fanout", F.round("avg_fanout", 6))


# --- nesting


@query(
    """SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS total
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def nest_one_to_many(spark, sf_dir):
    own = nest.nest_many(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), ["c_custkey"], ["o_custkey"], "orders", ["o_orderkey"], ["o_orderkey", "o_totalprice"])
    total = F.aggregate("orders.o_totalprice", F.lit(0.0), lambda a, x: a + x)
    return own.select("c_custkey", F.size("orders").cast("bigint").alias("n_orders"), F.array_join("orders.o_orderkey", ",").alias("orders"), F.round(total, 2).alias("total"))


@query("""SELECT conv_id, count(*) AS n_turns, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def nest_ordered_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    own = nest.nest_many(turns.select("conv_id").distinct(), turns, ["conv_id"], ["conv_id"], "turns", ["turn"], ["role", "text"])
    return own.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.array_join("turns.role", ",").alias("roles"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def nest_one_to_one(spark, sf_dir):
    own = nest.nest_one(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"], ["doc_id"], "label", ["quality", "toxic"])
    return own.select("doc_id", "label.quality", "label.toxic")


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def snapshot_lookup(spark, sf_dir):
    own = nest.snapshot_lookup(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), ["n_regionkey"], ["r_regionkey"], "region", ["r_regionkey"])
    return own.select("n_nationkey", "n_name", "region.r_name")


@query(
    """SELECT p_partkey, count(l_suppkey) AS n, coalesce(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey), '') AS ids
    FROM part LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey GROUP BY 1"""
)
def dissolve_m2m(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    own = nest.dissolve(table(spark, sf_dir, "part"), links, ["p_partkey"], ["l_partkey"], ["l_suppkey"], "supplier_ids", ["l_suppkey"])
    return own.select("p_partkey", F.size("supplier_ids").cast("bigint").alias("n"), F.array_join("supplier_ids", ",").alias("ids"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_recheck(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    hits = Q.find(df, {"o_orderstatus": "P"}, root=root)
    customers = table(spark, sf_dir, "customer")
    return Q.find(customers, {"c_acctbal": {"$gt": 0}}, root=Root(customers.schema, "c_custkey")).join(hits, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT p_name, p_size, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    df, root = parts(spark, sf_dir)
    own = nest.unique_violations(df, ["p_name", "p_size"], root)
    return own.select(F.col("k0.str").alias("p_name"), F.col("k1.num").cast("int").alias("p_size"), "n")


# --- updates


def updated(spark, sf_dir, filt, change, columns, **options):
    df, root = orders(spark, sf_dir)
    return update.update(df, filt, change, root=root, **options).table.select(*columns)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 'late' END AS note FROM orders")
def update_set(spark, sf_dir):
    return updated(spark, sf_dir, {"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "X", "note": "late"}}, ["o_orderkey", "o_orderstatus", "note"])


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def update_unset(spark, sf_dir):
    return updated(spark, sf_dir, {"o_totalprice": {"$lt": 50000}}, {"$unset": {"o_orderpriority": 1}}, ["o_orderkey", "o_orderpriority"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_custkey + 1000 ELSE o_custkey END AS o_custkey FROM orders")
def update_inc(spark, sf_dir):
    return updated(spark, sf_dir, {"o_orderstatus": "O"}, {"$inc": {"o_custkey": 1000}}, ["o_orderkey", "o_custkey"])


@query("SELECT p_partkey, replace(p_name, ' ', ',') || CASE WHEN p_size > 25 THEN ',large' ELSE '' END AS tags FROM part")
def update_push(spark, sf_dir):
    df, root = parts(spark, sf_dir)
    return update.update(df, {"p_size": {"$gt": 25}}, {"$push": {"tags": "large"}}, root=root).table.select("p_partkey", F.array_join("tags", ",").alias("tags"))


@query("""SELECT conv_id, string_agg(CASE WHEN turn = 0 THEN 'edited' ELSE text END, '|' ORDER BY turn) AS texts FROM conversations GROUP BY 1 HAVING count(*) FILTER (turn = 0) = 1""")
def update_positional(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    own = nest.nest_many(turns.select("conv_id").distinct(), turns, ["conv_id"], ["conv_id"], "turns", ["turn"], ["turn", "role", "text"])
    own = own.filter(F.size(F.filter("turns", lambda t: t["turn"] == 0)) == 1)
    new = update.update(own, {}, {"$set": {"turns.$[turn=0].text": "edited"}}, root=Root(own.schema, "conv_id")).table
    return new.select("conv_id", F.array_join("turns.text", "|").alias("texts"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + CASE WHEN event_type = 'click' THEN 5 ELSE 0 END AS k, CASE WHEN event_type = 'click' THEN 'yes' END AS seen FROM events")
def update_dynamic(spark, sf_dir):
    df, root = events(spark, sf_dir)
    typed = Root(df.schema, "event_id")
    clicks = update.update(df, {"event_type": "click"}, {"$inc": {"body.k": 5}, "$set": {"body.flags.seen": "yes"}}, root=typed).table
    return clicks.select("event_id", F.try_variant_get("body", "$.k", "bigint").alias("k"), F.try_variant_get("body", "$.flags.seen", "string").alias("seen"))


@query("SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT -1, 'N'")
def upsert_miss(spark, sf_dir):
    return updated(spark, sf_dir, {"o_orderkey": -1}, {"$setOnInsert": {"o_orderstatus": "N"}, "$set": {"o_custkey": 7}}, ["o_orderkey", "o_orderstatus"], upsert=True)


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 42 THEN 'H' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert_hit(spark, sf_dir):
    return updated(spark, sf_dir, {"o_orderkey": 42}, {"$setOnInsert": {"o_orderstatus": "N"}, "$set": {"o_orderstatus": "H"}}, ["o_orderkey", "o_orderstatus"], upsert=True)


@query("SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P') THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_one(spark, sf_dir):
    return updated(spark, sf_dir, {"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "X"}}, ["o_orderkey", "o_orderstatus"], one=True)


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def delete_many(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return update.delete(df, {"o_orderstatus": "F", "o_totalprice": {"$lt": 100000}}, root=root).table.select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')")
def delete_one(spark, sf_dir):
    df, root = orders(spark, sf_dir)
    return update.delete(df, {"o_orderstatus": "P"}, one=True, root=root).table.select("o_orderkey")


# --- versions: events as a changelog, an error being a delete


def changelog(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").otherwise("upsert")
    expires = F.unix_millis(F.col("ts").cast("timestamp")) + 86_400_000
    return e.select(F.col("user_id").alias("_id"), F.col("event_id").alias("_seq"), F.lit(0).alias("_ord"), op.alias("op"), "value", F.col("ts").alias("_ts"), expires.alias("_expires_at"))


LATEST = """SELECT user_id AS "_id", event_id AS "_seq", value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events {where}) WHERE r = 1 AND event_type <> 'error' {also}"""


@query(LATEST.format(where="", also=""))
def latest_version(spark, sf_dir):
    return versions.snapshot(changelog(spark, sf_dir)).select("_id", "_seq", "value")


@query(LATEST.format(where="WHERE event_id <= 500", also=""))
def snapshot_at_seq(spark, sf_dir):
    return versions.snapshot(changelog(spark, sf_dir), 500).select("_id", "_seq", "value")


@query("""SELECT user_id AS "_id", event_id AS "_seq", CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op FROM events WHERE event_id > 700""")
def change_feed_after(spark, sf_dir):
    return versions.changes_after(changelog(spark, sf_dir), 700, 0).select("_id", "_seq", "op")


@query(LATEST.format(where="WHERE ts <= (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)", also=""))
def pitr_to_time(spark, sf_dir):
    changes = changelog(spark, sf_dir)
    lo, hi = changes.agg(F.min("_ts"), F.max("_ts")).first()
    seq = versions.seq_at(changes, lo + (hi - lo) / 2).first()["seq"]
    return versions.snapshot(changes, seq).select("_id", "_seq", "value")


@query("""SELECT user_id AS "_id", event_id AS "_seq" FROM events WHERE event_id > 600 UNION ALL """ + LATEST.format(where="WHERE event_id <= 600", also="").replace(", value FROM", " FROM"))
def compaction_gc(spark, sf_dir):
    return versions.compact(changelog(spark, sf_dir), 600).select("_id", "_seq")


@query(LATEST.format(where="", also="AND epoch_us(ts) // 1000 + 86400000 >= (SELECT max(epoch_us(ts) // 1000) FROM events)"))
def ttl_visible(spark, sf_dir):
    changes = changelog(spark, sf_dir)
    now = changes.agg(F.max(F.unix_millis(F.col("_ts").cast("timestamp")))).first()[0]
    return versions.snapshot(changes, None, now).select("_id", "_seq", "value")


@query("""SELECT event_id, epoch_us(ts) // 1000 + 3600000 AS expires FROM events""")
def ttl_derive(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", versions.derived_expiry(F.unix_millis(F.col("ts").cast("timestamp")), 3600).alias("expires"))


@query("""SELECT user_id AS "_id", event_id AS "_seq", event_type AS op FROM events WHERE event_id > 300""")
def stream_feed(spark, sf_dir):
    """The feed after a sequence number as a stream: one run over all files that are there, into Parquet."""
    schema = table(spark, sf_dir, "events").schema
    out = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).filter("event_id > 300")
    feed = feed.select(F.col("user_id").alias("_id"), F.col("event_id").alias("_seq"), F.col("event_type").alias("op"))
    feed.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(feed.schema).parquet(f"{out}/rows")


@query("SELECT user_id AS _id, event_id AS _seq FROM events")
def raw_versions(spark, sf_dir):
    return versions.all_versions(changelog(spark, sf_dir)).select("_id", "_seq")


# --- the store: each query makes one of its own, writes to it and reads it back


def stored(spark, sf_dir, *more) -> tuple[Engine, Collection, int]:
    """Orders as documents (with more fields, if any are given); then those that are in progress are updated, and the cheap ones deleted."""
    db = engine(spark)
    own = db.collection("orders")
    first = own.insert_table(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_id"), "o_custkey", "o_orderstatus", "o_totalprice", *more))
    own.update_many({"o_orderstatus": "P"}, {"$set": {"o_orderstatus": "X"}, "$inc": {"o_custkey": 1000}})
    own.delete_many({"o_totalprice": {"$lt": 50000}})
    return db, own, first


def stored_fields(df: DataFrame) -> DataFrame:
    get = lambda path, kind: F.try_variant_get("body", f"$.{path}", kind)
    return df.select(F.col("_id").cast("bigint").alias("o_orderkey"), get("o_custkey", "bigint").alias("o_custkey"), get("o_orderstatus", "string").alias("o_orderstatus"))


STORED = "SELECT o_orderkey, o_custkey + CASE WHEN o_orderstatus = 'P' THEN 1000 ELSE 0 END AS o_custkey, replace(o_orderstatus, 'P', 'X') AS o_orderstatus FROM orders WHERE o_totalprice >= 50000"


@query(STORED)
def store_writes(spark, sf_dir):
    return stored_fields(stored(spark, sf_dir)[1].state())


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def store_old_state(spark, sf_dir):
    _, own, first = stored(spark, sf_dir)
    return stored_fields(own.state(first))


@query(STORED)
def store_compacted(spark, sf_dir):
    db, own, _ = stored(spark, sf_dir)
    db.compact()
    return stored_fields(Engine(spark, db.path).collection("orders").find())


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def store_restored(spark, sf_dir):
    db, _, first = stored(spark, sf_dir)
    copy = f"{db.path}-copy"
    db.restore_to(copy, first)
    return stored_fields(Engine(spark, copy).collection("orders").find())


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END AS BIGINT) AS rev FROM orders WHERE o_totalprice >= 50000")
def find_with_revision(spark, sf_dir):
    return stored(spark, sf_dir)[1].find_with_revision().select(F.col("_id").cast("bigint").alias("o_orderkey"), F.col("_rev").alias("rev"))


FEED = "SELECT o_orderkey, 2 AS seq, 'upsert' AS op FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 3, 'delete' FROM orders WHERE o_totalprice < 50000"


@query(FEED)
def store_feed(spark, sf_dir):
    """What came after the first commit, by a token."""
    db, own, first = stored(spark, sf_dir)
    token = own.event_token({"_seq": first, "_ord": 1 << 62})
    return own.changes_since(token).select(F.col("_id").cast("bigint").alias("o_orderkey"), F.col("_seq").cast("int").alias("seq"), "op")


@query(FEED)
def store_watch(spark, sf_dir):
    """The same by a stream, which starts after the token and keeps its place in a checkpoint."""
    db, own, first = stored(spark, sf_dir)
    out, token = f"{db.path}-watched", own.event_token({"_seq": first, "_ord": 1 << 62})
    for _ in range(2):  # the second run finds nothing new
        watch(own, lambda df, i: df.select("_id", "_seq", "op").write.mode("overwrite").parquet(f"{out}/{i}"), f"{db.path}-checkpoint", token, once=True).awaitTermination()
    seen = spark.read.schema("_id string, _seq long, op string").option("recursiveFileLookup", "true").parquet(out)
    return seen.select(F.col("_id").cast("bigint").alias("o_orderkey"), F.col("_seq").cast("int").alias("seq"), "op")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def store_index_pages(spark, sf_dir):
    """The second and third page of an index, by their tokens; equal prices are in the order of the key's number, not of its text."""
    _, own, _ = stored(spark, sf_dir, "o_orderkey")
    own.create_index([("o_totalprice", -1), ("o_orderkey", 1)], name="by_price")
    below = math.nextafter(300000, 0)  # the range ends before its bound, and 300000 is in it
    _, at = own.index_page("by_price", None, [below], 10)
    second, at = own.index_page("by_price", None, [below], 10, at) if at else ([], None)
    third, _ = own.index_page("by_price", None, [below], 10, at) if at else ([], None)
    return own.state(ids=second + third).select(F.col("_id").cast("bigint").alias("o_orderkey"), F.try_variant_get("body", "$.o_totalprice", "double").alias("o_totalprice"))


@query("SELECT r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN 'one' ELSE r_name END AS name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 77, 'new'")
def store_transaction(spark, sf_dir):
    """One transaction that is committed, one that is rolled back, and one that finds a document changed."""
    db = engine(spark)
    own = db.collection("region")
    own.insert_table(table(spark, sf_dir, "region"), "r_regionkey")
    with db.transaction() as tx:
        tx.put_document("region", {"_id": "1", "r_name": "one"})
        tx.put_document("region", {"_id": "77", "r_name": "new"})
        tx.delete_document("region", "2")
    tx = db.transaction()
    tx.delete_document("region", "3")
    tx.rollback()
    tx = db.transaction()
    tx.put_document("region", {"_id": "4", "r_name": "lost"})
    own.update_one({"_id": "4"}, {"$set": {"seen": True}})
    try:
        tx.commit()
    except Conflict:
        pass
    return own.find().select(F.col("_id").cast("int").alias("id"), F.try_variant_get("body", "$.r_name", "string").alias("name"))


@query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE starts_with(c_name, 'Customer#00000000') AND c_name <> 'Customer#000000007'")
def store_pairs(spark, sf_dir):
    db = engine(spark)
    rows = table(spark, sf_dir, "customer").filter("c_custkey < 200").select("c_name", "c_mktsegment").collect()
    db.pairs.write_batch([("put", r["c_name"].encode(), r["c_mktsegment"].encode()) for r in rows])
    db.pairs.delete(b"Customer#000000007")
    return db.pairs.prefix_scan(b"Customer#00000000").select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def unique_probe(spark, sf_dir):
    """The keys for which a unique index on both fields cannot be made."""
    df, root = orders(spark, sf_dir)
    own = nest.unique_violations(df, ["o_custkey", "o_orderpriority"], root)
    return own.select(F.col("k0.num").cast("bigint").alias("o_custkey"), F.col("k1.str").alias("o_orderpriority"), "n")


# --- dumps and migration


def nations_dump(spark, sf_dir) -> dict:
    """Regions and their nations as a dump in COPY format, read again."""
    regions, nations = (table(spark, sf_dir, n).collect() for n in ("region", "nation"))
    lines = ["CREATE TABLE public.region (r_regionkey integer PRIMARY KEY, r_name text);", "CREATE TABLE public.nation (n_nationkey integer PRIMARY KEY, n_name text, n_regionkey integer REFERENCES public.region(r_regionkey));"]
    lines += ["COPY public.region (r_regionkey, r_name) FROM stdin;", *(f"{r.r_regionkey}\t{r.r_name}" for r in regions), "\\."]
    lines += ["COPY public.nation (n_nationkey, n_name, n_regionkey) FROM stdin;", *(f"{n.n_nationkey}\t{n.n_name}\t{n.n_regionkey}" for n in nations), "\\."]
    at = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(at)
    return read_dump(spark, at)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def dump_rows(spark, sf_dir):
    rows = nations_dump(spark, sf_dir)["nation"].rows
    return rows.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name, count(n_nationkey) AS n, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def migrate_documents(spark, sf_dir):
    """Nations become a list in their region's document."""
    tables = nations_dump(spark, sf_dir)
    plan = migration.classify(tables)
    docs = migration.documents(tables, plan.collections["region"])
    nations = F.try_variant_get("body", "$.nation", "array<struct<n_nationkey:int,n_name:string>>")
    return docs.select(F.col("_id").alias("id"), F.try_variant_get("body", "$.r_name", "string").alias("r_name"), F.size(nations).cast("bigint").alias("n"), F.array_join(F.transform(nations, lambda x: x["n_name"]), ",").alias("nations"))


# --- key-value reads


@query("SELECT c_name, c_custkey FROM customer WHERE c_name >= 'Customer#000000100' AND c_name < 'Customer#000000500'")
def kv_range(spark, sf_dir):
    return kv.scan(table(spark, sf_dir, "customer"), "Customer#000000100", "Customer#000000500", "c_name").select("c_name", "c_custkey")


@query("SELECT c_name, c_custkey FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def kv_prefix(spark, sf_dir):
    return kv.prefix_scan(table(spark, sf_dir, "customer"), "Customer#0000001", "c_name").select("c_name", "c_custkey")


@query("SELECT c_name, c_custkey FROM customer WHERE c_name = 'Customer#000000042'")
def kv_get(spark, sf_dir):
    return kv.get(table(spark, sf_dir, "customer"), "Customer#000000042", "c_name").select("c_name", "c_custkey")


@query("SELECT c_name FROM customer WHERE NOT starts_with(c_name, 'Customer#0000001')")
def kv_delete_prefix(spark, sf_dir):
    return kv.delete_prefix(table(spark, sf_dir, "customer"), "Customer#0000001", "c_name").select("c_name")


@query("SELECT substr(c_name, 1, 16) AS tenant, CAST(sum(strlen(c_mktsegment)) AS BIGINT) AS bytes, count(*) AS keys FROM customer GROUP BY 1")
def tenant_usage(spark, sf_dir):
    return kv.tenant_usage(table(spark, sf_dir, "customer"), "c_name", "c_mktsegment")


# --- conversions of a dump's text values


@query("SELECT c_custkey, CAST(trunc(CAST(printf('%.4f', c_acctbal) AS DECIMAL(20, 4)) * 100) AS BIGINT) AS minor FROM customer")
def convert_money_minor(spark, sf_dir):
    text = F.format_string("%.4f", "c_acctbal")
    return table(spark, sf_dir, "customer").select("c_custkey", convert.minor_units(text, 2).alias("minor"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def convert_epoch_ms(spark, sf_dir):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return table(spark, sf_dir, "events").select("event_id", convert.epoch_ms(text).alias("ms"))


@query("SELECT doc_id, toxic = 1 AS toxic, CAST(quality AS BIGINT) AS quality FROM labels")
def convert_bool(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", convert.boolean(F.when(F.col("toxic") == 1, "t").otherwise("false")).alias("toxic"), convert.integer(F.col("quality").cast("string")).alias("quality"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
