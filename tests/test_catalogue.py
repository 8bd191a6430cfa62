import duckdb
import pytest

from docloom.operators import aggregate
from docloom.plans import catalogue
from tests.compare import connect, same

DIR = "/root/testdata/sf0.01"
EMPTY = {"group_null_empty"}


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert (same(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name], DIR) == 0) == (name in EMPTY)


@pytest.mark.parametrize("name", ["latest_version", "compaction_gc", "group_dotted", "distinct_dynamic"])
def test_bodies_and_groups_are_not_sorted(spark, name):
    """No sort by key below the result's own order."""
    plan = catalogue.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan


def test_groups_work_out_a_variant_type_once(spark):
    df, root = catalogue.events(spark, DIR)
    plan = aggregate.aggregate(df, [{"$group": {"_id": "$k", "total": {"$sum": "$k"}}}], root)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SchemaOfVariant.schemaOfVariant") == 1


def test_find_ids_has_no_cap(spark, tmp_path):
    spark.range(1_000_001).selectExpr("id AS o_orderkey", "400001D AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    assert catalogue.queries()["find_ids"](spark, str(tmp_path)).count() == 1_000_001


@pytest.mark.parametrize("n", [15, 25, 60])
def test_store_index_pages_with_equal_prices(spark, tmp_path, n):
    """Ties go by the key's number; the bound is in the range; a short range has no third page."""
    rows = spark.range(1, n + 1).selectExpr("id * 7 AS o_orderkey", "id AS o_custkey", "substr('FOP', CAST(id % 3 AS INT) + 1, 1) AS o_orderstatus", "300000D + 1000 * CAST(id % 2 AS DOUBLE) AS o_totalprice")
    rows.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    assert same(spark, con, catalogue.queries()["store_index_pages"], catalogue.oracle_sql()["store_index_pages"], str(tmp_path)) == min(20, n - 10)
