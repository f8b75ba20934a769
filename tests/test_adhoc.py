"""The ad-hoc entry point takes queries only (QRY-10)."""

import pytest

from riskmart.plans.q_jobs import adhoc_sql
from riskmart.session import scratch_path


@pytest.fixture
def stored(spark):
    path = scratch_path(spark, "t-adhoc")
    spark.range(3).withColumnRenamed("id", "a").write.parquet(path)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW adhoc_t USING parquet OPTIONS (path '{path}')")
    yield path
    spark.catalog.dropTempView("adhoc_t")


@pytest.mark.parametrize("text", [
    "WITH x AS (SELECT 9L AS a) INSERT INTO adhoc_t SELECT * FROM x",
    "with x as (select 9L as a) from x insert into adhoc_t select a insert into adhoc_t select a + 1",
    "WITH x AS (SELECT 9L AS a) INSERT OVERWRITE TABLE adhoc_t SELECT * FROM x",
    "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM adhoc_t",
    "SELECT reflect('java.lang.System', 'currentTimeMillis')", "SELECT  Java_Method ('java.util.UUID', 'randomUUID')",
    "INSERT INTO adhoc_t VALUES (9)", "DROP VIEW adhoc_t", "", "   ", "SET spark.x=1", "CREATE TABLE t2 AS SELECT 1"])
def test_other_statements_are_refused(spark, stored, text):
    with pytest.raises(ValueError):
        adhoc_sql(spark, text)
    assert sorted(r["a"] for r in spark.read.parquet(stored).collect()) == [0, 1, 2]


def test_queries_run_whole_or_capped(spark, stored):
    assert adhoc_sql(spark, "SELECT a FROM adhoc_t").count() == 3
    assert adhoc_sql(spark, "SELECT a FROM adhoc_t", cap=2).count() == 2
    assert adhoc_sql(spark, "WITH x AS (SELECT a FROM adhoc_t) SELECT sum(a) AS s FROM x").first()["s"] == 3
    assert adhoc_sql(spark, "SELECT 'INSERT INTO t' AS s, 'InsertIntoStatement' AS u").first()["s"] == "INSERT INTO t"
    assert adhoc_sql(spark, "SELECT a AS `insert`, a AS updated FROM adhoc_t WHERE a IN (SELECT max(a) FROM adhoc_t)").count() == 1
