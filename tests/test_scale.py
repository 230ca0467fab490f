"""What must not grow with the input: the rows of a task, what is collected for a join, how often wide rows are shuffled."""
import datetime

from pyspark.sql import functions as F

from factloom.catalog import derived
from factloom.operators import joins, ordered, registry_facts


def _tables(spark, path, n):
    key = F.col("id").cast("bigint")
    spark.range(1, n + 1, numPartitions=1).select(
        key.alias("c_custkey"), F.concat(F.lit("Customer#"), key.cast("string")).alias("c_name"), F.lit(1).cast("bigint").alias("c_nationkey"),
        F.lit(10.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"),
    ).write.parquet(f"{path}/customer.parquet")
    spark.range(1, n + 1, numPartitions=1).select(key.alias("p_partkey"), F.concat(F.lit("part "), key.cast("string")).alias("p_name")).write.parquet(f"{path}/part.parquet")
    spark.range(1, 10 * n + 1, numPartitions=1).select(
        key.alias("o_orderkey"), F.lit(datetime.date(1996, 1, 2)).alias("o_orderdate"), (key * 100).cast("double").alias("o_totalprice"),
    ).write.parquet(f"{path}/orders.parquet")


def test_derived_rows_are_dealt_over_tasks(spark, tmp_path):
    n = 2 * derived.TASK_ROWS + 1000
    _tables(spark, tmp_path, n)
    made = derived.companies(spark, str(tmp_path)).withColumn("_task", F.spark_partition_id()).select("c_custkey", "_task").collect()
    assert sorted(r.c_custkey for r in made) == list(range(1, n + 1))
    assert len({r._task for r in made}) == 3
    filed = derived.accounts_responses(spark, str(tmp_path)).select("org_number", F.spark_partition_id().alias("_task")).collect()
    assert sorted(r.org_number for r in filed) == sorted(str(900000000 + k) for k in range(1, 10 * n + 1))
    assert len({r._task for r in filed}) == -(-10 * n // derived.TASK_FILINGS)


def test_salted_lookup_is_never_collected(spark):
    big = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    lookup = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    for how in ("inner", "left", "left_anti"):
        joined = joins.salted_join(big, lookup, ["k"], how)
        assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert joins.salted_join(big, lookup, ["k"], "inner").count() == 67


def test_numbering_shuffles_rows_once(spark):
    rows = [(k, s, o, "x") for k in ("a", "b", None) for s in (0, 1, None) for o in (1, 2)]
    df = spark.createDataFrame(rows, "k string, s int, o int, payload string")
    numbered = ordered.row_numbers(df, ["k"], ["o"], "s", "n")
    plan = numbered._jdf.queryExecution().executedPlan().toString().splitlines()
    assert sum("Exchange hashpartitioning" in line for line in plan) == 4  # the rows, and three times one row a segment
    got = {(r.k, r.s, r.o): r.n for r in numbered.collect()}
    assert got == {(k, s, o): {None: 0, 0: 2, 1: 4}[s] + o for k, s, o, _ in rows}


def test_filings_leave_the_list_behind(spark):
    body = '[{"journalnr":"1","regnskapstype":"SELSKAP","regnskapsperiode":{"tilDato":"2023-12-31"}},{"regnskapstype":"KONSERN","regnskapsperiode":{"tilDato":"2023-12-31"}}]'
    shape = "org_number string, kind string, page_no int, url string, status int, body string, retrieved_at timestamp"
    responses = spark.createDataFrame([("1", "accounts", 1, "u", 200, body, datetime.datetime(2024, 6, 1))], shape)
    company = registry_facts.company_filings(registry_facts.filings(responses))
    assert "body" not in company.columns
    assert [(r.period_end, r.journal, r["rank"]) for r in company.collect()] == [("2023-12-31", "1", 1)]
