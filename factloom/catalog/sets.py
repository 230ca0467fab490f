"""Set operations and completeness (inventory J1, J2, J4, J5)."""
from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import derived
from factloom.catalog import sql as S
from factloom.catalog.registry import query, table
from factloom.operators import joins
from factloom.plans import assembly


@query("j1_ranked_union", """
SELECT user_id, arg_min(event_id, CAST(rank AS BIGINT) * 1000000000 + event_id) AS event_id, CAST(min(rank) AS INT) AS source_rank FROM (
  SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS rank FROM events) GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    parts = [e.filter(F.col("event_type") == t).drop("event_type") for t in ("purchase", "click", "view", "signup", "error")]
    return joins.ranked_union(parts, ["user_id"], ["event_id"])


@query("j1_prefer", """
SELECT o_custkey, 'order' AS source FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL
SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def _(spark, sf):
    first = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select("o_custkey").distinct().withColumn("source", F.lit("order"))
    second = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")).withColumn("source", F.lit("customer"))
    return joins.prefer(first, second, ["o_custkey"])


@query("j2_set_changes", """
(SELECT o_custkey, o_orderpriority, 'removed' AS kind FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) < 1998 EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) >= 1998))
UNION ALL (SELECT o_custkey, o_orderpriority, 'added' FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) >= 1998 EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE year(o_orderdate) < 1998))""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    return joins.set_changes(o.filter("y < 1998"), o.filter("y >= 1998"), ["o_custkey", "o_orderpriority"])


@query("j4_required_rows", """
SELECT c_custkey, f AS field, 'not_available' AS state FROM customer, (VALUES ('F'), ('O'), ('P')) v(f) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = f)""")
def _(spark, sf):
    present = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("field"))
    return joins.required_rows(table(spark, sf, "customer"), "c_custkey", ["F", "O", "P"], present, F.lit("not_available"))


@query("j4_reasons", f"""
WITH {S.COMPANIES}
SELECT org_number, 'company_profile' AS field, CASE c_custkey % 3 WHEN 0 THEN 'the company''s website links no social profile of its own' WHEN 1 THEN 'the registered website could not be confirmed as the company''s own, so there are no company-owned profiles to read'
  ELSE 'no website is registered with Brønnøysund or was found under the company''s name, so there are no company-owned profiles to read' END AS reason FROM companies UNION ALL
SELECT org_number, 'employee_count', 'Brønnøysund''s register gives no employee count for this company' FROM companies WHERE c_custkey % 2 = 0""")
def _(spark, sf):
    c = derived.companies(spark, sf)
    key = F.col("c_custkey")
    site = assembly.empty_claims(c, "official_website", F.when(key % 3 == 0, "available").when(key % 3 == 1, "ambiguous").otherwise("not_available"))
    site = site.withColumn("value", F.when(F.col("state") == "available", "https://x.no"))
    form = assembly.empty_claims(c.filter("c_custkey % 2 = 0"), "legal_form", F.lit("available"))
    hiring = assembly.empty_claims(c, "hiring_signal", F.lit("available"))
    claims = assembly.with_reasons(site.unionByName(form).unionByName(hiring), c)
    return claims.filter("field IN ('company_profile', 'employee_count')").select("org_number", "field", "reason")


@query("j5_one_per_input", """
SELECT c_custkey, coalesce(max(o_orderstatus), 'failed') AS state FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 3 = 0 GROUP BY 1""")
def _(spark, sf):
    results = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("state"))
    return joins.one_per_input(table(spark, sf, "customer"), results, "c_custkey", "state")
