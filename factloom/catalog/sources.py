"""Scans and sinks (inventory A)."""
from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import derived
from factloom.catalog import sql as S
from factloom.catalog.registry import query, table
from factloom.functions import urls
from factloom.operators import pages as pages_ops
from factloom.operators import quality, registry_facts
from factloom.sources import sinks, tables
from factloom.streaming import feeds


@query("a8_feed_items_in_window", """
SELECT CAST(event_id // 100 AS BIGINT) AS page_no, count(*) AS items, count(*) FILTER (WHERE event_type = 'view') AS active,
       bool_or(event_id // 100 >= 80) AS truncated
FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("page_no", F.floor(F.col("event_id") / 100))
    window = feeds.feed_window(e, "ts", F.lit("2024-01-31").cast("timestamp"), "page_no", days=20)
    return window.groupBy("page_no").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("event_type") == "view").alias("active"), F.max("truncated").alias("truncated")
    )


@query("a9_page_scan", f"SELECT {S.host()} AS org_number, page_id AS page_ord, url, CAST(length(html) AS BIGINT) AS chars, 'available' AS fetch_state FROM pages")
def _(spark, sf):
    scanned = tables.as_pages(table(spark, sf, "pages"), "page_id", "url", "html")
    return scanned.select("org_number", "page_ord", "url", F.length("raw_html").cast("bigint").alias("chars"), "fetch_state")


@query("a10_page_store", """
WITH store AS (SELECT url, page_id % 3 AS bucket, html, page_id AS load FROM pages),
fetched AS (SELECT url, page_id % 2 AS bucket, upper(url) AS html, page_id + 1000000 AS load FROM pages),
merged AS (SELECT url, bucket, arg_max(html, load) AS html FROM (SELECT * FROM store UNION ALL SELECT * FROM fetched) GROUP BY ALL)
SELECT 'hit' AS outcome, count(*) AS pages, CAST(sum(length(m.html)) AS BIGINT) AS chars
FROM (SELECT DISTINCT url, page_id % 4 AS bucket FROM pages) r JOIN merged m USING (url, bucket)
UNION ALL
SELECT 'miss', count(*), CAST(coalesce(sum(length(r.url)), 0) AS BIGINT)
FROM (SELECT DISTINCT url, page_id % 4 AS bucket FROM pages) r WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.url = r.url AND m.bucket = r.bucket)""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    store = p.select("url", (F.col("page_id") % 3).alias("bucket"), "html", F.col("page_id").alias("load"))
    fetched = p.select("url", (F.col("page_id") % 2).alias("bucket"), F.upper("url").alias("html"), (F.col("page_id") + 1000000).alias("load"))
    merged = sinks.store_put(store, fetched, "url", "bucket", "load")
    hits, misses = sinks.store_lookup(p.select("url", (F.col("page_id") % 4).alias("bucket")).distinct(), merged, "url", "bucket")
    return hits.agg(F.lit("hit").alias("outcome"), F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).alias("chars")).unionByName(
        misses.agg(F.lit("miss").alias("outcome"), F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.length("url")), F.lit(0)).alias("chars"))
    )


@query("a14_run_report", """
SELECT count(*) AS requests, count(DISTINCT user_id) AS inputs, count(DISTINCT event_id // 100) AS chunks,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS spend, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events""")
def _(spark, sf):
    report = quality.run_totals(
        table(spark, sf, "events"), "user_id", F.floor(F.col("event_id") / 100), F.col("value").cast("decimal(18,2)"), F.col("event_type") == "error"
    )
    return report.withColumn("spend", F.col("spend").cast("double"))


@query("a18_content_hash", "SELECT page_id, sha256(html) AS content_hash FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages_ops.content_hash(F.col("html")).alias("content_hash"))


@query("a19_record_hash", """
SELECT c_custkey, sha256('{"c_acctbal":' || c_acctbal || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name
  || '","c_nationkey":' || c_nationkey || '}') AS record_hash FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", registry_facts.canonical_hash(c, c.columns).alias("record_hash"))


@query("a3_entity_states", f"""
WITH {S.COMPANIES}
SELECT org_number,
       CASE WHEN c_custkey % 17 = 0 THEN 'not_available' WHEN c_custkey % 19 = 0 THEN 'failed' WHEN c_custkey % 23 = 0 THEN 'ambiguous' ELSE 'available' END AS resolution_state,
       CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 23 <> 0 THEN legal_name END AS legal_name,
       CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 23 <> 0
            THEN 'Storgata ' || c_custkey || ', ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ' ' || town END AS registered_address,
       CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 23 <> 0 THEN 'https://' || website END AS official_site
FROM companies""")
def _(spark, sf):
    return registry_facts.resolve(derived.entity_responses(spark, sf)).select("org_number", "resolution_state", "legal_name", "registered_address", "official_site")


@query("a5_accounts_states", """
SELECT CAST(900000000 + o_orderkey AS VARCHAR) AS org_number,
       CASE WHEN o_orderkey % 31 = 0 THEN 'not_available' WHEN o_orderkey % 37 = 0 THEN 'failed' WHEN o_orderkey % 29 = 0 THEN 'not_available' ELSE 'available' END AS accounts_state
FROM orders""")
def _(spark, sf):
    return registry_facts.accounts_states(derived.accounts_responses(spark, sf))


@query("a12_append_guard", """
WITH already AS (SELECT DISTINCT o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F')
SELECT count(*) AS new_rows FROM orders s WHERE NOT EXISTS (SELECT 1 FROM already a WHERE a.o_custkey = s.o_custkey AND a.o_orderdate = s.o_orderdate)""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    written = o.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderdate").distinct()
    return o.join(written, ["o_custkey", "o_orderdate"], "left_anti").agg(F.count(F.lit(1)).alias("new_rows"))


@query("a15_slim_lines", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}'
  ELSE '{"c_custkey":' || c_custkey || '}' END AS slim FROM customer""")
def _(spark, sf):
    c = table(spark, sf, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")))
    return c.select("c_custkey", F.to_json(F.struct("c_custkey", "c_name")).alias("slim"))
