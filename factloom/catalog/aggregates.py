"""Aggregates, data-quality rules, scoring (inventory E28, F20, G1-G19, O1-O4, P5)."""
from __future__ import annotations

from pyspark.sql import functions as F

from factloom import schemas
from factloom.catalog import derived
from factloom.catalog import sql as S
from factloom.catalog.registry import query, table
from factloom.functions import fixed, registry, social, text, urls
from factloom.operators import curation, evidence, pages, quality, scoring
from factloom.plans import assembly, summary
from factloom.streaming import feeds


def _claims(spark, sf):
    return derived.claims_of_events(spark, sf)


@query("g1_unique_claims", """
WITH c AS (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS value, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') END AS period, event_id FROM events)
SELECT CAST(user_id AS VARCHAR) AS org_number, event_type AS field, CAST(value AS VARCHAR) AS value, period AS reporting_period, min(event_id) AS event_id FROM c GROUP BY ALL""")
def _(spark, sf):
    c = _claims(spark, sf).withColumn("reporting_period", F.when(F.col("event_id") % 3 == 0, F.col("period")))
    return curation.unique_claims(c, ["org_number", "field"], ["event_id"]).select("org_number", "field", "value", "reporting_period", "event_id")


@query("g2_unique_profiles", f"""
SELECT {S.host()} AS org_number, min(page_id) AS page_id, 'https://www.facebook.com/acct' || (page_id % 7) AS profile FROM pages GROUP BY 1, 3""")
def _(spark, sf):
    kind, account = F.col("page_id") % 3, derived.words("acct", F.col("page_id") % 7)
    value = F.when(kind == 0, derived.words("https://facebook.com/", account)).when(kind == 1, derived.words("https://www.facebook.com/", F.upper(account), "/")).otherwise(
        derived.words("http://m.facebook.com/", account, "?ref=x"))
    c = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("org_number"), "page_id", value.alias("value"))
    return curation.unique_profiles(c, ["org_number"], ["page_id"]).select("org_number", "page_id", F.lower(social.canonical(F.col("value"))).alias("profile"))


@query("g4_shared_links", f"""
WITH {S.LINKS} SELECT {S.host()} AS host, link, count(DISTINCT lower(text) || page_id) AS headlines FROM links GROUP BY ALL HAVING count(DISTINCT lower(text) || page_id) > 1""")
def _(spark, sf):
    from factloom.operators import links

    found = links.page_links(table(spark, sf, "pages")).withColumn("host", urls.host(F.col("page_url")))
    return curation.shared_links(found, ["host"], F.col("link"), F.concat("text", "page_id"))


@query("g5_first_of_field", """
SELECT CAST(user_id AS VARCHAR) AS org_number, event_type AS field, min(event_id) AS event_id, arg_min(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), event_id) AS value FROM events GROUP BY ALL""")
def _(spark, sf):
    return curation.first_of_field(_claims(spark, sf), ["org_number"], "field", ["event_id"]).select("org_number", "field", "event_id", "value")


@query("g6_numbered_evidence", """
WITH f AS (SELECT user_id, event_type, props, min(event_id) AS first FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS evidence_no FROM f)
SELECT event_id, evidence_no FROM events JOIN n USING (user_id, event_type, props)""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "props")
    return evidence.numbered_by_first_use(e, ["user_id"], ["event_type", "props"], ["event_id"], "evidence_no").select("event_id", "evidence_no")


@query("g7_numbered_sources", f"""
WITH p AS (SELECT {S.host()} AS host, page_id, regexp_extract(url, '/([a-z]{{2}})/', 1) AS lang FROM pages), f AS (SELECT host, lang, min(page_id) AS first FROM p GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY first) AS n FROM f), j AS (SELECT p.host, page_id % 3 AS sentence, n FROM p JOIN n ON p.host = n.host AND p.lang = n.lang)
SELECT host, sentence, string_agg('[' || n || ']', '' ORDER BY n) AS marks FROM (SELECT DISTINCT * FROM j) GROUP BY ALL""")
def _(spark, sf):
    p = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"), "page_id", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"))
    numbered = evidence.numbered_by_first_use(p, ["host"], ["lang"], ["page_id"], "n")
    marks = numbered.groupBy("host", (F.col("page_id") % 3).alias("sentence")).agg(F.array_sort(F.collect_set("n")).alias("_n"))
    return marks.select("host", "sentence", F.array_join(F.transform("_n", lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "").alias("marks"))


@query("g8_scores", """
WITH r AS (SELECT l.doc_id, l.quality, l.toxic, d.doc_id IS NOT NULL AND l.doc_id % 5 <> 0 AS published, l.quality = 1 AS correct, 1 + l.toxic AS expected, 1 AS hits FROM labels l LEFT JOIN documents d USING (doc_id)),
c AS (SELECT count(*) AS labels, count(*) FILTER (WHERE published) AS published, count(*) FILTER (WHERE published AND correct) AS correct, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(CASE WHEN correct THEN hits ELSE 0 END) AS BIGINT) AS hits FROM r)
SELECT *, round(correct / labels * 100, 6) AS company_recall, round(hits / expected * 100, 6) AS claim_recall, round(correct / published * 100, 6) AS precision,
  round(35.0 * (0.7 * (correct / labels) + 0.3 * (hits / expected)), 6) AS coverage,
  35.0 * (0.7 * (correct / labels) + 0.3 * (hits / expected)) >= 21 AND correct / labels * 100 >= 60 AND correct / published * 100 >= 95 AS meets_targets FROM c""")
def _(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", F.lit(True).alias("_d")), "doc_id", "left")
    published = F.coalesce(F.col("_d"), F.lit(False)) & (F.col("doc_id") % 5 != 0)
    rated = scoring.scores(joined, published, F.col("quality") == 1, (1 + F.col("toxic")).cast("bigint"), F.lit(1).cast("bigint"))
    return rated.withColumns({c: F.round(c, 6) for c in ("company_recall", "claim_recall", "precision", "coverage")})


@query("f20_labels_to_documents", """
SELECT l.doc_id, l.quality, d.doc_id IS NOT NULL AS published, d.lang FROM labels l LEFT JOIN documents d USING (doc_id)""")
def _(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", F.lit(True).alias("_d")), "doc_id", "left")
    return joined.select("doc_id", "quality", F.coalesce("_d", F.lit(False)).alias("published"), "lang")


@query("g8_label_matches", f"""
WITH {S.COMPANIES} SELECT org_number, c_custkey % 3 <> 2 AS published, c_custkey % 3 = 0 AS correct FROM companies""")
def _(spark, sf):
    c = derived.companies(spark, sf)
    kind = F.col("c_custkey") % 3
    swapped = F.concat(F.lit("as "), F.reverse(F.split("p_name", " "))[0], F.lit(" "), F.substring_index("p_name", " ", 1))
    published = c.filter(kind != 2).select("org_number", F.when(kind == 0, swapped).otherwise("Noe helt annet firma").alias("name"))
    labels = c.select("org_number", F.concat(F.upper("p_name"), F.lit(" AS")).alias("expected"))
    return scoring.label_results(labels, published, "org_number", "expected", "name").select("org_number", "published", "correct")


@query("g8_expected_claims", """
SELECT CAST(user_id AS VARCHAR) AS org_number, field, bool_or(event_type = field AND contains(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), '7')) AS found
FROM events, (VALUES ('view'), ('click')) f(field) GROUP BY ALL""")
def _(spark, sf):
    c = _claims(spark, sf)
    labels = c.select("org_number").distinct().withColumn("expected_fields", F.create_map(F.lit("view"), F.lit("7"), F.lit("click"), F.lit("7")))
    return scoring.expected_claims(labels, c, "org_number", "expected_fields").select("org_number", "field", "found")


@query("g9_document_audit", """
WITH f AS (SELECT doc_id, length(text) > 500 AS too_long, lang NOT IN ('en', 'fr') AS bad_state FROM documents)
SELECT count(DISTINCT doc_id) AS records, CAST(0 AS BIGINT) AS workplaces, count(*) AS hiring_signals, count(*) FILTER (WHERE doc_id % 4 = 0) AS disqualifiers, count(*) FILTER (WHERE too_long) AS warnings,
  count(*) FILTER (WHERE bad_state) AS bad_states, count(*) FILTER (WHERE doc_id % 4 = 0) = 0 AND count(*) FILTER (WHERE bad_state) = 0 AS passed FROM f""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    c = d.select(
        F.col("doc_id").cast("string").alias("org_number"), F.lit("hiring_signal").alias("field"), F.col("text").alias("value"),
        F.when(F.col("lang").isin("en", "fr"), "available").otherwise(F.col("lang")).alias("state"), F.when(F.col("doc_id") % 2 == 0, "https://www.obos.no/jobb").otherwise("https://x.no").alias("source"),
    )
    named = d.select(F.col("doc_id").cast("string").alias("org_number"), F.when(F.col("doc_id") % 4 == 0, "Solsiden borettslag").otherwise("Solsiden AS").alias("legal_name"))
    return quality.audit(quality.audit_flags(c, named))


@query("e28_audit_flags", """
SELECT doc_id, length(text) > 500 AS too_long, lang = 'de' AS junk_hiring FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    c = d.select(
        F.col("doc_id").cast("string").alias("org_number"), "doc_id", F.lit("hiring_signal").alias("field"), F.when(F.col("lang") == "de", " Ledige Stillinger ").otherwise(F.col("text")).alias("value"),
        F.lit("available").alias("state"), F.lit(None).cast("string").alias("source"),
    )
    flagged = quality.audit_flags(c, c.select("org_number", F.lit("X AS").alias("legal_name")))
    return flagged.join(d.select("doc_id", "text"), "doc_id").select("doc_id", (F.length("text") > 500).alias("too_long"), "junk_hiring")


@query("g10_chunk_totals", """
SELECT CAST(event_id // 1000 AS BIGINT) AS chunk, count(*) AS requests, count(DISTINCT user_id) AS inputs, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.floor(F.col("event_id") / 1000).alias("chunk")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("user_id").alias("inputs"), F.count_if(F.col("event_type") == "error").alias("failures")
    )


@query("g12_merged_roles", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Led by Kari Hansen' || c_custkey || ' (managing director, chair of the board)' ||
  CASE WHEN c_custkey % 2 <> 0 THEN ' and Ola Hansen' || c_custkey || ' (board member)' WHEN c_custkey % 3 <> 0 THEN ' and Per Hansen' || c_custkey || ' (board member)' ELSE '' END ||
  ', with ' || (1 + CASE WHEN c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 THEN 1 ELSE 0 END) || ' more registered role holder' || CASE WHEN c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 THEN 's' ELSE '' END || '.' AS leadership_text FROM companies""")
def _(spark, sf):
    from factloom.operators import registry_facts

    claims = assembly.ordered_claims(assembly.available_claims(registry_facts.role_facts(derived.role_responses(spark, sf))))
    return summary.leadership(claims).select("org_number", "leadership_text")


@query("g13_newest_per_group", """
SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY ALL""")
def _(spark, sf):
    from factloom.operators.ordered import latest

    return latest(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"])


@query("g14_distinct_platforms", """
WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first) AS n FROM f)
SELECT CAST(user_id AS VARCHAR) AS org_number, string_agg(event_type, ', ' ORDER BY n) AS platforms FROM r WHERE n <= 4 GROUP BY user_id""")
def _(spark, sf):
    from factloom.operators.ordered import first_wins

    c = _claims(spark, sf).select("org_number", "field", "event_id")
    once = first_wins(c, ["org_number", "field"], ["event_id"])
    return summary._first_n(once, ["event_id"], 4, F.col("field"), "_p").select("org_number", F.array_join("_p", ", ").alias("platforms"))


@query("g15_feed_report", """
SELECT count(DISTINCT event_id // 100) AS pages, count(*) AS events, count(*) FILTER (WHERE event_type = 'view') AS active, bool_or(event_id // 100 >= 80) AS truncated FROM events
WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("page_no", F.floor(F.col("event_id") / 100))
    window = feeds.feed_window(e, "ts", F.lit("2024-01-31").cast("timestamp"), "page_no", days=20)
    return feeds.window_report(window, "page_no", F.col("event_type") == "view")


@query("g17_run_health", """
WITH s AS (SELECT event_type AS field, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'available' END AS state FROM events)
SELECT coalesce(field, 'all') AS field, coalesce(state, 'all') AS state, count(*) AS n FROM s GROUP BY ROLLUP (field, state)""")
def _(spark, sf):
    c = table(spark, sf, "events").select(F.col("event_type").alias("field"), F.when(F.col("event_id") % 4 == 0, "failed").otherwise("available").alias("state"))
    return quality.run_health(c, "field", "state")


@query("g18_area_coverage", """
SELECT c_custkey, CAST(coalesce(max(CAST(o_orderstatus = 'F' AS INT)), 0) AS INT) AS filed, CAST(coalesce(max(CAST(o_orderstatus = 'O' AS INT)), 0) AS INT) AS open, CAST(coalesce(max(CAST(o_orderstatus = 'P' AS INT)), 0) AS INT) AS pending,
  CAST(coalesce(count(DISTINCT o_orderstatus), 0) AS INT) AS areas_covered FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return quality.area_coverage(table(spark, sf, "customer"), o, "c_custkey", "o_orderstatus", {"filed": ["F"], "open": ["O"], "pending": ["P"]})


@query("g19_side_by_side", """
WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS c FROM customer GROUP BY ALL)
SELECT c_mktsegment, max(CASE WHEN c_nationkey = 1 THEN c END) AS "1", max(CASE WHEN c_nationkey = 2 THEN c END) AS "2", max(CASE WHEN c_nationkey = 3 THEN c END) AS "3",
  count(DISTINCT coalesce(c, -1)) > 1 OR count(*) < 3 AS differs FROM n WHERE c_nationkey IN (1, 2, 3) GROUP BY 1""")
def _(spark, sf):
    per_nation = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return quality.side_by_side(per_nation, "c_nationkey", "c_mktsegment", "n", [1, 2, 3])


@query("o1_claim_rules", """
WITH c AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'available' WHEN 'click' THEN 'not_available' WHEN 'error' THEN 'broken' ELSE 'available' END AS state,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS read_ts FROM events)
SELECT rule, count(*) AS claims FROM (SELECT CASE WHEN state = 'broken' THEN 'unknown_state' WHEN state <> 'available' AND value IS NOT NULL THEN 'value_without_availability'
  WHEN state = 'available' AND value IS NULL THEN 'available_without_value' WHEN state = 'available' AND read_ts IS NULL THEN 'available_without_time' ELSE 'good' END AS rule FROM c) GROUP BY rule""")
def _(spark, sf):
    kind, key = F.col("event_type"), F.col("event_id")
    c = table(spark, sf, "events").select(
        "event_id", F.when(kind == "click", "not_available").when(kind == "error", "broken").otherwise("available").alias("state"),
        F.when(key % 3 != 0, F.col("value").cast("string")).alias("value"), F.when(key % 5 != 0, F.col("ts")).alias("retrieved_at"),
    )
    good, bad = quality.split_claims(c)
    return bad.groupBy("rule").agg(F.count(F.lit(1)).alias("claims")).unionByName(good.agg(F.lit("good").alias("rule"), F.count(F.lit(1)).alias("claims")))


@query("o2_refresh_rules", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'first_run_with_previous' WHEN 2 THEN 'first_run_with_changes' ELSE 'refresh_without_previous' END AS rule FROM orders""")
def _(spark, sf):
    kind = F.col("o_orderkey") % 4
    broken = quality.inconsistent_refresh(kind != 3, F.when(kind == 1, F.col("o_orderdate")), F.when(kind == 2, 1).otherwise(0))
    return table(spark, sf, "orders").select("o_orderkey", broken.alias("rule"))


@query("o3_verbatim_spans", f"""
WITH s AS (SELECT page_id, page_id % 3 AS kind, html, substr(html, 50, 40) AS cut FROM pages)
SELECT kind, count(*) FILTER (WHERE kind <> 2 AND contains(html, CASE WHEN kind = 1 THEN cut || '@@' ELSE cut END)) AS found, count(*) FILTER (WHERE kind = 1) AS missing, count(*) FILTER (WHERE kind = 2) AS unchecked FROM s GROUP BY kind""")
def _(spark, sf):
    kind = F.col("page_id") % 3
    p = table(spark, sf, "pages").withColumn("content_hash", pages.content_hash(F.col("html")))
    spans = p.select(
        "page_id", kind.alias("kind"), F.when(kind == 2, "none").otherwise(F.col("content_hash")).alias("content_hash"),
        F.concat(F.substring("html", 50, 40), F.when(kind == 1, "@@").otherwise("")).alias("span"),
    )
    return evidence.verbatim_shares(evidence.span_checks(spans, p, "content_hash", "span", "html"), ["kind"])


@query("o4_rewritten_partitions", """
SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS run_year FROM orders WHERE year(o_orderdate) = 1997""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("run_year", F.year("o_orderdate"))
    after = o.withColumn("o_totalprice", F.when(F.col("run_year") == 1997, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))).unionByName(o.withColumn("run_year", F.lit(2030)))
    columns = ["o_orderkey", "o_totalprice"]
    changed = quality.rewritten_partitions(quality.partition_totals(o, ["run_year"], columns), quality.partition_totals(after, ["run_year"], columns), ["run_year"])
    return changed.select("run_year")


@query("p5_claim_constructors", """
SELECT field, state, count(*) AS claims, count(value) AS with_value, count(retrieved_at) AS with_time FROM (
  SELECT event_type AS field, 'available' AS state, CAST(value AS VARCHAR) AS value, ts AS retrieved_at FROM events WHERE event_type <> 'error' UNION ALL
  SELECT 'error', 'failed', NULL, NULL FROM events WHERE event_type = 'error') GROUP BY ALL""")
def _(spark, sf):
    e = table(spark, sf, "events")
    good = e.filter("event_type <> 'error'").select(
        F.col("user_id").cast("string").alias("org_number"), F.col("event_type").alias("field"), F.col("value").cast("string").alias("value"), F.lit("https://x.no").alias("source_url"), F.col("ts").alias("retrieved_at"))
    none = e.filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("org_number"))
    claims = assembly.available_claims(good).unionByName(assembly.empty_claims(none, "error", F.lit("failed")))
    return claims.groupBy("field", "state").agg(F.count(F.lit(1)).alias("claims"), F.count("value").alias("with_value"), F.count("retrieved_at").alias("with_time"))
