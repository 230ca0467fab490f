"""Registry records (inventory A4-A7, B21, C26-C33, F14-F16, F2, H3)."""
from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import derived
from factloom.catalog import sql as S
from factloom.catalog.registry import query, table
from factloom.functions import names, registry
from factloom.operators import joins, registry_facts
from factloom.session import materialise

_READ = "c_custkey % 17 <> 0 AND c_custkey % 19 <> 0"


@query("a4_role_rows", f"""
WITH {S.COMPANIES}, r AS (
  SELECT c_custkey, org_number, 'Kari Hansen' || c_custkey AS holder, 'Daglig leder' AS title, (c_custkey % 5 + 2020) || '-02-01' AS changed_on FROM companies UNION ALL
  SELECT c_custkey, org_number, 'Kari Hansen' || c_custkey, 'Styrets leder', '2019-01-01' FROM companies UNION ALL
  SELECT c_custkey, org_number, 'Ola Hansen' || c_custkey, 'Styremedlem', '2019-01-01' FROM companies WHERE c_custkey % 2 <> 0 UNION ALL
  SELECT c_custkey, org_number, 'Per Hansen' || c_custkey, 'Styremedlem', '2019-01-01' FROM companies WHERE c_custkey % 3 <> 0 UNION ALL
  SELECT c_custkey, org_number, 'REVISJON AS', 'Revisor', '2018-01-01' FROM companies)
SELECT org_number, holder, title, changed_on FROM r""")
def _(spark, sf):
    return registry_facts.role_rows(derived.role_responses(spark, sf)).select("org_number", "holder", "title", "changed_on")


@query("c27_role_facts", f"""
WITH {S.COMPANIES}
SELECT org_number, 'REVISJON AS (Revisor, org. no. 999999999)' AS value, '2018-01-01' AS effective_date, '"navn":["REVISJON AS"' AS evidence_span FROM companies UNION ALL
SELECT org_number, 'Kari Hansen' || c_custkey || ' (Daglig leder)', (c_custkey % 5 + 2020) || '-02-01', '"fornavn":"Kari","etternavn":"Hansen' || c_custkey || '"' FROM companies""")
def _(spark, sf):
    facts = registry_facts.role_facts(derived.role_responses(spark, sf))
    return facts.filter("value LIKE '%(Revisor%' OR value LIKE '%(Daglig leder)'").select("org_number", "value", "effective_date", "evidence_span")


@query("b51_no_private_fields", f"""
WITH {S.COMPANIES} SELECT count(*) AS people, CAST(0 AS BIGINT) AS with_birth_date FROM (
  SELECT 1 FROM companies UNION ALL SELECT 1 FROM companies UNION ALL SELECT 1 FROM companies WHERE c_custkey % 2 <> 0 UNION ALL SELECT 1 FROM companies WHERE c_custkey % 3 <> 0)""")
def _(spark, sf):
    facts = registry_facts.role_facts(derived.role_responses(spark, sf)).filter("value NOT LIKE 'REVISJON%'")
    everything = F.concat_ws("|", *[F.col(c).cast("string") for c in facts.columns])
    return facts.agg(F.count(F.lit(1)).alias("people"), F.count_if(everything.contains("1970-01-01")).alias("with_birth_date"))


@query("a6_workplaces", f"""
WITH {S.COMPANIES}, units AS (SELECT *, unnest([1, 2]) AS page FROM companies WHERE c_custkey % 13 <> 0 AND c_custkey % 9 <> 0)
SELECT org_number, legal_name || ' AVD ' || page || CASE WHEN c_custkey % 4 = 0 THEN ' (' || town || ', ' ELSE ', Havnegata ' || page || ', 0150 ' || town || ' (' END || employees || ' ansatte)' AS value,
  'https://data.brreg.no/enhetsregisteret/api/underenheter/' || (800000000 + c_custkey * 2 + page - 1) AS source_url FROM units UNION ALL
SELECT org_number, legal_name || ' (Storgata ' || c_custkey || ', ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ' ' || town || ')', 'https://data.brreg.no/enhetsregisteret/api/enheter/' || org_number
FROM companies WHERE c_custkey % 9 = 0 AND c_custkey % 13 <> 0 AND {_READ} AND c_custkey % 23 <> 0""")
def _(spark, sf):
    entities = registry_facts.resolve(derived.entity_responses(spark, sf))
    return registry_facts.workplace_facts(derived.subunit_responses(spark, sf), entities).select("org_number", "value", "source_url")


@query("c30_subunit_numbers", f"""
WITH {S.COMPANIES} SELECT org_number, CAST(800000000 + c_custkey * 2 + page - 1 AS VARCHAR) AS unit_number FROM companies, (VALUES (1), (2)) p(page) WHERE c_custkey % 13 <> 0 AND c_custkey % 9 <> 0""")
def _(spark, sf):
    entities = registry_facts.resolve(derived.entity_responses(spark, sf))
    return registry_facts.subunit_numbers(registry_facts.workplace_facts(derived.subunit_responses(spark, sf), entities))


@query("c30_workplace_spans", f"""
WITH {S.COMPANIES} SELECT org_number, '"beliggenhetsadresse":{{"adresse":["Havnegata ' || page || '"],"kommune":"' || town || '","postnummer":"0150","poststed":"' || town || '"}}' AS evidence_span
FROM companies, (VALUES (1), (2)) p(page) WHERE c_custkey % 13 <> 0 AND c_custkey % 9 <> 0 AND c_custkey % 4 <> 0""")
def _(spark, sf):
    facts = registry_facts.workplace_facts(derived.subunit_responses(spark, sf), registry_facts.resolve(derived.entity_responses(spark, sf)))
    return facts.filter("evidence_span LIKE '\"beligg%'").select("org_number", "evidence_span")


@query("a7_update_events", f"""
WITH {S.COMPANIES}, e AS (
  SELECT org_number, '20' || lpad(CAST(c_custkey % 13 + n AS VARCHAR), 2, '0') || '-0' || (n + 1) || '-10' AS day, CASE WHEN c_custkey % 2 = 0 THEN 'Endring' ELSE 'Ny' END AS change, n FROM companies, range(0, 5) r(n))
SELECT org_number, 'Registry record updated (' || change || ') on ' || day || ' - Brønnøysundregistrene' AS value,
  '"dato":"' || day || 'T08:00:00.000Z","endringstype":"' || change || '"' AS evidence_span, day AS effective_date FROM e WHERE n >= 2""")
def _(spark, sf):
    return registry_facts.update_facts(derived.update_responses(spark, sf)).select("org_number", "value", "evidence_span", "effective_date")


@query("c31_newest_events", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 3""")
def _(spark, sf):
    from factloom.operators.ordered import top_k

    return top_k(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts").desc(), "event_id"], 3).select("user_id", "event_id")


_CANNED = """
  SELECT org_number, 'founded_date' AS field, (c_custkey % 24 + 1990) || '-03-15' AS value FROM companies WHERE read UNION ALL
  SELECT org_number, 'dated_activity', 'Founded on ' || (c_custkey % 24 + 1990) || '-03-15 - Brønnøysundregistrene' FROM companies WHERE read UNION ALL
  SELECT org_number, 'industry', '62.010 Trade in ' || p_name FROM companies WHERE read UNION ALL
  SELECT org_number, 'employee_count', CAST(employees AS VARCHAR) FROM companies WHERE read AND c_custkey % 11 <> 0 UNION ALL
  SELECT org_number, 'legal_form', legal_form FROM companies WHERE read UNION ALL
  SELECT org_number, 'legal_name_registry', legal_name FROM companies WHERE read UNION ALL
  SELECT org_number, 'official_site_registry', 'https://' || website FROM companies WHERE read AND website IS NOT NULL UNION ALL
  SELECT org_number, 'operating_status', CASE WHEN c_acctbal < -900 THEN 'Bankrupt' WHEN c_acctbal < -500 THEN 'In liquidation' ELSE 'Active' END FROM companies WHERE read AND c_custkey % 13 <> 0 UNION ALL
  SELECT org_number, 'business_description', CASE WHEN c_custkey % 3 = 0 THEN 'Production of ' || p_name || ' and related services' ELSE 'The purpose is trade in ' || p_name END FROM companies WHERE read"""


@query("c32_live_details", f"""
WITH {S.COMPANIES.replace("companies AS (", "every AS (")}, companies AS (SELECT *, {_READ} AS read FROM every) {_CANNED}""")
def _(spark, sf):
    return registry_facts.live_facts(derived.entity_responses(spark, sf)).select("org_number", "field", "value")


@query("c26_quotes", f"""
WITH {S.COMPANIES}
SELECT org_number, 'founded_date' AS field, '"stiftelsesdato":"' || (c_custkey % 24 + 1990) || '-03-15"' AS evidence_span FROM companies WHERE {_READ} UNION ALL
SELECT org_number, 'employee_count', '"antallAnsatte":' || employees FROM companies WHERE {_READ} AND c_custkey % 11 <> 0 UNION ALL
SELECT org_number, 'industry', '"naeringskode1":{{"kode":"62.010","beskrivelse":"Trade in ' || p_name || '"}}' FROM companies WHERE {_READ} UNION ALL
SELECT org_number, 'operating_status', CASE WHEN c_acctbal < -900 THEN '"konkurs":true' WHEN c_acctbal < -500 THEN '"underAvvikling":true' ELSE '"konkurs":false' END FROM companies WHERE {_READ} AND c_custkey % 13 <> 0""")
def _(spark, sf):
    facts = registry_facts.live_facts(derived.entity_responses(spark, sf))
    return facts.filter("field IN ('founded_date', 'employee_count', 'industry', 'operating_status')").select("org_number", "field", "evidence_span")


@query("c32_former_names", f"""
WITH {S.COMPANIES}, f AS (
  SELECT org_number, 'OLD ' || legal_name AS name, (c_custkey % 20 + 2000) || '-05-0' || (c_custkey % 9 + 1) AS until FROM companies WHERE {_READ} UNION ALL
  SELECT org_number, 'SECOND NAME AS', CASE WHEN c_custkey % 23 <> 0 THEN '1995-02-03' END FROM companies WHERE {_READ} UNION ALL
  SELECT org_number, 'FIRST NAME AS', CASE WHEN c_custkey % 23 <> 0 THEN '1992-02-03' END FROM companies WHERE {_READ})
SELECT * FROM f""")
def _(spark, sf):
    return registry_facts.former_names(derived.entity_responses(spark, sf)).select("org_number", "name", "until")


@query("c32_rename_events", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Renamed from ''OLD ' || legal_name || ''' on ' || (c_custkey % 20 + 2000) || '-05-0' || (c_custkey % 9 + 1) || ' - Brønnøysundregistrene' AS value FROM companies WHERE {_READ}""")
def _(spark, sf):
    return registry_facts.rename_facts(derived.entity_responses(spark, sf)).filter("value LIKE 'Renamed from ''OLD%'").select("org_number", "value")


@query("f2_ambiguous_identity", f"""
WITH {S.COMPANIES} SELECT org_number, c_custkey % 23 = 0 AND {_READ} AS ambiguous FROM companies""")
def _(spark, sf):
    return registry_facts.resolve(derived.entity_responses(spark, sf)).select("org_number", (F.col("resolution_state") == "ambiguous").alias("ambiguous"))


@query("b21_site_hints", f"""
WITH {S.COMPANIES}
SELECT org_number, email, '2233' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone, 'Storgata ' || c_custkey AS street, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS postcode, town, town AS municipality
FROM companies WHERE {_READ}""")
def _(spark, sf):
    hints = registry_facts.site_hints(derived.entity_responses(spark, sf))
    return hints.select("org_number", "email", F.array_join("phones", ",").alias("phone"), "street", "postcode", "town", "municipality")


def _universe(spark, sf):
    c = derived.companies(spark, sf)
    return c.select(
        F.col("org_number").alias("organisation_number"), F.col("legal_name").alias("name"), "website", F.col("town").alias("municipality"), F.lit("62.010").alias("industry_code"),
        F.concat(F.lit("Listed "), "p_name").alias("industry_label"), F.col("employees").cast("int").alias("employees"), "legal_form", (F.col("c_acctbal") < -900).alias("bankrupt"),
        (F.col("c_acctbal") < -500).alias("liquidating"),
    )


@query("c33_listed_identity", f"""
WITH {S.COMPANIES}
SELECT org_number, 'industry' AS field, '62.010 Listed ' || p_name AS value FROM companies UNION ALL SELECT org_number, 'employee_count', CAST(employees AS VARCHAR) FROM companies UNION ALL
SELECT org_number, 'legal_form', legal_form FROM companies UNION ALL
SELECT org_number, 'operating_status', CASE WHEN c_acctbal < -900 THEN 'Bankrupt' WHEN c_acctbal < -500 THEN 'In liquidation' ELSE 'Active' END FROM companies""")
def _(spark, sf):
    return registry_facts.universe_facts(_universe(spark, sf), "company-list", F.lit(derived.READ_AT).cast("timestamp")).select("org_number", "field", "value")


@query("f14_live_over_listed", f"""
WITH {S.COMPANIES}
SELECT field, source, count(*) AS facts FROM (
  SELECT 'industry' AS field, CASE WHEN {_READ} THEN 'live' ELSE 'list' END AS source FROM companies UNION ALL
  SELECT 'employee_count', CASE WHEN {_READ} AND c_custkey % 11 <> 0 THEN 'live' ELSE 'list' END FROM companies UNION ALL
  SELECT 'legal_form', CASE WHEN {_READ} THEN 'live' ELSE 'list' END FROM companies UNION ALL
  SELECT 'operating_status', CASE WHEN {_READ} AND c_custkey % 13 <> 0 THEN 'live' ELSE 'list' END FROM companies) GROUP BY ALL""")
def _(spark, sf):
    fields = ["industry", "employee_count", "legal_form", "operating_status"]
    live = registry_facts.live_facts(derived.entity_responses(spark, sf)).filter(F.col("field").isin(fields))
    listed = registry_facts.universe_facts(_universe(spark, sf), "company-list", F.lit(derived.READ_AT).cast("timestamp"))
    merged = registry_facts.live_over_listed(live, listed)
    return merged.groupBy("field", F.when(F.col("source_url") == "company-list", "list").otherwise("live").alias("source")).agg(F.count(F.lit(1)).alias("facts"))


@query("f1_identity_with_fallback", """
SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'list ' || o_custkey ELSE c_name END AS name, c_mktsegment AS town
FROM orders JOIN customer ON c_custkey = o_custkey""")
def _(spark, sf):
    keys = table(spark, sf, "orders").select("o_custkey")
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    listed = c.filter("o_custkey % 3 = 0").select("o_custkey", F.concat(F.lit("list "), "o_custkey").alias("name"), F.lit(None).cast("string").alias("town"))
    live = c.select("o_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("town"))
    return joins.fill_from(keys, [listed, live], "o_custkey", ["name", "town"])


@query("f15_own_address_cited", f"""
WITH {S.COMPANIES} SELECT org_number, 'https://data.brreg.no/enhetsregisteret/api/enheter/' || org_number AS source_url, starts_with('"forretningsadresse":{{', '"forretningsadresse"') AS quoted
FROM companies WHERE {_READ}""")
def _(spark, sf):
    from factloom import schemas

    responses = derived.entity_responses(spark, sf)
    hints = registry_facts.site_hints(responses)
    own = schemas.conform(hints.select("org_number"), schemas.CONFIRMED_FACT, field=F.lit("workplace"), source_url=F.lit("company-list"))
    return registry_facts.relocate_own_workplace(own, hints).select("org_number", "source_url", F.col("evidence_span").startswith('"forretningsadresse":{').alias("quoted"))


_ANSWERED = "o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 AND o_orderkey % 29 <> 0"


@query("c28_filing_figures", f"""
WITH f AS (SELECT CAST(900000000 + o_orderkey AS VARCHAR) AS org_number, o_orderkey, year(o_orderdate) AS y, round(o_totalprice, 0) AS price FROM orders WHERE {_ANSWERED})
SELECT org_number, 'revenue' AS field, format('{{:,}}', CAST(price AS BIGINT)) || ' NOK' AS value, 'FY' || y AS reporting_period, '"sumDriftsinntekter":' || CAST(price AS BIGINT) AS evidence_span FROM f UNION ALL
SELECT org_number, 'revenue', format('{{:,}}', CAST(trunc(price / 2) AS BIGINT)) || ' NOK', 'FY' || (y - 1), '"sumDriftsinntekter":' || CAST(trunc(price / 2) AS BIGINT) FROM f""")
def _(spark, sf):
    company = registry_facts.company_filings(registry_facts.filing_docs(derived.accounts_responses(spark, sf)))
    return registry_facts.accounts_facts(company).filter("field = 'revenue'").select("org_number", "field", "value", "reporting_period", "evidence_span")


@query("c28_filing_lines", f"""
WITH f AS (SELECT CAST(900000000 + o_orderkey AS VARCHAR) AS org_number, o_orderkey, year(o_orderdate) AS y, round(o_totalprice, 0) AS price FROM orders WHERE {_ANSWERED}),
l AS (SELECT *, unnest([0, 1]) AS back FROM f)
SELECT org_number, CASE back WHEN 0 THEN 'annual_accounts_latest' ELSE 'annual_accounts_history' END AS field, 'FY' || (y - back) AS reporting_period,
  'Revenue: ' || format('{{:,}}', CAST(CASE back WHEN 0 THEN price ELSE trunc(price / 2) END AS BIGINT)) || ' NOK' ||
  CASE WHEN o_orderkey % 4 <> 0 THEN '; Net result: ' || format('{{:,}}', CAST(trunc(price / 10 - 20000) AS BIGINT)) || ' NOK' ELSE '' END AS value FROM l""")
def _(spark, sf):
    company = registry_facts.company_filings(registry_facts.filing_docs(derived.accounts_responses(spark, sf)))
    return registry_facts.accounts_facts(company).filter("field LIKE 'annual_accounts_%'").select("org_number", "field", "reporting_period", "value")


@query("c28_wide_to_long", """
SELECT o_orderkey, metric, amount FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS total, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS DOUBLE) END AS customer FROM orders)
UNPIVOT (amount FOR metric IN (total, customer))""")
def _(spark, sf):
    wide = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("double")).alias("customer"))
    return registry_facts.figure_rows(wide, ["o_orderkey"], ["total", "customer"])


@query("c29_filing_slices", f"""
SELECT CAST(900000000 + o_orderkey AS VARCHAR) AS org_number, count(*) AS slices FROM orders, range(0, 3) r(n) WHERE {_ANSWERED} GROUP BY 1""")
def _(spark, sf):
    rows = registry_facts.filings(derived.accounts_responses(spark, sf)).filter(F.col("filing_text").contains("journalnr"))
    return rows.groupBy("org_number").agg(F.count(F.lit(1)).alias("slices"))


@query("f16_cited_to_year", f"""
SELECT CAST(900000000 + o_orderkey AS VARCHAR) AS org_number, CASE WHEN o_orderkey % 2 = 0 THEN 'year' ELSE 'list' END AS cited, CAST(year(o_orderdate) AS VARCHAR) || '-12-31' AS period_end FROM orders WHERE {_ANSWERED}
UNION ALL SELECT CAST(900000000 + o_orderkey AS VARCHAR), 'list', CAST(year(o_orderdate) - 1 AS VARCHAR) || '-12-31' FROM orders WHERE {_ANSWERED}""")
def _(spark, sf):
    docs = registry_facts.filing_docs(derived.accounts_responses(spark, sf))
    picked = materialise(registry_facts.picked_filings(docs), "picked-filings")  # four branches read them
    company = registry_facts.with_figures(picked)
    newest = company.filter("rank = 1").withColumn("url", F.lit("year"))
    own_year = newest.drop("rank").filter("CAST(org_number AS BIGINT) % 2 = 0")
    twice = newest.drop("rank").filter("CAST(org_number AS BIGINT) % 2 = 1")
    cited = registry_facts.cited_to_own_response(company, own_year.unionByName(twice).unionByName(twice))
    return cited.select("org_number", F.when(F.col("url") == "year", "year").otherwise("list").alias("cited"), "period_end")


@query("h3_preferred_filings", """
WITH f AS (SELECT o_custkey, year(o_orderdate) AS period, o_orderstatus = 'P' AS is_group, o_orderkey FROM orders),
one AS (SELECT o_custkey, period, arg_min(o_orderkey, CAST(is_group AS INT) * 1000000000000 + o_orderkey) AS o_orderkey FROM f GROUP BY ALL)
SELECT o_custkey, CAST(period AS INT) AS period, o_orderkey, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY period DESC) AS rank FROM one) WHERE rank <= 2""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("period"), "o_orderstatus", "o_orderkey")
    return registry_facts.preferred_filings(o, ["o_custkey"], "period", F.col("o_orderstatus") == "P", ["o_orderkey"], 2).select("o_custkey", "period", "o_orderkey", "rank")
