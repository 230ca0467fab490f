"""Assembly, summary and envelope (inventory A13, G6, G7, K1-K13, P1-P4)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from factloom import schemas
from factloom.catalog import derived
from factloom.catalog import sql as S
from factloom.catalog.derived import words
from factloom.catalog.registry import query
from factloom.operators import registry_facts
from factloom.plans import assembly, envelope, summary
from factloom.session import materialise

KEY, NAME = F.col("c_custkey"), F.col("p_name")
LIST_CLAIMS = 8  # of an accounts list, about
_WRITTEN: dict[tuple, object] = {}


def _once(spark, sf, label, build):
    """A stage written out once per session and read by every query that needs it: plans over claims stay
    small because they start from a table, as a run's do."""
    key = (spark.sparkContext.applicationId, sf, label)
    if key not in _WRITTEN:
        _WRITTEN[key] = materialise(build(), label, assembly.TASK_CLAIMS)
    return _WRITTEN[key]


RUN_DAY = "2024-06-01"
_READ = "c_custkey % 17 <> 0 AND c_custkey % 19 <> 0"
_KNOWN = f"{_READ} AND c_custkey % 23 <> 0"


def _runs(claims, first=True):
    return claims.select("org_number").distinct().select(
        "org_number", F.lit(RUN_DAY).alias("run_day"), F.lit(first).alias("is_first_run"), F.lit(None if first else "2024-05-01").cast("string").alias("previous_day")
    )


def _registry_claims(spark, sf):
    """(entities, claims) from every kind of registry response but the accounts."""
    entities = _once(spark, sf, "entities", lambda: registry_facts.resolve(derived.entity_responses(spark, sf)))
    facts = _once(spark, sf, "registry-facts", lambda: _registry_facts(spark, sf, entities))
    states = entities.select("org_number", F.lit("not_available").alias("accounts_state"))
    previous = schemas.conform(entities.filter("false"), schemas.CLAIM)
    return entities, _once(spark, sf, "registry-claims", lambda: assembly.build_claims(entities, facts, states, previous))


def _ordered_claims(spark, sf):
    """The same claims with their place, numbered once for every part of a sentence that reads them."""
    claims = _registry_claims(spark, sf)[1]
    return _once(spark, sf, "ordered-registry-claims", lambda: assembly.ordered_claims(claims, claims.count()))


def _registry_facts(spark, sf, entities):
    responses = derived.entity_responses(spark, sf)
    parts = [
        registry_facts.live_facts(responses), registry_facts.rename_facts(responses), registry_facts.role_facts(derived.role_responses(spark, sf)),
        registry_facts.workplace_facts(derived.subunit_responses(spark, sf), entities), registry_facts.update_facts(derived.update_responses(spark, sf)),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _filing_claims(spark, sf):
    def build():
        responses = derived.accounts_responses(spark, sf)
        company = registry_facts.company_filings(registry_facts.filing_docs(responses), assembly.tasks_of(responses.count() * LIST_CLAIMS))
        return assembly.ordered_claims(assembly.available_claims(registry_facts.accounts_facts(company)), together=True)

    return _once(spark, sf, "filing-claims", build)


def _made_claims(spark, sf):
    """A small profile per company with every kind of claim a summary reads."""
    return _once(spark, sf, "made-claims", lambda: _profile_claims(spark, sf))


def _profile_claims(spark, sf):
    rows = derived.companies(spark, sf)
    c = rows.repartition(assembly.tasks_of(rows.count() * 14), "org_number")

    def claim(n, field, value, day=None, source=None, source_class="company_owned", span=None, period=None):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(n).alias("item_ord"), F.lit(field).alias("field"), value.cast("string").alias("value"), (none if day is None else F.lit(day)).alias("effective_date"),
            (F.lit("https://x.no/") if source is None else source).alias("source"), F.lit(source_class).alias("source_class"),
            (none if span is None else span).alias("evidence_span"), (none if period is None else F.lit(period)).alias("reporting_period"),
        )

    record = words("https://data.brreg.no/enhetsregisteret/api/enheter/", F.col("org_number"))
    rows = F.array(
        claim(0, "legal_name", F.col("legal_name"), None, record, "official_registry"), claim(1, "official_website", words("https://www.site", KEY, ".no/"), span=F.when(KEY % 2 == 0, words("Org.nr. ", F.col("org_number")))),
        claim(2, "company_profile", words("https://facebook.com/a", KEY)), claim(3, "company_profile", words("https://linkedin.com/company/a", KEY)), claim(4, "company_profile", words("https://facebook.com/b", KEY)),
        claim(5, "hiring_signal", words("Open role: Selger ", KEY, " - https://x.no/stilling/1")), claim(6, "hiring_signal", words("Open role: Montør - https://x.no/stilling/2")),
        claim(7, "dated_activity", words("Ny fabrikk ", KEY, " (2024-05-02) - https://x.no/nyheter/fabrikk"), "2024-05-02"), claim(8, "dated_activity", F.lit("Gammel sak (2023-05-02) - https://x.no/nyheter/gammel"), "2023-05-02"),
        claim(9, "dated_activity", F.lit("Renamed from 'GAMMEL AS' on 2023-11-01 - Brønnøysundregistrene"), "2023-11-01", record, "official_registry"),
        claim(10, "leader", words("Kari ", KEY, " (Daglig leder)"), "2024-02-01", words(record, "/roller"), "official_registry"), claim(11, "founded_date", F.lit("2023-03-15"), "2023-03-15", record, "official_registry"),
        claim(12, "operating_status", F.when(KEY % 3 == 0, "In liquidation").otherwise("Active"), None, record, "official_registry"), claim(13, "site_description", words("Vi lager ", NAME, ", selger dem og leverer dem")),
    )
    long = c.select("org_number", F.explode(rows).alias("_c")).select("org_number", "_c.*")
    made = schemas.conform(long, schemas.CLAIM, state=F.lit("available"), stage_ord=F.lit(0), page_ord=F.lit(0), retrieved_at=F.lit(derived.READ_AT))
    return assembly.ordered_claims(made, together=True)


@query("p1_legal_name", f"""
WITH {S.COMPANIES}
SELECT org_number, CASE WHEN {_KNOWN} THEN legal_name END AS value, CASE WHEN c_custkey % 17 = 0 THEN 'not_available' WHEN c_custkey % 19 = 0 THEN 'failed' WHEN c_custkey % 23 = 0 THEN 'ambiguous' ELSE 'available' END AS state FROM companies""")
def _(spark, sf):
    return _registry_claims(spark, sf)[1].filter("field = 'legal_name'").select("org_number", "value", "state")


@query("p2_official_site", f"""
WITH {S.COMPANIES}
SELECT org_number, CASE c_custkey % 5 WHEN 0 THEN 'discovered' WHEN 1 THEN 'proof' WHEN 2 THEN NULL WHEN 3 THEN 'https://' || website ELSE NULL END AS value,
  CASE c_custkey % 5 WHEN 2 THEN 'ambiguous' WHEN 4 THEN 'ambiguous' ELSE 'available' END AS state,
  CASE c_custkey % 5 WHEN 2 THEN 'because' WHEN 4 THEN 'Registered website https://www.obos.no: a housing co-op''s registered site is usually its property manager''s' END AS reason FROM companies""")
def _(spark, sf):
    c = derived.companies(spark, sf)
    kind = KEY % 5
    entities = c.select(
        "org_number", F.when(kind == 4, "SOLSIDEN BORETTSLAG").otherwise(F.col("legal_name")).alias("legal_name"), F.when(kind == 4, "https://www.obos.no").otherwise(
            F.concat(F.lit("https://"), "website")).alias("official_site"), F.lit("available").alias("resolution_state"), F.lit("list").alias("source"),
        F.lit(derived.READ_AT).cast("timestamp").alias("retrieved_at"), F.lit(None).cast("string").alias("content_hash"),
    )
    field = F.when(kind == 0, "official_site").when(kind == 1, "official_site_evidence").when(kind == 2, "official_site_unproven").when(kind == 3, "official_site_registry")
    value = F.when(kind == 0, "discovered").when(kind == 1, "proof").when(kind == 2, "because").otherwise(F.concat(F.lit("https://"), "website"))
    facts = schemas.conform(
        c.filter(kind < 4).select("org_number", field.alias("field"), value.alias("value"), F.lit("https://x.no").alias("source_url")), schemas.CONFIRMED_FACT,
        stage_ord=F.lit(0), page_ord=F.lit(0), item_ord=F.lit(0),
    )
    return assembly.official_site_claims(entities, facts).select("org_number", "value", "state", "reason")


@query("p3_b47_brand_part", f"""
WITH {S.COMPANIES}
SELECT org_number, CASE c_custkey % 3 WHEN 0 THEN legal_name WHEN 1 THEN 'Zzzz | Qqqq' END AS value, CASE WHEN c_custkey % 3 = 2 THEN 'not_available' ELSE 'available' END AS state FROM companies""")
def _(spark, sf):
    c = derived.companies(spark, sf)
    kind = KEY % 3
    facts = schemas.conform(
        c.select("org_number", F.lit("organization_name").alias("field"), F.when(kind == 1, "Zzzz | Qqqq").otherwise(words("Hjem - Kvalitet siden 1950 | ", F.col("legal_name"))).alias("value"),
                 F.when(kind == 2, "https://x.no/").alias("linked_from")),
        schemas.CONFIRMED_FACT, stage_ord=F.lit(0), page_ord=F.lit(0), item_ord=F.lit(0),
    )
    return assembly.brand_claims(c.select("org_number", "legal_name"), facts).select("org_number", "value", "state")


@query("p4_profiles", f"""
WITH {S.COMPANIES} SELECT org_number, CAST(part AS INT) AS part, CAST(CASE part WHEN 0 THEN 10 ELSE 4 END AS INT) AS claims FROM companies, (VALUES (0), (1)) p(part)""")
def _(spark, sf):
    claims = _made_claims(spark, sf)
    nested = assembly.profiles(claims, max_claims=10, count=claims.count())
    counted = F.aggregate(F.transform(F.map_values("sections"), lambda s: F.size(s)), F.lit(0), lambda a, n: a + n)
    return nested.select("org_number", "part", counted.alias("claims"))


@query("p4_claims_per_field", f"""
WITH {S.COMPANIES}, f AS (
  SELECT 'legal_name' AS field, 1 AS n FROM companies UNION ALL SELECT 'public_brand', 1 FROM companies UNION ALL SELECT 'official_website', 1 FROM companies UNION ALL SELECT 'annual_accounts_latest', 1 FROM companies UNION ALL
  SELECT 'industry', 1 FROM companies WHERE {_READ} UNION ALL SELECT 'leader', 3 + CASE WHEN c_custkey % 2 <> 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END FROM companies UNION ALL
  SELECT 'company_profile', 1 FROM companies UNION ALL SELECT 'hiring_signal', 1 FROM companies)
SELECT field, CAST(sum(n) AS BIGINT) AS claims FROM f GROUP BY 1""")
def _(spark, sf):
    entities, claims = _registry_claims(spark, sf)
    rows = assembly.ordered_claims(assembly.with_reasons(claims, entities)).groupBy("field").agg(F.count(F.lit(1)).alias("claims"))
    return rows.filter("field IN ('legal_name', 'public_brand', 'official_website', 'annual_accounts_latest', 'industry', 'leader', 'company_profile', 'hiring_signal')")


@query("k1_identity_sentence", f"""
WITH {S.COMPANIES}
SELECT org_number, legal_name || ' (org. no. ' || org_number || ') is a ' || CASE legal_form WHEN 'AS' THEN 'limited company (AS)' WHEN 'ASA' THEN 'public limited company (ASA)' WHEN 'ENK' THEN 'sole proprietorship (ENK)' ELSE 'Norwegian-registered foreign entity (NUF)' END
  || ' in trade in ' || p_name || ', founded ' || (c_custkey % 24 + 1990) ||
  CASE WHEN c_custkey % 13 = 0 AND c_custkey % 11 = 0 THEN '' ELSE '; ' || concat_ws(', ', CASE WHEN c_custkey % 13 <> 0 THEN 'registry status ' || CASE WHEN c_acctbal < -900 THEN 'Bankrupt' WHEN c_acctbal < -500 THEN 'In liquidation' ELSE 'Active' END END,
    CASE WHEN c_custkey % 11 <> 0 THEN employees || ' employees' END) END || '.' AS text FROM companies WHERE {_KNOWN}""")
def _(spark, sf):
    claims = _ordered_claims(spark, sf)
    return summary.scalar_fields(claims).select("org_number", summary.identity_text().alias("text")).filter("text IS NOT NULL")


@query("k2_activity_sentence", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Registered activity: "' || CASE WHEN c_custkey % 3 = 0 THEN 'Production of ' || p_name || ' and related services' ELSE 'The purpose is trade in ' || p_name END || '".' AS text FROM companies WHERE {_READ}""")
def _(spark, sf):
    claims = _ordered_claims(spark, sf)
    return summary.scalar_fields(claims).select("org_number", summary.activity_text().alias("text")).filter("text IS NOT NULL")


def _short(n: str) -> str:
    return f"CASE WHEN abs({n}) >= 1000000 THEN printf('%.1f', {n} / 1e6) || ' m' WHEN abs({n}) >= 10000 THEN printf('%.0f', {n} / 1e3) || ' k' ELSE format('{{:,}}', {n}) END || ' NOK'"


_FILED = """
f AS (SELECT CAST(900000000 + o_orderkey AS VARCHAR) AS org_number, o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(round(o_totalprice, 0) AS BIGINT) AS r, CAST(trunc(round(o_totalprice, 0) / 2) AS BIGINT) AS rb,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(trunc(round(o_totalprice, 0) / 10 - 20000) AS BIGINT) END AS n FROM orders WHERE o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 AND o_orderkey % 29 <> 0)"""


@query("k3_accounts_sentence", f"""
WITH {_FILED}
SELECT org_number, 'In FY' || y || ' (company accounts, year to ' || y || '-12-31), revenue grew ' || printf('%.1f', (r - rb) * 1.0 / rb * 100) || '% on FY' || (y - 1) || ' to ' || {_short("r")} ||
  CASE WHEN n IS NULL THEN '' ELSE ' and the company made a ' || CASE WHEN n >= 0 THEN 'net profit' ELSE 'net loss' END || ' of ' || {_short("abs(n)")} || CASE WHEN abs(n * 1.0 / r * 100) < 1000 THEN ' (' || printf('%.1f', abs(n * 1.0 / r * 100)) || '% of revenue), ' ELSE ', ' END ||
    CASE WHEN n = 0 THEN 'down from 0 NOK in FY' || (y - 1) ELSE 'about the same as in FY' || (y - 1) END END || ' (percentages calculated).' AS text FROM f""")
def _(spark, sf):
    claims = _filing_claims(spark, sf)
    wide = summary.wide_frame(claims)
    return wide.select("org_number", summary.accounts_sentence()["text"].alias("text"))


@query("k9_signals", f"""
WITH {_FILED}
SELECT org_number, 'Revenue up ' || printf('%.0f', (r - rb) * 1.0 / rb * 100) || '% in FY' || y || '.' AS text FROM f UNION ALL
SELECT org_number, 'Net loss in FY' || y || ' (' || {_short("abs(n)")} || ').' FROM f WHERE n < 0""")
def _(spark, sf):
    claims = _filing_claims(spark, sf)
    return summary.signals(claims, _runs(claims), summary.wide_frame(claims)).select("org_number", "text")


@query("k11_headline", f"""
WITH {_FILED} SELECT org_number, 'Org. ' || org_number || ', revenue ' || {_short("r")} || ' (FY' || y || ', up ' || printf('%.0f', (r - rb) * 1.0 / rb * 100) || '%)' AS headline FROM f""")
def _(spark, sf):
    return summary.wide_frame(_filing_claims(spark, sf)).select("org_number", summary.headline().alias("headline"))


@query("k5_workplaces_sentence", f"""
WITH {S.COMPANIES} SELECT org_number, '2 registered sites, including ' || upper(town[1]) || lower(substr(town, 2)) || '.' AS text FROM companies WHERE c_custkey % 9 <> 0 AND c_custkey % 13 <> 0""")
def _(spark, sf):
    claims = _ordered_claims(spark, sf)
    return summary.workplaces(claims).select("org_number", F.col("workplaces_text").alias("text"))


@query("k6_online_sentence", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Online: site' || c_custkey || '.no; Facebook, LinkedIn profiles; 2 open roles, e.g. "Selger ' || c_custkey || '"; latest news "Ny fabrikk ' || c_custkey || '" (2024-05-02).' AS text FROM companies""")
def _(spark, sf):
    claims = _made_claims(spark, sf)
    return summary.online(claims, _runs(claims)).select("org_number", F.col("online_text").alias("text"))


@query("k7_recorded_changes", f"""
WITH {S.COMPANIES} SELECT org_number, 'managing director changed 2024-02-01, renamed from ''GAMMEL AS'' on 2023-11-01' AS text FROM companies""")
def _(spark, sf):
    claims = _made_claims(spark, sf)
    return summary.recorded_changes(claims, _runs(claims)).select("org_number", F.col("record_text").alias("text"))


@query("k8_summary_sentences", f"""
WITH {S.COMPANIES}, s AS (
  SELECT org_number, 0 AS n, 'what_it_does' AS part, 'As of 2024-06-01: ' || legal_name || ' (org. no. ' || org_number || ') is a registered Norwegian entity, founded 2023; registry status ' || CASE WHEN c_custkey % 3 = 0 THEN 'In liquidation' ELSE 'Active' END || '.' AS text FROM companies UNION ALL
  SELECT org_number, 1, 'what_it_does', 'In its own words: "Vi lager ' || p_name || ', selger dem og leverer dem".' FROM companies UNION ALL
  SELECT org_number, 2, 'people_and_presence', 'Led by Kari ' || c_custkey || ' (managing director).' FROM companies UNION ALL
  SELECT org_number, 3, 'people_and_presence', 'Online: site' || c_custkey || '.no; Facebook, LinkedIn profiles; 2 open roles, e.g. "Selger ' || c_custkey || '"; latest news "Ny fabrikk ' || c_custkey || '" (2024-05-02).' FROM companies UNION ALL
  SELECT org_number, 4, 'what_changed', 'First run, so no earlier snapshot to compare with; latest changes on record: managing director changed 2024-02-01, renamed from ''GAMMEL AS'' on 2023-11-01.' FROM companies UNION ALL
  SELECT org_number, 5, 'unknown', 'Not found: annual accounts.' FROM companies)
SELECT org_number, CAST(n AS INT) AS sentence_ord, part, text FROM s""")
def _(spark, sf):
    claims = _made_claims(spark, sf)
    return _summary(claims)[0].select("org_number", "sentence_ord", "part", "text")


def _summary(claims, written=False):
    """(sentences, signals, overview) of first runs."""
    runs = _runs(claims)
    changes = claims.filter("false").select("org_number", "field", F.lit("changed").alias("kind"), F.col("value").alias("old"), F.col("value").alias("new"))
    return summary.build(claims, runs, changes, written)


@query("k9_flags", f"""
WITH {S.COMPANIES}, s AS (
  SELECT org_number, 'Registry status: In liquidation.' AS text FROM companies WHERE c_custkey % 3 = 0 UNION ALL SELECT org_number, 'Managing director changed on 2024-02-01.' FROM companies UNION ALL
  SELECT org_number, 'Renamed on 2023-11-01 (was GAMMEL AS).' FROM companies UNION ALL SELECT org_number, 'Young company: founded 2023-03-15.' FROM companies UNION ALL SELECT org_number, 'Hiring now: 2 open job ads.' FROM companies) SELECT * FROM s""")
def _(spark, sf):
    return _summary(_made_claims(spark, sf))[1].select("org_number", "text")


@query("k10_confidence", f"""
WITH {S.COMPANIES} SELECT org_number, CASE WHEN c_custkey % 2 = 0 THEN 'high' ELSE 'medium' END AS level,
  CASE WHEN c_custkey % 2 = 0 THEN 'the website states the company''s organisation number' ELSE 'the website names the company but does not state its organisation number' END AS why FROM companies""")
def _(spark, sf):
    return _summary(_made_claims(spark, sf))[2].select("org_number", "confidence.level", "confidence.why")


def _envelopes(spark, sf):
    claims = _made_claims(spark, sf)
    built = _summary(claims, written=True)
    sentences, signals, overview = (_once(spark, sf, label, lambda df=df: df) for label, df in zip(("sentences", "signals", "overview"), built))
    texts = claims.filter("false").select("org_number", F.col("value").alias("text"))
    run = claims.select("org_number").distinct().select(
        "org_number", F.lit("run-1").alias("run_id"), F.lit(derived.READ_AT).cast("timestamp").alias("started_at"), F.lit(derived.READ_AT).cast("timestamp").alias("completed_at"))
    return envelope.build(claims, sentences, signals, overview, texts, run)


@query("k12_labelled_text", f"""
WITH {S.COMPANIES}
SELECT org_number AS organisation_number, 'As of 2024-06-01. What it does: ' || legal_name || ' (org. no. ' || org_number || ') is a registered Norwegian entity, founded 2023; registry status ' || CASE WHEN c_custkey % 3 = 0 THEN 'In liquidation' ELSE 'Active' END || '. [1] '
  || 'In its own words: "Vi lager ' || p_name || ', selger dem og leverer dem". [2] People and presence: Led by Kari ' || c_custkey || ' (managing director). [3] Online: site' || c_custkey || '.no; Facebook, LinkedIn profiles; 2 open roles, e.g. "Selger ' || c_custkey
  || '"; latest news "Ny fabrikk ' || c_custkey || '" (2024-05-02). [2] What changed: First run, so no earlier snapshot to compare with; latest changes on record: managing director changed 2024-02-01, renamed from ''GAMMEL AS'' on 2023-11-01. [1][3] Key signals: '
  || CASE WHEN c_custkey % 3 = 0 THEN 'Registry status: In liquidation [1]; ' ELSE '' END || 'Managing director changed on 2024-02-01 [3]; Renamed on 2023-11-01 (was GAMMEL AS) [1]; Young company: founded 2023-03-15 [1]; Hiring now: 2 open job ads [2]. '
  || 'What remains unknown: annual accounts (none filed in the Register of Company Accounts).' AS text FROM companies""")
def _(spark, sf):
    return _envelopes(spark, sf).select("organisation_number", "summary.text")


@query("a13_envelope_lines", f"""
WITH {S.COMPANIES} SELECT org_number AS organisation_number, CAST(14 AS INT) AS claims, CAST(14 AS INT) AS evidence, CAST(3 AS INT) AS sources, true AS nulls_written FROM companies""")
def _(spark, sf):
    built = _envelopes(spark, sf)
    lines = envelope.json_lines(built).select(F.try_parse_json("value").alias("v"), F.col("value").contains('"cant_tell":null').alias("nulls_written"))

    def count(path):
        return F.size(F.try_variant_get("v", path, "array<variant>"))

    return lines.select(
        F.try_variant_get("v", "$.organisation_number", "string").alias("organisation_number"), count("$.claims").alias("claims"), count("$.evidence").alias("evidence"),
        count("$.summary.sources").alias("sources"), "nulls_written",
    )


@query("a15_slim_envelope", f"""
WITH {S.COMPANIES} SELECT org_number AS organisation_number, false AS has_text, false AS has_run, false AS has_nulls FROM companies""")
def _(spark, sf):
    lines = envelope.slim_lines(_envelopes(spark, sf)).select(F.try_parse_json("value").alias("v"), F.col("value").contains(":null").alias("has_nulls"))
    return lines.select(
        F.try_variant_get("v", "$.organisation_number", "string").alias("organisation_number"), F.try_variant_get("v", "$.summary.text", "string").isNotNull().alias("has_text"),
        F.try_variant_get("v", "$.run", "variant").isNotNull().alias("has_run"), "has_nulls",
    )


@query("k13_answers", f"""
WITH {S.COMPANIES}, a AS (
  SELECT org_number, 0 AS n, legal_name AS answer, 'available' AS state FROM companies UNION ALL SELECT org_number, 1, 'No registered industry or employee count available.', 'not_available' FROM companies UNION ALL
  SELECT org_number, 2, CASE WHEN c_custkey % 3 = 0 THEN 'In liquidation' ELSE 'Active' END, 'available' FROM companies UNION ALL SELECT org_number, 3, 'Founded 2023-03-15', 'available' FROM companies UNION ALL
  SELECT org_number, 4, 'https://www.site' || c_custkey || '.no/', 'available' FROM companies UNION ALL SELECT org_number, 5, 'Kari ' || c_custkey || ' (Daglig leder)', 'available' FROM companies UNION ALL
  SELECT org_number, 6, 'Yes, hiring signals found: Open role: Selger ' || c_custkey || ' - https://x.no/stilling/1', 'available' FROM companies UNION ALL SELECT org_number, 7, 'Not available.', 'not_available' FROM companies UNION ALL
  SELECT org_number, 8, 'No registered workplaces available.', 'not_available' FROM companies UNION ALL SELECT org_number, 9, 'Ny fabrikk ' || c_custkey || ' (2024-05-02) - https://x.no/nyheter/fabrikk', 'available' FROM companies UNION ALL
  SELECT org_number, 10, 'This is the first run -- no prior snapshot to compare.', 'not_applicable' FROM companies)
SELECT org_number, CAST(n AS INT) AS question_ord, answer, state FROM a""")
def _(spark, sf):
    claims = _made_claims(spark, sf)
    texts = claims.filter("false").select("org_number", F.col("value").alias("text"))
    return summary.answers(claims, _runs(claims), texts, count=claims.count()).select("org_number", "question_ord", "answer", "state")
