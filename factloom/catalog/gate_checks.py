"""Identity gates (inventory E1-E9, E14, E21-E28)."""
from __future__ import annotations

from pyspark.sql import functions as F

from factloom import schemas
from factloom.catalog import derived
from factloom.catalog import sql as S
from factloom.catalog.derived import words as _text
from factloom.catalog.registry import query, table
from factloom.functions import fixed, urls
from factloom.operators import curation, gates, linkage

KEY, NAME = F.col("c_custkey"), F.col("p_name")
_SITE = "'https://' || replace(p_name, ' ', '') || '.no'"


def _entities(spark, sf):
    c = derived.companies(spark, sf)
    site = _text("https://", F.replace("p_name", F.lit(" "), F.lit("")), ".no", F.when(KEY % 7 == 0, "/avdeling/x").otherwise(""))
    name = F.when(KEY % 5 == 0, _text(NAME, " borettslag")).otherwise(F.col("legal_name"))
    return c.select(
        "org_number", "c_custkey", "p_name", name.alias("legal_name"), F.when(KEY % 11 != 0, F.when(KEY % 5 == 0, "https://www.obos.no").otherwise(site)).alias("official_site"),
        F.lit("Kai 1, 5003 BERGEN").alias("registered_address"),
    )


def _raw_facts(spark, sf):
    """Eight facts per company, one per rule of the gate."""
    e = _entities(spark, sf)
    joined = F.replace("p_name", F.lit(" "), F.lit(""))
    site = F.when(KEY % 5 == 0, "https://obos.no").otherwise(_text("https://www.", joined, ".no"))
    account = _text("https://www.facebook.com/", joined)

    def fact(n, field, value, source=None, linked=None, context=None):
        none = F.lit(None).cast("string")
        return F.struct(
            F.lit(n).alias("item_ord"), F.lit(field).alias("field"), value.alias("value"), (_text(site, "/om") if source is None else source).alias("source_url"),
            (none if linked is None else linked).alias("linked_from"), (none if context is None else context).alias("context_name"),
        )

    facts = F.array(
        fact(0, "organization_name", _text("Velkommen til ", F.col("legal_name"))), fact(1, "organization_name", F.lit("Helt Annet Firma i Tromsø")),
        fact(2, "dated_activity", F.lit("News"), F.lit("https://elsewhere.no/")), fact(3, "hiring_signal", F.lit("Job ad: https://x"), F.lit("https://jobs.lever.co/x"), _text(site, "/")),
        fact(4, "dated_activity", F.lit("Item"), context=F.lit("Borettslagenes Landsforbund BBL")), fact(5, "company_profile", account, context=F.lit("Noe Helt Annet Selskap")),
        fact(6, "company_profile", _text(account, "bergen")), fact(7, "official_site", F.lit("https://template-agency.com/")),
    )
    rows = e.select("org_number", F.explode(facts).alias("_f")).select("org_number", "_f.*")
    return schemas.conform(rows, schemas.RAW_FACT, stage_ord=F.lit(0), page_ord=F.lit(0), extracted_at=F.lit(derived.READ_AT))


_JUDGED = f"""
WITH {S.COMPANIES}, f AS (SELECT *, unnest(range(0, 8)) AS n FROM companies),
j AS (SELECT org_number, n AS item_ord, CASE
  WHEN c_custkey % 11 = 0 THEN 'no_identity'
  WHEN n = 2 THEN 'off_site'
  WHEN n = 3 AND c_custkey % 5 <> 0 AND c_custkey % 7 = 0 THEN 'larger_site'
  WHEN n IN (4, 5, 6) AND c_custkey % 5 = 0 THEN 'manager_content'
  WHEN n = 4 THEN 'other_name'
  WHEN n = 6 THEN 'other_account'
  WHEN n = 7 THEN 'other_site'
  WHEN n = 1 THEN 'weak_name' END AS reject_reason FROM f)"""


def _judge(spark, sf):
    towns = table(spark, sf, "nation").select(F.lit("larvik").alias("town")).unionByName(table(spark, sf, "nation").select(F.lit("bergen").alias("town"))).distinct()
    e = _entities(spark, sf).withColumn("registered_address", F.lit("Kai 1, 0150 OSLO"))
    return gates.judge_facts(_raw_facts(spark, sf), e, towns)


@query("e9_judged_facts", f"{_JUDGED} SELECT org_number, item_ord, reject_reason FROM j")
def _(spark, sf):
    return _judge(spark, sf).select("org_number", "item_ord", "reject_reason")


@query("e8_confirmed_facts", f"""{_JUDGED}
SELECT field, count(*) AS facts, CAST(min(confidence) AS DOUBLE) AS least, count(*) FILTER (WHERE source_class = 'external') AS off_site FROM (
  SELECT CASE item_ord WHEN 0 THEN 'organization_name' WHEN 3 THEN 'hiring_signal' WHEN 5 THEN 'company_profile' END AS field, 100 AS confidence,
         CASE WHEN item_ord = 3 THEN 'external' ELSE 'company_owned' END AS source_class FROM j WHERE reject_reason IS NULL) GROUP BY field""")
def _(spark, sf):
    confirmed = gates.confirm(_judge(spark, sf))
    return confirmed.groupBy("field").agg(
        F.count(F.lit(1)).alias("facts"), F.min("match_confidence").alias("least"), F.count_if(F.col("source_class") == "external").alias("off_site")
    )


@query("e1_own_host_links", f"""
WITH {S.LINKS} SELECT page_id, count(*) AS own FROM links WHERE {S.host("link")} = {S.host()} GROUP BY page_id""")
def _(spark, sf):
    from factloom.operators import links

    found = links.page_links(table(spark, sf, "pages"))
    return found.filter(gates.provenance(F.col("link"), F.lit(None).cast("string"), F.col("page_url")) == "own").groupBy("page_id").agg(F.count(F.lit(1)).alias("own"))


@query("e7_site_shares_host", f"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS same FROM pages""")
def _(spark, sf):
    key, host = F.col("page_id") % 4, urls.host(F.col("url"))
    value = F.when(key == 0, host).when(key == 1, _text("shop.", host)).when(key == 2, _text("not", host)).otherwise(F.regexp_replace(host, r"^[^.]+\.", ""))
    found = (urls.on_site(value, host) | urls.on_site(host, value)) & F.lit(True)
    return table(spark, sf, "pages").select("page_id", found.alias("same"))


def _candidates(spark, sf):
    """One candidate site per company, cycling through the outcomes of the cascade."""
    c = derived.companies(spark, sf)
    kind = KEY % 10
    joined = F.replace("p_name", F.lit(" "), F.lit(""))
    number = F.concat_ws(" ", F.substring("org_number", 1, 3), F.substring("org_number", 4, 3), F.substring("org_number", 7, 3))
    url = (
        F.when(kind == 0, F.lit("https://www.proff.no/x")).when(kind == 1, F.lit("https://a.no/bedrift/x")).when(kind == 2, F.lit("https://a.no/123456789"))
        .when(kind == 5, _text("https://", joined, ".in/")).otherwise(_text("https://", joined, ".no/"))
    )
    html = (
        F.when(kind == 4, _text("<p>Org.nr: 918 965 556 ", "</p>")).when(kind == 6, _text("<title>Til salgs: domain is for sale</title>", NAME))
        .when(kind == 7, _text("<p>Velkommen til ", NAME, "</p><p>Org.nr. ", number, "</p>")).when(kind == 8, _text("<p>", F.upper(NAME), " i Bergen</p>"))
        .otherwise(_text("<h1>Noe helt annet</h1>"))
    )
    strings = F.array().cast("array<string>")
    return c.select(
        "org_number", F.concat("p_name", F.lit(" AS")).alias("legal_name"), strings.alias("alternate_names"),
        F.when(kind.isin(6, 8), "exact").when(kind == 9, "guess").otherwise("email").alias("kind"), url.alias("url"), url.alias("landed_url"),
        F.when(kind == 3, 500).otherwise(200).alias("status"), html.alias("html"), F.when(kind == 5, F.array(NAME)).otherwise(strings).alias("json_names"),
        strings.alias("phones"), F.lit(None).cast("string").alias("street"), F.lit("5003").alias("postcode"), F.lit("BERGEN").alias("town"), F.lit("BERGEN").alias("municipality"),
        (KEY % 20 == 8).alias("name_taken"), F.lit(None).cast("string").alias("holder_name"), "c_custkey",
    )


@query("e21_candidate_decisions", f"""
WITH {S.COMPANIES}
SELECT org_number, CASE c_custkey % 10 WHEN 0 THEN 'aggregator' WHEN 1 THEN 'directory' WHEN 2 THEN 'numbered_record' WHEN 3 THEN 'not_read' WHEN 4 THEN 'other_number' WHEN 5 THEN 'foreign_domain'
  WHEN 6 THEN 'parked' WHEN 7 THEN 'accepted' WHEN 8 THEN CASE WHEN length(replace(p_name, ' ', '')) < 6 THEN 'no_proof' WHEN c_custkey % 20 = 8 THEN 'name_taken' ELSE 'accepted' END ELSE 'no_proof' END AS decision,
  CASE WHEN c_custkey % 10 = 7 THEN 'Org.nr. ' || org_number[1:3] || ' ' || org_number[4:6] || ' ' || org_number[7:9]
       WHEN c_custkey % 10 = 8 AND c_custkey % 20 <> 8 THEN upper(p_name) || ' i Bergen' END AS span FROM companies""")
def _(spark, sf):
    return gates.judge_sites(_candidates(spark, sf)).select("org_number", "decision", "span")


@query("e14_many_organisations", f"""
WITH {S.COMPANIES} SELECT org_number, CASE WHEN c_custkey % 10 = 3 THEN 'not_read' WHEN c_custkey % 2 = 0 THEN 'lists_many' WHEN c_custkey % 10 = 9 THEN 'no_proof' ELSE 'accepted' END AS decision FROM companies""")
def _(spark, sf):
    c = _candidates(spark, sf)
    many = F.concat(F.array("legal_name"), F.when(KEY % 2 == 0, F.array(*[F.lit(f"Shop {i}") for i in range(4)])).otherwise(F.array(F.lit("Shop 1"), F.lit("shop 1 "))))
    rows = c.withColumn("html", F.lit("<p>x</p>")).withColumn("json_names", many).withColumn("url", _text("https://x", KEY, ".no/"))
    return gates.judge_sites(rows).select("org_number", "decision")


def _site_pages(spark, sf):
    """A home page and a contact page per company: own number, own name, another number, or neither."""
    kind = KEY % 4
    number = F.concat_ws(" ", F.substring("org_number", 1, 3), F.substring("org_number", 4, 3), F.substring("org_number", 7, 3))
    body = F.when(kind == 0, _text("<p>Org.nr. ", number, "</p>")).when(kind == 2, "<p>Org.nr: 918 965 556</p>").otherwise("<p>x</p>")
    title = F.when(kind == 1, _text("<title>", F.upper(NAME), " ", F.col("legal_form"), "</title>")).otherwise("<title>zzz qqq</title>")
    rows = derived.companies(spark, sf).withColumn("legal_name", F.concat(F.upper(NAME), F.lit(" "), "legal_form"))
    home = derived.company_pages(spark, sf, F.concat(title, F.lit("<p>hei</p>")), F.lit("/"), rows)
    contact = derived.company_pages(spark, sf, F.concat(F.lit("<title>zz</title>"), body), F.lit("/kontakt"), rows).withColumn("page_ord", F.lit(1).cast("bigint"))
    return home.unionByName(contact)


def _owners(spark, sf):
    return derived.companies(spark, sf).select(
        "org_number", "legal_name", F.when(KEY % 4 == 3, _text("https://www.unread", KEY, ".no")).otherwise(_text("https://", F.replace("p_name", F.lit(" "), F.lit("")), ".no")).alias("official_site"),
    )


_OWNERSHIP = f"""
WITH {S.COMPANIES}, o AS (SELECT c_custkey, org_number, p_name, legal_name,
  CASE c_custkey % 4 WHEN 0 THEN {_SITE} || '/kontakt' WHEN 1 THEN {_SITE} || '/' END AS proof_url,
  CASE c_custkey % 4 WHEN 0 THEN 'Org.nr. ' || org_number[1:3] || ' ' || org_number[4:6] || ' ' || org_number[7:9] WHEN 1 THEN legal_name END AS span,
  CASE c_custkey % 4 WHEN 2 THEN 'the website shows another organisation''s number (918 965 556), not this company''s' WHEN 3 THEN 'the website could not be read' END AS reason FROM companies)"""


@query("e22_site_ownership", f"{_OWNERSHIP} SELECT org_number, proof_url, span, reason FROM o")
def _(spark, sf):
    return gates.site_ownership(_site_pages(spark, sf), _owners(spark, sf)).select("org_number", "proof_url", "span", "reason")


@query("e23_site_outcome", f"""{_OWNERSHIP}
SELECT org_number, CASE c_custkey % 4 WHEN 0 THEN 'proven' WHEN 1 THEN 'proven' ELSE 'ambiguous' END AS outcome,
  CASE c_custkey % 4 WHEN 2 THEN 'Registered website ' || {_SITE} || ': ' || reason WHEN 3 THEN 'Registered website https://www.unread' || c_custkey || '.no: Brønnøysund lists the same website for UNREAD AS (1)' END AS unproven FROM o""")
def _(spark, sf):
    owned = gates.site_ownership(_site_pages(spark, sf), _owners(spark, sf))
    holders = owned.filter("official_site LIKE '%unread%'").select("org_number", F.lit("UNREAD AS").alias("holder_name"), F.lit("1").alias("holder_number"))
    return gates.registered_site_outcome(owned, holders).select("org_number", "outcome", "unproven")


def _hiring_claims(spark, sf):
    c = derived.companies(spark, sf)
    values = F.array(
        _text("Open role: Snekker ", KEY, " - https://x.no/stilling/", KEY), _text("Job ad: https://x.no/stilling/", KEY, "/"), _text("Job ad: https://x.no/stilling/annen-", KEY),
        F.lit("Open role: Åpen søknad - https://x.no/stilling/open"), F.lit("Careers page: https://x.no/karriere"), F.lit("Careers page: https://www.x.no/en/karriere"),
        F.lit("Careers page: https://x.no/karriere/lang/underside"), F.lit("Montør (published 2024-01-01) - NAV"),
    )
    return c.select("org_number", "c_custkey", F.posexplode(values).alias("ord", "value"))


@query("e26_open_postings", f"""
WITH {S.COMPANIES}, v AS (SELECT org_number, unnest(['Open role: Snekker ' || c_custkey || ' - https://x.no/stilling/' || c_custkey, 'Job ad: https://x.no/stilling/annen-' || c_custkey, 'Careers page: https://x.no/karriere',
  'Careers page: https://www.x.no/en/karriere', 'Careers page: https://x.no/karriere/lang/underside', 'Montør (published 2024-01-01) - NAV']) AS value FROM companies) SELECT * FROM v""")
def _(spark, sf):
    return curation.open_postings(_hiring_claims(spark, sf), "org_number").select("org_number", "value")


@query("g3_limited_careers", f"""
WITH {S.COMPANIES}, v AS (SELECT org_number, unnest(['Open role: Snekker ' || c_custkey || ' - https://x.no/stilling/' || c_custkey, 'Open role: Åpen søknad - https://x.no/stilling/open',
  'Careers page: https://x.no/karriere', 'Montør (published 2024-01-01) - NAV', 'Job ad: https://x.no/stilling/' || c_custkey || '/']) AS value FROM companies) SELECT * FROM v""")
def _(spark, sf):
    return curation.limited_careers(_hiring_claims(spark, sf), "org_number", ["ord"]).select("org_number", "value")


@query("e24_news_curation", f"""
WITH {S.COMPANIES}, v AS (SELECT org_number, unnest(['Ny fabrikk åpnet i Bergen (2024-05-02) - https://x.no/nyheter/' || c_custkey, 'Founded on 2001-01-01 - Brønnøysundregistrene']) AS value FROM companies) SELECT * FROM v""")
def _(spark, sf):
    c = derived.companies(spark, sf)

    def item(n, value, day="2024-05-02", source_class="company_owned"):
        return F.struct(F.lit(n).alias("item_ord"), value.alias("value"), F.lit(day).alias("effective_date"), F.lit(source_class).alias("source_class"))

    items = F.array(
        item(0, _text("Ny fabrikk åpnet i Bergen (2024-05-02) - https://x.no/nyheter/", KEY)), item(1, F.lit("Kommer snart noe nytt (2024-09-01) - https://x.no/a/1"), "2024-09-01"),
        item(2, F.lit("kypit kyrsovyu_aton (2024-05-02) - https://x.no/a/2")), item(3, _text(F.col("legal_name"), " (2024-05-02) - https://x.no/a/3")),
        item(4, F.lit("Uten lenke i det hele tatt (2024-05-02)")), item(5, F.lit("Delt lenke en (2024-05-02) - https://x.no/takk-side/5")),
        item(6, F.lit("Delt lenke to (2024-05-02) - https://x.no/takk-side/5")), item(7, F.lit("En vanlig tjeneste (2024-05-02) - https://x.no/tjenester/rens")),
        item(8, F.lit("Amet Commodo Nulla Facilisi (2024-05-02) - https://x.no/a/8")), item(9, F.lit("BMW 5-serie 520d (2024-05-02) - https://x.no/a/9")),
        item(10, F.lit("Siste nyheter (2024-05-02) - https://x.no/a/10")), item(11, F.lit("Sparebank1 Østlandet AS (2024-05-02) - https://x.no/a/11")),
        item(12, F.lit("Gammel demo fra mal (1995-05-02) - https://x.no/a/12"), "1995-05-02"), item(13, F.lit("Founded on 2001-01-01 - Brønnøysundregistrene"), "2001-01-01", "official_registry"),
    )
    rows = c.select("org_number", F.explode(items).alias("_i")).select("org_number", "_i.*")
    facts = schemas.conform(rows, schemas.CONFIRMED_FACT, field=F.lit("dated_activity"), retrieved_at=F.lit(derived.READ_AT))
    entities = c.select("org_number", "legal_name", F.lit("1999-01-01").alias("founded"))
    return curation.curated_news(facts, entities).select("org_number", "value")


@query("e27_own_social_rows", f"""
WITH {S.COMPANIES} SELECT org_number, 'company_profile' AS field FROM companies WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0 UNION ALL SELECT org_number, 'leader' FROM companies""")
def _(spark, sf):
    c = derived.companies(spark, sf)
    rows = c.select("org_number", "c_custkey", F.explode(F.array(F.lit("company_profile"), F.lit("leader"))).alias("field"), F.when(KEY % 3 == 0, "https://x.no/kontakt-oss").otherwise("https://x.no/blogg/sak").alias("source_url"))
    return gates.own_social_rows(rows, c.filter("c_custkey % 2 = 0").select("org_number")).select("org_number", "field")


@query("f5_f8_undoubted_accounts", f"""
WITH {S.COMPANIES}, n AS (SELECT count(DISTINCT org_number) AS c, p_name FROM companies GROUP BY p_name)
SELECT org_number, 'https://www.facebook.com/' || replace(p_name, ' ', '') AS value FROM companies WHERE c_custkey % 2 = 0 UNION ALL
SELECT org_number, 'https://www.facebook.com/' || replace(p_name, ' ', '') || 'bygg' FROM companies WHERE c_custkey % 2 = 1""")
def _(spark, sf):
    c = derived.companies(spark, sf)
    joined = F.replace("p_name", F.lit(" "), F.lit(""))
    own = c.select("org_number", F.lit("company_profile").alias("field"), _text("https://www.facebook.com/", joined, F.when(KEY % 2 == 1, "bygg").otherwise("")).alias("value"))
    others = c.select("org_number", F.lit("company_profile").alias("field"), _text("https://www.facebook.com/", joined, "eiendom").alias("value"))
    entities = c.select("org_number", F.concat("p_name", F.lit(" AS")).alias("legal_name"), F.lit("https://zz.no").alias("official_site"))
    sisters = c.select(F.concat(F.lit("s"), "org_number").alias("org_number"), F.concat("p_name", F.lit(" eiendom AS")).alias("legal_name"))
    registered = entities.select("org_number", "legal_name").unionByName(sisters)
    return gates.undoubted_accounts(own.unionByName(others), entities, registered).select("org_number", "value")
