"""Record linkage (inventory F3-F13, F17, I3)."""
from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import derived
from factloom.catalog import sql as S
from factloom.catalog.derived import words
from factloom.catalog.registry import query, table
from factloom.functions import names, text, urls
from factloom.operators import gates, linkage

KEY, NAME = F.col("c_custkey"), F.col("p_name")


@query("f3_name_taken", """
WITH n AS (SELECT upper(p_name) AS form, min(p_partkey) AS a, max(p_partkey) AS b FROM part GROUP BY 1)
SELECT p_partkey, a <> p_partkey OR b <> p_partkey AS taken FROM part JOIN n ON form = upper(p_name)""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " AS").otherwise(" ENK")).alias("name"))
    return linkage.held_by_another(p, p, "p_partkey", names.base(F.col("name")), names.base(F.col("name"))).select("p_partkey", "taken")


@query("f4_stem_families", """
WITH s AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS stem FROM part), n AS (SELECT stem, count(*) AS c FROM s GROUP BY 1)
SELECT p_partkey, stem, c - 1 AS others FROM s JOIN n USING (stem)""")
def _(spark, sf):
    return linkage.stem_families(table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" AS")).alias("name")), "p_partkey", "name")


@query("f6_site_holders", f"""
WITH p AS (SELECT page_id, {S.host()} AS host FROM pages)
SELECT p.page_id, min(l.page_id) AS holder_number FROM p JOIN p l ON l.host = p.host AND l.page_id <> p.page_id GROUP BY 1""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.authority(F.col("url"))).alias("site"))
    named = p.withColumn("name", F.concat(F.substring_index(urls.host(F.col("site")), ".", 1), F.lit(" AS")))
    return linkage.site_holders(p, named, "page_id", "site", "site", "name").select("page_id", "holder_number")


@query("f7_related_sites", f"""
WITH {S.COMPANIES}, n AS (SELECT p_name, org_number FROM companies WHERE legal_form <> 'ENK')
SELECT c.org_number, min(n.org_number) AS related_number FROM companies c JOIN n ON n.p_name = c.p_name AND n.org_number <> c.org_number WHERE c.c_custkey % 2 = 0 GROUP BY 1""")
def _(spark, sf):
    c = derived.companies(spark, sf)
    sites = c.filter("c_custkey % 2 = 0").select(
        "org_number", F.concat("p_name", F.lit(" Avdeling Nord AS")).alias("legal_name"), words("https://", F.replace("p_name", F.lit(" "), F.lit("")), ".no").alias("site"),
        F.concat("p_name", F.lit(" Gruppen")).alias("site_name"),
    ).withColumn("site_name", F.regexp_replace("site_name", " Gruppen$", ""))
    units = c.select("org_number", F.concat("p_name", F.when(KEY % 3 == 0, " Gruppen AS").otherwise(" AS")).alias("legal_name"), "legal_form", F.lit(None).cast("string").alias("website"))
    return linkage.related_sites(sites, units).select("org_number", "related_number")


@query("f7_shared_name_proof", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS own, CASE p_partkey % 3 WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 0 THEN 'zzz' ELSE p_name END AS site_name FROM part""")
def _(spark, sf):
    kind = F.col("p_partkey") % 3
    span = F.when(kind == 0, "Org.nr. 918 965 556").when(kind == 1, F.concat("p_name", F.lit(" – verksted"))).otherwise(F.concat(F.substring_index("p_name", " ", 1), F.lit(" | hjem")))
    name, site = F.concat("p_name", F.lit(" AS")), F.lit("https://zzz.no")
    return table(spark, sf, "part").select(
        "p_partkey", linkage.is_own_by_proof(span, F.lit("918965556"), site, name).alias("own"), linkage.shared_site_name(span, F.lit(None).cast("string"), site).alias("site_name")
    )


@query("f9_employer_matches", """
WITH e AS (SELECT DISTINCT upper(p_type) || ' - ' || upper(p_name) || ', ' || upper(p_brand) AS employer, upper(p_name) AS run FROM part),
n AS (SELECT run, employer, row_number() OVER (PARTITION BY run ORDER BY len(string_split(trim(regexp_replace(regexp_replace(employer, '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' ')), employer) AS rank FROM e),
c AS (SELECT DISTINCT p_name FROM part)
SELECT p_name, employer, CAST(rank AS INT) AS rank FROM c JOIN n ON run = upper(p_name) WHERE rank <= 12""")
def _(spark, sf):
    p = table(spark, sf, "part")
    employers = p.select(F.concat("p_type", F.lit(" - "), "p_name", F.lit(", "), "p_brand").alias("employer"))
    companies = p.select("p_name").distinct().withColumn("legal_name", F.concat("p_name", F.lit(" AS")))
    return linkage.employer_matches(companies, employers, "p_name", "legal_name", "employer")


@query("f10_attributed_ads", """
WITH own AS (SELECT c_custkey, c_custkey AS number FROM customer UNION SELECT c_custkey, c_custkey + 100000 FROM customer),
ads AS (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 100000 ELSE 0 END AS number, CAST(o_orderdate AS DATE) AS expires FROM orders),
r AS (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n FROM ads JOIN own USING (number) WHERE expires >= DATE '1998-01-01')
SELECT c_custkey, o_orderkey FROM r WHERE n <= 5""")
def _(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    numbers = linkage.own_numbers(c, c.select("c_custkey", (KEY + 100000).alias("unit")), "c_custkey", "unit")
    ads = o.select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 3 == 0, 100000).otherwise(0)).alias("number"), F.to_date("o_orderdate").alias("expires"))
    return linkage.attributed_ads(ads, numbers, "c_custkey", "number", "expires", F.lit("1998-01-01").cast("date"), ["o_orderkey"]).select("c_custkey", "o_orderkey")


@query("j3_own_numbers", """
SELECT c_custkey, c_custkey AS number FROM customer UNION SELECT o_custkey, o_orderkey + 1000000 FROM orders""")
def _(spark, sf):
    units = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderkey") + 1000000).alias("unit"))
    return linkage.own_numbers(table(spark, sf, "customer"), units, "c_custkey", "unit")


@query("f11_ad_homepages", """
SELECT DISTINCT o_custkey, 'https://firma' || o_custkey || '.no' AS url FROM orders WHERE o_orderkey % 4 = 0""")
def _(spark, sf):
    kind = F.col("o_orderkey") % 4
    ads = table(spark, sf, "orders").select(
        "o_custkey", F.when(kind == 1, F.lit(-1)).otherwise(F.col("o_custkey")).alias("number"),
        F.when(kind == 2, "www.uten-skjema.no").when(kind == 3, "ikke en side").otherwise(words(" https://firma", F.col("o_custkey"), ".no ")).alias("homepage"),
    )
    return linkage.ad_homepages(ads, "o_custkey", "number", "homepage")


@query("f10_ad_values", """
SELECT o_orderkey, 'Selger' || CASE o_orderkey % 3 WHEN 0 THEN ' (published ' || strftime(o_orderdate, '%Y-%m-%d') || ', apply by 2024-09-01)' WHEN 1 THEN ' (published ' || strftime(o_orderdate, '%Y-%m-%d') || ')' ELSE '' END || ' - NAV' AS value FROM orders""")
def _(spark, sf):
    kind = F.col("o_orderkey") % 3
    published = F.when(kind < 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", linkage.ad_value(F.lit(" Selger "), published, F.when(kind == 0, "2024-09-01")).alias("value"))


@query("f12_site_candidates", f"""
WITH {S.COMPANIES}, g AS (
  SELECT org_number, 0 AS tier, 'nav' AS kind, 'https://www.' || replace(p_name, ' ', '') || '.no/x' AS url, replace(p_name, ' ', '') || '.no' AS host FROM companies WHERE c_custkey % 3 = 0 UNION ALL
  SELECT org_number, 1, 'email', 'https://' || replace(p_name, ' ', '-') || '.no', replace(p_name, ' ', '-') || '.no' FROM companies WHERE c_custkey % 7 <> 0 UNION ALL
  SELECT org_number, 2, CASE WHEN length(replace(p_name, ' ', '')) >= 6 THEN 'exact' ELSE 'guess' END, 'https://' || replace(p_name, ' ', '') || '.no', replace(p_name, ' ', '') || '.no' FROM companies UNION ALL
  SELECT org_number, 3, CASE WHEN length(replace(p_name, ' ', '')) >= 6 THEN 'exact' ELSE 'guess' END, 'https://' || replace(p_name, ' ', '-') || '.no', replace(p_name, ' ', '-') || '.no' FROM companies UNION ALL
  SELECT org_number, CASE WHEN length(split_part(p_name, ' ', 1)) >= 4 THEN 5 ELSE 4 END, CASE WHEN length(replace(p_name, ' ', '')) >= 6 THEN 'exact' ELSE 'guess' END, 'https://' || replace(p_name, ' ', '') || '.com', replace(p_name, ' ', '') || '.com' FROM companies UNION ALL
  SELECT org_number, 4, 'guess', 'https://' || split_part(p_name, ' ', 1) || '.no', split_part(p_name, ' ', 1) || '.no' FROM companies WHERE length(split_part(p_name, ' ', 1)) >= 4),
u AS (SELECT org_number, host, arg_min(kind, tier) AS kind, arg_min(url, tier) AS url, min(tier) AS tier FROM g GROUP BY ALL)
SELECT org_number, CAST(n AS INT) AS cand_ord, kind, url FROM (SELECT *, row_number() OVER (PARTITION BY org_number ORDER BY tier) AS n FROM u) WHERE n <= 3""")
def _(spark, sf):
    c = derived.companies(spark, sf).withColumn("legal_name", F.concat(F.upper(NAME), F.lit(" AS")))
    homepages = c.filter("c_custkey % 3 = 0").select("org_number", words("www.", F.replace("p_name", F.lit(" "), F.lit("")), ".no/x").alias("url"))
    return linkage.site_candidates(c.select("org_number", "legal_name", "email"), homepages).select("org_number", "cand_ord", "kind", "url")


@query("f12_first_accepted_host", f"""
WITH r AS (SELECT {S.host()} AS host, page_id, url FROM pages WHERE page_id % 3 = 0) SELECT host, arg_min(url, page_id) AS url FROM r GROUP BY host""")
def _(spark, sf):
    judged = table(spark, sf, "pages").select(
        urls.host(F.col("url")).alias("org_number"), "page_id", "url", F.when(F.col("page_id") % 3 == 0, "accepted").otherwise("other_name").alias("decision"))
    return gates.first_accepted(judged, ["page_id"]).select(F.col("org_number").alias("host"), "url")


@query("f13_discovery_seeds", f"""
WITH {S.COMPANIES}
SELECT org_number, CAST(1 AS INT) AS round, legal_name AS query FROM companies UNION ALL SELECT org_number, 2, 'Kari ' || c_custkey || ' ' || legal_name FROM companies WHERE c_custkey % 2 = 0 UNION ALL
SELECT org_number, 3, org_number FROM companies UNION ALL SELECT org_number, 4, 'OLD ' || legal_name FROM companies WHERE c_custkey % 3 <> 0""")
def _(spark, sf):
    c = derived.companies(spark, sf)
    leaders = c.filter("c_custkey % 2 = 0").select("org_number", F.explode(F.array(F.struct(words("Kari ", KEY, " (Daglig leder)").alias("value"), F.lit(0).alias("ord")), F.struct(
        words("Ola ", KEY, " (Styremedlem)").alias("value"), F.lit(1).alias("ord")))).alias("_l")).select("org_number", "_l.*")
    former = c.select("org_number", F.concat(F.lit("OLD "), "legal_name").alias("name"))
    return linkage.discovery_seeds(c, leaders, former, c.filter("c_custkey % 3 = 0").select("org_number"))


@query("f17_branch_towns", """
SELECT p_partkey, p_partkey % 2 = 0 AND length(replace(p_name, ' ', '')) > 3 AS branch FROM part""")
def _(spark, sf):
    joined = F.replace("p_name", F.lit(" "), F.lit(""))
    accounts = table(spark, sf, "part").select("p_partkey", F.concat(joined, F.when(F.col("p_partkey") % 2 == 0, "bærum").otherwise("bergen")).alias("account"), F.concat(joined, F.lit("bergen")).alias("own"))
    towns = table(spark, sf, "nation").select(F.lower("n_name").alias("town")).unionByName(spark.createDataFrame([("bærum",), ("bergen",)], "town string"))
    hits = gates.branch_towns(accounts, towns, "account", "own").withColumn("branch", F.lit(True))
    return accounts.join(hits, ["account", "own"], "left").select("p_partkey", F.coalesce("branch", F.lit(False)).alias("branch"))


@query("i3_first_usable_result", f"""
SELECT {S.host()} AS host, arg_min(url, page_id) AS url FROM pages WHERE page_id % 4 = 0 GROUP BY 1""")
def _(spark, sf):
    kind = F.col("page_id") % 4
    link = F.when(kind == 1, F.lit("https://www.proff.no/x")).when(kind == 2, "https://a.no/bedrift/x").when(kind == 3, "https://a.no/r.pdf").otherwise(F.col("url"))
    results = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"), link.alias("url"), "page_id")
    return linkage.first_usable_result(results, ["host"], "url", "page_id").select("host", "url")
