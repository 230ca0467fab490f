"""URL expressions (inventory B1-B11, D4, E10-E15, E29)."""
from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import sql as S
from factloom.catalog.registry import query, table
from factloom.functions import registry, urls

URL = F.col("url")


def _pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url")


@query("b1_normalized_url", f"SELECT page_id, {S.normalized()} AS normalized FROM pages")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", urls.normalize(URL).alias("normalized"))


@query("b2_same_page", f"""
SELECT page_id, {S.normalized()} = {S.normalized("url || CASE WHEN position('?' IN url) > 0 THEN '&utm_medium=x' ELSE '' END")} AS same,
       {S.normalized()} = {S.normalized("replace(url, '.example.', '.sample.')")} AS same_elsewhere FROM pages""")
def _(spark, sf):
    tagged = F.when(URL.contains("?"), F.concat(URL, F.lit("&utm_medium=x"))).otherwise(URL)
    moved = F.replace(URL, F.lit(".example."), F.lit(".sample."))
    tagged = F.when(URL.contains("#"), URL).otherwise(tagged)
    return _pages(spark, sf).select("page_id", urls.same_page(URL, tagged).alias("same"), urls.same_page(URL, moved).alias("same_elsewhere"))


@query("b3_tracking_params", f"""
SELECT page_id, p AS param, starts_with(lower(split_part(p, '=', 1)), 'utm_') OR lower(split_part(p, '=', 1)) IN
       ('gclid', 'fbclid', 'msclkid', 'mc_cid', 'mc_eid', 'ref', 'ref_src') AS tracking
FROM (SELECT page_id, unnest(string_split({S.query_string()}, '&')) AS p FROM pages) WHERE p <> ''""")
def _(spark, sf):
    rows = _pages(spark, sf).select("page_id", F.explode(F.split(urls.query(URL), "&")).alias("param")).filter("param <> ''")
    return rows.withColumn("tracking", urls.is_tracking_param(F.substring_index("param", "=", 1)))


@query("b4_host", f"SELECT page_id, {S.host()} AS host FROM pages")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", urls.host(URL).alias("host"))


@query("b5_site_membership", f"""
SELECT page_id, {S.host()} = 'example.com' OR ends_with({S.host()}, '.example.com') AS on_com,
       list_has_any(list_transform(range(1, len(string_split({S.host()}, '.')) + 1), lambda i: array_to_string(list_slice(string_split({S.host()}, '.'), i, 9), '.')),
                    ['example.org', 'ththth.example.net']) AS on_list FROM pages""")
def _(spark, sf):
    return _pages(spark, sf).select(
        "page_id", urls.on_site(urls.host(URL), F.lit("example.com")).alias("on_com"), urls.on_any(urls.host(URL), ["example.org", "ththth.example.net"]).alias("on_list")
    )


@query("b6_base_domain", f"SELECT page_id, regexp_extract({S.host()}, '([^.]+\\.[^.]+)$', 1) AS base FROM pages")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", urls.base_domain(urls.host(URL)).alias("base"))


@query("b7_clean_page_url", f"""
SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS clean FROM (
  SELECT page_id, url, array_to_string(list_filter(string_split({S.query_string()}, '&'), lambda p: contains(p, '=') AND NOT
    regexp_full_match(split_part(p, '=', 1), '(?i)(utm_\\w+|gclid|fbclid|mc_\\w+|ref|source|src|trk|link_source\\w*)')), '&') AS kept FROM pages)""")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", urls.clean_page(URL).alias("clean"))


@query("b8_page_key", f"""
SELECT page_id, {S.host()} || '/' || lower(array_to_string(
  CASE WHEN len(s) > 1 AND regexp_full_match(s[1], '(?i)[a-z]{{2}}([-_][a-z]{{2}})?') THEN s[2:] ELSE s END, '/')) AS page_key
FROM (SELECT page_id, url, list_filter(string_split({S.path()}, '/'), lambda x: x <> '') AS s FROM pages)""")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", urls.page_key(URL).alias("page_key"))


@query("b9_site_key", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z]+://', ''), '^www\.', ''), '/+$', '') AS site_key FROM pages""")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", urls.site_key(URL).alias("site_key"))


@query("b11_registered_website", f"""
WITH {S.COMPANIES}, typed AS (
  SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN website WHEN 1 THEN 'HTTP://' || website WHEN 2 THEN email WHEN 3 THEN 'ingen' WHEN 4 THEN 'facebook.com/' || replace(p_name, ' ', '') ELSE p_name || '.no' END AS typed FROM companies)
SELECT c_custkey, CASE WHEN typed IS NULL OR typed = '' OR contains(typed, ' ') OR contains(typed, '@') OR NOT contains(typed, '.') OR starts_with(typed, 'facebook.com') THEN NULL
  WHEN regexp_matches(typed, '(?i)^https?://') THEN typed ELSE 'https://' || typed END AS website FROM typed""")
def _(spark, sf):
    from factloom.catalog import derived

    c = derived.companies(spark, sf)
    key = F.col("c_custkey") % 6
    typed = (
        F.when(key == 0, F.col("website")).when(key == 1, F.concat(F.lit("HTTP://"), "website")).when(key == 2, F.col("email")).when(key == 3, "ingen")
        .when(key == 4, F.concat(F.lit("facebook.com/"), F.replace("p_name", F.lit(" "), F.lit("")))).otherwise(F.concat("p_name", F.lit(".no")))
    )
    return c.select("c_custkey", registry.registered_website(typed).alias("website"))


@query("b31_deep_page", f"""
SELECT page_id, len(list_filter(string_split({S.path()}, '/'), lambda s: s <> '' AND lower(s) NOT IN
  ('no', 'nb', 'nn', 'en', 'se', 'sv', 'da', 'dk', 'de', 'fi', 'nor', 'eng', 'norsk', 'english'))) > 0 AS deep FROM pages""")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", urls.is_deep_page(URL).alias("deep"))


_MARKED = "regexp_replace(url, '/([a-z]{2})/', '/' || CASE page_id % 5 WHEN 0 THEN 'karriere' WHEN 1 THEN 'nyheter' WHEN 2 THEN 'kontakt' WHEN 3 THEN 'company' ELSE 'shop' END || '/')"


def _marked():
    words = F.element_at(F.array(*[F.lit(w) for w in ("karriere", "nyheter", "kontakt", "company", "shop")]), (F.col("page_id") % 5 + 1).cast("int"))
    return F.regexp_replace(URL, F.lit("/([a-z]{2})/"), F.concat(F.lit("/"), words, F.lit("/")))


@query("d4_sitemap_rank", f"""
SELECT page_id, CASE WHEN regexp_matches({S.path(_MARKED)}, 'career|karriere|jobs|jobb|ledig|stilling|vacanc') THEN 0
  WHEN regexp_matches({S.path(_MARKED)}, 'news|nyheter|aktuelt|press|blog|artikler') THEN 1 ELSE 2 END AS rank,
  regexp_matches({S.path(_MARKED)}, 'karriere|nyheter|kontakt') AS priority FROM pages""")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", urls.sitemap_rank(_marked()).alias("rank"), urls.is_sitemap_priority(_marked()).alias("priority"))


@query("e10_aggregator_hosts", f"""
SELECT page_id, regexp_matches({S.host("replace(url, 'example.com', 'proff.no')")}, '(^|\\.)proff\\.no$') AS aggregator FROM pages""")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", urls.is_aggregator(F.replace(URL, F.lit("example.com"), F.lit("proff.no"))).alias("aggregator"))


@query("e11_directory_paths", f"""
SELECT page_id, list_contains(string_split(lower({S.path(_MARKED)}), '/'), 'company') AS directory,
  NOT regexp_matches(lower(regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN page_id % 3 = 0 THEN '.pdf' ELSE '' END), '\\.(pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|svg|zip|mp4|mp3)$') AS web_page
FROM pages""")
def _(spark, sf):
    typed = F.concat(F.regexp_extract("url", "^([^?#]*)", 1), F.when(F.col("page_id") % 3 == 0, ".pdf").otherwise(""))
    return _pages(spark, sf).select("page_id", urls.is_directory_shaped(_marked()).alias("directory"), urls.is_web_page(typed).alias("web_page"))


@query("e12_embedded_numbers", """
SELECT page_id, page_id % 2 = 0 AS has_number, page_id % 4 = 0 AS other_number FROM pages""")
def _(spark, sf):
    number = F.when(F.col("page_id") % 4 == 0, "918965556").otherwise("999296432")
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://list.no/b/"), number, F.lit("?n="), "page_id")).otherwise(F.concat(F.lit("https://list.no/b/1"), number, F.lit("?n="), "page_id"))
    return _pages(spark, sf).select(
        "page_id", urls.embeds_a_number(link).alias("has_number"), urls.embeds_another_number(link, F.lit("999296432")).alias("other_number")
    )


@query("e15_foreign_tld", r"""
SELECT page_id, page_id % 5 IN (1, 3) AS foreign_tld FROM pages""")
def _(spark, sf):
    tld = F.element_at(F.array(*[F.lit(t) for t in ("no", "se", "com", "in", "as")]), (F.col("page_id") % 5 + 1).cast("int"))
    return _pages(spark, sf).select("page_id", urls.is_foreign_tld(F.regexp_replace(URL, F.lit(r"\.example\.[a-z]+"), F.concat(F.lit(".example."), tld))).alias("foreign_tld"))


@query("e29_safe_outbound", """
SELECT page_id, CASE page_id % 8 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN false WHEN 6 THEN false ELSE true END AS safe FROM pages""")
def _(spark, sf):
    hosts = F.element_at(F.array(*[F.lit(h) for h in (
        "", "10.1.2.3", "localhost:80", "8.8.8.8", "[::1]", "db.internal", "172.31.0.1:8080", "172.32.0.1")]), (F.col("page_id") % 8 + 1).cast("int"))
    moved = F.when(hosts == "", URL).otherwise(F.regexp_replace(URL, F.lit("://[^/]+"), F.concat(F.lit("://"), hosts)))
    return _pages(spark, sf).select("page_id", urls.is_safe_outbound(moved).alias("safe"))


@query("b44_source_label", f"""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Brønnøysund Register Centre: roles' WHEN 1 THEN 'Register of Company Accounts: FY2023 accounts'
  WHEN 2 THEN 'NAV job board (arbeidsplassen.nav.no)' WHEN 3 THEN 'Page linked from the company''s website (' || {S.host()} || ')'
  ELSE 'Company website (' || {S.host()} || ')' END AS label FROM pages""")
def _(spark, sf):
    kind = F.col("page_id") % 6
    tail = F.col("page_id").cast("string")
    url = (
        F.when(kind == 0, F.concat(F.lit("https://data.brreg.no/enhetsregisteret/api/enheter/"), tail, F.lit("/roller")))
        .when(kind == 1, F.concat(F.lit("https://data.brreg.no/regnskapsregisteret/regnskap/"), tail, F.lit("?%C3%A5r=2023")))
        .when(kind == 2, F.concat(F.lit("https://arbeidsplassen.nav.no/stillinger/stilling/"), tail)).otherwise(URL)
    )
    return _pages(spark, sf).select("page_id", registry.source_label(url, F.when(kind == 3, F.lit("https://a.no/"))).alias("label"))
