"""Facts out of pages (inventory C1-C15, C17, C18, C20-C25, C34-C37). Pages are derived from companies or are
the given ones; the expected facts are computed from the same rows without any page."""
from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import derived
from factloom.catalog import sql as S
from factloom.catalog.derived import words as _text
from factloom.catalog.registry import query, table
from factloom.functions import fixed, registry, text, urls
from factloom.operators import gates, pages

KEY, NAME = F.col("c_custkey"), F.col("p_name")
_SITE = "'https://' || replace(p_name, ' ', '') || '.no'"


def _facts(df, field):
    return df.filter(F.col("field") == field)


def _json_ld_pages(spark, sf, path="/"):
    """Every page carries a graph with its organisation, a job ad and an article, and a breadcrumb before them."""
    slug = F.regexp_replace("p_name", " ", "-")
    graph = _text(
        '<html><head><script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"BreadcrumbList","name":"Crumbs"},',
        '{"@type":["LocalBusiness","Store"],"name":"', F.initcap(NAME), ' AS","url":"/","address":{"streetAddress":"Kai ', KEY, '","postalCode":"5003","addressLocality":"Bergen"},',
        '"employee":[{"name":"Kari ', KEY, '","jobTitle":"CEO"},{"name":["x"]}],"sameAs":["https://www.facebook.com/', slug, '/","https://facebook.com/sharer.php?u=1"]},',
        '{"@graph":[{"@type":"JobPosting","title":"Smith &amp; co ', KEY, '","datePosted":"2024-05-0', KEY % 9 + 1, 'T08:00:00Z","hiringOrganization":{"name":"', NAME, '"}}]}]}</script>',
        '<script type="application/ld+json">not json</script>',
        '<script type="application/ld+json">[{"@type":"NewsArticle","headline":"Ny kontrakt nummer ', KEY, '","datePublished":"2024-04-1', KEY % 10, '"},',
        '{"@type":"Event","name":"Open day","startDate":"2024-09-01"},{"@type":"NewsArticle","headline":"Undated"}]</script></head><body>x</body></html>',
    )
    return derived.company_pages(spark, sf, graph, F.lit(path))


@query("c1_json_ld_objects", """
SELECT CAST(900000000 + c_custkey AS VARCHAR) AS org_number, CAST(6 AS BIGINT) AS objects, 'BreadcrumbList,Event,JobPosting,LocalBusiness,NewsArticle,Store' AS types
FROM customer JOIN part ON p_partkey = c_custkey""")
def _(spark, sf):
    rows = pages.json_ld_objects(_json_ld_pages(spark, sf), ["org_number"])
    return rows.groupBy("org_number").agg(
        F.count(F.lit(1)).alias("objects"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(pages.object_types(F.col("obj")))))), ",").alias("types")
    )


@query("c2_context_name", f"""
WITH {S.COMPANIES}
SELECT org_number, CASE WHEN c_custkey % 2 = 0 THEN 'Brand ' || c_custkey ELSE upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) || ' AS' END AS context_name FROM companies""")
def _(spark, sf):
    tag = _text("<meta content='Brand ", KEY, "' property='og:site_name'>")
    plain = derived.company_pages(spark, sf, F.concat(tag, F.lit("<p>x</p>")), F.lit("/")).filter(KEY % 2 == 0)
    marked = _json_ld_pages(spark, sf).filter(KEY % 2 == 1)
    return pages.context_names(plain.unionByName(marked)).select("org_number", "context_name")


@query("c3_job_postings", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Smith & co ' || c_custkey || ' (posted 2024-05-0' || (c_custkey % 9 + 1) || ')' AS value, p_name AS context_name, 'Smith &amp; co ' || c_custkey AS evidence_span,
  '2024-05-0' || (c_custkey % 9 + 1) AS effective_date FROM companies""")
def _(spark, sf):
    return _facts(pages.structured_facts(_json_ld_pages(spark, sf)), "hiring_signal").select("org_number", "value", "context_name", "evidence_span", "effective_date")


@query("c4_dated_items", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Ny kontrakt nummer ' || c_custkey || ' (2024-04-1' || (c_custkey % 10) || ') - ' || {_SITE} || '/nyheter/kontrakt' AS value, '2024-04-1' || (c_custkey % 10) AS effective_date FROM companies
UNION ALL SELECT org_number, 'Open day (2024-09-01) - ' || {_SITE} || '/nyheter/kontrakt', '2024-09-01' FROM companies""")
def _(spark, sf):
    return _facts(pages.structured_facts(_json_ld_pages(spark, sf, "/nyheter/kontrakt")), "dated_activity").select("org_number", "value", "effective_date")


@query("c5_organisation_rows", f"""
WITH {S.COMPANIES}, f AS (
  SELECT org_number, 'official_site' AS field, {_SITE} || '/' AS value FROM companies UNION ALL
  SELECT org_number, 'registered_address', 'Kai ' || c_custkey || ', 5003, Bergen' FROM companies UNION ALL
  SELECT org_number, 'organization_name', 'Open day' FROM companies UNION ALL SELECT org_number, 'organization_name', 'Crumbs' FROM companies)
SELECT * FROM f""")
def _(spark, sf):
    rows = pages.structured_facts(_json_ld_pages(spark, sf)).filter("field IN ('official_site', 'registered_address', 'organization_name')")
    return rows.filter("field <> 'organization_name' OR value IN ('Open day', 'Crumbs')").select("org_number", "field", "value")


@query("c6_employees", f"""
WITH {S.COMPANIES} SELECT org_number, 'Kari ' || c_custkey || ' (CEO)' AS value FROM companies""")
def _(spark, sf):
    return _facts(pages.structured_facts(_json_ld_pages(spark, sf)), "leader").select("org_number", "value")


@query("c7_same_as_profiles", f"""
WITH {S.COMPANIES}
SELECT org_number, 'https://facebook.com/' || replace(p_name, ' ', '-') AS value, 'https://www.facebook.com/' || replace(p_name, ' ', '-') || '/' AS evidence_span FROM companies""")
def _(spark, sf):
    return _facts(pages.structured_facts(_json_ld_pages(spark, sf)), "company_profile").select("org_number", "value", "evidence_span")


def _meta_pages(spark, sf):
    site_name = F.when(KEY % 3 == 0, _text('<meta property="og:site_name" content="Brand ', KEY, '">')).when(KEY % 3 == 1, _text('<meta name="application-name" content=" App ', KEY, ' ">')).otherwise("")
    canonical = F.when(KEY % 2 == 0, _text('<link rel="canonical" href="https://www.c', KEY, '.no/">')).otherwise(_text('<link href="https://d', KEY, '.no" rel="canonical">'))
    description = F.when(KEY % 4 == 0, _text('<meta name="description" content="We make ', NAME, " &amp; deliver it to shops along the whole coast of Norway, no. ", KEY, '">')).when(
        KEY % 4 == 1, _text('<meta name="description" content="Too short"><meta content="The company sells ', NAME, " to builders and farmers in the west, no. ", KEY, '" property="og:description">')).when(
        KEY % 4 == 2, _text('<meta name="description" content="Hud Oslo Negler Oslo Ansikt Oslo Massasje Oslo behandling ', KEY, '">')).otherwise("")
    return derived.company_pages(spark, sf, F.concat(site_name, canonical, description, F.lit("<p>x</p>")), F.lit("/"))


@query("c8_meta_tags", f"""
WITH {S.COMPANIES}
SELECT org_number, 'public_brand' AS field, CASE c_custkey % 3 WHEN 0 THEN 'Brand ' ELSE 'App ' END || c_custkey AS value FROM companies WHERE c_custkey % 3 < 2
UNION ALL SELECT org_number, 'official_site', CASE WHEN c_custkey % 2 = 0 THEN 'https://www.c' || c_custkey || '.no/' ELSE 'https://d' || c_custkey || '.no' END FROM companies""")
def _(spark, sf):
    return pages.meta_facts(_meta_pages(spark, sf)).filter("field <> 'site_description'").select("org_number", "field", "value")


@query("c9_site_description", f"""
WITH {S.COMPANIES}
SELECT org_number, CASE WHEN c_custkey % 4 = 0 THEN 'We make ' || p_name || ' & deliver it to shops along the whole coast of Norway, no. ' || c_custkey
  ELSE 'The company sells ' || p_name || ' to builders and farmers in the west, no. ' || c_custkey END AS value FROM companies WHERE c_custkey % 4 < 2""")
def _(spark, sf):
    return _facts(pages.meta_facts(_meta_pages(spark, sf)), "site_description").select("org_number", "value")


def _social_pages(spark, sf):
    slug = F.replace("p_name", F.lit(" "), F.lit(""))
    html = _text(
        '<a href="https://www.facebook.com/', slug, '/">f</a><a href="https://facebook.com/', slug, '?ref=x">again</a><a href="https://www.linkedin.com/in/kari">me</a>',
        '<a href="https://twitter.com/intent/tweet?url=x">share</a><div class="fb-page" data-href="https://www.facebook.com/widget', KEY, '"></div>',
        '<iframe src="https://www.facebook.com/plugins/page.php?href=https%3A%2F%2Fwww.facebook.com%2Fframe', KEY, '&tabs"></iframe>',
        '<script>var s={"insta":"https:\\/\\/www.instagram.com\\/', slug, '\\/","other":"https:\\/\\/www.instagram.com\\/partner"}</script>',
    )
    return derived.company_pages(spark, sf, html, F.lit("/"))


@query("c10_social_links", f"""
WITH {S.COMPANIES}, f AS (
  SELECT org_number, 0 AS n, 'https://facebook.com/' || replace(p_name, ' ', '') AS value, 'https://www.facebook.com/' || replace(p_name, ' ', '') || '/' AS evidence_span FROM companies UNION ALL
  SELECT org_number, 1, 'https://facebook.com/widget' || c_custkey, 'https://www.facebook.com/widget' || c_custkey FROM companies UNION ALL
  SELECT org_number, 2, 'https://facebook.com/frame' || c_custkey, 'https%3A%2F%2Fwww.facebook.com%2Fframe' || c_custkey FROM companies)
SELECT org_number, value, evidence_span FROM f""")
def _(spark, sf):
    return pages.social_facts(_social_pages(spark, sf)).select("org_number", "value", "evidence_span")


@query("c11_script_profiles", f"""
WITH {S.COMPANIES} SELECT org_number, 'https://instagram.com/' || replace(p_name, ' ', '') AS value FROM companies WHERE website IS NOT NULL""")
def _(spark, sf):
    p = _social_pages(spark, sf)
    entities = derived.companies(spark, sf).select("org_number", "legal_name", F.concat(F.lit("https://"), "website").alias("official_site"))
    return pages.script_social_facts(p, entities, pages.social_facts(p)).select("org_number", "value")


def _feed_pages(spark, sf):
    items = F.concat(*[_text(
        "<item><title><![CDATA[Ny avtale &amp;#8211; sak ", str(n), " for ", NAME, "]]></title><link>https://", F.replace("p_name", F.lit(" "), F.lit("")), ".no/nyheter/sak-", str(n),
        "</link><pubDate>Mon, 0", str(n + 1), " Apr 2024 10:00:00 +0200</pubDate></item>") for n in range(7)])
    undated = F.lit("<item><title>Undated item here</title><link>https://x.no/nyheter/y</link></item>")
    return derived.company_pages(spark, sf, F.concat(F.lit('<?xml version="1.0"?><rss><channel>'), undated, items, F.lit("</channel></rss>")), F.lit("/feed"))


@query("c12_feed_entries", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Ny avtale – sak ' || n || ' for ' || p_name || ' (2024-04-0' || (n + 1) || ') - ' || {_SITE} || '/nyheter/sak-' || n AS value, '2024-04-0' || (n + 1) AS effective_date
FROM companies, range(0, 5) r(n)""")
def _(spark, sf):
    return pages.feed_facts(_feed_pages(spark, sf)).select("org_number", "value", "effective_date")


@query("c13_post_list", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Vi åpner butikk ' || n || ' for ' || p_name || ' (2024-03-1' || n || ') - ' || {_SITE} || '/aktuelt/sak-' || n AS value,
  'Vi \\u00e5pner butikk ' || n || ' for ' || p_name AS evidence_span FROM companies, range(0, 3) r(n)""")
def _(spark, sf):
    posts = F.concat_ws(",", *[_text(
        '{"date":"2024-03-1', str(n), 'T09:00:00","title":{"rendered":"Vi \\u00e5pner butikk ', str(n), " for ", NAME, '"},"link":"https:\\/\\/', F.replace("p_name", F.lit(" "), F.lit("")),
        ".no\\/aktuelt\\/sak-", str(n), '"}') for n in range(3)])
    body = F.concat(F.lit("["), posts, F.lit(',{"title":{"rendered":"No date at all here"}},{"date":"2024-03-01","title":"plain"}]'))
    return pages.post_list_facts(derived.company_pages(spark, sf, body, F.lit("/wp-json/wp/v2/posts?per_page=6"))).select("org_number", "value", "evidence_span")


@query("c14_list_blocks", f"""
WITH b AS (SELECT page_id, unnest(string_split(regexp_replace({S.cut_scripts()}, '(?i)<(li|article)\\b', '␞<\\1', 'g'), '␞')[2:]) AS block FROM pages)
SELECT page_id, count(*) AS blocks, CAST(sum(length(block)) AS BIGINT) AS chars FROM b GROUP BY page_id""")
def _(spark, sf):
    rows = pages.item_blocks(table(spark, sf, "pages"), ["page_id"], "html")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("block")).alias("chars"))


def _news_pages(spark, sf):
    html = _text(
        '<nav><li><a href="/">Hjem</a></li></nav><article><h2>Ny fabrikk for ', NAME, " nr ", KEY, '</h2><time datetime="2024-05-02T10:00">2. mai</time><a href="/nyheter/fabrikk-', KEY, '">Les mer</a></article>',
        "<li>12. april 2024 <a href='/aktuelt/avtale'>Stor avtale signert med ", NAME, "</a></li>",
        '<div class="card news"><h3>Vi flytter til nye lokaler ', KEY, '</h3><span>03.03.2024</span></div><p><a href="/nyheter/vi-flytter-til-nye-lokaler">x</a></p>',
        "<li>01.01.2024 <h3>Kontakt oss</h3><a href='/nyheter/k'>k</a></li><li>05.05.2024 <h3>Uten egen lenke her ", KEY, "</h3></li>",
    )
    return derived.company_pages(spark, sf, html, F.lit("/nyheter"))


@query("c14_news_items", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Ny fabrikk for ' || p_name || ' nr ' || c_custkey || ' (2024-05-02) - ' || {_SITE} || '/nyheter/fabrikk-' || c_custkey AS value FROM companies UNION ALL
SELECT org_number, 'Stor avtale signert med ' || p_name || ' (2024-04-12) - ' || {_SITE} || '/aktuelt/avtale' FROM companies UNION ALL
SELECT org_number, 'Vi flytter til nye lokaler ' || c_custkey || ' (2024-03-03) - ' || {_SITE} || '/nyheter/vi-flytter-til-nye-lokaler' FROM companies""")
def _(spark, sf):
    return pages.news_facts(_news_pages(spark, sf)).select("org_number", "value")


@query("c15_time_tag_items", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Ny rapport om ' || p_name || ' er ute' AS title, '2024-02-0' || (c_custkey % 9 + 1) AS day, {_SITE} || '/artikkel/' || c_custkey AS link FROM companies""")
def _(spark, sf):
    html = _text(
        '<section><h1>Siste</h1><p><time class="d" datetime="2024-02-0', KEY % 9 + 1, '">dato</time></p><h3><a href="/artikkel/', KEY, '">Ny rapport om ', NAME, " er ute</a></h3></section>",
        '<p><time datetime="not a date">x</time></p>')
    return pages.time_tag_items(derived.company_pages(spark, sf, html, F.lit("/"))).select("org_number", "title", "day", "link")


def _careers_pages(spark, sf):
    kind = KEY % 4
    head = _text("<title>Ledige stillinger | ", NAME, "</title>")
    roles = _text(
        '<ul><li><a href="/stilling/elektriker-', KEY, '">Elektriker ', KEY, '</a></li><li><a href="/stilling/montor-', KEY, '"><h3>Montør i ', NAME, "</h3><p>Les om jobben</p></a></li></ul>",
        '<h2>Prosjektleder bygg</h2><p>tekst</p><a href="https://www.finn.no/job/ad/1234', KEY, '">Les mer</a><a href="/stilling/elektriker-', KEY, '#x">Elektriker</a>',
        '<a href="/stilling/personvern">Personvern</a><a href="/om-oss">Om oss</a>',
    )
    html = F.when(kind == 0, F.concat(head, roles)).when(kind == 1, F.concat(head, roles, F.lit("<p>Vi har ingen ledige stillinger nå.</p>"))).when(
        kind == 2, _text("<title>404 not found</title>", roles)).otherwise(F.concat(head, F.lit("<p>Se oss snart igjen</p>")))
    path = F.when(kind == 3, _text("/karriere/stilling/", KEY + 100000, "-x")).otherwise("/karriere")
    return derived.company_pages(spark, sf, html, path)


@query("c17_role_ads", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Open role: Elektriker ' || c_custkey || ' - ' || {_SITE} || '/stilling/elektriker-' || c_custkey AS value, 'Elektriker ' || c_custkey AS evidence_span FROM companies WHERE c_custkey % 4 = 0 UNION ALL
SELECT org_number, 'Open role: Montør i ' || p_name || ' - ' || {_SITE} || '/stilling/montor-' || c_custkey, 'Montør i ' || p_name FROM companies WHERE c_custkey % 4 = 0 UNION ALL
SELECT org_number, 'Open role: Prosjektleder bygg - https://www.finn.no/job/ad/1234' || c_custkey, 'Prosjektleder bygg' FROM companies WHERE c_custkey % 4 = 0 UNION ALL
SELECT org_number, 'Job ad: ' || {_SITE} || '/karriere/stilling/' || (c_custkey + 100000) || '-x', 'Ledige stillinger | ' || p_name FROM companies WHERE c_custkey % 4 = 3""")
def _(spark, sf):
    return pages.careers_facts(_careers_pages(spark, sf)).select("org_number", "value", "evidence_span")


@query("c18_main_text", rf"""
WITH p AS (SELECT page_id, {S.host()} AS host, html FROM pages),
l AS (SELECT page_id, host, {S.squeeze("unnest(l)")} AS line FROM (SELECT page_id, host, string_split({S.strip_tags(f"regexp_replace({S.cut_scripts()}, '(?i)</(li|p|h[1-6])\\s*>', '␞', 'g')")}, '␞') AS l FROM p)),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
r AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT page_id) AS seen FROM l WHERE line <> '' GROUP BY ALL) JOIN n USING (host) WHERE seen > 1 AND seen > pages * 0.5)
SELECT page_id, line, count(*) AS times FROM l WHERE line <> '' AND NOT EXISTS (SELECT 1 FROM r WHERE r.host = l.host AND r.line = l.line) GROUP BY ALL""")
def _(spark, sf):
    p = table(spark, sf, "pages").withColumn("host", urls.host(F.col("url")))
    return pages.main_text(p, ["page_id"], "host", "html").groupBy("page_id", "line").agg(F.count(F.lit(1)).alias("times"))


def _number_pages(spark, sf):
    """Every page states its company's number in one text node, and a phone, a street and another number."""
    number = F.concat_ws(" ", F.substring("org_number", 1, 3), F.substring("org_number", 4, 3), F.substring("org_number", 7, 3))
    html = _text("<title>Hjem – ", F.initcap(NAME), "</title><footer><p>Kai ", KEY, ", 5003 Bergen</p><p>Tlf. +47 22 33 44 ", F.lpad((KEY % 90 + 10).cast("string"), 2, "0"), "</p><p>Org.nr. ", number, " MVA</p></footer>")
    return derived.company_pages(spark, sf, html, F.lit("/kontakt"))


@query("c20_number_span", f"""
WITH {S.COMPANIES} SELECT org_number, 'Org.nr. ' || org_number[1:3] || ' ' || org_number[4:6] || ' ' || org_number[7:9] || ' MVA' AS span FROM companies""")
def _(spark, sf):
    return _number_pages(spark, sf).select("org_number", gates.number_span(F.col("raw_html"), F.col("org_number")).alias("span"))


@query("c21_name_span", f"""
WITH {S.COMPANIES}
SELECT org_number, CASE WHEN c_custkey % 2 = 0 THEN 'Velkommen til ' || upper(p_name) || ' ' || legal_form ELSE split_part(p_name, ' ', 2) || ' og ' || split_part(p_name, ' ', 1) || ' butikken' END AS span FROM companies""")
def _(spark, sf):
    swapped = _text(F.substring_index("p_name", " ", -1), " og ", F.substring_index("p_name", " ", 1), " butikken")
    title = F.when(KEY % 2 == 0, _text("Velkommen til ", F.col("legal_name"))).otherwise(F.concat(F.lit("Forside – "), swapped))
    p = derived.company_pages(spark, sf, F.concat(F.lit("<title>"), title, F.lit("</title>")), F.lit("/"))
    return gates.name_spans(p).select("org_number", F.col("name_span").alias("span"))


@query("c22_contact_span", f"""
WITH {S.COMPANIES}
SELECT org_number, CASE WHEN c_custkey % 2 = 0 THEN 'Tlf. +47 22 33 44 ' || lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') ELSE 'Kai ' || c_custkey || ', 5003 Bergen' END AS span FROM companies""")
def _(spark, sf):
    phones = F.when(KEY % 2 == 0, F.array(_text("223344", F.lpad((KEY % 90 + 10).cast("string"), 2, "0")))).otherwise(F.array().cast("array<string>"))
    p = _number_pages(spark, sf)
    return p.select("org_number", gates.contact_span(F.col("raw_html"), phones, _text("Kai ", KEY), F.lit("5003")).alias("span"))


@query("c24_whole_name_span", f"""
WITH {S.COMPANIES} SELECT org_number, 'Vi er ' || upper(p_name) || ' i Bergen' AS span FROM companies""")
def _(spark, sf):
    p = derived.company_pages(spark, sf, _text("<p>Hei</p><p>Vi er ", F.upper(NAME), " i Bergen</p>"), F.lit("/"))
    return p.select("org_number", gates.whole_name_span(F.col("raw_html"), F.concat("p_name", F.lit(" AS"))).alias("span"))


@query("c25_as_written", f"""
WITH {S.COMPANIES}
SELECT org_number, CASE c_custkey % 3 WHEN 0 THEN 'https://x.no/' || c_custkey WHEN 1 THEN 'https:\\/\\/x.no\\/' || c_custkey ELSE 'https%3A%2F%2Fx.no%2F' || c_custkey END AS written FROM companies""")
def _(spark, sf):
    link = _text("https://x.no/", KEY)
    page = F.when(KEY % 3 == 0, _text("<a href='", link, "'>")).when(KEY % 3 == 1, _text('{"u":"', F.replace(link, F.lit("/"), F.lit("\\/")), '"}')).otherwise(
        _text("<iframe src='?href=https%3A%2F%2Fx.no%2F", KEY, "'>"))
    return derived.companies(spark, sf).select("org_number", registry.as_written(page, link).alias("written"))


@query("c34_dated_lines", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Generalforsamling for ' || p_name || ' (2024-06-1' || (c_custkey % 10) || ')' AS value, '2024-06-1' || (c_custkey % 10) || ' Generalforsamling for ' || p_name AS evidence_span FROM companies""")
def _(spark, sf):
    html = _text("<p>2024-06-1", KEY % 10, " Generalforsamling for ", NAME, "</p><p>2024-01-01 – 2024-02-02</p><p>Nyheter</p>")
    return pages.dated_lines(derived.company_pages(spark, sf, html, F.lit("/"))).select("org_number", "value", "evidence_span")


@query("c35_page_kinds", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'feed' WHEN 1 THEN 'posts' WHEN 2 THEN 'careers' ELSE 'page' END AS kind FROM pages")
def _(spark, sf):
    key = F.col("page_id") % 4
    html = F.when(key == 0, F.concat(F.lit("<?xml?><RSS>"), "html")).otherwise(F.col("html"))
    url = F.when(key == 1, "https://x.no/wp-json/wp/v2/posts?a=1").when(key == 2, "https://karriere.x.no/").otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", pages.page_kind(url, html).alias("kind"))


@query("c36_own_post_links", f"""
WITH {S.COMPANIES}
SELECT org_number, 'Stor ordre til fabrikken vår ' || c_custkey AS title, {_SITE} || '/sak/stor-ordre-til-fabrikken-var' AS link FROM companies""")
def _(spark, sf):
    html = _text(
        '<article><h2>Stor ordre til fabrikken vår ', KEY, '</h2><span>02.02.2024</span></article><li>x</li><div><a href="/kontakt">Kontakt</a>',
        '<a href="/sak/annen">Annen sak</a><a href="/sak/stor-ordre-til-fabrikken-var">Les mer</a></div>')
    p = derived.company_pages(spark, sf, html, F.lit("/nyheter"))
    long_title = pages.block_items(p.withColumn("raw_html", F.regexp_replace("raw_html", r"vår \d+<", "vår<")))
    return long_title.join(p.select("org_number", "c_custkey"), "org_number").select("org_number", _text(F.col("title"), " ", KEY).alias("title"), "link")


@query("c37_canonical_and_text_guard", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'https://a' || c_custkey || '.no/' END AS canonical, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name FROM customer""")
def _(spark, sf):
    html = F.when(KEY % 2 == 0, _text('<link rel="canonical" href=" https://a', KEY, '.no/ ">')).otherwise('<link rel="canonical" href="">')
    doc = F.try_parse_json(F.when(KEY % 3 == 0, _text('{"name":"', F.col("c_name"), '"}')).when(KEY % 3 == 1, _text('{"name":["', F.col("c_name"), '"]}')).otherwise('{"name":12}'))
    return table(spark, sf, "customer").select("c_custkey", pages.canonical_link(html).alias("canonical"), registry.string_at(doc, "$.name").alias("name"))


@query("c35_extract_counts", f"""
SELECT field, count(*) AS facts FROM (
  WITH {S.COMPANIES} SELECT c_custkey, unnest(['organization_name', 'organization_name', 'organization_name', 'official_site', 'registered_address', 'leader', 'company_profile', 'company_profile', 'hiring_signal', 'dated_activity']) AS field FROM companies)
WHERE field <> 'company_profile' GROUP BY field""")
def _(spark, sf):
    facts = pages.extract(_json_ld_pages(spark, sf))
    kept = facts.filter("field <> 'company_profile'").dropDuplicates(["org_number", "field", "value"])
    return kept.groupBy("field").agg(F.count(F.lit(1)).alias("facts"))
