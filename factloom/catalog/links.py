"""Link graph and frontier (inventory C16, D1-D13) and the flagship query."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.catalog import derived
from factloom.catalog import sql as S
from factloom.catalog.registry import query, table
from factloom.functions import fixed, text, urls
from factloom.operators import links, ordered, quality
from factloom.streaming import feeds


def _links(spark, sf):
    return links.page_links(table(spark, sf, "pages"))


@query("flagship_links_per_host", f"""
WITH {S.LINKS},
own AS (SELECT *, {S.normalized("link")} AS normalized FROM links WHERE {S.host("link")} = {S.host()} OR ends_with({S.host("link")}, '.' || {S.host()})),
once AS (SELECT page_id, url, normalized, min(ord) AS ord FROM own GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS r FROM once)
SELECT {S.host("normalized")} AS host, count(*) AS links, count(DISTINCT page_id) AS pages FROM ranked WHERE r <= 2 GROUP BY 1""")
def _(spark, sf):
    found = links.same_site_links(_links(spark, sf)).withColumn("normalized", urls.normalize(F.col("link")))
    unique = ordered.first_wins(found, ["page_id", "normalized"], ["ord"])
    best = ordered.top_k(unique, ["page_id"], ["ord"], 2)
    return best.groupBy(urls.host(F.col("normalized")).alias("host")).agg(F.count(F.lit(1)).alias("links"), F.count_distinct("page_id").alias("pages"))


@query("c16_page_links", f"WITH {S.LINKS} SELECT page_id, ord, link, text FROM links")
def _(spark, sf):
    return _links(spark, sf).select("page_id", F.col("ord").cast("bigint").alias("ord"), "link", "text")


@query("c16_relative_links", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://a.no/x/y/next' WHEN 1 THEN 'https://a.no/up' WHEN 2 THEN 'https://b.no/z' WHEN 3 THEN 'https://a.no/x/y/p?q=' || page_id
  WHEN 4 THEN 'http://c.no/' ELSE 'https://a.no/x/s' || page_id END AS link FROM pages""")
def _(spark, sf):
    kind, key = F.col("page_id") % 6, F.col("page_id").cast("string")
    href = F.when(kind == 0, "next").when(kind == 1, "../../up").when(kind == 2, "//b.no/z").when(kind == 3, F.concat(F.lit("?q="), key)).when(kind == 4, "http://c.no/").otherwise(
        F.concat(F.lit("./../s"), key))
    return table(spark, sf, "pages").select("page_id", urls.absolute(F.lit("https://a.no/x/y/p"), href).alias("link"))


@query("d3_disallow_filter", f"""
WITH {S.LINKS}, f AS (SELECT page_id, ord, {S.host("link")} AS host, {S.path("link")} AS path FROM links),
rules AS (SELECT DISTINCT {S.host()} AS host, '/' || lower(substr(regexp_extract({S.cut_scripts()}, 'href="/([^"]*)"', 1), 1, 2)) AS prefix FROM pages)
SELECT page_id, ord, path FROM f WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.host = f.host AND starts_with(f.path, r.prefix))""")
def _(spark, sf):
    frontier = _links(spark, sf).select("page_id", F.col("ord").cast("bigint").alias("ord"), urls.host(F.col("link")).alias("host"), urls.path(F.col("link")).alias("path"))
    first = F.regexp_extract(text.cut_scripts(F.col("html")), 'href="/([^"]*)"', 1)
    rules = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"), F.concat(F.lit("/"), F.lower(F.left(first, F.lit(2)))).alias("prefix")).distinct()
    return links.disallowed(frontier, rules, "host", "path", "prefix").select("page_id", "ord", "path")


@query("d1_robots_rules", f"""
SELECT {S.host()} || page_id AS host, rule, value FROM pages, (VALUES ('disallow', '/private/'), ('sitemap', 'https://x.no/map.xml')) r(rule, value)
UNION ALL SELECT {S.host()} || page_id, 'disallow', '/p' || page_id FROM pages""")
def _(spark, sf):
    robots = table(spark, sf, "pages").select(F.concat(urls.host(F.col("url")), "page_id").alias("host"), F.concat(
        F.lit("User-agent: badbot\nDisallow: /\n\n# all\nUser-Agent: *\nDisallow: /private/ # secret\nDisallow:\nDisallow: /p"), "page_id",
        F.lit("\r\nuser-agent: other\ndisallow: /no/\nSitemap: https://x.no/map.xml\n"),
    ).alias("body"))
    return links.robots_rules(robots, "host", "body").select("host", "rule", "value")


@query("d2_sitemap_frontier", f"""
WITH p AS (SELECT page_id, {S.host()} AS host FROM pages),
locs AS (SELECT page_id, host, i AS ord, 'https://' || host || w AS loc, w AS path FROM p, (VALUES (0, '/om-oss'), (1, '/nyheter/1'), (2, '/karriere'), (3, '/private/jobs'), (4, '/news/map.xml'), (5, '/produkt/x'), (6, '/kontakt')) v(i, w))
SELECT page_id, loc, CAST(CASE WHEN path = '/karriere' THEN 0 WHEN path = '/nyheter/1' THEN 1 ELSE 2 END AS INT) AS rank FROM locs WHERE path IN ('/om-oss', '/nyheter/1', '/karriere', '/kontakt')""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    paths = ["/om-oss", "/nyheter/1", "/karriere", "/private/jobs", "/news/map.xml", "/produkt/x", "/kontakt"]
    body = F.concat(*[F.concat(F.lit("<url><loc> https://"), "host", F.lit(f"{w} </loc></url>")) for w in paths], F.lit("<loc>https://elsewhere.no/karriere</loc>"))
    located = links.sitemap_locations(p.withColumn("body", body), "page_id", "body").join(p, "page_id")
    rules = p.select("page_id", F.lit("disallow").alias("rule"), F.lit("/private").alias("value"))
    return links.sitemap_frontier(located, rules, "page_id", "host").select("page_id", "loc", "rank")


@query("d5_careers_links", f"""
SELECT page_id, CASE r WHEN 0 THEN 'https://' || {S.host()} || '/karriere' ELSE 'https://jobs.lever.co/' || page_id END AS link, CAST(CASE r WHEN 0 THEN 0 ELSE 0 END AS INT) AS rank
FROM pages, (VALUES (0), (1)) v(r)""")
def _(spark, sf):
    return links.careers_links(_typed_links(spark, sf), urls.host(F.col("page_url"))).select("page_id", "link", "rank")


def _typed_links(spark, sf):
    """Every page with a careers, contact, about, news and applicant-platform link added."""
    host, key = urls.host(F.col("url")), F.col("page_id").cast("string")
    more = F.concat(
        F.lit('<a href="/om-oss">Om oss</a><a href="https://'), host, F.lit('/karriere">x</a><a href="https://jobs.lever.co/'), key,
        F.lit('">Ledige stillinger</a><a href="/stillinger">Karriere</a><a href="/kontakt/">Ta kontakt</a><a href="https://other.no/jobb">Jobb</a>'
              '<a href="/nyheter/2024/01/sak">Sak</a><a href="/aktuelt">Aktuelt</a><a href="/media">News</a><a href="/blogg">Blogg</a>'),
    )
    return links.page_links(table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://"), host, F.lit("/")).alias("url"), F.concat("html", more).alias("html")))


@query("d6_info_links", f"""
SELECT page_id, 'https://' || {S.host()} || p AS link, CAST(r AS INT) AS rank FROM pages, (VALUES (0, '/kontakt/'), (1, '/om-oss')) v(r, p)""")
def _(spark, sf):
    return links.info_links(_typed_links(spark, sf), urls.host(F.col("page_url"))).select("page_id", "link", "rank")


@query("d7_news_links", f"""
SELECT page_id, 'https://' || {S.host()} || p AS link FROM pages, (VALUES ('/aktuelt'), ('/blogg')) v(p)""")
def _(spark, sf):
    return links.news_links(_typed_links(spark, sf), urls.host(F.col("page_url"))).select("page_id", "link")


@query("d7_first_two_links", f"""
WITH {S.LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM links)
SELECT page_id, link FROM r WHERE n <= 2""")
def _(spark, sf):
    return ordered.top_k(_links(spark, sf), ["page_id"], ["ord"], 2).select("page_id", "link")


@query("d8_platform_links", f"""
WITH p AS (SELECT {S.host()} AS host, page_id, row_number() OVER (PARTITION BY {S.host()} ORDER BY page_id) AS n FROM pages)
SELECT host, 'https://jobs.lever.co/' || page_id AS link, 'https://' || host || '/' AS linked_from FROM p WHERE n <= 3""")
def _(spark, sf):
    found = _typed_links(spark, sf).withColumn("host", urls.host(F.col("page_url")))
    return links.ats_links(found, "host", "page_id").select("host", "link", "linked_from")


@query("d9_declared_feeds", "SELECT page_id, 'https://x.no/feed/' || page_id AS feed_url FROM pages WHERE page_id % 2 = 0")
def _(spark, sf):
    tag = F.concat(F.lit('<link rel="alternate" type="application/rss+xml" href="/feed/'), "page_id", F.lit('"><link type="application/atom+xml" href="/other">'))
    p = table(spark, sf, "pages").select("page_id", F.lit("https://x.no/a/b").alias("url"), F.when(F.col("page_id") % 2 == 0, F.concat(tag, "html")).otherwise(F.col("html")).alias("html"))
    return links.declared_feeds(p, "page_id", "url", "html").select("page_id", "feed_url")


@query("d10_frontier", f"""
WITH {S.LINKS}, n AS (SELECT {S.host()} AS host, {S.normalized("link")} AS normalized, page_id, ord FROM links),
seen AS (SELECT DISTINCT {S.host()} AS host, {S.normalized()} AS normalized FROM pages),
first AS (SELECT host, normalized, min(page_id) AS first_page FROM n GROUP BY ALL)
SELECT host, normalized, first_page FROM first f WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.host = f.host AND s.normalized = f.normalized)""")
def _(spark, sf):
    found = _links(spark, sf).withColumn("host", urls.host(F.col("page_url")))
    seen = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"), urls.normalize(F.col("url")).alias("normalized"))
    return links.unseen(found, seen, ["host"], "link", ["page_id", "ord"]).select("host", "normalized", F.col("page_id").alias("first_page"))


@query("d10_frontier_rounds", """
WITH RECURSIVE n AS (SELECT c_nationkey AS host, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS place FROM customer),
e AS (SELECT a.host, a.c_custkey AS a, b.c_custkey AS b FROM n a JOIN n b ON b.host = a.host AND b.place IN (2 * a.place, 2 * a.place + 1, a.place // 2)),
r(host, page, round) AS (
  SELECT host, c_custkey, 0 FROM n WHERE place = 1
  UNION SELECT e.host, e.b, round + 1 FROM r JOIN e ON e.host = r.host AND e.a = r.page WHERE round < 40 AND e.b > e.a)
SELECT host, CAST(first AS INT) AS round, count(*) AS pages FROM (SELECT host, page, min(round) AS first FROM r GROUP BY ALL) GROUP BY ALL""")
def _(spark, sf):
    """From the first page of every host to the end; a page links two later ones and, back again, the one that links it."""
    c = table(spark, sf, "customer").select("c_nationkey", "c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).alias("place"))
    page = F.concat(F.lit("https://x.no/"), F.col("c_custkey").cast("string"))
    seeds = c.filter("place = 1").select(F.col("c_nationkey").alias("host"), page.alias("url"), F.col("c_custkey").alias("ord"))
    to = c.select("c_nationkey", F.col("place").alias("to"), page.alias("link"))
    steps = c.select("c_nationkey", "c_custkey", F.explode(F.array(F.col("place") * 2, F.col("place") * 2 + 1, F.floor(F.col("place") / 2).cast("int"))).alias("to"))
    edges = steps.join(to, ["c_nationkey", "to"]).select(
        F.col("c_nationkey").alias("host"), urls.normalize(page).alias("from_normalized"), "link", F.col("c_custkey").alias("page_ord"), F.col("to").alias("ord"))
    reached = links.expand_frontier(seeds, edges, "host")
    return reached.groupBy("host", "round").agg(F.count(F.lit(1)).alias("pages"))


@query("d11_rebase", f"""
WITH v AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS root FROM pages),
m AS (SELECT root, arg_max('https://' || {S.host()}, page_id) AS landing FROM v WHERE root <> 'https://' || {S.host()} GROUP BY root)
SELECT page_id, coalesce(landing, v.root) || substr(url, length(v.root) + 1) AS url FROM v LEFT JOIN m USING (root)""")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    roots = links.landing_roots(p.withColumn("landed", F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/"))), "url", "landed", ["page_id"])
    return links.rebase(p, roots, "url")


@query("d12_script_built", f"""
WITH v AS (SELECT page_id, html, length({S.visible()}) AS visible, len(regexp_extract_all(html, '(?i)<script\\b')) AS scripts FROM pages)
SELECT page_id, (page_id % 5 = 0 AND visible < 8000) OR (scripts >= 3 AND visible < 600) OR (scripts >= 8 AND visible * 1.0 / length(html) < 0.04) AS script_built,
  visible < 60 AS shell FROM v""")
def _(spark, sf):
    html = F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit('<div id="root"></div>'))).otherwise(F.col("html"))
    return table(spark, sf, "pages").select("page_id", links.looks_script_built(html).alias("script_built"), links.is_shell(F.col("html")).alias("shell"))


@query("d12_render_work_list", f"""
SELECT page_id, 'homepage' AS why FROM pages WHERE page_id % 4 = 0 AND length({S.visible()}) < 8000 UNION ALL
SELECT page_id, 'careers' FROM pages WHERE page_id % 4 = 1 AND length({S.visible()}) < 8000""")
def _(spark, sf):
    kind, host = F.col("page_id") % 4, urls.host(F.col("url"))
    mount = F.lit('<div id="app"></div>')
    p = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("https://"), host, F.when(kind == 1, "/karriere").when(kind == 0, "/").otherwise("/om")).alias("url"),
        F.concat("html", mount).alias("html"), F.lit(None).cast("string").alias("linked_from"), host.alias("official"),
    )
    none = p.filter("page_id < 0").select("page_id")
    return links.render_work_list(p, "page_id", "url", "html", "linked_from", "official", none, none, none).select("page_id", "why")


@query("d13_post_lists", f"""
SELECT page_id, 'https://' || {S.host()} || '/wp-json/wp/v2/posts?per_page=6&_fields=date,title,link' AS posts FROM pages WHERE page_id % 3 = 0""")
def _(spark, sf):
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<img src="/wp-content/a.png">'), "html")).otherwise(F.col("html"))
    p = table(spark, sf, "pages").withColumn("html", html).filter(links.is_wordpress(F.col("html")))
    return p.select("page_id", links.post_list_url(F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/x"))).alias("posts"))


@query("g11_busiest_hosts", f"""
SELECT {S.host()} AS host, count(*) AS requests FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    return quality.request_breakdown(p, urls.host(F.col("url")), F.lit(200))[1]


@query("g11_request_totals", """
SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'click') AS redirects, count(*) FILTER (WHERE event_type = 'error') AS server_errors FROM events""")
def _(spark, sf):
    status = F.when(F.col("event_type") == "click", 301).when(F.col("event_type") == "error", 502).otherwise(200)
    return quality.request_breakdown(table(spark, sf, "events"), F.col("user_id"), status)[0]


@query("l4_daily_fetches", """
SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS first_at, max(ts) AS last_at, count(*) AS fetches FROM events GROUP BY ALL""")
def _(spark, sf):
    return feeds.daily_dedupe(table(spark, sf, "events"), ["user_id"], "ts")
