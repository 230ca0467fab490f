"""Link-graph and frontier operators over page and link tables. Fetching is not part of them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed, text, urls
from factloom.operators.joins import SALTS, salted_join
from factloom.operators.ordered import first_wins, top_k
from factloom.session import materialise

_PLAIN_FILES = [".pdf", ".jpg", ".png", ".zip"]
_PLAIN_FILES_XML = [".pdf", ".jpg", ".png", ".zip", ".xml"]


def anchors(html: Column, page_url: Column) -> Column:
    """The usable anchors of a cleaned piece of markup, in order, as array<struct<ord, link, host, path, text>>."""
    found = F.regexp_extract_all(html, F.lit(fixed.ANCHOR), 0)
    read = F.transform(found, lambda a, i: F.struct(
        i.alias("ord"),
        text.entities_decoded(text.strip(text.first_group(F.regexp_extract(a, fixed.ANCHOR, 1), fixed.HREF))).alias("href"),
        text.fragment_text(F.regexp_extract(a, fixed.ANCHOR, 2)).alias("text"),
    ))
    usable = F.filter(read, lambda a: a["href"].isNotNull() & ~a["href"].rlike("^(?:#|mailto:|tel:|javascript:)"))
    placed = F.transform(usable, lambda a: F.struct(a["ord"].alias("ord"), urls.absolute(page_url, a["href"]).alias("link"), a["text"].alias("text")))
    return F.transform(placed, lambda a: F.struct(
        a["ord"].alias("ord"), a["link"].alias("link"), urls.host(a["link"]).alias("host"), urls.path(a["link"]).alias("path"), a["text"].alias("text")
    ))


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every link of a page as (key, page_url, ord, link, link_host, link_path, text). The markup stays in the
    narrow map: only links leave it, each part of them worked out once."""
    found = anchors(text.cut_scripts(F.col(html)), F.col(url))
    rows = pages.select(F.col(key), F.col(url).alias("page_url"), F.explode(found).alias("_a"))
    return rows.select(
        key, "page_url", "_a.ord", "_a.link", F.col("_a.host").alias("link_host"), F.col("_a.path").alias("link_path"), "_a.text"
    )


def _ranked_links(links: DataFrame, wanted: Column, rank: Column, key: str, limit: int) -> DataFrame:
    """Qualifying links of a page, one per address, best rank then page order first."""
    kept = links.filter(wanted).withColumn("_identity", urls.page_identity(F.col("link"))).withColumn("rank", rank)
    others = kept.filter(F.col("_identity") != F.regexp_replace("page_url", "/+$", ""))
    unique = first_wins(others, [key, "_identity"], ["ord"]).drop("_identity")
    return top_k(unique, [key], ["rank", "ord"], limit)


def careers_links(links: DataFrame, official: Column, key: str = "page_id", limit: int = fixed.TOP_K["careers_links"]) -> DataFrame:
    """Careers pages a page links to: same site or an applicant-tracking platform."""
    host, path, label = F.col("link_host"), F.col("link_path"), F.col("text")
    by_url = path.rlike(fixed.CAREERS_PATH) | host.rlike(fixed.CAREERS_HOST)
    by_text = F.length(label).between(1, 40) & label.rlike(fixed.CAREERS_LINK_TEXT)
    reachable = urls.on_site(host, official) | urls.on_any(host, fixed.ATS_HOSTS)
    wanted = (by_url | by_text) & reachable & ~urls.has_extension(path, _PLAIN_FILES)
    return _ranked_links(links, wanted, F.when(by_url, 0).otherwise(1), key, limit)


def info_links(links: DataFrame, official: Column, key: str = "page_id", limit: int = fixed.TOP_K["info_links"]) -> DataFrame:
    """Contact and about pages of the same site, contact first."""
    host, path, label = F.col("link_host"), F.col("link_path"), F.col("text")
    by_path = path.rlike(fixed.INFO_PATH) & (F.size(urls.segments(path)) <= 2)
    by_text = F.length(label).between(1, 30) & label.rlike(fixed.INFO_TEXT)
    wanted = (by_path | by_text) & urls.on_site(host, official) & ~urls.has_extension(path, _PLAIN_FILES_XML)
    contact = F.concat(path, F.lit(" "), label).rlike("(?iu)kontakt|contact")
    return _ranked_links(links, wanted, F.when(contact, 0).otherwise(1), key, limit)


def news_links(links: DataFrame, official: Column, key: str = "page_id", limit: int = fixed.TOP_K["news_links"]) -> DataFrame:
    """News listings of the same site, at most two levels deep when found by path."""
    host, path, label = F.col("link_host"), F.col("link_path"), F.col("text")
    by_path = path.rlike(fixed.NEWS_PATH)
    by_text = F.length(label).between(1, 30) & label.rlike(fixed.NEWS_LINK_TEXT)
    shallow = ~by_path | (F.size(urls.segments(path)) <= 2)
    wanted = (by_path | by_text) & urls.on_site(host, official) & shallow & ~urls.has_extension(path, _PLAIN_FILES_XML)
    return _ranked_links(links, wanted, F.when(by_path, 0).otherwise(1), key, limit)


def same_site_links(links: DataFrame) -> DataFrame:
    return links.filter(urls.on_site(F.col("link_host"), urls.host(F.col("page_url"))))


def ats_links(links: DataFrame, company: str, page_order: str, limit: int = fixed.TOP_K["ats_pages"]) -> DataFrame:
    """Applicant-platform pages linked from a company's own pages, with the page that links them."""
    found = links.filter(urls.on_any(F.col("link_host"), fixed.ATS_HOSTS)).withColumn("_n", urls.normalize(F.col("link")))
    unique = first_wins(found, [company, "_n"], [page_order, "ord"]).drop("_n")
    return top_k(unique, [company], [page_order, "ord"], limit).withColumn("linked_from", F.col("page_url"))


def declared_feeds(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """The first RSS or Atom feed a page declares."""
    tags = F.regexp_extract_all(F.col(html), F.lit(fixed.FEED_DECLARATION), 0)
    hrefs = F.filter(F.transform(tags, lambda t: text.strip(text.first_group(t, fixed.HREF))), lambda h: h.isNotNull())
    href = F.get(hrefs, F.lit(0))
    return pages.select(key, F.col(url).alias("page_url"), href.alias("_href")).filter("_href IS NOT NULL").select(
        key, "page_url", urls.absolute(F.col("page_url"), F.col("_href")).alias("feed_url")
    )


# --- robots and sitemaps ------------------------------------------------------------------

def robots_rules(robots: DataFrame, key: str, body: str) -> DataFrame:
    """(key, rule, value) rows: `disallow` of the `*` agent, and `sitemap` locations, in file order.
    One file is one row, so the current agent is folded along its lines in place."""
    lines = F.transform(
        F.split(F.col(body), r"\r\n|\n|\r"),
        lambda l: F.struct(
            F.lower(text.strip(F.substring_index(F.substring_index(l, "#", 1), ":", 1))).alias("k"),
            text.strip(F.regexp_extract(F.substring_index(l, "#", 1), r"(?s)^[^:]*:(.*)$", 1)).alias("v"),
            F.substring_index(l, "#", 1).contains(":").alias("rule"),
        ),
    )
    rules = F.array().cast("array<struct<rule:string,value:string>>")

    def entry(kind: str, line: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("rule"), line["v"].alias("value")))

    folded = F.aggregate(
        F.filter(lines, lambda l: l["rule"]),
        F.struct(F.lit(False).alias("all"), rules.alias("rules")),
        lambda acc, l: F.struct(
            F.when(l["k"] == "user-agent", l["v"] == "*").otherwise(acc["all"]).alias("all"),
            F.when((l["k"] == "disallow") & acc["all"] & (l["v"] != ""), F.concat(acc["rules"], entry("disallow", l)))
            .when((l["k"] == "sitemap") & (l["v"] != ""), F.concat(acc["rules"], entry("sitemap", l)))
            .otherwise(acc["rules"]).alias("rules"),
        ),
    )
    return robots.select(key, F.posexplode(folded["rules"]).alias("ord", "_r")).select(key, "ord", "_r.rule", "_r.value")


def sitemap_locations(sitemaps: DataFrame, key: str, body: str) -> DataFrame:
    return sitemaps.select(
        key, F.posexplode(F.regexp_extract_all(F.col(body), F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("ord", "loc")
    )


def disallowed(frontier: DataFrame, rules: DataFrame, host: str, path: str, prefix: str, salts: int = SALTS) -> DataFrame:
    """Frontier rows whose path starts with no rule of their host. A host has few rules and may own much
    of the frontier, so frontier rows are salted and rules repeated; the anti join emits no pairs."""
    left = frontier.withColumn("_salt", F.pmod(F.xxhash64(*frontier.columns), F.lit(salts)).cast("int"))
    right = rules.select(F.col(host).alias("_host"), F.col(prefix).alias("_prefix")).distinct().withColumn(
        "_rule_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    blocked = (F.col(host) == F.col("_host")) & (F.col("_salt") == F.col("_rule_salt")) & F.col(path).startswith(F.col("_prefix"))
    return left.join(right, blocked, "left_anti").drop("_salt")


def sitemap_frontier(locations: DataFrame, rules: DataFrame, key: str, host: str, limit: int = fixed.TOP_K["sitemap_urls"]) -> DataFrame:
    """Sitemap pages worth reading: same host, allowed, a priority word in the path; careers and news first."""
    loc = F.col("loc")
    here = locations.filter((urls.host(loc) == F.col(host)) & urls.is_sitemap_priority(loc)).withColumn("path", urls.path(loc))
    allowed = disallowed(here, rules.filter("rule = 'disallow'").select(key, F.col("value").alias("prefix")), key, "path", "prefix")
    return top_k(allowed.withColumn("rank", urls.sitemap_rank(loc)), [key], ["rank", "ord"], limit).drop("path")


# --- frontier -----------------------------------------------------------------------------

def unique_pages(candidates: DataFrame, keys: list[str], url: str, order: list) -> DataFrame:
    """One row per normalised URL, the first one seen; where it was linked from stays with it."""
    return first_wins(candidates.withColumn("normalized", urls.normalize(F.col(url))), [*keys, "normalized"], order)


def unseen(candidates: DataFrame, seen: DataFrame, keys: list[str], url: str, order: list) -> DataFrame:
    """The next frontier: new pages only."""
    return unique_pages(candidates, keys, url, order).join(seen.select(*keys, "normalized").distinct(), [*keys, "normalized"], "left_anti")


def expand_frontier(seeds: DataFrame, edges: DataFrame, key: str, rounds: int | None = None) -> DataFrame:
    """Pages reached from the seeds, first seen wins, in up to `rounds` steps or until nothing is new. `seeds` is (key, url, ord);
    `edges` is (key, from_normalized, link, page_ord, ord). A round joins the last round's new pages only, with salts,
    as one host may own much of the links. Each round is written out, so lineage does not grow with the rounds."""
    start = unique_pages(seeds, [key], "url", ["ord"])
    seen = materialise(start.select(key, "normalized", "url", F.lit(None).cast("string").alias("linked_from"), F.lit(0).alias("round")), "frontier-0")
    front, number = seen, 0
    while (rounds is None or number < rounds) and not front.isEmpty():
        number += 1
        step = salted_join(edges, front.select(key, F.col("normalized").alias("from_normalized"), F.col("url").alias("linked_from")), [key, "from_normalized"], "inner")
        found = unseen(step, seen, [key], "link", ["page_ord", "ord"]).select(
            key, "normalized", F.col("link").alias("url"), "linked_from", F.lit(number).alias("round")
        )
        front = materialise(found, f"frontier-{number}")
        seen = seen.unionByName(front)
    return seen


def landing_roots(visits: DataFrame, url: str, landed: str, order: list) -> DataFrame:
    """Scheme and host each root was last seen to redirect to."""
    moves = visits.select(urls.root_of(F.col(url)).alias("root"), urls.root_of(F.col(landed)).alias("landing_root"), F.struct(*order).alias("_o"))
    return moves.filter("root <> landing_root AND landing_root <> ''").groupBy("root").agg(F.max_by("landing_root", "_o").alias("landing_root"))


def rebase(frontier: DataFrame, roots: DataFrame, url: str) -> DataFrame:
    """Rewrite frontier URLs to the root their site lives on. Roots are few rows per key and a root
    can own much of the frontier, hence the salted join."""
    keyed = frontier.withColumn("root", urls.root_of(F.col(url)))
    return salted_join(keyed, roots, ["root"], "left").withColumn(url, urls.rebased(F.col(url), F.col("landing_root"))).drop("root", "landing_root")


# --- which pages need more than a static read ---------------------------------------------

def looks_script_built(html: Column) -> Column:
    """Probably drawn by scripts: a framework's mount point, or little text for the amount of script."""
    visible = F.length(text.visible_text(html))
    scripts = F.regexp_count(html, F.lit(r"(?iU)<script\b"))
    return (
        (html.rlike(fixed.FRAMEWORK_MARKER) & (visible < 8000))
        | ((scripts >= 3) & (visible < 600))
        | ((scripts >= 8) & (visible / F.greatest(F.length(html), F.lit(1)) < 0.04))
    )


def is_shell(html: Column) -> Column:
    return F.length(text.visible_text(html)) < fixed.SHELL_CHARS


def render_work_list(
    pages: DataFrame, key: str, url: str, html: str, linked_from: str, official: str, careers: DataFrame, social: DataFrame,
    roles: DataFrame,
) -> DataFrame:
    """Pages whose static read fails a completeness check: a script-built homepage that shows neither a
    careers link nor a profile, or a script-built careers page that lists no ad."""
    built = pages.filter(looks_script_built(F.col(html))).select(key, url, linked_from, official)
    at_home = (
        F.col(linked_from).isNull() & urls.is_homepage_path(F.col(url)) & urls.host(F.col(url)).endswith(F.col(official))
    )
    home = built.filter(at_home).join(careers.select(key).distinct(), key, "left_anti").join(social.select(key).distinct(), key, "left_anti")
    listing = built.filter(~at_home & urls.is_careers_url(F.col(url))).join(roles.select(key).distinct(), key, "left_anti")
    return home.withColumn("why", F.lit("homepage")).unionByName(listing.withColumn("why", F.lit("careers")))


def is_wordpress(html: Column) -> Column:
    return html.rlike(fixed.WORDPRESS)


def post_list_url(url: Column) -> Column:
    return F.concat(urls.scheme(url), F.lit("://"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(fixed.POST_LIST_PATH))
