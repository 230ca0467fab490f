"""URL expressions. Every function maps columns to a column; nothing leaves the JVM.

Parts are cut with the generic-syntax expression of RFC 3986 rather than `parse_url`, which returns
NULL for spaces, pipes and other characters that real links carry."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions.let import let

_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 5)


# An authority with one kind of bracket only; such a link has no usable parts.
_MALFORMED = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#\]]*\[[^/?#\]]*|[^/?#\[]*\][^/?#\[]*)(?:[/?#]|$)"
# The authority without `www.`; matches nothing when the brackets do not pair up.
_HOST = r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:www\.)?([^/?#\[\]]*|[^/?#\[]*\[[^/?#]*\][^/?#]*)(?:[/?#]|$)"


def malformed(url: Column) -> Column:
    return url.rlike(_MALFORMED)


def parse(url: Column) -> Column:
    """struct(scheme, host, path, query, malformed): the parts the predicates below share."""
    return F.struct(
        scheme(url).alias("scheme"), host(url).alias("host"), path(url).alias("path"), query(url).alias("query"), malformed(url).alias("malformed")
    )


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def host(url: Column) -> Column:
    """Authority in lower case without `www.`; empty for a malformed link. A port is kept."""
    return F.regexp_extract(F.lower(url), _HOST, 1)


def host_of_site(site: Column) -> Column:
    """Host of a website written with or without its scheme."""
    return host(with_scheme(site))


def with_scheme(site: Column) -> Column:
    return F.when(site.contains("://"), site).otherwise(F.concat(F.lit("https://"), site))


def label(site: Column) -> Column:
    """First label of the host: `acme` for https://www.acme.no/."""
    return F.substring_index(host_of_site(site), ".", 1)


def hostname(url: Column) -> Column:
    """Host without user info, port or IPv6 brackets."""
    a = F.regexp_replace(authority(url), r"^[^@]*@", "")
    return F.when(a.startswith("["), F.regexp_extract(a, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(a, ":", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(authority(url), r"^[^@]*@", ""), r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def join_rest(p: Column, q: Column, base: Column) -> Column:
    return F.concat(base, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


# --- normal forms -------------------------------------------------------------------------

def is_tracking_param(key: Column) -> Column:
    k = F.lower(key)
    return k.startswith("utm_") | k.isin(fixed.TRACKING_PARAMS)


def _form_decoded(text: Column) -> Column:
    spaced = F.replace(text, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(text), spaced)


def _form_encoded(text: Column) -> Column:
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _kept_params(q: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(q, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _form_decoded(F.substring_index(p, "=", 1)).alias("k"),
            _form_decoded(F.when(p.contains("="), F.regexp_replace(p, r"^[^=]*=", "")).otherwise(F.lit(""))).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~is_tracking_param(p["k"]))
    return F.array_join(
        F.transform(kept, lambda p: F.concat(_form_encoded(p["k"]), F.lit("="), _form_encoded(p["v"]))), "&"
    )


def normalize(url: Column) -> Column:
    """One spelling per page: lower-case scheme and host, no `www.`, default port, fragment, tracking
    parameters or trailing slash. A malformed URL is returned as written."""
    read = F.struct(
        scheme(url).alias("scheme"), without_www(hostname(url)).alias("host"), port(url).alias("port"), path(url).alias("path"),
        query(url).alias("query"), malformed(url).alias("malformed"),
    )
    return let(read, lambda u: _normalized(url, u))


def _normalized(url: Column, u: Column) -> Column:
    number = u["port"].try_cast("int")
    bad = u["malformed"] | ((u["port"] != "") & (number.isNull() | ~number.between(0, 65535)))
    default = ((u["scheme"] == "http") & (number == 80)) | ((u["scheme"] == "https") & (number == 443))
    netloc = F.concat(u["host"], F.when((u["port"] == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string"))))
    base = F.concat(
        F.when(u["scheme"] != "", F.concat(u["scheme"], F.lit(":"))).otherwise(F.lit("")),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(F.lit("")),
    )
    trimmed = F.when(F.length(u["path"]) > 1, F.regexp_replace(u["path"], "/+$", "")).otherwise(u["path"])
    kept = F.when(u["query"] == "", F.lit("")).otherwise(_kept_params(u["query"]))
    whole = let(kept, lambda q: join_rest(F.when(trimmed == "", F.lit("/")).otherwise(trimmed), q, base))
    return F.when(bad, url).otherwise(whole)


def same_page(a: Column, b: Column) -> Column:
    return normalize(a) == normalize(b)


def clean_page(url: Column) -> Column:
    """The page without fragment, tracking parameters or bare flags; a parameter naming the page stays."""
    kept = F.array_join(
        F.filter(
            F.split(query(url), "&"),
            lambda p: (p != "") & p.contains("=") & ~F.substring_index(p, "=", 1).rlike(fixed.PAGE_TRACKING_PARAM),
        ),
        "&",
    )
    raw_authority = F.regexp_extract(url, _PARTS, 2)
    base = F.concat(
        F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(F.lit("")),
        F.when(raw_authority != "", F.concat(F.lit("//"), raw_authority)).otherwise(F.lit("")),
    )
    return F.when(malformed(url), url).otherwise(join_rest(path(url), kept, base))


def page_key(url: Column) -> Column:
    """A page regardless of its language copy: host, then the path without a leading language segment."""
    parts = segments(path(url))
    kept = F.when(
        (F.size(parts) > 1) & F.coalesce(F.get(parts, F.lit(0)).rlike(fixed.LANGUAGE_SEGMENT), F.lit(False)),
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
    ).otherwise(parts)
    key = F.concat(without_www(authority(url)), F.lit("/"), F.lower(F.array_join(kept, "/")))
    return F.when(malformed(url), F.lower(url)).otherwise(key)


def site_key(value: Column) -> Column:
    """`https://www.Acme.no/` and `acme.no` are one site."""
    bare = F.regexp_replace(F.lower(F.trim(value)), r"^[a-z]+://", "")
    return F.regexp_replace(without_www(bare), "/+$", "")


def base_domain(domain: Column) -> Column:
    return F.substring_index(domain, ".", -2)


def page_identity(url: Column) -> Column:
    """A link with its fragment and trailing slashes removed, used to tell links of one page apart."""
    return F.regexp_replace(F.substring_index(url, "#", 1), "/+$", "")


# --- membership ---------------------------------------------------------------------------

def on_site(domain: Column, official: Column) -> Column:
    """Same host, or a subdomain of it."""
    return (domain == official) | domain.endswith(F.concat(F.lit("."), official))


def on_any(domain: Column, hosts: list[str]) -> Column:
    """Member of a fixed host list, subdomains included: one match against the list's own pattern."""
    return F.substring_index(domain, ":", 1).rlike(r"(?:^|\.)(?:" + "|".join(h.replace(".", r"\.") for h in hosts) + ")$")


# --- joining a link to the page it was found on -------------------------------------------

def _resolved_dots(p: Column) -> Column:
    parts = F.split(p, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    ends_in_dots = p.rlike(r"(?:^|/)\.\.?$")
    joined = F.array_join(kept, "/")
    return F.when(ends_in_dots & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def absolute(base: Column, link: Column) -> Column:
    """`link` as seen from the page `base`: absolute, protocol-relative, rooted, query-only or relative."""
    base_scheme, base_authority = F.lower(F.regexp_extract(base, _PARTS, 1)), F.regexp_extract(base, _PARTS, 2)
    root = F.concat(base_scheme, F.lit("://"), base_authority)
    tail = F.concat(
        F.when(link.rlike(r"^[^#]*\?."), F.concat(F.lit("?"), query(link))).otherwise(F.lit("")),
        F.when(link.contains("#"), F.regexp_extract(link, "(?s)(#.+)$", 1)).otherwise(F.lit("")),
    )
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(base_scheme, F.lit(":"), link))
        .when(link.startswith("?"), F.concat(root, path(base), tail))
        .when(link.startswith("#"), F.concat(F.substring_index(base, "#", 1), link))
        .otherwise(F.concat(root, let(_merged(base, path(link)), _without_dots), tail))
    )


def _merged(base: Column, link_path: Column) -> Column:
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return F.when(link_path.startswith("/"), link_path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), link_path))


def _without_dots(merged: Column) -> Column:
    return F.when(merged.rlike(r"(?:^|/)\.\.?(?:/|$)"), _resolved_dots(merged)).otherwise(merged)


# --- predicates over candidate and frontier URLs ------------------------------------------

def is_homepage_path(url: Column) -> Column:
    return path(url).isin("", "/")


def is_homepage(url: Column) -> Column:
    """The site root, or its language or index copy."""
    parts = segments(path(url))
    one = F.coalesce(F.get(parts, F.lit(0)).rlike(r"(?i)^(?:[a-z]{2}(?:-[a-z]{2})?|index\.(?:html?|php))$"), F.lit(False))
    return ~malformed(url) & ((F.size(parts) == 0) | ((F.size(parts) == 1) & one))


def is_deep_page(url: Column) -> Column:
    """A registered website below its site's root: one unit of a bigger site. A language prefix is not depth."""
    return F.exists(segments(path(url)), lambda s: ~F.lower(s).isin(fixed.LANGUAGE_NAMES))


def is_directory_shaped(url: Column) -> Column:
    words = F.array(*[F.lit(w) for w in fixed.DIRECTORY_SEGMENTS])
    return F.arrays_overlap(segments(F.lower(path(url))), words)


def is_web_page(url: Column) -> Column:
    """False for documents, images, archives and media."""
    p = F.lower(F.substring_index(F.substring_index(url, "?", 1), "#", 1))
    return ~p.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in fixed.NON_PAGE_EXTENSIONS) + ")$")


def has_extension(p: Column, extensions: list[str]) -> Column:
    return F.lower(p).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")


def embedded_numbers(text: Column) -> Column:
    """Nine-digit runs, the shape of an organisation number."""
    return F.regexp_extract_all(text, F.lit(r"(?<!\d)(\d{9})(?!\d)"), 1)


def embeds_a_number(url: Column) -> Column:
    return url.rlike(r"(?<!\d)\d{9}(?!\d)")


def embeds_another_number(url: Column, own: Column) -> Column:
    return F.coalesce(F.exists(embedded_numbers(url), lambda n: n != own), F.lit(False))


def is_foreign_tld(url: Column) -> Column:
    h = F.substring_index(authority(url), ":", 1)
    tld = F.when(h.contains("."), F.substring_index(h, ".", -1)).otherwise(F.lit(""))
    return (F.length(tld) == 2) & ~tld.isin(fixed.HOME_TLDS)


def is_aggregator(url: Column) -> Column:
    return on_any(authority(url), fixed.AGGREGATOR_HOSTS)


def same_label(asked: Column, landed: Column) -> Column:
    """Landed on the name asked for, whatever the ending."""

    def name(u: Column) -> Column:
        h = without_www(authority(u))
        return F.when(h.contains("."), F.regexp_replace(h, r"\.[^.]*$", "")).otherwise(h)

    return (name(asked) != "") & (name(asked) == name(landed))


def could_be_own_site(url: Column) -> Column:
    """A search result worth checking: a page, not an aggregator, a directory listing or a numbered record."""
    return is_web_page(url) & ~is_aggregator(url) & ~is_directory_shaped(url) & ~embeds_a_number(url)


def is_sitemap_priority(url: Column) -> Column:
    p = F.lower(path(url))
    return ~p.endswith(".xml") & p.rlike("|".join(fixed.SITEMAP_WORDS))


def sitemap_rank(url: Column) -> Column:
    """0 careers, 1 news, 2 the rest."""
    p = F.lower(path(url))
    return (
        F.when(p.rlike("|".join(fixed.CAREERS_SITEMAP_WORDS)), 0)
        .when(p.rlike("|".join(fixed.NEWS_SITEMAP_WORDS)), 1)
        .otherwise(2)
    )


def _ipv4_number(text: Column) -> Column:
    octets = F.transform(F.split(text, r"\."), lambda o: o.try_cast("bigint"))
    return F.when(
        text.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$") & F.forall(octets, lambda o: o <= 255),
        F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o),
    )


def _private_ipv4(number: Column) -> Column:
    hit = F.lit(False)
    for block in fixed.PRIVATE_IPV4:
        network, bits = block.split("/")
        first = 0
        for octet in network.split("."):
            first = first * 256 + int(octet)
        hit = hit | number.between(first, first + 2 ** (32 - int(bits)) - 1)
    return hit


def is_safe_outbound(url: Column) -> Column:
    """http(s) with a host that is neither an internal name nor a non-public address literal."""
    h = F.regexp_replace(F.trim(hostname(url)), r"\.+$", "")
    internal = (h == "localhost") | h.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in fixed.INTERNAL_SUFFIXES) + ")$")
    mapped = F.regexp_extract(h, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    v4 = _ipv4_number(F.when(mapped != "", mapped).otherwise(h))
    private_v6 = h.contains(":") & (mapped == "") & h.rlike(r"^(?:::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:db8:|100::)")
    return (
        scheme(url).isin("http", "https") & (h != "") & ~internal & ~private_v6
        & ~F.coalesce(_private_ipv4(v4), F.lit(False))
    )


def is_careers_url(url: Column, with_platforms: bool = True) -> Column:
    """A careers path or host, or an applicant-tracking platform; never a back-office page."""
    p = path(url)
    marked = F.concat(p, F.when(query(url) != "", F.lit("?")).otherwise(F.lit("")))
    found = host(url).rlike(fixed.CAREERS_HOST) | marked.rlike(fixed.CAREERS_PATH)
    if with_platforms:
        found = found | on_any(host(url), fixed.ATS_HOSTS)
    return ~p.rlike(fixed.BACK_OFFICE_PATH) & found


def is_post_link(url: Column, page: Column) -> Column:
    """A link that can be a news post's own page: same site as `page`, below its root, not a contact,
    legal, careers, shop or listing path. A press-release service counts as the publisher's own."""
    return let(parse(page), lambda p: is_post_of(url, p))


def is_post_of(url: Column, page: Column) -> Column:
    """`is_post_link` for a page given by its parts (`parse`), which many links share."""
    return let(parse(url), lambda u: _is_post(u, page))


def _is_post(u: Column, p: Column) -> Column:
    own_path = F.regexp_replace(u["path"], "/+$", "")
    marked = F.concat(u["path"], F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise(F.lit("")))
    same_site = (
        on_site(u["host"], p["host"]) & (own_path != "") & (own_path != F.regexp_replace(p["path"], "/+$", ""))
        & ~has_extension(own_path, [".jpg", ".png", ".gif", ".zip"]) & ~marked.rlike(fixed.NOT_A_POST_PATH)
    )
    on_newswire = on_any(u["host"], fixed.PRESS_RELEASE_HOSTS) & u["path"].rlike("[^/]")
    return ~u["malformed"] & ~p["malformed"] & u["scheme"].isin("http", "https") & F.when(
        on_any(u["host"], fixed.PRESS_RELEASE_HOSTS), on_newswire).otherwise(same_site)


def site_root(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url), F.lit("/"))


def is_post_page(url: Column) -> Column:
    return is_post_link(url, site_root(url))


def is_owner_page(url: Column) -> Column:
    """The home page and its contact and about pages: where a site names its owner."""
    p = path(url)
    return F.when(p == "", F.lit("/")).otherwise(p).rlike(fixed.OWNER_PATH)


def rebased(url: Column, landing_root: Column) -> Column:
    """`url` moved to the scheme and host its site was seen to live on."""
    root = root_of(url)
    rest = F.substr(url, F.length(root) + 1)
    return F.when(landing_root.isNull() | (root == ""), url).otherwise(F.concat(landing_root, rest))


def root_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def status_state(code: Column) -> Column:
    """HTTP status -> evidence state; no response at all is a failure."""
    return (
        F.when(code.between(200, 299), "available").when(code == 404, "not_available")
        .when(code.isin(401, 403, 429), "blocked").otherwise("failed")
    )
