"""Pieces of oracle SQL used by several queries."""
from __future__ import annotations


def host(url: str = "url") -> str:
    return rf"regexp_replace(lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\.', '')"


def path(url: str = "url") -> str:
    return rf"regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"


def query_string(url: str = "url") -> str:
    return rf"regexp_extract({url}, '^[^?#]*\?([^#]*)', 1)"


def cut_scripts(html: str = "html") -> str:
    return (
        rf"regexp_replace(regexp_replace({html}, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), "
        rf"'(?is)<style\b[^>]*>.*?</style>', ' ', 'g')"
    )


def squeeze(value: str) -> str:
    return rf"trim(regexp_replace({value}, '\s+', ' ', 'g'))"


def strip_tags(html: str) -> str:
    return rf"regexp_replace({html}, '<[^>]+>', ' ', 'g')"


def visible(html: str = "html") -> str:
    return squeeze(strip_tags(cut_scripts(html)))


def entities(value: str) -> str:
    for entity, char in (
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
    ):
        value = f"replace({value}, '{entity}', '{char}')"
    return value


def normalized(url: str = "url") -> str:
    kept = (
        f"array_to_string(list_filter(string_split({query_string(url)}, '&'), lambda p: p <> '' AND NOT "
        "(starts_with(lower(split_part(p, '=', 1)), 'utm_') OR lower(split_part(p, '=', 1)) IN "
        "('gclid', 'fbclid', 'msclkid', 'mc_cid', 'mc_eid', 'ref', 'ref_src'))), '&')"
    )
    return (
        f"lower(regexp_extract({url}, '^([A-Za-z]+):', 1)) || '://' || {host(url)} || "
        f"CASE WHEN {path(url)} IN ('', '/') THEN '/' ELSE regexp_replace({path(url)}, '/+$', '') END || "
        f"CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END"
    )


# Links of every page: (page_id, url, ord, link, text); `ord` counts from 0.
LINKS = rf"""
links AS (
  SELECT page_id, url, i - 1 AS ord,
         lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)
           || {entities("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS link,
         {squeeze(entities(strip_tags("regexp_extract(a, '(?is)<a\\b[^>]*>(.*?)</a>', 1)")))} AS text
  FROM (
    SELECT page_id, url, unnest(l) AS a, generate_subscripts(l, 1) AS i
    FROM (SELECT page_id, url, regexp_extract_all({cut_scripts()}, '(?is)<a\b[^>]*>.*?</a>') AS l FROM pages)
  )
)"""

# Companies derived from customers and the part of the same number.
COMPANIES = """
companies AS (
  SELECT c_custkey, CAST(900000000 + c_custkey AS VARCHAR) AS org_number, p_name,
         upper(p_name) || ' ' || CASE c_custkey % 4 WHEN 0 THEN 'AS' WHEN 1 THEN 'ASA' WHEN 2 THEN 'ENK' ELSE 'NUF' END AS legal_name,
         CASE c_custkey % 4 WHEN 0 THEN 'AS' WHEN 1 THEN 'ASA' WHEN 2 THEN 'ENK' ELSE 'NUF' END AS legal_form,
         CASE WHEN c_custkey % 5 <> 0 THEN 'www.' || replace(p_name, ' ', '') || '.no' END AS website,
         CASE WHEN c_custkey % 7 = 0 THEN 'firma@gmail.com' ELSE 'post@mail.' || replace(p_name, ' ', '-') || '.no' END AS email,
         c_mktsegment AS town, c_acctbal, c_custkey % 50 AS employees
  FROM customer JOIN part ON p_partkey = c_custkey
)"""
