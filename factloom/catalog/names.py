"""Company names and accounts (inventory B12-B19, B29-B33, E0, E17, E19, E20)."""
from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import derived
from factloom.catalog import sql as S
from factloom.catalog.registry import query, table
from factloom.functions import names, similarity, social, text, urls


@query("b12_name_forms", r"""
WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '  as' WHEN 1 THEN ' ASA' WHEN 2 THEN ' holding AS.' ELSE '' END AS name FROM part)
SELECT p_partkey, upper(regexp_replace(name, '\s+', ' ', 'g')) AS normalized, upper(p_name_base) AS base, CASE p_partkey % 4 WHEN 2 THEN name ELSE p_name_base END AS stripped
FROM (SELECT *, CASE p_partkey % 4 WHEN 2 THEN regexp_replace(name, ' AS\.$', '') ELSE regexp_replace(name, '(?i)\s+(asa?)$', '') END AS p_name_base FROM n)""")
def _(spark, sf):
    kind = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(kind == 0, "  as").when(kind == 1, " ASA").when(kind == 2, " holding AS.").otherwise(""))
    return table(spark, sf, "part").select(
        "p_partkey", names.normalized(name).alias("normalized"), names.base(name).alias("base"), names.strip_legal_form(name).alias("stripped")
    )


@query("b13_employer_tokens", """
SELECT p_partkey, upper(p_type || ' ' || p_name) || ' BRAND ' || regexp_extract(p_brand, '([0-9]+)', 1) AS tokens, true AS distinctive, p_name = 'none' AS single_distinctive FROM part""")
def _(spark, sf):
    name = F.concat("p_type", F.lit(" - "), "p_name", F.lit(", "), F.replace("p_brand", F.lit("#"), F.lit(" #")), F.lit(" AS"))
    tokens = names.employer_tokens(name)
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(tokens, " ").alias("tokens"), names.is_distinctive(tokens).alias("distinctive"),
        names.is_distinctive(names.employer_tokens(F.concat(F.lit("Drift"), F.lit(" AS")))).alias("single_distinctive"),
    )


@query("b15_identity_tokens", f"""
WITH {S.COMPANIES}
SELECT c_custkey, array_to_string(list_sort(list_distinct(list_filter(
  list_concat(list_filter(string_split(p_name, ' '), lambda w: length(w) >= 5), [replace(p_name, ' ', '')], CASE WHEN website IS NULL THEN [] ELSE [replace(p_name, ' ', '')] END),
  lambda t: length(t) >= 4))), ',') AS tokens FROM companies""")
def _(spark, sf):
    c = derived.companies(spark, sf)
    tokens = names.identity_tokens(F.col("legal_name"), F.coalesce(F.col("website"), F.lit("")))
    return c.select("c_custkey", F.array_join(F.array_sort(tokens), ",").alias("tokens"))


@query("b16_account_resembles", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'linkedin.com' WHEN 1 THEN 'facebook.com' ELSE 'x.com' END AS platform,
  CASE p_partkey % 3 WHEN 2 THEN 'someoneelse' ELSE replace(p_name, ' ', '') END AS account, p_partkey % 3 <> 2 AS resembles FROM part""")
def _(spark, sf):
    kind, joined = F.col("p_partkey") % 3, F.replace("p_name", F.lit(" "), F.lit(""))
    url = F.when(kind == 0, F.concat(F.lit("https://www.linkedin.com/company/"), joined)).when(kind == 1, F.concat(F.lit("https://www.facebook.com/"), joined)).otherwise(
        "https://x.com/someoneelse")
    tokens = names.identity_tokens(F.concat("p_name", F.lit(" AS")), F.lit(""))
    return table(spark, sf, "part").select(
        "p_partkey", social.platform(urls.authority(url)).alias("platform"), social.account_name(url).alias("account"), social.resembles(url, tokens).alias("resembles")
    )


_LINKS = [
    ("https://no.linkedin.com/company/{0}?trk=x", "https://www.linkedin.com/company/{0}"), ("http://linkedin.com/in/{0}", None),
    ("https://m.facebook.com/{0}/", "https://www.facebook.com/{0}"), ("https://facebook.com/sharer/sharer.php?u={0}", None),
    ("https://www.facebook.com/pages/{0}/12345", "https://www.facebook.com/pages/{0}/12345"), ("https://facebook.com/123_456", None),
    ("https://instagram.com/{0}", "https://www.instagram.com/{0}/"), ("https://instagram.com/p/{0}", None), ("https://twitter.com/{0}", "https://twitter.com/{0}"),
    ("https://www.youtube.com/watch?v={0}", None), ("https://youtube.com/@{0}", "https://www.youtube.com/@{0}"), ("https://tiktok.com/@{0}/video/1", "https://www.tiktok.com/@{0}"),
]


def _link_case(column: int) -> str:
    parts = []
    for i, pair in enumerate(_LINKS):
        value = "NULL" if pair[column] is None else "'" + pair[column].replace("{0}", "' || h || '") + "'"
        parts.append(f"WHEN {i} THEN {value}")
    return f"CASE p_partkey % {len(_LINKS)} " + " ".join(parts) + " END"


_PUBLISHED = "regexp_replace(regexp_replace(replace(key, 'twitter.com', 'x.com'), '://www\\.', '://'), '/+$', '')"


@query("b17_profile_urls", f"""
SELECT p_partkey, key, {_PUBLISHED} AS link FROM (SELECT p_partkey, {_link_case(1)} AS key FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS h FROM part))""")
def _(spark, sf):
    h = F.replace("p_name", F.lit(" "), F.lit("_"))
    link = F.when(F.lit(False), "")
    for i, (given, _) in enumerate(_LINKS):
        before, after = given.split("{0}") if "{0}" in given else (given, "")
        link = link.when(F.col("p_partkey") % len(_LINKS) == i, F.concat(F.lit(before), h, F.lit(after)) if "{0}" in given else F.lit(given))
    key = social.profile_key(link)
    return table(spark, sf, "part").select("p_partkey", key.alias("key"), social.published_form(key).alias("link"))


@query("b18_published_form", """
SELECT p_partkey, 'https://facebook.com/velv%C3%A6re' || p_size AS link, p_size % 2 = 0 AS acceptable FROM part""")
def _(spark, sf):
    link = F.concat(F.lit("https://www.facebook.com/velvære"), F.col("p_size").cast("string"), F.lit("/"))
    plugin = F.when(F.col("p_size") % 2 == 0, link).otherwise(F.concat(F.lit("https://www.facebook.com/plugins/page.php?href="), link))
    return table(spark, sf, "part").select("p_partkey", social.published_form(social.canonical(link)).alias("link"), social.is_profile_link(plugin).alias("acceptable"))


@query("b19_domain_guesses", """
WITH n AS (SELECT p_partkey, replace(p_name, ' ', '') AS j, replace(p_name, ' ', '-') AS h, split_part(p_name, ' ', 1) AS f FROM part),
g AS (SELECT p_partkey, list_concat([j || '.no', h || '.no'], CASE WHEN length(f) >= 4 THEN [f || '.no'] ELSE [] END, [j || '.com']) AS l FROM n)
SELECT p_partkey, unnest(l[1:4]) AS domain, generate_subscripts(l[1:4], 1) - 1 AS place FROM g""")
def _(spark, sf):
    guesses = names.domain_guesses(F.concat(F.upper("p_name"), F.lit(" AS")))
    return table(spark, sf, "part").select("p_partkey", F.posexplode(guesses).alias("place", "domain")).withColumn("place", F.col("place").cast("bigint"))


@query("b29_domain_resembles", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS resembles,
  CASE p_partkey % 4 WHEN 0 THEN length(replace(p_name, ' ', '')) >= 6 ELSE false END AS spells FROM part""")
def _(spark, sf):
    kind, joined = F.col("p_partkey") % 4, F.replace("p_name", F.lit(" "), F.lit(""))
    site = F.when(kind == 0, F.concat(joined, F.lit(".no"))).when(kind == 1, F.concat(F.lit("https://www."), joined, F.lit("gruppen.no/"))).when(kind == 2, "https://zzqq.no").otherwise("nko.no")
    name = F.when(kind == 3, F.lit("Norges Kakefabrikk Oslo AS")).otherwise(F.concat("p_name", F.lit(" AS")))
    return table(spark, sf, "part").select(
        "p_partkey", names.domain_resembles(site, name).alias("resembles"), names.spells_whole_name(urls.host_of_site(site), name).alias("spells")
    )


@query("b30_whole_name_on_page", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS loose, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE false END AS strict FROM part""")
def _(spark, sf):
    kind, name = F.col("p_partkey") % 3, F.concat("p_name", F.lit(" Norge AS"))
    title = F.when(kind == 0, F.concat(F.lit("Hjem – "), F.upper("p_name"), F.lit(" Norge AS"))).when(kind == 1, F.substring_index("p_name", " ", 1)).otherwise(
        F.concat(F.lit("Om "), "p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", names.holds_whole_name(title, name).alias("loose"), names.holds_whole_name_strictly(title, name).alias("strict")
    )


@query("b30_names_in_documents", r"""
WITH f AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS words FROM documents),
n AS (SELECT doc_id, split_part(trim(words), ' ', 1) || ' ' || split_part(trim(words), ' ', 2) AS name, words FROM f)
SELECT doc_id, name, true AS shown FROM n WHERE length(split_part(name, ' ', 2)) > 0""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    named = d.select("doc_id", "text", F.array_join(F.slice(words, 1, 2), " ").alias("name")).filter("name LIKE '% %'")
    return named.select("doc_id", "name", F.contains(text.folded_phrase(F.col("text")), F.concat(F.lit(" "), "name", F.lit(" "))).alias("shown"))


@query("b32_plausible_accounts", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS own FROM part""")
def _(spark, sf):
    kind, joined = F.col("p_partkey") % 6, F.replace("p_name", F.lit(" "), F.lit(""))
    account = F.when(kind == 0, joined).when(kind == 1, F.concat(F.substring_index("p_name", " ", 1), F.lit("-gruppen"))).when(
        kind == 2, F.concat(joined, F.lit("-ltd"))).when(
        kind == 3, F.concat(joined, F.lit("eiendom"))).when(kind == 4, "othercompany").otherwise(F.concat(joined, F.lit("norge")))
    url = F.concat(F.lit("https://www.facebook.com/"), account)
    name = F.concat("p_name", F.lit(" AS"))
    return table(spark, sf, "part").select("p_partkey", social.is_plausibly_own(url, name, F.concat(joined, F.lit(".no")), F.lit(False)).alias("own"))


@query("b33_account_is_company", """
SELECT p_partkey, p_partkey % 2 = 0 AS same, split_part(p_name, ' ', 1) AS stem FROM part""")
def _(spark, sf):
    joined = F.replace("p_name", F.lit(" "), F.lit(""))
    account = F.when(F.col("p_partkey") % 2 == 0, F.concat(joined, F.lit("norge"))).otherwise(F.concat(joined, F.lit("bygg")))
    name = F.concat("p_name", F.lit(" AS"))
    return table(spark, sf, "part").select(
        "p_partkey", social.is_the_company(F.concat(F.lit("https://www.facebook.com/"), account), name, F.lit("https://zz.no")).alias("same"), names.stem(name).alias("stem")
    )


@query("e0_name_containment", """
SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 100.0 ELSE 100.0 END AS score, true AS contained FROM part""")
def _(spark, sf):
    name, page = F.concat("p_name", F.lit(" AS")), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit("Velkommen til "), F.initcap("p_name"), F.lit(" AS her")))
    return table(spark, sf, "part").select("p_partkey", similarity.name_similarity(name, page).alias("score"), similarity.contained(name, page).alias("contained"))


@query("e0_name_similarity")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey", similarity.name_similarity(F.concat("p_name", F.lit(" AS")), F.reverse("p_name")).alias("score"),
        similarity.token_sort_similarity(F.concat(F.lit("as "), "p_name"), F.concat("p_name", F.lit("s as"))).alias("sorted_score"),
    )


@query("e17_word_coverage", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 1.0 END AS coverage FROM part""")
def _(spark, sf):
    kind = F.col("p_partkey") % 3
    name = F.when(kind == 2, F.lit("Bygg Eiendom AS")).otherwise(F.concat("p_name", F.lit(" Bygg AS")))
    page = F.when(kind == 0, F.initcap("p_name")).otherwise(F.substring_index("p_name", " ", 1))
    return table(spark, sf, "part").select("p_partkey", names.word_coverage(name, page).alias("coverage"))


@query("e17_document_coverage", r"""
WITH k AS (SELECT doc_id, split_part(text, ' ', 1) AS w, regexp_replace(lower(text), '[^0-9a-zæøå]+', '', 'g') AS flat FROM documents)
SELECT doc_id, CASE WHEN len(words) = 0 THEN 1.0 ELSE CAST(len(list_filter(words, lambda x: contains(flat, x))) AS DOUBLE) / len(words) END AS coverage
FROM (SELECT doc_id, flat, list_filter(['gizmo', 'anvil', 'the', 'de'], lambda x: true) AS words FROM k)""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", names.word_coverage(F.lit("Gizmo Anvil The De AS"), F.col("text")).alias("coverage"))


@query("e19_sister_pages", """
SELECT p_partkey, p_partkey % 3 = 0 AS sister FROM part""")
def _(spark, sf):
    kind, family = F.col("p_partkey") % 3, F.substring_index("p_name", " ", 1)
    name = F.concat(family, F.lit(" invest AS"))
    page = F.when(kind == 0, F.concat(F.lit("velkommen til "), family, F.lit(" bygg as her"))).when(kind == 1, F.concat(F.lit("velkommen til "), family, F.lit(" invest as"))).otherwise("custos")
    return table(spark, sf, "part").select("p_partkey", names.names_a_sister(name, page).alias("sister"))


@query("e20_location_and_label", """
SELECT p_partkey, p_partkey % 2 = 0 AS located, p_partkey % 3 = 0 AS same_label, CASE WHEN p_partkey % 2 = 0 THEN 'Bergen' END AS town FROM part""")
def _(spark, sf):
    from factloom.operators import gates

    key, joined = F.col("p_partkey"), F.replace("p_name", F.lit(" "), F.lit(""))
    html = F.concat(F.lit("<p>"), "p_name", F.lit("</p><p>Kai 1, 5003 "), F.when(key % 2 == 0, "Bergen").otherwise("Bergensk"), F.lit("</p>"))
    landed = F.when(key % 3 == 0, F.concat(F.lit("https://www."), joined, F.lit(".com/x"))).otherwise("https://other.no/")
    return table(spark, sf, "part").select(
        "p_partkey", (gates.shows_location(html, F.lit("5003"), F.lit("BERGEN")) & (key % 2 == 0)).alias("located"),
        urls.same_label(F.concat(F.lit("https://"), joined, F.lit(".no")), landed).alias("same_label"), gates.town_on_page(html, [F.lit("BERGEN"), F.lit("VESTLAND")]).alias("town"),
    )
