"""Text, date and amount expressions (inventory B10, B14, B20-B28, B34-B50, C9, C19, C23, E16, E18, E25, E28, G16)."""
from __future__ import annotations

from pyspark.sql import functions as F

from factloom.catalog import derived
from factloom.catalog import sql as S
from factloom.catalog.registry import query, table
from factloom.functions import dates, fixed, money, names, registry, text, urls

HTML, TEXT = F.col("html"), F.col("text")


@query("b10_address_line", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Gate ' || o_custkey || ', 0150 OSLO' WHEN 1 THEN 'Gate ' || o_custkey WHEN 2 THEN '0150 OSLO' END AS line,
  CASE WHEN o_orderkey % 3 = 0 THEN 'https://a' || o_custkey || '.no' WHEN o_orderkey % 3 = 1 THEN 'HTTP://a' || o_custkey || '.no' END AS site FROM orders""")
def _(spark, sf):
    key = F.col("o_orderkey")
    has_place = (key % 4).isin(0, 2)
    address = F.struct(
        F.when((key % 4).isin(0, 1), F.array(F.concat(F.lit("Gate "), "o_custkey"))).alias("adresse"), F.when(has_place, "0150").alias("postnummer"),
        F.when(has_place, "OSLO").alias("poststed"),
    )
    site = F.when(key % 3 == 0, F.concat(F.lit("a"), "o_custkey", F.lit(".no"))).when(key % 3 == 1, F.concat(F.lit("HTTP://a"), "o_custkey", F.lit(".no"))).otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", registry.address_line(address).alias("line"), registry.site_with_scheme(site).alias("site"))


@query("b14_nordic_fold", r"""
SELECT doc_id, md5(replace(replace(replace(lower(t), 'æ', 'ae'), 'ø', 'o'), 'å', 'a')) AS folded,
  md5(array_to_string(regexp_extract_all(replace(replace(replace(lower(t), 'æ', 'ae'), 'ø', 'o'), 'å', 'a'), '[a-z0-9]+'), '-')) AS slug
FROM (SELECT doc_id, 'ÆØÅ ' || text || ' blåbær' AS t FROM documents)""")
def _(spark, sf):
    t = F.concat(F.lit("ÆØÅ "), TEXT, F.lit(" blåbær"))
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold(t)).alias("folded"), F.md5(text.slug(t)).alias("slug"))


@query("b20_email_site", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'https://firma' || o_custkey || '.no' WHEN 1 THEN NULL WHEN 2 THEN 'https://firma' || o_custkey || '.no' ELSE NULL END AS site FROM orders""")
def _(spark, sf):
    host = F.concat(F.lit("firma"), "o_custkey", F.lit(".no"))
    kind = F.col("o_orderkey") % 4
    mail = F.when(kind == 0, F.concat(F.lit("Post@MAIL."), host)).when(kind == 1, F.concat(F.lit("firma"), "o_custkey", F.lit("@gmail.com"))).when(
        kind == 2, F.concat(F.lit("a@"), host)).otherwise(F.concat(F.lit("no address "), "o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", names.email_site(mail).alias("site"))


@query("b20_document_emails", r"""
SELECT doc_id, e AS email, CASE WHEN lower(split_part(e, '@', 2)) IN ('gmail.com', 'outlook.com', 'yahoo.com', 'hotmail.com') THEN NULL
  ELSE 'https://' || CASE WHEN len(string_split(split_part(e, '@', 2), '.')) > 2 AND string_split(lower(split_part(e, '@', 2)), '.')[1] IN ('mail', 'post', 'smtp', 'epost', 'mx')
    THEN regexp_replace(lower(split_part(e, '@', 2)), '^[^.]*\.', '') ELSE lower(split_part(e, '@', 2)) END END AS site
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS e FROM documents)""")
def _(spark, sf):
    found = F.regexp_extract_all(TEXT, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), 0)
    rows = table(spark, sf, "documents").select("doc_id", F.explode(found).alias("email"))
    return rows.withColumn("site", names.email_site(F.col("email")))


@query("b22_check_digit", """
WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7 + 100000000 AS VARCHAR), 9, '0') AS number FROM orders),
d AS (SELECT *, 11 - (CAST(number[1] AS INT) * 3 + CAST(number[2] AS INT) * 2 + CAST(number[3] AS INT) * 7 + CAST(number[4] AS INT) * 6 + CAST(number[5] AS INT) * 5
  + CAST(number[6] AS INT) * 4 + CAST(number[7] AS INT) * 3 + CAST(number[8] AS INT) * 2) % 11 AS c FROM n)
SELECT o_orderkey, number, c <> 10 AND CASE WHEN c = 11 THEN 0 ELSE c END = CAST(number[9] AS INT) AS valid FROM d""")
def _(spark, sf):
    number = F.lpad((F.col("o_orderkey") * 7 + 100000000).cast("string"), 9, "0")
    return table(spark, sf, "orders").select("o_orderkey", number.alias("number"), names.is_valid_org_number(number).alias("valid"))


_MONTHS = ["januar", "februar", "mars", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "desember"]


@query("b23_first_date_in_text", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN year(o_orderdate) < 2000 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def _(spark, sf):
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    month = F.element_at(F.array(*[F.lit(m) for m in _MONTHS]), F.month(d))
    english = F.date_format(d, "MMMM")
    day = F.dayofmonth(d).cast("string")
    written = (
        F.when(kind == 0, F.date_format(d, "yyyy-MM-dd")).when(kind == 1, F.date_format(d, "d.M.yyyy"))
        .when(kind == 2, F.concat(day, F.lit(". "), month, F.lit(" "), F.year(d).cast("string")))
        .when(kind == 3, F.concat(english, F.lit(" "), day, F.lit("th, "), F.year(d).cast("string"))).otherwise(F.concat(day, F.lit("-2024-"), F.month(d).cast("string")))
    )
    line = F.concat(F.lit("Order 31.02.2020 of "), written, F.lit(" no. "), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", dates.first_date(line, F.lit("2024-01-31").cast("date")).alias("day"))


@query("b23_document_dates", r"""
SELECT doc_id, any_value(n_chars) AS n_chars, CASE WHEN any_value(year) >= 2000 THEN any_value(day) END AS day FROM (
  SELECT doc_id, n_chars, 1995 + doc_id % 20 AS year, (1995 + doc_id % 20) || '-0' || (doc_id % 9 + 1) || '-1' || (doc_id % 10) AS day FROM documents) GROUP BY doc_id""")
def _(spark, sf):
    key = F.col("doc_id")
    iso = F.concat((key % 20 + 1995).cast("string"), F.lit("-0"), (key % 9 + 1).cast("string"), F.lit("-1"), (key % 10).cast("string"))
    return table(spark, sf, "documents").select("doc_id", "n_chars", dates.first_date(F.concat(TEXT, F.lit(" "), iso), F.lit("2024-01-31").cast("date")).alias("day"))


@query("b24_feed_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def _(spark, sf):
    d, kind = F.col("o_orderdate"), F.col("o_orderkey") % 3
    written = F.when(kind == 0, F.concat(F.date_format(d, "E, dd MMM yyyy"), F.lit(" 08:30:00 +0000"))).when(
        kind == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", dates.feed_date(written).alias("day"))


@query("b25_plain_text", f"""SELECT page_id, md5({S.squeeze(S.entities(S.strip_tags("html")))}) AS plain FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.squeeze(text.entities_decoded(text.strip_tags(HTML)))).alias("plain"))


@query("b26_visible_text", f"SELECT page_id, md5({S.visible()}) AS visible, CAST(length({S.visible()}) AS BIGINT) AS chars FROM pages")
def _(spark, sf):
    shown = text.visible_text(HTML)
    return table(spark, sf, "pages").select("page_id", F.md5(shown).alias("visible"), F.length(shown).cast("bigint").alias("chars"))


_LINES = rf"""
lines AS (
  SELECT page_id, url, line, i AS raw_ord FROM (
    SELECT page_id, url, {S.squeeze("unnest(l)")} AS line, generate_subscripts(l, 1) AS i FROM (
      SELECT page_id, url, string_split({S.strip_tags(f"regexp_replace({S.cut_scripts()}, '(?i)</(li|p|h[1-6])\\s*>', '␞', 'g')")}, '␞') AS l FROM pages)))"""


@query("b26_visible_lines", f"WITH {_LINES} SELECT page_id, line, count(*) AS times FROM lines WHERE line <> '' GROUP BY ALL")
def _(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(text.visible_lines(HTML)).alias("line"))
    return rows.groupBy("page_id", "line").agg(F.count(F.lit(1)).alias("times"))


@query("b27_page_heading", f"""
SELECT page_id, coalesce(nullif({S.squeeze(S.entities(S.strip_tags("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")))}, ''),
  nullif({S.squeeze(S.entities(S.strip_tags("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")))}, '')) AS heading FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.page_heading(HTML).alias("heading"))


@query("b28_head_text", f"""
SELECT page_id, md5(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' ' || substr({S.visible()}, 1, 2000)) AS head FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.head_text(HTML)).alias("head"))


@query("e18_parked_pages", "SELECT page_id, page_id % 3 = 0 AS parked FROM pages")
def _(spark, sf):
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<title>This domain may be for sale</title>"), HTML)).otherwise(HTML)
    return table(spark, sf, "pages").select("page_id", text.head_text(html).rlike(fixed.PARKED_PAGE).alias("parked"))


@query("b34_numeric_path", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice WHEN 3 THEN CAST(o_custkey AS DOUBLE) END AS amount FROM orders""")
def _(spark, sf):
    kind = F.col("o_orderkey") % 4
    inner = F.when(kind == 0, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).when(kind == 1, "true").when(
        kind == 2, F.concat(F.lit('"'), F.col("o_totalprice").cast("string"), F.lit('"'))).otherwise(F.col("o_custkey").cast("string"))
    doc = F.try_parse_json(F.concat(F.lit('{"a":{"b":'), inner, F.lit("}}")))
    return table(spark, sf, "orders").select("o_orderkey", registry.number_at(doc, "$.a.b").alias("amount"))


@query("b35_accounts_text", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Revenue: ' || format('{:,}', CAST(o_custkey * 1000 AS BIGINT)) || ' NOK; Net result: ' || format('{:,}', CAST(o_orderkey * 10 AS BIGINT)) || ' NOK'
  WHEN 1 THEN 'Revenue: ' || format('{:,}', CAST(o_custkey * 1000 AS BIGINT)) || ' NOK' END AS line FROM orders""")
def _(spark, sf):
    kind = F.col("o_orderkey") % 3
    revenue = F.when(kind < 2, (F.col("o_custkey") * 1000).cast("double"))
    result = F.when(kind == 0, (F.col("o_orderkey") * 10).cast("double"))
    return table(spark, sf, "orders").select("o_orderkey", money.accounts_text(revenue, result, F.lit("NOK")).alias("line"))


@query("b36_short_amount", """
WITH a AS (SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey * 137 WHEN 2 THEN o_orderkey * 12345 ELSE o_orderkey * 9876543 END AS BIGINT) AS n FROM orders)
SELECT o_orderkey, n AS parsed, CASE WHEN n >= 1000000000 THEN printf('%.2f', n / 1e9) || ' bn' WHEN n >= 1000000 THEN printf('%.1f', n / 1e6) || ' m'
  WHEN n >= 10000 THEN printf('%.0f', n / 1e3) || ' k' ELSE format('{:,}', n) END || ' EUR' AS short FROM a""")
def _(spark, sf):
    kind = F.col("o_orderkey") % 4
    n = F.when(kind == 0, F.col("o_custkey")).when(kind == 1, F.col("o_custkey") * 137).when(kind == 2, F.col("o_orderkey") * 12345).otherwise(F.col("o_orderkey") * 9876543)
    written = money.amount_text(n.cast("double"), F.lit("EUR"))
    return table(spark, sf, "orders").select("o_orderkey", money.amount(written).alias("parsed"), money.short_amount(written).alias("short"))


@query("b37_reporting_period", "SELECT o_orderkey, 'FY' || strftime(o_orderdate, '%Y') AS period FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.reporting_period(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("period"))


@query("b38_workplace_text", f"""
WITH {S.COMPANIES}
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN legal_name || ' (' || town || ', ' || employees || ' ansatte)' ELSE legal_name || ', Kai ' || c_custkey || ', 5003 ' || town || ' (' || employees || ' ansatte)' END AS workplace,
  upper(substr(town, 1, 1)) || lower(substr(town, 2)) AS town FROM companies""")
def _(spark, sf):
    c = derived.companies(spark, sf)
    address = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("Kai "), "c_custkey", F.lit(", 5003 "), "town"))
    value = registry.workplace_text(F.col("legal_name"), address, F.col("town"), F.col("employees"))
    return c.select("c_custkey", value.alias("workplace"), registry.town_of_workplace(value).alias("town"))


@query("b40_registered_description", r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS v FROM documents)
SELECT doc_id, CASE WHEN length(v) < 15 THEN 'Statutory purpose of the company' WHEN length(v) <= 400 THEN v
  ELSE rtrim(regexp_replace(substr(v, 1, 400), ' [^ ]*$', ''), ',;') || ' ...' END AS description FROM t""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", registry.registered_description(F.split(TEXT, "\n"), F.array(F.lit("Statutory purpose"), F.lit("of the company"))).alias("description")
    )


@query("b41_operating_status", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_acctbal < -500 THEN 'Bankrupt' WHEN c_acctbal < 0 THEN 'In liquidation' ELSE 'Active' END AS status FROM customer""")
def _(spark, sf):
    balance = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", registry.operating_status(balance < -500, balance < 0, F.col("c_custkey") % 5 != 0).alias("status"))


@query("b42_industry_text", f"""
WITH {S.COMPANIES}
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'trade in ' || p_name ELSE lower(substr(upper(p_name), 1, 1)) || substr(upper(p_name) || ' SALG', 2) END AS industry FROM companies""")
def _(spark, sf):
    c = derived.companies(spark, sf)
    coded = F.concat(F.lit("62.010 "), F.upper("p_name"), F.lit(" SALG"))
    english = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Trade in "), "p_name"))
    return c.select("c_custkey", registry.industry_text(coded, english).alias("industry"))


@query("b43_role_text", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Kari ' || o_custkey || ' (managing director)' WHEN 1 THEN 'Firma ' || o_custkey || ' (Kasserer)' ELSE 'Ola ' || o_custkey END AS english,
  CASE o_orderkey % 3 WHEN 0 THEN 'Kari ' WHEN 1 THEN 'Firma ' ELSE 'Ola ' END || o_custkey AS holder FROM orders""")
def _(spark, sf):
    kind, key = F.col("o_orderkey") % 3, F.col("o_custkey")
    value = F.when(kind == 0, F.concat(F.lit("Kari "), key, F.lit(" (Daglig leder)"))).when(kind == 1, F.concat(F.lit("Firma "), key, F.lit(" (Kasserer)"))).otherwise(
        F.concat(F.lit("Ola "), key))
    return table(spark, sf, "orders").select("o_orderkey", registry.role_in_english(value).alias("english"), registry.without_role(value).alias("holder"))


@query("b45_opening", r"""
WITH t AS (SELECT doc_id, rtrim(text, '. ') AS v FROM documents), c AS (SELECT *, substr(v, 1, 110) AS cut FROM t),
h AS (SELECT *, length(regexp_extract(cut, '(?s)^(.*)[,;] ', 1)) AS clause FROM c)
SELECT doc_id, CASE WHEN length(v) <= 110 THEN v ELSE rtrim(CASE WHEN clause >= 40 THEN substr(cut, 1, clause) ELSE regexp_replace(cut, ' [^ ]*$', '') END, ',; ') || ' ...' END AS opening FROM h""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.opening(TEXT).alias("opening"))


@query("b46_post_link", """
SELECT page_id, 'Page ' || page_id || CASE WHEN page_id % 2 = 0 THEN ' - ' || url ELSE '' END AS item, 'Page ' || page_id AS bare FROM pages""")
def _(spark, sf):
    item = text.with_post_link(F.concat(F.lit("Page "), "page_id"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("/relative"))
    return table(spark, sf, "pages").select("page_id", item.alias("item"), text.without_post_link(item).alias("bare"))


@query("b48_status_state", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'available' WHEN 'click' THEN 'not_available' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'blocked' ELSE 'failed' END AS state FROM events""")
def _(spark, sf):
    status = F.when(F.col("event_type") == "view", 204).when(F.col("event_type") == "click", 404).when(F.col("event_type") == "error", 503).when(F.col("event_type") == "signup", 429)
    return table(spark, sf, "events").select("event_id", urls.status_state(status).alias("state"))


@query("b49_claim_day", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts - INTERVAL 3 DAY, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d') END AS day FROM events""")
def _(spark, sf):
    effective = F.when(F.col("event_id") % 2 == 0, F.date_format(F.col("ts") - F.expr("INTERVAL 3 DAYS"), "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", dates.claim_day(effective, F.col("ts")).alias("day"))


@query("b50_values_and_sources", """
SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS available_values, count(DISTINCT props) FILTER (WHERE event_type <> 'error') AS sources,
  arg_min(lower(event_type[1]) || substr(event_type, 2), event_id) AS first_label FROM events GROUP BY user_id""")
def _(spark, sf):
    available = F.col("event_type") != "error"
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(available).alias("available_values"), F.count_distinct(F.when(available, F.col("props"))).alias("sources"),
        F.min_by(text.lower_first(F.upper(F.left("event_type", F.lit(1)))), "event_id").alias("_l"), F.min_by("event_type", "event_id").alias("first_label"),
    ).drop("_l")


@query("c9_repeated_words", r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}')) AS word FROM documents), n AS (SELECT doc_id, word, count(*) AS times FROM w GROUP BY ALL)
SELECT d.doc_id, CAST(coalesce(max(times), 0) AS INT) AS most FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.repeated_word_count(TEXT).alias("most"))


@query("g16_word_counts", r"""
SELECT word, count(*) AS times, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{3,}')) AS word FROM documents)
GROUP BY word HAVING count(*) >= 4""")
def _(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower(TEXT), F.lit(r"(?U)[\p{L}\p{N}_]{3,}"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("times"), F.count_distinct("doc_id").alias("docs")).filter("times >= 4")


@query("c19_stated_numbers", r"""
SELECT doc_id, '918965556' AS number FROM documents WHERE doc_id % 3 = 0 UNION ALL
SELECT doc_id, '999296432' FROM documents WHERE doc_id % 3 = 1""")
def _(spark, sf):
    kind = F.col("doc_id") % 3
    html = F.concat(F.lit("<p>"), TEXT, F.lit("</p><b>Org.nr:</b> "), F.when(kind == 0, "918 965 556").when(kind == 1, "NO 999&nbsp;296&nbsp;432 MVA").otherwise("918965557"))
    rows = table(spark, sf, "documents").select("doc_id", F.explode(names.stated_numbers(html)).alias("number"))
    return rows.filter(F.col("number").isin("918965556", "999296432", "918965557"))


@query("e16_shows_own_number", r"""
SELECT doc_id, contains(regexp_replace(text, '\s', '', 'g') || CASE WHEN doc_id % 2 = 0 THEN 'Org.918965556' ELSE '' END, '918965556') AS shown,
  len(regexp_extract_all(text, '(^|[^0-9])[0-9]{9}($|[^0-9])')) > 0 AS any_number FROM documents""")
def _(spark, sf):
    page = F.concat(TEXT, F.when(F.col("doc_id") % 2 == 0, "<i>Org.</i> 918 965\n556").otherwise(""))
    return table(spark, sf, "documents").select(
        "doc_id", names.shows_own_number(page, F.lit("918965556")).alias("shown"), urls.embeds_a_number(TEXT).alias("any_number")
    )


@query("e13_other_labelled_number", "SELECT doc_id, doc_id % 2 = 0 AS other FROM documents")
def _(spark, sf):
    page = F.concat(TEXT, F.lit("<b>Organisasjonsnr.:</b> "), F.when(F.col("doc_id") % 2 == 0, "918 965 556 ").otherwise("999 296 432 "))
    return table(spark, sf, "documents").select("doc_id", names.states_another_number(page, F.lit("999296432")).alias("other"))


@query("c23_text_nodes", f"""
SELECT page_id, count(*) AS nodes, CAST(sum(length(n)) AS BIGINT) AS chars, max(length(n)) AS longest FROM (
  SELECT page_id, unnest(regexp_extract_all({S.cut_scripts()}, '>([^<>]+)<', 1)) AS n FROM pages) WHERE trim(regexp_replace(n, '\\s+', ' ', 'g')) <> '' GROUP BY page_id""")
def _(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(text.text_nodes(HTML)).alias("n"))
    return rows.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.sum(F.length("n")).alias("chars"), F.max(F.length("n")).cast("bigint").alias("longest")
    )


@query("c23_node_span", f"""
SELECT page_id, (SELECT CASE WHEN length(trim(n)) <= 200 THEN trim(n) ELSE substr(trim(n), 1, 200) END FROM (
  SELECT unnest(l) AS n, generate_subscripts(l, 1) AS i) WHERE contains(n, '.') ORDER BY i LIMIT 1) AS span
FROM (SELECT page_id, regexp_extract_all({S.cut_scripts()}, '>([^<>]+)<', 1) AS l FROM pages)""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.node_span(HTML, lambda n: n.contains(".")).alias("span"))


@query("e25_news_titles", r"""
SELECT doc_id, doc_id % 4 IN (0, 3) AS news_title FROM documents""")
def _(spark, sf):
    kind, tail = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    title = F.when(kind == 0, F.concat(F.lit("Ny kontrakt signert i "), tail)).when(kind == 1, "Kontakt oss").when(kind == 2, F.concat(F.lit("Hello world "), tail)).otherwise(
        F.concat(F.lit("Åpner avdeling "), tail))
    return table(spark, sf, "documents").select("doc_id", text.is_news_title(title).alias("news_title"))


@query("e25_document_headlines", r"""
WITH t AS (SELECT doc_id, text AS v FROM documents)
SELECT doc_id, length(regexp_replace(regexp_replace(v, '&#?[\p{L}\p{N}_]+;', ' ', 'g'), '[^A-Za-zÆØÅæøåÄÖäöÜü]', '', 'g')) >= 8 AS headline FROM t""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.is_headline(TEXT).alias("headline"))


@query("b24_leading_day", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.leading_day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("day"))
