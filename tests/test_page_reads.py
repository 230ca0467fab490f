"""What a page reader works out once."""
from pyspark.sql import functions as F

from factloom.functions import fixed, registry, urls
from factloom.operators import pages


def _page(spark, url, html):
    return spark.range(1).select(
        F.lit("1").alias("org_number"), F.lit(0).cast("bigint").alias("page_ord"), F.lit(url).alias("url"), F.concat(F.lit(html), F.when(F.col("id") < 0, "x").otherwise("")).alias("raw_html"),
        F.lit("2024-06-01 00:00:00").cast("timestamp").alias("fetched_at"), F.lit("available").alias("fetch_state"), F.lit(None).cast("string").alias("linked_from"))


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_properties_are_read_in_one_pass(spark):
    html = (
        '<script type="application/ld+json">["x",{"@type":"Event","name":"Open day","startDate":"2024-09-01","publisher":{"name":"Eier","sameAs":"https://facebook.com/eier"}},'
        '{"@type":["JobPosting"],"title":"Selger","name":7,"address":"here","employee":[{"name":"Kari"},3],"hiringOrganization":["x"],"founder":null,"sameAs":[null,"https://x.com/oss"]}]</script>')
    df = pages.structured_facts(_page(spark, "https://a.no/", html)).select("field", "value", "context_name")
    assert sorted(map(tuple, df.collect()), key=str) == sorted([
        ("dated_activity", "Open day (2024-09-01)", None), ("organization_name", "Open day", None), ("company_profile", "https://facebook.com/eier", "Eier"),
        ("hiring_signal", "Selger", None), ("leader", "Kari", None), ("company_profile", "https://x.com/oss", None)], key=str)
    assert "$.publisher" not in _plan(df) and "$.headline" not in _plan(df)


def test_a_feed_item_is_matched_once(spark):
    html = "<rss><item><title>Ny avtale med kommunen</title><link>https://a.no/nyheter/sak-1</link><pubDate>Mon, 01 Apr 2024 10:00:00 +0200</pubDate></item><item><title>Ingen dato her</title></item></rss>"
    df = pages.feed_facts(_page(spark, "https://a.no/feed", html))
    assert [r["value"] for r in df.collect()] == ["Ny avtale med kommunen (2024-04-01) - https://a.no/nyheter/sak-1"]
    assert _plan(df).count(fixed.FEED_DATE) == 1


def test_json_is_escaped_by_runs(spark):
    texts = ["plain", "", None, 'a"b\\c/d', "Vi åpner\n\t\r\x01\x7f 😀 ø", "\u2028x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pages.json_escaped(F.col("t")).alias("e"))
    expected = [None if t is None else "".join(
        {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c) or (c if " " <= c <= "~" else "".join(f"\\u{c.encode('utf-16-be').hex()[i:i + 4]}" for i in range(0, len(c.encode("utf-16-be")) * 2, 4)))
        for c in t) for t in texts]
    assert [r["e"] for r in df.collect()] == expected
    assert "split(" not in _plan(df)


def test_a_quote_is_escaped_once(spark):
    df = spark.range(1).select(registry.json_written(F.lit('{"t":"\\u00e5/"}'), F.lit("å/"), F.upper(F.concat(F.lit("\\u00"), F.col("id").cast("string")))).alias("w"))
    assert df.first()["w"] == "å/"
    assert _plan(df).count("upper(") == 1


def test_links_share_the_parts_of_their_page(spark):
    df = spark.createDataFrame([("https://a.no/nyheter/x", "https://a.no/"), ("https://a.no/", "https://a.no/"), ("https://b.no/nyheter/x", "https://a.no/"), (None, "https://a.no/")], "l string, p string")
    both = df.select(urls.is_post_link(F.col("l"), F.col("p")).alias("a"), urls.is_post_of(F.col("l"), urls.parse(F.col("p"))).alias("b")).collect()
    assert [r["a"] for r in both][:3] == [True, False, False] and all(r["a"] == r["b"] for r in both)
