"""Expressions on single values."""
import pytest
from pyspark.sql import functions as F

from factloom.functions import dates, names, social, text, urls


def values(spark, build, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *[f"c{n}" for n in range(len(rows[0]))]])
    out = df.select("i", build(*[F.col(f"c{n}") for n in range(len(rows[0]))]).alias("v")).collect()
    return [r.v for r in sorted(out, key=lambda r: r.i)]


def test_normalize(spark):
    pairs = {
        "HTTPS://www.Acme.no:443/Om/?utm_source=x&b=2&a=%C3%A5#top": "https://acme.no/Om?b=2&a=%C3%A5",
        "http://acme.no": "http://acme.no/", "http://acme.no:8080/a//": "http://acme.no:8080/a", "http://a.no:99999/x": "http://a.no:99999/x",
        "https://a.no/?ref=1&flag": "https://a.no/?flag=", "http://[::1/x": "http://[::1/x", "https://a.no/x?q=a+b~*": "https://a.no/x?q=a+b~%2A",
    }
    assert values(spark, urls.normalize, *[(u,) for u in pairs]) == list(pairs.values())


def test_absolute(spark):
    base = "https://a.no/x/y/p?z=1#f"
    pairs = {
        "q.html": "https://a.no/x/y/q.html", "../q": "https://a.no/x/q", "/r?b=1": "https://a.no/r?b=1", "//b.no/c": "https://b.no/c", "?k=2": "https://a.no/x/y/p?k=2",
        "HTTP://c.no/d": "HTTP://c.no/d", "./": "https://a.no/x/y/", "": base,
    }
    assert values(spark, urls.absolute, *[(base, link) for link in pairs]) == list(pairs.values())


def test_first_date(spark):
    today = F.lit("2024-06-01").cast("date")
    pairs = {
        "12. mai 2024": "2024-05-12", "Published May 12, 2024": "2024-05-12", "1.2.2023 og 2022-01-01": "2023-02-01", "Version 2.0. 2010-09-15": "2010-09-15",
        "31.02.2020 then 3. sept 2021": "2021-09-03", "Copyright 1999-01-01": None, "2030-01-01": None, "Ring 22334455": None, "tlf 12.5.20240": None,
    }
    assert values(spark, lambda c: dates.first_date(c, today), *[(t,) for t in pairs]) == list(pairs.values())


def test_profiles(spark):
    pairs = {
        "https://no.linkedin.com/company/acme?trk=x": "https://www.linkedin.com/company/acme", "https://www.linkedin.com/in/kari": None,
        "https://www.facebook.com/profile.php?id=123456": "https://www.facebook.com/profile.php?id=123456", "https://facebook.com/12345": None,
        "https://www.youtube.com/@acme": "https://www.youtube.com/@acme", "https://x.com/intent/tweet": None, "https://notfacebook.com/acme": None,
    }
    assert values(spark, social.profile_key, *[(u,) for u in pairs]) == list(pairs.values())


def test_org_numbers(spark):
    html = "<b>Org.nr:</b> 918 965 556, Org: NO 990&nbsp;859&nbsp;671 MVA, org nr 123456789, tlf 22334455"
    assert set(values(spark, names.stated_numbers, (html,))[0]) <= {"918965556", "990859671"}
    assert values(spark, names.is_valid_org_number, ("923609016",), ("923609017",), ("12345678",)) == [True, False, False]


@pytest.mark.parametrize("site,name,expected", [
    ("st-olav.no", "SAMEIET ST OLAV", True), ("bate.no", "SAMEIET ST OLAV", False), ("skaatoy.com", "BYGGMESTER SKÅTØY AS", True),
    ("nkl.no", "NORSKE KOKKERS LANDSFORENING", True), ("obos.no", "OPPSAL BORETTSLAG OG SAMEIE", False), (None, "ACME AS", False),
])
def test_domain_resembles(spark, site, name, expected):
    df = spark.createDataFrame([(site, name)], "s string, n string")
    assert df.select(names.domain_resembles(F.col("s"), F.col("n")).alias("v")).first().v is expected


def test_opening_and_headlines(spark):
    long = "Selskapets formål er å drive handel med varer og tjenester, samt eie aksjer; " * 3
    opened = values(spark, text.opening, (long,), ("Kort tekst. ",))
    assert opened[0].endswith(" ...") and len(opened[0]) <= 114 and opened[1] == "Kort tekst"
    titles = {"Press room": False, "2026-10-12 &ndash; 2026-10-14": False, "Ny kontrakt i Bærum": True, "Hello world!": False, "Kontakt oss": False, "A/B/C/D ny liste her": False}
    assert values(spark, text.is_news_title, *[(t,) for t in titles]) == list(titles.values())
