"""Readers over small hand-made files."""
import gzip
import hashlib
import json

from pyspark.sql import functions as F

from factloom.operators import gates
from factloom.sources import sampling, sinks, tables


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_manifest_keeps_order_and_drops_blanks(spark, tmp_path):
    rows = tables.manifest(spark, write(tmp_path / "m.txt", "923609016\n\n  912345678 \n900000001\n")).orderBy("position").collect()
    assert [r.org_number for r in rows] == ["923609016", "912345678", "900000001"]


def test_universe_last_duplicate_wins_plain_and_gzip(spark, tmp_path):
    lines = [{"organisation_number": "1", "name": "OLD"}, {"organisation_number": "2", "name": "B", "employees": 3}, {"organisation_number": "1", "name": "NEW"}]
    text = "\n".join(json.dumps(x) for x in lines)
    plain = write(tmp_path / "u.jsonl", text)
    with gzip.open(tmp_path / "u.jsonl.gz", "wt", encoding="utf-8") as f:
        f.write(text)
    for path, parts in ((plain, None), (str(tmp_path / "u.jsonl.gz"), 3)):
        assert {r.organisation_number: r.name for r in tables.universe(spark, path, parts).collect()} == {"1": "NEW", "2": "B"}


def test_labels_feed_pages_and_ads(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    write(tmp_path / "labels" / "a.json", json.dumps({"org_number": "1", "expected_legal_name": "A", "expected_fields": {"leader": "Kari"}}, indent=1))
    label = tables.labels(spark, str(tmp_path / "labels")).first()
    assert label.expected_fields == {"leader": "Kari"}
    feed = write(tmp_path / "feed.jsonl", json.dumps({"items": [{"id": "x", "url": "/a", "_feed_entry": {"status": "ACTIVE", "businessName": "A"}}, {"url": "/b"}], "next_url": None}))
    assert [r.id for r in tables.feed_pages(spark, feed).collect()] == ["x"]
    ad = write(tmp_path / "ad.jsonl", json.dumps({"ad_content": {"title": "T", "published": "2024-01-02T00:00", "contactList": [{"name": "P"}], "employer": {"orgnr": "9"}}}))
    row = tables.ads(spark, ad).first().asDict()
    assert row["published"] == "2024-01-02" and row["number"] == "9" and "contactList" not in row


def test_report_round_trip(spark, tmp_path):
    sinks.write_report(spark.range(3).agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "r"))
    assert tables.envelopes(spark, str(tmp_path / "r"), "n long").first().n == 3


def test_failed_register_lookup_drops_doubtful_accounts(spark):
    facts = spark.createDataFrame([("1", "company_profile", "https://facebook.com/acme"), ("1", "company_profile", "https://facebook.com/acmebygg"), ("1", "leader", "K")], "org_number string, field string, value string")
    entities = spark.createDataFrame([("1", "ACME AS", "https://zz.no")], "org_number string, legal_name string, official_site string")
    kept = {r.value for r in gates.undoubted_accounts(facts, entities, None).collect()}
    assert kept == {"https://facebook.com/acme", "K"}


def test_samples_are_the_keys_with_the_smallest_hashes(spark):
    keys = [(f"{i:05d}",) for i in range(3000)]
    expected = sorted(keys, key=lambda k: hashlib.md5(f"7:{k[0]}".encode()).hexdigest())
    df = spark.createDataFrame(keys + keys[:50], "k string")
    for n in (0, 1, 999, 3000, 4000):
        assert [r.k for r in sampling.seeded_keys(df, "k", n, 7).collect()] == sorted(k for (k,) in expected[:n])
