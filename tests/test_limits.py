"""What once had a limit or depended on the order of files."""
import html
import json
import random

from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import gates, ordered, pages, refresh, registry_facts
from factloom.sources import tables


def test_entities_read_as_in_a_browser(spark):
    rng = random.Random(1)
    names = [n + ";" for n in html.entities.name2codepoint] + [n for n in html.entities.html5 if not n.endswith(";")]
    numbers = [0, 1, 9, 13, 38, 65, 127, 128, 129, 150, 159, 160, 229, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**20]

    def piece():
        return rng.choice([
            "&" + rng.choice(names), "&" + rng.choice(names).rstrip(";") + rng.choice("x ;1"), f"&#{rng.choice(numbers)}" + rng.choice([";", "", " "]),
            f"&#{rng.choice('xX')}{rng.choice(numbers):x}" + rng.choice([";", "", "g"]), rng.choice(["a", "&", "&&", "&;", "&#", "&#x", "&amp;lt;", "&copyright", "&nosuch;", "&#00065;", "å"]),
        ])

    texts = ["".join(piece() for _ in range(rng.randint(0, 8))) for _ in range(500)] + ["", "R&oslash;rlegger s&aring;k"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.entities_decoded(F.col("t")).alias("v")).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.i)] == [html.unescape(t) for t in texts]


def test_graphs_open_at_any_depth(spark):
    value = {"@type": "Organization", "name": "Dyp AS"}
    for _ in range(9):
        value = {"@graph": [value]}
    page = f'<script type="application/ld+json">{json.dumps(value)}</script>'
    plain = '<script type="application/ld+json">{"@type": "Organization", "name": "Flat AS"}</script>'
    rows = spark.createDataFrame([(0, page), (1, plain), (2, "x")], "i int, h string").select("i", pages.organisation_name(pages.json_ld(F.col("h"))).alias("n")).collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.i)] == ["Dyp AS", "Flat AS", None]


def test_long_towns_match(spark):
    town = "abcdefghij" * 4
    accounts = spark.createDataFrame([("firma" + town, "firma"), ("annet" + town, "annet" + town)], "account string, own string")
    assert [r.account for r in gates.branch_towns(accounts, spark.createDataFrame([(town,)], "town string"), "account", "own").collect()] == ["firma" + town]


def test_null_keys_and_segments_keep_their_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (None, 1, 2), ("a", None, 3), ("a", 1, 4), ("a", 1, 5)], "k string, s int, o int")
    got = ordered.row_numbers(df, ["k"], ["o"], "s", "n").collect()
    assert sorted((r.o, r.n) for r in got) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 3)]


def test_change_texts_quote_and_list_everything(spark):
    shape = "org_number string, field string, value string, source_class string, reporting_period string"
    old = [("1", "legal_name", "O'Neil AS", "a", None)] + [("1", "leader", f"Person {i:03d}", "a", None) for i in range(500)]
    new = [("1", "legal_name", 'Neil "X" AS', "a", None)] + [("1", "leader", f"Person {i:03d}", "a", None) for i in range(1, 500)]
    a, b = spark.createDataFrame(old, shape), spark.createDataFrame(new, shape)
    got = sorted(r.text for r in refresh.change_texts(refresh.material_changes(a, b), a, b).collect())
    people = [f"Person {i:03d}" for i in range(500)]
    assert got == [f"leadership.leaders: {people} -> {people[1:]}", f"legal_name: {chr(34)}O'Neil AS{chr(34)} -> 'Neil {chr(34)}X{chr(34)} AS'"]


def test_feed_pages_and_duplicates_follow_file_names(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    for f in range(3):
        lines = [json.dumps({"items": [{"id": f"{f}-{i}", "url": "u", "_feed_entry": {"status": "ACTIVE", "businessName": "b"}}]}) for i in range(4 - f)]
        (tmp_path / "feed" / f"{f}.json").write_text("\n".join(lines))
    rows = tables.feed_pages(spark, str(tmp_path / "feed")).orderBy("page_no").collect()
    assert [(r.page_no, r.id) for r in rows] == list(enumerate(f"{f}-{i}" for f in range(3) for i in range(4 - f)))
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "b.json").write_text(json.dumps({"organisation_number": "1", "name": "last"}))
    (tmp_path / "list" / "a.json").write_text("\n".join(json.dumps({"organisation_number": "1", "name": f"{'early' * 50}{i}"}) for i in range(50)))
    assert [r.name for r in tables.universe(spark, str(tmp_path / "list")).collect()] == ["last"]


def test_the_newest_response_decides(spark):
    shape = "org_number string, kind string, status int, url string, body string, retrieved_at timestamp"
    rows = spark.createDataFrame([("1", "entity", 200, "u", '{"navn": "GAMMEL"}', None), ("1", "entity", 200, "u", '{"navn": "NY"}', None)], shape)
    rows = rows.withColumn("retrieved_at", F.when(F.col("body").contains("NY"), F.lit("2024-02-01")).otherwise(F.lit("2024-01-01")).cast("timestamp"))
    assert [(r.org_number, r.legal_name) for r in registry_facts.resolve(rows).collect()] == [("1", "NY")]
