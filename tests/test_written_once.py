"""Steps that are worked out once, lookups no larger than what they are looked up for, tasks that grow in number."""
import datetime

from pyspark.sql import functions as F

from factloom import schemas
from factloom.catalog import registry
from factloom.operators import evidence, joins, ordered, pages
from factloom.plans import assembly, envelope, summary
from factloom.session import materialise

AT = datetime.datetime(2024, 6, 1)


def _claims(spark, *rows):
    """Claims of (org_number, field, value, source), numbered."""
    made = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "org_number string, field string, value string, source string, item_ord long")
    return assembly.ordered_claims(schemas.conform(made, schemas.CLAIM, state=F.lit("available"), retrieved_at=F.lit(AT)))


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_a_lookup_is_repeated_for_used_salts_only(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "s", i) for i in range(200)] + [("b", f"s{i}", i) for i in range(20)] + [("c", None, 1), (None, "s", 2)], "k string, s string, n long")
    repeated = []
    explode = F.explode

    def seen(column):
        repeated.append(column)
        return explode(column)

    monkeypatch.setattr(joins.F, "explode", seen)
    found = evidence.numbered_by_first_use(rows, ["k"], ["s"], ["n"], "no")
    monkeypatch.undo()
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", "s", i, 1) for i in range(200)] + [("b", f"s{i}", i, i + 1) for i in range(20)] + [("c", None, 1, 1)], key=str)
    lookup = rows.groupBy("k", "s").agg(joins.salts_of(rows).alias("_salts")).select("k", "s", explode(repeated[0]).alias("salt"))
    sizes = {(r["k"], r["s"]): r["n"] for r in lookup.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes[("a", "s")] == joins.SALTS and all(sizes[("b", f"s{i}")] == 1 for i in range(20))


def test_answers_repeat_first_claims_for_used_salts_only(spark, monkeypatch):
    claims = _claims(spark, ("1", "leader", "Kari", "x"), ("1", "leader", "Ola", "x"), ("1", "workplace", "Kai 1", "x"))
    runs = claims.select("org_number").distinct().select("org_number", F.lit("2024-06-01").alias("run_day"), F.lit(True).alias("is_first_run"), F.lit(None).cast("string").alias("previous_day"))
    used = []
    monkeypatch.setattr(summary, "salted_join", lambda *args, **given: used.append(given.get("used")) or joins.salted_join(*args, **given))
    found = summary.answers(claims, runs, claims.filter("false").select("org_number", F.col("value").alias("text")))
    assert {r["question_ord"]: r["answer"] for r in found.collect()}[5] == "Kari; Ola" and used == ["_salts"]
    dealt = summary.answers(claims, runs, claims.filter("false").select("org_number", F.col("value").alias("text")), count=150_001)
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, found.collect()), key=str)
    assert _plan(dealt).count("RepartitionByExpression") == 7  # six scalar answers and the questions


def test_an_envelope_numbers_its_claims_once(spark):
    claims = materialise(_claims(spark, ("1", "legal_name", "A AS", "https://a.no/1"), ("1", "leader", "Kari", "https://a.no/2"), ("1", "leader", "Ola", "https://a.no/1")), "made")
    runs = claims.select("org_number").distinct().select("org_number", F.lit("2024-06-01").alias("run_day"), F.lit(True).alias("is_first_run"), F.lit(None).cast("string").alias("previous_day"))
    sentences, signals, overview = summary.build(claims, runs, claims.filter("false").select("org_number", "field", F.lit("changed").alias("kind"), F.col("value").alias("old"), F.col("value").alias("new")))
    about = runs.select("org_number", F.lit("r").alias("run_id"), F.lit(AT).alias("started_at"), F.lit(AT).alias("completed_at"))
    sentences, signals, overview = (materialise(t, "made") for t in (sentences, signals, overview))
    built = envelope.build(claims, sentences, signals, overview, claims.filter("false").select("org_number", F.col("value").alias("text")), about)
    assert "row_number" not in _plan(built)
    (row,) = built.collect()
    assert [c["evidence_ids"] for c in row["claims"]] == [["ev-1"], ["ev-2"], ["ev-3"]] and [e["source_url"] for e in row["evidence"]] == ["https://a.no/1", "https://a.no/2", "https://a.no/1"]
    assert row["summary"]["sources"][0]["url"] == "https://a.no/1"


def test_reader_steps_are_put_together_once(spark, monkeypatch):
    calls = []
    reader = pages.Reader("feed", 0, "structured", lambda asked: calls.append(1) or pages._read_feed(asked), pages._finish_feed, ("feed",))
    html = "<rss><item><title>Ny avtale</title><link>https://a.no/nyheter/1</link><pubDate>Mon, 01 Apr 2024 10:00:00 +0200</pubDate></item></rss>"
    page = spark.createDataFrame([("1", 0, "https://a.no/feed", html, AT, "available")], "org_number string, page_ord long, url string, raw_html string, fetched_at timestamp, fetch_state string").withColumn(
        "linked_from", F.lit(None).cast("string"))
    found = [[r["value"] for r in pages.facts_of(page, [reader]).collect()] for _ in range(2)]
    assert found[0] == found[1] and len(found[0]) == 1 and calls == [1]


def test_claims_are_numbered_in_tasks_by_their_count(spark):
    rows = spark.range(30).select((F.col("id") % 3).cast("string").alias("k"), "id", F.lit(0).alias("segment"))
    found = ordered.row_numbers(rows, ["k"], ["id"], "segment", "n", 5)
    assert "RepartitionByExpression" in _plan(found) and all(r["n"] == r["id"] // 3 + 1 for r in found.collect())
    claims = _claims(spark, *[(str(i), "leader", f"L{n}", "x") for i in range(5) for n in range(12)]).drop("claim_no")
    numbered = assembly.ordered_claims(claims, 150_001)
    assert ", 4" in next(line for line in _plan(numbered).splitlines() if "RepartitionByExpression" in line)
    assert sorted(map(tuple, numbered.collect()), key=str) == sorted(map(tuple, assembly.ordered_claims(claims).collect()), key=str)


def test_profiles_are_dealt_by_their_count(spark):
    claims = _claims(spark, *[(str(i), f, f"{f} {i}", "x") for i in range(3) for f in ("legal_name", "leader", "workplace", "hiring_signal")])
    found = assembly.profiles(claims, 2, 100_001)
    assert ", 3" in next(line for line in _plan(found).splitlines() if "RepartitionByExpression" in line)
    plain = {(r["org_number"], r["part"]): r["sections"] for r in assembly.profiles(claims, 2).collect()}
    assert {(r["org_number"], r["part"]): r["sections"] for r in found.collect()} == plain and len(plain) == 6


def test_registry_claims_are_ordered_once_for_all_sentences(spark, monkeypatch):
    from factloom.catalog import summaries  # its column expressions need the session

    claims = _claims(spark, ("1", "workplace", "Avd 1 - Kai 1, 0150 OSLO, OSLO", "x"), ("1", "workplace", "Avd 2 - Kai 2, 0150 OSLO, OSLO", "x"), ("1", "legal_name", "A AS", "x")).drop("claim_no")
    counted = []
    whole = assembly.ordered_claims
    monkeypatch.setattr(summaries, "_registry_claims", lambda spark, sf: (None, claims))
    monkeypatch.setattr(summaries.assembly, "ordered_claims", lambda *given: counted.append(1) or whole(*given))
    found = [registry.QUERIES[q](spark, "made-of-rows") for q in ("k1_identity_sentence", "k5_workplaces_sentence")]
    assert [df.count() for df in found] == [1, 1] and counted == [1]
    assert all("_here" not in _plan(df) for df in found)
