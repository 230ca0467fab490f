"""An envelope is put together from few passes: what sentences, signals and overview share is written once, citations are
numbered where they stand, evidence is described as it is numbered."""
import datetime

import pytest
from pyspark.sql import functions as F

from factloom import schemas
from factloom.operators import evidence
from factloom.plans import assembly, envelope, summary
from factloom.session import materialise

AT = datetime.datetime(2024, 6, 1)


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def _claims(spark, *rows):
    """Claims of (org_number, field, value, source, source_class), numbered."""
    made = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "org_number string, field string, value string, source string, source_class string, item_ord long")
    return materialise(assembly.ordered_claims(schemas.conform(made, schemas.CLAIM, state=F.lit("available"), retrieved_at=F.lit(AT))), "made")


def _built(claims, written):
    runs = claims.select("org_number").distinct().select("org_number", F.lit("2024-06-01").alias("run_day"), F.lit(True).alias("is_first_run"), F.lit(None).cast("string").alias("previous_day"))
    changes = claims.filter("false").select("org_number", "field", F.lit("changed").alias("kind"), F.col("value").alias("old"), F.col("value").alias("new"))
    return runs, summary.build(claims, runs, changes, written)


def _some(spark):
    return _claims(
        spark, ("1", "legal_name", "A AS", "https://a.no/", "official_registry"), ("1", "leader", "Kari (Daglig leder)", "https://a.no/2", None), ("1", "leader", "Kari (Daglig leder)", "https://a.no/2", "later"),
        ("1", "hiring_signal", "Open role: Selger - https://a.no/", None, None), ("2", "legal_name", "B AS", None, None), ("3", "operating_status", "In liquidation", "https://a.no/3", None))


def test_citations_are_numbered_where_they_stand(spark):
    rows = spark.createDataFrame([("a", "s", 3), ("a", None, 1), ("a", "s", 5), ("a", "t", 4), ("b", "t", 2), ("b", None, 9), ("b", None, 2), (None, "s", 1)], "k string, s string, n long")
    blocks, here = (evidence.numbered_by_first_use(rows, ["k"], ["s"], ["n", "s"], "no", 2, together=t) for t in (False, True))
    assert "Join" in _plan(blocks) and "Join" not in _plan(here) and here.schema["no"].dataType == blocks.schema["no"].dataType
    assert sorted(map(str, here.collect())) == sorted(map(str, blocks.collect())) and here.columns == blocks.columns


@pytest.mark.parametrize("together", [False, True])
def test_a_source_is_described_by_its_first_use(spark, together):
    rows = spark.createDataFrame([("a", "s", 2, "late"), ("a", "s", 1, None), ("a", "t", 3, "own")], "k string, s string, n long, about string")
    found = evidence.numbered_by_first_use(rows, ["k"], ["s"], ["n"], "no", described=["about"], together=together)
    assert sorted((r["n"], r["no"], r["first_use"]["about"]) for r in found.collect()) == [(1, 1, None), (2, 1, None), (3, 2, "own")]


def test_what_sentences_share_is_written_once(spark):
    claims = _some(spark)
    plain, once = _built(claims, False)[1], _built(claims, True)[1]
    for a, b in zip(plain, once):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.columns == b.columns
    assert "Join" in _plan(plain[2]) and "Join" not in _plan(once[0]) and "Join" not in _plan(once[2])


def test_an_envelope_takes_five_joins(spark):
    claims = _some(spark)
    runs, built = _built(claims, True)
    parts = [materialise(t, "made") for t in built]
    about = runs.select("org_number", F.lit("r").alias("run_id"), F.lit(AT).alias("started_at"), F.lit(AT).alias("completed_at"))
    found = envelope.build(claims, *parts, claims.filter("false").select("org_number", F.col("value").alias("text")), about)
    assert _plan(found).count("Join ") == 5  # numbers and units to the overview, it and the changes to the run, the claims
    rows = {r["organisation_number"]: r for r in found.collect()}
    first = rows["1"]
    assert [(e["id"], e["source_url"], e["source_class"]) for e in first["evidence"]] == [("ev-1", "https://a.no/", "official_registry"), ("ev-2", "https://a.no/2", None)]
    assert [c["evidence_ids"] for c in first["claims"]] == [["ev-1"], ["ev-2"], ["ev-2"], []]
    assert [(s["n"], s["url"]) for s in first["summary"]["sources"]] == [(1, "https://a.no/"), (2, "https://a.no/2")]
    assert first["summary"]["text"].startswith("As of 2024-06-01. What it does: A AS (org. no. 1) is a registered Norwegian entity. [1] People and presence: Led by Kari (managing director")
    assert first["summary"]["sentences"][0]["evidence_ids"] == ["ev-1"] and first["summary"]["signals"][0]["sources"] == []
    assert rows["2"]["summary"]["signals"] is None and rows["2"]["summary"]["sources"] == [] and rows["2"]["evidence"] is None
    assert [s["evidence_ids"] for s in rows["3"]["summary"]["signals"]] == [["ev-1"]]


def test_made_claims_are_numbered_where_they_stand(spark, tmp_path, monkeypatch):
    from factloom.catalog import summaries  # its column expressions need the session

    customers = spark.range(1, 31).select(F.col("id").cast("long").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment"), F.lit(1.5).alias("c_acctbal"))
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 31).select(F.col("id").cast("long").alias("p_partkey"), F.lit("cold widget").alias("p_name")).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(assembly, "row_numbers", None)  # numbering by blocks
    claims = summaries._profile_claims(spark, str(tmp_path)).collect()
    assert sorted((r["org_number"], r["claim_no"]) for r in claims) == [(str(900000000 + k), n) for k in range(1, 31) for n in range(1, 15)]
    assert [r["field"] for r in sorted(claims, key=lambda r: r["claim_no"]) if r["org_number"] == "900000001"][:3] == ["legal_name", "official_website", "operating_status"]
