"""An accounts list is parsed once, and only the filings that are picked are read."""
import datetime
import json

from pyspark.sql import functions as F

from factloom import schemas
from factloom.catalog import load
from factloom.operators import registry_facts
from factloom.plans import assembly

AT = datetime.datetime(2024, 6, 1)


def _filing(end, revenue=None, result=None, kind="SELSKAP", journal="7", **more):
    doc = {"journalnr": journal, "regnskapstype": kind, "valuta": "NOK", "regnskapsperiode": {"tilDato": end}, "resultatregnskapResultat": {**more}}
    if revenue is not None:
        doc["resultatregnskapResultat"]["driftsresultat"] = {"driftsinntekter": {"sumDriftsinntekter": revenue}}
    if result is not None:
        doc["resultatregnskapResultat"]["aarsresultat"] = result
    return doc


def _responses(spark, *lists):
    rows = [(org, "accounts", 1, f"https://r.no/{org}", 200, body if isinstance(body, str) else json.dumps(body), AT) for org, body in lists]
    return spark.createDataFrame(rows, schemas.RESPONSE)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _parses(df):
    return _plan(df).lower().count("parsejson(")


def _facts(spark):
    responses = _responses(
        spark,
        ("1", [_filing("2021-12-31", 100, 5), _filing("2023-12-31", 1500, -20), _filing("2023-12-31", 9, 9), _filing("2023-12-31", 4, 4, "KONSERN"), _filing("2022-12-31", None, 12, journal="")]),
        ("2", [None, 3, {"regnskapstype": "SELSKAP"}, _filing("2020-12-31", None, None, journal=None)]), ("3", "[]"), ("4", "no list"), (None, [_filing("2023-12-31", 70, 1)]),
    )
    return registry_facts.accounts_facts(registry_facts.company_filings(registry_facts.filing_docs(responses)))


def test_lists_are_parsed_once_for_all_facts(spark):
    plan = _plan(_facts(spark))
    assert _parses(_facts(spark)) == 1 and "Join" not in plan and "Union" not in plan and "(size(" not in plan
    lines = _facts(spark).filter("field LIKE 'annual_accounts_%'").select("org_number", "field", "reporting_period", "value")
    assert "filing_text" in plan and "filing_text" not in _plan(lines) and _parses(lines) == 1


def test_facts_of_filings(spark):
    found = {(r["org_number"], r["field"], r["reporting_period"]): (r["stage_ord"], r["item_ord"], r["value"], r["evidence_span"], r["effective_date"]) for r in _facts(spark).collect()}

    def later(day):
        return (datetime.date(2500, 1, 1) - datetime.date.fromisoformat(day)).days

    assert found == {
        ("1", "revenue", "FY2023"): (11, 100, "1,500 NOK", '"sumDriftsinntekter":1500', "2023-12-31"),
        ("1", "annual_result", "FY2023"): (11, 103, "-20 NOK", '"aarsresultat":-20', "2023-12-31"),
        ("1", "annual_report_pdf", "FY2023"): (11, 107, "https://data.brreg.no/regnskapsregisteret/regnskap/aarsregnskap/kopi/1/2023", '"journalnr":"7"', "2023-12-31"),
        ("1", "annual_result", "FY2022"): (11, 203, "12 NOK", '"aarsresultat":12', "2022-12-31"),
        ("1", "annual_accounts_latest", "FY2023"): (12, later("2023-12-31"), "Revenue: 1,500 NOK; Net result: -20 NOK", '"sumDriftsinntekter":1500', "2023-12-31"),
        ("1", "annual_accounts_history", "FY2022"): (12, later("2022-12-31"), "Net result: 12 NOK", '"aarsresultat":12', "2022-12-31"),
        ("1", "annual_accounts_history", "FY2021"): (12, later("2021-12-31"), "Revenue: 100 NOK; Net result: 5 NOK", '"sumDriftsinntekter":100', "2021-12-31"),
        (None, "annual_accounts_history", "FY2023"): (12, later("2023-12-31"), "Revenue: 70 NOK; Net result: 1 NOK", '"sumDriftsinntekter":70', "2023-12-31"),
    }


def test_picked_filings_are_dealt_and_read_the_same_before_and_after_the_figures(spark):
    responses = _responses(spark, *[(str(n), [_filing(f"{y}-12-31", n + y, n - y) for y in (2021, 2022, 2023)]) for n in range(20)])
    late = registry_facts.company_filings(registry_facts.filing_docs(responses), 5)
    early = registry_facts.company_filings(registry_facts.filings(responses))
    assert ", 5" in next(line for line in _plan(late).splitlines() if "RepartitionByExpression" in line)
    columns = sorted(c for c in early.columns)
    assert sorted(late.columns) == columns and sorted(map(str, late.select(*columns).collect())) == sorted(map(str, early.select(*columns).collect()))
    assert sorted((r["period_end"], r["rank"]) for r in late.filter("org_number = '3'").collect() if r["rank"]) == [("2022-12-31", 2), ("2023-12-31", 1)]


def _tables(spark, path, n):
    spark.range(1, n + 1).select(
        F.col("id").alias("o_orderkey"), F.lit(datetime.date(1996, 1, 2)).alias("o_orderdate"), (F.col("id") * 1000).cast("double").alias("o_totalprice"),
    ).write.parquet(f"{path}/orders.parquet")


def test_cited_filings_are_picked_once(spark, tmp_path):
    _tables(spark, tmp_path, 40)
    found = load().QUERIES["f16_cited_to_year"](spark, str(tmp_path))
    assert not _parses(found)  # its four branches read written filings
    kept = [k for k in range(1, 41) if k % 31 and k % 37 and k % 29]
    want = [(str(900000000 + k), "list", "1995-12-31") for k in kept] + [(str(900000000 + k), "list" if k % 2 else "year", "1996-12-31") for k in kept]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_filing_claims_are_numbered_where_they_stand(spark, tmp_path):
    claims = assembly.available_claims(_facts(spark))
    here, blocks = assembly.ordered_claims(claims, together=True), assembly.ordered_claims(claims)
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and _parses(here) == 1
    assert here.columns == blocks.columns and here.schema["claim_no"].dataType == blocks.schema["claim_no"].dataType
    assert sorted(map(str, here.collect())) == sorted(map(str, blocks.collect()))
