"""Registered queries against their SQL on the smallest tables. `FACTLOOM_ALL=1` runs every query."""
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracles import kind, norm

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_links_per_host", "a10_page_store", "b1_normalized_url", "b17_profile_urls", "b23_first_date_in_text", "b29_domain_resembles", "c3_job_postings", "c14_news_items", "c17_role_ads", "c21_name_span",
    "c28_filing_lines", "d1_robots_rules", "d3_disallow_filter", "e9_judged_facts", "e21_candidate_decisions", "f3_name_taken", "f9_employer_matches", "g6_numbered_evidence",
    "g8_scores", "h2_material_changes", "h7_breaker_summary", "h10_carried_forward", "j4_required_rows", "k3_trend_classes", "l1_stream_fold", "o3_verbatim_spans",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("FACTLOOM_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(norm(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.sql(entry.oracle_sql()[name])
    assert sorted(result.columns) == columns
    place = [result.columns.index(c) for c in columns]
    assert mine == sorted(tuple(norm(r[i]) for i in place) for r in result.fetchall())
    types = {c: kind(str(t)) for c, t in zip(result.columns, result.types)}
    assert {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields} == types


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200
