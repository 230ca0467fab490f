"""Facts and records are dealt over tasks, and expressions stay where they were put."""
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import similarity
from factloom.operators import gates, registry_facts, staging


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _facts(spark, rows):
    made = spark.createDataFrame(rows, "org_number string, item_ord long, field string, value string, source_url string")
    return schemas.conform(made, schemas.RAW_FACT, stage_ord=F.lit(0), page_ord=F.lit(0))


def test_facts_without_a_profile_do_not_meet_in_one_task(spark):
    rows = [(str(i), n, "dated_activity", f"News {n}", f"https://firma{i}.no/om") for i in range(500) for n in range(2)]
    rows += [("1", 5, "company_profile", "https://www.facebook.com/firma1bergen", "https://firma1.no/"), ("2", 5, "company_profile", "https://www.facebook.com/firma2", "https://firma2.no/"),
             (None, 6, "company_profile", "https://www.facebook.com/firma3bergen", "https://firma3.no/"), ("3", 7, "company_profile", None, "https://firma3.no/")]
    entities = spark.createDataFrame([(str(i), f"Firma{i} AS", f"https://www.firma{i}.no", "Kai 1, 0150 OSLO") for i in range(500)],
                                     "org_number string, legal_name string, official_site string, registered_address string")
    towns = spark.createDataFrame([("Bergen",)], "town string")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        judged = gates.judge_facts(_facts(spark, rows), entities, towns).withColumn("task", F.spark_partition_id())
        found = judged.select("org_number", "item_ord", "reject_reason", "source_class", "task").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    per_task = {t: sum(r["task"] == t for r in found) for t in {r["task"] for r in found}}
    assert len(found) == len(rows) and max(per_task.values()) < len(rows) / 2
    odd = {(r["org_number"], r["item_ord"]): r["reject_reason"] for r in found if r["reject_reason"] is not None}
    assert odd == {("1", 5): "other_account", (None, 6): "no_identity"}
    assert {r["source_class"] for r in found if r["org_number"] is not None} == {"company_owned"}


def test_stretches_are_aligned_by_falling_bound(monkeypatch):
    aligned = []
    whole = similarity._common_length
    monkeypatch.setattr(similarity, "_common_length", lambda *given: aligned.append(1) or whole(*given))
    a, b = "acme tromsø", "nord og sør eiendom i bergen og acme tromsa"
    score = similarity._best_window(a, b)
    tried = len(aligned)
    every = max(similarity._ratio(a, b[max(0, end - len(a)):min(end, len(b))]) for end in range(1, len(a) + len(b)))
    assert score == every and tried < 5


def test_computed_columns_stand_below_the_generator(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), ("abc", 3)], "v string, n int")
    found = staging.computed(rows, size=F.length("v"), again=F.col("n") + 1).filter("size > 1")
    plan = _plan(found)
    assert found.columns == ["v", "n", "size", "again"] and [tuple(r) for r in found.collect()] == [("abc", 3, 3, 4)]
    assert plan.count("length(v") == 1 and "inline(_made" in plan
    assert staging.computed(rows, size=F.length("v")).count() == 3


def test_a_filter_on_a_record_stays_above_the_dealing(spark):
    from factloom.catalog import derived  # its column expressions need the session

    rows = spark.createDataFrame([(i, None if i % 3 else f'{{"navn":"A{i}"}}') for i in range(10)], "k int, body string")
    dealt = derived.spread(rows, 10, 4)
    plan = _plan(dealt.withColumn("r", F.from_json("body", "navn string")).filter("r.navn IS NOT NULL"))
    lines = plan.splitlines()
    place = next(i for i, line in enumerate(lines) if "Repartition" in line)
    assert dealt.columns == rows.columns and sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert any("from_json" in line for line in lines[:place]) and not any("from_json" in line for line in lines[place:])


def test_facts_of_a_record_are_listed_before_they_are_exploded(spark):
    body = '{"navn":"A AS","antallAnsatte":3,"konkurs":false}'
    rows = spark.createDataFrame([("1", "entity", 1, "https://r.no/1", 200, body, None), ("2", "entity", 1, "https://r.no/2", 200, "no record", None)], schemas.RESPONSE)
    found = registry_facts.live_facts(rows)
    assert "posexplode(_facts" in _plan(found) and "Filter (size(array" not in _plan(found)
    assert sorted((r["org_number"], r["field"], r["item_ord"], r["value"]) for r in found.collect()) == [
        ("1", "employee_count", 4, "3"), ("1", "legal_name_registry", 7, "A AS"), ("1", "operating_status", 6, "Active")]


def test_written_rows_are_bounded_by_the_file(spark, monkeypatch):
    from factloom.catalog import summaries  # its column expressions need the session

    monkeypatch.setattr(summaries.assembly, "TASK_CLAIMS", 10)
    written = summaries._once(spark, "made-of-rows", "bounded", lambda: spark.range(35).coalesce(1))
    per_file = [r["count"] for r in written.groupBy(F.input_file_name()).count().collect()]
    assert sorted(per_file) == [5, 10, 10, 10] and written.agg(F.sum("id")).first()[0] == 595
