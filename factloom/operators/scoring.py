"""Precision and recall of published profiles against labels."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed, similarity


def label_results(labels: DataFrame, published: DataFrame, key: str, expected: str, name: str) -> DataFrame:
    """Every label with `published` (a name is available) and `correct` (it reads like the expected one).
    One row per key on both sides."""
    joined = labels.join(published.select(key, name), key, "left")
    score = similarity.token_sort_similarity(F.col(name), F.col(expected))
    return joined.withColumn("published", F.col(name).isNotNull()).withColumn(
        "correct", F.coalesce(score >= fixed.NAME_THRESHOLD, F.lit(False))
    )


def expected_claims(labels: DataFrame, claims: DataFrame, key: str, expected_fields: str) -> DataFrame:
    """(key, field, expected, found): expected substrings and whether a claim of that field holds them."""
    wanted = labels.select(key, F.explode(expected_fields).alias("field", "expected"))
    values = claims.filter("value IS NOT NULL").select(key, "field", "value")
    hits = wanted.join(values, [key, "field"]).filter(F.contains(F.lower("value"), F.lower("expected"))).select(key, "field").distinct()
    return wanted.join(hits.withColumn("found", F.lit(True)), [key, "field"], "left").fillna(False, ["found"])


def scores(results: DataFrame, published: Column, correct: Column, expected: Column, hits: Column) -> DataFrame:
    """One row: company recall, claim recall, precision (100 when nothing is published) in percent, and
    coverage out of 35. `expected` and `hits` are claim counts per row."""
    counts = results.agg(
        F.count(F.lit(1)).alias("labels"), F.count_if(published).alias("published"), F.count_if(published & correct).alias("correct"),
        F.coalesce(F.sum(expected), F.lit(0)).alias("expected"), F.coalesce(F.sum(F.when(correct, hits)), F.lit(0)).alias("hits"),
    )

    def percent(part: str, whole: str, empty: float) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole) * 100).otherwise(F.lit(empty))

    rated = counts.withColumn("company_recall", percent("correct", "labels", 0.0)).withColumn("claim_recall", percent("hits", "expected", 0.0)).withColumn(
        "precision", percent("correct", "published", 100.0)
    ).withColumn("coverage", 35.0 * (0.7 * F.col("company_recall") / 100 + 0.3 * F.col("claim_recall") / 100))
    return rated.withColumn(
        "meets_targets", (F.col("coverage") >= 21) & (F.col("company_recall") >= 60) & (F.col("precision") >= 95)
    )
