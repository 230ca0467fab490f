"""Data-quality rules, audits and run reports."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed, urls
from factloom.operators.joins import salted_join


# --- claim rules --------------------------------------------------------------------------

def broken_rule(state: Column, value: Column, retrieved_at: Column) -> Column:
    """The first claim rule a row breaks, NULL when it keeps them all."""
    return (
        F.when(state.isNull() | ~state.isin(fixed.STATES), "unknown_state")
        .when((state != "available") & value.isNotNull(), "value_without_availability")
        .when((state == "available") & value.isNull(), "available_without_value")
        .when((state == "available") & retrieved_at.isNull(), "available_without_time")
    )


def split_claims(claims: DataFrame, state: str = "state", value: str = "value", retrieved_at: str = "retrieved_at") -> tuple[DataFrame, DataFrame]:
    """(good claims, quarantined claims with `rule`)."""
    judged = claims.withColumn("rule", broken_rule(F.col(state), F.col(value), F.col(retrieved_at)))
    return judged.filter("rule IS NULL").drop("rule"), judged.filter("rule IS NOT NULL")


def inconsistent_refresh(is_first_run: Column, previous_run: Column, n_changes: Column) -> Column:
    """A first run has neither an earlier run nor changes."""
    return (
        F.when(is_first_run & previous_run.isNotNull(), "first_run_with_previous").when(is_first_run & (n_changes > 0), "first_run_with_changes")
        .when(~is_first_run & previous_run.isNull(), "refresh_without_previous")
    )


def partition_totals(snapshots: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows and an order-free content total per partition; equal before and after a rerun when nothing
    earlier was rewritten."""
    return snapshots.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("content_total")
    )


def rewritten_partitions(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Partitions of `before` whose rows are no longer all there unchanged."""
    return before.join(after.withColumnRenamed("rows", "_rows").withColumnRenamed("content_total", "_total"), by, "left").filter(
        F.col("_rows").isNull() | (F.col("_rows") != F.col("rows")) | (F.col("_total") != F.col("content_total"))
    ).select(*before.columns)


# --- audit --------------------------------------------------------------------------------

def audit_flags(claims: DataFrame, names: DataFrame) -> DataFrame:
    """Claims with the audit's flags. `names` is (org_number, legal_name)."""
    joined = salted_join(claims, names.select("org_number", F.lower("legal_name").alias("_name")), ["org_number"], "left")
    coop = F.coalesce(F.col("_name").rlike("|".join(fixed.AUDITED_COOP_TERMS)), F.lit(False))
    managed = urls.on_any(urls.host(F.coalesce("source", F.lit(""))), fixed.AUDITED_MANAGER_HOSTS)
    is_value = F.col("value").isNotNull() & (F.col("value") != "")
    return joined.select(
        *claims.columns,
        F.coalesce(~F.col("state").isin(fixed.STATES), F.lit(True)).alias("bad_state"),
        F.coalesce(F.length("value") > fixed.MAX_CLAIM_CHARS, F.lit(False)).alias("too_long"),
        ((F.col("field") == "hiring_signal") & F.coalesce(F.lower(F.trim("value")).isin(fixed.GENERIC_HIRING), F.lit(False))).alias("junk_hiring"),
        (F.col("field").isin("company_profile", "hiring_signal", "dated_activity") & coop & managed).alias("manager_leak"),
        ((F.col("field") == "workplace") & is_value).alias("is_workplace"), ((F.col("field") == "hiring_signal") & is_value).alias("is_hiring"),
    )


def audit(flagged: DataFrame) -> DataFrame:
    """One row: totals of every flag and the verdict."""
    totals = flagged.agg(
        F.count_distinct("org_number").alias("records"), F.count_if("is_workplace").alias("workplaces"), F.count_if("is_hiring").alias("hiring_signals"),
        F.count_if("manager_leak").alias("disqualifiers"), (F.count_if("too_long") + F.count_if("junk_hiring")).alias("warnings"),
        F.count_if("bad_state").alias("bad_states"),
    )
    return totals.withColumn("passed", (F.col("disqualifiers") == 0) & (F.col("bad_states") == 0))


# --- run reports --------------------------------------------------------------------------

def run_totals(rows: DataFrame, key: str, chunk: Column, cost: Column, failed: Column) -> DataFrame:
    """One row of totals for a run."""
    return rows.agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct(key).alias("inputs"), F.count_distinct(chunk).alias("chunks"),
        F.sum(cost).alias("spend"), F.count_if(failed).alias("failures"),
    )


def request_breakdown(requests: DataFrame, host: Column, status: Column, top: int = 15) -> tuple[DataFrame, DataFrame]:
    """(totals, busiest hosts): requests, redirects and server errors, and the hosts asked most."""
    totals = requests.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(status.between(300, 399)).alias("redirects"), F.count_if(status >= 500).alias("server_errors")
    )
    hosts = requests.groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("requests")).orderBy(F.desc("requests"), "host").limit(top)
    return totals, hosts


def run_health(claims: DataFrame, field: str, state: str) -> DataFrame:
    """Claims per field and state with subtotals and a grand total (`all`)."""
    rolled = claims.rollup(field, state).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return rolled.select(
        F.when(F.col("level") == 3, "all").otherwise(F.col(field)).alias("field"), F.when(F.col("level") >= 1, "all").otherwise(F.col(state)).alias("state"), "n"
    )


def area_coverage(keys: DataFrame, claims: DataFrame, key: str, field: str, areas: dict[str, list[str]]) -> DataFrame:
    """(key, one flag per area, areas_covered): which areas of a profile hold at least one claim."""
    flags = claims.groupBy(key).agg(*[F.max(F.col(field).isin(fields).cast("int")).alias(area) for area, fields in areas.items()])
    joined = keys.select(key).distinct().join(flags, key, "left").fillna(0, list(areas))
    return joined.withColumn("areas_covered", sum(F.col(a) for a in areas))


def side_by_side(claims: DataFrame, key: str, field: str, value: str, keys: list) -> DataFrame:
    """(field, one column per key, differs) for two to four entities."""
    chosen = claims.filter(F.col(key).isin(keys))
    table = chosen.groupBy(field).pivot(key, keys).agg(F.min(value))
    columns = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\0")) for k in keys]
    return table.withColumn("differs", F.size(F.array_distinct(F.array(*columns))) > 1)
