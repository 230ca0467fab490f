"""From confirmed facts to the long claims table, and the nested profile as a view of it."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import fixed, names, similarity
from factloom.operators import curation, evidence
from factloom.operators.ordered import first_wins, row_numbers

IDENTITY_FIELDS = ["industry", "employee_count", "legal_form", "operating_status", "founded_date", "business_description"]
METRIC_FIELDS = [name for name, _ in fixed.METRICS] + ["annual_report_pdf"]
TASK_CLAIMS = 50_000  # of half a kilobyte or more in memory, a few dozen bytes in a file


def tasks_of(count: int | None) -> int | None:
    """Tasks for `count` claims. Spark sizes tasks by compressed bytes, and their number by the session: a task's memory would grow
    with the table."""
    return None if count is None else max(1, -(-count // TASK_CLAIMS))


# --- claim constructors -------------------------------------------------------------------

def available_claims(facts: DataFrame, field: Column | None = None) -> DataFrame:
    """Confirmed facts as available claims."""
    given = {"state": F.lit("available"), "source": F.col("source_url")}
    return schemas.conform(facts, schemas.CLAIM, **given, **({} if field is None else {"field": field}))


def empty_claims(keys: DataFrame, field: str, state: Column, **given: Column) -> DataFrame:
    """A claim of the given state without a value."""
    return schemas.conform(keys, schemas.CLAIM, field=F.lit(field), state=state, stage_ord=F.lit(0), page_ord=F.lit(0), item_ord=F.lit(0), **given)


def registry_claims(entities: DataFrame, field: str, value: str) -> DataFrame:
    """A claim straight from the resolved record: the state of the resolution, or not_available when the
    record has no such value."""
    resolved = F.col("resolution_state") == "available"
    has = resolved & F.col(value).isNotNull()

    def only(condition: Column, column: Column) -> Column:
        return F.when(condition, column)

    return schemas.conform(
        entities, schemas.CLAIM, field=F.lit(field), value=only(has, F.col(value)), stage_ord=F.lit(0), page_ord=F.lit(0), item_ord=F.lit(0),
        state=F.when(has, "available").when(resolved, "not_available").otherwise(F.col("resolution_state")),
        retrieved_at=only(resolved, F.col("retrieved_at")), content_hash=only(has, F.col("content_hash")),
        source_class=only(has, F.lit("official_registry")), extraction_method=only(has, F.lit("registry")),
        match_confidence=only(has, F.lit(100.0)),
    )


# --- single-valued fields -----------------------------------------------------------------

def legal_name_claims(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Cited to the live record when it was read, else to the resolved one."""
    live = first_wins(facts.filter("field = 'legal_name_registry'"), ["org_number"], schemas.ORDER)
    resolved = entities.filter("resolution_state = 'available'").select("org_number")
    quoted = available_claims(live.join(resolved, "org_number", "left_semi"), F.lit("legal_name"))
    rest = registry_claims(entities, "legal_name", "legal_name").join(quoted.select("org_number"), "org_number", "left_anti")
    return quoted.unionByName(rest)


def official_site_claims(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """A registered website: evidence from the site, else why it is unproven, else the co-op rule, else the
    live record, else the snapshot. Without one: a discovered site, else nothing on file."""
    fields = ["official_site_evidence", "official_site_unproven", "official_site_registry", "official_site"]
    firsts = first_wins(facts.filter(F.col("field").isin(fields)), ["org_number", "field"], schemas.ORDER)
    row = F.struct(*[F.col(c) for c in schemas.CONFIRMED_FACT if c not in ("org_number", "field")])
    wide = firsts.groupBy("org_number").agg(*[F.max(F.when(F.col("field") == f, row)).alias(f) for f in fields])
    base = registry_claims(entities, "official_website", "official_site").join(
        entities.select("org_number", F.col("legal_name").alias("_name"), F.col("official_site").alias("_site")), "org_number"
    ).join(wide, "org_number", "left")
    registered = F.col("state") == "available"
    co_op = names.is_housing_coop(F.col("_name")) & ~names.domain_resembles(F.col("_site"), F.col("_name"))
    live = F.col("official_site_registry").isNotNull() & (F.col("official_site_registry.value") == F.col("_site"))
    choice = (
        F.when(registered & F.col("official_site_evidence").isNotNull(), "evidence").when(registered & F.col("official_site_unproven").isNotNull(), "unproven")
        .when(registered & F.coalesce(co_op, F.lit(False)), "manager").when(registered & F.coalesce(live, F.lit(False)), "live").when(registered, "snapshot")
        .when(F.col("official_site").isNotNull(), "discovered").otherwise("none")
    )
    chosen = base.withColumn("_choice", choice)
    fact = F.when(F.col("_choice") == "evidence", F.col("official_site_evidence")).when(F.col("_choice") == "live", F.col("official_site_registry")).when(
        F.col("_choice") == "discovered", F.col("official_site")
    )
    taken = available_claims(
        chosen.filter(F.col("_choice").isin("evidence", "live", "discovered")).select("org_number", fact.alias("_f")).select("org_number", "_f.*"),
        F.lit("official_website"),
    )
    unsure = chosen.filter(F.col("_choice").isin("unproven", "manager"))
    reason = F.when(F.col("_choice") == "unproven", F.col("official_site_unproven.value")).otherwise(
        F.concat(F.lit("Registered website "), "_site", F.lit(": a housing co-op's registered site is usually its property manager's"))
    )
    ambiguous = empty_claims(unsure.select("org_number", "source", reason.alias("reason")), "official_website", F.lit("ambiguous"))
    return taken.unionByName(ambiguous).unionByName(chosen.filter(F.col("_choice").isin("snapshot", "none")).select(*schemas.CLAIM))


def brand_claims(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """What the company's own pages call it: of a page title used as a name, the part that reads like the
    company."""
    own = first_wins(facts.filter("field = 'organization_name' AND linked_from IS NULL"), ["org_number"], schemas.ORDER)
    named = own.join(entities.select("org_number", F.col("legal_name").alias("_name")), "org_number", "left")
    parts = F.filter(
        F.transform(F.split("value", fixed.TITLE_SEPARATOR), F.trim), lambda p: (p != "") & ~p.rlike(fixed.PAGE_NAME)
    )
    by_length = F.transform(F.array_sort(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))), lambda s: s["p"])
    split = (F.size(parts) > 0) & ~((F.size(parts) == 1) & (F.get(parts, F.lit(0)) == F.col("value")))
    scored = named.withColumn("_best", similarity.best_match(F.array("_name"), F.when(split, by_length)))
    better = F.coalesce(F.col("_best.score") >= fixed.BRAND_THRESHOLD, F.lit(False))
    out = scored.withColumn("evidence_span", F.when(better, F.coalesce("evidence_span", "value")).otherwise(F.col("evidence_span"))).withColumn(
        "value", F.when(better, F.col("_best.text")).otherwise(F.col("value"))
    )
    claims = available_claims(out, F.lit("public_brand"))
    missing = entities.select("org_number").join(claims.select("org_number"), "org_number", "left_anti")
    return claims.unionByName(empty_claims(missing, "public_brand", F.lit("not_available")))


def latest_accounts_claims(entities: DataFrame, facts: DataFrame, states: DataFrame, previous: DataFrame) -> DataFrame:
    """The newest filing. After a failed read the last good claim is carried forward; a confirmed absence
    never is. `states` is (org_number, accounts_state), `previous` the claims of the earlier snapshot."""
    fresh = available_claims(first_wins(facts.filter("field = 'annual_accounts_latest'"), ["org_number"], schemas.ORDER))
    without = entities.select("org_number").join(fresh.select("org_number"), "org_number", "left_anti").join(states, "org_number", "left")
    failed = without.filter("accounts_state = 'failed'").select("org_number")
    last_good = previous.filter("field = 'annual_accounts_latest' AND state = 'available'")
    carried = schemas.conform(last_good.join(failed, "org_number", "left_semi"), schemas.CLAIM)
    unread = failed.join(carried.select("org_number"), "org_number", "left_anti")
    absent = without.filter("accounts_state IS NULL OR accounts_state <> 'failed'").select("org_number")
    return (
        fresh.unionByName(carried).unionByName(empty_claims(unread, "annual_accounts_latest", F.lit("failed")))
        .unionByName(empty_claims(absent, "annual_accounts_latest", F.lit("not_available")))
    )


# --- all claims ---------------------------------------------------------------------------

def build_claims(entities: DataFrame, facts: DataFrame, states: DataFrame, previous: DataFrame) -> DataFrame:
    """Every claim of every entity as one long table. `entities` is the resolved table, `facts` the
    confirmed facts in their reading order."""
    order = schemas.ORDER
    scalar_facts = facts.filter(F.col("field").isin(IDENTITY_FIELDS)).unionByName(
        facts.filter("field = 'site_description' AND linked_from IS NULL")
    )
    scalars = available_claims(curation.first_of_field(scalar_facts, ["org_number"], "field", order))
    plain_lists = available_claims(
        facts.filter(F.col("field").isin("workplace", "annual_accounts_history", *METRIC_FIELDS) | (
            (F.col("field") == "leader") & (F.col("source_class") == "official_registry")
        ))
    )
    founded = curation.first_of_field(facts.filter("field = 'founded_date'"), ["org_number"], "field", order).select("org_number", F.col("value").alias("founded"))
    about = entities.select("org_number", "legal_name").join(founded, "org_number", "left")
    news = curation.curated_news(facts.filter("field = 'dated_activity'"), about)
    hiring = curation.unique_claims(available_claims(facts.filter("field = 'hiring_signal'")), ["org_number", "field"], order)
    hiring = curation.limited_careers(curation.open_postings(hiring, "org_number"), "org_number", order)
    parts = [
        legal_name_claims(entities, facts), brand_claims(entities, facts), official_site_claims(entities, facts),
        latest_accounts_claims(entities, facts, states, previous), scalars,
        curation.unique_claims(plain_lists, ["org_number", "field"], order),
        curation.unique_profiles(available_claims(facts.filter("field = 'company_profile'")), ["org_number", "field"], order), hiring,
        curation.unique_claims(available_claims(news), ["org_number", "field"], order),
    ]
    return reduce(lambda a, b: a.unionByName(b), [p.select(*schemas.CLAIM) for p in parts])


def with_reasons(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Claims plus one `not_available` claim for every checked and empty area, and a one-line reason on
    each blank claim that has none."""
    flags = claims.groupBy("org_number").agg(
        F.max(F.when(F.col("field") == "official_website", F.when((F.col("state") == "available") & F.col("value").isNotNull(), "confirmed").when(
            F.col("state") == "ambiguous", "ambiguous").otherwise("none"))).alias("_site"),
        *[F.max((F.col("field") == f).cast("int")).alias(f"_has_{f}") for f in ("company_profile", "hiring_signal", "employee_count", "legal_form")],
    )
    absent = F.filter(F.array(
        F.when(F.col("_has_company_profile") == 0, F.lit("company_profile")), F.when(F.col("_has_hiring_signal") == 0, F.lit("hiring_signal")),
        F.when((F.col("_has_employee_count") == 0) & (F.col("_has_legal_form") == 1), F.lit("employee_count")),
    ), lambda f: f.isNotNull())
    missing = flags.select("org_number", F.explode(absent).alias("field"))
    blank = schemas.conform(missing, schemas.CLAIM, state=F.lit("not_available"), stage_ord=F.lit(0), page_ord=F.lit(0), item_ord=F.lit(0))
    empty = claims.filter("state <> 'available'").unionByName(blank).join(flags.select("org_number", "_site"), "org_number", "left")
    reason = F.coalesce(F.nullif("reason", F.lit("")), default_reason(F.col("field"), F.col("state"), F.col("_site")))
    return claims.filter("state = 'available'").unionByName(empty.withColumn("reason", reason).select(*claims.columns))


def default_reason(field: Column, state: Column, site: Column) -> Column:
    """Why a field is blank, from what was looked at."""
    no_site = F.when(site == "ambiguous", "the registered website could not be confirmed as the company's own").otherwise(
        "no website is registered with Brønnøysund or was found under the company's name"
    )
    confirmed = site == "confirmed"
    return (
        F.when((field == "company_profile") & confirmed, "the company's website links no social profile of its own")
        .when(field == "company_profile", F.concat(no_site, F.lit(", so there are no company-owned profiles to read")))
        .when((field == "hiring_signal") & confirmed, "no single job ad was found on the company's website")
        .when(field == "hiring_signal", F.concat(no_site, F.lit(", so there is no careers page to read")))
        .when(field == "employee_count", "Brønnøysund's register gives no employee count for this company")
        .when((field == "official_website") & (site == "none"), "no website is registered with Brønnøysund or was found under the company's name")
        .when((field == "public_brand") & confirmed, "the company's website states no name other than the registered one")
        .when(field == "public_brand", "no confirmed website to state a trading name")
        .when((field == "annual_accounts_latest") & (state == "not_available"), "no annual accounts are filed in Brønnøysund's accounts register")
    )


def ordered_claims(claims: DataFrame, count: int | None = None, together: bool = False) -> DataFrame:
    """Claims with `claim_no`, their place within the entity: published field order, then reading order.
    The order is total: ties end at the value. With their `count`, roughly, tasks grow in number and not in size. Claims that stand
    `together`, an entity's few in one task, are numbered where they are; others by blocks, as an entity may have any number."""
    rank = evidence.field_rank(F.col("field"))
    block = (
        rank.cast("bigint") * 10**10 + F.coalesce(F.col("stage_ord"), F.lit(0)).cast("bigint") * 10**8
        + F.least(F.floor(F.coalesce(F.col("page_ord"), F.lit(0)) / 64), F.lit(10**8 - 1))
    )
    placed = claims.withColumn("_rank", rank.cast("bigint")).withColumn("_block", block.cast("bigint")).withColumn(
        "_tie", F.concat_ws("\0", F.coalesce("value", F.lit("")), F.coalesce("reporting_period", F.lit("")), F.coalesce("source", F.lit("")))
    )
    order = ["_rank", "_stage", "_page", "_item", "_tie"]
    placed = placed.withColumn("_stage", F.coalesce("stage_ord", F.lit(0))).withColumn("_page", F.coalesce("page_ord", F.lit(0))).withColumn(
        "_item", F.coalesce("item_ord", F.lit(0))
    )
    if together:
        number = F.row_number().over(W.partitionBy("org_number").orderBy(*order)).cast("bigint")
        return placed.withColumn("claim_no", number).drop("_block", *order)
    return row_numbers(placed, ["org_number"], order, "_block", "claim_no", tasks_of(count)).drop("_block", *order)


def profiles(claims: DataFrame, max_claims: int = 5000, count: int | None = None) -> DataFrame:
    """The nested profile: (org_number, part, sections). An entity with more than `max_claims` claims comes
    in several parts, in claim order, so no profile has to fit in one row. `claims` carries claim_no. With their `count`, tasks
    grow in number and not in size; claims are then dealt by profile before they are collected."""
    entry = F.struct("claim_no", *[c for c in schemas.CLAIM if c not in ("org_number", *schemas.ORDER)])
    section = (
        F.when(F.col("field").isin("legal_name", "public_brand", *IDENTITY_FIELDS, "site_description"), "legal_identity")
        .when(F.col("field").isin("annual_accounts_latest", "annual_accounts_history", *METRIC_FIELDS), "annual_accounts")
        .when(F.col("field").isin("leader", "workplace"), "leadership").when(F.col("field").isin("official_website", "company_profile"), "online_presence")
        .otherwise("activity")
    )
    part = F.floor((F.col("claim_no") - 1) / max_claims).cast("int")
    placed = claims.withColumn("part", part).withColumn("section", section)
    dealt = placed if count is None else placed.repartition(tasks_of(count), "org_number", "part")
    sections = dealt.groupBy("org_number", "part", "section").agg(
        F.array_sort(F.collect_list(entry)).alias("claims")
    )
    return sections.groupBy("org_number", "part").agg(F.map_from_entries(F.collect_list(F.struct("section", "claims"))).alias("sections"))
