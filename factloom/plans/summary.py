"""The cited summary: sentences, signals, unknowns, confidence and headline, from claims alone.

Input is the long claims table with claim_no. Each part reduces the claims of an entity to a handful of
values (aggregates and top-k), so the width of a sentence never depends on how many claims there are."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import dates, fixed, money, registry, social, text, urls
from factloom.operators import accounts, refresh
from factloom.operators.joins import salted_join, salts_of
from factloom.operators.ordered import first_wins, top_k
from factloom.plans.assembly import tasks_of
from factloom.session import materialise

KEY = "org_number"
SUMMARY_METRICS = ["revenue", "annual_result", "total_equity"]


def _available(claims: DataFrame) -> DataFrame:
    return claims.filter("state = 'available' AND value <> ''")


def _first_n(rows: DataFrame, order: list[str], n: int, value: Column, out: str) -> DataFrame:
    """(org_number, out): up to `n` values in order, as an array."""
    placed = top_k(rows.withColumn("_v", value), [KEY], order, n, "_place")
    return placed.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_v"))), lambda s: s["_v"]).alias(out))


def scalar_fields(claims: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per entity: each single-valued field as a struct, NULL when there is no claim. `tasks` deals the entities over so
    many tasks, else it is the session's number."""
    wanted = [
        "legal_name", "legal_form", "industry", "founded_date", "operating_status", "employee_count", "business_description",
        "site_description", "official_website", "annual_accounts_latest",
    ]
    row = F.struct("claim_no", "value", "state", "effective_date", "evidence_span", "source_class", "reporting_period", "reason")
    rows = claims.filter(F.col("field").isin(wanted))
    dealt = rows if tasks is None else rows.repartition(tasks, KEY)
    return dealt.groupBy(KEY).agg(*[F.min(F.when(F.col("field") == f, row)).alias(f) for f in wanted])


def _value(field: str) -> Column:
    return F.when((F.col(f"{field}.state") == "available") & (F.col(f"{field}.value") != ""), F.col(f"{field}.value"))


def _cited(*numbers: Column) -> Column:
    return F.filter(F.array(*numbers), lambda n: n.isNotNull())


def _sentence(part: str, body: Column, fields: list[str], cited: Column) -> Column:
    return F.struct(
        F.lit(part).alias("part"), body.alias("text"), F.array(*[F.lit(f) for f in fields]).alias("fields"),
        F.coalesce(cited, F.array().cast("array<bigint>")).cast("array<bigint>").alias("cited"),
    )


# --- what it does -------------------------------------------------------------------------

def identity_text(english: Column | None = None) -> Column:
    """Name, number, legal form, industry, founding year, status and head count. `english` is the official
    English label of the industry code, when a label table was joined."""
    name, form, industry = _value("legal_name"), _value("legal_form"), _value("industry")
    founded, status, staff = _value("founded_date"), _value("operating_status"), _value("employee_count")
    table = F.create_map(*[F.lit(x) for pair in fixed.LEGAL_FORM_TEXT.items() for x in pair])
    phrase = F.element_at(table, form)
    article = F.when(F.lower(F.left(phrase, F.lit(1))).isin(*"aeiou"), "an").otherwise("a")
    who = F.concat(name, F.lit(" (org. no. "), F.col(KEY), F.lit(") is "))
    entity = F.lit("a registered Norwegian entity")
    what = F.when(phrase.isNotNull(), F.concat(article, F.lit(" "), phrase)).when(
        form.isNotNull(), F.concat(entity, F.lit(" (legal form "), form, F.lit(")"))
    ).otherwise(entity)
    trade = F.when(~industry.startswith("00.000"), F.concat(F.lit(" in "), registry.industry_text(industry, F.lit(None).cast("string") if english is None else english)))
    since = F.concat(F.lit(", founded "), F.left(founded, F.lit(4)))
    counted = F.coalesce(F.concat(F.lit(" (registered "), F.left("employee_count.effective_date", F.lit(10)), F.lit(")")), F.lit(""))
    extras = F.concat_ws(", ", F.concat(F.lit("registry status "), status), F.concat(staff, F.lit(" employees"), counted))
    return F.concat(
        who, what, F.coalesce(trade, F.lit("")), F.coalesce(since, F.lit("")), F.when(extras != "", F.concat(F.lit("; "), extras)).otherwise(F.lit("")), F.lit(".")
    )


def activity_text() -> Column:
    """The company's own words on its homepage, else its registered activity."""
    own, registered = _value("site_description"), _value("business_description")
    return F.coalesce(
        F.concat(F.lit('In its own words: "'), text.opening(own, 160), F.lit('".')),
        F.concat(F.lit('Registered activity: "'), text.opening(registered), F.lit('".')),
    )


# --- money --------------------------------------------------------------------------------

def metric_pairs(claims: DataFrame) -> DataFrame:
    """One row per entity: for revenue, annual result and equity the figure of the newest filed period and
    the filing before it in the same currency. `period` is the newest period of the three."""
    rows = _available(claims).filter(F.col("field").isin(SUMMARY_METRICS)).filter("reporting_period <> ''").select(
        KEY, "field", "reporting_period", "effective_date", "claim_no", money.amount(F.col("value")).alias("amount"),
        F.coalesce(money.currency(F.col("value")), F.lit("")).alias("currency"),
    )
    two = top_k(first_wins(rows, [KEY, "field", "reporting_period"], ["claim_no"]), [KEY, "field"], [F.col("reporting_period").desc()], 2, "_place")
    entry = F.struct("reporting_period", "amount", "currency", "claim_no", "effective_date")
    wide = two.groupBy(KEY).agg(
        F.max("reporting_period").alias("period"),
        *[F.max(F.when((F.col("field") == m) & (F.col("_place") == p), entry)).alias(f"_{m}_{p}") for m in SUMMARY_METRICS for p in (1, 2)],
    )
    for m in SUMMARY_METRICS:
        current = F.when(F.col(f"_{m}_1.reporting_period") == F.col("period"), F.col(f"_{m}_1"))
        same = (F.col(f"_{m}_2.currency") == F.col(f"_{m}_1.currency")) & F.col(f"_{m}_2.amount").isNotNull() & F.col(f"_{m}_1.amount").isNotNull()
        wide = wide.withColumn(m, current).withColumn(f"{m}_before", F.when(current.isNotNull() & same, F.col(f"_{m}_2")))
    newest_revenue = F.col("_revenue_1")
    both = (F.col("_revenue_2.currency") == F.col("_revenue_1.currency")) & (F.col("_revenue_2.amount") != 0)
    return wide.select(
        KEY, "period", *SUMMARY_METRICS, *[f"{m}_before" for m in SUMMARY_METRICS], newest_revenue.alias("newest_revenue"),
        F.when(both, money.percent_change(F.col("_revenue_1.amount"), F.col("_revenue_2.amount"))).alias("revenue_change"),
        F.col("_revenue_2.claim_no").alias("revenue_change_base"),
    )


def accounts_sentence() -> Column:
    """How the newest filed year went: revenue trend, profit or loss with margin, equity. Falls back to the
    latest filing's own line."""
    r, n, e = F.col("revenue"), F.col("annual_result"), F.col("total_equity")
    rb, nb, eb = (F.col(f"{m}_before") for m in SUMMARY_METRICS)
    margin = accounts.margin_percent(n["amount"], r["amount"], F.coalesce(r["currency"] == n["currency"], F.lit(False)))
    revenue = accounts.revenue_phrase(r["amount"], rb["amount"], rb["reporting_period"], r["currency"])
    result = accounts.result_phrase(n["amount"], nb["amount"], nb["reporting_period"], n["currency"], margin)
    made = F.concat(F.lit("the company made "), result)
    first = F.coalesce(F.concat(revenue, F.coalesce(F.concat(F.lit(" and "), made), F.lit(""))), made)
    equity = F.when(e.isNotNull(), accounts.equity_phrase(e["amount"], eb["amount"], e["currency"]))
    body = F.concat_ws("; ", first, equity)
    end = F.left(F.coalesce(r["effective_date"], n["effective_date"], e["effective_date"]), F.lit(10))
    intro = F.concat(F.lit("In "), F.col("period"), F.lit(" (company accounts"), F.coalesce(F.concat(F.lit(", year to "), end), F.lit("")), F.lit("), "))
    note = F.when(body.contains("%"), F.lit(" (percentages calculated)")).otherwise(F.lit(""))
    counted = F.when(body != "", F.concat(intro, body, note, F.lit(".")))
    latest = _value("annual_accounts_latest")
    when = F.coalesce(F.concat(
        F.lit(" ("), F.col("annual_accounts_latest.reporting_period"),
        F.coalesce(F.concat(F.lit(", to "), F.left("annual_accounts_latest.effective_date", F.lit(10))), F.lit("")), F.lit(")"),
    ), F.lit(""))
    cited = F.when(
        counted.isNotNull(), _cited(*[F.col(f"{m}{s}.claim_no") for m in SUMMARY_METRICS for s in ("", "_before")])
    ).otherwise(_cited(F.col("annual_accounts_latest.claim_no")))
    sentence = F.coalesce(counted, F.concat(F.lit("Latest filed accounts"), when, F.lit(": "), latest, F.lit(".")))
    return _sentence("money", sentence, SUMMARY_METRICS, cited)


# --- people and presence ------------------------------------------------------------------

def leadership(claims: DataFrame) -> DataFrame:
    """(org_number, leadership_text, leadership_cited): the first two people with all their roles, and how
    many more the register lists. Advisers are never named."""
    rows = _available(claims).filter("field = 'leader'").select(KEY, "claim_no", "value").withColumn("english", registry.role_in_english(F.col("value")))
    leading = ~registry.role_name(F.col("value")).isin(fixed.ADVISER_ROLES)
    rows = rows.withColumn("_leading", leading).withColumn("_person", F.regexp_extract("english", r"(?s)^(.*?)(?: \(|$)", 1)).withColumn(
        "_role", F.regexp_extract("english", r"(?s)^.*? \((.*).$", 1)
    )
    people = rows.filter("_leading").groupBy(KEY, "_person").agg(
        F.min("claim_no").alias("_first"), F.array_sort(F.collect_set(F.struct("claim_no", "_role"))).alias("_roles")
    )
    held = F.filter(F.transform("_roles", lambda r: r["_role"]), lambda r: r != "")
    phrase = F.when(F.size(held) > 0, F.concat("_person", F.lit(" ("), F.array_join(held, ", "), F.lit(")"))).otherwise(F.col("_person"))
    shown = _first_n(people, ["_first"], 2, F.struct(phrase.alias("phrase"), F.transform("_roles", lambda r: r["claim_no"]).alias("cited")), "_shown")
    counts = people.groupBy(KEY).agg(F.count(F.lit(1)).alias("_people")).join(rows.groupBy(KEY).agg(F.count_if(~F.col("_leading")).alias("_others")), KEY)
    more = F.col("_people") - F.size("_shown") + F.col("_others")
    tail = F.when(more > 0, F.concat(F.lit(", with "), more.cast("string"), F.lit(" more registered role holder"), F.when(more > 1, "s").otherwise(""))).otherwise(F.lit(""))
    return shown.join(counts, KEY).select(
        KEY, F.concat(F.lit("Led by "), F.array_join(F.transform("_shown", lambda s: s["phrase"]), " and "), tail, F.lit(".")).alias("leadership_text"),
        F.flatten(F.transform("_shown", lambda s: s["cited"])).alias("leadership_cited"),
    )


def workplaces(claims: DataFrame) -> DataFrame:
    """(org_number, workplaces_text, workplaces_cited): only for two sites or more, with the first towns."""
    rows = _available(claims).filter("field = 'workplace'").select(KEY, "claim_no", registry.town_of_workplace(F.col("value")).alias("town"))
    counts = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    cited = _first_n(rows, ["claim_no"], 3, F.col("claim_no"), "workplaces_cited")
    towns = _first_n(first_wins(rows.filter("town <> ''"), [KEY, "town"], ["claim_no"]), ["claim_no"], 3, F.col("town"), "_towns")
    joined = counts.join(cited, KEY).join(towns, KEY, "left")
    where = F.coalesce(F.concat(F.lit(", including "), F.array_join("_towns", ", ")), F.lit(""))
    return joined.select(KEY, F.concat(F.col("_n").cast("string"), F.lit(" registered sites"), where, F.lit(".")).alias("workplaces_text"), "workplaces_cited")


def latest_news(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """(org_number, news_text, news_no): the newest item of the company's own pages, never one dated after the run."""
    items = _available(claims).filter("field = 'dated_activity' AND (source_class IS NULL OR source_class <> 'official_registry')").filter(
        ~F.col("value").startswith("Registry record")
    ).join(runs.select(KEY, "run_day"), KEY)
    day = F.coalesce(F.nullif(F.left("effective_date", F.lit(10)), F.lit("")), dates.latest_in_text(F.col("value")))
    title = F.trim(F.regexp_replace(text.without_post_link(F.col("value")), r"(?U)\s*\([^()]*\d{4}[^()]*\)\s*$", ""))
    title = F.trim(text.squeeze(F.regexp_replace(title, r"\d{4}-\d{2}-\d{2}", " ")), F.lit(" -:"))
    short = F.when(F.length(title) > 90, F.concat(F.regexp_replace(F.left(title, F.lit(90)), " [^ ]*$", ""), F.lit(" ..."))).otherwise(title)
    dated = items.withColumn("_day", day).filter("_day IS NOT NULL AND _day <= run_day").withColumn("_order", -F.col("claim_no"))
    newest = dated.groupBy(KEY).agg(F.max_by(F.struct("_day", short.alias("title"), "claim_no"), F.struct("_day", "_order")).alias("_n"))
    return newest.select(KEY, F.concat(F.lit('latest news "'), "_n.title", F.lit('" ('), "_n._day", F.lit(")")).alias("news_text"), F.col("_n.claim_no").alias("news_no"))


def online(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """(org_number, online_text, online_cited): website, platforms, hiring and the newest news in one line."""
    rows = _available(claims)
    site = rows.filter("field = 'official_website'").groupBy(KEY).agg(
        F.min_by(urls.host(F.col("value")), "claim_no").alias("_host"), F.min("claim_no").alias("_site_no")
    )
    linked = rows.filter("field = 'company_profile'").withColumn("_label", social.platform_label(urls.host(F.col("value"))))
    labels = first_wins(linked.select(KEY, "_label", "claim_no"), [KEY, "_label"], ["claim_no"])
    platforms = _first_n(labels, ["claim_no"], 4, F.col("_label"), "_platforms").join(labels.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n_platforms")), KEY)
    profile_nos = _first_n(linked, ["claim_no"], 2, F.col("claim_no"), "_profile_nos")
    jobs = rows.filter("field = 'hiring_signal'").select(KEY, "claim_no", "value")
    is_role, is_page = F.col("value").startswith(fixed.ROLE_PREFIX), F.col("value").startswith(fixed.CAREERS_PREFIX)
    ranked = jobs.withColumn("_tier", F.when(is_role, 0).when(is_page, 2).otherwise(1))
    hiring = ranked.groupBy(KEY).agg(
        F.count_if(is_role).alias("_roles"), F.min_by("value", F.struct("_tier", "claim_no")).alias("_job"),
        F.min_by("claim_no", F.struct("_tier", "claim_no")).alias("_job_no"),
    )
    role_nos = _first_n(jobs.filter(is_role), ["claim_no"], 2, F.col("claim_no"), "_role_nos")
    frames = [site, platforms, profile_nos, hiring, role_nos, latest_news(claims, runs)]
    joined = reduce(lambda a, b: a.join(b, KEY, "full_outer"), frames)
    job = F.col("_job")
    title = F.regexp_replace(F.substr(job, F.lit(len(fixed.ROLE_PREFIX) + 3)), r"(?s)^(.*) - .*$", "$1")
    roles = F.concat(
        F.col("_roles").cast("string"), F.lit(" open role"), F.when(F.col("_roles") > 1, 's, e.g.').otherwise(":"), F.lit(' "'), title, F.lit('"')
    )
    other = F.when(job.startswith(fixed.CAREERS_PREFIX), "careers page").when(job.startswith(fixed.JOB_AD_PREFIX), "a job ad on its careers pages").otherwise(
        F.concat(F.lit("hiring: "), F.trim(F.regexp_replace(job, r"(?U)\s*\(published.*$| - NAV$", "")))
    )
    profile_text = F.concat(F.array_join("_platforms", ", "), F.lit(" profile"), F.when(F.col("_n_platforms") > 1, "s").otherwise(""))
    line = F.concat_ws(
        "; ", F.nullif("_host", F.lit("")), profile_text, F.when(F.col("_roles") > 0, roles).when(job.isNotNull(), other), F.col("news_text")
    )
    none = F.array().cast("array<bigint>")
    cited = F.concat(
        _cited("_site_no"), F.coalesce("_profile_nos", none), F.when(F.col("_roles") > 0, F.col("_role_nos")).otherwise(_cited("_job_no")), _cited("news_no")
    )
    return joined.filter(line != "").select(KEY, F.concat(F.lit("Online: "), line, F.lit(".")).alias("online_text"), cited.alias("online_cited"))


# --- what changed -------------------------------------------------------------------------

def role_changes(claims: DataFrame) -> DataFrame:
    """(org_number, group, day, claim_no): the newest change of the management and of the board."""
    rows = _available(claims).filter("field = 'leader' AND effective_date <> ''").select(
        KEY, "claim_no", registry.role_group(F.col("value")).alias("group"), F.left("effective_date", F.lit(10)).alias("day")
    ).filter("group IS NOT NULL")
    newest = rows.withColumn("_order", -F.col("claim_no")).groupBy(KEY, "group").agg(
        F.max_by(F.struct("day", "claim_no"), F.struct("day", "_order")).alias("_n")
    )
    return newest.select(KEY, "group", "_n.day", "_n.claim_no")


def renames(claims: DataFrame) -> DataFrame:
    pattern = r"(?s)^Renamed from '(.+)' on (\d{4}-\d{2}-\d{2})"
    rows = _available(claims).filter("field = 'dated_activity'").filter(F.col("value").rlike(pattern))
    return rows.select(KEY, "claim_no", F.regexp_extract("value", pattern, 1).alias("was"), F.regexp_extract("value", pattern, 2).alias("day"))


def recorded_changes(claims: DataFrame, runs: DataFrame) -> DataFrame:
    """(org_number, record_text, record_cited): dated changes the claims themselves hold. Role groups within
    three calendar years, the newest renaming within five, the newest registry update."""
    today = runs.select(KEY, F.year(F.col("run_day").try_cast("date")).alias("_year"))

    def within(years: int) -> Column:
        return F.left("day", F.lit(4)).try_cast("int") >= F.col("_year") - years

    groups = role_changes(claims).join(today, KEY).filter(within(3)).select(
        KEY, "claim_no", "day", F.lit(0).alias("_kind"), F.concat("group", F.lit(" changed "), "day").alias("phrase")
    )
    newest_rename = renames(claims).join(today, KEY).filter(within(5)).withColumn("_o", -F.col("claim_no"))
    renamed = newest_rename.groupBy(KEY).agg(F.max_by(F.struct("day", "was", "claim_no"), F.struct("day", "_o")).alias("_n")).select(
        KEY, "_n.claim_no", "_n.day", F.lit(1).alias("_kind"), F.concat(F.lit("renamed from '"), "_n.was", F.lit("' on "), "_n.day").alias("phrase")
    )
    pattern = r"^Registry record updated .* on (\d{4}-\d{2}-\d{2})"
    updates = _available(claims).filter("field = 'dated_activity'").filter(F.col("value").rlike(pattern)).select(
        KEY, "claim_no", F.regexp_extract("value", pattern, 1).alias("day"), (-F.col("claim_no")).alias("_o")
    )
    updated = updates.groupBy(KEY).agg(F.max_by(F.struct("day", "claim_no"), F.struct("day", "_o")).alias("_n")).select(
        KEY, "_n.claim_no", "_n.day", F.lit(2).alias("_kind"), F.concat(F.lit("registry record updated "), "_n.day").alias("phrase")
    )
    rows = groups.unionByName(renamed).unionByName(updated).withColumn("_late", -F.datediff(F.col("day").try_cast("date"), F.lit("1900-01-01").cast("date")))
    listed = rows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("_kind", "_late", "phrase", "claim_no"))).alias("_l"))
    return listed.select(
        KEY, F.array_join(F.transform("_l", lambda r: r["phrase"]), ", ").alias("record_text"), F.transform("_l", lambda r: r["claim_no"]).alias("record_cited")
    )


def change_sentence() -> Column:
    """First run, what changed since the previous run, or that nothing did."""
    previous = F.col("previous_day")
    on_record = F.col("record_text")
    first = F.when(
        on_record.isNotNull(), F.concat(F.lit("First run, so no earlier snapshot to compare with; latest changes on record: "), on_record, F.lit("."))
    ).otherwise("First run, so there is nothing earlier to compare with.")
    dated = F.coalesce(F.concat(F.lit(" on "), previous), F.lit(""))
    more = F.when(F.col("n_changes") > 3, F.concat(F.lit(" (+"), (F.col("n_changes") - 3).cast("string"), F.lit(" more)"))).otherwise(F.lit(""))
    changed = F.concat(F.lit("Since the previous run"), dated, F.lit(": "), F.array_join("said", "; "), more, F.lit("."))
    bracketed = F.coalesce(F.concat(F.lit(" ("), previous, F.lit(")")), F.lit(""))
    unchanged = F.concat(
        F.lit("No material change since the previous run"), bracketed,
        F.coalesce(F.concat(F.lit("; latest changes on record: "), on_record), F.lit("")), F.lit("."),
    )
    has_changes = F.coalesce(F.col("n_changes"), F.lit(0)) > 0
    body = F.when(F.col("is_first_run"), first).when(has_changes, changed).otherwise(unchanged)
    cited = F.when(F.col("is_first_run") | ~has_changes, F.col("record_cited"))
    return _sentence("what_changed", body, ["leader", "dated_activity"], cited)


def said_changes(changes: DataFrame) -> DataFrame:
    """(org_number, said, n_changes): up to three changes in words. Role holders and sites count once each,
    added and removed hiring signals once per kind."""
    per_field = F.when(F.col("field").isin("leader", "workplace"), F.lit("changed")).otherwise(F.col("kind"))
    rows = changes.select(KEY, "field", per_field.alias("_kind"), refresh.change_in_words(changes).alias("words"))
    one = rows.groupBy(KEY, "field", "_kind").agg(F.min("words").alias("words"))
    place = {f: i for i, f in enumerate([
        "legal_name", "official_website", "annual_accounts_latest", "leader", "workplace", "operating_status", "employee_count", "legal_form",
        "industry", "hiring_signal",
    ])}
    order = F.element_at(F.create_map(*[F.lit(x) for pair in place.items() for x in pair]), F.col("field"))
    placed = one.withColumn("_order", order)
    return _first_n(placed, ["_order", "_kind"], 3, F.col("words"), "said").join(placed.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_changes")), KEY)


# --- unknowns, confidence, headline -------------------------------------------------------

def presence(claims: DataFrame) -> DataFrame:
    """(org_number, has_profiles, has_leaders, has_hiring, has_metrics)."""
    metrics = [name for name, _ in fixed.METRICS] + ["annual_report_pdf"]

    def any_of(fields: list[str]) -> Column:
        return F.coalesce(F.max((F.col("field").isin(fields) & (F.col("state") == "available")).cast("int")), F.lit(0)) == 1

    return claims.groupBy(KEY).agg(
        any_of(["company_profile"]).alias("has_profiles"), any_of(["leader"]).alias("has_leaders"), any_of(["hiring_signal"]).alias("has_hiring"),
        any_of(metrics).alias("has_metrics"),
    )


def unknowns() -> Column:
    """Gaps as array<struct<item, reason>>, in order."""
    site = _value("official_website").isNotNull()
    ambiguous = F.coalesce(F.col("official_website.state") == "ambiguous", F.lit(False))

    def gap(condition: Column, item: str, reason: Column) -> Column:
        return F.when(condition, F.struct(F.lit(item).alias("item"), reason.alias("reason")))

    return F.filter(F.array(
        gap(~site & ~ambiguous, "official website", F.lit("none is registered with Brønnøysund or was found under the company's name")),
        gap(~F.col("has_profiles"), "company-owned social profiles", F.when(site, "the company's website links none").otherwise("no confirmed website to read them from")),
        gap(_value("annual_accounts_latest").isNull() & ~F.col("has_metrics"), "annual accounts", F.lit("none filed in the Register of Company Accounts")),
        gap(~F.col("has_leaders"), "leadership", F.lit("no roles registered in Brønnøysund")),
        gap(~F.col("has_hiring"), "hiring signals", F.when(site, "no job ad on the company's website or on NAV's job board").otherwise(
            "no job ad on NAV's job board, and no confirmed website to read")),
    ), lambda g: g.isNotNull())


def cannot_tell() -> Column:
    reason = F.col("official_website.reason")
    return F.when(
        F.col("official_website.state") == "ambiguous",
        F.concat(F.lit("official website ("), F.when(reason != "", text.lower_first(reason)).otherwise("the company match is uncertain"), F.lit(")")),
    )


def confidence() -> Column:
    """struct(level, why): how sure it is that what is published belongs to this company."""
    site = F.col("official_website")
    digits = F.regexp_replace(F.coalesce(site["evidence_span"], F.lit("")), r"\D", "")

    def rated(level: str, why: str) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(why).alias("why"))

    return (
        F.when(site["state"] == "ambiguous", rated("low", "can't tell which website is the company's; only registry facts are published"))
        .when(_value("official_website").isNull(), rated("high", "every fact is from Brønnøysund's registers (no website found)"))
        .when(F.contains(digits, F.col(KEY)), rated("high", "the website states the company's organisation number"))
        .when(site["source_class"] == "official_registry", rated(
            "medium", "the registered website's address spells the company's name; the site does not state its number"))
        .otherwise(rated("medium", "the website names the company but does not state its organisation number"))
    )


def headline() -> Column:
    """Who, what state, and the headline figure."""
    name = F.coalesce(_value("legal_name"), F.concat(F.lit("Org. "), F.col(KEY)))
    status = F.coalesce(F.concat(F.lit(": "), F.lower(_value("operating_status"))), F.lit(""))
    latest, pct = F.col("newest_revenue"), F.col("revenue_change")
    direction = F.when(pct > accounts.FLAT_PERCENT, "up").when(pct < -accounts.FLAT_PERCENT, "down").otherwise("flat")
    moved = F.when(F.abs(pct) <= accounts.MAX_PERCENT, F.concat(
        F.lit(", "), direction, F.when(F.abs(pct) <= accounts.FLAT_PERCENT, "").otherwise(F.concat(F.lit(" "), F.replace(F.format_number(F.abs(pct), 0), F.lit(","), F.lit("")), F.lit("%")))))
    figure = F.concat(
        F.lit(", revenue "), money.short_number(latest["amount"], latest["currency"]), F.lit(" ("), latest["reporting_period"], F.coalesce(moved, F.lit("")), F.lit(")")
    )
    return F.concat(name, status, F.coalesce(figure, F.lit("")))


# --- signals ------------------------------------------------------------------------------

def signals(claims: DataFrame, runs: DataFrame, wide: DataFrame) -> DataFrame:
    """(org_number, signal_ord, text, fields, cited): at most six flags a reader acts on. `wide` is the
    joined scalar and metric frame."""
    today = F.col("run_day").try_cast("date")

    def within(day: Column, days: int) -> Column:
        return F.datediff(today, F.left(day, F.lit(10)).try_cast("date")).between(0, days)

    pct = F.col("revenue_change")
    status = _value("operating_status")
    r, n, e = F.col("newest_revenue"), F.col("annual_result"), F.col("total_equity")
    period = F.greatest(n["reporting_period"], e["reporting_period"])
    unsigned = F.ltrim(money.short_number(n["amount"], n["currency"]), F.lit("-"))
    founded = _value("founded_date")

    def flag(order: int, condition: Column, body: Column, field: str, cited: Column) -> Column:
        return F.when(condition, F.struct(F.lit(order).alias("_order"), body.alias("text"), F.array(F.lit(field)).alias("fields"), cited.cast("array<bigint>").alias("cited")))

    flagged = wide.join(runs.select(KEY, "run_day"), KEY).select(KEY, F.explode(F.filter(F.array(
        flag(0, F.lower(status) != "active", F.concat(F.lit("Registry status: "), status, F.lit(".")), "operating_status", _cited(F.col("operating_status.claim_no"))),
        flag(1, F.abs(pct).between(25, accounts.MAX_PERCENT), F.concat(
            F.lit("Revenue "), F.when(pct > 0, "up").otherwise("down"), F.lit(" "), F.replace(F.format_number(F.abs(pct), 0), F.lit(","), F.lit("")),
            F.lit("% in "), r["reporting_period"], F.lit(".")), "revenue", _cited(r["claim_no"], F.col("revenue_change_base"))),
        flag(2, (n["amount"] < 0) & (n["reporting_period"] == F.coalesce(period, n["reporting_period"])), F.concat(
            F.lit("Net loss in "), n["reporting_period"], F.lit(" ("), unsigned, F.lit(").")), "annual_result", _cited(n["claim_no"])),
        flag(3, (e["amount"] < 0) & (e["reporting_period"] == F.coalesce(period, e["reporting_period"])), F.concat(
            F.lit("Negative equity in "), e["reporting_period"], F.lit(" ("), money.short_number(e["amount"], e["currency"]), F.lit(").")),
            "total_equity", _cited(e["claim_no"])),
        flag(7, within(founded, 730), F.concat(F.lit("Young company: founded "), F.left(founded, F.lit(10)), F.lit(".")), "founded_date", _cited(F.col("founded_date.claim_no"))),
    ), lambda f: f.isNotNull())).alias("_f")).select(KEY, "_f.*")
    days = runs.select(KEY, "run_day")
    roles = role_changes(claims).join(days, KEY).filter(within(F.col("day"), 365)).select(
        KEY, F.when(F.col("group") == "board", 4).otherwise(5).alias("_order"), F.concat(text.upper_first(F.col("group")), F.lit(" changed on "), "day", F.lit(".")).alias("text"),
        F.array(F.lit("leader")).alias("fields"), F.array("claim_no").cast("array<bigint>").alias("cited"),
    )
    renamed = first_wins(renames(claims).join(days, KEY).filter(within(F.col("day"), 365)), [KEY], ["claim_no"]).select(
        KEY, F.lit(6).alias("_order"), F.concat(F.lit("Renamed on "), "day", F.lit(" (was "), "was", F.lit(").")).alias("text"),
        F.array(F.lit("dated_activity")).alias("fields"), F.array("claim_no").cast("array<bigint>").alias("cited"),
    )
    open_ads = _available(claims).filter("field = 'hiring_signal'").filter(~F.col("value").startswith(fixed.CAREERS_PREFIX))
    hiring = open_ads.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n")).join(_first_n(open_ads, ["claim_no"], 2, F.col("claim_no"), "cited"), KEY).select(
        KEY, F.lit(8).alias("_order"), F.concat(F.lit("Hiring now: "), F.col("_n").cast("string"), F.lit(" open job ad"), F.when(F.col("_n") > 1, "s").otherwise(""), F.lit(".")).alias("text"),
        F.array(F.lit("hiring_signal")).alias("fields"), F.col("cited").cast("array<bigint>").alias("cited"),
    )
    rows = flagged.unionByName(roles).unionByName(renamed).unionByName(hiring)
    return top_k(rows, [KEY], ["_order"], fixed.TOP_K["signals"], "signal_ord").drop("_order")


# --- the whole summary --------------------------------------------------------------------

def wide_frame(claims: DataFrame) -> DataFrame:
    """One row per entity with the scalar fields and the metric pairs."""
    return scalar_fields(claims).join(metric_pairs(claims), KEY, "left")


def build(claims: DataFrame, runs: DataFrame, changes: DataFrame, written: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sentences, signals, overview).

    `runs` is (org_number, run_day, is_first_run, previous_day); `changes` the typed changes. Sentences are
    (org_number, sentence_ord, part, text, fields, cited); overview holds headline, confidence, unknowns and
    cant_tell per entity. For a caller that reads all three, what they share is `written` once."""
    wide = wide_frame(claims)
    frames = [presence(claims), leadership(claims), workplaces(claims), online(claims, runs), recorded_changes(claims, runs), said_changes(changes)]
    full = reduce(lambda a, b: a.join(b, KEY, "left"), frames, wide.join(runs, KEY))
    if written:
        full = materialise(full, "summary-values")
        wide = full.select(*wide.columns)
    sentences = F.array(
        _sentence("what_it_does", identity_text(), ["legal_name", "legal_form", "industry", "founded_date", "operating_status", "employee_count"], _cited(
            *[F.col(f"{f}.claim_no") for f in ("legal_name", "legal_form", "industry", "founded_date", "operating_status", "employee_count")])),
        _sentence("what_it_does", activity_text(), ["site_description", "business_description"], _cited(
            F.when(_value("site_description").isNotNull(), F.col("site_description.claim_no")).otherwise(F.col("business_description.claim_no")))),
        accounts_sentence(), _sentence("people_and_presence", F.col("leadership_text"), ["leader"], F.col("leadership_cited")),
        _sentence("people_and_presence", F.col("workplaces_text"), ["workplace"], F.col("workplaces_cited")),
        _sentence("people_and_presence", F.col("online_text"), ["official_website", "company_profile", "hiring_signal", "dated_activity"], F.col("online_cited")),
        change_sentence(),
        _sentence("unknown", F.concat(F.lit("Can't tell: "), cannot_tell(), F.lit(".")), [], F.array().cast("array<bigint>")),
        _sentence("unknown", F.when(F.size(unknowns()) > 0, F.concat(
            F.lit("Not found: "), F.array_join(F.transform(unknowns(), lambda u: u["item"]), ", "), F.lit("."))), [], F.array().cast("array<bigint>")),
    )
    rows = full.select(KEY, "run_day", F.posexplode(F.filter(sentences, lambda s: s["text"].isNotNull())).alias("sentence_ord", "_s"))
    prefix = F.when(F.col("sentence_ord") == 0, F.concat(F.lit("As of "), "run_day", F.lit(": "))).otherwise(F.lit(""))
    out = rows.select(KEY, "sentence_ord", "_s.part", F.concat(prefix, "_s.text").alias("text"), "_s.fields", "_s.cited")
    overview = full.select(
        KEY, F.col("run_day").alias("as_of"), headline().alias("headline"), confidence().alias("confidence"), unknowns().alias("unknowns"), cannot_tell().alias("cant_tell")
    )
    return out, signals(claims, runs, wide), overview


# --- questions and answers ----------------------------------------------------------------

def answers(claims: DataFrame, runs: DataFrame, change_texts: DataFrame, per_part: int = 500, count: int | None = None) -> DataFrame:
    """(org_number, question_ord, part, question, answer, state): eleven fixed questions. List answers are
    joined in claim order; one longer than `per_part` items continues in further parts. `change_texts` is
    (org_number, text). With the `count` of the claims, tasks grow in number and not in size."""
    rows = _available(claims).filter("field IN ('leader', 'workplace', 'hiring_signal', 'dated_activity')").select(KEY, "field", "claim_no", "value")
    firsts = rows.groupBy(KEY, "field").agg(F.min("claim_no").alias("_first"), F.min_by("value", "claim_no").alias("first_value"), salts_of(rows).alias("_salts"))
    parted = salted_join(rows, firsts.select(KEY, "field", "_first", "_salts"), [KEY, "field"], "inner", used="_salts").withColumn(
        "part", F.floor((F.col("claim_no") - F.col("_first")) / per_part).cast("int")
    )

    def joined(field: str, separator: str) -> DataFrame:
        grouped = parted.filter(F.col("field") == field).groupBy(KEY, "part").agg(F.array_sort(F.collect_list(F.struct("claim_no", "value"))).alias("_v"))
        return grouped.select(KEY, "part", F.array_join(F.transform("_v", lambda v: v["value"]), separator).alias("answer"))

    def first_of(field: str) -> DataFrame:
        return firsts.filter(F.col("field") == field).select(KEY, F.lit(0).alias("part"), F.col("first_value").alias("answer"))

    def changed() -> DataFrame:
        return change_texts.withColumn("part", F.lit(0)).groupBy(KEY, "part").agg(F.array_join(F.array_sort(F.collect_set("text")), "; ").alias("answer"))

    wide = scalar_fields(claims, tasks_of(count)).join(
        first_wins(_available(claims).filter("field = 'public_brand'").select(KEY, "claim_no", F.col("value").alias("brand")), [KEY], ["claim_no"]), KEY, "left"
    )
    name, brand, period = _value("legal_name"), F.col("brand"), F.col("annual_accounts_latest.reporting_period")
    named = F.when(brand.isNull() | (brand == name), name).otherwise(F.concat(name, F.lit(" (publicly known as "), brand, F.lit(")")))
    does = F.nullif(F.concat_ws(
        "; ", F.concat(F.lit("Registered industry: "), _value("industry")), F.concat(_value("employee_count"), F.lit(" registered employees"))), F.lit(""))
    status = F.concat(_value("operating_status"), F.coalesce(F.concat(F.lit(" ("), _value("legal_form"), F.lit(")")), F.lit("")))
    filed = F.concat(_value("annual_accounts_latest"), F.coalesce(F.concat(F.lit(" ("), period, F.lit(")")), F.lit("")))

    def scalar(value: Column) -> DataFrame:
        return wide.select(KEY, F.lit(0).alias("part"), value.alias("answer")).filter("answer IS NOT NULL")

    hiring = first_of("hiring_signal").withColumn("answer", F.concat(F.lit("Yes, hiring signals found: "), "answer"))
    asked = [
        ("What is the company's legal name and brand?", scalar(named), "Legal name not available."),
        ("What does the company do, and how big is it?", scalar(does), "No registered industry or employee count available."),
        ("Is the company still operating?", scalar(status), "No registered operating status available."),
        ("When was the company founded?", scalar(F.concat(F.lit("Founded "), _value("founded_date"))), "No founding date available."),
        ("What is the official website?", scalar(_value("official_website")), "No official website on file."),
        ("Who leads the company?", joined("leader", "; "), "No leadership information available."),
        ("Is the company currently hiring?", hiring, "No hiring signals found."),
        ("What are the latest filed annual accounts?", scalar(filed), "Not available."),
        ("Where are the registered workplaces?", joined("workplace", ", "), "No registered workplaces available."),
        ("What is the most recent public activity?", first_of("dated_activity"), "No dated public activity found."),
        ("What has changed since the last run?", changed(), "No material changes since the last run."),
    ]
    found = reduce(lambda a, b: a.unionByName(b), [df.withColumn("question_ord", F.lit(i)) for i, (_, df, _) in enumerate(asked)])
    questions = F.array(*[F.struct(F.lit(q).alias("question"), F.lit(d).alias("empty")) for q, _, d in asked])
    frame = runs.select(KEY, "is_first_run", F.posexplode(questions).alias("question_ord", "_q"))
    dealt = frame if count is None else frame.repartition(tasks_of(count), KEY, "question_ord")
    out = dealt.join(found, [KEY, "question_ord"], "left")
    first_run = F.col("is_first_run") & (F.col("question_ord") == 10)
    last = F.col("question_ord") == 10
    state = F.when(first_run, "not_applicable").when(F.col("answer").isNotNull() | last, "available").otherwise("not_available")
    answer = F.when(first_run, "This is the first run -- no prior snapshot to compare.").otherwise(F.coalesce("answer", "_q.empty"))
    return out.select(KEY, "question_ord", F.coalesce("part", F.lit(0)).alias("part"), F.col("_q.question").alias("question"), answer.alias("answer"), state.alias("state"))
