"""Confirmed facts from stored registry responses (entity record, roles, accounts, sub-units, updates).

Responses are one table (org_number, kind, page_no, url, status, body, retrieved_at); a status of NULL is
a request that got no answer. Each fact quotes the response exactly as it is written."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import dates, fixed, money, names, registry, text
from factloom.functions.let import let
from factloom.operators.ordered import first_wins, latest, top_k
from factloom.operators.pages import content_hash
from factloom.operators.staging import computed

RESPONSE_KEY = ["org_number", "url", "retrieved_at", "content_hash", "body"]


def response_state(status: Column, items: Column | None = None) -> Column:
    """200 with content is available, 404 or an empty list a confirmed absence, anything else a failure."""
    found = F.lit("available") if items is None else F.when(items > 0, "available").otherwise("not_available")
    return F.when(status == 404, "not_available").when((status == 200) & (F.lit(True) if items is None else items.isNotNull()), found).otherwise("failed")


def _facts(df: DataFrame, stage: int, **given: Column) -> DataFrame:
    return schemas.conform(
        df, schemas.CONFIRMED_FACT,
        **{
            "stage_ord": F.lit(stage), "match_confidence": F.lit(100.0), "extraction_method": F.lit("registry"),
            "source_class": F.lit("official_registry"), **({"source_url": F.col("url")} if "url" in df.columns else {}), **given,
        },
    )


def _answered(responses: DataFrame, kind: str) -> DataFrame:
    return responses.filter((F.col("kind") == kind) & (F.col("status") == 200)).withColumn("content_hash", content_hash(F.col("body")))


# --- entity record ------------------------------------------------------------------------

def resolve(responses: DataFrame) -> DataFrame:
    """One row per entity, from its newest response: name, address, website and the state of its identity.
    Two current names make it ambiguous; a record that was not read gives no values."""
    record = F.from_json("body", schemas.ENTITY_RECORD)
    newest = latest(responses.filter("kind = 'entity'"), ["org_number"], ["retrieved_at", "url", "status", "body"])
    read = newest.withColumn("r", F.when(F.col("status") == 200, record))
    current = F.size(F.filter(F.coalesce("r.historiskeNavn", F.array()), lambda n: n["tilDato"].isNull()))
    state = (
        F.when(F.col("status") == 404, "not_available").when((F.col("status") == 200) & F.col("r").isNotNull(),
        F.when(current > 1, "ambiguous").otherwise("available")).otherwise("failed")
    )
    known = state == "available"
    return read.select(
        "org_number", F.when(known, F.col("r.navn")).alias("legal_name"),
        F.when(known, registry.address_line(F.col("r.forretningsadresse"))).alias("registered_address"),
        F.when(known, registry.site_with_scheme(F.col("r.hjemmeside"))).alias("official_site"),
        state.alias("resolution_state"), F.col("url").alias("source"), "retrieved_at",
        F.when(known, content_hash(F.col("body"))).alias("content_hash"), F.when(known, F.col("body")).alias("raw_record"),
    )


def canonical_hash(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of a record as JSON with its keys in alphabetical order; equal records hash alike."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def resolve_from_universe(universe: DataFrame, source: str, now: Column) -> DataFrame:
    """The same row from the company list: no request, municipality in place of an address."""
    columns = universe.columns
    return universe.select(
        F.col("organisation_number").alias("org_number"), F.col("name").alias("legal_name"),
        F.col("municipality").alias("registered_address"), registry.site_with_scheme(F.col("website")).alias("official_site"),
        F.lit("available").alias("resolution_state"), F.lit(source).alias("source"), now.alias("retrieved_at"),
        canonical_hash(universe, columns).alias("content_hash"), F.lit(None).cast("string").alias("raw_record"),
    )


def universe_facts(universe: DataFrame, source: str, now: Column) -> DataFrame:
    """Industry, head count, legal form and status of the company list; a missing field gives no row."""
    status = registry.operating_status(F.col("bankrupt"), F.col("liquidating"), F.lit(True))
    pairs = F.array(
        _pair("industry", registry.industry_code_text(F.col("industry_code"), F.col("industry_label"))),
        _pair("employee_count", F.col("employees").cast("string")), _pair("legal_form", registry.blank_to_null(F.col("legal_form"))),
        _pair("operating_status", status),
    )
    rows = universe.select(
        F.col("organisation_number").alias("org_number"), canonical_hash(universe, universe.columns).alias("content_hash"),
        F.posexplode(pairs).alias("item_ord", "_f"),
    ).select("*", "_f.*").filter("value IS NOT NULL")
    return _facts(rows, 30, source_url=F.lit(source), retrieved_at=now)


def _pair(field: str, value: Column, span: Column | None = None, day: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(field).alias("field"), value.cast("string").alias("value"), (none if span is None else span).alias("evidence_span"),
        (none if day is None else day).alias("effective_date"),
    )


def live_facts(responses: DataFrame) -> DataFrame:
    """Facts of the live entity record: name, website, description, founding, industry, head count, legal
    form and status, each with its quote. Status needs at least one flag on the record."""
    body = F.col("body")
    rec = _answered(responses, "entity").withColumn("r", F.from_json(body, schemas.ENTITY_RECORD)).filter("r IS NOT NULL")
    r = {c: F.col(f"r.{c}") for c in (
        "navn", "hjemmeside", "stiftelsesdato", "naeringskode1", "antallAnsatte", "organisasjonsform", "konkurs", "underAvvikling",
        "underTvangsavviklingEllerTvangsopplosning", "aktivitet", "vedtektsfestetFormaal",
        "registreringsdatoAntallAnsatteEnhetsregisteret",
    )}
    forced = r["underTvangsavviklingEllerTvangsopplosning"]
    flagged = r["konkurs"].isNotNull() | r["underAvvikling"].isNotNull() | forced.isNotNull()
    deciding = (
        F.when(F.coalesce(r["konkurs"], F.lit(False)), "konkurs").when(F.coalesce(r["underAvvikling"], F.lit(False)), "underAvvikling")
        .when(F.coalesce(forced, F.lit(False)), "underTvangsavviklingEllerTvangsopplosning").otherwise("konkurs")
    )
    liquidating = F.coalesce(r["underAvvikling"], F.lit(False)) | F.coalesce(forced, F.lit(False))
    founded = F.nullif(F.left(F.trim(r["stiftelsesdato"]), F.lit(10)), F.lit(""))
    founded_span = registry.quote_string(body, "stiftelsesdato", r["stiftelsesdato"])
    activity = registry.registered_description(r["aktivitet"], F.lit(None).cast("array<string>"))
    counted = F.when(
        F.trim(r["registreringsdatoAntallAnsatteEnhetsregisteret"]).rlike(r"^\d{4}-\d{2}-\d{2}$"),
        F.trim(r["registreringsdatoAntallAnsatteEnhetsregisteret"]),
    )
    facts = F.array(
        _pair("official_site_registry", registry.registered_website(r["hjemmeside"]), registry.quote_string(body, "hjemmeside", F.trim(r["hjemmeside"]))),
        _pair("founded_date", founded, founded_span, founded),
        _pair("dated_activity", F.concat(F.lit("Founded on "), founded, F.lit(f" - {fixed.REGISTER_NAME}")), founded_span, founded),
        _pair(
            "industry", registry.industry_code_text(r["naeringskode1"]["kode"], r["naeringskode1"]["beskrivelse"]),
            registry.quote_object(body, "naeringskode1"),
        ),
        _pair("employee_count", r["antallAnsatte"].cast("string"), registry.quote_any_number(body, "antallAnsatte"), counted),
        _pair(
            "legal_form", registry.blank_to_null(r["organisasjonsform"]["kode"]),
            registry.quote_string(body, "kode", F.trim(r["organisasjonsform"]["kode"])),
        ),
        _pair("operating_status", registry.operating_status(r["konkurs"], liquidating, flagged), registry.quote_flag(body, deciding)),
        _pair("legal_name_registry", F.nullif(F.trim(r["navn"]), F.lit("")), registry.quote_string(body, "navn", r["navn"])),
        _pair(
            "business_description", registry.registered_description(r["aktivitet"], r["vedtektsfestetFormaal"]),
            F.when(activity.isNotNull(), registry.quote_array(body, "aktivitet")).otherwise(registry.quote_array(body, "vedtektsfestetFormaal")),
        ),
    )
    # The array is a column of its own below the generator, which interprets what stands inside it; an outer one, as Catalyst puts a
    # filter on the array's presence, with a copy of it, below any other.
    listed = rec.select("org_number", "url", "retrieved_at", "content_hash", facts.alias("_facts"))
    rows = listed.select("org_number", "url", "retrieved_at", "content_hash", F.posexplode_outer("_facts").alias("item_ord", "_f")).select("*", "_f.*")
    return _facts(rows.filter("value IS NOT NULL"), 20)


def former_names(responses: DataFrame, limit: int = fixed.TOP_K["former_names"]) -> DataFrame:
    """Up to three former names, newest first, the current name left out: (org_number, rank, name, until, ...)."""
    rec = _answered(responses, "entity").withColumn("r", F.from_json("body", schemas.ENTITY_RECORD)).filter("r IS NOT NULL")
    rows = rec.select(*RESPONSE_KEY, F.col("r.navn").alias("_current"), F.posexplode("r.historiskeNavn").alias("pos", "_h"))
    renamed = rows.filter(F.trim("_h.navn") != "").filter(
        F.upper(F.trim("_h.navn")) != F.upper(F.trim(F.coalesce("_current", F.lit(""))))
    ).select(
        *RESPONSE_KEY, "pos", F.trim("_h.navn").alias("name"), F.col("_h.navn").alias("raw_name"),
        F.nullif(F.substring_index(F.substring_index(F.coalesce("_h.tilDato", F.lit("")), " ", 1), "T", 1), F.lit("")).alias("until"),
        F.coalesce("_h.tilDato", F.lit("")).alias("_until"),
    )
    return top_k(renamed, ["org_number"], [F.col("_until").desc(), "pos"], limit, "rank").drop("_until")


def rename_facts(responses: DataFrame) -> DataFrame:
    names_before = former_names(responses).filter("until IS NOT NULL")
    body, raw = F.col("body"), F.col("raw_name")
    with_date = F.concat(F.lit(r'"navn"\s*:\s*"\Q'), raw, F.lit(r'\E"\s*,\s*"tilDato"\s*:\s*"[^"]*"'))
    span = F.coalesce(F.nullif(F.regexp_substr(body, with_date), F.lit("")), registry.quote_string(body, "navn", raw))
    return _facts(
        names_before, 21, field=F.lit("dated_activity"), item_ord=F.col("rank"), evidence_span=span,
        value=F.concat(F.lit("Renamed from '"), "name", F.lit("' on "), "until", F.lit(f" - {fixed.REGISTER_NAME}")),
        effective_date=F.when(F.col("until").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("until")),
    )


def site_hints(responses: DataFrame) -> DataFrame:
    """What the record says about reaching the company: e-mail, phones, street, postcode, town."""
    rec = _answered(responses, "entity").withColumn("r", F.from_json("body", schemas.ENTITY_RECORD)).filter("r IS NOT NULL")
    address = F.coalesce("r.forretningsadresse", "r.postadresse")
    phones = F.transform(F.array("r.telefon", "r.mobil"), lambda p: F.regexp_replace(p, r"\D", ""))
    return rec.select(
        "org_number", F.when(F.col("r.epostadresse").contains("@"), F.lower(F.trim("r.epostadresse"))).alias("email"),
        F.transform(F.filter(phones, lambda p: F.length(p) >= 8), lambda p: F.right(p, F.lit(8))).alias("phones"),
        registry.blank_to_null(F.get(address["adresse"], F.lit(0))).alias("street"),
        F.when(F.trim(address["postnummer"]).rlike(r"^\d{4}$"), F.trim(address["postnummer"])).alias("postcode"),
        registry.blank_to_null(address["poststed"]).alias("town"), registry.blank_to_null(address["kommune"]).alias("municipality"),
        registry.quote_object(F.col("body"), "forretningsadresse").alias("address_span"), F.col("url").alias("record_url"),
    )


# --- roles --------------------------------------------------------------------------------

def role_rows(responses: DataFrame) -> DataFrame:
    """Sitting role holders: not deregistered, not resigned, not dead, not deleted. Birth dates are not in
    the schema the response is read with."""
    read = _answered(responses, "roles").withColumn("r", F.from_json("body", schemas.ROLES_RECORD))
    groups = read.select(*RESPONSE_KEY, F.posexplode("r.rollegrupper").alias("group_ord", "_g"))
    roles = groups.select(
        *RESPONSE_KEY, "group_ord", F.col("_g.type.kode").alias("group_code"), F.col("_g.sistEndret").alias("changed"),
        F.posexplode("_g.roller").alias("role_ord", "_r"),
    )
    gone = [F.coalesce(F.col(f"_r.{f}"), F.lit(False)) for f in ("avregistrert", "fratraadt", "person.erDoed", "enhet.erSlettet")]
    sitting = roles.filter(~reduce(lambda a, b: a | b, gone))
    person = registry.person_name(F.col("_r.person.navn.fornavn"), F.col("_r.person.navn.mellomnavn"), F.col("_r.person.navn.etternavn"))
    organisation = F.get(F.col("_r.enhet.navn"), F.lit(0))
    return sitting.select(
        *RESPONSE_KEY, "group_ord", "role_ord", "group_code",
        F.when(F.col("_r.person").isNotNull(), person).otherwise(organisation).alias("holder"),
        F.col("_r.type.beskrivelse").alias("title"),
        F.when(F.col("_r.person").isNull(), F.col("_r.enhet.organisasjonsnummer")).alias("holder_number"),
        F.when(F.col("changed").rlike(r"^\d{4}-\d{2}-\d{2}"), F.left("changed", F.lit(10))).alias("changed_on"),
        F.col("_r.person.navn.fornavn").alias("first"), F.col("_r.person.navn.etternavn").alias("last"),
    ).filter("holder IS NOT NULL AND holder <> ''")


def role_facts(responses: DataFrame) -> DataFrame:
    rows = role_rows(responses)
    body = F.col("body")
    organisation = F.concat(F.lit(r'"navn"\s*:\s*\[\s*"\Q'), F.col("holder"), F.lit(r'\E"'))
    span = F.when(F.col("first").isNotNull() & F.col("last").isNotNull(), registry.quote_person(body, F.col("first"), F.col("last"))).when(
        F.col("holder_number").isNotNull(), F.nullif(F.regexp_substr(body, organisation), F.lit(""))
    )
    return _facts(
        rows, 10, field=F.lit("leader"), item_ord=F.col("group_ord") * 10_000 + F.col("role_ord"), evidence_span=span,
        value=registry.role_value(F.col("holder"), F.col("title"), F.col("holder_number")), effective_date=F.col("changed_on"),
    )


# --- annual accounts ----------------------------------------------------------------------

def filing_docs(responses: DataFrame, kind: str = "accounts") -> DataFrame:
    """One row per filing of the accounts list (or of responses of another kind), the filing unread as `doc`. The list is a column of its
    own below the generator, an outer one, as in `live_facts`: the body is parsed once. A place without a filing has no period."""
    read = _answered(responses, kind).withColumn("_list", F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>"))
    rows = read.select(*RESPONSE_KEY, F.posexplode_outer("_list").alias("pos", "doc"))

    def string(path: str) -> Column:
        return F.try_variant_get(F.col("doc"), path, "string")

    return rows.select(
        *RESPONSE_KEY, "pos", string("$.regnskapsperiode.tilDato").alias("period_end"),
        F.coalesce(string("$.regnskapstype"), F.lit("SELSKAP")).alias("kind"), F.coalesce(string("$.valuta"), F.lit("")).alias("currency"),
        string("$.journalnr").alias("journal"), "doc",
    ).filter("period_end <> ''")


def with_figures(docs: DataFrame) -> DataFrame:
    """Filings with their figures and their own text in place of `doc`. The text is the filing re-serialised by Spark (canonical JSON),
    since the list is stored as one body."""
    figures = {name: registry.number_at(F.col("doc"), path) for name, path in fixed.METRICS}
    return docs.withColumns({**figures, "filing_text": F.to_json("doc")}).drop("doc")


def filings(responses: DataFrame, kind: str = "accounts") -> DataFrame:
    """One row per filing of the accounts list (or of responses of another kind), with its figures and its own text."""
    return with_figures(filing_docs(responses, kind))


def picked_filings(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """One company filing per period, group accounts never, with its rank from the newest. The body of the whole list stays
    behind: a filing has its own text. They are picked and ranked in one pass: with one per period, few of an entity are left to meet.
    `tasks` deals the entities over so many tasks, else it is the session's number."""
    picked = first_wins(rows.drop("body").filter("kind <> 'KONSERN'"), ["org_number", "period_end"], ["pos"])
    own = picked if tasks is None else picked.repartition(tasks, "org_number")
    place = F.row_number().over(W.partitionBy("org_number").orderBy(F.col("period_end").desc()))
    newest = F.col("org_number").isNotNull() & (F.col("_place") <= fixed.TOP_K["filings_with_figures"])
    return own.withColumn("_place", place).withColumn("rank", F.when(newest, F.col("_place"))).drop("_place")


def company_filings(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """`picked_filings` with their figures. Of `filing_docs`, only the filings that are picked are read."""
    picked = picked_filings(rows, tasks)
    return with_figures(picked) if "doc" in rows.columns else picked


def preferred_filings(rows: DataFrame, keys: list[str], period: str, is_group: Column, order: list, newest: int) -> DataFrame:
    """One filing per (key, period), the company's own before the group's, for the newest periods."""
    one = first_wins(rows.withColumn("_group", is_group.cast("int")), [*keys, period], ["_group", *order]).drop("_group")
    return top_k(one, keys, [F.col(period).desc()], newest, "rank")


def cited_to_own_response(list_filings: DataFrame, year_filings: DataFrame) -> DataFrame:
    """Each newest filing cited to its own single-year response when exactly one filing there has its
    period, else to the list."""
    matched = year_filings.filter("kind <> 'KONSERN'").groupBy("org_number", "period_end").agg(
        F.count(F.lit(1)).alias("_n"), F.any_value("url").alias("_url"), F.any_value("content_hash").alias("_hash"),
        F.any_value("filing_text").alias("_text"),
        *[F.any_value(name).alias(f"_{name}") for name, _ in fixed.METRICS],
    ).filter("_n = 1")
    joined = list_filings.join(matched, ["org_number", "period_end"], "left")
    own = F.col("_n").isNotNull() & F.col("rank").isNotNull()
    out = joined.withColumns({
        "url": F.when(own, F.col("_url")).otherwise(F.col("url")), "content_hash": F.when(own, F.col("_hash")).otherwise(F.col("content_hash")),
        "filing_text": F.when(own, F.col("_text")).otherwise(F.col("filing_text")),
        **{name: F.when(own, F.col(f"_{name}")).otherwise(F.col(name)) for name, _ in fixed.METRICS},
    })
    return out.select(*list_filings.columns)


def figure_rows(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide figures to (keys..., metric, amount); a figure the filing does not state gives no row."""
    return rows.unpivot(keys, metrics, "metric", "amount").filter("amount IS NOT NULL")


def accounts_facts(company: DataFrame) -> DataFrame:
    """Figures and report link of the two newest filings, and the summary line of every filing: the newest
    as `annual_accounts_latest`, earlier ones as history. What a filing has is listed first, in one pass; texts and quotes are made of
    what is listed."""
    leaf = [path.rsplit(".", 1)[1] for _, path in fixed.METRICS]
    report, line = len(leaf), len(leaf) + 1
    ranked, rank, n, filed = F.col("rank").isNotNull(), F.col("rank"), F.col("_n"), F.col("filing_text")

    def listed(place: int, field: Column, there: Column, amount: Column) -> Column:
        return F.when(there, F.struct(F.lit(place).alias("_n"), field.alias("field"), amount.cast("double").alias("_amount")))

    facts = [listed(i, F.lit(name), ranked & F.col(name).isNotNull(), F.col(name)) for i, (name, _) in enumerate(fixed.METRICS)]
    facts.append(listed(report, F.lit("annual_report_pdf"), ranked & (F.col("journal") != ""), F.lit(None)))
    facts.append(listed(
        line, F.when(rank == 1, "annual_accounts_latest").otherwise("annual_accounts_history"), F.col("revenue").isNotNull() | F.col("annual_result").isNotNull(), F.lit(None)))
    rows = company.withColumn("_facts", F.array(*facts)).withColumn("_f", F.explode_outer("_facts")).filter("_f IS NOT NULL").select("*", "_f.*")
    value = (
        F.when(n < report, money.amount_text(F.col("_amount"), F.col("currency")))
        .when(n == report, F.concat(F.lit(fixed.REPORT_COPY_URL), "org_number", F.lit("/"), F.left("period_end", F.lit(4))))
        .otherwise(money.accounts_line(F.col("revenue"), F.col("annual_result"), F.col("currency")))
    )
    # A branch is not shared with what stands around it: the quote is found in one column and judged in the next, not searched for twice.
    found = F.when(n == line, registry.number_found(filed, "sumDriftsinntekter", F.col("revenue"))).when(n == report, registry.any_number_found(filed, "journalnr"))
    for i, key in enumerate(leaf):
        found = found.when(n == i, registry.any_number_found(filed, key))
    second = F.when((n == line) & (F.coalesce("_found", F.lit("")) == ""), registry.number_found(filed, "aarsresultat", F.col("annual_result")))
    quoted = rows.withColumn("_found", found).withColumn("_second", second)
    day = F.datediff(F.lit("2500-01-01").cast("date"), F.col("period_end").try_cast("date"))
    return _facts(
        quoted, 11, stage_ord=F.when(n == line, 12).otherwise(11), item_ord=F.when(n == line, day).otherwise(rank * 100 + n), value=value,
        evidence_span=F.coalesce(F.nullif("_found", F.lit("")), F.nullif("_second", F.lit(""))),
        reporting_period=dates.reporting_period(F.col("period_end")), effective_date=F.col("period_end"),
    )


def accounts_states(responses: DataFrame) -> DataFrame:
    """(org_number, accounts_state): an unreadable or failed answer is not an absence."""
    listed = F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")
    rows = responses.filter("kind = 'accounts'").select(
        "org_number", "retrieved_at",
        F.when(F.col("status") == 404, "not_available")
        .when((F.col("status") == 200) & F.try_parse_json("body").isNotNull(), F.when(F.size(listed) > 0, "available").otherwise("not_available"))
        .otherwise("failed").alias("accounts_state"),
    )
    return latest(rows, ["org_number"], ["retrieved_at", "accounts_state"]).select("org_number", "accounts_state")


# --- sub-units ----------------------------------------------------------------------------

def workplace_facts(responses: DataFrame, entities: DataFrame) -> DataFrame:
    """Registered sub-units over all pages; a company whose list was read and is empty gets its own
    registered location instead. A list that could not be read proves nothing."""
    pages = responses.filter("kind = 'subunits'").filter("status = 200").withColumn("content_hash", content_hash(F.col("body"))).withColumn(
        "r", F.from_json("body", schemas.SUBUNITS_RECORD)
    )
    units = pages.select(*RESPONSE_KEY, "page_no", F.posexplode("r._embedded.underenheter").alias("pos", "_u"))
    place = F.coalesce("_u.beliggenhetsadresse", "_u.postadresse")
    rows = computed(
        units, value=let(registry.address_line(place), lambda line: registry.workplace_text(F.col("_u.navn"), line, place["kommune"], F.col("_u.antallAnsatte")))
    ).filter("value IS NOT NULL")
    spans = [_address_quote(F.col("body"), key, F.col(f"_u.{key}")) for key in ("beliggenhetsadresse", "postadresse")]
    listed = _facts(
        rows, 13, field=F.lit("workplace"), page_ord=F.col("page_no"), item_ord=F.col("pos"),
        source_url=F.coalesce("_u._links.self.href", "url"),
        evidence_span=F.coalesce(*spans, registry.quote_string(F.col("body"), "navn", F.col("_u.navn"))),
    )
    read = pages.groupBy("org_number").agg(F.max("retrieved_at").alias("retrieved_at"))
    empty = read.join(listed.select("org_number").distinct(), "org_number", "left_anti").join(
        entities.filter("legal_name IS NOT NULL").select("org_number", "legal_name", "registered_address", F.col("source").alias("url")), "org_number"
    )
    own = _facts(
        empty, 13, field=F.lit("workplace"), value=registry.own_location_text(F.col("legal_name"), F.col("registered_address")),
        page_ord=F.lit(0), item_ord=F.lit(0),
    )
    return listed.unionByName(own)


def _address_quote(body: Column, key: str, address: Column) -> Column:
    street, postcode = F.get(address["adresse"], F.lit(0)), address["postnummer"]
    by_street = F.concat(F.lit(rf'"{key}"\s*:\s*\{{[^{{}}]*"adresse"\s*:\s*\[\s*"\Q'), street, F.lit(r'\E"[^{}]*\}'))
    by_postcode = F.concat(F.lit(rf'"{key}"\s*:\s*\{{[^{{}}]*"postnummer"\s*:\s*"\Q'), postcode, F.lit(r'\E"[^{}]*\}'))
    pattern = F.when(street != "", by_street).otherwise(by_postcode)
    return F.nullif(F.regexp_substr(body, pattern), F.lit(""))


def subunit_numbers(facts: DataFrame) -> DataFrame:
    """(org_number, unit_number) from the registry URLs of workplace facts."""
    number = F.regexp_extract("source_url", r"/underenheter/(\d{9})(?:\D|$)", 1)
    return facts.filter("field = 'workplace'").select("org_number", number.alias("unit_number")).filter("unit_number <> ''").distinct()


def relocate_own_workplace(facts: DataFrame, hints: DataFrame) -> DataFrame:
    """An own-location workplace without a web source is cited to the live record's address object."""
    joined = facts.join(hints.filter("address_span IS NOT NULL").select("org_number", "record_url", "address_span"), "org_number", "left")
    moved = (F.col("field") == "workplace") & ~F.coalesce("source_url", F.lit("")).startswith("http") & F.col("record_url").isNotNull()
    return joined.withColumns({
        "source_url": F.when(moved, F.col("record_url")).otherwise(F.col("source_url")),
        "evidence_span": F.when(moved, F.col("address_span")).otherwise(F.col("evidence_span")),
    }).drop("record_url", "address_span")


# --- registry updates ---------------------------------------------------------------------

def update_facts(responses: DataFrame, limit: int = fixed.TOP_K["update_events"]) -> DataFrame:
    """The three newest registry updates of an entity; the record says that it changed, not what."""
    read = _answered(responses, "updates").withColumn("r", F.from_json("body", schemas.UPDATES_RECORD))
    events = read.select(*RESPONSE_KEY, F.posexplode("r._embedded.oppdaterteEnheter").alias("pos", "_e")).filter("_e.dato <> ''")
    newest = top_k(events, ["org_number"], [F.col("_e.dato").desc(), "pos"], limit, "rank")
    day = F.substring_index("_e.dato", "T", 1)
    both = F.concat(F.lit(r'"dato"\s*:\s*"\Q'), F.col("_e.dato"), F.lit(r'\E"\s*,\s*"endringstype"\s*:\s*"[^"]*"'))
    span = F.coalesce(F.nullif(F.regexp_substr("body", both), F.lit("")), registry.quote_string(F.col("body"), "dato", F.col("_e.dato")))
    change = F.coalesce(F.nullif("_e.endringstype", F.lit("")), F.lit("Endring"))
    return _facts(
        newest, 19, field=F.lit("dated_activity"), item_ord=F.col("rank"), evidence_span=span,
        value=F.concat(F.lit("Registry record updated ("), change, F.lit(") on "), day, F.lit(f" - {fixed.REGISTER_NAME}")),
        effective_date=F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day),
    )


# --- merging sources ----------------------------------------------------------------------

def live_over_listed(live: DataFrame, listed: DataFrame) -> DataFrame:
    """The live record per field; the company list only fills what it could not supply."""
    return live.unionByName(listed.join(live.select("org_number", "field").distinct(), ["org_number", "field"], "left_anti"))
