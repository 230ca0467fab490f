"""Identity gates: which facts and sites belong to an entity."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import fixed, names, registry, similarity, social, text, urls
from factloom.operators.ordered import first_wins
from factloom.operators.pages import canonical_link, content_hash, context_name
from factloom.operators.staging import computed

_MANAGED_FIELDS = ["company_profile", "hiring_signal", "dated_activity"]
_NAME_FIELDS = ["organization_name", "page_text"]
_CAREERS_PREFIXES = rf"^(?:{fixed.CAREERS_PREFIX}|{fixed.JOB_AD_PREFIX}|{fixed.ROLE_PREFIX})"


# --- the fact gate ------------------------------------------------------------------------

def provenance(source_url: Column, linked_from: Column, official_site: Column) -> Column:
    """`own` when the page is on the official host, `linked` when a page there links to it."""
    return _provenance(source_url, linked_from, urls.host(official_site))


def _provenance(source_url: Column, linked_from: Column, official: Column) -> Column:
    return F.when(urls.host(source_url) == official, "own").when(urls.host(linked_from) == official, "linked")


def branch_towns(accounts: DataFrame, towns: DataFrame, account: str, own: str) -> DataFrame:
    """Distinct (account, own) whose account ends in a town that is not in its own letters. A suffix match
    as an equi-join: each account meets only towns that are one of its endings. `towns` is (town)."""
    folded = towns.select(text.fold(F.col("town")).alias("_ending")).distinct()
    endings = accounts.select(account, own).distinct().withColumn("_folded", text.fold(F.col(account)))
    rows = endings.select(
        account, own, F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("_folded") - 4, F.lit(1))),
            lambda n: F.right(F.col("_folded"), n),
        )).alias("_ending"), "_folded",
    )
    hits = rows.join(folded, "_ending").filter(
        (F.length("_folded") > F.length("_ending") + 3) & ~F.contains(F.col(own), F.col("_ending"))
    )
    return hits.select(account, own).distinct()


def judge_facts(facts: DataFrame, entities: DataFrame, towns: DataFrame) -> DataFrame:
    """Raw facts with `reject_reason` (NULL when the fact is the entity's), `match_confidence` and
    `source_class`. The first failing rule names the reason.

    `entities` is (org_number, legal_name, official_site, registered_address), one row per entity."""
    about = computed(entities.select("org_number", "legal_name", "official_site", "registered_address"), _official=urls.host(F.col("official_site")))
    joined = facts.join(about, "org_number", "left")
    name, site, official, field, value = (F.col(c) for c in ("legal_name", "official_site", "_official", "field", "value"))
    joined = computed(
        joined, _from=_provenance(F.col("source_url"), F.col("linked_from"), official), _profile=F.when(field == "company_profile", social.canonical(value))
    )
    # Only profiles have an account to look up. Other facts are dealt by what they say, in letters no name has: without any, they would
    # all meet in the task of the missing account.
    dealt = F.concat(F.lit("-"), F.pmod(F.xxhash64("org_number", "field", "value", "source_url"), F.lit(1_000_000)).cast("string"))
    joined = computed(
        joined, _account=social.account_name(F.col("_profile")),
        _own=F.when(F.col("_profile").isNotNull(), social.own_letters(name, site, F.col("registered_address"))).otherwise(dealt),
    )
    profiles = joined.filter("field = 'company_profile' AND _profile IS NOT NULL")
    in_town = branch_towns(profiles, towns, "_account", "_own").withColumn("_branch", F.lit(True))
    joined = joined.join(in_town, ["_account", "_own"], "left")

    anonymous = name.isNull() | site.isNull()
    off_site = F.col("_from").isNull()
    larger_site = (field == "hiring_signal") & value.rlike(_CAREERS_PREFIXES) & urls.is_deep_page(site)
    managed = field.isin(_MANAGED_FIELDS) & names.is_housing_coop(name) & urls.host(F.col("source_url")).isin(fixed.MANAGER_HOSTS)
    early = F.when(anonymous, "no_identity").when(off_site, "off_site").when(larger_site, "larger_site").when(managed, "manager_content")
    named_after = F.col("_profile").isNotNull() & social.resembles(F.col("_profile"), names.identity_tokens(name, F.lit("")))
    # The similarity function reads plain columns, filled only for the facts that still need a score.
    staged = computed(joined, _early=early, _named_after=F.coalesce(named_after, F.lit(False)))
    alive = F.col("_early").isNull()
    staged = computed(
        staged, _context=F.when(alive & ~F.col("_named_after"), F.col("context_name")), _claimed=F.when(alive & field.isin(_NAME_FIELDS), value)
    )
    scored = staged.withColumn("_context_score", similarity.name_similarity(name, F.col("_context"))).withColumn(
        "_value_score", similarity.name_similarity(name, F.col("_claimed"))
    )
    host = urls.host(value)
    other_site = (field == "official_site") & ~(urls.on_site(host, official) | urls.on_site(official, host))
    other_account = F.col("_profile").isNotNull() & ~social.is_plausibly_own(F.col("_profile"), name, site, F.col("_branch"))
    reason = F.coalesce(
        F.col("_early"),
        F.when(F.col("_context_score") < fixed.NAME_THRESHOLD, "other_name").when(other_account, "other_account")
        .when(other_site, "other_site").when(F.col("_value_score") < fixed.NAME_THRESHOLD, "weak_name"),
    )
    return scored.select(
        *facts.columns, reason.alias("reject_reason"), F.coalesce("_value_score", F.lit(100.0)).alias("match_confidence"),
        F.when(F.col("_from") == "own", "company_owned").otherwise("external").alias("source_class"),
        (urls.host(F.col("linked_from")) == official).alias("_chained"),
    )


def confirm(judged: DataFrame) -> DataFrame:
    """The accepted facts in the confirmed shape; the link chain is kept where it is the provenance."""
    kept = judged.filter("reject_reason IS NULL")
    return schemas.conform(
        kept, schemas.CONFIRMED_FACT, retrieved_at=F.col("extracted_at"),
        linked_from=F.when(F.coalesce("_chained", F.lit(False)), F.col("linked_from")),
    )


# --- candidate sites ----------------------------------------------------------------------

def contact_span(html: Column, phones: Column, street: Column, postcode: Column) -> Column:
    """Where the page shows the registered phone, or the street with its postcode on the page; verbatim."""
    wanted_street = F.lower(text.squeeze(street))
    flat = text.squeeze(text.strip_tags(html))

    def phone_in(value: Column) -> Column:
        found = F.regexp_extract_all(value, F.lit(fixed.PHONE), 1)
        return F.exists(found, lambda p: F.array_contains(phones, F.regexp_replace(p, r"\D", "")))

    def cut(pattern: Column, before: int, after: int) -> Column:
        return F.nullif(F.trim(F.regexp_substr(flat, F.concat(F.lit(rf"(?is).{{0,{before}}}"), pattern, F.lit(rf".{{0,{after}}}")))), F.lit(""))

    has_phones = F.coalesce(F.size(phones) > 0, F.lit(False))
    by_node = F.when(has_phones, text.node_span(html, phone_in))
    placed = street.isNotNull() & F.contains(flat, postcode)
    street_node = F.when(placed, text.node_span(html, lambda n: F.contains(F.lower(n), wanted_street)))
    numbers = F.filter(
        F.regexp_extract_all(flat, F.lit(r"(?U).{0,24}" + fixed.PHONE.replace("(?U)", "") + ".{0,24}"), 0), phone_in
    )
    street_text = F.when(placed, cut(F.concat(F.lit(r"\Q"), text.squeeze(street), F.lit(r"\E")), 20, 40))
    return F.coalesce(by_node, street_node, F.when(has_phones, F.trim(F.get(numbers, F.lit(0)))), street_text)


def shows_location(html: Column, postcode: Column, town: Column) -> Column:
    """The registered postcode followed by its town."""
    flat = text.squeeze(text.strip_tags(html))
    pattern = F.concat(F.lit(r"(?iuU)(?<!\d)"), postcode, F.lit(r"\s*,?\s+\Q"), town, F.lit(r"\E"))
    return F.coalesce(F.rlike(flat, pattern), F.lit(False))


def town_on_page(html: Column, places: list[Column]) -> Column:
    """The registered post town, else the municipality, as the page writes it."""
    body = text.body_text(html)

    def found(place: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iuU)(?<![\wæøå])\Q"), place, F.lit(r"\E(?![\wæøå])"))
        return F.when(F.length(place) >= 3, F.nullif(F.regexp_substr(body, pattern), F.lit("")))

    return F.coalesce(*[found(p) for p in places])


def number_span(html: Column, number: Column) -> Column:
    """The text around this organisation number: its text node, else the visible line cut around it."""
    anchor = F.concat_ws(
        r"(?:\s|&nbsp;|&#160;|&#xa0;|\.)?", F.substring(number, 1, 3), F.substring(number, 4, 3), F.substring(number, 7, 3)
    )
    node = text.node_span(html, lambda n: F.array_contains(names.numbers_in(n), number), anchor)
    line = F.get(F.filter(text.visible_lines(html), lambda l: F.array_contains(names.numbers_in(l), number)), F.lit(0))
    spaced = F.concat_ws("[ . ]?", F.substring(number, 1, 3), F.substring(number, 4, 3), F.substring(number, 7, 3))
    around = F.regexp_substr(line, F.concat(F.lit(r"(?s)(?:^.{0,69}|(?<= )\S.{0,69}?|)(?<!\d)"), spaced, F.lit(r"(?!\d).{0,40}")))
    return F.coalesce(node, F.trim(around))


def whole_name_span(html: Column, name: Column) -> Column:
    wanted = names.whole_name(name)
    return F.when(wanted != "", text.node_span(html, lambda n: F.contains(text.folded_phrase(n), wanted)))


def judge_sites(candidates: DataFrame) -> DataFrame:
    """Candidate sites with `decision` (accepted or the first rule that refused it), `site`, `span` and
    `match_confidence`. One row per candidate: every test is a column of that row.

    Columns: org_number, legal_name, alternate_names, kind, url, landed_url, status, html, json_names,
    phones, street, postcode, town, municipality, name_taken, holder_name."""
    html, name, number = F.col("html"), F.col("legal_name"), F.col("org_number")
    readable = F.when(F.col("status") == 200, html)
    by_url = (
        F.when(urls.is_aggregator(F.col("url")), "aggregator").when(urls.is_directory_shaped(F.col("url")), "directory")
        .when(urls.embeds_a_number(F.col("url")), "numbered_record").when(F.coalesce(F.col("status") != 200, F.lit(True)), "not_read")
        .when(names.states_another_number(html, number), "other_number")
    )
    staged = candidates.withColumn("_by_url", by_url)
    page = F.when(F.col("_by_url").isNull(), readable)
    all_names = F.concat(F.array(name), F.coalesce(F.col("alternate_names"), F.array().cast("array<string>")))
    main = F.array_join(text.visible_lines(page), " ")
    found_names = F.when(F.size("json_names") > 0, F.col("json_names")).otherwise(F.filter(F.array(main), lambda t: t != ""))
    staged = staged.withColumn("_names", all_names).withColumn("_found", F.when(F.col("_by_url").isNull(), found_names))
    staged = staged.withColumn("_best", similarity.best_match(F.col("_names"), F.col("_found")))
    staged = staged.withColumn("_own_number", names.shows_own_number(page, number)).withColumn(
        "_contact", contact_span(page, F.col("phones"), F.col("street"), F.col("postcode"))
    ).withColumn("_score", F.coalesce("_best.score", F.lit(0.0)))
    resembling = F.exists("_names", lambda n: names.domain_resembles(F.col("url"), n))
    by_contact = F.col("_contact").isNotNull() & ((F.col("_score") >= fixed.NAME_THRESHOLD) | resembling)
    needs_proof = F.col("kind").isin("guess", "exact")
    own = F.coalesce("_own_number", F.lit(False))
    proven = own | by_contact
    located = shows_location(page, F.col("postcode"), F.col("town"))
    by_town = (
        (F.col("kind") == "exact") & ~proven & ~located & urls.same_label(F.col("url"), F.col("landed_url"))
        & town_on_page(page, [F.col("town"), F.col("municipality")]).isNotNull() & names.shows_whole_name(text.body_text(page), name)
    )
    staged = staged.withColumn("_by_contact", by_contact).withColumn("_proven", proven).withColumn("_by_town", F.coalesce(by_town, F.lit(False)))
    organisations = F.size(F.array_distinct(F.transform("json_names", lambda n: F.lower(F.trim(n)))))
    covered = F.array_max(F.flatten(F.transform("_names", lambda n: F.transform("_found", lambda c: names.word_coverage(n, c)))))
    flat = F.lower(text.squeeze(text.strip_tags(page)))
    unproven = ~F.col("_proven") & ~F.col("_by_town")
    landed_host = urls.without_www(urls.authority(F.col("landed_url")))
    held = names.spells_whole_name(landed_host, F.col("holder_name")) & ~names.spells_whole_name(landed_host, name)
    decision = F.coalesce(
        F.col("_by_url"),
        F.when(~own & (organisations > fixed.MAX_OWN_ORGANISATIONS), "lists_many").when(~own & urls.is_foreign_tld(F.col("url")), "foreign_domain")
        .when(needs_proof & ~own & text.head_text(page).rlike(fixed.PARKED_PAGE), "parked")
        .when(needs_proof & unproven & ~located, "no_proof").when(~own & names.names_a_sister(name, flat), "sister")
        .when(unproven & (F.col("_score") < fixed.NAME_THRESHOLD), "other_name")
        .when(unproven & (F.coalesce(covered, F.lit(0.0)) < fixed.WORD_COVERAGE), "thin_name")
        .when(needs_proof & ~own & F.col("_by_town") & F.col("name_taken").isNull(), "name_unchecked")
        .when(needs_proof & ~own & F.coalesce("name_taken", F.lit(False)), "name_taken")
        .when(~own & F.col("holder_name").isNotNull() & held, "held_by_other"),
        F.lit("accepted"),
    )
    span = F.coalesce(
        F.when(own, number_span(page, number)), F.when(F.col("_by_contact"), F.col("_contact")),
        F.when(F.col("_by_town"), whole_name_span(page, name)), F.col("_best.text"), text.page_heading(page),
    )
    landed = F.col("landed_url")
    site = F.when((urls.query(landed) == "") & (urls.fragment(landed) == ""), landed).otherwise(F.col("url"))
    accepted = decision == "accepted"
    out = staged.withColumn("decision", decision)
    return out.select(
        *candidates.columns, "decision", F.when(accepted, site).alias("site"), F.when(accepted, span).alias("span"),
        F.when(accepted, F.when(F.col("_proven"), F.lit(100.0)).otherwise(F.col("_score"))).alias("match_confidence"),
    )


def first_accepted(judged: DataFrame, order: list) -> DataFrame:
    """The first accepted candidate of each entity, in candidate order."""
    return first_wins(judged.filter("decision = 'accepted'"), ["org_number"], order)


# --- registered sites ---------------------------------------------------------------------

def site_ownership(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per entity with a registered site: the page that proves it and its span, or `reason`.

    A page proves the site by the organisation number, or, on a home, contact or about page, by the
    company's own name. Pages outside the domain the site lands on do not count."""
    about = entities.filter("official_site IS NOT NULL AND legal_name IS NOT NULL").select("org_number", "legal_name", "official_site")
    html, landed = F.col("raw_html"), F.coalesce("final_url", "url")
    # Everything the decision needs is read in the narrow map; only these columns meet the entities.
    readable = pages.filter("fetch_state = 'available' AND raw_html <> '' AND linked_from IS NULL").select(
        "org_number", "page_ord", "url", landed.alias("landed"), "fetched_at", content_hash(html).alias("content_hash"), canonical_link(html).alias("canonical"),
        number_span(html, F.col("org_number")).alias("_number"), F.filter(names.stated_numbers(html), lambda n: n != F.col("org_number")).alias("_others"),
        F.when(urls.is_owner_page(landed), _own_names(html)).alias("_found"),
    ).join(about, "org_number")
    requested = readable.filter(urls.on_site(urls.host(F.col("url")), urls.host(F.col("official_site"))))
    home = first_wins(requested.select("org_number", "page_ord", F.col("landed").alias("home_landed"), "canonical", "official_site"), ["org_number"], ["page_ord"])
    official = urls.host(F.col("official_site"))
    moved = ~urls.on_site(urls.host(F.col("home_landed")), official)
    base = F.when(moved, urls.host(F.col("home_landed"))).otherwise(official)
    value = F.when(
        F.col("canonical").isNotNull() & urls.on_site(urls.host(F.col("canonical")), base), F.col("canonical")
    ).otherwise(F.col("home_landed"))
    sites = home.select(
        "org_number", moved.alias("moved"), urls.host(F.col("home_landed")).alias("landed_host"),
        F.when(moved & (urls.query(value) != ""), F.substring_index("home_landed", "?", 1)).otherwise(value).alias("site"),
    )
    own = requested.join(sites, "org_number").filter(~F.col("moved") | (urls.host(F.col("landed")) == F.col("landed_host")))
    proofs = _with_name_span(own).select(
        "org_number", "page_ord", "landed", "fetched_at", "content_hash", "_others", F.coalesce("_number", "name_span").alias("span"),
        F.when(F.col("_number").isNotNull(), 0).when(F.col("name_span").isNotNull(), 1).otherwise(2).alias("_rank"),
    )
    # One row per entity before anything wide moves: best proof by (rank, page order), smallest other number.
    best = proofs.groupBy("org_number").agg(
        F.min_by(F.struct("landed", "fetched_at", "content_hash", "span", "_rank"), F.struct("_rank", "page_ord")).alias("_p"),
        F.min(F.array_min("_others")).alias("other_number"),
    )
    proven = F.col("_p._rank") < 2
    reason = (
        F.when(F.col("_p").isNull(), "the website could not be read").when(proven, F.lit(None))
        .when(
            F.col("other_number").isNotNull(),
            F.concat(F.lit("the website shows another organisation's number ("), names.spaced_number(F.col("other_number")), F.lit("), not this company's")),
        ).otherwise("the website does not show this company's name or organisation number")
    )
    return about.select("org_number", "legal_name", "official_site").join(best, "org_number", "left").join(
        sites.select("org_number", "site"), "org_number", "left"
    ).select(
        "org_number", "legal_name", "official_site", F.when(proven, F.col("site")).alias("site"), F.when(proven, F.col("_p.landed")).alias("proof_url"),
        F.when(proven, F.col("_p.span")).alias("span"), F.when(proven, F.col("_p.content_hash")).alias("content_hash"),
        F.when(proven, F.col("_p.fetched_at")).alias("retrieved_at"), reason.alias("reason"),
    )


def _own_names(html: Column) -> Column:
    """What a page calls its owner: its organisation name and its heading."""
    return F.filter(F.array(context_name(html), text.page_heading(html)), lambda c: c.isNotNull() & (c != ""))


def _with_name_span(rows: DataFrame) -> DataFrame:
    """Rows with legal_name and `_found` (what the page calls its owner), plus `name_span`: the one that
    reads like the company, else the part of a title that holds the whole name."""
    scored = computed(computed(rows, _read=F.col("_found")), _best=similarity.best_match(F.array("legal_name"), F.col("_read"))).drop("_read")
    parts = F.flatten(F.transform("_found", lambda c: F.split(c, fixed.TITLE_SEPARATOR)))
    holding = F.get(F.filter(F.transform(parts, F.trim), lambda p: names.holds_whole_name(p, F.col("legal_name"))), F.lit(0))
    span = F.when(F.col("_best.score") >= fixed.SPAN_NAME_THRESHOLD, F.col("_best.text")).otherwise(holding)
    return scored.withColumn("name_span", span).drop("_best")


def name_spans(pages: DataFrame) -> DataFrame:
    """(org_number, page_ord, name_span): the page's own name for the company. Pages carry legal_name."""
    read = pages.select("org_number", "page_ord", "legal_name", _own_names(F.col("raw_html")).alias("_found"))
    return _with_name_span(read).select("org_number", "page_ord", "name_span").filter("name_span IS NOT NULL")


def registered_site_outcome(ownership: DataFrame, holders: DataFrame) -> DataFrame:
    """Per entity: `proven`, `domain_stands` (the domain spells the name; nothing read from it counts unless
    it spells the whole name) or `ambiguous` with the reason. `holders` is (org_number, holder_name,
    holder_number): another entity that lists the same website."""
    joined = ownership.join(holders, "org_number", "left")
    resembles = names.domain_resembles(F.col("official_site"), F.col("legal_name"))
    silent = F.col("reason").isin(
        "the website could not be read", "the website does not show this company's name or organisation number"
    )
    outcome = F.when(F.col("reason").isNull(), "proven").when(silent & resembles, "domain_stands").otherwise("ambiguous")
    held = ~resembles & F.col("holder_name").isNotNull()
    why = F.when(
        held, F.concat(F.lit("Brønnøysund lists the same website for "), "holder_name", F.lit(" ("), "holder_number", F.lit(")"))
    ).otherwise(F.col("reason"))
    keep = (outcome == "proven") | ((outcome == "domain_stands") & names.domain_spells(F.col("official_site"), F.col("legal_name")))
    return joined.select(
        *ownership.columns, outcome.alias("outcome"), keep.alias("content_counts"),
        F.when(outcome == "ambiguous", F.concat(F.lit("Registered website "), "official_site", F.lit(": "), why)).alias("unproven"),
    )


def own_social_rows(facts: DataFrame, proven: DataFrame) -> DataFrame:
    """Profiles only from a proven site's home and contact pages; every other fact passes."""
    profiles = facts.filter("field = 'company_profile'").filter(urls.is_owner_page(F.col("source_url")))
    return facts.filter("field <> 'company_profile'").unionByName(
        profiles.join(proven.select("org_number").distinct(), "org_number", "left_semi")
    )


def undoubted_accounts(facts: DataFrame, entities: DataFrame, registered: DataFrame) -> DataFrame:
    """Drop profiles whose account spells another registered company's name.

    `registered` is every registered name (org_number, legal_name), or None when the register could not
    be searched: then every account that is not simply the company's own name is dropped."""
    profiles = facts.filter("field = 'company_profile'").join(entities.select("org_number", "legal_name", "official_site"), "org_number")
    sure = social.is_the_company(F.col("value"), F.col("legal_name"), F.coalesce("official_site", F.lit("")))
    marked = profiles.withColumn("_sure", sure)
    certain = marked.filter("_sure").select(*facts.columns)
    others = facts.filter("field <> 'company_profile'")
    if registered is None:
        return others.unionByName(certain)
    spelled = registered.select(
        "org_number", names.plain(F.array_join(names.stem_words(F.col("legal_name")), "")).alias("_spelling")
    ).filter(F.length("_spelling") >= 4).groupBy("_spelling").agg(F.min("org_number").alias("_least"), F.max("org_number").alias("_most"))
    doubtful = marked.filter(~F.col("_sure")).withColumn("_row", F.struct(*facts.columns))
    claimed = doubtful.select("org_number", "value", F.explode(social.account_spellings(F.col("value"))).alias("_spelling")).distinct().join(
        spelled, "_spelling"
    ).filter((F.col("_least") != F.col("org_number")) | (F.col("_most") != F.col("org_number"))).select("org_number", "value").distinct()
    kept = doubtful.join(claimed, ["org_number", "value"], "left_anti").select("_row.*")
    return others.unionByName(certain).unionByName(kept)
