"""Facts read out of pages. A page row goes in, fact rows come out; the markup is never shuffled.

Every extractor is a `Reader`: it reads arrays out of the markup, names the texts whose entities are to be decoded, and
makes an array of facts from both. `facts_of` runs any number of readers in one narrow map: the markup is read
once and dropped, the texts of all readers are decoded in one Arrow step, and the facts are exploded once. Choosing the
first of equal items and cutting lists happens inside the page's arrays, so nothing is shuffled.

Every operator takes a `pages` table in the working shape (org_number, page_ord, url, raw_html,
fetched_at, fetch_state, linked_from, final_url) and returns raw facts with their reading order."""
from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import zip_longest

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schemas
from factloom.functions import dates, fixed, names, registry, social, text, urls
from factloom.functions.let import let
from factloom.operators.joins import salted_join
from factloom.operators.links import anchors
from factloom.operators.ordered import first_wins
from factloom.operators.staging import computed
from factloom.session import materialise

PAGE_KEY = ["org_number", "page_ord"]


def content_hash(body: Column) -> Column:
    return F.sha2(F.encode(body, "UTF-8"), 256)


def _facts(df: DataFrame, stage: int, method: str, **given: Column) -> DataFrame:
    return schemas.conform(
        df, schemas.RAW_FACT, stage_ord=F.lit(stage), extraction_method=F.lit(method),
        source_url=F.col("url"), extracted_at=F.col("fetched_at"), **given,
    )


# --- one read of a page -------------------------------------------------------------------

_PAGE = [*PAGE_KEY, "url", "fetched_at", "linked_from", "content_hash"]
_MARK = "\u241e"  # between pieces of one text


Steps = Iterator[dict[str, Column]]


@dataclass(frozen=True)
class Reader:
    """One extractor, as steps: each is a dict of columns that the next may read. `read(asked)` sees the page row with
    `_objects` and `context_name`, works where `asked` holds, and ends with `_<name>_texts`, an array of texts to decode.
    `finish()` ends with `_<name>_facts`; it finds the decoded texts as `_<name>_decoded`, see `decodings`, and no
    markup. A `late` reader finishes when the others have."""

    name: str
    stage: int
    method: str
    read: Callable[[Column], Steps]
    finish: Callable[[], Steps]
    kinds: tuple[str, ...] = ("page", "careers")
    late: bool = False


_STILL_ENCODED = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def decodings(texts: pd.Series) -> pd.Series:
    """Each text [decoded, decoded again where the source encoded it twice, the second again for the decoded text], by the
    full HTML entity table. A text may hold several pieces between marks: each piece is decoded alone."""

    def twice(piece: str) -> str:
        once = html_lib.unescape(piece)
        return html_lib.unescape(once) if _STILL_ENCODED.search(once) else once

    def forms(t: str | None) -> list[str | None]:
        if t is None or "&" not in t:
            return [t, t, t]
        pieces = t.split(_MARK)
        once = [html_lib.unescape(p) for p in pieces]
        return [_MARK.join(once), _MARK.join(map(twice, pieces)), _MARK.join(map(twice, once))]

    return texts.map(lambda ts: None if ts is None else [forms(t) for t in ts])


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _opened(pages: DataFrame) -> DataFrame:
    """Page rows with what several readers share."""
    html = F.col("raw_html")
    read = computed(pages, _objects=json_ld(html), content_hash=content_hash(html))
    return computed(read, context_name=F.coalesce(organisation_name(F.col("_objects")), F.nullif(site_name(html), F.lit(""))))


def _side_by_side(df: DataFrame, readers: list[Iterable[dict[str, Column]]]) -> DataFrame:
    """The steps of several readers taken together: a plan is as long as the longest of them."""
    for step in zip_longest(*readers, fillvalue={}):
        df = computed(df, **{name: value for own in step for name, value in own.items()})
    return df


_STEPS: dict[tuple, tuple[list[dict[str, Column]], list[dict[str, Column]]]] = {}


def _steps(reader: Reader, routed: bool) -> tuple[list[dict[str, Column]], list[dict[str, Column]]]:
    """The steps of a reader, put together once per session: thousands of column calls, the same whatever the pages."""
    key = (SparkContext._active_spark_context.applicationId, reader, routed)
    if key not in _STEPS:
        _STEPS[key] = list(reader.read(F.col("_kind").isin(*reader.kinds) if routed else F.lit(True))), list(reader.finish())
    return _STEPS[key]


def _read_by(pages: DataFrame, readers: list[Reader], wanted: list[str], routed: bool = False) -> DataFrame:
    """Page rows without markup, with the `wanted` columns of the readers."""
    steps = {r.name: _steps(r, routed) for r in readers}
    read = _side_by_side(_opened(pages), [steps[r.name][0] for r in readers])
    read = read.drop("_objects", "raw_html")
    texts = [F.coalesce(f"_{r.name}_texts", _none("string")) for r in readers]
    read = read.withColumn("_decoded", decodings(F.concat(*texts)))
    begin, slices = F.lit(1), {}
    for r, own in zip(readers, texts):
        slices[f"_{r.name}_decoded"] = F.slice("_decoded", begin, F.size(own))
        begin = begin + F.size(own)
    read = computed(read, **slices)
    for late in (False, True):
        read = _side_by_side(read, [steps[r.name][1] for r in readers if r.late == late])
    return read.select(*_PAGE, *wanted)


def _numbered(facts: Column, reader: Reader) -> Column:
    """Facts with their stage, method and place."""
    return F.transform(F.coalesce(facts, _none(_FACT)), lambda f, i: F.struct(
        F.lit(reader.stage).alias("stage_ord"), i.cast("bigint").alias("item_ord"), F.lit(reader.method).alias("extraction_method"), *[f[c].alias(c) for c in _FACT_FIELDS]
    ))


def facts_of(pages: DataFrame, readers: list[Reader], routed: bool = False) -> DataFrame:
    """Raw facts of all readers, each page read once. With `routed`, a reader reads pages of its kinds (`_kind`) only."""
    read = _read_by(pages, readers, [f"_{r.name}_facts" for r in readers], routed)
    facts = F.concat(*[_numbered(F.col(f"_{r.name}_facts"), r) for r in readers])
    rows = read.select(*_PAGE, F.explode(facts).alias("_f")).select(*_PAGE, "_f.*")
    return schemas.conform(rows, schemas.RAW_FACT, source_url=F.col("url"), extracted_at=F.col("fetched_at"))


def _first_of_each(items: Column, key: str) -> Column:
    """The first item of each `key`, in order of item_ord. Items are structs; sorting keeps long lists cheap."""
    ordered = F.array_sort(F.transform(items, lambda x: F.struct(x[key].alias("k"), x["item_ord"].alias("o"), x.alias("x"))))
    firsts = let(ordered, lambda all_: F.filter(all_, lambda r, i: (i == 0) | ~F.get(all_, i - 1)["k"].eqNullSafe(r["k"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda r: F.struct(r["o"], r["x"]))), lambda r: r["x"])


_FACT_FIELDS = ["field", "value", "context_name", "evidence_span", "effective_date"]
_FACT = "struct<" + ",".join(f"{c}:string" for c in _FACT_FIELDS) + ">"


# --- JSON-LD ------------------------------------------------------------------------------

def _array_at(doc: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(doc, path, f"array<{kind}>")


def _one_or_many(doc: Column, path: str, kind: str) -> Column:
    return F.coalesce(_array_at(doc, path, kind), F.array(F.try_variant_get(doc, path, kind)))


def _properties(obj: Column, *names: str, kind: str = "variant") -> Column:
    """The named properties of an object as a struct, read in one pass; each is NULL where it is missing, all of them where
    `obj` is no object. Looking up a missing property by its path costs Spark many times more than one that is there."""
    return F.try_variant_get(obj, "$", "struct<" + ",".join(f"`{n}`:{kind}" for n in names) + ">")


def json_ld(html: Column) -> Column:
    """The JSON-LD objects of a page in page order, as array<variant>. `@graph` wrappers are opened,
    nested ones included, as deep as they go; a script that is not JSON is left out."""
    blocks = F.regexp_extract_all(html, F.lit(fixed.JSON_LD), 1)
    documents = F.filter(F.transform(blocks, lambda b: F.try_parse_json(text.strip(b))), lambda d: d.isNotNull())
    objects = F.flatten(F.transform(documents, lambda d: F.coalesce(_array_at(d, "$"), F.array(d))))
    depth = F.regexp_count(html, F.lit('"@graph"'))  # no wrapper lies deeper than there are wrappers
    objects = F.reduce(
        F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")), objects,
        lambda found, _: F.flatten(F.transform(found, lambda o: F.coalesce(_properties(o, "@graph", kind="array<variant>")["@graph"], F.array(o)))),
    )
    return F.when(html.contains("ld+json"), objects).otherwise(F.array().cast("array<variant>"))


def json_ld_objects(pages: DataFrame, carry: list[str]) -> DataFrame:
    """(carry..., obj_ord, obj): one row per JSON-LD object."""
    return pages.select(*carry, F.posexplode(json_ld(F.col("raw_html"))).alias("obj_ord", "obj"))


def object_types(obj: Column) -> Column:
    return _types(_properties(obj, "@type"))


def _types(properties: Column) -> Column:
    return F.coalesce(_one_or_many(properties["@type"], "$", "string"), _none("string"))


def _is_any(types: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(types, F.array(*[F.lit(w) for w in wanted]))


def organisation_name(objects: Column) -> Column:
    """The name of the first named object that describes neither a page, an article, a product nor a person."""
    read = F.transform(objects, lambda o: _properties(o, "name", "@type"))
    named = F.filter(
        F.transform(read, lambda o: F.struct(registry.string_of(o["name"]).alias("name"), _types(o).alias("types"))),
        lambda o: o["name"].isNotNull() & ~F.coalesce(_is_any(o["types"], fixed.NOT_ORGANISATION_TYPES), F.lit(False)),
    )
    return F.get(named, F.lit(0))["name"]


def site_name(html: Column) -> Column:
    return F.coalesce(*[text.first_group(html, p) for p in fixed.SITE_NAME])


def context_name(html: Column) -> Column:
    """What the page calls its organisation: from JSON-LD, else its og:site_name."""
    return F.coalesce(organisation_name(json_ld(html)), F.nullif(site_name(html), F.lit("")))


def context_names(pages: DataFrame) -> DataFrame:
    return pages.select(*PAGE_KEY, context_name(F.col("raw_html")).alias("context_name"))


def canonical_link(html: Column) -> Column:
    return F.nullif(text.strip(F.coalesce(*[text.first_group(html, p) for p in fixed.CANONICAL])), F.lit(""))


_OWNERS = ("publisher", "founder", "provider")
_READ_PROPERTIES = (
    "@type", "title", "name", "headline", "datePosted", "hiringOrganization", "datePublished", "startDate", "url", "address", "employee", "sameAs", *_OWNERS
)


def _read_structured(asked: Column) -> Steps:
    html = F.col("raw_html")

    def read(o: Column) -> Column:
        def given(node: Column, path: str = "$") -> Column:
            return F.nullif(F.try_variant_get(node, path, "string"), F.lit(""))

        people = F.transform(
            F.transform(F.coalesce(_array_at(o["employee"], "$"), _none("variant")), lambda e: _properties(e, "name", "jobTitle")),
            lambda e: F.struct(registry.string_of(e["name"]).alias("n"), registry.string_of(e["jobTitle"]).alias("t")),
        )
        name = registry.string_of(o["name"])
        return F.struct(
            _types(o).alias("types"), registry.string_of(o["title"]).alias("title"), name.alias("name"),
            F.coalesce(registry.string_of(o["headline"]), name).alias("raw_headline"), given(o["datePosted"]).alias("posted"),
            registry.string_of(_properties(o["hiringOrganization"], "name")["name"]).alias("employer"), given(o["datePublished"]).alias("published"),
            given(o["startDate"]).alias("starts"), registry.string_of(o["url"]).alias("site"),
            F.concat_ws(", ", *[given(o["address"], f"$.{p}") for p in ("streetAddress", "postalCode", "addressLocality")]).alias("line"),
            people.alias("people"), _same_as(o, html).alias("profiles"),
        )

    yield dict(
        _structured_objects=F.when(asked, F.transform("_objects", lambda o: _properties(o, *_READ_PROPERTIES))),
        _structured_name=organisation_name(F.col("_objects")),
    )
    yield dict(_structured=F.transform("_structured_objects", read))
    titles, headlines = F.transform("_structured", lambda o: o["title"]), F.transform("_structured", lambda o: o["raw_headline"])
    yield dict(_structured_texts=F.concat(titles, headlines), _structured_post=urls.is_post_page(F.col("url")))


def _finish_structured() -> Steps:
    """Per object a job posting, a dated article or event, organisation name, site, address, employees and linked profiles,
    in this order."""
    post_page, url = F.col("_structured_post"), F.col("url")

    def decoded(i: Column) -> Column:
        return F.get(F.get("_structured_decoded", i), F.lit(0))

    def worded(o: Column, i: Column) -> Column:
        is_article = F.coalesce(_is_any(o["types"], fixed.ARTICLE_TYPES), F.lit(False))
        return o.withField("title_text", decoded(i)).withField("headline", F.coalesce(decoded(i + F.size("_structured")), F.lit("activity"))).withField(
            "is_article", is_article
        ).withField("is_event", ~is_article & F.coalesce(_is_any(o["types"], fixed.EVENT_TYPES), F.lit(False))).withField(
            "posted_day", dates.leading_day(o["posted"])).withField("absolute", F.when(o["site"].isNotNull(), urls.absolute(url, o["site"])))

    def dated(o: Column) -> Column:
        news = o["is_article"] & post_page & text.is_news_title(o["headline"])
        return o.withField("when", F.when(news, o["published"]).when(o["is_event"], o["starts"]))

    def facts(o: Column) -> Column:
        posted = F.coalesce(o["posted_day"], o["posted"])
        is_job = F.coalesce(_is_any(o["types"], fixed.JOB_TYPES), F.lit(False)) & o["title"].isNotNull()
        job = _fact(
            is_job, "hiring_signal", F.when(posted.isNotNull(), F.concat(o["title_text"], F.lit(" (posted "), posted, F.lit(")"))).otherwise(o["title_text"]),
            o["employer"], o["title"], o["posted_day"],
        )
        item = F.concat(o["headline"], F.lit(" ("), F.coalesce(o["day"], o["when"]), F.lit(")"))
        activity = _fact(
            o["when"].isNotNull(), "dated_activity", F.when(post_page, text.with_post_link(item, url)).otherwise(item),
            F.col("_structured_name"), o["raw_headline"], o["day"],
        )
        staff = F.transform(
            F.filter(o["people"], lambda p: p["n"].isNotNull()),
            lambda p: _fact_struct("leader", F.coalesce(F.concat(p["n"], F.lit(" ("), p["t"], F.lit(")")), p["n"]), o["name"]),
        )
        return F.concat(
            job, activity, _fact(o["name"].isNotNull(), "organization_name", o["name"]),
            _fact(o["absolute"].rlike("(?i)^https?://[^/?#]"), "official_site", o["absolute"]), _fact(o["line"] != "", "registered_address", o["line"]),
            staff, F.transform(o["profiles"], lambda f: _fact_struct("company_profile", f["value"], f["owner"], f["span"])),
        )

    yield dict(_structured_1=F.transform("_structured", worded))
    yield dict(_structured_2=F.transform("_structured_1", dated))
    yield dict(_structured_3=F.transform("_structured_2", lambda o: o.withField("day", dates.leading_day(o["when"]))))
    yield dict(_structured_facts=F.flatten(F.transform("_structured_3", facts)))


STRUCTURED = Reader("structured", 0, "structured", _read_structured, _finish_structured)


def structured_facts(pages: DataFrame) -> DataFrame:
    """Job postings, dated articles and events, organisation name, site, address, employees and linked
    profiles from JSON-LD."""
    return facts_of(pages.filter(F.col("raw_html").contains("ld+json")), [STRUCTURED])


def _fact_struct(field: str, value: Column, context: Column | None = None, span: Column | None = None, day: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(field).alias("field"), value.cast("string").alias("value"),
        (none if context is None else context.cast("string")).alias("context_name"),
        (none if span is None else span.cast("string")).alias("evidence_span"),
        (none if day is None else day.cast("string")).alias("effective_date"),
    )


def _fact(condition: Column, field: str, value: Column, context=None, span=None, day=None) -> Column:
    fact = _fact_struct(field, value, context, span, day)
    return F.filter(F.array(fact), lambda f: F.coalesce(condition, F.lit(False)) & f["value"].isNotNull())


def _same_as(obj: Column, html: Column) -> Column:
    """Profiles an object (its `_READ_PROPERTIES`), its publisher, founder or provider lists under sameAs, each with its owner's name:
    array<struct<value, owner, span>>."""
    own = F.struct(obj["sameAs"].alias("sameAs"), obj["name"].alias("name"))
    owners = F.filter(F.array(own, *[_properties(obj[k], "sameAs", "name") for k in _OWNERS]), lambda o: o.isNotNull())
    listed = F.flatten(F.transform(owners, lambda o: F.transform(
        F.coalesce(_one_or_many(o["sameAs"], "$", "variant"), _none("variant")),
        lambda v: F.struct(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).alias("link"), registry.string_of(o["name"]).alias("owner")),
    )))
    links = F.filter(listed, lambda l: l["link"].isNotNull() & (l["link"] != "") & ~l["link"].rlike(fixed.SOCIAL_NOT_PROFILE))
    keyed = F.filter(
        F.transform(links, lambda l: F.struct(l["link"].alias("link"), l["owner"].alias("owner"), social.profile_key(l["link"]).alias("key"))), lambda l: l["key"].isNotNull()
    )
    return F.transform(keyed, lambda l: F.struct(
        social.published_form(l["key"]).alias("value"), l["owner"].alias("owner"), registry.as_written(html, l["link"]).alias("span")
    ))


# --- meta tags ----------------------------------------------------------------------------

def _read_meta(asked: Column) -> Steps:
    html, asked = F.col("raw_html"), asked
    brand = F.coalesce(
        F.nullif(site_name(html), F.lit("")), F.nullif(text.strip(text.first_group(html, fixed.APP_NAME)), F.lit(""))
    )
    yield dict(_meta_brand=F.when(asked, brand), _meta_canonical=F.when(asked, canonical_or_null(html)), _meta_texts=F.when(asked, descriptions(html, F.col("url")))
    )


def _finish_meta() -> Steps:
    plain = F.transform(F.coalesce("_meta_texts", _none("string")), lambda raw, i: F.struct(raw.alias("raw"), text.squeeze(F.get(F.get("_meta_decoded", i), F.lit(0))).alias("text")))
    yield dict(_meta_first=F.get(F.filter(plain, lambda d: is_own_description(d["text"])), F.lit(0)))
    first = F.col("_meta_first")
    facts = F.concat(
        _fact(F.col("_meta_brand").isNotNull(), "public_brand", F.col("_meta_brand")),
        _fact(F.col("_meta_canonical").isNotNull(), "official_site", F.col("_meta_canonical")),
        _fact(first.isNotNull(), "site_description", text.cut_at_word(first["text"], fixed.DESCRIPTION_CHARS[1], ",;:"), None, first["raw"]),
    )
    yield dict(_meta_facts=facts)


META = Reader("meta", 2, "structured", _read_meta, _finish_meta)


def meta_facts(pages: DataFrame) -> DataFrame:
    """Brand, canonical address and the homepage's own description."""
    return facts_of(pages, [META])


def canonical_or_null(html: Column) -> Column:
    return F.nullif(F.coalesce(*[text.first_group(html, p) for p in fixed.CANONICAL]), F.lit(""))


def descriptions(html: Column, url: Column) -> Column:
    """Candidate descriptions of a homepage in order of preference; empty for any other page."""
    found = F.filter(F.array(*[text.first_group(html, p) for p in fixed.DESCRIPTION]), lambda d: d.isNotNull())
    return F.when(urls.is_homepage(url), found).otherwise(F.array().cast("array<string>"))


def is_own_description(value: Column) -> Column:
    """At least 40 characters and six words, no junk, and no word of three letters four times."""
    return (
        (F.length(value) >= fixed.DESCRIPTION_CHARS[0]) & (F.size(F.split(value, " ")) >= 6)
        & ~value.rlike(fixed.JUNK_DESCRIPTION) & (text.repeated_word_count(value) < 4)
    )


# --- social links -------------------------------------------------------------------------

def _read_social(asked: Column) -> Steps:
    html = F.col("raw_html")
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?iU)<a\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""), 1)
    widgets = F.regexp_extract_all(html, F.lit(r"""(?iU)\bdata-href\s*=\s*["']([^"']+)["']"""), 1)
    frames = F.regexp_extract_all(html, F.lit(r"""(?iU)<iframe\b[^>]*\bsrc\s*=\s*["']([^"']+)["']"""), 1)

    def parameter(src: Column, name: str) -> Column:
        values = F.filter(F.split(urls.query(src), "&"), lambda p: p.startswith(f"{name}=") & (F.length(p) > len(name) + 1))
        return F.transform(values, lambda p: F.coalesce(F.try_url_decode(F.substr(p, F.lit(len(name) + 2))), p))

    embedded = F.flatten(F.transform(frames, lambda s: F.concat(parameter(s, "href"), parameter(s, "u"))))
    links = F.transform(F.concat(hrefs, widgets, embedded), text.strip)
    likely = F.filter(links, lambda l: l.rlike(r"(?i)\.(?:com)") & ~l.rlike(fixed.SOCIAL_NOT_PROFILE))
    keyed = F.filter(
        F.transform(likely, lambda l, i: F.struct(i.alias("item_ord"), l.alias("link"), social.profile_key(l).alias("key"), registry.as_written(html, l).alias("span"))),
        lambda l: l["key"].isNotNull(),
    )
    yield dict(_social=F.when(asked, keyed), _social_texts=_none("string"))


def _finish_social() -> Steps:
    kept = F.slice(_first_of_each(F.col("_social"), "key"), 1, fixed.TOP_K["social_links"])
    facts = F.transform(kept, lambda l: _fact_struct("company_profile", social.published_form(l["key"]), F.col("context_name"), l["span"]))
    yield dict(_social_facts=facts)


SOCIAL = Reader("social", 3, "structured", _read_social, _finish_social)


def social_facts(pages: DataFrame) -> DataFrame:
    """Profiles a page links: anchors, widget addresses, then addresses inside embed frames; one per
    profile, eight per page."""
    return facts_of(pages, [SOCIAL])


def script_social_facts(pages: DataFrame, entities: DataFrame, found: DataFrame) -> DataFrame:
    """Profiles inside script data whose account resembles the company, minus those already found.
    `entities` is (org_number, legal_name, official_site)."""
    own = pages.filter("linked_from IS NULL AND fetch_state = 'available'").select(
        *PAGE_KEY, "url", "fetched_at", "linked_from", content_hash(F.col("raw_html")).alias("content_hash"),
        F.explode(F.transform(social.script_links(F.col("raw_html")), lambda r, i: F.struct(
            i.alias("item_ord"), r.alias("_raw"), social.profile_key(F.replace(r, F.lit("\\/"), F.lit("/"))).alias("_key")))).alias("_s"),
    )
    keyed = own.select("*", "_s.*").drop("_s").filter("_key IS NOT NULL")
    tokens = entities.filter("legal_name IS NOT NULL AND official_site IS NOT NULL").select(
        "org_number", names.identity_tokens(F.col("legal_name"), F.col("official_site")).alias("_tokens")
    )
    close = keyed.join(tokens, "org_number").filter(social.resembles(F.col("_key"), F.col("_tokens"))).drop("_tokens")
    have = found.filter("field = 'company_profile'").select("org_number", social.profile_key(F.col("value")).alias("_key")).distinct()
    fresh = first_wins(close.join(have, ["org_number", "_key"], "left_anti"), ["org_number", "_key"], ["page_ord", "item_ord"])
    return _facts(
        fresh, 6, "structured", field=F.lit("company_profile"), value=social.published_form(F.col("_key")), evidence_span=F.col("_raw")
    )


# --- feeds and post lists -----------------------------------------------------------------

def is_feed(body: Column) -> Column:
    return F.lower(F.left(body, F.lit(2000))).rlike("<rss|<feed|<rdf:rdf")


def _feed_text(raw: Column) -> Column:
    unwrapped = F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return text.squeeze(text.strip_tags(unwrapped))


def _twice_decoded(df: DataFrame, column: str, out: str) -> DataFrame:
    """Entities decoded, and once more when a source encoded them twice."""
    once = df.withColumn("_once", text.decode_entities(column))
    again = F.when(F.col("_once").rlike(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);"), F.col("_once"))
    return once.withColumn("_again", text.decode_entities(again)).withColumn(out, F.coalesce("_again", "_once")).drop("_once", "_again")


def _read_feed(asked: Column) -> Steps:
    html, url = F.col("raw_html"), F.col("url")
    asked = asked & is_feed(html) & ~urls.path(url).rlike(fixed.PRODUCT_FEED_PATH)

    def read(item: Column) -> Column:
        link = let(F.regexp_extract(item, fixed.FEED_LINK, 1), lambda one: F.when(one != "", one).otherwise(F.regexp_extract(item, fixed.FEED_LINK, 2)))
        return F.struct(
            _feed_text(F.regexp_extract(item, fixed.FEED_DATE, 1)).alias("published"), _feed_text(F.regexp_extract(item, fixed.TITLE, 1)).alias("title"),
            _feed_text(link).alias("link"),
        )

    # what is missing reads as empty, and an item without all three is left out
    items = F.filter(
        F.transform(F.regexp_extract_all(html, F.lit(fixed.FEED_ITEM), 1), read), lambda i: (i["published"] != "") & (i["title"] != "") & (i["link"] != "")
    )
    yield dict(_feed_all=F.when(asked, items), _feed_page=urls.parse(url))
    yield dict(_feed=F.filter("_feed_all", lambda i: urls.is_post_of(i["link"], F.col("_feed_page"))))
    yield dict(_feed_texts=F.transform("_feed", lambda i: i["title"]))


def _finish_feed() -> Steps:
    yield dict(_feed_1=F.transform("_feed", lambda f, i: f.withField("headline", text.plain_headline(F.get(F.get("_feed_decoded", i), F.lit(1))))))
    news = F.slice(F.filter("_feed_1", lambda f: text.is_news_title(f["headline"])), 1, fixed.TOP_K["feed_entries"])
    yield dict(_feed_2=F.transform(news, lambda f: f.withField("day", dates.feed_date(f["published"]))))

    def fact(f: Column) -> Column:
        value = F.concat(f["headline"], F.lit(" ("), F.coalesce(f["day"], f["published"]), F.lit(")"))
        return _fact_struct("dated_activity", text.with_post_link(value, f["link"]), None, f["title"], f["day"])

    yield dict(_feed_facts=F.transform("_feed_2", fact))


FEED = Reader("feed", 0, "structured", _read_feed, _finish_feed, ("feed",))


def feed_facts(pages: DataFrame) -> DataFrame:
    """Dated entries of an RSS or Atom feed: titled, with a post link of their own."""
    return facts_of(pages, [FEED])


def json_escaped(value: Column) -> Column:
    """A string as JSON writes it with every non-ASCII letter escaped."""
    short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def written(c: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(....)", r"\\u$1")
        known = F.get(F.array(*[F.lit(v) for v in short.values()]), F.array_position(F.array(*[F.lit(k) for k in short]), c).cast("int") - 1)
        return F.coalesce(known, units)

    plain = r"[\x20\x21\x23-\x5b\x5d-\x7e]"
    pieces = F.transform(F.regexp_extract_all(value, F.lit(rf"{plain}+|(?s:.)"), 0), lambda c: F.when(c.rlike(plain), c).otherwise(written(c)))
    return F.when(value.rlike(r'[^\x20-\x7e]|["\\]'), F.array_join(pieces, "")).otherwise(value)


def _read_posts(asked: Column) -> Steps:
    html, url, today = F.col("raw_html"), F.col("url"), F.to_date("fetched_at")
    asked = asked & url.contains("/wp-json/wp/v2/posts")
    entries = F.slice(F.coalesce(_array_at(F.try_parse_json(html), "$"), _none("variant")), 1, fixed.TOP_K["news_items"])

    def read(post: Column) -> Column:
        link_node = F.try_variant_get(post, "$.link", "variant")
        return F.struct(
            registry.string_at(post, "$.title.rendered").alias("raw"), F.try_variant_get(post, "$.date", "string").alias("date"),
            F.when(F.schema_of_variant(link_node) == "STRING", F.try_variant_get(post, "$.link", "string")).alias("link"),
        )

    yield dict(_posts_all=F.when(asked, F.filter(F.transform(entries, read), lambda p: p["raw"].isNotNull())))
    spanned = F.transform("_posts_all", lambda p: p.withField("span", registry.json_written(html, p["raw"], json_escaped(p["raw"]))).withField("day", dates.first_date(p["date"], today)))
    yield dict(_posts=spanned, _posts_texts=F.transform("_posts_all", lambda p: p["raw"]))


def _finish_posts() -> Steps:
    url, today = F.col("url"), F.to_date("fetched_at").cast("string")
    titled = F.transform("_posts", lambda p, i: p.withField("title", text.squeeze(text.strip_tags(F.get(F.get("_posts_decoded", i), F.lit(0))))))
    yield dict(_posts_1=titled, _posts_page=urls.parse(url))

    def usable(p: Column) -> Column:
        no_link = F.coalesce(p["link"], F.lit("")) == ""
        return p["day"].isNotNull() & (p["day"] != today) & text.is_news_title(p["title"]) & (no_link | urls.is_post_of(p["link"], F.col("_posts_page")))

    def fact(p: Column) -> Column:
        value = text.with_post_link(F.concat(p["title"], F.lit(" ("), p["day"], F.lit(")")), p["link"])
        return _fact_struct("dated_activity", value, None, p["span"], p["day"])

    yield dict(_posts_facts=F.transform(F.filter("_posts_1", usable), fact))


POSTS = Reader("posts", 0, "structured", _read_posts, _finish_posts, ("posts",))


def post_list_facts(pages: DataFrame) -> DataFrame:
    """Dated posts of a site's structured post list; only its first entries (as many as a site's news items) are looked at."""
    return facts_of(pages, [POSTS])


# --- dated items on ordinary pages --------------------------------------------------------

def _blocks(html: Column) -> Column:
    """Article, list-item and card blocks of a page."""
    pieces = F.split(F.regexp_replace(text.cut_scripts(html), f"({fixed.BLOCK_START})", f"{_MARK}$1"), _MARK)
    return let(pieces, lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))))


def item_blocks(pages: DataFrame, carry: list[str], html: str = "raw_html") -> DataFrame:
    """The blocks of a page as (carry..., block_ord, block)."""
    return pages.select(*carry, F.posexplode(_blocks(F.col(html))).alias("block_ord", "block"))


def _fits(title: Column, limits: tuple[int, int]) -> Column:
    return F.length(title).between(*limits)


def _names_headline(link: Column, label: Column, title: Column) -> Column:
    """A link whose text is or holds the headline, or whose address spells it (twelve characters or more)."""
    key, wanted = F.lower(F.trim(title)), F.left(text.slug(title), F.lit(40))
    by_text = (label != "") & F.contains(F.lower(label), key)
    return by_text | ((F.length(wanted) >= 12) & F.contains(text.slug(link), wanted))


def _read_news(asked: Column) -> Steps:
    """`_news`: the dated blocks with their headings, best label and own post link; `_news_posts`: the page's post links;
    `_news_times`: items of its <time> tags."""
    html, url, today = F.col("raw_html"), F.col("url"), F.to_date("fetched_at")

    def day(block: Column) -> Column:
        return F.coalesce(dates.first_date(text.first_group(block, fixed.TIME_TAG), today), dates.first_date(text.fragment_text(block), today))

    def read(b: Column) -> Column:
        headings = F.transform(F.regexp_extract_all(b["block"], F.lit(fixed.HEADING_1_4), 1), lambda h: text.squeeze(text.strip_tags(h)))
        return F.struct(b["item_ord"].alias("item_ord"), b["day"].alias("day"), F.array_join(headings, _MARK).alias("headings"), anchors(b["block"], url).alias("anchors"))

    def linked(b: Column) -> Column:
        labels = F.filter(F.transform(b["anchors"], lambda a: a["text"]), lambda t: _fits(t, fixed.NEWS_TITLE_CHARS) & dates.first_date(t, today).isNull())
        inside = F.filter(b["anchors"], lambda a: urls.is_post_link(a["link"], url))
        return F.struct(*[b[c].alias(c) for c in ("item_ord", "day", "headings")], F.get(labels, F.lit(0)).alias("label"), F.get(inside, F.lit(0))["link"].alias("inside"))

    yield dict(_news_all=F.when(asked, F.transform(_blocks(html), lambda b, i: F.struct(i.alias("item_ord"), b.alias("block"), day(b).alias("day")))))
    yield dict(_news_dated=F.transform(F.filter("_news_all", lambda b: b["day"].isNotNull() & (b["day"] != today.cast("string"))), read))
    yield dict(_news=F.transform("_news_dated", linked))
    apart = F.exists("_news", lambda b: b["inside"].isNull())
    posts = F.filter(anchors(text.cut_scripts(html), url), lambda a: urls.is_post_link(a["link"], url))
    yield dict(_news_posts=F.when(apart, posts))
    yield from _read_times(asked)
    texts = [F.transform("_news", lambda b: b["headings"]), F.transform("_news", lambda b: b["label"]), F.transform("_news_times", lambda t: t["title"])]
    yield dict(_news_texts=F.concat(*[F.coalesce(t, _none("string")) for t in texts]))


def _finish_blocks() -> Steps:
    """`_news_blocks`: (item_ord, title, day, link, decoded) of the blocks that are news. A block's own link comes first;
    else a link of the page that names the headline."""
    today = F.to_date("fetched_at")

    def form(i: Column, n: int) -> Column:
        return F.get(F.get("_news_decoded", i), F.lit(n))

    def titled(b: Column, i: Column) -> Column:
        headings = F.arrays_zip(F.split(form(i, 0), _MARK).alias("once"), F.split(form(i, 2), _MARK).alias("after"))
        fitting = F.get(F.filter(headings, lambda h: _fits(h["once"], fixed.NEWS_TITLE_CHARS)), F.lit(0))
        label = F.struct(b["label"].alias("once"), form(i + F.size("_news"), 1).alias("after"))
        return b.withField("t", F.coalesce(fitting, F.when(b["label"].isNotNull(), label)))

    yield dict(_news_1=F.transform("_news", titled))
    named = F.filter(F.transform("_news_1", lambda b: F.struct(
        b["item_ord"].alias("item_ord"), b["t"]["once"].alias("title"), b["day"].alias("day"), b["inside"].alias("link"), b["t"]["after"].alias("decoded")
    )), lambda b: b["title"].isNotNull() & text.is_news_title(b["title"]) & dates.first_date(b["title"], today).isNull())
    yield dict(_news_2=named)
    beside = F.transform("_news_2", lambda b: b.withField("link", F.coalesce(
        b["link"], F.get(F.filter("_news_posts", lambda p: _names_headline(p["link"], p["text"], b["title"])), F.lit(0))["link"])).withField("key", F.lower(b["title"])))
    yield dict(_news_3=F.filter(beside, lambda b: b["link"].isNotNull()))
    yield dict(_news_blocks=_first_of_each(F.col("_news_3"), "key"))


def _finish_news() -> Steps:
    yield from _finish_blocks()
    times = F.transform("_news_times", lambda t, i: t.withField("decoded", F.get(F.get("_news_decoded", i + 2 * F.size("_news")), F.lit(1))))
    both = F.when(F.size("_news_blocks") > 0, F.transform("_news_blocks", _item)).otherwise(F.transform(times, _item))
    yield dict(_news_4=F.slice(both, 1, fixed.TOP_K["news_items"]))
    yield dict(_news_5=F.filter(F.transform("_news_4", lambda t: t.withField("headline", text.plain_headline(t["decoded"]))), lambda t: t["headline"] != ""))

    def fact(t: Column) -> Column:
        value = text.with_post_link(F.concat(t["headline"], F.lit(" ("), t["day"], F.lit(")")), t["link"])
        return _fact_struct("dated_activity", value, F.col("context_name"), t["title"], t["day"])

    yield dict(_news_facts=F.transform("_news_5", fact))


def _item(t: Column) -> Column:
    return F.struct(*[t[c].alias(c) for c in ("item_ord", "title", "day", "link", "decoded")])


NEWS = Reader("news", 4, "text", _read_news, _finish_news, ("page",))
_BLOCKS = Reader("news", 4, "text", _read_news, _finish_blocks)


def news_facts(pages: DataFrame) -> DataFrame:
    """Dated headlines of a page's blocks, each with its own post link; where a page has none, its
    <time> tags paired with the nearest heading."""
    return facts_of(pages, [NEWS])


def _item_rows(pages: DataFrame, reader: Reader, items: str) -> DataFrame:
    rows = _read_by(pages, [reader], [items]).select(*PAGE_KEY, F.explode(items).alias("_i"))
    return rows.select(*PAGE_KEY, F.col("_i.item_ord").alias("item_ord"), "_i.title", "_i.day", "_i.link")


def block_items(pages: DataFrame) -> DataFrame:
    """(page key, item_ord, title, day, link) of dated blocks."""
    return _item_rows(pages, _BLOCKS, "_news_blocks")


_AFTER = rf"(?=(.{{0,{fixed.NEARBY_CHARS}}}))"


def _before(chars: int) -> str:
    """Look-behind that captures up to `chars` characters before a match."""
    return rf"(?:(?<=(.{{{chars}}}))|(?<=^(.{{0,{chars - 1}}})))"


def _read_times(asked: Column) -> Steps:
    """`_news_times`: each <time> tag of a page with the nearest heading or link text within 400 characters after it, else
    before it, provided a post link stands there too."""
    html, url, today = F.col("raw_html"), F.col("url"), F.to_date("fetched_at")
    around = r"(?is)(?=<time\b)" + _before(fixed.NEARBY_CHARS) + fixed.TIME_TAG.replace("(?is)", "") + _AFTER
    asked = asked & html.rlike(fixed.TIME_TAG)
    yield dict(_times_html=F.when(asked, text.cut_scripts(html)), _times_page=urls.parse(url))
    groups = [F.regexp_extract_all("_times_html", F.lit(around), g).alias(c) for g, c in enumerate(("far", "near", "at", "after"), 1)]
    tags = F.transform(F.arrays_zip(*groups), lambda t, i: F.struct(
        i.alias("item_ord"), dates.first_date(t["at"], today).alias("day"),
        F.array(t["after"], F.concat(F.coalesce(t["far"], F.lit("")), F.coalesce(t["near"], F.lit("")))).alias("windows"),
    ))
    yield dict(_times=F.filter(tags, lambda t: t["day"].isNotNull() & (t["day"] != today.cast("string"))))

    def side(window: Column) -> Column:
        headings = F.transform(F.regexp_extract_all(window, F.lit(fixed.NEARBY_HEADING), 1), text.fragment_text)
        return F.struct(
            F.get(F.filter(headings, lambda h: _fits(h, fixed.NEWS_TITLE_CHARS) & dates.first_date(h, today).isNull()), F.lit(0)).alias("title"),
            F.filter(anchors(window, url), lambda a: urls.is_post_of(a["link"], F.col("_times_page"))).alias("posts"),
        )

    def linked(s: Column) -> Column:
        naming = F.get(F.filter(s["posts"], lambda a: _names_headline(a["link"], a["text"], s["title"])), F.lit(0))["link"]
        only = F.when(F.size(F.array_distinct(F.transform(s["posts"], lambda a: a["link"]))) == 1, F.get(s["posts"], F.lit(0))["link"])
        return F.struct(s["title"].alias("title"), F.coalesce(naming, only).alias("link"))

    yield dict(_times_1=F.transform("_times", lambda t: t.withField("sides", F.filter(F.transform(t["windows"], side), lambda s: s["title"].isNotNull() & (F.size(s["posts"]) > 0)))))
    nearest = F.transform(F.filter("_times_1", lambda t: F.size(t["sides"]) > 0), lambda t: t.withField("side", linked(F.get(t["sides"], F.lit(0)))))
    yield dict(_times_2=F.transform(nearest, lambda t: F.struct(
        t["item_ord"].alias("item_ord"), t["side"]["title"].alias("title"), t["day"].alias("day"), t["side"]["link"].alias("link"), F.lower(t["side"]["title"]).alias("key"))))
    yield dict(_news_times=F.filter(_first_of_each(F.col("_times_2"), "key"), lambda t: text.is_news_title(t["title"])))


def _only_times(asked: Column) -> Steps:
    yield from _read_times(asked)
    yield dict(_times_texts=_none("string"))


_TIMES = Reader("times", 4, "text", _only_times, lambda: iter(()))


def time_tag_items(pages: DataFrame) -> DataFrame:
    """(page key, item_ord, title, day, link) of <time> tags."""
    return _item_rows(pages, _TIMES, "_news_times")


def dated_lines(pages: DataFrame) -> DataFrame:
    """Short text lines that carry an ISO date and say something besides it."""
    iso = r"\d{4}-\d{2}-\d{2}"
    lines = pages.select(
        *PAGE_KEY, "url", "fetched_at", "linked_from", content_hash(F.col("raw_html")).alias("content_hash"),
        F.posexplode(text.visible_lines(F.col("raw_html"))).alias("item_ord", "_line"),
    ).filter(F.length("_line") <= fixed.FREE_LINE_CHARS).filter(F.col("_line").rlike(iso))
    lines = lines.filter(text.is_headline(F.regexp_replace("_line", iso, " "))).withColumn("_day", F.regexp_extract("_line", iso, 0))
    rest = F.regexp_replace("_line", rf"^(.*?){iso}", "$1 ")
    named = _twice_decoded(lines.withColumn("_rest", rest), "_rest", "_decoded")
    headline = F.trim(text.plain_headline(F.col("_decoded")), F.lit(" -–—:|"))
    named = named.withColumn("_headline", headline).filter("_headline <> ''")
    return _facts(
        named, 5, "text", field=F.lit("dated_activity"), value=F.concat("_headline", F.lit(" ("), "_day", F.lit(")")),
        evidence_span=F.col("_line"), effective_date=F.col("_day"),
    )


# --- careers pages ------------------------------------------------------------------------

def _roles() -> Steps:
    """`_roles`: individual job ads a page lists as array<(item_ord, title, link)>, distinct by address and by
    title. The title is the link's own heading or text, the heading just above a "read more", or the
    first line of a card."""
    url = F.col("url")
    pattern = r"(?is)(?=<a\b)" + _before(fixed.LOOKBACK_CHARS) + fixed.ANCHOR.replace("(?is)", "")
    groups = [F.regexp_extract_all("_careers_html", F.lit(pattern), g).alias(c) for g, c in enumerate(("far", "near", "attrs", "inner"), 1)]
    found = F.transform(F.arrays_zip(*groups), lambda a, i: a.withField("item_ord", i).withField("raw", text.entities_decoded(text.strip(text.first_group(a["attrs"], fixed.HREF)))))
    yield dict(_roles_1=F.filter(found, lambda a: a["raw"].isNotNull() & ~a["raw"].rlike("^(?:#|mailto:|tel:|javascript:)")))
    yield dict(_roles_2=F.transform("_roles_1", lambda a: a.withField("link", urls.absolute(url, a["raw"]))))
    placed = F.transform("_roles_2", lambda a: a.withField("identity", urls.page_identity(a["link"])).withField("host", urls.host(a["link"])))
    yield dict(_roles_3=placed, _roles_base=urls.base_domain(urls.host(url)), _roles_own=urls.page_identity(url))

    def is_ad(a: Column) -> Column:
        board = a["link"].rlike(fixed.JOB_BOARD_AD)
        reachable = (urls.base_domain(a["host"]) == F.col("_roles_base")) | urls.on_any(a["host"], fixed.ATS_HOSTS) | board
        return (a["link"].rlike(fixed.JOB_DETAIL) | board) & ~a["link"].rlike(fixed.NOT_A_ROLE_PATH) & reachable & (a["identity"] != F.col("_roles_own"))

    def titled(a: Column) -> Column:
        return F.struct(a["item_ord"].alias("item_ord"), _role_title(a).alias("title"), a["link"].alias("link"), a["identity"].alias("identity"))

    yield dict(_roles_4=F.transform(F.filter("_roles_3", is_ad), titled))
    yield dict(_roles_5=F.transform(F.filter("_roles_4", lambda a: a["title"].isNotNull() & ~a["title"].rlike(fixed.NAV_LINK_TEXT)
        & ~a["title"].rlike(fixed.BOILERPLATE_TEXT) & ~a["title"].rlike(fixed.AD_SECTION)), lambda a: a.withField("key", F.lower(a["title"]))))
    yield dict(_roles_6=_first_of_each(F.col("_roles_5"), "identity"))
    yield dict(_roles=_first_of_each(F.col("_roles_6"), "key"))


def _role_title(a: Column) -> Column:
    def fitting(value: Column) -> Column:
        return F.when(F.length(value).between(*fixed.ROLE_TITLE_CHARS), value)

    inner = a["inner"]
    label = text.fragment_text(inner)
    heading = fitting(text.fragment_text(text.first_group(inner, fixed.HEADING_INSIDE, 2)))
    above = F.concat(F.coalesce(a["far"], F.lit("")), F.coalesce(a["near"], F.lit("")))
    headings = F.transform(F.regexp_extract_all(above, F.lit(fixed.HEADING_BEFORE), 2), text.fragment_text)
    last_above = fitting(F.try_element_at(headings, F.lit(-1)))
    lines = F.filter(F.transform(F.split(inner, fixed.CARD_SPLIT), text.fragment_text), lambda l: l != "")
    first_line = fitting(F.get(lines, F.lit(0)))
    generic = (label == "") | label.rlike(fixed.GENERIC_LINK_TEXT)
    return F.when(heading.isNotNull(), heading).when(generic, last_above).otherwise(F.coalesce(fitting(label), first_line))


def _read_careers(asked: Column) -> Steps:
    """`_careers_facts`: the listed ads when there are two, or one off-site; else the page itself when it is a single ad."""
    html, url = F.col("raw_html"), F.col("url")
    asked = asked & urls.is_careers_url(url)
    yield dict(_careers_heading=F.when(asked, text.page_heading(html)))
    live = F.col("_careers_heading").isNotNull() & ~F.col("_careers_heading").rlike(fixed.ERROR_PAGE)
    yield dict(_careers_cut=F.when(live, text.cut_scripts(html)))
    yield dict(_careers_live=live & ~text.fragment_text(F.col("_careers_cut")).rlike(fixed.NO_OPENINGS))
    yield dict(_careers_html=F.when(F.col("_careers_live"), F.col("_careers_cut")))
    yield from _roles()
    off_site = F.exists("_roles", lambda r: urls.base_domain(urls.host(r["link"])) != F.col("_roles_base"))
    yield dict(_careers_listing=F.coalesce((F.size("_roles") >= fixed.MIN_ROLE_LINKS) | off_site, F.lit(False)))

    def ad(r: Column) -> Column:
        value = F.concat(F.lit(f"{fixed.ROLE_PREFIX}: "), r["title"], F.lit(" - "), urls.clean_page(r["link"]))
        return _fact_struct("hiring_signal", value, F.col("context_name"), F.coalesce(text.span_for_text(html, r["title"]), r["title"]))

    on_platform = urls.on_any(urls.host(url), fixed.ATS_HOSTS)
    single = (
        ~html.rlike(r'(?iU)"@type"\s*:\s*"JobPosting"') & url.rlike(fixed.JOB_DETAIL)
        & (on_platform | F.col("_careers_heading").rlike(fixed.CAREERS_HEADING))
    )
    alone = _fact(single, "hiring_signal", F.concat(F.lit(f"{fixed.JOB_AD_PREFIX}: "), urls.clean_page(url)), F.col("context_name"), F.col("_careers_heading"))
    facts = F.when(F.col("_careers_listing"), F.transform(F.slice("_roles", 1, fixed.TOP_K["role_ads"]), ad)).otherwise(alone)
    yield dict(_careers_facts=F.when(F.col("_careers_live"), facts), _careers_texts=_none("string"))


CAREERS = Reader("careers", 4, "text", _read_careers, lambda: iter(()), ("careers",))


def careers_facts(pages: DataFrame) -> DataFrame:
    """Open roles of careers pages: the listed ads when there are two, or one off-site; else the page
    itself when it is a single ad. Nothing when it says there are no openings or is an error page."""
    return facts_of(pages, [CAREERS])


# --- main text ----------------------------------------------------------------------------

def repeated_lines(pages: DataFrame, key: list[str], host: str, html: str, shared_by: float = 0.5) -> DataFrame:
    """(host, line) of the lines that more than `shared_by` of a host's pages hold, and two pages at least. A page is one row
    for itself and one per different line; both kinds are counted in one aggregate, before the shuffle."""
    lines = F.transform(F.array_distinct(text.visible_lines(F.col(html))), lambda l: F.struct(l.alias("line"), F.lit(0).alias("page")))
    rows = pages.select(host, F.explode(F.concat(F.array(F.struct(F.lit("").alias("line"), F.lit(1).alias("page"))), lines)).alias("_l"))
    counted = rows.groupBy(host, "_l.line").agg(F.count(F.lit(1)).alias("_on"), F.max("_l.page").alias("_page"))
    counted = materialise(counted.filter("_page = 1 OR _on > 1"), "line-counts")  # read twice, the pages once
    per_host = counted.filter("_page = 1").select(host, F.col("_on").alias("_pages"))  # no visible line is empty
    often = counted.filter("_page = 0").select(host, "line", "_on")
    return salted_join(often, per_host, [host], "inner").filter(F.col("_on") > F.col("_pages") * shared_by).select(host, "line")


def main_text(pages: DataFrame, key: list[str], host: str, html: str, shared_by: float = 0.5) -> DataFrame:
    """(key, ord, line): a page's lines without those that most pages of its host repeat. Lines are
    counted as (host, line) pairs, so a host's pages are never brought together."""
    lines = pages.select(*key, host, F.posexplode(text.visible_lines(F.col(html))).alias("ord", "line"))
    return salted_join(lines, repeated_lines(pages, key, host, html, shared_by), [host, "line"], "left_anti").select(*key, "ord", "line")


def _read_text(asked: Column) -> Steps:
    yield dict(_text=F.when(asked, text.visible_lines(F.col("raw_html"))), _text_texts=_none("string"))


def _finish_text() -> Steps:
    """`page_text` for pages without structured facts: one fact per line."""
    bare = F.coalesce(F.size("_structured_facts"), F.lit(0)) <= 0
    yield dict(_text_facts=F.when(bare, F.transform("_text", lambda l: _fact_struct("page_text", l, None, l))))


TEXT = Reader("text", 1, "text", _read_text, _finish_text, late=True)  # stands beside STRUCTURED


# --- routing ------------------------------------------------------------------------------

def page_kind(url: Column, html: Column) -> Column:
    """feed, posts, careers or page: which extractors read it."""
    return (
        F.when(is_feed(html), "feed").when(url.contains("/wp-json/wp/v2/posts"), "posts")
        .when(urls.is_careers_url(url), "careers").otherwise("page")
    )


def extract(pages: DataFrame) -> DataFrame:
    """Raw facts of every readable page, each page read by the extractors of its kind in one narrow map. Of pages without
    structured facts the text is kept, less the lines that most pages of the host repeat: those are counted first, in a read
    of their own."""
    read = pages.filter("fetch_state = 'available' AND raw_html <> ''").withColumn("_kind", page_kind(F.col("url"), F.col("raw_html")))
    facts = facts_of(read, [FEED, POSTS, STRUCTURED, TEXT, META, SOCIAL, NEWS, CAREERS], routed=True)
    documents = read.filter("_kind IN ('careers', 'page')").withColumn("_host", urls.host(F.col("url")))
    repeated = repeated_lines(documents, PAGE_KEY, "_host", "raw_html").withColumnRenamed("line", "_line")
    # facts that are no text get a key of their own that no host has
    is_text = F.col("field") == "page_text"
    keyed = facts.withColumn("_host", F.when(is_text, urls.host(F.col("source_url"))).otherwise(F.concat_ws(" ", F.lit(""), "org_number", "page_ord")))
    keyed = keyed.withColumn("_line", F.when(is_text, F.col("value")).otherwise(""))
    return salted_join(keyed, repeated, ["_host", "_line"], "left_anti").select(*facts.columns)
