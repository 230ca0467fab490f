"""Company names: normal forms, tokens, and the tests that tie a name to a domain or a page."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed, text, urls
from factloom.functions.let import let


def _words_of(name: Column) -> Column:
    return F.filter(F.split(text.squeeze(name), " "), lambda w: w != "")


def _without(words: Column, stop: list[str]) -> Column:
    return F.filter(words, lambda w: ~w.isin(stop))


def _among(word: Column, choices: list[str]) -> Column:
    return word.isin(choices)


# --- normal forms -------------------------------------------------------------------------

def normalized(name: Column) -> Column:
    return text.squeeze(F.upper(name))


def base(name: Column) -> Column:
    """Upper case, trailing legal forms removed, however many there are."""
    forms = "|".join(fixed.REGISTER_FORMS)
    return F.regexp_replace(normalized(name), rf"(?:(?:^| )(?:{forms})\.*)+$", "")


def strip_legal_form(name: Column) -> Column:
    return F.trim(F.regexp_replace(text.strip(name), fixed.LEGAL_FORM_TAIL, ""))


def employer_tokens(name: Column) -> Column:
    """Upper-case words without punctuation or trailing legal forms."""
    cleaned = text.squeeze(F.regexp_replace(F.upper(name), r"(?U)[^\w\s]|_", " "))
    forms = "|".join(fixed.EMPLOYER_FORMS)
    trimmed = F.regexp_replace(cleaned, rf"(?:(?:^| )(?:{forms}))+$", "")
    return F.filter(F.split(trimmed, " "), lambda w: w != "")


def is_distinctive(tokens: Column) -> Column:
    """Enough to stand for one company: two words, or one long uncommon word."""
    first = F.get(tokens, F.lit(0))
    return (F.size(tokens) >= 2) | (
        (F.size(tokens) == 1) & (F.length(first) >= 5) & ~first.isin(fixed.EMPLOYER_COMMON)
    )


def token_runs(tokens: Column, longest: int) -> Column:
    """Every contiguous run of up to `longest` words, joined with spaces."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)))
    runs = F.flatten(F.transform(
        starts,
        lambda i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(longest), F.greatest(F.size(tokens) - i + 1, F.lit(1)))),
            lambda n: F.array_join(F.slice(tokens, i, n), " "),
        ),
    ))
    return F.array_distinct(F.filter(runs, lambda r: r != ""))


def stem_words(name: Column) -> Column:
    """Folded words without legal forms, for account names."""
    cleaned = F.regexp_replace(text.fold(name), "[^a-z0-9æøå ]", " ")
    return _without(_words_of(cleaned), fixed.ACCOUNT_FORMS)


def stem(name: Column) -> Column:
    """The name without its last word: what sister companies share."""
    words = stem_words(name)
    return F.array_join(F.when(F.size(words) > 1, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words), " ")


def plain(value: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(text.fold(value), "[^a-z0-9]", "")


def site_name_words(name: Column) -> Column:
    """Words of the name as a site shows it, trailing legal and foreign forms removed."""
    forms = "|".join(sorted(set(fixed.STRICT_FORM_WORDS + fixed.FOREIGN_FORM_WORDS), key=len, reverse=True))
    joined = F.array_join(text.folded_words(name), " ")
    return F.filter(F.split(F.regexp_replace(joined, rf"(?:(?:^| )(?:{forms}))+$", ""), " "), lambda w: w != "")


# --- tokens an account or a domain may carry ----------------------------------------------

def _letters(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9æøå]", "")


def identity_tokens(name: Column, site: Column) -> Column:
    """Distinctive name words, the whole name joined, and the domain label; four letters or more."""
    words = _without(F.filter(F.transform(_words_of(name), _letters), lambda w: w != ""), fixed.ACCOUNT_FORMS)
    distinctive = F.filter(words, lambda w: (F.length(w) >= 5) & ~w.isin(fixed.ACCOUNT_COMMON))
    label = urls.label(site)
    from_site = F.when(F.length(label) >= 4, F.array(_letters(label))).otherwise(F.array().cast("array<string>"))
    tokens = F.array_distinct(F.concat(distinctive, F.array(F.array_join(words, "")), F.coalesce(from_site, F.array().cast("array<string>"))))
    return F.filter(tokens, lambda t: F.length(t) >= 4)


def _site_words(name: Column) -> Column:
    cleaned = F.regexp_replace(F.lower(name), r"""[.,!?'"()&+/]""", " ")
    return _without(_words_of(cleaned), fixed.SITE_FORMS)


def _hyphen_trimmed(value: Column) -> Column:
    return F.trim(value, F.lit("-"))


def domain_guesses(name: Column, limit: int = fixed.TOP_K["name_guesses"]) -> Column:
    """Domains the name suggests: joined, hyphenated, first word; .no first, then .com."""
    words = _site_words(name)
    joined = _hyphen_trimmed(text.ascii_slug(F.array_join(words, "")))
    hyphened = _hyphen_trimmed(text.ascii_slug(F.array_join(words, "-")))
    first = text.ascii_slug(F.get(words, F.lit(0)))
    whole = F.filter(F.array(joined, hyphened), lambda s: F.length(s).between(3, 40))
    lead = F.filter(
        F.array(first),
        lambda s: (F.size(words) > 1) & (F.length(s) >= 4) & ~s.isin(fixed.SITE_COMMON),
    )
    slugs = F.array_distinct(F.concat(whole, F.coalesce(lead, F.array().cast("array<string>"))))
    guesses = F.concat(
        F.transform(slugs, lambda s: F.concat(s, F.lit(".no"))),
        F.transform(F.slice(slugs, 1, 1), lambda s: F.concat(s, F.lit(".com"))),
    )
    return F.slice(guesses, 1, limit)


def email_site(email: Column) -> Column:
    """https://<domain> of an address on the company's own domain; NULL for mailbox providers."""
    domain = F.trim(F.lower(text.strip(F.substring_index(email, "@", -1))), F.lit("."))
    parts = F.split(domain, r"\.")
    own = F.when(
        (F.size(parts) > 2) & F.get(parts, F.lit(0)).isin(fixed.MAIL_SUBDOMAINS), F.regexp_replace(domain, r"^[^.]*\.", "")
    ).otherwise(domain)
    usable = email.contains("@") & domain.contains(".") & ~domain.isin(fixed.MAILBOX_HOSTS)
    return F.when(usable, F.concat(F.lit("https://"), own))


# --- does a domain or a page carry the name? ----------------------------------------------

def is_housing_coop(name: Column) -> Column:
    return F.lower(name).rlike("|".join(fixed.COOP_TERMS))


def _initials(words: Column) -> Column:
    lettered = F.filter(words, lambda w: w.rlike(r"(?U)^\p{Alpha}"))
    return F.array_join(F.transform(lettered, lambda w: F.left(w, F.lit(1))), "")


_SPELLINGS = (("ae", "o", "a"), ("ae", "oe", "aa"), ("ae", "o", "aa"), ("e", "oe", "a"))


def domain_resembles(site: Column, name: Column) -> Column:
    """The domain plainly belongs to the name: it holds it, is part of it, holds a word of it, or
    spells its initials (never for a housing co-op). æ, ø and å are tried in four spellings."""
    def judge(u: Column) -> Column:
        label, words = u["label"], u["words"]

        def spelled_like(ae: str, oe: str, aa: str) -> Column:
            folded = F.transform(words, lambda w: text.spelled(w, ae, oe, aa))
            joined = F.array_join(folded, "")
            held = F.contains(label, joined) | ((F.length(label) >= 4) & F.contains(joined, label))
            return held | F.exists(folded, lambda w: (F.length(w) >= 4) & F.contains(label, w))

        hit = reduce(lambda a, b: a | b, [spelled_like(*spelling) for spelling in _SPELLINGS])
        initials = _initials(words)
        spelled = (F.length(initials) >= 3) & label.isin(initials, F.concat(initials, F.lit("as")), F.concat(initials, F.lit("sa")))
        return (label != "") & (F.size(words) > 0) & (hit | (~is_housing_coop(name) & spelled))

    words = _without(F.filter(F.transform(_words_of(name), _letters), lambda w: w != ""), fixed.COOP_WORDS)
    verdict = let(F.struct(_letters(urls.label(site)).alias("label"), words.alias("words")), judge)
    return F.coalesce(site.isNotNull() & (site != "") & verdict, F.lit(False))


def spells_whole_name(domain: Column, name: Column) -> Column:
    """The domain's label is the whole name, joined or hyphenated, six letters or more."""
    words = _site_words(name)
    joined = _hyphen_trimmed(text.ascii_slug(F.array_join(words, "")))
    hyphened = _hyphen_trimmed(text.ascii_slug(F.array_join(words, "-")))
    label = F.substring_index(urls.without_www(F.lower(domain)), ".", 1)
    return F.coalesce((F.length(joined) >= 6) & ((label == joined) | (label == hyphened)), F.lit(False))


def _all_in(core: Column, words: Column) -> Column:
    return F.size(F.array_except(core, words)) == 0


def holds_whole_name(part: Column, name: Column) -> Column:
    """Every distinctive word of the name is in the text, or both are the same letters."""
    core, words = _without(text.folded_words(name), fixed.FORM_WORDS), text.folded_words(part)
    same = F.array_join(core, "") == F.array_join(_without(words, fixed.FORM_WORDS), "")
    return F.coalesce((F.size(core) > 0) & (F.size(words) > 0) & (same | _all_in(core, words)), F.lit(False))


def holds_whole_name_strictly(value: Column, name: Column) -> Column:
    """As above for the text or one part of a "Brand – tagline" title; country words count, group
    words do not."""
    core = _without(text.folded_words(name), fixed.STRICT_FORM_WORDS + fixed.GROUP_WORDS)
    parts = F.concat(F.array(value), F.split(value, fixed.TITLE_SEPARATOR))

    def matches(part: Column) -> Column:
        words = _without(text.folded_words(part), fixed.STRICT_FORM_WORDS)
        same = F.array_join(core, "") == F.array_join(_without(words, fixed.GROUP_WORDS), "")
        return (F.size(words) > 0) & (same | _all_in(core, words))

    return F.coalesce((value != "") & (F.size(core) > 0) & F.exists(parts, matches), F.lit(False))


def domain_spells(site: Column, name: Column) -> Column:
    """The domain is the whole name or its initials, not one word of it."""
    label = urls.label(site)
    core = _without(text.folded_words(name), fixed.FORM_WORDS)
    initials = F.array_join(F.transform(core, lambda w: F.left(w, F.lit(1))), "")
    joined = F.array_join(text.folded_words(label), "")
    by_initials = (F.length(initials) >= 3) & joined.isin(initials, F.concat(initials, F.lit("as")))
    return F.coalesce((site != "") & (holds_whole_name_strictly(label, name) | by_initials), F.lit(False))


def whole_name(name: Column) -> Column:
    """The name without legal forms as a folded phrase; empty when nothing is left."""
    words = _site_words(name)
    return F.when(F.size(words) > 0, text.folded_phrase(F.array_join(words, " "))).otherwise(F.lit(""))


def shows_whole_name(page_text: Column, name: Column) -> Column:
    wanted = whole_name(name)
    return F.coalesce((wanted != "") & F.contains(text.folded_phrase(page_text), wanted), F.lit(False))


def word_coverage(name: Column, candidate: Column) -> Column:
    """Share of the name's distinctive words found in the candidate; 1.0 when none is distinctive."""
    words = F.filter(
        F.split(F.lower(strip_legal_form(name)), "[^0-9a-zæøå]+"), lambda w: (w != "") & ~w.isin(fixed.COVERAGE_COMMON)
    )
    flat = F.regexp_replace(F.lower(candidate), "[^0-9a-zæøå]+", "")
    found = F.size(F.filter(words, lambda w: F.contains(flat, w)))
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(found / F.size(words))


def names_a_sister(name: Column, page_text: Column) -> Column:
    """For a holding, investment or property company: the page names another company of the family
    and never this one. `page_text` is tag-free, lower-case, single-spaced text."""
    lowered = text.squeeze(F.lower(name))
    core = F.trim(F.regexp_replace(lowered, fixed.LEGAL_FORM_TAIL, ""))
    family = F.substring_index(core, " ", 1)
    holding = F.exists(F.split(lowered, " "), lambda w: F.trim(w, F.lit(".,")).isin(fixed.HOLDING_WORDS))
    quoted = F.concat(F.lit(r"\Q"), F.replace(family, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    pattern = F.concat(F.lit(r"(?U)\b"), quoted, F.lit(r"((?:\s+[a-zæøå&\-]+){0,3}?)\s+(?:as|asa)\b"))
    named = F.regexp_extract_all(page_text, pattern, F.lit(1))
    other = F.exists(named, lambda m: F.trim(F.concat(family, m)) != core)
    return F.coalesce(holding & ~F.contains(page_text, core) & other, F.lit(False))


# --- organisation numbers -----------------------------------------------------------------

def is_valid_org_number(number: Column) -> Column:
    """Nine digits whose last one is the modulus-11 check digit."""
    digits = F.transform(F.split(F.left(number, F.lit(8)), ""), lambda d: d.try_cast("int"))
    weighted = F.zip_with(digits, F.array(*[F.lit(w) for w in fixed.ORG_WEIGHTS]), lambda d, w: d * w)
    check = 11 - F.aggregate(weighted, F.lit(0), lambda acc, x: acc + x) % 11
    expected = F.when(check == 11, 0).otherwise(check)
    return F.coalesce(
        number.rlike(r"^\d{9}$") & (check != 10) & (expected == F.substr(number, F.lit(9), F.lit(1)).try_cast("int")),
        F.lit(False),
    )


def spaced_number(number: Column) -> Column:
    return F.concat_ws(" ", F.substring(number, 1, 3), F.substring(number, 4, 3), F.substring(number, 7, 3))


def numbers_in(value: Column) -> Column:
    """Nine-digit numbers in a text, with or without the usual spacing."""
    hits = F.regexp_extract_all(value, F.lit(fixed.SPACED_NUMBER), 0)
    return F.transform(hits, lambda n: F.regexp_replace(n, r"\D", ""))


def stated_numbers(html: Column) -> Column:
    """Organisation numbers the page states as such, check digit verified."""
    flat = F.replace(F.replace(text.strip_tags(html), F.lit("&nbsp;"), F.lit(" ")), F.lit("&#160;"), F.lit(" "))
    hits = F.regexp_extract_all(flat, F.lit(fixed.STATED_NUMBER), 0)
    digits = F.transform(hits, lambda h: F.right(F.regexp_replace(h, r"\D", ""), F.lit(9)))
    return F.array_distinct(F.filter(digits, is_valid_org_number))


def states_another_number(html: Column, own: Column) -> Column:
    """A labelled number on the page that is not this company's."""
    hits = F.regexp_extract_all(text.strip_tags(html), F.lit(fixed.LABELLED_NUMBER), 1)
    digits = F.transform(hits, lambda h: F.regexp_replace(h, r"(?U)\s", ""))
    return F.coalesce(F.exists(digits, lambda n: (F.length(n) == 9) & (n != own)), F.lit(False))


def shows_own_number(html: Column, own: Column) -> Column:
    """The page shows the number, whatever the spacing."""
    return F.contains(F.regexp_replace(text.strip_tags(html), r"(?U)\s", ""), own)
