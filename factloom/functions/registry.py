"""Expressions over registry records and the texts published from them."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed, text, urls
from factloom.functions.let import let


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def string_at(doc: Column, json_path: str) -> Column:
    """A text property: anything that is not a non-empty JSON string counts as absent."""
    node = F.try_variant_get(doc, json_path, "variant")
    return F.when(F.schema_of_variant(node) == "STRING", F.nullif(F.try_variant_get(doc, json_path, "string"), F.lit("")))


def string_of(node: Column) -> Column:
    """`string_at` for a property that is already read."""
    return F.when(F.schema_of_variant(node) == "STRING", F.nullif(F.try_variant_get(node, "$", "string"), F.lit("")))


def number_at(doc: Column, json_path: str) -> Column:
    """A numeric property: never a boolean, never a number written as text, never zero-filled."""
    node = F.try_variant_get(doc, json_path, "variant")
    numeric = F.schema_of_variant(node).rlike("^(?:BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(numeric, F.try_variant_get(doc, json_path, "double"))


def address_line(address: Column) -> Column:
    """`Street 1, 0123 TOWN` from struct(adresse, postnummer, poststed); NULL when nothing is given."""
    place = F.concat_ws(" ", blank_to_null(address["postnummer"]), blank_to_null(address["poststed"]))
    lines = F.filter(F.coalesce(address["adresse"], F.array().cast("array<string>")), lambda l: l.isNotNull() & (l != ""))
    return F.nullif(F.array_join(F.filter(F.concat(lines, F.array(place)), lambda p: p != ""), ", "), F.lit(""))


def site_with_scheme(site: Column) -> Column:
    return F.when(site.rlike("(?i)^https?://"), site).when(site != "", F.concat(F.lit("https://"), site))


def registered_website(value: Column) -> Column:
    """The registry's free-text website as a URL; NULL for e-mails, words and social profiles."""
    cleaned = text.strip(value)
    url = site_with_scheme(cleaned)
    host = F.substring_index(urls.authority(url), ":", 1)
    usable = ~cleaned.contains(" ") & ~cleaned.contains("@") & cleaned.contains(".") & host.contains(".")
    return F.when(usable & ~urls.on_any(host, fixed.SOCIAL_HOSTS), url)


def operating_status(bankrupt: Column, liquidating: Column, flags_present: Column) -> Column:
    """Bankrupt before liquidation before active; nothing when the record carries no flag at all."""
    return F.when(
        flags_present,
        F.when(F.coalesce(bankrupt, F.lit(False)), "Bankrupt")
        .when(F.coalesce(liquidating, F.lit(False)), "In liquidation")
        .otherwise("Active"),
    )


def registered_description(activity: Column, purpose: Column) -> Column:
    """The registered activity, else the statutory purpose: 15 characters at least, cut at 400."""

    def joined(lines: Column) -> Column:
        value = text.squeeze(F.array_join(lines, " "))
        return F.when(F.length(value) >= 15, text.cut_at_word(value, 400, ",;"))

    return F.coalesce(joined(activity), joined(purpose))


def industry_code_text(code: Column, label: Column) -> Column:
    return F.nullif(F.concat_ws(" ", blank_to_null(code), blank_to_null(label)), F.lit(""))


def workplace_text(name: Column, address: Column, municipality: Column, employees: Column) -> Column:
    """`NAME, Street 1, 0123 TOWN (3 ansatte)`; the municipality only when there is no address."""
    staff = F.concat(employees.cast("string"), F.lit(" ansatte"))
    detail = F.concat_ws(", ", F.when(address.isNull(), blank_to_null(municipality)), staff)
    head = F.when(address.isNotNull(), F.concat(name, F.lit(", "), address)).otherwise(name)
    return F.when(name != "", F.when(detail != "", F.concat(head, F.lit(" ("), detail, F.lit(")"))).otherwise(head))


def own_location_text(name: Column, address: Column) -> Column:
    return F.when(blank_to_null(address).isNotNull(), F.concat(name, F.lit(" ("), F.trim(address), F.lit(")"))).otherwise(name)


def town_of_workplace(value: Column) -> Column:
    """`ACME, Hammergata 20, 3264 LARVIK (12 ansatte)` -> `Larvik`."""
    by_postcode = r"(?U)\b\d{4}\s+([A-ZÆØÅa-zæøå][\w .'-]*?)(?:\s*\(|,|$)"
    in_brackets = r"(?U)\(([A-ZÆØÅ][\wÆØÅæøå .'-]*?)(?:,|\))"
    found = F.coalesce(text.first_group(value, by_postcode), text.first_group(value, in_brackets))
    return F.initcap(F.trim(found))


def person_name(first: Column, middle: Column, last: Column) -> Column:
    return F.nullif(
        F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(middle, F.lit("")), F.nullif(last, F.lit(""))), F.lit("")
    )


def role_value(holder: Column, title: Column, holder_number: Column) -> Column:
    detail = F.concat_ws(", ", F.nullif(title, F.lit("")), F.concat(F.lit("org. no. "), holder_number))
    return F.when(detail != "", F.concat(holder, F.lit(" ("), detail, F.lit(")"))).otherwise(holder)


_IN_BRACKETS = r"(?s)^(.*) \((.*)\)$"


def role_holder(value: Column) -> Column:
    """`Roger Tveide` of `Roger Tveide (Daglig leder)`."""
    return F.when(value.rlike(_IN_BRACKETS), F.regexp_extract(value, _IN_BRACKETS, 1)).otherwise(value)


def role_inner(value: Column) -> Column:
    return F.regexp_extract(value, _IN_BRACKETS, 2)


def role_name(value: Column) -> Column:
    """The role alone, lower case: what stands in the last brackets before a comma."""
    return F.lower(F.trim(F.substring_index(role_inner(value), ",", 1)))


def role_in_english(value: Column) -> Column:
    """`Roger Tveide (Daglig leder)` -> `Roger Tveide (managing director)`."""
    table = F.create_map(*[F.lit(x) for pair in fixed.ROLE_TEXT.items() for x in pair])
    inner = F.trim(role_inner(value))
    translated = F.coalesce(F.element_at(table, F.lower(inner)), inner)
    return F.when(value.rlike(_IN_BRACKETS), F.concat(role_holder(value), F.lit(" ("), translated, F.lit(")"))).otherwise(value)


def without_role(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s*\([^)]*\)\s*$", ""))


def role_group(value: Column) -> Column:
    """`managing director`, `board` or NULL."""
    role = F.when(value.endswith(")"), role_name(value)).otherwise(F.lit(""))
    return F.when(role == "daglig leder", "managing director").when(role.isin(fixed.BOARD_ROLES), "board")


def industry_text(industry: Column, english: Column) -> Column:
    """The industry in words: the official English label when there is one, the code removed, 70 characters."""
    coded = r"(?U)^\d{2}\.\d{2,3}\s+"
    code = F.substring_index(industry, " ", 1)
    wording = F.when(industry.rlike(coded) & english.isNotNull(), F.concat(code, F.lit(" "), english)).otherwise(industry)
    return text.lower_first(text.cut_at_word(text.strip(F.regexp_replace(wording, coded, "")), 70, ",;"))


def source_label(url: Column, linked_from: Column) -> Column:
    """A source in plain words."""
    u = F.coalesce(url, F.lit(""))
    year = F.regexp_extract(u, r"(?:år|%C3%A5r)=(\d{4})", 1)
    host = F.when(u.contains("://"), urls.without_www(urls.authority(u))).otherwise(u)
    centre = F.lit("Brønnøysund Register Centre: ")
    return (
        F.when(
            u.contains("regnskapsregisteret"),
            F.when(year != "", F.concat(F.lit("Register of Company Accounts: FY"), year, F.lit(" accounts")))
            .otherwise(F.lit("Register of Company Accounts (Brønnøysund)")),
        )
        .when(u.contains("data.brreg.no") & u.contains("/roller"), F.concat(centre, F.lit("roles")))
        .when(u.contains("data.brreg.no") & u.contains("underenheter"), F.concat(centre, F.lit("sub-units")))
        .when(u.contains("data.brreg.no") & u.contains("oppdateringer"), F.concat(centre, F.lit("update log")))
        .when(u.contains("data.brreg.no"), F.concat(centre, F.lit("entity record")))
        .when(u.contains("arbeidsplassen.nav.no"), F.lit("NAV job board (arbeidsplassen.nav.no)"))
        .when(linked_from.isNotNull() & (linked_from != ""), F.concat(F.lit("Page linked from the company's website ("), host, F.lit(")")))
        .when(u.contains("://"), F.concat(F.lit("Company website ("), host, F.lit(")")))
        .otherwise(host)
    )


# --- verbatim quotes from a response body -------------------------------------------------

def _quoted(value: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _quote(body: Column, pattern: Column) -> Column:
    return F.nullif(F.regexp_extract(body, pattern, 0) if isinstance(pattern, str) else F.regexp_substr(body, pattern), F.lit(""))


def quote_string(body: Column, key: str, value: Column) -> Column:
    """`"key":"value"` as the JSON writes it, NULL when it is not there."""
    return _quote(body, F.concat(F.lit(rf'"{key}"\s*:\s*"'), _quoted(value), F.lit('"')))


def quote_object(body: Column, key: str) -> Column:
    """`"key":{...}` for a flat object."""
    return _quote(body, F.lit(rf'"{key}"\s*:\s*\{{[^{{}}]*\}}'))


def quote_array(body: Column, key: str) -> Column:
    return _quote(body, F.lit(rf'"{key}"\s*:\s*\[[^\]]*\]'))


def number_found(body: Column, key: str, value: Column) -> Column:
    """`"key":753009000.00` for a figure read as `value`, empty when it is not there."""
    whole = value.cast("decimal(38,0)").cast("string")
    pattern = F.concat(F.lit(rf'"{key}"\s*:\s*'), _quoted(whole), F.lit(r"(?:\.0+)?(?![\d.])"))
    return F.call_function("regexp_extract", body, pattern, F.lit(0))


def _any_number(key: str) -> str:
    return rf'"{key}"\s*:\s*(?:-?[\d.eE+]+|"[^"]*")'


def quote_any_number(body: Column, key: str) -> Column:
    """The first figure written under `key`."""
    return _quote(body, F.lit(_any_number(key)))


def any_number_found(body: Column, key: str) -> Column:
    """`quote_any_number`, empty when it is not there."""
    return F.regexp_extract(body, _any_number(key), 0)


def quote_flag(body: Column, key: Column) -> Column:
    return _quote(body, F.concat(F.lit('"'), key, F.lit(r'"\s*:\s*(?:true|false)')))


def quote_person(body: Column, first: Column, last: Column) -> Column:
    """A person's first and last name as written, in either key order."""
    given = F.concat(F.lit(r'"fornavn"\s*:\s*"'), _quoted(first), F.lit('"'))
    family = F.concat(F.lit(r'"etternavn"\s*:\s*"'), _quoted(last), F.lit('"'))
    gap = F.lit(r"[^{}]*?")
    return F.coalesce(_quote(body, F.concat(family, gap, given)), _quote(body, F.concat(given, gap, family)))


def as_written(page: Column, link: Column) -> Column:
    """A link exactly as the page source writes it: plain, with escaped slashes, or URL-encoded."""
    escaped = F.replace(link, F.lit("/"), F.lit("\\/"))
    encoded = F.replace(F.url_encode(link), F.lit("+"), F.lit("%20"))
    return F.coalesce(
        *[F.when(F.contains(page, form), form) for form in (link, escaped, encoded, F.lower(encoded))]
    )


def json_written(body: Column, value: Column, escaped_value: Column) -> Column:
    """A decoded JSON string as the response writes it: non-ASCII letters and slashes may be escaped."""
    def read(escaped: Column) -> Column:
        forms = [escaped, F.replace(escaped, F.lit("/"), F.lit("\\/")), value, F.replace(value, F.lit("/"), F.lit("\\/"))]
        return F.coalesce(*[F.when(F.contains(body, form), form) for form in forms], value)

    return let(escaped_value, read)
