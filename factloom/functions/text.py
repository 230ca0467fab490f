"""Text and markup expressions."""
from __future__ import annotations

import html as html_lib
import html.entities  # noqa: F401
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import fixed
from factloom.functions.let import let

# Accented Latin letters and their base letter, by Unicode decomposition.
_ACCENTED = [
    (chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)
    if unicodedata.normalize("NFKD", chr(c))[0].isascii() and unicodedata.normalize("NFKD", chr(c)) != chr(c)
]


def squeeze(text: Column) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cut_scripts(html: Column) -> Column:
    return F.regexp_replace(html, fixed.SCRIPT_STYLE, " ")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, fixed.TAG, " ")


def visible_text(html: Column) -> Column:
    return squeeze(strip_tags(cut_scripts(html)))


def body_text(html: Column) -> Column:
    """Visible text with `noscript` blocks cut as well."""
    return squeeze(strip_tags(F.regexp_replace(html, fixed.SCRIPT_STYLE_NOSCRIPT, " ")))


def visible_lines(html: Column) -> Column:
    """One line per paragraph, list item or heading."""
    marked = F.regexp_replace(cut_scripts(html), r"(?iU)</(li|p|h[1-6])\s*>", "␞")
    lines = F.transform(F.split(strip_tags(marked), "␞"), squeeze)
    return F.filter(lines, lambda line: line != "")


# The named characters of HTML 4 and other spellings of them, and the names that may stand without a semicolon, longest first.
_NAMES = {*html_lib.entities.name2codepoint, *(n for n in html_lib.entities.html5 if not n.endswith(";")), "apos"}
_NAMED = ",".join(f"{name}={ord(html_lib.entities.html5[name + ';'])}" for name in sorted(_NAMES))
_WHOLE_NAME = "(?:" + "|".join(sorted(_NAMES)) + ")"
_BARE_NAME = "^(?:" + "|".join(sorted((n for n in html_lib.entities.html5 if not n.endswith(";")), key=len, reverse=True)) + ")"
# Numbers from 128 to 159 mean Windows-1252; the five without a character there keep their own.
_C1 = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)]


def _character(code: Column) -> Column:
    """The character of a number; a number of no character reads as U+FFFD or vanishes."""
    def read(c: Column) -> Column:
        vanish = c.between(1, 8) | (c == 11) | c.between(14, 31) | (c == 127) | c.between(0xFDD0, 0xFDEF) | (c.bitwiseAND(0xFFFE) == 0xFFFE)
        plain = F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        return (
            F.when(c.isNull() | (c == 0) | c.between(0xD800, 0xDFFF) | (c > 0x10FFFF), "\ufffd").when(vanish, "")
            .when(c.between(0x80, 0x9F), F.get(F.array(*[F.lit(x) for x in _C1]), (c - 0x80).cast("int"))).otherwise(plain)
        )

    return let(code, read)


def _after_ampersand(part: Column) -> Column:
    """What follows an ampersand, with the entity at its start decoded; the ampersand comes back where there is none."""
    found = F.regexp_extract(part, rf"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|{_WHOLE_NAME};)", 0)

    def read(entity: Column) -> Column:
        digits = F.ltrim(F.regexp_extract(entity, r"^#[xX]?([0-9a-fA-F]+)", 1), F.lit("0"))
        base = F.when(entity.rlike("^#[xX]"), 16).otherwise(10)
        number = F.when(digits == "", 0).when(F.length(digits) <= 8, F.conv(digits, 16, 10).cast("bigint"))
        decimal = F.when(digits == "", 0).when(F.length(digits) <= 8, F.conv(digits, 10, 10).cast("bigint"))
        named = F.try_element_at(F.str_to_map(F.lit(_NAMED), F.lit(","), F.lit("=")), F.substring_index(entity, ";", 1)).cast("bigint")
        code = F.when(~F.startswith(entity, F.lit("#")), named).when(base == 16, number).otherwise(decimal)
        bare = F.regexp_extract(part, _BARE_NAME, 0)
        return F.when(F.startswith(entity, F.lit("#")) | named.isNotNull(), F.concat(_character(code), part.substr(F.length(entity) + 1, F.length(part)))).otherwise(F.concat(F.lit("&"), part))

    return let(F.when(found != "", found).otherwise(F.regexp_extract(part, _BARE_NAME, 0)), read)


def entities_decoded(text: Column) -> Column:
    """Numeric HTML entities of every form and the named ones of HTML 4, with or without their semicolon, decoded in the JVM."""
    def decode(t: Column) -> Column:
        parts = F.split(t, "&", -1)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _after_ampersand), ""))

    return F.when(F.contains(text, F.lit("&")), let(text, decode)).otherwise(text)


@F.pandas_udf(T.StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """The full HTML entity table (2,231 names and every numeric form); no Spark builtin has it."""
    return text.map(lambda t: html_lib.unescape(t) if t is not None and "&" in t else t)


@F.pandas_udf(T.ArrayType(T.StringType()))
def decode_all_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: None if ts is None else [html_lib.unescape(t) if t and "&" in t else t for t in ts])


def fragment_text(fragment: Column) -> Column:
    """Markup of a fragment as readable text, entities decoded."""
    return squeeze(entities_decoded(strip_tags(fragment)))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """The captured group of the first match, NULL when nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def page_heading(html: Column) -> Column:
    """The title, else the first h1, as the page writes it."""
    cleaned = cut_scripts(html)

    def readable(pattern: str) -> Column:
        return F.nullif(fragment_text(first_group(cleaned, pattern)), F.lit(""))

    return F.coalesce(readable(fixed.TITLE), readable(fixed.H1))


def head_text(html: Column) -> Column:
    """Title and the opening of the visible text, where a parking page says what it is."""
    title = F.coalesce(first_group(html, r"(?is)<title[^>]*>(.*?)</title>"), F.lit(""))
    return F.concat(title, F.lit(" "), F.left(body_text(html), F.lit(2000)))


def text_nodes(html: Column) -> Column:
    """Non-blank text nodes as the source writes them."""
    nodes = F.regexp_extract_all(cut_scripts(html), F.lit(r">([^<>]+)<"), 1)
    return F.filter(nodes, lambda n: squeeze(n) != "")


def plain_node(node: Column) -> Column:
    return squeeze(entities_decoded(node))


def strip(text: Column) -> Column:
    """Whitespace of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def node_span(html: Column, test, anchor: Column | None = None) -> Column:
    """The first text node whose plain text passes `test`, verbatim, cut to a window around `anchor`."""
    node = strip(F.get(F.filter(text_nodes(html), lambda n: test(plain_node(n))), F.lit(0)))
    start = F.lit(1)
    if anchor is not None:
        at = F.regexp_instr(node, anchor)
        start = F.when(at > 0, F.greatest(at - fixed.SPAN_CHARS // 2, F.lit(1))).otherwise(1)
    return F.when(F.length(node) <= fixed.SPAN_CHARS, node).otherwise(F.substr(node, start, F.lit(fixed.SPAN_CHARS)))


def span_for_text(html: Column, text: Column) -> Column:
    """The node that is the text, else the longest node that is part of it."""
    target = F.lower(plain_node(text))
    nodes = F.transform(text_nodes(html), lambda n: F.struct(F.lower(plain_node(n)).alias("plain"), strip(n).alias("raw")))
    exact = F.get(F.filter(nodes, lambda n: n["plain"] == target), F.lit(0))["raw"]
    inside = F.filter(nodes, lambda n: (F.length(n["plain"]) >= 3) & F.contains(target, n["plain"]))
    longest = F.aggregate(
        inside,
        F.struct(F.lit("").alias("plain"), F.lit(None).cast("string").alias("raw")),
        lambda best, n: F.when(F.length(n["plain"]) > F.length(best["plain"]), n).otherwise(best),
    )["raw"]
    return F.coalesce(exact, longest)


# --- cutting ------------------------------------------------------------------------------

def cut_at_word(text: Column, limit: int, trailing: str) -> Column:
    """At most `limit` characters, ending at a word, trailing punctuation dropped, ` ...` appended."""
    head = F.regexp_replace(F.left(text, F.lit(limit)), " [^ ]*$", "")
    return F.when(F.length(text) > limit, F.concat(F.rtrim(head, F.lit(trailing)), F.lit(" ..."))).otherwise(text)


def opening(text: Column, limit: int = 110) -> Column:
    """The opening of a long text: cut at the last clause past 40 characters, else at a word."""
    body = F.rtrim(text, F.lit(". "))
    cut = F.left(body, F.lit(limit))
    clause = F.length(F.regexp_extract(cut, r"(?s)^(.*)[,;] ", 1))
    head = F.when(clause >= 40, F.left(cut, clause)).otherwise(F.regexp_replace(cut, " [^ ]*$", ""))
    return F.when(F.length(body) <= limit, body).otherwise(F.concat(F.rtrim(head, F.lit(",; ")), F.lit(" ...")))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


# --- folding ------------------------------------------------------------------------------

def fold(text: Column) -> Column:
    """Lower case with æ, ø and å spelled ae, o and a."""
    return spelled(F.lower(text), "ae", "o", "a")


def spelled(text: Column, ae: str, oe: str, aa: str) -> Column:
    for letter, spelling in (("æ", ae), ("ø", oe), ("å", aa)):
        text = F.replace(text, F.lit(letter), F.lit(spelling))
    return text


def ascii_slug(text: Column) -> Column:
    """Lower-case ASCII letters, digits and hyphens only; accents dropped."""
    based = F.translate(spelled(text, "ae", "o", "a"), "".join(a for a, _ in _ACCENTED), "".join(b for _, b in _ACCENTED))
    return F.regexp_replace(F.lower(based), "[^a-z0-9-]", "")


def folded_words(text: Column) -> Column:
    """Folded ASCII words as an array."""
    return F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), 0)


def folded_phrase(text: Column) -> Column:
    """Folded words in one string with a space on either side, for whole-word containment."""
    return F.concat(F.lit(" "), F.array_join(folded_words(text), " "), F.lit(" "))


def slug(text: Column) -> Column:
    return F.array_join(folded_words(text), "-")


# --- headlines ----------------------------------------------------------------------------

def without_post_link(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\s+-\s+https?://\S+$", "")


def with_post_link(value: Column, link: Column) -> Column:
    ok = F.coalesce(link.rlike(r"(?U)^https?://\S+$"), F.lit(False))
    return F.when(ok, F.concat(value, F.lit(" - "), link)).otherwise(value)


def is_headline(title: Column) -> Column:
    """Says something: not a section label, and at least eight letters."""
    letters = F.regexp_replace(F.regexp_replace(title, r"(?U)&#?\w+;", " "), "[^A-Za-zÆØÅæøåÄÖäöÜü]", "")
    return ~strip(title).rlike(fixed.SECTION_LABEL) & (F.length(letters) >= 8)


def is_news_title(title: Column) -> Column:
    """A headline of two words or more that is no navigation label, sample post or spec list."""
    words = F.filter(F.split(squeeze(title), " "), lambda w: w.rlike(r"(?U)\w"))
    bare = F.trim(title, F.lit(" .:-–|"))
    slashes = F.length(title) - F.length(F.replace(title, F.lit("/"), F.lit("")))
    return (
        is_headline(title) & (F.size(words) >= 2) & ~bare.rlike(fixed.NAV_TITLE)
        & ~title.rlike(fixed.PLACEHOLDER_TITLE) & (slashes < 3)
    )


def plain_headline(decoded: Column) -> Column:
    """A decoded headline without the date printed in front of it."""
    return squeeze(F.regexp_replace(decoded, fixed.LEADING_DATE, ""))


def repeated_word_count(text: Column) -> Column:
    """How often the most repeated word of three letters or more occurs."""
    words = F.array_sort(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w{3,}"), 0))
    runs = F.aggregate(
        words,
        F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda acc, w: F.struct(
            w.alias("word"),
            F.when(acc["word"] == w, acc["run"] + 1).otherwise(1).alias("run"),
            F.greatest(acc["best"], F.when(acc["word"] == w, acc["run"] + 1).otherwise(1)).alias("best"),
        ),
    )
    return runs["best"]
