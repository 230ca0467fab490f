"""URL filters: domain rules, then a weighted vocabulary counted by an Aho-Corasick automaton.

A term counts where neither neighbour is a letter or digit (characters beyond ASCII count as letters). One strict term
rejects a URL, and so do `soft_limit` different soft terms. Rules come first: the longest rule that fits decides."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import table
from factloom.llm.registry import query

STRICT = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT = (
    "ads", "bet", "bets", "betting", "bonus", "cam", "cheap", "crack", "dating", "farm", "free", "gamble", "jackpot", "keygen", "loan",
    "nude", "pharmacy", "pills", "poker", "prize", "replica", "sex", "slots", "torrent", "track", "win",
)
SOFT_LIMIT = 2
#: (rule, verdict): host up to the first "/", then the beginning of the path.
RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)


def _letter(c: str) -> bool:
    return "0" <= c <= "9" or "a" <= c <= "z" or c > "\x7f"


@dataclass(frozen=True)
class UrlFilter:
    """Rules and vocabulary, both small parameters that travel with the tasks."""

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    soft_limit: int = SOFT_LIMIT
    rules: tuple[tuple[str, str], ...] = RULES

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, strict in [*((t, False) for t in self.soft), *((t, True) for t in self.strict)]:
            found.add_word(term, (term, strict))
        if len(found):
            found.make_automaton()
        return found

    def by_host(self) -> dict[str, list[tuple[str, str, str]]]:
        hosts: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in self.rules:
            host, slash, path = rule.partition("/")
            hosts.setdefault(host, []).append((slash + path, rule, verdict))
        return hosts


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode().lower().decode(), path


def fitting_rule(host: str, path: str, rules: dict) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits the host or a domain above it."""
    best, at = None, 0
    while host and at >= 0:
        for prefix, rule, verdict in rules.get(host[at:], ()):
            if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
        at = host.find(".", at) + 1 or -1
    return best


def term_hits(url: str, automaton: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Different strict and soft terms that stand free in the URL."""
    strict: set[str] = set()
    soft: set[str] = set()
    text = url.encode().lower().decode()
    for end, (term, is_strict) in automaton.iter(text) if len(automaton) else ():
        start = end - len(term) + 1
        if (start == 0 or not _letter(text[start - 1])) and (end + 1 == len(text) or not _letter(text[end + 1])):
            (strict if is_strict else soft).add(term)
    return strict, soft


def judge_urls(df: DataFrame, id_column: str, url_column: str, settings: UrlFilter = UrlFilter()) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict (allow or block), n_strict and n_soft (different terms).

    A null URL has an empty host and path, no terms, and is allowed. One narrow map, no shuffle."""
    kind = df.schema[id_column].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, rules = settings.automaton(), settings.by_host()
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                strict, soft = term_hits(url or "", automaton)
                rejected = bool(strict) or len(soft) >= settings.soft_limit
                rule, verdict = fitting_rule(host, path, rules) or (None, "block" if rejected else "allow")
                rows.append((host, path, rule, verdict, len(strict), len(soft)))
            host, path, rule, verdict, n_strict, n_soft = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in (host, path, rule, verdict)), *(pa.array(c, pa.int64()) for c in (n_strict, n_soft))],
                names=["id", "host", "path", "rule", "verdict", "n_strict", "n_soft"],
            )

    return df.select(id_column, url_column).mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, n_strict long, n_soft long")


def _hits(terms: tuple[str, ...]) -> str:
    edge = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
    lowered = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return " + ".join(f"CAST(regexp_matches({lowered}, '(^|{edge}){t}($|{edge})') AS BIGINT)" for t in terms)


_FITS = " UNION ALL ".join(
    f"SELECT page_id, '{rule}' AS rule, '{verdict}' AS verdict FROM parts WHERE (host = '{rule.partition('/')[0]}' "
    f"OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')"
    for rule, verdict in RULES
)

SQL = rf"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
         {_hits(STRICT)} AS n_strict, {_hits(SOFT)} AS n_soft
  FROM pages
), fits AS ({_FITS}),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id)
SELECT p.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN n_strict > 0 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
FROM parts p LEFT JOIN best USING (page_id)"""


@query("op6_url_filter", SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), "page_id", "url").withColumnRenamed("id", "page_id")
