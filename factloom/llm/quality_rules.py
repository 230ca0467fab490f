"""Quality rules as a ledger: every rule is evaluated once per document, its failure is a bit and its measurements are
columns. A policy is a set of rules; applying it, or asking what one rule alone would change, is bit arithmetic over
the written ledger and never reads a text again."""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table, written
from factloom.llm.registry import query

#: (name, failure as SQL over the measurements). The place in this list is the bit; rules are only ever appended.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
)
BASE_RULES = ("few_words", "repeated_words")
#: Versioned policies. A document is kept when none of a policy's bits is set.
POLICIES = {
    "base": BASE_RULES,
    "v1": (*BASE_RULES, "short_words", "long_words", "symbols"),
    "v2": (*BASE_RULES, "short_words", "long_words", "symbols", "repeated_lines"),
}
CURRENT = "v2"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(seen) < len(words) - 2:
        end = 0
        for i, window in enumerate(zip(words, words[1:], words[2:])):
            if seen[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    lines = Counter(line for line in raw.split(b"\n") if line.split())
    n_lines = sum(lines.values())
    return len(words), len(text) - len(_SPACE.findall(text)), len(_SYMBOL.findall(text)), n_lines, n_lines - len(lines), repeated


def bit(name: str) -> int:
    return 1 << [n for n, _ in RULES].index(name)


def mask(policy: str) -> int:
    return sum(bit(name) for name in POLICIES[policy])


def ledger(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per input row: id, the measurements, and `failures`, a bit per rule of RULES.

    A null text has no words and fails `few_words`. Repeated rows each get a row. A narrow map, no shuffle."""
    kind = df.schema[id_column].dataType.simpleString()
    names = MEASURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(text or "") for text in batch.column(1).to_pylist()]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["id", *names])

    measured = df.select(id_column, text_column).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names))
    return measured.withColumn("failures", F.expr(_FAILURES))


#: The bits of the rules that fail, over the measurements.
_FAILURES = "CAST(" + " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES)) + " AS BIGINT)"


def _measured(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t or "") for t in texts], columns=MEASURES)


def with_ledger(df: DataFrame, text_column: str, name: str) -> DataFrame:
    """`df` and its ledger, written once: a struct column `name` of the measurements and `failures`. Any policy, and what each
    of its rules alone would change, is read from this table."""
    measures = F.pandas_udf(_measured, ", ".join(f"{n} long" for n in MEASURES))(F.col(f"`{text_column}`"))
    rows = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("given"), measures.alias("m")).select("given", "m.*")
    told = rows.select("given", F.struct(*MEASURES, F.expr(_FAILURES).alias("failures")).alias("told"))
    return written(told.select("given.*", F.col("told").alias(name)), "ledger")


def good_documents(df: DataFrame, text_column: str, policy: str = CURRENT) -> DataFrame:
    """The rows of `df` that the policy keeps, with their columns: the ledger is written with the rows, then its bits decide.
    Null and empty texts have too few words."""
    name = "_ledger"
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return with_ledger(df, text_column, name).filter(passes(policy, f"{name}.failures")).select(*[f"`{c}`" for c in df.columns])


def passes(policy: str, failures: str = "failures") -> Column:
    return F.col(failures).bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of the policy: documents that fail it, and documents that only it rejects. One aggregate over the ledger."""
    active = F.col("failures").bitwiseAND(F.lit(mask(policy)))
    totals = rows.agg(*[
        c for name in POLICIES[policy]
        for c in (F.count_if(active.bitwiseAND(F.lit(bit(name))) != 0).alias(f"{name}_fails"), F.count_if(active == bit(name)).alias(f"{name}_alone"))
    ])
    return totals.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"{name}_fails").alias("fails"), F.col(f"{name}_alone").alias("only_this")) for name in POLICIES[policy]
    ])).alias("r")).select("r.*")


SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), t AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), f AS (SELECT *, {_FAILURES} AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {mask("base")} <> 0 AS base_failed,
       failures & {mask(CURRENT)} = 0 AS kept, n_lines, failures
FROM f"""


_ACTIVE = f"(failures & {mask(CURRENT)})"
ABLATIONS_SQL = SQL.rsplit("SELECT doc_id, n_words", 1)[0] + " UNION ALL ".join(
    f"SELECT '{name}' AS rule, count(*) FILTER ({_ACTIVE} & {bit(name)} <> 0) AS fails, count(*) FILTER ({_ACTIVE} = {bit(name)}) AS only_this FROM f" for name in POLICIES[CURRENT]
)


@query("quality_rule_ablations", ABLATIONS_SQL)
def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, and rejects alone, from a written ledger."""
    return ablations(with_ledger(table(spark, sf_dir, "documents"), "text", "ledger").select("ledger.*"))


@query("op2_quality_rules", SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"),
        passes(CURRENT).alias("kept"), "n_lines", "failures",
    )
