"""License scans by diagonal voting, in DataFrame functions only.

Every run of three words of every text is joined by its hash to the positions of the same run in license templates.
A hit votes for the diagonal `text position - template position`; neighbouring diagonals (an inserted or lost word
moves the rest of a text by one) merge into one span. The words of a hit are compared in the join itself, so equal hashes
alone never count. Spans are then verified: their words are compared with the template's one by one, and the words that
tell a license from its relatives must agree."""
from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import table
from factloom.llm.registry import query

K = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of a text with A-Z lower-cased


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False  # counts only where all words stand consecutively
    needs: tuple[str, ...] = ()  # words of the template that a span must have in their place
    bars: tuple[str, ...] = ()  # words of other licenses that may not stand inside a span


#: Fixed phrases and their labels.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
#: Opening sentences and usual notices of common licenses.
TEMPLATES = (
    Template("agpl-3", "gnu affero general public license version 3", needs=("affero", "3"), bars=("lesser", "library")),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", needs=("apache", "2")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", needs=("attribution",), bars=("sharealike", "share", "noncommercial", "commercial", "noderivatives", "noderivs", "derivatives", "derivs")),
    Template("gpl-3", "licensed under the gnu general public license version 3", needs=("gnu", "general", "3"), bars=("affero", "lesser", "library")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", needs=("mozilla", "2")),
)
MIN_SHARE = 0.6  # of a template's words, verified; of its runs, by vote
BAND = 2
MAX_GRAMS = 100_000  # the template table is broadcast; more is refused


def template_grams(spark: SparkSession, templates: tuple[Template, ...], k: int = K) -> DataFrame:
    """One row per (template, position): the words of the run, its hash, and how many runs the template has."""
    rows = []
    for number, t in enumerate(templates):
        words = t.text.split(" ")
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {t.text!r}")
        if missing := set(t.needs) - set(words):
            raise ValueError(f"not words of the template {t.text!r}: {sorted(missing)}")
        needed = [i for i, w in enumerate(words) if w in t.needs]
        rows += [(number, i, len(words) - k + 1, t.exact, t.label, words, needed, list(t.bars), *words[i : i + k]) for i in range(len(words) - k + 1)]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"{len(rows)} template runs are too many to broadcast; at most {MAX_GRAMS}")
    names = ", ".join(f"t{i} string" for i in range(k))
    grams = spark.createDataFrame(rows, f"template int, at int, runs int, exact boolean, label string, all_words array<string>, needs array<int>, bars array<string>, {names}")
    return grams.withColumn("gram", F.xxhash64(*[f"t{i}" for i in range(k)]))


def spans(df: DataFrame, text_column: str, templates: tuple[Template, ...], k: int = K, band: int = BAND) -> DataFrame:
    """Per input row (`row`, its place in the scan) and merged diagonal: label, exact, runs, found (different runs of the
    template that it holds), same (places of the template whose word stands there in the text), needed (all distinguishing
    words are among them), barred (a word of another license stands inside), first_word, n_words of the text. A row without
    a hit appears once with null label.

    Null text: no words. Long texts: the words of one text are exploded as a stream, never gathered again."""
    text = F.translate(F.coalesce(F.col(text_column), F.lit("")), ascii_uppercase, ascii_lowercase)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), *[c for c in ("id",) if c in df.columns])
    words = rows.select("row", "id", "words", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    run = [F.get("words", F.col("pos") + i) for i in range(k)]
    runs_of_text = words.withColumn("gram", F.xxhash64(*run))
    grams = F.broadcast(template_grams(df.sparkSession, templates, k))  # at most MAX_GRAMS short rows
    same = [runs_of_text["gram"] == grams["gram"], *[r == F.col(f"t{i}") for i, r in enumerate(run)]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    start = F.col("pos") - F.col("at")
    stretch = F.when(F.col("template").isNotNull(), F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("runs") + (k - 1)))
    told = F.col("template").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0)  # hits, and one row of every text
    hits = runs_of_text.join(grams, condition, "left").filter(told).select(
        "row", "id", "n_words", "pos", "template", "at", "label", "exact", "runs", "all_words", "needs", "bars", F.when(F.col("template").isNotNull(), start).alias("diagonal"), stretch.alias("stretch")
    )
    votes = hits.groupBy("row", "id", "diagonal", "template").agg(
        F.max("n_words").cast("long").alias("n_words"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("runs").alias("runs"),
        F.min("pos").alias("from"), F.collect_set("at").alias("found"), *[F.first(c).alias(c) for c in ("all_words", "needs", "bars", "stretch")],
    )
    here = F.col("stretch")
    before = F.least(F.col("diagonal"), F.lit(0))  # a text that begins inside the template
    same_words = F.filter(F.sequence(F.lit(0), F.col("runs") + (k - 2)), lambda i: F.get(here, i + before) == F.get("all_words", i))
    strange = F.filter(F.transform(here, lambda w, i: F.when(F.array_contains("bars", w), i + F.greatest(F.col("diagonal"), F.lit(0)))), lambda i: i.isNotNull())
    votes = votes.withColumn("same", same_words).withColumn("strange", strange)
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.when(F.col("exact"), 0).otherwise(band), F.lit(True))
    numbered = votes.withColumn("apart", apart).withColumn("span", F.sum(F.col("apart").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("row", "id", "template", "span").agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("runs").alias("runs"),
        F.min("diagonal").cast("long").alias("start"), F.min("from").cast("long").alias("first_word"),
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"), F.array_distinct(F.flatten(F.collect_list("same"))).alias("same"),
        F.first("needs").alias("needs"), F.flatten(F.collect_list("strange")).alias("strange"),
        F.min(F.col("diagonal") + F.array_min("same")).alias("begins"), F.max(F.col("diagonal") + F.array_max("same")).alias("ends"),
    ).withColumn("needed", F.size(F.array_except("needs", "same")) == 0).withColumn("barred", F.exists("strange", lambda p: p.between(F.col("begins"), F.col("ends"))))


def scan(df: DataFrame, id_column: str, text_column: str, base: tuple[Template, ...] = BASE, templates: tuple[Template, ...] = TEMPLATES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    `base` templates count where every word stands in place; the others where a span has `min_share` of their words, all
    distinguishing words among them and none of another license.
    `score` is the largest share of any template's runs in one span, 0 without a hit. Null and empty texts: no words, no labels, 0."""
    source = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = spans(source, "text", tuple(base) + tuple(templates))
    share = F.col("found") / F.col("runs")
    whole = F.col("exact") & (F.col("found") == F.col("runs"))
    verified = (F.size("same") >= min_share * (F.col("runs") + (K - 1))) & F.col("needed") & ~F.col("barred")
    held = whole | (~F.col("exact") & verified)

    def labels(which):
        return F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")

    return found.groupBy("row", "id").agg(
        F.max("n_words").alias("n_words"), F.sum(F.coalesce(whole, F.lit(False)).cast("long")).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).alias("first_word"), F.max(F.when(whole, F.col("start"))).alias("last_word"),
        labels(whole).alias("base_labels"), labels(held).alias("labels"), F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
    ).drop("row")


def _values() -> tuple[str, str]:
    """The runs and the words of all templates, as SQL rows."""
    runs, whole = [], []
    for number, t in enumerate(BASE + TEMPLATES):
        words = t.text.split(" ")
        whole.append(f"({number}, {words}, {[i for i, w in enumerate(words) if w in t.needs]}::INT[], {list(t.bars)}::VARCHAR[])")
        runs += [f"({number}, {i}, {len(words) - K + 1}, {str(t.exact).lower()}, '{t.label}', '{words[i]}', '{words[i + 1]}', '{words[i + 2]}')" for i in range(len(words) - K + 1)]
    return ", ".join(runs), ", ".join(whole)


_RUNS, _WHOLE = _values()
SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), p AS (
  SELECT doc_id, pos, ws[pos + 1] AS a, ws[pos + 2] AS b, ws[pos + 3] AS c FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS pos FROM w)
), t(template, at_, runs, exact, label, t0, t1, t2) AS (VALUES {_RUNS}),
tt(template, words, needs, bars) AS (VALUES {_WHOLE}),
hits AS (SELECT doc_id, template, runs, exact, label, pos, at_, pos - at_ AS diagonal FROM p JOIN t ON a = t0 AND b = t1 AND c = t2),
d AS (SELECT DISTINCT doc_id, template, exact, diagonal FROM hits),
g AS (
  SELECT *, sum(CASE WHEN diagonal - prev > CASE WHEN exact THEN 0 ELSE {BAND} END OR prev IS NULL THEN 1 ELSE 0 END)
              OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS prev FROM d)
), s AS (
  SELECT h.doc_id, h.template, span, max(h.runs) AS runs, bool_or(h.exact) AS exact, max(h.label) AS label,
         count(DISTINCT at_) AS found, min(h.diagonal) AS start
  FROM hits h JOIN g ON h.doc_id = g.doc_id AND h.template = g.template AND h.diagonal = g.diagonal GROUP BY h.doc_id, h.template, span
), v AS (
  SELECT g.doc_id, g.template, span, diagonal, needs,
         list_filter(range(0, len(words)), lambda i: diagonal + i >= 0 AND ws[diagonal + i + 1] = words[i + 1]) AS same,
         list_filter(range(greatest(diagonal, 0), greatest(diagonal, 0) + len(words)), lambda i: list_contains(bars, ws[i + 1])) AS strange
  FROM g JOIN w ON w.doc_id = g.doc_id JOIN tt ON tt.template = g.template
), m AS (
  SELECT doc_id, template, span, list_distinct(flatten(list(same))) AS same, any_value(needs) AS needs, flatten(list(strange)) AS strange,
         min(diagonal + list_min(same)) AS begins, max(diagonal + list_max(same)) AS ends
  FROM v GROUP BY doc_id, template, span
), x AS (
  SELECT s.*, exact AND found = runs AS whole,
         (exact AND found = runs) OR (NOT exact AND len(same) >= {MIN_SHARE}::DOUBLE * (runs + {K - 1}) AND list_has_all(same, needs)
                                      AND len(list_filter(strange, lambda i: i BETWEEN begins AND ends)) = 0) AS held
  FROM s JOIN m ON s.doc_id = m.doc_id AND s.template = m.template AND s.span = m.span
), r AS (
  SELECT doc_id, count(*) FILTER (whole) AS n_base, min(start) FILTER (whole) AS first_word, max(start) FILTER (whole) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (whole))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label) FILTER (held))), ',') AS labels, max(found / runs) AS score
  FROM x GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM w LEFT JOIN r USING (doc_id)"""


@query("op10_license_scan", SQL)
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
