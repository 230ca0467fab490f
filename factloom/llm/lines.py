"""Line dedup: later copies of repeated runs of lines go.

The corpus is one sequence of line ids per document. Prefix doubling ranks its suffixes by their first 1, 2, 4, ...
lines: a suffix's rank for 2k lines comes from sorting the pairs (own rank, rank of the suffix k lines on). Only suffixes
that share their rank go on, as a unique one begins no repeated run. Suffixes of equal rank are an interval of the
suffix array whose common prefix has at least that many lines; intervals of any other depth are pairs of two ranks.

A run counts from `min_words` words. Whether a line lies in a repeated run of so many words is decided by the shortest
such runs that begin or end at each line, and these have at most `min_words` lines, since lines without a word are
passed over. So doubling ends at that depth, and the union of the runs it finds is the union of all maximal ones.

Pairs are counted before they are sorted or joined back, so a line, run or document that occurs very often is one row
per task in the sort; its members meet their rank in a join whose large side Spark may split."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import ROW, block_of, filled, given_back, numbered, put_aside, table, written
from factloom.llm.registry import query

MIN_WORDS = 30
COUNTS = ("_n_lines", "_n_removed", "_n_runs")


def line_windows(words: list[int], min_words: int) -> set[tuple[int, int]]:
    """(first line, lines) of the shortest runs with `min_words` words that begin or end at each line."""
    found, total, first = set(), 0, 0
    for last, n in enumerate(words):  # shortest run that ends at `last`
        total += n
        while total - words[first] >= min_words:
            total -= words[first]
            first += 1
        if total >= min_words:
            found.add((first, last - first + 1))
    total, last = 0, len(words)
    for first in range(len(words) - 1, -1, -1):  # shortest run that begins at `first`
        total += words[first]
        while total - words[last - 1] >= min_words:
            last -= 1
            total -= words[last]
        if total >= min_words:
            found.add((first, last - first))
    return found


def _lines(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "n", "at", "h1", "h2", "runs"]
        for batch in batches:
            rows: list[tuple] = []
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (t.as_py() for t in filled(batch.column(2)).cast(pa.large_binary()))):
                own = [(at, line, n) for at, line in enumerate(text.split(b"\n")) if (n := len(line.split()))]
                runs: dict[int, list[int]] = {}
                for first, size in line_windows([n for _, _, n in own], min_words):
                    runs.setdefault(first, []).append(size)
                for n, (at, line, _) in enumerate(own):
                    h1, h2 = np.frombuffer(hashlib.blake2b(line, digest_size=16).digest(), np.int64).tolist()
                    rows.append((row, doc_id, n, at, h1, h2, runs.get(n, [])))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if i == 6 else pa.int64()) for i, c in enumerate(zip(*rows))], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if i == 6 else pa.int64()) for i, c in enumerate(zip(*rows))], names=names)

    return run


def _ranked(suffixes: DataFrame, first: str, second: str) -> DataFrame:
    """(row, n, rank) of the suffixes whose pair (first, second) occurs again; the rank is the pair's place in sorted order."""
    pairs = suffixes.groupBy(first, second).agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select(first, second)
    sorted_ = written(pairs.repartitionByRange(first, second).withColumn("part", F.spark_partition_id()), "pairs")
    sizes = sorted_.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    numbered = sorted_.join(offsets, "part").withColumn("rank", F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy(first, second)))
    return written(suffixes.join(numbered.select(first, second, "rank"), [first, second]).select("row", "n", "rank"), "ranks")


def repeated_lines(lines: DataFrame, min_words: int) -> DataFrame:
    """(row, n) of every line in a run of `min_words` words that also begins at an earlier place (id, row, line)."""
    level = _ranked(lines.select("row", "n", "h1", "h2"), "h1", "h2")
    levels = level.withColumn("level", F.lit(0))
    depth = 1
    while depth * 2 <= min_words:
        after = level.select("row", (F.col("n") - depth).alias("n"), F.col("rank").alias("second"))
        level = _ranked(level.join(after, ["row", "n"]).withColumnRenamed("rank", "first"), "first", "second")
        depth *= 2
        levels = levels.unionByName(level.withColumn("level", F.lit(depth.bit_length() - 1)))
    runs = lines.select("row", "id", "n", F.explode("runs").alias("size")).withColumn("level", F.floor(F.log2("size") + 1e-9).cast("int"))
    end = F.col("n") + F.col("size") - F.expr("shiftleft(1L, level)")
    begun = runs.join(levels.withColumnRenamed("rank", "first"), ["row", "n", "level"])
    closed = levels.select("row", F.col("n").alias("end"), "level", F.col("rank").alias("last"))
    both = written(begun.withColumn("end", end).join(closed, ["row", "end", "level"]).select("row", "id", "n", "size", "first", "last"), "runs")
    place = F.struct("id", "row", "n")
    earliest = both.groupBy("size", "first", "last").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("members")).filter("members > 1").drop("members")
    later = both.join(earliest, ["size", "first", "last"]).filter(place > F.col("earliest"))
    return later.select("row", F.explode(F.sequence("n", F.col("n") + F.col("size") - 1)).alias("n")).distinct()


def dedup_lines(df: DataFrame, id_column: str, text_column: str, min_words: int = MIN_WORDS) -> DataFrame:
    """All input columns (but those named as a count below), the text without later copies of repeated line runs, and `_n_lines`, `_n_removed`, `_n_runs`
    (maximal stretches of removed lines, blank lines between them passed over).

    Lines are compared byte for byte; lines without a word are kept and never compared. The earliest copy, by id (nulls
    first), then by place in the scan, then by line, stays whole. A null text stays null. A text may become empty, its
    row stays. Repeated rows are documents of their own: the first keeps its text."""
    given, names = put_aside(df.drop(*[c for c in df.columns if c.lower() in COUNTS]), [*ROW, "_gone", "_cut"])
    docs = numbered(given, "lines")
    found = docs.select("_row", F.col(names[id_column]).cast("long").alias("id"), F.col(names[text_column]).alias("text")).mapInArrow(
        _lines(min_words), "row long, id long, n long, at long, h1 long, h2 long, runs array<long>"
    )
    lines = written(found, "lines")
    gone = repeated_lines(lines, min_words).join(lines.select("row", "n", "at"), ["row", "n"])
    gone = gone.groupBy(block_of("row").alias("_block"), F.col("row").alias("_row")).agg(F.sort_array(F.collect_list(F.struct("n", "at"))).alias("_gone"))

    joined = docs.join(gone.hint("shuffle_hash"), ROW, "left")
    lost = F.coalesce(F.col("_gone.n"), F.array().cast("array<long>"))
    text = F.col(names[text_column])
    all_lines, cut = F.split(text, "\n"), F.col("_gone.at")
    # the stretches between removed lines, one slice each: as much work as there are lines
    first, end = F.concat(F.array(F.lit(-1).cast("long")), cut), F.concat(cut, F.array(F.size(all_lines).cast("long")))
    left = F.flatten(F.zip_with(first, end, lambda a, b: F.slice(all_lines, (a + 2).cast("int"), (b - a - 1).cast("int"))))
    counted = joined.select(
        *[f"`{now}`" for now in names.values()], F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(left, "\n")).alias("_cut"),
        F.size(F.split(F.coalesce(text, F.lit("")), "\n")).cast("long").alias("_n_lines"), F.size(lost).cast("long").alias("_n_removed"),
        F.size(F.filter(lost, lambda x, i: (i == 0) | (F.get(lost, i - 1) < x - 1))).cast("long").alias("_n_runs"),
    )
    # columns of the input come first and keep their names; the counts take names with an underscore
    return counted.select(*[F.col("_cut").alias(c) if c == text_column else own for c, own in zip(names, given_back(names))], *COUNTS)


SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS raw FROM documents
), b AS (
  SELECT doc_id, raw, list_filter(range(1, len(raw) + 1), lambda i: regexp_matches(raw[i], '[^\x20\x09-\x0D]')) AS ats FROM d
), l AS (
  SELECT doc_id, ats, list_transform(ats, lambda i: raw[i]) AS ls, list_transform(ats, lambda i: len(regexp_extract_all(raw[i], '[^\x20\x09-\x0D]+'))) AS ws FROM b
), s AS (SELECT doc_id, ats, ls, ws, unnest(range(1, len(ls) + 1)) AS i FROM l),
r AS (
  SELECT doc_id, i, k, md5(array_to_string(ls[i:i + k - 1], chr(10))) AS run
  FROM (SELECT doc_id, ls, ws, i, unnest(range(1, least(len(ls) - i + 1, {MIN_WORDS}) + 1)) AS k FROM s)
  WHERE list_sum(ws[i:i + k - 1]) >= {MIN_WORDS}
), e AS (SELECT k, run, min(struct_pack(a := doc_id, b := i)) AS earliest FROM r GROUP BY k, run HAVING count(*) > 1),
g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS n FROM r JOIN e USING (k, run) WHERE struct_pack(a := doc_id, b := i) > earliest
), c AS (
  SELECT doc_id, list(n) AS gone, count(*) AS n_removed, count(*) FILTER (prev IS NULL OR prev < n - 1) AS n_runs
  FROM (SELECT doc_id, n, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM g) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.raw) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
       sha256(CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_transform(
         list_filter(range(1, len(d.raw) + 1), lambda x: NOT list_contains(list_transform(gone, lambda n: ats[n]), x)), lambda x: d.raw[x]), chr(10)) END) AS kept_sha256
FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)"""


@query("op8_line_dedup", SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_runs").alias("n_runs"), digest.alias("kept_sha256"))
