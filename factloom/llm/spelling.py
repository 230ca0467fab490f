"""Spelling variants: words one edit apart, each led to its most frequent form, by a variable-length gram index.

A gram is a stretch of a word between its two end marks. Grams that occur more than `LIST_LIMIT` times in the vocabulary are
the dictionary of frequent grams; a word is decomposed into one gram per start position, the shortest one that is not
frequent, so grams grow only where shorter ones have long lists. Whether a gram stands there depends on its own
letters alone. One edit therefore changes at most the grams that hold the edited place: the largest number of grams over
any place is the word's bound of affected grams. Of any `bound + 1` grams of a word at least one is found in every word one
edit away, at the same place or one later. So each word looks up its `bound + 1` rarest grams in the index of all words'
grams, by (gram, place, length); the lists are merged and every word in them is verified by its edit distance."""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table, written
from factloom.llm.registry import query

MIN_CHARS, MIN_COUNT = 5, 3
SHORTEST, LONGEST = 2, 5  # code points of a gram, end marks included
LIST_LIMIT = 64
MAX_DICTIONARY = 200_000  # frequent grams that travel to the tasks; the limit of a list grows where there would be more
RATIO = 2  # a form is at least so many times as frequent
DELETE_ONE_IN = 97
_HELD_WORDS = 300_000

#: One byte for each code point up to U+00FF: letters lower-cased (A-Z only), everything else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def word_counts(df: DataFrame, id_column: str, text_column: str, delete_one_in: int | None = None) -> DataFrame:
    """(word, n): how often each run of letters `[A-Za-z\\u00C0-\\u00FF]+` occurs in all texts, A-Z lower-cased.

    With `delete_one_in`, a run whose checksum with its document's id is divisible by it loses one letter, in all its
    places in that document: planted misspellings whose right spelling is known. A null text has no words; a null id counts
    as an empty one. Words are counted in the tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = Counter((text.as_py() or "").encode("latin-1", "replace").translate(_LETTERS).split(b" "))
                words.pop(b"", None)
                if not delete_one_in:
                    held.update(words)
                    continue
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in words.items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begun)
                    if h % delete_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    held[word] += n
                if len(held) >= _HELD_WORDS:
                    yield told()
                    held.clear()
        held.pop(b"", None)
        if held:
            yield told()

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """The dictionary: grams of the vocabulary that occur more than LIST_LIMIT times, with their number. There are at most
    MAX_DICTIONARY, whatever the vocabulary: the limit is at least all grams divided by that."""
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    place = F.sequence(F.lit(1), F.char_length("marked") - (SHORTEST - 1))
    grams = F.flatten(F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda size: F.transform(F.filter(place, lambda i: i + size - 1 <= F.char_length("marked")), lambda i: F.substring("marked", i, size))))
    counted = written(words.select(marked.alias("marked")).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    total = counted.agg(F.sum("n")).first()[0] or 0
    return {r.gram: r.n for r in counted.filter(F.col("n") > max(LIST_LIMIT, -(-total // MAX_DICTIONARY))).toLocalIterator()}


def decomposed(word: str, frequent: dict[str, int]) -> tuple[list[str], int]:
    """The gram at each place of a marked word, and how many of them one edit can change at most."""
    marked = f"^{word}$"
    grams, holding = [], [0] * len(marked)
    for i in range(len(marked) - SHORTEST + 1):
        end = i + SHORTEST
        while end < min(i + LONGEST, len(marked)) and marked[i:end] in frequent:
            end += 1
        grams.append(marked[i:end])
        for x in range(i, end):
            holding[x] += 1
    return grams, max(holding)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): every two words of the vocabulary `words` (word, n) one edit apart, once, a not longer than b.

    No list is cut: a long one is only looked up by words that have no rarer grams left, and a word has few
    neighbours (letters times places) however large the vocabulary is."""
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(words))  # at most MAX_DICTIONARY short strings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for word, n in zip(*(c.to_pylist() for c in batch.columns)):
                grams, bound = decomposed(word, known)
                if len(grams) <= bound:
                    raise ValueError(f"{word!r} is too short for grams of {LONGEST}")
                rarest = sorted(range(len(grams)), key=lambda i: (known.get(grams[i], 0), -len(grams[i]), i))[: bound + 1]
                asked = set(rarest)
                for i, gram in enumerate(grams):
                    for column, value in zip(out, (word, n, len(word), i, gram, i in asked)):
                        column.append(value)
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["word", "n", "size", "place", "gram", "asked"])

    index = written(words.select("word", "n").mapInArrow(run, "word string, n long, size int, place int, gram string, asked boolean"), "gram-index")
    # the same length and place, or one longer: the letter more stands behind the gram or before it
    to = F.array(*[F.struct((F.col("size") + s).alias("size"), (F.col("place") + p).alias("place")) for s, p in ((0, 0), (1, 0), (1, 1))])
    asked = index.filter("asked").select(F.col("word").alias("a"), F.col("n").alias("n_a"), "gram", F.explode(to).alias("to")).select("a", "n_a", "gram", "to.size", "to.place")
    listed = index.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "gram", "size", "place")
    once = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    found = asked.join(listed, ["gram", "size", "place"]).filter(once & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "b", "n_a", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row (word, form): the end of its chain of forms. Chains are doubled in each round; a form is
    RATIO times as frequent as its word, so they have at most 63 steps and end. Each round is a written table."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while now.filter("moved").limit(1).count():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("on"))
        now = written(now.drop("moved").join(further, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
    return now.select("word", "root")


def spelling_variants(words: DataFrame) -> DataFrame:
    """One row per word of `words` (word, n): word, form, root, n, n_near, form_n.

    `form` is the word's most frequent near word (ties: the smallest in code-point order) if that is RATIO times as
    frequent, else null; `root` follows forms to the last. Words are distinct and have MIN_CHARS code points or more."""
    pairs = written(near_words(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near")).alias("to"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("near")).alias("to")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("to").alias("to"))
    strong = -F.col("to.less") >= RATIO * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word", F.when(strong, F.col("to.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, -F.col("to.less")).alias("form_n")
    )
    formed = written(formed, "forms")
    return formed.join(roots(formed.filter("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_in(df: DataFrame, id_column: str, text_column: str, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, delete_one_in: int | None = None) -> DataFrame:
    """`spelling_variants` of the words of all texts that have `min_chars` code points and occur `min_count` times."""
    if min_chars < LONGEST:
        raise ValueError(f"words under {LONGEST} code points may have no gram that an edit leaves whole")
    counted = word_counts(df, id_column, text_column, delete_one_in)
    return spelling_variants(written(counted.filter((F.char_length("word") >= min_chars) & (F.col("n") >= min_count)), "words"))


_POLYNOMIAL = 0xEDB88320
SQL = rf"""
WITH RECURSIVE eight AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_POLYNOMIAL}) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
), runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  GROUP BY doc_id, run
), coded AS (SELECT doc_id, run, n, hex(encode(doc_id || ':' || run)) AS x FROM runs),
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))),
                                             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h
  FROM coded, eight
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {DELETE_ONE_IN} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM summed)
  WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
), less AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS k FROM pairs
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form, CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1
), led(word, root, step) AS (
  SELECT word, word, 0 FROM formed
  UNION ALL SELECT led.word, f.form, step + 1 FROM led JOIN formed f ON f.word = led.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, l.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN (SELECT word, arg_max(root, step) AS root FROM led GROUP BY word) l ON l.word = f.word"""


@query("op11_spelling_variants", SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants_in(table(spark, sf_dir, "documents"), "doc_id", "text", delete_one_in=DELETE_ONE_IN)
