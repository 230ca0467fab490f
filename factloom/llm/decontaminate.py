"""Benchmark decontamination: word runs as seeds, then Smith-Waterman alignment.

Words are lower-cased, and ASCII characters other than letters and digits part them, so case and punctuation do not
hide a copy. Every run of GRAM words of a benchmark item is a seed, so every GRAM words that were copied unchanged hold one, however
common they are. Where a document holds a seed and the words around it can make up a leak in any order, this passage is
aligned with the item, word by word. The score is the alignment's over that of the whole item with itself, so changed,
lost and added words cost, but do not hide."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import ROW, block_of, filled, given_back, numbered, put_aside, table, windows, word_hashes, written
from factloom.llm.registry import query
from factloom.llm.tokens import ragged, slices

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
SLACK = 8  # words on either side of a passage
MAX_ITEM_WORDS = 4_000_000  # of one broadcast; a larger benchmark is taken in parts
PAIRS = 1 << 20  # handled at a time
_BITS = 20
_LOW = np.uint64((1 << _BITS) - 1)

_TABLE = np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of all texts, and the number of words of each text."""
    lowered = pc.utf8_lower(texts)
    if not len(lowered):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _TABLE[np.frombuffer(lowered.buffers()[2] or b"", np.uint8)]
    return word_hashes(pa.Array.from_buffers(lowered.type, len(lowered), [None, lowered.buffers()[1], pa.py_buffer(data.tobytes())], offset=lowered.offset))


def grams_of(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place in its text of every run of GRAM words."""
    if len(h) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = windows(h, GRAM)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[: len(grams)] == owner[GRAM - 1 :]
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    return grams[inside], owner[: len(grams)][inside], place[: len(grams)][inside]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each item with its passage, and where it ends in the passage (last word)."""
    rows, width = max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((len(items), rows), np.uint64), np.zeros((len(items), width), np.uint64)
    for i, (item, passage) in enumerate(zip(items, passages)):
        a[i, : len(item)], b[i, : len(passage)] = item, passage
    real = np.arange(width)[None, :] < np.array([len(p) for p in passages])[:, None]
    sizes = np.array([len(i) for i in items])
    before = np.zeros((len(items), width + 1), np.int32)
    best, ends = np.zeros(len(items), np.int32), np.full(len(items), -1)
    slope = (np.arange(1, width + 1) * -GAP).astype(np.int32)
    for r in range(rows):
        step = np.where((a[:, r, None] == b) & real, MATCH, MISMATCH).astype(np.int32)
        now = np.maximum(before[:, :-1] + step, before[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps along the row
        now[r >= sizes] = 0
        now[~real] = 0
        top = now.argmax(axis=1)
        score = now[np.arange(len(items)), top]
        better = score > best
        best[better], ends[better] = score[better], top[better]
        before[:, 1:] = now
    return best, ends


def _batched(items: list[np.ndarray], passages: list[np.ndarray], size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort([len(p) for p in passages], kind="stable")
    best, ends = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
    i = 0
    while i < len(order):
        part = order[i : i + size]
        part = part[: max(1, PAIRS // max(1, len(passages[part[-1]])))]  # long passages in smaller batches
        best[part], ends[part] = align([items[k] for k in part], [passages[k] for k in part])
        i += len(part)
    return best, ends


def clusters(group: np.ndarray, low: np.ndarray, high: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of diagonals per group, those at most `near` apart (of the group) made one. Merged ranges can be merged again."""
    order = np.lexsort((low, group))
    group, low, high, near = group[order], low[order], high[order], near[order]
    if not len(group):
        return group, low, high
    new = np.concatenate([[True], group[1:] != group[:-1]])
    rank = np.cumsum(new) << 40  # above every diagonal
    reach = np.maximum.accumulate(rank + high) - rank
    starts = np.nonzero(new | np.concatenate([[True], low[1:] - reach[:-1] > near[1:]]))[0]
    return group[starts], low[starts], reach[np.append(starts[1:], len(group)) - 1]


class Items:
    """The items of one broadcast: words, runs and where they stand, and which words an item has."""

    def __init__(self, ids: list[int | None], words: list[np.ndarray]):
        self.ids, self.words = ids, words
        self.sizes = np.array([len(w) for w in words], np.int64)
        flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
        grams, owner, place = grams_of(flat, self.sizes)
        order = np.argsort(grams, kind="stable")
        self.grams, first = np.unique(grams[order], return_index=True)
        self.starts = np.append(first, len(order))
        self.item, self.q = owner[order].astype(np.int32), place[order].astype(np.int32)
        self.vocabulary, coded = np.unique(flat, return_inverse=True)
        self.has = np.unique(np.repeat(np.arange(len(words)), self.sizes) * len(self.vocabulary) + coded)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.grams & _LOW).astype(np.int64)] = True


def _within(x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted array that is not empty, and whether it is there."""
    spot = np.minimum(np.searchsorted(held, x), len(held) - 1)
    return spot, held[spot] == x


def passages(known: Items, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, from, to) of every stretch of a text around shared runs: runs whose diagonals are near go together."""
    grams, owner, place = grams_of(h, counts)
    maybe = np.nonzero(known.table[(grams & _LOW).astype(np.int64)])[0]
    if not len(maybe) or not len(known.grams):
        return (np.zeros(0, np.int64),) * 4
    spot, there = _within(grams[maybe], known.grams)
    spot, owner, place = spot[there], owner[maybe[there]], place[maybe[there]]
    sizes, n = known.starts[spot + 1] - known.starts[spot], len(known.sizes)
    group, low, high = (np.zeros(0, np.int64),) * 3
    ends, at = np.cumsum(sizes), 0
    while at < len(spot):  # so many pairs at a time, made ranges before the next
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + PAIRS, side="right")))
        of = ragged(known.starts[spot[at:to]], sizes[at:to])
        item, diagonal = known.item[of].astype(np.int64), np.repeat(place[at:to], sizes[at:to]) - known.q[of]
        group, low, high = np.concatenate([group, np.repeat(owner[at:to], sizes[at:to]) * n + item]), np.concatenate([low, diagonal]), np.concatenate([high, diagonal])
        group, low, high = clusters(group, low, high, known.sizes[group % n] // 2)
        at = to
    return group // n, group % n, np.maximum(0, low - SLACK), np.minimum(counts[group // n], high + known.sizes[group % n] + SLACK)


def can_hold(known: Items, h: np.ndarray, item: np.ndarray, start: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether an alignment in h[start:to] can reach MIN_SCORE: no more than MATCH for each word that the item has, in any
    order, and at least -1 for every other word in between. A bound, so nothing is lost by it."""
    out, sizes = np.zeros(len(item), bool), to - start
    _code, _there = _within(h, known.vocabulary)
    ends, at = np.cumsum(sizes), 0
    while at < len(item):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + PAIRS, side="right")))
        n = sizes[at:upto]
        where, of = ragged(start[at:upto], n), np.repeat(np.arange(upto - at), n)
        _, own = _within(item[at:upto][of] * len(known.vocabulary) + _code[where], known.has)
        total = np.cumsum(np.where(own & _there[where], MATCH, max(MISMATCH, GAP)))
        before = np.concatenate([[0], total[:-1]])
        fall = of << 40
        gain = total - (np.minimum.accumulate(before - fall) + fall)
        out[at:upto] = np.maximum.reduceat(gain, np.cumsum(n) - n) >= MIN_SCORE * MATCH * known.sizes[item[at:upto]]
        at = upto
    return out


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, counts = normal_words(filled(batch.column(1)))
        offsets = pa.array(np.concatenate([np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64)))], names=["item", "words"])


def _aligned(held):
    """(row, id, text) to the best alignment of every text with every item that reaches MIN_SCORE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in (b.slice(at, to - at) for b in batches for at, to in slices(filled(b.column(2)))):
            h, counts = normal_words(filled(batch.column(2)))
            text, item, low, high = passages(known, h, counts)
            if not len(text):
                continue
            start = (np.cumsum(counts) - counts)[text]
            able = can_hold(known, h, item, start + low, start + high)
            text, item, low, high, start = (x[able] for x in (text, item, low, high, start))
            if not len(text):
                continue
            items, parts = [known.words[i] for i in item.tolist()], [h[f:t] for f, t in zip((start + low).tolist(), (start + high).tolist())]
            best, last = _batched(items, parts)
            full = known.sizes[item] * MATCH
            good = np.nonzero(best >= MIN_SCORE * full)[0]
            if not len(good):
                continue
            _, back = _batched([items[k][::-1] for k in good], [parts[k][: last[k] + 1][::-1] for k in good])  # backwards, for the first word
            found: dict[tuple[int, int], tuple[float, int, int]] = {}
            for k, f in zip(good.tolist(), back.tolist()):
                end = int(low[k] + last[k])
                told = (best[k] / full[k], f - end, end)
                key = (int(text[k]), int(item[k]))
                found[key] = max(found.get(key, told), told)
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            columns = list(zip(*[(rows[t], ids[t], known.ids[i], score, -first, end) for (t, i), (score, first, end) in found.items()]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[i], pa.float64() if i == 3 else pa.int64()) for i in range(6)], names=["row", "id", "item_id", "score", "first_word", "last_word"]
            )

    return run


_RESULT = "row long, id long, item_id long, score double, first_word long, last_word long"


def _leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(row, id, item_id, score, first_word, last_word) of the best alignments; items fit one broadcast."""
    ids, words = [], []
    for r in items.select("item", "text").mapInArrow(_item_words, "item long, words array<long>").toLocalIterator():
        ids.append(r["item"])
        words.append(np.array(r["words"], np.int64).view(np.uint64))
    held = docs.sparkSession.sparkContext.broadcast(Items(ids, words))  # at most MAX_ITEM_WORDS
    return written(docs.select(F.col("_row").alias("row"), "id", "text").mapInArrow(_aligned(held), _RESULT), "aligned")


def leaks(docs: DataFrame, benchmark: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """Leaks between `docs` (columns _row, id, text) and a benchmark, as (row, id, item_id, score, first_word, last_word).

    The best alignment per row and item, scores from MIN_SCORE, words counted from 0. Items are the different rows of the
    benchmark: texts under one id are searched each, as are those under none. Items with fewer than GRAM words and
    null texts are never found. Benchmarks beyond MAX_ITEM_WORDS are taken in parts, each with a pass over the documents."""
    named = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(text_column).alias("text"))
    items = written(named.distinct(), "items")
    size = items.agg(F.sum(F.size(F.split("text", r"[\x00-\x20]+")))).first()[0] or 0
    parts = -(-size // MAX_ITEM_WORDS) or 1
    found = [_leaks(docs, items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == i)) for i in range(parts)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def find_leaks(df: DataFrame, id_column: str, text_column: str, benchmark: DataFrame, item_column: str, item_text: str) -> DataFrame:
    """One row per (document, item) found: id, item_id, score, first_word, last_word. Null texts hold nothing; repeated
    rows and rows with a null id are reported like any other."""
    docs = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return leaks(docs, benchmark, item_column, item_text).drop("row")


def decontaminate(df: DataFrame, id_column: str, text_column: str, benchmark: DataFrame, item_column: str, item_text: str) -> DataFrame:
    """The rows of `df` without a leak, all columns as they were."""
    given, names = put_aside(df, ROW)
    docs = numbered(given, "passages")
    found = leaks(docs.select("_row", F.col(names[id_column]).cast("long").alias("id"), F.col(names[text_column]).alias("text")), benchmark, item_column, item_text)
    return docs.join(found.select(block_of("row").alias("_block"), F.col("row").alias("_row")).distinct(), ROW, "left_anti").select(*given_back(names))


@query("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.withColumnRenamed("id", "doc_id")
