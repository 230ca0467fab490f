"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, and links confirmed on whole shingle sets.

A signature is `CHUNKS * CHUNK` symbols of 32 bits, each the smallest of the document's shingle hashes under one
permutation. Two signatures that differ in at most `DISTANCE = CHUNKS * (ERRORS + 1) - 1` symbols differ in at most
ERRORS symbols of some chunk (pigeonhole), so they share a key when every chunk is entered once for each choice of
ERRORS symbols left out. All such pairs are found. At a similarity of 0.75 a pair differs in 9 of 36 symbols on
average and in more than 23 with a probability of 1.7e-7 (binomial).

No group emits its pairs. Documents with equal sets are one class. In each bucket every class is first compared with
the bucket's smallest class. Where a bucket still spans several components, classes are compared with those of other
components inside the task, by signature and then by the smallest hashes of their sets, and each sends its few likeliest
partners. Only what is still apart after that is compared in full: there the smallest hashes drop no pair, only sizes that
rule a link out do. A pair is judged in the first of its common buckets alone, and every link is confirmed on whole sets."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import MULTIPLIER, ROW, ascii_lower, block_of, filled, given_back, mix, numbered, put_aside, table, windows, word_hashes, written
from factloom.llm.components import components
from factloom.llm.registry import query
from factloom.llm.tokens import slices

WORDS = 5
SHARE = 75  # percent
CHUNKS, CHUNK, ERRORS = 12, 3, 1
DISTANCE = CHUNKS * (ERRORS + 1) - 1
SEED = 7
BLOCK = 512  # classes of a bucket compared at a time
LIKELIEST = 2  # partners that a class sends from a bucket before the full comparison
BOTTOM = 256  # smallest hashes of a set that travel to a bucket; smaller sets travel whole
DEVIATIONS = 4.5  # before the full comparison: by which the similarity of the smallest hashes may fall short of that of the sets


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and their number per text."""
    h, counts = word_hashes(ascii_lower(texts))
    grams = windows(h, words) if len(h) >= words else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    parts, sizes = [], np.zeros(len(counts), np.int64)
    for i, (start, end) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
        if end - start >= words:
            own = np.sort(grams[start : end - words + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif end > start:
            own = windows(h[start:end], end - start) ^ np.uint64(end - start)
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes


def signatures(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The symbols of each non-empty set, one row each."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 1 << 63, CHUNKS * CHUNK, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(sizes), len(factors)), np.uint32)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):  # runs that stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 15), side="right")))
        base = int(ends[at] - sizes[at])
        own, starts = sets[base : int(ends[to - 1])], ends[at:to] - sizes[at:to] - base
        for k, factor in enumerate(factors):
            x = own * factor
            x ^= x >> np.uint64(32)
            x *= MULTIPLIER
            out[at:to, k] = np.minimum.reduceat(x, starts) >> np.uint64(32)
        at = to
    return out


def bucket_keys(symbols: np.ndarray) -> np.ndarray:
    """One key per (chunk, symbols left out) and row."""
    keys = []
    for chunk in range(CHUNKS):
        own = symbols[:, chunk * CHUNK : (chunk + 1) * CHUNK].astype(np.uint64)
        for kept in combinations(range(CHUNK), CHUNK - ERRORS):
            key = np.full(len(own), len(keys) + 1, np.uint64) * MULTIPLIER
            for k in kept:
                key = mix(key + own[:, k])
            keys.append(key)
    return np.stack(keys, axis=1)


def bottom_similar(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of sets by their smallest hashes (rows in order, padded with the largest number), and whether the sets
    may be similar enough. Where a set travels in part, only hashes up to its last one count."""
    part = np.full(len(x), 0xFFFFFFFE, np.uint32)
    for rows, n in ((x, n_x), (y, n_y)):
        part = np.where(n > BOTTOM, np.minimum(part, rows[:, -1]), part)
    both_ = np.sort(np.concatenate([x, y], axis=1), axis=1)
    known = both_ <= part[:, None]
    twice = ((both_[:, 1:] == both_[:, :-1]) & known[:, 1:]).sum(axis=1)
    either = np.maximum(1, known.sum(axis=1) - twice)
    share = twice / either
    whole = (n_x <= BOTTOM) & (n_y <= BOTTOM)
    least = SHARE / 100 - np.where(whole, 0.005, DEVIATIONS * np.sqrt(SHARE / 100 * (1 - SHARE / 100) / either))
    return share, (share >= least) & sizes_allow(n_x, n_y)


def sizes_allow(n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return 100 * np.minimum(n_x, n_y) >= SHARE * np.maximum(n_x, n_y)


def may_link(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Whether sets may be similar enough, ruled out only by what holds for certain: sizes, and the smallest hashes of two
    sets that travel whole."""
    share, _ = bottom_similar(x, y, n_x, n_y)
    whole = (n_x <= BOTTOM) & (n_y <= BOTTOM)
    return sizes_allow(n_x, n_y) & (~whole | (share >= SHARE / 100 - 0.005))


def _digests(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    ends = np.cumsum(sizes)
    found = []
    for salt in (MULTIPLIER, MULTIPLIER >> np.uint64(1)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + salt), dtype=np.uint64)])
        found.append(mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return found[0], found[1]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = filled(batch.column(2))
        for at, to in slices(texts):
            sets, sizes = shingle_sets(texts.slice(at, to - at))
            k1, k2 = _digests(sets, sizes)
            full = sizes > 0
            symbols = np.zeros((to - at, CHUNKS * CHUNK), np.uint32)
            symbols[full] = signatures(sets, sizes[full])
            width = symbols.shape[1] * 4
            packed = pa.Array.from_buffers(pa.binary(width), to - at, [None, pa.py_buffer(symbols.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at), pa.array(sizes), pa.array(k1), pa.array(k2), packed],
                names=["row", "id", "n", "k1", "k2", "signature"],
            )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            keys = bucket_keys(symbols)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], names=["key", "node"]
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = filled(batch.column(0))
        for at, to in slices(texts):
            sets, sizes = shingle_sets(texts.slice(at, to - at))
            k1, k2 = _digests(sets, sizes)
            offsets = pa.array(np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)]))
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(offsets, pa.array(sets.view(np.int64)))], names=["k1", "k2", "shingles"])


def _across(best: bool):
    """Pairs of different components that may be similar, bucket by bucket; rows come sorted by key and component.

    A pair counts in the first of its common buckets only. With `best`, a class sends its LIKELIEST partners alone, as
    judged by the smallest hashes; without, every pair that may be linked."""
    chosen = list(combinations(range(CHUNK), CHUNK - ERRORS))

    def first_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        same = x == y
        return np.stack([same[:, [c * CHUNK + k for k in kept]].all(axis=1) for c in range(CHUNKS) for kept in chosen], axis=1).argmax(axis=1)

    def compare(key, nodes, roots, symbols, sizes, least):
        if len(nodes) < 2 or roots[0] == roots[-1]:
            return
        slot = int(np.nonzero(bucket_keys(symbols[:1])[0].view(np.int64) == key)[0][0])
        for i in range(0, len(nodes), BLOCK):
            found: list[tuple] = []
            x = symbols[i : i + BLOCK]
            for j in range(0 if best else i, len(nodes), BLOCK):
                y = symbols[j : j + BLOCK]
                differ = np.zeros((len(x), len(y)), np.uint8)
                for k in range(x.shape[1]):
                    differ += x[:, k, None] != y[None, :, k]
                near = (differ <= DISTANCE) & (roots[i : i + BLOCK, None] != roots[None, j : j + BLOCK])
                a, b = np.nonzero(near if best or i != j else np.triu(near))
                for at in range(0, len(a), 1 << 15):
                    a_, b_ = a[at : at + (1 << 15)] + i, b[at : at + (1 << 15)] + j
                    here = first_common(symbols[a_], symbols[b_]) == slot
                    a_, b_ = a_[here], b_[here]
                    sketches = least[a_], least[b_], sizes[a_], sizes[b_]
                    share, similar = bottom_similar(*sketches) if best else (np.zeros(len(a_)), may_link(*sketches))
                    found.append((a_[similar], b_[similar], share[similar]))
            if found:
                a, b, share = (np.concatenate(p) for p in zip(*found))
                if best and len(a):
                    order = np.lexsort((-share, a))
                    a, b = a[order], b[order]
                    starts = np.nonzero(np.append(True, a[1:] != a[:-1]))[0]
                    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
                    a, b = a[rank < LIKELIEST], b[rank < LIKELIEST]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(nodes[a], nodes[b])), pa.array(np.maximum(nodes[a], nodes[b]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, root, sizes = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            symbols = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            least = np.full((batch.num_rows, BOTTOM), 0xFFFFFFFF, np.uint32)
            least[np.arange(BOTTOM)[None, :] < np.minimum(sizes, BOTTOM)[:, None]] = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint32)
            if held is not None:
                key, node, root, symbols, sizes, least = (np.concatenate(p) for p in zip(held, (key, node, root, symbols, sizes, least)))
            edges = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist()]
            for start, end in zip(edges, edges[1:]):
                yield from compare(key[start], *(v[start:end] for v in (node, root, symbols, sizes, least)))
            held = tuple(v[edges[-1] :] for v in (key, node, root, symbols, sizes, least))
        if held is not None:
            yield from compare(held[0][0], *held[1:])

    return run


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, the smallest hashes of its set: 32 bits each, in order)."""
    for batch in batches:
        sets, ends = batch.column(1).flatten().to_numpy().view(np.uint64), np.cumsum(np.diff(batch.column(1).offsets.to_numpy()), dtype=np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        packed = [np.minimum(sets[a : min(b, a + BOTTOM)] >> np.uint64(32), np.uint64(0xFFFFFFFE)).astype(np.uint32).tobytes() for a, b in zip(starts.tolist(), ends.tolist())]  # below the padding
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - starts), pa.array(packed, pa.binary())], names=["node", "n", "least"])


def _sets_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, shingles): the whole sets of the classes in `nodes`, from their texts, as a written table."""
    wanted = nodes.join(classes.select("node", "id", "k1", "k2"), "node")
    texts = docs.join(wanted.select("id").distinct(), "id", "left_semi").select("text")
    found = texts.mapInArrow(_sets, "k1 long, k2 long, shingles array<long>").join(wanted.select("node", "k1", "k2"), ["k1", "k2"])
    return written(found.dropDuplicates(["node"]).select("node", "shingles"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return written(both.filter(f"100 * both >= {SHARE} * (sum - both)").select("a", "b"), "links")


def near_duplicates(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links, its own included), kept.

    Texts with fewer than five words are one shingle; texts without a word (null too) have no shingle and no link.
    Rows with a null id take no part: they are kept and have a null component. Repeated rows share a component."""
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return judged(docs).select("id", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows of `df` without near duplicates: of each component the row with the smallest id (of equal ids the first).

    Texts without a word and rows with a null id stay. The columns are those of `df`."""
    given, names = put_aside(df, ROW)
    docs = numbered(given, "documents")
    rows = judged(docs.select(F.col("_row").alias("row"), F.col(names[id_column]).cast("long").alias("id"), F.col(names[text_column]).alias("text")))
    first = rows.filter("n_shingles > 0 AND id IS NOT NULL").groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first")).select("first.row")
    stay = first.unionByName(rows.filter("n_shingles = 0 OR id IS NULL").select("row"))
    stay = stay.select(block_of("row").alias("_block"), F.col("row").alias("_row"))
    return docs.join(stay, ROW, "left_semi").select(*given_back(names))


def judged(docs: DataFrame) -> DataFrame:
    """(row, id, n_shingles, component_id) of documents (row, id, text); rows are unique numbers."""
    signed = written(docs.select("row", "id", "text").mapInArrow(_signed, "row long, id long, n long, k1 long, k2 long, signature binary"), "signatures")
    linked = signed.filter("n > 0 AND id IS NOT NULL")
    classes = written(
        linked.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.min("row").alias("node"), F.max("n").alias("n"), F.min("signature").alias("signature")), "classes"
    )
    keys = classes.select("node", "signature").mapInArrow(_keyed, "key long, node long")
    first = keys.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = written(keys.join(first, "key"), "buckets")
    signature = classes.select("node", "signature")
    stars = shared.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    compared = stars.join(signature.toDF("a", "x"), "a").join(signature.toDF("b", "y"), "b").select("a", "b", "x", "y")
    near = written(compared.mapInArrow(_near, "a long, b long"), "pairs")
    sets = _sets_of(shared.select("node").distinct(), docs, classes)
    links = _confirmed(near, sets)
    roots = components(links)
    for best in (True, False):
        placed = shared.filter("members > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        apart = placed.join(mixed, "key", "left_semi")
        least = sets.join(apart.select("node").distinct(), "node", "left_semi").select("node", "shingles").mapInArrow(_least, "node long, n long, least binary")
        apart = apart.join(signature, "node").join(least, "node").select("key", "node", "root", "signature", "n", "least")
        pairs = apart.repartition("key").sortWithinPartitions("key", "root").mapInArrow(_across(best), "a long, b long").distinct()
        pairs = written(pairs.join(near, ["a", "b"], "left_anti"), "pairs")  # the first of a bucket is its smallest: a < b there too
        near = near.unionByName(pairs)
        links = links.unionByName(_confirmed(pairs, sets))
        roots = components(links)
    roots = written(roots, "components")
    named = classes.join(roots, "node", "left").select("k1", "k2", "id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    answer = written(named.join(least, "root").select("k1", "k2", "component_id"), "answer")
    joined = linked.select("row", "id", "n", "k1", "k2").join(answer, ["k1", "k2"]).select("row", "id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.filter("n = 0 OR id IS NULL").select("row", "id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return joined.unionByName(alone)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within DISTANCE."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= DISTANCE))


SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, ws[i:i + {WORDS - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS i FROM w WHERE len(ws) > 0)
), d AS (SELECT doc_id, md5(array_to_string(g, ' ')) || len(g) AS g FROM s GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM d a JOIN d b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= {SHARE} * (a.n + b.n - shared)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


@query("op1_near_dedup", SQL)
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")
