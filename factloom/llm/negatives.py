"""Hard negatives by a multiway hyperplane tree with distance ranges.

A node of the tree has up to WAYS split points; a row belongs to the nearest. The tree is fitted on a bounded sample, then
every row is routed through it to its leaf, and each split point learns the range of its distances to the rows of
every sibling subtree. A search asks for the rows whose inner product with an anchor lies in a window. With the
range of the rows' lengths that is an annulus around the anchor; a subtree is passed over when, for any split point of
its node, the distances that the annulus allows do not meet the range of the subtree. Rows of the leaves that remain are
scored exactly, in integers, so the elimination saves work and never changes a result.

Rows lie in the order of their leaves, so a task holds few leaves, and a large leaf is shared by several tasks. A
task takes its rows in chunks and reads the anchors from the shared folder in batches, so neither side is ever whole in
one place. Rows with equal vectors and labels are one class with its smallest ids: no result needs more of them."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import partitions, shared_folder, table, written
from factloom.llm.registry import query
from factloom.operators.joins import salted_join

POSITIVES, NEGATIVES = 5, 5
LOWEST = 80  # a negative has at least so many hundredths of the positive's score
SCALE = 256
WAYS, LEAF_SAMPLE, MAX_LEVELS = 8, 16, 16
SAMPLE_ROWS = 4096  # classes that the tree is fitted on, drawn by hash
SEED = 20263
CHUNK_ROWS, CHUNK_VALUES = 16_384, 1 << 22
ANCHOR_ROWS = 256
_ALL = 1 << 62


@dataclass
class Node:
    points: np.ndarray  # split points, one a row
    children: list  # of each split point: a Node, or the number of a leaf
    first: int  # leaves below: first to last
    last: int = 0
    low: np.ndarray = field(default=None)  # [i, j]: smallest squared distance of point i to a row of child j
    high: np.ndarray = field(default=None)
    shortest: np.ndarray = field(default=None)  # squared lengths of the rows of each child
    longest: np.ndarray = field(default=None)


def squared_distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (rows @ points.T)


def fitted(sample: np.ndarray, ways: int = WAYS, leaf_rows: int = LEAF_SAMPLE) -> list[Node]:
    """The inner nodes of a tree over the sample, the root first; empty where the sample is one leaf."""
    rng, nodes, leaves = np.random.default_rng(SEED), [], 0

    def grow(rows: np.ndarray, level: int):
        nonlocal leaves
        chosen = [] if len(rows) <= leaf_rows or level >= MAX_LEVELS else _split_points(rows, ways, rng)
        if len(chosen) < 2:
            leaves += 1
            return leaves - 1
        node = Node(rows[chosen], [], leaves)
        nodes.append(node)
        nearest = squared_distances(rows, node.points).argmin(1)
        node.children = [grow(rows[nearest == j], level + 1) for j in range(len(chosen))]
        node.last = leaves - 1
        return node

    if len(sample):
        grow(sample, 0)
    for node in nodes:
        m = len(node.points)
        node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        node.shortest, node.longest = np.full(m, np.inf), np.full(m, -np.inf)
    return nodes


def _split_points(rows: np.ndarray, ways: int, rng: np.random.Generator) -> list[int]:
    """Rows far from each other: of a few drawn ones, always the one farthest from those chosen."""
    drawn = rng.choice(len(rows), min(len(rows), 3 * ways), replace=False)
    apart = squared_distances(rows[drawn], rows[drawn])
    chosen, nearest = [0], apart[0].copy()
    while len(chosen) < min(ways, len(drawn)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, apart[chosen[-1]])
    return drawn[chosen].tolist()


def routed(nodes: list[Node], rows: np.ndarray, learn: bool = False) -> np.ndarray:
    """The leaf of each row. With `learn`, the nodes take note of the rows' distances and lengths."""
    leaf = np.zeros(len(rows), np.int32)
    lengths = (rows * rows).sum(1)
    work = [(nodes[0], np.arange(len(rows)))] if nodes and len(rows) else []
    while work:
        node, at = work.pop()
        distances = squared_distances(rows[at], node.points)
        nearest = distances.argmin(1)
        for j, child in enumerate(node.children):
            own = nearest == j
            if not own.any():
                continue
            if learn:
                node.low[:, j] = np.minimum(node.low[:, j], distances[own].min(0))
                node.high[:, j] = np.maximum(node.high[:, j], distances[own].max(0))
                node.shortest[j] = min(node.shortest[j], lengths[at[own]].min())
                node.longest[j] = max(node.longest[j], lengths[at[own]].max())
            if isinstance(child, Node):
                work.append((child, at[own]))
            else:
                leaf[at[own]] = child
    return leaf


def open_leaves(nodes: list[Node], anchors: np.ndarray, lowest: np.ndarray, highest: np.ndarray, first: int, last: int) -> np.ndarray:
    """[anchor, leaf - first]: whether a leaf of first..last may hold a row whose score is in lowest..highest of the anchor."""
    alive = np.ones((len(anchors), last - first + 1), bool)
    lengths = (anchors * anchors).sum(1)
    work = [(nodes[0], np.ones(len(anchors), bool))] if nodes else []
    while work:
        node, asked = work.pop()
        apart = np.sqrt(np.maximum(squared_distances(anchors, node.points), 0))
        for j, child in enumerate(node.children):
            from_, to = (child.first, child.last) if isinstance(child, Node) else (child, child)
            if to < first or from_ > last:
                continue
            if node.longest[j] < 0:  # no row went there
                meets = np.zeros(len(anchors), bool)
            else:
                outer = np.sqrt(np.maximum(lengths + node.longest[j] - 2.0 * lowest, 0))[:, None] * (1 + 1e-9) + 1e-3
                inner = np.sqrt(np.maximum(lengths + node.shortest[j] - 2.0 * highest, 0))[:, None] * (1 - 1e-9) - 1e-3
                near, far = np.sqrt(node.low[:, j]), np.sqrt(node.high[:, j])
                meets = asked & ((apart + outer >= near) & (np.maximum(apart - outer, inner - apart) <= far)).all(1)
                meets &= lengths + node.longest[j] - 2.0 * lowest >= 0
            alive[:, max(from_, first) - first : min(to, last) - first + 1] &= meets[:, None]
            if isinstance(child, Node) and meets.any():
                work.append((child, meets))
    return alive


def matrix(column: pa.Array, dimension: int, kind: type) -> np.ndarray:
    """One row a vector; a shorter vector is filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dimension).all():
        return values.reshape(len(column), dimension).astype(kind)
    out = np.zeros((len(column), dimension), kind)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def in_windows(nodes: list[Node], leaf: np.ndarray, rows: np.ndarray, labels: np.ndarray, ids: list[list], anchors: np.ndarray, own: np.ndarray, windows: list[list[tuple[int, int]]], same: bool, k: int) -> Iterator[tuple[int, int, int, int | None]]:
    """(anchor, window, score, id) of the first `k` rows of a chunk in each window of each anchor, among rows of the anchor's
    label (`same`) or of the others. `rows` are classes in the order of their leaves; `ids` are their smallest ids in order."""
    lowest = np.array([min((w[0] for w in ws), default=1) for ws in windows], np.float64)
    highest = np.array([max((w[1] for w in ws), default=0) for ws in windows], np.float64)
    alive = open_leaves(nodes, anchors, lowest, highest, int(leaf[0]), int(leaf[-1])) & (lowest <= highest)[:, None]
    cuts = np.flatnonzero(np.diff(leaf, prepend=-1))
    found = []
    for a, b in zip(cuts, [*cuts[1:], len(leaf)]):
        asked = np.flatnonzero(alive[:, leaf[a] - leaf[0]])
        if len(asked):
            scores = anchors[asked] @ rows[a:b].T
            hit = (scores >= lowest[asked, None]) & (scores <= highest[asked, None]) & ((own[asked, None] == labels[None, a:b]) == same)
            i, j = np.nonzero(hit)
            found.append((asked[i], a + j, scores[i, j].astype(np.int64)))
    if not found:
        return
    who, row, score = (np.concatenate(c) for c in zip(*found))
    smallest = np.array([-_ALL if i[0] is None else i[0] for i in ids], np.int64)
    order = np.lexsort((smallest[row], -score, who))
    who, row, score = who[order], row[order], score[order]
    begins = np.searchsorted(who, np.arange(len(anchors) + 1))
    for anchor in np.unique(who).tolist():
        a, b = begins[anchor], begins[anchor + 1]
        for w, (low, high) in enumerate(windows[anchor]):
            # the scores fall: first place of at most `high`, first place under `low`
            from_ = a + int(np.searchsorted(-score[a:b], -high, side="left"))
            to = a + int(np.searchsorted(-score[a:b], -low, side="right"))
            # k classes in this order hold the first k rows: each has a row before all rows of later classes
            best = sorted((-int(score[x]), i is not None, i) for x in range(from_, min(to, from_ + k)) for i in ids[row[x]])[:k]
            for minus, _, i in best:
                yield anchor, w, -minus, i


def quantized(df: DataFrame, id_column: str, vector_column: str, label_column: str, scale: int = SCALE) -> DataFrame:
    """(id, label, q) of the rows that take part: `q` is floor(scale * x) of each component. Rows with a null label, a
    null vector or a null or non-finite component are left out."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows.filter("label IS NOT NULL AND v IS NOT NULL").filter(finite).select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q"))


def _learned(spark: SparkSession, classes: DataFrame, nodes: list[Node], dimension: int, kind: type) -> list[Node]:
    """The nodes with the ranges of all rows: each task notes its own, a bounded table of the tree's size joins them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            routed(nodes, matrix(batch.column(0), dimension, kind), learn=True)
        out = [(n, i, j, node.low[i, j], node.high[i, j], node.shortest[j], node.longest[j]) for n, node in enumerate(nodes) for i in range(len(node.points)) for j in range(len(node.points)) if node.longest[j] >= 0]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["n", "i", "j", "low", "high", "shortest", "longest"])

    told = classes.select("q").mapInArrow(run, "n long, i long, j long, low double, high double, shortest double, longest double")
    for r in told.groupBy("n", "i", "j").agg(*[F.min(c).alias(c) for c in ("low", "shortest")], *[F.max(c).alias(c) for c in ("high", "longest")]).toLocalIterator():
        node = nodes[r.n]
        node.low[r.i, r.j], node.high[r.i, r.j], node.shortest[r.j], node.longest[r.j] = r.low, r.high, r.shortest, r.longest
    return nodes


@dataclass
class Index:
    """Classes in the order of their leaves, and what the tasks need to search them."""

    rows: DataFrame  # label, q, ids, leaf
    nodes: list[Node]
    sample: tuple[np.ndarray, np.ndarray, np.ndarray]  # vectors, labels, number of ids of the sampled classes
    dimension: int
    kind: type


def indexed(rows: DataFrame, keep: int) -> Index:
    """The index of all rows (id, label, q), with the `keep` smallest ids of each class (null ids first)."""
    spark = rows.sparkSession
    place = F.row_number().over(Window.partitionBy("label", "q").orderBy("id"))
    few = rows.withColumn("_place", place).filter(F.col("_place") <= keep)  # pruned in the tasks, before the shuffle
    ids = F.transform(F.sort_array(F.collect_list(F.struct("id"))), lambda s: s["id"])
    classes = written(few.groupBy("label", "q").agg(ids.alias("ids")), "classes")
    size = classes.agg(F.max(F.size("q")).alias("n"), F.max(F.greatest(F.coalesce(F.array_max("q"), F.lit(0)), -F.coalesce(F.array_min("q"), F.lit(0)))).alias("most")).first()
    dimension, most = max(size.n or 1, 1), size.most or 0
    if 4 * dimension * most * most >= 1 << 62:
        raise ValueError(f"components up to {most} in {dimension} dimensions: scores do not fit a long")
    kind = np.float64 if 4 * dimension * most * most < 1 << 53 else np.int64  # doubles hold every sum exactly, or else longs
    drawn = classes.select("q", "label", F.size("ids").alias("n")).orderBy(F.xxhash64("q", "label", F.lit(SEED))).limit(SAMPLE_ROWS).toPandas()
    vectors = np.zeros((len(drawn), dimension), kind)
    for i, q in enumerate(drawn["q"]):
        vectors[i, : len(q)] = q
    nodes = fitted(vectors)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = routed(nodes, matrix(batch.column(1), dimension, kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["label", "q", "ids", "leaf"])

    placed = classes.select("label", "q", "ids").mapInArrow(route, "label long, q array<long>, ids array<long>, leaf int")
    # a leaf of any size is shared out by a hash of its vectors
    ordered = written(placed.repartitionByRange(partitions(spark), "leaf", F.xxhash64("q")).sortWithinPartitions("leaf"), "leaves")
    return Index(ordered, _learned(spark, ordered, nodes, dimension, kind), (vectors, drawn["label"].to_numpy(np.int64), drawn["n"].to_numpy(np.int64)), dimension, kind)


def search(index: Index, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """(key, window, score, id): for each window (a place in the array `windows` of lowest and highest scores) of each anchor
    (key, label, q, windows) the first `k` rows by score, then id, among rows of the anchor's label or of the others."""
    spark, nodes, dimension, kind = anchors.sparkSession, index.nodes, index.dimension, index.kind
    folder = shared_folder(spark, "anchors")
    anchors.select("key", "label", "q", "windows").write.parquet(folder)
    chunk_rows = max(256, min(CHUNK_ROWS, CHUNK_VALUES // dimension))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), chunk_rows):
                part = batch.slice(at, chunk_rows)
                if n + len(part) > chunk_rows:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
                held.append(part)
                n += len(part)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = pa.fs.FileSystem.from_uri(folder)
        for chunk in chunks(batches):
            chunk = chunk.take(pa.array(np.argsort(chunk["leaf"].to_numpy(), kind="stable"))).combine_chunks()
            rows, labels = matrix(chunk["q"].combine_chunks(), dimension, kind), chunk["label"].to_numpy()
            leaf, ids = chunk["leaf"].to_numpy(), chunk["ids"].to_pylist()
            for batch in pa.dataset.dataset(inner, filesystem=store, format="parquet").to_batches(batch_size=ANCHOR_ROWS):
                if not len(batch):
                    continue
                windows = [[(w["low"], w["high"]) for w in ws] for ws in batch.column("windows").to_pylist()]
                found = list(in_windows(nodes, leaf, rows, labels, ids, matrix(batch.column("q"), dimension, kind), batch.column("label").to_numpy(), windows, same, k))
                if found:
                    who, window, score, id_ = zip(*found)
                    key = batch.column("key").take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([key, pa.array(window, pa.int32()), pa.array(score, pa.int64()), pa.array(id_, pa.int64())], names=["key", "window", "score", "id"])

    found = index.rows.select("label", "q", "ids", "leaf").mapInArrow(run, "key string, window int, score long, id long")
    place = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def _from_sample(index: Index, anchors: DataFrame, k: int) -> DataFrame:
    """Anchors (key, label, q) with one window: the k-th best score among sampled rows of the label and all above. There
    are as many rows there at least, so the window holds the first k."""
    vectors, labels, counts = index.sample
    dimension, kind = index.dimension, index.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lowest = []
            for at in range(0, len(batch), ANCHOR_ROWS):
                part = batch.slice(at, ANCHOR_ROWS)
                scores = matrix(part.column(2), dimension, kind) @ vectors.T
                for own, label in zip(scores, part.column(1).to_pylist()):
                    mine = np.flatnonzero(labels == label)
                    order = mine[np.argsort(-own[mine], kind="stable")]
                    enough = int(np.searchsorted(np.cumsum(counts[order]), k))
                    lowest.append(int(own[order[enough]]) if enough < len(order) else -_ALL)
            windows = pa.array([[{"low": x, "high": _ALL}] for x in lowest], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, windows], names=["key", "label", "q", "windows"])

    return anchors.select("key", "label", "q").mapInArrow(run, "key string, label long, q array<long>, windows array<struct<low long, high long>>")


def hard_negatives(df: DataFrame, id_column: str, vector_column: str, label_column: str, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, scale: int = SCALE) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are integer inner products of the quantized vectors. `anchor` is a condition on the columns `id` and `label` of a
    row. An anchor's positives are the first `positives` other rows of its label by score, then id; for each, the first
    `negatives` rows of other labels are returned whose score is `lowest` hundredths of the positive's score to all of it. A
    positive without any has no row.

    Rows with a null label, a null vector or a null or non-finite component take no part. A null id is the smallest. Repeated
    rows are rows of their own: a repeated anchor gives its rows again, and its copy is its best positive. A shorter
    vector counts as filled up with zeros. Vectors whose scores may leave a long are refused."""
    keep = max(positives + 1, negatives)  # one more: the anchor itself is among them
    rows = quantized(df, id_column, vector_column, label_column, scale)
    index = indexed(rows, keep)
    key = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("q").cast("array<string>")), 256)
    asked = written(rows.filter(anchor).select("id", "label", "q", key.alias("key")), "asked")
    different = asked.groupBy("key").agg(F.first("label").alias("label"), F.first("q").alias("q"))  # equal anchors search once
    different = written(different, "different")
    near = search(index, _from_sample(index, different, positives + 1), True, positives + 1)
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("id"))))
    near = written(near.groupBy("key").agg(best.alias("near")), "positives")

    def window(score: Column) -> Column:
        share = score * lowest
        rest = F.pmod(share, F.lit(100))
        whole = ((share - rest) / 100).cast("decimal(38,0)").cast("long")
        return F.struct((whole + F.when(rest > 0, 1).otherwise(0)).alias("low"), score.alias("high"))

    scores = F.array_distinct(F.transform("near", lambda p: -p["minus"]))
    windows = different.join(near, "key").select("key", "label", "q", F.transform(scores, window).alias("windows"), scores.alias("scores"))
    windows = written(windows, "windows")
    far = search(index, windows, False, negatives)
    far = far.groupBy("key", "window").agg(best.alias("far"))
    far = far.groupBy("key").agg(F.collect_list(F.struct("window", "far")).alias("far"))
    told = near.join(far, "key").join(windows.select("key", "scores"), "key")
    length = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x * x)
    own = asked.select(F.col("id").alias("anchor_id"), "key", (-length).alias("own"))
    joined = salted_join(own, told, ["key"], "inner")  # a third of the anchors may be alike
    self = F.array_position("near", F.struct(F.col("own").alias("minus"), F.col("anchor_id").alias("id")))
    others = F.slice(F.filter("near", lambda p, i: i != F.col("self") - 1), 1, positives)
    pairs = joined.withColumn("self", self).select("anchor_id", "scores", "far", F.explode(others).alias("p"))
    pairs = pairs.select("anchor_id", F.col("p.id").alias("positive_id"), (-F.col("p.minus")).alias("positive_score"), "scores", "far")
    mine = F.filter("far", lambda w: F.get("scores", w["window"]) == F.col("positive_score"))
    ranked = pairs.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.flatten(F.transform(mine, lambda w: w["far"]))).alias("at", "n"))
    return ranked.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.minus")).alias("negative_score"))


SQL = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LOWEST} * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= {NEGATIVES}"""


@query("op12_hard_negatives", SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), "vec_id", "embedding", "label", F.col("id") % 100 == 0)
