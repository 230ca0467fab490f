"""Packing token ids into sequences: first-fit decreasing, in randomised groups of documents.

A document longer than a sequence is cut into full pieces and a rest. Within a group of documents, pieces go from long
to short into the first sequence with room; a tournament tree over the sequences' room finds it in log steps. Groups
are drawn by a hash, so they are alike in every part of the corpus and each is packed alone, in one task."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import filled, table
from factloom.llm.registry import query
from factloom.llm.tokens import ENCODE_BYTES, encoder, slices, word_tokenizer_path

LENGTH = 2048
END_ID = 1
GROUP_DOCUMENTS = 4096
SEED = 20261


class RoomTree:
    """The room of each bin at the leaves, the larger of two at each inner node."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for `size`, and how much stood in it; the bin's room shrinks."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bin_, before = node - self.leaves, room[node]
        room[node] = before - size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return bin_, before


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces of equal size keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree = RoomTree(len(sizes) - full, capacity)
    for i in order[full:].tolist():
        bin_, before = tree.place(int(sizes[i]))
        bins[i], offsets[i] = full + bin_, capacity - before
    return bins, offsets


def pieces(df: DataFrame, id_column: str, text_column: str, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document's ids with `end_id`, cut every `length`: row (its place in the scan), id, start, length, ids_crc32,
    doc_tokens, and the ids themselves if wanted. A null or empty text is just `end_id`."""
    names = ["row", "id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        for batch in batches:
            texts = filled(batch.column(2))
            for at, to in slices(texts, ENCODE_BYTES):
                ids, counts = words.encode(texts.slice(at, to - at))
                ends, rows, kept = np.cumsum(counts), [], []
                for row, doc_id, start, end in zip(batch.column(0).slice(at, to - at).to_pylist(), batch.column(1).slice(at, to - at).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    own = np.append(ids[start:end], np.uint32(end_id)).astype("<u4")
                    for cut in range(0, len(own), length):
                        piece = own[cut : cut + length]
                        rows.append((row, doc_id, cut, len(piece), zlib.crc32(piece.tobytes()), len(own)))
                        kept.append(piece)
                columns = {n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows))}
                if with_ids:
                    sizes = np.array([len(p) for p in kept], np.int32)
                    offsets = pa.array(np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)]))
                    columns["ids"] = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(kept).astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names) + (", ids array<int>" if with_ids else ""))


def pack(df: DataFrame, id_column: str, text_column: str, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID, group_documents: int = GROUP_DOCUMENTS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding (of its sequence: up to
    `length`, none where the sequence is a power of two long), and the ids if wanted.

    Every id of every document lies in one piece; offsets in a sequence have no gaps. Repeated rows and rows with a null
    id are packed like any other. Only pieces are shuffled (by group), and a group holds about `group_documents`
    documents whatever the input's size, so a long document or a frequent id does not fill a task."""
    groups = max(1, -(-df.count() // group_documents))
    cut = pieces(df, id_column, text_column, tokenizer_path, length, end_id, with_ids).withColumn("group", F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(groups)))

    def place(t: pa.Table) -> pa.Table:
        sizes = t["length"].to_numpy()
        order = np.lexsort((t["start"].to_numpy(), t["row"].to_numpy()))  # the same packing however the rows arrive
        bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        bins[order], offsets[order] = first_fit_decreasing(sizes[order], length)
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        padding = np.where((used & (used - 1)) == 0, 0, length - used)
        sequence = (t["group"].to_numpy() << 32) + bins
        for name, values in (("sequence_id", sequence), ("offset", offsets), ("padding", padding[bins])):
            t = t.append_column(name, pa.array(values, pa.int64()))
        return t.drop_columns(["row", "group"]).select([*names, *(["ids"] if with_ids else [])])

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"]
    return cut.groupBy("group").applyInArrow(place, ", ".join(f"{n} long" for n in names) + (", ids array<int>" if with_ids else ""))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", word_tokenizer_path()).withColumnRenamed("id", "doc_id")
