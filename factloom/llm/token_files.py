"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames, each with the ids of whole documents; then a skippable frame with the
documents' ids and lengths (itself compressed); then the seek table of the zstandard seekable format, also a skippable
frame: per frame its compressed size, its plain size and the low 32 bits of the xxhash64 of its plain bytes, then the
number of frames, a flag byte and the magic number. Any zstandard reader can decode the file; a reader that knows the
table reads the last bytes, picks the frames of the documents it wants, and decompresses and checks only those.
Ids are little-endian unsigned integers, 16 bits wide where the vocabulary allows, else 32."""
from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import filled, shared_folder, table, written
from factloom.llm.registry import query
from factloom.llm.tokens import ENCODE_BYTES, encoder, slices, word_tokenizer_path

SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS = 1 << 16  # a frame ends with the document that reaches so many ids
LEVEL = 3
END_ID = 2


def _check(plain: bytes) -> int:
    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


class TokenWriter:
    """Writes documents in the order given. `close` finishes the file."""

    def __init__(self, sink, width: int):
        self.sink, self.kind, self.compressor = sink, np.dtype(f"<u{width}"), zstandard.ZstdCompressor(level=LEVEL)
        self.waiting: list[np.ndarray] = []
        self.held, self.frames, self.ids, self.sizes = 0, [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_IDS:
            self._frame()

    def _frame(self) -> None:
        plain = np.concatenate(self.waiting).astype(self.kind).tobytes()
        packed = self.compressor.compress(plain)
        self.sink.write(packed)
        self.frames.append((len(packed), len(plain), _check(plain)))
        self.waiting, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._frame()
        null = np.array([i is None for i in self.ids], np.uint8)
        index = struct.pack("<BQ", self.kind.itemsize, len(self.ids)) + np.array([i or 0 for i in self.ids], "<i8").tobytes() + null.tobytes() + np.array(self.sizes, "<u8").tobytes()
        packed = self.compressor.compress(index)
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        self.frames.append((len(packed) + 8, 0, _check(index)))
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.sink.write(struct.pack("<II", SKIPPABLE_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEKABLE))
        self.sink.close()


class TokenReader:
    """Reads the documents of one file; `source` is a seekable binary file."""

    def __init__(self, source):
        self.source, self.decompressor = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2)
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table")
        self.table = np.frombuffer(self._at(end - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3).astype(np.int64)
        self.places = np.cumsum(self.table[:, 0]) - self.table[:, 0]
        index = self._plain(frames - 1, skip=8)
        width, n = struct.unpack_from("<BQ", index)
        self.kind = np.dtype(f"<u{width}")
        self.null = np.frombuffer(index, np.uint8, n, 9 + 8 * n).astype(bool)
        self.ids = np.frombuffer(index, "<i8", n, 9)
        self.sizes = np.frombuffer(index, "<u8", n, 9 + 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.frame_ends = np.cumsum(self.table[:-1, 1]) // width

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def _plain(self, frame: int, skip: int = 0) -> bytes:
        plain = self.decompressor.decompress(self._at(int(self.places[frame]) + skip, int(self.table[frame, 0]) - skip))
        if _check(plain) != self.table[frame, 2]:
            raise ValueError(f"frame {frame}: checksum differs")
        return plain

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in the file, ids), of all documents or of those wanted."""
        held, plain = -1, np.zeros(0, self.kind)
        for doc_id, null, start, size in zip(self.ids.tolist(), self.null.tolist(), self.starts.tolist(), self.sizes.tolist()):
            if wanted is not None and (null or doc_id not in wanted):
                continue
            frame = int(np.searchsorted(self.frame_ends, start, side="right"))
            if frame >= len(self.frame_ends):  # only documents without ids stand there
                yield None if null else doc_id, start, np.zeros(0, np.uint32)
                continue
            if frame != held:
                held, plain = frame, np.frombuffer(self._plain(frame), self.kind)
            base = int(self.frame_ends[frame - 1]) if frame else 0
            yield None if null else doc_id, start, plain[start - base : start - base + size].astype(np.uint32)


def write_tokens(df: DataFrame, id_column: str, text_column: str, folder: str, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes all texts to files in `folder` in ascending id order, nulls first, equal ids by a hash of their text.

    Returns the manifest, a written table: part (files in order), path, n_docs, n_ids, base (ids in all files before).
    A null or empty text is just `end_id`. Each task writes one file under a name of its own and reports it at its end,
    so a lost or repeated task leaves at most a file that the manifest does not name. No table without rows has files."""
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, n_ids, words = None, "", 0, encoder(tokenizer_path)
        for batch in batches:
            texts = filled(batch.column(1))
            for at, to in slices(texts, ENCODE_BYTES):
                if writer is None:
                    store, inner = pa.fs.FileSystem.from_uri(folder)
                    store.create_dir(inner, recursive=True)
                    path = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
                    writer = TokenWriter(store.open_output_stream(f"{inner}/{path}", compression=None), 2 if max(words.vocabulary, end_id + 1) <= 1 << 16 else 4)
                ids, counts = words.encode(texts.slice(at, to - at))
                ends = np.cumsum(counts)
                for doc_id, start, end in zip(batch.column(0).slice(at, to - at).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    writer.add(doc_id, np.append(ids[start:end], np.uint32(end_id)))
                n_ids += len(ids) + len(counts)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [f"{folder}/{path}"], "n_docs": [len(writer.ids)], "n_ids": [n_ids]})

    files = written(rows.mapInArrow(write, "part long, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, wanted: set[int] | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document (or per wanted id): id, start (ids of all documents before), n_tokens, ids_crc32, ids.

    Frames that hold no wanted document are not read."""
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, inner = pa.fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as source:
                    rows, held = [], 0
                    for doc_id, start, ids in TokenReader(source).documents(wanted):
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids if with_ids else None))
                        held += len(ids) if with_ids else 1
                        if held >= 1 << 20:
                            yield _batch(rows, with_ids)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, with_ids)

    schema = "id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return manifest.select("path", "base").repartition(files).mapInArrow(read, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows))
    data = {n: pa.array(c, pa.int64()) for n, c in zip(("id", "start", "n_tokens", "ids_crc32"), columns)}
    return pa.RecordBatch.from_pydict(data | ({"ids": pa.array(columns[4], pa.list_(pa.int64()))} if with_ids else {}))


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", shared_folder(spark, "tokens"), word_tokenizer_path())
    return read_tokens(manifest, with_ids=False).withColumnRenamed("id", "doc_id")
