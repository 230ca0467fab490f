"""WARC archives: writing responses, revisits and segmented records, and putting segments together again.

Every record is a gzip member of its own. A response's block is an HTTP message with a chunked body; a block longer than
`segment_bytes` goes on in continuation records that name their origin and their number, the last one with the total
length. Reading groups continuation records by origin, orders them by number, checks numbers and total length, takes the
chunk framing apart and checks length and digest of the payload."""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import ROW, numbered, shared_folder, small_batches, table, written
from factloom.llm.registry import query

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
MIN_REVISIT_BYTES = 0
LEVEL = 4
_READ = 64 << 10
_PAGE_ROWS, _SEGMENT_ROWS = 256, 64  # rows of a batch of whole pages, of segments
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        if body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("chunk is cut")
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def records_of(page_id: int | None, url: str | None, html: str | None, response_id: int | None, revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    """The gzip members of one page."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = f"<urn:page:{'' if page_id is None else page_id}:{uuid.uuid4()}>"
    named = [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if url is not None:
        named.insert(0, ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url)))
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        yield _record("revisit", own, [*named, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<urn:page:{'' if response_id is None else response_id}>")], message)
        return
    block = message + chunked(payload)
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(cuts) == 1:
        yield _record("response", own, named, block)
        return
    yield _record("response", own, [*named, ("WARC-Segment-Number", "1")], cuts[0])
    for number, cut in enumerate(cuts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if number == len(cuts) else []
        yield _record("continuation", f"<urn:uuid:{uuid.uuid4()}>", [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(number)), *last], cut)


def members(source) -> Iterator[bytes]:
    """The plain bytes of each gzip member of a file, read in small pieces."""
    left = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not (data := left or source.read(_READ)):
                if parts:
                    raise ValueError("archive ends inside a record")
                return
            left = b""
            parts.append(unpacker.decompress(data))
        left = unpacker.unused_data
        yield b"".join(parts)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def write_archives(df: DataFrame, id_column: str, url_column: str, payload_column: str, folder: str, segment_bytes: int = SEGMENT_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes every row as a record and returns the manifest, a written table: path, n_pages, bytes.

    Of rows with equal payloads of at least `min_revisit_bytes` the one with the largest id is the response (a null id is
    the smallest; rows that repeat the largest id are responses too). A null payload is empty. Each task names its own file and reports it at its end, so what
    a lost task leaves behind is not in the manifest. Responses are chosen on ids and digests alone; the answer, a few
    bytes a row, goes back to the block of rows that its payload stands in, so payloads are not dealt anew and one
    payload shared by many rows fills no task."""
    spark = df.sparkSession
    payload = F.coalesce(F.col(payload_column), F.lit(""))
    pages = df.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), payload.alias("payload"))
    pages = pages.withColumn("digest", F.unhex(F.sha1(F.encode("payload", "UTF-8")))).withColumn("size", F.octet_length("payload"))
    rows = numbered(pages, "warc_pages", small_batches(spark, _PAGE_ROWS))
    first = rows.filter(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("response"), F.lit(True).alias("large"))
    revisit = F.coalesce(F.col("large"), F.lit(False)) & ~F.col("id").eqNullSafe(F.col("response"))
    answer = rows.select(*ROW, "id", "digest").join(first, "digest", "left").select(*ROW, "response", revisit.alias("revisit"))
    told = rows.join(answer.hint("shuffle_hash"), ROW)
    told = told.select("id", "url", "payload", "response", "revisit")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, path, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, response_id, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    store, inner = pa.fs.FileSystem.from_uri(folder)
                    store.create_dir(inner, recursive=True)
                    path = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    sink = store.open_output_stream(f"{inner}/{path}", compression=None)
                for member in records_of(page_id, url, html, response_id, revisit, segment_bytes):
                    sink.write(member)
                    size += len(member)
                n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "n_pages": [n], "bytes": [size]})

    return written(told.mapInArrow(write, "path string, n_pages long, bytes long"), "warc-manifest", reader=spark)


_RAW = "origin string, segment long, total long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, problem string, block binary"
_NAMES = [c.split(" ")[0] for c in _RAW.split(", ")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, _TYPES[c.split(" ")[1]]) for c, v in zip(_RAW.split(", "), zip(*rows))], names=_NAMES)


def _id(text: str) -> int | None:
    found = re.match(r"<urn:page:(-?\d+)", text)
    return int(found[1]) if found else None


def _checked(headers: dict[str, str], block: bytes | None) -> tuple[int | None, str | None, str | None]:
    """Payload length and digest of a whole response, and what is wrong with it."""
    try:
        head, _, body = block.partition(b"\r\n\r\n")
        payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError as error:
        return None, None, str(error)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    stated = headers.get("WARC-Payload-Digest", f"sha1:{digest}"), int(headers.get("WARC-Payload-Length", len(payload)))
    return len(payload), digest, None if stated == (f"sha1:{digest}", len(payload)) else "payload differs from its header"


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per page: page_id, record_type, refers_to, payload_bytes, payload_digest, problem (null when all is well).

    Whole records are judged where they are read; only segments are shuffled, by their origin, and streamed in order
    in small batches, so a task holds one record at a time. The result is a written table. A record with a missing, repeated or cut segment has its problem named."""
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = pa.fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(inner) as source:
                    for member in members(source):
                        h, block = parsed(member)
                        kind, own, stated = h["WARC-Type"], h["WARC-Record-ID"], int(h.get("WARC-Payload-Length", -1))
                        digest = h.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                        if kind == "continuation" or "WARC-Segment-Number" in h:
                            total = int(h["WARC-Segment-Total-Length"]) if "WARC-Segment-Total-Length" in h else None
                            rows.append((h.get("WARC-Segment-Origin-ID", own), int(h["WARC-Segment-Number"]), total, _id(own), kind, None, stated, digest, None, block))
                        elif kind == "revisit":
                            rows.append((own, None, None, _id(own), kind, _id(h["WARC-Refers-To"]), stated, digest, None, None))
                        else:
                            rows.append((own, None, None, _id(own), kind, None, *_checked(h, block), None))
                        held += len(block) + 200
                        if held > 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        done: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():  # at most _SEGMENT_ROWS segments
                if group and group[0]["origin"] != row["origin"]:
                    done.append(_joined(group))
                    group = []
                group.append(row)
            if len(done) > 1000:
                yield _rows(done)
                done = []
        if group:
            done.append(_joined(group))
        if done:
            yield _rows(done)

    few = small_batches(manifest.sparkSession, _SEGMENT_ROWS)
    raw = written(manifest.select("path").repartition(files).mapInArrow(read, _RAW), "warc-records", reader=few)
    segments = raw.filter(F.col("segment").isNotNull()).repartition("origin").sortWithinPartitions("origin", "segment")
    whole = raw.filter(F.col("segment").isNull()).drop("block").unionByName(segments.mapInArrow(join, _RAW).drop("block"))
    whole = written(whole, "warc-pages", reader=manifest.sparkSession)
    return whole.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "problem")


def _joined(group: list[dict]) -> tuple:
    first, block = group[0], b"".join(r["block"] for r in group)
    numbers, total = [r["segment"] for r in group], group[-1]["total"]
    row = (first["origin"], None, None, _id(first["origin"]), "response", None)
    if numbers != list(range(1, len(group) + 1)) or total is None:
        return *row, None, None, "segments missing or repeated", None
    if total != len(block):
        return *row, None, None, "segments do not add up to the total length", None
    return *row, *_checked({"WARC-Payload-Digest": f"sha1:{first['payload_digest']}", "WARC-Payload-Length": first["payload_bytes"]}, block), None


_FIVE = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))

SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
l AS (SELECT payload, max(page_id) AS response FROM p GROUP BY payload)
SELECT page_id, CAST(strlen(p.payload) AS BIGINT) AS payload_bytes, {_FIVE} AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN l USING (payload)"""


@query("op9_warc", SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html", shared_folder(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
