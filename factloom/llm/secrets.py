"""Secret scans: a worklist of decoded layers per document.

The text is the first layer. Every layer is scanned with the same patterns, then unwrapped: percent escapes and Unicode
escapes give the layer with the escapes replaced, a base64 run gives the text or the compressed data inside it, compressed
data gives what it holds. What comes out goes on the worklist, until nothing new comes out; a layer that the same
place has already given is not taken again, so data that unpacks to itself ends. Every code point of a layer carries the
range of the document it was decoded from, so a match in any layer is a span of the document. A match in a deeper layer
counts only when it holds something that was decoded: the rest has been matched above it."""
from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import filled, table
from factloom.llm.registry import query

#: Fixed patterns, in the order in which spans of equal start are listed, and the shortest match that counts.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED, MIN_ACCESS = 6, 20
UNREAD = "unread"  # a layer beyond the limits below: listed, not read

MAX_LAYER_BYTES = 64 << 20  # of one decompressed layer
MAX_DEPTH = 32

#: A text without a match of this holds neither a secret nor anything to unwrap.
_WORTH = r"(?i)passw|secret|token|api_?key|%u?[0-9a-f]{2}|\\[ux]|&#|[a-z0-9+/_-]{16}"
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|%u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]{16,})*(?:\r?\n[A-Za-z0-9+/_-]+)?={0,2}")
_URL_SAFE = str.maketrans("-_", "+/")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")

_SPANS = "array<struct<kind string, start long, end long, base boolean, path string, match string>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("path", pa.string()), ("match", pa.string())]))


@dataclass
class Layer:
    """Decoded content, and for each of its code points (bytes) the range of the document it stands for."""

    content: str | bytes
    starts: np.ndarray
    ends: np.ndarray
    decoded: np.ndarray  # whether a code point came out of any decoding
    path: str

    @property
    def depth(self) -> int:
        return self.path.count(">") + 1 if self.path else 0

    def key(self) -> tuple:
        data = self.content.encode("utf-8", "surrogatepass") if isinstance(self.content, str) else self.content
        return type(self.content), hashlib.blake2b(data, digest_size=16).digest(), int(self.starts[0]), int(self.ends[-1])


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of every match in one text: leftmost, not overlapping within a kind; too short ones dropped."""
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= MIN_ASSIGNED:
            yield "assign", m.start(), m.end()
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= MIN_ACCESS:
            yield "access", m.start(), m.end()
    for m in _HEX_LONG.finditer(text):  # a maximal run of 24 and more is what a shorter run's drop leaves
        yield "hex", m.start(), m.end()


def _replaced(layer: Layer, found: list[tuple[int, int, str, list[tuple[int, int]]]], name: str) -> Layer | None:
    """The layer with each (from, to, new text, source range of each new code point) put in place."""
    if not found:
        return None
    texts, starts, ends, decoded, at = [], [], [], [], 0
    for from_, to, new, ranges in found:
        texts += [layer.content[at:from_], new]
        starts += [layer.starts[at:from_], np.array([layer.starts[a] for a, _ in ranges], np.int64)]
        ends += [layer.ends[at:from_], np.array([layer.ends[b - 1] for _, b in ranges], np.int64)]
        decoded += [layer.decoded[at:from_], np.ones(len(new), bool)]
        at = to
    texts.append(layer.content[at:])
    return Layer("".join(texts), *(np.concatenate([*parts, whole[at:]]) for parts, whole in ((starts, layer.starts), (ends, layer.ends), (decoded, layer.decoded))), f"{layer.path}>{name}".lstrip(">"))


def _inner(layer: Layer, data: bytes, first: np.ndarray, last: np.ndarray, name: str) -> Layer:
    """A layer of bytes; each came from the code points `first` to `last` of `layer`."""
    return Layer(data, layer.starts[first], layer.ends[last], np.ones(len(data), bool), f"{layer.path}>{name}".lstrip(">"))


def _percent(layer: Layer) -> Iterator[Layer]:
    found = []
    for m in _PERCENT.finditer(layer.content):
        data, first = binascii.unhexlify(m[0].replace("%", "")), m.start()
        if _is_compressed(data):
            place = first + 3 * np.arange(len(data))
            yield _inner(layer, data, place, place + 2, "url")
        at = 0
        while at < len(data):  # code point by code point; a byte that begins none stays escaped
            size = next((n for n in (1, 2, 3, 4) if _is_character(data[at : at + n], n)), 0)
            if size:
                a, b = first + 3 * at, first + 3 * (at + size)
                found.append((a, b, data[at : at + size].decode(), [(a, b)]))
            at += size or 1
    if (whole := _replaced(layer, found, "url")) is not None:
        yield whole


def _is_character(data: bytes, size: int) -> bool:
    try:
        return len(data) == size and len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def _escapes(layer: Layer) -> Iterator[Layer]:
    found: list[tuple[int, int, str, list[tuple[int, int]]]] = []
    for m in _ESCAPE.finditer(layer.content):
        digits = next(g for g in m.groups() if g is not None)
        code = int(digits, 10 if m[6] is not None else 16)
        if code > 0x10FFFF:
            continue
        if 0xDC00 <= code < 0xE000 and found and found[-1][1] == m.start() and 0xD800 <= ord(found[-1][2]) < 0xDC00:
            a, _, high, _ = found.pop()  # the second half of a pair
            code = 0x10000 + ((ord(high) - 0xD800) << 10) + (code - 0xDC00)
            found.append((a, m.end(), chr(code), [(a, m.end())]))
        else:
            found.append((m.start(), m.end(), chr(code), [(m.start(), m.end())]))
    if (whole := _replaced(layer, found, "unicode")) is not None:
        yield whole


def _base64(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.content):
        stretches = [(m.start(), m.end())]
        if "\n" in m[0]:  # one wrapped value, or lines of their own
            ends = [m.start() + i for i, c in enumerate(m[0]) if c == "\n"]
            stretches += list(zip([m.start(), *[e + 1 for e in ends]], [*ends, m.end()]))
        for from_, to in stretches:
            run = layer.content[from_:to].translate(_URL_SAFE).encode()
            digits = np.frombuffer(run, np.uint8)
            places = from_ + np.nonzero((digits != 61) & (digits != 13) & (digits != 10))[0]
            run = run.translate(None, b"=\r\n")[: len(places) - (len(places) % 4 == 1)]
            data = base64.b64decode(run + b"=" * (-len(run) % 4))
            if data and (_is_compressed(data) or _plain(data) is not None):
                k = np.arange(len(data))
                yield _inner(layer, data, places[8 * k // 6], places[(8 * k + 7) // 6], "base64")


def _plain(data: bytes) -> str | None:
    """The text of bytes that are text: UTF-8 without control characters."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return None if _CONTROL.search(text) else text


def _is_compressed(data: bytes) -> bool:
    zlib_head = len(data) > 6 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0
    return zlib_head or data.startswith((b"\x1f\x8b\x08", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd"))


def _unpacked(data: bytes, limit: int) -> tuple[bytes | None, bool]:
    """What compressed data holds (None: it is not compressed data), and whether there is more than `limit`."""
    try:
        if data.startswith(b"BZh"):
            unpacker = bz2.BZ2Decompressor()
        elif data.startswith(b"\xfd7zXZ\x00"):
            unpacker = lzma.LZMADecompressor()
        elif data.startswith(b"\x28\xb5\x2f\xfd"):
            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data) as source:
                out = source.read(limit + 1)
            return out[:limit], len(out) > limit
        else:
            unpacker = zlib.decompressobj(47)  # zlib or gzip, as its head says
        out = unpacker.decompress(data, limit + 1)
        return out[:limit], len(out) > limit
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        return None, False


def _texts(layer: Layer, max_layer_bytes: int) -> Iterator[Layer]:
    """What a layer of bytes holds: the compressed data's content, or its text."""
    whole = (int(layer.starts[0]), int(layer.ends[-1]))
    if _is_compressed(layer.content):
        data, more = _unpacked(layer.content, max_layer_bytes)
        if data is not None:
            path = f"{layer.path}>compressed"
            if more:
                yield Layer(b"", np.array([whole[0]]), np.array([whole[1]]), np.ones(1, bool), UNREAD)
            if data:
                if not _is_compressed(data):
                    data = data.decode("utf-8", "replace")
                yield Layer(data, np.full(len(data), whole[0], np.int64), np.full(len(data), whole[1], np.int64), np.ones(len(data), bool), path)
            return
    if text := _plain(layer.content):
        sizes = np.array([len(c.encode()) for c in text], np.int64)
        last = np.cumsum(sizes)
        yield Layer(text, layer.starts[last - sizes], layer.ends[last - 1], np.ones(len(text), bool), layer.path)


def secrets_of(text: str, max_layer_bytes: int = MAX_LAYER_BYTES, max_depth: int = MAX_DEPTH) -> list[tuple[str, int, int, bool, str, str]]:
    """(kind, start, end, base, path of decodings, what matched) of every span, in order of start, kind and end."""
    if not text:
        return []
    place = np.arange(len(text), dtype=np.int64)
    work = [Layer(text, place, place + 1, np.zeros(len(text), bool), "")]
    seen, found = {work[0].key()}, {}
    while work:
        layer = work.pop()
        if layer.path == UNREAD or layer.depth > max_depth:
            found.setdefault((UNREAD, int(layer.starts[0]), int(layer.ends[-1])), (False, UNREAD, ""))
            continue
        if isinstance(layer.content, str):
            for kind, a, b in matches(layer.content):
                if not layer.path or layer.decoded[a:b].any():
                    found.setdefault((kind, int(layer.starts[a:b].min()), int(layer.ends[a:b].max())), (not layer.path, layer.path, layer.content[a:b]))
            inner = (i for unwrap in (_percent, _escapes, _base64) for i in unwrap(layer))
        else:
            inner = _texts(layer, max_layer_bytes)
        for new in inner:
            if (key := new.key()) not in seen:
                seen.add(key)
                work.append(new)
    order = {kind: n for n, kind in enumerate((*KINDS, UNREAD))}
    return [(*k, *v) for k, v in sorted(found.items(), key=lambda x: (x[0][1], order[x[0][0]], x[0][2]))]


def find_secrets(df: DataFrame, id_column: str, text_column: str, max_layer_bytes: int = MAX_LAYER_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per input row: id, and `spans`, an array of (kind, start, end, base, path, match) in order of start, kind
    and end. Offsets count code points of the text, the end is exclusive; `base` spans match the text as it stands, the
    others were found in the layer that `path` names (url>base64>compressed, outermost first) and cover what was decoded.

    Null and empty texts have no spans; rows with a null id and repeated rows each get their row. Texts of any length are
    read whole. A decompressed layer over `max_layer_bytes` is read so far and listed with kind `unread`, as is a layer
    more than `max_depth` deep: nothing is left out silently."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = filled(batch.column(1))
            worth = pc.match_substring_regex(texts, _WORTH).to_pylist()
            spans = [secrets_of(texts[i].as_py(), max_layer_bytes, max_depth) if w else [] for i, w in enumerate(worth)]
            names = [f.name for f in _SPAN_TYPE.value_type]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(names, s)) for s in own] for own in spans], _SPAN_TYPE)], names=["id", "spans"])

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id long, spans {_SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op13_secret_scan")
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), "doc_id", "text")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
