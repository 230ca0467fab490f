"""Token files, packing and archives: exact round trips."""
import base64
import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from cases import awkward_rows, documents, words
from factloom.llm import packing, token_files, tokens, warc
from factloom.llm.common import filled, shared_folder

PATH = tokens.word_tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts(seed=1):
    rng = random.Random(seed)
    pieces = ["can't", "Don'T'll", "á", " ́x", "ÉTÉ", "ΣΣ", "İ", "<|endoftext|>", "a<|startoftext|>b", "\x01", "a\x01b", "　", " ", "\x85", "\x1c", "\U0001f600", "3.14", "...", "\n", "\r\n", "\t", "กำ", "ﬁ", "'", "'s"]
    return ["".join(rng.choice(pieces + [" "] * 8) for _ in range(rng.randint(0, 40))) for _ in range(300)]


def test_words_encode_as_whole_texts(library):
    texts = odd_texts() + [t or "" for _, t in awkward_rows()]
    for cache in (0, 50, 100_000):
        encoder = tokens.WordEncoder(PATH, cache)
        for _ in range(2):
            ids, counts = encoder.encode(filled(pa.array(texts)))
            ends = np.cumsum(counts)
            for text, start, end in zip(texts, ends - counts, ends):
                assert ids[start:end].tolist() == library.encode(text, add_special_tokens=False).ids


def test_slices_cover_all_texts():
    column = filled(pa.array(["x" * n for n in (0, 5, 100, 3, 0, 7, 7)]))
    for limit in (1, 8, 1000):
        assert [i for at, to in tokens.slices(column.slice(1), limit) for i in range(at, to)] == list(range(6))


def rows_with_ties():
    return awkward_rows() + [(20, t) for t in odd_texts(2)[:20]]


def test_token_files_round_trip(spark, library):
    rows = rows_with_ties()
    folder = shared_folder(spark, "token-test")
    manifest = token_files.write_tokens(documents(spark, rows), "doc_id", "text", folder, PATH)
    got = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += r.n_tokens
    expected = defaultdict(list)
    for d, t in rows:
        expected[d].append(library.encode(t or "", add_special_tokens=False).ids + [2])
    for r in got:
        expected[r.id].remove(list(r.ids))
    assert not any(expected.values())
    some = token_files.read_tokens(manifest, {6, 20}).collect()
    assert sorted(r.start for r in some) == sorted(r.start for r in got if r.id in (6, 20))


def test_only_wanted_frames_are_read_and_checked(tmp_path):
    path = tmp_path / "f.zst"
    writer = token_files.TokenWriter(path.open("wb"), 2)
    for i in range(10):
        writer.add(i, np.arange(40_000, dtype=np.uint32) % 50_000)
    writer.add(None, np.zeros(0, np.uint32))
    writer.close()
    data = bytearray(path.read_bytes())
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(data)), read_across_frames=True) as plain:  # any reader can decode it
        assert len(plain.read()) == 2 * 400_000
    reader = token_files.TokenReader(io.BytesIO(bytes(data)))
    assert len(reader.frame_ends) == 5
    data[int(reader.places[4]) + 30] ^= 255
    broken = token_files.TokenReader(io.BytesIO(bytes(data)))
    assert [len(ids) for _, _, ids in broken.documents({0, 1, 7})] == [40_000] * 3
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(broken.documents({9}))


def test_first_fit_decreasing_matches_brute_force():
    rng = random.Random(7)
    for _ in range(100):
        sizes = np.array([rng.randint(1, 20) for _ in range(rng.randint(1, 40))])
        bins, offsets = packing.first_fit_decreasing(sizes, 20)
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
        room, want = [], {}
        for i in order:
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
            if b is None:
                room.append(20)
                b = len(room) - 1
            want[i] = (b, 20 - room[b])
            room[b] -= sizes[i]
        assert [(b, o) for b, o in zip(bins.tolist(), offsets.tolist())] == [want[i] for i in range(len(sizes))]


def test_packing_holds_every_id_once(spark, library):
    rows = rows_with_ties()
    got = packing.pack(documents(spark, rows), "doc_id", "text", PATH, length=64, group_documents=8, with_ids=True).collect()
    sequences, documents_ = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) <= 64 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append(r)
        documents_[r.id].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        used = sum(r.length for r in pieces)
        assert used <= 64 and {r.padding for r in pieces} == {0 if used & (used - 1) == 0 else 64 - used}
    for d in {d for d, _ in rows}:
        want = sorted(i for e, t in rows if e == d for i in library.encode(t or "", add_special_tokens=False).ids + [1])
        assert sorted(i for r in documents_[d] for i in r.ids) == want
    one = sorted(documents_[13], key=lambda r: r.start)
    assert [i for r in one for i in r.ids] == library.encode(dict(rows)[13], add_special_tokens=False).ids + [1]


def test_archives_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}\r\nX: y", rng.choice(["same", "", None, "é" * 5000, "\r\n0\r\n\r\n", " ".join(words(rng, 3000))])) for i in range(40)]
    rows += [(None, None, "alone"), (39, "http://again", "same"), (50, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, payload string, digest string").repartition(4)
    got = warc.read_archives(warc.write_archives(df, "page_id", "url", "html", shared_folder(spark, "warc-test"), segment_bytes=1000)).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    payloads = defaultdict(list)
    for page_id, _, html in rows:
        payloads[(html or "").encode()].append(page_id)
    want = []
    for payload, ids in payloads.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids.sort(key=lambda i: (i is not None, i or 0))
        want += [(i, "response", None, len(payload), digest) if i == ids[-1] else (i, "revisit", ids[-1], len(payload), digest) for i in ids]
    assert sorted(map(str, [tuple(r)[:5] for r in got])) == sorted(map(str, want))


def test_small_payloads_are_never_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "p long, u string, h string")
    got = warc.read_archives(warc.write_archives(df, "p", "u", "h", shared_folder(spark, "warc-test"), min_revisit_bytes=3)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]


def test_broken_segments_are_named():
    def segment(number, block, total=None):
        return {"origin": "<urn:page:7:x>", "segment": number, "total": total, "payload_bytes": 3, "payload_digest": base64.b32encode(hashlib.sha1(b"abc").digest()).decode(), "block": block}

    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"abc", 2)
    cut = [message[:20], message[20:50], message[50:]]
    good = [segment(1, cut[0]), segment(2, cut[1]), segment(3, cut[2], len(message))]
    assert warc._joined(good)[8] is None and warc._joined(good)[6] == 3
    assert "missing" in warc._joined([good[0], good[2]])[8]
    assert "missing" in warc._joined(good[:2])[8]
    assert "missing" in warc._joined([good[0], good[1], good[1], good[2]])[8]
    assert "total" in warc._joined([*good[:2], segment(3, cut[2], 1)])[8]
    assert "differs" in warc._joined([good[0], good[1], segment(3, cut[2].replace(b"c", b"d"), len(message))])[8]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, url string, text string")
    manifest = token_files.write_tokens(empty, "doc_id", "text", shared_folder(spark, "token-test"), PATH)
    assert manifest.count() == 0 and token_files.read_tokens(manifest).collect() == []
    assert packing.pack(empty, "doc_id", "text", PATH).collect() == []
    assert warc.read_archives(warc.write_archives(empty, "doc_id", "url", "text", shared_folder(spark, "warc-test"))).collect() == []
