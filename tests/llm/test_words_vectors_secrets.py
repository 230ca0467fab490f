"""Spelling variants, hard negatives and secret scans against brute force."""
import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from cases import awkward_rows, documents
from pyspark.sql import functions as F

from factloom.llm import negatives, spelling
from factloom.llm.secrets import KINDS, find_secrets, op13_secret_scan, secrets_of

SF = "/root/testdata/sf0.01"  # the smallest tables hold no secret


# spelling variants

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts)


@pytest.mark.parametrize("limit", [1, 5, 64])
def test_every_near_word_is_found(spark, monkeypatch, limit):
    """A dense vocabulary of two letters, with few and with many frequent grams."""
    monkeypatch.setattr(spelling, "LIST_LIMIT", limit)
    rng = random.Random(limit)
    counts = {"".join(rng.choice("aé") for _ in range(rng.randint(5, 9))): rng.randint(3, 400) for _ in range(150)} | {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24}
    found = spelling.spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == brute_variants(counts)


def test_an_edit_changes_no_more_grams_than_the_bound():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 12))) for _ in range(300)]
    grams = Counter(f"^{w}$"[i : i + n] for w in words for n in range(2, 6) for i in range(len(w) + 3 - n))
    frequent = {g: n for g, n in grams.items() if n > 30}
    for w in words:
        own, bound = spelling.decomposed(w, frequent)
        assert len(own) == len(w) + 1 and bound < len(own)
        i = rng.randrange(len(w))
        for changed in (w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "c" + w[i + 1 :]):
            there, _ = spelling.decomposed(changed, frequent)
            kept = sum(any(0 <= j < len(there) and there[j] == g for j in {k, k + len(changed) - len(w)}) for k, g in enumerate(own))
            assert kept >= len(own) - bound


def test_words_of_awkward_texts(spark):
    rows = [*awkward_rows(), (20, "Colour COLOUR colour colours colour× xÉté colo÷r")]
    plain = Counter()
    for _, text in rows:
        plain.update(re.sub("[A-Z]", lambda m: m[0].lower(), r) for r in re.findall("[A-Za-zÀ-ÿ]+", text or ""))
    assert {r.word: r.n for r in spelling.word_counts(documents(spark, rows), "doc_id", "text").collect()} == plain
    kept = {w: n for w, n in plain.items() if len(w) >= 5 and n >= 3}
    found = spelling.variants_in(documents(spark, rows), "doc_id", "text")
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == brute_variants(kept)
    empty = spelling.variants_in(documents(spark, rows).filter("false"), "doc_id", "text")
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.collect() == []


def test_a_short_word_is_refused(spark):
    with pytest.raises(ValueError):
        spelling.variants_in(documents(spark, []), "doc_id", "text", min_chars=4)


# hard negatives

def brute_negatives(rows, positives=5, negatives=5):
    use = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda x: (-x[0], x[1] is not None, x[1])
    out = []
    for at, (anchor, label, q) in enumerate(use):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(q, p)), i, own) for n, (i, own, p) in enumerate(use) if n != at]
        for positive, pid, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            held = sorted((s for s in scored if s[2] != label and 80 * positive <= 100 * s[0] <= 100 * positive), key=order)
            out += [(anchor, pid, n, i, positive, s) for n, (s, i, _) in enumerate(held[:negatives], 1)]
    return sorted(out, key=str)


def clustered(rng, n, dimension=8):
    centres = rng.normal(size=(12, dimension))
    rows = centres[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, dimension))
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def vectors(spark, rows, partitions=3):
    clashing = ["id", "q", "key", "label2", "ids", "leaf", "window", "score", "_place", "near", "far"]
    return spark.createDataFrame([(*r, *["x"] * len(clashing)) for r in rows], "vec_id long, label int, v array<float>, " + ", ".join(f"`{c}` string" for c in clashing)).repartition(partitions)


def mined(df):
    found = negatives.hard_negatives(df, "vec_id", "v", "label", F.col("id") % 100 == 0)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def test_negatives_with_nulls_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    points = clustered(rng, 500).astype(np.float32)
    rows = [(i * 10, int(rng.integers(0, 4)), p.tolist()) for i, p in enumerate(points)]
    hot = points[0].tolist()
    rows += [(5000 + i, 1 + i % 2, hot) for i in range(120)]  # one vector for many rows, two labels
    rows += [(i, label, v) for i, label, v in rows[:20]]  # repeated rows, anchors among them
    rows += [(6000, None, hot), (6100, 1, None), (6200, 1, [float("nan"), *hot[1:]]), (6300, 2, [float("inf"), *hot[1:]]), (6400, 2, [None, *hot[1:]])]
    rows += [(None, 2, hot), (None, 1, hot), (6500, 1, hot[:5]), (6600, 2, []), (6700, 3, [0.0] * 8)]
    assert mined(vectors(spark, rows)) == brute_negatives(rows)
    assert mined(vectors(spark, rows[:1])) == [] and mined(vectors(spark, rows).filter("false")) == []


def test_the_tree_passes_over_leaves_and_no_row_of_a_window():
    rng = np.random.default_rng(9)
    rows = np.floor(256 * clustered(rng, 4000, 16))
    nodes = negatives.fitted(rows[:800])
    leaf = negatives.routed(nodes, rows, learn=True)
    assert (negatives.routed(nodes, rows) == leaf).all() and leaf.max() > 20
    anchors = rows[:50]
    scores = anchors @ rows.T
    high = np.sort(scores, axis=1)[:, -20]
    low = 0.9 * high
    alive = negatives.open_leaves(nodes, anchors, low, high, 0, int(leaf.max()))
    inside = (scores >= low[:, None]) & (scores <= high[:, None])
    assert all(alive[a, leaf[r]] for a, r in zip(*np.nonzero(inside)))
    assert alive.mean() < 0.5


def test_large_components_are_exact_or_refused(spark):
    rows = [(i, i % 2, [float(i % 7 + 1) * 1e5, 3.0 * i]) for i in range(0, 300, 25)]
    assert mined(vectors(spark, rows)) == brute_negatives(rows)
    with pytest.raises(ValueError):
        mined(vectors(spark, [(0, 1, [1e30]), (1, 1, [1.0])]))


# secret scans

SECRET = 'api_key = "abcdef123456"'
B64 = lambda data: base64.b64encode(data).decode()
QUOTED = lambda text: urllib.parse.quote(text, safe="")
LAYERS = {
    "url": QUOTED(SECRET), "url>url": QUOTED(QUOTED(SECRET)), "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET), "base64": B64(SECRET.encode()),
    "base64>base64": B64(B64(SECRET.encode()).encode()), "base64>compressed": B64(gzip.compress(SECRET.encode())), "base64>compressed>compressed": B64(bz2.compress(zlib.compress(SECRET.encode()))),
    "url>base64>compressed>compressed": QUOTED(B64(zstandard.compress(lzma.compress(SECRET.encode())))) + "%21", "unicode>url": "\\u0025".join(QUOTED(SECRET).split("%")), "url>compressed": "".join(f"%{b:02x}" for b in zlib.compress(SECRET.encode())),
}


@pytest.mark.parametrize("path", sorted(LAYERS))
def test_secrets_inside_layers(path):
    """The span is the encoded secret: it begins with the encoding of its first character and holds that of its last."""
    before = "\U0001f600 naïve "
    found = secrets_of(before + LAYERS[path] + " after")
    assert [(k, base, p, m) for k, _, _, base, p, m in found] == [("assign", False, path, SECRET[:-1])]
    start, end = found[0][1:3]
    assert start == len(before) and len(before) + len(LAYERS[path]) - 9 <= end <= len(before) + len(LAYERS[path])


def test_mixed_wrapped_and_endless_layers():
    assert [s[:4] for s in secrets_of("pass%77ord: hunter22")] == [("assign", 0, 20, False)]
    wrapped = B64(b"nothing here " * 9 + SECRET.encode())
    lines = "\n".join(wrapped[i : i + 76] for i in range(0, len(wrapped), 76))
    (found,) = secrets_of(lines)
    at = 8 * 13 * 9 // 6
    assert found[0] == "assign" and found[1] == at + at // 76
    assert [s[3] for s in secrets_of(SECRET + " " + LAYERS["base64"])] == [True, False]
    nested = SECRET
    for _ in range(40):
        nested = B64(nested.encode())[:4000]
    assert [s[0] for s in secrets_of(nested, max_depth=3)] == ["unread"]
    bomb = B64(zlib.compress(b"\0" * 100_000))
    assert [s[0] for s in secrets_of(bomb, max_layer_bytes=1000)] == ["unread"] and secrets_of(bomb) == []
    assert secrets_of("x" * 200_000 + " %zz \\u12 &#; = %" + "=" * 50) == []


def plain_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_scan_against_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op13_secret_scan(spark, SF).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in rows)
    for r in rows:
        spans = plain_spans(texts[r.doc_id])
        digest = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(digest.encode()).hexdigest() and set(digest.split(",")) <= {*r.spans.split(","), ""}


def test_scan_of_awkward_texts(spark):
    extra = [(30, SECRET), (30, SECRET), (None, "token: abcdefgh AKIA" + "Q" * 16 + " " + "a1" * 12), (31, "toKen=abcdefgh TOKEN=abc token=abcdef"), (32, "x " * 50_000 + LAYERS["base64"])]
    rows = [*awkward_rows(), *extra]
    found = find_secrets(documents(spark, rows), "doc_id", "text").collect()
    assert Counter(r.id for r in found) == Counter(d for d, _ in rows)
    mine = Counter((r.id, tuple((s["start"], KINDS.index(s["kind"]), s["end"]) for s in r.spans if s["base"])) for r in found)
    assert mine == Counter((d, tuple(plain_spans(t))) for d, t in rows)
    assert [s["path"] for r in found if r.id == 32 for s in r.spans] == ["base64"]
    assert find_secrets(documents(spark, rows).filter("false"), "doc_id", "text").collect() == []
