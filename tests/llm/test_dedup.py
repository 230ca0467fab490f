"""Near duplicates, repeated byte strings and repeated lines against brute force."""
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cases import CLASHING, awkward_rows, documents, words
from factloom.llm import components, lines, merge, minhash, repeats


def shingles(text):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(sets[i]), least[find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)), key=str)


def variants(seed):
    """Families around the threshold, chains of small changes, and a phrase that all documents share."""
    rng = random.Random(seed)
    common = " ".join(words(rng, 12))
    rows, number = [], 100
    for _ in range(8):
        base = words(rng, rng.choice([6, 30, 60, 120]))
        for _ in range(10):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = f"new{rng.randint(0, 10**6)}"
            if rng.random() < 0.4:
                base = text  # a chain: the family drifts
            rows.append((number, common + " " + " ".join(text)))
            number += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    rows = variants(seed) + (awkward_rows() if seed == 1 else [])
    got = minhash.near_duplicates(documents(spark, rows), "doc_id", "text").collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)
    assert all(r.kept == (r.id is None or r.id == r.component_id) for r in got)


@pytest.mark.parametrize("best", [True, False])
def test_pairs_between_components_of_one_bucket(best):
    """The bucket's smallest class is like none, two others like each other: the comparison across components finds them
    in their first common bucket, and in no other."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sets = [np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)) for _ in range(2)]
    sets.append(np.sort(np.concatenate([sets[1][5:], rng.integers(0, 1 << 63, 5, dtype=np.uint64)])))
    flat, sizes = np.concatenate(sets), np.array([400, 400, 400])
    symbols = minhash.signatures(flat, sizes)
    least = pa.RecordBatch.from_pydict({"node": [1, 2, 3], "shingles": [s.view(np.int64).tolist() for s in sets]})
    least = next(minhash._least(iter([least]))).column(2).to_pylist()
    keys = minhash.bucket_keys(symbols).view(np.int64)
    common = np.nonzero(keys[1] == keys[2])[0]
    assert len(common) > 1
    found = []
    for slot in common[:3]:
        batch = pa.RecordBatch.from_pydict({
            "key": [int(keys[1][slot])] * 2, "node": [2, 3], "root": [2, 3], "signature": [s.tobytes() for s in symbols[1:]], "n": [400, 400], "least": least[1:],
        })
        found.append([(a, b) for out in minhash._across(best)(iter([batch.slice(0, 1), batch.slice(1)])) for a, b in zip(*(c.to_pylist() for c in out.columns))])
    assert set(found[0]) == {(2, 3)} and found[1:] == [[]] * (len(found) - 1)


def test_one_of_each_keeps_one_row(spark):
    rows = awkward_rows()
    kept = minhash.one_of_each(documents(spark, rows), "doc_id", "text")
    assert kept.columns == ["doc_id", "text", *CLASHING]
    assert all(r[c] == "x" for r in kept.collect() for c in CLASHING)
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    # 1-3 have no words; 5 repeats 4; 7 (twice), 8 and 15 repeat 6; one row of 10 goes
    assert ids == [1, 2, 3, 4, 6, 9, 10, 11, 12, 13, 14] or ids == [1, 2, 3, 4, 6, 9, 11, 12, 13, 14]
    assert sum(r.doc_id is None for r in kept.select("doc_id").collect()) == 2


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 50), (100, 51), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 51: 50}


def test_loser_tree_merges_and_knows_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 7))]
        matrices = [np.frombuffer(b"".join(r), np.uint8).reshape(-1, 6) for r in runs]
        prefixes = [merge.neighbour_prefixes(m) for m in matrices]
        assert [merge.plain(merge.front_coded(m, p), p, 6) for m, p in zip(matrices, prefixes)] == runs
        source, shared = merge.merged(runs, [p.tolist() for p in prefixes], 6)
        places, out = [0] * len(runs), []
        for s in source.tolist():
            out.append(runs[s][places[s]])
            places[s] += 1
        assert out == sorted(x for r in runs for x in r)
        for i in range(1, len(out)):
            assert shared[i] == next((k for k in range(6) if out[i][k] != out[i - 1][k]), 6)


def brute_repeats(rows, length=50):
    first, out = {}, []
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - length + 1) if d is not None else ():
            first[b[i : i + length]] = min(d, first.get(b[i : i + length], d))
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def passages(seed):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abc \n\0\u00e9") for _ in range(n))

    shared = [noise(rng.choice([30, 49, 50, 51, 60, 120, 400])) for _ in range(12)]
    rows = []
    for i in range(150):
        text = "".join(rng.choice([noise(rng.randint(0, 80)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 20) :]]) for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice([i, i, i, i // 2, None]), rng.choice([text] * 9 + [None])))
    return rows + [(1000 + i, "a" * rng.randint(40, 140)) for i in range(10)] + [(2000, shared[0] * 3)] * 3


@pytest.mark.parametrize("hot_times", [1024, 4])
def test_repeats_match_brute_force(spark, hot_times):
    rows = passages(1) + awkward_rows()
    got = repeats.remove_repeats(documents(spark, rows), "doc_id", "text", block_bytes=3000, hot_times=hot_times, with_bytes=True).collect()
    assert sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got), key=str) == brute_repeats(rows)


def brute_lines(rows, min_words):
    """Every run of lines with enough words that also begins at an earlier (id, place, line)."""
    texts = [[(at, line) for at, line in enumerate((t or "").split("\n")) if line.encode().split()] for _, t in rows]
    first, gone = {}, [set() for _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    for place, i in enumerate(order):
        ls = texts[i]
        for a in range(len(ls)):
            for b in range(a + 1, len(ls) + 1):
                run = tuple(line for _, line in ls[a:b])
                if sum(len(line.encode().split()) for line in run) >= min_words:
                    if first.setdefault(run, (place, a)) < (place, a):
                        gone[i] |= {at for at, _ in ls[a:b]}
    return [None if t is None else "\n".join(line for at, line in enumerate(t.split("\n")) if at not in gone[i]) for i, (_, t) in enumerate(rows)]


def test_lines_match_brute_force(spark):
    rng = random.Random(9)
    pool = [" ".join(words(rng, rng.choice([1, 2, 3, 5, 9]))) for _ in range(12)] + ["", "  "]
    blocks = [[rng.choice(pool) for _ in range(rng.randint(1, 6))] for _ in range(8)]
    rows = [(i, "\n".join(line for _ in range(rng.randint(0, 4)) for line in rng.choice([rng.choice(blocks), [rng.choice(pool)]]))) for i in range(60)]
    rows += [(60, "w " * 9), (61, "\n".join(["w"] * 40)), (62, None), (63, "")]
    done = lines.dedup_lines(documents(spark, rows), "doc_id", "text", min_words=8)
    assert done.columns == ["doc_id", "text", *CLASHING, "_n_lines", "_n_removed", "_n_runs"]
    assert all(r[c] == "x" for r in done.collect() for c in CLASHING)
    assert [r.text for r in done.orderBy("doc_id").collect()] == brute_lines(rows, 8)


def test_lines_of_awkward_rows(spark):
    done = {(r.doc_id, r.text) for r in lines.dedup_lines(documents(spark, awkward_rows()), "doc_id", "text").collect()}
    first_line = awkward_rows()[11][1].split("\n")[0]
    assert (9, first_line + "\nshort\n") in done and (10, "intro") in done
    assert (1, None) in done and (2, "") in done and (3, " \n\t ") in done


def test_shortest_runs_cover_every_run_with_enough_words():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.randint(1, 6) for _ in range(rng.randint(0, 9))]
        found = lines.line_windows(sizes, 8)
        assert all(sum(sizes[a : a + n]) >= 8 and n <= 8 for a, n in found)
        for a in range(len(sizes)):
            for b in range(a + 1, len(sizes) + 1):
                if sum(sizes[a:b]) >= 8:
                    inside = {x for s, n in found if a <= s and s + n <= b for x in range(s, s + n)}
                    assert inside == set(range(a, b))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty, "doc_id", "text").collect() == []
    assert repeats.remove_repeats(empty, "doc_id", "text").collect() == []
    assert lines.dedup_lines(empty, "doc_id", "text").collect() == []


def test_smallest_hashes_tell_similarity():
    rng = np.random.default_rng(3)
    for n in (3, 100, 256, 257, 3000):
        for changed in (0, n // 8, n // 3):
            a = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            b = np.sort(np.concatenate([rng.permutation(a)[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64) * np.uint64(2)]))
            rows = np.full((2, minhash.BOTTOM), 0xFFFFFFFF, np.uint32)
            for row, s in zip(rows, (a, b)):
                row[: min(n, minhash.BOTTOM)] = s[: minhash.BOTTOM] >> np.uint64(32)
            share, similar = minhash.bottom_similar(rows[:1], rows[1:], np.array([n]), np.array([n]))
            real = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs(share[0] - real) < (1e-9 if n <= minhash.BOTTOM else 0.13) and (similar[0] or real < 0.75)


def test_full_comparison_drops_no_pair_by_its_smallest_hashes():
    rng = np.random.default_rng(12)
    shared, own = rng.integers(1 << 62, 1 << 63, 1720, dtype=np.uint64), rng.integers(1, 1 << 61, (2, 280), dtype=np.uint64)
    sets = [np.sort(np.concatenate([shared, o])) for o in own]  # similar by 0.754, but not in a single one of the smallest hashes
    symbols = minhash.signatures(np.concatenate(sets), np.array([2000, 2000]))
    keys = minhash.bucket_keys(symbols).view(np.int64)
    least = [(s[: minhash.BOTTOM] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets]
    rows = sorted((int(keys[i, k]), i, i, symbols[i].tobytes(), 2000, least[i]) for k in np.nonzero(keys[0] == keys[1])[0] for i in range(2))
    batch = pa.RecordBatch.from_pylist([dict(zip(("key", "node", "root", "signature", "n", "least"), row)) for row in rows])
    assert [b.to_pylist() for b in minhash._across(False)(iter([batch]))] == [[{"a": 0, "b": 1}]]
    assert not minhash.sizes_allow(np.array([74]), np.array([100]))[0] and minhash.sizes_allow(np.array([75]), np.array([100]))[0]
