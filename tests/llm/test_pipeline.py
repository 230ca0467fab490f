"""Decontamination, the pipeline, and every query with SQL on the smallest tables."""
import glob
import os
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cases import CLASHING, awkward_rows, documents, words
from factloom.llm import decontaminate, registry
from test_dedup import brute_components
from tools.check_oracles import kind, norm

SF = "/root/testdata/sf0.001"
registry.load()


def smith_waterman(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(4)
    items = [rng.integers(1, 5, n, dtype=np.uint64) for n in rng.integers(3, 12, 120)]
    passages = [rng.integers(1, 5, n, dtype=np.uint64) for n in rng.integers(0, 30, 120)]
    best, _ = decontaminate._batched(items, passages, 16)
    assert best.tolist() == [smith_waterman(a.tolist(), b.tolist()) for a, b in zip(items, passages)]


def test_edited_copies_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, rng.randint(15, 40))) + ".") for i in range(20)] + [(20, None), (None, "lost item words here"), (21, "two words"), (3, "again under the same number")]
    rows, want = [], set()
    for i in range(20):
        ws = items[i][1].split(" ")
        edits = {
            "exact": ws, "upper": [w.upper() + "!!" for w in ws], "replaced": ["other" if k % 6 == 5 else w for k, w in enumerate(ws)],
            "lost": [w for k, w in enumerate(ws) if k % 7 != 6], "added": [x for k, w in enumerate(ws) for x in ([w, "extra"] if k % 6 == 5 else [w])],
        }
        for k, (name, text) in enumerate(edits.items()):
            rows.append((100 + 10 * i + k, " ".join(words(rng, 50) + text + words(rng, 50))))
            if i != 3:
                want.add((100 + 10 * i + k, i))
        rows.append((1000 + i, " ".join(words(rng, 60) + ws[:5] + words(rng, 60))))
    rows += [(2000 + i, " ".join(words(rng, 200))) for i in range(20)] + [(7, None), (8, ""), (None, items[0][1]), (9, items[1][1]), (9, items[1][1])]
    benchmark = spark.createDataFrame([(*i, "x") for i in items if i[0] != 3 or i[1].endswith(".")], "item_id long, text string, words string")
    want |= {(100 + 30 + k, 3) for k in range(5)} | {(None, 0), (9, 1)}
    got = decontaminate.find_leaks(documents(spark, rows), "doc_id", "text", benchmark, "item_id", "text").collect()
    assert {(r.id, r.item_id) for r in got} == want and len(got) == len(want) + 1
    plain = {d: re.findall(r"[a-z0-9]+", (t or "").lower()) for d, t in rows}
    for r in got:
        if r.score == 1.0:
            assert plain[r.id][r.first_word : r.last_word + 1] == re.findall(r"[a-z0-9]+", items[r.item_id][1].lower()) if r.id is not None else True
    kept = decontaminate.decontaminate(documents(spark, rows), "doc_id", "text", benchmark, "item_id", "text")
    assert kept.columns == ["doc_id", "text", *CLASHING]
    assert all(r[c] == "x" for r in kept.collect() for c in CLASHING)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows if d is not None and d not in {w for w, _ in want})


def test_edited_copies_beside_exact_copies_are_found(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((15, 20, 25, 30, 35, 40, 50))]
    rows = []
    for i, text in items:
        ws = text.split(" ")
        rows += [(100 * i + k, " ".join(words(rng, 30) + ws + words(rng, 30))) for k in range(3)]
        rows += [(100 * i + 10 + every, " ".join(words(rng, 30) + [f"new{k}" if k % every == every - 1 else w for k, w in enumerate(ws)] + words(rng, 30))) for every in (4, 5)]
    got = decontaminate.find_leaks(documents(spark, rows), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()
    assert sorted((r.id, r.item_id) for r in got) == sorted((d, d // 100) for d, _ in rows)


def test_texts_under_one_item_id_and_under_none_are_found(spark):
    rng = random.Random(9)
    texts = [" ".join(words(rng, 20)) for _ in range(4)]
    benchmark = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3]), (1, texts[0]), (None, None)], "item_id long, text string")
    rows = [(i, " ".join(words(rng, 30) + t.split(" ") + words(rng, 30))) for i, t in enumerate(texts)] + [(4, " ".join(words(rng, 90)))]
    got = decontaminate.find_leaks(documents(spark, rows), "doc_id", "text", benchmark, "item_id", "text").collect()
    assert sorted((r.id, r.item_id, r.score) for r in got if r.id < 2) == [(0, 1, 1.0), (1, 1, 1.0)]
    assert sorted((r.id, r.item_id, r.score) for r in got if r.id >= 2) == [(2, None, 1.0), (3, None, 1.0)]
    kept = decontaminate.decontaminate(documents(spark, rows), "doc_id", "text", benchmark, "item_id", "text")
    assert [r.doc_id for r in kept.collect()] == [4]


def test_leaks_are_those_of_aligning_everything(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 64)  # in this process; the arrays are small in either case
    rng = np.random.default_rng(10)
    items = [rng.integers(1, 9, n, dtype=np.uint64) for n in rng.integers(3, 14, 40)]
    texts = [rng.integers(1, 12, n, dtype=np.uint64) for n in rng.integers(0, 60, 40)]
    known = decontaminate.Items(list(range(len(items))), items)
    h, counts = np.concatenate(texts), np.array([len(t) for t in texts])
    text, item, low, high = decontaminate.passages(known, h, counts)
    start = (np.cumsum(counts) - counts)[text]
    able = decontaminate.can_hold(known, h, item, start + low, start + high)
    best, _ = decontaminate._batched([items[i] for i in item], [texts[t][a:b] for t, a, b in zip(text, low, high)])
    assert not able.all() and (best[~able] < decontaminate.MIN_SCORE * 2 * known.sizes[item[~able]]).all()
    runs = [{tuple(x[k : k + 3]) for k in range(len(x) - 2)} for x in map(np.ndarray.tolist, items)]
    held = [{tuple(x[k : k + 3]) for k in range(len(x) - 2)} for x in map(np.ndarray.tolist, texts)]
    assert {(t, i) for t, i in zip(text.tolist(), item.tolist())} == {(t, i) for t in range(len(texts)) for i in range(len(items)) if runs[i] & held[t]}


def test_no_benchmark_and_no_documents(spark):
    docs, items = documents(spark, awkward_rows()), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect() == []
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.find_leaks(empty, "doc_id", "text", spark.createDataFrame([(1, "a b c d")], "item_id long, text string"), "item_id", "text").collect() == []


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(norm(v) for v in row) for row in df.select(*columns).collect())
    result = duck.sql(registry.ORACLES[name])
    place = [result.columns.index(c) for c in columns]
    assert sorted(result.columns) == columns and mine == sorted(tuple(norm(r[i]) for i in place) for r in result.fetchall())
    assert {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields} == {c: kind(str(t)) for c, t in zip(result.columns, result.types)}


def test_every_operator_has_one_query():
    names = set(entry.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names


def test_pipeline_stages(spark):
    """Each stage on its own input against a plain account of what it must keep."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test-stage")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        kept[name] = before, after
    before, after = kept["quality"]
    assert all((t or "").encode().split() and len((t or "").encode().split()) >= 50 for t in after.values())
    before, after = kept["line_dedup"]
    assert all(set(t.split("\n")) <= set(before[d].split("\n")) for d, t in after.items())
    assert docs.filter("n_chars <> char_length(text)").count() == 0
    before, after = kept["near_dedup"]
    rows = sorted(before.items())
    groups = defaultdict(list)
    for d, n, component in brute_components(rows):
        groups[component if n else ("alone", d)].append(d)
    assert sorted(after) == sorted(min(g) for g in groups.values()) and all(after[d] == before[d] for d in after)
    before, after = kept["decontamination"]
    items = [" " + " ".join(re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", r.text.lower()).split()) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for d, t in before.items():
        plain = " " + " ".join(re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", t.lower()).split()) + " "
        assert (d in after) == (not any(i in plain for i in items))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(after) and sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
