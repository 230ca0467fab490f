"""URL filter, quality rules and license scan."""
import random

import pytest

from cases import CLASHING, awkward_rows, documents
from factloom.llm import license_scan, quality_rules, url_filter


def judged(spark, urls):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return {r.id: r for r in url_filter.judge_urls(df, "page_id", "url").collect()}


def test_url_hosts_paths_and_rules(spark):
    rows = judged(spark, [
        None, "", "no scheme", "http://A.Example.COM", "http://a.example.com/en/x?q#f", "http://www.example.com/en/1", "http://b.www.example.com/en/1",
        "https://x.net/es/1", "https://x.net/fr", "https://xnet/es/1", "http://h?x/y", "http://h#x/y", "://host/p", "a://b://c/d", "http://example.com.evil.org/en/",
    ])
    assert [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(15)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "", None, "allow"),
        ("a.example.com", "/en/x", "example.com/en/", "block"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("b.www.example.com", "/en/1", "www.example.com/en/", "allow"), ("x.net", "/es/1", "net/es/", "block"), ("x.net", "/fr", None, "allow"),
        ("xnet", "/es/1", None, "allow"), ("h", "", None, "allow"), ("h", "", None, "allow"), ("host", "/p", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("example.com.evil.org", "/en/", None, "allow"),
    ]


def test_url_terms_need_boundaries_and_differ(spark):
    rows = judged(spark, ["http://casino.org", "http://casinos.org", "http://xcasino.org", "http://free-bets.org", "http://free.org/free", "http://freebets.org", "http://CASINO.org", "http://\u00e9casino.org"])
    assert [rows[i].verdict for i in range(8)] == ["block", "allow", "allow", "block", "allow", "allow", "block", "allow"]
    assert (rows[3].n_soft, rows[4].n_soft) == (2, 1)


def test_empty_inputs_keep_their_schema(spark):
    df = spark.createDataFrame([], "doc_id long, text string, url string")
    assert url_filter.judge_urls(df, "doc_id", "url").collect() == []
    assert quality_rules.ledger(df, "doc_id", "text").collect() == []
    assert license_scan.scan(df, "doc_id", "text").collect() == []


def brute_measures(text):
    ws = text.encode().split()
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    covered = {i + o for i, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
    lines = [line for line in text.split("\n") if line.encode().split()]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    chars = sum(c not in " \t\n\x0b\x0c\r" for c in text)
    return len(ws), chars, sum(c in "#*$%&|<>" for c in text), len(lines), dup, len(covered)


def test_measures_match_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", " ", "\n", "#", "a b ", "\u00e9", "\x1c", "\u2003"]) for _ in range(rng.randint(0, 60)))
        assert quality_rules.measure(text) == brute_measures(text)


def test_ledger_policies_and_ablation(spark):
    rows = quality_rules.ledger(documents(spark, awkward_rows()), "doc_id", "text")
    got = rows.collect()
    assert len(got) == len(awkward_rows())
    assert all(r.failures & 1 for r in got if r.n_words < 50)
    kept = {r.id for r in got if not r.failures & quality_rules.mask("v2")}
    assert kept == {6, 7, 8, 13, 15, None}
    table = {r.rule: (r.fails, r.only_this) for r in quality_rules.ablations(rows).collect()}
    for name in quality_rules.POLICIES[quality_rules.CURRENT]:
        bit, mask = quality_rules.bit(name), quality_rules.mask(quality_rules.CURRENT)
        assert table[name] == (sum(r.failures & bit != 0 for r in got), sum(r.failures & mask == bit for r in got))
    good = quality_rules.good_documents(documents(spark, awkward_rows()), "text")
    assert good.columns == ["doc_id", "text", *CLASHING]
    assert all(r[c] == "x" for r in good.collect() for c in CLASHING)
    assert sorted(r.doc_id or 0 for r in good.collect()) == sorted(r.id or 0 for r in got if not r.failures & quality_rules.mask(quality_rules.CURRENT))


def brute_phrases(text):
    import re

    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, t.label) for t in license_scan.BASE for i in range(len(ws)) if ws[i : i + len(t.text.split())] == t.text.split()]
    return len(ws), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({label for _, label in places}))


def test_license_phrases_match_brute_force(spark):
    rng = random.Random(4)
    pieces = ["under the mit license", "Under The MIT-License", "cc by nc", "cc by", "nc cc by nc", "apache license version 2", "apache license, version 20", "the", "\u212a", "x", "\u00c9t\u00e9", "mit license"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(80)] + ["cc by nc " * 3000, None, "", "  "]
    df = documents(spark, list(enumerate(texts)))
    for r in license_scan.scan(df, "doc_id", "text").collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_phrases(texts[r.id] or "")
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_license_text_with_edits(spark):
    text = "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that these conditions are met"
    rows = {r.id: r for r in license_scan.scan(documents(spark, [(1, text), (2, "redistribution and use"), (3, text), (3, text)]), "doc_id", "text").collect()}
    assert rows[1].labels == "bsd" and rows[1].score > 0.6 and rows[1].n_base == 0
    assert rows[2].labels == "" and 0 < rows[2].score < 0.2


def test_license_spans_are_verified(spark):
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files".split(" ")
    cases = [
        ("Licensed under the GNU General Public License, version 3.", "gpl-3"), ("Licensed under the GNU General Public License, version 2.", ""),
        ("Licensed under the GNU Lesser General Public License version 3", ""), ("licensed under the GNU Affero General Public License version 3", "agpl-3"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
        *[(f"This work is licensed under a Creative Commons Attribution-{x} 4.0 International License", "") for x in ("ShareAlike", "NonCommercial", "NoDerivatives")],
        (" ".join("other" if i % 6 == 5 else w for i, w in enumerate(mit)), "mit"), (" ".join(mit[4:]), "mit"), (" ".join(mit[:9]), ""),
        ("Unlike lesser ones, this is licensed under the GNU General Public License version 3, not the Affero one", "gpl-3"),
    ]
    rows = license_scan.scan(documents(spark, [(i, text) for i, (text, _) in enumerate(cases)]), "doc_id", "text").collect()
    assert {r.id: r.labels for r in rows} == {i: label for i, (_, label) in enumerate(cases)}
    with pytest.raises(ValueError):
        license_scan.template_grams(spark, (license_scan.Template("x", "three words here", needs=("four",)),))


def test_a_template_needs_enough_words(spark):
    with pytest.raises(ValueError):
        license_scan.template_grams(spark, (license_scan.Template("x", "two words"),))
