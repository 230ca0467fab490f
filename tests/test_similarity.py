"""The similarity kernels against a brute-force longest common subsequence."""
import random

from factloom.functions.similarity import _best_window, _common_length, _penalised, _ratio


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_length_and_windows_match_brute_force():
    rng = random.Random(7)
    for _ in range(1500):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9)))
        b = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 16)))
        assert _common_length(a, b) == lcs(a, b)
        if len(a) == len(b):
            continue
        short, long = sorted((a, b), key=len)
        n, m = len(short), len(long)
        stretches = [long[max(0, e - n):min(e, m)] for e in range(1, m + n)]
        best = max(200 * lcs(short, s) / (n + len(s)) for s in stretches)
        assert abs(_best_window(a, b) - best) < 1e-9


def test_short_names_that_only_resemble_are_halved():
    raw = _best_window("fanson as", "fanison")
    assert round(raw, 1) == 92.3
    assert _penalised("fanson as", "fanison", raw) < 60
    assert _penalised("acme as", "acme", _best_window("acme as", "acme")) == 100.0


def test_ratio_of_equal_and_empty_texts():
    assert _ratio("", "") == 100.0 and _ratio("ab", "ab") == 100.0 and _ratio("ab", "cd") == 0.0
