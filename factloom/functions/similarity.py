"""Fuzzy name similarity: the one measure Spark has no builtin for.

Both measures count insertions and deletions only (longest common subsequence), which `levenshtein`
does not. Exact containment and equality are answered by expressions; the Arrow function sees only
the pairs that remain."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import fixed, text


def _places(a: str) -> dict[str, int]:
    """Where each character of `a` stands, as bits."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    return places


def _common_length(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, one machine-word step per character of `b`."""
    at = (_places(a) if places is None else places).get
    mask = (1 << len(a)) - 1
    row = mask
    for ch in b:
        hit = row & at(ch, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & mask
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _common_length(a, b) / total


def _best_window(a: str, b: str) -> float:
    """The shorter text against every stretch of the longer one that is at most as long as it."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100.0
    if len(a) == len(b):
        return max(_along(a, b), _along(b, a))
    return _along(short, long)


def _along(short: str, long: str) -> float:
    """Best ratio of `short` over every stretch of `long`. The letters two texts share bound their common
    subsequence; stretches are aligned by falling bound, until none left can beat the best so far."""
    n, m = len(short), len(long)
    need: dict[str, int] = {}
    for ch in short:
        need[ch] = need.get(ch, 0) + 1
    have = dict.fromkeys(need, 0)
    shared, stretches = 0, []
    for end in range(1, m + n):
        lo, hi = max(0, end - n), min(end, m)
        if end <= m and long[end - 1] in need:
            ch = long[end - 1]
            shared += have[ch] < need[ch]
            have[ch] += 1
        if end > n and long[lo - 1] in need:
            ch = long[lo - 1]
            have[ch] -= 1
            shared -= have[ch] < need[ch]
        stretches.append((200.0 * shared / (n + hi - lo), lo, hi))
    stretches.sort(reverse=True)
    places, best = _places(short), 0.0
    for bound, lo, hi in stretches:
        if bound <= best:
            break
        best = max(best, 200.0 * _common_length(short, long[lo:hi], places) / (n + hi - lo))
    return best


@F.pandas_udf(T.DoubleType())
def _window_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _best_window(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _ratio_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType())]))
def _best_of(names: pd.Series, candidates: pd.Series) -> pd.DataFrame:
    """Best-scoring candidate against any of the names, the first one on a tie."""
    rows = []
    for own, found in zip(names, candidates):
        best = (0.0, None)
        for c in [] if found is None else found:
            for n in [] if own is None else own:
                if n and c is not None:
                    score = _penalised(n.lower(), c.lower(), _best_window(n.lower(), c.lower()))
                    if best[1] is None or score > best[0]:
                        best = (score, c)
        rows.append(best)
    return pd.DataFrame(rows, columns=["score", "text"])


def _penalised(a: str, b: str, score: float) -> float:
    short = min(len(a.strip()), len(b.strip())) <= fixed.SHORT_NAME_CHARS
    return score / 2 if score < 100 and short else score


def contained(a: Column, b: Column) -> Column:
    """One text holds the other, ignoring case: similarity 100 without any alignment."""
    x, y = F.lower(a), F.lower(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def name_similarity(a: Column, b: Column) -> Column:
    """0-100: best partial alignment, halved when it is not exact and the shorter name has 12
    characters or fewer. Pass plain columns: arguments holding lambdas keep Spark from recognising
    the repeated call as one."""
    x, y = F.lower(a), F.lower(b)
    open_pair = ~F.coalesce(contained(a, b), F.lit(True))
    score = F.coalesce(_window_score(F.when(open_pair, x), F.when(open_pair, y)), F.lit(100.0))
    short = F.least(F.length(text.strip(a)), F.length(text.strip(b))) <= fixed.SHORT_NAME_CHARS
    graded = F.when((score < 100) & short, score / 2).otherwise(score)
    return F.when(a.isNotNull() & b.isNotNull(), graded)


def best_match(names: Column, candidates: Column) -> Column:
    """struct(score, text): the candidate closest to any of the names."""
    return _best_of(names, candidates)


def token_sort_similarity(a: Column, b: Column) -> Column:
    """0-100 after sorting the words of both names; equality needs no alignment."""

    def ordered(t: Column) -> Column:
        return F.array_join(F.array_sort(F.filter(F.split(text.squeeze(F.lower(t)), " "), lambda w: w != "")), " ")

    x, y = ordered(a), ordered(b)
    open_pair = ~F.coalesce(x == y, F.lit(True))
    score = F.coalesce(_ratio_score(F.when(open_pair, x), F.when(open_pair, y)), F.lit(100.0))
    return F.when(a.isNotNull() & b.isNotNull(), score)
