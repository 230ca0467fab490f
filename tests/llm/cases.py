"""Small tables that hold every awkward case: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
from __future__ import annotations

import random

CLASHING = ["row", "id", "n", "key", "kept", "words", "block", "part", "failures", "start", "length", "_row", "_block", "_gone", "_ledger", "_measured"]


def documents(spark, rows, partitions=3):
    """(doc_id, text) rows with columns whose names operators use themselves."""
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *["x"] * len(CLASHING)) for r in rows], f"doc_id long, text string, {extra}").repartition(partitions)


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randint(0, 30)) for _ in range(n)]


def awkward_rows(seed=5):
    rng = random.Random(seed)
    text = " ".join(words(rng, 80))
    near = text.split(" ")
    near[3] = "changed"
    line = " ".join(words(rng, 35))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, text), (7, text), (7, text), (8, " ".join(near)), (None, text), (None, None),
        (9, line + "\nshort\n\n" + line), (10, "intro\n" + line), (11, "\u00c9t\u00e9 \u212aelvin \U0001f600 na\u00efve"), (12, "a" * 5000), (13, " ".join(words(rng, 20000))),
        (14, "\x00\x01 odd \x7f bytes \x1c here"), (15, text.upper()), (10, "intro\n" + line),
    ]
