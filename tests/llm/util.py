"""Documents with every awkward case, for any operator."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep_doc_id long, score double, bin_id string, spans int, __n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 9, 0.5, "x", 1, 2) for i, t, s in rows], DOC_SCHEMA)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n)) + "."


def awkward(seed=0):
    rng = random.Random(seed)
    base = prose(rng, 120)
    near = base.split()
    near[10], near[70] = "other", "words"
    long = prose(rng, 30_000)
    return [
        (1, base, "a"), (2, " ".join(near), "b"), (3, base, None), (3, base, None), (4, None, "a"), (5, "", "a"), (6, "!!! ???", "b"), (None, base, "a"), (None, None, None),
        (7, "one", "c"), (8, "one", "c"), (9, long, "a"), (10, long + " tail", "a"), (11, "é" * 300, "b"), (11, prose(rng, 60), "b"), (12, prose(rng, 200), "c"),
    ]
