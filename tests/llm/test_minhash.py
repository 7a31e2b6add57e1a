import itertools
import random
import re

import numpy as np

from clipquarry.llm.minhash import dedup, near_duplicates, signatures
from tests.llm.util import awkward, frame, prose


def grams(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for g in range(60):
        words = prose(rng, rng.randrange(20, 200)).split()
        for _ in range(rng.randrange(1, 5)):
            copy = [w if rng.random() > 0.03 else f"x{rng.randrange(999)}" for w in words]
            rows.append((len(rows), " ".join(copy), "s"))
    got = {r["doc_id"]: r["rep_doc_id"] for r in near_duplicates(frame(spark, rows)).collect()}
    sets = [grams(t) for _, t, _ in rows]
    close = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])]
    assert len(close) > 30
    assert sum(got.get(a, a) == got.get(b, b) for a, b in close) >= 0.95 * len(close)
    for a, r in got.items():
        assert sets[a] & sets[r], "strangers were put together"


def test_estimate_is_the_jaccard_similarity():
    rng = random.Random(1)
    a = prose(rng, 400).split()
    pairs = []
    for k in range(0, 400, 40):
        b = a[:k] + [f"y{i}" for i in range(k, 400)]
        pairs.append((" ".join(a), " ".join(b)))
    for x, y in pairs:
        data = [x.encode(), y.encode()]
        sig, _ = signatures(np.frombuffer(b"".join(data), np.uint8), np.array([0, len(data[0]), len(data[0]) + len(data[1])]), bins=1024)
        true = len(grams(x) & grams(y)) / len(grams(x) | grams(y))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.07


def test_awkward_rows(spark):
    df = frame(spark, awkward())
    got = {r["doc_id"]: r["rep_doc_id"] for r in near_duplicates(df).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 10: 9}
    kept = dedup(df)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert [i for n, i in ids if not n] == [1, 4, 5, 6, 7, 9, 11, 12] and sum(n for n, _ in ids) == 2
    assert near_duplicates(df.limit(0)).collect() == [] and dedup(df.limit(0)).collect() == []
