import random
import re
from collections import defaultdict

import numpy as np

from clipquarry.llm.suffix import anchors, repeats

SCHEMA = "doc_id long, text string, name string, n int, a long"


def brute(docs, least):
    """Character spans covered by word runs that occur twice or more."""
    where, spots = defaultdict(list), {}
    for k, (_, text) in enumerate(docs):
        w = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")]
        spots[k] = w
        for i in range(len(w) - least + 1):
            where[tuple(x[0] for x in w[i : i + least])].append((k, i))
    covered = defaultdict(list)
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                covered[docs[k][0]].append((spots[k][i][1], spots[k][i + least - 1][2]))
    out = set()
    for d, spans in covered.items():
        run = None
        for a, b in sorted(spans):
            if run and a <= run[1]:
                run[1] = max(run[1], b)
            else:
                if run:
                    out.add((d, *run))
                run = [a, b]
        out.add((d, *run))
    return out


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.2 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def fixture(seed):
    rng = random.Random(seed)
    shared = words(rng, 70)
    docs = [(k, " ".join(words(rng, rng.randrange(10, 300)))) for k in range(30)]
    for k in range(30, 40):
        docs.append((k, " ".join(words(rng, rng.randrange(0, 40)) + shared[: rng.randrange(45, 70)] + words(rng, rng.randrange(0, 40)))))
    docs += [(40 + k, docs[3][1]) for k in range(3)] + [(50, docs[3][1].upper() + " tail more"), (51, "na " * 200), (52, ""), (53, None), (54, "x, y. " * 40)]
    loop = words(rng, 20)
    docs.append((55, " ".join(loop * 6)))
    return docs


def test_equals_brute_force(spark):
    for seed in range(3):
        docs = fixture(seed)
        df = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in docs], SCHEMA)
        for least in (50, 20):
            assert {tuple(r) for r in repeats(df, least).collect()} == brute([x for x in docs if x[1]], least)


def test_every_run_holds_an_anchor():
    rng = np.random.default_rng(0)
    for least in (20, 50, 51):
        h = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
        _, first, n, _ = anchors(h, np.repeat(np.arange(40), 500), least)
        ends = np.full(20001, 1 << 30)
        np.minimum.at(ends, first, first + n)
        soonest = np.minimum.accumulate(ends[::-1])[::-1]
        begin = np.array([i for i in range(20000 - least) if i // 500 == (i + least - 1) // 500])
        assert (soonest[begin] <= begin + least).all()


def test_no_rows_nulls_and_repeated_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repeats(empty).collect() == []
    text = " ".join(f"t{k}" for k in range(60))
    rows = [(None, text, "x", 1, 1), (1, text, "x", 1, 1), (1, text, "x", 1, 1), (2, None, None, None, None)]
    assert {tuple(r) for r in repeats(spark.createDataFrame(rows, SCHEMA)).collect()} == {(1, 0, len(text))}


def test_rows_that_differ_under_one_doc_id(spark):
    rng = random.Random(7)
    x, shared = words(rng, 90), words(rng, 60)
    y, z = words(rng, 30) + shared + words(rng, 10), words(rng, 8) + shared + words(rng, 40)
    part = x[20:80] + words(rng, 30)
    docs = [(5, x), (7, x), (7, y), (9, z), (4, part), (11, x), (11, x), (12, z), (12, y), (13, [w.upper() for w in x]), (13, part)]
    docs = [(d, " ".join(w)) for d, w in docs]
    again = [(1, " ".join(x)), (1, " ".join(x)), (2, " ".join(part)), (3, " ".join(y)), (3, " ".join(y)), (4, " ".join(z))]
    for rows in (docs[:4], docs, again, again[:3]):
        df = spark.createDataFrame([(d, t, "clash", 1, 2) for d, t in rows], SCHEMA)
        assert {tuple(r) for r in repeats(df).collect()} == brute(rows, 50)


def test_long_texts_and_clashing_columns(spark):
    rng = random.Random(8)
    passage = words(rng, 80)
    long = words(rng, 30_000, 10**6)
    docs = [(1, " ".join(long[:15_000] + passage + long[15_000:])), (2, " ".join(passage)), (3, "é" * 100_000), (4, " ".join(words(rng, 60)))]
    df = spark.createDataFrame([(d, t, 1, 2, "x", "y", 3, 4) for d, t in docs], "doc_id long, text string, begin int, end int, spots string, copies string, first int, b long")
    assert {tuple(r) for r in repeats(df).collect()} == brute(docs, 50)
