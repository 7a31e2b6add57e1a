import random

import numpy as np

from clipquarry.llm import preferences, quality
from tests.llm.util import awkward, frame, prose


def made(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() > 0.3
        words = [w.capitalize() if rng.random() < 0.1 else w for w in prose(rng, rng.randrange(5, 150)).split()]
        if not good:
            words = [w + rng.choice(["%%%", "###"]) for w in words] if i % 2 else words[:1] * len(words)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(good), 0, 1.0))
    return rows, labels


def test_held_out_accuracy_and_calibration(spark):
    rows, labels = made(900, 1)
    lab = spark.createDataFrame(labels[:500] + [(1, None, None, 0.0), (None, 1, 0, 0.0), (10**9, 1, 0, 0.0)], "doc_id long, quality int, toxic int, y double")
    model = quality.fit(frame(spark, rows), lab)
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, rows), model).collect()}
    held = labels[500:]
    assert sum(got[i]["keep"] == bool(q) for i, q, _, _ in held) >= 0.95 * len(held)
    chance = np.array([got[i]["chance"] for i, _, _, _ in held])
    assert ((0 <= chance) & (chance <= 1)).all() and abs(chance.mean() - np.mean([q for _, q, _, _ in held])) < 0.05
    odd = {(r["doc_id"], r["score"], r["chance"], r["keep"]) for r in quality.quality(frame(spark, awkward()), model).collect() if r["doc_id"] in (4, 5, 6)}
    assert odd == {(4, None, 0.0, False), (5, None, 0.0, False), (6, None, 0.0, False)}


def test_sums_do_not_depend_on_partitions(spark):
    rows, labels = made(200, 2)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, y double")
    a, b = (quality.fit(frame(spark, rows).repartition(k), lab) for k in (1, 7))
    x = np.random.default_rng(0).normal(size=(50, len(quality.STATS)))
    assert np.allclose(a.score(x), b.score(x), atol=1e-6)


def test_no_labels(spark):
    rows, labels = made(30, 3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, y double")
    assert quality.fit(frame(spark, rows), lab.limit(0)) is None and quality.fit(frame(spark, rows), lab.filter("quality = 1")) is None
    assert all(r["keep"] and r["chance"] is None for r in quality.quality(frame(spark, rows), None).collect())
    assert quality.quality(frame(spark, rows).limit(0), None).collect() == []


def test_isotonic_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        y, w = rng.integers(0, 5, 12).astype(float), rng.integers(1, 4, 12).astype(float)
        x = np.arange(12.0)
        px, py = quality.isotonic(x, y, w)
        fit = np.array([max(min(np.average(y[i : j + 1], weights=w[i : j + 1]) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)])
        assert (np.diff(py) > 0).all() and np.allclose(sorted(set(np.round(fit, 9))), np.round(py, 9))


def test_ridge_equals_a_direct_solve(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["plain", "words", "AND", "$$$", "1234", "tail."]) for _ in range(rng.randrange(5, 80))), "s") for i in range(150)]
    labels = spark.createDataFrame([(i, int(t.count("$") < len(t) / 25), 0) for i, t, _ in rows], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    model = quality.fit(docs, labels, features=24)
    y = np.array([int(t.count("$") < len(t) / 25) for _, t, _ in rows], float)
    raw = [t.encode() for _, t, _ in rows]
    x = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    scale = x.std(0)
    z = np.sqrt(2 / 24) * np.cos(np.clip((x - x.mean(0)) / np.where(scale > 1e-9, scale, 1.0), -8, 8) @ model.omega + model.phase)
    z = np.c_[z, np.ones(len(z))]
    assert np.allclose(z, model.features(x))
    penalty = quality.RIDGE * len(z) * np.eye(25)
    penalty[-1, -1] = 0
    beta = np.linalg.lstsq(np.r_[z, np.sqrt(penalty)], np.r_[y, np.zeros(25)], rcond=None)[0]
    assert np.allclose(z @ beta, z @ model.beta, atol=1e-6)


def brute(chosen, rejected):
    c, r = ([(a or "", b or "") for a, b in x] for x in (chosen, rejected))
    if c == r or not c or not r:
        return None
    n = 0
    while n < min(len(c), len(r)) - 1 and c[n] == r[n]:
        n += 1
    show = lambda t: "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in t)

    def learnt(t):
        at, out = len(show(c[:n])), []
        for a, b in t:
            if a == "assistant":
                begin = at + len(f"<|{a}|>\n")
                out.append((begin, begin + len(b) + 7))
            at += len(show([(a, b)]))
        return out

    return n, show(c[:n]), show(c[n:]), show(r[n:]), learnt(c[n:]), learnt(r[n:])


def test_formatting_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "b\n", "", None, "é<|end|>"]))
        c = [turn() for _ in range(rng.randrange(0, 5))]
        r = c[: rng.randrange(0, len(c) + 1)] + [turn() for _ in range(rng.randrange(0, 3))]
        rows.append((i, c, r, "clash", 4))
    df = spark.createDataFrame([*rows, (None, None, [("user", "x")], "y", 1)], f"pair_id long, chosen {preferences.TURNS}, rejected {preferences.TURNS}, prompt string, n int")
    got = {r["pair_id"]: r for r in preferences.formatted(df).collect()}
    for i, c, r, _, _ in rows:
        want = brute(c, r)
        assert (want is None) == (i not in got)
        if want:
            g = got[i]
            assert (g["turns_in_prompt"], g["prompt"], g["chosen"], g["rejected"], [tuple(x) for x in g["chosen_mask"]], [tuple(x) for x in g["rejected_mask"]]) == want
    assert preferences.formatted(df.limit(0)).collect() == []


def test_pairs_of_conversations(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a b c d"), (1, 2, "user", "tail"), (2, 1, "assistant", "old one"), (2, 1, "assistant", "old one"), (2, 3, "assistant", "new"), (3, 1, "assistant", "old"), (3, 2, "user", None), (3, 3, "assistant", "new"), (4, 0, "user", "alone"),
        (None, 0, "assistant", "x"), (7, None, "assistant", "x"), (5, 0, "assistant", None), (6, 0, None, "x"), (6, 1, "assistant", "one"), (8, 0, "user", "go"), (8, 1, "assistant", "long " * 50_000), (8, 2, "assistant", "end"),
    ]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn long, role string, text string, last int, good string")
    got = {r["pair_id"]: ([tuple(x) for x in r["chosen"]], [x["text"] for x in r["rejected"]]) for r in preferences.pairs(df).collect()}
    half = " ".join(("long " * 50_000).split(" ")[:25_000])
    assert got == {
        1: ([("user", "q"), ("assistant", "a b c d")], ["q", "a b"]), 2: ([("assistant", "old one"), ("assistant", "new")], ["old", "new"]), 3: ([("assistant", "old"), ("user", ""), ("assistant", "new")], ["old", "", "old"]),
        5: ([("assistant", "")], [""]), 6: ([("", "x"), ("assistant", "one")], ["x", ""]), 8: ([("user", "go"), ("assistant", "long " * 50_000), ("assistant", "end")], ["go", half, "end"]),
    }
    made = preferences.formatted(preferences.pairs(df)).collect()
    assert {r["pair_id"]: (r["turns_in_prompt"], len(r["chosen_mask"])) for r in made} == {1: (1, 1), 2: (0, 2), 3: (2, 1), 6: (1, 1), 8: (1, 2)}
    for r in made:
        c = got[r["pair_id"]][0]
        whole = r["prompt"] + r["chosen"]
        assert "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in c) == whole
        assert [whole[m["begin"] : m["end"]] for m in r["chosen_mask"]] == [b + "<|end|>" for a, b in c[r["turns_in_prompt"] :] if a == "assistant"]
    assert preferences.pairs(df.limit(0)).collect() == []
