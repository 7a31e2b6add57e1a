import random
from collections import Counter, defaultdict

import numpy as np

from clipquarry.llm.mixing import expected, mixed, mixture, systematic
from clipquarry.llm.packing import best_two_fit, pack
from tests.llm.util import awkward, frame


def slow(lengths, capacity):
    """Best-two-fit by trying all pairs."""
    left, bins = sorted(((x, i) for i, x in enumerate(lengths)), key=lambda z: (-z[0], z[1])), []
    while left:
        gap, items = capacity, []
        while True:
            fit = [z for z in left if z[0] <= gap]
            if not fit:
                break
            items.append(fit[0])
            left.remove(fit[0])
            gap -= fit[0][0]
        while gap:
            small = items[-1]
            room = gap + small[0]
            best = max(((a[0] + b[0], a[0]) for k, a in enumerate(left) for b in left[k + 1 :] if a[0] + b[0] <= room), default=(0, 0))
            if best[0] <= small[0]:
                break
            one = next(z for z in left if z[0] == best[1])
            left.remove(one)
            two = next(z for z in left if z[0] == best[0] - best[1])
            left.remove(two)
            left.append(small)
            left.sort(key=lambda z: (-z[0], z[1]))
            items = sorted([*items[:-1], one, two], key=lambda z: -z[0])
            gap = room - best[0]
        bins.append([x for x, _ in items])
    return bins


def test_best_two_fit_equals_trying_all_pairs():
    rng = random.Random(0)
    for _ in range(200):
        cap = rng.randrange(5, 60)
        lengths = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(0, 40))]
        where, slot = best_two_fit(np.array(lengths, dtype=np.int64), cap)
        bins = defaultdict(list)
        for x, w, s in sorted(zip(lengths, where, slot, strict=True), key=lambda z: (z[1], z[2])):
            bins[w].append(x)
        assert [bins[k] for k in sorted(bins)] == slow(lengths, cap)


def test_pack_rows(spark):
    rows = awkward()
    df = frame(spark, rows)
    for shards in (1, 5):
        got = pack(df, 700, texts=True, shards=shards).collect()
        assert max(Counter({b: sum(r["length"] for r in got if r["bin_id"] == b) for b in {r["bin_id"] for r in got}}).values()) <= 700
        want = Counter((i, k, t[b : b + 700]) for i, t, _ in rows if t for k, b in enumerate(range(0, len(t), 700)))
        assert Counter((r["doc_id"], r["piece"], r["text"]) for r in got) == want
        assert all(r["length"] == len(r["text"]) and r["begin"] == 700 * r["piece"] for r in got)
        assert len({(r["bin_id"], r["slot"]) for r in got}) == len(got)
    assert pack(df.limit(0)).collect() == [] and pack(df.filter("doc_id in (4, 5)")).collect() == []


def test_systematic_copies(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(1, 90), s) for i, s in enumerate("a" * 300 + "b" * 40 + "c" * 7)]
    df = frame(spark, rows)
    units = {r["source"]: r["units"] for r in expected(df, {"a": 0.2, "b": 0.7, "c": 0.0}).collect()}
    assert units["c"] == 0 and min(u for s, u in units.items() if s != "c") == 1_000_000
    copies = Counter((r["doc_id"], r["source"]) for r in mixture(df, weights={"a": 0.5, "b": 0.5}).collect())
    u = {r["source"]: r["units"] / 1e6 for r in expected(df, {"a": 0.5, "b": 0.5}).collect()}
    for s in "ab":
        n = [copies[i, s] for i, _, x in rows if x == s]
        assert abs(sum(n) - u[s] * len(n)) <= 1 and set(n) <= {int(u[s]), int(u[s]) + 1}
    size = Counter({s: sum(copies[i, x] * len(t) for i, t, x in rows if x == s) for s in "ab"})
    assert abs(size["a"] / size.total() - 0.5) < 0.05
    again = systematic(df, expected(df), "other").groupBy().sum("times").first()[0]
    assert abs(again - mixed(df).count()) <= 3
    tiny = frame(spark, [(i, "x" * 100, "big") for i in range(2000)] + [(9999, "y", "tiny")])
    shares = {r["source"]: r["size"] * r["units"] / 1e6 for r in expected(tiny).collect()}
    assert abs(shares["tiny"] / shares["big"] - (1 / 200_000) ** 0.8) < 1e-8  # no bound on copies keeps a small source short


def test_mixing_awkward_rows(spark):
    df = frame(spark, awkward())
    out = mixed(df)
    assert out.columns == df.columns
    got, want = Counter(map(tuple, out.collect())), Counter(map(tuple, df.collect()))
    assert set(got) == set(want) and all(got[r] >= n for r, n in want.items())
    assert mixed(df.limit(0)).collect() == [] and mixture(df, weights={}).collect() == []


def test_mixing_clashes_and_hot_groups(spark):
    """Columns that bear the names used inside, a doc_id and a null repeated over and over, rows that are equal."""
    names = ["src", "key", "whole", "part", "row", "times", "copy", "n", "units", "base", "k", "__key", "_key", "a.b"]
    rows = [(None, f"t{i}", "a", *(f"{c}{i}" for c in names)) for i in range(300)] + [(7, "same", "a", *names)] * 500 + [(8, None, None, *names), (9, "", "b", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    got, want = Counter(map(tuple, mixed(df).collect())), Counter(map(tuple, rows))
    assert mixed(df).columns == df.columns and set(got) == set(want) and all(got[r] >= n for r, n in want.items())
    u = {r["source"]: r["units"] / 1e6 for r in expected(df).collect()}
    assert abs(sum(n for r, n in got.items() if r[2] == "a") - 800 * u["a"]) <= 1
    assert abs(sum(1 for r in mixture(df).collect() if r["source"] == "a") - 800 * u["a"]) <= 1


def test_pack_repeated_rows(spark):
    df = frame(spark, [(7, "abc" * 20, "a")] * 5000 + [(None, "x" * 50, "b")] * 3000 + [(1, "one", "c")])
    for texts in (False, True):
        got = pack(df, 200, texts=texts, shards=4).collect()
        assert Counter(r["doc_id"] for r in got) == {7: 5000, None: 3000, 1: 1}
        assert len({(r["bin_id"], r["slot"]) for r in got}) == len(got)
        fill = Counter()
        for r in got:
            fill[r["bin_id"]] += r["length"]
        assert max(fill.values()) <= 200
        assert max(Counter(r["bin_id"] >> 32 for r in got).values()) < 6000  # equal rows are dealt over the shards
