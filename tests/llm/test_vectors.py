import numpy as np

from clipquarry.llm.vectors import crossing, linked, near_duplicates, visits

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, id string"


def roots(pairs, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32))
    for k in range(400):  # displaced by about the radius, in any direction
        y = x[rng.integers(0, 700)] + (d := rng.normal(size=32)) * 0
        d *= rng.uniform(0.05, 0.31) * np.linalg.norm(y) / np.linalg.norm(d)
        x = np.r_[x, (y + d)[None]]
    x = np.r_[x, np.repeat(x[:1], 60, 0)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = np.argwhere(np.triu(u @ u.T >= 0.95, 1))
    df = spark.createDataFrame([(i, v.tolist(), 0, 1, "x") for i, v in enumerate(x)], SCHEMA)
    got = dict(map(tuple, near_duplicates(df).collect()))
    found = sum(got.get(int(a), a) == got.get(int(b), b) for a, b in pairs)
    assert found >= 0.95 * len(pairs)
    true = roots(pairs.tolist(), range(len(x)))
    assert all(true[i] == true[r] for i, r in got.items())


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(5, v), (5, v), (6, [2.0, 4.0, 6.0, 8.0]), (7, None), (8, [0.0] * 4), (9, [1.0]), (10, [float("nan"), 1.0, 1.0, 1.0]), (None, v), (11, [-1.0, -2.0, -3.0, -4.0]), (12, [None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, x, None, 3, None) for i, x in rows], SCHEMA)
    assert [tuple(r) for r in near_duplicates(df).collect()] == [(6, 5)]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_visits_are_the_likeliest_cells():
    rng = np.random.default_rng(3)
    for k in (1, 2, 9):
        books = (rng.normal(size=(k, 4)).astype(np.float32), rng.normal(size=(k, 4)).astype(np.float32))
        x = rng.normal(size=(40, 8)).astype(np.float32)
        for recall in (0.5, 0.98, 1.0):
            row, cell, own = visits(x, books, 0.4, recall)
            p, q = crossing(x[:, :4], books[0], 0.4), crossing(x[:, 4:], books[1], 0.4)
            for r in range(len(x)):
                grid = (p[r][:, None].astype(float) * q[r][None]).ravel()
                got = cell[row == r]
                assert len(set(got.tolist())) == len(got) and own[row == r][0] and own[row == r].sum() == 1
                assert np.allclose(grid[got], np.sort(grid)[::-1][: len(got)])  # in order, and none is skipped
                rest = grid.sum() - grid[got].sum()
                assert rest <= 1 - recall + 1e-9 or len(got) == k * k
                assert len(got) == 1 or rest + grid[got[-1]] > 1 - recall - 1e-9


def test_linked_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, homes = 60, int(rng.integers(0, 61))
        x = rng.normal(size=(6, 5))[rng.integers(0, 6, n)] + rng.normal(size=(n, 5)) * 0.3
        v = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        pairs = [(a, b) for a, b in np.argwhere(np.triu(v @ v.T >= 0.95, 1)).tolist() if a < homes]
        true = roots(pairs, range(n))
        for most in (0, 10**9):
            got = linked(v, homes, 0.95, most)
            assert all((got[a] == got[b]) == (true[a] == true[b]) for a in range(n) for b in range(n))


def test_dense_cells_take_no_longer(spark):
    import time

    rng = np.random.default_rng(6)
    c = rng.normal(size=64)
    took = []
    for n in (2000, 16000):
        x = c + rng.normal(size=(n, 64)) * 0.02
        v = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        began = time.perf_counter()
        assert len(set(linked(v, n, 0.95).tolist())) == 1
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.5
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0], 0, 0, "") for i in range(20_000)] + [(20_000, [3.0, -1.0, 0.0], 0, 0, "")], SCHEMA)
    got = near_duplicates(same).collect()
    assert len(got) == 19_999 and {r["rep_vec_id"] for r in got} == {0}
