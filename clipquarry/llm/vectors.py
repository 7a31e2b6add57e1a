"""Embedding near-dedup with an inverted multi-index.

Two codebooks, one for each half of the vectors, form a product grid of cells. Every vector lies in the list of its own cell
and, as a query, visits others in multi-sequence order, the likeliest first, until what it has not visited holds a near copy
with a chance below 1 - target recall. Pairs that meet in a cell are verified by their cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, components, only, read_table, small_batches, stored

#: Near copies have at least this cosine. A cell has about this many vectors. Rounds of k-means, over all vectors each.
COSINE, RECALL, CELL, ROUNDS = 0.95, 0.98, 32, 4


def unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors of length 1) of those entries that have dim finite numbers, not all zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.array(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(size == dim)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], (x[good] / norm[good, None]).astype(np.float32)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def codebooks(rows: DataFrame, dim: int, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """k centres for each half by k-means over all rows; partitions send sums, which Spark adds up by centre and coordinate."""
    half = dim // 2
    seeds = rows.orderBy(F.xxhash64("vec_id", F.lit("seed")), "vec_id").select("vec").limit(4 * k).toArrow()
    x = np.unique(unit(seeds["vec"], dim)[1], axis=0)
    x = x[np.argsort((x.astype(np.float64) @ np.arange(1, dim + 1)) % 0.001)][:k]
    books = (x[:, :half].copy(), x[:, half:].copy())
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], books: tuple = books) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(b), b.shape[1] + 1)) for b in books]
            for batch in batches:
                _, v = unit(batch.column(0), dim)
                for s, b, part in zip(sums, books, (v[:, :half], v[:, half:]), strict=True):
                    c = _distances(part, b).argmin(1)
                    np.add.at(s, c, np.c_[part, np.ones(len(part))])
            flat = np.concatenate([s.ravel() for s in sums])
            at = np.flatnonzero(flat)
            yield pa.record_batch([pa.array(at), pa.array(flat[at])], names=["at", "x"])

        total = np.zeros(sum(len(b) * (b.shape[1] + 1) for b in books))
        got = rows.select("vec").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        total[got["at"].to_numpy()] = got["x"].to_numpy()
        cut = len(books[0]) * (half + 1)
        new = []
        for b, part in zip(books, (total[:cut], total[cut:]), strict=True):
            s = part.reshape(len(b), -1)
            new.append(np.where(s[:, -1:] > 0, s[:, :-1] / np.maximum(s[:, -1:], 1), b).astype(np.float32))
        books = (new[0], new[1])
    return books


def crossing(x: np.ndarray, centres: np.ndarray, sigma: float) -> np.ndarray:
    """For each row and centre: a bound on the chance that a near copy of the row is nearest to that centre. A near copy is displaced by the radius in a random direction, so its part towards the plane between two centres is about normal with deviation sigma."""
    d = _distances(x, centres)
    own = d.argmin(1)
    apart = np.sqrt(_distances(centres, centres))[own]
    h = (d - d.min(1)[:, None]) / np.maximum(2 * apart, 1e-9)
    p = 0.5 * np.exp(-0.717 * (z := h / sigma) - 0.416 * z * z)  # within a few per cent of the normal tail
    p[np.arange(len(x)), own] = 1.0
    return p


def visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], sigma: float, recall: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether its own): the cells a vector visits, likeliest first, until the chances of those not visited sum to at most 1 - recall.

    The multi-sequence walk, of all rows in step: centres of each half are sorted by chance, and of centre i of the first half taken[i] cells have been visited. The next cell is the best of the corners (i, taken[i]), of which only those with taken[i] < taken[i - 1] can be, so a row looks at a staircase of the grid and never at the grid."""
    half = books[0].shape[1]
    k = len(books[1])
    probs = [crossing(part, b, sigma) for part, b in zip((x[:, :half], x[:, half:]), books, strict=True)]
    order = [np.argsort(-p, axis=1, kind="stable") for p in probs]
    p, q = (np.take_along_axis(p, o, 1).astype(np.float64) for p, o in zip(probs, order, strict=True))
    q = np.c_[q, np.zeros(len(x))]  # beyond the last centre there is nothing
    left = p.sum(1) * q.sum(1)
    live = np.arange(len(x))
    taken = np.zeros((len(x), 1), np.int64)
    corner = p[:, :1] * q[:, :1]
    rows, first, second = [], [], []
    while len(live):
        i = corner.argmax(1)
        at = np.arange(len(live))
        j = taken[at, i]
        rows.append(live), first.append(order[0][live, i]), second.append(order[1][live, j])
        left[live] -= corner[at, i]
        taken[at, i] += 1
        if i.max() + 1 == taken.shape[1] and taken.shape[1] < p.shape[1]:
            taken, corner = np.c_[taken, np.zeros(len(live), np.int64)], np.c_[corner, np.zeros(len(live))]
        for c in (i, np.minimum(i + 1, taken.shape[1] - 1)):
            t = taken[at, c]
            open_ = (c == 0) | (t < taken[at, np.maximum(c - 1, 0)])
            corner[at, c] = np.where(open_, p[live, c] * q[live, np.minimum(t, k)], 0.0)
        go = (left[live] > 1 - recall) & (corner.max(1) > 0)
        if not go.all():
            live, taken, corner = live[go], taken[go], corner[go]
    row, a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (rows, first, second))
    turn = np.argsort(row, kind="stable")  # a vector's visits in a row, which shuffles small
    row, a, b = row[turn], a[turn], b[turn]
    own = (a == order[0][row, 0]) & (b == order[1][row, 0])
    return row, a * k + b, own


def _listed(rows: DataFrame, dim: int, books: tuple[np.ndarray, np.ndarray], sigma: float, recall: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                at, v = unit(part.column(1), dim)
                if not len(at):
                    continue
                row, cell, own = visits(v, books, sigma, recall)
                # of the two cells of a pair it is enough that one side visits the other's; own cells are always there
                yield pa.record_batch(
                    [pa.array(cell.astype(np.int64)), part.column(0).take(pa.array(at[row])).cast(pa.int64()), pa.array(own), pa.array([x.tobytes() for x in v], pa.binary()).take(pa.array(row))],
                    names=["cell", "id", "own", "v"],
                )

    return rows.mapInArrow(run, "cell long, id long, own boolean, v binary")


#: Up to so many pairs in a cell are all compared; beyond, leaders come first.
PAIRS = 1 << 22


def linked(v: np.ndarray, homes: int, least: float, pairs: int = PAIRS) -> np.ndarray:
    """For each vector of length 1 a label, equal for those that chains of pairs of at least that cosine connect; of a pair, one at least is among the first ``homes``.

    A cell of ordinary size is one product of matrices. In a larger one leaders are taken in order; what is near a leader has its label at once, so dense groups cost one pass. Only vectors of groups whose leaders are so near that the angles allow a link are compared one by one, in blocks."""
    n = len(v)
    if not homes:
        return np.arange(n)
    if n * homes <= pairs:
        a, b = np.nonzero(v @ v[:homes].T >= least)
        label = np.arange(n)
        while True:
            low = np.minimum(label[a], label[b])
            old = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == old).all():
                return label
    label = np.full(n, -1)
    leaders: list[int] = []
    for i in range(homes):
        if label[i] < 0:
            free = np.flatnonzero(label < 0)
            near = free[v[free] @ v[i] >= least]
            label[near], label[i] = len(leaders), len(leaders)
            leaders.append(i)
    free = np.flatnonzero(label < 0)  # visitors that no leader is near to
    label[free] = len(leaders) + np.arange(len(free))
    leaders += free.tolist()
    parent = np.arange(len(leaders))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    lead = v[leaders]
    angle = np.arccos(np.clip((v * lead[label]).sum(1), -1, 1))
    radius = np.zeros(len(leaders))
    np.maximum.at(radius, label, angle)
    reach = np.arccos(np.clip(least, -1, 1))
    members = np.split(np.argsort(label, kind="stable"), np.cumsum(np.bincount(label, minlength=len(leaders)))[:-1])
    for a in range(len(leaders)):
        apart = np.arccos(np.clip(lead[a + 1 :] @ lead[a], -1, 1))
        for b in (np.flatnonzero(apart <= reach + radius[a] + radius[a + 1 :] + 1e-6) + a + 1).tolist():
            if root(a) == root(b):
                continue
            x, y = members[a], members[b]
            for lo in range(0, len(x), 1024):
                some = v[x[lo : lo + 1024]] @ v[y].T >= least
                some &= (x[lo : lo + 1024] < homes)[:, None] | (y < homes)[None]
                if some.any():
                    parent[root(b)] = root(a)
                    break
    return np.array([root(k) for k in range(len(leaders))])[label]


def _edges(table: pa.Table, dim: int, least: float) -> pa.Table:
    """Star edges of one cell: of vectors that verified pairs link, one edge from each to the smallest id."""
    ids = table["id"].to_numpy()
    own = np.array(table["own"])
    v = np.frombuffer(b"".join(table["v"].to_pylist()), np.float32).reshape(len(ids), dim)
    order = np.argsort(~own, kind="stable")
    ids, label = ids[order], linked(v[order], int(own.sum()), least)
    smallest = np.full(label.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, ids)
    root = smallest[label]
    keep = root != ids
    return pa.table({"u": pa.array(root[keep]), "v": pa.array(ids[keep])})


def near_duplicates(vectors: DataFrame, least: float = COSINE, recall: float = RECALL, cell: int = CELL, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, rep_vec_id) for every vector that has a near copy: rep_vec_id is the smallest vec_id of its group, linked by pairs of at least that cosine; the representative has no row.

    Every vector is a query. The dimension is that of most vectors; vectors of another, null or zero ones, ones with null, infinite or NaN coordinates, and rows with a null vec_id have no row. Equal vectors, however many, are one before anything else is done with them, and each is linked with the smallest of their ids; rows that repeat a vec_id count as one, with all its vectors. The grid grows with the number of different vectors, and its centres are drawn from them, so a cell holds as many at any size and where vectors lie close cells do too. No rows in: none out. Other columns are ignored."""
    spark = vectors.sparkSession
    small_batches(spark)
    every = only(vectors, "vec_id", "embedding").filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vec"))
    sizes = every.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None or sizes["d"] < 2:
        return spark.createDataFrame([], "vec_id long, rep_vec_id long")
    dim = sizes["d"]
    good = every.filter((F.size("vec") == dim) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0))
    name = [F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), F.col("vec")).alias("b")]  # 128 bits stand for a vector
    ids = good.select("vec_id", *name)
    first = stored(ids.groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    copies = ids.join(first.filter("n > 1"), ["a", "b"]).filter("vec_id > rep").select(F.col("rep").alias("u"), F.col("vec_id").alias("v"))
    n = first.count()
    many = n < first.agg(F.sum("n")).first()[0]
    rows = good
    if many:  # one row for each different vector; what is left out is what first says
        w = good.select("vec_id", "vec", *name).join(first.select("a", "b", F.col("rep").alias("vec_id")), ["a", "b", "vec_id"]).groupBy("a", "b", "vec_id").agg(F.first("vec").alias("vec"))
        rows = stored(w.select("vec_id", "vec"), "vectors")
    k = max(1, math.ceil(math.sqrt(n / cell)))
    books = codebooks(rows, dim, k, rounds) if n else (np.zeros((0, 1)),) * 2
    if not len(books[0]):
        return spark.createDataFrame([], "vec_id long, rep_vec_id long")
    sigma = math.sqrt(max(2 - 2 * least, 1e-9) / dim)
    lists = _listed(rows, dim, books, sigma, recall)
    found = stored(lists.groupBy("cell").applyInArrow(lambda t: _edges(t, dim, least), "u long, v long").unionByName(copies), "vectors")
    return components(found).filter("id <> root").select(F.col("id").alias("vec_id"), F.col("root").alias("rep_vec_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


#: The same by comparing all pairs; the index finds a pair with the target recall, so with near copies the two may differ by as much.
SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding, b.embedding) >= {COSINE}),
r AS (SELECT vec_id AS id, vec_id AS root FROM e UNION SELECT p.v, r.root FROM r JOIN p ON p.u = r.id)
SELECT id AS vec_id, min(root) AS rep_vec_id FROM r GROUP BY id HAVING min(root) < id
"""

by_value(__name__)
