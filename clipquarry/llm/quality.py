"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, only, read_table, small_batches, stored, text_chunks, tokens

#: Bound on the labelled rows a fit uses; random features; width of the kernel in deviations; ridge; score bins for calibration.
MAX_FIT_ROWS, FEATURES, WIDTH, RIDGE, SCORE_BINS, SEED = 50_000, 128, 4.0, 1e-3, 400, 11
#: A document stays if it is good with at least this chance.
KEEP = 0.5

_CLASSES = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 symbol, 4 plain punctuation, 5 line end, 6 other space, 7 non-ASCII, 8 lower
_CLASSES[65:91], _CLASSES[97:123], _CLASSES[48:58], _CLASSES[128:] = 1, 8, 2, 7
_CLASSES[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~!"]] = 3
_CLASSES[[ord(c) for c in ".,;:'\"()-?"]] = 4
_CLASSES[10], _CLASSES[[9, 13, 32]] = 5, 6
STATS = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "punctuation", "lines", "space", "foreign", "distinct", "top_word", "same_as_last")


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of STATS for each text of a chunk; all 0 where there is no word."""
    n = len(off) - 1
    kinds = np.zeros((n, 9))
    some = np.flatnonzero(np.diff(off) > 0)
    if len(raw):
        c = _CLASSES[raw]
        for k in range(1, 9):
            kinds[some, k] = np.add.reduceat((c == k).astype(np.int64), off[some])
    h, row, start, end = tokens(raw, off)
    size = np.diff(off).astype(float)
    words = np.bincount(row, minlength=n).astype(float)
    letters = np.bincount(row, weights=end - start, minlength=n)
    distinct, top, same = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(h):
        _, at, count = np.unique(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_counts=True)
        distinct = np.bincount(row[at], minlength=n).astype(float)
        np.maximum.at(top, row[at], count)
        rep = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        same = np.bincount(row[1:][rep], minlength=n).astype(float)
    w, s = np.maximum(words, 1), np.maximum(size, 1)
    out = np.c_[np.log1p(size), np.log1p(words), letters / w, kinds[:, 1] / s, kinds[:, 2] / s, kinds[:, 3] / s, kinds[:, 4] / s, kinds[:, 5] / w, kinds[:, 6] / s, kinds[:, 7] / s, distinct / np.sqrt(w) / 10, top / w, same / w]
    out[words == 0] = 0
    return out


@dataclass
class Model:
    """mean and scale of the statistics, the random features, ridge weights, and the calibration as steps (score, chance)."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    beta: np.ndarray | None = None
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase), np.ones(len(x))]

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def chance(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, *self.steps)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares rising fit by pooling adjacent violators: (x of each pool, value). x is sorted."""
    pools: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), weight.tolist(), strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _stats(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The columns doc_id and extra, words and the statistics x, of every row; a null text as an empty one."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(raw, off) for _, _, raw, off in text_chunks(batch.column(batch.num_columns - 1))]
            x = np.concatenate(x) if x else np.zeros((0, len(STATS)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], names=["doc_id", *extra, "x"])

    return docs.select("doc_id", *extra, "text").mapInArrow(run, f"{kinds}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS))


def _summed(rows: DataFrame, sums) -> np.ndarray | None:
    """Element-wise sum of sums(x, y) over all rows: each partition adds up its own, Spark adds up by element, so the driver gets one vector however many partitions there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

    got = rows.select("x", "y").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    if not got.num_rows:
        return None
    out = np.zeros(got.num_rows)
    out[got["at"].to_numpy()] = got["v"].to_numpy()
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE) -> Model | None:
    """The model fitted on at most about max_rows labelled documents (taken by a hash of doc_id); None without labels of both kinds.

    Labels other than 0 and 1, null doc_ids and labels of unknown documents are left out; of several labels of a document the highest counts. Statistics of mean and scale, normal equations and calibration are sums over all those rows."""
    small_batches(docs.sparkSession)
    lab = only(labels, "doc_id", "quality").filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    count = lab.count()
    if not count:
        return None
    if count > max_rows:
        lab = lab.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(max_rows / count * 1_000_000))
    # lab is bounded by max_rows, so it may be sent to every executor
    own = only(docs, "doc_id", "text").join(F.broadcast(lab), "doc_id").select("doc_id", "y", "text")
    rows = stored(_stats(own, ("y",)), "quality")
    m = len(STATS)
    first = _summed(rows, lambda x, y: np.r_[len(x), y.sum(), x.sum(0), (x * x).sum(0)])
    if first is None or not 0 < first[1] < first[0]:
        return None
    mean = first[2 : 2 + m] / first[0]
    scale = np.sqrt(np.maximum(first[2 + m :] / first[0] - mean**2, 0))
    rng = np.random.default_rng(SEED)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(m, features)) / width, rng.uniform(0, 2 * np.pi, features))
    d = features + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.r_[(z.T @ z).ravel(), z.T @ y]

    total = _summed(rows, normal)
    penalty = ridge * first[0] * np.eye(d)
    penalty[-1, -1] = 0
    model.beta = np.linalg.solve(total[: d * d].reshape(d, d) + penalty, total[d * d :])
    lo, hi = -0.5, 1.5

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = np.clip(model.score(x), lo, hi)
        at = np.minimum(((s - lo) / (hi - lo) * SCORE_BINS).astype(int), SCORE_BINS - 1)
        return np.concatenate([np.bincount(at, w, SCORE_BINS) for w in (None, y, s)])

    n, y, s = _summed(rows, histogram).reshape(3, SCORE_BINS)
    at = n > 0
    model.steps = isotonic(s[at] / n[at], y[at] / n[at], n[at])
    return model


def quality(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """(doc_id, score, chance, keep) for every row: the ridge score, the calibrated chance that the document is good, and whether that reaches ``keep``.

    A null or wordless text has no score, chance 0, and is not kept. Without a model score and chance are null and everything that has text is kept. Repeated rows and null doc_ids are rows like others. Other columns are ignored. No rows in: none out."""
    small_batches(docs.sparkSession)
    rows = _stats(only(docs, "doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            some = x[:, 1] > 0
            if model is None:
                score, chance, good = pa.nulls(len(x), pa.float64()), pa.array(np.zeros(len(x)), mask=some), some
            else:
                s = model.score(x) if len(x) else np.zeros(0)
                c = np.where(some, np.clip(model.chance(s), 0, 1), 0.0)
                score, chance, good = pa.array(s, mask=~some), pa.array(c), c >= keep
            yield pa.RecordBatch.from_arrays([batch.column(0), score, chance, pa.array(good & some)], names=["doc_id", "score", "chance", "keep"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, chance double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality(docs, fit(docs, read_table(spark, sf_dir, "labels")))


by_value(__name__)
