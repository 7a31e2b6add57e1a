"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_value, components, mix, names_free, only, small_batches, stored, text_chunks, tokens

BINS, ROWS, WORDS, LEAST = 192, 4, 3, 0.45


def shingles(h: np.ndarray, row: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``size`` words in a row; a row of fewer words gives one run of all it has."""
    n = len(h)
    if not n:
        return h, row
    size = max(1, size)
    first = np.r_[True, row[1:] != row[:-1]]
    starts = np.flatnonzero(first)
    lengths = np.diff(np.r_[starts, n])
    out = h * np.uint64(3)
    for k in range(1, size):
        out[: n - k] = mix(out[: n - k]) + h[k:]
    pos = np.arange(n) - np.repeat(starts, lengths)
    whole = pos <= np.repeat(lengths, lengths) - size
    got, rows = mix(out[whole]), row[whole]
    short = lengths < size
    if short.any():
        s, ln, acc = starts[short], lengths[short], h[starts[short]] * np.uint64(3)
        for k in range(1, size):
            there = ln > k
            acc[there] = mix(acc[there]) + h[s[there] + k]
        got, rows = np.r_[got, mix(acc + np.uint64(7))], np.r_[rows, row[s]]
    return got, rows


def signatures(raw: np.ndarray, off: np.ndarray, bins: int = BINS, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bins) 32-bit one-permutation sketches and which rows have any word.

    One hash of a shingle gives its bin (high bits) and its value (low bits); an empty bin borrows from a bin that a 2-universal probe sequence of its own index reaches first (optimal densification), so that P[equal] stays the Jaccard similarity."""
    n = len(off) - 1
    h, row, _, _ = tokens(raw, off)
    sh, rows = shingles(h, row, size)
    sig = np.full(n * bins, 1 << 32, dtype=np.int64)
    np.minimum.at(sig, rows * bins + (sh >> np.uint64(40)).astype(np.int64) % bins, (sh & np.uint64(0xFFFFFFFF)).astype(np.int64))
    sig = sig.reshape(n, bins)
    filled = sig < (1 << 32)
    some = filled.any(axis=1)
    r, b = np.nonzero(~filled & some[:, None])
    attempt = np.uint64(1)
    while len(r):
        probe = (mix(b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.full(1, attempt, np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(bins)).astype(np.int64)
        good = filled[r, probe]
        sig[r[good], b[good]] = sig[r[good], probe[good]]
        r, b, attempt = r[~good], b[~good], attempt + np.uint64(1)
    return sig, some


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, bins = sig.shape
    parts = sig.astype(np.uint64).reshape(n, bins // rows, rows)
    key = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, bins // rows)).copy()
    for k in range(rows):
        key = mix(key + parts[:, :, k] + np.uint64(k + 1))
    return key.view(np.int64)


def sketch(docs: DataFrame, bins: int = BINS, rows: int = ROWS, size: int = WORDS) -> DataFrame:
    """(doc_id, bands, sig) for each row that has a word."""
    schema = pa.schema([("doc_id", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, end, raw, off in text_chunks(batch.column(1)):
                sig, some = signatures(raw, off, bins, size)
                if not some.any():
                    continue
                sig = sig[some]
                keys = band_keys(sig, rows)
                low = sig.astype(np.uint16)
                yield pa.record_batch(
                    [
                        ids.slice(first, end - first).filter(pa.array(some)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel())),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                    ],
                    schema=schema,
                )

    return only(docs, "doc_id", "text").filter("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, bands array<long>, sig binary")


def star_edges(sketches: DataFrame) -> DataFrame:
    """(u, v): in each bucket the smallest id is the centre and every other id has one edge to it, n - 1 edges for n members.

    Centres are an aggregate that starts before the shuffle, and members meet theirs in a join, whose hot buckets Spark splits over tasks; no bucket is held in one."""
    rows = sketches.select("doc_id", F.explode("bands").alias("key"))
    centres = rows.groupBy("key").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("last")).filter("u < last").select("key", "u")
    return rows.join(centres, "key").select("u", F.col("doc_id").alias("v")).filter("u < v").distinct()


def _grouped(docs: DataFrame, bins: int, rows: int, size: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(id, root) of every grouped document but the representatives, and (doc_id, sig)."""
    small_batches(docs.sparkSession)
    sk = stored(sketch(docs, bins, rows, size), "minhash")
    sig = sk.select("doc_id", "sig").groupBy("doc_id").agg(F.min("sig").alias("sig"))
    edges = star_edges(sk).join(sig.select(F.col("doc_id").alias("u"), F.col("sig").alias("a")), "u").join(sig.select(F.col("doc_id").alias("v"), F.col("sig").alias("b")), "v")
    kept = edges.withColumn("s", _same(bins)("a", "b")).filter(F.col("s") >= least).select("u", "v")
    return components(kept).filter("id <> root"), sig


def near_duplicates(docs: DataFrame, bins: int = BINS, rows: int = ROWS, size: int = WORDS, least: float = LEAST) -> DataFrame:
    """(doc_id, rep_doc_id, similarity) for every document that is a near copy of another: rep_doc_id, the smallest doc_id of its group, stays.

    similarity is the sketch estimate (two bins are held equal if the lower 16 of their 32 bits are, which adds at most 1 in 65,536) of the Jaccard similarity of word shingles between the document and its group's representative (where the two are linked through others, it may be below ``least``). A pair enters a group if they share a bucket and the estimate reaches ``least``. Null doc_id or text, empty texts and texts without words: in no group; very long texts are sketched as a whole. Rows that repeat a doc_id count as one document. No rows in: none out. Other columns are ignored."""
    groups, sig = _grouped(docs, bins, rows, size, least)
    return (
        groups.join(sig.select(F.col("doc_id").alias("id"), F.col("sig").alias("a")), "id")
        .join(sig.select(F.col("doc_id").alias("root"), F.col("sig").alias("b")), "root")
        .select(F.col("id").alias("doc_id"), F.col("root").alias("rep_doc_id"), _same(bins)("a", "b").alias("similarity"))
    )


def _same(bins: int):
    @F.pandas_udf("double")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (np.frombuffer(b"".join(s), dtype=np.uint16).reshape(len(s), bins) for s in (a, b))
        return pd.Series((x == y).mean(axis=1))

    return same


def dedup(docs: DataFrame, bins: int = BINS, rows: int = ROWS, size: int = WORDS, least: float = LEAST) -> DataFrame:
    """The documents without near copies, all columns kept, whatever their names; one of each group, that of the least doc_id, stays.

    Rows that share a doc_id are versions of one document: the row first by text stays, a null text last. Rows with a null doc_id stay as they are, as nothing can name them; so do null, empty and wordless texts of other doc_ids. Very long texts are sketched as a whole. No rows in: none out."""
    gone = _grouped(docs, bins, rows, size, least)[0].select(F.col("id").alias("doc_id"))
    count, rank = names_free(docs, "n", "rank")
    many = stored(only(docs, "doc_id").filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(count)).filter(f"{count} > 1").select("doc_id"), "repeated")
    if many.isEmpty():  # texts are shuffled once, for the anti-join
        return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(gone.union(many).distinct(), "doc_id", "left_anti").select(*names)
    first = docs.join(many, "doc_id", "left_semi").join(gone, "doc_id", "left_anti")
    w = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    one = first.withColumn(rank, F.row_number().over(w)).filter(f"{rank} = 1").select(*names)
    return out.unionByName(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


by_value(__name__)
