"""Shared pieces: packed tokenisation in numpy, shared-folder tables, connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one vectorised step works on; bounds a Python worker's memory, not the text.
CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_value(*modules: str) -> None:
    """Ship functions of these modules inside the task, so executors need no installed copy of the package."""
    import sys

    from pyspark import cloudpickle

    for name in modules:
        cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local master gets one of its own, as in tests; on a cluster that is an error, as executors would not see the driver's disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.getCheckpointDir() is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
            import tempfile

            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clipquarry-"))
        path = spark.sparkContext.getCheckpointDir()
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later uses of it neither recompute it nor need the executor that made it. The folder goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, as texts may be long. A setting of the session: it holds for what is run later, too."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


# -- tokens

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "inv" if inverse else "pow"
    if key not in _POWERS or len(_POWERS[key]) < n:
        p = np.full(max(n, CHUNK_BYTES * 2), _INV if inverse else _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS[key][:n]


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into bytes) of runs of rows of at most ``most`` bytes (or one row). A null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + most, side="right")) - 1)
        end = min(end, n)
        yield first, end, raw[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk: (hash, row, first byte, end byte). Words are runs of ASCII letters, digits and non-ASCII bytes, compared without case (ASCII and Latin-1)."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    word = _WORD[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = word[cut]
    ends = np.zeros(n, dtype=bool)
    ends[:-1] = word[:-1] & ~word[1:]
    ends[cut - 1] |= word[cut - 1]
    ends[n - 1] = word[n - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    low = _FOLD[raw]
    if (raw >= 128).any():
        after = np.zeros(n, dtype=bool)
        after[1:] = raw[:-1] == 0xC3
        up = after & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        low[up] += 0x20
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[low] * powers(n), out=total[1:])
    h = mix((total[end] - total[start]) * powers(n + 1, True)[start])
    return h, np.searchsorted(off, start, side="right") - 1, start, end


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive token hashes (len(h)-size+1 of them), whatever their rows."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * powers(n), out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(n + 1, True)[: n - size + 1])


def per_chunk(fn: Callable[[np.ndarray, np.ndarray], list], column: pa.Array) -> list:
    """fn's values for each row of a text column, chunk by chunk."""
    out: list = []
    for _, _, raw, off in text_chunks(column):
        out += fn(raw, off)
    return out


# -- graphs


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, root) for every id of ``edges`` (u, v): root is the smallest id of its connected component.

    Alternates large-star and small-star steps until no edge changes, which takes a number of rounds of the order of the logarithm of the largest component; the bound on rounds is there to end a run that a fault keeps from settling, with an error. Every round is written once in the shared folder. An id of very many edges is no single task: minima are taken before the shuffle, and its join is one that Spark splits. Null ends and loops are ignored; no edges give no rows."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u")).groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u > v").distinct()
        e = stored(small, "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, so that no other column of the input can clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def names_free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row, nulls told apart; columns that hold maps or variants can't be hashed and are left out."""
    odd = lambda t: any(x in t.simpleString() for x in ("map<", "variant"))
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not odd(f.dataType)]
    return F.xxhash64(*[x for c in plain for x in (c.isNull(), c)])


LONGS = T.ArrayType(T.LongType())

by_value(__name__)
