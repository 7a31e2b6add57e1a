"""Best-two-fit packing of documents into bins of one capacity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, only, read_table, stored

#: Characters in a bin, about 4,096 tokens; characters in a shard, which one task packs.
CAPACITY, SHARD_CHARS = 16_384, 24_000_000
#: Rows that are equal are dealt over shards in lots of this many.
LOT = 256


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, slot) of each length, from 1 to capacity.

    A bin is filled greedily with the longest item that fits. Then, while it helps, its shortest item goes back and the two unpacked items come in whose sum is largest within the gap thus made, if that is more than it was; of equal sums the pair with the longest item. Items of one length go in their order. No lengths: no bins."""
    n = len(lengths)
    where, slot = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-np.arange(n), kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order.tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    count = np.bincount(lengths, minlength=capacity + 1) if n else np.zeros(capacity + 1, np.int64)
    below = np.maximum.accumulate(np.where(count > 0, np.arange(capacity + 1), 0))  # longest length there is, up to each

    def take(x: int) -> int:
        count[x] -= 1
        if not count[x]:
            after = x + 1
            stop = capacity + 1
            above = np.flatnonzero(below[after:] != x)
            stop = after + int(above[0]) if len(above) else stop
            below[x:stop] = below[x - 1]
        return stacks[x].pop()

    def give(x: int, i: int) -> None:
        if not count[x]:
            part = below[x:]
            part[part < x] = x
        count[x] += 1
        stacks[x].append(i)

    left, k = n, 0
    while left:
        gap, items = capacity, []
        while gap and (x := int(below[gap])):
            items.append((x, take(x)))
            gap -= x
        left -= len(items)
        while gap and left > 1:
            x, i = items[-1]  # filled from long to short
            room = gap + x
            a = np.flatnonzero(count[: room + 1])
            if not len(a):
                break
            b = below[room - a]
            b = np.where((b == a) & (count[a] < 2), below[a - 1], b)
            b = np.where(b < a, b, np.where(b == a, b, 0))  # a is the longer
            total = np.where(b > 0, a + b, 0)
            best = len(a) - 1 - int(np.argmax(total[::-1]))
            if total[best] <= x:
                break
            items.pop()
            one, two = int(a[best]), int(b[best])
            pair = [(one, take(one)), (two, take(two))]
            give(x, i)
            items = sorted(items + pair, key=lambda z: -z[0])
            left -= 1
            gap = room - one - two
        for s, (_, i) in enumerate(items):
            where[i], slot[i] = k, s
        k += 1
    return where, slot


def _shards(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.length("text"))).first()[0]
    return max(1, -(-int(total or 0) // SHARD_CHARS))


def _rows(docs: DataFrame, texts: bool) -> DataFrame:
    """(doc_id, n, tie, lot, copies[, text]): the rows that have text. Rows that are equal, if there are more than LOT of them, are counted before they are shuffled and come in lots."""
    own = only(docs, "doc_id", "text").filter("text is not null and text <> ''")
    rows = own.select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("tie"), *(["text"] if texts else []))
    many = stored(rows.groupBy("doc_id", "n", "tie").agg(F.count("*").alias("c")).filter(F.col("c") > LOT), "repeated")
    once = lambda r: r.withColumn("lot", F.lit(0).cast("long")).withColumn("copies", F.lit(1).cast("long"))
    if many.isEmpty():
        return once(rows)
    hot = F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("tie") == F.col("m_tie")) & (F.col("n") == F.col("m_n"))
    m = many.select(F.col("doc_id").alias("m_doc"), F.col("tie").alias("m_tie"), F.col("n").alias("m_n"))
    whole = rows.join(m, hot, "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("c"))
    lots = whole.select(*rows.columns, "c", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(c - 1) div {LOT}"))).alias("lot"))
    return once(rows.join(m, hot, "left_anti")).unionByName(lots.withColumn("copies", F.least(F.lit(LOT).cast("long"), F.col("c") - F.col("lot") * LOT)).drop("c"))


def _packed(docs: DataFrame, capacity: int, texts: bool, shards: int | None) -> DataFrame:
    shards = shards or _shards(docs)
    rows = _rows(docs, texts).withColumn("shard", F.pmod(F.xxhash64("doc_id", "tie", "lot"), F.lit(shards)).cast("long"))
    kinds = "bin_id long, slot int, doc_id long, piece int, begin int, length int" + ", text string" * texts
    names = [k.split()[0] for k in kinds.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("lot", "ascending")])
        copies = table["copies"].to_numpy()
        if (copies > 1).any():
            table = table.take(pa.array(np.repeat(np.arange(len(copies)), copies)))
        n = table["n"].to_numpy().astype(np.int64)
        shard = table["shard"][0].as_py()
        pieces = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = piece * capacity
        length = np.minimum(n[row] - begin, capacity)
        where, slot = best_two_fit(length, capacity)
        out = [pa.array(shard * (1 << 32) + where), pa.array(slot, pa.int32()), table["doc_id"].take(pa.array(row)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(begin, pa.int32()), pa.array(length, pa.int32())]
        if texts:
            every = table["text"].to_pylist()
            out.append(pa.array([every[r] if m == n[r] else every[r][b : b + m] for r, b, m in zip(row.tolist(), begin.tolist(), length.tolist(), strict=True)], pa.string()))
        return pa.table(out, names=names)

    return rows.groupBy("shard").applyInArrow(run, kinds)


def pack(docs: DataFrame, capacity: int = CAPACITY, texts: bool = False, shards: int | None = None) -> DataFrame:
    """(bin_id, slot, doc_id, piece, begin, length[, text]): each stretch of each document and its place in a bin.

    A document longer than capacity is cut into pieces of capacity characters and the rest; every character is in exactly one bin. Documents are dealt over shards by a hash, as many as the corpus has SHARD_CHARS characters; each shard is packed by itself, so work and memory of a task stay the same at any size, and at most one bin a shard is badly filled for want of documents. Null and empty texts have nothing to pack and no row. Rows that repeat, also in doc_id, are packed each, and dealt over the shards if there are many; a null doc_id is kept as null. Of pieces that tie in length the one first by doc_id and text goes first. Other columns are ignored. No rows in: none out."""
    return _packed(docs, capacity, texts, shards)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


by_value(__name__)
