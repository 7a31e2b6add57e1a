"""Suffix-array dedup by prefix-free parsing.

Rolling-hash triggers cut every text into phrases, each of which ends with the trigger that begins the next, so no phrase is a
prefix of another. Suffixes of the corpus are then ordered by two names: that of the phrase suffix (dictionary) and that of
the parse suffix that follows it. The order is cut off at the least length of a repeat, which is all that is asked of it:
a suffix has a repeat if, in that order, a neighbour has the same two names. Names are hashes of words in place of
lexicographic ranks, so that no stage needs all phrases in one place; only parts of the text whose phrases repeat are ordered
at all, and whole copies of a text stand for one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_value, mix, only, powers, read_table, small_batches, stored, text_chunks, tokens

#: A repeat has at least LEAST words; a trigger is a pair of words of which one in MODULUS is one.
LEAST, MODULUS = 50, 6
#: Bytes of text that a step works on; names are hashed in many arrays, so they are fewer than elsewhere.
CHUNK = 1 << 19
_W = 2


def _sums(h: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(len(h)), out=total[1:])
    return total


def _name(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the words from a to b."""
    return mix((total[b] - total[a]) * powers(len(total), True)[a] + (b - a).astype(np.uint64))


def _triggers(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a trigger begins at each word."""
    out = np.zeros(len(h), dtype=bool)
    if len(h) >= _W:
        pair = mix(h[:-1] * np.uint64(3) + h[1:])
        out[:-1] = (pair % np.uint64(MODULUS) == 0) & (row[1:] == row[:-1])
    return out


def _whole(total: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Name of a text as a whole; it is never that of an anchor."""
    return _name(total, begin, begin + size) ^ np.uint64(0x5851F42D4C957F2D)


def anchors(h: np.ndarray, row: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, words, whether a phrase) of what any repeat of ``least`` words holds one of: whole phrases, and, as a repeat may lie in a stretch of about half its length without a trigger, every run of some words within such a stretch."""
    n = len(h)
    total = _sums(h)
    at = np.flatnonzero(_triggers(h, row))
    a, b = at[:-1], at[1:]
    same = row[a] == row[b] if len(at) > 1 else np.zeros(0, bool)
    first, words = a[same], (b - a)[same] + _W
    # stretches without a trigger, at the ends of texts too
    edge = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True]) if n else np.zeros(0, np.int64)
    cuts = np.unique(np.r_[at, edge])
    lo, hi = cuts[:-1], cuts[1:]
    room, run = (least - _W + 1) // 2 - 1, max(1, (least - _W) // 2 - 3)
    sparse = hi - lo > room
    lo, hi = lo[sparse], np.minimum(hi[sparse] + _W - 1, n)
    m = np.maximum(hi - lo - run, 0)
    start = np.repeat(lo, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    start = start[start + run <= n]
    start = start[row[start] == row[start + run - 1]]
    phrase = np.r_[np.ones(len(first), bool), np.zeros(len(start), bool)]
    first = np.r_[first, start].astype(np.int64)
    words = np.r_[words, np.full(len(start), run)].astype(np.int64)
    return _name(total, first, first + words), first, words, phrase


def marks(doc_id: np.ndarray, *name: np.ndarray) -> np.ndarray:
    """Of the rows of a chunk: 0 for one whose name no other has, 1 for the one of least doc_id of those that share a name, and for its others a number of 2 or more of their own, odd if they have the same doc_id.

    So what a chunk repeats is known without a look elsewhere, and of a name that very many rows have each chunk sends one row to the place where names meet; the others are dealt over all tasks."""
    n = len(doc_id)
    out = np.zeros(n, np.int32)
    if n:
        order = np.lexsort((doc_id, *name[::-1]))
        new = np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in name], axis=0)]
        first, size = np.flatnonzero(new), np.diff(np.r_[np.flatnonzero(new), n])
        out[order[first[size > 1]]] = 1
        rest = order[~new]
        own = mix(doc_id[rest].astype(np.uint64) * np.uint64(31) + rest.astype(np.uint64)) % np.uint64((1 << 30) - 2)
        out[rest] = own.astype(np.int64) * 2 + 2 + (doc_id[rest] == np.repeat(doc_id[order[first]], size - 1))
    return out


def parse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(name, doc_id, first, mark) of every anchor; and one row for each text of at least ``least`` words as a whole, with first = -1 - its length in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, end, raw, off in text_chunks(batch.column(1), CHUNK):
                h, row, _, _ = tokens(raw, off)
                if not len(h):
                    continue
                size = np.bincount(row, minlength=end - lo)
                begin = np.cumsum(size) - size
                long = np.flatnonzero(size >= least)
                name, first, _, _ = anchors(h, row, least)
                chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)][off]
                whole = _whole(_sums(h), begin[long], size[long])
                keep = size[row[first]] >= least
                name, first = name[keep], first[keep]
                r = row[first]
                name, doc = np.r_[name, whole].view(np.int64), ids[lo + np.r_[r, long]].astype(np.int64)
                yield pa.record_batch(
                    [pa.array(name), pa.array(doc), pa.array(np.r_[first - begin[r], -1 - np.diff(chars)[long]].astype(np.int32)), pa.array(marks(doc, name))],
                    names=["name", "doc_id", "first", "mark"],
                )

    return only(docs, "doc_id", "text").mapInArrow(run, "name long, doc_id long, first int, mark int")


def ordered(marked: DataFrame, least: int = LEAST) -> DataFrame:
    """From (doc_id, text, spots, copies): (a, b, doc_id, begin, end, mark) of every run of ``least`` words all of whose anchors repeat: the names of its phrase suffix and of its parse suffix, and its characters. A text whose name as a whole is in copies is left out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("mark", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            spots, copies = batch.column(2), batch.column(3)
            for lo, end, raw, off in text_chunks(batch.column(1), CHUNK):
                h, row, sb, eb = tokens(raw, off)
                n = len(h)
                if n < least:
                    continue
                size = np.bincount(row, minlength=end - lo)
                base = np.cumsum(size) - size
                part = spots.slice(lo, end - lo)
                counts = np.array([len(x) if x.is_valid else 0 for x in part])
                good = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(base, counts)
                _, first, words, phrase = anchors(h, row, least)
                repeats = np.isin(first, good)
                # a run of which there is another may hold no phrase that does not repeat, and must hold an anchor that does
                bad = np.zeros(n + 2, dtype=np.int64)
                begin = np.arange(n - least + 1)
                inside = words <= least
                f, w, r, whole = first[inside], words[inside], repeats[inside], phrase[inside]
                some = bad.copy()
                for count, which in ((bad, ~r & whole), (some, r)):
                    np.add.at(count, np.maximum(f[which] + w[which] - least, 0), 1)
                    np.add.at(count, f[which] + 1, -1)
                bad, some = np.cumsum(bad)[: len(begin)], np.cumsum(some)[: len(begin)]
                total = _sums(h)
                names = _whole(total, base, size).view(np.int64).tolist()
                lone = np.array([not x.is_valid or name not in x.as_py() for x, name in zip(copies.slice(lo, end - lo), names, strict=True)])
                begin = begin[(bad == 0) & (some > 0) & (row[begin] == row[begin + least - 1]) & lone[row[begin]]]
                if not len(begin):
                    continue
                at = np.r_[np.flatnonzero(_triggers(h, row)), n + least]
                t = at[np.searchsorted(at, begin)]
                stop = begin + least
                cut = np.where(t + _W <= stop, t, stop)
                a = _name(total, begin, np.minimum(cut + _W, stop))
                b = _name(total, cut, stop)
                chars = np.cumsum((raw & 0xC0) != 0x80)
                zero = np.r_[0, chars][off[row[begin]]]
                doc = ids[lo + row[begin]]
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc), pa.array((chars[sb[begin]] - 1 - zero).astype(np.int32)), pa.array((chars[eb[begin + least - 1] - 1] - zero).astype(np.int32)), pa.array(marks(doc, a, b))], schema=schema)

    return marked.mapInArrow(run, "a long, b long, doc_id long, begin int, end int, mark int")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, begin, end): each longest stretch of characters of a text that is covered by runs of ``least`` words that occur at least twice in the corpus, in another text or in the same.

    Words are compared without case, marks and white space. Texts of under ``least`` words, null and empty texts and rows with a null doc_id have no row. Rows that repeat a doc_id count as texts of their own; their stretches are given together. No rows in: none out. Other columns are ignored. Passages that only one text has are never given. Texts are read whole, however long. Of a phrase or a passage that very many texts share, each chunk of text sends one row to where they are compared."""
    small_batches(docs.sparkSession)
    own = only(docs, "doc_id", "text").filter("doc_id is not null and text is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    apart = F.when(F.col("mark") < 2, 0).otherwise(F.col("mark"))
    by = Window.partitionBy("name", apart)
    # of copies in one chunk all but the first have a mark of their own; there is one of a lower doc_id if it is even
    lead = F.when(F.col("mark") < 2, F.min("doc_id").over(by)).otherwise(F.col("doc_id") - 1 + F.col("mark") % 2)
    seen = parse(own, least).select("*", F.count("*").over(by).alias("n"), lead.alias("lead")).filter("n > 1 or mark > 0").drop("n", "mark")
    spots = stored(seen.groupBy("doc_id").agg(F.collect_list(F.when(F.col("first") >= 0, F.col("first"))).alias("spots"), F.min("first").alias("least"), F.collect_set(F.when((F.col("first") < 0) & (F.col("lead") < F.col("doc_id")), F.col("name"))).alias("copies")), "anchors")
    whole = spots.filter("least < 0").select("doc_id", F.lit(0).alias("begin"), (-1 - F.col("least")).alias("end"))
    # a doc_id's only text is left out here if it is a copy; where there are more, each is looked at by itself, with the spots of all: too many are no harm
    several = only(docs, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1")
    some = spots.filter("size(spots) > 0").join(several, "doc_id", "left").filter("size(copies) = 0 or texts is not null")
    marked = own.join(some, "doc_id").select("doc_id", "text", "spots", "copies")
    # a neighbour in the order has the same names or none has, so places are dealt by both: a common beginning is no group of its own
    same = F.count("*").over(Window.partitionBy("a", "b", apart))
    found = ordered(marked, least).select("doc_id", "begin", "end", "mark", same.alias("n")).filter("n > 1 or mark > 0").select("doc_id", "begin", "end").unionByName(whole)
    return joined(found)


def joined(spans: DataFrame) -> DataFrame:
    """Spans that touch or overlap, as one."""
    w = Window.partitionBy("doc_id").orderBy("begin", "end")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("__new", F.when(F.col("begin") <= upto, 0).otherwise(1))
    run = new.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("doc_id", "__run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).select("doc_id", "begin", "end")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read_table(spark, sf_dir, "documents"))


#: The same by brute force: every run of LEAST words of every text by its words, those that come twice, joined; and texts that are the same as a whole. Words here fold case of all letters; the corpus has none beyond Latin-1.
SQL = rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, text, regexp_extract_all(text, '[A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+|[^A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+') AS p FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
u AS (SELECT doc_id, row, text, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM t),
c AS (SELECT *, sum(length(x)) OVER (PARTITION BY row ORDER BY i) AS stop FROM u),
w AS (SELECT doc_id, row, lower(x) AS x, CAST(stop - length(x) AS INT) AS start, CAST(stop AS INT) AS stop, row_number() OVER (PARTITION BY row ORDER BY i) AS k FROM c WHERE regexp_matches(x, '^[A-Za-z0-9\x{{80}}-\x{{10FFFF}}]')),
l AS (SELECT row, any_value(doc_id) AS doc_id, list(x ORDER BY k) AS ws, list(start ORDER BY k) AS a, list(stop ORDER BY k) AS b FROM w GROUP BY row HAVING count(*) >= {LEAST}),
r AS (SELECT row, doc_id, a, b, ws, unnest(range(1, len(ws) - {LEAST} + 2)) AS k FROM l),
n AS (SELECT row, doc_id, a[k] AS s, b[k + {LEAST - 1}] AS e, md5(array_to_string(ws[k:k + {LEAST - 1}], ' ')) AS name FROM r),
twice AS (SELECT name FROM n GROUP BY name HAVING count(*) > 1),
same AS (SELECT row, doc_id, count(*) OVER (PARTITION BY array_to_string(ws, ' ')) AS n FROM l),
spans AS (SELECT doc_id, s, e FROM n WHERE name IN (SELECT name FROM twice) UNION ALL SELECT same.doc_id, 0, CAST(length(t.text) AS INT) FROM same JOIN t ON t.row = same.row WHERE n > 1),
f AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM spans),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT doc_id, min(s) AS "begin", max(e) AS "end" FROM g GROUP BY doc_id, run
"""

by_value(__name__)
