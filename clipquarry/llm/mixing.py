"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_value, only, read_table, row_hash, stored

#: Sources get weight size ** ALPHA; the largest is copied once.
ALPHA, SEED = 0.8, "mix-1"
_UNIT = 1_000_000


def expected(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, size, units): size in characters, and the copies of each document of the source that the target weights ask for, in millionths.

    The budget is the least for which no source is cut: the source that is largest against its weight gets one copy of each document. There is no bound on copies, so every source reaches its target weight, however small it is. Without ``weights`` a source weighs size ** alpha; with them, sources that are not named weigh nothing and get no copy. A null source is a source of its own; one whose texts are all empty counts as of size 1. Sources that tie in size get the same. No rows in: none out."""
    sizes = only(docs, "source", "text").groupBy("source").agg(F.greatest(F.sum(F.coalesce(F.length("text"), F.lit(0))), F.lit(1)).cast("double").alias("size"))
    if weights is None:
        weight: Column = F.pow("size", F.lit(alpha))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce("source", F.lit(""))), F.lit(0.0)) if weights else F.lit(0.0)
    w = sizes.withColumn("w", weight)
    top = w.filter("w > 0").agg(F.max(F.expr("size / w")).alias("top"))  # one row
    return w.crossJoin(F.broadcast(top)).select("source", "size", F.round(F.coalesce(F.col("top") * F.col("w") / F.col("size"), F.lit(0.0)) * _UNIT).cast("long").alias("units"))


def _keys(docs: DataFrame, seed: str) -> list[Column]:
    """Source, order key and whole-row hash of each row. The key is a hash of doc_id, or of the row where doc_id is null."""
    whole = row_hash(docs)
    return [F.coalesce("source", F.lit("\0")).alias("src"), F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("|"), whole.cast("string"))))).alias("key"), whole.alias("whole")]


def systematic(docs: DataFrame, units: DataFrame, seed: str = SEED) -> DataFrame:
    """(src, key, whole, doc_id, source, n, times): how often each row of docs is to be put out, by systematic sampling; n rows that are equal in every column are one row here, and times is the sum of theirs.

    Within a source, in the order of a hash of doc_id, the expected copies are summed up; the source has one random offset, and a row is emitted once for each whole number that its stretch of the sum crosses. So a row with e expected copies comes out floor(e) or ceil(e) times, and a source within one of its sum. The prefix sum is taken in two steps, over 4,096 hash ranges of each source and within each, so a hot source is no single task; rows that are equal, however many, are counted before they are shuffled, and texts take no part. Rows that tie in doc_id are told apart by a hash of the row. A null doc_id has a place like any other, by that hash too."""
    rows = docs.select(*_keys(docs, seed), "doc_id").groupBy("src", "key", "whole", "doc_id").agg(F.count("*").alias("n"))
    rows = rows.withColumn("part", F.substring("key", 1, 3)).withColumn("source", F.nullif("src", F.lit("\0")))
    u = units.select(F.coalesce("source", F.lit("\0")).alias("src"), "units")
    count = docs.select(*_keys(docs, seed)[:2]).groupBy("src", F.substring("key", 1, 3).alias("part")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), "src")), 1, 8), 16, 10).cast("long") % _UNIT
    base = count.join(u, "src").withColumn("base", offset + (F.sum("n").over(order) - F.col("n")) * F.col("units")).select("src", "part", "base", "units")
    within = Window.partitionBy("src", "part").orderBy("key", "doc_id", "whole").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.join(base, ["src", "part"]).withColumn("k", F.sum("n").over(within))
    upto = F.floor((F.col("base") + F.col("k") * F.col("units")) / _UNIT)
    before = F.floor((F.col("base") + (F.col("k") - F.col("n")) * F.col("units")) / _UNIT)
    return placed.withColumn("times", upto - before).filter("times > 0").select("src", "key", "whole", "doc_id", "source", "n", "times")


def mixture(docs: DataFrame, **params: object) -> DataFrame:
    """(doc_id, source, copy): the documents of the mixture, repeated ones once for each copy. Rows equal in doc_id and source count as one row of as many shares. Null doc_ids and sources are kept as null; other columns, also of the names used here, are ignored. No rows in: none out."""
    own = only(docs, "doc_id", "source")
    return systematic(own, expected(docs, **params)).select("doc_id", "source", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))


def mixed(docs: DataFrame, **params: object) -> DataFrame:
    """The mixture with all columns of docs, whatever their names: every row as often as systematic sampling says, null and empty texts too. Of rows that are equal in every column, what comes out is as often as all of them together are to. No rows in: none out."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*_keys(docs, SEED), F.struct(*names).alias("row"))
    places = stored(systematic(docs, expected(docs, **params)), "mixture")
    one = rows
    if not places.filter("n > 1").isEmpty():  # rows that are equal are one before their texts are shuffled
        one = rows.groupBy("src", "key", "whole").agg(F.first("row").alias("row"))
    out = one.join(places.select("src", "key", "whole", "times"), ["src", "key", "whole"]).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents"))


SQL = f"""
WITH sizes AS (SELECT source, greatest(sum(coalesce(length(text), 0)), 1)::DOUBLE AS size FROM documents GROUP BY source),
w AS (SELECT *, pow(size, {ALPHA}) AS w FROM sizes),
units AS (SELECT source, CAST(round((SELECT max(size / w) FROM w) * w / size * {_UNIT}) AS BIGINT) AS units FROM w),
placed AS (
  SELECT d.doc_id, d.source, u.units,
         ('0x' || substr(md5('{SEED}|' || coalesce(d.source, chr(0))), 1, 8))::BIGINT % {_UNIT} AS off,
         row_number() OVER (PARTITION BY d.source ORDER BY md5('{SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id) AS k
  FROM documents d JOIN units u ON d.source IS NOT DISTINCT FROM u.source),
times AS (SELECT *, (off + k * units) // {_UNIT} - (off + (k - 1) * units) // {_UNIT} AS n FROM placed)
SELECT doc_id, source, CAST(unnest(range(1, n + 1)) AS BIGINT) AS copy FROM times
"""

by_value(__name__)
