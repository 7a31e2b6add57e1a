"""Joins of intervals and points within a key: overlap, semi, largest overlap, containment, as-of and nearest.

Overlap joins are cut into time buckets, so they are equi-joins on (key, bucket) that Spark can shuffle and adapt, in place
of a nested loop; a pair that shares several buckets is kept in the first of them only. As-of and nearest joins are one
sorted window over the union of both sides. Frames have columns s and e, in one unit; rows with a null key, s or e match
nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def overlap(s1="s", e1="e", s2="s2", e2="e2") -> Column:
    """Shared length of two intervals, 0 if apart."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.greatest(F.lit(0), F.least(c(e1), c(e2)) - F.greatest(c(s1), c(s2)))


def share_of_longer(s1="s", e1="e", s2="s2", e2="e2", least: float = 0.01) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return overlap(s1, e1, s2, e2) / F.greatest(c(e1) - c(s1), c(e2) - c(s2), F.lit(least))


def half_of_shorter(s1="s", e1="e", s2="s2", e2="e2") -> Column:
    """Whether the overlap is at least half of the shorter interval."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    shorter = F.least(c(e1) - c(s1), c(e2) - c(s2))
    return (shorter > 0) & (2 * overlap(s1, e1, s2, e2) >= shorter)


def overlap_join(left: DataFrame, right: DataFrame, key: str, width: int, touch: bool = False) -> DataFrame:
    """All pairs of a key that overlap (or, with touch, that share an end): left's columns and right's, which must differ but for key; right has s2 and e2. width: bucket length, about the usual length of the longer intervals."""
    spread = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width).cast("long"), F.floor(F.col(e) / width).cast("long")))
    lb = left.filter("s IS NOT NULL AND e IS NOT NULL AND e >= s").withColumn("__b", spread("s", "e"))
    rb = right.filter("s2 IS NOT NULL AND e2 IS NOT NULL AND e2 >= s2").withColumn("__b", spread("s2", "e2"))
    pair = lb.join(rb, [key, "__b"])
    first = F.col("__b") == F.floor(F.greatest("s", "s2") / width).cast("long")
    meets = (F.col("s") <= F.col("e2")) & (F.col("s2") <= F.col("e")) if touch else (F.col("s") < F.col("e2")) & (F.col("s2") < F.col("e"))
    return pair.filter(first & meets).drop("__b")


def overlap_semi(left: DataFrame, right: DataFrame, key: str, row: str, width: int, least: int = 1, anti: bool = False) -> DataFrame:
    """Rows of left that overlap some row of right by at least ``least`` (anti: that don't). row: left's unique column."""
    hit = overlap_join(left.select(key, row, "s", "e"), right.select(key, F.col("s").alias("s2"), F.col("e").alias("e2")), key, width).filter(overlap() >= least).select(row).distinct()
    return left.join(hit, row, "left_anti" if anti else "left_semi")


def guarded_semi(outputs: DataFrame, inputs: DataFrame, key: str, row: str, width: int, least: int = 1) -> DataFrame:
    """As overlap_semi, but a key of which no output is left gets its inputs instead; a key without inputs keeps its outputs. Both frames have the same columns."""
    kept = overlap_semi(outputs, inputs, key, row, width, least)
    free = outputs.join(inputs.select(key).distinct(), key, "left_anti")
    kept = kept.unionByName(free.select(*kept.columns))
    lost = outputs.select(key).distinct().join(kept.select(key).distinct(), key, "left_anti")
    return kept.unionByName(inputs.join(lost, key, "left_semi").select(*kept.columns))


def largest_overlap(left: DataFrame, right: DataFrame, key: str, row: str, value: str, width: int) -> DataFrame:
    """left with ``value`` of the row of right (key, pos, s, e, value) that it shares most with; the first pos on a tie, null without any."""
    pairs = overlap_join(left.select(key, row, "s", "e"), right.select(key, F.col("pos").alias("__pos"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col(value)), key, width)
    best = pairs.groupBy(row).agg(F.max_by(value, F.struct(overlap(), -F.col("__pos"))).alias(value))
    return left.join(best, row, "left")


def containing_or_nearest(points: DataFrame, spans: DataFrame, key: str, row: str, value: str) -> DataFrame:
    """points (key, row, t) with ``value`` of the first span (by s, e, pos) that contains t, both ends included, else of the nearest one, the first on a tie; '' where the key has no span. row need not be unique: points keep their columns and are joined with nothing.

    Points and spans of a key lie in one order of time, looked at forwards and backwards. A span contains t first if it is the first to end at t or later, and so ends after all spans before it; only such spans are asked for that."""
    own = spans.filter(F.col(key).isNotNull())
    w = Window.partitionBy(key).orderBy("s", "e", "pos")
    before = F.max(F.when(F.col("e") >= F.col("s"), F.col("e"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    order = own.select(key, F.row_number().over(w).alias("__r"), F.col("s").cast("long").alias("__s"), F.col("e").cast("long").alias("__e"), F.col(value).alias("__v"), ((F.col("e") >= F.col("s")) & (before.isNull() | (F.col("e") > before))).alias("__top"))
    first = order.filter("__top").select(key, F.col("__e").alias("t"), F.lit(2).alias("__q"), F.struct(F.col("__r").alias("r"), F.col("__s").alias("s"), F.col("__v").alias("v")).alias("__i"))
    ends = order.select(key, F.col("__e").alias("t"), F.lit(0).alias("__q"), F.struct(F.col("__e").alias("x"), (-F.col("__r")).alias("r"), F.col("__v").alias("v")).alias("__b"))
    starts = order.select(key, F.col("__s").alias("t"), F.lit(2).alias("__q"), F.struct(F.col("__s").alias("x"), F.col("__r").alias("r"), F.col("__v").alias("v")).alias("__f"))
    both = points.withColumns({"t": F.col("t").cast("long"), "__q": F.lit(1)})
    for part in (first, ends, starts):
        both = both.unionByName(part, allowMissingColumns=True)
    back, ahead = onward(key), onward(key, forward=True)
    seen = both.withColumns({"__b": F.max("__b").over(back), "__f": F.min("__f").over(ahead), "__i": F.min("__i").over(ahead)}).filter("__q = 1")
    gap_b = F.struct((F.col("t") - F.col("__b.x")).alias("g"), (-F.col("__b.r")).cast("int").alias("r"), F.col("__b.v").alias("v"))
    gap_f = F.struct((F.col("__f.x") - F.col("t")).alias("g"), F.col("__f.r").cast("int").alias("r"), F.col("__f.v").alias("v"))
    near = F.array_min(F.array_compact(F.array(F.when(F.col("__b").isNotNull(), gap_b), F.when(F.col("__f").isNotNull(), gap_f))))["v"]
    inside = F.when(F.col("__i.s") <= F.col("t"), F.col("__i.v"))
    return seen.select(*points.columns, F.coalesce(inside, near, F.lit("")).alias(value))


def onward(key: str, forward: bool = False) -> WindowSpec:
    """All rows of a key up to this one in order of t and __q, or, with forward, from this one on: in falling order, as Spark counts a frame that ends with the partition anew for every row."""
    order = [F.desc("t"), F.desc("__q")] if forward else ["t", "__q"]
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def asof(points: DataFrame, anchors: DataFrame, key: str, row: str, forward: bool = False) -> DataFrame:
    """(row, anchor): the last anchor (key, a) at or before each point's t, or with forward the first at or after it; null without any."""
    q = points.select(key, "t", F.lit(1).alias("__q"), F.col(row), F.lit(None).cast("long").alias("a"))
    a = anchors.select(key, F.col("a").cast("long").alias("t"), F.lit(2 if forward else 0).alias("__q"), F.lit(None).cast(points.schema[row].dataType).alias(row), F.col("a").cast("long"))
    pick = (F.min if forward else F.max)("a").over(onward(key, forward))
    return q.unionByName(a).withColumn("anchor", pick).filter("__q = 1").select(row, "anchor")


def snapped(points: DataFrame, tiers: list[DataFrame], key: str, row: str, most: int, forward: bool = False) -> DataFrame:
    """(row, t, snapped): t moved to the as-of anchor of the first tier that has one within ``most``; t itself where none has or most is 0. All tiers are seen in one sorted window, so there is one shuffle and no join."""
    kinds = points.schema[row].dataType
    everything = points.select(key, "t", F.lit(1).alias("__q"), F.col(row), F.lit(-1).alias("__tier"), F.lit(None).cast("long").alias("a"))
    for k, tier in enumerate(tiers):
        everything = everything.unionByName(tier.select(key, F.col("a").cast("long").alias("t"), F.lit(2 if forward else 0).alias("__q"), F.lit(None).cast(kinds).alias(row), F.lit(k).alias("__tier"), F.col("a").cast("long")))
    pick, w = F.min if forward else F.max, onward(key, forward)
    near = everything.withColumns({f"__a{k}": pick(F.when(F.col("__tier") == k, F.col("a"))).over(w) for k in range(len(tiers))}).filter("__q = 1")
    within = [F.when((F.abs(F.col("t") - F.col(f"__a{k}")) <= most) & F.lit(most > 0), F.col(f"__a{k}")) for k in range(len(tiers))]
    return near.select(row, "t", F.coalesce(*within, F.col("t")).alias("snapped"))


def nearest(points: DataFrame, allowed: DataFrame, key: str, row: str, most: int) -> DataFrame:
    """(row, t, nearest): the allowed value (key, a) next to t, the smaller on a tie, if within ``most``; else t."""
    b = asof(points, allowed, key, row).withColumnRenamed("anchor", "__b")
    f = asof(points, allowed, key, row, forward=True).withColumnRenamed("anchor", "__f")
    db, df = F.col("t") - F.col("__b"), F.col("__f") - F.col("t")
    pick = F.when(F.col("__f").isNull() | (db <= df), F.col("__b")).otherwise(F.col("__f"))
    x = points.join(b, row, "left").join(f, row, "left").withColumn("__p", pick)
    return x.select(row, "t", F.when(F.abs(F.col("__p") - F.col("t")) <= most, F.col("__p")).otherwise(F.col("t")).alias("nearest"))


def clamped(df: DataFrame, lo: Column, hi: Column, tolerance: int = 0, least: int = 1) -> DataFrame:
    """Rows not outside lo - tolerance .. hi + tolerance, cut to lo .. hi; those of which less than ``least`` is left go."""
    kept = df.filter(~((F.col("e") <= lo - tolerance) | (F.col("s") >= hi + tolerance)))
    cut = lambda c: F.least(F.greatest(F.col(c), lo), hi)
    return kept.withColumn("__s", cut("s")).withColumn("__e", cut("e")).filter(F.col("__e") - F.col("__s") >= least).withColumn("s", F.col("__s")).withColumn("e", F.col("__e")).drop("__s", "__e")
