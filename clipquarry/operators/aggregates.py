"""Aggregates: apportionment, per-variant figures, stability, suspect terms, probe logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def apportioned(mix: dict[str, int], seconds: Column, per_hour: int) -> Column:
    """Largest remainders: the kinds' shares of max(1, round(hours * rate)) clips in whole numbers, as a map; ties go to the kind named first. A rate or length of 0 leaves the mix, a mix of nothing makes all reels. seconds: whole seconds, a bigint."""
    kinds = list(mix)
    base = sum(mix.values())
    x = seconds * per_hour
    whole, rest = F.floor(x / 3600).cast("long"), x % 3600
    total = F.greatest(F.lit(1).cast("long"), F.when((rest * 2 > 3600) | ((rest * 2 == 3600) & (whole % 2 == 1)), whole + 1).otherwise(whole))
    if not base:
        return F.create_map(F.lit("reel"), total)
    floors = [F.floor(total * n / base).cast("long") for n in mix.values()]
    parts = [total * n % base for n in mix.values()]
    left = total
    for f in floors:
        left = left - f
    got = []
    for i, k in enumerate(kinds):
        before = F.lit(0)
        for j in range(len(kinds)):
            if j != i:
                before = before + F.when((parts[j] > parts[i]) | ((parts[j] == parts[i]) & F.lit(j < i)), 1).otherwise(0)
        got += [F.lit(k), F.when((seconds <= 0) | F.lit(per_hour <= 0), F.lit(mix[k]).cast("long")).otherwise(floors[i] + F.when(before < left, 1).otherwise(0))]
    return F.create_map(*got)


def variant_metrics(m: DataFrame, shortest: int, longest: int) -> DataFrame:
    """Count, mean score and length, and lengths out of bounds, by variant; from (variant, s, e, score)."""
    d = F.col("e") - F.col("s")
    mean = lambda x: F.floor(F.sum(x).cast("double") / F.count("*") * 1000 + 0.5) / 1000
    return m.groupBy("variant").agg(F.count("*").alias("moments"), mean(F.col("score")).alias("avg_score"), mean(d).alias("avg_duration"), F.count_if(~d.between(shortest, longest)).alias("violations"))


def stability(m: DataFrame, width: int) -> DataFrame:
    """(ep, a, b, jaccard) over the sets of bucketed (s, e) of each two variants of an episode; 1 where both are empty. Counts, not sets, are joined, so no set is gathered."""
    cells = m.select("ep", "variant", F.floor(F.col("s") / width).alias("x"), F.floor(F.col("e") / width).alias("y")).distinct()
    size = cells.groupBy("ep", "variant").agg(F.count("*").alias("n"))
    both = cells.withColumnRenamed("variant", "a").join(cells.withColumnRenamed("variant", "b"), ["ep", "x", "y"]).groupBy("ep", "a", "b").agg(F.count("*").alias("common"))
    pairs = size.withColumnsRenamed({"variant": "a", "n": "na"}).join(size.withColumnsRenamed({"variant": "b", "n": "nb"}), "ep")
    c = F.coalesce("common", F.lit(0))
    return pairs.join(both, ["ep", "a", "b"], "left").select("ep", "a", "b", (F.floor(c / (F.col("na") + F.col("nb") - c) * 10000 + 0.5) / 10000).alias("jaccard"))


#: A capitalised word of four letters or more that opens no sentence and no line.
CAPITAL = r"(?m)(?=[А-ЯЁA-Z])(?<![.!?…\n]\s)(?<!^)(?<![\p{L}\p{N}_])[А-ЯЁA-Z][а-яёa-z]{3,}(?![\p{L}\p{N}_])"


def suspect_terms(docs: DataFrame, key: str, least: int = 2, stem: int = 6, length: int = 6) -> DataFrame:
    """(key, stem, term, occurrences): capitalised words within sentences that share their first letters, if they occur often enough and none is short; term is the shortest, the first on a tie."""
    w = docs.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(CAPITAL), F.lit(0))).alias("pos", "word")).withColumn("stem", F.substring(F.lower("word"), 1, stem))
    g = w.groupBy(key, "stem").agg(F.count("*").alias("occurrences"), F.min(F.length("word")).alias("least"), F.min_by("word", F.struct(F.length("word"), "pos")).alias("term"))
    return g.filter((F.col("occurrences") >= least) & (F.col("least") >= length)).drop("least")


def collocates(docs: DataFrame, key: str, stem: int = 6) -> DataFrame:
    """(key, stem, neighbour, n): the capitalised word that most often stands right before those of a stem, the first by letters on a tie; words of the same stem don't count."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"), F.lit(0))
    w = docs.select(key, F.explode(F.arrays_zip(F.slice(words.alias("x"), 1, 1_000_000_000).alias("a"), F.slice(words, 2, 1_000_000_000).alias("b"))).alias("p")).select(key, "p.a", "p.b")
    cap = r"^\p{Lu}\p{Ll}{3,}$"
    w = w.filter(F.col("a").rlike(cap) & F.col("b").rlike(cap)).select(key, F.substring(F.lower("b"), 1, stem).alias("stem"), F.col("a").alias("neighbour")).filter(F.substring(F.lower("neighbour"), 1, stem) != F.col("stem"))
    n = w.groupBy(key, "stem", "neighbour").agg(F.count("*").alias("n"))
    r = Window.partitionBy(key, "stem").orderBy(F.desc("n"), "neighbour")
    return n.withColumn("r", F.row_number().over(r)).filter("r = 1").drop("r")


def suspect_queries(docs: DataFrame, key: str) -> DataFrame:
    """(key, term, occurrences, query): suspects with what is asked about them, their usual neighbour, if they have one, and the term."""
    near = collocates(docs, key)
    x = suspect_terms(docs, key).join(near, [key, "stem"], "left")
    return x.select(key, "term", "occurrences", F.trim(F.concat_ws(" ", "neighbour", "term")).alias("query"))


def silence_ratio(log: Column | str, span: Column) -> Column:
    """Silent share of a span from a probe's log: the sum of the lengths told, and an open silence to the end; at most 1. No marks: 0 if the volume was measured, else null."""
    x = F.col(log) if isinstance(log, str) else log
    nums = lambda p: F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(1)), lambda v: v.try_cast("double"))
    begins, lengths = nums(r"silence_start: (-?[0-9.]+)"), nums(r"silence_duration: ([0-9.]+)")
    known = F.aggregate(lengths, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    tail = F.when(F.size(begins) > F.size(lengths), F.greatest(F.lit(0.0), span - F.element_at(begins, -1))).otherwise(0.0)
    marks = (F.size(begins) > 0) | (F.size(lengths) > 0)
    ratio = F.floor(F.least(F.lit(1.0), (known + tail) / span) * 10000 + 0.5) / 10000
    return F.when(marks & (span > 0), ratio).when(x.contains("mean_volume:"), 0.0)


def volume(log: Column | str, which: str = "mean") -> Column:
    x = F.col(log) if isinstance(log, str) else log
    return F.regexp_extract(x, which + r"_volume: (-?[0-9.]+) dB", 1).try_cast("double")


def scaled_score(x: Column) -> Column:
    """A score on 0..10 whatever its scale: up to 1 times 10, over 10 by 10; 0 and below is none."""
    v = F.when(x <= 1, x * 10).when(x > 10, F.least(x / 10, F.lit(10.0))).otherwise(x)
    return F.when(x > 0, v)


def latest_by(df: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """The values of each key's row of the highest order; one hash aggregate, no sort."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("v")).select(key, "v.*")


def upper_median(x: Column) -> Column:
    """The middle value, of an even number the higher of the two."""
    return F.element_at(F.array_sort(F.collect_list(x)), (F.floor(F.count(x) / 2) + 1).cast("int"))
