"""Fuzzy matching and checked edits: quotes against what was said, corrections against their source, spellings against a lookup.

Sequence ratios are those of difflib with its defaults; they are the only part in Python, in Arrow batches, and rows that plain
comparison decides come to it as nulls, which it passes over."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, normalised, tokens

MATCH = 0.75


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def safe_correction(original: Column | str, corrected: Column | str, least: float = 0.8) -> Column:
    """Whether an edit keeps the content: equal once normalised, or of a ratio of at least ``least`` with nearly as many words. An empty edit is safe for an empty original only."""
    a, b = normalised(original), normalised(corrected)
    na, nb = F.size(tokens(original)), F.size(tokens(corrected))
    drift = F.greatest(F.lit(2), F.floor(na * 0.2).cast("int"))
    decided = F.when(b == "", a == "").when(a == b, True).when(F.abs(na - nb) > drift, False)
    # a branch does not keep Python from seeing a row; a null does
    return F.coalesce(decided, ratio(F.when(decided.isNull(), a), F.when(decided.isNull(), b)) >= least)


def applied(segments: DataFrame, fixes: DataFrame, key: list[str]) -> DataFrame:
    """segments with text replaced by the correction (key, corrected) where there is a safe one; verdict is applied, rejected, same or none. An outer join: a segment without correction stays."""
    x = segments.join(fixes, key, "left")
    ok = safe_correction("text", "corrected")
    verdict = F.when(F.col("corrected").isNull(), "none").when(F.col("corrected") == F.col("text"), "same").when(ok, "applied").otherwise("rejected")
    x = x.withColumn("verdict", verdict)
    return x.withColumn("text", F.when(F.col("verdict") == "applied", F.col("corrected")).otherwise(F.col("text"))).drop("corrected")


def best_window(quote: str | None, said: list[str]) -> tuple[float, int, int]:
    """(ratio, first, end) of the run of as many words that is most like the quote; the first on a tie. All words if there are no more than the quote has."""
    q = re.findall(r"[^\W_]+", (quote or "").lower().translate({0x451: 0x435}))
    n = len(q)
    if not n or not said:
        return 0.0, 0, 0
    needle = " ".join(q)
    if n >= len(said):
        return difflib.SequenceMatcher(None, needle, " ".join(said)).ratio(), 0, len(said)
    for k in range(len(said) - n + 1):
        if said[k : k + n] == q:
            return 1.0, k, k + n
    best, at = 0.0, 0
    bounds = _bounds(needle, said, n)
    # by falling bound, the first on a tie; none beyond a bound that is under the best can be better
    for k in sorted(range(len(bounds)), key=lambda i: (-bounds[i], i)):
        if bounds[k] < best:
            break
        x = difflib.SequenceMatcher(None, needle, " ".join(said[k : k + n])).ratio()
        if x > best or (x == best > 0 and k < at):
            best, at = x, k
    return best, at, at + n


def _bounds(needle: str, said: list[str], n: int) -> list[float]:
    """Of every run of n words, the ratio that its longest common subsequence with the needle allows: the blocks that difflib matches are one. Found with the needle's places as the bits of a number."""
    places: dict[str, int] = {}
    for i, c in enumerate(needle):
        places[c] = places.get(c, 0) | 1 << i
    size = len(needle)
    full = (1 << size) - 1
    out = []
    for k in range(len(said) - n + 1):
        run, open_ = " ".join(said[k : k + n]), full
        for c in run:
            hit = open_ & places.get(c, 0)
            if hit:
                open_ = ((open_ + hit) | (open_ - hit)) & full
        out.append(2.0 * (size - open_.bit_count()) / (size + len(run)))
    return out


_FOUND = T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType())])


@F.pandas_udf(_FOUND)
def window_match(quote: pd.Series, said: pd.Series) -> pd.DataFrame:
    rows = [best_window(q, [] if s is None else list(s)) for q, s in zip(quote, said, strict=True)]
    return pd.DataFrame([(round(r, 4), a, b) for r, a, b in rows], columns=["ratio", "first", "end"])


def exact_window(quote: Column | str, said: Column) -> Column:
    """What window_match finds where the quote's words are said in a row: 1 and the first such place; null elsewhere. said: an array of tokens."""

    def found(x: Column) -> Column:
        before = F.call_function("substring_index", x["said"], x["quote"], F.lit(1))
        first = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
        return F.when((x["n"] > 0) & F.contains(x["said"], x["quote"]), F.struct(F.lit(1.0).alias("ratio"), first.cast("int").alias("first"), (first + x["n"]).cast("int").alias("end")))

    pad = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return let(tokens(quote), lambda q: let(F.struct(pad(said).alias("said"), pad(q).alias("quote"), F.size(q).alias("n")), found))


def said_near(spans: DataFrame, words: DataFrame, key: str, row: str, around: int, width: int) -> DataFrame:
    """spans (key, row, s, e) with w: the words (key, s2, e2, seg, pos, t) that share time with each, widened by ``around`` at both ends, in order of time: an array of struct(s2, seg, pos, t, e2), empty or null without any.

    Words lie in buckets of time as arrays, each with the bucket after it, so a span no longer than a bucket is a filter over one array; only longer ones are put together from several."""
    at = lambda c: F.floor(F.col(c) / width).cast("long")
    w = words.filter("s2 IS NOT NULL AND e2 IS NOT NULL AND e2 >= s2").withColumn("__b", F.explode(F.sequence(at("s2") - 1, at("e2"))))
    held = w.groupBy(key, "__b").agg(F.array_sort(F.collect_list(F.struct("s2", "seg", "pos", "t", "e2"))).alias("__w"))
    own = spans.withColumns({"__s": F.col("s") - around, "__e": F.col("e") + around})
    own = own.withColumn("__more", F.coalesce(at("__e") - at("__s") > 1, F.lit(False)))
    meets = lambda y: (y["s2"] < F.col("__e")) & (F.col("__s") < y["e2"])
    # a fixed number, as few moments ask for much of Python and would all be put into one task for their size
    tasks = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = own.filter("NOT __more").withColumn("__b", at("__s")).repartition(tasks, key, "__b").join(held, [key, "__b"], "left")
    one = one.withColumn("w", F.when(F.col("__e") >= F.col("__s"), F.filter("__w", meets)))
    # of a word that several arrays have, the one of the first bucket that both share has it
    first = lambda y: F.floor(F.greatest(y["s2"], F.col("__s")) / width).between(F.col("__b"), F.col("__b") + 1)
    long = own.filter("__more")
    parts = long.select(key, row, "__s", "__e", F.explode(F.sequence(at("__s"), at("__e"), F.lit(2).cast("long"))).alias("__b")).join(held, [key, "__b"])
    parts = parts.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list(F.filter("__w", lambda y: meets(y) & first(y))))).alias("w"))
    cols = [*spans.columns, "w"]
    return one.select(cols).unionByName(long.repartition(tasks, row).join(parts, row, "left").select(cols))


def verified_quotes(moments: DataFrame, words: DataFrame, key: str, row: str, tolerance: int = 10_000, width: int = 30_000) -> DataFrame:
    """moments (key, row, s, e, quote) with quote_match_ratio, and s and e widened to the words that match, if they do by 0.75. words: (key, seg, pos, word, s_ms, e_ms); those within tolerance of the span are looked at. No quote or no words: 0."""
    w = words.select(key, F.get(tokens("word"), F.lit(0)).alias("t"), F.col("s_ms").alias("s2"), F.col("e_ms").alias("e2"), "seg", "pos").filter("t is not null")
    x = said_near(moments, w, key, row, tolerance, width).withColumn("__said", F.transform("w", lambda y: y["t"]))
    # what plain search finds comes to Python as nulls
    x = x.withColumn("__x", exact_window("quote", F.col("__said")))
    left = lambda c: F.when(F.col("__x").isNull(), F.col(c))
    x = x.withColumn("m", F.coalesce("__x", window_match(left("quote"), left("__said"))))
    hit = (F.col("m.ratio") >= MATCH) & (F.col("m.end") > F.col("m.first"))
    s = F.when(hit, F.least("s", F.get("w", F.col("m.first"))["s2"])).otherwise(F.col("s"))
    e = F.when(hit, F.greatest("e", F.get("w", F.col("m.end") - 1)["e2"])).otherwise(F.col("e"))
    return x.withColumn("quote_match_ratio", F.col("m.ratio")).withColumns({"s": s, "e": e}).drop("w", "m", "__said", "__x")


SWAPS = {"д": "т", "т": "д", "б": "п", "п": "б", "в": "ф", "ф": "в", "г": "к", "к": "г", "ж": "ш", "ш": "ж", "з": "с", "с": "з", "е": "э", "э": "е", "и": "ы", "ы": "и", "о": "а", "а": "о", "щ": "ш", "ъ": "ь", "ь": "ъ"}
LATIN = {"d": "t", "t": "d", "b": "p", "p": "b", "v": "f", "f": "v", "g": "k", "k": "g", "z": "s", "s": "z", "o": "a", "a": "o", "i": "y", "y": "i"}


def spelling_variants(term: Column | str, most: int = 24, swaps: dict[str, str] | None = None) -> Column:
    """One letter swapped for its like, from the last to the second, with the term's capital; distinct, at most ``most``."""
    t = F.col(term) if isinstance(term, str) else term
    table = swaps or SWAPS | LATIN
    own, to = "".join(table), "".join(table.values())

    def swapped(x: Column) -> Column:
        low, other, n = x["low"], x["other"], F.length(x["low"])

        def swap(i: Column) -> Column:
            new = F.substring(other, i, F.lit(1))
            v = F.concat(F.substring(low, F.lit(1), i - 1), new, F.substring(low, i + 1, n))
            v = F.when(x["capital"], let(v, lambda y: F.concat(F.upper(F.substring(y, 1, 1)), F.substring(y, F.lit(2), n)))).otherwise(v)
            return F.when(new != F.substring(low, i, F.lit(1)), v)

        spots = F.when(n >= 2, F.sequence(n, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
        return F.slice(F.array_distinct(F.array_compact(F.transform(spots, swap))), 1, most)

    # every letter's like at once, worked out once for a term
    parts = lambda low: F.struct(low.alias("low"), F.translate(low, own, to).alias("other"), (F.substring(t, 1, 1) != F.substring(low, 1, 1)).alias("capital"))
    return let(let(F.lower(F.coalesce(t, F.lit(""))), parts), swapped)


def verified_terms(suspects: DataFrame, lookup: DataFrame, unknown: int = 1, confident: int = 5) -> DataFrame:
    """(wrong, right, occurrences, hits): for each suspect (term, occurrences) that the lookup (term, hits) knows less than ``unknown`` times, the variant it knows best, if ``confident`` times or more; the earlier variant on a tie. A null hits or a term that is missing was not found out: it is never taken for 0, and voids its suspect."""
    known = lookup.select(F.lower("term").alias("__t"), "hits")
    own = suspects.join(known, F.lower("term") == F.col("__t")).filter(F.col("hits") < unknown).select("term", "occurrences")
    v = own.select("term", "occurrences", F.posexplode(spelling_variants("term")).alias("pos", "variant"))
    asked = v.join(known, F.lower("variant") == F.col("__t"), "left")
    best = F.max_by(F.struct("variant", "hits"), F.struct("hits", -F.col("pos")))
    g = asked.groupBy("term", "occurrences").agg(F.count_if(F.col("hits").isNull()).alias("lost"), best.alias("b"))
    return g.filter((F.col("lost") == 0) & (F.col("b.hits") >= confident)).select(F.col("term").alias("wrong"), F.col("b.variant").alias("right"), "occurrences", "b.hits")


def with_term_fixes(text: str, fixes: list[tuple[str, str]]) -> tuple[str, int]:
    """Every form of a wrong term set right: the ending stays, a capital too; and how many."""
    n = 0
    for wrong, right in fixes:
        def put(m: re.Match, right: str = right) -> str:
            new = right.lower()
            return (new[:1].upper() + new[1:] if m[1][:1].isupper() else new) + m[2]

        text, k = re.subn(rf"\b({re.escape(wrong)})([^\W\d_]*)\b", put, text or "", flags=re.I)
        n += k
    return text, n


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())]))
def term_fixed(text: pd.Series, fixes: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([with_term_fixes(t, [(x["wrong"], x["right"]) for x in (f if f is not None else [])]) for t, f in zip(text, fixes, strict=True)], columns=["text", "n"])


def unique_names(names: DataFrame, key: str) -> DataFrame:
    """(key, id, name) from (key, pos, id, name): blanks in names are one space; of names that are equal but for case the first by pos stays; blank ones go."""
    n = names.withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " "))).filter("name <> ''")
    w = Window.partitionBy(key, F.lower("name")).orderBy("pos")
    return n.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(key, "id", "name")
