"""Smaller operators on segments, chunks, moments and model results. Times are whole milliseconds unless a name says seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import folds as O
from . import intervals as I

WORDS = "array<struct<s_ms:bigint,e_ms:bigint,word:string>>"
PREFIX = r"(?m)^\[[0-9]+-[0-9]+\] (?:\([^)]*\) )?"


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


# -- timings of segments


def usable_words() -> Column:
    """A segment's words, none at all if one of them is blank or ends before it begins."""
    w = F.coalesce("words", F.array().cast(WORDS))
    return F.when(F.forall(w, lambda x: F.coalesce((F.trim(x["word"]) != "") & (x["s_ms"] >= 0) & (x["e_ms"] >= x["s_ms"]), F.lit(False))), w).otherwise(F.array().cast(WORDS))


def units(segments: DataFrame, key: str) -> DataFrame:
    """(key, seg, pos, s_ms, e_ms, text, speaker): the sentences of segments (key, seg, s_ms, e_ms, text, speaker, words).

    A segment of one sentence is a unit. Else the sentences take the times of the words if these are as many as theirs, in order; otherwise the segment's length goes by characters, at least 10 ms each. Segments without text or length have no unit."""
    x = segments.withColumns({"t": T.clean("text"), "speaker": F.trim(F.coalesce("speaker", F.lit("")))}).filter("t <> '' and e_ms > s_ms")
    x = x.withColumns({"parts": T.sentences("text"), "w": usable_words()})
    counts = F.transform("parts", lambda p: F.size(F.split(F.trim(p), r"\s+")))
    upto = F.aggregate(counts, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    x = x.withColumn("upto", upto)
    span = lambda i: F.struct(F.get("w", F.get("upto", i))["s_ms"].alias("s"), F.get("w", F.get("upto", i + 1) - 1)["e_ms"].alias("e"))
    timed = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), span)
    fits = (F.size("w") == F.element_at("upto", -1)) & F.forall(timed, lambda t: t["e"] > t["s"])
    total = F.greatest(F.lit(1), F.length(F.array_join("parts", "")))
    length = F.greatest(F.lit(10), F.col("e_ms") - F.col("s_ms"))

    chars = F.aggregate("parts", F.array(F.lit(0)), lambda a, p: F.array_append(a, F.element_at(a, -1) + F.length(p)))
    x = x.withColumn("chars", chars)

    def shared(acc: Column, i: Column) -> Column:
        last = F.element_at(acc, -1)["e"]
        end = F.when(i == F.size("parts") - 1, F.col("e_ms").cast("double")).otherwise(F.col("s_ms") + length * F.get("chars", i + 1) / total)
        return F.array_append(acc, F.struct(last.alias("s"), F.greatest(last + 10, end).alias("e")))

    zero = F.array(F.struct(F.lit(0.0).alias("s"), F.col("s_ms").cast("double").alias("e")))
    by_chars = F.transform(F.slice(F.aggregate(F.sequence(F.lit(0), F.size("parts") - 1), zero, shared), 2, 1_000_000_000), lambda t: F.struct(rounded(t["s"]).alias("s"), rounded(t["e"]).alias("e")))
    whole = F.array(F.struct(F.col("s_ms").alias("s"), F.col("e_ms").alias("e")))
    times = F.when(F.size("parts") == 1, whole).when(fits, timed).otherwise(by_chars)
    out = x.select(key, "seg", "speaker", F.posexplode(F.arrays_zip("parts", times.alias("times"))).alias("pos", "u"))
    return out.select(key, "seg", F.col("pos").cast("long").alias("pos"), F.col("u.times.s").alias("s_ms"), F.col("u.times.e").alias("e_ms"), F.col("u.parts").alias("text"), "speaker")


def subtitle_words(segments: DataFrame, key: str) -> DataFrame:
    """(key, seg, pos, s_ms, e_ms, word): words for karaoke. A segment's own times if its words are those of its text, each word until the next begins, 10 ms at least; else its length by the letters of the words."""
    own = F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda x: x != "")
    x = segments.select(key, "seg", "s_ms", F.greatest("e_ms", F.col("s_ms") + 10).alias("e_ms"), own.alias("t"), F.coalesce("words", F.array().cast(WORDS)).alias("w")).filter("size(t) > 0")
    same = (F.size("t") == F.size("w")) & F.forall(F.zip_with("t", "w", lambda a, b: T.bare_word(a) == T.bare_word(b["word"])), lambda ok: F.coalesce(ok, F.lit(False)))
    x = x.withColumn("real", same)
    x = x.withColumn("upto", letters_upto(F.col("t")))
    after = lambda i: F.coalesce(F.get("w", i + 1)["s_ms"], F.get("w", i)["e_ms"])
    share = lambda i: shared(F.col("s_ms"), F.col("e_ms"), F.col("upto"), i)

    def timed(p: Column, i: Column) -> Column:
        s = F.when(F.col("real"), F.get("w", i)["s_ms"].cast("double")).otherwise(share(i))
        e = F.when(F.col("real"), after(i).cast("double")).otherwise(share(i + 1))
        return F.struct(rounded(s).alias("s_ms"), rounded(F.greatest(s + 10, e)).alias("e_ms"), p.alias("word"))

    out = x.select(key, "seg", F.posexplode(F.transform("t", timed)).alias("pos", "x"))
    return out.select(key, "seg", F.col("pos").cast("long").alias("pos"), "x.*")


def letters_upto(t: Column) -> Column:
    """Of an array of words, the letters before each, and all of them at the end."""
    return F.aggregate(F.transform(t, lambda p: F.length(p)), F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))


def shared(s: Column, e: Column, upto: Column, i: Column) -> Column:
    """The time at which word i of a span begins if the span goes by letters."""
    return s + (e - s) * F.get(upto, i) / F.element_at(upto, -1)


def words_by_letters(text: Column, s: Column, e: Column) -> Column:
    """An array of struct(s_ms, e_ms, word): the words of a text whose own times are not known, as subtitle_words has them."""
    own = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")
    end = F.greatest(e, s + 10)

    def timed(p: Column, i: Column, upto: Column) -> Column:
        a, b = shared(s, end, upto, i), shared(s, end, upto, i + 1)
        return F.struct(rounded(a).alias("s_ms"), rounded(F.greatest(a + 10, b)).alias("e_ms"), p.alias("word"))

    return T.let(own, lambda t: T.let(letters_upto(t), lambda upto: F.transform(t, lambda p, i: timed(p, i, upto))))


def sample_times(s: Column, e: Column, n: int) -> Column:
    """n times evenly spread over the inner 70 % of a span, its middle for one; none without a length."""
    length = (e - s).cast("double")
    if n <= 0:
        return F.array().cast("array<double>")
    spread = F.array(s + length / 2) if n == 1 else F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: s + length * 0.15 + length * 0.7 / (n - 1) * i)
    return F.when(length > 0, spread).otherwise(F.array().cast("array<double>"))


def clip_words(clips: DataFrame, words: DataFrame, key: str, padding: int = 0, least: int = 10) -> DataFrame:
    """(clip, word, s_ms, e_ms): words that a clip (key, clip, s, e), widened by the padding, shares time with, counted from its start; what is left of a word under ``least`` goes."""
    own = clips.select(key, "clip", F.greatest(F.lit(0), F.col("s") - padding).alias("s"), (F.col("e") + padding).alias("e"))
    w = words.select(key, "seg", "pos", "word", F.col("s_ms").alias("s2"), F.col("e_ms").alias("e2"))
    x = I.overlap_join(own, w, key, 60_000).filter(I.overlap() >= least)
    return x.select("clip", "seg", "pos", "word", (F.greatest("s2", "s") - F.col("s")).alias("s_ms"), (F.least("e2", "e") - F.col("s")).alias("e_ms"))


def segment_lines(raw: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, line): "[start-end] text" in whole seconds of segments whose start and end, texts of seconds, are numbers and whose text is not blank."""
    n = lambda c: F.coalesce(F.col(c), F.lit("0")).try_cast("double").try_cast("long")
    x = raw.select(key, order, n("start").alias("a"), n("end").alias("b"), F.trim(F.coalesce("text", F.lit(""))).alias("t")).filter("a is not null and b is not null and t <> ''")
    return x.select(key, order, F.concat(F.lit("["), F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string"), F.lit("] "), F.col("t")).alias("line"))


def compact_text(lines: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """(key, text): the lines (key, order, line) of a key, cut at ``most`` characters, back to a line end if that keeps over 80 %."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy(key).agg(joined.alias("t")).select(key, T.first_lines(F.col("t"), most).alias("text"))


def plain_text(chunks: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """(key, chunk_id, text): the plain speech of chunks (key, chunk_id, segments, text): the texts of their segments (key, seg, text), or, where they name none that is there, their own text without its marks."""
    asked = chunks.select(key, "chunk_id", F.explode("segments").alias("seg")).join(segments.select(key, "seg", F.trim("text").alias("t")), [key, "seg"]).filter("t <> ''")
    said = asked.groupBy(key, "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "t"))), lambda x: x["t"]), " ").alias("__s"))
    own = F.trim(F.array_join(F.transform(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), PREFIX, ""), "\n"), lambda x: F.trim(x)), " "))
    return chunks.select(key, "chunk_id", "text").join(said, [key, "chunk_id"], "left").select(key, "chunk_id", F.coalesce("__s", own).alias("text"))


def rendered_turns(turns: DataFrame, key: str, names: Column | None = None) -> DataFrame:
    """(key, text): turns (key, turn, speaker, text) as lines "Name: text"; a speaker without a name keeps its id. names: a map column."""
    who = F.coalesce(F.element_at(names, F.col("speaker")), "speaker") if names is not None else F.col("speaker")
    line = turns.select(key, "turn", F.concat(who, F.lit(": "), "text").alias("line"))
    return line.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))


def both_ends(x: Column, most: int) -> Column:
    """A long text's first 60 % and last 40 % of ``most`` characters."""
    head = int(most * 0.6)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, head), F.lit("\n\n[...]\n\n"), F.right(x, F.lit(most - head))))


# -- selection


def accepted(rows: list[O.Row], starts: list[int], ends: list[int], most: int = 5, shortest: int = 30, longest: int = 90, reach: int = 10) -> list[O.Row]:
    """Moments in whole seconds, taken in their order: times moved to the nearest that are allowed, an end that makes the length fit; what is still not allowed, seen already or in the way of one taken goes; ``most`` are enough."""
    ends = sorted(set(ends))
    ok_s, ok_e = set(starts), set(ends)
    near = lambda v, to: min(((abs(a - v), a) for a in to if abs(a - v) <= reach), default=(0, v))[1]
    out: list[O.Row] = []
    for r in rows:
        if r["s"] is None or r["e"] is None or len(out) >= most:
            continue
        s, e = near(r["s"], ok_s), near(r["e"], ok_e)
        if not shortest <= e - s <= longest:
            e = next((x for x in ends if s + shortest <= x <= s + longest), e)
        if s in ok_s and e in ok_e and shortest <= e - s <= longest and all(e <= o["s"] or o["e"] <= s for o in out):
            out.append({**r, "s": s, "e": e})
    return out


def exclusions(ranges: Column) -> Column:
    """What a prompt says of ranges (an array of s, e) taken already; '' without any."""
    shown = F.array_join(F.transform(ranges, lambda r: F.concat(F.lit("["), r["s"].cast("string"), F.lit("-"), r["e"].cast("string"), F.lit("]"))), ", ")
    return F.when(F.coalesce(F.size(ranges), F.lit(0)) > 0, F.concat(F.lit("\nTAKEN ALREADY (don't repeat or overlap): "), shown)).otherwise("")


# -- models compared


def model_results(runs: DataFrame) -> DataFrame:
    """(model, seconds, moments, avg_score, valid): from (model, seconds, score) with a row for each moment, its score on any scale, and one with a null score for a model without moments."""
    from .aggregates import scaled_score

    g = runs.groupBy("model").agg(F.max("seconds").alias("seconds"), F.count("score").alias("moments"), F.avg(scaled_score(F.col("score"))).alias("a"))
    return g.select("model", "seconds", "moments", F.coalesce("a", F.lit(0.0)).alias("avg_score"), (F.col("moments") >= 3).alias("valid"))


def winners(results: DataFrame) -> DataFrame:
    """One row: winner has most moments, then the best mean, then the least time; of the valid models best weighs the three, fastest and highest are what they say. Ties go to the model first by name."""
    weighed = F.col("moments") * 2 + F.col("avg_score") * 1.5 + 50 / F.greatest("seconds", F.lit(1))
    down = F.struct(-F.col("moments"), -F.col("avg_score"), "seconds")
    return results.agg(
        F.min_by("model", F.struct(down, "model")).alias("winner"),
        F.min_by("model", F.when(F.col("valid"), F.struct(-weighed, "model"))).alias("best"),
        F.min_by("model", F.when(F.col("valid"), F.struct("seconds", "model"))).alias("fastest"),
        F.min_by("model", F.when(F.col("valid"), F.struct(-F.col("avg_score"), "model"))).alias("highest"),
    )


def comparison_markdown(results: DataFrame) -> DataFrame:
    """(markdown): the models as a table, by name, and the winner."""
    row = F.format_string("| %s | %.0fs | %d | %.1f |", "model", "seconds", "moments", "avg_score")
    table = results.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("model", row.alias("r")))), lambda x: x["r"]), "\n").alias("t"))
    head = "# Model comparison\n\n| Model | Time | Moments | Avg score |\n|---|---|---|---|\n"
    return table.crossJoin(F.broadcast(winners(results))).select(F.concat(F.lit(head), "t", F.lit("\n\n## Winner: "), "winner", F.lit("\n")).alias("markdown"))  # a row each
