"""Documents out of rows: subtitles, markdown, JSON, reports. Each is one text per key, ready for the text writer; Spark's committer makes the write atomic."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ass_time, clean, hms, srt_time, without_hashtags

_STYLE = [("Name", "Default"), ("Fontname", "Arial"), ("Fontsize", 64), ("PrimaryColour", "&H00FFFFFF"), ("SecondaryColour", "&H0000FFFF"), ("OutlineColour", "&H00000000"), ("BackColour", "&H64000000"), ("Bold", -1), ("Italic", 0), ("Alignment", 2), ("MarginL", 60), ("MarginR", 60), ("MarginV", 240)]
_EVENT = "Layer Start End Style Name MarginL MarginR MarginV Effect Text"


def _section(name: str, **lines: object) -> str:
    return f"[{name}]\n" + "".join(f"{k}: {v}\n" for k, v in lines.items())


ASS_HEADER = "\n".join(
    [
        _section("Script Info", ScriptType="v4.00+", **{f"PlayRes{axis}": n for axis, n in (("X", 1080), ("Y", 1920))}),
        _section("V4+ Styles", Format=", ".join(k for k, _ in _STYLE), Style=",".join(str(v) for _, v in _STYLE)),
        _section("Events", Format=", ".join(_EVENT.split())),
    ]
)


def joined(order: list[str], text: Column, by: str) -> Column:
    """An aggregate: texts of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("__t")))), lambda x: x["__t"]), by)


def srt(cues: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, srt): cues (s_ms, e_ms, text) numbered from 1."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    line = F.concat(F.col("__n").cast("string"), F.lit("\n"), srt_time("s_ms"), F.lit(" --> "), srt_time("e_ms"), F.lit("\n"), F.col("text"), F.lit("\n"))
    return cues.withColumn("__n", n).groupBy(key).agg(joined(["__n"], line, "\n").alias("srt"))


def karaoke_tag(w: Column) -> Column:
    return F.concat(F.lit("{\\kf"), F.floor((w["e_ms"] - w["s_ms"]) / 10).cast("string"), F.lit("}"), w["word"])


def dialogue(s: Column, e: Column, tags: Column, fade: Column | None = None, margin: int = 0) -> Column:
    return F.concat(F.lit("Dialogue: 0,"), ass_time(s), F.lit(","), ass_time(e), F.lit(f",Default,,0,0,{margin},,"), fade if fade is not None else F.lit(""), tags)


def ass(cues: DataFrame, key: str, order: list[str], fade: Column | None = None, margin: int = 0) -> DataFrame:
    """(key, ass): header, then a dialogue line for each cue (s_ms, e_ms, words: array of s_ms, e_ms, word) with karaoke tags in whole centiseconds."""
    tags = F.array_join(F.transform("words", karaoke_tag), " ")
    line = dialogue(F.col("s_ms"), F.col("e_ms"), tags, fade, margin)
    return cues.groupBy(key).agg(F.concat(F.lit(ASS_HEADER), joined(order, line, "\n"), F.lit("\n")).alias("ass"))


def reel_markdown(title: Column, label: Column, description: Column, tags: Column) -> Column:
    """Title, description and hashtags of a reel; without a title its label, # before a title go."""
    t = F.coalesce(F.nullif(clean(title), F.lit("")), F.nullif(clean(label), F.lit("")), F.lit("Reel"))
    t = F.when(t.startswith("#"), F.coalesce(F.nullif(F.trim(F.regexp_replace(t, "^#+", "")), F.lit("")), F.lit("Reel"))).otherwise(t)
    return F.concat(F.regexp_replace(F.concat(F.lit("# "), t, F.lit("\n\n"), description, F.lit("\n\n"), F.array_join(tags, " ")), r"\s+$", ""), F.lit("\n"))


def social_text(reasons: Column, hook: Column, description: Column, tags: Column) -> Column:
    """What to paste: why it was rejected, if it was; the hook, if it says something else; description and tags."""
    head = F.when(F.size(reasons) > 0, F.concat(F.lit("[ОТКЛОНЁН: "), F.array_join(reasons, ", "), F.lit("]")))
    h = without_hashtags(hook)
    body = F.concat_ws("\n\n", head, F.when((h != "") & (h != description), h), description, F.array_join(tags, " "))
    return F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n"))


def summary_markdown(reels: DataFrame, key: str) -> DataFrame:
    """(key, markdown): a section for each reel (rank, title, clip_type, s, e in milliseconds, score, priority, why, hook, description, tags)."""
    line = lambda name, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{name}: "), F.trim(c)))
    score = F.concat(F.format_string("Score: %.1f/10", F.col("score").cast("double")), F.when(F.col("priority").isNotNull(), F.format_string(" (priority %.2f)", F.col("priority").cast("double"))).otherwise(""))
    head = F.concat_ws("\n", F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), F.trim("title"), F.lit(" ["), "clip_type", F.lit("]")), F.concat(F.lit("Time: "), hms("s"), F.lit("-"), hms("e")), score, line("Why", F.col("why")), line("Hook", F.col("hook")))
    part = F.concat_ws("\n\n", head, F.nullif("description", F.lit("")), F.nullif(F.array_join("tags", " "), F.lit("")))
    return reels.groupBy(key).agg(F.concat(F.lit("# Reels Suggestions\n\n"), joined(["rank"], part, "\n\n"), F.lit("\n")).alias("markdown"))


def article_markdown(sections: DataFrame, key: str) -> DataFrame:
    """(key, markdown) of (pos, title, paragraphs); an empty title has no heading."""
    part = F.concat_ws("\n\n", F.when(F.trim("title") != "", F.concat(F.lit("## "), F.trim("title"))), F.array_join("paragraphs", "\n\n"))
    return sections.groupBy(key).agg(F.concat(joined(["pos"], part, "\n\n"), F.lit("\n")).alias("markdown"))


def json_lists(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """(key, json): the rows as a JSON list, nulls left out."""
    item = F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})
    return rows.groupBy(key).agg(F.concat(F.lit("["), joined(order, item, ","), F.lit("]")).alias("json"))


def cache_json(cache: DataFrame) -> DataFrame:
    """(json): (term, hits) as one object, keys sorted."""
    return cache.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", "hits"))))).alias("json"))


def reels_to_moments(files: DataFrame, moments: DataFrame, index: Column) -> DataFrame:
    """Reel files joined with moments (rank) by the number in their name; the moments are the small side, and AQE broadcasts them if they are."""
    return files.withColumn("rank", index).filter("rank IS NOT NULL").join(moments, "rank")


def drawtext(blocks: DataFrame, text: Column) -> DataFrame:
    """blocks (s_ms, e_ms) with filter, a drawtext expression; text is escaped already."""
    sec = lambda c: F.format_string("%d.%03d", F.floor(F.col(c) / 1000).cast("long"), (F.col(c) % 1000).cast("long"))
    return blocks.withColumn("filter", F.concat(F.lit("drawtext=text='"), text, F.lit("':enable='between(t,"), sec("s_ms"), F.lit(","), sec("e_ms"), F.lit(")'")))


def write_texts(df: DataFrame, path: str, text: str, key: str) -> None:
    """One folder for each key, written by Spark's committer: readers see all of it or nothing."""
    df.select(F.col(key).cast("string").alias(key), F.col(text).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def reel_assets(cues: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, srt, ass): the cues of a clip merged, split and timed, as both kinds of subtitles; a clip without cues has none. A clip's cues are one row from the first to the last step, so they are dealt once."""
    from ..operators import folds as O
    from ..operators import records as R

    listed = cues.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, "s_ms", "e_ms", "text"))).alias("cues"))
    ready = O.per_row(listed, "cues", O.subtitles, "s_ms long, e_ms long, text string")
    ready = ready.filter("size(cues) > 0").withColumn("cues", F.array_sort("cues"))
    number = F.transform("cues", lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(c["s_ms"]), F.lit(" --> "), srt_time(c["e_ms"]), F.lit("\n"), c["text"], F.lit("\n")))
    tags = lambda c: F.array_join(F.transform(R.words_by_letters(c["text"], c["s_ms"], c["e_ms"]), karaoke_tag), " ")
    lines = F.transform("cues", lambda c: dialogue(c["s_ms"], c["e_ms"], tags(c)))
    return ready.select(key, F.array_join(number, "\n").alias("srt"), F.concat(F.lit(ASS_HEADER), F.array_join(lines, "\n"), F.lit("\n")).alias("ass"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, as UTF-8: written beside its place and moved there, so that a reader sees the old file or the new one. For many, write a table."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex[:8]}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, target):
        fs.delete(target, False)  # where a file system does not replace
        fs.rename(part, target)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def write_if_absent(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").json(path)
