"""Scans: media and transcript folders, transcripts, diarizations, golden and candidate files. All are Spark readers; a file is a row, so listing and parsing are distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.semistructured import coerced, fields, payload_items

VIDEO, AUDIO = ("mp4", "mkv", "mov", "avi"), ("mp3", "wav", "m4a", "flac", "ogg")
WORD = "struct<start:string,end:string,word:string,probability:string>"
SEGMENT = f"struct<start:string,end:string,text:string,speaker:string,confidence:string,words:array<{WORD}>>"
TRANSCRIPT = f"audio string, source_audio string, language string, duration string, segments array<{SEGMENT}>, sentences array<struct<start:string,end:string,text:string,speaker:string>>"


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, stem, ext, modified, size) of the files below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return f.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def newest(files: DataFrame, exts: tuple[str, ...]) -> DataFrame:
    return files.filter(F.col("ext").isin(*exts)).orderBy(F.desc("modified"), "name").limit(1)


def queue(files: DataFrame) -> DataFrame:
    """(stem, path, companions): the newest video of each stem, the first name on a tie, with the audio files beside it."""
    v = files.filter(F.col("ext").isin(*VIDEO)).groupBy("stem").agg(F.min_by("path", F.struct(-F.unix_micros("modified"), "name")).alias("path"))
    a = files.filter(F.col("ext").isin("mp3", "wav")).groupBy("stem").agg(F.array_sort(F.collect_list("path")).alias("companions"))
    return v.join(a, "stem", "left").withColumn("companions", F.coalesce("companions", F.array().cast("array<string>")))


def audio_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("ext").isin(*AUDIO)).orderBy(F.lower("name"))


def transcript_of(files: DataFrame, stem: str) -> DataFrame:
    """The transcript to use: <stem>.proofread.json, <stem>.json, audio.proofread.json, audio.json, any proofread, any other; never a diarization."""
    return files.filter("ext = 'json' AND name <> 'diarization.json'").withColumn("rank", transcript_rank(F.lit(stem))).orderBy("rank", "name").limit(1)


def transcript_rank(stem: Column, name: Column | None = None) -> Column:
    """Which of the transcripts of a folder to prefer, 0 first."""
    name = F.col("name") if name is None else name
    named = [F.concat(stem, F.lit(".proofread.json")), F.concat(stem, F.lit(".json")), F.lit("audio.proofread.json"), F.lit("audio.json")]
    rank = F.when(name == named[0], 0)
    for k, n in enumerate(named[1:], 1):
        rank = rank.when(name == n, k)
    return rank.when(name.endswith(".proofread.json"), 4).otherwise(5)


def transcripts_of(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, stem, name): of every folder (folder, stem) the transcript to use, one aggregate over its files (folder, name)."""
    x = folders.join(files.filter("name LIKE '%.json' AND name <> 'diarization.json'"), "folder")
    return x.groupBy("folder", "stem").agg(F.min_by("name", F.struct(transcript_rank(F.col("stem")), "name")).alias("name"))


def model_folders(files: DataFrame, root: str) -> DataFrame:
    """(folder): the folders right below root that hold files, in order of name."""
    rest = F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.substring("path", len(root.rstrip("/")) + 2, 1_000_000))
    return files.select(F.split(rest, "/").alias("p")).filter("size(p) > 1").select(F.get("p", F.lit(0)).alias("folder")).distinct().orderBy("folder")


def source_audio(transcripts: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, path): the first of source_audio and audio of a transcript that is there, null if neither is."""
    asked = transcripts.select(key, F.posexplode(F.array("source_audio", "audio")).alias("pos", "path"))
    there = asked.join(files.select("path").distinct(), "path", "left_semi")
    return transcripts.select(key).distinct().join(there.groupBy(key).agg(F.min_by("path", "pos").alias("path")), key, "left")


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(name, free): each wanted name, with _1, _2 ... before its ending if it is taken: the first that is not. Taken numbers of a name are aggregated, so there is no loop."""
    stem, ext = F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    used = taken.select("name").distinct()
    numbered = used.select(F.regexp_extract("name", r"^(.*)_([1-9][0-9]{0,8})(\.[^.]*)?$", 1).alias("stem"), F.regexp_extract("name", r"^(.*)_([1-9][0-9]{0,8})(\.[^.]*)?$", 2).try_cast("long").alias("n"), F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("ext")).filter("n is not null")
    w = Window.partitionBy("stem", "ext").orderBy("n")
    # the first number that is not its own place in the order is after a gap
    gap = numbered.withColumn("k", F.row_number().over(w)).groupBy("stem", "ext").agg(F.count_if(F.col("n") == F.col("k")).alias("run"))
    x = wanted.select("name").distinct().withColumns({"stem": stem, "ext": ext}).join(used.select("name", F.lit(True).alias("there")), "name", "left").join(gap, ["stem", "ext"], "left")
    return x.select("name", F.when(F.col("there"), F.concat("stem", F.lit("_"), (F.coalesce("run", F.lit(0)) + 1).cast("string"), "ext")).otherwise(F.col("name")).alias("free"))


def golden_path(stem: Column | str) -> Column:
    return F.concat(F.lit("golden/"), F.regexp_replace(stem, r"\.proofread$", ""), F.lit(".json"))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): whole files; json is null where a file is no JSON."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.select("path", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("json"))


def transcripts(raw: DataFrame, json: str = "json") -> DataFrame:
    """raw with t, the transcript; numbers stay texts until they are cast, so that a bad one spoils nothing else."""
    return raw.withColumn("t", F.from_json(json, TRANSCRIPT))


def _number(x: Column) -> Column:
    return F.when(~F.isnan(v := x.try_cast("double")), v)


def words(t: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """(key, start, end, word) of transcripts; no blank words, no start below 0, no end before the start (strict: after it)."""
    s = t.select(key, F.explode("t.segments").alias("g")).select(key, F.explode("g.words").alias("w"))
    out = s.select(key, _number(F.col("w.start")).alias("start"), _number(F.col("w.end")).alias("end"), F.trim("w.word").alias("word"))
    return out.filter("start >= 0 AND word <> ''").filter("end > start" if strict else "end >= start")


def sentences(t: DataFrame, key: str) -> DataFrame:
    """(key, start, end, text): sentences of a transcript, or its segments where it has no valid sentence."""
    valid = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<start:string,end:string,text:string>>")), lambda x: F.struct(_number(x["start"]).alias("start"), _number(x["end"]).alias("end"), F.trim(x["text"]).alias("text"))), lambda x: (x["start"] >= 0) & (x["end"] > x["start"]) & (x["text"] != ""))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    a, b = valid(plain(F.col("t.sentences"))), valid(plain(F.col("t.segments")))
    return t.select(key, F.explode(F.when(F.size(a) > 0, a).otherwise(b)).alias("x")).select(key, "x.*")


def whole_word_timings(t: DataFrame, key: str) -> DataFrame:
    """(key, seg, words): word timings of a segment, none at all if one of them is bad."""
    s = t.select(key, F.posexplode("t.segments").alias("seg", "g"))
    w = F.transform(F.coalesce("g.words", F.array().cast(f"array<{WORD}>")), lambda x: F.struct(_number(x["start"]).alias("start"), _number(x["end"]).alias("end"), F.trim(x["word"]).alias("word")))
    good = F.forall(w, lambda x: F.coalesce((x["start"] >= 0) & (x["end"] >= x["start"]) & (x["word"] != ""), F.lit(False)))
    return s.select(key, "seg", F.when(good, w).otherwise(F.array().cast("array<struct<start:double,end:double,word:string>>")).alias("words"))


def diarization(raw: DataFrame, key: str, json: str = "json", strict: bool = True) -> DataFrame:
    """(key, pos, start, end, speaker) of a list of spans; strict drops those without numbers, without speaker or length."""
    x = raw.select(key, F.posexplode(F.from_json(json, "array<struct<start:string,end:string,speaker:string>>")).alias("pos", "d"))
    x = x.select(key, "pos", _number(F.col("d.start")).alias("start"), _number(F.col("d.end")).alias("end"), F.trim("d.speaker").alias("speaker"))
    return x.filter("end > start AND speaker <> ''") if strict else x


def candidates(raw: DataFrame, key: str, json: str = "json") -> DataFrame:
    """(key, pos, m): valid moments of a reply or file in any of its shapes."""
    x = raw.select(key, F.posexplode(payload_items(json)).alias("pos", "j"))
    return x.select(key, "pos", coerced("j").alias("m")).filter("m IS NOT NULL")


def lookup_cache(raw: DataFrame, json: str = "json") -> DataFrame:
    """(term, hits) of a JSON object of counts; values that are no whole number go."""
    return raw.select(F.explode(fields(json)).alias("term", "v")).select("term", F.col("v").try_cast("long").alias("hits")).filter("hits IS NOT NULL")


def latest_stem(files: DataFrame, key: str = "stem") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("modified"), "name")
    return files.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
