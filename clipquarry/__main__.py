"""python -m clipquarry: run registered queries over a folder of tables, or the stages of the analysis over transcripts.

    python -m clipquarry query NAME... --data DIR --out DIR
    python -m clipquarry analyse --transcripts DIR --out DIR [--only STAGE...] [--skip STAGE...] [--again]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog
from .operators import records as R
from .plans import analysis as N
from .plans import pipeline, stages
from .sources import files as S
from .sources import sinks as K


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(ep, seg, s_ms, e_ms, text, speaker, words) of the transcripts of a folder; an episode is a file, named by its stem."""
    raw = S.json_files(spark, folder).filter("json is not null and not path like '%diarization.json'")
    t = S.transcripts(raw.withColumn("ep", F.regexp_extract("path", r"([^/]*?)(?:\.proofread)?\.json$", 1)))
    ms = lambda c: F.round(c.try_cast("double") * 1000).cast("long")
    g = t.select("ep", F.posexplode("t.segments").alias("seg", "g"))
    words = F.transform("g.words", lambda w: F.struct(ms(w["start"]).alias("s_ms"), ms(w["end"]).alias("e_ms"), F.trim(w["word"]).alias("word")))
    x = g.select("ep", F.col("seg").cast("long").alias("seg"), ms(F.col("g.start")).alias("s_ms"), ms(F.col("g.end")).alias("e_ms"), F.trim(F.coalesce("g.text", F.lit(""))).alias("text"), F.trim(F.coalesce("g.speaker", F.lit(""))).alias("speaker"), words.alias("words"))
    return x.filter("s_ms >= 0 and e_ms > s_ms and text <> ''")


def analysed(segments: DataFrame) -> DataFrame:
    """The staged analysis with models that follow rules; a real run passes its own makers to analysis.staged."""
    words = segments.select("ep", "seg", F.posexplode(R.usable_words()).alias("pos", "w")).select("ep", "seg", F.col("pos").cast("long").alias("pos"), "w.*")
    units = R.units(segments, "ep")
    return N.staged(segments.drop("words"), words, units, stages.MODELS, N.Settings(clips_per_hour=10))


def summaries(moments: DataFrame) -> DataFrame:
    """(ep, markdown): what the episode's reels are."""
    return K.summary_markdown(moments.select("ep", "rank", "title", "clip_type", "s", "e", "score", "priority", "why", "hook", F.col("caption").alias("description"), F.col("hashtags").alias("tags")), "ep")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="clipquarry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("names", nargs="+", choices=sorted(catalog.queries()), metavar="NAME")
    q.add_argument("--data", required=True)
    q.add_argument("--out", required=True)
    a = sub.add_parser("analyse")
    a.add_argument("--transcripts", required=True)
    a.add_argument("--out", required=True)
    for name in ("--only", "--skip"):
        a.add_argument(name, nargs="*", default=None)
    a.add_argument("--again", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("clipquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "query":
        for name in args.names:
            catalog.queries()[name](spark, args.data).write.mode("overwrite").parquet(f"{args.out}/{name}")
            print(f"{name}: done")
        return 0
    graph = [pipeline.Stage("transcribe", lambda: transcripts(spark, args.transcripts)), pipeline.Stage("analyze", analysed, ("proofread|transcribe",)), pipeline.Stage("cut", summaries, ("analyze",))]
    told = pipeline.run(spark, graph, args.out, args.only, args.skip, args.again)
    for name, what in told.items():
        print(f"{name}: {what}")
    return 0 if not {"failed", "missing"} & set(told.values()) else 1


if __name__ == "__main__":
    raise SystemExit(main())
