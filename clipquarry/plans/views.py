"""The engine's tables as views over the source tables, each with the DuckDB text of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Milliseconds that a character of speech takes in the derived timelines.
MS_PER_CHAR = 70


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(ep, seg, speaker, text, s_ms, e_ms): turns laid out on a timeline by their length."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("n", F.length("text").cast("long"))
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.select(F.col("conv_id").alias("ep"), F.col("turn").alias("seg"), F.col("role").alias("speaker"), "text", ((upto - F.col("n")) * MS_PER_CHAR).alias("s_ms"), (upto * MS_PER_CHAR).alias("e_ms"))


def parts(segs: DataFrame, pieces, name: str) -> DataFrame:
    """segs with pieces (an array of strings) exploded as ``name`` with pos and s_ms, e_ms by running length. The window is on (ep, seg) of rows that are already dealt by ep, so they are sorted but not shuffled again."""
    x = segs.select("ep", "seg", "speaker", F.col("s_ms").alias("__s"), F.posexplode(pieces).alias("pos", name))
    w = Window.partitionBy("ep", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("__s") + F.sum(F.length(name).cast("long")).over(w) * MS_PER_CHAR
    return x.select("ep", "seg", F.col("pos").cast("long").alias("pos"), "speaker", name, (end - F.length(name) * MS_PER_CHAR).alias("s_ms"), end.alias("e_ms"))


def words(spark: SparkSession, d: str) -> DataFrame:
    return parts(segments(spark, d), F.expr(r"filter(split(text, '\\s+'), w -> w <> '')"), "word")


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return parts(segments(spark, d), F.expr(r"filter(split(trim(regexp_replace(text, '\\s+', ' ')), '(?<=[.!?])\\s+'), x -> x <> '')"), "text")


def moments(spark: SparkSession, d: str) -> DataFrame:
    """(ep, id, s, e, score, clip_type, title): candidate moments in seconds."""
    e = table(spark, d, "events")
    s = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    kind = F.expr("CASE event_type WHEN 'click' THEN 'story' WHEN 'purchase' THEN 'long_reel' WHEN 'signup' THEN 'highlight' ELSE 'reel' END")
    return e.select(F.col("user_id").alias("ep"), F.col("event_id").alias("id"), s.alias("s"), (s + F.greatest(F.lit(1), F.floor(F.col("value") * 600))).alias("e"), (1 + F.col("event_id") % 10).alias("score"), kind.alias("clip_type"), F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")).alias("title"), "event_type")


def golden(spark: SparkSession, d: str) -> DataFrame:
    return moments(spark, d).filter("event_type = 'signup'").select("ep", "id", "s", "e", F.expr("CASE id % 3 WHEN 0 THEN 'must' WHEN 1 THEN 'good' ELSE 'ok' END").alias("label"))


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return moments(spark, d).filter("event_type <> 'signup'")


def diarization(spark: SparkSession, d: str) -> DataFrame:
    return moments(spark, d).filter("event_type IN ('view', 'click')").select("ep", F.col("id").alias("pos"), "s", "e", F.concat(F.lit("S"), F.col("id") % 4).alias("speaker"))


def cards(spark: SparkSession, d: str) -> DataFrame:
    """Moments with prose and measured factors, out of documents: the title is the first sentence, the hook the second, the quote all that follows, why the last, and the caption the whole text."""
    x = table(spark, d, "documents")
    return x.select(F.col("doc_id").alias("id"), "lang", *[F.expr(f"{sql} AS {name}") for name, sql in CARD.items()])


CARD = {
    "title": "trim(regexp_extract(text, '^[^.!?]*', 0))",
    "quote": "CASE WHEN doc_id % 9 = 0 THEN '' ELSE trim(regexp_extract(text, '(?s)^[^.!?]*[.!?]+[^.!?]*[.!?]+(.*)$', 1)) END",
    "why": "CASE WHEN doc_id % 7 = 0 THEN '' ELSE trim(regexp_extract(text, '(?:^|[.!?])([^.!?]*)[.!?]*$', 1)) END",
    "hook": "CASE WHEN doc_id % 3 = 0 THEN '' ELSE trim(regexp_extract(text, '^[^.!?]*[.!?]+([^.!?]*[.!?]?)', 1)) END",
    "caption": "CASE WHEN doc_id % 4 = 0 THEN '' ELSE trim(text) END",
    "speaker": "CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END",
    "speaker_confidence": "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE cast(doc_id % 11 AS double) / 10 END",
    "s": "cast(doc_id * 37 % 7200 AS double)",
    "e": "cast(doc_id * 37 % 7200 + doc_id * 13 % 240 AS double)",
    "score": "cast(1 + doc_id % 10 AS double)",
    "clip_type": "CASE doc_id % 5 WHEN 0 THEN 'Story' WHEN 1 THEN 'highlight' WHEN 2 THEN 'long_reel' WHEN 3 THEN 'hot take' ELSE 'reel' END",
    "quote_match_ratio": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE cast(doc_id % 13 AS double) / 10 END",
    "audio_energy_db": "CASE WHEN doc_id % 3 = 1 THEN NULL ELSE -cast(doc_id % 47 AS double) END",
    "audio_silence_ratio": "CASE WHEN doc_id % 4 = 1 THEN NULL ELSE cast(doc_id % 12 AS double) / 10 END",
    "speech_rate_wps": "CASE WHEN doc_id % 8 = 0 THEN NULL ELSE cast(doc_id % 60 AS double) / 10 END",
}

#: DuckDB text of the views, to stand after WITH.
SQL = {
    "segments": f"segments AS (SELECT conv_id AS ep, turn AS seg, role AS speaker, text, CAST({MS_PER_CHAR} * (sum(length(text)) OVER w - length(text)) AS BIGINT) AS s_ms, CAST({MS_PER_CHAR} * sum(length(text)) OVER w AS BIGINT) AS e_ms FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))",
    "words": rf"""words0 AS (SELECT *, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM segments),
words1 AS (SELECT ep, seg, speaker, s_ms AS z, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM words0),
words AS (SELECT ep, seg, pos, speaker, word, CAST(z + {MS_PER_CHAR} * (sum(length(word)) OVER w - length(word)) AS BIGINT) AS s_ms, CAST(z + {MS_PER_CHAR} * sum(length(word)) OVER w AS BIGINT) AS e_ms FROM words1 WINDOW w AS (PARTITION BY ep, seg ORDER BY pos))""",
    "sentences": rf"""sent0 AS (SELECT *, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ws FROM segments),
sent1 AS (SELECT ep, seg, speaker, s_ms AS z, unnest(range(0, len(ws))) AS pos, unnest(ws) AS text FROM sent0),
sentences AS (SELECT ep, seg, pos, speaker, text, CAST(z + {MS_PER_CHAR} * (sum(length(text)) OVER w - length(text)) AS BIGINT) AS s_ms, CAST(z + {MS_PER_CHAR} * sum(length(text)) OVER w AS BIGINT) AS e_ms FROM sent1 WINDOW w AS (PARTITION BY ep, seg ORDER BY pos))""",
    "moments": "moments0 AS (SELECT *, date_diff('second', TIMESTAMP '2024-01-01', ts) AS s FROM events), moments AS (SELECT user_id AS ep, event_id AS id, s, s + greatest(1, CAST(floor(value * 600) AS BIGINT)) AS e, 1 + event_id % 10 AS score, CASE event_type WHEN 'click' THEN 'story' WHEN 'purchase' THEN 'long_reel' WHEN 'signup' THEN 'highlight' ELSE 'reel' END AS clip_type, event_type || ' ' || (props::JSON->>'$.k') AS title, event_type FROM moments0)",
    "golden": "golden AS (SELECT ep, id, s, e, CASE id % 3 WHEN 0 THEN 'must' WHEN 1 THEN 'good' ELSE 'ok' END AS label FROM moments WHERE event_type = 'signup')",
    "predicted": "predicted AS (SELECT * FROM moments WHERE event_type <> 'signup')",
    "diarization": "diarization AS (SELECT ep, id AS pos, s, e, 'S' || (id % 4) AS speaker FROM moments WHERE event_type IN ('view', 'click'))",
    "cards": "cards AS (SELECT doc_id AS id, lang, " + ", ".join(f"{sql} AS {name}" for name, sql in CARD.items()) + " FROM documents)",
}
NEEDS = {"words": ["segments"], "sentences": ["segments"], "golden": ["moments"], "predicted": ["moments"], "diarization": ["moments"]}


def using(*names: str, recursive: bool = False) -> str:
    """WITH and the text of these views and those they need."""
    seen: list[str] = []
    for n in names:
        seen += [x for x in [*NEEDS.get(n, []), n] if x not in seen]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in seen) + "\n"
