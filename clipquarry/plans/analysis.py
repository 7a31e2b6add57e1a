"""The staged analysis of all episodes at once: context, scout, cleanup, top-up, quotes, judge, snapping, ranking, metadata.

Every stage is a plan from DataFrame to DataFrame. Moments are rows of MOMENT; times are whole milliseconds, and ids are
unique. What a model sees is one prompt a chunk or a batch, so calls run in parallel over the cluster; a failed call costs its
chunk or batch only, and an episode of which every chunk failed is an error."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions.semistructured import LISTS, NUMBERS, TEXTS, moment_json, payload_items, stamped
from ..operators import aggregates as A
from ..operators import folds as O
from ..operators import intervals as I
from ..operators import matching as M
from ..operators import providers as P
from ..operators.store import stored

Make = Callable[[], P.Provider]
MINUTE = 60_000
#: The columns of a moment beside its episode, in order.
MOMENT = "id long, s long, e long, score double, " + ", ".join([*(f"{c} string" for c in TEXTS), *(f"{c} double" for c in NUMBERS), *(f"{c} array<string>" for c in LISTS)])
COLUMNS = [c.split()[0] for c in MOMENT.split(", ")]
PROMPTS = {
    "context": "CONTEXT\n{transcript_digest}",
    "scout": "SCOUT\n{requirements}\n{episode_context}\n{chunk_json}\n{transcript}",
    "cleanup_refine": "CLEANUP\n{requirements}\nCANDIDATES\n{candidates_json}",
    "judge_metadata": "JUDGE\n{requirements}\n{episode_context}\nCANDIDATES\n{candidates_json}",
}


@dataclass
class Settings:
    """What may be set of an analysis; lengths are milliseconds."""

    quotas: dict[str, int] = field(default_factory=lambda: {"reel": 4})
    clips_per_hour: int = 0
    chunk: int = 900_000
    chunk_chars: int = 12_000
    chunk_tolerance: int = 3000
    cleanup_batch: int = 16
    judge_batch: int = 14
    head: int = 15_000
    tail: int = 5000
    excerpt_chars: int = 260
    snap: int = 3000
    require_overlap: bool = True
    context: bool = True
    digest_chars: int = 4000
    similar: float = 0.5
    weights: dict[str, object] | None = None
    prompts: dict[str, str] = field(default_factory=lambda: dict(PROMPTS))


def value(m: DataFrame | None = None) -> Column:
    """What moments are ordered by: the priority where it is known, else the model's score."""
    return F.coalesce("priority", "score")


def numbered(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """id from 1 on within each episode, in order; unique within an episode only, so joins are by ep and id."""
    return rows.withColumn("id", F.row_number().over(Window.partitionBy("ep").orderBy(*order)).cast("long"))


def exploded(replies: DataFrame, stage: str, *keep: str) -> DataFrame:
    """Moments out of replies: keep, pos and the fields of each."""
    x = replies.select("ep", *keep, F.posexplode(stamped("reply", stage)).alias("pos", "m"))
    ms = lambda c: F.round(F.col(f"m.{c}") * 1000).cast("long")
    return x.select("ep", *keep, "pos", ms("start").alias("s"), ms("end").alias("e"), *[F.col(f"m.{c}").alias(c) for c in ("score", *TEXTS, *NUMBERS, *LISTS)])


def requirements(quotas: Column) -> Column:
    """The clips that are wanted, as told to a model; kinds of which none is wanted are left out."""
    told = {"story": ("Stories", " clips up to 15s"), "reel": ("Reels", " clips up to 60s"), "long_reel": ("Long reels", " clips up to 180s"), "highlight": ("Highlights", " moments")}
    lines = [F.when(quotas[k] > 0, F.concat(F.lit(f"{name}: "), quotas[k].cast("string"), F.lit(rest))) for k, (name, rest) in told.items()]
    total = F.aggregate(F.map_values(quotas), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.coalesce(F.nullif(F.concat_ws("\n", *lines), F.lit("")), F.concat(F.lit("Reels: "), F.greatest(F.lit(1), total).cast("string"), F.lit(" clips of 30-60s")))


def episodes(segments: DataFrame, settings: Settings) -> DataFrame:
    """(ep, duration, quotas, target, requirements): lengths and what is wanted of each episode."""
    d = segments.groupBy("ep").agg(F.max("e_ms").alias("duration"))
    if settings.clips_per_hour > 0:
        q = A.apportioned(settings.quotas, F.floor(F.col("duration") / 1000), settings.clips_per_hour)
    else:
        q = F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for kv in settings.quotas.items() for x in kv])
    d = d.withColumn("quotas", q)
    total = F.aggregate(F.map_values("quotas"), F.lit(0).cast("long"), lambda a, b: a + b)
    return d.select("ep", "duration", "quotas", F.greatest(F.lit(1).cast("long"), total).alias("target"), requirements(F.col("quotas")).alias("requirements"))


# -- context


def formatted_context(payload: Column | str) -> Column:
    """An overview of an episode, a JSON object, as a part of a prompt; '' without a summary and the rest."""
    get = lambda k: F.trim(F.coalesce(F.get_json_object(payload, f"$.{k}"), F.lit("")))

    def listed(k: str) -> Column:
        items = F.from_json(F.get_json_object(payload, f"$.{k}"), "array<string>")
        return F.array_join(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), ", ")

    told = [("", get("summary")), ("Темы эпизода / Episode topics: ", listed("topics")), ("Тональность / Tone: ", get("tone")), ("Участники / Speakers: ", listed("speakers"))]
    lines = F.concat_ws("\n", *[F.when(x != "", F.concat(F.lit(name), x)) for name, x in told])
    return F.when(lines == "", "").otherwise(F.concat(F.lit("# Контекст эпизода / Episode context\n"), lines))


def episode_context(sentences: DataFrame, make: Make, settings: Settings) -> DataFrame:
    """(ep, episode_context): one call for each episode over its digest, about a sentence for every two minutes. A reply without a summary, or a failure, gives none."""
    picked = O.per_key(sentences, "ep", ["s_ms", "e_ms"], lambda r: O.digest(r, MINUTE, 40), "s_ms long, text string")
    d = picked.groupBy("ep").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_ms", "text"))), lambda x: x["text"]), " ").alias("d"))
    cut = F.substring("d", 1, settings.digest_chars)
    short = F.when(F.length("d") > settings.digest_chars, F.concat(F.regexp_replace(cut, r" [^ ]*$", ""), F.lit("…"))).otherwise(F.col("d"))
    asked = P.generate(d.select("ep", T.render(settings.prompts["context"], {"transcript_digest": short}).alias("prompt")), make)
    told = F.coalesce(F.get_json_object("reply", "$.summary"), F.lit("")) != ""
    return asked.select("ep", F.when(told, formatted_context("reply")).otherwise("").alias("episode_context"))


# -- scout


def chunks(segments: DataFrame, settings: Settings) -> DataFrame:
    """(ep, chunk_id, s_ms, e_ms, text, speakers, units, overlap_left, overlap_right, segments) of units (ep, seg, s_ms, e_ms, text, speaker)."""
    overlap = max(15_000, settings.chunk // 8000 * 1000)
    kinds = "chunk_id string, s_ms long, e_ms long, text string, speakers array<string>, units long, overlap_left boolean, overlap_right boolean, segments array<long>"
    return O.per_key(segments, "ep", ["s_ms", "e_ms", "seg"], lambda r: O.overlapping_chunks(r, settings.chunk, settings.chunk_chars, overlap), kinds)


def chunk_json() -> Column:
    """A chunk as JSON, without its text, which a prompt shows by itself; seconds to 3 decimals."""
    sec = lambda c: F.round(F.col(c) / 1000, 3)
    return F.to_json(F.struct("chunk_id", sec("s_ms").alias("start"), sec("e_ms").alias("end"), F.col("speakers").alias("speaker_set"), F.col("units").alias("sentence_count"), "overlap_left", "overlap_right", F.col("segments").alias("source_segment_ids")))


def with_chunk(rows: DataFrame) -> DataFrame:
    """Moments with the chunk they came from among their sources and, where they name no speaker, the first of the chunk's speakers; the fewer there are the surer."""
    guessed = (F.col("speaker") == "") & (F.size("speakers") > 0)
    return rows.withColumns({
        "source_chunk_ids": F.array_distinct(F.concat("source_chunk_ids", F.array("chunk_id"))),
        "speaker": F.when(guessed, F.get("speakers", F.lit(0))).otherwise(F.col("speaker")),
        "speaker_confidence": F.when(guessed, F.when(F.size("speakers") == 1, 0.5).otherwise(0.35)).otherwise(F.col("speaker_confidence")),
    })


def not_all_failed(replies: DataFrame, key: str) -> DataFrame:
    """The replies; an error if every call of a key failed, as then a server is down. An answer that is no JSON is no failure."""
    failed = F.col("reply").isNull() & F.col("error").isNotNull() & (F.col("error") != P.NO_JSON)
    lost = F.min(failed.cast("int")).over(Window.partitionBy(key)) == 1
    return replies.withColumn("error", F.when(lost, F.raise_error(F.concat(F.lit("all calls failed for "), F.col(key).cast("string"), F.lit(": "), "error"))).otherwise(F.col("error"))).filter("error is null or error is not null and reply is null")


def scout(chunked: DataFrame, info: DataFrame, context: DataFrame | None, make: Make, settings: Settings) -> DataFrame:
    """Candidates of every chunk, in order of chunk and answer, cut to the chunk; those outside it by more than the tolerance go."""
    asked = chunked.join(info.select("ep", "requirements"), "ep")
    asked = asked.join(context, "ep", "left") if context is not None else asked.withColumn("episode_context", F.lit(""))
    values = {"requirements": "requirements", "episode_context": "episode_context", "chunk_json": chunk_json(), "transcript": "text"}
    prompts = asked.select("ep", "chunk_id", "s_ms", "e_ms", "speakers", T.render(settings.prompts["scout"], values).alias("prompt"))
    found = exploded(not_all_failed(P.generate(prompts, make), "ep"), "scout", "chunk_id", "s_ms", "e_ms", "speakers")
    cut = I.clamped(found, F.col("s_ms"), F.col("e_ms"), settings.chunk_tolerance, 1000)
    return numbered(with_chunk(cut), [F.regexp_extract("chunk_id", "([0-9]+)$", 1).cast("long"), "pos"]).select("ep", *COLUMNS)


# -- cleanup


def deduped(moments: DataFrame) -> DataFrame:
    """Moments without near duplicates in time, the best of each kept."""
    own = moments.select("ep", "id", "s", "e", value().alias("value"), "title", "clip_type")
    return moments.join(O.nms(own, "ep"), ["ep", "id"], "left_semi")


def best(moments: DataFrame, most: Column) -> DataFrame:
    """The best of each episode; most may be a column."""
    w = Window.partitionBy("ep").orderBy(F.desc("__v"), "s", "e", "title", "id")
    return moments.withColumn("__v", value()).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= most).drop("__v", "__r")


def batched(moments: DataFrame, order: list[Column | str], size: int) -> DataFrame:
    """Moments with batch: fixed numbers of rows of each episode, in order."""
    return moments.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("ep").orderBy(*order)) - 1) / size).cast("long"))


def column(c: str) -> Column:
    return F.col({"start": "s", "end": "e"}.get(c, c)) / 1000 if c in ("start", "end") else F.col(c)


def refined(batches: DataFrame, payload: Column, order: list[str], stage: str, info: DataFrame, context: DataFrame | None, make: Make, settings: Settings) -> DataFrame:
    """What a model makes of batches of moments: its valid records, or, where it gives none, the batch as it was."""
    rows = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, payload.alias("j")))), lambda x: x["j"]), ","), F.lit("]"))
    asked = batches.groupBy("ep", "batch").agg(rows.alias("candidates_json")).join(info.select("ep", "requirements"), "ep")
    asked = asked.join(context, "ep", "left") if context is not None else asked.withColumn("episode_context", F.lit(""))
    values = {"requirements": "requirements", "episode_context": "episode_context", "candidates_json": "candidates_json"}
    replies = stored(P.generate(asked.select("ep", "batch", T.render(settings.prompts[stage], values).alias("prompt")), make).select("ep", "batch", "reply"), stage)
    answered = F.size(stamped("reply", stage)) > 0
    kept = batches.join(replies.filter(~F.coalesce(answered, F.lit(False))).select("ep", "batch"), ["ep", "batch"], "left_semi")
    new = exploded(replies, stage, "batch")
    return new.withColumn("id", F.lit(None).cast("long")).withColumn("fresh", F.lit(True)).select("ep", "batch", "pos", "fresh", *COLUMNS).unionByName(kept.withColumn("pos", F.col("id").cast("int")).withColumn("fresh", F.lit(False)).select("ep", "batch", "pos", "fresh", *COLUMNS))


def cleaned(moments: DataFrame, info: DataFrame, make: Make, settings: Settings) -> DataFrame:
    """The best of the moments, refined in batches by time, so that near duplicates come together; without duplicates."""
    top = best(deduped(moments).join(info.select("ep", "target"), "ep"), F.greatest(F.lit(12), F.col("target") * 3)).select("ep", *COLUMNS)
    rows = stored(batched(top, ["s", "e", "id"], settings.cleanup_batch), "batches")
    out = refined(rows, moment_json(column), ["s", "e", "id"], "cleanup_refine", info, None, make, settings)
    return deduped(stored(numbered(out, ["batch", "pos"]).select("ep", *COLUMNS), "refined"))


def guarded(outputs: DataFrame, inputs: DataFrame, settings: Settings) -> DataFrame:
    """Outputs that overlap an input by a second; an episode of which none does gets its inputs."""
    if not settings.require_overlap:
        return outputs
    # ids are unique within an episode only
    row = F.concat_ws("-", "ep", "id")
    return I.guarded_semi(outputs.withColumn("__row", row), inputs.withColumn("__row", row), "ep", "__row", MINUTE, 1000).select("ep", *COLUMNS)


def topped_up(kept: DataFrame, pool: DataFrame, info: DataFrame) -> DataFrame:
    """Where a cleanup left too few for the target, the best of the pool that overlap nothing kept come back."""
    rows = kept.withColumn("kept", F.lit(True)).unionByName(pool.withColumn("kept", F.lit(False)))
    own = rows.select("ep", "id", "s", "e", "kept", value().alias("value")).join(info.select("ep", "target"), "ep")

    def kernel(rows: list[O.Row]) -> list[O.Row]:
        target = rows[0]["target"]
        return O.topped_up(rows, max(target + max(3, target // 3), sum(r["kept"] for r in rows)))

    chosen = O.per_key(own, "ep", ["kept", "id"], kernel, "id long, kept boolean")
    return numbered(rows.join(chosen, ["ep", "id", "kept"], "left_semi"), [F.desc("kept"), F.desc(value()), "s", "e", "id"]).select("ep", *COLUMNS)


# -- what was said


def text_between(spans: DataFrame, words: DataFrame, sentences: DataFrame, row: str, most: int = 0) -> DataFrame:
    """(row, text): what is said in each span (ep, row, s, e): its words or, where there are none, its sentences; cut at ``most`` characters. A span without length has the word it lies in."""
    join = lambda t, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s2", "seg", "pos", c))), lambda x: x[c]), " ")
    side = lambda t, c: t.select("ep", F.col("s_ms").alias("s2"), F.col("e_ms").alias("e2"), "seg", "pos", c)
    own = spans.select("ep", row, "s", "e")
    said = I.overlap_join(own, side(words, "word"), "ep", MINUTE).groupBy(row).agg(join(words, "word").alias("__w"))
    told = I.overlap_join(own, side(sentences, "text"), "ep", MINUTE).groupBy(row).agg(join(sentences, "text").alias("__t"))
    x = spans.select(row).join(said, row, "left").join(told, row, "left")
    whole = F.trim(F.coalesce("__w", "__t", F.lit("")))
    return x.select(row, (T.excerpt(whole, most) if most else whole).alias("text"))


def verified(moments: DataFrame, words: DataFrame) -> DataFrame:
    """Moments with their quote's likeness to what was said, widened to where it was."""
    x = moments.withColumn("__row", F.concat_ws("-", "ep", "id")).drop("quote_match_ratio")
    return M.verified_quotes(x, words, "ep", "__row").select("ep", *COLUMNS)


def judged(moments: DataFrame, words: DataFrame, sentences: DataFrame, info: DataFrame, context: DataFrame | None, make: Make, settings: Settings) -> DataFrame:
    """Moments rated again in batches, best first, with the words at both their ends; a batch without a valid answer stays as it is."""
    x = moments.withColumns({"__row": F.concat_ws("-", "ep", "id"), "__v": value()})
    head = text_between(x.select("ep", "__row", "s", F.least(F.col("s") + settings.head, "e").alias("e")), words, sentences, "__row", settings.excerpt_chars).withColumnRenamed("text", "__head")
    tail = text_between(x.select("ep", "__row", F.greatest(F.col("e") - settings.tail, "s").alias("s"), "e"), words, sentences, "__row", settings.excerpt_chars // 2).withColumnRenamed("text", "__tail")
    x = x.join(head, "__row").join(tail, "__row")
    some = {c: F.nullif(F.col(c), F.lit("")) for c in ("hook", "speaker")} | {"quote_match_ratio": F.col("quote_match_ratio"), "excerpt_head": F.nullif("__head", F.lit("")), "excerpt_tail": F.nullif("__tail", F.lit(""))}
    always = {c: F.round(column(c), 3) for c in ("start", "end")} | {c: F.col(c) for c in ("clip_type", "title", "quote", "why", "score")}
    payload = F.to_json(F.struct(*[v.alias(k) for k, v in (always | some).items()]), {"ignoreNullFields": "true"})
    rows = stored(batched(x.withColumn("__o", -F.col("__v")), ["__o", "s", "e", "id"], settings.judge_batch), "batches")
    out = refined(rows, payload, ["__o", "s", "e", "id"], "judge_metadata", info, context, make, settings)
    out = out.withColumn("judge_score", F.when(F.col("fresh"), F.col("score")).otherwise(F.col("judge_score")))
    return numbered(out, ["batch", "pos"]).select("ep", *COLUMNS)


def snapped(moments: DataFrame, words: DataFrame, sentences: DataFrame, most: int) -> DataFrame:
    """Both ends moved to the sentence or word next to them, unless under a second would be left."""
    x = moments.withColumn("__row", F.concat_ws("-", "ep", "id"))
    ends = {"__s": ("s", "s_ms", False), "__e": ("e", "e_ms", True)}
    for name, (c, anchor, forward) in ends.items():
        tiers = [t.select("ep", F.col(anchor).alias("a")) for t in (sentences, words)]
        moved = I.snapped(x.select("ep", "__row", F.col(c).alias("t")), tiers, "ep", "__row", most, forward)
        x = x.join(moved.select("__row", F.col("snapped").alias(name)), "__row")
    ok = F.col("__e") - F.col("__s") >= 1000
    return x.withColumns({"s": F.when(ok, F.col("__s")).otherwise(F.col("s")), "e": F.when(ok, F.col("__e")).otherwise(F.col("e"))}).select("ep", *COLUMNS)


def within_episode(moments: DataFrame, info: DataFrame) -> DataFrame:
    """Moments cut to their episode; what begins after it, or has under a second left, goes."""
    x = moments.join(info.select("ep", "duration"), "ep").filter("duration <= 0 or s < duration")
    known = F.col("duration") > 0
    x = x.withColumns({"s": F.when(known, F.greatest(F.lit(0).cast("long"), "s")).otherwise(F.col("s")), "e": F.when(known, F.least("e", "duration")).otherwise(F.col("e"))})
    return x.filter("duration <= 0 or e - s >= 1000").select("ep", *COLUMNS)


def with_speech_rate(moments: DataFrame, words: DataFrame) -> DataFrame:
    """Words a second of each moment, to 4 decimals; what it was where none is known to be said."""
    x = moments.withColumn("__row", F.concat_ws("-", "ep", "id"))
    w = words.select("ep", F.col("s_ms").alias("s2"), F.col("e_ms").alias("e2"))
    n = I.overlap_join(x.select("ep", "__row", "s", "e"), w, "ep", MINUTE).groupBy("__row").agg(F.count("*").alias("__n"))
    rate = S.fixed(F.col("__n") * 1000.0 / (F.col("e") - F.col("s")))
    return x.join(n, "__row", "left").withColumn("speech_rate_wps", F.coalesce(rate, "speech_rate_wps")).select("ep", *COLUMNS)


def with_audio(moments: DataFrame, logs: DataFrame) -> DataFrame:
    """Loudness and silent share out of probe logs (ep, s, e, log) of the moments' spans; moments without a log, or one that tells no volume, stay as they are."""
    seen = logs.select("ep", "s", "e", A.volume("log").alias("__db"), A.volume("log", "max").alias("__max"), A.silence_ratio("log", (F.col("e") - F.col("s")) / 1000).alias("__quiet")).filter("__db is not null or __max is not null")
    x = moments.join(seen.dropDuplicates(["ep", "s", "e"]), ["ep", "s", "e"], "left")
    return x.withColumns({"audio_energy_db": F.coalesce("__db", "audio_energy_db"), "audio_silence_ratio": F.coalesce("__quiet", "audio_silence_ratio")}).select("ep", *COLUMNS)


# -- ranking and metadata


def scored(moments: DataFrame, weights: dict[str, object] | None = None) -> DataFrame:
    """Moments with their priority and the factors that subtitles and crops are chosen by; the model's own score stays."""
    x = moments.withColumns({"__s": F.col("s"), "__e": F.col("e")}).withColumns({"s": F.col("__s") / 1000, "e": F.col("__e") / 1000})
    b = S.breakdown()
    new = {"priority": S.priority(weights), "hook_score": b["hook_score"], "completeness_score": b["completeness_score"], "speaker_focus": b["speaker_focus_score"], "subtitle_readability_score": b["readability_score"], "crop_confidence": b["duration_score"], "selection_stage": F.coalesce(F.nullif("selection_stage", F.lit("")), F.lit("judge"))}
    return x.withColumns(new).withColumns({"s": F.col("__s"), "e": F.col("__e")}).select("ep", *COLUMNS)


def selected(moments: DataFrame, info: DataFrame, settings: Settings) -> DataFrame:
    """(ep, rank, MOMENT): scored, without duplicates, under the quotas; with clips an hour the total is kept and the mix may give way."""
    x = scored(moments, settings.weights)
    own = x.select("ep", "id", "s", "e", F.col("priority").alias("value"), "title", "quote", "clip_type").join(info.select("ep", "target", F.map_entries("quotas").alias("quotas")), "ep")
    fill, similar = settings.clips_per_hour > 0, settings.similar

    def kernel(rows: list[O.Row]) -> list[O.Row]:
        quotas = {q["key"]: q["value"] for q in rows[0]["quotas"]}
        return O.ranked(rows, quotas, similar, rows[0]["target"] if fill else None)

    return x.join(O.per_key(own, "ep", ["id"], kernel, "id long, rank long"), ["ep", "id"])


def finalised(moments: DataFrame) -> DataFrame:
    """Texts that are missing filled from one another, five hashtags; moments as they go out."""
    x = moments.withColumn("__d", T.description())
    filled = lambda c, *others: F.coalesce(F.nullif(S.text(c), F.lit("")), *[F.nullif(o, F.lit("")) for o in others])
    tags = T.hashtags(F.col("hashtags"), ["__d", T.without_hashtags("caption"), *[T.clean(c) for c in ("hook", "title", "quote", "why")]], S.bucket())
    x = x.withColumns({"hashtags": tags, "caption": filled("caption", F.col("__d")), "selection_stage": filled("selection_stage", F.lit("metadata")), "why": filled("why", F.col("__d"))})
    x = x.withColumn("title", filled("title", F.substring("__d", 1, 60)))
    x = x.withColumn("hook", filled("hook", F.col("title")))
    return x.withColumn("quote", filled("quote", F.col("hook"))).drop("__d")


def staged(segments: DataFrame, words: DataFrame, sentences: DataFrame, models: dict[str, Make], settings: Settings | None = None, diarization: DataFrame | None = None, logs: DataFrame | None = None) -> DataFrame:
    """The whole analysis: (ep, rank, MOMENT). segments: (ep, seg, speaker, text, s_ms, e_ms); words and sentences: with seg, pos and word or text. models: a maker for scout, cleanup_refine, judge_metadata and, if an overview is wanted, context."""
    settings = settings or Settings()
    # every stage reads its input more than once, so each is written once; what a model said is never asked for again
    keep = stored
    segments, words, sentences = keep(segments, "segments"), keep(words, "words"), keep(sentences, "sentences")
    units = sentences.select("ep", "seg", "speaker", "text", "s_ms", "e_ms")
    if diarization is not None:
        own = segments.select("ep", "seg", F.concat_ws("-", "ep", "seg").alias("__row"), F.col("s_ms").alias("s"), F.col("e_ms").alias("e"))
        who = I.largest_overlap(own, diarization, "ep", "__row", "speaker", MINUTE).select("ep", "seg", F.col("speaker").alias("__who"))
        units = units.join(who, ["ep", "seg"], "left").withColumn("speaker", F.coalesce("__who", "speaker")).drop("__who")
    info = keep(episodes(segments, settings), "episodes")
    context = keep(episode_context(sentences, models["context"], settings), "context") if settings.context and "context" in models else None
    found = keep(scout(chunks(units, settings), info, context, models["scout"], settings), "scouted")
    pool = keep(best(deduped(found).join(info.select("ep", "target"), "ep"), F.greatest(F.lit(settings.cleanup_batch), F.col("target") * 2)).select("ep", *COLUMNS), "pool")
    clean = keep(cleaned(pool, info, models["cleanup_refine"], settings), "cleaned")
    kept = topped_up(keep(guarded(clean, pool, settings), "guarded"), pool, info)
    if logs is not None:
        kept = with_audio(kept, logs)
    kept = keep(verified(keep(kept, "kept"), words), "verified")
    rated = keep(judged(kept, words, sentences, info, context, models["judge_metadata"], settings), "judged")
    rated = keep(verified(keep(guarded(rated, kept, settings), "guarded"), words), "verified")
    # a quote may widen a moment, and the widened ends are snapped
    rated = keep(snapped(rated, words, sentences, settings.snap), "snapped")
    rated = keep(with_speech_rate(within_episode(rated, info), words), "ready")
    return finalised(selected(rated, info, settings)).select("ep", "rank", *COLUMNS)
