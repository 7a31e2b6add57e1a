"""Queries of the record operators, of files by name, and of parts of the staged analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import config as C
from ..operators import aggregates as A
from ..operators import folds as O
from ..operators import intervals as I
from ..operators import records as R
from ..sources import files as S
from ..sources import sinks as K
from . import analysis as N
from . import views as V
from .aggregate_queries import oracles as SUMS
from .fold_queries import _CHUNKS, overlap_chunks
from .text_queries import _DESCRIBED, _TAGGED, _VAGUE_CARDS, _described
from .views import using

queries, oracles = {}, {}


def register(name, sql=None):
    def add(fn):
        queries[name] = fn
        if sql:
            oracles[name] = sql
        return fn

    return add


# -- segments with word times

#: Words as they were heard: of segments that are multiples of 3 they are all there, of others the last is missing, so their times do not fit.
_HEARD = ", h AS (SELECT g.*, list(w.pos ORDER BY w.pos) AS ps, list(w.s_ms + 5 ORDER BY w.pos) AS ws, list(w.e_ms ORDER BY w.pos) AS we, list(w.word ORDER BY w.pos) AS ww FROM segments g JOIN words w ON w.ep = g.ep AND w.seg = g.seg WHERE (g.ep + g.seg) % 3 = 0 OR w.pos > 0 GROUP BY ALL)"


def _heard(spark, d):
    w = V.words(spark, d).filter("(ep + seg) % 3 = 0 OR pos > 0").groupBy("ep", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("s_ms") + 5).alias("s_ms"), "e_ms", "word"))).alias("w"))
    return V.segments(spark, d).join(w, ["ep", "seg"]).withColumn("words", F.transform("w", lambda x: F.struct(x["s_ms"].alias("s_ms"), x["e_ms"].alias("e_ms"), x["word"].alias("word"))))


@register("word_timed_units", using("words") + _HEARD + r""", p AS (SELECT *, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ps2 FROM h),
u AS (SELECT ep, seg, speaker, s_ms, e_ms, ws, we, len(ps2) AS n, unnest(ps2) AS text, unnest(range(0, len(ps2))) AS pos FROM p),
c AS (SELECT *, sum(len(string_split(text, ' '))) OVER w AS upto0, sum(len(string_split(text, ' '))) OVER (PARTITION BY ep, seg) AS every, sum(length(text)) OVER w AS chars, sum(length(text)) OVER (PARTITION BY ep, seg) AS total FROM u WINDOW w AS (PARTITION BY ep, seg ORDER BY pos)),
t AS (SELECT *, ws[CAST(upto0 AS INT) - len(string_split(text, ' ')) + 1] AS a, we[CAST(upto0 AS INT)] AS b FROM c), f AS (SELECT *, len(ws) = every AND bool_and(coalesce(b > a, false)) OVER (PARTITION BY ep, seg) AS fits FROM t)
SELECT ep, seg, pos, CASE WHEN n = 1 THEN s_ms WHEN fits THEN a ELSE CAST(floor(s_ms + (e_ms - s_ms)::DOUBLE * (chars - length(text)) / total + 0.5) AS BIGINT) END AS s_ms, CASE WHEN n = 1 THEN e_ms WHEN fits THEN b WHEN pos = n - 1 THEN e_ms ELSE CAST(floor(s_ms + (e_ms - s_ms)::DOUBLE * chars / total + 0.5) AS BIGINT) END AS e_ms, text, speaker FROM f""")
def word_timed_units(spark, d):
    return R.units(_heard(spark, d), "ep")


@register("subtitle_words", using("words") + _HEARD + r""", t AS (SELECT ep, seg, s_ms, e_ms, ws, we, ww, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS t FROM h),
u AS (SELECT ep, seg, s_ms, e_ms, ws, we, ww = t AS hit, unnest(t) AS word, unnest(range(0, len(t))) AS pos, len(t) AS n FROM t), c AS (SELECT *, sum(length(word)) OVER (PARTITION BY ep, seg ORDER BY pos) AS upto, sum(length(word)) OVER (PARTITION BY ep, seg) AS total FROM u),
x AS (SELECT *, CASE WHEN hit THEN ws[pos + 1]::DOUBLE ELSE s_ms + (e_ms - s_ms)::DOUBLE * (upto - length(word)) / total END AS a, CASE WHEN hit THEN coalesce(ws[pos + 2], we[pos + 1])::DOUBLE ELSE s_ms + (e_ms - s_ms)::DOUBLE * upto / total END AS b FROM c)
SELECT ep, seg, pos, CAST(floor(a + 0.5) AS BIGINT) AS s_ms, CAST(floor(greatest(a + 10, b) + 0.5) AS BIGINT) AS e_ms, word FROM x""")
def subtitle_words(spark, d):
    return R.subtitle_words(_heard(spark, d), "ep")


@register("sample_times", using("moments") + ", q AS (SELECT id, s, e, unnest(range(0, 4)) AS k FROM moments) SELECT id, list(floor((s + (e - s) * 0.15::DOUBLE + (e - s)::DOUBLE * 0.7::DOUBLE / 3 * k) * 1000 + 0.5) / 1000 ORDER BY k) AS times FROM q GROUP BY id")
def sample_times(spark, d):
    t = R.sample_times(F.col("s"), F.col("e"), 4)
    return V.moments(spark, d).select("id", F.transform(t, lambda x: F.floor(x * 1000 + 0.5) / 1000).alias("times"))


_CLIPS = ", clip AS (SELECT ep, seg AS clip, s_ms + 700 AS s, e_ms + 900 AS e FROM segments)"


def _clips(spark, d):
    return V.segments(spark, d).select("ep", F.col("seg").alias("clip"), (F.col("s_ms") + 700).alias("s"), (F.col("e_ms") + 900).alias("e"))


@register("clip_words", using("words") + _CLIPS + " SELECT c.ep || '-' || c.clip AS clip, w.seg, w.pos, w.word, greatest(w.s_ms, greatest(0, c.s - 500)) - greatest(0, c.s - 500) AS s_ms, least(w.e_ms, c.e + 500) - greatest(0, c.s - 500) AS e_ms FROM clip c JOIN words w ON w.ep = c.ep AND least(w.e_ms, c.e + 500) - greatest(w.s_ms, greatest(0, c.s - 500)) >= 10")
def clip_words(spark, d):
    return R.clip_words(_clips(spark, d).withColumn("clip", F.concat_ws("-", "ep", "clip")), V.words(spark, d), "ep", 500)


_CUE_TIME = lambda c: f"printf('%02d:%02d:%02d,%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"


@register("clip_srt", using("sentences") + _CLIPS + f""", x AS (SELECT c.ep || '-' || c.clip AS clip, greatest(t.s_ms, c.s) - c.s AS a, least(t.e_ms, c.e) - c.s AS b, t.text, row_number() OVER (PARTITION BY c.ep, c.clip ORDER BY t.seg, t.pos) AS n FROM clip c JOIN sentences t ON t.ep = c.ep AND least(t.e_ms, c.e) - greatest(t.s_ms, c.s) >= 50)
SELECT clip, string_agg(n || chr(10) || {_CUE_TIME('a')} || ' --> ' || {_CUE_TIME('b')} || chr(10) || text || chr(10), chr(10) ORDER BY n) AS srt FROM x GROUP BY clip""")
def clip_srt(spark, d):
    """Subtitles of each clip by themselves, counted from its start."""
    t = V.sentences(spark, d).select("ep", "seg", "pos", "text", F.col("s_ms").alias("s2"), F.col("e_ms").alias("e2"))
    x = I.overlap_join(_clips(spark, d).withColumn("clip", F.concat_ws("-", "ep", "clip")), t, "ep", 60_000).filter(I.overlap() >= 50)
    cues = x.select("clip", "seg", "pos", "text", (F.greatest("s2", "s") - F.col("s")).alias("s_ms"), (F.least("e2", "e") - F.col("s")).alias("e_ms"))
    return K.srt(cues, "clip", ["seg", "pos"])


def reel_assets(spark, d):
    """(clip, srt, ass) of each clip: its cues merged, split and timed, as both kinds of subtitles."""
    t = V.sentences(spark, d).select("ep", "seg", "pos", "text", F.col("s_ms").alias("s2"), F.col("e_ms").alias("e2"))
    x = I.overlap_join(_clips(spark, d).withColumn("clip", F.concat_ws("-", "ep", "clip")), t, "ep", 60_000).filter(I.overlap() >= 50)
    return K.reel_assets(x.select("clip", "seg", "pos", "text", (F.greatest("s2", "s") - F.col("s")).alias("s_ms"), (F.least("e2", "e") - F.col("s")).alias("e_ms")), "clip", ["seg", "pos"])


queries["reel_assets"] = reel_assets


_RAW_TIMES = "CASE doc_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN NULL WHEN 2 THEN '12.9' ELSE CAST(doc_id AS VARCHAR(20)) END"


@register("segment_lines", f"WITH r AS (SELECT lang, doc_id, {_RAW_TIMES} AS a, text AS t FROM documents) SELECT lang, doc_id, '[' || CAST(trunc(TRY_CAST(coalesce(a, '0') AS DOUBLE)) AS BIGINT) || '-' || (doc_id + 9) || '] ' || trim(t) AS line FROM r WHERE TRY_CAST(coalesce(a, '0') AS DOUBLE) IS NOT NULL AND trim(t) <> ''")
def segment_lines(spark, d):
    raw = V.table(spark, d, "documents").select("lang", "doc_id", F.expr(_RAW_TIMES).alias("start"), (F.col("doc_id") + 9).cast("string").alias("end"), "text")
    return R.segment_lines(raw, "lang", "doc_id")


_ROW = "'[' || (s_ms // 1000) || '-' || (e_ms // 1000) || '] (' || speaker || ') ' || trim(text)"


@register("compact_text", using("segments") + f", t AS (SELECT ep, string_agg({_ROW}, chr(10) ORDER BY seg) AS t FROM segments GROUP BY ep), k AS (SELECT *, left(t, 1500) AS cut, 1500 - instr(reverse(left(t, 1500)), chr(10)) AS line FROM t) SELECT ep, CASE WHEN length(t) <= 1500 THEN t WHEN contains(cut, chr(10)) AND line > 1200 THEN left(cut, line) ELSE cut END AS text FROM k")
def compact_text(spark, d):
    sec = lambda c: F.floor(F.col(c) / 1000).cast("string")
    line = F.concat(F.lit("["), sec("s_ms"), F.lit("-"), sec("e_ms"), F.lit("] ("), "speaker", F.lit(") "), F.trim("text"))
    return R.compact_text(V.segments(spark, d).select("ep", "seg", line.alias("line")), "ep", ["seg"], 1500)


_CTE, _PICK = _CHUNKS.rsplit("\nSELECT f.ep, ", 1)


@register("chunk_plain_text", using("sentences", recursive=True) + _CTE + f", chunks AS (SELECT f.ep, {_PICK}), a AS (SELECT ep, chunk_id, unnest(segments) AS seg FROM chunks) SELECT a.ep, a.chunk_id, string_agg(trim(g.text), ' ' ORDER BY a.seg) AS text FROM a JOIN segments g ON g.ep = a.ep AND g.seg = a.seg WHERE trim(g.text) <> '' GROUP BY a.ep, a.chunk_id")
def chunk_plain_text(spark, d):
    return R.plain_text(overlap_chunks(spark, d), V.segments(spark, d), "ep")


@register("rendered_turns", using("segments") + ", l AS (SELECT ep, string_agg(CASE speaker WHEN 'user' THEN 'Ann' ELSE speaker END || ': ' || text, chr(10) ORDER BY seg) AS t FROM segments GROUP BY ep) SELECT ep, CASE WHEN length(t) <= 2000 THEN t ELSE left(t, 1200) || chr(10) || chr(10) || '[...]' || chr(10) || chr(10) || right(t, 800) END AS excerpt FROM l")
def rendered_turns(spark, d):
    """What a model is shown to tell the speakers' names: both ends of an episode."""
    t = R.rendered_turns(V.segments(spark, d).withColumnRenamed("seg", "turn"), "ep", F.create_map(F.lit("user"), F.lit("Ann")))
    return t.select("ep", R.both_ends(F.col("text"), 2000).alias("excerpt"))


# -- text between, judge


@register("text_between", using("words", "sentences") + ", q AS (SELECT ep, id, s * 10 % 90000 AS s, s * 10 % 90000 + e % 20000 AS e FROM moments), w AS (SELECT q.id, string_agg(w.word, ' ' ORDER BY w.s_ms, w.seg, w.pos) AS t FROM q JOIN words w ON w.ep = q.ep AND w.e_ms > q.s AND w.s_ms < q.e WHERE w.seg % 4 <> 3 GROUP BY q.id), t AS (SELECT q.id, string_agg(t.text, ' ' ORDER BY t.s_ms, t.seg, t.pos) AS t FROM q JOIN sentences t ON t.ep = q.ep AND t.e_ms > q.s AND t.s_ms < q.e GROUP BY q.id), x AS (SELECT q.id, trim(coalesce(w.t, t.t, '')) AS t FROM q LEFT JOIN w USING (id) LEFT JOIN t USING (id)), k AS (SELECT *, left(t, 120) AS cut, 120 - instr(reverse(left(t, 120)), ' ') AS space FROM x) SELECT id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(CASE WHEN contains(cut, ' ') AND space > 72 THEN left(cut, space) ELSE cut END) || '…' END AS text FROM k".replace("q AS (", V.SQL["moments"] + ", q AS (", 1))
def text_between(spark, d):
    """Words are known of three turns in four; elsewhere sentences tell what is said."""
    q = V.moments(spark, d).select("ep", "id", (F.col("s") * 10 % 90_000).alias("s"), (F.col("s") * 10 % 90_000 + F.col("e") % 20_000).alias("e"))
    return N.text_between(q, V.words(spark, d).filter("seg % 4 <> 3"), V.sentences(spark, d), "id", 120)


@register("moments_in_order", using("moments", recursive=True) + """, a AS (SELECT ep, list_sort(list_distinct(list(s // 3600))) AS ss, list_sort(list_distinct(list(e // 3600))) AS es FROM moments WHERE id % 3 > 0 GROUP BY ep),
q0 AS (SELECT m.ep, id, s // 3600 AS s, e // 3600 AS e, ss, es, row_number() OVER (PARTITION BY m.ep ORDER BY id) AS k FROM moments m JOIN a ON a.ep = m.ep),
q1 AS (SELECT *, coalesce(list_sort(list_transform(list_filter(ss, lambda x: abs(x - s) <= 10), lambda x: {'d': abs(x - s), 'v': x}))[1].v, s) AS ns, coalesce(list_sort(list_transform(list_filter(es, lambda x: abs(x - e) <= 10), lambda x: {'d': abs(x - e), 'v': x}))[1].v, e) AS ne FROM q0),
q2 AS (SELECT ep, id, k, ss, es, ns, CASE WHEN ne - ns BETWEEN 5 AND 24 THEN ne ELSE coalesce(list_filter(es, lambda x: x BETWEEN ns + 5 AND ns + 24)[1], ne) END AS ne FROM q1),
q3 AS (SELECT ep, id, k, ns, ne, list_contains(ss, ns) AND list_contains(es, ne) AND ne - ns BETWEEN 5 AND 24 AS ok FROM q2),
f AS (SELECT ep, 0::BIGINT AS k, []::STRUCT(id BIGINT, s BIGINT, e BIGINT)[] AS got FROM q3 GROUP BY ep UNION ALL SELECT q.ep, q.k, CASE WHEN q.ok AND len(f.got) < 5 AND len(list_filter(f.got, lambda o: NOT (q.ne <= o.s OR o.e <= q.ns))) = 0 THEN list_append(f.got, {'id': q.id, 's': q.ns, 'e': q.ne}) ELSE f.got END FROM f JOIN q3 q ON q.ep = f.ep AND q.k = f.k + 1),
l AS (SELECT ep, arg_max(got, k) AS got FROM f GROUP BY ep), u AS (SELECT ep, unnest(got) AS m FROM l) SELECT ep, m.id AS id, m.s AS s, m.e AS e FROM u""")
def moments_in_order(spark, d):
    m = V.moments(spark, d).select("ep", "id", F.expr("s div 3600").alias("s"), F.expr("e div 3600").alias("e"))
    a = m.filter("id % 3 > 0").groupBy("ep").agg(F.collect_set("s").alias("starts"), F.collect_set("e").alias("ends"))
    return O.per_key(m.join(a, "ep"), "ep", ["id"], lambda r: R.accepted(r, r[0]["starts"], r[0]["ends"], 5, 5, 24), "id long, s long, e long")


@register("exclusion_prompt", using("moments") + ", r AS (SELECT ep, s, e, row_number() OVER (PARTITION BY ep ORDER BY s, id) AS k FROM moments) SELECT ep, chr(10) || 'TAKEN ALREADY (don''t repeat or overlap): ' || string_agg('[' || s || '-' || e || ']', ', ' ORDER BY k) AS prompt FROM r WHERE k <= 4 GROUP BY ep")
def exclusion_prompt(spark, d):
    first = F.slice(F.array_sort(F.collect_list(F.struct("s", "id", "e"))), 1, 4)
    g = V.moments(spark, d).groupBy("ep").agg(first.alias("r"))
    return g.select("ep", R.exclusions(F.transform("r", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))).alias("prompt"))


_OVERVIEW = """CASE doc_id % 4 WHEN 0 THEN concat('{"summary":" About ', doc_id, ' ","topics":["a"," ","b', doc_id % 3, '"],"tone":"calm"}') WHEN 1 THEN concat('{"topics":"x","speakers":["Ann","Bob ', doc_id, '"]}') WHEN 2 THEN '{}' ELSE 'no json' END"""


@register("episode_context_text", f"""WITH r AS (SELECT doc_id, {_OVERVIEW} AS raw FROM documents), j AS (SELECT doc_id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM r),
p AS (SELECT doc_id, trim(coalesce(j->>'$.summary', '')) AS summary, trim(coalesce(j->>'$.tone', '')) AS tone, array_to_string(list_filter(list_transform(CASE WHEN json_type(j->'$.topics') = 'ARRAY' THEN CAST(j->'$.topics' AS VARCHAR[]) END, lambda x: trim(x)), lambda x: length(x) > 0), ', ') AS topics, array_to_string(list_transform(CASE WHEN json_type(j->'$.speakers') = 'ARRAY' THEN CAST(j->'$.speakers' AS VARCHAR[]) END, lambda x: trim(x)), ', ') AS speakers FROM j),
l AS (SELECT doc_id, concat_ws(chr(10), nullif(summary, ''), CASE WHEN topics <> '' THEN 'Темы эпизода / Episode topics: ' || topics END, CASE WHEN tone <> '' THEN 'Тональность / Tone: ' || tone END, CASE WHEN speakers <> '' THEN 'Участники / Speakers: ' || speakers END) AS t FROM p)
SELECT doc_id, CASE WHEN t = '' THEN '' ELSE '# Контекст эпизода / Episode context' || chr(10) || t END AS context FROM l""")
def episode_context_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", N.formatted_context(F.expr(_OVERVIEW)).alias("context"))


# -- moments made ready


def _card_moments(spark, d):
    """Cards as moments of 20 episodes, in whole milliseconds."""
    c = _described(spark, d).withColumns({"ep": F.col("id") % 20, "s": (F.col("s") * 1000).cast("long"), "e": (F.col("e") * 1000).cast("long")})
    empty = {k: F.lit(None).cast("double") for k in N.NUMBERS if k not in c.columns}
    return c.withColumns(empty | {"selection_stage": F.lit(""), "hashtags": F.expr("CASE id % 3 WHEN 0 THEN array() WHEN 1 THEN array('##Mixed Tag!', '') ELSE array(concat('#', id)) END").cast("array<string>"), "source_chunk_ids": F.expr("CASE WHEN id % 2 = 0 THEN array('chunk_001') ELSE array() END").cast("array<string>")}).select("ep", *N.COLUMNS)


@register("finalised_moments", using("cards") + f""", {_VAGUE_CARDS}, {_DESCRIBED}, {_TAGGED}, h AS (SELECT id, list(tag ORDER BY k)[1:5] AS tags FROM f GROUP BY id),
x AS (SELECT g.*, h.tags, coalesce(nullif(trim(title), ''), nullif(left(shown, 60), '')) AS t2 FROM g JOIN h USING (id)), y AS (SELECT *, coalesce(nullif(trim(hook), ''), t2) AS h2 FROM x)
SELECT id, t2 AS title, h2 AS hook, coalesce(nullif(trim(quote), ''), h2) AS quote, coalesce(nullif(trim(why), ''), shown) AS why, coalesce(nullif(trim(caption), ''), shown) AS caption, tags AS hashtags, 'metadata' AS selection_stage FROM y""")
def finalised_moments(spark, d):
    return N.finalised(_card_moments(spark, d)).select("id", "title", "hook", "quote", "why", "caption", "hashtags", "selection_stage")


@register("moments_with_chunk", using("cards") + """, x AS (SELECT id, coalesce(speaker, '') AS speaker, speaker_confidence, CASE WHEN id % 2 = 0 THEN ['chunk_001'] ELSE [] END AS ids, 'chunk_' || lpad(CAST(id % 3 AS VARCHAR), 3, '0') AS chunk, CASE id % 4 WHEN 0 THEN [] WHEN 1 THEN ['A'] ELSE ['A', 'B'] END AS speakers FROM cards)
SELECT id, CASE WHEN list_contains(ids, chunk) THEN ids ELSE list_append(ids, chunk) END AS source_chunk_ids, CASE WHEN speaker = '' AND len(speakers) > 0 THEN 'A' ELSE speaker END AS speaker, CASE WHEN speaker = '' AND len(speakers) > 0 THEN CASE WHEN len(speakers) = 1 THEN 0.5 ELSE 0.35 END::DOUBLE ELSE speaker_confidence END AS speaker_confidence FROM x""")
def moments_with_chunk(spark, d):
    m = _card_moments(spark, d).withColumns({"speaker": F.coalesce("speaker", F.lit("")), "chunk_id": F.concat(F.lit("chunk_"), F.lpad((F.col("id") % 3).cast("string"), 3, "0")), "speakers": F.expr("CASE id % 4 WHEN 0 THEN array() WHEN 1 THEN array('A') ELSE array('A', 'B') END").cast("array<string>")})
    return N.with_chunk(m).select("id", "source_chunk_ids", "speaker", "speaker_confidence")


_LOGGED = "CASE id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN concat('mean_volume: -', id % 40, '.5 dB') ELSE concat('silence_start: 1', chr(10), 'silence_duration: 2.5', chr(10), 'mean_volume: -20 dB') END"


@register("moments_with_audio", using("cards") + """ SELECT id, CASE id % 3 WHEN 0 THEN audio_energy_db WHEN 1 THEN -(id % 40 + 0.5)::DOUBLE ELSE -20 END AS audio_energy_db, CASE WHEN id % 3 = 0 OR e <= s THEN audio_silence_ratio WHEN id % 3 = 1 THEN 0 ELSE floor(least(1.0, 2.5 / (e - s)) * 10000 + 0.5) / 10000 END AS audio_silence_ratio FROM cards WHERE e > s""")
def moments_with_audio(spark, d):
    m = _card_moments(spark, d).filter("e > s").withColumn("ep", F.col("id"))
    return N.with_audio(m, m.select("ep", "s", "e", F.expr(_LOGGED).alias("log"))).select("id", "audio_energy_db", "audio_silence_ratio")


@register("speech_rates", using("words") + ", q AS (SELECT ep, id, s * 10 % 90000 AS s, s * 10 % 90000 + 1000 + e % 20000 AS e FROM moments), n AS (SELECT q.id, count(*) AS n FROM q JOIN words w ON w.ep = q.ep AND w.e_ms > q.s AND w.s_ms < q.e GROUP BY q.id) SELECT q.id, floor(n.n * 1000.0::DOUBLE / (q.e - q.s) * 10000 + 0.5) / 10000 AS rate FROM q LEFT JOIN n USING (id)".replace("q AS (", V.SQL["moments"] + ", q AS (", 1))
def speech_rates(spark, d):
    q = V.moments(spark, d).select("ep", "id", (F.col("s") * 10 % 90_000).alias("s"), (F.col("s") * 10 % 90_000 + 1000 + F.col("e") % 20_000).alias("e"), "clip_type", "title")
    q = q.withColumns({c: F.lit("") for c in N.TEXTS if c not in q.columns} | {c: F.lit(None).cast("double") for c in ("score", *N.NUMBERS)} | {c: F.array().cast("array<string>") for c in N.LISTS})
    return N.with_speech_rate(q, V.words(spark, d)).select("id", F.col("speech_rate_wps").alias("rate"))


@register("suspect_queries", f"SELECT s.doc_id, s.term, s.occurrences, trim(concat_ws(' ', c.neighbour, s.term)) AS query FROM ({SUMS['suspect_terms']}) s LEFT JOIN ({SUMS['collocates']}) c ON c.doc_id = s.doc_id AND c.stem = s.stem")
def suspect_queries(spark, d):
    """What is asked of a source about each suspect: the word that stands before it most often, and the term."""
    docs = V.table(spark, d, "documents")
    return A.suspect_queries(docs, "doc_id")


# -- models and configuration


@register("model_winners", "WITH r AS (SELECT event_type AS model, max(value) AS seconds, count(*) FILTER (WHERE event_id % 3 > 0) AS moments, avg(CASE WHEN event_id % 3 > 0 THEN CASE WHEN value <= 0 THEN NULL WHEN value <= 1 THEN value * 10 WHEN value > 10 THEN least(value / 10, 10) ELSE value END END) AS a FROM events GROUP BY 1), s AS (SELECT model, seconds, moments, coalesce(a, 0) AS a FROM r) SELECT arg_min(model, {'a': -moments, 'b': -a, 'c': seconds, 'd': model}) AS winner, arg_min(model, {'a': -(moments * 2 + a * 1.5 + 50 / greatest(seconds, 1)), 'b': model}) FILTER (moments >= 3) AS best, arg_min(model, {'a': seconds, 'b': model}) FILTER (moments >= 3) AS fastest, arg_min(model, {'a': -a, 'b': model}) FILTER (moments >= 3) AS highest FROM s")
def model_winners(spark, d):
    runs = V.table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("seconds"), F.expr("CASE WHEN event_id % 3 > 0 THEN value END").alias("score"))
    return R.winners(R.model_results(runs))


_CONF = """CASE doc_id % 4 WHEN 0 THEN concat('{"llama_cpp":{"roles":{"Scout ":" m', doc_id % 5, '","cleanup_refine":"c","judge_metadata":"j","article":"","x":"y"}}}') WHEN 1 THEN '{"llama_cpp":{"models":["a"," ","b","c","d"]}}' WHEN 2 THEN '{"llama_cpp":{"roles":{"scout":"s"},"models":["a","b","c"]}}' ELSE '{"processing":1}' END"""


@register("model_roles", f"""WITH c AS (SELECT doc_id, {_CONF}::JSON AS j FROM documents) SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN trim(j->>'$.llama_cpp.roles."Scout "') WHEN 1 THEN 'a' END AS scout, CASE doc_id % 4 WHEN 0 THEN j->>'$.llama_cpp.roles.cleanup_refine' WHEN 1 THEN list_filter(CAST(j->'$.llama_cpp.models' AS VARCHAR[]), lambda x: trim(x) <> '')[2] END AS cleanup_refine, CASE doc_id % 4 WHEN 0 THEN j->>'$.llama_cpp.roles.judge_metadata' WHEN 1 THEN list_filter(CAST(j->'$.llama_cpp.models' AS VARCHAR[]), lambda x: trim(x) <> '')[3] END AS judge_metadata, CASE doc_id % 4 WHEN 0 THEN j->>'$.llama_cpp.roles.cleanup_refine' WHEN 1 THEN 'b' END AS article FROM c""")
def model_roles(spark, d):
    """Roles out of configurations; where they do not name all that are needed, none."""
    r = V.table(spark, d, "documents").select("doc_id", C.roles(F.expr(_CONF)).alias("r"))
    return r.select("doc_id", *[F.col("r")[k].alias(k) for k in ("scout", "cleanup_refine", "judge_metadata", "article")])


@register("completion_payloads", using("segments") + """ SELECT ep, seg, '{"prompt":' || to_json(text) || ',"stream":false,"temperature":' || CASE seg % 2 WHEN 0 THEN '0.5' ELSE '0.0' END || ',"n_predict":4096' || CASE WHEN seg % 3 = 0 THEN ',"json_schema":{"type":"object"}' ELSE '' END || '}' AS payload FROM segments""")
def completion_payloads(spark, d):
    t = F.when(F.col("seg") % 2 == 0, 0.5).otherwise(0.0)
    return V.segments(spark, d).select("ep", "seg", C.completion_payload(F.col("text"), t, 4096, F.when(F.col("seg") % 3 == 0, F.lit('{"type":"object"}'))).alias("payload"))


# -- files by name



@register("preferred_transcripts", f"""WITH f AS (SELECT lang || '/' || (doc_id % 50) AS folder, source || CAST(doc_id % 50 AS VARCHAR) AS stem, CASE doc_id % 7 WHEN 0 THEN source || CAST(doc_id % 50 AS VARCHAR) || '.json' WHEN 1 THEN source || CAST(doc_id % 50 AS VARCHAR) || '.proofread.json' WHEN 2 THEN 'audio.json' WHEN 3 THEN 'audio.proofread.json' WHEN 4 THEN 'diarization.json' WHEN 5 THEN 'z' || doc_id || '.proofread.json' ELSE 'it''s ' || doc_id || '.json' END AS name FROM documents),
k AS (SELECT DISTINCT folder, min(stem) OVER (PARTITION BY folder) AS stem FROM f), r AS (SELECT f.folder, k.stem, f.name, CASE WHEN f.name = k.stem || '.proofread.json' THEN 0 WHEN f.name = k.stem || '.json' THEN 1 WHEN f.name = 'audio.proofread.json' THEN 2 WHEN f.name = 'audio.json' THEN 3 WHEN f.name LIKE '%.proofread.json' THEN 4 ELSE 5 END AS rank FROM f JOIN k USING (folder) WHERE f.name <> 'diarization.json')
SELECT folder, any_value(stem) AS stem, arg_min(name, rank || name) AS name FROM r GROUP BY folder""")
def preferred_transcripts(spark, d):
    stem = "concat(source, doc_id % 50)"
    f = V.table(spark, d, "documents").selectExpr("concat(lang, '/', doc_id % 50) AS folder", f"{stem} AS stem", f"CASE doc_id % 7 WHEN 0 THEN concat({stem}, '.json') WHEN 1 THEN concat({stem}, '.proofread.json') WHEN 2 THEN 'audio.json' WHEN 3 THEN 'audio.proofread.json' WHEN 4 THEN 'diarization.json' WHEN 5 THEN concat('z', doc_id, '.proofread.json') ELSE concat('it\\'s ', doc_id, '.json') END AS name")
    return S.transcripts_of(f.select("folder", "name"), f.groupBy("folder").agg(F.min("stem").alias("stem")))


@register("model_folders", "WITH p AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'other/' || source || '/a' WHEN doc_id % 3 = 1 THEN 'out/' || lang || '_' || (doc_id % 5) || '/r.mp4' ELSE 'out/x' || doc_id || '.json' END AS path FROM documents) SELECT DISTINCT string_split(substr(path, 5), '/')[1] AS folder FROM p WHERE path LIKE 'out/%/%'")
def model_folders(spark, d):
    p = V.table(spark, d, "documents").selectExpr("CASE WHEN doc_id % 3 = 0 THEN concat('other/', source, '/a') WHEN doc_id % 3 = 1 THEN concat('out/', lang, '_', doc_id % 5, '/r.mp4') ELSE concat('out/x', doc_id, '.json') END AS path")
    return S.model_folders(p, "out")


@register("source_audio", "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 's' || doc_id END AS a, 'a' || (doc_id % 9) AS b FROM documents), f AS (SELECT 's' || doc_id AS path FROM documents WHERE doc_id % 4 = 0 UNION SELECT 'a' || (doc_id % 9) FROM documents WHERE doc_id % 9 < 4) SELECT doc_id, CASE WHEN a IN (SELECT path FROM f) THEN a WHEN b IN (SELECT path FROM f) THEN b END AS path FROM t")
def source_audio(spark, d):
    x = V.table(spark, d, "documents")
    there = x.filter("doc_id % 4 = 0").selectExpr("concat('s', doc_id) AS path").unionByName(x.filter("doc_id % 9 < 4").selectExpr("concat('a', doc_id % 9) AS path"))
    return S.source_audio(x.selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN concat('s', doc_id) END AS source_audio", "concat('a', doc_id % 9) AS audio"), there, "doc_id")


@register("free_file_names", "WITH w AS (SELECT DISTINCT 'reel_' || (doc_id % 60) || '.mp4' AS name FROM documents), t AS (SELECT DISTINCT 'reel_' || (doc_id % 40) || '.mp4' AS name FROM documents UNION SELECT 'reel_' || (doc_id % 20) || '_' || (1 + doc_id % 7 % 5) || '.mp4' FROM documents WHERE doc_id % 11 < 6), c AS (SELECT w.name, replace(w.name, '.mp4', '') AS stem, k FROM w, (SELECT unnest(range(1, 10)) AS k)) SELECT w.name, CASE WHEN w.name IN (SELECT name FROM t) THEN (SELECT c.stem || '_' || min(c.k) || '.mp4' FROM c WHERE c.name = w.name AND c.stem || '_' || c.k || '.mp4' NOT IN (SELECT name FROM t) GROUP BY c.stem) ELSE w.name END AS free FROM w")
def free_file_names(spark, d):
    x = V.table(spark, d, "documents")
    taken = x.selectExpr("concat('reel_', doc_id % 40, '.mp4') AS name").unionByName(x.filter("doc_id % 11 < 6").selectExpr("concat('reel_', doc_id % 20, '_', 1 + doc_id % 7 % 5, '.mp4') AS name"))
    return S.free_names(x.selectExpr("concat('reel_', doc_id % 60, '.mp4') AS name"), taken)
