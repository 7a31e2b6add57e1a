"""Whole stages over all episodes at once: proofreading, article, analysis; and the queries of matching, providers and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semistructured as J
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import folds as O
from ..operators import matching as M
from ..operators import providers as P
from ..operators import records as R
from ..operators.store import stored
from ..sources import files as S
from ..sources import sinks as K
from . import analysis as N
from . import views as V
from .text_queries import stems
from .views import using

STAGES = tuple("transcribe diarize proofread article analyze cut".split())
queries, oracles = {}, {}


def register(name, sql=None):
    def add(fn):
        queries[name] = fn
        if sql:
            oracles[name] = sql
        return fn

    return add


def chosen_stages(only: list[str] | None = None, skip: list[str] | None = None) -> list[str]:
    """Stages to run, in order; a name that is none, or nothing left, is an error."""
    wrong = [x for x in [*(only or []), *(skip or [])] if x not in STAGES]
    out = [s for s in STAGES if (not only or s in only) and s not in (skip or [])]
    if wrong or not out:
        raise ValueError(f"no such stage: {wrong}" if wrong else "no stage is left to run")
    return out


def ready(spark, path: str) -> bool:
    """Whether a stage's table is there and complete."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def proofread(segments: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments with safe corrections, counts of each verdict by episode)."""
    out = M.applied(segments, fixes, ["ep", "seg"])
    return out, out.groupBy("ep").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("applied", "rejected", "same", "none")])


def article(edits: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Of each chunk's tries (ep, chunk, try, source, edited) the one to keep: the first that is faithful, else that of the fewest novel words, marked as not faithful."""
    x = edits.select("ep", "chunk", "try", "edited", T.faithfulness("source", "edited", limits).alias("f"))
    order = F.struct(~F.col("f.ok"), F.when(F.col("f.ok"), 0.0).otherwise(F.col("f.novel")), "try")
    # a pick of each column, so that texts that nobody asks for are not dealt
    return x.groupBy("ep", "chunk").agg(*[F.min_by(c, order).alias(name) for c, name in (("try", "try"), ("f.ok", "faithful"), ("f.novel", "novel"), ("edited", "edited"))])


def corrected(segments: DataFrame, make: Callable[[], P.Provider], chars: int = 3500, template: str = "PROOFREAD\n{segments_json}") -> DataFrame:
    """Segments proofread by a model in batches that fit its prompt: what it gives back for a segment is taken if it is a safe correction. A batch that fails keeps its texts; verdict tells what became of each segment."""
    rows = O.per_key(segments.select("ep", "seg", "text"), "ep", ["seg"], lambda r: O.next_fit(r, lambda x: len(x["text"] or ""), chars), "seg long, bin long")
    x = segments.select("ep", "seg", "text").join(rows, ["ep", "seg"])
    item = F.to_json(F.struct(F.col("seg").alias("id"), F.trim("text").alias("text")))
    asked = x.groupBy("ep", "bin").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", item.alias("j")))), lambda y: y["j"]), ","), F.lit("]")).alias("j"))
    replies = P.generate(asked.select("ep", "bin", T.render(template, {"segments_json": "j"}).alias("prompt")), make)
    fixes = replies.select("ep", F.explode(J.corrections("reply")).alias("seg", "corrected")).withColumn("seg", F.col("seg").cast("long"))
    return M.applied(segments, fixes, ["ep", "seg"])


RETRY = "\n\nThe answer before was not the speaker's own words. Keep them, add and leave out nothing but slips."


def written(chunks: DataFrame, make: Callable[[], P.Provider], limits: dict[str, float] | None = None, template: str = "ARTICLE\n{transcript}") -> DataFrame:
    """(ep, chunk, try, faithful, novel, edited) of chunks (ep, chunk, source): what a model makes of each; one that is not faithful, or has no sections, is asked for once more, and the closer of the two kept."""
    prompts = chunks.withColumn("prompt", T.render(template, {"transcript": "source"}))
    said = lambda df: df.withColumn("edited", F.array_join(F.flatten(F.transform(J.sections("answer"), lambda x: x["paragraphs"])), "\n\n")).drop("answer", "error", "prompt")
    one = stored(said(P.answers(prompts, make)).withColumn("try", F.lit(1)), "article")
    bad = one.filter((F.col("edited") == "") | ~T.faithfulness("source", "edited", limits)["ok"])
    two = said(P.answers(bad.drop("edited", "try").withColumn("prompt", F.concat(T.render(template, {"transcript": "source"}), F.lit(RETRY))), make)).withColumn("try", F.lit(2))
    return article(one.unionByName(two).filter("edited <> ''"), limits)


def speaker_names(turns: DataFrame, make: Callable[[], P.Provider], chars: int = 6000, template: str = "NAMES\n{transcript}") -> DataFrame:
    """(ep, id, name): names that a model, shown both ends of an episode's turns (ep, turn, speaker, text), gives to its speakers. Only ids that are there count, a name once; an episode of fewer than two speakers has none."""
    ids = turns.filter("speaker <> ''").select("ep", F.col("speaker").alias("id")).distinct()
    several = ids.groupBy("ep").agg(F.count("*").alias("n")).filter("n >= 2").select("ep")
    shown = R.rendered_turns(turns, "ep").join(several, "ep", "left_semi").select("ep", T.render(template, {"transcript": R.both_ends(F.col("text"), chars)}).alias("prompt"))
    reply = P.generate(shown, make).select("ep", F.coalesce(F.get_json_object("reply", "$.speakers"), "reply").alias("r"))
    entries = reply.select("ep", F.posexplode(F.from_json("r", "array<struct<id:string,name:string>>")).alias("pos", "x")).select("ep", "pos", F.trim("x.id").alias("id"), F.coalesce("x.name", F.lit("")).alias("name"))
    return M.unique_names(entries.join(ids, ["ep", "id"], "left_semi"), "ep")


def checked_terms(docs: DataFrame, key: str) -> DataFrame:
    """(key, term_fixes, text) of every row: a suspect term that no other document has is set right to the spelling that most documents have, if at least five do. docs: (key, text)."""
    suspects = A.suspect_terms(docs, key)
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower))
    terms = suspects.select("term", F.lit(0).cast("long").alias("occurrences")).distinct()
    asked = terms.select(F.explode(F.concat(F.array("term"), M.spelling_variants("term"))).alias("t")).select(F.lower("t").alias("t")).distinct()
    hits = docs.select(key, F.explode(words).alias("t")).join(asked, "t", "left_semi").distinct().groupBy("t").agg(F.count("*").alias("hits"))
    look = asked.join(hits, "t", "left").select(F.col("t").alias("term"), F.coalesce("hits", F.lit(0)).alias("hits"))
    # a term's own document is one of its hits
    found = M.verified_terms(terms, look, unknown=2).select(F.col("wrong").alias("term"), "right")
    fixes = suspects.join(found, "term").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("term").alias("wrong"), "right"))).alias("fixes"))
    x = docs.join(fixes, key, "left").withColumn("f", M.term_fixed("text", "fixes"))
    return x.select(key, F.col("f.n").alias("term_fixes"), F.col("f.text").alias("text"))


MODELS = {"context": P.summarising, "scout": P.rule_based, "cleanup_refine": P.echoing(), "judge_metadata": P.echoing(0.5)}


@register("full_analysis")
def full_analysis(spark, d):
    """Every stage of the analysis, with models that follow rules."""
    settings = N.Settings(quotas={"story": 2, "reel": 4, "highlight": 2}, clips_per_hour=60, chunk=90_000, chunk_chars=2500)
    return N.staged(V.segments(spark, d), V.words(spark, d), V.sentences(spark, d), MODELS, settings)


@register("scout_replies", using("segments") + r""", p AS (SELECT *, seg % 3 < 2 AS timed, CASE WHEN seg % 3 < 2 THEN '[' || (s_ms // 1000) || '-' || (e_ms // 1000) || '] ' || text ELSE text END AS prompt, regexp_extract_all(text, '\p{L}{4,}') AS w FROM segments)
SELECT ep, seg, CASE WHEN timed THEN '{"moments": [{"end": ' || greatest(s_ms // 1000 + 1, e_ms // 1000) || ', "quote": "' || array_to_string(w[1:8], ' ') || '", "score": ' || (1 + length(prompt) % 10) || ', "start": ' || (s_ms // 1000) || ', "title": "' || array_to_string(w[1:3], ' ') || '"}]}' END AS reply, CASE WHEN NOT timed THEN 'no JSON in the answer' END AS error FROM p""")
def scout_replies(spark, d):
    """Each turn as a prompt; those of every third turn have no times, and their answers no JSON."""
    timed = F.concat(F.lit("["), F.floor(F.col("s_ms") / 1000).cast("string"), F.lit("-"), F.floor(F.col("e_ms") / 1000).cast("string"), F.lit("] "), F.col("text"))
    p = V.segments(spark, d).select("ep", "seg", F.when(F.col("seg") % 3 < 2, timed).otherwise(F.col("text")).alias("prompt"))
    return P.generate(p, P.rule_based).select("ep", "seg", "reply", "error")


def _fixes(seg):
    x = F.expr("CASE seg % 4 WHEN 0 THEN upper(text) WHEN 1 THEN concat(text, ' and then some more that nobody ever said here, all of it invented by a model') WHEN 2 THEN concat(text, '!') END")
    return seg.select("ep", "seg", x.alias("corrected")).filter("corrected IS NOT NULL")


@register("proofread_guard")
def proofread_guard(spark, d):
    seg = V.segments(spark, d)
    return proofread(seg, _fixes(seg))[0].select("ep", "seg", "verdict")


@register("proofread_counts")
def proofread_counts(spark, d):
    seg = V.segments(spark, d)
    return proofread(seg, _fixes(seg))[1]


@register("quote_verify")
def quote_verify(spark, d):
    """Every sentence as a quote, whole; those of every other turn are said a little later than the moment."""
    s = V.sentences(spark, d).select("ep", F.concat_ws("-", "ep", "seg", "pos").alias("row"), (F.col("s_ms") - F.col("seg") % 2 * 3000).alias("s"), (F.col("s_ms") + 2000).alias("e"), F.col("text").alias("quote"))
    return M.verified_quotes(s, V.words(spark, d), "ep", "row").select("row", "s", "e", "quote_match_ratio")


@register("spelling_variants", "WITH t AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS t FROM documents), v AS (SELECT t, k, left(t, k - 1) || m.b || substr(t, k + 1) AS v FROM (SELECT t, unnest(range(2, length(t) + 1)) AS k FROM t) JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in M.LATIN.items()) + ") m(a, b) ON substr(t, k, 1) = m.a), r AS (SELECT t, v, max(k) AS k FROM v GROUP BY ALL) SELECT t AS term, list(v ORDER BY k DESC)[1:24] AS variants FROM r GROUP BY t")
def spelling_variants(spark, d):
    t = V.table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("term")).select(F.lower("term").alias("term")).distinct()
    # whether a term has a variant shows without working them out
    some = F.col("term").rlike("(?s)^.+[" + "".join(M.SWAPS | M.LATIN) + "]")
    return t.filter(some).select("term", M.spelling_variants("term").alias("variants"))


#: Every word of six letters or more, with the documents that have it; of words of nine letters nothing is known.
_TERMS = "d AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS t FROM documents), n AS (SELECT t, count(*) AS hits FROM d GROUP BY t), v AS (SELECT t, k, left(t, k - 1) || m.b || substr(t, k + 1) AS v FROM (SELECT t, unnest(range(2, length(t) + 1)) AS k FROM n WHERE hits < 2 AND length(t) <> 9) JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in M.LATIN.items()) + ") m(a, b) ON substr(t, k, 1) = m.a), f AS (SELECT t, v, max(k) AS k FROM v GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY k DESC) AS pos FROM f), h AS (SELECT o.t, o.v, o.pos, coalesce(n.hits, 0) AS hits FROM o LEFT JOIN n ON n.t = o.v WHERE pos <= 24)"


@register("verify_terms", f"WITH {_TERMS}, b AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY hits DESC, pos) AS r FROM h) SELECT t AS wrong, v AS \"right\", 1 AS occurrences, hits FROM b WHERE r = 1 AND hits >= 5")
def verify_terms(spark, d):
    """Every word that only one document has, against the spelling of its like that most documents have."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0)), F.lower))
    n = V.table(spark, d, "documents").select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("hits"))
    asked = n.filter("hits < 2").select(F.explode(M.spelling_variants("term")).alias("term")).distinct().join(n, "term", "left_anti").withColumn("hits", F.lit(0).cast("long"))
    look = n.unionByName(asked).filter("length(term) <> 9")
    return M.verified_terms(n.filter("hits < 2").select("term", F.col("hits").alias("occurrences")), look, unknown=2)


@register("corpus_terms")
def corpus_terms(spark, d):
    return checked_terms(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@register("unique_names", using("segments") + ", n AS (SELECT ep, seg AS pos, 'id' || seg AS id, CASE WHEN seg % 3 = 0 THEN 'Ann' WHEN seg % 3 = 1 THEN 'bob' ELSE 'ANN ' END AS name FROM segments), r AS (SELECT *, row_number() OVER (PARTITION BY ep, lower(trim(name)) ORDER BY pos) AS r FROM n) SELECT ep, id, trim(name) AS name FROM r WHERE r = 1")
def unique_names(spark, d):
    n = V.segments(spark, d).select("ep", F.col("seg").alias("pos"), F.concat(F.lit("id"), F.col("seg").cast("string")).alias("id"), F.expr("CASE WHEN seg % 3 = 0 THEN 'Ann' WHEN seg % 3 = 1 THEN 'bob' ELSE 'ANN ' END AS name"))
    return M.unique_names(n, "ep")


_TRIED = f"""WITH p AS (SELECT lang AS ep, doc_id AS chunk, text AS source, unnest(['', CASE WHEN doc_id % 2 = 0 THEN text ELSE left(text, length(text) // 2) || ' Zzzzzz yyyyyy xxxxxx' END]) AS edited, unnest([1, 2]) AS try FROM documents),
s AS (SELECT *, {stems('source')} AS a, {stems('edited')} AS b FROM p),
r AS (SELECT *, CASE WHEN len(b) = 0 THEN 0.0 ELSE floor((len(b) - len(list_intersect(a, b))) / len(b) * 10000 + 0.5) / 10000 END AS novel, CASE WHEN len(a) = 0 THEN 1.0 ELSE floor(len(list_intersect(a, b)) / len(a) * 10000 + 0.5) / 10000 END AS cover, CASE WHEN length(trim(source)) = 0 THEN 0.0 ELSE floor(length(trim(edited)) / length(trim(source)) * 10000 + 0.5) / 10000 END AS part FROM s),
k AS (SELECT *, novel <= 0.08 AND cover >= 0.5 AND part BETWEEN 0.3 AND 1.1 AS ok FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY ep, chunk ORDER BY NOT ok, CASE WHEN ok THEN 0 ELSE novel END, try) AS n FROM k)
SELECT ep, chunk, try, ok AS faithful, novel FROM o WHERE n = 1"""


@register("article_retry", _TRIED)
def article_retry(spark, d):
    """The first try of each document is empty; the second is the text itself, or, for every other document, its first half and foreign words."""
    p = V.table(spark, d, "documents").select(F.col("lang").alias("ep"), F.col("doc_id").alias("chunk"), F.col("text").alias("source"))
    tries = F.array(F.struct(F.lit(1).alias("try"), F.lit("").alias("edited")), F.struct(F.lit(2).alias("try"), F.expr("CASE WHEN chunk % 2 = 0 THEN source ELSE concat(left(source, length(source) div 2), ' Zzzzzz yyyyyy xxxxxx') END").alias("edited")))
    return article(p.select("*", F.explode(tries).alias("t")).select("ep", "chunk", "source", "t.*")).select("ep", "chunk", "try", "faithful", "novel")


@register("srt_files", using("sentences") + ", n AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY seg, pos) AS n FROM sentences), t AS (SELECT *, " + ", ".join(f"printf('%02d:%02d:%02d,%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000) AS {n}" for c, n in (("s_ms", "a"), ("e_ms", "b"))) + " FROM n) SELECT ep, string_agg(n || chr(10) || a || ' --> ' || b || chr(10) || text || chr(10), chr(10) ORDER BY n) AS srt FROM t GROUP BY ep")
def srt_files(spark, d):
    return K.srt(V.sentences(spark, d), "ep", ["seg", "pos"])


@register("ass_files", using("words") + f""", c AS (SELECT ep, seg, min(s_ms) AS s, max(e_ms) AS e, string_agg('{{\\kf' || ((e_ms - s_ms) // 10) || '}}' || word, ' ' ORDER BY pos) AS t FROM words GROUP BY ep, seg),
l AS (SELECT ep, seg, 'Dialogue: 0,' || printf('%d:%02d:%02d.%02d', s // 3600000, s // 60000 % 60, s // 1000 % 60, s // 10 % 100) || ',' || printf('%d:%02d:%02d.%02d', e // 3600000, e // 60000 % 60, e // 1000 % 60, e // 10 % 100) || ',Default,,0,0,0,,' || t AS line FROM c)
SELECT ep, '{K.ASS_HEADER}' || string_agg(line, chr(10) ORDER BY seg) || chr(10) AS ass FROM l GROUP BY ep""")
def ass_files(spark, d):
    w = V.words(spark, d).groupBy("ep", "seg").agg(F.min("s_ms").alias("s_ms"), F.max("e_ms").alias("e_ms"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "s_ms", "e_ms", "word"))), lambda x: F.struct(x["s_ms"].alias("s_ms"), x["e_ms"].alias("e_ms"), x["word"].alias("word"))).alias("words"))
    return K.ass(w, "ep", ["seg"])


_HOOK = "trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(hook, '\\s+', ' ', 'g')), '(^|[^\\p{L}\\p{N}_])#[\\p{L}\\p{N}_]+', '\\1', 'g'), '\\s+([,.!?;:])', '\\1', 'g'), '\\s+', ' ', 'g'))"


@register("reel_documents", using("cards") + rf""", x AS (SELECT id, CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN '## ' || title ELSE title END AS t, quote, ['#a', '#b' || (id % 3)] AS tags, CASE WHEN score < 3 THEN ['score', 'short'] WHEN score < 4 THEN ['score'] ELSE [] END AS why, {_HOOK} AS h FROM cards),
y AS (SELECT *, coalesce(nullif(trim(regexp_replace(t, '\s+', ' ', 'g')), ''), 'reel_' || id) AS t2 FROM x), z AS (SELECT *, CASE WHEN t2 LIKE '#%' THEN coalesce(nullif(trim(regexp_replace(t2, '^#+', '')), ''), 'Reel') ELSE t2 END AS t3 FROM y)
SELECT id, '# ' || t3 || chr(10) || chr(10) || quote || chr(10) || chr(10) || array_to_string(tags, ' ') || chr(10) AS md, concat_ws(chr(10) || chr(10), CASE WHEN len(why) > 0 THEN '[ОТКЛОНЁН: ' || array_to_string(why, ', ') || ']' END, CASE WHEN h <> '' AND h <> quote THEN h END, quote, array_to_string(tags, ' ')) || chr(10) AS social FROM z""")
def reel_documents(spark, d):
    c = V.cards(spark, d).withColumn("tags", F.array(F.lit("#a"), F.concat(F.lit("#b"), (F.col("id") % 3).cast("string"))))
    why = F.expr("CASE WHEN score < 3 THEN array('score', 'short') WHEN score < 4 THEN array('score') ELSE array() END").cast("array<string>")
    title = F.expr("CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('## ', title) ELSE title END")
    label = F.concat(F.lit("reel_"), F.col("id").cast("string"))
    return c.select("id", K.reel_markdown(title, label, F.col("quote"), F.col("tags")).alias("md"), K.social_text(why, F.col("hook"), F.col("quote"), F.col("tags")).alias("social"))


_HMS = lambda c: f"CASE WHEN {c} >= 3600 THEN printf('%02d:%02d:%02d', {c} // 3600, {c} // 60 % 60, {c} % 60) ELSE printf('%02d:%02d', {c} // 60 % 60, {c} % 60) END"


@register("summary_markdown", using("moments") + f""", r AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY score DESC, s, id) AS rank FROM moments),
p AS (SELECT ep, rank, '## ' || rank || '. ' || title || ' [' || clip_type || ']' || chr(10) || 'Time: ' || {_HMS('s')} || '-' || {_HMS('e')} || chr(10) || 'Score: ' || score || '.0/10' || CASE WHEN id % 2 = 0 THEN ' (priority ' || score || '.50)' ELSE '' END || chr(10) || CASE WHEN id % 3 = 0 THEN 'Why: w' || id || chr(10) ELSE '' END || CASE WHEN id % 5 > 0 THEN 'Hook: h' || id || chr(10) ELSE '' END || chr(10) || 'id ' || id || chr(10) || chr(10) || '#x' AS part FROM r)
SELECT ep, '# Reels Suggestions' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY rank) || chr(10) AS markdown FROM p GROUP BY ep""")
def summary_markdown(spark, d):
    w = Window.partitionBy("ep").orderBy(F.desc("score"), "s", "id")
    r = V.moments(spark, d).withColumn("rank", F.row_number().over(w))
    text = lambda sql: F.expr(sql).cast("string")
    return K.summary_markdown(r.select("ep", "rank", "title", "clip_type", (F.col("s") * 1000).alias("s"), (F.col("e") * 1000).alias("e"), "score", F.expr("CASE WHEN id % 2 = 0 THEN score + 0.5D END").alias("priority"), text("CASE WHEN id % 3 = 0 THEN concat('w', id) END").alias("why"), text("CASE WHEN id % 5 > 0 THEN concat('h', id) ELSE '' END").alias("hook"), F.concat(F.lit("id "), F.col("id").cast("string")).alias("description"), F.array(F.lit("#x")).alias("tags")), "ep")


_ASS = lambda c: f"printf('%d:%02d:%02d.%02d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} // 10 % 100)"


@register("karaoke_blocks", using("words") + f""", k AS (SELECT *, (row_number() OVER (PARTITION BY ep ORDER BY seg, pos) - 1) // 5 AS block FROM words), c AS (SELECT ep, block, min(s_ms) AS s, max(e_ms) AS e, string_agg('{{\\kf' || ((e_ms - s_ms) // 10) || '}}' || word, ' ' ORDER BY seg, pos) AS t FROM k GROUP BY ep, block)
SELECT ep, '{K.ASS_HEADER}' || string_agg('Dialogue: 0,' || {_ASS('s')} || ',' || {_ASS('e')} || ',Default,,0,0,0,,' || t, chr(10) ORDER BY block) || chr(10) AS ass FROM c GROUP BY ep""".replace("\\\\", "\\"))
def karaoke_blocks(spark, d):
    """Karaoke of five words at a time."""
    w = Window.partitionBy("ep").orderBy("seg", "pos")
    k = V.words(spark, d).withColumn("block", F.floor((F.row_number().over(w) - 1) / 5))
    words = F.transform(F.array_sort(F.collect_list(F.struct("seg", "pos", "s_ms", "e_ms", "word"))), lambda x: F.struct(x["s_ms"].alias("s_ms"), x["e_ms"].alias("e_ms"), x["word"].alias("word")))
    return K.ass(k.groupBy("ep", "block").agg(F.min("s_ms").alias("s_ms"), F.max("e_ms").alias("e_ms"), words.alias("words")), "ep", ["block"])


@register("moments_json", using("moments") + """ SELECT ep, '[' || string_agg('{"id":' || id || ',"s":' || s || CASE WHEN id % 3 = 0 THEN '' ELSE ',"t":"' || title || '"' END || '}', ',' ORDER BY s, id) || ']' AS json FROM moments GROUP BY ep""")
def moments_json(spark, d):
    return K.json_lists(V.moments(spark, d).withColumn("t", F.when(F.col("id") % 3 != 0, F.col("title"))), "ep", ["s", "id"], ["id", "s", "t"])


@register("drawtext_filters", using("sentences") + r" SELECT ep, seg, pos, 'drawtext=text=''' || replace(replace(replace(replace(text, '\', '\\'), '''', '\'''), ':', '\:'), '%', '\%') || ''':enable=''between(t,' || (s_ms // 1000) || '.' || printf('%03d', s_ms % 1000) || ',' || (e_ms // 1000) || '.' || printf('%03d', e_ms % 1000) || ')''' AS filter FROM sentences")
def drawtext_filters(spark, d):
    return K.drawtext(V.sentences(spark, d), T.escape_filter("text")).select("ep", "seg", "pos", "filter")


@register("reel_index_join", using("moments") + ", m AS (SELECT ep, id, row_number() OVER (PARTITION BY ep ORDER BY score DESC, s, id) AS rank FROM moments), f AS (SELECT DISTINCT doc_id AS n, 'reel_' || doc_id || '.mp4' AS name FROM documents) SELECT f.name, m.ep, m.id FROM f JOIN m ON m.rank = f.n AND f.n > 0")
def reel_index_join(spark, d):
    w = Window.partitionBy("ep").orderBy(F.desc("score"), "s", "id")
    m = V.moments(spark, d).withColumn("rank", F.row_number().over(w)).select("rank", "ep", "id")
    f = V.table(spark, d, "documents").select(F.concat(F.lit("reel_"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("name")).distinct()
    return K.reels_to_moments(f, m, T.reel_index("name")).select("name", "ep", "id")


_TJ = """concat('{"duration":"9","segments":[{"start":', conv_id, ',"end":', conv_id + 9, ',"text":" seg ', turn, ' ","words":[{"start":1,"end":2,"word":"a"},{"start":"x","end":3,"word":"b"},{"start":4,"end":4,"word":" c "},{"start":5,"end":4,"word":"d"}]},{"start":3,"end":2,"text":"bad"}],"sentences":[', CASE WHEN turn % 2 = 0 THEN '{"start":1,"end":2,"text":"s"}' ELSE '{"start":2,"end":2,"text":"s"}' END, ']}')"""


_NUM = lambda x, k: f"TRY_CAST({x}->>'$.{k}' AS DOUBLE)"
_SPAN = lambda x: f"{_NUM(x, 'start')} >= 0 AND {_NUM(x, 'end')} > {_NUM(x, 'start')} AND trim({x}->>'$.text') <> ''"


@register("transcript_scan", f"""WITH r AS (SELECT conv_id * 100 + turn AS k, ({_TJ})::JSON AS j FROM conversations), w AS (SELECT k, unnest(json_extract(j, '$.segments[*].words[*]')) AS w FROM r),
n AS (SELECT k, count(*) AS words FROM w WHERE {_NUM('w', 'start')} >= 0 AND {_NUM('w', 'end')} >= {_NUM('w', 'start')} AND trim(w->>'$.word') <> '' GROUP BY k),
s AS (SELECT k, unnest(json_extract(j, '$.sentences[*]')) AS x FROM r), g AS (SELECT k, unnest(json_extract(j, '$.segments[*]')) AS x FROM r), v AS (SELECT k, x FROM s WHERE {_SPAN('x')}),
u AS (SELECT * FROM v UNION ALL SELECT k, x FROM g WHERE {_SPAN('x')} AND k NOT IN (SELECT k FROM v))
SELECT u.k, n.words, trim(x->>'$.text') AS first_sentence, {_NUM('x', 'start')} AS start FROM u JOIN n USING (k)""")
def transcript_scan(spark, d):
    raw = V.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.expr(_TJ).alias("json"))
    t = S.transcripts(raw)
    w = S.words(t, "k").groupBy("k").agg(F.count("*").alias("words"))
    return w.join(S.sentences(t, "k").select("k", F.col("text").alias("first_sentence"), "start"), "k")


_DJ = """concat('[{"start":1,"end":3,"speaker":" A "},{"start":"4","end":"6.5","speaker":"B"},{"start":5,"end":5,"speaker":"C"},{"end":5,"speaker":"D"},{"start":', turn, ',"end":9,"speaker":""}]')"""


@register("diarization_scan", f"""WITH r AS (SELECT conv_id * 100 + turn AS k, json_extract(({_DJ})::JSON, '$[*]') AS l FROM conversations), x AS (SELECT k, unnest(l) AS x, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos FROM r)
SELECT k, pos, {_NUM('x', 'start')} AS start, {_NUM('x', 'end')} AS "end", trim(x->>'$.speaker') AS speaker FROM x WHERE {_NUM('x', 'end')} > {_NUM('x', 'start')} AND trim(x->>'$.speaker') <> ''""")
def diarization_scan(spark, d):
    raw = V.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), F.expr(_DJ).alias("json"))
    return S.diarization(raw, "k")
