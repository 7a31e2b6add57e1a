"""Queries of the text expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scoring import bucket
from . import views as V
from .views import using

queries, oracles = {}, {}


def register(name, sql=None):
    def add(fn):
        queries[name] = fn
        if sql:
            oracles[name] = sql
        return fn

    return add


def tok(x):
    return f"regexp_extract_all(replace(lower({x}), 'ё', 'е'), '[\\p{{L}}\\p{{N}}]+')"


def stems(x):
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(replace(lower({x}), 'ё', 'е'), '\\p{{L}}+'), lambda t: length(t) >= 6), lambda t: left(t, 5)))"


def clean(x):
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@register("normalize_tokens", f"SELECT doc_id, len({tok('text')}) AS n, array_to_string({tok('text')}, ' ') AS norm FROM documents")
def normalize_tokens(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.size(T.tokens("text")).cast("long").alias("n"), T.normalised("text").alias("norm"))


@register("clean_text", f"SELECT doc_id, {clean('text')} AS cleaned, regexp_matches(text, '[А-Яа-яЁё]') AS cyrillic FROM documents")
def clean_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.clean("text").alias("cleaned"), T.cyrillic("text").alias("cyrillic"))


@register("transcript_sentences", using("sentences") + "SELECT * FROM sentences")
def transcript_sentences(spark, d):
    return V.sentences(spark, d)


@register("transcript_words", using("words") + "SELECT * FROM words")
def transcript_words(spark, d):
    return V.words(spark, d)


@register("sentences_without_quotes", f"""WITH s AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace({clean("replace(text, '.', '.»')")}, '([.!?…])["»”’)\\]]*\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) AS s FROM documents) SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS chars FROM s GROUP BY doc_id""")
def without_quotes(spark, d):
    s = V.table(spark, d, "documents").select("doc_id", F.explode(T.sentences_without_quotes(F.replace("text", F.lit("."), F.lit(".»")))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


_TOPIC = "list_distinct(list_filter(" + tok("title || ' ' || quote") + ", lambda t: length(t) >= 3))"
_JAC = "CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE floor(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) * 10000 + 0.5) / 10000 END"


@register("topic_jaccard", using("cards") + f", t AS (SELECT id, lang, {_TOPIC} AS x FROM cards), p AS (SELECT id, x, lead(id) OVER w AS other, lead(x) OVER w AS y FROM t WINDOW w AS (PARTITION BY lang, id % 16 ORDER BY id)) SELECT id, other, len(x) AS tokens, {_JAC} AS similarity FROM p WHERE other IS NOT NULL")
def topic_jaccard(spark, d):
    w = Window.partitionBy("lang", F.col("id") % 16).orderBy("id")
    t = V.cards(spark, d).select("id", "lang", T.topic_tokens("title", "quote").alias("x"))
    p = t.select("id", "x", F.lead("id").over(w).alias("other"), F.lead("x").over(w).alias("y")).filter("other IS NOT NULL")
    return p.select("id", "other", F.size("x").cast("long").alias("tokens"), T.jaccard(F.col("x"), F.col("y")).alias("similarity"))


_PAIRS = "p AS (SELECT doc_id, text AS source, lead(text) OVER w AS edited FROM documents WINDOW w AS (PARTITION BY lang, doc_id % 8 ORDER BY doc_id))"


@register("faithfulness", f"""WITH {_PAIRS}, s AS (SELECT doc_id, source, edited, {stems('source')} AS a, {stems('edited')} AS b FROM p WHERE edited IS NOT NULL),
r AS (SELECT doc_id, CASE WHEN len(b) = 0 THEN 0.0 ELSE floor((len(b) - len(list_intersect(a, b))) / len(b) * 10000 + 0.5) / 10000 END AS novel, CASE WHEN len(a) = 0 THEN 1.0 ELSE floor(len(list_intersect(a, b)) / len(a) * 10000 + 0.5) / 10000 END AS coverage, CASE WHEN length(trim(source)) = 0 THEN 0.0 ELSE floor(length(trim(edited)) / length(trim(source)) * 10000 + 0.5) / 10000 END AS length FROM s)
SELECT *, novel <= 0.08 AND coverage >= 0.5 AND length BETWEEN 0.3 AND 1.1 AS ok, list_filter([CASE WHEN novel > 0.08 THEN 'novel words' END, CASE WHEN coverage < 0.5 THEN 'low coverage' END, CASE WHEN length < 0.3 THEN 'too short' END, CASE WHEN length > 1.1 THEN 'too long' END], lambda x: x IS NOT NULL) AS reasons FROM r""")
def faithfulness(spark, d):
    """Each document against the next of its like. The stems are taken where a text lies; these are dealt, the texts are not."""
    w = Window.partitionBy("lang", F.col("doc_id") % 8).orderBy("doc_id")
    x = V.table(spark, d, "documents").select("lang", "doc_id", T.content_stems("text").alias("a"), T.said_length("text").alias("na"))
    p = x.select("doc_id", "a", "na", F.lead("a").over(w).alias("b"), F.lead("na").over(w).alias("nb")).filter("nb IS NOT NULL")
    return p.select("doc_id", T.stem_faithfulness(F.col("a"), F.col("b"), F.col("na"), F.col("nb")).alias("f")).select("doc_id", "f.*")


def _short(t, most):
    """SQL of a text already clean, cut like T.trimmed."""
    cut = f"rtrim(left({t}, {most - 3}))"
    space = f"length({cut}) - instr(reverse({cut}), ' ')"
    return f"CASE WHEN length({t}) <= {most} THEN {t} ELSE regexp_replace(CASE WHEN contains({cut}, ' ') AND {space} >= {int((most - 3) * 0.7)} THEN left({cut}, {space}) ELSE {cut} END, '[ ,;:.\\-]+$', '') || '...' END"


@register("trim_text", f"WITH c AS (SELECT doc_id, {clean('text')} AS t FROM documents) SELECT doc_id, {_short('t', 160)} AS short FROM c")
def trim_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.trimmed("text", 160).alias("short"))


_STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"


def _kw(x):
    return f"list_filter(regexp_extract_all(lower({x}), '{T.KEYWORD}'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN {_STOP})"


@register("keywords", f"SELECT doc_id, {_kw('text')} AS words FROM documents")
def keywords(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.keywords("text").alias("words"))


_FIELDS = tuple("title hook quote why".split())
_EDGE = r"[^\p{L}\p{N}_]"


def _nohash(x):
    return clean(rf"regexp_replace(regexp_replace({clean(x)}, '(^|{_EDGE})#[\p{{L}}\p{{N}}_]+', '\1', 'g'), '\s+([,.!?;:])', '\1', 'g')")


_SUBJECT = r"regexp_replace(coalesce(" + ", ".join(f"nullif(regexp_extract({f}_, '(?:^|{_EDGE})({p})(?:{_EDGE}|$)', 1), '')" for f in _FIELDS for p in T.TOPICS) + r", ''), '\s+', ' ', 'g')"
_PLAIN = "n AS (SELECT *, " + ", ".join(f"{_nohash(f)} AS {f}_" for f in (*_FIELDS, "caption")) + " FROM cards)"


@register("subject_phrase", using("cards") + f", {_PLAIN} SELECT id, {_SUBJECT} AS subject FROM n")
def subject_phrase(spark, d):
    return V.cards(spark, d).select("id", T.subject(*_FIELDS).alias("subject"))


#: Some captions have tags and vague phrases, some only these.
_CAPTION = "CASE id % 6 WHEN 1 THEN 'Смотрите этот фильм #tag , эту вещь: ' || caption WHEN 2 THEN '#only #tags' WHEN 3 THEN 'про эту игру и Эта Сцена, не этаж' ELSE caption END"
_VAGUE_CARDS = f"cards2 AS (SELECT * REPLACE ({_CAPTION} AS caption) FROM cards)"
_DESCRIBED = f"""n AS (SELECT *, {", ".join(f"{_nohash(f)} AS {f}_" for f in (*_FIELDS, "caption"))} FROM cards2),
s AS (SELECT *, {_SUBJECT} AS about, CASE WHEN caption_ <> '' THEN caption_ ELSE array_to_string(list_filter([hook_, title_, quote_, why_], lambda p: p <> ''), ' ') END AS base FROM n),
r AS (SELECT *, {clean(rf"CASE WHEN base = '' THEN 'Strong podcast moment.' WHEN about = '' THEN base ELSE regexp_replace(base, '(?i)(^|{_EDGE})(?:{T.VAGUE})($|{_EDGE})', '\1' || about || '\2', 'g') END")} AS t FROM s)"""


def _described(spark, d):
    return V.cards(spark, d).withColumn("caption", F.expr(_CAPTION))


@register("description", using("cards") + f", {_VAGUE_CARDS}, {_DESCRIBED} SELECT id, {_short('t', 1000)} AS description FROM r")
def description(spark, d):
    return _described(spark, d).select("id", T.description().alias("description"))


_BUCKET = "CASE WHEN lower(clip_type) LIKE '%story%' THEN 'story' WHEN lower(clip_type) LIKE '%highlight%' OR lower(clip_type) LIKE '%hot%' THEN 'highlight' WHEN lower(clip_type) LIKE '%long%' THEN 'long_reel' ELSE 'reel' END"
_TAGS = f"CASE {_BUCKET} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.TYPE_TAGS.items()) + " END"
_TAGGED = f"""g AS (SELECT *, CASE id % 3 WHEN 0 THEN [] WHEN 1 THEN ['Mixed', 'Tag'] ELSE [CAST(id AS VARCHAR)] END AS given, {_short('t', 1000)} AS shown FROM r),
l AS (SELECT id, list_concat(given, list_concat(list_concat(list_concat({_kw('shown')}, {_kw('caption_')}), list_concat({_kw('hook')}, {_kw('title')})), list_concat(list_concat({_kw('quote')}, {_kw('why')}), {_TAGS}))) AS raw FROM g),
u AS (SELECT id, unnest(raw) AS raw, generate_subscripts(raw, 1) AS k FROM l),
f AS (SELECT id, '#' || lower(regexp_replace(raw, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS tag, min(k) AS k FROM u GROUP BY ALL)"""


@register("hashtags", using("cards") + f", {_VAGUE_CARDS}, {_DESCRIBED}, {_TAGGED} SELECT id, list(tag ORDER BY k)[1:5] AS tags FROM f GROUP BY id")
def hashtags(spark, d):
    given = F.expr("CASE id % 3 WHEN 0 THEN array() WHEN 1 THEN array('##Mixed Tag!', '') ELSE array(concat('#', id)) END")
    c = _described(spark, d).withColumn("shown", T.description())
    return c.select("id", T.hashtags(given, ["shown", T.without_hashtags("caption"), "hook", "title", "quote", "why"], bucket()).alias("tags"))


@register("time_codes", using("segments") + """, m AS (SELECT ep, seg, s_ms * 7 - 999 AS raw, greatest(s_ms * 7 - 999, 0) AS m FROM segments)
SELECT ep, seg, printf('%02d:%02d:%02d,%03d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m % 1000) AS srt, printf('%d:%02d:%02d.%02d', m // 3600000, m // 60000 % 60, m // 1000 % 60, m // 10 % 100) AS ass, CASE WHEN m >= 3600000 THEN printf('%02d:%02d:%02d', m // 3600000, m // 60000 % 60, m // 1000 % 60) ELSE printf('%02d:%02d', m // 60000 % 60, m // 1000 % 60) END AS hms FROM m""")
def time_codes(spark, d):
    ms = F.col("s_ms") * 7 - 999
    return V.segments(spark, d).select("ep", "seg", T.srt_time(ms).alias("srt"), T.ass_time(ms).alias("ass"), T.hms(ms).alias("hms"))


@register("names_and_escapes", r"""WITH x AS (SELECT doc_id, source, 'out/reel_' || lpad(CAST(doc_id % 12 AS VARCHAR), 2, '0') || CASE WHEN doc_id % 3 = 0 THEN '_2' ELSE '' END || '.mp4' AS path, 'it''s 5% of a:b\' || doc_id AS t, 'My Model-' || (doc_id % 5) || ' (Q4)' AS model FROM documents)
SELECT doc_id, CASE WHEN doc_id % 12 > 0 THEN CAST(doc_id % 12 AS INT) END AS reel, replace(replace(replace(replace(t, '\', '\\'), '''', '\'''), ':', '\:'), '%', '\%') AS escaped, trim(regexp_replace(regexp_replace(lower(model), '[:./ ]', '_', 'g'), '[^\p{L}\p{N}_\-]+', '', 'g'), '_') AS folder, lower(regexp_replace(source, '[^\p{L}\p{N}]', '', 'g')) AS bare, CASE WHEN doc_id % 3 = 0 THEN 'en' WHEN doc_id % 3 = 1 THEN 'ru' ELSE 'ru' END AS prompt_lang, '&H' || upper(printf('%02x', CAST(floor((1 - (doc_id % 5)::DOUBLE / 4) * 255 + 0.5) AS BIGINT))) || '330A' || 'FF' AS color FROM x""")
def names_and_escapes(spark, d):
    x = V.table(spark, d, "documents").selectExpr("doc_id", "source", "concat('out/reel_', lpad(cast(doc_id % 12 as string), 2, '0'), CASE WHEN doc_id % 3 = 0 THEN '_2' ELSE '' END, '.mp4') AS path", r"concat('it\'s 5% of a:b\\', doc_id) AS t", "concat('My Model-', doc_id % 5, ' (Q4)') AS model")
    lang = F.expr("CASE doc_id % 3 WHEN 0 THEN 'en-US' WHEN 1 THEN 'ru' ELSE 'de' END")
    return x.select("doc_id", T.reel_index("path").alias("reel"), T.escape_filter("t").alias("escaped"), T.model_folder("model").alias("folder"), T.bare_word("source").alias("bare"), T.prompt_language(F.lit(None).cast("string"), lang).alias("prompt_lang"), T.color(F.lit("#FF0A33"), (F.col("doc_id") % 5).cast("double") / 4).alias("color"))


@register("render_prompt", using("segments") + r"SELECT ep, seg, '<start_of_turn>user' || chr(10) || 'Episode ' || ep || ': ' || text || ' by ' || speaker || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS prompt FROM segments")
def render_prompt(spark, d):
    p = T.render("Episode {ep}: {text} by {speaker}", {"ep": "ep", "speaker": "speaker", "text": "text"})
    return V.segments(spark, d).select("ep", "seg", T.wrapped_prompt(p, "turns").alias("prompt"))
