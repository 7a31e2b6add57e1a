"""Queries of the aggregates and of schema on read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import semistructured as J
from ..operators import aggregates as A
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


_MIX = dict(story=2, reel=3, long_reel=1, highlight=5)


@register("quota_apportion", """WITH e AS (SELECT DISTINCT 60 + event_id * 7 % 36000 AS sec FROM events), t AS (SELECT sec, greatest(1, CAST(round_even(sec::DOUBLE * 11 / 3600, 0) AS BIGINT)) AS total FROM e),
m AS (SELECT * FROM (VALUES (0, 'story', 2), (1, 'reel', 3), (2, 'long_reel', 1), (3, 'highlight', 5)) v(pos, kind, n)), x AS (SELECT sec, total, pos, kind, total * n // 11 AS f, total * n % 11 AS r FROM t, m),
y AS (SELECT *, row_number() OVER (PARTITION BY sec ORDER BY r DESC, pos) AS k, total - sum(f) OVER (PARTITION BY sec) AS spare FROM x) SELECT sec, kind, CAST(f + CASE WHEN k <= spare THEN 1 ELSE 0 END AS BIGINT) AS clips FROM y""")
def quota_apportion(spark, d):
    sec = V.table(spark, d, "events").select((60 + F.col("event_id") * 7 % 36000).alias("sec")).distinct()
    return sec.select("sec", F.explode(A.apportioned(_MIX, F.col("sec"), 11)).alias("kind", "clips"))


_VAR = ", v AS (SELECT *, 'v' || (id % 3) AS variant FROM moments)"


def _variants(spark, d):
    return V.moments(spark, d).withColumn("variant", F.concat(F.lit("v"), F.col("id") % 3))


@register("variant_metrics", using("moments") + _VAR + " SELECT variant, count(*) AS moments, floor(sum(score)::DOUBLE / count(*) * 1000 + 0.5) / 1000 AS avg_score, floor(sum(e - s)::DOUBLE / count(*) * 1000 + 0.5) / 1000 AS avg_duration, count(*) FILTER (WHERE NOT e - s BETWEEN 600 AND 72000) AS violations FROM v GROUP BY variant")
def variant_metrics(spark, d):
    return A.variant_metrics(_variants(spark, d), 600, 72_000)


@register("variant_stability", using("moments") + _VAR + ", c AS (SELECT DISTINCT ep, variant, s // 86400 AS x, e // 86400 AS y FROM v), n AS (SELECT ep, variant, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT a.ep, a.variant AS a, b.variant AS b, count(*) AS k FROM c a JOIN c b ON a.ep = b.ep AND a.x = b.x AND a.y = b.y GROUP BY ALL) SELECT p.ep, p.variant AS a, q.variant AS b, floor(coalesce(k, 0) / (p.n + q.n - coalesce(k, 0)) * 10000 + 0.5) / 10000 AS jaccard FROM n p JOIN n q ON p.ep = q.ep LEFT JOIN k ON k.ep = p.ep AND k.a = p.variant AND k.b = q.variant")
def variant_stability(spark, d):
    return A.stability(_variants(spark, d), 86_400)


@register("stability_pivot", "WITH v AS (SELECT user_id AS ep, event_type AS kind, 'v' || (event_id % 3) AS variant FROM events) SELECT variant, count(*) FILTER (WHERE kind = 'click') AS click, count(*) FILTER (WHERE kind = 'error') AS error, count(*) FILTER (WHERE kind = 'purchase') AS purchase, count(*) FILTER (WHERE kind = 'signup') AS signup, count(*) FILTER (WHERE kind = 'view') AS view FROM v GROUP BY variant")
def stability_pivot(spark, d):
    v = V.table(spark, d, "events").select(F.concat(F.lit("v"), F.col("event_id") % 3).alias("variant"), "event_type")
    return v.groupBy("variant").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).count()


@register("best_variant", using("moments") + _VAR + ", g AS (SELECT ep, variant, count(*) AS n, sum(score) AS total FROM v GROUP BY ALL) SELECT ep, arg_max(variant, total * 1000 + n * 10 + (2 - CAST(right(variant, 1) AS INT))) AS variant, max(total) AS total FROM g GROUP BY ep")
def best_variant(spark, d):
    g = _variants(spark, d).groupBy("ep", "variant").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
    order = F.col("total") * 1000 + F.col("n") * 10 + (2 - F.right("variant", F.lit(1)).cast("int"))
    return g.groupBy("ep").agg(F.max_by("variant", order).alias("variant"), F.max("total").alias("total"))


@register("latest_per_key", "SELECT o_custkey AS cust, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, arg_max(floor(o_totalprice * 100 + 0.5)::BIGINT, (o_orderdate, o_orderkey)) AS cents FROM orders GROUP BY o_custkey")
def latest_per_key(spark, d):
    o = V.table(spark, d, "orders").withColumn("cents", F.floor(F.col("o_totalprice") * 100 + 0.5)).withColumnRenamed("o_custkey", "cust")
    return A.latest_by(o, "cust", F.struct("o_orderdate", "o_orderkey"), "o_orderkey", "o_orderstatus", "cents")


#: Openers of sentences and lines are marked, then the capitalised words that are not marked are taken out.
_CAPS = r"""w AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?…\n]\s)([А-ЯЁA-Z])', '\1' || chr(1) || '\2', 'g'), '(?m)^([А-ЯЁA-Z])', chr(1) || '\1', 'g') AS t FROM documents),
m AS (SELECT doc_id, regexp_extract_all(t, '(?:^|[^\p{L}\p{N}_\x01])[А-ЯЁA-Z][а-яёa-z]{3,}[\p{L}\p{N}_]*') AS ws FROM w),
x AS (SELECT doc_id, unnest(ws) AS raw, generate_subscripts(ws, 1) AS pos FROM m),
c AS (SELECT doc_id, pos, regexp_extract(raw, '[\p{L}\p{N}_]+') AS word FROM x WHERE regexp_full_match(regexp_extract(raw, '[\p{L}\p{N}_]+'), '[А-ЯЁA-Z][а-яёa-z]{3,}'))"""


@register("suspect_terms", f"WITH {_CAPS}, g AS (SELECT doc_id, left(lower(word), 6) AS stem, count(*) AS occurrences, min(length(word)) AS least, arg_min(word, length(word) * 1000000 + pos) AS term FROM c GROUP BY ALL) SELECT doc_id, stem, occurrences, term FROM g WHERE occurrences >= 2 AND least >= 6")
def suspect_terms(spark, d):
    return A.suspect_terms(V.table(spark, d, "documents"), "doc_id")


@register("collocates", r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]') AS w FROM documents), p AS (SELECT doc_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM t),
n AS (SELECT doc_id, left(lower(b), 6) AS stem, a AS neighbour, count(*) AS n FROM p WHERE regexp_full_match(a, '\p{Lu}\p{Ll}{3,}') AND regexp_full_match(b, '\p{Lu}\p{Ll}{3,}') AND left(lower(a), 6) <> left(lower(b), 6) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, stem ORDER BY n DESC, neighbour) AS r FROM n) SELECT doc_id, stem, neighbour, n FROM r WHERE r = 1""")
def collocates(spark, d):
    return A.collocates(V.table(spark, d, "documents"), "doc_id")


@register("distinct_first_seen", using("segments") + ", s AS (SELECT ep, speaker, min(seg) AS first FROM segments WHERE trim(speaker) <> '' GROUP BY ALL) SELECT ep, list(speaker ORDER BY first) AS speakers FROM s GROUP BY ep")
def distinct_first_seen(spark, d):
    s = V.segments(spark, d).filter("trim(speaker) <> ''").groupBy("ep", "speaker").agg(F.min("seg").alias("first"))
    return s.groupBy("ep").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "speaker"))), lambda x: x["speaker"]).alias("speakers"))


_LOG = "concat('[x] silence_start: ', event_id % 50, chr(10), CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('silence_end: 9 | silence_duration: ', event_id % 40, '.5', chr(10)) END, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('mean_volume: -', event_id % 33, '.25 dB', chr(10), 'max_volume: -', event_id % 5, ' dB') END)"
_LOGS = f"CASE WHEN event_id % 7 = 0 THEN substr({_LOG}, 1, 0) WHEN event_id % 5 = 0 THEN 'mean_volume: -20.5 dB' ELSE {_LOG} END"


@register("probe_logs", f"""WITH l AS (SELECT event_id AS id, {_LOGS} AS log, 60.0::DOUBLE AS span FROM events), n AS (SELECT *, regexp_extract_all(log, 'silence_start: (-?[0-9.]+)', 1) AS b, regexp_extract_all(log, 'silence_duration: ([0-9.]+)', 1) AS k FROM l),
r AS (SELECT *, coalesce(list_sum(list_transform(k, lambda x: x::DOUBLE)), 0) + CASE WHEN len(b) > len(k) THEN greatest(0, span - b[-1]::DOUBLE) ELSE 0 END AS quiet FROM n)
SELECT id, CASE WHEN len(b) + len(k) > 0 THEN floor(least(1.0, quiet / span) * 10000 + 0.5) / 10000 WHEN contains(log, 'mean_volume:') THEN 0.0 END AS silence, TRY_CAST(nullif(regexp_extract(log, 'mean_volume: (-?[0-9.]+) dB', 1), '') AS DOUBLE) AS mean_db, TRY_CAST(nullif(regexp_extract(log, 'max_volume: (-?[0-9.]+) dB', 1), '') AS DOUBLE) AS max_db FROM r""")
def probe_logs(spark, d):
    logs = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr(_LOGS).alias("log"))
    return logs.select("id", A.silence_ratio("log", F.lit(60.0)).alias("silence"), A.volume("log").alias("mean_db"), A.volume("log", "max").alias("max_db"))


@register("model_scores", "WITH x AS (SELECT event_type AS model, value / CASE event_id % 3 WHEN 0 THEN 400 WHEN 1 THEN 40 ELSE 4 END AS v, floor(value * 100)::BIGINT AS ms FROM events), y AS (SELECT model, ms, CASE WHEN v > 0 THEN CASE WHEN v <= 1 THEN v * 10 WHEN v > 10 THEN least(v / 10, 10) ELSE v END END AS z FROM x) SELECT model, count(z) AS n, sum(CAST(floor(z * 100) AS BIGINT))::BIGINT AS total, max(ms) AS slowest FROM y GROUP BY model")
def model_scores(spark, d):
    v = F.col("value") / F.expr("CASE event_id % 3 WHEN 0 THEN 400 WHEN 1 THEN 40 ELSE 4 END")
    y = V.table(spark, d, "events").select(F.col("event_type").alias("model"), A.scaled_score(v).alias("z"), F.floor(F.col("value") * 100).alias("ms"))
    return y.groupBy("model").agg(F.count("z").alias("n"), F.sum(F.floor(F.col("z") * 100)).alias("total"), F.max("ms").alias("slowest"))


@register("upper_median", "SELECT user_id AS ep, list(event_id ORDER BY event_id)[count(*) // 2 + 1] AS middle, count(*) AS n FROM events GROUP BY user_id")
def upper_median(spark, d):
    return V.table(spark, d, "events").groupBy(F.col("user_id").alias("ep")).agg(A.upper_median(F.col("event_id")).alias("middle"), F.count("*").alias("n"))


@register("quality_filter_reasons", using("moments") + ", r AS (SELECT ep, id, list_filter([CASE WHEN score < 4 THEN 'score ' || score || ' < 4' END, CASE WHEN e - s < 3600 THEN 'short ' || (e - s) END, CASE WHEN e - s > 90000 THEN 'long ' || (e - s) END], lambda x: x IS NOT NULL) AS reasons FROM moments) SELECT *, len(reasons) > 0 AS is_rejected FROM r")
def quality_filter(spark, d):
    n = F.col("e") - F.col("s")
    reasons = F.array_compact(F.array(F.when(F.col("score") < 4, F.concat(F.lit("score "), F.col("score").cast("string"), F.lit(" < 4"))), F.when(n < 3600, F.concat(F.lit("short "), n.cast("string"))), F.when(n > 90_000, F.concat(F.lit("long "), n.cast("string")))))
    return V.moments(spark, d).select("ep", "id", reasons.alias("reasons")).withColumn("is_rejected", F.size("reasons") > 0)


_RAW = """CASE event_id % 7 WHEN 0 THEN concat('{"start":', event_id, ',"end":"', event_id + 30, '.5","title":" T ","k":"v', event_id % 3, '","hook":" h","speaker":"A ","judge_score":"7","priority":"x","source_chunk_ids":["c', event_id % 4, '"," "],"hashtags":["a",""," b"]}') WHEN 1 THEN concat('{"start":"x","end":5,"title":"t"}') WHEN 2 THEN concat('{"start":9,"end":', event_id % 20, ',"quote":"q"}') WHEN 3 THEN '{"start":1,"end":2}' WHEN 4 THEN concat('{"start":1,"end":4,"why":"w","score":"', event_id % 9, '","clip_type":"story","hashtags":"no"}') WHEN 5 THEN concat('{"end":', event_id % 3, ',"why":"only","speaker_confidence":0.', event_id % 9, '}') ELSE 'not json' END"""


@register("coerce_moments", f"""WITH r AS (SELECT event_id AS id, {_RAW} AS raw FROM events), j AS (SELECT id, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM r),
m AS (SELECT id, j, CASE WHEN (j->'$.start') IS NULL THEN 0 ELSE TRY_CAST(j->>'$.start' AS DOUBLE) END AS s, TRY_CAST(j->>'$.end' AS DOUBLE) AS e, trim(coalesce(j->>'$.title', '')) AS title, trim(coalesce(j->>'$.quote', '')) AS quote, trim(coalesce(j->>'$.why', '')) AS why FROM j)
SELECT id, s AS start, e AS "end", title, quote, why, coalesce(TRY_CAST(j->>'$.score' AS DOUBLE), 0) AS score, coalesce(nullif(trim(j->>'$.clip_type'), ''), 'reel') AS clip_type, coalesce(len(list_filter(TRY_CAST(j->'$.hashtags' AS VARCHAR[]), lambda t: trim(t) <> '')), 0)::BIGINT AS tags, j->>'$.k' AS k,
 trim(coalesce(j->>'$.hook', '')) AS hook, trim(coalesce(j->>'$.speaker', '')) AS speaker, TRY_CAST(j->>'$.judge_score' AS DOUBLE) AS judge_score, TRY_CAST(j->>'$.priority' AS DOUBLE) AS priority, TRY_CAST(j->>'$.speaker_confidence' AS DOUBLE) AS speaker_confidence, coalesce(list_filter(list_transform(TRY_CAST(j->'$.source_chunk_ids' AS VARCHAR[]), lambda t: trim(t)), lambda t: length(t) > 0), []) AS source_chunk_ids, 'scout' AS selection_stage
FROM m WHERE s IS NOT NULL AND e > s AND (title <> '' OR quote <> '' OR why <> '')""")
def coerce_moments(spark, d):
    r = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr(_RAW).alias("raw"))
    m = r.select("id", F.explode(J.stamped(F.concat(F.lit("["), "raw", F.lit("]")), "scout")).alias("m"))
    return m.select("id", "m.start", "m.end", "m.title", "m.quote", "m.why", "m.score", "m.clip_type", F.size("m.hashtags").cast("long").alias("tags"), F.col("m.extra")["k"].alias("k"), "m.hook", "m.speaker", "m.judge_score", "m.priority", "m.speaker_confidence", "m.source_chunk_ids", "m.selection_stage")


_REPLY = """CASE event_id % 5 WHEN 0 THEN concat('[', props, ',', props, ']') WHEN 1 THEN concat('{"moments":[', props, ']}') WHEN 2 THEN concat('{"moment":', props, '}') WHEN 3 THEN concat('{"x":1,"clips":[', props, ',', props, ',', props, ']}') ELSE '{"none":true}' END"""


@register("json_payload_items", f"""WITH r AS (SELECT event_id AS id, {_REPLY} AS raw FROM events), i AS (SELECT id, unnest(CASE id % 5 WHEN 0 THEN (raw::JSON->'$[*].k') WHEN 1 THEN (raw::JSON->'$.moments[*].k') WHEN 2 THEN [raw::JSON->'$.moment.k'] WHEN 3 THEN (raw::JSON->'$.clips[*].k') ELSE [] END) AS k FROM r) SELECT id, count(*) AS items, sum(k::BIGINT)::BIGINT AS k FROM i GROUP BY id""")
def json_payload_items(spark, d):
    r = V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.explode(J.payload_items(F.expr(_REPLY))).alias("j"))
    return r.groupBy("id").agg(F.count("*").alias("items"), F.sum(F.get_json_object("j", "$.k").cast("long")).alias("k"))


_FIX = """CASE event_id % 3 WHEN 0 THEN concat('[{"id":1,"text":"a', event_id % 5, '"},{"id":"2","text":"b"},{"id":1,"text":"c', event_id % 7, '"}]') WHEN 1 THEN concat('{"segments":[{"id":"x","text":"q"},{"id":7,"text":"  "},{"id":8,"text":" ok"}]}') ELSE 'bad' END"""


@register("corrections", f"""WITH r AS (SELECT event_id AS id, {_FIX} AS raw FROM events), j AS (SELECT id, raw::JSON AS j FROM r WHERE json_valid(raw)), l AS (SELECT id, json_extract(CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE j->'$.segments' END, '$[*]') AS l FROM j),
x AS (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM l), g AS (SELECT id, TRY_CAST(x->>'$.id' AS INT) AS seg, trim(x->>'$.text') AS text, pos FROM x) SELECT id, seg, arg_max(text, pos) AS text FROM g WHERE seg IS NOT NULL AND text <> '' GROUP BY id, seg""")
def corrections(spark, d):
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), F.explode(J.corrections(F.expr(_FIX))).alias("seg", "text"))


@register("layered_config", "WITH c AS (SELECT event_id AS id, map_concat(MAP {'temp': '1', 'n': '3'}, MAP {'model': 'm' || (event_id % 2), 'n': '5'}, CASE WHEN event_id % 3 = 0 THEN MAP {'temp': '9'} ELSE MAP {'x': ''} END) AS m FROM events) SELECT id, m['model'] AS model, m['temp'] AS temp, m['n'] AS n FROM c")
def layered_config(spark, d):
    m = lambda *kv: F.create_map(*map(F.lit, kv))
    top = F.when(F.col("event_id") % 3 == 0, m("temp", "9"))
    c = J.merged_maps(m("temp", "1", "n", "3"), F.create_map(F.lit("model"), F.concat(F.lit("m"), F.col("event_id") % 2), F.lit("n"), F.lit("5")), top)
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), c["model"].alias("model"), c["temp"].alias("temp"), c["n"].alias("n"))


_CUT = """CASE event_id % 4 WHEN 0 THEN concat('Sure! Here: ```json', chr(10), '{"a":', event_id, ',"b":[1,2,{"c":"x') WHEN 1 THEN props WHEN 2 THEN concat('text [', event_id, ', 2, "y"] and more') ELSE 'no value at all' END"""


@register("json_salvage")
def json_salvage(spark, d):
    return V.table(spark, d, "events").select(F.col("event_id").alias("id"), J.json_value(F.expr(_CUT)).alias("value"))


@register("markdown_sections")
def markdown_sections(spark, d):
    md = F.concat(F.lit("# "), F.substring("text", 1, 20), F.lit("\n\n"), F.col("text"), F.lit("\n\n## Empty\n\n## Next\n\n{\"x\": 1}\n\n"), F.substring("text", 30, 60))
    return V.table(spark, d, "documents").select("doc_id", F.posexplode(J.sections(md)).alias("pos", "s")).select("doc_id", "pos", "s.title", F.size("s.paragraphs").alias("paragraphs"))


_CLIPS_CONF = """CASE event_id % 4 WHEN 0 THEN concat('{"clips":{"stories":{"count":', event_id % 5, '},"reels":{"count":', event_id % 3 - 1, '},"highlights":{"moments_count":', event_id % 6, '}}}') WHEN 1 THEN concat('{"clips":{"reels":{"count":', event_id % 7, '}},"reels_count":', event_id % 9 + 1, '}') WHEN 2 THEN '{"clips":5}' ELSE concat('{"reels_count":', event_id % 4 + 2, ',"clips":{"long_reels":{"count":"', event_id % 5, '"}}}') END"""


@register("requested_quotas", f"WITH j AS (SELECT event_id AS id, ({_CLIPS_CONF})::JSON AS j FROM events) SELECT id, coalesce(TRY_CAST(j->>'$.clips.stories.count' AS BIGINT), 0) AS story, CASE WHEN coalesce(TRY_CAST(j->>'$.clips.reels.count' AS BIGINT), 0) > 0 THEN TRY_CAST(j->>'$.clips.reels.count' AS BIGINT) ELSE coalesce(TRY_CAST(j->>'$.reels_count' AS BIGINT), 4) END AS reel, coalesce(TRY_CAST(j->>'$.clips.long_reels.count' AS BIGINT), 0) AS long_reel, coalesce(TRY_CAST(j->>'$.clips.highlights.moments_count' AS BIGINT), 0) AS highlight FROM j")
def requested_quotas(spark, d):
    q = V.table(spark, d, "events").select(F.col("event_id").alias("id"), C.requested_quotas(F.expr(_CLIPS_CONF)).alias("q"))
    return q.select("id", *[F.col("q")[k].alias(k) for k in ("story", "reel", "long_reel", "highlight")])
