"""Queries of the interval joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from . import views as V
from .views import using

DAY = 86_400
queries, oracles = {}, {}


def register(name, sql=None):
    def add(fn):
        queries[name] = fn
        if sql:
            oracles[name] = sql
        return fn

    return add


def _match(a="p", b="g"):
    return f"2 * greatest(0, least({a}.e, {b}.e) - greatest({a}.s, {b}.s)) >= least({a}.e - {a}.s, {b}.e - {b}.s)"


@register(
    "golden_recall_precision",
    using("golden", "predicted")
    + f""", hit AS (SELECT g.ep, g.id, g.label, EXISTS (SELECT 1 FROM predicted p WHERE p.ep = g.ep AND {_match()}) AS h FROM golden g),
pre AS (SELECT p.ep, p.id, EXISTS (SELECT 1 FROM golden g WHERE p.ep = g.ep AND {_match()}) AS h FROM predicted p),
a AS (SELECT ep, count(*) AS golden, count(*) FILTER (WHERE h) AS hits, count(*) FILTER (WHERE label = 'must') AS must, count(*) FILTER (WHERE h AND label = 'must') AS must_hits FROM hit GROUP BY ep),
b AS (SELECT ep, count(*) AS predicted, count(*) FILTER (WHERE h) AS good FROM pre GROUP BY ep)
SELECT a.ep, golden, hits, must, must_hits, coalesce(predicted, 0) AS predicted, coalesce(good, 0) AS good, floor(hits / golden * 1000 + 0.5) / 1000 AS recall_all, CASE WHEN must = 0 THEN 1.0 ELSE floor(must_hits / must * 1000 + 0.5) / 1000 END AS recall_must, CASE WHEN coalesce(predicted, 0) = 0 THEN 0.0 ELSE floor(good / predicted * 1000 + 0.5) / 1000 END AS "precision" FROM a LEFT JOIN b USING (ep)""",
)
def golden_recall_precision(spark, d):
    """Recall over golden moments, also of those labelled must, and precision, by episode."""
    g, p = V.golden(spark, d), V.predicted(spark, d)
    must = F.col("label") == "must"
    pairs = I.overlap_join(g.select("ep", F.col("id").alias("gid"), "label", "s", "e"), p.select("ep", F.col("id").alias("pid"), F.col("s").alias("s2"), F.col("e").alias("e2")), "ep", DAY).filter(I.half_of_shorter())
    # the pairs are made once: a side's hits are its distinct ids in them
    hits = pairs.groupBy("ep").agg(F.count_distinct("gid").alias("hits"), F.count_distinct(F.when(must, F.col("gid"))).alias("must_hits"), F.count_distinct("pid").alias("good"))
    a = g.groupBy("ep").agg(F.count("*").alias("golden"), F.count_if(must).alias("must"))
    b = p.groupBy("ep").agg(F.count("*").alias("predicted")).join(hits, "ep", "left")
    x = a.join(b, "ep", "left").fillna(0, ["predicted", "good", "hits", "must_hits"])
    rate = lambda n, m, none: F.when(F.col(m) == 0, none).otherwise(F.floor(F.col(n) / F.col(m) * 1000 + 0.5) / 1000)
    return x.withColumns({"recall_all": rate("hits", "golden", 0.0), "recall_must": rate("must_hits", "must", 1.0), "precision": rate("good", "predicted", 0.0)})


def _in_out(spark, d):
    m = V.moments(spark, d)
    return m.filter("event_type IN ('view', 'error')"), m.filter("event_type IN ('purchase', 'click')")


_IO = using("moments") + ", outp AS (SELECT * FROM moments WHERE event_type IN ('view', 'error')), inp AS (SELECT * FROM moments WHERE event_type IN ('purchase', 'click'))"
_HIT = "EXISTS (SELECT 1 FROM inp i WHERE i.ep = o.ep AND least(i.e, o.e) - greatest(i.s, o.s) >= 3600)"


@register("interval_semi_guard", _IO + f" SELECT ep, id, s, e FROM outp o WHERE {_HIT}")
def interval_semi(spark, d):
    o, i = _in_out(spark, d)
    return I.overlap_semi(o, i, "ep", "id", DAY, 3600).select("ep", "id", "s", "e")


@register("interval_anti", _IO + f" SELECT ep, id, s, e FROM outp o WHERE NOT {_HIT}")
def interval_anti(spark, d):
    o, i = _in_out(spark, d)
    return I.overlap_semi(o, i, "ep", "id", DAY, 3600, anti=True).select("ep", "id", "s", "e")


@register("guard_fallback", _IO + f""", k AS (SELECT ep, id, s, e FROM outp o WHERE {_HIT.replace('3600', '150000')} OR NOT EXISTS (SELECT 1 FROM inp i WHERE i.ep = o.ep))
SELECT * FROM k UNION ALL SELECT ep, id, s, e FROM inp WHERE ep IN (SELECT ep FROM outp) AND ep NOT IN (SELECT ep FROM k)""")
def guard_fallback(spark, d):
    o, i = _in_out(spark, d)
    return I.guarded_semi(o, i, "ep", "id", DAY, 150_000).select("ep", "id", "s", "e")


@register("assign_speaker_max_overlap", using("predicted", "diarization") + """, c AS (SELECT p.id, d.speaker, row_number() OVER (PARTITION BY p.id ORDER BY least(p.e, d.e) - greatest(p.s, d.s) DESC, d.pos) AS r FROM predicted p JOIN diarization d ON p.ep = d.ep AND p.s < d.e AND d.s < p.e)
SELECT p.ep, p.id, c.speaker FROM predicted p LEFT JOIN c ON c.id = p.id AND r = 1""")
def assign_speaker(spark, d):
    return I.largest_overlap(V.predicted(spark, d), V.diarization(spark, d), "ep", "id", "speaker", DAY).select("ep", "id", "speaker")


_POINTS = ", q AS (SELECT ep, id, s AS t FROM moments WHERE event_type IN ('error', 'signup', 'purchase'))"


def _points(spark, d):
    return V.moments(spark, d).filter("event_type IN ('error', 'signup', 'purchase')").select("ep", "id", F.col("s").alias("t"))


@register("speaker_at_nearest", using("diarization") + _POINTS + """, c AS (SELECT q.id, d.speaker, row_number() OVER (PARTITION BY q.id ORDER BY CASE WHEN d.s <= q.t AND q.t <= d.e THEN 0 ELSE 1 END, CASE WHEN d.s <= q.t AND q.t <= d.e THEN 0 WHEN q.t < d.s THEN d.s - q.t ELSE q.t - d.e END, d.s, d.e, d.pos) AS r FROM q JOIN diarization d ON q.ep = d.ep)
SELECT q.ep, q.id, coalesce(c.speaker, '') AS speaker FROM q LEFT JOIN c ON c.id = q.id AND r = 1""")
def speaker_at(spark, d):
    return I.containing_or_nearest(_points(spark, d), V.diarization(spark, d), "ep", "id", "speaker").select("ep", "id", "speaker")


def _windows(spark, d):
    """A clip in each conversation: its middle fifth and a bit."""
    return V.segments(spark, d).groupBy("ep").agg(F.max("e_ms").alias("t")).select("ep", F.expr("t * 2 div 5").alias("s"), F.expr("t * 3 div 5 + 700").alias("e"))


_WIN = ", clip AS (SELECT ep, max(e_ms) * 2 // 5 AS s, max(e_ms) * 3 // 5 + 700 AS e FROM segments GROUP BY ep)"


@register("words_between", using("words") + _WIN + " SELECT c.ep, count(*) AS words, min(w.s_ms) AS first_ms, max(w.e_ms) AS last_ms, string_agg(word, ' ' ORDER BY w.s_ms, seg, pos) AS text FROM clip c JOIN words w ON w.ep = c.ep AND w.e_ms > c.s AND w.s_ms < c.e GROUP BY c.ep")
def words_between(spark, d):
    w = V.words(spark, d).select("ep", "seg", "pos", "word", F.col("s_ms").alias("s2"), F.col("e_ms").alias("e2"))
    x = I.overlap_join(_windows(spark, d), w, "ep", 30_000)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s2", "seg", "pos", "word"))), lambda y: y["word"]), " ")
    return x.groupBy("ep").agg(F.count("*").alias("words"), F.min("s2").alias("first_ms"), F.max("e2").alias("last_ms"), listed.alias("text"))


@register("words_midpoint", using("words", "sentences") + " SELECT s.ep, s.seg, s.pos, count(w.word) AS words, string_agg(w.word, '|' ORDER BY w.s_ms, w.seg, w.pos) AS text FROM sentences s LEFT JOIN words w ON w.ep = s.ep AND (w.s_ms + w.e_ms) BETWEEN 2 * s.s_ms AND 2 * s.e_ms GROUP BY ALL")
def words_midpoint(spark, d):
    """Words of each sentence by their midpoint, both ends included."""
    s = V.sentences(spark, d).select("ep", "seg", "pos", (F.col("s_ms") * 2).alias("s"), (F.col("e_ms") * 2).alias("e"))
    mid = F.col("s_ms") + F.col("e_ms")
    w = V.words(spark, d).select("ep", F.col("seg").alias("wseg"), F.col("pos").alias("wpos"), "word", mid.alias("s2"), mid.alias("e2"), "s_ms")
    x = I.overlap_join(s, w, "ep", 20_000, touch=True)
    got = x.groupBy("ep", "seg", "pos").agg(F.count("*").alias("words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_ms", "wseg", "wpos", "word"))), lambda y: y["word"]), "|").alias("text"))
    return s.select("ep", "seg", "pos").join(got, ["ep", "seg", "pos"], "left").fillna(0, ["words"])


@register("clip_slice", using("segments") + _WIN + " SELECT g.ep, g.seg, greatest(g.s_ms, c.s) - c.s AS s_ms, least(g.e_ms, c.e) - c.s AS e_ms FROM clip c JOIN segments g ON g.ep = c.ep AND g.s_ms < c.e AND c.s < g.e_ms WHERE least(g.e_ms, c.e) - greatest(g.s_ms, c.s) >= 50")
def clip_slice(spark, d):
    """Segments cut to a clip and counted from its start; under 0.05 s goes."""
    g = V.segments(spark, d).select("ep", "seg", F.col("s_ms").alias("s2"), F.col("e_ms").alias("e2"))
    x = I.overlap_join(_windows(spark, d), g, "ep", 60_000).filter(I.overlap() >= 50)
    return x.select("ep", "seg", (F.greatest("s2", "s") - F.col("s")).alias("s_ms"), (F.least("e2", "e") - F.col("s")).alias("e_ms"))


_T = ", q AS (SELECT ep, seg, s_ms + 911 * (seg + 1) AS t FROM segments)"


def _snap_points(spark, d):
    return V.segments(spark, d).select("ep", F.concat_ws("-", "ep", "seg").alias("row"), (F.col("s_ms") + 911 * (F.col("seg") + 1)).alias("t"))


def _snap_sql(a, cmp, fn, shift):
    one = lambda tbl, col: f"(SELECT {fn}(x.{col}) FROM {tbl} x WHERE x.ep = q.ep AND x.{col} {cmp} q.t AND abs(q.t - x.{col}) <= {shift})"
    return using("words", "sentences") + _T + f" SELECT q.ep || '-' || q.seg AS row, q.t, coalesce({one('sentences', a)}, {one('words', a)}, q.t) AS snapped FROM q"


@register("snap_start", _snap_sql("s_ms", "<=", "max", 3000))
def snap_start(spark, d):
    tiers = [V.sentences(spark, d), V.words(spark, d)]
    return I.snapped(_snap_points(spark, d), [t.select("ep", F.col("s_ms").alias("a")) for t in tiers], "ep", "row", 3000)


@register("snap_end", _snap_sql("e_ms", ">=", "min", 3000))
def snap_end(spark, d):
    tiers = [V.sentences(spark, d), V.words(spark, d)]
    return I.snapped(_snap_points(spark, d), [t.select("ep", F.col("e_ms").alias("a")) for t in tiers], "ep", "row", 3000, forward=True)


@register("snap_record_boundaries", using("sentences") + ", q AS (SELECT ep, seg, s_ms + 911 AS s, e_ms - 650 AS e FROM segments), x AS (SELECT *, coalesce((SELECT max(s_ms) FROM sentences t WHERE t.ep = q.ep AND s_ms <= q.s AND q.s - s_ms <= 3000), q.s) AS ns, coalesce((SELECT min(e_ms) FROM sentences t WHERE t.ep = q.ep AND e_ms >= q.e AND e_ms - q.e <= 3000), q.e) AS ne FROM q) SELECT ep, seg, CASE WHEN ne - ns >= 1000 THEN ns ELSE s END AS s, CASE WHEN ne - ns >= 1000 THEN ne ELSE e END AS e FROM x")
def snap_records(spark, d):
    """Both ends snapped, unless under a second would be left."""
    q = V.segments(spark, d).select("ep", "seg", F.concat_ws("-", "ep", "seg").alias("row"), (F.col("s_ms") + 911).alias("s"), (F.col("e_ms") - 650).alias("e"))
    t = V.sentences(spark, d)
    a = I.snapped(q.withColumn("t", F.col("s")), [t.select("ep", F.col("s_ms").alias("a"))], "ep", "row", 3000).select("row", F.col("snapped").alias("ns"))
    b = I.snapped(q.withColumn("t", F.col("e")), [t.select("ep", F.col("e_ms").alias("a"))], "ep", "row", 3000, forward=True).select("row", F.col("snapped").alias("ne"))
    ok = F.col("ne") - F.col("ns") >= 1000
    return q.join(a, "row").join(b, "row").select("ep", "seg", F.when(ok, F.col("ns")).otherwise(F.col("s")).alias("s"), F.when(ok, F.col("ne")).otherwise(F.col("e")).alias("e"))


@register("nearest_allowed", using("moments") + _POINTS + """, a AS (SELECT DISTINCT ep, s AS a FROM moments WHERE event_type = 'view'), c AS (SELECT q.id, a.a, row_number() OVER (PARTITION BY q.id ORDER BY abs(a.a - q.t), a.a) AS r FROM q JOIN a USING (ep))
SELECT q.id, q.t, CASE WHEN abs(c.a - q.t) <= 7200 THEN c.a ELSE q.t END AS nearest FROM q LEFT JOIN c ON c.id = q.id AND r = 1""")
def nearest_allowed(spark, d):
    a = V.moments(spark, d).filter("event_type = 'view'").select("ep", F.col("s").alias("a")).distinct()
    return I.nearest(_points(spark, d), a, "ep", "id", 7200)


@register("asof_anchor", using("moments") + _POINTS + " SELECT q.id, (SELECT max(s) FROM moments m WHERE m.ep = q.ep AND m.event_type = 'click' AND m.s <= q.t) AS anchor FROM q")
def asof_anchor(spark, d):
    return I.asof(_points(spark, d), V.moments(spark, d).filter("event_type = 'click'").select("ep", F.col("s").alias("a")), "ep", "id")


@register("normalize_duration", using("moments") + ", q AS (SELECT ep, id, s, e FROM moments) SELECT id, s, CASE WHEN e - s BETWEEN 3600 AND 36000 THEN e ELSE coalesce((SELECT min(m.e) FROM moments m WHERE m.ep = q.ep AND m.event_type = 'view' AND m.e BETWEEN q.s + 3600 AND q.s + 36000), e) END AS e FROM q")
def normalize_duration(spark, d):
    """Where a length is out of bounds, the first allowed end that makes it fit."""
    q = V.moments(spark, d).select("ep", "id", "s", "e")
    ends = V.moments(spark, d).filter("event_type = 'view'").select("ep", F.col("e").alias("a"))
    f = I.asof(q.withColumn("t", F.col("s") + 3600), ends, "ep", "id", forward=True)
    fits = (F.col("e") - F.col("s")).between(3600, 36000)
    return q.join(f, "id").select("id", "s", F.when(fits | ~F.coalesce(F.col("anchor") <= F.col("s") + 36000, F.lit(False)), F.col("e")).otherwise(F.col("anchor")).alias("e"))


@register("clamp_window", using("moments") + ", w AS (SELECT *, ep * 3600 AS lo, ep * 3600 + 1500000 AS hi FROM moments), c AS (SELECT ep, id, least(greatest(s, lo), hi) AS s, least(greatest(e, lo), hi) AS e FROM w WHERE NOT (e <= lo - 3600 OR s >= hi + 3600)) SELECT * FROM c WHERE e - s >= 60")
def clamp_window(spark, d):
    lo = F.col("ep") * 3600
    return I.clamped(V.moments(spark, d), lo, lo + 1_500_000, 3600, 60).select("ep", "id", "s", "e")


@register("clamp_episode", using("moments") + ", l AS (SELECT ep, max(s) - 90000 AS d FROM moments GROUP BY ep), c AS (SELECT ep, id, greatest(0, s) AS s, least(e, d) AS e FROM moments JOIN l USING (ep) WHERE d > 0 AND s < d) SELECT * FROM c WHERE e - s >= 1 UNION ALL SELECT ep, id, s, e FROM moments JOIN l USING (ep) WHERE d <= 0")
def clamp_episode(spark, d):
    m = V.moments(spark, d)
    x = m.join(m.groupBy("ep").agg((F.max("s") - 90000).alias("d")), "ep")
    cut = x.filter("d > 0 AND s < d").select("ep", "id", F.greatest(F.lit(0), "s").alias("s"), F.least("e", "d").alias("e")).filter("e - s >= 1")
    return cut.unionByName(x.filter("d <= 0").select("ep", "id", "s", "e"))


@register("speech_rate", using("words") + _WIN + " SELECT c.ep, count(*) AS words, c.e - c.s AS span_ms, floor(count(*)::DOUBLE * 1000 / (c.e - c.s) * 10000 + 0.5) / 10000 AS rate FROM clip c JOIN words w ON w.ep = c.ep AND w.e_ms > c.s AND w.s_ms < c.e GROUP BY c.ep, c.s, c.e")
def speech_rate(spark, d):
    w = V.words(spark, d).select("ep", F.col("s_ms").alias("s2"), F.col("e_ms").alias("e2"))
    x = I.overlap_join(_windows(spark, d), w, "ep", 30_000).groupBy("ep", "s", "e").agg(F.count("*").alias("words"))
    return x.select("ep", "words", (F.col("e") - F.col("s")).alias("span_ms"), (F.floor(F.col("words").cast("double") * 1000 / (F.col("e") - F.col("s")) * 10000 + 0.5) / 10000).alias("rate"))


@register("interval_pairs", using("moments") + " SELECT a.id AS a, b.id AS b, least(a.e, b.e) - greatest(a.s, b.s) AS shared, floor((least(a.e, b.e) - greatest(a.s, b.s)) / greatest(a.e - a.s, b.e - b.s) * 10000 + 0.5) / 10000 AS share FROM moments a JOIN moments b ON a.ep = b.ep AND a.id < b.id AND a.s < b.e AND b.s < a.e")
def interval_pairs(spark, d):
    m = V.moments(spark, d)
    x = I.overlap_join(m.select("ep", F.col("id").alias("a"), "s", "e"), m.select("ep", F.col("id").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2")), "ep", DAY).filter("a < b")
    return x.select("a", "b", I.overlap().alias("shared"), (F.floor(I.share_of_longer() * 10000 + 0.5) / 10000).alias("share"))
