"""Queries of the order-dependent operators and of selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds as O
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


_SEG = ", x AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY seg) AS k FROM segments)"


def _next_fit_sql(views, rows, cost, budget, cols, most=None):
    more = f" OR f.n >= {most}" if most else ""
    return using(*views, recursive=True) + rows + f""", f AS (SELECT ep, k, 0 AS bin, {cost} AS load, 1 AS n FROM x WHERE k = 1
UNION ALL SELECT x.ep, x.k, CASE WHEN f.load + {cost} > {budget}{more} THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.load + {cost} > {budget}{more} THEN {cost} ELSE f.load + {cost} END, CASE WHEN f.load + {cost} > {budget}{more} THEN 1 ELSE f.n + 1 END FROM f JOIN x ON x.ep = f.ep AND x.k = f.k + 1)
SELECT f.ep, {cols}, CAST(f.bin AS BIGINT) AS bin, CAST(f.load AS BIGINT) AS load FROM f JOIN x ON x.ep = f.ep AND x.k = f.k"""


@register("char_budget_batches", _next_fit_sql(["segments"], _SEG, "length(x.text)", 1200, "x.seg"))
def char_budget(spark, d):
    return O.per_key(V.segments(spark, d), "ep", ["seg"], lambda r: O.next_fit(r, lambda x: len(x["text"]), 1200), "seg long, bin long, load long")


@register("turn_batches", _next_fit_sql(["segments"], _SEG, "(length(x.speaker) + 2 + length(x.text) + 1)", 1500, "x.seg"))
def turn_batches(spark, d):
    return O.per_key(V.segments(spark, d), "ep", ["seg"], lambda r: O.next_fit(r, lambda x: len(x["speaker"]) + len(x["text"]) + 3, 1500), "seg long, bin long, load long")


@register("word_blocks", _next_fit_sql(["words"], ", x AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY seg, pos) AS k FROM words)", "(length(x.word) + 1)", 31, "x.seg, x.pos", most=5))
def word_blocks(spark, d):
    return O.per_key(V.words(spark, d), "ep", ["seg", "pos"], lambda r: O.next_fit(r, lambda x: len(x["word"]) + 1, 31, 5), "seg long, pos long, bin long, load long")


@register("time_chunks", using("sentences", recursive=True) + """, x AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY seg, pos) AS k FROM sentences),
f AS (SELECT ep, k, 0 AS chunk, s_ms AS z FROM x WHERE k = 1 UNION ALL SELECT x.ep, x.k, CASE WHEN x.e_ms - f.z > 60000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN x.e_ms - f.z > 60000 THEN x.s_ms ELSE f.z END FROM f JOIN x ON x.ep = f.ep AND x.k = f.k + 1)
SELECT x.ep, x.seg, x.pos, CAST(f.chunk AS BIGINT) AS chunk FROM f JOIN x ON x.ep = f.ep AND x.k = f.k""")
def time_chunks(spark, d):
    return O.per_key(V.sentences(spark, d), "ep", ["seg", "pos"], lambda r: O.time_chunks(r, 60_000), "seg long, pos long, chunk long")


#: For each unit as the first of a chunk, the unit after its last and the one that begins the next chunk; then the chain of these from the first unit.
_CHUNKS = f""", u AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY s_ms, e_ms, seg, pos) AS i, count(*) OVER (PARTITION BY ep) AS n, '[' || (s_ms // 1000) || '-' || (e_ms // 1000) || '] ' || CASE WHEN speaker <> '' THEN '(' || speaker || ') ' ELSE '' END || text AS line FROM sentences),
c AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY ep ORDER BY i) AS chars FROM u),
j AS (SELECT a.ep, a.i, a.n, a.s_ms, coalesce(min(b.i) FILTER (b.i > a.i AND (b.e_ms - a.s_ms > 90000 OR b.chars - a.chars + length(a.line) > 2500)), a.n + 1) AS j FROM c a JOIN c b ON b.ep = a.ep AND b.i >= a.i GROUP BY a.ep, a.i, a.n, a.s_ms),
k AS (SELECT j.ep, j.i, j.j, j.n, max(b.e_ms) AS e_ms FROM j JOIN c b ON b.ep = j.ep AND b.i BETWEEN j.i AND j.j - 1 GROUP BY j.ep, j.i, j.j, j.n),
x AS (SELECT k.*, CASE WHEN k.j > k.n THEN k.j ELSE coalesce((SELECT min(b.i) FROM c b, c a WHERE a.ep = k.ep AND a.i = k.i AND b.ep = k.ep AND b.i > k.i AND b.s_ms >= greatest(a.s_ms, k.e_ms - 30000)), k.j) END AS nxt FROM k),
f AS (SELECT ep, i, 1 AS no FROM x WHERE i = 1 UNION ALL SELECT x.ep, x.nxt, f.no + 1 FROM f JOIN x ON x.ep = f.ep AND x.i = f.i WHERE x.nxt <= x.n)
SELECT f.ep, 'chunk_' || CASE WHEN f.no < 1000 THEN lpad(CAST(f.no AS VARCHAR), 3, '0') ELSE CAST(f.no AS VARCHAR) END AS chunk_id, min(c.s_ms) AS s_ms, x.e_ms, string_agg(c.line, chr(10) ORDER BY c.i) AS text, list_sort(list_distinct(list(c.speaker))) AS speakers, count(*) AS units, f.i > 1 AS overlap_left, x.j <= x.n AS overlap_right, list_sort(list_distinct(list(c.seg))) AS segments
FROM f JOIN x ON x.ep = f.ep AND x.i = f.i JOIN c ON c.ep = f.ep AND c.i BETWEEN f.i AND x.j - 1 GROUP BY f.ep, f.no, f.i, x.e_ms, x.j, x.n"""


@register("overlap_chunks", using("sentences", recursive=True) + _CHUNKS)
def overlap_chunks(spark, d):
    return O.per_key(V.sentences(spark, d), "ep", ["s_ms", "e_ms", "seg", "pos"], lambda r: O.overlapping_chunks(r, 90_000, 2500, 30_000), "chunk_id string, s_ms long, e_ms long, text string, speakers array<string>, units long, overlap_left boolean, overlap_right boolean, segments array<long>")


@register("sentence_groups", using("sentences", recursive=True) + r""", x AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY seg, pos) AS k, regexp_matches(trim(text), '[.!?…]["»”’)\]]*$') AS fin FROM sentences),
f AS (SELECT ep, k, 0 AS g, length(text) AS n, fin OR length(text) >= 140 AS done FROM x WHERE k = 1
UNION ALL SELECT x.ep, x.k, CASE WHEN f.done THEN f.g + 1 ELSE f.g END, CASE WHEN f.done THEN length(x.text) ELSE f.n + 1 + length(x.text) END, x.fin OR CASE WHEN f.done THEN length(x.text) ELSE f.n + 1 + length(x.text) END >= 140 FROM f JOIN x ON x.ep = f.ep AND x.k = f.k + 1)
SELECT x.ep, min(x.s_ms) AS s_ms, max(x.e_ms) AS e_ms, string_agg(x.text, ' ' ORDER BY x.k) AS text, arg_min(x.speaker, x.k) AS speaker, count(*) AS segments FROM f JOIN x ON x.ep = f.ep AND x.k = f.k GROUP BY x.ep, f.g""")
def sentence_groups(spark, d):
    return O.per_key(V.sentences(spark, d), "ep", ["seg", "pos"], O.sentence_groups, "s_ms long, e_ms long, text string, speaker string, segments long")


@register("digest", using("sentences", recursive=True) + """, w AS (SELECT ep, greatest(30000, max(e_ms) // 12) AS w FROM sentences GROUP BY ep), x AS (SELECT s.*, w.w, row_number() OVER (PARTITION BY s.ep ORDER BY seg, pos) AS k FROM sentences s JOIN w ON w.ep = s.ep),
f AS (SELECT ep, k, s_ms >= 0 AS hit, CASE WHEN s_ms >= 0 THEN s_ms + w ELSE 0 END AS slot FROM x WHERE k = 1 UNION ALL SELECT x.ep, x.k, x.s_ms >= f.slot, CASE WHEN x.s_ms >= f.slot THEN x.s_ms + x.w ELSE f.slot END FROM f JOIN x ON x.ep = f.ep AND x.k = f.k + 1)
SELECT x.ep, x.seg, x.pos, x.s_ms, x.text FROM f JOIN x ON x.ep = f.ep AND x.k = f.k WHERE f.hit""")
def digest(spark, d):
    return O.per_key(V.sentences(spark, d), "ep", ["seg", "pos"], lambda r: O.digest(r, 30_000, 12), "seg long, pos long, s_ms long, text string")


_LINE = "'[' || (s_ms // 1000) || '-' || (e_ms // 1000) || '] ' || text"


@register("sampled_rows", using("sentences") + f""", x AS (SELECT *, {_LINE} AS line, row_number() OVER (PARTITION BY ep ORDER BY seg, pos) - 1 AS i, count(*) OVER (PARTITION BY ep) AS n FROM sentences),
y AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY ep) AS every, greatest(1, n // 4) AS q FROM x),
r AS (SELECT *, CASE WHEN every <= 2400 OR i < q THEN 0 WHEN i >= greatest(0, n // 2 - q // 2) AND i < n // 2 + q // 2 THEN 1 WHEN i >= n - q THEN 2 END AS part FROM y),
z AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY ep ORDER BY CASE WHEN every <= 2400 THEN 0 ELSE part END, i) AS upto FROM r WHERE part IS NOT NULL)
SELECT ep, string_agg(line, chr(10) ORDER BY part, i) AS transcript, list_sort(list_distinct(list(s_ms // 1000))) AS starts, list_sort(list_distinct(list(e_ms // 1000))) AS ends FROM z WHERE upto <= 2400 GROUP BY ep""")
def sampled_rows(spark, d):
    """The part of a transcript that fits a prompt, and the times that an answer may begin and end at."""
    sec = lambda c: F.floor(F.col(c) / 1000)
    line = F.concat(F.lit("["), sec("s_ms").cast("string"), F.lit("-"), sec("e_ms").cast("string"), F.lit("] "), F.col("text"))
    x = O.sampled(V.sentences(spark, d).withColumn("line", line), "ep", ["seg", "pos"], F.length("line") + 1, 2400)
    # the parts are in order of time, but for an episode of one or two rows, which is all in the first
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "pos", "line"))), lambda y: y["line"]), "\n")
    return x.groupBy("ep").agg(shown.alias("transcript"), F.array_sort(F.collect_set(sec("s_ms"))).alias("starts"), F.array_sort(F.collect_set(sec("e_ms"))).alias("ends"))


_CUES = using("sentences", recursive=True) + ", x AS (SELECT ep, seg, pos, s_ms, e_ms + (seg * 7 + pos * 13) % 9 * 400 AS e_ms, row_number() OVER (PARTITION BY ep ORDER BY seg, pos) AS k FROM sentences)"


def _cues(spark, d):
    return V.sentences(spark, d).withColumn("e_ms", F.col("e_ms") + (F.col("seg") * 7 + F.col("pos") * 13) % 9 * 400)


@register("subtitle_overlap_push", _CUES + """, f AS (SELECT ep, k, s_ms AS s, e_ms AS e FROM x WHERE k = 1 UNION ALL SELECT x.ep, x.k, CASE WHEN x.s_ms < f.e THEN f.e + 50 ELSE x.s_ms END, CASE WHEN x.s_ms < f.e THEN f.e + 50 + x.e_ms - x.s_ms ELSE x.e_ms END FROM f JOIN x ON x.ep = f.ep AND x.k = f.k + 1)
SELECT x.ep, x.seg, x.pos, f.s AS s_ms, f.e AS e_ms FROM f JOIN x ON x.ep = f.ep AND x.k = f.k""")
def overlap_push(spark, d):
    return O.per_key(_cues(spark, d), "ep", ["seg", "pos"], O.pushed_cues, "seg long, pos long, s_ms long, e_ms long")


@register("subtitle_timing", _CUES + """, t AS (SELECT *, s_ms + least(7000, greatest(1500, e_ms - s_ms)) AS e, lead(s_ms) OVER (PARTITION BY ep ORDER BY k) AS nx FROM x)
SELECT ep, seg, pos, s_ms, CASE WHEN nx - e < 150 AND nx - 150 - s_ms >= 1500 THEN least(e, nx - 150) ELSE e END AS e_ms FROM t""")
def timing(spark, d):
    return O.cue_times(_cues(spark, d), "ep", ["seg", "pos"]).select("ep", "seg", "pos", "s_ms", "e_ms")


@register("subtitle_cues")
def subtitle_cues(spark, d):
    return O.per_key(V.sentences(spark, d), "ep", ["seg", "pos"], O.subtitles, "s_ms long, e_ms long, text string")


@register("srt_cues", using("sentences", recursive=True) + ", x AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY seg, pos) AS k FROM sentences), y AS (SELECT *, length(text) < 45 AND length(text) + 1 + lead(length(text)) OVER (PARTITION BY ep ORDER BY k) <= 140 AS pull FROM x), f AS (SELECT ep, k, coalesce(pull, false) AS two FROM y WHERE k = 1 UNION ALL SELECT y.ep, y.k, coalesce(y2.pull, false) FROM f JOIN y ON y.ep = f.ep AND y.k = f.k + CASE WHEN f.two THEN 2 ELSE 1 END JOIN y y2 ON y2.ep = y.ep AND y2.k = y.k) SELECT f.ep, y.s_ms, CASE WHEN f.two THEN z.e_ms ELSE y.e_ms END AS e_ms, length(y.text) + CASE WHEN f.two THEN 1 + length(z.text) ELSE 0 END AS chars FROM f JOIN y ON y.ep = f.ep AND y.k = f.k LEFT JOIN y z ON z.ep = f.ep AND z.k = f.k + 1")
def srt_cues(spark, d):
    cues = O.per_key(V.sentences(spark, d), "ep", ["seg", "pos"], O.srt_cues, "s_ms long, e_ms long, text string")
    return cues.select("ep", "s_ms", "e_ms", F.length("text").cast("long").alias("chars"))


@register("wrapped_lines", """WITH RECURSIVE w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)),
f AS (SELECT doc_id, k, 1 AS line, length(word) AS n FROM w WHERE k = 1 UNION ALL SELECT w.doc_id, w.k, CASE WHEN f.n + 1 + length(word) <= 42 THEN f.line ELSE f.line + 1 END, CASE WHEN f.n + 1 + length(word) <= 42 THEN f.n + 1 + length(word) ELSE length(word) END FROM f JOIN w ON w.doc_id = f.doc_id AND w.k = f.k + 1)
SELECT doc_id, max(line)::BIGINT AS lines, max(n)::BIGINT AS longest FROM f GROUP BY doc_id""")
def wrapped_lines(spark, d):
    """Every text wrapped where it lies; nothing is shuffled."""
    said = V.table(spark, d, "documents").filter(F.col("text").rlike(f"[^{O.BLANK}]"))
    lines = said.select("doc_id", O.wrapped_text("text").alias("lines"))
    return lines.select("doc_id", F.size("lines").cast("long").alias("lines"), F.array_max(F.transform("lines", lambda x: F.length(x).cast("long"))).alias("longest"))


@register("speaker_islands", using("segments") + ", c AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY ep ORDER BY seg) THEN 0 ELSE 1 END AS n FROM (SELECT ep, seg, CASE WHEN seg % 4 < 2 THEN 'a' ELSE 'b' END AS speaker, s_ms, e_ms, text FROM segments)), i AS (SELECT *, sum(n) OVER (PARTITION BY ep ORDER BY seg) AS island FROM c) SELECT ep, CAST(island AS BIGINT) AS island, any_value(speaker) AS speaker, min(s_ms) AS s_ms, max(e_ms) AS e_ms, string_agg(text, ' ' ORDER BY seg) AS text FROM i GROUP BY ep, island")
def speaker_islands(spark, d):
    """Turns of one speaker in a row as one: gaps and islands in two windows over one partitioning."""
    w = Window.partitionBy("ep").orderBy("seg")
    x = V.segments(spark, d).withColumn("speaker", F.expr("CASE WHEN seg % 4 < 2 THEN 'a' ELSE 'b' END"))
    x = x.withColumn("n", F.when(F.col("speaker") == F.lag("speaker").over(w), 0).otherwise(1)).withColumn("island", F.sum("n").over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda y: y["text"]), " ")
    return x.groupBy("ep", "island").agg(F.first("speaker").alias("speaker"), F.min("s_ms").alias("s_ms"), F.max("e_ms").alias("e_ms"), joined.alias("text"))


_TITLE = "CASE seg % 2 WHEN 0 THEN 'Part ' || (seg // 4) || '.' ELSE ' PART  ' || (seg // 4) END"


@register("section_islands", using("segments") + rf""", t AS (SELECT ep, seg, trim(trim(lower(regexp_replace({_TITLE}, '\s+', ' ', 'g'))), ' .:—-') AS title, text FROM segments), c AS (SELECT *, CASE WHEN title = lag(title) OVER (PARTITION BY ep ORDER BY seg) THEN 0 ELSE 1 END AS n FROM t), i AS (SELECT *, sum(n) OVER (PARTITION BY ep ORDER BY seg) AS k FROM c) SELECT ep, CAST(k AS BIGINT) AS section, any_value(title) AS title, list(text ORDER BY seg) AS paragraphs FROM i GROUP BY ep, k""")
def section_islands(spark, d):
    """Neighbouring sections whose titles are the same but for case, blanks and marks at the ends, as one."""
    w = Window.partitionBy("ep").orderBy("seg")
    raw = F.expr(_TITLE.replace("seg // 4", "seg div 4"))
    x = V.segments(spark, d).withColumn("title", F.btrim(F.trim(F.lower(F.regexp_replace(raw, r"\s+", " "))), F.lit(" .:—-")))
    same = (F.col("title") == F.lag("title").over(w)) & (F.col("title") != "")
    x = x.withColumn("n", F.when(same, 0).otherwise(1)).withColumn("section", F.sum("n").over(w))
    return x.groupBy("ep", "section").agg(F.first("title").alias("title"), F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda y: y["text"]).alias("paragraphs"))


@register("karaoke_lead", using("words") + ", x AS (SELECT *, lead(s_ms) OVER (PARTITION BY ep, seg ORDER BY pos) AS nx FROM words) SELECT ep, seg, pos, s_ms, greatest(coalesce(nx, e_ms), s_ms + 10) AS e_ms, '{\\kf' || ((greatest(coalesce(nx, e_ms), s_ms + 10) - s_ms) // 10) || '}' || word AS tag FROM x".replace("\\\\", "\\"))
def karaoke(spark, d):
    """Each word lasts until the next begins; the tag has centiseconds, cut off."""
    w = Window.partitionBy("ep", "seg").orderBy("pos")
    end = F.greatest(F.coalesce(F.lead("s_ms").over(w), F.col("e_ms")), F.col("s_ms") + 10)
    x = V.words(spark, d).withColumn("end", end)
    return x.select("ep", "seg", "pos", "s_ms", F.col("end").alias("e_ms"), F.concat(F.lit("{\\kf"), F.floor((F.col("end") - F.col("s_ms")) / 10).cast("string"), F.lit("}"), F.col("word")).alias("tag"))


#: A speaker for 17 of every 19 seconds, in turn of three; the last span ends with the episode.
_SPANS = "ends AS (SELECT ep, max(e_ms) AS m FROM segments GROUP BY ep), spans AS (SELECT ep, k AS pos, k * 19000 AS s, least(m, k * 19000 + 17000) AS e, 'S' || (k % 3) AS speaker FROM (SELECT ep, m, unnest(range(0, (m - 1) // 19000 + 1)) AS k FROM ends))"
#: Of every fifth segment the word times are not known.
_TIMED = "(ep + seg) % 5 <> 0"


@register("speaker_turns", using("words", recursive=True) + f""", {_SPANS}, tw AS (SELECT ep, seg, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '') AS t, s_ms, e_ms FROM segments),
p AS (SELECT ep, seg, pos, s_ms, e_ms FROM words WHERE {_TIMED} UNION ALL SELECT ep, seg, 0, s_ms, e_ms FROM tw WHERE NOT {_TIMED} AND len(t) > 0),
c AS (SELECT p.*, x.speaker, row_number() OVER (PARTITION BY p.ep, p.seg, p.pos ORDER BY CASE WHEN 2 * x.s <= p.s_ms + p.e_ms AND p.s_ms + p.e_ms <= 2 * x.e THEN 0 ELSE 1 END, greatest(2 * x.s - p.s_ms - p.e_ms, p.s_ms + p.e_ms - 2 * x.e, 0), x.s, x.pos) AS r FROM p JOIN spans x ON x.ep = p.ep),
l AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w THEN 0 ELSE 1 END AS new FROM c WHERE r = 1 WINDOW w AS (PARTITION BY ep, seg ORDER BY pos)),
i AS (SELECT *, sum(new) OVER (PARTITION BY ep, seg ORDER BY pos) AS run FROM l),
runs0 AS (SELECT ep, seg, run, min(pos) AS first, max(pos) + 1 AS stop, any_value(speaker) AS who FROM i GROUP BY ep, seg, run), runs AS (SELECT *, lead(who) OVER (PARTITION BY ep, seg ORDER BY run) AS after FROM runs0),
f AS (SELECT ep, seg, run, 1 AS g, who, false AS skip FROM runs WHERE run = 1
 UNION ALL SELECT x.ep, x.seg, x.run, CASE WHEN f.skip OR f.who = x.who OR (x.after IS NOT NULL AND x.stop - x.first < 2 AND f.who = x.after) THEN f.g ELSE f.g + 1 END, CASE WHEN f.skip OR f.who = x.who OR (x.after IS NOT NULL AND x.stop - x.first < 2 AND f.who = x.after) THEN f.who ELSE x.who END, NOT f.skip AND x.after IS NOT NULL AND x.stop - x.first < 2 AND f.who = x.after FROM f JOIN runs x ON x.ep = f.ep AND x.seg = f.seg AND x.run = f.run + 1),
m AS (SELECT x.ep, x.seg, f.g, any_value(f.who) AS who, min(x.first) AS first, max(x.stop) AS stop FROM f JOIN runs x ON x.ep = f.ep AND x.seg = f.seg AND x.run = f.run GROUP BY x.ep, x.seg, f.g),
n AS (SELECT m.*, tw.t, len(tw.t) AS tn, count(w.pos) AS wn, CAST(round_even(m.first::DOUBLE * len(tw.t) / greatest(count(w.pos), 1), 0) AS INT) AS cut0, any_value(tw.s_ms) AS s0, any_value(tw.e_ms) AS e0 FROM m JOIN tw ON tw.ep = m.ep AND tw.seg = m.seg LEFT JOIN words w ON w.ep = m.ep AND w.seg = m.seg AND (m.ep + m.seg) % 5 <> 0 GROUP BY m.ep, m.seg, m.g, m.who, m.first, m.stop, tw.t),
k AS (SELECT *, CASE WHEN cut0 <= 0 OR cut0 >= tn THEN cut0 ELSE coalesce(list_filter([cut0, cut0 - 1, cut0 + 1, cut0 - 2, cut0 + 2, cut0 - 3, cut0 + 3, cut0 - 4, cut0 + 4], lambda j: j BETWEEN 1 AND tn AND regexp_matches(t[j], '[.!?…]["»”’)\\]]*$'))[1], cut0) END AS a FROM n),
z AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY ep, seg ORDER BY g), tn) AS b FROM k),
o AS (SELECT z.ep, z.seg, z.g, z.who, CASE WHEN z.wn > 0 THEN w1.s_ms ELSE z.s0 END AS s_ms, CASE WHEN z.wn > 0 THEN w2.e_ms ELSE z.e0 END AS e_ms, array_to_string(z.t[a + 1:b], ' ') AS text FROM z LEFT JOIN words w1 ON w1.ep = z.ep AND w1.seg = z.seg AND w1.pos = z.first LEFT JOIN words w2 ON w2.ep = z.ep AND w2.seg = z.seg AND w2.pos = z.stop - 1 WHERE b > a),
q AS (SELECT *, CASE WHEN who = lag(who) OVER (PARTITION BY ep ORDER BY seg, g) THEN 0 ELSE 1 END AS new FROM o), u AS (SELECT *, sum(new) OVER (PARTITION BY ep ORDER BY seg, g) AS turn FROM q)
SELECT ep, CAST(turn AS BIGINT) AS turn, any_value(who) AS speaker, arg_min(s_ms, seg * 100000 + g) AS s_ms, arg_max(e_ms, seg * 100000 + g) AS e_ms, string_agg(text, ' ' ORDER BY seg, g) AS text FROM u GROUP BY ep, turn""")
def speaker_turns(spark, d):
    """Turns from segments with word times and speaker spans cut into the same timeline."""
    w = V.words(spark, d).filter(_TIMED).groupBy("ep", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "s_ms", "e_ms"))).alias("words"))
    seg = V.segments(spark, d).join(w, ["ep", "seg"], "left").withColumn("words", F.transform("words", lambda x: F.struct(x["s_ms"].alias("s_ms"), x["e_ms"].alias("e_ms"))))
    ends = V.segments(spark, d).groupBy("ep").agg(F.max("e_ms").alias("m")).select("ep", "m", F.explode(F.expr("sequence(0L, (m - 1) div 19000)")).alias("pos"))
    spans = ends.select("ep", "pos", (F.col("pos") * 19_000).alias("s"), F.least("m", F.col("pos") * 19_000 + 17_000).alias("e"), F.concat(F.lit("S"), F.col("pos") % 3).alias("speaker"))
    return O.speaker_turns(seg, spans, "ep")


_NMS = """, o AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY score DESC, s, e, title, id) AS k FROM moments),
f AS (SELECT ep, 1 AS k, [{'id': id, 's': s, 'e': e}] AS kept FROM o WHERE k = 1 UNION ALL SELECT o.ep, o.k, CASE WHEN len(list_filter(f.kept, lambda z: least(z.e, o.e) > greatest(z.s, o.s) AND 100 * (least(z.e, o.e) - greatest(z.s, o.s)) >= 35 * greatest(z.e - z.s, o.e - o.s))) > 0 THEN f.kept ELSE list_append(f.kept, {'id': o.id, 's': o.s, 'e': o.e}) END FROM f JOIN o ON o.ep = f.ep AND o.k = f.k + 1),
l AS (SELECT ep, arg_max(kept, k) AS kept FROM f GROUP BY ep) SELECT ep, unnest(kept).id AS id FROM l"""


@register("nms_dedupe", using("moments", recursive=True) + _NMS)
def nms_dedupe(spark, d):
    return O.nms(V.moments(spark, d).withColumn("value", F.col("score")), "ep")


#: Of the rows that suppression leaves, three passes: varied topics under the quotas, then the rest under them, then any up to the total.
_RANK = """, k0 AS (SELECT m.*, unnest_id.id AS keep FROM moments m JOIN (SELECT unnest(kept).id AS id FROM l) unnest_id ON unnest_id.id = m.id),
n0 AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY score DESC, s, e, id) AS i, count(*) OVER (PARTITION BY ep) AS n, list_distinct(list_filter(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'), lambda t: length(t) >= 3)) AS tok, CASE clip_type WHEN 'story' THEN 2 WHEN 'reel' THEN 3 WHEN 'long_reel' THEN 1 ELSE 5 END AS quota FROM k0),
n1 AS (SELECT ep, id, s, e, tok, clip_type, quota, i + n * pass AS step, pass FROM n0, (VALUES (0), (1), (2)) p(pass)),
g AS (SELECT ep, 0::BIGINT AS step, []::STRUCT(id BIGINT, s BIGINT, e BIGINT, tok VARCHAR[], kind VARCHAR)[] AS got FROM n1 GROUP BY ep
 UNION ALL SELECT x.ep, x.step, CASE WHEN len(list_filter(g.got, lambda z: z.id = x.id OR (z.s < x.e AND x.s < z.e))) > 0
  OR (x.pass < 2 AND len(list_filter(g.got, lambda z: z.kind = x.clip_type)) >= x.quota)
  OR (x.pass = 0 AND len(list_filter(g.got, lambda z: len(z.tok) > 0 AND len(x.tok) > 0 AND 2 * len(list_intersect(z.tok, x.tok)) >= len(list_distinct(list_concat(z.tok, x.tok))))) > 0)
  OR (x.pass = 2 AND len(g.got) >= 14) THEN g.got ELSE list_append(g.got, {'id': x.id, 's': x.s, 'e': x.e, 'tok': x.tok, 'kind': x.clip_type}) END FROM g JOIN n1 x ON x.ep = g.ep AND x.step = g.step + 1),
w AS (SELECT ep, arg_max(got, step) AS got FROM g GROUP BY ep), v AS (SELECT ep, unnest(got) AS t, generate_subscripts(got, 1) AS rank FROM w)
SELECT ep, t.id AS id, rank, t.kind AS bucket, t.s AS s, t.e AS e FROM v"""


@register("rank_greedy", using("moments", recursive=True) + _NMS[: _NMS.rindex(" SELECT ep, unnest")] + _RANK)
def rank_greedy(spark, d):
    rows = V.moments(spark, d).withColumn("value", F.col("score").cast("double")).select("ep", "id", "s", "e", "value", "title", "clip_type")
    return O.per_key(rows, "ep", ["id"], lambda r: O.ranked(r, dict(story=2, reel=3, long_reel=1, highlight=5), total=14), "id long, rank long, bucket string, s long, e long")


_B = "CASE clip_type WHEN 'story' THEN 2 WHEN 'reel' THEN 3 WHEN 'long_reel' THEN 1 ELSE 5 END"


@register("quota_topk", using("moments") + f", r AS (SELECT ep, id, clip_type, row_number() OVER (PARTITION BY ep, clip_type ORDER BY score DESC, s, id) AS rn FROM moments) SELECT ep, id, clip_type, rn FROM r WHERE rn <= {_B}")
def quota_topk(spark, d):
    w = Window.partitionBy("ep", "clip_type").orderBy(F.desc("score"), "s", "id")
    return V.moments(spark, d).withColumn("rn", F.row_number().over(w).cast("long")).filter(f"rn <= {_B}").select("ep", "id", "clip_type", "rn")


@register("batch_numbers", using("moments") + ", r AS (SELECT ep, id, row_number() OVER (PARTITION BY ep ORDER BY s, id) - 1 AS k FROM moments) SELECT ep, id, k // 16 AS batch FROM r")
def batch_numbers(spark, d):
    w = Window.partitionBy("ep").orderBy("s", "id")
    return V.moments(spark, d).select("ep", "id", F.floor((F.row_number().over(w) - 1) / 16).alias("batch"))


@register("judge_topn", using("moments") + ", r AS (SELECT *, row_number() OVER (PARTITION BY ep ORDER BY score DESC, s, id) AS rn FROM moments) SELECT ep, rn, id, s, e, score, title FROM r WHERE rn <= 12")
def judge_topn(spark, d):
    w = Window.partitionBy("ep").orderBy(F.desc("score"), "s", "id")
    return V.moments(spark, d).withColumn("rn", F.row_number().over(w).cast("long")).filter("rn <= 12").select("ep", "rn", "id", "s", "e", "score", "title")


@register("speech_units", using("sentences") + "SELECT ep, seg, pos, s_ms, greatest(e_ms, s_ms + 10) AS e_ms, '[' || (s_ms // 1000) || '-' || (greatest(e_ms, s_ms + 10) // 1000) || '] (' || speaker || ') ' || text AS line FROM sentences")
def speech_units(spark, d):
    e = F.greatest("e_ms", F.col("s_ms") + 10)
    sec = lambda x: F.floor(x / 1000).cast("string")
    return V.sentences(spark, d).select("ep", "seg", "pos", "s_ms", e.alias("e_ms"), F.concat(F.lit("["), sec(F.col("s_ms")), F.lit("-"), sec(e), F.lit("] ("), F.col("speaker"), F.lit(") "), F.col("text")).alias("line"))
