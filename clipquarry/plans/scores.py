"""Queries of the scoring expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from .views import cards, using

_WC = r"(CASE WHEN {0} = '' THEN 0 ELSE len(regexp_split_to_array({0}, '\s+')) END)"
_HOOK = "(CASE WHEN hook <> '' THEN hook ELSE title END)"
_BASE = "(CASE WHEN caption <> '' THEN caption ELSE quote END)"


def _bounded(v, lo, hi):
    return f"(CASE WHEN {v} < {lo} THEN greatest(0.0::DOUBLE, {v}::DOUBLE / {max(lo, 1)}) WHEN {v} > {hi} THEN {hi}::DOUBLE / greatest({v}::DOUBLE, 1) ELSE 1.0::DOUBLE END)"


def _p(cond, x):
    return f"(CASE WHEN {cond} THEN {x}::DOUBLE ELSE 0 END)"


_HW = "(^|[^\\p{L}\\p{N}_])(why|how|what|лучше|почему|как|что)($|[^\\p{L}\\p{N}_])"
_NUM = "(^|[^\\p{L}\\p{N}_])\\p{Nd}+([.,]\\p{Nd}+)?($|[^\\p{L}\\p{N}_])"
_DUR = "(e - s)"
_LO = "(CASE WHEN lower(clip_type) LIKE '%story%' THEN 5 WHEN lower(clip_type) LIKE '%highlight%' OR lower(clip_type) LIKE '%hot%' THEN 10 WHEN lower(clip_type) LIKE '%long%' THEN 60 ELSE 30 END)::DOUBLE"
_HI = "(CASE WHEN lower(clip_type) LIKE '%story%' THEN 15 WHEN lower(clip_type) LIKE '%highlight%' OR lower(clip_type) LIKE '%hot%' THEN 30 WHEN lower(clip_type) LIKE '%long%' THEN 180 ELSE 60 END)::DOUBLE"


def _fixed(x, n=4):
    return f"(floor(({x}) * {10**n} + 0.5) / {10**n})"


ORACLE = {
    "hook_score": f"CASE WHEN {_HOOK} = '' THEN 0.0 ELSE least(1.0, {_bounded(_WC.format(_HOOK), 4, 14)} * 0.45::DOUBLE + {_p(f'regexp_matches({_HOOK}, $$[?？]$$)', 0.12)} + {_p(f'regexp_matches({_HOOK}, $$[!！]$$)', 0.08)} + {_p(f'regexp_matches({_HOOK}, $${_NUM}$$)', 0.08)} + {_p(f'regexp_matches(lower({_HOOK}), $${_HW}$$)', 0.08)} + {_p(f'length({_HOOK}) <= 80', 0.12)} + {_p(f'left({_HOOK}, 1) = upper(left({_HOOK}, 1)) AND left({_HOOK}, 1) <> lower(left({_HOOK}, 1))', 0.07)}) END",
    "readability_score": f"CASE WHEN {_BASE} = '' THEN 0.0 ELSE least(1.0, {_bounded(_WC.format(_BASE), 8, 28)} * 0.55::DOUBLE + {_p(f'length({_BASE}) <= 220', 0.15)} + {_p(f'length({_BASE}) >= 30', 0.1)} + {_p(f'regexp_matches({_BASE}, $$[,:—]$$)', 0.1)} + {_p(f'regexp_matches({_BASE}, $$[?？!！]$$)', 0.05)}) END",
    "completeness_score": f"least(1.0, {_p('title <> chr(0) AND length(title) > 0', 0.25)} + {_p('length(why) > 0', 0.25)} + {_p('length(quote) > 0', 0.2)} + {_bounded(f'greatest(0.01, {_DUR})', 12, 180)} * 0.3::DOUBLE)",
    "speaker_focus_score": f"least(1.0, {_p('length(speaker) > 0', 0.7)} + greatest(0.0, least(0.3, coalesce(speaker_confidence, 0) * 0.3)))",
    "duration_score": f"CASE WHEN {_DUR} <= 0 THEN 0.0 WHEN {_DUR} < {_LO} THEN {_DUR} / greatest({_LO}, 1) * 0.6::DOUBLE WHEN {_DUR} > {_HI} THEN {_HI} / greatest({_DUR}, 1) * 0.6::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - abs({_DUR} - ({_LO} + {_HI}) / 2) / greatest(({_LO} + {_HI}) / 2, 1)) END",
    "quote_grounding_score": "CASE WHEN quote_match_ratio IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, quote_match_ratio)) END",
    "audio_quality_score": "CASE WHEN audio_energy_db IS NULL AND audio_silence_ratio IS NULL THEN 0.5 ELSE " + _fixed("(CASE WHEN audio_energy_db IS NULL THEN 0 ELSE greatest(0.0, least(1.0, (audio_energy_db + 35) / 20)) * 0.6::DOUBLE END + CASE WHEN audio_silence_ratio IS NULL THEN 0 ELSE (1 - greatest(0.0, (greatest(0.0, least(1.0, audio_silence_ratio)) - 0.35::DOUBLE) / 0.65::DOUBLE)) * 0.4::DOUBLE END) / (CASE WHEN audio_energy_db IS NULL THEN 0::DOUBLE ELSE 0.6::DOUBLE END + CASE WHEN audio_silence_ratio IS NULL THEN 0::DOUBLE ELSE 0.4::DOUBLE END)") + " END",
    "speech_rate_score": f"CASE WHEN speech_rate_wps IS NULL THEN 0.5 WHEN speech_rate_wps <= 0 THEN 0.0 ELSE {_fixed(_bounded('speech_rate_wps', 1.6, 3.4))} END",
    "mid_thought_penalty": f"{_p('title LIKE $$%...$$ OR title LIKE $$%—$$ OR title LIKE $$%-$$', 0.3)} + {_p(f'length(quote) > 0 AND {_WC.format('quote')} < 3', 0.15)} + {_p(f'length(why) > 0 AND {_WC.format('why')} < 4', 0.1)}",
}
_WEIGHTED = {"hook_score": 1.8, "readability_score": 1.2, "completeness_score": 1.0, "speaker_focus_score": 0.6, "duration_score": 1.4, "quote_grounding_score": 0.8, "audio_quality_score": 0.7, "speech_rate_score": 0.4}

queries, oracles = {}, {}
for _name in ORACLE:
    queries[f"score_{_name}"] = lambda spark, d, n=_name: cards(spark, d).select("id", (F.floor(S.breakdown()[n] * 10000 + 0.5) / 10000).alias(n))
    oracles[f"score_{_name}"] = using("cards") + f"SELECT id, {_fixed(f'({ORACLE[_name]})::DOUBLE')} AS {_name} FROM cards"
queries["score_priority"] = lambda spark, d: cards(spark, d).select("id", (F.floor(S.priority() * 1000 + 0.5) / 1000).alias("priority"))
oracles["score_priority"] = using("cards") + ", b AS (SELECT id, score, " + ", ".join(f"({x})::DOUBLE AS {n}" for n, x in ORACLE.items()) + " FROM cards) SELECT id, " + _fixed(_fixed("greatest(0.0, score * 0.55::DOUBLE + " + " + ".join(f"{n} * {w}::DOUBLE" for n, w in _WEIGHTED.items()) + " - mid_thought_penalty)"), 3) + " AS priority FROM b"


def _bounds(spark, d):
    lo, hi = S.target_bounds()
    return cards(spark, d).select("id", lo.alias("lo"), hi.alias("hi"), S.bucket().alias("bucket"), S.word_count("caption").alias("words"), S.duration().alias("seconds"))


queries["clip_bounds"] = _bounds
oracles["clip_bounds"] = using("cards") + f"SELECT id, {_LO} AS lo, {_HI} AS hi, CASE WHEN lower(clip_type) LIKE '%story%' THEN 'story' WHEN lower(clip_type) LIKE '%highlight%' OR lower(clip_type) LIKE '%hot%' THEN 'highlight' WHEN lower(clip_type) LIKE '%long%' THEN 'long_reel' ELSE 'reel' END AS bucket, {_WC.format('caption')} AS words, e - s AS seconds FROM cards"


def _coercions(spark, d):
    raw = cards(spark, d).select("id", F.expr("CASE id % 9 WHEN 0 THEN 'abc' WHEN 1 THEN NULL WHEN 2 THEN ' ' WHEN 3 THEN 'yes' WHEN 4 THEN 'OFF' WHEN 5 THEN '2.75' ELSE cast(id - 20 AS string) END").alias("raw"), "speaker_confidence")
    return raw.select("id", S.safe_float("raw", 0.5, 0.0, 100.0).alias("f"), S.safe_int("raw", 3, 1).alias("i"), S.safe_bool("raw", True).alias("b"), S.one_of("raw", ["yes", "off"], "left").alias("choice"), S.segment_confidence(-F.col("speaker_confidence")).alias("conf"), S.crop_x(F.coalesce("speaker_confidence", F.lit(0.5)), F.lit(1920), F.lit(608)).alias("x"), S.margin_v(F.lit(20), (F.col("id") % 5 - 2) / 8, F.lit(1080)).alias("margin"), S.fade_tag((F.col("id") % 700).cast("double"), 120, 180).alias("fade"))


queries["coercions"] = _coercions
oracles["coercions"] = using("cards") + """, r AS (SELECT id, speaker_confidence AS c, CASE id % 9 WHEN 0 THEN 'abc' WHEN 1 THEN NULL WHEN 2 THEN ' ' WHEN 3 THEN 'yes' WHEN 4 THEN 'OFF' WHEN 5 THEN '2.75' ELSE CAST(id - 20 AS VARCHAR) END AS raw FROM cards),
v AS (SELECT *, TRY_CAST(raw AS DOUBLE) AS n, lower(trim(raw)) AS t, least(1.0, (id % 700)::DOUBLE / 300) AS sc FROM r)
SELECT id, least(100.0, greatest(0.0, coalesce(n, 0.5))) AS f, greatest(1, coalesce(CAST(trunc(n) AS BIGINT), 3)) AS i,
 CASE WHEN t IN ('1', 'true', 'yes', 'on', 'y') THEN true WHEN t IN ('0', 'false', 'no', 'off', 'n', '') THEN false WHEN n IS NOT NULL THEN n <> 0 ELSE true END AS b,
 CASE WHEN t IN ('yes', 'off') THEN t ELSE 'left' END AS choice, CASE WHEN c IS NOT NULL THEN floor(greatest(0.0, least(1.0, 1 - c)) * 1000 + 0.5) / 1000 END AS conf,
 greatest(0, least(CAST(round_even(coalesce(c, 0.5) * 1920 - 304, 0) AS BIGINT), 1312)) AS x,
 CASE WHEN id % 5 = 2 THEN 0 ELSE greatest(1, 20 + CAST(floor((id % 5 - 2)::DOUBLE / 8 * 1080 + 0.5) AS BIGINT)) END AS margin,
 CASE WHEN floor(sc * 120) > 0 OR floor(sc * 180) > 0 THEN '{\\fad(' || CAST(floor(sc * 120) AS BIGINT) || ',' || CAST(floor(sc * 180) AS BIGINT) || ')}' ELSE '' END AS fade FROM v""".replace("\\\\", "\\")
