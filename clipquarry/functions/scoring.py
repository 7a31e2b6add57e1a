"""Scores of a candidate moment as column expressions; all stay in whole-stage code generation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each factor weighs in the priority.
DEFAULT_WEIGHTS = {"audio": 0.7, "base": 0.55, "completeness": 1.0, "duration": 1.4, "hook": 1.8, "mid_thought": 1.0, "quote": 0.8, "readability": 1.2, "speaker": 0.6, "speech_rate": 0.4}
NEUTRAL = 0.5
_WORD_EDGE = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Words that open a hook well, in either language; a number that stands by itself.
HOOK_WORDS = "why how what лучше почему как что".split()
HOOK_WORD, NUMBER = (rf"(?iu){_WORD_EDGE[0]}(?:{x}){_WORD_EDGE[1]}" for x in ("|".join(HOOK_WORDS), r"\p{Nd}+(?:[.,]\p{Nd}+)?"))
QUESTION, EXCLAMATION = "[?？]", "[!！]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    """Trimmed, '' for null."""
    return F.trim(F.coalesce(col(x), F.lit("")))


def fixed(x: Column, digits: int = 4) -> Column:
    """Half-up on the given decimals, the same on any engine."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def safe_float(x: Column | str, default: float = 0.0, least: float | None = None, most: float | None = None) -> Column:
    """x as a double, default where it is no number; kept within least and most."""
    v = F.coalesce(col(x).cast("string").try_cast("double"), F.lit(default))
    v = F.greatest(v, F.lit(least)) if least is not None else v
    return F.least(v, F.lit(most)) if most is not None else v


def safe_int(x: Column | str, default: int = 0, least: int | None = None) -> Column:
    v = F.coalesce(col(x).cast("string").try_cast("double").try_cast("long"), F.lit(default).cast("long"))
    return F.greatest(v, F.lit(least).cast("long")) if least is not None else v


def safe_bool(x: Column | str, default: bool = False) -> Column:
    s = F.lower(F.trim(col(x).cast("string")))
    n = s.try_cast("double")
    return F.when(s.isin("1", "true", "yes", "on", "y"), True).when(s.isin("0", "false", "no", "off", "n", ""), False).when(n.isNotNull(), n != 0).otherwise(F.lit(default))


def one_of(x: Column | str, allowed: list[str], default: str) -> Column:
    s = F.lower(text(x))
    return F.when(s.isin(*allowed), s).otherwise(F.lit(default))


def word_count(x: Column | str) -> Column:
    t = text(x)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def bounded(v: Column, lo: float, hi: float) -> Column:
    """1 within lo..hi, in proportion below and above."""
    if hi <= lo:
        return F.lit(0.0)
    return F.when(v < lo, F.greatest(F.lit(0.0), v / max(lo, 1.0))).when(v > hi, F.lit(float(hi)) / F.greatest(v.cast("double"), F.lit(1.0))).otherwise(F.lit(1.0))


def clip(x: Column, most: float = 1.0) -> Column:
    """x within 0..most; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(most), x)))


def duration(s: Column | str = "s", e: Column | str = "e") -> Column:
    return F.coalesce(col(e).cast("double") - col(s).cast("double"), F.lit(0.0))


def _points(*terms: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for cond, p in terms:
        total = total + F.when(cond, p).otherwise(0.0)
    return total


def hook_strength(hook: Column | str = "hook", title: Column | str = "title") -> Column:
    h = F.when(text(hook) != "", text(hook)).otherwise(text(title))
    first = F.substring(h, 1, 1)
    score = bounded(word_count(h), 4, 14) * 0.45 + _points((h.rlike(QUESTION), 0.12), (h.rlike(EXCLAMATION), 0.08), (h.rlike(NUMBER), 0.08), (h.rlike(HOOK_WORD), 0.08), (F.length(h) <= 80, 0.12), ((first == F.upper(first)) & (first != F.lower(first)), 0.07))
    return F.when(h == "", 0.0).otherwise(F.least(F.lit(1.0), score))


def readability(caption: Column | str = "caption", quote: Column | str = "quote") -> Column:
    b = F.when(text(caption) != "", text(caption)).otherwise(text(quote))
    score = bounded(word_count(b), 8, 28) * 0.55 + _points((F.length(b) <= 220, 0.15), (F.length(b) >= 30, 0.1), (b.rlike("[,:—]"), 0.1), (b.rlike("[?？!！]"), 0.05))
    return F.when(b == "", 0.0).otherwise(F.least(F.lit(1.0), score))


def completeness(title="title", why="why", quote="quote", s="s", e="e") -> Column:
    score = _points((text(title) != "", 0.25), (text(why) != "", 0.25), (text(quote) != "", 0.2)) + bounded(F.greatest(F.lit(0.01), duration(s, e)), 12, 180) * 0.3
    return F.least(F.lit(1.0), score)


def speaker_focus(speaker="speaker", confidence="speaker_confidence") -> Column:
    return F.least(F.lit(1.0), _points((text(speaker) != "", 0.7)) + clip(F.coalesce(col(confidence), F.lit(0.0)) * 0.3, 0.3))


def target_bounds(clip_type: Column | str = "clip_type") -> tuple[Column, Column]:
    t = F.lower(text(clip_type))
    pick = lambda a, b, c, d: F.when(t.contains("story"), a).when(t.contains("highlight") | t.contains("hot"), b).when(t.contains("long"), c).otherwise(d).cast("double")
    return pick(5.0, 10.0, 60.0, 30.0), pick(15.0, 30.0, 180.0, 60.0)


def bucket(clip_type: Column | str = "clip_type") -> Column:
    t = F.lower(text(clip_type))
    return F.when(t.contains("story"), "story").when(t.contains("highlight") | t.contains("hot"), "highlight").when(t.contains("long"), "long_reel").otherwise("reel")


def clip_duration(lo: Column, hi: Column, s="s", e="e") -> Column:
    d = F.greatest(F.lit(0.0), duration(s, e))
    centre = (lo + hi) / 2
    odd = (lo <= 0) | (hi <= 0) | (hi < lo)
    return (
        F.when(d <= 0, 0.0).when(odd, bounded(d, 10, 180)).when(d < lo, d / F.greatest(lo, F.lit(1.0)) * 0.6).when(d > hi, hi / F.greatest(d, F.lit(1.0)) * 0.6)
        .otherwise(F.greatest(F.lit(0.0), 1 - F.abs(d - centre) / F.greatest(centre, F.lit(1.0))))
    )


def audio_quality(energy="audio_energy_db", silence="audio_silence_ratio") -> Column:
    loud = clip((col(energy) + 35) / 20) * 0.6
    pauses = clip((clip(col(silence)) - 0.35) / 0.65)
    quiet = 0.4 * (1 - pauses)
    weight = F.when(col(energy).isNull(), 0.0).otherwise(0.6) + F.when(col(silence).isNull(), 0.0).otherwise(0.4)
    total = F.coalesce(loud, F.lit(0.0)) + F.coalesce(quiet, F.lit(0.0))
    return F.when(weight > 0, fixed(total / F.nullif(weight, F.lit(0.0)))).otherwise(F.lit(NEUTRAL))


def speech_rate(rate="speech_rate_wps") -> Column:
    r = col(rate)
    return F.when(r.isNull(), NEUTRAL).when(r <= 0, 0.0).otherwise(fixed(bounded(r, 1.6, 3.4)))


def quote_grounding(ratio="quote_match_ratio") -> Column:
    return F.when(col(ratio).isNull(), NEUTRAL).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(ratio))))


def mid_thought_penalty(title="title", quote="quote", why="why") -> Column:
    t, q, w = text(title), text(quote), text(why)
    return _points((t.endswith("...") | t.endswith("—") | t.endswith("-"), 0.3), ((q != "") & (word_count(q) < 3), 0.15), ((w != "") & (word_count(w) < 4), 0.1))


def weights(overrides: Mapping[str, object] | None = None):
    """The weights as a dict: defaults with those known keys replaced whose values are numbers."""
    out = dict(DEFAULT_WEIGHTS)
    for k, v in (overrides or {}).items():
        try:
            out[k] = float(v) if k in out else out[k]  # type: ignore[arg-type]
        except (TypeError, ValueError, KeyError):
            pass
    return out


def breakdown() -> dict[str, Column]:
    lo, hi = target_bounds()
    return {"hook_score": hook_strength(), "readability_score": readability(), "completeness_score": completeness(), "speaker_focus_score": speaker_focus(), "duration_score": clip_duration(lo, hi), "quote_grounding_score": quote_grounding(), "audio_quality_score": audio_quality(), "speech_rate_score": speech_rate(), "mid_thought_penalty": mid_thought_penalty()}


def priority(overrides: Mapping[str, object] | None = None) -> Column:
    """The value that orders candidates; apart from the model's own score."""
    w, b = weights(overrides), breakdown()
    keys = {"hook": "hook_score", "readability": "readability_score", "completeness": "completeness_score", "speaker": "speaker_focus_score", "duration": "duration_score", "quote": "quote_grounding_score", "audio": "audio_quality_score", "speech_rate": "speech_rate_score"}
    total = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) * w["base"]
    for k, name in keys.items():
        total = total + b[name] * w[k]
    return fixed(F.greatest(F.lit(0.0), total - b["mid_thought_penalty"] * w["mid_thought"]))


def segment_confidence(logprob: Column | str) -> Column:
    """1 + mean log-probability within 0..1, to 3 decimals; null stays null."""
    return F.when(col(logprob).isNotNull(), fixed(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 + col(logprob))), 3))


def crop_x(centre: Column, scaled_width: Column, crop_width: Column) -> Column:
    """Left edge of a crop around a centre ratio, within the picture."""
    return F.greatest(F.lit(0), F.least(F.bround(centre * scaled_width - crop_width / 2).cast("long"), (scaled_width - crop_width).cast("long")))


def margin_v(margin: Column, offset: Column, height: Column) -> Column:
    """0 inherits; otherwise at least 1."""
    return F.when(offset == 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), (margin + F.floor(offset * height + 0.5)).cast("long")))


def fade_tag(cue_ms: Column, fade_in: int, fade_out: int) -> Column:
    """Both fades, shrunk to the cue where they are longer; '' where there are none."""
    if fade_in + fade_out <= 0:
        return F.lit("")
    scale = F.least(F.lit(1.0), cue_ms / (fade_in + fade_out))
    a, b = F.floor(scale * fade_in).cast("long"), F.floor(scale * fade_out).cast("long")
    return F.when((a > 0) | (b > 0), F.format_string("{\\fad(%d,%d)}", a, b)).otherwise("")
