"""Schema on read: JSON replies into validated records, and records back into compact JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scoring import col
from .text import let

#: Fields of a moment beside start, end, score and hashtags: texts, numbers that may be missing, lists.
TEXTS = tuple("title quote why clip_type hook caption selection_stage speaker".split())
NUMBERS = tuple("priority judge_score hook_score completeness_score speaker_focus subtitle_readability_score crop_confidence quote_match_ratio speech_rate_wps audio_energy_db audio_silence_ratio speaker_confidence".split())
LISTS = ("hashtags", "source_chunk_ids")
KNOWN = ("start", "end", "score", *TEXTS, *NUMBERS, *LISTS)
LIST_KEYS = tuple("moments candidates results items clips".split())


def fields(payload: Column | str) -> Column:
    """A JSON object as a map of raw values; null where it is none."""
    return F.from_json(col(payload), "map<string,string>")


def coerced(payload: Column | str) -> Column:
    """A moment out of a JSON object, null if it is not valid: start and end (0 where they are not named) must be numbers, end after start, and one of title, quote and why there. Texts are trimmed, a bad score is 0, other bad numbers null, lists other than lists none, a missing type reel; keys not known go to extra."""

    def record(m: Column) -> Column:
        get = lambda k: F.trim(F.coalesce(m[k], F.lit("")))
        num = lambda k: F.nanvl(m[k].try_cast("double"), F.lit(None).cast("double"))
        listed = lambda k: F.coalesce(F.filter(F.transform(F.from_json(m[k], "array<string>"), lambda t: F.trim(t)), lambda t: t != ""), F.array().cast("array<string>"))
        time = lambda k: F.when(F.map_contains_key(m, k), num(k)).otherwise(0.0)
        said = lambda k: ~F.coalesce(m[k], F.lit("")).isin("", "false", "0", "0.0", "[]", "{}")
        texts = [F.coalesce(F.nullif(get(k), F.lit("")), F.lit("reel")).alias(k) if k == "clip_type" else get(k).alias(k) for k in TEXTS]
        whole = F.struct(time("start").alias("start"), time("end").alias("end"), F.coalesce(num("score"), F.lit(0.0)).alias("score"), *texts, *[num(k).alias(k) for k in NUMBERS], *[listed(k).alias(k) for k in LISTS], F.map_filter(m, lambda k, v: ~k.isin(*KNOWN)).alias("extra"))
        return F.when((time("end") > time("start")) & (said("title") | said("quote") | said("why")), whole)

    return let(fields(payload), record)


def stamped(reply: Column | str, stage: str) -> Column:
    """The valid moments of a reply in any of its shapes, marked with the stage they come from."""
    good = F.filter(F.transform(payload_items(reply), coerced), lambda m: m.isNotNull())
    return F.transform(good, lambda m: m.withField("selection_stage", F.lit(stage)))


def moment_json(m: Callable[[str], Column]) -> Column:
    """A moment as JSON: times to 3 decimals, and of the fields that may be missing those that are there; what is extra is added and overrides nothing. m: a function from a field's name to its column."""
    some = {k: F.nullif(m(k), F.lit("")) for k in ("selection_stage", "speaker")} | {k: m(k) for k in NUMBERS} | {"source_chunk_ids": F.when(F.size(m("source_chunk_ids")) > 0, m("source_chunk_ids"))}
    always = {"start": F.round(m("start"), 3), "end": F.round(m("end"), 3)} | {k: m(k) for k in ("title", "quote", "why", "score", "clip_type", "hook", "caption", "hashtags")}
    return F.to_json(F.struct(*[c.alias(k) for k, c in (always | some).items()]), {"ignoreNullFields": "true"})


def payload_items(reply: Column | str) -> Column:
    """The JSON texts of a reply's items: of a list, or of the first list under moments, candidates, results, items or clips, or the object under moment; none otherwise."""
    r = F.trim(col(reply))
    listed = lambda path: F.transform(F.from_json(F.get_json_object(r, path), "array<variant>"), lambda v: F.to_json(v))
    one = F.get_json_object(r, "$.moment")
    keys = [F.when(F.get_json_object(r, f"$.{k}").startswith("["), listed(f"$.{k}")) for k in LIST_KEYS]
    return F.coalesce(F.when(r.startswith("["), listed("$")), F.when(one.startswith("{"), F.array(one)), *keys, F.array().cast("array<string>"))


def compact(record: dict[str, Column], extra: Column | None = None) -> Column:
    """JSON without nulls, empty texts and empty lists; times to 3 decimals. extra never overrides."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in record.items()]), {"ignoreNullFields": "true"}) if extra is None else F.to_json(F.map_concat(extra, F.create_map(*[x for k, v in record.items() for x in (F.lit(k), v.cast("string"))])))


def corrections(reply: Column | str) -> Column:
    """id -> text of a list, or of that under segments; ids may be texts; blanks and bad ids go, the last of an id counts."""
    r = F.trim(col(reply))
    body = F.when(r.startswith("["), r).otherwise(F.get_json_object(r, "$.segments"))
    rows = F.from_json(body, "array<struct<id:string,text:string>>")
    good = F.filter(F.transform(rows, lambda x: F.struct(x["id"].try_cast("int").alias("id"), F.trim(x["text"]).alias("text"))), lambda x: x["id"].isNotNull() & (F.coalesce(x["text"], F.lit("")) != ""))
    step = lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["id"]), F.map_from_arrays(F.array(x["id"]), F.array(x["text"])))
    return F.aggregate(F.coalesce(good, F.array().cast("array<struct<id:int,text:string>>")), F.create_map().cast("map<int,string>"), step)


def without_fences(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col(x)), r"^```[A-Za-z0-9]*\s*", ""), r"\s*```$", ""))


def merged_maps(*layers: Column) -> Column:
    """Later layers win; null layers count as empty."""
    out = F.coalesce(layers[0], F.create_map().cast("map<string,string>"))
    for m in layers[1:]:
        out = _over(out, F.coalesce(m, F.create_map().cast("map<string,string>")))
    return out


def _over(below: Column, above: Column) -> Column:
    return F.map_concat(F.map_filter(below, lambda k, v: ~F.map_contains_key(above, k)), above)


#: What a model says to itself first.
THOUGHTS = re.compile(r"(?s)<(think)>.*?</\1>")


def salvage(text: str | None) -> str | None:
    """The first JSON value of a reply as compact JSON: fences and prose around it go; a value cut short is closed at the last place where that gives JSON; None if there is none."""
    if not text:
        return None
    t = THOUGHTS.sub("", text)
    starts = [m.start() for m in re.finditer(r"[\[{]", t)]
    decoder = json.JSONDecoder()
    for s in starts:
        try:
            value, _ = decoder.raw_decode(t, s)
            return json.dumps(value, ensure_ascii=False, sort_keys=True)
        except ValueError:
            fixed = _closed(t[s:])
            if fixed is not None:
                return fixed
    return None


def _closed(t: str) -> str | None:
    stack: list[str] = []
    spots: list[tuple[int, str]] = []
    text = escape = False
    for i, c in enumerate(t):
        if text:
            text, escape = (not (c == '"' and not escape)), c == "\\" and not escape
            if not text:
                spots.append((i + 1, "".join(reversed(stack))))
            continue
        if c == '"':
            text = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
            spots.append((i + 1, "".join(reversed(stack))))
        elif c in "]}":
            if not stack or stack[-1] != c:
                break
            stack.pop()
            spots.append((i + 1, "".join(reversed(stack))))
            if not stack:
                break
        elif c.isalnum():
            spots.append((i + 1, "".join(reversed(stack))))
    for at, ends in reversed(spots):
        try:
            value = json.loads(t[:at].rstrip().rstrip(",") + ends)
        except ValueError:
            continue
        return json.dumps(value, ensure_ascii=False, sort_keys=True) if value not in ([], {}) else None
    return None


@F.pandas_udf(T.StringType())
def salvaged(s: pd.Series) -> pd.Series:
    """salvage, in Arrow batches; for replies that from_json can't read."""
    return s.map(salvage)


def json_value(reply: Column | str) -> Column:
    """Clean JSON stays in the JVM; Python sees a null in its place, and only the rest as it is."""
    c = without_fences(reply)
    clean = F.try_parse_json(c)
    return F.coalesce(F.to_json(clean), salvaged(F.when(clean.isNull(), col(reply))))


def markdown_sections(text: str | None) -> list[tuple[str, list[str]]]:
    """(title, paragraphs) of the headings of a text; what looks like JSON and sections without a paragraph go."""
    out: list[tuple[str, list[str]]] = [("", [])]
    block: list = []

    def close_paragraph() -> None:
        p = " ".join(block).strip()
        block.clear()
        if p and not re.match(r'^[\[{}\]]|^"[^"]*"\s*:', p):
            out[-1][1].append(p)

    for raw in re.sub(r"^```\w*$", "", text or "", flags=re.M).split("\n"):
        s = raw.strip()
        head = re.match(r"^#{1,6}\s+(.*)$", s)
        if head:
            close_paragraph()
            out.append((head.group(1).strip(), []))
        elif not s:
            close_paragraph()
        else:
            block.append(s)
    close_paragraph()
    return [x for x in out if x[1]]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("paragraphs", T.ArrayType(T.StringType()))])))
def sections(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [{"title": a, "paragraphs": b} for a, b in markdown_sections(t)])


def golden_rows(raw: DataFrame) -> DataFrame:
    """(ep, start, end, label) of golden files, a column json beside ep: a list, or a list under moments; anything else has none."""
    items = raw.select("ep", F.explode(payload_items("json")).alias("j"))
    m = fields("j")
    out = items.select("ep", m["start"].try_cast("double").alias("start"), m["end"].try_cast("double").alias("end"), F.coalesce(m["label"], F.lit("good")).alias("label"))
    return out.filter("start is not null and end is not null and end > start")
