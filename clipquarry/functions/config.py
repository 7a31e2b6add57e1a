"""Configurations as JSON columns: model roles, sections, layers, and the bodies of completion requests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import col
from .text import let

NEEDED = ("scout", "cleanup_refine", "judge_metadata")
OPTIONAL = ("proofread", "article")


def section(conf: Mapping | None, *path: str) -> dict:
    """A nested section of a configuration; {} where it is missing or no section."""
    for k in path:
        conf = conf.get(k) if isinstance(conf, Mapping) else None
    return dict(conf) if isinstance(conf, Mapping) else {}


def layered(base: Mapping | None, role: str | None = None, model: str | None = None) -> dict:
    """Settings with those of the role and then those of the model over them."""
    base = dict(base or {})
    return base | section(base, "role_overrides", role or "") | section(base, "model_overrides", model or "")


def with_overrides(base: Mapping | None, over: Mapping | None) -> dict:
    """One layer over another; only the watchdog's settings are merged one by one."""
    out = dict(base or {}) | dict(over or {})
    if isinstance(section(base).get("watchdog"), Mapping) and isinstance(section(over).get("watchdog"), Mapping):
        out["watchdog"] = {**base["watchdog"], **over["watchdog"]}
    return out


def role_models(raw: Column) -> Column:
    """A JSON object of roles as a map: names trimmed and in lower case, models trimmed; blank ones go."""
    m = F.from_json(raw, "map<string,string>")
    good = F.filter(F.transform(F.map_entries(m), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.trim(F.coalesce(e["value"], F.lit(""))).alias("value"))), lambda e: (e["key"] != "") & (e["value"] != ""))
    return F.map_from_entries(good)


def roles(conf: Column | str) -> Column:
    """The model of each role as a map: the roles of a configuration, or its older list of models in order. Roles that may be missing take the model of cleanup_refine; null if one that is needed is missing."""
    c = col(conf)
    named = role_models(F.get_json_object(c, "$.llama_cpp.roles"))
    listed = F.filter(F.transform(F.from_json(F.get_json_object(c, "$.llama_cpp.models"), "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    old = let(listed, lambda m: F.when(F.size(m) >= len(NEEDED), F.map_from_arrays(F.array(*map(F.lit, NEEDED)), F.slice(m, 1, len(NEEDED)))))

    def whole(m: Column) -> Column:
        every = [F.lit(k) for k in NEEDED + OPTIONAL]
        values = [m[k] for k in NEEDED] + [F.coalesce(m[k], m["cleanup_refine"]) for k in OPTIONAL]
        ok = m["scout"].isNotNull() & m["cleanup_refine"].isNotNull() & m["judge_metadata"].isNotNull()
        return F.when(ok, F.map_from_arrays(F.array(*every), F.array(*values)))

    return let(F.when(F.size(F.map_keys(named)) > 0, named).otherwise(old), whole)


def completion_payload(prompt: Column, temperature: Column, n_predict: int, schema: Column | None = None) -> Column:
    """The JSON body of a completion request. schema: JSON text of the answer's schema, null for a free answer."""
    body = F.to_json(F.struct(prompt.alias("prompt"), F.lit(False).alias("stream"), temperature.cast("double").alias("temperature"), F.lit(n_predict).alias("n_predict")))
    if schema is None:
        return body
    return F.when(schema.isNull(), body).otherwise(F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(',"json_schema":'), schema, F.lit("}")))


def requested_quotas(processing: Column | str) -> Column:
    """Clips wanted of each kind, out of a processing section as JSON, as a map: 0 where a kind is not told; reels that are none, or not told, are reels_count, 4 by default."""
    c = col(processing)
    count = lambda path: F.coalesce(F.get_json_object(c, path).try_cast("double").try_cast("long"), F.lit(0).cast("long"))
    fallback = F.coalesce(F.get_json_object(c, "$.reels_count").try_cast("double").try_cast("long"), F.lit(4).cast("long"))
    reels = count("$.clips.reels.count")
    wanted = {"story": count("$.clips.stories.count"), "reel": F.when(reels > 0, reels).otherwise(fallback), "long_reel": count("$.clips.long_reels.count"), "highlight": count("$.clips.highlights.moments_count")}
    return F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), v)])
