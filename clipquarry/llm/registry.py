"""The queries of this subpackage and the SQL that tells their results, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jpeg, minhash, mixing, packing, pii, preferences, quality, suffix, toxicity, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jpeg": jpeg.query,
        "op2_pii": pii.query,
        "op3_minhash": minhash.query,
        "op4_repeats": suffix.query,
        "op5_preferences": preferences.query,
        "op6_vectors": vectors.query,
        "op7_toxicity": toxicity.query,
        "op8_quality": quality.query,
        "op9_packing": packing.query,
        "op10_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_repeats": suffix.SQL, "op5_preferences": preferences.SQL, "op6_vectors": vectors.SQL, "op10_mixing": mixing.SQL}
