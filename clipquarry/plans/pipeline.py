"""The pipeline over all episodes: six stages in order, each a table that is kept, so that a run goes on where the last one ended.

A stage is a function from the tables before it to its own. Speech recognition, diarization and cutting are programs outside; what
they put out comes in as tables, and what is to be cut goes out as one. A stage that may fail without harm (proofreading, the
article) is passed over, and what follows reads the table before it; a failed analysis leaves an empty table."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import STAGES, chosen_stages, ready

LOG = logging.getLogger(__name__)
Tables = dict[str, DataFrame]


@dataclass
class Stage:
    """name; needs: tables, each the first there is of its alternatives ("proofread|transcribe"); optional: whether its failure is passed over; empty: the schema of the table that stands in for it then."""

    name: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    optional: bool = False
    empty: str | None = None


def first_of(tables: Tables, names: str) -> DataFrame | None:
    return next((tables[n] for n in names.split("|") if n in tables), None)


def run(spark: SparkSession, stages: list[Stage], root: str, only: list[str] | None = None, skip: list[str] | None = None, again: bool = False) -> dict[str, str]:
    """Run the stages chosen, each into root/<name>; what happened to each: done, cached, skipped, failed or missing.

    A table that is there and complete is used as it is, unless again. A stage that lacks an input is missing. An error of a stage that is not optional ends the run."""
    names = [s.name for s in stages]
    wanted = set(chosen_stages(only, skip)) if set(names) <= set(STAGES) else {n for n in names if (not only or n in only) and n not in (skip or [])}
    tables: Tables = {}
    told: dict[str, str] = {}
    for stage in stages:
        path = f"{root}/{stage.name}"
        if ready(spark, path) and not (again and stage.name in wanted):
            tables[stage.name], told[stage.name] = spark.read.parquet(path), "cached"
            continue
        if stage.name not in wanted:
            told[stage.name] = "skipped"
            continue
        inputs = [first_of(tables, n) for n in stage.needs]
        if any(x is None for x in inputs):
            told[stage.name] = "missing"
            continue
        try:
            stage.run(*inputs).write.mode("overwrite").parquet(path)
            tables[stage.name], told[stage.name] = spark.read.parquet(path), "done"
        except Exception as e:
            if not stage.optional and stage.empty is None:
                raise
            LOG.warning("%s failed and is passed over: %s", stage.name, e)
            told[stage.name] = "failed"
            if stage.empty is not None:
                # stands in for this run only, so that the next one tries again
                tables[stage.name] = spark.createDataFrame([], stage.empty)
    return told


def swept(variants: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """The results of each variant of a run under its name, in one table."""
    out = None
    for name, make in variants.items():
        rows = make().withColumn("variant", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def best_variant(metrics: DataFrame, reels: int = 4) -> DataFrame:
    """(variant, rank_value) of the best variant: with golden figures 6 x recall of must + 3 x recall + 2 x precision - 0.75 x violations, else mean score - 0.75 x violations - 0.25 for each moment beyond reels; the first by name on a tie."""
    golden = 6 * F.col("recall_must") + 3 * F.col("recall_all") + 2 * F.col("precision") - 0.75 * F.col("violations")
    plain = F.col("avg_score") - 0.75 * F.col("violations") - 0.25 * F.greatest(F.lit(0), F.col("moments") - reels)
    ranked = metrics.select("variant", F.coalesce(golden, plain).alias("rank_value"))
    return ranked.orderBy(F.desc("rank_value"), "variant").limit(1)
