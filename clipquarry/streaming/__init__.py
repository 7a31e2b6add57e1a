"""Transcripts that arrive as files: each micro-batch goes through the same scans as a batch.

The batch engine has no notion of late data, so nothing here keeps state across batches: a transcript is a whole file, and a
file that comes again replaces its rows downstream by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files


def arriving(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """(path, json) of the JSON files of a folder, as a stream; json is null where a file is no JSON."""
    t = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", per_trigger).load(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.select("path", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).alias("json"))


def each_batch(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Transcripts of each micro-batch (path, t) to sink; once: all that is there, then the query ends."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(files.transcripts(df), n))
    return (w.trigger(availableNow=True) if once else w).start()
