"""The corpus pipeline: toxicity, near-duplicates, PII, mixture, packing; each stage's result is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clipquarry.llm.common import read_table, shared_dir
from clipquarry.llm.minhash import dedup
from clipquarry.llm.mixing import mixed
from clipquarry.llm.packing import pack
from clipquarry.llm.pii import redact
from clipquarry.llm.toxicity import full_lexicon, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; further terms are learnt from the labels beside the documents."""
    return without_toxic(docs, full_lexicon(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least doc_id."""
    return dedup(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers in their texts replaced by the identifier's kind."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources have their target weights; none is left out."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts, laid out in bins of one capacity."""
    return pack(docs, texts=True)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii", pii), ("mixture", mixture), ("packing", packing)]
#: SQL has neither the matcher, the sketches nor the packing; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again; the folder goes when the application ends."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex[:12]}"
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
