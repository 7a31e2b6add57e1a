"""What a query's plan does once, and what it does not do at all."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from clipquarry import catalog
from clipquarry.operators import folds, records
from clipquarry.sources import sinks
from tests.oracle import SF


def plan(spark, name):
    return catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_faithfulness_takes_the_stems_of_a_text_once(spark):
    assert plan(spark, "faithfulness").count("regexp_extract_all") == 1


def test_article_takes_the_stems_of_source_and_edit_once_and_deals_no_text(spark):
    text = plan(spark, "article_retry")
    assert text.count("regexp_extract_all") == 2
    assert "min_by(edited" not in text and "edited, edited" not in text


def test_no_window_looks_ahead_to_the_end_of_its_partition(spark):
    """Spark counts such a frame anew for every row, so that an episode costs the square of its length."""
    for name in ("speaker_turns", "speaker_at_nearest", "asof_anchor", "nearest_allowed", "snap_start", "snap_end", "snap_record_boundaries"):
        assert "unboundedfollowing" not in plan(spark, name).replace("unboundedpreceding$(), unboundedfollowing", ""), name


def test_variants_are_worked_out_once(spark):
    assert plan(spark, "spelling_variants").count("array_distinct(") == 1


def test_lines_are_wrapped_without_python_as_the_kernel_wraps(spark):
    assert not any(x in plan(spark, "wrapped_lines") for x in ("Python", "Arrow"))
    rng = random.Random(5)
    texts = ["", " \n\t", "x" * 43, "x" * 42, "a " + "y" * 41 + " b", "\U0001f600" * 41 + " \U0001f600", *["".join(rng.choice("abcdef  \n \x1c.\U0001f600") * rng.choice([1, 1, 1, 15]) for _ in range(rng.randrange(200))) for _ in range(60)]]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", folds.wrapped_text("t").alias("l")).collect()
    assert {r["k"]: r["l"] for r in got} == {k: folds.wrapped(t) for k, t in enumerate(texts)}


def test_reel_assets_deal_a_clip_once_and_are_those_of_its_parts(spark):
    df = catalog.queries()["reel_assets"](spark, SF)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in text and text.count("Join") == 1 and text.count("Aggregate") == 1
    cues = spark.createDataFrame([("a", 0, 0, 900, "Hi."), ("a", 1, 950, 2600, "It is, as they say, a long way to the old mill on the hill and back to the house by the sea."), ("b", 0, 0, 5, "One")], "clip string, pos long, s_ms long, e_ms long, text string")
    ready = folds.per_key(cues, "clip", ["pos"], folds.subtitles, "s_ms long, e_ms long, text string").withColumn("seg", F.row_number().over(Window.partitionBy("clip").orderBy("s_ms", "e_ms")).cast("long"))
    words = records.subtitle_words(ready.withColumn("words", F.lit(None).cast(records.WORDS)), "clip").groupBy("clip", "seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s_ms", "e_ms", "word"))), lambda x: F.struct(x["s_ms"].alias("s_ms"), x["e_ms"].alias("e_ms"), x["word"].alias("word"))).alias("words"))
    want = sinks.srt(ready, "clip", ["seg"]).join(sinks.ass(ready.join(words, ["clip", "seg"]), "clip", ["seg"]), "clip").collect()
    got = sinks.reel_assets(cues, "clip", ["pos"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 2
