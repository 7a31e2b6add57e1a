from clipquarry.sources import files
from clipquarry.streaming import arriving, each_batch


def test_files_are_scanned_once_each(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = str(tmp_path / "out")

    def put(name):
        (tmp_path / "in" / name).write_text('{"segments":[{"start":0,"end":1,"text":"x","words":[{"start":0,"end":1,"word":"x"}]}]}' if name != "bad" else "{")

    def sink(df, n):
        files.words(df, "path").write.mode("append").parquet(out)

    for names in (["a", "bad"], ["b"]):
        for name in names:
            put(name)
        each_batch(arriving(spark, str(tmp_path / "in")), str(tmp_path / "check"), sink).awaitTermination()
    assert sorted(r["path"][-1] for r in spark.read.parquet(out).collect()) == ["a", "b"]
