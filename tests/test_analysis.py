"""The staged analysis, its parts with scripted models, the pipeline and the command line."""

import json
import re

import pytest
from pyspark.sql import functions as F

from clipquarry import __main__ as cli
from clipquarry.functions import config, semistructured
from clipquarry.operators import providers, records
from clipquarry.plans import analysis, pipeline, stages
from clipquarry.sources import sinks


def timeline(spark, eps=(1,), n=20):
    """Segments of 10 s, two sentences of five words each."""
    seg, words, sent = [], [], []
    for ep in eps:
        for i in range(n):
            s = i * 10_000
            parts = [f"alpha{i} beta{i} gamma{i} delta{i} omega{i}.", f"one{i} two{i} three{i} four{i} five{i}."]
            seg.append((ep, i, "AB"[i // 5 % 2], " ".join(parts), s, s + 10_000))
            for p, part in enumerate(parts):
                sent.append((ep, i, p, "AB"[i // 5 % 2], part, s + p * 5000, s + p * 5000 + 5000))
                words += [(ep, i, p * 5 + k, "AB"[i // 5 % 2], w, s + p * 5000 + k * 1000, s + p * 5000 + k * 1000 + 900) for k, w in enumerate(part.split())]
    return (
        spark.createDataFrame(seg, "ep int, seg long, speaker string, text string, s_ms long, e_ms long"),
        spark.createDataFrame(words, "ep int, seg long, pos long, speaker string, word string, s_ms long, e_ms long"),
        spark.createDataFrame(sent, "ep int, seg long, pos long, speaker string, text string, s_ms long, e_ms long"),
    )


def scripted(fn):
    return lambda: fn


def item(start, end, title, score=5.0, **more):
    return {"start": start, "end": end, "title": title, "score": score, "why": "because it is so", **more}


def moments(spark, rows):
    empty = {c: "" for c in analysis.TEXTS} | {c: None for c in analysis.NUMBERS} | {c: [] for c in analysis.LISTS}
    full = [{"ep": 1, "clip_type": "reel", "score": 5.0, **{k: v for k, v in empty.items() if k != "clip_type"}, **r} for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in ["ep", *analysis.COLUMNS]) for r in full], "ep int, " + analysis.MOMENT)


def info(spark, duration=200_000, target=4, quotas=None):
    return spark.createDataFrame([(1, duration, quotas or {"reel": 4}, target, "Reels: 4 clips up to 60s")], "ep int, duration long, quotas map<string,long>, target long, requirements string")


def test_whole_analysis(spark):
    seg, words, sent = timeline(spark, (1, 2))

    def scout(prompt):
        assert "Reels: 2 clips up to 60s" in prompt and "# Контекст эпизода / Episode context\nsum of it" in prompt and '"chunk_id":"chunk_' in prompt and '"text"' not in prompt.split("\n")[0]
        s, e = map(int, re.findall(r"\[(\d+)-(\d+)\]", prompt)[0])
        return json.dumps({"moments": [item(s + 1.5, s + 31, f"first of {s}", 6, quote=f"beta{s // 10} gamma{s // 10} delta{s // 10}"), item(s + 33, s + 43, f"second of {s}", 4), item(5000, 5010, "elsewhere", 9)]})

    def judge(prompt):
        rows = json.loads(prompt[prompt.index("CANDIDATES\n") + 11 :])
        assert all(set(r) >= {"start", "end", "clip_type", "title", "score"} for r in rows) and any("excerpt_head" in r and "excerpt_tail" in r for r in rows)
        return json.dumps([{**r, "score": 9 if "first" in r["title"] else 2} for r in rows] + [item(9000, 9010, "invented", 10)])

    models = {"context": scripted(lambda p: '{"summary": "sum of it"}'), "scout": scripted(scout), "cleanup_refine": providers.echoing(), "judge_metadata": scripted(judge)}
    out = analysis.staged(seg, words, sent, models, analysis.Settings(quotas={"reel": 2}, chunk=60_000)).orderBy("ep", "rank").collect()
    assert {r["ep"] for r in out} == {1, 2} and all(r["rank"] <= 2 for r in out)
    for r in out:
        assert "first" in r["title"] and r["judge_score"] == 9.0 and r["priority"] > 0 and r["clip_type"] == "reel" and len(r["hashtags"]) == 5
        assert r["s"] % 5000 == 0 and r["e"] <= 200_000 and r["quote_match_ratio"] == 1.0 and r["speech_rate_wps"] > 0 and r["caption"] and r["hook"]
    one = [r for r in out if r["ep"] == 1]
    assert all(a["e"] <= b["s"] or b["e"] <= a["s"] for a in one for b in one if a["id"] != b["id"])


def test_a_failed_chunk_is_passed_over_and_all_failed_is_an_error(spark):
    seg, _, sent = timeline(spark)
    settings = analysis.Settings(chunk=60_000, context=False)
    chunked = analysis.chunks(sent.select("ep", "seg", "speaker", "text", "s_ms", "e_ms"), settings)
    ids = {r["chunk_id"] for r in chunked.collect()}
    assert len(ids) > 2

    def some(prompt):
        if "chunk_001" in prompt:
            raise RuntimeError("down")
        if "chunk_002" in prompt:
            return "no json"
        s = int(re.findall(r"\[(\d+)-", prompt)[0])
        return json.dumps({"moments": [item(s - 2, s + 20, "drifts"), item(s + 1, s + 1.5, "short"), item(s, s + 20, "named", speaker="Z")]})

    got = analysis.scout(chunked, info(spark), None, scripted(some), settings).orderBy("id").collect()
    assert {c for r in got for c in r["source_chunk_ids"]} == ids - {"chunk_001", "chunk_002"} and {r["title"] for r in got} == {"drifts", "named"}
    assert [r["id"] for r in got] == list(range(1, len(got) + 1)) and all(r["s"] % 1000 == 0 and r["selection_stage"] == "scout" for r in got)
    assert {(r["title"], r["speaker"], r["speaker_confidence"]) for r in got} <= {("drifts", "A", 0.35), ("drifts", "B", 0.5), ("drifts", "A", 0.5), ("drifts", "B", 0.35), ("named", "Z", None)}

    def none(prompt):
        raise RuntimeError("down")

    with pytest.raises(Exception, match="all calls failed"):
        analysis.scout(chunked, info(spark), None, scripted(none), settings).collect()
    assert analysis.scout(chunked, info(spark), None, scripted(lambda p: "nothing"), settings).collect() == []
    assert analysis.scout(chunked.limit(0), info(spark), None, scripted(none), settings).collect() == []


def test_cleanup_keeps_a_batch_that_fails(spark):
    rows = [{"id": i, "s": i * 10_000, "e": i * 10_000 + 9000, "title": f"t{i}", "score": float(i)} for i in range(6)]

    def model(prompt):
        got = json.loads(prompt[prompt.index("CANDIDATES\n") + 11 :])
        return json.dumps(got[:1]) if got[0]["title"] == "t0" else "nothing"

    out = analysis.cleaned(moments(spark, rows), info(spark), scripted(model), analysis.Settings(cleanup_batch=3)).collect()
    assert sorted((r["title"], r["selection_stage"]) for r in out) == [("t0", "cleanup_refine"), ("t3", ""), ("t4", ""), ("t5", "")] and len({r["id"] for r in out}) == 4


def test_guard_and_top_up(spark):
    pool = moments(spark, [{"id": i, "s": i * 10_000, "e": i * 10_000 + 8000, "title": f"p{i}", "score": float(i)} for i in range(8)])
    kept = moments(spark, [{"id": 1, "s": 70_000, "e": 78_000, "title": "kept"}, {"id": 2, "s": 900_000, "e": 910_000, "title": "invented"}])
    settings = analysis.Settings()
    guarded = analysis.guarded(kept, pool, settings)
    assert [r["title"] for r in guarded.collect()] == ["kept"]
    assert analysis.guarded(kept.filter("title = 'invented'"), pool, settings).count() == 8
    assert analysis.guarded(kept, pool, analysis.Settings(require_overlap=False)).count() == 2
    topped = analysis.topped_up(guarded, pool, info(spark, target=3)).orderBy("id").collect()
    assert [r["title"] for r in topped] == ["kept", "p6", "p5", "p4", "p3", "p2"]


def test_judge_snap_and_clamp(spark):
    _, words, sent = timeline(spark)
    m = moments(spark, [{"id": 1, "s": 11_200, "e": 31_500, "title": "a", "quote": "beta1 gamma1"}, {"id": 2, "s": 190_500, "e": 230_000, "title": "b", "clip_type": "story"}, {"id": 3, "s": 205_000, "e": 206_000, "title": "gone"}])
    shown = []

    def model(prompt):
        shown.append(prompt)
        return "no answer"

    same = analysis.judged(m, words, sent, info(spark), None, scripted(model), analysis.Settings()).orderBy("s").collect()
    assert [(r["title"], r["judge_score"]) for r in same] == [("a", None), ("b", None), ("gone", None)]
    text = {r["__row"]: r["text"] for r in analysis.text_between(m.withColumn("__row", F.concat_ws("-", "ep", "id")), words, sent, "__row", 20).collect()}
    assert text["1-1"] == "beta1 gamma1 delta1…" and text["1-3"] == ""
    cut = analysis.within_episode(analysis.snapped(m, words, sent, 3000), info(spark)).orderBy("id").collect()
    assert [(r["s"], r["e"]) for r in cut] == [(10_000, 31_900), (190_000, 200_000)]
    seen = {r["id"]: (r["quote_match_ratio"], r["s"]) for r in analysis.verified(m, words).collect()}
    assert seen[1] == (1.0, 11_000) and seen[2][0] == 0.0
    chosen = analysis.selected(analysis.snapped(m, words, sent, 3000), info(spark, quotas={"reel": 1, "story": 0}), analysis.Settings()).collect()
    assert [r["title"] for r in chosen] == ["a"]


def test_text_of_a_span_without_length_is_the_word_it_lies_in(spark):
    _, words, sent = timeline(spark)
    spans = spark.createDataFrame([(1, 1, 11_200, 11_200), (1, 2, 11_000, 11_000), (1, 3, 11_950, 11_950), (1, 4, 900_000, 900_000)], "ep int, id long, s long, e long")
    text = {r["id"]: r["text"] for r in analysis.text_between(spans, words, sent, "id").collect()}
    assert text == {1: "beta1", 2: "alpha1 beta1 gamma1 delta1 omega1.", 3: "alpha1 beta1 gamma1 delta1 omega1.", 4: ""}


def test_proofread_article_and_names(spark):
    seg = spark.createDataFrame([(1, k, t) for k, t in enumerate(["hello wrold today", "all is fine", "a b c"])] + [(2, 0, "left alone")], "ep int, seg long, text string")

    def reader(prompt):
        rows = json.loads(prompt[prompt.index("\n") + 1 :])
        if any(r["text"] == "left alone" for r in rows):
            raise RuntimeError("down")
        return json.dumps({"segments": [{"id": r["id"], "text": {"hello wrold today": "hello world today", "a b c": "quite another text of many words"}.get(r["text"], r["text"])} for r in rows]})

    got = {(r["ep"], r["seg"]): (r["verdict"], r["text"]) for r in stages.corrected(seg, scripted(reader)).collect()}
    assert got == {(1, 0): ("applied", "hello world today"), (1, 1): ("same", "all is fine"), (1, 2): ("rejected", "a b c"), (2, 0): ("none", "left alone")}

    said = "wonderful mountains surround beautiful villages everywhere"
    chunks = spark.createDataFrame([(1, 0, said), (1, 1, said + " forever"), (1, 2, "something entirely")], "ep int, chunk long, source string")

    def writer(prompt):
        again = stages.RETRY in prompt
        text = prompt.split("\n")[1]
        if "entirely" in text:
            return ""
        return f"# T\n\n{text}" if again or "forever" not in text else "# T\n\nincomparable hallucination happened yesterday"

    got = {r["chunk"]: (r["try"], r["faithful"]) for r in stages.written(chunks, scripted(writer)).collect()}
    assert got == {0: (1, True), 1: (2, True)}

    turns = spark.createDataFrame([(1, 0, "S0", "hi, I am Ann"), (1, 1, "S1", "and I am Bob"), (1, 2, "S2", "me too"), (2, 0, "S0", "alone")], "ep int, turn long, speaker string, text string")
    names = stages.speaker_names(turns, scripted(lambda p: '{"speakers": [{"id": "S0", "name": " Ann  B"}, {"id": "S9", "name": "X"}, {"id": "S1", "name": "ann b"}, {"id": "S2", "name": "Bob"}]}'))
    assert sorted(map(tuple, names.collect())) == [(1, "S0", "Ann B"), (1, "S2", "Bob")]


def test_salvage_by_trying_every_cut():
    whole = '{"a": [1, {"b": "x, y"}, [2, "c"]], "d": {"e": true}}'
    for n in range(len(whole) + 1):
        best = None
        for cut in range(n, 0, -1):
            for ends in ("", "}", "]}", "}]}", "]]}", "}}"):
                try:
                    best = json.loads(whole[:cut].rstrip().rstrip(",") + ends)
                    break
                except ValueError:
                    continue
            if best is not None:
                break
        got = semistructured.salvage("so: " + whole[:n])
        if got is None:
            assert best in (None, {}, []), n
        else:
            assert len(json.dumps(json.loads(got))) <= len(json.dumps(json.loads(whole)))
            assert json.loads(got) == best or json.loads(got)["a"][0] == 1, n


def test_records(spark):
    out = records.accepted([{"s": 3, "e": 40}, {"s": 4, "e": 41}, {"s": None, "e": 1}, {"s": 100, "e": 110}, {"s": 300, "e": 350}], [0, 100, 170], [35, 140, 200], 5)
    assert [(r["s"], r["e"]) for r in out] == [(0, 35), (100, 140)]
    chunk = spark.createDataFrame([(1, "c1", [0, 9], "x"), (1, "c2", [7], "[1-2] (A) hi\n[2-3] there"), (1, "c3", [], None)], "ep int, chunk_id string, segments array<long>, text string")
    seg = spark.createDataFrame([(1, 0, " said ")], "ep int, seg long, text string")
    assert {r["chunk_id"]: r["text"] for r in records.plain_text(chunk, seg, "ep").collect()} == {"c1": "said", "c2": "hi there", "c3": ""}
    runs = spark.createDataFrame([("a", 10.0, 5.0), ("a", 10.0, 50.0), ("a", 10.0, 0.7), ("b", 1.0, None), ("c", 2.0, 9.0), ("c", 2.0, 9.0), ("c", 2.0, 9.0)], "model string, seconds double, score double")
    results = records.model_results(runs)
    assert {r["model"]: (r["moments"], r["avg_score"], r["valid"]) for r in results.collect()} == {"a": (3, pytest.approx(17 / 3), True), "b": (0, 0.0, False), "c": (3, 9.0, True)}
    assert records.winners(results).first().asDict() == {"winner": "c", "best": "c", "fastest": "c", "highest": "c"}
    assert "| b | 1s | 0 | 0.0 |" in records.comparison_markdown(results).first()["markdown"]
    m = moments(spark, [{"id": 1, "s": 1234, "e": 5000, "title": "t", "hashtags": ["#a"], "speaker": "A", "priority": 2.5}])
    assert json.loads(m.select(semistructured.moment_json(analysis.column).alias("j")).first()["j"]) == {"start": 1.234, "end": 5.0, "title": "t", "quote": "", "why": "", "score": 5.0, "clip_type": "reel", "hook": "", "caption": "", "hashtags": ["#a"], "speaker": "A", "priority": 2.5}


def test_passes_and_files(spark):
    eps = spark.createDataFrame([(1, "text", [0, 100, 200], [40, 140, 250]), (2, "bad", [0], [40]), (3, None, [0], [40])], "ep int, transcript string, starts array<int>, ends array<int>")

    def model(prompt):
        if "bad" in prompt:
            raise RuntimeError("down")
        if "TAKEN" not in prompt:
            return '[{"start": 1, "end": "40", "title": "a"}, {"start": "x", "end": 3}, 5]'
        return json.dumps({"moments": [{"start": 1, "end": 40, "title": "again"}, {"start": 100, "end": 140, "title": "b"}]}) if "[0-40]" in prompt else "none"

    got = providers.in_passes(eps, scripted(model), "P {transcript}", 3).orderBy("ep", "rank").collect()
    assert [(r["ep"], r["rank"], r["s"], r["e"], r["title"], r["pass"], r["error"]) for r in got] == [(1, 1, 0, 40, "a", 1, None), (1, 2, 100, 140, "b", 2, None), (2, None, None, None, None, None, "RuntimeError: down"), (3, 1, 0, 40, "a", 1, None)]
    files_ = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")

    def recognise(path):
        if path == "b":
            raise OSError("broken")
        return f"{path}!"

    ran = providers.each_file(files_, scripted(recognise), spark.createDataFrame([("c",)], "path string"))
    assert sorted((r["path"], r["status"], r["result"]) for r in ran.collect()) == [("a", "done", "a!"), ("b", "failed", None), ("c", "skipped", None)]
    assert {r["status"]: r["count"] for r in ran.groupBy("status").count().collect()} == {"done": 1, "failed": 1, "skipped": 1}


def test_configuration():
    conf = {"analysis": {"quotes": {"enabled": False}, "bad": 3}}
    assert config.section(conf, "analysis", "quotes") == {"enabled": False} and config.section(conf, "analysis", "bad") == {} and config.section(None, "x") == {}
    base = {"t": 1, "role_overrides": {"scout": {"t": 2, "u": 1}}, "model_overrides": {"m": {"u": 2}}}
    assert {k: config.layered(base, "scout", "m")[k] for k in "tu"} == {"t": 2, "u": 2} and config.layered(base)["t"] == 1 and config.layered(None) == {}
    assert config.with_overrides({"a": 1, "watchdog": {"x": 1, "y": 2}}, {"a": 2, "watchdog": {"y": 3}}) == {"a": 2, "watchdog": {"x": 1, "y": 3}}


def test_pipeline_goes_on_where_it_ended(spark, tmp_path):
    calls = []

    def stage(name, rows=1, fails=False):
        def run(*inputs):
            calls.append((name, [i.columns for i in inputs]))
            if fails:
                raise RuntimeError("no")
            return spark.range(rows).withColumnRenamed("id", name)

        return run

    graph = lambda fails: [
        pipeline.Stage("transcribe", stage("transcribe")), pipeline.Stage("proofread", stage("proofread", fails=fails), ("transcribe",), optional=True),
        pipeline.Stage("article", stage("article"), ("proofread|transcribe",), optional=True), pipeline.Stage("analyze", stage("analyze", fails=fails), ("proofread|transcribe",), empty="analyze long"), pipeline.Stage("cut", stage("cut"), ("analyze", "diarize")),
    ]
    root = str(tmp_path / "run")
    told = pipeline.run(spark, graph(True), root)
    assert told == {"transcribe": "done", "proofread": "failed", "article": "done", "analyze": "failed", "cut": "missing"}
    assert ("article", [["transcribe"]]) in calls
    calls.clear()
    told = pipeline.run(spark, graph(False), root, skip=["article"])
    assert told == {"transcribe": "cached", "proofread": "done", "article": "cached", "analyze": "done", "cut": "missing"} and [c[0] for c in calls] == ["proofread", "analyze"]
    with pytest.raises(ValueError):
        pipeline.run(spark, graph(False), root, only=["nope"])
    rows = pipeline.swept({"a": lambda: spark.range(2), "b": lambda: spark.range(1)})
    assert rows.groupBy("variant").count().orderBy("variant").collect()[0]["count"] == 2
    metrics = spark.createDataFrame([("a", 5.0, 4, 0, 1.0, 0.5, 0.5), ("b", 9.0, 9, 1, 0.0, 0.5, 0.5), ("c", 5.0, 4, 0, 1.0, 0.5, 0.5)], "variant string, avg_score double, moments long, violations long, recall_must double, recall_all double, precision double")
    assert pipeline.best_variant(metrics).first().asDict() == {"variant": "a", "rank_value": 8.5}
    assert pipeline.best_variant(metrics.withColumn("recall_must", F.lit(None).cast("double"))).first()["variant"] == "b"


def test_command_line_and_files(spark, tmp_path, capsys):
    seg = [{"start": i * 10, "end": i * 10 + 10, "text": f"Alpha{i} beta gamma delta. Omega{i} sigma tau.", "speaker": "A", "words": [{"start": i * 10 + k, "end": i * 10 + k + 1, "word": w} for k, w in enumerate(f"Alpha{i} beta gamma delta. Omega{i} sigma tau.".split())]} for i in range(12)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.json").write_text(json.dumps({"segments": seg}))
    (tmp_path / "in" / "diarization.json").write_text("[]")
    (tmp_path / "in" / "broken.json").write_text("{")
    assert cli.main(["analyse", "--transcripts", str(tmp_path / "in"), "--out", str(tmp_path / "out")]) == 0
    assert "analyze: done" in capsys.readouterr().out
    assert {r["ep"] for r in spark.read.parquet(str(tmp_path / "out" / "analyze")).collect()} == {"one"}
    assert spark.read.parquet(str(tmp_path / "out" / "cut")).first()["markdown"].startswith("# ")
    assert cli.main(["query", "quota_topk", "--data", "/root/testdata/sf0.001", "--out", str(tmp_path / "q")]) == 0
    assert spark.read.parquet(str(tmp_path / "q" / "quota_topk")).count() > 0
    target = tmp_path / "files" / "a.json"
    for value in ({"k": "é"}, [1]):
        sinks.write_json(spark, str(target), value)
        assert json.loads(target.read_text()) == value and target.read_text().endswith("\n")
    assert [p.name for p in target.parent.iterdir() if not p.name.endswith(".crc")] == ["a.json"]
