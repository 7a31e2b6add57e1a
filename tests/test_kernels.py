"""Kernels on hand-made rows."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from clipquarry.functions import scoring, semistructured, text
from clipquarry.operators import aggregates, folds, intervals, matching, providers
from clipquarry.plans import stages
from clipquarry.sources import files, sinks


def one(spark, *cols):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_clip_slice_is_cut_and_rebased(spark):
    clip = spark.createDataFrame([(1, 5000, 15000)], "ep int, s long, e long")
    seg = spark.createDataFrame([(1, 3000, 6000), (1, 8000, 12000), (1, 14500, 18000), (1, 20000, 21000)], "ep int, s2 long, e2 long")
    x = intervals.overlap_join(clip, seg, "ep", 4000).select(F.greatest("s", "s2") - F.col("s"), F.least("e", "e2") - F.col("s"))
    assert sorted(map(tuple, x.collect())) == [(0, 1000), (3000, 7000), (9500, 10000)]


def test_speaker_in_a_gap_is_the_nearest(spark):
    spans = spark.createDataFrame([(1, 0, 0, 2000, "A"), (1, 1, 3000, 5000, "B")], "ep int, pos long, s long, e long, speaker string")
    points = spark.createDataFrame([(1, 1, 2400), (1, 2, 2900), (1, 3, 2500), (1, 4, 4000), (2, 5, 1)], "ep int, id long, t long")
    got = {r["id"]: r["speaker"] for r in intervals.containing_or_nearest(points, spans, "ep", "id", "speaker").collect()}
    assert got == {1: "A", 2: "B", 3: "A", 4: "B", 5: ""}


def test_apportionment(spark):
    mix = dict(story=2, reel=3, long_reel=1, highlight=5)
    a, b, c = one(spark, aggregates.apportioned(mix, F.lit(7200).cast("long"), 11), aggregates.apportioned(mix, F.lit(0).cast("long"), 11), aggregates.apportioned({"story": 0}, F.lit(3600).cast("long"), 3))
    assert a == dict(zip(mix, (4, 6, 2, 10), strict=True)) and b == mix and c == {"reel": 3}


def test_zero_quota_shuts_a_kind_out():
    rows = [{"id": i, "s": i * 100, "e": i * 100 + 50, "value": 5.0, "clip_type": k, "title": t} for i, (k, t) in enumerate([("story", "alpha beta"), ("reel", "gamma delta"), ("reel", "gamma delta")])]
    assert [r["id"] for r in folds.ranked(rows, {"story": 0, "reel": 2})] == [1, 2]
    assert [r["id"] for r in folds.ranked(rows, {"reel": 1}, total=2)] == [1, 0]
    assert [r["id"] for r in folds.ranked(rows, {})] == [1, 2]


def test_chunks_overlap():
    units = [{"seg": i, "s_ms": i * 10_000, "e_ms": (i + 1) * 10_000, "text": f"t{i}.", "speaker": "AB"[i % 2]} for i in range(12)]
    got = list(folds.overlapping_chunks(units, 50_000, 10_000, 20_000))
    assert [(g["s_ms"], g["e_ms"], g["units"]) for g in got] == [(0, 50_000, 5), (30_000, 80_000, 5), (60_000, 110_000, 5), (90_000, 120_000, 3)]
    assert got[0]["text"].startswith("[0-10] (A) t0.") and got[0]["overlap_right"] and not got[-1]["overlap_right"]
    assert [g["units"] for g in folds.overlapping_chunks(units, 10**9, 40, 0)] == [2] * 6
    assert list(folds.overlapping_chunks([], 1, 1, 1)) == []


def test_speaker_runs_and_turns(spark):
    labels = spark.createDataFrame([(k, i, w) for k, x in enumerate(["AABAACC", "ABABA", "B", "AABBA", "ABBA"]) for i, w in enumerate(x)], "k int, pos int, who string")
    got = {r["k"]: [(x["who"], x["first"], x["end"]) for x in r["runs"]] for r in folds.word_runs(labels, ["k"]).collect()}
    assert got == {0: [("A", 0, 5), ("C", 5, 7)], 1: [("A", 0, 5)], 2: [("B", 0, 1)], 3: [("A", 0, 2), ("B", 2, 4), ("A", 4, 5)], 4: [("A", 0, 1), ("B", 1, 3), ("A", 3, 4)]}
    words = [(i * 500, i * 500 + 400) for i in range(8)]
    rows = [(1, 0, "One two three four. Five six seven eight", 0, 4000, words), (1, 1, "nine", 4000, 4500, None), (1, 2, None, 4500, 5000, None), (2, 0, "alone", 0, 1000, [])]
    seg = spark.createDataFrame(rows, "ep int, seg int, text string, s_ms long, e_ms long, words array<struct<s_ms:long,e_ms:long>>")
    spans = spark.createDataFrame([(1, 0, 0, 2300, "A"), (1, 1, 2300, 4000, "B")], "ep int, pos long, s long, e long, speaker string")
    got = [(t["speaker"], t["s_ms"], t["e_ms"], t["text"]) for t in folds.speaker_turns(seg, spans, "ep").orderBy("turn").collect()]
    assert got == [("A", 0, 2400, "One two three four."), ("B", 2500, 4500, "Five six seven eight nine")]


def test_ranking_by_trying_all_pairs():
    rng = random.Random(7)

    def shared(a, b):
        return min(a["e"], b["e"]) - max(a["s"], b["s"])

    for _ in range(60):
        rows = [{"id": i, "s": (s := rng.randrange(300)), "e": s + rng.randrange(1, 60), "value": float(rng.randrange(5)), "clip_type": rng.choice(["story", "hot", "reel", "long reel"]), "title": rng.choice(["alpha beta", "alpha", "beta gamma", "", None])} for i in range(40)]
        kept = []
        for r in sorted(rows, key=lambda r: (-r["value"], r["s"], r["e"], r["title"] or "", r["id"])):
            if all(shared(r, k) < 0.35 * max(r["e"] - r["s"], k["e"] - k["s"]) for k in kept):
                kept.append(r)
        assert [r["id"] for r in folds.deduped(rows)] == [r["id"] for r in kept]
        quota = {"story": 1, "reel": 2, "highlight": 1, "long_reel": 0}
        got = folds.ranked(rows, quota, total=9)
        assert len(got) <= 9 and all(shared(a, b) <= 0 for a in got for b in got if a["id"] != b["id"])
        strict = folds.ranked(rows, quota)
        assert [r["id"] for r in strict] == [r["id"] for r in got][: len(strict)]
        for kind, n in quota.items():
            assert sum(r["bucket"] == kind for r in strict) <= n
        left = [r for r in kept if r["id"] not in {g["id"] for g in got} and all(shared(r, g) <= 0 for g in got)]
        assert len(got) == 9 or not left


def test_top_up_takes_the_best_that_overlap_nothing():
    rows = [{"id": 1, "s": 0, "e": 10, "value": 1, "kept": True}, {"id": 2, "s": 5, "e": 20, "value": 9, "kept": False}, {"id": 3, "s": 10, "e": 20, "value": 3, "kept": False}, {"id": 4, "s": 30, "e": 40, "value": 5, "kept": False}]
    assert [r["id"] for r in folds.topped_up(rows, 3)] == [1, 4, 3] and [r["id"] for r in folds.topped_up(rows, 1)] == [1]


def test_names_that_are_free(spark, tmp_path):
    taken = spark.createDataFrame([("a.mp4",), ("a_1.mp4",), ("a_3.mp4",), ("b",), ("it's.mp4",)], "name string")
    got = dict(map(tuple, files.free_names(spark.createDataFrame([("a.mp4",), ("b",), ("c.mp4",), ("it's.mp4",), ("a_1.mp4",)], "name string"), taken).collect()))
    assert got == {"a.mp4": "a_2.mp4", "b": "b_1", "c.mp4": "c.mp4", "it's.mp4": "it's_1.mp4", "a_1.mp4": "a_1_1.mp4"}
    for name in ("it's.json", "other.json", "diarization.json"):
        (tmp_path / name).write_text("{}")
    assert files.transcript_of(files.listing(spark, str(tmp_path)), "it's").first()["name"] == "it's.json"
    audio = spark.createDataFrame([(1, "x.wav", "y.wav"), (2, None, "y.wav"), (3, "z", None)], "k int, source_audio string, audio string")
    there = spark.createDataFrame([("y.wav",), ("y.wav",)], "path string")
    assert dict(map(tuple, files.source_audio(audio, there, "k").collect())) == {1: "y.wav", 2: "y.wav", 3: None}


def test_subtitles_do_not_overlap_and_keep_the_words():
    rows = [{"s_ms": i * 1000, "e_ms": i * 1000 + 1400, "text": f"word{i}, and more of it in row {i}."} for i in range(20)]
    out = folds.subtitles(rows, 40)
    assert all(a["e_ms"] <= b["s_ms"] for a, b in zip(out, out[1:], strict=False)) and all(len(o["text"]) <= 40 for o in out)
    assert " ".join(o["text"] for o in out) == " ".join(r["text"] for r in rows)


def test_srt_cues_join_short_sentences():
    rows = [{"s_ms": i, "e_ms": i + 1, "text": t} for i, t in enumerate("Ага.|Угу.|Не знаю я.".split("|"))]
    assert [c["text"] for c in folds.srt_cues(rows)] == "Ага. Угу.|Не знаю я.".split("|")


def test_json_salvage():
    cases = {'```json\n{"zz": 7}\n```': '{"zz": 7}', 'so: [1, 2] end': "[1, 2]", '{"a": [1, {"b": "x': '{"a": [1, {}]}', '{"a": "b", "c": tru': '{"a": "b"}', "none": None, "": None, '<think>[1]</think>{"k": 2}': '{"k": 2}', '[{"t": "a\\"b"}, {"t"': '[{"t": "a\\"b"}]'}
    for raw, want in cases.items():
        got = semistructured.salvage(raw)
        assert got == want or (want and "t" in raw and got and got.startswith('[{"t": "a\\"b"}')), raw


def test_markdown_sections():
    md = "intro\n\n# One\n\na\nb\n\n## Two\n\n{\"x\": 1}\n\n# Three\n\nc\n\nd"
    assert semistructured.markdown_sections(md) == [("", ["intro"]), ("One", ["a b"]), ("Three", ["c", "d"])]
    assert semistructured.markdown_sections(None) == []


def test_corrections_are_guarded(spark):
    pairs = [("Hello, wrold today", "Hello, world today", True), ("Hello world", "Hello world and a lot more words here", False), ("a b", "A, b!", True), ("", "", True), ("x", "", False), (None, "x", False)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = [r["ok"] for r in df.select("i", matching.safe_correction("a", "b").alias("ok")).orderBy("i").collect()]
    assert got == [p[2] for p in pairs]


def test_best_window():
    said = "so then we went to the old mill by the river and".split()
    assert matching.best_window("The old mill", said) == (1.0, 5, 8)
    assert matching.best_window("", said)[0] == 0 and matching.best_window("x", []) == (0.0, 0, 0)


def test_best_window_is_that_of_every_window_tried():
    rng = random.Random(3)
    for _ in range(200):
        words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6))) for _ in range(12)]
        said, n = [rng.choice(words) for _ in range(30)], rng.randrange(1, 12)
        at = rng.randrange(30 - n)
        quote = " ".join(w if rng.random() < 0.8 else "zz" for w in said[at : at + n])
        tried = [(difflib.SequenceMatcher(None, quote, " ".join(said[k : k + n])).ratio(), -k) for k in range(31 - n)]
        best, k = max(tried)
        assert matching.best_window(quote, said) == ((best, -k, n - k) if best else (0.0, 0, n))


def test_words_near_a_span_are_those_of_the_plain_join(spark):
    rng = random.Random(7)
    words = [(k % 3, s, s + rng.randrange(0, 900), k // 7, k % 7, f"w{rng.randrange(9)}") for k in range(400) for s in [rng.randrange(0, 60_000)]]
    spans = [(k % 4, k, s, s + rng.choice([-500, 0, 1, 900, 4000, 15_000, 40_000])) for k in range(120) for s in [rng.randrange(-2000, 62_000)]] + [(1, 120, None, 5)]
    w = spark.createDataFrame(words, "ep int, s2 long, e2 long, seg long, pos long, t string")
    x = matching.said_near(spark.createDataFrame(spans, "ep int, id long, s long, e long"), w, "ep", "id", 300, 2000)
    got = {r["id"]: [tuple(y) for y in r["w"] or []] for r in x.collect()}
    near = lambda s, e, y: s is not None and s - 300 <= e + 300 and y[1] < e + 300 and s - 300 < y[2]
    assert got == {i: sorted((y[1], y[3], y[4], y[5], y[2]) for y in words if y[0] == ep and near(s, e, y)) for ep, i, s, e in spans}


def test_plain_search_finds_what_the_window_finds(spark):
    said = "on the day of the old mill and the old mill again".split()
    quotes = ["The old mill!", "on", "again", "he old mill", "of the new mill", "", "the day of the old mill and the old mill again and on"]
    x = spark.createDataFrame([(q, said) for q in quotes], "q string, said array<string>").select("q", matching.exact_window("q", F.col("said")).alias("x"))
    got = {r["q"]: tuple(r["x"]) if r["x"] else None for r in x.collect()}
    assert got == {q: w if w[0] == 1 else None for q in quotes for w in [matching.best_window(q, said)]}
    assert got["The old mill!"] == (1.0, 4, 7) and got["he old mill"] is None


def test_every_sentence_is_a_quote_and_whole(spark, tmp_path):
    same = "a quote is cut nowhere, and this one runs on for far more than sixty characters before it says "
    turns = [(1, 0, "user", f"Is it so? Yes, it is. {same}north. Then the end."), (1, 1, "assistant", f"First things first! {same}south."), (2, 0, "user", "Alone")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["row"]: r["quote_match_ratio"] for r in stages.quote_verify(spark, str(tmp_path)).collect()}
    assert set(got) == {"1-0-0", "1-0-1", "1-0-2", "1-0-3", "1-1-0", "1-1-1", "2-0-0"}
    assert set(got.values()) == {1.0}


def test_term_fixes_keep_endings_and_capitals(spark):
    assert matching.with_term_fixes("Курократа и курократ", [("курократ", "курокрад")]) == ("Курокрада и курокрад", 2)
    assert one(spark, matching.spelling_variants(F.lit("Abde"), swaps={"d": "t", "b": "p", "a": "o"}))[0] == ["Abte", "Apde"]


def test_provider_failures_stay_in_their_row(spark):
    def make():
        def ask(prompt):
            if "bad" in prompt:
                raise RuntimeError("down")
            return "[1]" if "JSON only" in prompt or "good" in prompt else "no"

        return ask

    df = spark.createDataFrame([("good",), ("bad",), ("again",), (None,)], "prompt string")
    got = {r["prompt"]: (r["reply"], r["error"]) for r in providers.generate(df, make).collect()}
    assert got == {"good": ("[1]", None), "bad": (None, "RuntimeError: down"), "again": ("[1]", None), None: (None, None)}


def test_coerced_and_items(spark):
    reply = F.lit('{"moments":[{"start":"1","end":2,"title":"t","x":5},{"start":3,"end":1,"title":"t"}]}')
    rows = spark.range(1).select(F.explode(semistructured.payload_items(reply)).alias("j")).select(semistructured.coerced("j").alias("m")).collect()
    assert rows[0]["m"]["extra"] == {"x": "5"} and rows[0]["m"]["start"] == 1.0 and rows[1]["m"] is None
    assert one(spark, semistructured.payload_items(F.lit("oops")), semistructured.payload_items(F.lit(None).cast("string"))) == [[], []]


def test_time_codes_and_text(spark):
    assert one(spark, text.srt_time(F.lit(3_661_007)), text.ass_time(F.lit(3_661_007)), text.hms(F.lit(61_999)), text.srt_time(F.lit(-5))) == ["01:01:01,007", "1:01:01.00", "01:01", "00:00:00,000"]
    assert one(spark, text.normalised(F.lit("Привет, МИР! Ещё…")), text.normalised(F.lit(None).cast("string"))) == ["привет мир еще", ""]
    assert one(spark, text.trimmed(F.lit("aaa bbb ccc, ddd"), 13), text.file_size(F.lit(2048)), text.font_name(F.lit("f/my_font-bold.ttf"))) == ["aaa bbb...", "2.0 KB", "My Font Bold"]
    assert one(spark, text.excerpt(F.lit("one two three"), 9), text.excerpt(F.lit("one two three"), 5), text.first_lines(F.lit("ab\ncdefg"), 4), text.first_lines(F.lit("abcdefg\nh\nij"), 9)) == ["one two…", "one t…", "ab\nc", "abcdefg\nh"]


def test_descriptions_and_tags(spark):
    row = spark.createDataFrame([(1, "Играем в D&D 5e сегодня", "Про эту игру и это видео #tag , да", "", "", "", "story"), (2, "", "", "", "", None, "reel"), (3, "One", "", "Два #x", "", "why not", "hot take")], "id int, title string, caption string, hook string, quote string, why string, clip_type string")
    got = {r["id"]: (r["d"], r["s"], r["t"]) for r in row.select("id", text.description().alias("d"), text.subject("title", "hook", "quote", "why").alias("s"), text.hashtags(F.array(F.lit("#Two words"), F.lit(None)), [text.description(), "caption", "hook", "title", "quote", "why"], scoring.bucket()).alias("t")).collect()}
    assert got[1] == ("Про D&D 5e и D&D 5e, да", "D&D 5e", ["#two", "#words", "#5e", "#эту", "#игру"]) and got[2] == ("Strong podcast moment.", "", ["#two", "#words", "#strong", "#podcast", "#moment"])
    assert got[3][:2] == ("Два One why not", "") and got[3][2] == ["#two", "#words", "#два", "#one", "#highlight"]


def test_scoring_of_missing_values(spark):
    row = spark.createDataFrame([(None,) * 8], "title string, quote string, why string, hook string, caption string, speaker string, speaker_confidence double, quote_match_ratio double")
    row = row.withColumns({c: F.lit(None).cast("double") for c in ("audio_energy_db", "audio_silence_ratio", "speech_rate_wps", "s", "e", "score")}).withColumn("clip_type", F.lit(None).cast("string"))
    got = row.select(*[c.alias(n) for n, c in scoring.breakdown().items()], scoring.priority().alias("p")).first().asDict()
    assert (got["hook_score"], got["quote_grounding_score"], got["audio_quality_score"], got["speech_rate_score"], got["duration_score"]) == (0.0, 0.5, 0.5, 0.5, 0.0)
    assert scoring.weights({"hook": "2", "nope": 1, "base": "x"})["hook"] == 2.0


def test_files_and_sinks(spark, tmp_path):
    for name in ("b.mp4", "b.mkv", "b.mp3", "a.mov", "b.json", "b.proofread.json", "diarization.json"):
        (tmp_path / name).write_text('[{"start":1,"end":2,"label":"must"},{"start":2,"end":2}]')
    f = files.listing(spark, str(tmp_path))
    assert [(r["stem"], len(r["companions"])) for r in files.queue(f).orderBy("stem").collect()] == [("a", 0), ("b", 1)]
    assert files.transcript_of(f, "b").first()["name"] == "b.proofread.json" and files.newest(f, files.AUDIO).count() == 1
    assert files.audio_files(f).count() == 1
    g = semistructured.golden_rows(files.json_files(spark, str(tmp_path / "b.json")).withColumn("ep", F.lit(1)))
    assert [tuple(r) for r in g.collect()] == [(1, 1.0, 2.0, "must")]
    cues = spark.createDataFrame([(1, 0, 1500, "a"), (1, 2000, 2500, "b")], "ep int, s_ms long, e_ms long, text string")
    assert sinks.srt(cues, "ep", ["s_ms"]).first()["srt"] == "\n".join(["1", "00:00:00,000 --> 00:00:01,500", "a", "", "2", "00:00:02,000 --> 00:00:02,500", "b", ""])
    sinks.write_texts(sinks.srt(cues, "ep", ["s_ms"]), str(tmp_path / "out"), "srt", "ep")
    assert stages.ready(spark, str(tmp_path / "out")) and not stages.ready(spark, str(tmp_path / "none"))
    cache = files.lookup_cache(spark.createDataFrame([('{"b": 2, "a": 1, "c": "x"}',)], "json string"))
    assert sinks.cache_json(cache).first()["json"] == '{"a":1,"b":2}'
    article = spark.createDataFrame([(1, 0, "", ["p", "q"]), (1, 1, " T ", ["r"])], "ep int, pos int, title string, paragraphs array<string>")
    assert sinks.article_markdown(article, "ep").first()["markdown"] == "p\n\nq\n\n## T\n\nr\n"


def test_stage_choice():
    assert stages.chosen_stages(["cut", "analyze"]) == ["analyze", "cut"] and "cut" not in stages.chosen_stages(skip=["cut"])
    for bad in ({"only": ["cutt"]}, {"only": ["cut"], "skip": ["cut"]}):
        with pytest.raises(ValueError):
            stages.chosen_stages(**bad)


def test_empty_frames(spark):
    m = spark.createDataFrame([], "ep long, id long, s long, e long, value double")
    assert folds.nms(m, "ep").collect() == []
    assert intervals.overlap_semi(m, m, "ep", "id", 10).collect() == []
    assert folds.per_key(m, "ep", ["id"], lambda r: r, "id long").collect() == []


def test_proofread_query_equals_difflib(spark):
    import difflib
    import re

    from clipquarry.plans import views
    from tests.oracle import SF

    def norm(x):
        return " ".join(re.findall(r"[^\W_]+", x.lower().replace("ё", "е")))

    seg = views.segments(spark, SF)
    fixes = {(r["ep"], r["seg"]): r["corrected"] for r in stages._fixes(seg).collect()}
    got = {(r["ep"], r["seg"]): r["verdict"] for r in stages.queries["proofread_guard"](spark, SF).collect()}
    counts = {r["ep"]: r.asDict() for r in stages.queries["proofread_counts"](spark, SF).collect()}
    for ep, c in counts.items():
        assert {v: sum(x == v for (e, _), x in got.items() if e == ep) for v in ("applied", "rejected", "same", "none")} == {k: v for k, v in c.items() if k != "ep"}
    for r in seg.collect():
        k = (r["ep"], r["seg"])
        new = fixes.get(k)
        if new is None or new == r["text"]:
            want = "none" if new is None else "same"
        else:
            a, b = norm(r["text"]), norm(new)
            drift = abs(len(a.split()) - len(b.split())) <= max(2, int(len(a.split()) * 0.2))
            want = "applied" if a == b or (b and drift and difflib.SequenceMatcher(None, a, b).ratio() >= 0.8) else "rejected"
        assert got[k] == want


def test_terms_are_checked_over_the_corpus(spark):
    docs = [(k, f"Here we met Kurokrad again, number {k}.") for k in range(5)]
    docs += [(10, "Then came Kurograd, and old Kurograd spoke to the Kurograds."), (11, "So said Zamenhof and Zamenhof."), (12, "So said Bedrosan to Bedrosan."), (13, "So said Bedrosan to Bedrosan."), (14, None)]
    docs += [(20 + k, "a pedrosan") for k in range(6)]
    got = stages.checked_terms(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id").collect()
    want = [(k, 3, "Then came Kurokrad, and old Kurokrad spoke to the Kurokrads.") if k == 10 else (k, 0, t) for k, t in docs]
    assert sorted(map(tuple, got)) == sorted(want)
