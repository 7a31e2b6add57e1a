import random
import re

from clipquarry.llm.toxicity import LEXICON, Matcher, EXCEPTIONS, fold, learn_terms, toxicity, without_toxic
from tests.llm.util import awkward, frame, prose


def brute(text, lexicon, exceptions):
    t = fold(text)
    found = []
    for term, weight in [*lexicon.items(), *((e, 0.0) for e in exceptions)]:
        key, stem = fold(term.rstrip("*")), term.endswith("*")
        for i in range(len(t)):
            if t.startswith(key, i) and not (i and t[i - 1].isalnum()) and (stem or not t[i + len(key) : i + len(key) + 1].isalnum()):
                found.append((i, -len(key), weight))
    total, covered = 0.0, -1
    for i, minus, weight in sorted(found):
        if i > covered:
            covered, total = i - minus - 1, total + weight
    return total


def test_matcher_equals_brute_force():
    rng = random.Random(2)
    lexicon, parts = LEXICON | {"réeu*": 1.0}, ["1d10t", "stуpid", "STUPID", "trash can", "trash", "closer", "l0ser", "réeuxpa", "a réeu", "m​oron", "clown fish", "clowns", "$cum", "word", ",", "idiotic", "İdiot"]
    m = Matcher(lexicon, EXCEPTIONS)
    for _ in range(300):
        text = rng.choice([" ", "-", ""]).join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert m.weigh(text)[0] == brute(text, lexicon, EXCEPTIONS), text


def test_query_rows(spark):
    rows = awkward() + [(20, "you stupid idiot", "a"), (21, "take out the trash, then the trash can", "a"), (22, "you 1d10t, you m0rоn " + "word " * 50, "a"), (23, "idiot " + "word " * 5000, "a")]
    df = frame(spark, rows)
    got = toxicity(df, LEXICON).collect()
    assert len(got) == len(rows)
    assert sorted(r["doc_id"] for r in got if r["toxic"]) == [20, 22]
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (4, 5, 6))
    kept = without_toxic(df, LEXICON)
    assert kept.columns == df.columns and kept.count() == len(rows) - 2
    assert without_toxic(df.limit(0), LEXICON).collect() == []
    assert toxicity(df, {}, ()).filter("toxic").count() == 0


def test_clashing_columns_and_weights(spark):
    rows = [(1, "you idiot", "a", 1, 2.0, 3), (2, "fine words", None, 4, None, 6), (2, "fine words", None, 4, None, 6), (None, None, "x", 7, 8.0, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hits string, __words int, weight double, _weight int")
    kept = without_toxic(df, LEXICON)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
    got = toxicity(df, LEXICON).collect()
    assert [r["weight"] for r in got if r["doc_id"] == 1] == [2.0] and len(got) == 4
    assert Matcher(LEXICON, EXCEPTIONS).weigh("such vermin")[0] > Matcher(LEXICON, EXCEPTIONS).weigh("such losers")[0]


def test_learns_planted_stems_only(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(rng, 60).split()
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(60), "zork" + rng.choice("abcdefgh"))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad), 7))
    lab = spark.createDataFrame(labels + [(None, 1, 1, 7), (5, None, None, 7)], "doc_id long, quality int, toxic int, text int")
    assert [re.sub(r"\*", "", k) for k in learn_terms(frame(spark, rows), lab)] == ["zor"] or list(learn_terms(frame(spark, rows), lab))[0].startswith("zor")
    assert learn_terms(frame(spark, rows), lab.limit(0)) == {}
