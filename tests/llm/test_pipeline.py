from collections import Counter

import corpus_pipeline
from clipquarry.llm.folding import lower_folded
from clipquarry.llm.pii import find
from clipquarry.llm.toxicity import LEXICON
from tests.llm.test_minhash import grams
from tests.llm.util import DOC_SCHEMA, awkward, frame


def test_run_equals_brute_force(spark, tmp_path):
    clean = [(i, t, s) for i, t, s in awkward(7) if i is not None]
    rows = [*clean, (40, "you stupid idiot, you moron", "a"), (41, "mail jo.81@mail7.example.com or call +1 (325) 555-8094 soon", "b")]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        texts.setdefault(r["doc_id"], {})[r["begin"]] = r["text"]
    whole = {i: "".join(p[b] for b in sorted(p)) for i, p in texts.items()}
    # by hand: not toxic, least id of each group of near copies, redacted, at least once each
    alive = sorted((i, t) for i, t, _ in rows if t and not any(w in lower_folded(t).split() for w in LEXICON))
    kept, seen = {}, []
    for i, t in alive:
        g = grams(t)
        if i not in kept and not any(g and len(g & h) >= 0.6 * len(g | h) for h in seen):
            seen.append(g)
            for a, b, k in reversed(find(t)):
                t = t[:a] + f"[{k.upper()}]" + t[b:]
            kept[i] = t
    assert whole == kept
    fill = Counter()
    for r in got:
        fill[r["bin_id"]] += r["length"]
    assert max(fill.values()) <= 16_384


def test_stages_keep_the_columns_and_take_no_rows(spark, tmp_path):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (frame(spark, awkward()).select(*names), spark.createDataFrame([], DOC_SCHEMA).select(*names)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == names
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
