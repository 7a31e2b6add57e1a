"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, names_free, only, read_table, small_batches
from .folding import INVISIBLE, LOOKALIKES, ODD

#: Terms by weight: 3 for slurs that are one in any sentence, 2 for plain insults. A term ending in * matches every word that begins with it.
_TERMS = {
    3.0: "scum scumbag scumbags vermin bastard bastards bitch asshole arschloch connard salaud cabrón hijo_de_puta",
    2.0: "idiot idiots moron morons loser losers trash pathetic worthless disgusting stupid clown clowns imbecile idiota imbécil estúpido dummkopf vollidiot crétin imbécile",
}
LEXICON: dict[str, float] = {term.replace("_", " "): weight for weight, terms in _TERMS.items() for term in terms.split()}
#: Phrases in which a term means no offence; what they cover counts for nothing.
EXCEPTIONS: tuple[str, ...] = ("trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "take out the trash", "clown fish", "circus clown", "worthless check", "pathetic fallacy", "pond scum", "soap scum", "sore loser", "stupid of me")
#: Toxic: at least this weight per 100 words, and at least this weight in all.
PER_100_WORDS, LEAST_WEIGHT = 0.5, 2.0
#: Bound on the labelled rows that teach further terms, and the length of a learnt stem.
MAX_FIT_ROWS, STEM_CHARS = 6000, (3, 6)

_LEET = {ord(a): b for a, b in zip("0134578$@!|", "oieastbsaii")} | {ord("l"): "i"}
_FOLDS = {k: _LEET.get(ord(v), v) if len(v) == 1 else v for k, v in LOOKALIKES.items()} | _LEET | {ord(c): "" for c in INVISIBLE}

_ASCII = {k: v for k, v in _FOLDS.items() if k < 128}
_BYTES = bytes(ord(_ASCII.get(k, chr(k))) if k < 128 else k for k in range(256))


def fold(text: str) -> str:
    """Lower case, look-alikes and digit substitutions to one letter each; l, 1, ! and i are one class. Characters without width go."""
    t = text.lower()
    if t.isascii():
        return t.translate(_ASCII)
    if ODD.search(text):
        return t.translate(_FOLDS)
    return t.encode().translate(_BYTES).decode()


class Matcher:
    """The automaton; built once in each Python worker from the plain lexicon."""

    def __init__(self, lexicon: dict[str, float], exceptions: tuple[str, ...]):
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, tuple[int, float, bool]] = {}
        for term, weight in lexicon.items():
            key = fold(term.rstrip("*"))
            if key:
                entries[key] = (len(key), weight, term.endswith("*"))
        for phrase in exceptions:
            entries[fold(phrase)] = (len(fold(phrase)), 0.0, False)
        for key, value in entries.items():
            self.automaton.add_word(key, value)
        self.any = bool(entries)
        if self.any:
            self.automaton.make_automaton()

    def weigh(self, text: str) -> tuple[float, int]:
        """Sum of the weights of the terms in text, and how many matched. Of matches that overlap, the longest counts; an exception phrase covers the terms in it."""
        if not self.any:
            return 0.0, 0
        t = fold(text)
        found = []
        for end, (length, weight, stem) in self.automaton.iter(t):
            begin = end - length + 1
            if (begin and t[begin - 1].isalnum()) or (not stem and end + 1 < len(t) and t[end + 1].isalnum()):
                continue
            found.append((begin, -length, weight))
        total, hits, covered = 0.0, 0, -1
        for begin, minus, weight in sorted(found):
            if begin > covered:
                covered = begin - minus - 1
                total += weight
                hits += weight > 0
        return total, hits


def learn_terms(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> dict[str, float]:
    """Word stems that mark labelled toxic documents, fitted on at most ``max_rows`` labelled rows.

    A stem (the first 3 to 6 letters of a word) is learnt if documents labelled toxic hold it at least 4 times as often as clean ones of their language, in at least 5 toxic documents and far beyond chance (z of 6); of stems that begin with each other, the one that tells most stays. Weight 1, so that one chance occurrence never rejects a document. No labels, or under 20 toxic ones: nothing is learnt."""
    lab = only(labels, "doc_id", "toxic").filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = lab.count()
    if not rows:
        return {}
    if rows > max_rows:
        part = int(max_rows / rows * 1_000_000)
        lab = lab.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) < part)
    text = only(docs, "doc_id", "text", "lang").filter("text is not null").join(F.broadcast(lab), "doc_id")
    lo, hi = STEM_CHARS
    per_doc = text.select("doc_id", "toxic", F.coalesce("lang", F.lit("")).alias("lang"), F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    stems = per_doc.select("toxic", "lang", F.explode(F.array_distinct(F.flatten(F.transform("w", lambda w: F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda k: F.substring(w, F.lit(1), k)))))).alias("stem")).filter(F.length("stem") >= lo)
    sizes = {r["lang"]: (r["t"], r["n"] - r["t"]) for r in per_doc.groupBy("lang").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()}
    if sum(t for t, _ in sizes.values()) < 20:
        return {}
    counted = stems.groupBy("lang", "stem").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).filter("t >= 5 and t * 4 >= n - t").collect()
    scored = []
    for r in counted:
        nt, nc = sizes[r["lang"]]
        a, b = r["t"] / nt, (r["n"] - r["t"] + 0.5) / (nc + 1)
        p = r["n"] / (nt + nc)
        z = (a - b) / math.sqrt(max(p * (1 - p), 1e-9) * (1 / nt + 1 / max(nc, 1)))
        if a >= 4 * b and z >= 6:
            scored.append((z, r["stem"]))
    out: dict[str, float] = {}
    known = {fold(x.rstrip("*")) for x in LEXICON}
    for _, stem in sorted(scored, key=lambda x: (-x[0], x[1])):
        f = fold(stem)
        if not any(k.startswith(f) or f.startswith(k) for k in known):
            known.add(f)
            out[stem + "*"] = 1.0
    return out


def scored(docs: DataFrame, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> tuple[DataFrame, tuple[str, str, str]]:
    """docs with weight, hits and words of each text added, and the names of these columns, which are such as docs has not. Whole texts, row by row in place. A null or empty text has 0 of each."""
    small_batches(docs.sparkSession)
    kept: list[Matcher] = []
    added = names_free(docs, "weight", "hits", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Matcher(lexicon, exceptions))
        at = None
        for batch in batches:
            at = batch.schema.get_field_index("text") if at is None else at
            ws, hs, ns = [], [], []
            for text in batch.column(at):
                text = text.as_py() or ""
                w, h = kept[0].weigh(text)
                ws.append(w), hs.append(h), ns.append(len(text.split()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ws, pa.float64()), pa.array(hs, pa.int64()), pa.array(ns, pa.int64())], names=[*batch.schema.names, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, `{added[0]}` double, `{added[1]}` long, `{added[2]}` long"), tuple(added)


def _per_100(weight: str, words: str) -> Column:
    return F.when(F.col(words) > 0, F.col(weight) * 100 / F.col(words)).otherwise(0.0)


def _toxic(weight: str, words: str, per_100: float, least: float) -> Column:
    return (_per_100(weight, words) >= per_100) & (F.col(weight) >= least)


def toxicity(docs: DataFrame, lexicon: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, per_100: float = PER_100_WORDS, least: float = LEAST_WEIGHT) -> DataFrame:
    """(doc_id, weight, hits, words, score, toxic) for every row of docs, repeated rows and null doc_ids included.

    score is the weight per 100 words, of the whole text, however long. Null, empty and wordless texts score 0 and are not toxic. Where terms tie for a place the longest counts. Other columns, also of the names used here, are ignored. No rows in: none out; an empty lexicon finds nothing."""
    rows, (weight, hits, words) = scored(only(docs, "doc_id", "text"), lexicon, exceptions)
    return rows.select("doc_id", F.col(weight).alias("weight"), F.col(hits).alias("hits"), F.col(words).alias("words"), _per_100(weight, words).alias("score"), _toxic(weight, words, per_100, least).alias("toxic"))


def without_toxic(docs: DataFrame, lexicon: dict[str, float], per_100: float = PER_100_WORDS, least: float = LEAST_WEIGHT) -> DataFrame:
    """The rows of docs that are not toxic, all columns kept, whatever their names. Null, empty and wordless texts stay, as do null doc_ids and repeated rows. A very long text goes only if it has that much weight in every 100 words of it. No rows in: none out."""
    rows, (weight, _, words) = scored(docs, lexicon)
    return rows.filter(~_toxic(weight, words, per_100, least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def full_lexicon(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    return learn_terms(docs, labels) | LEXICON


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity(docs, full_lexicon(docs, read_table(spark, sf_dir, "labels")))


by_value(__name__)
