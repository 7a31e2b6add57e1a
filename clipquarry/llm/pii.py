"""PII: offset-preserving deobfuscation.

A first transducer folds look-alike characters one to one; a second rewrites spelled digits and at/dot disguises and drops
characters without width, noting where each rewritten stretch came from. Identifiers are found in what results, and their
spans are mapped back to the source text."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, only, read_table, small_batches, text_chunks, tokens
from .folding import INVISIBLE, ODD, lower_folded

_DIGITS = "zero=0 one=1 two=2 three=3 four=4 five=5 six=6 seven=7 eight=8 nine=9 oh=0 zéro=0 un=1 deux=2 trois=3 quatre=4 cinq=5 sept=7 huit=8 neuf=9 null=0 eins=1 zwei=2 drei=3 vier=4 fünf=5 sechs=6 sieben=7 acht=8 neun=9 cero=0 uno=1 dos=2 tres=3 cuatro=4 cinco=5 seis=6 siete=7 ocho=8 nueve=9"
DIGIT_WORDS = dict(x.split("=") for x in _DIGITS.split())
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: A run of at least four items, digit words or numbers.
_RUN = re.compile(rf"(?<!\w)(?:(?:double|triple)\s+)?(?:{_WORD}|\d+)(?:[\s,.\-()]{{1,3}}(?:(?:double|triple)\s+)?(?:{_WORD}|\d+)(?!\w)){{3,}}")
_PAIR = re.compile(rf"(?<!\w)(?:{_WORD}|\d+)[\s,.\-()]{{1,3}}(?:double\s+|triple\s+)?(?:{_WORD}|\d)")
_ITEM = re.compile(rf"(?:(double|triple)\s+)?({_WORD}|\d+)(?!\w)")
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,2}", r"\s{0,2}[\])}>]\s{0,3}"
_AT = re.compile(rf"(?<=[\w]){_OPEN}(?:at|@|arroba|ät){_CLOSE}(?=\w)")
_DOT = re.compile(rf"(?<=\w){_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}(?=\w)")
_BARE_AT = re.compile(r"(?<=\w)(?:\s+at\s+|\s*@\s*)(?!(?:the|a|an|this|that|our|my|your|his|her|its|any|all|one)\b)(?=[\w\-]{1,63}(?:\s*\.\s*|\s+dot\s+|\s{0,3}[\[({<]\s{0,2}(?:dot|\.)\s{0,2}[\])}>]\s{0,3})[a-z]{2,})")
_BARE_DOT = re.compile(r"(?<=\w)\s+dot\s+(?=\w)")
_ZERO = re.compile(f"[{INVISIBLE}]")
_DOMAIN = re.compile(r"[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z]{2,24}(?![a-z0-9])")
_IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
_PHONE = re.compile(r"(?:(?<![\d+])\+\d{1,3}[ .\-]?)?(?:\(\d{3}\)[ .\-]?|(?<![\d.\-])\d{3}[ .\-])\d{3}[ .\-]?\d{4}(?!\d)|(?<![\d+])\+\d{9,14}(?!\d)|(?<!\d)1?\d{10}(?!\d)")
#: Numbers with a country code, in groups of any length; 9 to 15 digits in all.
_ABROAD = re.compile(r"(?<![\d+])\+\d{1,3}(?:[ .\-]?\(?\d{1,4}\)?){2,6}(?!\d)")
_IBAN = re.compile(r"(?<![a-z0-9])[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?(?![a-z0-9])")
_CARD = re.compile(r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?!\d)")
_SSN = re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])")
_SECRET = re.compile(r"(?:token|secret|password|passwd|api[_\-]?key|access[_\-]?key)\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{8,})")
#: Where numbers can be; the patterns above need no other characters, but for a + or ( before.
_NUMBERS = re.compile(r"\d[\d().\- ]*")
KINDS = ("secret", "email", "iban", "ip", "ssn", "card", "phone")


class Tape:
    """A rewritten text and where its stretches came from: from[k] on, norm position from[k] + d is source position to[k] + d (or, in a rewritten stretch, the stretch's ends)."""

    def __init__(self, text: str):
        self.text = text
        self.norm, self.begin, self.end = [0], [0], [len(text)]
        self.same = [True]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """edits: (begin, end, replacement) of self.text, in order and apart."""
        if not edits:
            return self
        out, parts, pos, at = Tape(""), [], 0, 0
        out.norm, out.begin, out.end, out.same = [], [], [], []

        def piece(length: int, source: tuple[int, int], same: bool) -> None:
            nonlocal at
            if length:
                out.norm.append(at), out.begin.append(source[0]), out.end.append(source[1]), out.same.append(same)
                at += length

        def copy(a: int, b: int) -> None:
            k = bisect_right(self.norm, a) - 1
            while a < b:
                stop = min(b, self.norm[k + 1] if k + 1 < len(self.norm) else len(self.text))
                if self.same[k]:
                    d = self.begin[k] - self.norm[k]
                    piece(stop - a, (a + d, stop + d), True)
                else:
                    piece(stop - a, (self.begin[k], self.end[k]), False)
                parts.append(self.text[a:stop])
                a, k = stop, k + 1

        for a, b, new in edits:
            copy(pos, a)
            if new:
                parts.append(new)
                piece(len(new), self.source(a, b), False)
            pos = b
        copy(pos, len(self.text))
        out.text = "".join(parts)
        return out

    def source(self, a: int, b: int) -> tuple[int, int]:
        """Source span of text[a:b], which is not empty."""
        k, j = bisect_right(self.norm, a) - 1, bisect_right(self.norm, b - 1) - 1
        begin = self.begin[k] + (a - self.norm[k] if self.same[k] else 0)
        end = self.begin[j] + (b - self.norm[j]) if self.same[j] else self.end[j]
        return begin, end


def _spelled(m: re.Match) -> str:
    out = []
    for many, word in _ITEM.findall(m.group(0)):
        out.append(DIGIT_WORDS.get(word, word) * {"double": 2, "triple": 3}.get(many, 1))
    return "".join(out)


def spelled_rows(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which rows of a chunk have a digit word next to another or to a number: only they can have a run. It sees no look-alikes; a text that has any is looked at in full."""
    h, row, start, _ = tokens(raw, off)
    out = np.zeros(len(off) - 1, dtype=bool)
    if len(h) > 1:
        word = np.isin(h, _HASHES)
        item = word | np.isin(h, _MANY) | ((raw[start] >= 48) & (raw[start] <= 57))
        near = (row[1:] == row[:-1]) & item[1:] & item[:-1] & (word[1:] | word[:-1])
        out[row[1:][near]] = True
    return out


def _hashes(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    return tokens(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data])])[0]


_HASHES, _MANY = _hashes(list(DIGIT_WORDS)), _hashes(["double", "triple"])


def normalised(text: str, spelled: bool = True) -> Tape:
    """The text as the detectors see it. spelled: False if it is known to have no run of spelled digits."""
    tape = Tape(lower_folded(text))
    spelled = spelled or (not text.isascii() and bool(ODD.search(text)))
    if not text.isascii() and _ZERO.search(tape.text):
        tape = tape.rewrite([(m.start(), m.end(), "") for m in _ZERO.finditer(tape.text)])
    t = tape.text
    if spelled and _PAIR.search(t):
        tape = tape.rewrite([(m.start(), m.end(), _spelled(m)) for m in _RUN.finditer(t) if re.search(_WORD, m.group(0))])
        t = tape.text
    if any(x in t for x in ("at", "@", "arroba", "ät")) and any(x in t for x in (" at ", "@", "at)", "at]", "at}", "at>", "at ", "arroba", "ät")):
        edits = [(m.start(), m.end(), "@") for m in _AT.finditer(t)]
        if " at " in t or " @" in t or "@ " in t or "\nat" in t or "at\n" in t:
            edits = _apart(edits + [(m.start(), m.end(), "@") for m in _BARE_AT.finditer(t)])
        tape = tape.rewrite(edits)
        t = tape.text
    if "@" in t or "dot" in t:
        edits = []
        for at in _all(t, "@"):
            # only in the domain that follows an @, and in the local part before it
            lo, hi = _around(t, at)
            edits += [(lo + m.start(), lo + m.end(), ".") for r in (_DOT, _BARE_DOT) for m in r.finditer(t[lo:hi])]
        tape = tape.rewrite(_apart(edits))
        t = tape.text
    return tape


_JOIN = r"(?:\s+dot\s+|\s{0,3}[\[({<]\s{0,2}(?:dot|punkt|point|punto|\.)\s{0,2}[\])}>]\s{0,3})"
_JOINED = re.compile(rf"(?<=[\w.%+\-]){_JOIN}$")
_RIGHT = re.compile(rf"@[\w\-.]+(?:{_JOIN}[\w\-.]+)*")


def _local(t: str, at: int) -> int:
    """Where the run of characters of a local part that ends at ``at`` begins, however long it is. Runs before different @ never overlap, so a text is walked over once."""
    while at and (t[at - 1].isalnum() or t[at - 1] in "_.%+-"):
        at -= 1
    return at


def _around(t: str, at: int) -> tuple[int, int]:
    """Span of what may be an address with its @ at ``at``: local parts joined by a spelled dot, and the domain."""
    left = at
    while (run := _local(t, left)) < left:
        left = run
        # a joint is looked for in the 24 characters before the run
        m = _JOINED.search(t[max(0, left - 24) : left])
        if not m:
            break
        left -= len(m.group(0))
    right = _RIGHT.match(t, at)
    return left, right.end() if right else at


def _all(t: str, x: str) -> Iterator[int]:
    at = t.find(x)
    while at >= 0:
        yield at
        at = t.find(x, at + 1)


def _apart(edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for e in sorted(set(edits)):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def _each(pattern: re.Pattern, t: str, a: int, b: int) -> Iterator[re.Match]:
    """The matches at every place of t[a:b], also those that overlap, as one of them may turn out to be no identifier."""
    while m := pattern.search(t, a, b):
        yield m
        a = m.start() + 1


def _card(number: str) -> bool:
    """Whether a number's last digit is its check digit (every other digit doubled, from the last but one on)."""
    d = [int(c) for c in reversed(number) if c.isdigit()]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _sound(iban: str) -> bool:
    """Whether the check digits are right."""
    x = iban.replace(" ", "")
    return x.isascii() and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _iban(t: str, at: int) -> tuple[int, int] | None:
    """Span of the account number whose two letters are at ``at``: a sound one with at least four digits after the check digits. Words that follow it are left off."""
    m = _IBAN.match(t, at)
    x = m.group(0) if m else ""
    while len(x.replace(" ", "")) >= 12 and sum(map(str.isdigit, x[4:])) >= 4:
        if _sound(x):
            return at, at + len(x)
        x, _, last = x.rpartition(" ")
        if not last.isalpha():
            break
    return None


def find(text: str, spelled: bool = True) -> list[tuple[int, int, str]]:
    """(begin, end, kind) in characters of text of every identifier, in order; where two overlap, the kind first in KINDS stays. An empty text has none."""
    if not text:
        return []
    tape = normalised(text, spelled)
    t = tape.text
    hits: list[tuple[int, int, int]] = []
    for at in _all(t, "@"):
        left, right = _local(t, at), _DOMAIN.match(t, at + 1)
        if left < at and right:
            hits.append((1, left, right.end()))
    for area in _NUMBERS.finditer(t):
        a, b = area.span()
        # the area may hold no more than the check digits, if letters follow
        if a > 1 and t[a - 2 : a].isalpha() and (x := _iban(t, a - 2)):
            hits.append((2, *x))
        if b - a < 7:
            continue
        while a and t[a - 1] in "+(" and area.start() - a < 2:
            a -= 1
        hits += [(3, m.start(), m.end()) for m in _each(_IP, t, a, b) if all(int(x) < 256 for x in m.group(0).split("."))]
        for rank, pattern in ((4, _SSN), (5, _CARD), (6, _PHONE)):
            hits += [(rank, m.start(), m.end()) for m in _each(pattern, t, a, b) if rank != 5 or _card(m.group(0))]
        if "+" in t[a : area.start()]:
            hits += [(6, m.start(), m.end()) for m in _each(_ABROAD, t, a, b) if 9 <= sum(map(str.isdigit, m.group(0))) <= 15]
    if any(x in t for x in ("token", "secret", "passw", "key")):
        hits += [(0, m.start(1), m.end(1)) for m in _SECRET.finditer(t)]
    taken: list[tuple[int, int, str]] = []  # apart and in order, so only the neighbours of a hit can overlap it
    for rank, a, b in sorted(hits):
        k = bisect_left(taken, (a, b, ""))
        if (not k or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
            taken.insert(k, (a, b, KINDS[rank]))
    return [(*tape.source(a, b), kind) for a, b, kind in taken]


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, pos = [], 0
    for a, b, kind in spans:
        out += [text[pos:a], f"[{kind.upper()}]"]
        pos = b
    return "".join([*out, text[pos:]])


def _mapped(docs: DataFrame, spans: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, found = [], []
            flags = [x for _, _, raw, off in text_chunks(batch.column(at)) for x in spelled_rows(raw, off).tolist()]
            for text, flag in zip(batch.column(at).to_pylist(), flags, strict=True):
                got = find(text, flag) if text else []
                texts.append(redacted(text, got) if got else text)
                found.append([{"begin": a, "end": b, "kind": k} for a, b, k in got])
            columns, names = list(batch.columns), list(batch.schema.names)
            columns[at] = pa.array(texts, pa.string())
            if spans:
                columns.append(pa.array(found, pa.list_(span)))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, kinds + ", spans array<struct<begin:int,end:int,kind:string>>" * spans)


def pii(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_spans, spans) for every row: text with each identifier replaced by its kind, spans the identifiers' places in characters of the source text.

    A null text stays null and an empty one empty, without spans; a text without identifiers is returned as it is. Of hits that overlap the kind first in KINDS stays, then the one that begins first. Texts are read whole, in time that grows with their length. Repeated rows and null doc_ids are rows like others. Other columns are ignored. No rows in: none out."""
    return _mapped(only(docs, "doc_id", "text"), True).select("doc_id", "text", F.size("spans").alias("n_spans"), "spans")


def redact(docs: DataFrame) -> DataFrame:
    """docs with text redacted and, where it was there, n_chars counted again; all columns, whatever their names, and all rows kept. A null text stays null and an empty one empty, a null n_chars null; whole texts are read, however long. No rows in: none out."""
    out = _mapped(docs, False)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(read_table(spark, sf_dir, "documents"))


by_value(__name__)
