import random
import re
import time

from clipquarry.llm import pii
from tests.llm.util import awkward, frame

CASES = [
    ("jo.81@mail7.example.com", "email"), ("j​ane (at) mail dot example [dot] com", "email"), ("anna at mail.example.com", "email"), ("аdmin@exаmple.com", "email"), ("jane[at]ex[.]com", "email"), ("bob AT mail DOT example DOT org", "email"),
    ("+1 (325) 555-8094", "phone"), ("five five five, one two three four five six seven", "phone"), ("+1 (nine eight zero) 555-six two six eight", "phone"), ("+1 ６50-555-1234", "phone"), ("double five five one two three four five six seven", "phone"),
    ("4111 1111 1111 1111", "card"), ("4238 3974-3689 6688", "card"), ("226.203.165.104", "ip"), ("DE89 3704 0044 0532 0130 00", "iban"), ("+33 6 12 34 56 78", "phone"), ("+49 (30) 1234567", "phone"), ("２２６.203.165.104", "ip"), ("078-05-1120", "ssn"), ("b7852d4e73166f43a80132626729b5fa5141a7a6", "secret"),
]


def test_each_kind_is_found_at_its_place():
    for before, after in (("", ""), ("Übung і​ zu: ", " ende."), ("x\n", "\ny"), ("é" * 5000 + " ", " " + "ß" * 5000)):
        for value, kind in CASES:
            shown = f'token = "{value}"' if kind == "secret" else value
            text = before + shown + after
            (begin, end, got), *more = pii.find(text)
            assert (text[begin:end], got, more) == (value, kind, []), (text[:80], value)


def test_account_numbers_with_letters_after_the_check_digits():
    for value in ["GB29 NWBK 6016 1331 9268 19", "GB29NWBK60161331926819", "NL91ABNA0417164300", "NL91 ABNA 0417 1643 00", "MT84MALT011000012345MTLCAST001S", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "IE29AIBK93115212345678", "BE68 5390 0754 7034"]:
        for before, after in (("", ""), ("pay ", " soon, then 12 more"), ("é" * 300 + " (", ")")):
            text = before + value + after
            assert [(text[a:b], kind) for a, b, kind in pii.find(text)] == [(value, "iban")], text[-60:]
    for text in ["GB30 NWBK 6016", "mp34 with some text", "at GB29 NWBK"]:
        assert pii.find(text) == [], text


def test_clean_text_is_left_alone():
    rng = random.Random(0)
    for text in ["meet at noon", "the dot on the i", "un deux trois soleil", "page 12 of 300", "in 2024, 15.5 %", "1.2.3", "a@b", "look at the dot com", "one two", "@home", "v 1.2.3.4.5", "999.999.999.999", "0846248622952050", "item 4111 1111 1111 1112"]:
        assert pii.find(text) == [], text
    for _ in range(200):
        assert pii.find(" ".join(rng.choice(["at", "dot", "one", "zwei", "the", "net", "uno,"]) if rng.random() < 0.15 else f"w{rng.choice('abc')}" for _ in range(40))) is not None


def test_tape_maps_back_every_position():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abc​ de") for _ in range(30))
        tape = pii.Tape(text)
        for _ in range(2):
            spots = sorted(rng.sample(range(len(tape.text) + 1), 4)) if len(tape.text) > 4 else [0, 0, 0, 0]
            edits = [(a, b, rng.choice(["", "7", "42"])) for a, b in (spots[:2], spots[2:]) if a < b]
            old = tape
            tape = tape.rewrite(edits)
            want, pos = [], 0
            for a, b, new in [*edits, (len(old.text), len(old.text), "")]:
                want += [old.source(k, k + 1) for k in range(pos, a)] + [old.source(a, b)] * len(new)
                pos = b
            assert [tape.source(k, k + 1) for k in range(len(tape.text))] == want


def test_flags_of_a_chunk_agree_with_the_full_look():
    import numpy as np

    texts = ["call nine eight zero five five", "one", "one two", "the 5 nine", "", "double five"]
    raw = [t.encode() for t in texts]
    got = pii.spelled_rows(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    assert got.tolist() == [True, False, True, True, False, True]


def test_rows(spark):
    rows = awkward() + [(30, "call +1 (325) 555-8094 or jo@x.example.com", "a")]
    df = frame(spark, rows)
    got = pii.pii(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[30]["text"] == "call [PHONE] or [EMAIL]" and by[30]["n_spans"] == 2 and by[4]["text"] is None and by[5]["text"] == ""
    assert sum(r["n_spans"] for r in got) == 2
    out = pii.redact(df)
    assert out.columns == df.columns
    assert {r["doc_id"]: r["n_chars"] for r in out.collect()}[30] == 23
    assert pii.pii(df.limit(0)).collect() == []


def brute(text):
    """Identifiers of a text by the patterns alone, tried at every place of the whole text; for texts without disguise."""
    hits = []
    for k in range(len(text)):
        for rank, pattern in ((3, pii._IP), (4, pii._SSN), (5, pii._CARD), (6, pii._PHONE), (6, pii._ABROAD)):
            m = pattern.match(text, k)
            if m and (rank != 3 or all(int(x) < 256 for x in m.group(0).split("."))) and (rank != 5 or pii._card(m.group(0))) and (pattern is not pii._ABROAD or 9 <= sum(map(str.isdigit, m.group(0))) <= 15):
                hits.append((rank, *m.span()))
        if text[k] == "@":
            a = k
            while a and re.match(r"[\w.%+\-]", text[a - 1]):
                a -= 1
            m = pii._DOMAIN.match(text, k + 1)
            if a < k and m:
                hits.append((1, a, m.end()))
    taken = []
    for rank, a, b in sorted(hits):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, pii.KINDS[rank]))
    return sorted(taken)


def test_plain_texts_equal_brute_force():
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    parts = [lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: digits(rng.choice([4, 10, 16, 25])), lambda: ".".join(digits(rng.choice([1, 2, 3])) for _ in range(4)), lambda: f"+{digits(2)} {digits(2)} {digits(3)} {digits(4)}"]
    parts += [lambda: f"a{digits(2)}.b@mail{digits(1)}.example.com", lambda: "word", lambda: "(", lambda: "x@y", lambda: "- ", lambda: "v" + digits(5)]
    for _ in range(400):
        text = rng.choice([" ", ", ", ""]).join(rng.choice(parts)() for _ in range(rng.randrange(1, 9))).lower()
        assert pii.find(text, False) == brute(text), text


def test_long_local_parts_go_whole():
    for text in ("x" * 5000 + "@mail.example.com", "a.b dot " * 60 + "c" * 300 + " (at) mail dot example [dot] com"):
        (begin, end, kind), = pii.find("so: " + text + " then")
        assert (begin, end, kind) == (4, 4 + len(text), "email")


def test_time_grows_with_the_text():
    one = "write to ann@mail.example.com or 325-555-8094, soon. "
    took = []
    for n in (1000, 8000):
        began = time.perf_counter()
        assert len(pii.find(one * n)) == 2 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 0.5
