import numpy as np

from clipquarry.llm import jpeg


def slow_dc(data):
    """DC of the luminance blocks by a bit-at-a-time reader of our files (one table pair)."""
    info = jpeg.markers(data)
    books = []
    for counts, values in (info["scan"][0][2], info["scan"][0][3]):
        book, code, k = {}, 0, 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                book[n, code] = values[k]
                code, k = code + 1, k + 1
            code <<= 1
        books.append(book)
    g = jpeg._grid(info)
    plane = np.zeros((g["rows"], g["wide"]), int)
    mcu = 0
    for lane in jpeg._lanes(info["data"]):
        bits = "".join(f"{x:08b}" for x in lane)
        at, pred = 0, [0] * 4

        def symbol(book, at):
            for n in range(1, 17):
                if (n, int(bits[at : at + n], 2)) in book:
                    return book[n, int(bits[at : at + n], 2)], at + n
            raise AssertionError

        for _ in range(min(info["restart"] or g["mcus"], g["mcus"] - mcu)):
            for s, y, x in g["blocks"]:
                n, at = symbol(books[0], at)
                v = int(bits[at : at + n] or "0", 2)
                at += n
                c = info["scan"].index(s)
                pred[c] += v if not n or v >= 1 << (n - 1) else v - (1 << n) + 1
                if s[4]:
                    plane[mcu // g["across"] * g["v"] + y, mcu % g["across"] * g["h"] + x] = pred[c]
                k = 1
                while k < 64:
                    sym, at = symbol(books[1], at)
                    if sym == 0:
                        break
                    k += (sym >> 4) + 1
                    at += sym & 15
            mcu += 1
    rows, cols = g["seen"]
    return np.clip((plane[:rows, :cols] * info["quant"] + 4) // 8 + 128, 0, 255)


def images():
    rng = np.random.default_rng(1)
    out = []
    for k in range(24):
        h, w = rng.integers(1, 70, 2)
        smooth = np.add.outer(np.arange(h) * 3, np.arange(w) * 2) % 256
        y = (smooth if k % 2 else rng.integers(0, 256, (h, w))).astype(np.uint8)
        planes = [y] if k % 3 else [y, y[::2, ::2], 255 - y[::2, ::2]]
        out.append((planes, jpeg.encode(planes, quant=int(rng.integers(1, 40)), restart=int(rng.integers(0, 4)))))
    return out


def test_equals_slow_reader_and_block_means():
    made = images()
    for (planes, data), row in zip(made, jpeg.decode([d for _, d in made]), strict=True):
        h, w = planes[0].shape
        assert row[:3] == ("ok", w, h)
        t = np.frombuffer(row[5], np.uint8).reshape(row[4], row[3])
        assert (t == slow_dc(data)).all()
        full = planes[0][: h // 8 * 8, : w // 8 * 8].reshape(h // 8, 8, w // 8, 8).mean((1, 3))
        assert np.abs(t[: h // 8, : w // 8] - full).max(initial=0) <= jpeg.markers(data)["quant"] / 16 + 1.5


def test_bad_images():
    good = images()[4][1]
    at = good.index(b"\xff\xc0")
    cut = good[:-40]
    rows = jpeg.decode([None, b"", b"GIF89a", good[:at] + b"\xff\xc2" + good[at + 2 :], cut, good[:30], good])
    assert [r[0] for r in rows][:4] == [None, "not_jpeg", "not_jpeg", "unsupported"]
    assert rows[4][0] in ("corrupt", "truncated") and rows[5][0] == "truncated" and rows[6][0] == "ok"


def test_column(spark):
    data = images()[3][1]
    df = spark.createDataFrame([(1, data, "x", 5), (1, data, "x", 5), (None, data, None, None), (2, None, "y", 6), (3, b"", "", 0)], "k long, image binary, status string, width int")
    rows = jpeg.media(df, "k", "image").collect()
    assert [(r["k"], r["status"]) for r in rows] == [(1, "ok"), (1, "ok"), (None, "ok"), (2, None), (3, "not_jpeg")]
    assert jpeg.media(df.limit(0), "k", "image").collect() == []
    pages = spark.createDataFrame([(1, "<p>é" * 400, "x"), (2, None, "x"), (3, "", "x")], "page_id long, html string, image string")
    assert [r["status"] for r in jpeg.media(jpeg.page_images(pages), "page_id", "image").collect()] == ["ok", None, "ok"]


def by_hand(y, sampling, interleaved, wide_tables, quant=3, lanes=0):
    """Bytes of a JPEG written bit by bit with a flat code of its own: luminance DC levels y (a dict of blocks), chroma all 0, an AC or two a block."""
    (h0, v0), chroma = sampling[0], sampling[1:]
    # every symbol has 8 bits (but the last of 256 codes, all ones, which is not allowed)
    dc_values, ac_values = bytes(range(12)), bytes([0, 0xF0, 0x11, 0x23])
    counts = lambda values: bytes([0] * 7 + [len(values)] + [0] * 8)
    put = lambda values, sym: f"{values.index(sym):08b}"

    def number(v):
        n = abs(v).bit_length()
        return n, "" if not n else f"{v if v > 0 else v + (1 << n) - 1:0{n}b}"

    def block(level, before, k):
        n, bits = number(level - before)
        out = put(dc_values, n) + bits
        if k % 3 == 1:
            out += put(ac_values, 0x11) + "1" + put(ac_values, 0x23) + "010"
        if k % 5 == 2:
            out += put(ac_values, 0xF0) * 2 + put(ac_values, 0x11) + "0"
        return out + put(ac_values, 0)

    rows, cols = y.shape
    down, across = rows // v0, cols // h0
    scans = []
    pad = lambda bits: bits + "1" * (-len(bits) % 8)
    raw = lambda bits: int(pad(bits), 2).to_bytes(len(pad(bits)) // 8, "big").replace(b"\xff", b"\xff\x00")
    if interleaved:
        bits, before, k = "", 0, 0
        for a in range(down):
            for b in range(across):
                for i in range(v0):
                    for j in range(h0):
                        bits += block(int(y[a * v0 + i, b * h0 + j]), before, k)
                        before, k = int(y[a * v0 + i, b * h0 + j]), k + 1
                for h, v in chroma:
                    bits += (put(dc_values, 0) + put(ac_values, 0)) * (h * v)
        scans.append(([1, *range(2, 2 + len(chroma))], raw(bits)))
    else:
        for c, (h, v) in enumerate(chroma):  # the chroma scans come first
            scans.append(([2 + c], raw((put(dc_values, 0) + put(ac_values, 0)) * (down * v * across * h))))
        bits, before = "", 0
        for k, level in enumerate(y.ravel().tolist()):
            bits += block(level, before, k)
            before = level
        scans.append(([1], raw(bits)))
    segment = lambda m, body: bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body
    table = b"\x10" + quant.to_bytes(2, "big") * 64 if wide_tables else b"\0" + bytes([quant]) * 64
    frame = b"\x08" + (rows * 8).to_bytes(2, "big") + (cols * 8).to_bytes(2, "big") + bytes([1 + len(chroma)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(sampling))
    out = b"\xff\xd8" + segment(0xDB, table) + segment(0xC1 if wide_tables else 0xC0, frame) + segment(0xC4, b"\0" + counts(dc_values) + dc_values) + segment(0xFE, b"note") + segment(0xC4, b"\x10" + counts(ac_values) + ac_values)
    for parts, body in scans:
        out += b"\xff" + segment(0xDA, bytes([len(parts)]) + b"".join(bytes([p, 0]) for p in parts) + b"\0\x3f\0") + body
    return out + b"\xff\xd9"


def test_images_written_by_hand():
    """4:4:4, 4:2:2, 4:4:0, 4:2:0, 4:1:1 and grey, interleaved or not, tables of 8 and 16 bits, fill bytes before markers; many at once and each alone."""
    rng = np.random.default_rng(8)
    made, want = [], []
    for sampling in ([(1, 1)], [(1, 1)] * 3, [(2, 1), (1, 1), (1, 1)], [(1, 2), (1, 1), (1, 1)], [(2, 2), (1, 1), (1, 1)], [(4, 1), (1, 1), (1, 1)], [(2, 2), (2, 1), (2, 1)]):
        for interleaved in (True, False):
            for wide in (True, False):
                y = rng.integers(-300, 300, (4, 8))
                made.append(by_hand(y, sampling, interleaved and True, wide, quant=300 if wide else 3))
                want.append(np.clip((y * (300 if wide else 3) + 4) // 8 + 128, 0, 255))
    for rows in (jpeg.decode(made * 3)[: len(made)], [jpeg.decode([x])[0] for x in made]):
        for row, y in zip(rows, want, strict=True):
            assert row[0] == "ok" and row[3:5] == (8, 4)
            assert (np.frombuffer(row[5], np.uint8).reshape(4, 8) == y).all()


def test_large_and_hostile_images(spark):
    good = jpeg.encode([np.tile(np.arange(200, dtype=np.uint8), (3000, 4))], restart=0)
    at = good.index(b"\xff\xc0")
    liar = good[: at + 5] + (65500).to_bytes(2, "big") * 2 + good[at + 9 : at + 700]
    row, *lies = jpeg.decode([good, *[liar] * 40])
    assert row[:5] == ("ok", 800, 3000, 100, 375) and {x[0] for x in lies} == {"truncated"} and lies[0][1:3] == (65500, 65500)
    want = jpeg.decode([good])[0]
    few = jpeg.FEW
    try:
        jpeg.FEW = 0  # all in lockstep
        assert jpeg.decode([good])[0] == want == row
        jpeg.FEW = 10**9  # each lane by itself
        made = images()
        alone = jpeg.decode([d for _, d in made] + [made[4][1][:-40], liar])
    finally:
        jpeg.FEW = few
    assert alone == jpeg.decode([d for _, d in made] + [made[4][1][:-40], liar])
    df = spark.createDataFrame([(1, good, "a", 2), (1, good, "a", 2), (None, None, None, None), (2, bytearray(b""), "x", 1)], "id long, image binary, status string, width int")
    got = jpeg.media(df, "id", "image").collect()
    assert sorted((str(r["id"]), str(r["status"])) for r in got) == [("1", "ok"), ("1", "ok"), ("2", "not_jpeg"), ("None", "None")]
    assert jpeg.media(df.limit(0), "id", "image").collect() == []
