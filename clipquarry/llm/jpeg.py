"""Baseline JPEG columns: markers, Huffman scans and DC-only luminance thumbnails, in numpy.

The scans of a whole Arrow batch are decoded in lockstep: each restart interval of each image is a lane, and one numpy step
decodes the next symbol of every lane, so there is no Python work for each symbol."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, only, read_table, small_batches

ZIGZAG = np.array([r * 8 + c for s in range(15) for r, c in ((i, s - i) if s % 2 else (s - i, i) for i in range(s + 1)) if r < 8 and c < 8])


#: Bytes of images, and different Huffman tables (128 KB each), that are decoded in lockstep; one image may have more. With fewer lanes than FEW a lane is read by itself.
LOCKSTEP_BYTES, LOCKSTEP_TABLES, FEW = 1 << 26, 1024, 24


class Bad(ValueError):
    """An image that can't be read; the text says why."""


def lookup(counts: bytes, values: bytes) -> np.ndarray:
    """length << 8 | symbol for every 16 bits that may come; 0 where no code begins so."""
    table, code = np.zeros(65536, np.uint16), 0
    k = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            if k >= len(values) or code >= 1 << length:
                raise Bad("corrupt")
            lo = code << (16 - length)
            table[lo : lo + (1 << (16 - length))] = length << 8 | values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def markers(data: bytes) -> dict:
    """Dimensions, luminance sampling, tables and the scan that has the luminance, of a baseline image; Bad otherwise."""
    if data[:2] != b"\xff\xd8":
        raise Bad("not_jpeg")
    at, n, dht, dqt, frame, restart = 2, len(data), {}, {}, None, 0
    while True:
        if at + 4 > n or data[at] != 0xFF:
            raise Bad("truncated" if at + 4 > n else "corrupt")
        m = data[at + 1]
        if m == 0xFF or m == 0x01 or 0xD0 <= m <= 0xD7:
            at += 1 if m == 0xFF else 2
            continue
        if m == 0xD9:
            raise Bad("truncated")
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise Bad("truncated")
        at += 2 + size
        if m == 0xC0 or m == 0xC1:
            if size < 8 or len(body) < 6 + 3 * body[5]:
                raise Bad("corrupt")
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            frame = {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "parts": parts}
            if body[0] != 8 or not frame["height"]:
                raise Bad("unsupported")
            if not parts or not frame["width"] or any(not 1 <= h <= 4 or not 1 <= v <= 4 for _, h, v, _ in parts):
                raise Bad("corrupt")
        elif 0xC2 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC):
            raise Bad("unsupported")
        elif m == 0xC4:
            k = 0
            while k + 17 <= len(body):
                total = sum(body[k + 1 : k + 17])
                dht[body[k]] = (body[k + 1 : k + 17], body[k + 17 : k + 17 + total])
                k += 17 + total
        elif m == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                if k + 1 + 64 * (1 + wide) > len(body):
                    raise Bad("corrupt")
                dqt[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif m == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif m == 0xDA:
            if frame is None or len(body) < 1 + 2 * body[0]:
                raise Bad("corrupt")
            own = {p[0]: p for p in frame["parts"]}
            scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            if any(c not in own for c, _, _ in scan):
                raise Bad("corrupt")
            stop = at
            while True:
                stop = data.find(b"\xff", stop)
                if stop < 0 or stop + 1 >= n:
                    stop = n
                    break
                if data[stop + 1] and not 0xD0 <= data[stop + 1] <= 0xD7:
                    break
                stop += 2
            first = frame["parts"][0]
            if first[0] not in [c for c, _, _ in scan]:
                at = stop
                continue
            if first[3] not in dqt or any(d not in dht or 16 + a not in dht for _, d, a in scan):
                raise Bad("corrupt")
            return {**frame, "quant": dqt[first[3]], "restart": restart, "data": data[at:stop], "scan": [(own[c][1], own[c][2], dht[d], dht[16 + a], c == first[0]) for c, d, a in scan]}


def _grid(info: dict) -> dict:
    """Blocks of an MCU in order, MCUs of a row and in all, luminance blocks of a row."""
    hs, vs = max(p[1] for p in info["parts"]), max(p[2] for p in info["parts"])
    h0, v0 = info["parts"][0][1:3]
    if len(info["scan"]) == 1:  # not interleaved: one block at a time, no padding to whole MCUs
        across = -(-(-(-info["width"] * h0 // hs)) // 8)
        down = -(-(-(-info["height"] * v0 // vs)) // 8)
        return {"blocks": [(info["scan"][0], 0, 0)], "across": across, "mcus": across * down, "h": 1, "v": 1, "wide": across, "rows": down, "seen": (down, across)}
    across, down = -(-info["width"] // (8 * hs)), -(-info["height"] // (8 * vs))
    blocks = [(s, y, x) for s in info["scan"] for y in range(s[1]) for x in range(s[0])]
    if len(blocks) > 10:
        raise Bad("corrupt")
    seen = (-(-(-(-info["height"] * v0 // vs)) // 8), -(-(-(-info["width"] * h0 // hs)) // 8))
    return {"blocks": blocks, "across": across, "mcus": across * down, "h": h0, "v": v0, "wide": across * h0, "rows": down * v0, "seen": seen}


def _lanes(raw: bytes) -> list[bytes]:
    """Restart intervals without stuffed zeros."""
    if b"\xff" not in raw:
        return [raw]
    out, begin, at = [], 0, 0
    while (at := raw.find(b"\xff", at)) >= 0 and at + 1 < len(raw):
        if 0xD0 <= raw[at + 1] <= 0xD7:
            out.append(raw[begin:at])
            begin = at + 2
        at += 2
    out.append(raw[begin:])
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def dc_planes(infos: list[dict]) -> list[np.ndarray | str]:
    """For each image the luminance DC of its blocks as grey levels (uint8, rows by columns), or why it can't be had."""
    tables: dict[tuple, int] = {}
    luts: list[np.ndarray] = []

    def table(t: tuple) -> int:
        if t not in tables:
            luts.append(lookup(*t))
            tables[t] = len(luts) - 1
        return tables[t]

    out: list[np.ndarray | str] = [""] * len(infos)
    spec, planes = [], 0
    chunks, owner, lane_mcu, lane_n, lane_at, pos = [], [], [], [], [], 0
    dcs, acs, comps, lumas = (np.zeros((len(infos), 10), np.int64) for _ in range(4))
    sizes, base = np.ones(len(infos), np.int64), np.zeros(len(infos), np.int64)
    for i, info in enumerate(infos):
        try:
            g = _grid(info)
            for k, (s, y, x) in enumerate(g["blocks"]):
                dcs[i, k], acs[i, k] = table(s[2]), table(s[3])
                comps[i, k] = info["scan"].index(s)
                lumas[i, k] = y * g["wide"] + x if s[4] else -1
            if g["mcus"] * len(g["blocks"]) * 2 > len(info["data"]) * 8:  # a block takes two bits at least
                raise Bad("truncated")
            parts = _lanes(info["data"])
            step = info["restart"] or g["mcus"]
            if len(parts) != -(-g["mcus"] // step):
                raise Bad("truncated" if len(parts) < -(-g["mcus"] // step) else "corrupt")
        except Bad as e:
            out[i] = str(e)
            spec.append(None)
            continue
        sizes[i], base[i] = len(g["blocks"]), planes
        planes += g["wide"] * g["rows"]
        spec.append(g)
        for k, p in enumerate(parts):
            owner.append(i), lane_mcu.append(k * step), lane_n.append(min(step, g["mcus"] - k * step)), lane_at.append(pos)
            chunks.append(p + b"\0" * 8)
            pos += len(p) + 8
    plane, bad = np.zeros(planes, np.int32), np.zeros(len(infos), bool)
    if owner:
        joined = b"".join(chunks)
        data = np.frombuffer(joined, np.uint8)
        lut = np.concatenate(luts)
        across = np.array([g["across"] if g else 1 for g in spec])
        gh, gv, wide = (np.array([g[x] if g else 1 for g in spec]) for x in ("h", "v", "wide"))
        lane = np.arange(len(owner))
        own, mcu, todo = np.array(owner), np.array(lane_mcu), np.array(lane_n)
        bit = np.array(lane_at, np.int64) * 8
        end = bit + np.array([len(c) - 8 for c in chunks], np.int64) * 8
        block, coef = np.zeros_like(lane), np.zeros_like(lane)
        pred = np.zeros((len(lane), 4), np.int64)
        while len(lane) > FEW:
            p = bit >> 3
            b0, b1, b2, b3, b4 = (data[p + k].astype(np.int64) for k in range(5))
            word = (b0 << 32 | b1 << 24 | b2 << 16 | b3 << 8 | b4) >> (8 - (bit & 7)) & 0xFFFFFFFF
            is_dc = coef == 0
            entry = lut[np.where(is_dc, dcs[own, block], acs[own, block]) << 16 | word >> 16].astype(np.int64)
            length, sym = entry >> 8, entry & 255
            size = np.where(is_dc, sym, sym & 15)
            wrong = (length == 0) | (is_dc & (sym > 11))
            d = np.flatnonzero(is_dc & ~wrong)
            if len(d):
                s, o = size[d], own[d]
                extra = word[d] >> (32 - length[d] - s) & ((1 << s) - 1)
                value = np.where(extra < (1 << s >> 1), extra - (1 << s) + 1, extra)
                c = comps[o, block[d]]
                pred[d, c] += np.where(s > 0, value, 0)
                lu = lumas[o, block[d]]
                y = lu >= 0
                o, m = o[y], mcu[d][y]
                plane[base[o] + (m // across[o]) * gv[o] * wide[o] + (m % across[o]) * gh[o] + lu[y]] = pred[d[y], c[y]]
            bit = bit + length + size
            coef = np.where(is_dc, 1, np.where(size > 0, coef + (sym >> 4) + 1, np.where(sym == 0xF0, coef + 16, 64)))
            wrong |= (bit > end) | (coef > 64)
            done = coef >= 64
            block = block + done
            coef = np.where(done, 0, coef)
            whole = block == sizes[own]
            block = np.where(whole, 0, block)
            mcu, todo = mcu + whole, todo - whole
            if wrong.any():
                bad[own[wrong]] = True
            go = (todo > 0) & ~wrong
            if not go.all():
                lane, own, mcu, todo, bit, end, block, coef, pred = (x[go] for x in (lane, own, mcu, todo, bit, end, block, coef, pred))
        for k in range(len(lane)):
            i = int(own[k])
            g, n = spec[i], int(sizes[i])
            kinds = [(luts[dcs[i, j]], luts[acs[i, j]], int(comps[i, j]), int(lumas[i, j])) for j in range(n)]
            state = (int(bit[k]), int(end[k]), int(block[k]), int(coef[k]), int(mcu[k]), int(todo[k]), pred[k].tolist())
            bad[i] |= not _alone(joined, kinds, state, plane[base[i] : base[i] + g["wide"] * g["rows"]], g)
    for i, g in enumerate(spec):
        if g and bad[i]:
            out[i] = "corrupt"
        elif g:
            p = plane[base[i] : base[i] + g["wide"] * g["rows"]].reshape(g["rows"], g["wide"])[: g["seen"][0], : g["seen"][1]]
            out[i] = np.clip((p * infos[i]["quant"] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return out


def _alone(data: bytes, kinds: list[tuple], state: tuple, plane: np.ndarray, g: dict) -> bool:
    """Read the rest of one lane, symbol by symbol; False if it is corrupt. For the last lanes, which are too few for numpy to gain by."""
    bit, end, block, coef, mcu, todo, pred = state
    tables = [(memoryview(d), memoryview(a), c, lu) for d, a, c, lu in kinds]
    across, gv, gh, wide = g["across"], g["v"], g["h"], g["wide"]
    while todo:
        dc, ac, comp, luma = tables[block]
        while coef < 64:
            at = bit >> 3
            word = int.from_bytes(data[at : at + 5], "big") >> (8 - (bit & 7)) & 0xFFFFFFFF
            entry = (ac if coef else dc)[word >> 16]
            length, sym = entry >> 8, entry & 255
            if coef:
                size = sym & 15
                coef += (sym >> 4) + 1 if size else 16 if sym == 0xF0 else 64
                if coef > 64 and (size or sym == 0xF0):
                    return False
            else:
                size = sym
                if size > 11:
                    return False
                if size:
                    extra = word >> (32 - length - size) & ((1 << size) - 1)
                    pred[comp] += extra - (1 << size) + 1 if extra < 1 << size >> 1 else extra
                if luma >= 0:
                    plane[mcu // across * gv * wide + mcu % across * gh + luma] = pred[comp]
                coef = 1
            bit += length + size
            if not length or bit > end:
                return False
        block, coef = block + 1, 0
        if block == len(tables):
            block, mcu, todo = 0, mcu + 1, todo - 1
    return True


_RESIZE: dict[tuple[int, int], np.ndarray] = {}


def _resize(n: int, m: int) -> np.ndarray:
    """Area averages of n cells in m."""
    if (n, m) not in _RESIZE:
        edge = np.arange(m + 1) * n / m
        cell = np.arange(n)
        over = np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell)
        w = np.maximum(over, 0)
        _RESIZE[n, m] = w / w.sum(1, keepdims=True)
    return _RESIZE[n, m]


def hashes(thumb: np.ndarray) -> tuple[int, int]:
    """Average hash and difference hash, 64 bits each."""
    h, w = thumb.shape
    t = thumb.astype(float)
    rows = _resize(h, 8) @ t
    square, nine = np.round(rows @ _resize(w, 8).T, 6), np.round(rows @ _resize(w, 9).T, 6)
    bits = np.packbits(np.r_[(square > square.mean()).ravel(), (nine[:, 1:] > nine[:, :-1]).ravel()])
    a, d = bits.view(">i8")
    return int(a), int(d)


FIELDS = "status string, width int, height int, thumb_width int, thumb_height int, thumb binary, average_hash long, difference_hash long"


def decode(images: list[bytes | None]) -> list[tuple]:
    """FIELDS of each image; as many at once as LOCKSTEP_BYTES and LOCKSTEP_TABLES allow, so memory is bounded by them or by one image."""
    infos, where, out = [], [], [(None,) * 8] * len(images)
    for i, data in enumerate(images):
        if data is None:
            continue
        try:
            infos.append(markers(data))
            where.append(i)
        except Bad as e:
            out[i] = (str(e), *(None,) * 7)
    planes, begin, size, tables = [], 0, 0, set()
    for k, info in enumerate(infos):
        own = {t for s in info["scan"] for t in s[2:4]}
        if k > begin and (size + len(info["data"]) > LOCKSTEP_BYTES or len(tables | own) > LOCKSTEP_TABLES):
            planes += dc_planes(infos[begin:k])
            begin, size, tables = k, 0, set()
        size += len(info["data"])
        tables |= own
    planes += dc_planes(infos[begin:])
    for i, info, t in zip(where, infos, planes, strict=True):
        if isinstance(t, str):
            out[i] = (t, info["width"], info["height"], *(None,) * 5)
        else:
            out[i] = ("ok", info["width"], info["height"], t.shape[1], t.shape[0], t.tobytes(), *hashes(t))
    return out


def media(df: DataFrame, key: str, image: str) -> DataFrame:
    """(key, FIELDS) of every row: dimensions, the DC-only luminance thumbnail (a pixel for each 8 x 8 block, row by row) and its hashes.

    status is ok; not_jpeg, also for no bytes; unsupported (progressive, arithmetic, lossless, 12 bits); truncated or corrupt. An image whose header tells of more blocks than its scan has room for is truncated; no memory is taken for them. Where it isn't ok, what could not be read is null. A null image has all null. An image of any size is read whole. No rows in: none out. Repeated rows and null keys are rows like others. Other columns are ignored."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    names = [key, *(f.split()[0] for f in FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = decode(batch.column(1).to_pylist())
            columns = zip(*got, strict=True) if got else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=names)

    return only(df, key, image).mapInArrow(run, f"`{key}` {kind}, {FIELDS}")


# -- a baseline encoder, for images to read

DC_TABLE = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
_AC = "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
AC_TABLE = (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]), bytes.fromhex(_AC))


def _codes(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    c, k = 0, 0
    for n in range(1, 17):
        for _ in range(table[0][n - 1]):
            code[table[1][k]], length[table[1][k]] = c, n
            c, k = c + 1, k + 1
        c <<= 1
    return code, length


_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
_CODES = (_codes(DC_TABLE), _codes(AC_TABLE))


def _size(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def encode(planes: list[np.ndarray], quant: int = 12, restart: int = 0) -> bytes:
    """A baseline JPEG of one grey plane, or of Y, Cb and Cr with Cb and Cr of half the size in both directions."""
    height, width = planes[0].shape
    colour = len(planes) == 3
    unit = 16 if colour else 8
    down, across = -(-height // unit), -(-width // unit)
    seq = []  # blocks in order of the scan, with their component
    for k, p in enumerate(planes):
        f = 2 if colour and k == 0 else 1
        h, w = down * 8 * f, across * 8 * f
        p = np.pad(p, ((0, h - p.shape[0]), (0, w - p.shape[1])), mode="edge").astype(float) - 128
        b = p.reshape(down, f, 8, across, f, 8).transpose(0, 3, 1, 4, 2, 5).reshape(down * across, f * f, 8, 8)
        seq.append(np.round(_DCT @ b @ _DCT.T / quant).astype(np.int64).reshape(down * across, f * f, 64)[:, :, ZIGZAG])
    blocks = np.concatenate(seq, axis=1)
    mcus, each, _ = blocks.shape
    comp = np.concatenate([np.full(s.shape[1], k) for k, s in enumerate(seq)])
    dc = blocks[:, :, 0].copy()
    step = restart or mcus
    for k in range(len(planes)):
        v = dc[:, comp == k].ravel()
        begin = np.arange(mcus)[:, None].repeat((comp == k).sum(), 1).ravel()
        first = (begin % step == 0) & np.r_[True, begin[1:] != begin[:-1]]
        dc[:, comp == k] = np.where(first, v, v - np.r_[0, v[:-1]]).reshape(mcus, -1)
    flat = blocks.reshape(-1, 64)
    d, n = dc.ravel(), _size(dc.ravel())
    keys, codes, lens = [np.arange(len(d)) * 256], [_CODES[0][0][n] << n | np.where(d < 0, d + (1 << n) - 1, d)], [_CODES[0][1][n] + n]
    r, c = np.nonzero(flat[:, 1:])
    c = c + 1
    run = c - np.where(np.r_[False, r[1:] == r[:-1]], np.r_[0, c[:-1]], 0) - 1
    v = flat[r, c]
    n = _size(v)
    sym = (run % 16) << 4 | n
    keys.append(r * 256 + c * 4 + 3), codes.append(_CODES[1][0][sym] << n | np.where(v < 0, v + (1 << n) - 1, v)), lens.append(_CODES[1][1][sym] + n)
    for z in range(3):
        far = run >= 16 * (z + 1)
        keys.append(r[far] * 256 + c[far] * 4 + z), codes.append(np.full(far.sum(), _CODES[1][0][0xF0])), lens.append(np.full(far.sum(), _CODES[1][1][0xF0]))
    last = np.flatnonzero(flat[:, 63] == 0)
    keys.append(last * 256 + 255), codes.append(np.full(len(last), _CODES[1][0][0])), lens.append(np.full(len(last), _CODES[1][1][0]))
    key, code, size = (np.concatenate(x) for x in (keys, codes, lens))
    order = np.argsort(key, kind="stable")
    key, code, size = key[order], code[order], size[order]
    part = key // 256 // each // step
    scan = b""
    for k in range(-(-mcus // step)):
        cd, sz = code[part == k], size[part == k]
        at = np.repeat(np.cumsum(sz), sz) - np.arange(int(sz.sum())) - 1
        bits = (np.repeat(cd, sz) >> at & 1).astype(np.uint8)
        bits = np.r_[bits, np.ones(-len(bits) % 8, np.uint8)]
        scan += (bytes([0xFF, 0xD0 + (k - 1) % 8]) if k else b"") + np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")

    def segment(m: int, body: bytes) -> bytes:
        return bytes([0xFF, m]) + (len(body) + 2).to_bytes(2, "big") + body

    parts = b"".join(bytes([k + 1, 0x22 if colour and not k else 0x11, 0]) for k in range(len(planes)))
    return (
        b"\xff\xd8"
        + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
        + segment(0xDB, b"\0" + bytes([quant]) * 64)
        + segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(planes)]) + parts)
        + segment(0xC4, b"\0" + DC_TABLE[0] + DC_TABLE[1] + b"\x10" + AC_TABLE[0] + AC_TABLE[1])
        + (segment(0xDD, restart.to_bytes(2, "big")) if restart else b"")
        + segment(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + b"\0\x3f\0")
        + scan
        + b"\xff\xd9"
    )


def page_planes(html: bytes) -> list[np.ndarray]:
    """A picture of a whole page: each pixel is the mean of its share of the page's bytes. Three pages in eight are in colour."""
    raw = np.frombuffer(html or b" ", np.uint8).astype(np.int64)
    n = len(raw)
    w, h = 16 + n % 25, 16 + n // 25 % 25
    total = np.r_[0, np.cumsum(raw)]

    def plane(w: int, h: int, turn: int) -> np.ndarray:
        k = np.arange(w * h)
        a = k * n // (w * h)
        b = np.maximum((k + 1) * n // (w * h), a + 1)
        v = (total[b] - total[a]) / (b - a)
        return np.clip((np.roll(v, turn).reshape(h, w) - 96) * 4 + 128, 0, 255).astype(np.uint8)

    if n % 8 < 3:
        return [plane(w, h, 0), plane(-(-w // 2), -(-h // 2), 7), plane(-(-w // 2), -(-h // 2), 19)]
    return [plane(w, h, 0)]


def page_images(pages: DataFrame) -> DataFrame:
    """(page_id, image): the tables hold no images, so each page is pictured as a baseline JPEG. A null page has a null image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [None if x is None else encode(page_planes(x.encode()), restart=4 * (len(x) % 2)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], names=["page_id", "image"])

    small_batches(pages.sparkSession)
    return only(pages, "page_id", "html").withColumn("page_id", F.col("page_id").cast("long")).mapInArrow(run, "page_id long, image binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(page_images(read_table(spark, sf_dir, "pages")), "page_id", "image")


by_value(__name__)
