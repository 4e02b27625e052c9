import hashlib
import os
import time
import zlib

import numpy as np
import pytest

from graftline.llm import jpeg, media

SCHEMA = "doc_id long, text string, media string, f int, feature string"


def decoded(blob):
    """Header and coefficients of one file."""
    h = jpeg.parse(blob)
    found = jpeg.decode_many([h])[0]
    if isinstance(found, ValueError):
        raise found
    return h, found


def bit_by_bit(h):
    """A plain decoder: one interval, block and bit after the other."""
    across, down, kinds = h.layout()
    parts, at, start = [], 0, 0
    while (at := h.data.find(b"\xff", at)) >= 0:
        if 0xD0 <= h.data[at + 1] <= 0xD7:
            parts.append(h.data[start:at])
            start = at + 2
        at += 2
    parts, out, left = [*parts, h.data[start:]], [], across * down
    for part in parts:
        bits, pos = "".join(f"{b:08b}" for b in part.replace(b"\xff\0", b"\xff")), 0
        tables = {}
        for key, t in h.huffman.items():
            code, i, tables[key] = 0, 16, {}
            for length, n in enumerate(t[:16], 1):
                for _ in range(n):
                    tables[key][f"{code:0{length}b}"] = t[i]
                    code, i = code + 1, i + 1
                code <<= 1

        def symbol(key):
            nonlocal pos
            end = pos + 1
            while bits[pos:end] not in tables[key]:
                end += 1
            s, pos = tables[key][bits[pos:end]], end
            return s

        def value(size):
            nonlocal pos
            text, pos = bits[pos : pos + size], pos + size
            return 0 if not size else int(text, 2) if text[0] == "1" else int(text, 2) - (1 << size) + 1

        pred = [0] * len(h.scan)
        for _ in range(min(left, h.restart or left)):
            left -= 1
            for kind in kinds:
                block, k = [0] * 64, 1
                pred[kind] += value(symbol(h.scan[kind][1]))
                block[0] = pred[kind]
                while k < 64:
                    s = symbol(0x10 | h.scan[kind][2])
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        block[k] = value(s & 15)
                    k += 1
                out.append(block)
    return np.array(out).reshape(across * down, len(kinds), 64)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_round_trip(n):
    payload = os.urandom(192 * n)
    blob = jpeg.encode(payload)
    h, found = decoded(blob)
    assert jpeg.payload_of(h, found) == payload
    assert h.width * h.height >= 64 * n
    if n < 70:
        assert (bit_by_bit(h) == found).all()


def test_codes_of_several_lengths_are_decoded():
    h, found = decoded(jpeg.encode(bytes(range(256)) * 3))
    assert sum(h.huffman[0][:16]) == 9 and (bit_by_bit(h) == found).all()
    assert len(np.unique(found)) == 256


def natural(rng, width, height, sampling, restart=0):
    """A baseline file with runs, ends of blocks, negative values and differences."""
    dc_symbols, ac_symbols = list(range(10)), [0x00, 0xF0] + [run << 4 | size for run in range(5) for size in range(1, 8)]
    table = lambda symbols: bytes([0] * 5 + [len(symbols)] + [0] * 10) + bytes(symbols)
    codes = lambda symbols: {s: f"{i:06b}" for i, s in enumerate(symbols)}
    dc, ac = codes(dc_symbols), codes(ac_symbols)
    n = len(sampling)
    across, down = max(a for a, _ in sampling), max(d for _, d in sampling)
    if n == 1:
        kinds, units = [0], -(-width // 8) * -(-height // 8)
    else:
        kinds, units = [i for i, (a, d) in enumerate(sampling) for _ in range(a * d)], -(-width // (8 * across)) * -(-height // (8 * down))

    def value(v):
        size = abs(v).bit_length()
        return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    def block(kind, pred):
        first = int(rng.integers(-200, 200))
        size, text = value(first - pred[kind])
        bits, pred[kind], k = dc[size] + text, first, 1
        while k < 64:
            run = int(rng.integers(0, 30))
            if k + run >= 64:
                return bits + ac[0]
            while run > 15:
                bits, run, k = bits + ac[0xF0], run - 16, k + 16
            if run > 4:
                return bits + ac[0]
            k += run
            size, text = value(int(rng.integers(1, 100)) * int(rng.choice([-1, 1])))
            bits, k = bits + ac[run << 4 | size] + text, k + 1
        return bits

    data, marks = b"", 0
    for lo in range(0, units, restart or units):
        pred, bits = [0] * n, ""
        for _ in range(min(restart or units, units - lo)):
            bits += "".join(block(kind, pred) for kind in kinds)
        bits += "1" * (-len(bits) % 8)
        data += (bytes([0xFF, 0xD0 + (marks - 1) % 8]) if marks else b"") + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
        marks += 1
    seg = jpeg._segment
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, a << 4 | d, 0]) for i, (a, d) in enumerate(sampling))
    scan = bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0])
    return b"\xff\xd8" + seg(jpeg.DQT, b"\0" + bytes([3] * 64)) + seg(jpeg.SOF0, frame) + seg(jpeg.DHT, b"\0" + table(dc_symbols)) + seg(jpeg.DHT, b"\x10" + table(ac_symbols)) + (seg(jpeg.DRI, restart.to_bytes(2, "big")) if restart else b"") + seg(jpeg.SOS, scan) + data + b"\xff\xd9"


FULL, HALF = [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)]


@pytest.mark.parametrize("width, height, sampling, restart", [(96, 8, [(1, 1)], 0), (20, 30, FULL, 0), (50, 40, HALF, 0), (50, 40, HALF, 2), (33, 17, [(2, 1), (1, 1), (1, 1)], 3), (64, 64, [(1, 1)], 5)])
def test_other_baseline_files(width, height, sampling, restart):
    h, found = decoded(natural(np.random.default_rng(4), width, height, sampling, restart))
    assert (found == bit_by_bit(h)).all() and found.any()
    image = jpeg.thumbnail(h, found)
    assert image.shape == (-(-height // 8), -(-width // 8))
    if sampling == HALF:  # the second block of a unit is right of the first, the third below it
        want = np.clip(found[0, :4, 0] * 3 / 8 + 128, 0, 255)
        assert [image[0, 0], image[0, 1], image[1, 0], image[1, 1]] == want.tolist()


def test_files_side_by_side_and_broken_ones():
    rng = np.random.default_rng(5)
    good = [jpeg.encode(b"a" * 192 * n) for n in (1, 5, 3)] + [natural(rng, 40, 40, HALF, 1), natural(rng, 16, 16, FULL)]
    cut = good[3][:-40] + b"\xff\xd9"
    rows = media.read_back([good[0], None, good[1], b"\xff\xd8", cut, good[3], b"", good[2], good[4], good[1][:300]])
    assert [r[-1] is None for r in rows] == [True, True, True, False, False, False, False, True, False, False]
    assert rows[1] == (None,) * len(rows[0]) and [rows[i][0] for i in (0, 2, 7)] == [192, 960, 576]
    assert rows[5][-1] == "no payload in this file" and rows[5][5:7] == (40, 40) and rows[5][7].startswith("40x40:")
    assert rows[4][3] == len(cut) and rows[4][7] is None


def test_long_files_take_time_in_proportion():
    for blob in (jpeg.encode(b"text and more " * 96 * 1000), natural(np.random.default_rng(1), 400, 100, FULL, 0)):
        began = time.process_time()
        decoded(blob)
        assert time.process_time() - began < 5


def test_other_formats_are_refused():
    with pytest.raises(ValueError):
        jpeg.parse(b"GIF89a")


TEXTS = [None, "", "a", "x" * 191, "x" * 192, "x" * 193, "é" * 5000, "\U0001f600 tie", "\U0001f600 tie", "w " * 300000]


def test_media_columns(spark):
    rows = [(i if i % 4 else None, t, "", 0, "") for i, t in enumerate(TEXTS)]
    got = media.describe(media.store(spark.createDataFrame(rows, SCHEMA))).collect()
    by = sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got)
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        want.append((str(i), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert by == sorted(want)
    same = [r for r in got if r.payload_sha256 == hashlib.sha256("\U0001f600 tie".encode().ljust(192)).hexdigest()]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1 and len(same) == 2
    assert media.describe(media.store(spark.createDataFrame([], SCHEMA))).count() == 0
    broken = spark.createDataFrame([(1, 3, None), (2, 3, bytearray(b"no media"))], "doc_id long, n_bytes long, media binary")
    assert [(r.doc_id, r.media_bytes, r.error) for r in media.describe(broken).orderBy("doc_id").collect()] == [(1, None, None), (2, 8, "not a JPEG file")]
