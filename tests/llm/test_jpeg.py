"""The progressive JPEG decoder against an encoder that writes any scans, and against a slow transform; the payload's way there and back."""

import math
import re

import numpy as np
import pytest

from lodestar.llm import jpeg

ZIGZAG = []
for s in range(15):  # up and down the diagonals
    diagonal = [(y, s - y) for y in range(8) if 0 <= s - y < 8]
    ZIGZAG += [y * 8 + x for y, x in (diagonal if s % 2 else diagonal[::-1])]


class Writer:
    """Symbols and bits of one scan; every symbol that the scan has gets a code of nine bits."""

    def __init__(self):
        self.items = []

    def symbol(self, s):
        self.items.append((s, None))

    def bits(self, value, n):
        self.items.append((value, n))

    def number(self, v):
        size = abs(v).bit_length()
        self.bits(v if v > 0 else v + (1 << size) - 1, size)

    def packed(self, codes):
        text = "".join(f"{codes[a]:09b}" if n is None else f"{a:0{n}b}" if n else "" for a, n in self.items)
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def _run_end(w, run, after):
    if run:
        n = run.bit_length() - 1
        w.symbol(n << 4)
        w.bits(run - (1 << n), n)
        for b in after:
            w.bits(b, 1)


def _ac_first(w, blocks, ss, se, al):
    run = 0
    for block in blocks:
        zeros = 0
        for k in range(ss, se + 1):
            c = int(block[ZIGZAG[k]])
            v = (abs(c) >> al) * (1 if c > 0 else -1)
            if not v:
                zeros += 1
                continue
            _run_end(w, run, [])
            run = 0
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            w.symbol(zeros << 4 | abs(v).bit_length())
            w.number(v)
            zeros = 0
        if zeros:
            run += 1
    _run_end(w, run, [])


def _ac_refine(w, blocks, ss, se, al):
    run, after = 0, []
    for block in blocks:
        size = {k: abs(int(block[ZIGZAG[k]])) >> al for k in range(ss, se + 1)}
        last = max((k for k in size if size[k] == 1), default=-1)
        zeros, corrections = 0, []
        for k in range(ss, se + 1):
            if not size[k]:
                zeros += 1
                continue
            while zeros > 15 and k <= last:
                _run_end(w, run, after)
                run, after = 0, []
                w.symbol(0xF0)
                for b in corrections:
                    w.bits(b, 1)
                corrections, zeros = [], zeros - 16
            if size[k] > 1:
                corrections.append(size[k] & 1)
                continue
            _run_end(w, run, after)
            run, after = 0, []
            w.symbol(zeros << 4 | 1)
            w.bits(int(block[ZIGZAG[k]] > 0), 1)
            for b in corrections:
                w.bits(b, 1)
            zeros, corrections = 0, []
        if zeros or corrections:
            run, after = run + 1, after + corrections
    _run_end(w, run, after)


def _segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _written(parts, head):
    """A scan: its Huffman table with the symbols it needs, its header, and its intervals."""
    kind, scan = head
    symbols = sorted({a for w in parts for a, n in w.items if n is None})
    codes = {s: i for i, s in enumerate(symbols)}
    table = _segment(0xC4, bytes([kind]) + bytes(len(symbols) if n == 9 else 0 for n in range(1, 17)) + bytes(symbols)) if symbols else b""
    data = b"".join((bytes([0xFF, 0xD0 + (i - 1) % 8]) if i else b"") + w.packed(codes) for i, w in enumerate(parts))
    return table + _segment(0xDA, scan) + data


def encode(coefs, factors, width, height, quant, restart=0):
    """coefs: per component (blocks down, blocks across, 64), natural order, padded to whole groups of blocks."""
    H, V = max(h for h, _ in factors), max(v for _, v in factors)
    down, across = math.ceil(height / (8 * V)), math.ceil(width / (8 * H))
    out = [b"\xff\xd8", _segment(0xDB, bytes([0]) + bytes(int(quant[i]) for i in ZIGZAG))]
    if restart:
        out.append(_segment(0xDD, restart.to_bytes(2, "big")))
    out.append(_segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(coefs)]) + bytes(x for i, (h, v) in enumerate(factors) for x in (i + 1, h << 4 | v, 0))))

    def split(n):
        return [range(a, min(n, a + (restart or n))) for a in range(0, n, restart or n)]

    def dc(ah, al):
        parts = []
        for some in split(down * across):
            w, last = Writer(), [0] * len(coefs)
            for m in some:
                my, mx = divmod(m, across)
                for c, (h, v) in enumerate(factors):
                    for b in range(h * v):
                        value = int(coefs[c][my * v + b // h, mx * h + b % h, 0])
                        if ah:
                            w.bits(value >> al & 1, 1)
                        else:
                            d, last[c] = (value >> al) - last[c], value >> al
                            w.symbol(abs(d).bit_length())
                            w.number(d)
            parts.append(w)
        out.append(_written(parts, (0, bytes([len(coefs)]) + bytes(x for i in range(len(coefs)) for x in (i + 1, 0)) + bytes([0, 0, ah << 4 | al]))))

    def ac(c, ss, se, ah, al):
        h, v = factors[c]
        rows, columns = math.ceil(math.ceil(height * v / V) / 8), math.ceil(math.ceil(width * h / H) / 8)
        blocks = coefs[c][:rows, :columns].reshape(-1, 64)
        parts = []
        for some in split(len(blocks)):
            w = Writer()
            (_ac_refine if ah else _ac_first)(w, [blocks[i] for i in some], ss, se, al)
            parts.append(w)
        out.append(_written(parts, (0x10, bytes([1, c + 1, 0, ss, se, ah << 4 | al]))))

    dc(0, 1)
    for c in range(len(coefs)):
        ac(c, 1, 5, 0, 2)
        ac(c, 6, 63, 0, 2)
    for al in (1, 0):
        for c in range(len(coefs)):
            ac(c, 1, 63, al + 1, al)
    dc(1, 0)
    return b"".join(out) + b"\xff\xd9"


def image(rng, factors, width, height):
    H, V = max(h for h, _ in factors), max(v for _, v in factors)
    down, across = math.ceil(height / (8 * V)), math.ceil(width / (8 * H))
    coefs = []
    for h, v in factors:
        full = rng.integers(-60, 61, (down * v, across * h, 64)) * (rng.random((down * v, across * h, 64)) < rng.choice([0.01, 0.1, 0.5]))
        full[rng.random(full.shape[:2]) < 0.4, 1:] = 0  # runs of blocks without AC
        full[..., 0] = rng.integers(-300, 300, full.shape[:2])
        rows, columns = math.ceil(math.ceil(height * v / V) / 8), math.ceil(math.ceil(width * h / H) / 8)
        full[rows:, :, 1:] = 0
        full[:, columns:, 1:] = 0
        coefs.append(full)
    return coefs


SHAPES = [([(2, 2), (1, 1), (1, 1)], 37, 29, 0), ([(2, 2), (1, 1), (1, 1)], 50, 70, 3), ([(1, 1)] * 3, 17, 9, 0), ([(2, 1), (1, 1), (1, 1)], 33, 24, 2), ([(1, 2), (1, 1), (1, 1)], 24, 40, 0), ([(1, 1)], 20, 30, 1)]


@pytest.mark.parametrize("factors,width,height,restart", SHAPES)
def test_scans_give_the_coefficients(factors, width, height, restart):
    rng = np.random.default_rng(width)
    coefs = image(rng, factors, width, height)
    got = jpeg.Image(encode(coefs, factors, width, height, np.ones(64, int), restart))
    assert (got.width, got.height) == (width, height)
    for want, c in zip(coefs, got.components.values()):
        assert np.array_equal(c["coef"], want)


def _slow(coefs, factors, width, height, quant):
    """Pixels one by one, in floating point."""
    H, V = max(h for h, _ in factors), max(v for _, v in factors)
    cos = [[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)]
    out = np.zeros((height, width, 3))
    for y in range(height):
        for x in range(width):
            p = []
            for c, (h, v) in zip(coefs, factors):
                sy, sx = y * v // V, x * h // H
                block = c[sy // 8, sx // 8] * quant
                p.append(min(255, max(0, round(128 + sum(block[i * 8 + j] * cos[sy % 8][i] * cos[sx % 8][j] for i in range(8) for j in range(8))))))
            if len(p) == 1:
                out[y, x] = p[0]
            else:
                out[y, x] = [p[0] + 1.402 * (p[2] - 128), p[0] - 0.344136 * (p[1] - 128) - 0.714136 * (p[2] - 128), p[0] + 1.772 * (p[1] - 128)]
    return np.clip(out, 0, 255)


@pytest.mark.parametrize("factors,width,height,restart", SHAPES)
def test_pixels_by_a_slow_transform(factors, width, height, restart):
    rng = np.random.default_rng(height)
    coefs, quant = image(rng, factors, width, height), rng.integers(1, 4, 64)
    got = jpeg.decode(encode(coefs, factors, width, height, quant, restart))
    assert got.shape == (height, width, 3) and np.abs(got.astype(float) - _slow(coefs, factors, width, height, quant)).max() <= 4


def test_images_of_more_kinds_together():
    rng = np.random.default_rng(9)
    data = [encode(image(rng, f, w, h), f, w, h, rng.integers(1, 4, 64), r) for f, w, h, r in SHAPES[:4] for _ in range(2)]
    data += jpeg.encode_payloads([jpeg.pad(b"abc" * n) for n in (1, 100, 1000)])
    for alone, together in zip(data, jpeg.tensors_of([jpeg.Image(d) for d in data])):
        assert np.array_equal(jpeg.decode(alone), together)


def test_payloads_are_subsampled_and_whole():
    rng = np.random.default_rng(4)
    for n in [1, 2, 3, 4, 5, 63, 64, 65, 9000]:
        payload = rng.integers(0, 256, n * 192, dtype=np.uint8).tobytes()
        got = jpeg.Image(jpeg.encode_payloads([payload])[0])
        assert [(c["h"], c["v"]) for c in got.components.values()] == [(2, 2), (1, 1), (1, 1)] and jpeg.payload_of(got) == payload


def test_tensors(spark):
    media = jpeg.encode_payloads([jpeg.pad(b"some text")])[0]
    df = spark.createDataFrame([(1, media, "x"), (2, None, "x"), (2, None, "x"), (3, media, "y"), (None, b"", "z")], "doc_id long, media binary, rgb string")
    got = {r.doc_id: r for r in jpeg.tensors(df).collect()}
    assert jpeg.tensors(df).count() == 5 and got[2].rgb is None and got[None].height is None
    assert bytes(got[1].rgb) == jpeg.decode(media).tobytes() == bytes(got[3].rgb) and (got[1].height, got[1].width) == (16, 16)
    assert jpeg.tensors(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match=re.escape("not a JPEG")):
        jpeg.Image(b"GIF89a")
