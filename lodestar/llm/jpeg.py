"""Media columns: progressive JPEG.

The decoder reads a progressive JPEG scan by scan. Each scan holds a spectral band (Ss to Se) of some components at a successive approximation (Ah, Al) and adds to the components' coefficient arrays. Then numpy transforms the blocks back, repeats chroma samples up to full resolution, and turns YCbCr into RGB. Any Huffman tables, sampling factors and
restart intervals are read; where a table has one code only, so that each coefficient takes as many bits, or where a refinement only corrects, a scan is read as arrays instead of bit by bit.

The payload column stores bytes losslessly in the format's unit, the quantised coefficient: 64 bytes are one 8 x 8 block, and six blocks a group of 16 x 16 pixels, four of luma and one of each chroma at half the resolution both ways. A byte b becomes an AC coefficient b + 256; a first scan holds them without their lowest two bits, two refinement scans add one bit each. A DC byte is the difference
of two blocks' DC coefficients that follow each other, plus or minus b + 256 with the sign that keeps them small. The features come from the full-resolution RGB tensors.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, by_bytes, table, text_of, thrifty

UNIT = 192
#: Blocks of a group, luma first; groups down an image, at most.
GROUP, ROWS = (4, 1, 1), 4095
AL = 2
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_EOBS = bytes(n << 4 for n in range(15))


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of UNIT bytes."""
    return data + b" " * (-len(data) % UNIT or (0 if data else UNIT))


# --- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, lengths: dict[int, int], symbols: bytes) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(lengths.get(n, 0) for n in range(1, 17)) + symbols)


def _scan(components: list[int], ss: int, se: int, ah: int, al: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, 0)), ss, se, ah << 4 | al]))


_QUANT = _segment(0xDB, b"\x00" + b"\x01" * 64)
_DC_TABLE = _huffman(0x00, {1: 1}, b"\x09")
_FIRST_TABLE = _huffman(0x10, {1: 1}, bytes([9 - AL]))
_EOB_TABLE = _huffman(0x10, {4: 15}, _EOBS)
_HEAD = b"\xff\xd8" + _QUANT


def _bits(values: np.ndarray, width: int) -> np.ndarray:
    return (values[..., None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)


def _dc_bits(group_bytes: np.ndarray) -> np.ndarray:
    """(groups, 6) DC bytes -> bits of their differences: one code bit and nine value bits each."""
    size = group_bytes.astype(np.int64) + 256
    sign, start = np.empty(size.shape, bool), 0
    for many in GROUP:
        at, down = 0, []
        for m in size[:, start : start + many].reshape(-1).tolist():
            down.append(at > 0)
            at += -m if at > 0 else m
        sign[:, start : start + many] = np.array(down, bool).reshape(-1, many)
        start += many
    return _bits(np.where(sign, 511 - size, size), 10).reshape(-1)  # the code is 0, the value's top bit


def _refinement(bits: np.ndarray, blocks: int) -> bytes:
    """Correction bits after end-of-band runs that cover all blocks."""
    out, done = [], 0
    while done < blocks:
        run = min(blocks - done, 32767)
        n = run.bit_length() - 1
        head = np.array([int(x) for x in f"{n:04b}" + (f"{run - (1 << n):0{n}b}" if n else "")], np.uint8)
        out += [head, bits[done * 63 : (done + run) * 63]]
        done += run
    return _packed(np.concatenate(out))


def _packed(bits: np.ndarray) -> bytes:
    if len(bits) % 8:
        bits = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG of each payload, whose length must be a positive multiple of UNIT."""
    out = []
    for payload in payloads:
        blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        groups = -(-len(blocks) // sum(GROUP))
        columns = -(-groups // ROWS)
        rows = -(-groups // columns)
        blocks = np.concatenate([blocks, np.zeros((columns * rows * sum(GROUP) - len(blocks), 64), np.uint8)]).reshape(-1, sum(GROUP), 64)
        planes = [blocks[:, :4].reshape(rows, columns, 2, 2, 64).swapaxes(1, 2).reshape(-1, 64)[:, 1:], blocks[:, 4, 1:], blocks[:, 5, 1:]]
        size = struct.pack(">BHHB", 8, rows * 16, columns * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        parts = [_HEAD, _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xC2, size), _DC_TABLE, _scan([1, 2, 3], 0, 0, 0, 0), _packed(_dc_bits(blocks[:, :, 0])), _FIRST_TABLE]
        for c, plane in enumerate(planes, 1):
            parts += [_scan([c], 1, 63, 0, AL), ((plane >> AL) + (256 >> AL)).astype(np.uint8).tobytes()]
        parts.append(_EOB_TABLE)
        for al in range(AL - 1, -1, -1):
            for c, plane in enumerate(planes, 1):
                parts += [_scan([c], 1, 63, al + 1, al), _refinement(((plane >> al) & 1).reshape(-1), len(plane))]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# --- reading


class _Table:
    """A Huffman table; only: its symbol and length if it has just one code."""

    def __init__(self, lengths: bytes, symbols: bytes):
        self.codes, code, at = {}, 0, 0
        for n, many in enumerate(lengths, 1):
            for _ in range(many):
                self.codes[n, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.only = (symbols[0], next(n for n, x in enumerate(lengths, 1) if x)) if len(symbols) == 1 else None
        self.ends_only = bool(symbols) and all(s & 15 == 0 and s >> 4 < 15 for s in symbols)


class _Reader:
    """Bits of one restart interval."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def read(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | b
        self.at += n
        if self.at > len(self.bits):
            raise ValueError("the scan ends too early")
        return v

    def symbol(self, table: _Table) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.read(1)
            if (n, code) in table.codes:
                return table.codes[n, code]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        v = self.read(size) if size else 0
        return v if not size or v >> size - 1 else v - (1 << size) + 1


class Image:
    """Coefficients of a progressive JPEG, per component (blocks down, blocks across, 64) in natural order."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, _Table] = {}
        self.restart, self.comment, self.components = 0, b"", {}
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while at < len(data):
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = data[at + 2] << 8 | data[at + 3]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    q = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    natural = np.empty(64, np.int64)
                    natural[ZIGZAG] = q
                    self.quant[body[0] & 15], body = natural, body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]], body = _Table(body[1:17], body[17 : 17 + n]), body[17 + n :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xC2:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(n)]
                self.h, self.v = max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts)
                self.mcus = (-(-self.height // (8 * self.v)), -(-self.width // (8 * self.h)))
                for p in parts:
                    h, v = p[1] >> 4, p[1] & 15
                    own = (-(-(-(-self.height * v // self.v)) // 8), -(-(-(-self.width * h // self.h)) // 8))
                    self.components[p[0]] = {"h": h, "v": v, "q": p[2], "own": own, "coef": np.zeros((self.mcus[0] * v, self.mcus[1] * h, 64), np.int32)}
            elif marker == 0xDA:
                end = at
                while True:  # the scan's data last up to a marker that is neither a stuffed byte nor a restart
                    end = data.index(b"\xff", end)
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                    else:
                        break
                self._scan(body, data[at:end])
                at = end
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a progressive JPEG with Huffman codes")

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        parts = [(self.components[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
        ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if self.restart:
            import re

            pieces = re.split(rb"\xff[\xd0-\xd7]", data)
        else:
            pieces = [data]
        pieces = [p.replace(b"\xff\x00", b"\xff") for p in pieces]
        if n == 1:
            comp, tables = parts[0]
            rows, columns = comp["own"]
            order = comp["coef"][:rows, :columns].reshape(-1, 64)  # a copy unless the component has no padding
            many = rows * columns
        else:
            many, order = self.mcus[0] * self.mcus[1], None
        each = self.restart or many
        for k, piece in enumerate(pieces):
            first, last = k * each, min(many, (k + 1) * each)
            if order is None:
                self._interleaved(parts, first, last, piece, ah, al)
            elif ss == 0:
                self._dc(order[first:last], piece, self.tables.get(tables >> 4), ah, al)
            elif ah == 0:
                self._ac_first(order[first:last], piece, self.tables[16 | tables & 15], ss, se, al)
            else:
                self._ac_refine(order[first:last], piece, self.tables[16 | tables & 15], ss, se, al)
        if order is not None:
            comp["coef"][:rows, :columns] = order.reshape(rows, columns, 64)

    def _interleaved(self, parts, first, last, piece, ah, al) -> None:
        """DC of several components: a block after the other in each unit."""
        tables = [self.tables.get(t >> 4) for _, t in parts]
        if not ah and all(t and t.only and t.only[0] for t in tables) and len({t.only for t in tables}) == 1:
            size, code = tables[0].only
            each = sum(c["h"] * c["v"] for c, _ in parts)
            width, n = size + code, (last - first) * each
            bits = np.unpackbits(np.frombuffer(piece, np.uint8), count=n * width).reshape(n, width)[:, code:]
            v = bits.astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
            v = np.where(bits[:, 0], v, v - (1 << size) + 1).reshape(-1, each)
            (my, mx), at = np.divmod(np.arange(first, last), self.mcus[1]), 0
            for c, _ in parts:
                many = c["h"] * c["v"]
                dc = np.cumsum(v[:, at : at + many]).reshape(-1, many) << al
                for b in range(many):
                    c["coef"][my * c["v"] + b // c["h"], mx * c["h"] + b % c["h"], 0] = dc[:, b]
                at += many
            return
        r, last_dc = _Reader(piece), [0] * len(parts)
        for m in range(first, last):
            my, mx = divmod(m, self.mcus[1])
            for k, (c, _) in enumerate(parts):
                for b in range(c["h"] * c["v"]):
                    block = c["coef"][my * c["v"] + b // c["h"], mx * c["h"] + b % c["h"]]
                    if ah:
                        block[0] |= r.read(1) << al
                    else:
                        last_dc[k] += r.value(r.symbol(tables[k]))
                        block[0] = last_dc[k] << al

    def _dc(self, blocks, piece, table, ah, al) -> None:
        r, dc = _Reader(piece), 0
        for block in blocks:
            if ah:
                block[0] |= r.read(1) << al
            else:
                dc += r.value(r.symbol(table))
                block[0] = dc << al

    def _ac_first(self, blocks, piece, table, ss, se, al) -> None:
        if table.only and 0 < table.only[0] < 16:  # no runs: each coefficient has one code and as many bits
            size, code = table.only
            width, n, band = size + code, len(blocks), se - ss + 1
            if width == 8:
                v = np.frombuffer(piece, np.uint8, n * band).astype(np.int32) & ((1 << size) - 1)
            else:
                v = np.unpackbits(np.frombuffer(piece, np.uint8), count=n * band * width).reshape(-1, width)[:, code:].astype(np.int32) @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
            blocks[:, ZIGZAG[ss : se + 1]] = (np.where(v >> (size - 1), v, v - (1 << size) + 1) * (1 << al)).reshape(n, band)
            return
        r, run = _Reader(piece), 0
        for block in blocks:
            if run:
                run -= 1
                continue
            k = ss
            while k <= se:
                rs = r.symbol(table)
                zeros, size = rs >> 4, rs & 15
                if size:
                    k += zeros
                    block[ZIGZAG[k]] = r.value(size) * (1 << al)
                    k += 1
                elif zeros == 15:
                    k += 16
                else:
                    run = (1 << zeros) + r.read(zeros) - 1
                    break

    def _ac_refine(self, blocks, piece, table, ss, se, al) -> None:
        r, at, bit = _Reader(piece), 0, 1 << al
        band = ZIGZAG[ss : se + 1]
        while at < len(blocks):
            rs = r.symbol(table) if table.ends_only else None
            if rs is not None:  # only ends of band: what follows is one correction bit for each coefficient known so far, of a run of blocks
                run = (1 << (rs >> 4)) + r.read(rs >> 4)
                self._correct(blocks[at : at + run], band, r, bit)
                at += run
                continue
            at = self._refine_block(blocks, at, band, table, r, bit)

    def _correct(self, blocks, band, r, bit) -> None:
        some = blocks[:, band]
        known = some != 0
        n = int(known.sum())
        add = r.bits[r.at : r.at + n].astype(np.int32) * bit
        r.at += n
        if n == some.size:
            some += np.where(some > 0, add.reshape(some.shape), -add.reshape(some.shape))
        else:
            some[known] += np.where(some[known] > 0, add, -add)
        blocks[:, band] = some

    def _refine_block(self, blocks, at, band, table, r, bit) -> int:
        block, k = blocks[at], 0
        while k < len(band):
            rs = r.symbol(table)
            zeros, size = rs >> 4, rs & 15
            if not size and zeros < 15:
                run = (1 << zeros) + r.read(zeros)
                self._correct(blocks[at : at + 1], band[k:], r, bit)
                self._correct(blocks[at + 1 : at + run], band, r, bit)
                return at + run
            new = (bit if r.read(1) else -bit) if size else 0
            while k < len(band):
                i = band[k]
                if block[i]:
                    if r.read(1):
                        block[i] += bit if block[i] > 0 else -bit
                elif zeros:
                    zeros -= 1
                else:
                    if new:
                        block[i] = new
                    k += 1
                    break
                k += 1
        return at + 1


def _basis() -> np.ndarray:
    """The inverse transform of a block as a matrix of whole numbers, 2048 times the real one: sums of whole numbers are exact in any order, so equal blocks give equal samples."""
    u = np.arange(8)
    one = np.cos((2 * u[:, None] + 1) * u[None, :] * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    return np.rint(np.einsum("yv,xu->vuyx", one, one).reshape(64, 64) * 2048)


_INVERSE = _basis()


def samples(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(blocks, 64) -> (blocks, 8, 8) samples from 0 to 255."""
    sums = (coefficients * quant).astype(np.float64) @ _INVERSE
    return np.clip(np.floor((sums + 1024) / 2048) + 128, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def rgb_of(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Full-resolution planes to RGB, in whole numbers."""
    y, cb, cr = (x.astype(np.int32) for x in (y, cb, cr))
    cb, cr = cb - 128, cr - 128
    out = np.stack([(y * 65536 + 91881 * cr + 32768) >> 16, (y * 65536 - 22554 * cb - 46802 * cr + 32768) >> 16, (y * 65536 + 116130 * cb + 32768) >> 16], -1)
    return np.clip(out, 0, 255).astype(np.uint8)


def _grouped(image: Image, c: dict) -> np.ndarray:
    """A component's coefficients group by group: (groups, blocks down, blocks across, 64)."""
    rows, columns = image.mcus
    return c["coef"].reshape(rows, c["v"], columns, c["h"], 64).swapaxes(1, 2).reshape(-1, c["v"], c["h"], 64)


def _kind(image: Image) -> tuple:
    """What images must have in common to be transformed together: sampling factors and quantisation."""
    return tuple((c["h"], c["v"], image.quant[c["q"]].tobytes()) for c in image.components.values())


def tensors_of(images: list[Image]) -> list[np.ndarray]:
    """The (height, width, 3) RGB tensor of each image; one component is grey. Blocks of neighbours of one kind are transformed together; chroma samples are repeated up to full resolution."""
    out: list[np.ndarray] = []
    for _, some in itertools.groupby(images, _kind):
        some = list(some)
        one, planes = some[0], []
        for k, c in enumerate(one.components.values()):
            v, h = c["v"], c["h"]
            coef = np.concatenate([_grouped(i, list(i.components.values())[k]) for i in some])
            plane = samples(coef.reshape(-1, 64), one.quant[c["q"]]).reshape(-1, v, h, 8, 8).swapaxes(2, 3).reshape(-1, v * 8, h * 8)
            planes.append(plane.repeat(one.v // v, 1).repeat(one.h // h, 2))
        groups = rgb_of(*planes) if len(planes) == 3 else np.repeat(planes[0][..., None], 3, -1)
        at = 0
        for i in some:
            rows, columns = i.mcus
            mine = groups[at : at + rows * columns].reshape(rows, columns, 8 * i.v, 8 * i.h, 3).swapaxes(1, 2)
            out.append(mine.reshape(rows * 8 * i.v, columns * 8 * i.h, 3)[: i.height, : i.width])
            at += rows * columns
    return out


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) RGB tensor of a progressive JPEG; one component is grey."""
    return tensors_of([Image(data)])[0]


def payload_of(image: Image) -> bytes:
    """The payload that encode_payloads() has stored."""
    n = struct.unpack(">Q", image.comment)[0]
    out, at = np.empty((image.mcus[0] * image.mcus[1], sum(GROUP), 64), np.uint8), 0
    for comp in image.components.values():
        many, coef = comp["h"] * comp["v"], _grouped(image, comp).reshape(-1, 64)
        out[:, at : at + many, 0] = (np.abs(np.diff(coef[:, 0], prepend=0)) - 256).reshape(-1, many)
        out[:, at : at + many, 1:] = (coef[:, ZIGZAG[1:]] - 256).reshape(-1, many, 63)
        at += many
    return out.tobytes()[:n]


def feature_of(rgb: np.ndarray) -> str:
    """Width, height and the mean red, green and blue of a tensor, in thousandths."""
    height, width, _ = rgb.shape
    return f"{width}x{height}:" + ",".join(str(int(x) * 1000 // (height * width)) for x in rgb.sum((0, 1), dtype=np.int64))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, padded, as a progressive JPEG.

    A null text is empty and becomes one unit of spaces. Repeated rows stay; an empty table gives no rows; other columns of df are not read.
    """
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1).cast(pa.binary())]
            for start, some in _runs(texts):
                media = encode_payloads([pad(t) for t in some])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(some)), pa.array(map(len, some), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return text_of(df, id_col, text_col).mapInArrow(thrifty(run), "doc_id long, n_bytes long, media binary")


def _runs(items: list[bytes], most: int = 1 << 20):
    start = 0
    for some in by_bytes(items, most):
        yield start, some
        start += len(some)


def tensors(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, height, width, rgb) of a column of progressive JPEGs: full-resolution RGB tensors as bytes, row by row. A null or empty image has null values; one that can't be read is an error. Repeated rows stay; an empty table gives no rows; other columns of df are not read."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            media = [x or b"" for x in batch.column(1).to_pylist()]
            for start, some in _runs(media):
                found = iter(tensors_of([Image(m) for m in some if m]))
                got = [next(found) if m else None for m in some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(some)), *[pa.array([None if x is None else x.shape[k] for x in got], pa.int32()) for k in (0, 1)], pa.array([None if x is None else x.tobytes() for x in got], pa.binary())], names=["doc_id", "height", "width", "rgb"]
                )

    return df.select(id_col, media_col).mapInArrow(thrifty(run), "doc_id long, height int, width int, rgb binary")


def read_back(df: DataFrame) -> DataFrame:
    """The digests of op9 from the media that store() has made: rgb_crc32 is that of the full-resolution RGB tensor, feature is computed from it. Rows are those of store(); equal media have equal values."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "rgb_crc32"]

    def run(batches):
        for batch in batches:
            media = [x.as_py() for x in batch.column(2)]
            for start, some in _runs(media):
                images = [Image(m) for m in some]
                payloads, rgb = [payload_of(i) for i in images], tensors_of(images)
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(some)), batch.column(1).slice(start, len(some)), pa.array(map(len, payloads), pa.int64()), sha(payloads), pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()), pa.array(map(len, some), pa.int64()), sha(some), pa.array(map(feature_of, rgb), pa.string()), pa.array([zlib.crc32(np.ascontiguousarray(x)) for x in rgb], pa.int64())], names=names
                )

    return df.mapInArrow(thrifty(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, rgb_crc32 long")


def op9_progressive_jpeg(spark, sf_dir):
    return read_back(store(table(spark, sf_dir, "documents")))
