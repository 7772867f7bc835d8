"""BPE encoding and decoding by tree concatenation.

A text is halved until its parts are short (LEAF). Every part is encoded on its own, wherever the cuts fell: the parts of all texts of a batch together. Going up the tree, two neighbours are joined: a window around the join is encoded, and grows on both sides until it agrees with the left part at one place and with the right part at another; then the tokens are the left part's up to the one place,
the window's up to the other, and the right part's from there on.

Encodings are kept as units: a unit has a start, an end and ids. A word that stands whole between white space in its part is one unit; a word that a cut or a window's edge parts, and a word longer than LONG, has its tokens for units (tokens that share a character are one). Two encodings agree at a unit if both have it, with the same start, end and ids, and if what stands there
can't be composed with a neighbour by Unicode normalisation. From such a unit both go on from the same state: the pattern that cuts text into pieces looks ahead only, and a byte-pair encoding is right as a whole if each pair of neighbouring tokens is one that an encoder has put side by side. If nothing agrees, the window grows to the whole of both parts, which is the plain encoding.
The smallest window holds a special string whole if the cut parts one, so those need no rule of their own.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, by_bytes, table, text_of, thrifty
from .lexicon import Lexicon, vocabulary_path

#: Bytes of a part that is not halved further.
LEAF = 2048
#: Bytes on each side of a join in the first window: more than a special string has.
WINDOW = 24
#: A longer word is not kept whole, and has its tokens for units.
LONG = 256
SCHEMA = "doc_id long, n_tokens long, ids binary, decoded binary"
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


class Part:
    """The encoding of text[a:b] in units, in order."""

    __slots__ = ("start", "end", "ids")

    def __init__(self, start: np.ndarray, end: np.ndarray, ids: list[bytes]):
        self.start, self.end, self.ids = start, end, ids


def _cuts(text: bytes, a: int, b: int, leaf: int) -> list[int]:
    """Where text[a:b] is cut, halving until parts have at most `leaf` bytes or can't be cut, never inside a character; in order, without a and b."""
    if b - a <= leaf:
        return []
    mid = _middle(text, a, b)
    return [] if mid == b else [*_cuts(text, a, mid, leaf), mid, *_cuts(text, mid, b, leaf)]


def _middle(text: bytes, a: int, b: int) -> int:
    mid = (a + b) // 2
    while mid < b and text[mid] & 0xC0 == 0x80:
        mid += 1
    return mid if mid > a else b


def _alone(text: bytes, at: int) -> bool:
    """The character at this place is not composed with what stands before it."""
    if at >= len(text) or text[at] < 0x80:
        return True
    x = text[at : at + 4].decode(errors="ignore")[0]
    return unicodedata.category(x)[0] != "M" and not "ᅠ" <= x <= "ᇿ"


class Encoder:
    """Encodes parts; `joins` and `grown` count the joins taken and the windows that had to grow."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.joins, self.grown = lexicon, 0, 0

    def tokens(self, word: bytes, at: int) -> tuple[list[int], list[int], list[bytes]]:
        """A word's tokens as units, tokens that share a character as one."""
        x = word.decode()
        e = self.lexicon.tokenizer.encode(x, add_special_tokens=False)
        byte = list(range(len(x) + 1)) if len(x) == len(word) else np.concatenate([[0], np.cumsum([len(c.encode()) for c in x])]).tolist()
        start, end, ids = [], [], []
        for i, (a, b) in zip(e.ids, e.offsets):
            piece = i.to_bytes(4, "little")
            if end and (at + byte[a] < end[-1] or a == b):
                ids[-1] += piece
                end[-1] = max(end[-1], at + byte[b])
            else:
                start.append(at + byte[a])
                end.append(at + byte[b])
                ids.append(piece)
        return start, end, ids

    def part(self, text: bytes, a: int, b: int, looked_up: tuple[list[bytes], list[bytes | None]] | None = None) -> Part:
        """text[a:b] encoded on its own. looked_up: its words and what the lexicon had of them, the rest having been learned since."""
        data = text[a:b]
        space = _IS_SPACE[np.frombuffer(data, np.uint8)]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True)) + a
        start, end = edge[::2], edge[1::2]
        words, ids = looked_up or self.look_up([data])[0]
        if None in ids:
            ids = [self.lexicon.words.get(w) if i is None else i for w, i in zip(words, ids)]
        apart = {k for k, i in enumerate(ids) if i is None} if None in ids else set()
        if words and a and not space[0] and not _IS_SPACE[text[a - 1]]:
            apart.add(0)
        if words and b < len(text) and not space[-1] and not _IS_SPACE[text[b]]:
            apart.add(len(words) - 1)
        if not apart:
            return Part(start, end, ids)
        starts, ends, out, done = [], [], [], 0
        for k in sorted(apart):
            s, e, i = self.tokens(words[k], int(start[k]))
            starts += [start[done:k], np.array(s, np.int64)]
            ends += [end[done:k], np.array(e, np.int64)]
            out += ids[done:k] + i
            done = k + 1
        return Part(np.concatenate([*starts, start[done:]]), np.concatenate([*ends, end[done:]]), out + ids[done:])

    def look_up(self, parts: list[bytes]) -> list[tuple[list[bytes], list[bytes | None]]]:
        """Each part's words and their ids, None for new ones; those are learned, all at once, but for long ones."""
        out, new, get = [], set(), self.lexicon.words.get
        for p in parts:
            words = p.split()
            ids = list(map(get, words))
            if None in ids:
                new.update([w for w, i in zip(words, ids) if i is None and len(w) <= LONG])
            out.append((words, ids))
        self.lexicon.learn(new)
        return out

    def joined(self, text: bytes, a: int, mid: int, b: int, left: Part, right: Part) -> Part:
        """text[a:b] from its two halves."""
        self.joins += 1
        w = WINDOW
        while True:
            i, j = int(np.searchsorted(left.start, mid - w, "right")) - 1, int(np.searchsorted(right.end, mid + w))
            whole_left, whole_right = i < 0, j >= len(right.ids)
            lo, hi = a if whole_left else int(left.start[i]), b if whole_right else int(right.end[j])
            window = self.part(text, lo, hi)
            found = {(s, e): k for k, (s, e) in enumerate(zip(window.start.tolist(), window.end.tolist()))}

            def agrees(side: Part, at: int) -> int | None:
                s, e = int(side.start[at]), int(side.end[at])
                k = found.get((s, e))
                return k if k is not None and window.ids[k] == side.ids[at] and _alone(text, s) and _alone(text, e) else None

            first, last = (0 if whole_left else None), (len(window.ids) if whole_right else None)
            i, j = (0 if whole_left else i), (len(right.ids) if whole_right else j)
            while first is None and i < len(left.ids) and left.end[i] < mid:
                first = agrees(left, i)
                i += first is None
            while last is None and j >= 0 and right.start[j] > mid:
                last = agrees(right, j)
                j -= last is None
            if first is not None and last is not None and first <= last:
                of = lambda x, y, z: np.concatenate([x[:i], y[first:last], z[j:]])
                return Part(of(left.start, window.start, right.start), of(left.end, window.end, right.end), left.ids[:i] + window.ids[first:last] + right.ids[j:])
            self.grown += 1
            w *= 2

    def encode(self, texts: list[bytes], leaf: int = LEAF) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers of each text."""
        bounds = [[0, *_cuts(x, 0, len(x), leaf), len(x)] for x in texts]
        looked_up = iter(self.look_up([x[a:b] for x, at in zip(texts, bounds) for a, b in zip(at, at[1:])]))
        out = []
        for x, at in zip(texts, bounds):
            leaves = {a: next(looked_up) for a in at[:-1]}

            def tree(a: int, b: int) -> Part:
                if a in leaves and b - a <= leaf or (mid := _middle(x, a, b)) == b:
                    return self.part(x, a, b, leaves[a])
                return self.joined(x, a, mid, b, tree(a, mid), tree(mid, b))

            out.append(b"".join(tree(0, len(x)).ids))
        return out


def encode_texts(texts: list[bytes], path: str, leaf: int = LEAF) -> list[bytes]:
    """Ids as little-endian unsigned 32-bit integers of each text."""
    return Encoder(Lexicon.at(path)).encode(texts, leaf)


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, digests: bool = False, with_decoded: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): token ids as bytes and their decoded text, or with digests=True their SHA-256 in hex instead; without with_decoded, decoded is null.

    A null text is empty: no tokens, decoded to an empty text. Repeated rows stay; an empty table gives no rows; other columns of df are not read. Texts of any length are taken whole. The vocabulary file must be at `path` on every executor.
    """
    bounded_batches(df.sparkSession)
    path = path or vocabulary_path()
    kind = pa.string() if digests else pa.binary()

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), [x.as_py() for x in batch.column(1).cast(pa.binary())]
            got = [x for some in by_bytes(texts) for x in encode_texts(some, path)]
            decode = Lexicon.at(path).decode
            value = (lambda b: hashlib.sha256(b).hexdigest()) if digests else bytes
            decoded = [value(decode(x)) if with_decoded else None for x in got]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) // 4 for x in got], pa.int64()), pa.array(map(value, got), kind), pa.array(decoded, kind)], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "n_tokens", "ids", "decoded"]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else SCHEMA
    return text_of(df, id_col, text_col).mapInArrow(thrifty(run, keep_words=True), schema)


def op5_bpe(spark, sf_dir):
    return encode_decode(table(spark, sf_dir, "documents"), digests=True)


__all__ = ["Encoder", "encode_decode", "encode_texts", "op5_bpe"]
