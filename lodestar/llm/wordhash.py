"""Words of many texts as arrays: where they start and end, and a 64-bit hash of each.

A word's hash is a polynomial in its bytes' random values, modulo 2**64, taken from running sums over all texts at once and finished by a mixing step. A to Z hash like a to z.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_VALUES[65:91] = _VALUES[97:123]
_BASE = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """The base's powers and their inverses, n at least."""
    if len(_powers[0]) < n:
        n = 1 << n.bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def forget() -> None:
    """Drops the tables; they are made again when needed."""
    for k in range(2):
        _powers[k] = np.ones(1, np.uint64)


def separators(chars: str) -> np.ndarray:
    """Which bytes part words, from a character class of single bytes."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


SPACES = separators(" \t\n\r\x0b\x0c")
LETTERS_ONLY = np.array([not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])


def words(texts: list[bytes], parting: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start, end, text's start) of all words of the texts; starts and ends count bytes of all texts put together with a space between."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    inside = ~parting[joined]
    inside[text_at[1:] - 1] = False
    inside[-1:] = False
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, end = edges[::2], edges[1::2]
    powers, inverses = _tables(len(joined) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[joined] * powers[: len(joined)], dtype=np.uint64)])
    h = mix((sums[end] - sums[start]) * inverses[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(text_at, start, "right") - 1, start, end, text_at


def windows(h: np.ndarray, text: np.ndarray, n_texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and their text's number, in order. A text with fewer words has one window, the whole of it; one without words has none."""
    count = np.bincount(text, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if n_texts else np.zeros(0, np.int64)
    rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        rolled += mix(h[k : k + len(rolled)] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & _MASK))
    whole = text[: len(rolled)] == text[n - 1 :] if len(rolled) else np.zeros(0, bool)
    out, owner = mix(rolled[whole]), text[: len(rolled)][whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = []
        for t in short.tolist():
            v = np.uint64(count[t])
            s = np.zeros(1, np.uint64) + v
            for k, x in enumerate(h[first[t] : first[t] + count[t]]):
                s += mix(np.array([x], np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & _MASK))
            extra.append(mix(s)[0])
        out, owner = np.concatenate([out, np.array(extra, np.uint64)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner
