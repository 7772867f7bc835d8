"""A byte-pair vocabulary compiled to a deterministic transducer whose transitions carry token counts.

The input is a normalised text: symbols are bytes, each tagged with the kind of its character (letter, number, other) and, for a number, with whether it starts a character. A state says what piece of text is open (none, a run of letters or of others, a number, an apostrophe that may become a contraction) and how the open run is tokenised so far.

How a run is tokenised so far is a finite thing. Let last(i) be the last token of the encoding of the run's first i bytes and count(i) its length. The encoding of a prefix that ends in token t is the encoding of what stands before t, then t; and t may follow the token p exactly if p and t together are encoded as p, t. So last(i + 1) is the one token t that ends at i + 1 and may follow
last(i + 1 - len(t)), and only those places can matter later from which some token might still start: the places whose rest is the beginning of a token. The state is that rest with last and count (less the count at the end) at each such place. A byte emits the change of the count, which may be negative when tokens grow together; the end of a run emits what the final token, which carries the
end-of-word mark, changes. The sum over a text is its number of tokens.

Transitions are made when first needed, from the vocabulary and the merges alone, and kept in a dense table. A table of more than KEEP states starts anew: a bound on memory that changes no count.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

#: States that a table holds.
KEEP = 1 << 17
END = "</w>"
GAP = 0
SPACE, LETTER, NUMBER, OTHER = 1, 2, 3, 4
#: What follows an apostrophe that opens a piece to make a contraction: fixed by the vocabulary's pattern.
SHORT, LONGER = frozenset(b"stmd"), {ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters stand for themselves, the other bytes, in order, for the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """Token texts and merges. A token is (bytes, ends a word); a run is a sequence of such symbols, the last one marked where it ends a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = byte_letters()

        def token(x: str) -> tuple[bytes, bool]:
            ends = x.endswith(END)
            return bytes(byte[c] for c in (x[: -len(END)] if ends else x)), ends

        self.tokens = {token(x) for x in model["vocab"]}
        self.rank: dict[tuple, int] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((token(a), token(b)), k)
        self.begins = {x[:k] for x, _ in self.tokens for k in range(len(x) + 1)}
        self._follows: dict[tuple, bool] = {}

    def encode(self, symbols: list[tuple[bytes, bool]]) -> list[tuple[bytes, bool]]:
        """Merges the pair of least rank, leftmost first, until none is left."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 30))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            (a, _), (b, ends) = symbols[best : best + 2]
            symbols[best : best + 2] = [(a + b, ends)]
        return symbols

    def follows(self, p: bytes | None, t: bytes, ends: bool) -> bool:
        """May token t come after token p (None: at the start of a run)?"""
        got = self._follows.get((p, t, ends))
        if got is None:
            text = (p or b"") + t
            symbols = [(text[k : k + 1], ends and k == len(text) - 1) for k in range(len(text))]
            got = self.encode(symbols) == ([(p, False)] if p is not None else []) + [(t, ends)]
            self._follows[p, t, ends] = got
        return got

    def step(self, run: tuple, b: bytes) -> tuple[tuple, int]:
        """The run with one more byte, and the change of its count. A run is (rest, ((length, last, count less the count at the end), ...)), from the longest rest to the empty one."""
        rest, places = run[0] + b, run[1]
        size, token, fit = len(rest), None, []
        for k, last, n in places:
            t = rest[size - k - 1 :]
            if t in self.begins:
                fit.append((k + 1, last, n))
                if token is None and (t, False) in self.tokens and self.follows(last, t, False):
                    token, count = t, n + 1
        kept = (*[(k, last, n - count) for k, last, n in fit], (0, token, 0))
        return (rest[size - kept[0][0] :], kept), count

    def close(self, run: tuple) -> int:
        """The change of the count when the run ends here."""
        rest, places = run
        return next(n + 1 for k, last, n in places if k and (t := rest[len(rest) - k :], True) and (t, True) in self.tokens and self.follows(last, t, True))


EMPTY = (b"", ((0, None, 0),))


class Transducer:
    """The table of transitions: target[state, symbol] and emits[state, symbol]."""

    _open: dict[str, Transducer] = {}

    def __init__(self, path: str, keep: int = KEEP):
        from .lexicon import Lexicon

        self.merges, self.keep, self.library = Merges(path), keep, Lexicon.at(path).tokenizer
        self.kind = np.zeros(0x110000, np.uint8)
        self.odd = np.zeros(0x110000, bool)
        self.symbol = np.full(4 * 256 * 2, -1, np.int32)  # by kind, byte and whether it starts a character
        self.meaning: list[tuple[int, int]] = []
        self._symbol(SPACE, 32, True)
        self.width = 128
        self.forget()

    @classmethod
    def at(cls, path: str) -> Transducer:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def forget(self) -> None:
        self.number, self.states = {(SPACE, None): GAP}, [(SPACE, None)]
        self.target = np.full((1024, self.width), -1, np.int32)
        self.emits = np.zeros((1024, self.width), np.int8)

    def _symbol(self, kind: int, byte: int, first: bool) -> int:
        at = ((kind - 1) * 256 + byte) * 2 + (first or kind != NUMBER)
        if self.symbol[at] < 0:
            self.symbol[at] = len(self.meaning)
            self.meaning.append((kind, byte, first))
        return self.symbol[at]

    def learn_characters(self, codes: np.ndarray) -> None:
        """The kinds of characters not met yet, as the library has them."""
        for c in np.unique(codes[self.kind[codes] == 0]).tolist():
            x = chr(c)
            pieces = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(f"a{x}a1")]
            found = SPACE if len(pieces) == 3 and all(len(p) == 1 for p in pieces) and not x.strip() else LETTER if len(pieces) == 2 else None
            if found is None:
                found = OTHER if len(self.library.pre_tokenizer.pre_tokenize_str(f"!{x}")) == 1 else NUMBER
            self.kind[c] = found
            self.odd[c] = unicodedata.category(x) == "Cn"

    def normalised(self, text: str) -> str:
        """The text in NFC and lower case, character by character; where Unicode's tables might differ from the library's, by the library."""
        if not text.isascii():
            codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
            self.learn_characters(codes)
            if self.odd[codes].any() or not unicodedata.is_normalized("NFC", text):
                return self.library.normalizer.normalize_str(text)
            text = text.replace("Σ", "σ")  # a final sigma is no special case
        return text.lower()

    def symbols(self, text: bytes) -> np.ndarray:
        """The symbols of a normalised text in UTF-8."""
        codes = np.frombuffer(text.decode().encode("utf-32-le"), "<u4")
        self.learn_characters(codes)
        data = np.frombuffer(text, np.uint8)
        first = (data & 0xC0) != 0x80
        kind = self.kind[codes][np.cumsum(first) - 1].astype(np.int32)
        at = ((kind - 1) * 256 + np.where(kind == SPACE, 32, data)) * 2 + (first | (kind != NUMBER))
        out = self.symbol[at]
        if len(out) and out.min() < 0:
            for x in np.unique(at[out < 0]).tolist():
                self._symbol(x // 512 + 1, x // 2 % 256, bool(x % 2))
            out = self.symbol[at]
        # the later bytes of a space's character say nothing more than its first
        return out

    def _closing(self, state: tuple) -> int:
        kind, run = state
        if isinstance(kind, tuple):  # the letter after the apostrophe is a piece of its own
            letter, n = self.merges.step(EMPTY, bytes([kind[1]]))
            return self.merges.close(run) + n + self.merges.close(letter)
        return 0 if kind == SPACE else self.merges.close(run)

    def _opened(self, kind: int, b: bytes) -> tuple[tuple, int]:
        run, n = self.merges.step(EMPTY, b)
        return (("apostrophe" if kind == OTHER and b == b"'" else kind), run), n

    def _next(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        kind, run = state
        new, byte, first = self.meaning[symbol]
        b = bytes([byte])
        if new == SPACE:
            return (SPACE, None), self._closing(state)
        if kind == "apostrophe" and new == LETTER:
            if byte in SHORT:  # a contraction is a piece of its own
                run, n = self.merges.step(run, b)
                return (SPACE, None), n + self.merges.close(run)
            if byte in LONGER:
                return (("contraction", byte), run), 0
        if isinstance(kind, tuple):  # an apostrophe and the first of two letters
            begun = bytes([kind[1]])
            if new == LETTER and byte == LONGER[kind[1]]:
                run, n = self.merges.step(run, begun)
                run, m = self.merges.step(run, b)
                return (SPACE, None), n + m + self.merges.close(run)
            left = self.merges.close(run)
            state, n = self._opened(LETTER, begun)
            after, m = self._next(state, symbol)
            return after, left + n + m
        same = new == kind or (kind == "apostrophe" and new == OTHER)
        if same and (new != NUMBER or not first):
            run, n = self.merges.step(run, b)
            return (new, run), n
        left = self._closing(state)
        state, n = self._opened(new, b)
        return state, left + n

    def compile(self, state: int, symbol: int) -> None:
        after, n = self._next(self.states[state], symbol)
        to = self.number.get(after)
        if to is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
            if to >= len(self.target):
                self.target = np.concatenate([self.target, np.full_like(self.target, -1)])
                self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)])
        self.target[state, symbol] = to
        self.emits[state, symbol] = n

    def widen(self) -> None:
        while len(self.meaning) > self.width:
            self.target = np.concatenate([self.target, np.full_like(self.target, -1)], 1)
            self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)], 1)
            self.width *= 2

    def run(self, states: np.ndarray, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs lanes side by side, lane k from states[k] over size[k] symbols from start[k] on; the longest lanes come first. Gives the states at the end and what each lane emitted."""
        self.widen()
        state, out = np.array(states, np.int64), np.zeros(len(states), np.int64)
        left = np.cumsum(np.bincount(size)[::-1])[::-1].tolist() if len(size) else []  # lanes of a size or more
        for j, m in enumerate(left[1:]):
            at = state[:m] * self.width + symbols[start[:m] + j]
            to = self.target.ravel()[at]
            if to.min() < 0:
                for x in np.unique(at[to < 0]).tolist():
                    self.compile(x // self.width, x % self.width)
                to = self.target.ravel()[at]
            out[:m] += self.emits.ravel()[at]
            state[:m] = to
        return state, out

    def walk(self, state: int, symbols: np.ndarray) -> tuple[int, int]:
        """One lane, without the cost of a vector for each symbol."""
        self.widen()
        out = 0
        for x in symbols.tolist():
            to = self.target.item(state, x)
            if to < 0:
                self.compile(state, x)
                to = self.target.item(state, x)
            out += self.emits.item(state, x)
            state = to
        return state, out
