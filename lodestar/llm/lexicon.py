"""The vocabulary's library, and a cache of what it says of single words, kept by each Python worker.

The vocabulary's tokenizer drops white space and never joins what white space parts, so the tokens of a word that stands whole between white space hang on that word alone. Words here end at ASCII white space only, which every step of the tokenizer takes for white space too.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker keeps; then it starts anew (a bound on memory, results stay the same).
KEEP = 600_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Lexicon:
    """word -> ids as little-endian unsigned 32-bit integers."""

    _open: dict[str, Lexicon] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pieces = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size())]
        self.words: dict[bytes, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Lexicon:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: the vocabulary has no decoder of its own, so tokens stand between spaces."""
        return b" ".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def learn(self, words: Iterable[bytes]) -> None:
        """Looks up the words that are not known yet, all at once."""
        new = [w for w in set(words) if w not in self.words]
        if len(self.words) + len(new) > KEEP:
            self.words.clear()
        if new:
            for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)):
                self.words[w] = np.array(e.ids, "<u4").tobytes()
