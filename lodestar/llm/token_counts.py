"""Token counts by a compiled finite-state transducer (see transducer.py).

Texts are cut into chunks of CHUNK symbols, wherever that falls. A chunk's state map says for every state at its start in which state it ends and what it emits. From any state, white space leads to GAP; so after its first white space a map is constant, (inner, tail), and only the symbols before, its head, hang on the start. All chunks of a batch run side by side from GAP, each over what follows its head;
then all heads run side by side, each from the tail before it. A chunk without white space is all head: its tail is known once the one before it is. The counts of the chunks then compose by a prefix scan over the whole batch, and a text's count is the difference of the scan at its ends.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, by_bytes, table, text_of, thrifty
from .lexicon import vocabulary_path
from .transducer import GAP, Transducer

CHUNK = 512
LIMIT = 2048
#: Lanes below which one lane after the other is faster than a vector for each symbol.
FEW = 12
#: The vocabulary's special strings: fixed values. Each is one token, and what stands on its two sides is tokenised apart.
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
#: Bytes of texts that run side by side.
SIDE_BY_SIDE = 4 << 20


def _lanes(t: Transducer, states: np.ndarray, symbols: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States at the end and emitted counts of the lanes, run side by side."""
    end, out = np.array(states, np.int64), np.zeros(len(start), np.int64)
    if len(start) < FEW:
        for k in range(len(start)):
            end[k], out[k] = t.walk(int(end[k]), symbols[start[k] : start[k] + size[k]])
    else:
        order = np.argsort(-size, kind="stable")
        end[order], out[order] = t.run(end[order], symbols, start[order], size[order])
    return end, out


def count_symbols(t: Transducer, texts: list[np.ndarray], chunk: int = CHUNK) -> np.ndarray:
    """The number of tokens of each text, given as symbols."""
    length = np.array([len(x) for x in texts], np.int64)
    symbols = np.concatenate([*texts, np.zeros(1, np.int32)])  # the last one ends a text
    chunks = -(-length // chunk)
    owner = np.repeat(np.arange(len(texts)), chunks)
    if not len(owner):
        return np.zeros(len(texts), np.int64)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = (np.cumsum(length) - length)[owner] + place * chunk
    size = np.minimum(chunk, length[owner] - place * chunk)
    opens = place == 0  # a text's first chunk starts in GAP and has no head
    spaces = np.append(np.flatnonzero(symbols == 0), len(symbols))
    head = np.where(opens, 0, np.minimum(spaces[np.searchsorted(spaces, start)] - start, size))
    all_head = ~opens & (head == size)
    tail, inner = _lanes(t, np.full(len(owner), GAP), symbols, start + head, size - head)
    # heads, each with the white space after it, from the tail before it; those after a chunk that is all head wait for that one's tail
    emitted = np.zeros(len(owner), np.int64)
    ready = np.flatnonzero(~opens & ~np.concatenate([[False], all_head[:-1]]))
    while len(ready):
        ends, emitted[ready] = _lanes(t, tail[ready - 1], symbols, start[ready], head[ready] + ~all_head[ready])
        whole = all_head[ready]
        tail[ready[whole]] = ends[whole]
        ready = ready[whole] + 1
        ready = ready[ready < len(owner)]
        ready = ready[~opens[ready]]
    last = np.flatnonzero(np.concatenate([opens[1:], [True]]))
    closing = np.zeros(len(owner), np.int64)
    closing[last] = _lanes(t, tail[last], symbols, np.full(len(last), len(symbols) - 1), np.ones(len(last), np.int64))[1]
    scan = np.concatenate([[0], np.cumsum(inner + emitted + closing)])
    upto = np.cumsum(chunks)
    return scan[upto] - scan[upto - chunks]


def count_texts(texts: list[bytes], path: str, chunk: int = CHUNK) -> list[int]:
    """The number of tokens of each text."""
    t = Transducer.at(path)
    if len(t.states) > t.keep:
        t.forget()
    parts, owner, out = [], [], np.zeros(len(texts), np.int64)
    for k, x in enumerate(texts):
        pieces = SPECIAL.split(x.decode())
        out[k] = len(pieces) - 1
        parts += [t.symbols(t.normalised(p).encode()) for p in pieces]
        owner += [k] * len(pieces)
    np.add.at(out, np.array(owner, np.int64), count_symbols(t, parts, chunk))
    return out.tolist()


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row.

    A null text is empty: 0 bytes, 0 tokens. Repeated rows stay; an empty table gives no rows; other columns of df are not read. Strings of special tokens inside a text count as the library counts them by default. The vocabulary file must be at `path` on every executor.
    """
    bounded_batches(df.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1).cast(pa.binary())]
            n = [x for some in by_bytes(texts, SIDE_BY_SIDE) for x in count_texts(some, path)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return text_of(df, id_col, text_col).mapInArrow(thrifty(run, keep_words=True), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
