"""Personal data, and information-theoretic sanitisation of the terms that give it away.

Entities (e-mail addresses, IP addresses, card and phone numbers) are found by pattern and check. They are what has to be protected. A term (a word of letters) in a text with an entity may reveal it: if c of the df rows that have the term have entity e too, then it tells PMI(t; e) = log2(p(e|t) / p(e)) bits of the IC(e) = -log2 p(e) bits that name e.
p(e|t) is estimated as (c + SMOOTH p(e)) / (df + SMOOTH), so a term seen seldom tells less than its bare counts say. The share PMI / IC is the term's disclosure, the largest over all entities that it stands with. From GENERALISE on a term is generalised to the kind of word above it, from REMOVE on it is removed. All counts are over all rows, and all terms of a text count, at any distance from the entity.

Three scans: entities and the terms of texts that have one; document frequencies of those terms; occurrences of the revealing terms. Entities of one text only have the same counts with each of its terms, so they are one entity there; pairs are counted for the others. Terms are 64-bit hashes. A bitmap of fixed size tells the later scans which words can matter; an exact join follows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_bytes, numbered, table, thrifty, written
from .wordhash import LETTERS_ONLY, words

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the contract. A number can't start an address inside a run of digits whose start doesn't, so such starts are not tried.
PATTERNS = {
    "email": re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The shortest term in bytes.
SHORTEST = 4
#: Rows that the prior counts for; shares of an entity's bits from which on a term is generalised, removed.
SMOOTH, GENERALISE, REMOVE = 1.0, 0.8, 0.9
#: Bits of the bitmaps, a power of two.
BITMAP = 1 << 23
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Matches of the local part `[A-Za-z0-9._%+-]+` with a host after it, leftmost and not overlapping. Goes from one @ to the next and back over the local part, so long words cost no more than short ones."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := PATTERNS["email"].match(text, at)):
            done = m.end()
            out.append(("email", start, done))
        at = text.find("@", at + 1)
    return out


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start, in code points; end exclusive."""
    out = []
    if "@" in text:
        out += _emails(text)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in PATTERNS["ip"].finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in PATTERNS["card"].finditer(text):
        if 16 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PATTERNS["phone"].finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _terms(texts: list[bytes]):
    """Hashes (signed), text numbers, starts and ends of the terms, and the texts' starts."""
    h, owner, start, end, text_at = words(texts, LETTERS_ONLY)
    long = end - start >= SHORTEST
    return h[long].view(np.int64), owner[long], start[long], end[long], text_at


def _together(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Distinct entities and terms of a text; an occurrence that is part of an entity is no term."""
    data = text.encode()
    h, _, start, end, _ = _terms([data])
    at = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
    first, last = at[start] - 1 if len(start) else start, at[end - 1] if len(end) else end
    free = np.ones(len(h), bool)
    for _, a, b in spans:
        free[np.searchsorted(last, a, "right") : np.searchsorted(first, b)] = False
    e = {_hash(f"{kind}:{re.sub(r'[^a-z0-9@.+]', '', text[a:b].lower())}".encode()) for kind, a, b in spans}
    return sorted(e), np.unique(h[free]).tolist()


_FOUND = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base string, es array<long>, ts array<long>"


def _find(df: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py()
                spans = entities(text)
                n = [sum(k == s[0] for s in spans) for k in KINDS]
                rows.append((_hash(text.encode()), *n, ",".join(f"{k}:{a}:{b}" for k, a, b in spans), *(_together(text, spans) if spans else ([], []))))
            kinds = [pa.int64()] * 5 + [pa.string(), *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base", "es", "ts"])

    return df.mapInArrow(thrifty(run), _FOUND)


def _bitmap(terms: DataFrame) -> np.ndarray:
    """BITMAP bits with those of the terms (t) set; it has the same size for any number of terms."""
    bit = F.col("t").bitwiseAND(F.lit(BITMAP - 1))
    rows = terms.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(t & 63 as int))").alias("b"))
    out = np.zeros(BITMAP // 64, np.int64)
    for r in rows.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # at most BITMAP / 64 rows
        out[r.w] = r.b
    return out.view(np.uint64)


def _may(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & (BITMAP - 1)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _frequencies(df: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(t, n): rows whose text has the term, counted in each task first."""

    def run(batches):
        seen, many, held = [], [], 0

        def merged():
            t, where = np.unique(np.concatenate(seen or [np.zeros(0, np.int64)]), return_inverse=True)
            return t, np.bincount(where, weights=np.concatenate(many or [np.zeros(0)]), minlength=len(t))

        def out(t, n):
            for a in range(0, len(t), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(t[a : a + (1 << 16)], pa.int64()), pa.array(n[a : a + (1 << 16)].astype(np.int64), pa.int64())], names=["t", "n"])

        for batch in batches:
            texts = [x.as_py() for x in batch.column(1).cast(pa.binary())]
            for some in by_bytes(texts):
                h, owner, *_ = _terms(some)
                ok = _may(bitmap, h)
                h, owner = h[ok], owner[ok]
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
                t, n = np.unique(h[new], return_counts=True)
                seen.append(t)
                many.append(n.astype(float))
                held += len(t)
            if held > 1 << 21:
                t, n = merged()
                seen, many, held = [t], [n], len(t)
            if held > 1 << 20 and len(seen) == 1:  # too many different terms to keep: their counts so far go out
                yield from out(*merged())
                seen, many, held = [], [], 0
        yield from out(*merged())

    return df.mapInArrow(thrifty(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("df"))


def _occurrences(df: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(doc_id, text_key, t, start, end) of the words that the bitmap lets pass, in code points."""

    def run(batches):
        for batch in batches:
            ids, texts, rows, at = batch.column(0).to_pylist(), [x.as_py() for x in batch.column(1).cast(pa.binary())], [], 0
            for some in by_bytes(texts):
                h, owner, start, end, text_at = _terms(some)
                ok = np.flatnonzero(_may(bitmap, h))
                for o in np.unique(owner[ok]).tolist():
                    mine, base = ok[owner[ok] == o], int(text_at[o])
                    points = np.cumsum((np.frombuffer(some[o], np.uint8) & 0xC0) != 0x80)
                    key = _hash(some[o])
                    rows += [(ids[at + o], key, int(h[k]), int(points[start[k] - base]) - 1, int(points[end[k] - 1 - base])) for k in mine]
                at += len(some)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "text_key", "t", "start", "end"])

    return df.mapInArrow(thrifty(run), "doc_id long, text_key long, t long, start long, end long")


def _pair_counts(found: DataFrame) -> DataFrame:
    """(t, c, n_e): each term with the different counts of its entities, c the rows that have both, n_e the entity's rows."""
    rows = found.where("size(es) > 0").select("text_key", "es", "ts")
    of = rows.select("text_key", F.explode("es").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n_e"), F.min("text_key").alias("text_key"), F.max("text_key").alias("last"))
    of = written(of, "entity-rows")
    # all rows of an entity that one text has are rows of each of its terms
    alone = of.where("text_key = last").select("text_key", "n_e").distinct()
    one = rows.select("text_key", "ts").dropDuplicates(["text_key"]).join(alone, "text_key").select(F.explode("ts").alias("t"), F.col("n_e").alias("c"), "n_e")
    more = rows.select(F.explode("es").alias("e"), "ts").join(of.where("text_key <> last").select("e", "n_e"), "e").select("e", "n_e", F.explode("ts").alias("t"))
    more = more.groupBy("e", "t").agg(F.count(F.lit(1)).alias("c"), F.first("n_e").alias("n_e")).select("t", "c", "n_e")
    return one.unionByName(more).distinct()


def revealing_terms(found: DataFrame, docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, smooth: float = SMOOTH) -> DataFrame:
    """(t, disclosure, action) of the terms to generalise or remove."""
    pairs = written(_pair_counts(found), "pairs")
    n = float(found.count())
    frequency = _frequencies(docs, _bitmap(pairs.select("t").distinct()))
    p = F.col("n_e") / F.lit(max(n, 1.0))
    bits = -F.log2(p)
    share = F.when(bits > 0, 1 + F.log2((F.col("c") + smooth * p) / (F.col("df") + smooth)) / bits).otherwise(F.lit(0.0))
    told = pairs.join(frequency, "t").withColumn("disclosure", share).groupBy("t").agg(F.max("disclosure").alias("disclosure"))
    return told.where(F.col("disclosure") >= generalise).withColumn("action", F.when(F.col("disclosure") >= remove, F.lit("remove")).otherwise(F.lit("generalise")))


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_email, n_ip, n_card, n_phone, base, terms) of each row: base is the entities as kind:start:end, terms the revealing terms' (start, end, action).

    A null text is empty and has no spans. Repeated rows stay, each has its spans and each counts. An empty table gives no rows; other columns of df are not read. Texts of any length are taken whole.
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = written(_find(docs), "entities")
    terms = written(revealing_terms(found, docs), "terms")
    hits = _occurrences(docs, _bitmap(terms)).join(terms.select("t", "action"), "t").select("doc_id", "text_key", F.struct("start", "end", "action").alias("x")).distinct()
    hits = hits.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.array_sort(F.collect_list("x")).alias("terms"))
    out = found.drop("es", "ts").join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").drop("d", "k")
    return out.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:long,end:long,action:string>>")))


def parent_of(term: str) -> str:
    """What a generalised term becomes: the kind of word above it, told by its letters. A word, a name or an acronym of a script; so what it says of its sentence's form stays, and which word it was does not."""
    script = "" if term.isascii() else unicodedata.name(next(c for c in term if not c.isascii()), "").split(" ")[0] + " "
    kind = "ACRONYM" if term.isupper() and len(term) > 1 else "NAME" if term[0].isupper() else "WORD"
    return f"[{'' if script == 'LATIN ' else script}{kind}]"


def clean_text(text: str, terms: str | None = None) -> str:
    """Entities become a label of their kind, generalised terms the kind of word that they are (parent_of), removed terms nothing; overlapping spans become one, the first one's. terms: start:end:action, comma-joined."""
    cuts = [(a, b, f"[{k.upper()}]") for k, a, b in entities(text)]
    cuts += [(int(a), int(b), parent_of(text[int(a) : int(b)]) if action == "generalise" else "") for a, b, action in (x.split(":") for x in (terms or "").split(",") if x)]
    out, at = [], 0
    for a, b, label in sorted(cuts):
        if a >= at:
            out += [text[at:a], label]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with its texts sanitised; same rows, same columns. A null text stays null; equal rows are edited alike; an empty table gives no rows. df's columns may have any names. Entities are found again where they are replaced, so only rows with revealing terms are joined by key."""
    joined = F.array_join(F.transform("terms", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["action"])), ",")
    spans = written(find_spans(df, id_col, text_col).where("size(terms) > 0").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), joined.alias("_terms")).distinct(), "spans")
    key = F.udf(lambda t: None if t is None else _hash(t.encode()), "long", useArrow=True)
    edit = F.udf(lambda t, x: None if t is None else clean_text(t, x), "string", useArrow=True)
    plain, at = numbered(df)
    text = at[text_col]
    out = plain.withColumn("_key", key(F.col(text))).join(spans, F.col(at[id_col]).eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    return out.withColumn(text, edit(text, "_terms")).select(*plain.columns).toDF(*df.columns)


def op7_pii(spark, sf_dir):
    out = find_spans(table(spark, sf_dir, "documents"))
    terms = F.array_join(F.transform("terms", lambda x: F.concat(F.lit("term:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
    base = F.when(F.col("base") != "", F.col("base"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), F.concat_ws(",", base, F.when(F.size("terms") > 0, terms)).alias("spans"))
