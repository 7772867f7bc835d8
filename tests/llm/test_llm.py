"""The training-data operators against brute force, round trips and the tokenizers library, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, jaccard, jpeg, licenses, mixing, pii, quality, sharding, token_counts, warc
from lodestar.llm.components import components
from lodestar.llm.lexicon import Lexicon, vocabulary_path
from lodestar.llm.signature_tree import SignatureTree
from lodestar.llm.transducer import Transducer

LOREM = " ".join(f"word{i * 7 % 53} and{i % 11}" for i in range(80))
TEXTS = [
    (1, LOREM, "a"), (2, LOREM + " tail", "a"), (3, LOREM, "b"), (3, LOREM, "b"), (4, None, None), (5, "", "c"), (6, " \n\t ", "c"), (7, "All Rights Reserved. CC-BY, GNU General Public License", "c"),
    (8, "write to jo.do@mail.example.com or +1 (988) 555-2485, 10.0.0.1 and 4111 1111 1111 1111", "a"), (9, "x" * 5000 + " é日本 " + "lang " * 300, "b"), (10, "line\nline\nline\na b c d e f a b c d e f", "z"), (11, "<|endoftext|> 's İ é", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "x", 1) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, bucket int")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for f in (licenses.scan, sharding.shard_rows, jaccard.linked_groups, bpe.encode_decode, pii.find_spans, quality.statistics, token_counts.token_counts, lambda d: jpeg.read_back(jpeg.store(d)), lambda d: mixing.per_document(s := mixing.document_sizes(d), *mixing.mix(s))):
        assert f(none).count() == 0
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    r = got[7]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (9, 3, 0, 6, "cc-by,gpl,reserved")
    assert 0 < r.score <= 1 and got[4].n_words == 0 and got[4].labels == "" and got[5].score == 0
    for text, label in (("SPDX-License-Identifier: MIT", "mit"), ("Licensed under the Apache License, Version 2.0", "apache-2.0"), ("under CC BY-NC 4.0.", "cc-by-nc-4.0"), ("GNU General Public License, version 3", "gpl-3.0")):
        assert label in licenses.scan_text(text.encode())["labels"].split(",")
    assert len(licenses.rules()) > 200


def _variants(parsed):
    """Texts that a rule's pattern matches: all alternatives, optional parts with and without."""
    out = [""]
    for op, x in parsed:
        op = str(op)
        if op == "LITERAL":
            some = [chr(x)]
        elif op in ("ANY", "NOT_LITERAL"):
            some = ["q"]
        elif op == "IN":
            some = [chr(v if str(o) == "LITERAL" else v[0]) for o, v in x if str(o) in ("LITERAL", "RANGE")]
        elif op == "SUBPATTERN":
            some = _variants(x[3])
        elif op == "BRANCH":
            some = [v for b in x[1] for v in _variants(b)]
        elif op.endswith("REPEAT"):
            some = [""] * (x[0] == 0) + [v * max(x[0], 1) for v in _variants(x[2])]
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
            some = [""]
        out = [a + b for a in out for b in some]
    return out


def test_license_prefilter_loses_nothing():
    """Each text that a rule matches holds one of its keywords; on one text per rule all rules without the prefilter find the same."""
    from re import _parser

    for rule in licenses.rules():
        texts = _variants(_parser.parse(rule.pattern.pattern))
        assert all(rule.pattern.search(x) and any(k in x for k in rule.keywords) for x in texts), rule
        text = min(texts, key=len)
        plain = {(r.number, text.count(" ", 0, m.start())) for r in licenses.rules() for m in r.pattern.finditer(text)}
        assert {(d.rule, d.first) for d in licenses.detect(text.encode("latin-1"))[1]} == plain
    assert licenses.scan_text(b"Dedicated to the public under CC0 1.0 Universal")["labels"] == licenses.scan_text(b"Data: CC0")["labels"] == "cc0-1.0"


def test_license_suppression():
    kept = [s["label"] for s in licenses.scan_text(b"spdx license identifier apache 2.0")["spans"]]
    assert kept == ["apache-2.0"]


def test_license_resolve_by_brute_force():
    """Containment among kept detections, against comparing each with all; and every place of a long text's repeated phrase."""
    rng = np.random.default_rng(9)
    for _ in range(200):
        found = []
        for k in range(int(rng.integers(1, 40))):
            first = int(rng.integers(0, 30))
            found.append(licenses.Detection(f"l{k % 5}", first, first + int(rng.integers(0, 12)), int(rng.integers(0, 4)) * 10, 0.5, k))
        kept = []
        for d in sorted(found, key=lambda d: (-d.priority, d.first - d.last, d.first, d.rule)):
            if all(d.first < k.first or d.last > k.last for k in kept):
                kept.append(d)
        assert licenses.resolve(found) == kept
    got = licenses.scan_text(b"cc by foo " * 20_000)
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"]) == (60_000, 20_000, 0, 59_997)


def test_sharding(docs):
    got = sharding.shard_rows(docs).collect()
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in TEXTS)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def _draw(seed, level, name, key, weight):
    """The draw of a child, by another implementation of the 64-bit hash that the DataFrame function names."""
    import struct

    import xxhash

    h = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
    for data in (level.encode(), struct.pack("<i", name), struct.pack("<q", key)):
        h = xxhash.xxh64(data, seed=h).intdigest()
    return -np.log(((h >> 11) + 0.5) / (1 << 53)) / weight


def test_sharding_descends(spark):
    """Region, then rack, then shard, each among siblings only, against a descent in Python; the counts follow the weights."""
    shards = [sharding.Shard(i, i // 4, i // 2, w) for i, w in enumerate((1.0, 2.0, 1.0, 4.0, 1.0, 1.0, 0.0, 6.0))]
    got = {r.id: r.s for r in spark.range(4000).select("id", sharding.shard_of(F.col("id"), shards).alias("s")).collect()}

    def descend(key):
        some = [s for s in shards if s.weight]
        for level in ("region", "rack", "shard"):
            weight = Counter()
            for s in some:
                weight[getattr(s, level)] += s.weight
            best = min(weight, key=lambda n: _draw(17, level, n, key, weight[n])) if len(weight) > 1 else next(iter(weight))
            some = [s for s in some if getattr(s, level) == best]
        return some[0].shard

    assert all(got[k] == descend(k) for k in range(1000))
    counts = Counter(got.values())
    assert 6 not in counts and all(abs(counts[s.shard] - 4000 * s.weight / 16) < 6 * (4000 * s.weight / 16) ** 0.5 for s in shards if s.weight)


def test_sharding_confines_movement(spark):
    """Sixteen to seventeen shards: rows move only into the new one. A weight that changes in one rack moves nothing within other regions or other racks, and only out of or into the subtree that holds it."""
    ids = spark.range(4000)
    grown = [sharding.Shard(s.shard, s.region, s.rack, 3.0 if s.shard == 5 else 1.0) for s in sharding.topology(16)]
    for r in ids.select(*[sharding.shard_of(F.col("id"), sharding.topology(n)).alias(f"s{n}") for n in (16, 17)], sharding.shard_of(F.col("id"), grown).alias("heavier")).collect():
        assert r.s17 in (r.s16, 16)
        if r.heavier != r.s16:  # shard 5 of rack 1 of region 0
            assert r.heavier == 5 if r.s16 // 4 == 1 else r.heavier // 4 == 1 if r.s16 // 8 == 0 else r.heavier // 8 == 0
    counts = Counter(r.s for r in ids.select(sharding.shard_of(F.col("id"), sharding.topology(16)).alias("s")).collect())
    assert len(counts) == 16 and max(counts.values()) < 1.4 * 4000 / 16


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert rows_of(back.select(*docs.columns)) == rows_of(docs)
    want = {(r.doc_id, r.shard) for r in sharding.shard_rows(docs).collect()}
    assert {(r.doc_id, r.shard) for r in back.collect()} == want


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    fixed, rest = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        got = {s: (rest - sum(fixed.values())) * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > 2 * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(docs):
    sizes = mixing.document_sizes(docs)
    goals, blocks = mixing.mix(sizes, block=16)
    got = mixing.per_document(sizes, goals, blocks).collect()
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = Counter()
    for _, t, s in TEXTS:
        per[s] += n(t)
    want = _targets(per)
    source, taken = {i: s for i, _, s in TEXTS}, Counter()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, n(t)) for i, t, _ in TEXTS)
    for r in got:
        assert r.source_size == per[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]]) and r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in per)
    again = mixing.per_document(s2 := mixing.document_sizes(docs), *mixing.mix(s2, block=16))
    assert rows_of(again) == sorted((tuple(r) for r in got), key=str)


def test_hypergeometric_draws(spark):
    """The quantiles that the tree draws, against the law's exact distribution."""
    from math import comb

    rng, rows = np.random.default_rng(8), []
    for _ in range(300):
        n = int(rng.integers(1, 200))
        rows.append((n, int(rng.integers(0, n + 1)), int(rng.integers(0, n + 1)), float(rng.random())))
    df = spark.createDataFrame(rows, "n long, m long, k long, u double")
    for r in df.withColumn("x", mixing._hypergeometric(F.col("n"), F.col("m"), F.col("k"), F.col("u"))).collect():
        law = [comb(r.m, x) * comb(r.n - r.m, r.k - x) / comb(r.n, r.k) if x <= r.k and r.k - x <= r.n - r.m else 0.0 for x in range(r.m + 1)]
        below = sum(law[: r.x])
        assert below - 1e-9 <= r.u <= below + law[r.x] + 1e-9


def test_mixed_runs_keep_the_text(spark, docs, tmp_path):
    """A pass's runs of a document, joined in their order, are what it took of the text; a document that is taken whole is as it was; shards are written in the order of their keys."""
    texts = [(i, "".join(f"w{i}_{k}" + (" ", "\n", "\t\t", "  ")[k % 4] for k in range(i * 7)), f"s{i % 3}") for i in range(1, 60)]
    df = spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in [*texts, *TEXTS]], docs.schema)
    rows = mixing.mixed_runs(df, block=16, depth=2).collect()
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per, taken, of = Counter(), Counter(), defaultdict(list)
    for i, t, s in [*texts, *TEXTS]:
        per[s] += n(t)
        of[i].append(t or "")
    for r in rows:
        taken[r.source] += n(r.text)
        assert any(r.text in t for t in of[r.doc_id]) and 0 <= r._shard < 4 and r.text
    want = _targets(per)
    assert all(abs(taken[s] - want[s]) <= 1 for s in per)
    whole = sum(r.text in of[r.doc_id] for r in rows)
    assert whole > len(rows) / 2
    sizes = Counter(r._shard for r in rows)
    assert len(sizes) == 4
    mixing.write_mix(df, f"{tmp_path}/mix")
    back = spark.read.parquet(f"{tmp_path}/mix")
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in mixing.mixed_documents(df).collect())
    for part in (tmp_path / "mix").glob("shard=*/*.parquet"):
        keys = [r.order_key for r in spark.read.parquet(str(part)).collect()]
        assert keys == sorted(keys)


def test_mix_refuses_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(mixing.document_sizes(spark.createDataFrame([(k, "a b", f"s{k}") for k in range(3)], "doc_id long, text string, source string")))


def test_split_quotas(spark):
    dealt = mixing.split_quotas(spark.createDataFrame([(0, 1000), (1, 10), (2, 333)], "ordinal long, quota long"), depth=3).collect()
    for o, q in ((0, 1000), (1, 10), (2, 333)):
        runs = sorted((r["first"], r["last"]) for r in dealt if r.ordinal == o)
        assert runs[0][0] == 0 and runs[-1][1] == q and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
    per = Counter()
    for r in dealt:
        per[r.shard] += r["last"] - r["first"]
    assert max(per.values()) - min(per.values()) <= 3


def _groups(texts, n, num, den):
    sets = []
    for _, t, _ in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    up = list(range(len(sets)))
    root = lambda i: i if up[i] == i else root(up[i])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _, _) in enumerate(texts):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _, _) in enumerate(texts))


def test_jaccard(spark, docs):
    for n, num in ((4, 85), (5, 80)):
        assert rows_of(jaccard.linked_groups(docs, n, num, 100)) == sorted(_groups(TEXTS, n, num, 100), key=str)


def test_jaccard_near_copies_in_chunks(spark):
    rng = np.random.default_rng(1)
    base, texts = [f"w{i}" for i in range(120)], []
    for d in range(90):
        w = list(base if d % 3 else rng.permutation(base))
        for k in rng.choice(120, 1 + d % 7, replace=False):
            w[k] = f"z{d}"
        texts.append((d, " ".join(w), None))
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    want = sorted(_groups(texts, 4, 85, 100), key=str)
    assert rows_of(jaccard.linked_groups(df, 4, 85, 100)) == want
    assert rows_of(jaccard.linked_groups(df, 4, 85, 100, group_texts=8)) == want


def test_jaccard_links(spark, docs):
    """The number of links and all pairs, copies and groups in chunks too, against brute force."""
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(100)], list(TEXTS)
    for d in range(20, 100):
        w = list(base)
        for k in rng.choice(100, d % 4, replace=False):
            w[k] = f"z{d // 2}"
        texts.append((d, " ".join(w), None))
    fold = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = [re.findall(r"[^\x20\x09-\x0D]+", fold(t)) for _, t, _ in texts]
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []) for w in split]
    link = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    want = sorted((d, sum(link(a, b) for j, b in enumerate(sets) if j != i)) for i, ((d, _, _), a) in enumerate(zip(texts, sets)))
    least = {s: min(d for (d, _, _), x in zip(texts, sets) if x == s) for s in set(sets)}
    pairs = sorted((*sorted((least[a], least[b])), len(a & b), len(a | b)) for a in least for b in least if least[a] < least[b] and link(a, b))
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    for size in (8192, 9):
        got = jaccard.document_links(df, 4, 85, 100, group_texts=size).collect()
        assert sorted((r.doc_id, r.n_links) for r in got) == want
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(_groups(texts, 4, 85, 100), key=str)
        assert sorted((*sorted((r.doc_a, r.doc_b)), r.shared, r.n_union) for r in jaccard.linked_pairs(df, 4, 85, 100, group_texts=size).collect()) == pairs
    assert len(pairs) > 100 and jaccard.document_links(docs.where("false")).count() == 0


def test_signature_tree_and_components(spark):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(60, 30).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(120)]
    up = list(range(120))
    root = lambda i: i if up[i] == i else root(up[i])
    for i in range(120):
        for j in range(i):
            x = len(np.intersect1d(sets[i], sets[j]))
            if 100 * x >= 60 * (len(sets[i]) + len(sets[j]) - x):
                up[root(i)] = root(j)
    got = SignatureTree(sets, 60, 100).groups()
    assert all((got[i] == got[j]) == (root(i) == root(j)) for i in range(120) for j in range(i))
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {r.v: r.root for r in components(chain).collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_bpe_and_counts(docs):
    path = vocabulary_path()
    t = Lexicon.at(path).tokenizer
    long = "abc'reé1!" * 400
    texts = [x or "" for _, x, _ in TEXTS] + [long, "a" * 3000, "the" * 2000]
    for leaf in (16, 300, bpe.LEAF):
        encoder = bpe.Encoder(Lexicon.at(path))
        for x, ids in zip(texts, encoder.encode([x.encode() for x in texts], leaf)):
            want = t.encode(x, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert Lexicon.at(path).decode(ids).decode() == t.decode(want, skip_special_tokens=False)
        assert encoder.joins >= sum(len(x.encode()) > leaf for x in texts)
    assert token_counts.count_texts([x.encode() for x in texts], path, 13) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    got = {(r.doc_id, r.n_tokens) for r in bpe.encode_decode(docs, digests=True).collect()}
    assert got == {(r.doc_id, r.n_tokens) for r in token_counts.token_counts(docs).collect()}


def test_warc(spark):
    pages = [(1, "http://b.org/x?y=1", "<p>one</p>"), (2, None, None), (3, "http://a.b.org/", "<p>one</p>"), (4, "http://b.org/x?y=1", "é" * 5000), (5, "nonsense url\n", ""), (None, "http://c", "<p>one</p>")] + [(100 + i, f"http://h{i % 7}.net/{i}", f"p{i % 50}") for i in range(1300)]
    got = warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    first, want = {}, []
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in pages:
        b = (h or "").encode()
        again = i is not None and first[h or ""] != i
        want.append((i, len(b), warc.digest_of(b), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert warc.surt("http://www.Example.com:8080/a?b") == "com,example,www:8080)/a?b"


def test_warc_hot_keys_over_blocks(spark, monkeypatch):
    """A page captured often has its captures in many index blocks and stretches; each is read back once. Keys that are not there give no rows."""
    monkeypatch.setattr(warc, "BLOCK", 4)
    monkeypatch.setattr(warc, "STRETCH", 300)
    pages = spark.createDataFrame([(7, "http://hot.org/", f"<p>{i}</p>") if i % 3 else (100 + i, f"http://h{i}.org/", f"<p>{i}</p>") for i in range(90)], "page_id long, url string, html string")
    folder = f"{warc.shared_dir(spark)}/warc-test"
    captures = warc.write_archives(pages, folder)
    index = warc.write_index(captures, folder)
    hot = captures.groupBy("key").count().orderBy(F.desc("count")).first()
    got = warc.lookup(spark.createDataFrame([(hot.key,), (hot.key,), ("zzz",), ("",)], "key string"), index, folder).collect()
    assert hot["count"] == len(got) == 60 and {r.page_id for r in got} == {7}
    want = sorted(warc.digest_of(f"<p>{i}</p>".encode()) for i in range(90))
    assert sorted(r.payload_digest for r in warc.lookup(captures, index, folder).collect()) == want


def test_pii(docs):
    got = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    r = got[8]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and got[4].base == ""
    text = TEXTS[8][1]
    assert [text[int(a) : int(b)] for _, a, b in (x.split(":") for x in r.base.split(","))] == ["jo.do@mail.example.com", "10.0.0.1", "4111 1111 1111 1111", "+1 (988) 555-2485"]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[8] == "write to [EMAIL] or [PHONE], [IP] and [CARD]" and clean[4] is None and clean[1] == LOREM


def test_emails_match_the_pattern():
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for x in ("a@b.c-d@e.f", "a@b.c_d@e.f g@h", "@a.b x@y.z@q.r.s", "..@--.--", "a" * 2000 + "@b", "é@a.b k.l@m.n."):
        assert pii._emails(x) == [("email", m.start(), m.end()) for m in plain.finditer(x)]


def _luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def test_op7_base_by_brute_force(spark, docs, tmp_path):
    """All four kinds, their counts, digests and spans, on planted and random texts, against the contract's patterns as they stand."""
    rng = np.random.default_rng(11)
    pieces = ["a@b.co", "x.y+z@h-1.org.net", "@", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", "001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500000000000004", "+1 (988) 555-2485", "+12", "+44.20 7946-0958", " ", "\n", "-", "é", "word", "7", "12345678901234567890"]
    texts = ["".join(rng.choice(pieces, int(rng.integers(0, 14)))) for _ in range(300)] + [t for _, t, _ in TEXTS]
    folder = f"{tmp_path}/sf"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda x: re.sub("[^0-9]", "", x)
    holds = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 16 <= len(digits(x)) <= 19 and _luhn(digits(x)), "phone": lambda x: 8 <= len(digits(x)) <= 15}
    for r in pii.op7_pii(spark, folder).collect():
        text = texts[r.doc_id] or ""
        want = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, text) if holds[k](m[0])]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in plain)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert all(re.fullmatch(r"term:\d+:\d+", x) for x in r.spans[len(base) :].split(",") if x)


def test_generalised_terms():
    assert [pii.parent_of(x) for x in ("word", "Name", "NATO", "Éva", "日本", "Ивана")] == ["[WORD]", "[NAME]", "[ACRONYM]", "[NAME]", "[CJK WORD]", "[CYRILLIC NAME]"]
    assert pii.clean_text("See Zara of acme", "4:8:generalise,12:16:remove") == "See [NAME] of "


def test_revealing_terms(spark):
    texts = [(i, f"note {i} about zanzibarius person@secret.example.org today and common words", "a") for i in range(6)] + [(10 + i, f"common words about nothing {i} today and note", "a") for i in range(60)]
    got = {r.doc_id: r for r in pii.find_spans(spark.createDataFrame(texts, "doc_id long, text string, source string")).collect()}
    words = {texts[3][1][x["start"] : x["end"]] for x in got[3].terms}
    assert "zanzibarius" in words and "common" not in words and all(not got[10 + i].terms for i in range(60))


def test_all_revealing_terms(spark):
    """Terms of entities seen once or twice, far from them, in copies and beside common words, against brute force over all pairs."""
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(chr(97 + int(x)) for x in str(n))
    common, rows = [f"common{letters(k)}" for k in range(30)], []
    for i in range(300):
        w = list(rng.choice(common, 12)) + [f"seldom{letters(int(rng.integers(40)))}"] * (i % 3 == 0) + [f"single{letters(i)}"]
        w += [f"who{i}@host{i}.org"] * (i % 10 == 0) + ["twice@host.org"] * (i in (7, 8)) + ["often@host.org"] * (i % 50 == 3)
        rows.append((i, " ".join(w), "a"))
    rows += [(1000, rows[10][1], "a"), (1001, rows[10][1], "a"), (1002, rows[7][1], "a")]
    own, at, entity = lambda x: {w for w in x.split() if "@" not in w}, lambda x: {w for w in x.split() if "@" in w}, {}
    df, n = Counter(w for _, x, _ in rows for w in own(x)), len(rows)
    for _, x, _ in rows:
        entity.update({e: entity.get(e, 0) + 1 for e in at(x)})
    both, want = Counter((e, w) for _, x, _ in rows for e in at(x) for w in own(x)), {}
    for (e, w), c in both.items():
        p = entity[e] / n
        share = 1 + np.log2((c + p) / (df[w] + 1)) / -np.log2(p)
        want[w] = max(share, want.get(w, 0.0))
    want = {w: "remove" if d >= pii.REMOVE else "generalise" for w, d in want.items() if d >= pii.GENERALISE}
    got = {}
    for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        text = next(x for i, x, _ in rows if i == r.doc_id)
        found = {text[x["start"] : x["end"]]: x["action"] for x in r.terms}
        assert set(found) == own(text) & set(want)
        got |= found
    assert got == want and {f"single{letters(0)}", f"single{letters(10)}", f"single{letters(7)}", f"single{letters(8)}"} <= set(got) and not set(common) & set(got)


def test_quality(docs):
    got = {r.doc_id: r for r in quality.judge(quality.statistics(docs), quality.DecisionList()).collect()}
    for i, t, _ in TEXTS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and r.kept == (not r.base_failed)


def test_decision_list_on_held_out_rows():
    rng = np.random.default_rng(3)

    def row(i):
        r = {f: float(rng.random()) for f in quality.FEATURES}
        bad = (r["symbols_per_word"] > 0.8 and r["repeat_share"] > 0.3) or r["upper_share"] > 0.9
        return r | {"bad": bad, "fold": i % 3}

    rules = quality.learn([row(i) for i in range(3000)])
    held = [row(i) for i in range(1000)]
    hits = [(rules.rejects(r), r["bad"]) for r in held]
    assert sum(a and b for a, b in hits) / max(1, sum(a for a, _ in hits)) > 0.9 and sum(a and b for a, b in hits) > 0.8 * sum(b for _, b in hits)
    assert quality.learn([]).rules == []


def test_jpeg(docs):
    got = {r.doc_id: r for r in jpeg.read_back(jpeg.store(docs)).collect()}
    for i, t, _ in TEXTS:
        p = jpeg.pad((t or "").encode())
        assert len(p) % 192 == 0 and (got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert got[1].feature == got[3].feature
    media = jpeg.store(docs).where("doc_id = 8").first().media
    rgb = jpeg.decode(bytes(media))
    means = ",".join(str(int(x) * 1000 // (rgb.shape[0] * rgb.shape[1])) for x in rgb.sum((0, 1), dtype=np.int64))
    assert got[8].feature == f"{rgb.shape[1]}x{rgb.shape[0]}:{means}" and got[8].rgb_crc32 == zlib.crc32(rgb.tobytes())
    big = jpeg.pad(bytes(range(256)) * 7000)  # more blocks than an image is high
    assert jpeg.payload_of(jpeg.Image(jpeg.encode_payloads([big])[0])) == big


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, sf, "documents")
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, corpus_pipeline.written(stage(spark, seen, sf), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen.columns == docs.columns
        if name == "n-gram Jaccard join":
            texts = [(r.doc_id, r.text, None) for r in before.collect()]
            assert sorted(r.doc_id for r in seen.collect()) == sorted(d for d, _, least in _groups(texts, 5, 80, 100) if d == least)
    assert 0 < seen.count()


def _pii_texts(texts):
    """Sanitised texts from the disclosure of all pairs."""
    shown, df, of, both = [], Counter(), Counter(), Counter()
    for x in texts:
        spans = pii.entities(x)
        terms = [(m.start(), m.end(), "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0])) for m in re.finditer(r"[A-Za-z\x80-\U0010ffff]+", x) if len(m[0].encode()) >= 4]
        free = {w for a, b, w in terms if all(b <= p or a >= q for _, p, q in spans)}
        es = {(k, re.sub(r"[^a-z0-9@.+]", "", x[p:q].lower())) for k, p, q in spans}
        df.update({w for _, _, w in terms})
        of.update(es)
        both.update((e, w) for e in es for w in free)
        shown.append((x, terms))
    told = {}
    for (e, w), c in both.items():
        p = of[e] / len(texts)
        if p < 1:
            told[w] = max(told.get(w, 0.0), 1 + np.log2((c + p) / (df[w] + 1)) / -np.log2(p))
    cut = lambda a, b, w: f"{a}:{b}:{'remove' if told[w] >= pii.REMOVE else 'generalise'}"
    return [pii.clean_text(x, ",".join(cut(*t) for t in terms if told.get(t[2], 0.0) >= pii.GENERALISE)) for x, terms in shown]


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    seen, rows = corpus_pipeline.table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = seen.collect()
        seen = corpus_pipeline.written(stage(spark, seen, sf), "test")
        rows[name] = before, seen.collect()
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    before, after = rows["quality rules"]

    def failed(t):
        w = words_of(t)
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        return len(w) < 10 or 100 * len({j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}) > 20 * len(w)

    assert after and not Counter(after) - Counter(r for r in before if not failed(r.text))

    before, after = rows["PII"]
    assert sorted(zip([r.doc_id for r in before], _pii_texts([r.text for r in before]))) == sorted((r.doc_id, r.text) for r in after)

    before, after = rows["mixing sources to target weights"]
    sizes, taken, whole = Counter(), Counter(), {r.doc_id: r for r in before}
    for r in before:
        sizes[r.source] += len(words_of(r.text))
    for r in after:
        taken[r.source] += len(words_of(r.text))
        assert r.source == whole[r.doc_id].source and r.n_chars == len(r.text) and r.text in whole[r.doc_id].text
    want = _targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)

    before, after = rows["BPE encoding and decoding"]
    t = Lexicon.at(vocabulary_path()).tokenizer
    want = []
    for r in before:
        ids = t.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    assert sorted(want) == sorted((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in after)


def test_lexicon_starts_anew(monkeypatch):
    """Beyond its bound the lexicon forgets, and still learns the words at hand."""
    from lodestar.llm import lexicon

    monkeypatch.setattr(lexicon, "KEEP", 3)
    words = Lexicon(vocabulary_path())
    words.learn(iter([b"one", b"two"]))
    words.learn(iter([b"three", b"four"]))
    assert set(words.words) == {b"three", b"four"}


def test_adversarial_cuts_and_chunks():
    """Contractions, marks, numbers, cased and special strings cut at every place, against the library."""
    path, rng = vocabulary_path(), np.random.default_rng(6)
    t = Lexicon.at(path).tokenizer
    pieces = [*"ab'rselvtdm 12½", "é", "e\u0301\u0316", "Σ", "İ", "日", "각", "\u1100\u1161", "<|", "|>", "<|endoftext|>", "\u00a0", "the", "ing", "'re"]
    texts = ["".join(rng.choice(pieces, rng.integers(120))) for _ in range(150)] + ["'r", "'", "''re", "a" * 2000, "é\u0301" * 200]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    for leaf in (8, 40, 400):
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_texts([x.encode() for x in texts], path, leaf)] == want
    for chunk in (1, 3, 7, 64, 512):
        assert token_counts.count_texts([x.encode() for x in texts], path, chunk) == [len(x) for x in want]


def test_real_texts_take_joins_and_transitions(spark):
    """No text of documents is counted or encoded but over the tree and the table, and all equal the library's."""
    path = vocabulary_path()
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = [x.ids for x in Lexicon.at(path).tokenizer.encode_batch(texts, add_special_tokens=False)]
    encoder, table = bpe.Encoder(Lexicon.at(path)), Transducer(path)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([x.encode() for x in texts])] == want
    assert encoder.joins >= sum(len(x.encode()) > bpe.LEAF for x in texts) > 0
    parts = [table.symbols(table.normalised(x).encode()) for x in texts if "<|" not in x]
    assert token_counts.count_symbols(table, parts).tolist() == [len(w) for x, w in zip(texts, want) if "<|" not in x]
    assert (table.target >= 0).sum() > 1000 and len(table.states) > 500


def test_transducer_starts_anew():
    """Beyond its bound the table forgets its states, and counts the same."""
    path = vocabulary_path()
    t = Transducer.at(path)
    words = [b"some words to count", b"other words there"]
    want = token_counts.count_texts(words, path)
    keep, t.keep = t.keep, 3
    try:
        assert token_counts.count_texts(words, path) == token_counts.count_texts(words, path) == want
    finally:
        t.keep = keep


def test_thresholds_lie_in_the_middle_of_a_gap():
    rows = [{f: 0.0 for f in quality.FEATURES} | {"symbols_per_word": 0.5 + i % 7 / 10 if i % 2 else 0.0, "bad": bool(i % 2), "fold": i % 3} for i in range(300)]
    (rule,) = quality.learn(rows).rules
    assert rule.conditions == [("symbols_per_word", True, 0.25)] and not rule.meets({"symbols_per_word": 0.2}) and rule.meets({"symbols_per_word": 0.3})


def test_stages_with_clashing_columns(spark, docs):
    """Columns may be called what the stages call their own; a stage gives back the columns that it got, empty tables too."""
    import corpus_pipeline

    own = ["_uid", "_first", "_words", "_shard", "_order", "_piece", "_d", "_k", "_key", "_terms", "_row", "_q", "_n", "_id", "n_words", "rule", "kept", "c0", "rows", "uid", "a.b"]
    table = docs.select("doc_id", "text", "source", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"), *[F.lit(i).alias(c) for i, c in enumerate(own)])
    for some in (table, table.where("false")):
        some = corpus_pipeline.written(some, "test")
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, some, "/root/testdata/sf0.001")
            rows = got.collect()
            assert name == corpus_pipeline.STAGES[-1][0] or got.columns == some.columns
            assert all(r["_id"] == own.index("_id") and r["a.b"] == own.index("a.b") for r in rows if "_id" in r)


@pytest.mark.parametrize("name", ["op4_ngram_jaccard", "op6_warc"])
def test_sql(spark, name):
    """Whole results against their SQL."""
    import duckdb

    from lodestar.llm import queries

    folder = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, folder)
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.select(*want.columns)) == sorted(want.fetchall(), key=str)


def test_sql_on_odd_rows(spark, docs, tmp_path):
    """The links' SQL agrees on nulls, empty and very long texts and repeated rows."""
    import duckdb

    from lodestar.llm.oracle import ORACLE

    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    db = duckdb.connect()
    db.register("documents", documents)
    assert rows_of(jaccard.document_links(docs, n=4, num=85, den=100)) == sorted(db.sql(ORACLE["op4_ngram_jaccard"]).fetchall(), key=str)
