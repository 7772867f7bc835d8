"""N-gram Jaccard join: documents whose word shingles overlap enough, and their linked groups.

1. Classes. Documents with equal shingle sets are one class: a hash of the set, found in one scan, together with a sketch of the set: how many tokens fall into each of some hash bins.
2. Candidates, without loss. Sets are put into size bands. In a band, tokens are dealt by hash into so many parts that two sets which link must agree in more parts than either leaves out: sets of at most U tokens with Jaccard similarity num/den or more differ in at most d = 2U(den-num)/(den+num) tokens, so of d + 1 + e parts they agree in at least e + 1. A set leaves out its sparsest parts, e at most, by a bound on their
   size that keeps all parts as full; the fullest part in which two sets agree is then kept by both. A key is a part's content. A set near its band's end is also dealt by the next band's rule, so pairs across two bands meet too. Keys are packed into arrays, a row for each bucket of keys and task.
   The classes under one key are a block; blocks with the same classes are one. In a block, two sets whose sketches differ by more than linked sets can differ are no candidates; the rest is joined from class to class, each looked at once against those not reached yet. So a passage that many documents share makes no candidates of them.
3. Links. Each candidate group's texts (one per class) come together; a signature tree finds all pairs that link, or, where only groups are asked for, as many as join them. A group too large for one task is dealt into bands of size, and bands into chunks; only chunks of one band or of two that touch can have links between them, and each such pair of chunks is one task. What they link is merged.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_bytes, table, text_of, thrifty, thrifty_group, written
from .components import components
from .signature_tree import Forest, SignatureTree
from .wordhash import mix, windows, words

#: Keys that one bucket of the key table is meant to hold.
BUCKET_KEYS = 1 << 21
#: Keys that a task packs at once, and rows of blocks that a task looks at together, as meant.
EMIT_KEYS, BLOCK_ROWS = 1 << 20, 1 << 17
#: A candidate group of more texts or bytes is dealt into chunks.
GROUP_TEXTS, GROUP_BYTES = 8192, 48 << 20
#: The same where the pairs themselves go out.
PAIR_TEXTS = 2048
#: Ids that are broadcast at most (8 bytes each); beyond, texts are found by a shuffled join.
BROADCAST_IDS = 1 << 18


def sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The distinct n-word shingles of each text, as sorted hashes."""
    h, owner, *_ = words(texts)
    s, owner = windows(h, owner, len(texts), n)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
    return [np.unique(s[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]).astype(int), ends)]


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def _bands(most: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return out


BANDS = np.array(_bands())


def keys_of(s: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The keys of a set, for its own band and, near the band's end, the next."""
    size, out = len(s), []
    band = int(np.searchsorted(BANDS, size, "right")) - 1
    for b in (band, band + 1) if den * size >= num * int(BANDS[band + 1]) else (band,):
        d = 2 * (int(BANDS[b + 1]) - 1) * (den - num) // (den + num)
        if not d:
            continue  # only equal sets can link here
        e = max(1, (d + 1) // 6)
        k = d + 1 + e
        part = (s >> np.uint64(11)) % np.uint64(k)
        order = np.argsort(part, kind="stable")
        count = np.bincount(part.astype(np.int64), minlength=k)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s[order] ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
        ends = np.cumsum(count)
        content = sums[ends] - sums[ends - count]
        bound = np.partition(count, e)[e]  # at most e parts are smaller
        names = mix(content + mix(np.arange(k, dtype=np.uint64) + np.uint64(b) * np.uint64(1 << 40) + count.astype(np.uint64) * np.uint64(1 << 20)))
        out.append(names[count >= bound])
    return out


def sketch_of(s: np.ndarray) -> bytes:
    """How many tokens fall into each bin, 255 at most; a power of two of bins, about an eighth of the tokens. Halving a sketch adds its halves."""
    bins = 32
    while bins < min(4096, 0.1 * len(s)):
        bins *= 2
    return np.minimum(np.bincount(((s >> np.uint64(40)) & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def _halved(v: np.ndarray, bins: int) -> np.ndarray:
    return v.reshape(-1, bins).sum(0)


def _apart(v: np.ndarray, n: np.ndarray, i: int, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the others can't link with i: sets differ by no less than their sketches do."""
    out = np.empty(len(others), bool)
    step = max(1, (1 << 22) // v.shape[1])
    for a in range(0, len(others), step):
        o = others[a : a + step]
        out[a : a + step] = (np.abs(v[o] - v[i]).sum(1) * (den + num) > (den - num) * (n[o] + n[i])) | (den * np.minimum(n[o], n[i]) < num * np.maximum(n[o], n[i]))
    return out


def _block_edges(classes: np.ndarray, n: np.ndarray, sketches: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """Edges that join the classes of a block which their sketches let link, directly or over others."""
    bins = min(map(len, sketches))
    v = np.stack([_halved(np.frombuffer(x, np.uint8).astype(np.int32), bins) for x in sketches])
    v = np.minimum(v, 255)
    left, out = np.arange(len(classes)), []
    while len(left) > 1:
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            apart = _apart(v, n, i, left, num, den)
            reached, left = left[~apart], left[apart]
            out += [(int(classes[i]), int(classes[k])) for k in reached]
            front += reached.tolist()
    return out


def document_classes(df: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, cls, n_bytes, sketch) of each row; cls and sketch are null for a set without shingles."""
    bounded_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1).cast(pa.binary())]
            sets = [s for some in by_bytes(texts) for s in sets_of(some, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([sketch_of(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n_shingles", "cls", "n_bytes", "sketch"])

    return text_of(df, id_col, text_col).mapInArrow(thrifty(run), "doc_id long, n_shingles long, cls long, n_bytes long, sketch binary")


def blocks_of(df: DataFrame, n: int, num: int, den: int, buckets: int, text_col: str = "text") -> DataFrame:
    """(block, cls): the classes that have a key in common, a block for each different list of classes."""
    shift = np.uint64(64 - (buckets - 1).bit_length()) if buckets > 1 else None

    def packed(keys, classes):
        keys, classes = np.concatenate(keys), np.concatenate(classes)
        order = np.argsort(keys, kind="stable")
        keys, classes = keys[order], classes[order]
        where = np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64)) if shift is not None else np.array([0, len(keys)])
        some = [k for k in range(buckets) if where[k + 1] > where[k]]
        slices = lambda x, kind: pa.array([x[where[k] : where[k + 1]].astype(kind).tobytes() for k in some], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), slices(keys, "<u4"), slices(classes, "<i8")], names=["bucket", "keys", "classes"])

    def emit(batches):
        keys, classes, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            texts = [x.as_py() for x in batch.column(0).cast(pa.binary())]
            for some in by_bytes(texts):
                done = set()
                for s in sets_of(some, n):
                    if len(s) and (c := class_of(s)) not in done:
                        done.add(c)
                        for k in keys_of(s, num, den):
                            keys.append(k)
                            classes.append(np.full(len(k), c, np.int64))
                            held += len(k)
                if held > EMIT_KEYS:
                    yield packed(keys, classes)
                    keys, classes, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        yield packed(keys, classes)

    def meet(group: pa.Table) -> pa.Table:
        # keys of one bucket differ in what is left of their low 32 bits; two keys that don't only put more classes into one block
        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in group.column(name)])
        keys, classes = read("keys", "<u4"), read("classes", "<i8")
        order = np.lexsort((classes, keys))
        keys, classes = keys[order], classes[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])]) if len(keys) else np.zeros(0, bool)
        keys, classes = keys[new], classes[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(keys)))
        first, size = first[size > 1], size[size > 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(classes.view(np.uint64)), dtype=np.uint64)])
        name, at = np.unique(mix(sums[first + size] - sums[first] + size.astype(np.uint64)), return_index=True)
        first, size = first[at], size[at]
        member = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
        return pa.table({"block": pa.array(np.repeat(name.view(np.int64), size), pa.int64()), "cls": pa.array(classes[member], pa.int64())})

    rows = df.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(thrifty(emit), "bucket int, keys binary, classes binary").groupBy("bucket").applyInArrow(thrifty_group(meet), "block long, cls long").distinct()


def candidate_edges(blocks: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that join the classes of each block which may link; classes has (cls, n_shingles, sketch). A task joins what its blocks have in common and gives an edge from each class to the smallest one that it reaches, so tasks that see the same group give the same edges."""

    def run(group: pa.Table) -> pa.Table:
        block, cls, size, sketch = group.column("block").to_numpy(), group.column("cls").to_numpy(), group.column("n_shingles").to_numpy(), group.column("sketch")
        order = np.lexsort((cls, block))
        ends = np.append(np.flatnonzero(np.diff(block[order])) + 1, len(order))
        names = np.unique(cls)
        forest, a = Forest(len(names)), 0
        number = {c: k for k, c in enumerate(names.tolist())}
        for b in ends.tolist():
            mine = order[a:b]
            for x, y in _block_edges(cls[mine], size[mine], [sketch[int(k)].as_py() for k in mine], num, den):
                forest.join(number[x], number[y])
            a = b
        root = names[[forest.root(k) for k in range(len(names))]] if len(names) else names
        joined = root != names
        return pa.table({"a": pa.array(names[joined], pa.int64()), "b": pa.array(root[joined], pa.int64())})

    tasks = max(8, -(-blocks.count() // BLOCK_ROWS))
    return blocks.join(classes, "cls").withColumn("task", F.pmod("block", F.lit(tasks))).groupBy("task").applyInArrow(thrifty_group(run), "a long, b long")


def _tree(pdf: pd.DataFrame, n: int, num: int, den: int) -> tuple[list[int], SignatureTree, np.ndarray, np.ndarray | None]:
    """A task's classes in order, their tree, their rows, and their chunks if only links between chunks are the task's."""
    texts = [t.encode() for t in pdf["text"]]
    sets = [s for some in by_bytes(texts) for s in sets_of(some, n)]
    by_class = {class_of(s): s for s in sets if len(s)}
    names = sorted(set(pdf["cls"]) & by_class.keys())
    rows, chunk = dict(zip(pdf["cls"], pdf["rows"])), dict(zip(pdf["cls"], pdf["chunk"]))
    task = pdf["task"].iloc[0]
    side = np.array([chunk[c] for c in names]) if task["i"] != task["j"] else None
    return names, SignatureTree([by_class[c] for c in names], num, den), np.array([rows[c] for c in names], np.int64), side


def _verify(n: int, num: int, den: int, count: bool):
    """Edges (a, b) from each class to the smallest of its group, and with count=True the rows of other classes that a links with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, tree, rows, side = _tree(pdf, n, num, den)
        linked = np.zeros(len(names), np.int64)
        if count:
            for i, j, _ in tree.links(side):
                np.add.at(linked, i, rows[j])
                np.add.at(linked, j, rows[i])
            group = tree.joined()
        else:
            group = tree.groups()
        least: dict[int, int] = {}
        for c, g in zip(names, group.tolist()):
            least.setdefault(g, c)
        return pd.DataFrame({"a": pd.Series(names, dtype="int64"), "b": pd.Series([least[g] for g in group.tolist()], dtype="int64"), "linked": pd.Series(linked, dtype="int64")})

    return run


def _pairs(n: int, num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, tree, _, side = _tree(pdf, n, num, den)
        name, sizes = np.array(names, np.int64), np.array([len(s) for s in tree.sets], np.int64)
        size = np.empty(len(sizes), np.int64)
        size[tree.order] = sizes
        i, j, both = (np.concatenate(x) for x in zip(*(list(tree.links(side)) or [(np.zeros(0, np.int64),) * 3])))
        return pd.DataFrame({"a": name[i], "b": name[j], "shared": both, "n_union": size[i] + size[j] - both})

    return run


def _dealt(df: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, group_texts: int, group_bytes: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows' classes, the classes, the candidate groups' chunks, and the tasks' texts."""
    docs = written(document_classes(df, n, id_col, text_col), "classes")
    shingles = docs.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = 8
    while buckets < min(1 << 22, 0.3 * shingles / BUCKET_KEYS):
        buckets *= 2
    classes = docs.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.max("n_bytes").alias("n_bytes"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"))
    blocks = written(blocks_of(df, n, num, den, buckets, text_col), "blocks")
    near = components(candidate_edges(blocks, classes.select("cls", "n_shingles", "sketch"), num, den))
    # sizes of linked sets differ by den / num at most, so by less than one band; the bands of a group are few
    band = F.floor(F.log("n_shingles") / (1.001 * max(math.log(den / num), 1e-6))).cast("int")
    members = near.join(classes, near["v"] == classes["cls"]).select("root", "cls", "rep", "rows", "n_bytes", band.alias("band"))
    members = written(members, "members")
    needed = F.greatest(F.ceil(F.sum("texts") / group_texts), F.ceil(F.sum("n_bytes") / group_bytes))
    bands = members.groupBy("root", "band").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_bytes").alias("n_bytes"))
    chunks = F.greatest(F.ceil(F.col("texts") / group_texts), F.ceil(F.col("n_bytes") / group_bytes)).cast("int")
    sizes = bands.withColumn("chunks", chunks).groupBy("root").agg((needed > 1).alias("large"), F.map_from_entries(F.collect_list(F.struct("band", "chunks"))).alias("chunks"))
    members = written(members.join(sizes, "root"), "members")
    ids = members.select("rep").distinct()
    texts = df.select(F.col(id_col).alias("rep"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if members.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(ids), "rep", "left_semi")
    name = lambda band, k: F.shiftleft(band.cast("long"), 32) + k
    chunk = F.when(F.col("large"), name(F.col("band"), F.pmod(F.xxhash64("cls"), F.col("chunks")[F.col("band")]))).otherwise(F.lit(0).cast("long"))
    # chunks of the bands that a text's links can lead to
    of_band = lambda b: F.when(F.col("chunks")[b].isNotNull(), F.transform(F.sequence(F.lit(0), F.col("chunks")[b] - 1), lambda k: name(b, k))).otherwise(F.array().cast("array<long>"))
    others = F.when(F.col("large"), F.flatten(F.transform(F.array(*[F.col("band") + k for k in (-1, 0, 1)]), of_band))).otherwise(F.array(F.lit(0).cast("long")))
    tasks = F.transform(others, lambda k: F.struct(F.least(F.col("chunk"), k).alias("i"), F.greatest(F.col("chunk"), k).alias("j")))
    dealt = members.withColumn("chunk", chunk).withColumn("task", F.explode(tasks)).join(texts, "rep").select("root", "task", "chunk", "cls", "rows", "text")
    return docs, classes, sizes, dealt


def linked_pairs(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", group_texts: int = PAIR_TEXTS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(cls_a, cls_b, doc_a, doc_b, shared, n_union): each pair of different shingle sets that links, once, with the smallest id of each set's rows. Rows and links are as document_links() has them; document_classes() says which rows have which set."""
    _, classes, _, dealt = _dealt(df, n, num, den, id_col, text_col, group_texts, group_bytes)
    pairs = written(dealt.groupBy("root", "task").applyInPandas(thrifty_group(_pairs(n, num, den)), "a long, b long, shared long, n_union long"), "pairs")
    of = lambda x: classes.select(F.col("cls").alias(x), F.col("rep").alias(f"doc_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("a").alias("cls_a"), F.col("b").alias("cls_b"), "doc_a", "doc_b", "shared", "n_union")


def document_links(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", group_texts: int = GROUP_TEXTS, group_bytes: int = GROUP_BYTES, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row.

    A row's set are its distinct n-word shingles (A to Z like a to z; words end at ASCII white space); with fewer words the whole sequence is one. Two rows link if den * shared >= num * union. component_id is the smallest id that links reach, n_links the number of other rows that the row links with, copies too.
    A null or empty text has no shingles and links with nothing. Equal texts have equal sets and link. Repeated rows stay. A null id never names a group unless all ids of it are null. An empty table gives no rows; other columns of df are not read.
    """
    docs, classes, sizes, dealt = _dealt(df, n, num, den, id_col, text_col, group_texts, group_bytes)
    links = written(dealt.groupBy("root", "task").applyInPandas(thrifty_group(_verify(n, num, den, count)), "a long, b long, linked long"), "links")
    if sizes.where("large").isEmpty():
        found = links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    else:
        found = components(links)
    # groups are named class by class, and what names them is written, so that Spark can split the joins at a group or a class that has many rows
    grouped = classes.select("cls", "rep").join(found.select(F.col("v").alias("cls"), F.col("root").alias("g")).distinct(), "cls", "left").withColumn("g", F.coalesce("g", "cls"))
    least = written(grouped.groupBy("g").agg(F.min("rep").alias("least")), "least")
    names = written(grouped.join(least, "g").select("cls", "least"), "names")
    out = docs.join(names, "cls", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    if not count:
        return out.select("doc_id", "n_shingles", "component_id", F.lit(None).cast("long").alias("n_links"))
    others = classes.select("cls", "rows").join(links.groupBy(F.col("a").alias("cls")).agg(F.sum("linked").alias("linked")), "cls", "left")
    others = others.select("cls", (F.col("rows") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    return out.join(others, "cls", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def linked_groups(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", group_texts: int = GROUP_TEXTS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """document_links() without the number of links: pairs of sets that are already in one group are not compared."""
    return document_links(df, n, num, den, id_col, text_col, group_texts, group_bytes, count=False).drop("n_links")


def op4_ngram_jaccard(spark, sf_dir):
    return document_links(table(spark, sf_dir, "documents"), n=4, num=85, den=100)
