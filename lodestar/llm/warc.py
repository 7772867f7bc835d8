"""WARC archives with a two-level capture index.

Archives: every task writes its records, each a gzip member of its own, to one file in the shared folder. Of records with equal payloads one is a response; the others are revisits that refer to it and have no payload.
Index: captures are sorted by their reversed-host URL key and cut into compressed blocks of BLOCK lines, one index file per range of keys. The file ends with its block directory, which has the first key of each block and the block's place. A lookup goes by binary search from the files' first keys to a file, in its directory to a block, and in the block
to the line that names archive, offset and length; then it reads that range of the archive.

Files are named by the task attempt that wrote them, and only rows of attempts that ended well name them, so an attempt that is lost leaves an unread file and no wrong index.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, table, thrifty, written

#: Index lines in a compressed block.
BLOCK = 512
#: Bytes of archives that a reading task is meant to take, bytes of an archive that are dealt out together, and index files whose directories a task keeps.
READ_BYTES, STRETCH, OPEN_INDEXES = 32 << 20, 1 << 18, 64
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MAGIC = b"LDIX"


def surt(url: str | None) -> str:
    """The key of a URL: host names from the last to the first, then port, path and query; '-' for none. Never has a space or a control character."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return quote(url, safe="/?&=%:,;~+!*'()@#$[]")
    path = quote((u.path or "/") + (f"?{u.query}" if u.query else ""), safe="/?&=%:,;~+!*'()@#$[]")
    return quote(",".join(reversed(host.split("."))), safe=",-_") + (f":{port}" if port else "") + ")" + path


def key_of(url: str | None, page_id: int | None) -> str:
    return f"{surt(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, url: str | None, page_id: int | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC record, not compressed."""
    uri = quote(url or "", safe="/?&=%:,;~+!*'()@#$[]")
    name = lambda i: uuid.uuid5(_SPACE, f"page:{i}").urn
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name(page_id)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{name(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if kind == "revisit" else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(headers["content-length"])]
    return headers, body.partition(b"\r\n\r\n")[2]


def _gz(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class _Files:
    """Open files of the shared folder, the last few of which stay open."""

    def __init__(self, folder: str, most: int = 32):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(folder)
        self.open, self.most = OrderedDict(), most

    def create(self, name: str):
        self.fs.create_dir(self.path, recursive=True)
        return self.fs.open_output_stream(f"{self.path}/{name}", compression=None)

    def file(self, name: str):
        if name not in self.open:
            if len(self.open) >= self.most:
                self.open.popitem(last=False)[1].close()
            self.open[name] = self.fs.open_input_file(f"{self.path}/{name}")
        self.open.move_to_end(name)
        return self.open[name]

    def read(self, name: str, offset: int, length: int) -> bytes:
        return self.file(name).read_at(length, offset)


def _attempt() -> str:
    c = TaskContext.get()
    return f"{c.partitionId():06d}-{c.taskAttemptId()}"


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row and returns the captures: (key, file, offset, length).

    A null html is an empty payload; a null url has the key '-'; a row without id is always a response. Of rows with equal payloads of at least min_revisit bytes the smallest id is the response; other rows with that same id are responses too.
    """
    bounded_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    sums = written(rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("n")), "payloads")
    many = sums.where(f"n >= {int(min_revisit)} and page_id is not null").groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = sums.join(many, "sha").where("page_id <> first").select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first").distinct()
    marked = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(again, (F.col("page_id") == F.col("p")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "html", "first")

    def run(batches):
        files, name, out, at = _Files(folder), f"archive-{_attempt()}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for page, url, html, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).to_pylist()):
                data = _gz(record("response" if first is None else "revisit", url, page, html.as_py(), first))
                out = out or files.create(name)
                out.write(data)
                rows.append((key_of(url, page), name, at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(4)], names=["key", "file", "offset", "length"])
        if out:
            out.close()

    return written(marked.mapInArrow(thrifty(run), "key string, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes the block files and returns the top of the index, a row per file: (first_key, file, bytes), the bytes being those of the archives that its captures take."""

    def run(batches):
        files, name, out, at, held, directory, size = _Files(folder), f"index-{_attempt()}.idx", None, 0, [], [], 0

        def flush():
            nonlocal out, at
            block = zlib.compress("\n".join(held).encode(), 6)
            out = out or files.create(name)
            out.write(block)
            directory.append((held[0].partition("\t")[0], at, len(block)))
            at += len(block)
            held.clear()

        for batch in batches:
            size += sum(batch.column(3).to_pylist())
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append("\t".join(map(str, row)))
                if len(held) == BLOCK:
                    flush()
        if held:
            flush()
        if out:
            tail = zlib.compress("\n".join(f"{k}\t{a}\t{n}" for k, a, n in directory).encode(), 6)
            out.write(tail + struct.pack("<Q", len(tail)) + _MAGIC)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name]), pa.array([size], pa.int64())], names=["first_key", "file", "bytes"])

    ranged = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return written(ranged.select("key", "file", "offset", "length").mapInArrow(thrifty(run), "first_key string, file string, bytes long"), "index")


class _IndexFile:
    """An index file's block directory; blocks are read when asked for."""

    def __init__(self, files: _Files, name: str):
        self.files, self.name = files, name
        f = files.file(name)
        size = f.size()
        n, magic = struct.unpack("<Q4s", f.read_at(12, size - 12))
        if magic != _MAGIC:
            raise ValueError(f"{name} is not an index file")
        rows = [x.split("\t") for x in zlib.decompress(f.read_at(n, size - 12 - n)).decode().split("\n")]
        self.keys, self.places = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
        self.at, self.lines = -1, []

    def blocks(self, key: str) -> range:
        """The blocks that may have captures of a key, by binary search in the directory."""
        return range(max(0, bisect.bisect_left(self.keys, key) - 1), bisect.bisect_right(self.keys, key))

    def find(self, key: str, block: int) -> list[tuple[str, int, int]]:
        """A key's captures in one block: (archive, offset, length)."""
        if self.at != block:
            self.lines, self.at = [x.split("\t") for x in zlib.decompress(self.files.read(self.name, *self.places[block])).decode().split("\n")], block
        first, last = (cut(self.lines, key, key=lambda x: x[0]) for cut in (bisect.bisect_left, bisect.bisect_right))
        return [(x[1], int(x[2]), int(x[3])) for x in self.lines[first:last]]


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def lookup(keys: DataFrame, index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """SCHEMA of all captures of the keys (key), each asked for once however often it is given. A key without captures has no rows. A revisit's payload is null; its length and digest are those of the payload that it refers to. Without payloads, that column is null."""
    top = sorted((r.first_key, r.file, r.bytes) for r in index.collect())  # a row for each index file: as many as the range partitions of the sort
    if not top:
        return keys.sparkSession.createDataFrame([], SCHEMA)
    firsts, names = [t[0] for t in top], [t[1] for t in top]
    tasks = max(keys.sparkSession.sparkContext.defaultParallelism, -(-sum(t[2] for t in top) // READ_BYTES))

    def route(batches):
        files, open_ = _Files(folder), {}
        for batch in batches:
            parts = []
            for key in batch.column(0).to_pylist():
                # a key's captures may go on in the files, and the blocks, that start with it
                for p in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                    if p not in open_:
                        if len(open_) >= OPEN_INDEXES:
                            open_.clear()
                        open_[p] = _IndexFile(files, names[p])
                    parts += [(key, p, i) for i in open_[p].blocks(key)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in parts], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))], names=["key", "part", "block"])

    def places(batches):
        files, part, index = _Files(folder), -1, None
        for batch in batches:
            rows = []
            for key, p, i in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    part, index = p, _IndexFile(files, names[p])
                rows += index.find(key, i)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "offset", "length"])

    def run(batches):
        files = _Files(folder)
        for batch in batches:
            rows = []
            for place in zip(*(c.to_pylist() for c in batch.columns)):
                raw = zlib.decompress(files.read(*place), 31)
                headers, payload = parse(raw)
                full = headers["warc-type"] == "response"
                n = len(payload) if full else int(headers["x-payload-length"])
                digest = digest_of(payload) if full else headers["warc-payload-digest"].removeprefix("sha1:")
                rows.append((int(headers["x-page-id"]) if "x-page-id" in headers else None, n, digest, headers["warc-type"], int(headers["x-refers-to-page"]) if not full else None, payload if full and payloads else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    # index blocks are dealt to tasks, then stretches of the archives: a key with many captures is in many blocks and stretches
    routed = keys.select("key").distinct().mapInArrow(thrifty(route), "key string, part int, block int")
    found = routed.repartition(tasks, "part", "block").sortWithinPartitions("part", "block", "key").mapInArrow(thrifty(places), "file string, offset long, length long")
    stretch = F.floor(F.col("offset") / STRETCH)
    return found.repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset").mapInArrow(thrifty(run), SCHEMA)


def archive(pages: DataFrame, min_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", payloads: bool = False) -> DataFrame:
    """Writes pages to archives and an index in the shared folder, looks every capture up and reads it back: SCHEMA, a row for each row of pages. An empty table gives no rows; other columns are not read."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex[:12]}"
    captures = write_archives(pages, folder, min_revisit, id_col, url_col, html_col)
    return lookup(captures, write_index(captures, folder), folder, payloads)


def op6_warc(spark, sf_dir):
    return archive(table(spark, sf_dir, "pages")).drop("payload")
