"""WARC archives with a two-level capture index.

Records go to archives in the order in which partitions hold the pages.  The index has one line
per capture, sorted by reversed-host URL key and page id, in compressed blocks.  A sparse directory
has the first key and the byte range of each block; it is kept in slices, one beside each index
file, and the first keys of the slices are all that travels.  A lookup finds the slice, searches its
directory, then one block, and then reads the byte range of the record.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.plans.scratch import materialize, scratch_path, shuffle_partitions
from corpusgraph.plans.skew import join_groups

MIN_REVISIT_BYTES = 100
BLOCK_LINES = 256
BROADCAST_BYTES = 8 << 20
ARCHIVE_BYTES = 1 << 30
_NO_ID = -(2**63)
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard namespace of URLs
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"  # pages carry no capture time


def _clean(value: str | None) -> str:
    """A url without white space and control characters, which would end a line of a header or of the index."""
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: f"%{ord(m[0]):02X}", value or "")


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example,www)/a?b`` (scheme and fragment go).

    Of the url as a record's header has it (``_clean``), so that a header leads back to its key.
    """
    url = _clean(url)
    rest = url.partition("://")[2] or url
    m = re.match(r"([^/?#]*)([^#]*)", rest, re.S)
    host = m[1].lower().rpartition("@")[2]
    return f"{','.join(reversed(host.split('.')))}){m[2] or '/'}"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """One compressed record.  A revisit carries the HTTP head only and names its response and its url."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Target-URI: {_clean(refers_url)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return _gzip("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    return fs, path


def _classify(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Payload digests, and for copies the smallest page id of their payload."""
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    long_enough = F.octet_length("payload") >= MIN_REVISIT_BYTES
    response = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    seen = p.where(long_enough).groupBy("digest").agg(response.alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"), "n")
    seen = materialize(seen, "warc-copies")
    if (seen.agg(F.sum(F.coalesce(F.octet_length("first_url"), F.lit(0)) + 160)).first()[0] or 0) <= BROADCAST_BYTES:
        p = p.join(F.broadcast(seen.drop("n")), "digest", "left")
    else:
        p = join_groups(p, seen, ["digest"], how="left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.select("page_id", "url", "payload", "digest", F.when(other, F.col("first")).alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_url"))


CAPTURE = "key string, page_id long, file string, at long, size long"


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per page; returns the captures (key, page id, file and byte range).

    A task writes files of its own under a fresh name, so that a task run again leaves at most
    a file that no capture names.
    """

    def scan(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        sink, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, u, payload, digest, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None or at > ARCHIVE_BYTES:
                    if sink is not None:
                        sink.close()
                    name, at = f"pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz", 0
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                record = make_record(page_id, u, payload, digest, "response" if refers_to is None else "revisit", refers_to, refers_url)
                sink.write(record)
                rows.append((url_key(u), page_id, name, at, len(record)))
                at += len(record)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "at", "size"])
        if sink is not None:
            sink.close()

    return materialize(_classify(pages, key, url, html).mapInArrow(scan, CAPTURE), "warc-captures")


SLICE = "key string, page_id long, file string, n_blocks long, n long"


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures into compressed index blocks; returns the slices of the directory, one row a file.

    Beside ``index-….gz`` lies ``index-….dir``: a line per block with its first key and byte range.
    """

    def scan(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name = f"index-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        sink, at, held, lines, n = None, 0, [], [], 0

        def flush():
            nonlocal sink, at, held
            if sink is None:
                sink = fs.open_output_stream(f"{base}/{name}.gz", compression=None)
            block = _gzip("\n".join(f"{k} {'' if i is None else i} {f} {a} {s}" for k, i, f, a, s in held).encode())
            sink.write(block)
            lines.append(json.dumps([held[0][0], held[0][1], at, len(block)]))
            at, held = at + len(block), []

        first = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = first or row
                n += 1
                held.append(row)
                if len(held) == BLOCK_LINES:
                    flush()
        if held:
            flush()
        if sink is not None:
            sink.close()
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as out:
                out.write(_gzip("\n".join(lines).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((first[0], first[1], name, len(lines), n), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "n_blocks", "n"])

    n = shuffle_partitions(captures.sparkSession)
    ordered = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id")
    return materialize(ordered.mapInArrow(scan, SLICE), "warc-slices")


def load_slices(slices: DataFrame) -> list[tuple[str, int | None, str]]:
    """First key, page id and file of each slice, in order: one row per index file, of which there are as many as partitions."""
    rows = ((r["key"], r["page_id"], r["file"]) for r in slices.collect())
    return sorted(rows, key=lambda r: Reader.order(r[0], r[1]))


class Reader:
    """Lookups by binary search in slices, directory and block, then range reads; the last ones stay open."""

    def __init__(self, folder: str, slices: list[tuple[str, int | None, str]]):
        self.fs, self.base = _open(folder)
        self.files: OrderedDict = OrderedDict()
        self.held: OrderedDict = OrderedDict()
        self.slices = [(self.order(k, i), f) for k, i, f in slices]

    @staticmethod
    def order(key: str, page_id: int | None) -> tuple[bytes, int]:
        return key.encode(), _NO_ID if page_id is None else page_id

    def read(self, file: str, at: int, size: int) -> bytes:
        f = self.files.pop(file, None) or self.fs.open_input_file(f"{self.base}/{file}")
        self.files[file] = f
        if len(self.files) > 64:
            self.files.popitem(last=False)[1].close()
        return f.read_at(size, at)

    def _keep(self, where: tuple, load) -> list:
        if where not in self.held:
            self.held[where] = load()
            if len(self.held) > 128:
                self.held.popitem(last=False)
        self.held.move_to_end(where)
        return self.held[where]

    def directory(self, file: str) -> list[tuple[tuple[bytes, int], int, int]]:
        """Order, start and size of each block of one index file."""

        def load():
            with self.fs.open_input_stream(f"{self.base}/{file}.dir", compression=None) as f:
                rows = map(json.loads, zlib.decompress(f.read(), 31).decode().split("\n"))
            return [(self.order(k, i), at, size) for k, i, at, size in rows]

        return self._keep((file, -1), load)

    def block(self, file: str, at: int, size: int) -> list[tuple[tuple[bytes, int], str, int, int]]:
        """Order, archive, start and size of each capture of a block."""

        def load():
            split = (x.split(" ") for x in zlib.decompress(self.read(f"{file}.gz", at, size), 31).decode().split("\n"))
            return [(self.order(k, int(i) if i else None), f, int(a), int(s)) for k, i, f, a, s in split]

        return self._keep((file, at), load)

    def lookup(self, key: str, page_id: int | None) -> Iterator[bytes]:
        """The compressed records of a capture: the one, or all of those that repeat its key and id."""
        want = self.order(key, page_id)
        s = max(0, bisect_left(self.slices, want, key=lambda x: x[0]) - 1)
        for i in range(s, len(self.slices)):
            if self.slices[i][0] > want:
                return
            blocks = self.directory(self.slices[i][1])
            b = max(0, bisect_left(blocks, want, key=lambda x: x[0]) - 1)
            for j in range(b, len(blocks)):
                first, at, size = blocks[j]
                if first > want:
                    return
                lines = self.block(self.slices[i][1], at, size)
                for k in range(bisect_left(lines, want, key=lambda x: x[0]), len(lines)):
                    if lines[k][0] != want:
                        return
                    yield self.read(*lines[k][1:])

    def payload(self, key: str, page_id: int | None) -> bytes | None:
        """A capture's payload; that of a revisit is its response's, looked up in its turn."""
        for data in self.lookup(key, page_id):
            fields, payload = parse_record(data)
            if fields["WARC-Type"] == "response":
                return payload
            return self.payload(url_key(fields["WARC-Refers-To-Target-URI"]), int(fields["X-Refers-To-Page-ID"]))
        return None


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(pages: DataFrame, folder: str, slices: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Look every page's capture up by url key and page id, and read its record.

    Requests are dealt by ranges of the key, as the index is, so a task's lookups stay within a few
    slices and go through their blocks in order.  A response's digest is checked on its payload;
    a revisit takes its payload's length from the HTTP head that it repeats.
    """
    known = load_slices(slices)

    def ask(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(1).to_pylist()], pa.string()), batch.column(0)], names=["key", "page_id"])

    def scan(batches):
        reader = Reader(folder, known)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            rows: list[tuple] = []
            for k, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before = len(rows)
                rows += (_describe(page_id, data) for data in reader.lookup(k, page_id))
                if len(rows) == before:
                    raise ValueError(f"the index has no capture of page {page_id}")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    asked = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url")).mapInArrow(ask, "key string, page_id long")
    asked = materialize(asked.distinct(), "warc-requests")
    n = shuffle_partitions(pages.sparkSession)
    return asked.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(scan, RESULT)


def _describe(page_id: int | None, data: bytes) -> tuple:
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
    if fields["X-Page-ID"] != ("" if page_id is None else str(page_id)):
        raise ValueError(f"the index names page {page_id}, the record page {fields['X-Page-ID']}")
    if kind == "response":
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of page {page_id} does not have its digest")
        return page_id, len(payload), digest, kind, None
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return page_id, n, digest, kind, int(fields["X-Refers-To-Page-ID"])


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", folder: str | None = None) -> tuple[str, DataFrame]:
    """Write archives and their index under ``folder`` (else the shared scratch folder)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return folder, write_index(write_archives(pages, folder, key, url, html), folder)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archive all pages, then look every page up in the index and read its record back.

    A null html is an empty payload; null urls index under the empty key.  Of rows with an equal
    payload of 100 bytes or more the one with the smallest page id is the response (all of them,
    where rows repeat that id); rows without an id revisit it, and are responses if none has one.
    Long payloads are handled one record at a time; other columns don't stay.  An empty table gives
    an empty result.
    """
    folder, slices = archive_pages(pages, key, url, html)
    return read_archives(pages, folder, slices, key, url)


def iterate(folder: str, file: str) -> Iterator[dict[str, str]]:
    """The headers of all records of an archive, in file order, without an index."""
    fs, base = _open(folder)
    with fs.open_input_file(f"{base}/{file}") as f:
        data = f.read()
    while data:
        z = zlib.decompressobj(31)
        raw = z.decompress(data) + z.flush()
        yield dict(x.split(": ", 1) for x in raw.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
        data = z.unused_data
