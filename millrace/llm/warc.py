"""WARC archives of pages, deduplicated by payload, with a two-level capture index.

``write`` appends each page as a gzip member to an archive of its task; payloads move
between machines only if so many of them repeat that Spark does not broadcast the
repeated digests. The captures' lines (reversed-host URL key, id, archive, offset,
length, digest, type) are sorted by key and written to index files in compressed
blocks of ``LINES``; a sparse directory beside each index file holds the first key and
the place of each block, and the manifest the first and last key of each index file.

``lookup`` goes the way back: manifest, binary search in the sparse directory, range
read of a block, binary search in its lines, range read of the record.
``read_back`` reads all blocks, and the records they name in the archives' order.

Of records with equal payloads of at least ``least`` bytes the one with the smallest
page id is a response and the others revisit it. Null html is an empty payload, a
null URL an empty key. Rows that repeat the smallest id of their payload are all
responses; rows without an id come last, and revisit a page with an id if there is
one. An empty table gives no archive. Other columns are not read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .store import Appender, file_system, kept, partitions, read_range

LINES = 500
FILE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"
_URL = re.compile(r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", re.S)


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.a.com:80/X?q#f`` gives ``com,a)/x?q``."""
    if not url:
        return ""
    scheme, host, port, rest = _URL.match(url.strip()).groups()
    host = host.lower().strip(".")
    host = re.sub(r"^www\d*\.", "", host)
    if port in (None, "", {"http": "80", "https": "443"}.get((scheme or "").lower())):
        port = ""
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (rest.lower() if rest else "/")
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02x}", key)


def _identifier(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_identifier(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02x}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_identifier(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; payload is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["WARC-Record-ID"][len("<urn:page:"):-1]
    refers = fields.get("WARC-Refers-To", "<urn:page:none>")[len("<urn:page:"):-1]
    revisit = fields["WARC-Type"] == "revisit"
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if not revisit and len(payload) != length:
        raise ValueError("a payload is cut off")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
    return {"page_id": None if page == "none" else int(page), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": int(refers) if revisit and refers != "none" else None, "payload": None if revisit else payload}


def with_originals(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, first: the smallest id with the payload (null for small ones).

    Digests that occur more than once are written down first, so that Spark knows their
    size: it broadcasts a small table and else shuffles by digest and splits a hot one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    many = rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(kept(many, "warc-repeats"), "digest", "left")


_LINE = "key string, page_id long, archive string, at long, size long, digest string, type string"


def write(pages: DataFrame, folder: str, least: int = 100, lines: int = LINES) -> DataFrame:
    """Archives and index below ``folder``; returns the manifest."""
    import pyarrow as pa

    rows = with_originals(pages, least).select("page_id", "url", "payload", "digest", "first")

    def archives(batches):
        out = None
        for b in batches:
            made = []
            for page_id, url, payload, digest, first in zip(*[c.to_pylist() for c in b.columns]):
                if out is not None and out.size >= FILE_BYTES:
                    out.close()
                    out = None
                out = out or Appender(folder, ".warc.gz")
                revisit = first is not None and first != page_id
                raw = gzip.compress(record(page_id, url, payload, digest, first, revisit), 4, mtime=0)
                made.append((url_key(url), page_id, out.uri, out.write(raw), len(raw), digest, "revisit" if revisit else "response"))
            if made:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["key", "page_id", "archive", "at", "size", "digest", "type"])
        if out is not None:
            out.close()

    captures = kept(rows.mapInArrow(archives, _LINE), "warc-captures")
    ordered = captures.repartitionByRange("key", "page_id", "archive", "at").sortWithinPartitions(
        "key", F.col("page_id").asc_nulls_last(), "archive", "at")

    def index(batches):
        out = None
        for b in batches:
            for line in zip(*[c.to_pylist() for c in b.columns]):
                out = out or _Index(folder, lines)
                out.add(line)
                if out.out.size >= FILE_BYTES:
                    yield pa.RecordBatch.from_pylist([out.close()])
                    out = None
        if out is not None:
            yield pa.RecordBatch.from_pylist([out.close()])

    schema = "first_key string, last_key string, index string, directory string, n_records long, n_blocks long"
    return kept(ordered.mapInArrow(index, schema), "warc-manifest")


class _Index:
    """An index file with its directory while they are written."""

    def __init__(self, folder: str, lines: int):
        self.out, self.folder, self.lines = Appender(folder, ".cdx"), folder, lines
        self.block, self.directory, self.n = [], [], 0
        self.first_key = self.last_key = None

    def add(self, line: tuple) -> None:
        self.first_key = line[0] if self.first_key is None else self.first_key
        self.last_key = line[0]
        self.block.append(line)
        self.n += 1
        if len(self.block) >= self.lines:
            self.flush()

    def flush(self) -> None:
        if self.block:
            raw = zlib.compress("\n".join(map(json.dumps, self.block)).encode(), 6)
            self.directory.append([self.block[0][0], self.out.write(raw), len(raw), len(self.block)])
            self.block = []

    def close(self) -> dict:
        self.flush()
        self.out.close()
        sparse = Appender(self.folder, ".dir")
        sparse.write(json.dumps(self.directory).encode())
        sparse.close()
        return {"first_key": self.first_key, "last_key": self.last_key, "index": self.out.uri, "directory": sparse.uri,
                "n_records": self.n, "n_blocks": len(self.directory)}


def _read(uri: str) -> bytes:
    system, path = file_system(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def _lines(uri: str, at: int, size: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(read_range(uri, at, size)).decode().split("\n")]


def read_back(manifest: DataFrame) -> DataFrame:
    """Every record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The index blocks' lines go to tasks by stretches of the archives, and a task
    fetches records that lie side by side in one range of a few MB.
    """
    import pyarrow as pa

    spark = manifest.sparkSession

    def blocks(batches):
        for b in batches:
            for r in b.to_pylist():
                found = [{"index": r["index"], "at": at, "size": size} for _, at, size, _ in json.loads(_read(r["directory"]))]
                yield pa.RecordBatch.from_pylist(found)

    def captures(batches):
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pylist([{"archive": x[2], "at": x[3], "size": x[4]} for x in _lines(r["index"], r["at"], r["size"])])

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def records(batches):
        for b in batches:
            places = list(zip(*[c.to_pylist() for c in b.columns]))
            k = 0
            while k < len(places):
                archive, base, size = places[k]
                m, end = k + 1, base + size
                while m < len(places) and places[m][:2] == (archive, end) and end - base < 4 << 20:
                    end += places[m][2]
                    m += 1
                raw = memoryview(read_range(archive, base, end - base))
                found = [parse(zlib.decompress(raw[at - base: at - base + n], 31)) for _, at, n in places[k:m]]
                yield pa.RecordBatch.from_pylist([{c: x[c] for c in names} for x in found], kinds)
                k = m

    n = partitions(spark)
    listed = manifest.select("index", "directory").repartition(n, "index").mapInArrow(blocks, "index string, at long, size long")
    lines = listed.repartition(n, "index", "at").mapInArrow(captures, "archive string, at long, size long")
    spread = lines.repartition(n, "archive", F.floor(F.col("at") / (8 << 20))).sortWithinPartitions("archive", "at")
    return spread.mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


class Index:
    """Lookups by URL over a manifest's rows; directories are read when first needed."""

    def __init__(self, rows: list[dict]):
        self.rows = sorted(rows, key=lambda r: (r["first_key"], r["last_key"]))
        self.directories: dict[str, list] = {}

    def captures(self, url: str | None) -> list[dict]:
        """Records of a URL's key, in order of their ids, from all index files that may hold it."""
        key, out = url_key(url), []
        for r in self.rows[: bisect.bisect_right([r["first_key"] for r in self.rows], key)]:
            if r["last_key"] < key:
                continue
            directory = self.directories.get(r["directory"])
            if directory is None:
                directory = self.directories[r["directory"]] = json.loads(_read(r["directory"]))
            firsts = [x[0] for x in directory]
            # The block before the first that begins at the key may end with it.
            k = max(0, bisect.bisect_left(firsts, key) - 1)
            while k < len(directory) and firsts[k] <= key:
                lines = _lines(r["index"], directory[k][1], directory[k][2])
                keys = [x[0] for x in lines]
                for x in lines[bisect.bisect_left(keys, key): bisect.bisect_right(keys, key)]:
                    out.append(parse(zlib.decompress(read_range(x[2], x[3], x[4]), 31)))
                k += 1
        return out


def lookup(urls: DataFrame, manifest: DataFrame, url: str = "url") -> DataFrame:
    """Captures of many URLs: url, page_id, record_type, payload_digest, payload_bytes.

    Every task searches the manifest, which has a row per index file.
    """
    import pyarrow as pa

    sent = urls.sparkSession.sparkContext.broadcast([r.asDict() for r in manifest.collect()])
    kinds = pa.schema([("url", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])

    def found(batches):
        index = Index(sent.value)
        for b in batches:
            for u in b.column(0).to_pylist():
                rows = [{"url": u, **{c: x[c] for c in kinds.names[1:]}} for x in index.captures(u)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    return urls.select(url).mapInArrow(found, "url string, page_id long, record_type string, payload_digest string, payload_bytes long")


def archive(spark: SparkSession, pages: DataFrame, least: int = 100) -> DataFrame:
    """Write ``pages`` below the shared folder and return the manifest."""
    return write(pages, scratch_path(spark, "warc"), least)
