"""Operator 5: WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import bisect
import gzip
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

#: Captures in a compressed index block; bytes after which a new archive is begun.
BLOCK_LINES, ARCHIVE_BYTES = 256, 32_000_000
#: Payloads shorter than this are written in full each time.
LEAST_BYTES = 0

INDEX = "key string, file string, at long, size long"


# -- storage ---------------------------------------------------------------------------


def store(root: str):
    """The file system and path of a uri: a shared folder, an object store or HDFS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class Writer:
    """A new file under a name that no other attempt of the task has. It counts once closed."""

    def __init__(self, root: str, kind: str):
        files, path = store(root)
        self.name, self.at = f"{kind}-{uuid.uuid4().hex}", 0
        files.create_dir(path, recursive=True)
        self.out = files.open_output_stream(f"{path}/{self.name}", compression=None)

    def add(self, data: bytes) -> tuple[int, int]:
        begin = self.at
        self.out.write(data)
        self.at += len(data)
        return begin, len(data)


class Reader:
    """Range reads; the file read last stays open."""

    def __init__(self, root: str):
        self.files, self.path = store(root)
        self.name, self.open = None, None

    def read(self, name: str, at: int, size: int) -> bytes:
        if name != self.name:
            self.name, self.open = name, self.files.open_input_file(f"{self.path}/{name}")
        return self.open.read_at(size, at)


# -- records ---------------------------------------------------------------------------


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record as a gzip member of its own. A revisit keeps the HTTP head, not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        # Line ends would end the field, so control characters are percent-encoded.
        fields.append(("WARC-Target-URI", "".join(quote(c) if c < " " or c == "\x7f" else c for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:x-page:{'' if refers_to is None else refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 3, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Fields of the record, fields of its HTTP head, payload."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def page_number(urn: str) -> int | None:
    n = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(n) if n else None


# -- keys ------------------------------------------------------------------------------


def url_key(url: Column, page_id: Column) -> Column:
    """Sort key of a capture: host labels reversed, the rest of the url, then the page.

    ``https://www.example.com/a`` sorts as ``com,example,www)/a``. Keys compare by code
    points; ids are shifted and padded so that they sort as numbers, null first.
    """
    text = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(text, r"(?s)^[^/?#]*?://", "")
    host = common.ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    number = F.lpad((page_id.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail, F.lit(" "), F.coalesce(number, F.lit("")))


# -- writing ---------------------------------------------------------------------------


def decisions(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, sha, first_id, revisit: of equal payloads the smallest id is the response."""
    rows = common.materialise(pages.select("page_id", F.sha1(_payload()).alias("sha"), F.octet_length(_payload()).alias("bytes")), "payloads")
    groups = common.materialise(rows.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("captures")), "digests")
    found = common.with_groups(rows, groups, ["sha"], "captures")
    revisit = (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.select("page_id", "sha", "first_id", revisit.alias("revisit")).distinct()


def _payload() -> Column:
    return F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")


def write_archives(pages: DataFrame, root: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per row into archives under ``root``; key, file, at, size of each."""
    decided = decisions(pages, least_bytes).select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "first_id", "revisit")
    rows = pages.select("page_id", "url", "html", F.sha1(_payload()).alias("sha"), url_key(F.col("url"), F.col("page_id")).alias("key"))
    # Ids come first in the key of the shuffle, so copies of a payload do not meet in one task.
    rows = rows.join(decided, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha"))).drop("_id", "_sha")

    def write(batches):
        held: list[tuple] = []
        out = None

        def close():
            out.out.close()
            batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=["key", "file", "at", "size"])
            held.clear()
            return batch

        for page_id, url, html, sha, key, first_id, revisit in tokens.rows(batches, "page_id", "url", "html", "sha", "key", "first_id", "revisit"):
            out = out or Writer(root, "archive")
            held.append((key, out.name, *out.add(record(page_id, url, (html or "").encode(), base32(sha), first_id, revisit))))
            if out.at >= archive_bytes:
                yield close()
                out = None
        if out:
            yield close()

    # The rows name the files of the attempts that count, so they are written down at once.
    return common.materialise(rows.mapInArrow(write, INDEX), "captures")


def write_index(captures: DataFrame, root: str, shards: int, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts captures by key into shards of compressed blocks; first, file, at, size of each directory.

    A shard file is its blocks and then its sparse directory: the first key, place and
    size of each block. What comes back has one row per shard.
    """

    def write(batches):
        out, directory, lines = None, [], []

        def block():
            data = zlib.compress(b"".join(lines), 6)
            directory.append([json.loads(lines[0])[0], *out.add(data)])
            lines.clear()

        for row in tokens.rows(batches, "key", "file", "at", "size"):
            out = out or Writer(root, "index")
            lines.append(json.dumps(row).encode() + b"\n")
            if len(lines) >= block_lines:
                block()
        if out:
            if lines:
                block()
            at, size = out.add(zlib.compress(json.dumps(directory).encode(), 6))
            out.out.close()
            yield pa.RecordBatch.from_pydict({"key": [directory[0][0]], "file": [out.name], "at": [at], "size": [size]})

    ordered = captures.repartitionByRange(shards, "key").sortWithinPartitions("key")
    return common.materialise(ordered.mapInArrow(write, INDEX), "shards")


# -- reading ---------------------------------------------------------------------------


class Shard:
    """One shard of the index: binary search in its directory, then range reads of blocks."""

    def __init__(self, reader: Reader, file: str, at: int, size: int):
        self.reader, self.file = reader, file
        self.directory = json.loads(zlib.decompress(reader.read(file, at, size)))
        self.firsts = [d[0] for d in self.directory]
        self.number, self.lines, self.keys = None, [], []

    def block(self, n: int) -> None:
        if n != self.number:
            _, at, size = self.directory[n]
            self.lines = [json.loads(x) for x in zlib.decompress(self.reader.read(self.file, at, size)).splitlines()]
            self.number, self.keys = n, [x[0] for x in self.lines]

    def find(self, key: str) -> Iterator[list]:
        # The block before the first one that begins with the key may end with it.
        n = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while n < len(self.firsts) and self.firsts[n] <= key:
            self.block(n)
            yield from self.lines[bisect.bisect_left(self.keys, key) : bisect.bisect_right(self.keys, key)]
            n += 1


def look_up(keys: DataFrame, root: str, shards: DataFrame) -> DataFrame:
    """The captures (key, file, at, size) of the distinct keys in ``keys``.

    The driver holds one row per shard, whose number is a parameter of the index. Keys
    go to the tasks of their shards: one that ends where the next begins is in both.
    """
    listed = sorted((r.key, r.file, r.at, r.size) for r in shards.collect())
    firsts = [r[0] for r in listed]

    def route(batches):
        for batch in batches:
            found, of = [], []
            for key in batch.column(0).to_pylist():
                n = max(0, bisect.bisect_left(firsts, key) - 1)
                while n < len(firsts) and firsts[n] <= key:
                    found.append(key)
                    of.append(n)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(of, pa.int32())], names=["key", "shard"])

    def search(batches):
        reader, number, shard = Reader(root), None, None
        for batch in batches:
            out = []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n != number:
                    number, shard = n, Shard(reader, *listed[n][1:])
                out += shard.find(key)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "at", "size"])

    routed = keys.select("key").distinct().mapInArrow(route, "key string, shard int")
    return routed.repartition(max(1, len(listed)), "shard").sortWithinPartitions("shard", "key").mapInArrow(search, INDEX)


def read_records(captures: DataFrame, root: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of captures.

    Each record is a range read. A response's payload is checked against its digest;
    what a revisit leaves out is null.
    """
    import hashlib

    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def read(batches):
        reader = Reader(root)
        for batch in batches:
            rows = []
            for file, at, size in tokens.rows([batch], "file", "at", "size"):
                fields, http, payload = parse(reader.read(file, at, size))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response" and base32(hashlib.sha1(payload).hexdigest()) != digest:
                    raise ValueError(f"{file} at {at}: the payload differs from its digest")
                refers = page_number(fields["WARC-Refers-To"]) if kind == "revisit" else None
                rows.append((page_number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), int(http["Content-Length"]), digest, kind, refers, payload if kind == "response" else None))
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    near = captures.repartition("file", F.floor(F.col("at") / 4_000_000)).sortWithinPartitions("file", "at")
    return near.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive(pages: DataFrame, least_bytes: int = LEAST_BYTES, shards: int | None = None, block_lines: int = BLOCK_LINES, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Writes archives and index into a new shared folder; its uri and the shards."""
    root = common.new_folder(pages.sparkSession, "warc")
    shards = shards or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    captures = write_archives(pages, root, least_bytes, archive_bytes)
    return root, write_index(captures, root, shards, block_lines)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES, **sizes) -> DataFrame:
    """Archives all pages and reads every one back through the index.

    One row per input row: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Null html is an empty payload; a null url has no target uri and the
    empty key. Of equal payloads of at least ``least_bytes`` bytes, rows with the smallest id are responses
    (each of them, if a row repeats) and the rest revisits; a null id ranks behind all
    others. No rows in, no rows out; other columns are ignored.
    """
    pages = pages.select("page_id", "url", "html")
    root, shards = archive(pages, least_bytes, **sizes)
    captures = look_up(pages.select(url_key(F.col("url"), F.col("page_id")).alias("key")), root, shards)
    return read_records(captures, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "pages"))
