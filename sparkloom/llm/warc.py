"""WARC archives with a two-level capture index.

Writing: each task compresses its records one by one (one gzip member each) into archive files in the shared folder and
reports a *capture line* per record: key, file, offset, length. A key is the URL with its host reversed
(``com,example,www)/path``), so that the pages of a site stand together. The lines, sorted by key over
the whole table, are written as index files of compressed blocks; each file ends in a sparse directory, the
first key, offset and length of every block.

Reading: the first keys of the index files, one per file, tell which files can hold a key; in a file the
directory is searched by bisection, the blocks that can hold the key are read by range, and so are the records their
lines point at. A file is only used if its lines were committed, so what a lost task has left is never read.

Files are reached through ``pyarrow.fs``, by the URI of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.llm.common import require
from sparkloom.session import stage, stage_path

BLOCK_LINES = 512
ARCHIVE_BYTES = 64 << 20
DEDUP_BYTES = 1000
_LEVEL = 3
_DATE = "2020-01-01T00:00:00Z"
_OPEN_FILES = 32


def shared_uri(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, as a URI that names its store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(stage_path(spark, name))
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def capture_key(url: Column) -> Column:
    """Reversed-host key of a URL: without scheme, user, default port and fragment; empty for null."""
    shape = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)([^#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_replace(F.regexp_extract(whole, shape, 1), r"^.*@|:(?:80|443)$", ""))
    rest = F.regexp_extract(whole, shape, 2)
    reversed_host = F.array_join(F.reverse(F.split(host, r"\.")), ",")
    return F.when(whole == "", F.lit("")).otherwise(F.concat(reversed_host, F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest)))


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = ("".join(f"%{ord(c):02X}" if ord(c) < 33 or c == "\x7f" else c for c in v) if k == "WARC-Target-URI" else v for k, v in fields)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for (k, _), v in zip(fields, clean)) + "\r\n").encode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit without it."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    return _header(fields) + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record. The length of a revisit's payload is in its HTTP header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload-length"] = next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:]
    return fields, payload


def plan_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to, key): the records to write.

    Of records with equal payloads of at least ``DEDUP_BYTES``, that with the largest id is the response and the
    others revisit it. Rows that repeat this id are responses too; records without an id revisit, if any has one.
    """
    require(pages, id_col, url, html)
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    large = F.col("size") >= DEDUP_BYTES
    # only payloads that occur again need to be known
    holders = rows.filter(large).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1").drop("n")
    other = large & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    met = rows.join(holders, "digest", "left").withColumn("refers_to", F.when(other, F.col("holder")))
    # a revisit is written without its payload
    return met.select(
        "page_id", "url", F.when(~other, F.col("payload")).alias("payload"), "digest", "size", "refers_to", capture_key(F.col("url")).alias("key")
    )


def _store(base: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(base)


def _archive(base: str):
    """Batches of planned records to capture lines, while the records go to archive files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(base)
        file, name, at = None, "", 0
        for batch in batches:
            lines = []
            columns = [batch.column(k) for k in range(batch.num_columns)]
            for row in range(batch.num_rows):
                page_id, url, payload, digest, size, refers_to, key = (c[row].as_py() for c in columns)
                if file is None or at >= ARCHIVE_BYTES:
                    if file is not None:
                        file.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    store.create_dir(folder, recursive=True)
                    file = store.open_output_stream(f"{folder}/{name}", compression=None)
                member = gzip.compress(make_record(page_id, url, payload or b"", digest, size, refers_to), _LEVEL, mtime=0)
                file.write(member)
                lines.append({"key": key, "page_id": page_id, "file": name, "offset": at, "length": len(member)})
                at += len(member)
            if lines:
                yield pa.RecordBatch.from_pylist(lines, schema=_LINE)
        if file is not None:
            file.close()

    return run


_LINE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_LINE_FIELDS = "key string, page_id long, file string, offset long, length long"


def write_archives(pages: DataFrame, base: str, **columns: str) -> DataFrame:
    """Write a record for every row of ``pages`` to archives below ``base``; returns the staged capture lines."""
    records = plan_records(pages, **columns)
    return stage(records.mapInArrow(_archive(base), _LINE_FIELDS), "captures")


def _index(base: str):
    """Sorted capture lines of one partition to one index file; gives its name, first and last key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(base)
        name, at, directory, held, last = f"{uuid.uuid4().hex}.cdx", 0, [], [], None
        file = None

        def flush() -> None:
            nonlocal at, file
            if file is None:
                store.create_dir(folder, recursive=True)
                file = store.open_output_stream(f"{folder}/{name}", compression=None)
            block = zlib.compress("\n".join(json.dumps(x) for x in held).encode(), _LEVEL)
            file.write(block)
            directory.append((held[0][0], at, len(block)))
            at += len(block)
            held.clear()

        for batch in batches:
            for line in zip(*(batch.column(k).to_pylist() for k in range(5))):
                held.append(line)
                last = line[0]
                if len(held) >= BLOCK_LINES:
                    flush()
        if held:
            flush()
        if file is not None:
            tail = zlib.compress(json.dumps(directory).encode(), _LEVEL)
            file.write(tail + struct.pack("<Q", len(tail)))
            file.close()
            yield pa.record_batch([[name], [directory[0][0]], [last]], names=["index", "first_key", "last_key"])

    return run


def write_index(captures: DataFrame, base: str) -> DataFrame:
    """Write the index of capture lines below ``base``; returns (index, first_key, last_key), staged, one row per file."""
    dealt = captures.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return stage(dealt.mapInArrow(_index(base), "index string, first_key string, last_key string"), "index")


class _Files:
    """Files open for range reads, the last few of them."""

    def __init__(self, base: str) -> None:
        self.store, self.folder = _store(base)
        self.open: OrderedDict = OrderedDict()

    def read(self, name: str, offset: int, length: int) -> bytes:
        file = self.open.pop(name, None) or self.store.open_input_file(f"{self.folder}/{name}")
        self.open[name] = file
        if len(self.open) > _OPEN_FILES:
            self.open.popitem(last=False)[1].close()
        return file.read_at(length, offset)

    def size(self, name: str) -> int:
        return self.store.get_file_info(f"{self.folder}/{name}").size


class _IndexFile:
    def __init__(self, files: _Files, name: str) -> None:
        self.files, self.name = files, name
        size = files.size(name)
        (length,) = struct.unpack("<Q", files.read(name, size - 8, 8))
        self.directory = json.loads(zlib.decompress(files.read(name, size - 8 - length, length)))
        self.keys = [entry[0] for entry in self.directory]
        self.held: tuple[int, list] = (-1, [])

    def lines(self, key: str) -> Iterator[list]:
        """Capture lines of a key: bisection over the first keys, then range reads while blocks can hold it."""
        block = max(0, bisect.bisect_left(self.keys, key) - 1)
        while block < len(self.keys) and self.keys[block] <= key:
            if self.held[0] != block:
                raw = self.files.read(self.name, self.directory[block][1], self.directory[block][2])
                self.held = block, [json.loads(x) for x in zlib.decompress(raw).decode().split("\n")]
            rows = self.held[1]
            at = bisect.bisect_left(rows, key, key=lambda r: r[0])
            while at < len(rows) and rows[at][0] == key:
                yield rows[at]
                at += 1
            block += 1


def _choose_files(bounds: list[tuple[str, str, str]]):
    """Batches of keys to (index, key) for each index file that can hold the key. ``bounds`` rise by first key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [b[1] for b in bounds], [b[2] for b in bounds]
        for batch in batches:
            names, keys = [], []
            for key in batch.column(0).to_pylist():
                for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                    names.append(bounds[k][0])
                    keys.append(key)
            if keys:
                yield pa.record_batch([pa.array(names), pa.array(keys)], names=["index", "key"])

    return run


def _find_lines(base: str):
    """(index, key) rows, sorted, to the capture lines found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, index = _Files(base), None
        for batch in batches:
            found = []
            for name, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if index is None or index.name != name:
                    index = _IndexFile(files, name)
                for line in index.lines(key):
                    found.append(dict(zip(_LINE.names, line)))
                    if len(found) >= 4 * BLOCK_LINES:
                        yield pa.RecordBatch.from_pylist(found, schema=_LINE)
                        found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=_LINE)

    return run


def look_up(keys: DataFrame, index: DataFrame, base: str, key: str = "key") -> DataFrame:
    """Capture lines of the given keys (distinct): one row per capture.

    Only the first and last key of every index file, as many as the index has partitions, go through the driver.
    """
    bounds = sorted(((r["index"], r["first_key"], r["last_key"]) for r in index.collect()), key=lambda b: (b[1], b[2]))
    chosen = keys.select(F.col(key).alias("key")).mapInArrow(_choose_files(bounds), "index string, key string")
    dealt = chosen.repartition("index").sortWithinPartitions("index", "key")
    return dealt.mapInArrow(_find_lines(base), _LINE_FIELDS)


def _read(base: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(base)
        for batch in batches:
            out = []
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                fields, payload = parse_record(gzip.decompress(files.read(file, offset, length)))
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {file} at {offset} does not match its digest")
                row = {
                    "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
                    "url": fields.get("WARC-Target-URI"),
                    "record_type": fields["WARC-Type"],
                    "payload_bytes": int(fields["payload-length"]),
                    "payload_digest": digest,
                    "refers_to": int(fields["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in fields else None,
                }
                if with_payload:
                    row["payload"] = payload if fields["WARC-Type"] == "response" else None
                out.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_RECORD if not with_payload else _RECORD.append(pa.field("payload", pa.binary())))

    return run


_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
)
_RECORD_FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read_records(lines: DataFrame, base: str, with_payload: bool = False) -> DataFrame:
    """The records that capture lines point at, by range reads; payloads of responses are checked against their digests."""
    fields = _RECORD_FIELDS + (", payload binary" if with_payload else "")
    return lines.select(*_LINE.names).mapInArrow(_read(base, with_payload), fields)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write every page, index the archives, look every URL up, and return the records found: one row per page.

    Defined results: null html is an empty payload; a null url has the empty key and no target in its record; rows
    without an id are written and read like others; wholly equal rows have a record each; other columns are not
    read. An empty table writes no file and gives no rows. Jobs run when this is called.
    """
    base = shared_uri(pages.sparkSession, "warc")
    captures = write_archives(pages, base, id_col=id_col, url=url, html=html)
    index = write_index(captures, base)
    keys = pages.select(capture_key(F.col(url)).alias("key")).distinct()
    return read_records(look_up(keys, index, base), base)
