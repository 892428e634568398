"""WARC archives of pages, and a two-level capture index to read them back by URL.

Tasks write the records, each a gzip member of its own, to files in a shared folder, and report where each lies. The
captures are then sorted over all files by their reversed-host key: every range of keys becomes a file of index lines in
compressed blocks with a sparse directory of its blocks beside it, and the first and last key of each range stay with
the archive. A lookup takes the range by binary search in those, the block by binary search in the range's directory,
reads the block by its byte range and searches its lines; the records are read by byte range in file order.

A file counts once its task's rows are committed; what a lost task wrote is named in no index. A URL of very many
captures lies in several ranges, and each of them is looked up by itself. Copies are told from digests; only copied
payloads' digests travel, in a counted broadcast, and beyond it the commonest of them do.

Defined results: null html is an empty payload; a null URL has the empty key and a record without target; white space
and control characters of a URL are percent-encoded; a null page_id is smaller than any other, has no record id of its
own and refers to the largest of its copies; a repeated row is written again, as what the first is; no pages give an
archive without records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import BROADCAST_ROWS, cut, shared_folder

#: Payloads below so many bytes are always stored whole.
REVISIT_BYTES = 1000
#: An archive file is closed beyond so many bytes; lines of an index block; lines of an index range, about.
FILE_BYTES, BLOCK_LINES, RANGE_LINES = 1 << 30, 3000, 1_000_000
#: Records that lie side by side are read together up to so many bytes; a task reads about so many.
READ_BYTES, TASK_BYTES = 4 << 20, 256 << 20
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ENTRY = "key string, date string, url string, type string, digest string, file string, offset long, length long"
RECORD = "page_id long, url string, date string, record_type string, payload_digest string, payload_bytes long, refers_to long"
_PORTS = {"http": 80, "https": 443}


def safe_url(url: str) -> str:
    """The URL without white space or control characters, which would end a header line or an index field."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def surt(url: str | None) -> str:
    """The sort key of a URL: host names from the top domain down, then path and query; no scheme, user, www. or fragment."""
    url = safe_url(url or "")
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    names = host if re.fullmatch(r"[0-9.]+|.*:.*", host) else ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{names}{f':{port}' if port and port != _PORTS.get(parts.scheme) else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _sha1(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(record: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record or "")
    return int(found[1]) if found else None


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    return _member("\r\n".join(lines).encode() + block + b"\r\n\r\n")


def capture(page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, refers: int | None = None, refers_url: str | None = None) -> bytes:
    """A response record, or a revisit that holds the HTTP headers alone; digest: the payload's SHA-1 in hexadecimal."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers is not None
    block = http if revisit else http + payload
    return _record(
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", date),
            ("WARC-Target-URI", None if url is None else safe_url(url)),
            ("WARC-Payload-Digest", _sha1(digest)),
            ("WARC-Block-Digest", _sha1(hashlib.sha1(block).hexdigest())),
            ("WARC-Profile", PROFILE if revisit else None),
            ("WARC-Refers-To", record_id(refers) if revisit else None),
            ("WARC-Refers-To-Target-URI", safe_url(refers_url) if revisit and refers_url is not None else None),
            ("WARC-Refers-To-Date", date if revisit else None),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def _headers(raw: bytes) -> tuple[str, dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def parse(member: bytes) -> tuple[dict[str, str], bytes | None, int]:
    """Headers of a stored record, its payload (None in a revisit) and the full payload's size.

    A record whose lengths or digests don't agree with its bytes raises a ValueError.
    """
    first, headers, rest = _headers(zlib.decompress(member, 31))
    block = rest[: int(headers["content-length"])]
    if first != VERSION or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"broken record {headers.get('warc-record-id')}")
    _, http, payload = _headers(block)
    if headers["warc-type"] == "revisit":
        return headers, None, int(http["content-length"])
    if len(payload) != int(http["content-length"]) or _sha1(hashlib.sha1(payload).hexdigest()) != headers["warc-payload-digest"]:
        raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
    return headers, payload, len(payload)


def _store(folder: str) -> tuple[FileSystem, str]:
    """The file system that a folder's URI names, and the folder's path in it."""
    return FileSystem.from_uri(folder)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([pa.field(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def with_copies(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers, refers_url) of every page; refers: whom an equal payload's revisit names."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    own = own.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"), F.xxhash64("payload").alias("check"))
    key = ["digest", "size", "check"]
    groups = own.where(F.col("size") >= min_bytes).groupBy(*key).agg(F.max(F.struct("page_id", "url")).alias("kept"), F.count("*").alias("n"))
    copied = cut(groups.where("n > 1 and kept.page_id is not null").select(*key, "n", F.col("kept.page_id").alias("refers"), F.col("kept.url").alias("refers_url")), "copied")
    few = copied.orderBy(F.desc("n"), *key).limit(BROADCAST_ROWS)
    many = copied.count() > BROADCAST_ROWS
    out = own.join(F.broadcast(few.drop("n") if many else copied.drop("n")), key, "left")
    if many:
        # Found ones get a key of their own, so that the commonest payloads don't gather in the second join.
        rest = copied.join(few.select(*key), key, "left_anti").select(F.concat_ws("-", *key).alias("rest"), F.col("refers").alias("refers_2"), F.col("refers_url").alias("url_2"))
        open_ = F.when(F.col("refers").isNull() & (F.col("size") >= min_bytes), F.concat_ws("-", *key)).otherwise(F.concat(F.lit("!"), F.uuid()))
        out = out.withColumn("rest", open_).join(rest.hint("merge"), "rest", "left").withColumn("refers_url", F.coalesce("refers_url", "url_2")).withColumn("refers", F.coalesce("refers", "refers_2"))
    revisit = F.col("refers").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers"))
    return out.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("refers")).alias("refers"), F.when(revisit, F.col("refers_url")).alias("refers_url"))


class Archive:
    """Archive files and their index in one folder; ranges: (first key, last key, index file), in order; size: bytes of all records."""

    def __init__(self, spark: SparkSession, folder: str, ranges: list[tuple[str, str, str]], size: int) -> None:
        self.spark, self.folder, self.ranges, self.size = spark, folder, ranges, size

    def lookup(self, urls: DataFrame) -> DataFrame:
        """The captures of all URLs of a table (url), each capture once."""
        folder = self.folder
        # Two keys a range of about a million captures: the one part of the index that every task holds.
        tops = self.spark.sparkContext.broadcast(([r[0] for r in self.ranges], [r[1] for r in self.ranges], [r[2] for r in self.ranges]))

        def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            firsts, lasts, _ = tops.value
            schema = _schema("place int, key string")
            for batch in batches:
                keys = {surt(u) for u in batch.column(0).to_pylist()}
                yield _batch([(i, k) for k in sorted(keys) for i in range(bisect_left(lasts, k), bisect_right(firsts, k))], schema)

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, blocks, rows, schema = None, None, [], _schema(ENTRY)
            for batch in batches:
                for at, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if at != place:
                        place, blocks = at, _Blocks(folder, tops.value[2][at])
                    for row in blocks.captures(key):
                        rows.append(row)
                        if len(rows) >= 10_000:
                            yield _batch(rows, schema)
                            rows = []
            yield _batch(rows, schema)

        wanted = urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(located, "place int, key string").distinct()
        return wanted.repartition("place").sortWithinPartitions("place", "key").mapInArrow(found, ENTRY)

    def fetch(self, captures: DataFrame, payload: bool = False) -> DataFrame:
        """The records of captures, read by byte range in file order; with their payload if asked for."""
        folder, ddl = self.folder, RECORD + (", payload binary" if payload else "")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, path = _store(folder)
            schema, name, file = _schema(ddl), None, None
            for batch in batches:
                rows, held = [], 0
                files, offsets, lengths = (batch.column(i).to_pylist() for i in range(3))
                i = 0
                while i < len(files):
                    j, end = i + 1, offsets[i] + lengths[i]
                    while j < len(files) and files[j] == files[i] and offsets[j] == end and end - offsets[i] < READ_BYTES:
                        end += lengths[j]
                        j += 1
                    if files[i] != name:
                        name, file = files[i], store.open_input_file(f"{path}/{files[i]}")
                    raw = memoryview(file.read_at(end - offsets[i], offsets[i]))
                    for k in range(i, j):
                        at = offsets[k] - offsets[i]
                        h, body, size = parse(raw[at : at + lengths[k]])
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        row = (_page(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-date"], h["warc-type"], digest, size, _page(h.get("warc-refers-to")))
                        rows.append((*row, body) if payload else row)
                        held += len(body or b"") if payload else 0
                    if held > READ_BYTES:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                    i = j
                yield _batch(rows, schema)

        # The spans are small beside the records behind them, so their size is no measure of a task's work.
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(self.size / TASK_BYTES))
        spans = captures.select("file", "offset", "length").repartition(tasks, "file", F.floor(F.col("offset") / READ_BYTES))
        return spans.sortWithinPartitions("file", "offset").mapInArrow(read, ddl)


class _Blocks:
    """The blocks of one index range, found in its directory and read one at a time."""

    def __init__(self, folder: str, name: str) -> None:
        store, path = _store(folder)
        lines = store.open_input_file(f"{path}/{name}.idx").readall().decode().split("\n")
        self.file = store.open_input_file(f"{path}/{name}")
        entries = [x.rsplit(" ", 2) for x in lines]
        self.firsts = [x[0] for x in entries]
        self.spans = [(int(x[1]), int(x[2])) for x in entries]
        self.number, self.keys, self.lines = None, [], []

    def _open(self, number: int) -> None:
        if number != self.number:
            offset, length = self.spans[number]
            lines = zlib.decompress(self.file.read_at(length, offset), 31).decode().split("\n")
            cut_up = [x.split(" ", 2) for x in lines]
            self.number, self.keys, self.lines = number, [x[0] for x in cut_up], cut_up

    def captures(self, key: str) -> Iterator[tuple]:
        # The block before the first that starts with the key may end with it.
        for number in range(max(bisect_left(self.firsts, key) - 1, 0), bisect_right(self.firsts, key)):
            self._open(number)
            for at in range(bisect_left(self.keys, key), bisect_right(self.keys, key)):
                x = json.loads(self.lines[at][2])
                yield key, self.lines[at][1], x["url"], x["type"], x["digest"], x["filename"], x["offset"], x["length"]


def write_records(pages: DataFrame, folder: str, date: str, min_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per page and returns the captures: key, URL, date, kind, digest and the bytes where each lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        schema, out, name, at = _schema(ENTRY), None, "", 0
        for batch in batches:
            rows = []
            # Rows are taken one by one, so a batch's payloads are never held twice.
            for page_id, url, payload, digest, refers, refers_url in zip(*batch.columns):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    at = len(info)
                url, refers, digest = url.as_py(), refers.as_py(), digest.as_py()
                member = capture(page_id.as_py(), url, payload.as_py(), digest, date, refers, refers_url.as_py())
                out.write(member)
                rows.append((surt(url), date, url, "response" if refers is None else "revisit", digest, name, at, len(member)))
                at += len(member)
            yield _batch(rows, schema)
        if out is not None:
            out.close()

    return cut(with_copies(pages, min_bytes).mapInArrow(run, ENTRY), "captures")


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, range_lines: int = RANGE_LINES) -> list[tuple[str, str, str]]:
    """Sorts the captures over all files and writes ranges of blocks, each with its directory; returns the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        out, name, at, first, last, lines, directory = None, "", 0, "", "", [], []

        def close_block() -> None:
            nonlocal at, lines
            member = _member("\n".join(lines).encode())
            directory.append(f"{lines[0].split(' ', 1)[0]} {at} {len(member)}")
            out.write(member)
            at, lines = at + len(member), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, date, url, kind, digest, file, offset, length = row
                if out is None:
                    name, first = f"index-{uuid.uuid4().hex}.cdxj.gz", key
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                last = key
                lines.append(f"{key} {date} " + json.dumps({"url": url, "type": kind, "digest": digest, "filename": file, "offset": offset, "length": length}))
                if len(lines) == block_lines:
                    close_block()
        if out is None:
            return
        if lines:
            close_block()
        out.close()
        with store.open_output_stream(f"{path}/{name}.idx", compression=None) as sparse:
            sparse.write("\n".join(directory).encode())
        yield _batch([(first, last, name)], _schema("first string, last string, name string"))

    parts = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(captures.count() / range_lines))
    order = ["key", "date", "file", "offset"]
    made = cut(captures.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, "first string, last string, name string"), "ranges")
    # One short row per range: bounded by the captures over range_lines, or the partitions of a shuffle.
    return sorted((r["first"], r["last"], r["name"]) for r in made.collect())


def write(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", min_bytes: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES, block_lines: int = BLOCK_LINES, range_lines: int = RANGE_LINES) -> Archive:
    """Archives pages (page_id, url, html) in a new folder (in the shared one if none is given) and indexes the captures."""
    spark = pages.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    captures = write_records(pages, folder, date, min_bytes, file_bytes)
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return Archive(spark, folder, write_index(captures, folder, block_lines, range_lines), size)
