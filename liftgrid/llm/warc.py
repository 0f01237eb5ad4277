"""Web archives: write request, response or revisit, and metadata records; assemble captures.

A capture is one page. Its three records go to one archive file, each as a gzip member;
request and metadata name the response or revisit through WARC-Concurrent-To. Reading joins
the records back through those identifiers and gives one nested row per capture.

Of captures with equal payloads of at least ``min_bytes`` bytes, the one with the least
page_id is a response; the others are revisits that carry the payload's digest and the
response's record id, but not the payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftgrid.llm.common import batch_of, schema, stored

FILES = schema("path string, records bigint")
RECORDS = schema(
    "record_id string, record_type string, concurrent_to string, refers_to_id string, page_id bigint, "
    "target_uri string, payload_digest string, payload_bytes bigint, block binary")
DIGESTS = schema("page_id bigint, row bigint, digest string, size bigint")
VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of records, before compression, after which a writer begins another file.
FILE_BYTES = 64 << 20


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page_id, row) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page_id}/{row}')}>"


def _line(value) -> str:
    """A header value: line breaks would end the header, so they are percent-encoded."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _plain(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress(VERSION + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def capture(page_id, row, url, html, digest, size, first) -> bytes:
    """The three records of a page; ``first`` is the (page_id, row) of the response it revisits."""
    uri = [("WARC-Target-URI", _line(url))] if url is not None else []
    page = [("X-Page-Id", page_id)] if page_id is not None else []
    main = record_id("response", page_id, row)
    common = [("WARC-Date", DATE), *uri, *page]
    payload = [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if first is None:
        response = member([("WARC-Type", "response"), ("WARC-Record-ID", main), *common, *payload,
                           ("Content-Type", "application/http;msgtype=response")], http + html)
    else:
        response = member([("WARC-Type", "revisit"), ("WARC-Record-ID", main), *common, *payload,
                           ("WARC-Refers-To", record_id("response", *first)),
                           ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                           ("Content-Type", "application/http;msgtype=response")], http)
    get = f"GET {_line(url or '')} HTTP/1.1\r\n\r\n".encode()
    request = member([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page_id, row)), *common,
                      ("WARC-Concurrent-To", main), ("Content-Type", "application/http;msgtype=request")], get)
    notes = member([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_id, row)), *common,
                    ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")],
                   f"fetchedBytes: {size}\r\n".encode())
    return response + request + notes


# Writing --------------------------------------------------------------------------------

def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [h or b"" for h in batch.column("html").to_pylist()]
        yield batch_of(DIGESTS, batch.column("page_id"), batch.column("row"),
                       [digest_of(p) for p in payloads], [len(p) for p in payloads])


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        open_file, path, size, records = None, None, 0, 0
        for batch in batches:
            for r in batch.to_pylist():
                if open_file is None:
                    # a task that is run again writes other files; only reported ones are read
                    path, size, records = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    open_file = store.open_output_stream(path, compression=None)
                html = r["html"] or b""
                first = None if r["first"] is None else (r["first"]["page_id"], r["first"]["row"])
                open_file.write(capture(r["page_id"], r["row"], r["url"], html, digest_of(html), len(html), first))
                records += 3
                size += len(html)
                if size >= FILE_BYTES:
                    open_file.close()
                    open_file = None
                    yield batch_of(FILES, [path], [records])
        if open_file is not None:
            open_file.close()
            yield batch_of(FILES, [path], [records])
    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the records of ``pages`` (page_id, url, html) under ``folder``; the files written.

    Null html is an empty payload, a null url has no target, a null page_id sorts last. Rows
    equal in page_id, url and html are one capture: their records are equal, and reading
    takes a repeated record once. Of equal payloads with equal ids the row with the least
    hash of url and html is first. An empty table writes no file; other columns are not read.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    # tells rows with one page_id apart, alike in every run
    rows = rows.withColumn("row", F.xxhash64("url", "html"))
    found = stored(rows.select("page_id", "row", "html").mapInArrow(_digests, DIGESTS), "digests")
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "row")
    repeated = found.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
    # the hot payload of a third of all pages meets one row; adaptive execution splits that join
    revisits = found.join(repeated, ["digest", "size"]).where(
        ~(F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("row") == F.col("first.row")))
    ).select(F.coalesce("page_id", F.lit(-(1 << 63))).alias("k"), "row",
             F.struct("first.page_id", "first.row").alias("first")).dropDuplicates(["k", "row"])
    whole = rows.withColumn("k", F.coalesce("page_id", F.lit(-(1 << 63)))).join(revisits, ["k", "row"], "left")
    return stored(whole.select("page_id", "row", "url", "html", "first").mapInArrow(_write(folder), FILES), "archives")


# Reading --------------------------------------------------------------------------------

def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(unpack.decompress(data))
            if not unpack.eof:
                break
            yield b"".join(parts)
            data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if b"".join(parts):
        raise ValueError("the archive ends inside a record")


def parse(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("the record is cut off")
    digest, page, size = fields.get("WARC-Payload-Digest"), fields.get("X-Page-Id"), fields.get("X-Payload-Length")
    uri = fields.get("WARC-Target-URI")
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        digest, size = f"sha1:{digest_of(payload)}", len(payload)  # of what was stored, not what was said
    return (fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Concurrent-To"), fields.get("WARC-Refers-To"),
            None if page is None else int(page), None if uri is None else _plain(uri),
            digest and digest.removeprefix("sha1:"), None if size is None else int(size), block)


def _read(folder: str, blocks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for record in members(stream):
                        row = parse(record)
                        rows.append(row if blocks else (*row[:-1], None))
                        size += len(record)
                        if size > 1 << 23:
                            yield batch_of(RECORDS, *map(list, zip(*rows)))
                            rows, size = [], 0
                if rows:
                    yield batch_of(RECORDS, *map(list, zip(*rows)))
    return run


def read_records(files: DataFrame, folder: str, blocks: bool = True) -> DataFrame:
    """One row per record of the given archives; without ``blocks`` the block is null."""
    # a number, so that adaptive execution does not put all files into one task
    return files.select("path").repartition(max(1, min(files.count(), 20_000))).mapInArrow(_read(folder, blocks), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: record_id, page_id, target_uri, payload_*, record_type,
    refers_to_id, and the nested response, request and metadata (null where there is none).

    Records meet through the identifier that request and metadata are concurrent to. One
    identifier has three records, so no key is hot; a repeated record is taken once.
    """
    key = F.coalesce("concurrent_to", "record_id")
    part = F.struct("record_id", "block")
    of = lambda *kinds: F.min(F.when(F.col("record_type").isin(*kinds), part))
    main = F.when(F.col("record_type").isin("response", "revisit"), F.struct(
        "record_type", "page_id", "target_uri", "payload_digest", "payload_bytes", "refers_to_id"))
    grouped = records.groupBy(key.alias("record_id")).agg(
        F.min(main).alias("main"), of("response", "revisit").alias("response"),
        of("request").alias("request"), of("metadata").alias("metadata"))
    return grouped.where(F.col("main").isNotNull()).select("record_id", "main.*", "response", "request", "metadata")


def with_targets(captures: DataFrame) -> DataFrame:
    """``captures`` with refers_to, the page_id of the response that a revisit names.

    A hot response is met by many revisits; the responses are one row each, so adaptive
    execution can split the join.
    """
    targets = captures.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return captures.join(targets, "refers_to_id", "left")
