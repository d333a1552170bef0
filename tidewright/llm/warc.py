"""WARC archives with an index written first, and reads of selected records by byte ranges.

Each record is a gzip member of its own. The index has the file, offset,
length, URL and digest of every record; readers sort the selected records by
place, merge neighbouring ranges into one read, and parse each record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import files, scratch, textprep
from tidewright.session import ship_package

#: Ranges of a file that are at most GAP apart are one read, up to READ bytes.
GAP, READ = 1 << 16, 4 << 20
#: Bytes after which a task starts another archive.
FILE_BYTES = 1 << 28
#: Archive bytes that a task reads, about, and reading tasks at most.
TASK_BYTES, TASKS = 1 << 22, 100_000
#: Repeated payloads up to which their table (64 bytes each, about) is broadcast to the pages.
BROADCAST_ROWS = 500_000
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
DATE = "2000-01-01T00:00:00Z"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data: each 5 hex digits are 4 of base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def classified(pages: DataFrame, least: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, html, bytes, digest and first: the page_id that a revisit refers to, else null.

    Of pages with equal payloads of `least` bytes or more that with the
    smallest page_id is the response. Digests are counted by a partial
    aggregation; only the payloads that repeat make a table. It is counted,
    and if it has `broadcast_rows` at most, broadcast, so that no html moves;
    else the pages are joined by a shuffle on the digest, where the rows of one
    payload are one key (Spark's adaptive skew join splits a large one).
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("bytes"), sha1_base32(F.encode(payload, "UTF-8")).alias("digest")
    )
    counts = rows.groupBy("digest", "bytes").agg(F.min("page_id").alias("low"), F.count("*").alias("n"))
    repeated = scratch.table(counts.where(F.col("n") > 1).select("digest", "bytes", "low"), "repeated")
    if repeated.count() <= broadcast_rows:
        repeated = F.broadcast(repeated)
    first = F.when((F.col("bytes") >= least) & F.col("low").isNotNull() & ~F.col("low").eqNullSafe(F.col("page_id")), F.col("low"))
    return rows.join(repeated, ["digest", "bytes"], "left").withColumn("first", first).drop("low")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """The bytes of a WARC/1.1 response record, or of a revisit record if first is given."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if first is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if first is not None:
        head += [f"WARC-Refers-To: {name(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; names are in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda b: {k.lower(): v for k, _, v in (x.partition(": ") for x in b.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Write archives of classified rows; returns the index of their records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = files.place(folder)
        store.create_dir(path)
        out, name = None, ""
        for batch in batches:
            for part in textprep.slices(batch, "html"):
                index = []
                for page_id, url, html, digest, first in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first"))):
                    if out is None or out.tell() >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = files.attempt_name(".warc.gz")
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, html.encode(), digest, first)) + packer.flush()
                    index.append((page_id, name, out.tell(), len(data), url, digest, "response" if first is None else "revisit"))
                    out.write(data)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                names = ["page_id", "file", "offset", "length", "url", "digest", "record_type"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), kinds)], names)
        if out is not None:
            out.close()

    return rows.select("page_id", "url", "html", "digest", "first").mapInArrow(run, INDEX)


def ranges(places: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as reads: file, offset, length and the records (start, length) in each."""
    held: list[tuple[int, int]] = []
    file = None
    for name, offset, length in places:
        if held and (name != file or offset - sum(held[-1]) > GAP or offset + length - held[0][0] > READ):
            yield file, held[0][0], max(map(sum, held)) - held[0][0], [(a - held[0][0], n) for a, n in held]
            held = []
        file = name
        held.append((offset, length))
    if held:
        yield file, held[0][0], max(map(sum, held)) - held[0][0], [(a - held[0][0], n) for a, n in held]


def read(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records of an index (or of any part of it): page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is read and its digest computed anew; a revisit has
    both from its headers. With payload the text comes too (null for revisits).
    Records are dealt by place to tasks of about TASK_BYTES of archive each.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["html"] * payload
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()) + (pa.string(),) * payload

    def page(name: str | None) -> int | None:
        own = re.search(r"urn:page:(-?\d+)", name or "")
        return int(own[1]) if own else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = files.place(folder)
        source, opened = None, None
        for batch in batches:
            for file, offset, length, own in ranges(list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))):
                if file != opened:
                    if source is not None:
                        source.close()
                    source, opened = store.open_input_file(f"{path}/{file}"), file
                data = source.read_at(length, offset)
                rows = []
                for start, n in own:
                    warc, http, body = parse(zlib.decompress(data[start : start + n], 31))
                    kind, digest = warc["warc-type"], warc["warc-payload-digest"].partition(":")[2]
                    if kind == "response":
                        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                    size = len(body) if kind == "response" else int(http["content-length"])
                    row = (page(warc["warc-record-id"]), size, digest, kind, page(warc.get("warc-refers-to")))
                    rows.append(row + ((body.decode() if kind == "response" else None,) if payload else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * payload
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select("file", "offset", "length").repartitionByRange(min(TASKS, total // TASK_BYTES + 1), "file", "offset")
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives and read all records back by the index.

    A null html is an empty payload; a null url is named by its page_id. Rows
    that repeat a page_id and payload are all responses or all revisits. A null
    page_id refers to the smallest page_id with its payload, if there is one.
    A payload of any length is one record, held in a task as a whole. An empty
    table gives an empty one; other columns are ignored.
    """
    spark = pages.sparkSession
    ship_package(spark)
    folder = scratch.new_path(spark, "warc")
    index = scratch.table(write(classified(pages, least), folder), "warc-index")
    return read(index, folder)
