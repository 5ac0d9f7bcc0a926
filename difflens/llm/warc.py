"""WARC archives: a writer with revisit records, and a reader that splits gzip-per-record archives by byte ranges.

A writing task puts out one archive per slice of its rows, under a name of its own; only archives named in the
materialised manifest count, so that a task run twice does no harm. A reading task gets a byte range. It looks for the
gzip magic, takes a place for a record's start if what it decodes to begins with the version line of a WARC and lines of
`name: value`, owns the records that start inside its range and reads on past the range's end for the last one.

Archives of others are read too: any 0.x or 1.x version, any record type. A record without a type or a whole block of its
stated length comes back as `malformed`; none is left out.

A null html is an empty payload, a null page_id gives records without a page id. Payloads under `least` bytes are always
responses. Repeated rows are records of their own; rows that share the largest page_id of a payload are all responses. An
empty table gives no archive and no rows; only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_path, slices

LEAST = 1000
RANGE_BYTES = 4 << 20
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
#: What a record's header begins with: its version line, then whole lines with a name (or going on), then perhaps a cut one.
HEADER = re.compile(rb"WARC/[01]\.\d+\r?\n(?:(?:[^\r\n:]+:|[ \t])[^\r\n]*\r?\n)*(?:\r?\n|[^\r\n]*\Z)")
#: Bytes decoded to validate a candidate, bytes decompressed at a time.
PEEK, STEP = 1024, 1 << 16
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string"
_EPOCH = "2024-01-01T00:00:00Z"


def marked(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to: of equal payloads the largest page_id is the response.

    Payloads that stand alone never move: only digests are grouped, and only digests of repeated payloads are joined back.
    """
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumns({"payload_digest": F.sha1("payload"), "n": F.octet_length("payload")})
    again = p.where(F.col("n") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    again = again.withColumnRenamed("payload_digest", "again_digest")
    j = p.join(again, (F.col("payload_digest") == F.col("again_digest")) & (F.col("n") >= least), "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("first_id").isNotNull())
    return j.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def _uuid(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def encode_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One gzip member. A revisit holds the HTTP header of the page but not its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [
        VERSION[:-2].decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_uuid('page', page_id)}",
        f"WARC-Date: {_EPOCH}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uuid('page', refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _sha1_of(stated: str | None) -> str | None:
    """A digest field as hex: of sha1 in base 32 or hex, else none."""
    name, _, value = (stated or "").strip().partition(":")
    if name.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def decode_record(data: bytes) -> tuple:
    """The columns of RECORD. The payload is a response's HTTP body, as it was sent, or the block of other records; a revisit has none, and the size that its HTTP header states."""
    head, _, block = re.split(rb"(\r?\n\r?\n)", data, maxsplit=1) if re.search(rb"\r?\n\r?\n", data) else (data, b"", b"")
    lines = re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").splitlines()
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    number = lambda name: int(fields[name]) if re.fullmatch(r"-?\d+", fields.get(name, "")) else None
    size, kind = number("content-length"), fields.get("warc-type", "").lower()
    names = (fields.get("warc-record-id"), fields.get("warc-refers-to"))
    if not kind or size is None or not 0 <= size <= len(block):
        return number("warc-page-id"), fields.get("warc-target-uri"), None, None, None, "malformed", number("warc-refers-to-page-id"), *names
    block = block[:size]
    http, gap, body = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if re.fullmatch(rb"(?i)content-length:\s*\d+\s*", x)]
        payload, n, digest = None, sizes[0] if sizes else None, _sha1_of(fields.get("warc-payload-digest"))
    else:
        payload = body if kind == "response" and fields.get("content-type", "").lower().startswith("application/http") and gap else block
        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return number("warc-page-id"), fields.get("warc-target-uri"), payload, n, digest, kind, number("warc-refers-to-page-id"), *names


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Writes archives under path; the materialised manifest (file, bytes, records) names those that count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for part in slices(batch, "payload", 64 << 20):
                name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for row in part.to_pylist():
                        size += out.write(encode_record(row["page_id"], row["url"], row["payload"] or b"", row["payload_digest"], row["record_type"], row["refers_to"]))
                yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [part.num_rows]})

    return materialise(records.mapInArrow(write, "file string, bytes long, records long"), "manifest")


def member_starts(data: bytes, upto: int) -> Iterator[int]:
    """Places before upto where a gzip member with a WARC record starts: magic that decodes to a header's beginning."""
    at = data.find(MAGIC)
    while 0 <= at < upto:
        try:
            if HEADER.match(zlib.decompressobj(31).decompress(data[at : at + 4096], PEEK)):
                yield at
        except zlib.error:
            pass
        at = data.find(MAGIC, at + 1)


def member_at(data: memoryview, at: int, more: Callable[[], bytes]) -> tuple[bytes | None, int]:
    """The decoded member that begins at a place of data, and how many bytes of data and what follows it (more) it takes; None if it is cut off. Each byte is handed on once."""
    z, out, taken = zlib.decompressobj(31), [], 0
    while True:
        step = bytes(data[at + taken : at + taken + STEP]) or more()
        if not step:
            return None, taken
        out.append(z.decompress(step))
        taken += len(step) - len(z.unused_data)
        if z.eof:
            return b"".join(out), taken


def read_archives(spark: SparkSession, path: str, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records (columns of RECORD) of archives: files has file (under path) and bytes."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(starts).alias("start"))
    # one range a row, dealt evenly; ranges are a few bytes each
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['file']}") as f:
                    own = min(range_bytes, row["bytes"] - row["start"])
                    data = f.read_at(own + 4096, row["start"])
                    rows, held, end, view = [], 0, 0, memoryview(data)
                    for at in member_starts(data, own):
                        if at < end:  # inside a record that is already read
                            continue
                        beyond = itertools.count(row["start"] + len(data), STEP)
                        record, taken = member_at(view, at, lambda: f.read_at(STEP, next(beyond)))  # noqa: B023
                        if record is None:
                            raise ValueError(f"{row['file']}: record at {row['start'] + at} is cut off")
                        rows.append(decode_record(record))
                        end = at + taken
                        held += len(rows[-1][2] or b"")
                        if held > 16 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                    if rows:
                        yield packed(rows)

    return ranges.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes the pages as archives to the shared folder and reads them back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    manifest = write_archives(marked(pages, least), path)
    return read_archives(spark, path, manifest)
