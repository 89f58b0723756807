"""WARC archives: a distributed writer and a splittable reader."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .shared import shared_dir, written

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this length are never written as revisits.
MIN_REVISIT = 100
#: Most tasks that one read is dealt over; beyond it, a task reads several byte ranges.
MAX_TASKS = 50_000
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_SCHEMA = "path string, offset long, record_type string, page_id long, refers_to long, uri string, payload_bytes long, payload_digest string, payload binary"


def _store(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None) -> bytes:
    """One gzip member that holds one record; a record that refers to another has no payload."""
    revisit = refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    uri = "".join(c if " " < c != "\x7f" else "%%%02X" % ord(c) for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def first_copies(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """``(_digest, _first)``: the smallest page_id of each payload that several rows have."""
    keyed = pages.select("page_id", F.sha2("_payload", 256).alias("_digest"), F.length("_payload").alias("_bytes")).where(F.col("_bytes") >= min_bytes)
    return keyed.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_digest", "_first")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as ``*.warc.gz`` below ``folder``; returns the files' table ``(path, bytes, records)``.

    Each task writes one file under a name of its own attempt. The returned
    table is committed by Spark's writer and names only the files of finished
    attempts, so that lost or repeated tasks leave no record twice. A null html
    is an empty payload. Of equal payloads of at least ``min_bytes``, the row
    with the smallest page_id is the response and the others revisit it; rows
    that share that page_id are all responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("_payload"))
    firsts = written(first_copies(rows, min_bytes), "firsts")
    # small payloads, of which one may be most frequent, revisit nothing: their rows are spread
    key = F.when(F.length("_payload") >= min_bytes, F.col("_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rows = rows.withColumn("_digest", F.sha2("_payload", 256)).withColumn("_key", key).join(firsts.withColumnRenamed("_digest", "_key"), "_key", "left").drop("_key")
    rows = rows.withColumn("_first", F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")))

    def write(batches: Iterable) -> Iterator:
        import pyarrow as pa

        path, out, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "_payload", "_digest", "_first"))
            for page_id, url, payload, digest, first in zip(*(c.to_pylist() for c in columns)):
                if out is None:
                    store, at = _store(path)
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(at, compression=None)
                member = record(page_id, url, payload, digest, first)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [n]})

    ids = rows.select(F.col("page_id"), "url", "_payload", "_digest", "_first")
    return written(ids.mapInArrow(write, "path string, bytes long, records long"), "files")


def _parsed(member: bytes) -> tuple | None:
    """Type, page_id, refers_to, uri, payload length, digest and payload of a decoded member; None if it holds no record.

    Names of headers count in any case, and blanks around values do not. A record without a usable
    Content-Length has all bytes behind its head; ids that are no pages' are null.
    """
    head, sep, block = member.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        return None
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}

    def number(name: str) -> int | None:
        x = fields.get(name, "").removeprefix("<urn:x-page:").removesuffix(">")
        return int(x) if x.isascii() and x.removeprefix("-").isdigit() and -(1 << 63) <= int(x) < 1 << 63 else None

    length = number("content-length")
    block = block[:length] if length is not None and length >= 0 else block
    kind, uri = fields.get("warc-type", ""), fields.get("warc-target-uri")
    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
    if kind == "revisit":
        told = number("x-payload-length")
        return kind, number("warc-record-id"), number("warc-refers-to"), uri, -1 if told is None else told, fields.get("warc-payload-digest", "").removeprefix("sha256:"), None
    return kind, number("warc-record-id"), None, uri, len(payload), hashlib.sha256(payload).hexdigest(), payload


def _member(read, at: int, step: int) -> tuple[bytes, int] | None:
    """The whole gzip member at ``at`` and the offset behind it; None if none that is sound starts there."""
    inflate, out, pos = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof:
            data = read(pos, step)
            if not data:
                return None
            out.append(inflate.decompress(data))
            pos += len(data)
    except zlib.error:
        return None
    return b"".join(out), pos - len(inflate.unused_data)


def records_in(read, size: int, start: int, stop: int, step: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """``(offset, decoded member)`` of each record that starts in ``[start, stop)``.

    Scans for the gzip magic; a candidate counts if its first bytes decode to a
    WARC version line and the whole member is sound. From there on, records
    follow one another; behind bytes that are no record, the scan goes on.
    ``read(offset, n)`` gives bytes; the last record may end behind ``stop``.
    """
    pos = start
    while pos < stop:
        window = read(pos, min(step, size - pos) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0:
            pos += max(len(window) - len(MAGIC) + 1, 1)
            continue
        at = pos + hit
        if at >= stop:
            return
        try:
            sound = zlib.decompressobj(31).decompress(read(at, 512), 8).startswith(b"WARC/")
        except zlib.error:
            sound = False
        member = _member(read, at, step) if sound else None
        if member is None:
            pos = at + 1
            continue
        yield at, member[0]
        pos = member[1]


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = 64 << 20, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``files(path, bytes)``, read by tasks over byte ranges of ``split_bytes``.

    A task owns the records that start in its range, so each is read once, however
    the ranges fall. A revisit has a null payload; its length and digest are
    those its headers state. Files that hold no record give no rows.
    """
    ranges = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(min(max(ranges.count(), 1), MAX_TASKS))

    told = StructType.fromDDL(RECORD_SCHEMA)

    def scan(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(told)
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            for path, size, start in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "bytes", "start"))):
                store, at = _store(path)
                rows, held = [], 0
                with store.open_input_file(at) as f:
                    for offset, member in records_in(lambda pos, n: f.read_at(n, pos), size, start, min(start + split_bytes, size)):
                        if (r := _parsed(member)) is None:
                            continue
                        rows.append((path, offset, *r[:6], r[6] if payloads else None))
                        held += len(member)
                        if held > 16 << 20 or len(rows) >= 5000:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    return ranges.mapInArrow(scan, RECORD_SCHEMA)


def warc_round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT, split_bytes: int = 64 << 20) -> DataFrame:
    """Write ``pages`` as archives in a shared folder, read them back and give a row per page.

    Nulls: a null html is an empty payload, a null url an empty target, a null
    page_id comes back as null. Repeated rows give repeated records. An empty
    table writes no archive and gives no rows. Payloads of any length are written and read whole. Further columns are ignored.
    """
    spark = pages.sparkSession
    files = write_warc(pages, shared_dir(spark) + "-warc", min_bytes)
    return read_warc(spark, files, split_bytes, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")
