"""WARC files: a writer with revisit records and a splittable reader.

Every record is a gzip member of its own.  The reader cuts files into byte
ranges, one row each, and a task looks for gzip magic in its range: a
candidate counts only if its first bytes decode to a WARC version line and the
whole member is sound and followed by the end of the file or another member.
From there members follow each other.  A task owns the records that start
inside its range and reads the last one beyond the end of it, so ranges need no
index and every record is read once.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import ref, sized, stored, with_workers
from cellgrid.llm.files import locate, write_file

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 8 << 20     # range that a reading task scans
FILE_BYTES = 64 << 20     # a file is closed once it is as long as this
_STEP = 1 << 18           # bytes read at a time
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = "2020-01-01T00:00:00Z") -> bytes:
    """One gzip member: a response with its payload, or a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of a record; checks
    its length and, for a response, its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = int(fields["content-length"])
    if len(rest) != length + 4:
        raise ValueError(f"record {fields.get('warc-record-id')} is {len(rest) - 4} bytes long, not {length}")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    fields["http"] = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    fields["payload"] = payload
    if fields["warc-type"] == "response" and f"sha1:{digest(payload)}" != fields["warc-payload-digest"]:
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not have its digest")
    return fields


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """``(page_id, sha, first)``: pages whose payload a page with a smaller id
    has too; ``first`` is the smallest such id.  Stored."""
    html = F.coalesce(ref(pages, payload_col).cast("string"), F.lit("")).cast("binary")
    narrow = pages.select(ref(pages, id_col).alias("page_id"), F.sha1(html).alias("sha"), F.length(html).alias("bytes"))
    narrow = stored(narrow.where(F.col("bytes") >= min_bytes).drop("bytes"), "payloads")
    shared = stored(narrow.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1 and first is not null").select("sha", "first"), "shared-payloads")
    found = narrow.join(sized(shared), "sha").where(~F.col("page_id").eqNullSafe(F.col("first")))
    return stored(found.distinct(), "revisits")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per page into ``folder``; returns the stored list of
    files ``(path, records, bytes)``.

    Of pages with equal payloads of at least ``min_bytes`` the smallest id is the
    response, the others revisit it; pages that share that id are all responses.
    Null payload: empty.  Null ids come after all others.  No pages: no file.
    """
    spark = with_workers(pages.sparkSession)
    again = revisits(pages, id_col, payload_col, min_bytes)
    again = again.select(F.col("page_id").alias("_i"), F.col("sha").alias("_s"), F.col("first").alias("refers_to"))
    src = pages.select(ref(pages, id_col).alias("page_id"), ref(pages, url_col).cast("string").alias("url"),
                       F.coalesce(ref(pages, payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    src = src.withColumn("sha", F.sha1("payload"))
    src = src.join(sized(again), src["page_id"].eqNullSafe(again["_i"]) & (src["sha"] == again["_s"]), "left")
    src = src.select("page_id", "url", "payload", "refers_to")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/pages-{part:06d}-{number:06d}.warc.gz"
            write_file(uri, lambda out: [out.write(x) for x in held])
            return pa.RecordBatch.from_pylist([{"path": uri, "records": len(held), "bytes": size}], schema=schema)

        for b in batches:
            for page in b.to_pylist():
                member = record(page["page_id"], page["url"], page["payload"], page["refers_to"])
                held.append(member)
                size += len(member)
                if size >= file_bytes:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return stored(src.mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


class _Bytes:
    """A window over a file that grows forward and drops what is behind."""

    def __init__(self, source, size: int, at: int):
        self.source, self.size, self.base, self.data = source, size, at, b""

    def upto(self, end: int) -> None:
        have = self.base + len(self.data)
        if end > have and have < self.size:
            self.data += self.source.read_at(min(max(end - have, _STEP), self.size - have), have)

    def drop(self, at: int) -> None:
        if at - self.base > 4 * _STEP:
            self.data, self.base = self.data[at - self.base:], at

    def get(self, at: int, n: int) -> bytes:
        self.upto(at + n)
        return self.data[at - self.base:at - self.base + n]


def _member(window: _Bytes, at: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``at``; None if there is no WARC record."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        first = z.decompress(window.get(at, 512), 8)
        if not first.startswith(b"WARC/1."):
            return None
        z, pos = zlib.decompressobj(31), at
        while not z.eof:
            piece = window.get(pos, _STEP)
            if not piece:
                return None
            out.append(z.decompress(piece))
            pos += len(piece)
    except zlib.error:
        return None
    return b"".join(out), pos - len(z.unused_data)


def records_in(source, size: int, start: int, end: int) -> Iterator[bytes]:
    """Decoded records whose member starts in ``[start, end)``."""
    window, at, sure = _Bytes(source, size, start), start, start == 0
    while at < end:
        window.drop(at)
        if not sure:
            window.upto(min(end, at + _STEP) + len(MAGIC))
            hit = window.data.find(MAGIC, at - window.base)
            if hit < 0:
                at = max(at, window.base + len(window.data) - len(MAGIC) + 1)
                if window.base + len(window.data) >= size:
                    return
                continue
            at = window.base + hit
            if at >= end:
                return
        found = _member(window, at)
        if found and (found[1] >= size or window.get(found[1], 3) == MAGIC):
            yield found[0]
            at, sure = found[1], True
        elif sure and at < size:
            raise ValueError(f"no sound record at byte {at}")
        else:
            at += 1


def read_records(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, id_type: str = "bigint") -> DataFrame:
    """``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)``
    of every record in the archives under ``folder``; a revisit has no payload."""
    with_workers(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(split_bytes).cast("bigint"))
    ranges = files.where("length > 0").select("path", "length", F.explode(starts).alias("start"))
    # rows are few and short and would be merged into one task: say how many tasks there are
    tasks = min(ranges.count(), 8 * spark.sparkContext.defaultParallelism)
    ranges = ranges.repartition(max(1, tasks), "path", "start")
    number = id_type in ("bigint", "int", "smallint", "tinyint")
    kind = pa.int64() if number else pa.string()
    schema = pa.schema([("page_id", kind), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", kind),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def name(urn: str | None):
        value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return None if not value else int(value) if number else value

    def row(raw: bytes) -> dict:
        f = parse(raw)
        whole = f["warc-type"] == "response"
        return {"page_id": name(f["warc-record-id"]), "url": f.get("warc-target-uri"), "record_type": f["warc-type"],
                "refers_to": name(f.get("warc-refers-to")),
                "payload_bytes": len(f["payload"]) if whole else int(f["http"]["content-length"]),
                "payload_digest": f["warc-payload-digest"].removeprefix("sha1:"), "payload": f["payload"] if whole else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                where, path = locate(r["path"])
                with where.open_input_file(path) as source:
                    held = []
                    for raw in records_in(source, r["length"], r["start"], min(r["length"], r["start"] + split_bytes)):
                        held.append(row(raw))
                        if len(held) >= 64:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    t = "bigint" if number else "string"
    return ranges.mapInArrow(run, f"page_id {t}, url string, record_type string, refers_to {t}, payload_bytes bigint, "
                                  "payload_digest string, payload binary")
