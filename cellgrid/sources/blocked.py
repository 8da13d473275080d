"""Text files of many gzip members, read by byte ranges.

A blocked gzip file (and any file made of gzip members laid end to end, and plain text)
is cut into byte ranges; a range owns the members that start in it.  Every range
is read on its own (small ones several to a task), in two steps:

1. ``line_ranges`` inflates what a range owns and counts its line ends.  Sums over the ranges
   before it tell the number of its first line, so line k of one file can be found
   beside line k of another.
2. ``lines_from`` opens a file at a range's first member and skips to a line.

Where a member starts is found by its magic bytes and proved by inflating: what is no
member breaks off soon, at the latest at its checksum.  Members and lines may end
anywhere; a line belongs to the range in which it starts.  A gzip file of one member has
one range with lines: it cannot be split, only read from its start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b"
MEMBER = b"\x1f\x8b\x08"       # with the one method there is (deflate)
CHUNK = 1 << 20                # bytes read at a time
READ = 1 << 17                 # bytes read at a time while inflating: a range may be far smaller than CHUNK
TASK_BYTES = 1 << 20           # bytes of ranges that a task takes, where there are more than FEW ranges
FEW = 64
PROVEN = 4 << 20               # bytes that a candidate member has to inflate to, if it does not end before
BLOCK_TEXT = 0xFF00            # bytes of text in a block that is written


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI as Spark writes it (names as they are) or of a local path."""
    return pafs.FileSystem.from_uri(quote(uri, safe=":/@")) if "://" in uri else (pafs.LocalFileSystem(), uri)


class _File:
    """A file opened by URI or local path."""

    def __init__(self, uri: str):
        where, path = locate(uri)
        self._in = where.open_input_file(path)
        self.size = self._in.size()
        self.gzip = self.at(0, 2) == MAGIC

    def at(self, start: int, n: int) -> bytes:
        return self._in.read_at(max(0, min(n, self.size - start)), start)

    def __enter__(self) -> "_File":
        return self

    def __exit__(self, *_) -> None:
        self._in.close()

    def data(self, start: int) -> Iterator[tuple[int, bytes]]:
        """``(member start, text)`` from a member's start to the end of the file; of a
        plain file ``(place, text)``."""
        pos = start
        if not self.gzip:
            while pos < self.size:
                raw = self.at(pos, CHUNK)
                yield pos, raw
                pos += len(raw)
            return
        raw = b""                      # bytes read from ``pos`` on
        while pos < self.size:
            one, used = zlib.decompressobj(31), 0
            while not one.eof:
                if not raw:
                    raw = self.at(pos + used, READ)
                    if not raw:
                        raise EOFError("a gzip member is cut off")
                text = one.decompress(raw)
                used += len(raw) - len(one.unused_data)
                raw = one.unused_data
                if text:
                    yield pos, text
            pos += used
            if not raw.strip(b"\0") and not self.at(pos, CHUNK).strip(b"\0") and pos + CHUNK >= self.size:
                return                 # nothing, or padding, follows

    def is_member(self, start: int) -> bool:
        """Whether a candidate inflates, to its checksum or for long enough."""
        if len(self.at(start, 18)) < 18 or self.at(start + 3, 1)[0] & 0xE0:   # reserved flags
            return False
        one, at, size = zlib.decompressobj(31), start, 0
        try:
            while not one.eof and size < PROVEN:
                raw = self.at(at, 1 << 16)
                if not raw:
                    return False
                at += len(raw)
                size += len(one.decompress(raw))
        except zlib.error:
            return False
        return True

    def first_member(self, start: int, end: int) -> int | None:
        """The first member that starts in ``[start, end)``; of a plain file ``start``."""
        if start == 0 or not self.gzip:
            return start if start < self.size else None
        for base in range(start, end, CHUNK):
            held = self.at(base, min(CHUNK, end - base) + len(MEMBER) - 1)
            k = held.find(MEMBER)
            while k >= 0:
                if self.is_member(base + k):
                    return base + k
                k = held.find(MEMBER, k + 1)
        return None


def range_tasks(n: int, range_bytes: int) -> int:
    """Tasks for ``n`` ranges: beyond ``FEW`` small ranges go several to a task, which costs more to start than they to read."""
    return max(1, min(n, FEW), -(-n // max(1, TASK_BYTES // range_bytes)))


def _count(uri: str, start: int, end: int) -> tuple:
    """``(first, ends, bytes, whole)``: first member, line ends, text size, whether
    the last byte is a line end; of a range without members ``first`` is None."""
    with _File(uri) as f:
        first = f.first_member(start, end)
        ends = size = 0
        last = b""
        if first is not None:
            for at, text in f.data(first):
                if at >= end:
                    break
                if not f.gzip:
                    text = text[:end - at]
                ends += text.count(b"\n")
                size += len(text)
                last = text[-1:]
        return first, ends, size, last == b"\n"


def line_ranges(spark: SparkSession, files: list[tuple[int, str, str, int]], range_bytes: int) -> DataFrame:
    """``(file_no, side, path, first, before, first_line, next_line)`` of every range that holds lines.

    ``files`` are ``(file_no, side, path, size)``.  ``before`` is the number of line ends before
    the range (the line its text begins in); its own lines are ``first_line`` up to ``next_line``."""
    from cellgrid.functions.positions import materialize
    from cellgrid.session import ship_package

    ship_package(spark)
    table = spark.createDataFrame(files, "file_no int, side string, path string, size bigint")
    cut = table.select("file_no", "side", "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes))).alias("start"))
    n = sum(max(1, -(-size // range_bytes)) for *_, size in files)
    fields = [("file_no", pa.int32()), ("side", pa.string()), ("path", pa.string()), ("first", pa.int64()),
              ("ends", pa.int64()), ("bytes", pa.int64()), ("whole", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                first, *rest = _count(r["path"], r["start"], r["start"] + range_bytes)
                row = dict(zip([f for f, _ in fields], (r["file_no"], r["side"], r["path"], first, *rest)))
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema(fields))

    counted = materialize(cut.repartition(range_tasks(n, range_bytes)).mapInArrow(
        run, "file_no int, side string, path string, first bigint, ends bigint, bytes bigint, whole boolean")).where("bytes > 0")
    of_file = Window.partitionBy("file_no", "side").orderBy("first")   # one row per range of a file
    upto = of_file.rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("ends").over(upto), F.lit(0)))
    inside = ~F.coalesce(F.lag("whole").over(of_file), F.lit(True))   # the text begins inside a line
    counted = counted.withColumn("first_line", F.col("before") + inside.cast("bigint"))
    end = F.col("before") + F.col("ends") + (~F.col("whole")).cast("bigint")
    return counted.select("file_no", "side", "path", "first", "before", "first_line",
                          F.coalesce(F.lead("first_line").over(of_file), end).alias("next_line"))


def lines_from(uri: str, first: int, skip: int) -> Iterator[bytes]:
    """Lines of a file (without their ends) from a range's first member on, ``skip`` line ends left out."""
    with _File(uri) as f:
        rest = b""
        for _, text in f.data(first):
            if skip:
                ends = text.count(b"\n")
                if ends < skip:
                    skip -= ends
                    continue
                text = text.split(b"\n", skip)[-1]
                skip = 0
            *whole, rest = (rest + text).split(b"\n")
            yield from whole
        if rest and not skip:
            yield rest


def every_fourth(lines: Iterator[bytes], n: int) -> Iterator[str]:
    """The second line of each of ``n`` records of four."""
    return (x.rstrip(b"\r").decode("ascii", "replace") for x in islice(lines, 1, 4 * n, 4))


def block(text: bytes) -> bytes:
    """One gzip member that states its own size in an extra field (the blocked gzip convention)."""
    raw = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = raw.compress(text) + raw.flush()
    size = 18 + len(body) + 8 - 1
    head = MEMBER + b"\x04" + bytes(4) + b"\x00\xff" + (6).to_bytes(2, "little") + b"BC" + (2).to_bytes(2, "little") + size.to_bytes(2, "little")
    return head + body + zlib.crc32(text).to_bytes(4, "little") + len(text).to_bytes(4, "little")


def write_blocked(df: DataFrame, folder: str) -> list[str]:
    """Lines (the string column ``value``) written as blocked gzip, one file per partition, under a
    folder of the shared file system; returns the files in order of the partitions."""
    import uuid

    from pyspark import TaskContext

    from cellgrid.session import ship_package
    from cellgrid.sources.paths import qualified

    ship_package(df.sparkSession)
    place = qualified(df.sparkSession, folder)
    place = "file://" + place[len("file:"):] if place.startswith("file:/") and not place.startswith("file://") else place

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        where, base = locate(place)
        where.create_dir(base, recursive=True)
        name = f"part-{part:06d}.gz"
        trial, held = f"{base}/.{name}-{uuid.uuid4().hex}", b""
        with where.open_output_stream(trial, compression=None) as out:
            for b in batches:
                held += "".join(f"{x}\n" for x in b.column("value").to_pylist()).encode()
                while len(held) >= BLOCK_TEXT:
                    out.write(block(held[:BLOCK_TEXT]))
                    held = held[BLOCK_TEXT:]
            if held:
                out.write(block(held))
            out.write(block(b""))      # the convention's mark of a file's end
        where.move(trial, f"{base}/{name}")   # a repeated task leaves the same file
        yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{place}/{name}"}], schema=pa.schema([("part", pa.int32()), ("path", pa.string())]))

    return [r["path"] for r in df.select("value").mapInArrow(run, "part int, path string").orderBy("part").collect()]  # a row per file
