"""Paired FASTQ reads (S7) and tag libraries.

``read_fastq_pairs`` cuts files above ``RANGE_BYTES`` into byte ranges (``blocked``): plain text,
blocked gzip and other files of many gzip members.  Line counts of the ranges pair the two files by
record number, and each range of R1 is read with its counterpart in R2 by one task.  A gzip file of one member cannot be cut: it stays one task, however large.

``fastq_pair`` is the Python data source for lanes below that size, and for direct use: one input
partition per file pair, both files read in lockstep inside the task, only
the sequence line of each 4-line record kept, stopping at the shorter file.

    spark.dataSource.register(FastqPairDataSource)
    spark.read.format("fastq_pair").option("pairs", '[["r1.fq.gz", "r2.fq.gz"], ["r1b.fq.gz", "r2b.fq.gz"]]').load()
"""

from __future__ import annotations

import gzip
import json
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellgrid.functions.positions import dense_positions, materialize
from cellgrid.sources.blocked import every_fourth, line_ranges, lines_from, locate, range_tasks
from cellgrid.sources.paths import file_size, qualified, require_exists

BATCH_ROWS = 65536
RANGE_BYTES = 64 << 20   # files above this size are cut into ranges of it


def _open(path: str):
    """Text stream of a FASTQ file, gzip or plain (detected by magic bytes).

    Plain local paths use the local file system; URIs (``s3://``, ``hdfs://``,
    ``gs://``, ``file://``) go through ``pyarrow.fs`` inside the task.
    """
    import io

    if "://" in path:
        filesystem, inner = locate(path)
        raw = filesystem.open_input_stream(inner, compression=None)   # told by its magic bytes below
    else:
        raw = open(path, "rb")
    buf = io.BufferedReader(raw) if not isinstance(raw, io.BufferedReader) else raw
    magic = buf.peek(2)[:2]
    if magic == b"\x1f\x8b":
        return io.TextIOWrapper(gzip.GzipFile(fileobj=buf), encoding="ascii", errors="replace")
    return io.TextIOWrapper(buf, encoding="ascii", errors="replace")


def _sequences(fh):
    """Sequence line of every 4-line record (newline removed)."""
    while True:
        head = fh.readline()
        if head == "":
            return
        seq = fh.readline()
        fh.readline()
        fh.readline()
        yield seq.rstrip("\r\n")


class _PairPartition(InputPartition):
    def __init__(self, file_no: int, r1: str, r2: str):
        super().__init__(file_no)
        self.file_no, self.r1, self.r2 = file_no, r1, r2


class _PairReader(DataSourceReader):
    def __init__(self, pairs):
        self.pairs = pairs

    def partitions(self):
        return [_PairPartition(i, a, b) for i, (a, b) in enumerate(self.pairs)]

    def read(self, partition):
        import pyarrow as pa

        schema = pa.schema([("file_no", pa.int32()), ("read_no", pa.int64()), ("r1", pa.string()),
                            ("r2", pa.string())])
        with _open(partition.r1) as f1, _open(partition.r2) as f2:
            buf1, buf2, n = [], [], 0
            for s1, s2 in zip(_sequences(f1), _sequences(f2)):
                buf1.append(s1)
                buf2.append(s2)
                if len(buf1) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([partition.file_no] * len(buf1), pa.int32()),
                         pa.array(range(n, n + len(buf1)), pa.int64()), pa.array(buf1), pa.array(buf2)],
                        schema=schema)
                    n += len(buf1)
                    buf1, buf2 = [], []
            if buf1:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.file_no] * len(buf1), pa.int32()),
                     pa.array(range(n, n + len(buf1)), pa.int64()), pa.array(buf1), pa.array(buf2)],
                    schema=schema)


class FastqPairDataSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq_pair"

    def schema(self):
        return "file_no int, read_no bigint, r1 string, r2 string"

    def reader(self, schema):
        pairs = json.loads(self.options.get("pairs") or "[]")   # JSON: file names may hold any character
        for item in pairs:
            if len(item) != 2:
                raise ValueError(f"a FASTQ pair needs two files, got {item!r}")
        if not pairs:
            raise ValueError("option 'pairs' must list at least one [r1, r2] pair")
        return _PairReader([(a, b) for a, b in pairs])


def _uri(spark: SparkSession, path: str) -> str:
    require_exists(spark, path)
    uri = qualified(spark, path)
    return "file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def read_fastq_pairs(spark: SparkSession, pairs: list[tuple[str, str]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(file_no, read_no, r1, r2)`` from one or more (R1, R2) file pairs; of a pair as many
    records as the shorter file has."""
    from cellgrid.session import ship_package

    # tasks must open the files that are checked here: one spelling with its file system
    pairs = [(_uri(spark, a), _uri(spark, b)) for a, b in pairs]
    sizes = [(file_size(spark, a), file_size(spark, b)) for a, b in pairs]
    if max((n for two in sizes for n in two), default=0) > range_bytes:
        return _paired_ranges(spark, [(k, side, path, size) for k, two in enumerate(zip(pairs, sizes))
                                      for side, path, size in zip(("r1", "r2"), *two)], range_bytes)
    ship_package(spark)
    spark.dataSource.register(FastqPairDataSource)
    return spark.read.format("fastq_pair").option("pairs", json.dumps(pairs)).load()


def _paired_ranges(spark: SparkSession, files: list[tuple], range_bytes: int) -> DataFrame:
    """Every range of R1 with the place in R2 where its first record is."""
    import pyarrow as pa

    ranges = materialize(line_ranges(spark, files, range_bytes))
    of_file = Window.partitionBy("file_no")
    # a record of four lines belongs to the range in which its first line starts
    ranges = ranges.withColumn("a", F.ceil(F.col("first_line") / 4)).withColumn("b", F.ceil(F.col("next_line") / 4))
    ranges = ranges.withColumn("records2", F.max(F.when(F.col("side") == "r2", F.col("b"))).over(of_file))
    # the last range of R2 whose own lines begin at or before the record's first line (a few rows per file)
    place = F.when(F.col("side") == "r2", F.struct("path", "first", "before"))
    line = F.when(F.col("side") == "r2", F.col("first_line")).otherwise(4 * F.col("a"))
    upto = of_file.orderBy(line, F.col("side").desc(), "first").rowsBetween(Window.unboundedPreceding, 0)
    work = (ranges.withColumn("other", F.last(place, ignorenulls=True).over(upto)).where("side = 'r1'")
            .withColumn("b", F.least("b", F.coalesce("records2", F.lit(0)))).where("a < b AND other IS NOT NULL")
            .select("file_no", "a", "b", "path", "first", (4 * F.col("a") - F.col("before")).alias("skip"),
                    F.col("other.path").alias("path2"), F.col("other.first").alias("first2"), (4 * F.col("a") - F.col("other.before")).alias("skip2")))
    work = materialize(work)
    schema = pa.schema([("file_no", pa.int32()), ("read_no", pa.int64()), ("r1", pa.string()), ("r2", pa.string())])

    def run(batches):
        for batch in batches:
            for w in batch.to_pylist():
                n, at = w["b"] - w["a"], w["a"]
                both = zip(every_fourth(lines_from(w["path"], w["first"], w["skip"]), n),
                           every_fourth(lines_from(w["path2"], w["first2"], w["skip2"]), n))
                while rows := list(islice(both, BATCH_ROWS)):
                    r1, r2 = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array([w["file_no"]] * len(rows), pa.int32()),
                                                      pa.array(range(at, at + len(rows)), pa.int64()), pa.array(r1), pa.array(r2)], schema=schema)
                    at += len(rows)

    return work.repartition(range_tasks(work.count(), range_bytes)).mapInArrow(run, "file_no int, read_no bigint, r1 string, r2 string")


def read_tag_library(spark: SparkSession, path: str) -> DataFrame:
    """``id<TAB>sequence`` lines -> ``(pos, tag_id, seq)`` with ``pos`` the line
    number; a repeated sequence keeps its first position and takes the last id."""
    require_exists(spark, path)
    raw = (spark.read.text(path)
           .select("value", F.col("_metadata.file_path").alias("_f"),
                   F.col("_metadata.file_block_start").alias("_b"),
                   F.monotonically_increasing_id().alias("_r")))
    lines = dense_positions(raw, [F.col("_f"), F.col("_b"), F.col("_r")], name="pos")
    parts = F.split(F.regexp_replace("value", r"[\r\n\s]+$", ""), "\t")
    lib = lines.where(F.length(F.trim("value")) > 0).select(
        "pos", F.get(parts, 0).alias("tag_id"), F.get(parts, 1).alias("seq"))
    bad = lib.where(F.col("seq").isNull()).limit(1).count()
    if bad:
        raise ValueError(f"{path}: every line must be 'id<TAB>sequence'")
    return (lib.groupBy("seq").agg(F.min("pos").alias("pos"), F.max_by("tag_id", "pos").alias("tag_id"))
            .select("pos", "tag_id", "seq"))
