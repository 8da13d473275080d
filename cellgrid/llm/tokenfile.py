"""Token ids in files of directly addressable codes.

A file holds the ids of whole documents.  An id is cut into chunks of 8 bits,
lowest first.  Level 0 has one chunk for every token; a continuation bitmap
says which tokens go on, and level 1 has a chunk for exactly these, and so on.
A rank directory (ones before every 512 bits) turns a position of one level
into its position on the next: any token, or any run of tokens, is read with
one lookup per level, and nothing before it is decoded.

Layout (little-endian): ``DAC1``, header length (uint32), JSON header with the
place of every section, then the sections: for each level chunks, bitmap and
ranks (uint32); the token offsets of the documents (int64); the document
ids (Arrow stream).  Files are numbered in ascending document id.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellgrid.llm.common import ref, stored, with_workers
from cellgrid.llm.files import locate, write_file
from cellgrid.llm.tokens import encoder

MAGIC = b"DAC1"
RANK = 512                # bits between two entries of a rank directory
FILE_TOKENS = 8_000_000   # a file is closed once it holds this many tokens


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(chunks, bitmap, ranks)`` per level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.pad(bitmap, (0, -len(bitmap) % (RANK // 8)))
        ones = np.bitwise_count(bitmap.reshape(-1, RANK // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        levels.append(((rest & 0xFF).astype(np.uint8), bitmap, ranks))
        if not more.any():
            return levels
        rest = rest[more] >> 8


def write_documents(uri: str, doc_ids: pa.Array, ids: list[bytes]) -> None:
    """One file with the ids (little-endian uint32 bytes) of these documents."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<i8")
    sink = pa.BufferOutputStream()
    table = pa.table({"doc_id": doc_ids})
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    sections = [s.tobytes() for level in encode_levels(flat) for s in level] + [offsets.tobytes(), sink.getvalue().to_pybytes()]
    ends = np.cumsum([len(s) for s in sections]).tolist()
    head = json.dumps({"tokens": len(flat), "documents": len(ids), "levels": (len(sections) - 2) // 3,
                       "ends": ends, "rank_bits": RANK, "chunk_bits": 8}).encode()

    def write(out) -> None:
        out.write(MAGIC + len(head).to_bytes(4, "little") + head)
        for s in sections:
            out.write(s)

    write_file(uri, write)


class TokenFile:
    """Random access to a token file; a section is read when it is first needed."""

    def __init__(self, uri: str):
        where, path = locate(uri)
        self._in = where.open_input_file(path)
        start = self._in.read_at(8, 0)
        if start[:4] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        size = int.from_bytes(start[4:8], "little")
        self.head = json.loads(self._in.read_at(size, 8))
        self._at = 8 + size
        self._sections: dict[int, bytes] = {}

    def __len__(self) -> int:
        return self.head["tokens"]

    def _section(self, k: int) -> bytes:
        if k not in self._sections:
            ends = self.head["ends"]
            begin = ends[k - 1] if k else 0
            self._sections[k] = self._in.read_at(ends[k] - begin, self._at + begin)
        return self._sections[k]

    def _level(self, k: int, what: int, kind: str) -> np.ndarray:
        return np.frombuffer(self._section(3 * k + what), dtype=kind)

    def _rank(self, k: int, i: int) -> int:
        """Ones of level ``k``'s bitmap before position ``i``."""
        block, bitmap = i // RANK, self._level(k, 1, "u1")
        ones = int(self._level(k, 2, "<u4")[block])
        first = block * (RANK // 8)
        ones += int(np.bitwise_count(bitmap[first:i // 8]).sum())
        return ones + (int(bitmap[i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else ones

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive), from their own chunks only."""
        out = np.zeros(max(0, end - start), dtype="<u4")
        at, shift = np.arange(len(out)), 0
        for k in range(self.head["levels"]):
            if end <= start:
                break
            out[at] |= self._level(k, 0, "u1")[start:end].astype(np.uint32) << np.uint32(shift)
            bits = np.unpackbits(self._level(k, 1, "u1")[start // 8:(end + 7) // 8], bitorder="little")
            more = bits[start % 8:start % 8 + end - start].astype(bool)
            at, shift = at[more], shift + 8
            start = self._rank(k, start)
            end = start + len(at)
        return out

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])

    def documents(self) -> tuple[pa.Array, np.ndarray]:
        """Document ids and their token offsets (one more than documents)."""
        n = 3 * self.head["levels"]
        ids = pa.ipc.open_stream(self._section(n + 1)).read_all()["doc_id"]
        return ids, np.frombuffer(self._section(n), dtype="<i8")

    def close(self) -> None:
        self._in.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id",
                 text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write every document's ids, each followed by ``end_id``, in ascending
    document id (nulls first; ties by text) into files under ``folder``.

    Returns the stored manifest ``(part, number, path, documents, tokens, base)``,
    one row per file; ``base`` counts the ids in all files before it.  Null text
    counts as empty; an empty table writes no file.
    """
    spark = with_workers(docs.sparkSession)
    src = docs.select(ref(docs, id_col).alias("doc_id"), ref(docs, text_col).cast("string").alias("text"))
    order = ["doc_id", "h", "row"]  # ties of a hot id are split as well
    src = src.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    src = src.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        names, ids, held, number = [], [], 0, 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/tokens-{part:06d}-{number:06d}.dac"
            write_documents(uri, pa.concat_arrays(names), ids)
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "path": uri, "documents": len(ids), "tokens": held}],
                                              schema=schema)

        for b in batches:
            for i, one in enumerate(enc.many(b.column("text").to_pylist())):
                one += end
                names.append(b.column("doc_id").slice(i, 1))
                ids.append(one)
                held += len(one) // 4
                if held >= file_tokens:
                    yield close()
                    names, ids, held, number = [], [], 0, number + 1
        if ids:
            yield close()

    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])
    files = stored(src.mapInArrow(run, "part int, number int, path string, documents bigint, tokens bigint"), "token-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


@lru_cache(maxsize=2)
def _open(uri: str) -> TokenFile:
    return TokenFile(uri)


def read_documents(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files."""
    with_workers(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                f = _open(path)
                names, offsets = f.documents()
                crc = [zlib.crc32(f.tokens(s, e).tobytes()) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                columns = [names.combine_chunks(), pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task per file: rows are few and short, so they would be merged into one task
    files = manifest.select("path", "base").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_folder(spark: SparkSession) -> str:
    """A fresh folder for token files in the shared scratch space."""
    from cellgrid.session import scratch_path

    return scratch_path(spark, "tokens")
