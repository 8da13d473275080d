"""Best-fit packing of token pieces into sequences of a fixed length by minimum bin slack.

1. Texts become token counts in one pass over the documents: ids, the end id,
   and pieces of at most ``size`` tokens (only longer documents are cut; the
   first piece is the shorter one).  Only numbers leave this pass.
2. Pieces are dealt at random into bins of about ``GROUP`` pieces, each one task's
   bounded work.  How many pieces share a document, a length or a source plays
   no part in this, so there is no hot group.
3. In a group, sequences are closed one after the other.  The longest piece
   left is in; a bitset holds which sums the other available lengths can reach
   (a length with ``c`` pieces counts as 1, 2, 4 ... of them), the highest sum
   that fits is traced back to its lengths, and the combination is removed, as
   often as the pieces left allow.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import ref, stored, with_workers
from cellgrid.llm.tokens import encoder

GROUP = 16_384   # pieces that one task packs at a time (expected)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``n`` tokens."""
    first = n % size or min(n, size)
    ends = range(first, n + 1, size)
    return [(max(0, e - size) if e > first else 0, first if e == first else size) for e in ends] if n else []


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document."""
    with_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for b in batches:
            rows: list[tuple] = []
            for i, ids in enumerate(enc.many(b.column("text").to_pylist())):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    rows.append((i, k, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])))
            if rows:   # ids are taken in Arrow, so they stay as they are beside nulls too
                at, *columns = zip(*rows)
                columns = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *columns],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(ref(docs, id_col).alias("doc_id"), ref(docs, text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths whose sum is the largest that ``room`` holds.  ``lengths`` is
    sorted downwards; with ``counts`` it says what is available."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    full = 1 << room
    for length in lengths:
        if length > room:
            continue
        left, times = min(counts[length], room // length), 1
        while left > 0:
            n = min(times, left)
            steps.append((reach, length, n))
            reach |= (reach << (n * length)) & mask
            left -= n
            times *= 2
        if reach & full:
            break
    target, used = reach.bit_length() - 1, []
    for before, length, n in reversed(steps):
        if not before >> target & 1:
            used += [length] * n
            target -= n * length
    return used


def pack_lengths(length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, offset)`` of every piece, sequences numbered from 0."""
    order = np.argsort(-length, kind="stable")
    values, first, many = np.unique(-length[order], return_index=True, return_counts=True)
    lengths = [int(-v) for v in values]
    counts = dict(zip(lengths, many.tolist()))
    place = dict(zip(lengths, first.tolist()))    # next unused piece of a length, in ``order``
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    number = 0
    while lengths:
        top = lengths[0]
        counts[top] -= 1
        chosen = [top, *fullest(lengths, counts, size - top)]
        counts[top] += 1
        need: dict[int, int] = {}
        for v in chosen:
            need[v] = need.get(v, 0) + 1
        times = min(counts[v] // k for v, k in need.items())
        for _ in range(times):
            at = 0
            for v in chosen:
                p = order[place[v]]
                place[v] += 1
                sequence[p], offset[p] = number, at
                at += v
            number += 1
        gone = False
        for v, k in need.items():
            counts[v] -= k * times
            gone |= not counts[v]
        if gone:
            lengths = [v for v in lengths if counts[v]]
    return sequence, offset


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id",
         text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` per piece.

    Null text counts as empty: one piece that holds the end id.  Rows that
    repeat an id are documents of their own; null ids are kept.  Columns besides
    id and text are ignored.  An empty table gives an empty result.
    """
    found = stored(pieces(docs, tokenizer, size, end_id, id_col, text_col), "pieces")
    groups = max(1, -(-found.count() // group))

    def solve(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        sequence, offset = pack_lengths(t["length"].to_numpy(), size)
        t = t.drop_columns(["row", "bin"])
        return t.append_column("sequence_id", pa.array((key[0].as_py() << 32) + sequence)).append_column("offset", pa.array(offset))

    kind = found.schema["doc_id"].dataType.simpleString()
    dealt = found.withColumn("row", F.monotonically_increasing_id()).withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("bin").applyInArrow(
        solve, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
