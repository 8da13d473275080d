"""Cross-tokenizer alignment over exact-text classes.

A text is tokenised twice (A: byte-level BPE of a blank and the text; B: a
sentencepiece model, which puts the blank in itself).  Byte offsets where tokens of A
and of B both end cut the two lists into groups; an A token and a B token of one group
are linked.

1. Documents are shuffled by their full text and counted: every distinct text is
   tokenised and aligned once, and what it adds to corpus counts is weighted with its
   number of documents.
2. Texts are aligned in *blocks* of about ``BLOCK`` characters.  A text is cut into chunks
   before blanks that follow no white space: neither vocabulary has a token across such a
   place (checked against B's pieces), so a chunk's tokens, groups and links do not depend on
   its surroundings, and chunks seen before are looked up.  A block is stored with its
   distinct id pairs, the documents that hold each, and per text which pairs it holds how often.
3. Corpus counts of pairs are one grouped sum over the blocks' pairs; the highest
   count of an A id is a maximum over at most as many rows as B has pieces.
4. The counts go back to the blocks as rows (block, pair), far fewer than (text, pair),
   and every block adds up its texts' measures: a block is one task's bounded work.
5. Measures meet the documents by run and digest as in ``exact``: copies of a hot text
   never meet in one key.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm.common import ref, stored, with_workers
from cellgrid.llm.exact import SAME, attach, digested, runs_of

BLOCK = 2_500_000      # characters of texts in a block; a longer text is a block of its own
REMEMBERED = 250_000   # chunks a worker remembers from block to block
LARGE = 1024           # links of a group beyond which ids are counted before they are paired
LONGEST = 48           # longer chunks are forgotten after their block
# a lone last blank stays with its chunk: B puts no blank before an empty text
_CHUNK = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*(?: \Z)?")
_BYTE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable bytes
    for themselves, the others in turn from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers and the byte strings of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True   # strings of special tokens are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = _byte_alphabet()
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in names.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(_BYTE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_sizes = np.zeros(max(self.a_bytes, default=0) + 1, np.int64)
        for i, x in self.a_bytes.items():
            self.a_sizes[i] = len(x)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        # ids as text with the mark that follows them in a written group
        every = range(max(len(self.a_sizes), len(pieces)))
        self.listed, self.last_a, self.last_b = (np.array([f"{i}{mark}" for i in every], object) for mark in ",|;")
        # chunks stand alone only if no piece reaches over a blank and nothing is normalised away
        probe = " a  béﬁ　 "
        same = b"".join(self.b_bytes[i] for i in self.b.encode(probe)) == (" " + probe).encode()
        self.cuts = same and not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a blank (which B puts in itself)."""
        call = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        return ([e.ids for e in call(chunks, add_special_tokens=False)],
                self.b.encode([c[1:] for c in chunks], num_threads=1))

    def fitting(self, chunks: list[str], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Which chunks are what their joined tokens are, on both sides."""
        texts = [c.encode("utf-8", "surrogatepass") for c in chunks]
        fine = np.ones(len(chunks), bool)
        for ids, names in ((a, self.a_bytes), (b, self.b_bytes)):
            joined = [b"".join([names[i] for i in one]) for one in ids]
            if joined != texts:
                fine &= [x == y for x, y in zip(joined, texts)]
        return fine


def _expanded(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1 ... `` (``many[i]`` of them) for every i in turn."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


@lru_cache(maxsize=2)
def _pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


class Chunks:
    """What is known of the chunks of one worker: counts, groups as text, id pairs."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.facts = array("q")                  # ok, tokens of A, tokens of B, groups, links of each chunk
        self.parts: list[str] = []               # its groups, written out, each with a mark at its end
        self.starts, self.pairs, self.times = array("q", [0]), array("q"), array("q")
        self.numbers: dict[int, int] = {}        # number of an id pair
        self.codes = array("q")                  # id pair of a number: A id << 32 | B id

    def _number(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of id pairs, new ones in turn."""
        kinds, back = np.unique(codes, return_inverse=True)
        for code in kinds.tolist():
            if code not in self.numbers:
                self.numbers[code] = len(self.codes)
                self.codes.append(code)
        return np.array([self.numbers[c] for c in kinds.tolist()], np.int64)[back]

    def _add(self, chunks: list[str]) -> range:
        """Align new chunks, all at once: laid end to end, the place where one ends is
        an end on both sides, so groups never reach over it."""
        pair, n = self.pair, len(chunks)
        a, b = pair.encode(chunks)
        fine = pair.fitting(chunks, a, b)
        a, b = ([x if ok else [] for x, ok in zip(ids, fine.tolist())] for ids in (a, b))
        many_a, many_b = (np.fromiter(map(len, ids), np.int64, n) for ids in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a, b))
        ends_a, ends_b = np.cumsum(pair.a_sizes[flat_a]), np.cumsum(pair.b_sizes[flat_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        size_a, size_b = np.bincount(in_a, minlength=len(common)), np.bincount(in_b, minlength=len(common))
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        chunk_of = np.repeat(np.arange(n), many_a)[first_a] if len(common) else np.zeros(0, np.int64)

        # every A token with every B token of its group; of large groups each pair of ids once
        large = size_a * size_b > LARGE
        token = np.flatnonzero(~large[in_a])
        partners = size_b[in_a[token]]
        codes = np.repeat(flat_a[token] << 32, partners) | flat_b[_expanded(first_b[in_a[token]], partners)]
        owner, times = np.repeat(chunk_of[in_a[token]], partners), np.ones(len(codes), np.int64)
        for g in np.flatnonzero(large).tolist():
            xs, nx = np.unique(flat_a[first_a[g]:first_a[g] + size_a[g]], return_counts=True)
            ys, ny = np.unique(flat_b[first_b[g]:first_b[g] + size_b[g]], return_counts=True)
            codes = np.concatenate([codes, (xs[:, None] << 32 | ys).ravel()])
            times = np.concatenate([times, (nx[:, None] * ny).ravel()])
            owner = np.concatenate([owner, np.full(len(xs) * len(ys), chunk_of[g])])
        if large.any():
            order = np.argsort(owner, kind="stable")
            codes, times, owner = codes[order], times[order], owner[order]
        self.pairs.frombytes(self._number(codes).tobytes())
        self.times.frombytes(times.tobytes())
        self.starts.frombytes((self.starts[-1] + np.cumsum(np.bincount(owner, minlength=n))).tobytes())
        facts = np.stack([fine, many_a, many_b, np.bincount(chunk_of, minlength=n),
                          np.bincount(chunk_of, size_a * size_b, n)], axis=1).astype(np.int64)
        self.facts.frombytes(facts.tobytes())

        # written out: tokens in the order of group, side and place, each with the mark that follows it
        out = np.empty(len(flat_a) + len(flat_b), object)
        out[np.arange(len(flat_a)) + first_b[in_a]] = np.where(np.diff(in_a, append=-1) == 0, pair.listed[flat_a], pair.last_a[flat_a])
        out[np.arange(len(flat_b)) + (first_a + size_a)[in_b]] = np.where(np.diff(in_b, append=-1) == 0, pair.listed[flat_b], pair.last_b[flat_b])
        out, at, base = out.tolist(), 0, len(self.parts)
        for k in (many_a + many_b).tolist():
            self.parts.append("".join(out[at:at + k]))
            at += k
        return range(base, base + n)

    def numbers_of(self, texts: list[str]) -> list[list[int]]:
        """The chunks of every text, by number."""
        if len(self.parts) > REMEMBERED:
            self.clear()
        cut = [(_CHUNK.findall(" " + t) if self.pair.cuts else [" " + t]) if t else [] for t in texts]
        found = [list(map(self.known.get, chunks)) for chunks in cut]
        new = {c for chunks, ns in zip(cut, found) if None in ns for c, n in zip(chunks, ns) if n is None}
        if new:
            new = list(new)
            here = dict(zip(new, self._add(new)))
            for chunks, ns in zip(cut, found):
                if None in ns:
                    ns[:] = [here[c] if n is None else n for c, n in zip(chunks, ns)]
            self.known.update((c, n) for c, n in here.items() if len(c) <= LONGEST)
        return found

    def block(self, texts: list[str], docs: np.ndarray) -> dict:
        """A block's columns: its distinct pairs, and per text measures and pairs."""
        found = self.numbers_of(texts)
        sizes = np.array([len(f) for f in found], np.int64)
        at = np.repeat(np.arange(len(texts)), sizes)
        chunk = np.array([n for f in found for n in f], np.int64)
        facts = np.frombuffer(self.facts, np.int64).reshape(-1, 5)
        fine = np.ones(len(texts), bool)
        fine[at[facts[chunk, 0] == 0]] = False
        at, chunk = at[fine[at]], chunk[fine[at]]
        sums = [np.bincount(at, facts[chunk, k], len(texts)).astype(np.int64) for k in range(1, 5)]
        shas = [hashlib.sha256("".join([self.parts[n] for n in f])[:-1].encode()).hexdigest() if ok and f else ""
                for f, ok in zip(found, fine.tolist())]
        # every (text, pair) once, with its links
        starts = np.frombuffer(self.starts, np.int64)
        many = starts[chunk + 1] - starts[chunk]
        place = _expanded(starts[chunk], many)
        pair, times = np.frombuffer(self.pairs, np.int64)[place], np.frombuffer(self.times, np.int64)[place]
        key, back = np.unique(np.repeat(at, many) * (len(self.codes) + 1) + pair, return_inverse=True)
        links = np.bincount(back, times, len(key)).astype(np.int64)
        text, pair = np.divmod(key, len(self.codes) + 1)
        used = np.unique(pair)
        codes = np.frombuffer(self.codes, np.int64)[used]
        order = np.argsort(codes)
        rank = np.empty(len(used), np.int64)
        rank[order] = np.arange(len(used))
        pair = rank[np.searchsorted(used, pair)]
        return {"codes": codes[order], "docs": np.bincount(pair, docs[text], len(used)).astype(np.int64),
                "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[3], "groups_sha256": shas,
                "ends": np.cumsum(np.bincount(text, minlength=len(texts))), "pair": pair.astype("<u4").tobytes(), "times": links.astype("<i8").tobytes()}


@lru_cache(maxsize=1)
def _chunks(a_path: str, b_path: str) -> Chunks:
    return Chunks(_pair(a_path, b_path))


_LISTS = {"sha": "binary", "bytes": "bigint", "check": "bigint", "codes": "bigint", "docs": "bigint", "n_a": "bigint", "n_b": "bigint",
          "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string", "ends": "bigint"}
_ARROW = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}
_BLOCKS = "block bigint, " + ", ".join(f"{k} array<{v}>" for k, v in _LISTS.items()) + ", pair binary, times binary"


def aligned_blocks(texts: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """Stored blocks of distinct texts ``(text, n, sha, bytes, check)``."""
    with_workers(texts.sparkSession)
    fields = [("block", pa.int64())] + [(k, pa.list_(_ARROW[v])) for k, v in _LISTS.items()] + [("pair", pa.binary()), ("times", pa.binary())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunks = TaskContext.get().partitionId() << 32, _chunks(a_path, b_path)
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            text, n, *same = zip(*held)
            row = {"block": number, **dict(zip(SAME, same)), **chunks.block(list(text), np.array(n, np.int64))}
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("text", "n", *SAME))):
                held.append(row)
                size += len(row[0])
                if size >= block:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return stored(texts.select("text", "n", *SAME).mapInArrow(run, _BLOCKS), "aligned")


def pair_counts(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(of, code)`` rows of the blocks, and stored ``(code, count, best)``: documents that hold
    an id pair linked, and whether its A id has no pair with more."""
    rows = blocks.select("block", F.explode(F.arrays_zip("codes", "docs")).alias("p")).select("block", "p.codes", "p.docs")
    counts = rows.groupBy(F.col("codes").alias("code")).agg(F.sum("docs").alias("count"))
    of_a = Window.partitionBy(F.shiftright("code", 32))   # at most as many rows as B has pieces
    ranked = counts.withColumn("best", F.col("count") == F.max("count").over(of_a))
    return rows.select(F.col("block").alias("of"), F.col("codes").alias("code")), stored(ranked, "pair-counts")


def _measures(key: tuple, block: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """Per text of one block what the corpus counts of its pairs add up to."""
    names = [*SAME, "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    if not len(block):
        return pd.DataFrame(columns=names + ["n_best", "count_sum"])
    b = block.iloc[0]
    pairs = pairs.sort_values("code")
    pair, times = np.frombuffer(b["pair"], "<u4"), np.frombuffer(b["times"], "<i8")
    ends = np.concatenate([[0], np.asarray(b["ends"], np.int64)])
    out = pd.DataFrame({n: list(b[n]) for n in names})
    for name, value in (("n_best", pairs["best"].to_numpy(bool)), ("count_sum", pairs["count"].to_numpy(np.int64))):
        upto = np.concatenate([[0], np.cumsum(value[pair] * times)])
        out[name] = upto[ends[1:]] - upto[ends[:-1]]
    return out


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` per row of ``docs``.

    Texts that are null, empty, or of which the joined tokens of A or B are not a
    blank and the text, have no tokens: zeros and an empty digest.  Repeated rows
    and null ids are documents like all others.  Other columns are ignored,
    whatever their names.  An empty table gives an empty result.
    """
    text = ref(docs, text_col).cast("string")
    texts = docs.select(F.coalesce(text, F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    texts = texts.select("text", "n", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("bigint").alias("bytes"),
                         F.xxhash64("text").alias("check"))
    blocks = aligned_blocks(texts, a_path, b_path, block)
    rows, ranked = pair_counts(blocks)
    counted = rows.join(ranked, "code")
    facts = (blocks.select("block", *SAME, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ends", "pair", "times")
             .groupBy("block").cogroup(counted.groupBy("of"))
             .applyInPandas(_measures, "sha binary, bytes bigint, check bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                                       "groups_sha256 string, n_best bigint, count_sum bigint"))
    facts = stored(facts, "measures")
    by_doc = digested(docs, text, id_col)
    runs = runs_of(by_doc, F.max, F.col("id"))
    return attach(by_doc, runs, facts).select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
