"""Queries of this subpackage over the test tables: ``(spark, sf_dir)``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm import align, ann, audit, covertree, exact, lines, mixing, packing, quality, simhash, tokenfile, toxicity, warc
from cellgrid.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 2048 byte-BPE tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        size=2048, end_id=0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates: three-word shingles, links at 3 bits or fewer."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to weights in proportion to the square root of their size, as many rows as before."""
    return mixing.mix(_table(spark, sf_dir, "documents"), alpha=0.5, seed=7)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one, exactly or nearly."""
    return lines.dedup_lines(_table(spark, sf_dir, "documents"), min_words=1, fuzzy_chars=10, max_bits=3, sketch=True, similarity=0.8,
                             length_col="n_chars")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by random-indexing vectors and a small network; held out: remainder 0 of 5."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), held_out=0, mod=5)
    found = quality.score(docs, model)
    return found.select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
                        "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-BPE ids of every document written to token files and read back."""
    docs = _table(spark, sf_dir, "documents")
    files = tokenfile.write_tokens(docs, tokenfile.token_folder(spark), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokenfile.read_documents(files, docs.schema["doc_id"].dataType.simpleString())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity by non-negative positive-unlabelled learning; held out: remainder 2 of 4."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), held_out=2, mod=4)
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
                        "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every page, written to archives and read back by byte ranges."""
    folder = scratch_path(spark, "warc")
    files = warc.write_archives(_table(spark, sf_dir, "pages"), folder, min_bytes=0)
    if not files.limit(1).count():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    found = warc.read_records(spark, folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    return ann.search(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at a cosine of 0.98 or more."""
    return covertree.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source in each of their 120 orders."""
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are equal but for A-Z in lower case; the largest id stays."""
    return exact.duplicates(_table(spark, sf_dir, "documents"), largest=True)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-BPE and sentencepiece tokens of every text aligned, with corpus counts of id pairs."""
    return align.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                       public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_token_files": op6_token_files,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_neighbours": op9_neighbours,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_alignment": op13_alignment,
}
