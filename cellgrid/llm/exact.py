"""Exact duplicates by a tree-merge of sorted digest runs, DataFrame functions only.

1. One pass over the documents keeps a small row of each: its SHA-256, its length
   in bytes, an independent 64-bit hash and the partition it was read in.  Texts
   do not leave this pass.
2. Every partition's rows become a *run*: one row per distinct digest with the
   identifier that stays and the number of rows, sorted by digest.
3. Runs meet in binomial rounds: in a round, ``FAN_IN`` neighbouring runs are merged
   into one, so ``n`` runs take log(n) rounds.  Merged rows are those that agree in
   digest *and* in length and second hash (a collision of one of them would stay
   two rows), the better identifier stays and counts add up.  A run is cut into slices
   by the first bits of its digests: a slice of a run is sorted and merged by one task,
   so also the last run is spread over the cluster.
4. The decisions go back to the runs of the first level (a digest has at most one row
   in each) and from there, by run and digest, to the documents.

A text that is a third of all rows is one row per run after step 2, and its documents
meet the decision in as many keys as there are runs: no step has a hot key.  Every level
is a stored table, so a lost executor repeats its tasks of one round only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import ref, stored

FAN_IN = 8       # runs merged into one in a round
SLICE_BITS = 12  # digest bits that cut a run into slices
SAME = ["sha", "bytes", "check"]   # rows that agree in all three are one text


def lowered(text: Column) -> Column:
    """``text`` with A-Z (and nothing else) in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ascii_only = F.octet_length(text) == F.length(text)   # lower() then changes nothing but A-Z
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def digested(docs: DataFrame, text: Column, id_col: str) -> DataFrame:
    """Stored ``(row, run, id, sha, bytes, check)``, one row per document; ``run``
    is the partition it was read in."""
    found = docs.select(ref(docs, id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    return stored(found.select(
        F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"), "id",
        F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("bigint").alias("bytes"),
        F.xxhash64("text").alias("check")), "digests")


def _slice() -> Column:
    return F.shiftright(F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("bigint"), 32 - SLICE_BITS).cast("int")


def runs_of(rows: DataFrame, pick: Callable, best: Column) -> DataFrame:
    """The sorted runs of the first level: ``(run, slice, sha, bytes, check, keep, n)``."""
    one = rows.withColumn("slice", _slice()).groupBy("run", "slice", *SAME).agg(pick(best).alias("keep"), F.count(F.lit(1)).alias("n"))
    return stored(one.sortWithinPartitions("run", "slice", "sha"), "runs")


def merged(runs: DataFrame, pick: Callable, fan_in: int = FAN_IN) -> DataFrame:
    """All runs merged into one in rounds of ``fan_in``: ``(sha, bytes, check, keep, n)``."""
    last = runs.agg(F.max("run")).first()[0] or 0
    step = max(1, fan_in.bit_length() - 1)
    while last > 0:
        met = (runs.withColumn("run", F.shiftright("run", step))
               .repartition("run", "slice").sortWithinPartitions("run", "slice", "sha"))
        # the exchange deals whole slices of a run, so merging needs no other one
        runs = stored(met.groupBy("run", "slice", *SAME).agg(pick("keep").alias("keep"), F.sum("n").alias("n")), "runs")
        last >>= step
    return runs.select(*SAME, "keep", "n")


def attach(rows: DataFrame, runs: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` of ``digested`` with the columns that ``facts`` has per text.

    ``facts`` meets the runs first (a text has at most one row in each) and then
    the rows of each run, so copies of one text never meet in one key."""
    extra = [c for c in facts.columns if c not in SAME]
    per_run = runs.select("run", *SAME).join(facts, SAME)
    return rows.join(per_run.select("run", *SAME, *extra), ["run", *SAME])


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True,
               fan_in: int = FAN_IN) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row of ``docs``.

    Texts are equal if they are identical once A-Z are in lower case; null counts as
    empty.  Of equal texts the row with the largest id stays (``largest=False``: the
    smallest); null ids stay only where all ids of a text are null (``keep_id`` is
    null then).  Of rows that repeat the id that stays exactly one is ``kept``.
    Other columns are ignored, whatever their names.  An empty table gives an
    empty result.
    """
    text = ref(docs, text_col).cast("string")
    rows = digested(docs, lowered(text), id_col)
    known = F.col("id").isNotNull()
    # a known id beats null either way
    best = F.struct((known if largest else ~known).alias("known"), "id", "row")
    pick = F.max if largest else F.min
    runs = runs_of(rows, pick, best)
    facts = merged(runs, pick, fan_in)
    facts = facts.select(*SAME, F.col("keep.id").alias("keep_id"), F.col("keep.row").alias("keep_row"), F.col("n").alias("group_size"))
    return attach(rows, runs, facts).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
