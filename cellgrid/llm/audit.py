"""How filters interact: what each removes in every order they can be applied in.

1. One pass over the documents evaluates the filters that a text alone decides and
   keeps a small row: id, part, digest, failing filters as bits of a mask.  The labels
   are joined to these rows by id, and rows that repeat an id are counted together.
2. Duplicates need the smallest id of each digest.  Rows are first counted by (digest,
   part, labels), so a text that is a third of the corpus is a few rows when digests
   meet, and what is compared there are these counts.
3. Documents that agree in part, mask and labels are a *mask cell*: at most 32 masks
   times four labels a part, whatever the size of the corpus.
4. Every cell folds across the array of all orders (a literal of the plan, 120 rows of
   five): ``transform`` goes through the orders, ``aggregate`` applies the filters of one
   from left to right and writes a struct for each step, weighted with the cell's
   documents.  The 600 structs of each cell of a part are merged by elementwise sums,
   in every task before they are shuffled.  Documents are not touched again, so an order more costs nothing per document.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellgrid.llm.common import ref, shuffle_parts, stored

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 200       # A: fewer words
DISTINCT_PERCENT = 50  # B: fewer distinct words than this share
UPPER_PERCENT = 2     # C: more A-Z than this share of the code points
SYMBOLS = r"[#$%&*|]"  # D: any of these
FILTERS = "ABCDE"     # E: identical to the text of a smaller id
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits 0-3: the filters A-D that a whole text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def mask(w: Column) -> Column:
        n, distinct = F.size(w).cast("bigint"), F.size(F.array_distinct(w)).cast("bigint")
        upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
        fails = [n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n,
                 100 * upper.cast("bigint") > UPPER_PERCENT * F.length(text).cast("bigint"), text.rlike(SYMBOLS)]
        bits = [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)]
        return bits[0] + bits[1] + bits[2] + bits[3]

    # the words are found once and then used three times
    return F.get(F.transform(F.array(words), mask), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               part_col: str = "source") -> DataFrame:
    """Stored ``(part, mask, good, toxic, n)``: documents by part, failing filters and labels.

    Null text and null part count as empty strings.  A null id has no label and is
    neither smaller nor larger than another; equal ids are not smaller either.  A
    document is good (toxic) if any of its label rows says 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(ref(docs, id_col).alias("id"), ref(docs, text_col).cast("string").alias("text"),
                       F.coalesce(ref(docs, part_col).cast("string"), F.lit("")).alias("part"))
    rows = stored(rows.select("id", "part", F.unhex(F.sha2(text, 256)).alias("sha"), text_mask(text).alias("abcd")), "masks")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flag = [F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")]
    with_id = rows.where("id is not null").groupBy("id", "sha", "part", "abcd").agg(F.count(F.lit(1)).alias("n"))
    with_id = with_id.join(marks, "id", "left").select("id", "sha", "part", "abcd", *flag, "n")
    no_id = rows.where("id is null").groupBy("sha", "part", "abcd").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast(with_id.schema["id"].dataType).alias("id"), "sha", "part", "abcd", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    groups = stored(with_id.unionByName(no_id).groupBy("sha", "part", "abcd", "good", "toxic").agg(
        F.sum("n").alias("n"), first.alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("free")), "by-digest")
    # rows of the smallest id of a digest, and rows without an id, are no copies
    low = groups.groupBy("sha").agg(F.min("first.id").alias("low"))
    own = F.col("free") + F.when(F.col("first.id") == F.col("low"), F.col("first.n")).otherwise(F.lit(0))
    groups = groups.join(low, "sha").select("part", "abcd", "good", "toxic", F.explode(F.array(
        F.struct(F.col("abcd").alias("mask"), own.alias("n")),
        F.struct((F.col("abcd") + F.lit(16)).alias("mask"), (F.col("n") - own).alias("n")))).alias("cell"))
    return stored(groups.where("cell.n > 0").groupBy("part", F.col("cell.mask").alias("mask"), "good", "toxic")
                  .agg(F.sum("cell.n").alias("n")), "cells")


def orders(filters: str = FILTERS) -> Column:
    """Every order of the filters as ``array<struct<name, array<struct<letter, bit>>>>``."""
    return F.array(*[F.struct(F.lit("".join(o)).alias("name"), F.array(*[
        F.struct(F.lit(f).alias("letter"), F.lit(1 << filters.index(f)).alias("bit")) for f in o]).alias("steps"))
        for o in permutations(filters)])


def folded(cell: Column, all_orders: Column) -> Column:
    """What one cell adds to every order and step: an array of structs."""
    zero = F.lit(0).cast("bigint")

    def one(order: Column) -> Column:
        def step(state: Column, f: Column) -> Column:
            fails = cell["mask"].bitwiseAND(f["bit"]) != 0
            gone = F.when(fails, state["alive"]).otherwise(zero)   # the cell goes here, all of it or nothing
            late = F.when(fails, cell["n"] - state["alive"]).otherwise(zero)
            alone = F.when(cell["mask"] == f["bit"], cell["n"]).otherwise(zero)
            row = F.struct(order["name"].alias("filter_order"), (F.size(state["rows"]) + 1).alias("step"), f["letter"].alias("letter"),
                           (state["alive"] - gone).alias("kept"), gone.alias("removed"), late.alias("redundant"),
                           alone.alias("unique_fails"), (gone * cell["good"]).alias("good_lost"), (gone * cell["toxic"]).alias("toxic_lost"))
            return F.struct((state["alive"] - gone).alias("alive"), F.concat(state["rows"], F.array(row)).alias("rows"))

        empty = F.array().cast("array<struct<filter_order:string,step:int,letter:string," + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")
        return F.aggregate(order["steps"], F.struct(cell["n"].alias("alive"), empty.alias("rows")), step, lambda s: s["rows"])

    return F.flatten(F.transform(all_orders, one))


def interactions(cells: DataFrame) -> DataFrame:
    """One row per part, order and step from ``mask_cells``.

    ``shapley`` is the filter's ``removed`` summed over all orders.  No cells: no rows."""
    cell = F.struct("mask", "n", F.col("good").cast("bigint").alias("good"), F.col("toxic").cast("bigint").alias("toxic"))
    dealt = cells.select("part", cell.alias("cell")).repartition(shuffle_parts(cells.sparkSession), "cell", "part")
    rows = dealt.select("part", F.explode(folded(F.col("cell"), orders())).alias("r"))
    # elementwise: the structs of one order and step, summed in every task first
    merged = rows.groupBy("part", "r.filter_order", "r.step", "r.letter").agg(*[F.sum(f"r.{c}").alias(c) for c in COUNTS])
    every_order = Window.partitionBy("part", "letter")   # 120 rows
    return merged.select("part", "filter_order", "step", *COUNTS, F.sum("removed").over(every_order).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``interactions`` of the filters over whole ``docs``; other columns are ignored.
    An empty table gives an empty result."""
    return interactions(mask_cells(docs, labels, id_col, text_col, part_col))
