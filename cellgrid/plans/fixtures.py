"""Datasets derived from the test tables (see FIXTURES.md).

M1  cells = orders, genes = parts, x = lineitem quantities summed per (order, part)
M2  cell annotations with gaps and foreign ids; gene annotations; value lists
R1  paired reads and two tag libraries derived from events and nation

Everything here is a lazy plan over the parquet tables, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.data import CellData, Deferred
from cellgrid.functions.names import make_unique


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cell_id_of(orderkey: Column) -> Column:
    return F.concat(F.lit("C"), F.lpad(orderkey.cast("string"), 8, "0"), F.lit("-1"))


def m1_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("cell_idx"),
                    cell_id_of(F.col("o_orderkey")).alias("cell_id"),
                    F.col("o_orderstatus").alias("status"),
                    F.col("o_totalprice").alias("price"),
                    F.col("o_orderdate").alias("ordered_at"),
                    (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


def m1_genes(spark: SparkSession, sf_dir: str, unique: bool = True) -> DataFrame:
    p = table(spark, sf_dir, "part")
    genes = p.select(F.col("p_partkey").alias("gene_idx"),
                     F.col("p_name").alias("gene_id"),
                     F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene_ids"),
                     F.col("p_brand").alias("brand"),
                     F.col("p_type").alias("type"),
                     F.col("p_size").cast("bigint").alias("size"),
                     F.col("p_retailprice").alias("retail"))
    return make_unique(genes, "gene_id", "gene_idx") if unique else genes


def m1_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy(F.col("l_orderkey").alias("cell_idx"), F.col("l_partkey").alias("gene_idx"))
            .agg(F.sum("l_quantity").alias("value"))
            .where(F.col("value") != 0))


def m1(spark: SparkSession, sf_dir: str) -> CellData:
    return CellData(cells=m1_cells(spark, sf_dir), genes=Deferred(lambda: m1_genes(spark, sf_dir)), x_raw=m1_x(spark, sf_dir))


def m1_brands(spark: SparkSession, sf_dir: str) -> CellData:
    """Same cells, genes = the distinct part brands."""
    p = table(spark, sf_dir, "part")
    brands = p.select("p_brand").distinct()
    genes = brands.select(F.xxhash64("p_brand").alias("gene_idx"), F.col("p_brand").alias("gene_id"))
    li = table(spark, sf_dir, "lineitem")
    x = (li.join(p.select("p_partkey", "p_brand"), li.l_partkey == p.p_partkey)
         .groupBy(F.col("l_orderkey").alias("cell_idx"), F.xxhash64("p_brand").alias("gene_idx"))
         .agg(F.sum("l_quantity").alias("value")))
    return CellData(cells=m1_cells(spark, sf_dir), genes=genes, x_raw=x)


# ------------------------------------------------------------------------ M2
def m2_cell_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cell_id, batch, score)`` for orders that are not pending (about two
    thirds), score missing for low-priority orders, plus one foreign id per
    nation (ids that match no cell)."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P")
    known = o.select(cell_id_of(F.col("o_orderkey")).alias("cell_id"),
                     F.concat(F.lit("B"), (F.col("o_custkey") % 4).cast("string")).alias("batch"),
                     F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("double"))
                     .otherwise(F.col("o_totalprice") / 1000).alias("score"))
    n = table(spark, sf_dir, "nation")
    foreign = n.select(F.concat(F.lit("X"), F.col("n_name")).alias("cell_id"),
                       F.lit("BX").alias("batch"), F.lit(1.0).alias("score"))
    return known.unionByName(foreign)


def m2_gene_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(gene_id, size2, kind)`` for parts with size < 25, keyed by the unique gene id."""
    genes = m1_genes(spark, sf_dir).where(F.col("size") < 25)
    return genes.select("gene_id", (F.col("size") * 2).alias("size2"), F.col("type").alias("kind"))


def m2_status_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("value")).where(F.col("value").isin("F", "O")).distinct()


def m2_small_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.where(F.col("p_size") <= 2).select(F.col("p_brand").alias("value")).distinct()


# ------------------------------------------------------------------------ R1
def dna(s: Column, n: int) -> Column:
    """Deterministic pseudo-random bases from a string."""
    hexes = F.concat(F.md5(s), F.md5(F.concat(s, F.lit("*"))))
    return F.substring(F.translate(hexes, "0123456789abcdef", "ACGTACGTACGTACGT"), 1, n)


def mutate(s: Column, positions: list[int]) -> Column:
    """Replace each 1-based position by the next base (A->C->G->T->A)."""
    for k in positions:
        s = F.overlay(s, F.translate(F.substring(s, k, 1), "ACGT", "CGTA"), F.lit(k), F.lit(1))
    return s


def r1_lib14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five 14-base tags; ``pos`` is the file position."""
    n = table(spark, sf_dir, "nation").where(F.col("n_nationkey") < 5)
    tag = F.concat(F.lit("a"), F.col("n_nationkey").cast("string"))
    return n.select(F.col("n_nationkey").cast("bigint").alias("pos"), tag.alias("tag_id"),
                    dna(tag, 14).alias("seq"))


def r1_lib30(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    tag = F.concat(F.lit("b"), F.col("n_nationkey").cast("string"))
    return n.select(F.col("n_nationkey").cast("bigint").alias("pos"), tag.alias("tag_id"),
                    dna(tag, 30).alias("seq"))


def r1_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(read_no, r1, r2)`` one pair per event."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id")
    l14 = r1_lib14(spark, sf_dir).select(F.col("pos").alias("p14"), F.col("seq").alias("s14"))
    l30 = r1_lib30(spark, sf_dir).select(F.col("pos").alias("p30"), F.col("seq").alias("s30"))
    e, u = F.col("event_id"), F.col("user_id")
    tail = F.when(e % 13 == 0, F.lit("TTGTTTTTTT")).otherwise(F.lit("TTTTTTTTTT"))
    r1 = F.concat(dna(F.concat(F.lit("cell"), u.cast("string")), 16),
                  dna(F.concat(F.lit("umi"), e.cast("string")), 10), tail)
    ev = ev.select("event_id", "user_id", r1.alias("r1"),
                   (u % 5).alias("p14"),
                   F.when((u % 4 == 0) & (e % 10 == 1), (u + 1) % 25).otherwise(u % 25).alias("p30"))
    j = ev.join(F.broadcast(l14), "p14").join(F.broadcast(l30), "p30")  # 5- and 25-row libraries
    s14 = F.when(e % 7 == 0, mutate(F.col("s14"), [3])).otherwise(F.col("s14"))
    s30 = (F.when(e % 11 == 0, mutate(F.col("s30"), [2, 9, 20]))
           .when(e % 5 == 0, mutate(F.col("s30"), [4, 17])).otherwise(F.col("s30")))
    link = F.when(e % 17 == 0, F.lit("TCGT")).otherwise(F.lit("TGGT"))
    return j.select(F.col("event_id").alias("read_no"), "r1", F.concat(s14, link, s30).alias("r2"))


def r1_cells(spark: SparkSession, sf_dir: str) -> CellData:
    ev = table(spark, sf_dir, "events").select("user_id").distinct()
    cells = ev.select(F.col("user_id").alias("cell_idx"),
                      F.concat(dna(F.concat(F.lit("cell"), F.col("user_id").cast("string")), 16),
                               F.lit("-1")).alias("cell_id"))
    genes = spark.createDataFrame([], "gene_idx bigint, gene_id string")
    x = spark.createDataFrame([], "cell_idx bigint, gene_idx bigint, value double")
    return CellData(cells=cells, genes=genes, x_raw=x)
