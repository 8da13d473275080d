"""Registered queries: one per operator of the inventory, named after its ID.

Each callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
test tables (see ``fixtures``).  The equivalent DuckDB SQL lives in
``oracle.py`` under the same key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.operators import totals
from cellgrid.plans import fixtures as fx

QUERIES: dict = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _m1_totals(spark: SparkSession, sf_dir: str):
    return totals.with_total_umis(fx.m1(spark, sf_dir))


# --------------------------------------------------------------- A: totals
@query("a01_total_umis")
def a01(spark, sf_dir) -> DataFrame:
    return _m1_totals(spark, sf_dir).cells.select("cell_id", "total_umis")


@query("a02_totals_histogram")
def a02(spark, sf_dir) -> DataFrame:
    cd = _m1_totals(spark, sf_dir)
    return totals.totals_histogram(cd.cells).select("total", "n", "cum", "cum_before")


@query("a03_kth_total")
def a03(spark, sf_dir) -> DataFrame:
    cd = _m1_totals(spark, sf_dir)
    hist = totals.totals_histogram(cd.cells)
    return totals.kth_total_frame(hist, 299).select("kth_total", "n_cells")


@query("a04_cr_thresholds")
def a04(spark, sf_dir) -> DataFrame:
    cd = _m1_totals(spark, sf_dir)
    return totals.cr_thresholds_frame(cd.cells)


@query("a05_classic")
def a05(spark, sf_dir) -> DataFrame:
    return totals.filter_classic(fx.m1(spark, sf_dir)).cells.select("cell_id", "total_umis")


@query("a06_default_drops")
def a06(spark, sf_dir) -> DataFrame:
    return totals.default_drops(fx.m1(spark, sf_dir)).select("cell_id", "total_umis", "is_cell")


@query("a07_shape")
def a07(spark, sf_dir) -> DataFrame:
    cd = fx.m1(spark, sf_dir)
    n_cells = cd.cells.agg(F.count(F.lit(1))).scalar()
    n_genes = cd.genes.agg(F.count(F.lit(1))).scalar()
    return cd.x.agg(n_cells.alias("n_cells"), n_genes.alias("n_genes"),
                    F.count(F.lit(1)).alias("nnz"), F.sum("value").alias("sum_value"))


@query("s10_make_unique")
def s10(spark, sf_dir) -> DataFrame:
    return fx.m1_genes(spark, sf_dir).select("gene_idx", "gene_id")


# ------------------------------------------------------- F: select expressions
def _f_data(spark, sf_dir):
    """M1 with total_umis and the M2 cell annotations (batch, score) added."""
    from cellgrid.operators.annotate import annotate
    cd = _m1_totals(spark, sf_dir)
    return annotate(cd, "cell", fx.m2_cell_annotations(spark, sf_dir), ["batch", "score"], [1, 2],
                    check_unique=False)


def _f_cells(expr: str, lists=None, anchor: str = "full"):
    def run(spark, sf_dir) -> DataFrame:
        from cellgrid.operators.select import select_cells
        lst = {k: v(spark, sf_dir) for k, v in (lists or {}).items()}
        return select_cells(_f_data(spark, sf_dir), expr, lst, anchor, record=False).cells.select("cell_id")
    return run


def _f_genes(expr: str, lists=None):
    def run(spark, sf_dir) -> DataFrame:
        from cellgrid.operators.select import select_genes
        lst = {k: v(spark, sf_dir) for k, v in (lists or {}).items()}
        return select_genes(fx.m1(spark, sf_dir), expr, lst, record=False).genes.select("gene_idx", "gene_id")
    return run


F_CELL_EXPRS = {
    "f03_eq": "batch == 'B1'",
    "f04_ne": "batch != 'B1'",
    "f05_lt": "score < 100",
    "f06_le": "score <= 100.5",
    "f07_gt": "score > 200",
    "f08_ge": "score >= 200",
    "f09_is_regex": 'batch is "B[12]"',
    "f10_is_not_regex": 'batch is not "B[12]"',
    "f13_and": "score > 100 and batch == 'B0' and urgent == True",
    "f14_or": "score > 300 or batch == B3 or total_umis < 10",
    "f15_not": "not (score > 100)",
    "f16_negative": "score > -1 and not (score <= -0.5e3) and not (score > 150)",
    "f18_quoted_name": "'total_umis' > 150 and status == F",
    "f19_bool_number": "urgent == 1 or (urgent == 0.5 and score < 10)",
    "f19b_bool_text": "urgent == 'TRUE' and not (urgent == 'no')",
    "f20_category_literal": "status != 1",
    "f21_nested": "(batch == 'B0' or batch == 'B1') and not (score < 50 or status == 'P')",
}
for _name, _expr in F_CELL_EXPRS.items():
    QUERIES[_name] = _f_cells(_expr)

QUERIES["f01_select_cells"] = _f_cells("total_umis > 100 and status == 'F'")
QUERIES["f09b_regex_prefix"] = _f_cells('batch is "B"', anchor="start")
QUERIES["f11_in_list"] = _f_cells('status in "statuses"', {"statuses": fx.m2_status_list})
QUERIES["f12_not_in_list"] = _f_cells('status not in "statuses" or score > 400',
                                      {"statuses": fx.m2_status_list})
QUERIES["f02_select_genes"] = _f_genes("retail > 950 and brand != 'Brand#13'")
QUERIES["f17_gene_name"] = _f_genes('gene is "(red|hot) .*" and not (gene is ".*-[0-9]+")')
QUERIES["f11b_in_list_genes"] = _f_genes('brand in "small_brands" and size > 20',
                                         {"small_brands": fx.m2_small_brands})


@query("f01b_matrix_follows")
def f01b(spark, sf_dir) -> DataFrame:
    """The matrix after a cell and a gene selection (one semi-join pair)."""
    from cellgrid.operators.select import select_cells, select_genes
    cd = _m1_totals(spark, sf_dir)
    cd = select_cells(cd, "total_umis > 100 and urgent == False", record=False)
    cd = select_genes(cd, "size >= 25", record=False)
    return cd.x.groupBy("gene_idx").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("umis"))


@query("f22_removed_count")
def f22(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.select import removed_count
    return removed_count(_f_data(spark, sf_dir).cells, "score > 150 or batch == 'B2'")


# ------------------------------------------------------- J: annotation edits
@query("j01_annotate_cells")
def j01(spark, sf_dir) -> DataFrame:
    return _f_data(spark, sf_dir).cells.select("cell_id", "status", "total_umis", "batch", "score")


@query("j02_annotate_genes")
def j02(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.annotate import annotate
    cd = annotate(fx.m1(spark, sf_dir), "gene", fx.m2_gene_annotations(spark, sf_dir),
                  "double_size,kind", "1,2")
    return cd.genes.select("gene_id", "brand", "double_size", "kind")


@query("j03_id_column_last")
def j03(spark, sf_dir) -> DataFrame:
    """Id column after the value columns; columns picked by file position."""
    from cellgrid.operators.annotate import annotate
    ann = fx.m2_cell_annotations(spark, sf_dir).select("score", "batch", "cell_id")
    cd = annotate(_m1_totals(spark, sf_dir), "cell", ann, ["grp", "value"], [1, 0], id_column=2)
    return cd.cells.select("cell_id", "grp", "value")


@query("j04_replace_cells")
def j04(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.annotate import replace
    o = fx.table(spark, sf_dir, "orders")
    new = o.select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("new_id"),
                   F.col("o_orderpriority").alias("priority"),
                   (-F.col("o_orderkey")).alias("line_no"))
    cd = replace(fx.m1(spark, sf_dir), "cell", new)
    return cd.cells.select("cell_idx", "cell_id", "priority")


@query("j05_drop_annotation")
def j05(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.annotate import drop
    cd = drop(drop(_f_data(spark, sf_dir), "cell", "score"), "cell", "no_such_column")
    return cd.cells.drop("ordered_at")


@query("j07_promote")
def j07(spark, sf_dir) -> DataFrame:
    from cellgrid.functions.joins import sized
    from cellgrid.functions.positions import materialize
    from cellgrid.operators.annotate import promote
    cd = promote(promote(fx.m1(spark, sf_dir), "price"), "urgent")
    # a promoted gene has an entry for nearly every cell: dealt by gene, each would be one task's sort
    new = sized(materialize(cd.genes.where(F.col("gene_id").isin("price", "urgent")).select("gene_idx", "gene_id")))
    return cd.x.join(new, "gene_idx").select("cell_idx", "gene_idx", "gene_id", "value")


# ------------------------------------------------------- W: ranks and knee
@query("w01_barcode_ranks")
def w01(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.ranks import barcode_ranks
    return barcode_ranks(fx.m1(spark, sf_dir)).select("cell_id", "total", "rank")


@query("w02_knee_inflection")
def w02(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.ranks import knee_inflection_frame, rank_histogram
    hist = rank_histogram(totals.cell_totals(fx.m1(spark, sf_dir)))
    return knee_inflection_frame(hist, lower=100).select("knee", "inflection", "left_total", "n_points")


@query("w03_knee_low_lower")
def w03(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.ranks import knee_inflection_frame, rank_histogram
    hist = rank_histogram(totals.cell_totals(fx.m1(spark, sf_dir)))
    return knee_inflection_frame(hist, lower=20, exclude_from=10).select("knee", "inflection", "left_total",
                                                                         "n_points")


@query("w05_rank_plot_classic")
def w05(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.ranks import rank_plot_table
    cd = totals.filter_classic(fx.m1(spark, sf_dir), keep_all=True)
    return rank_plot_table(cd)


@query("w06_rank_plot_unfiltered")
def w06(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.ranks import rank_plot_table
    return rank_plot_table(fx.m1(spark, sf_dir))


@query("w08_rank_plot_summary")
def w08(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.ranks import rank_plot_summary
    cd = totals.filter_classic(fx.m1(spark, sf_dir), keep_all=True)
    return rank_plot_summary(cd)


# ------------------------------------------------------- P: describe
@query("p01_brief")
def p01(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.describe import brief
    return brief(_f_data(spark, sf_dir))


@query("p02_numeric_summary")
def p02(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.describe import numeric_summary
    cells = _f_data(spark, sf_dir).cells.drop("cell_idx", "cell_id")
    out = numeric_summary(cells)
    # floating summaries rounded so that both engines' last bits agree
    return out.select("annotation", "count", "min", "max", F.round("mean", 4).alias("mean"),
                      F.round("sd", 4).alias("sd"),
                      *[F.round(c, 9).alias(c) for c in ("median", "q1", "q3")])


@query("p03_categorical_summary")
def p03(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.describe import categorical_summary
    cells = _f_data(spark, sf_dir).cells.drop("cell_idx", "cell_id")
    return categorical_summary(cells)


@query("p03b_events_summary")
def p03b(spark, sf_dir) -> DataFrame:
    """Second describe target: category, number and time columns of events."""
    from cellgrid.operators.describe import categorical_summary
    ev = fx.table(spark, sf_dir, "events").select("event_type", "ts")
    return categorical_summary(ev)


@query("p04_name_sample")
def p04(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.describe import name_sample
    return name_sample(fx.m1(spark, sf_dir).genes, "gene_idx", "gene_id")


@query("p05_array_summary")
def p05(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.describe import array_summary
    return array_summary(fx.table(spark, sf_dir, "embeddings"))


@query("p06_matrix_line")
def p06(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.describe import matrix_line
    return matrix_line(fx.m1(spark, sf_dir))


# ------------------------------------------------------- T: tag lineage
def _reads(spark, sf_dir):
    return fx.r1_reads(spark, sf_dir)


@query("t01_parse_r1")
def t01(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.tags import parse_r1
    return parse_r1(_reads(spark, sf_dir)).select("read_no", "cell", "umi")


@query("t02_parse_r2")
def t02(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.tags import parse_r2
    return parse_r2(_reads(spark, sf_dir)).select("read_no", "bc14", "bc30")


@query("t03_pair_filter")
def t03(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.tags import parse_pairs
    return parse_pairs(_reads(spark, sf_dir)).select("read_no", "cell", "umi", "bc14", "bc30")


@query("j08_whitelist")
def j08(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.tags import parse_pairs, whitelist
    cells = fx.r1_cells(spark, sf_dir).cells
    # barcodes of users with more events than the average user: the semi-join
    # then has reads to remove
    ev = fx.table(spark, sf_dir, "events")
    per_user = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    mean = ev.agg(F.count(F.lit(1)) / F.countDistinct("user_id")).scalar()
    cells = cells.join(per_user.where(F.col("n") > mean).select(F.col("user_id").alias("cell_idx")), "cell_idx",
                       "left_semi")
    return parse_pairs(_reads(spark, sf_dir)).join(whitelist(cells), "cell", "left_semi").select("read_no", "cell")


def _observed(spark, sf_dir, col):
    from cellgrid.operators.tags import parse_pairs
    return parse_pairs(_reads(spark, sf_dir)).select(F.col(col).alias("seq"))


@query("t04_exact_match")
def t04(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.tags import match_tags
    m = match_tags(_observed(spark, sf_dir, "bc14"), fx.r1_lib14(spark, sf_dir))
    return m.where("exact").select("seq", "tag_id")


@query("t05_corrected_match")
def t05(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.tags import match_tags
    m14 = match_tags(_observed(spark, sf_dir, "bc14"), fx.r1_lib14(spark, sf_dir))
    m30 = match_tags(_observed(spark, sf_dir, "bc30"), fx.r1_lib30(spark, sf_dir))
    return (m14.select("seq", "tag_id", "exact", F.lit(14).alias("lib"))
            .unionByName(m30.select("seq", "tag_id", "exact", F.lit(30).alias("lib"))))


@query("t06_kmer_nearest")
def t06(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.tags import kmer_nearest
    r = kmer_nearest(_observed(spark, sf_dir, "bc30"), fx.r1_lib30(spark, sf_dir))
    return r.select("seq", "tag_id", F.round("distance", 9).alias("distance"))


def _calls(spark, sf_dir):
    from cellgrid.operators.tags import tag_calls
    cd = fx.r1_cells(spark, sf_dir)
    return tag_calls(cd.cells, _reads(spark, sf_dir), fx.r1_lib14(spark, sf_dir), fx.r1_lib30(spark, sf_dir))


READS_PER_LANE = 250_000


def _stored_reads(spark, sf_dir) -> DataFrame:
    """R1 stored in lanes in the order of ``read_no``: three, or more so that none holds far more than ``READS_PER_LANE``."""
    from cellgrid.functions.positions import materialize
    lanes = max(3, -(-fx.table(spark, sf_dir, "events").count() // READS_PER_LANE))
    return materialize(_reads(spark, sf_dir).select("read_no", "r1", "r2").repartitionByRange(lanes, "read_no").sortWithinPartitions("read_no"))


@query("s07b_fastq_blocked_lanes")
def s07b(spark, sf_dir) -> DataFrame:
    """R1 written as blocked gzip lanes, each read by several tasks (64 KB ranges; R1 and R2 differ in
    size, so their ranges pair by record number), and assigned."""
    from cellgrid.operators.tags import assign, tag_calls
    from cellgrid.sources.blocked import write_blocked
    from cellgrid.sources.fastq import read_fastq_pairs
    place = _scratch(spark, "blocked")
    reads = _stored_reads(spark, sf_dir)
    lanes = []
    for side in ("r1", "r2"):
        record = F.array(F.concat(F.lit("@"), F.col("read_no").cast("string")), F.col(side), F.lit("+"), F.repeat(F.lit("I"), F.length(side)))
        lanes.append(write_blocked(reads.select(F.explode(record).alias("value")), f"{place}/{side}"))
    back = read_fastq_pairs(spark, list(zip(*lanes)), range_bytes=1 << 16)
    cells = fx.r1_cells(spark, sf_dir).cells
    calls = tag_calls(cells, back, fx.r1_lib14(spark, sf_dir), fx.r1_lib30(spark, sf_dir))
    return assign(cells, calls, "-1").select("cell_id", "doublet", "tags")


@query("s07_fastq_files_to_tags")
def s07(spark, sf_dir) -> DataFrame:
    """R1 written as FASTQ lanes and tag-library files, read back and assigned."""
    from cellgrid.operators.tags import assign, tag_calls
    from cellgrid.sources.fastq import read_fastq_pairs, read_tag_library
    from cellgrid.sources.paths import data_files
    place = _scratch(spark, "lanes")
    reads = _stored_reads(spark, sf_dir)
    for side in ("r1", "r2"):  # both from the same stored partitions, so record k of a lane is the same read
        record = F.array(F.concat(F.lit("@"), F.col("read_no").cast("string")), F.col(side), F.lit("+"), F.repeat(F.lit("I"), F.length(side)))
        reads.select(F.explode(record).alias("value")).write.option("compression", "gzip").text(f"{place}/{side}")
    for name, lib in (("lib14", fx.r1_lib14(spark, sf_dir)), ("lib30", fx.r1_lib30(spark, sf_dir))):
        (lib.coalesce(1).sortWithinPartitions("pos").select(F.concat_ws("\t", "tag_id", "seq").alias("value"))
         .write.text(f"{place}/{name}"))
    back = read_fastq_pairs(spark, list(zip(data_files(spark, f"{place}/r1"), data_files(spark, f"{place}/r2"))))
    cells = fx.r1_cells(spark, sf_dir).cells
    calls = tag_calls(cells, back, read_tag_library(spark, f"{place}/lib14"), read_tag_library(spark, f"{place}/lib30"))
    return assign(cells, calls, "-1").select("cell_id", "doublet", "tags")


@query("s06_value_file")
def s06(spark, sf_dir) -> DataFrame:
    """F11 with its list written to a text file and read back."""
    from cellgrid.operators.select import select_cells
    from cellgrid.sources.tables import read_values
    place = _scratch(spark, "values")
    fx.m2_status_list(spark, sf_dir).select("value").write.text(place)
    return select_cells(_f_data(spark, sf_dir), 'status in "statuses"', {"statuses": read_values(spark, place)}, record=False).cells.select("cell_id")


@query("t07_tag_counts")
def t07(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.tags import parse_pairs, tag_counts, whitelist
    cells = fx.r1_cells(spark, sf_dir).cells
    pairs = parse_pairs(_reads(spark, sf_dir)).join(whitelist(cells), "cell", "left_semi")
    return tag_counts(pairs, fx.r1_lib14(spark, sf_dir), fx.r1_lib30(spark, sf_dir))


@query("t08_confident")
def t08(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.tags import confident
    return confident(t07(spark, sf_dir))


@query("t09_assign")
def t09(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.tags import annotate_tags
    cd = fx.r1_cells(spark, sf_dir)
    cd = annotate_tags(cd, _reads(spark, sf_dir), fx.r1_lib14(spark, sf_dir), fx.r1_lib30(spark, sf_dir),
                       id_suffix="-1", log_summary=False)
    return cd.cells.select("cell_id", "doublet", "tags")


@query("t10_tag_summary")
def t10(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.tags import tag_summary
    return tag_summary(_calls(spark, sf_dir))


# ------------------------------------------------------- E: emptyDrops
@query("e01_ambient_set")
def e01(spark, sf_dir) -> DataFrame:
    cd = fx.m1(spark, sf_dir)
    tot = totals.cell_totals(cd).where(F.col("total") <= 100)
    return tot.join(cd.cells, "cell_idx").select("cell_id", "total")


@query("e02_ambient_profile")
def e02(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.emptydrops import ambient_profile
    return ambient_profile(fx.m1(spark, sf_dir), lower=50)


@query("e03_good_turing")
def e03(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.emptydrops import ambient_proportions
    p = ambient_proportions(fx.m1(spark, sf_dir), lower=50)
    return p.select("gene_idx", "count", F.round(F.col("prop") * 1e6, 6).alias("prop_ppm"))


def _loglik(alpha):
    def run(spark, sf_dir) -> DataFrame:
        from cellgrid.operators.emptydrops import ambient_proportions, log_likelihoods
        cd = fx.m1(spark, sf_dir)
        props = ambient_proportions(cd, lower=50)
        tested = totals.cell_totals(cd).where(F.col("total") > 50)
        ll = log_likelihoods(cd, props, alpha, tested)
        return ll.select("cell_idx", "total", F.round("loglik", 4).alias("loglik"))
    return run


QUERIES["e05_loglik_multinomial"] = _loglik(float("inf"))
QUERIES["e05b_loglik_dirichlet"] = _loglik(25.0)


@query("e08_bh_adjust")
def e08(spark, sf_dir) -> DataFrame:
    from cellgrid.functions.stats import bh_adjust
    o = fx.table(spark, sf_dir, "orders")
    mx = o.agg(F.max("o_totalprice")).scalar()
    p = o.select(F.col("o_orderkey").alias("cell_idx"),
                 F.when(F.col("o_orderstatus") == "P", F.lit(None))
                 .otherwise(F.round(F.col("o_totalprice") / mx, 3)).alias("pvalue"))
    return bh_adjust(p, "pvalue", "fdr").select("cell_idx", "pvalue", F.round("fdr", 9).alias("fdr"))


@query("e04_alpha_mle")
def e04(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.emptydrops import ambient_proportions, estimate_alpha
    cd = fx.m1(spark, sf_dir)
    props = ambient_proportions(cd, lower=50)
    a = estimate_alpha(cd, props, lower=50)
    return props.agg(F.count(F.lit(1)).alias("n_genes")).select("n_genes", F.round(F.lit(a), 6).alias("alpha"))


@query("e06_monte_carlo_pvalues")
def e06(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.emptydrops import ambient_proportions, monte_carlo_pvalues
    cd = fx.m1(spark, sf_dir)
    props = ambient_proportions(cd, lower=50)
    tested = totals.cell_totals(cd).where(F.col("total") > 50)
    return monte_carlo_pvalues(cd, props, float("inf"), tested, iters=10000, seed=1)


@query("e09_emptydrops")
def e09(spark, sf_dir) -> DataFrame:
    cd = fx.m1(spark, sf_dir)
    cd = cd.filter_emptydrops(lower=50, iters=10000, seed=1)  # the default call: alpha from the data
    return cd.cells.select("cell_id", "emptydrops_fdr")


@query("e10_cellranger")
def e10(spark, sf_dir) -> DataFrame:
    cd = fx.m1(spark, sf_dir)
    cd = cd.filter_emptydrops(cellranger=True, iters=10000, seed=1, keep_all=True)
    return cd.cells.select("cell_id", "total_umis", "emptydrops_fdr")


@query("e12_ambient_pvalues")
def e12(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.emptydrops import ambient_pvalues
    return ambient_pvalues(fx.m1(spark, sf_dir), lower=50, alpha=float("inf"), iters=10000, seed=1)


# The caller with few iterations: the same code, small enough for SQL to repeat every draw.
FEW = 40


@query("e06b_monte_carlo_few")
def e06b(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.emptydrops import ambient_proportions, monte_carlo_pvalues
    cd = fx.m1(spark, sf_dir)
    props = ambient_proportions(cd, lower=50)
    tested = totals.cell_totals(cd).where(F.col("total") > 50)
    p = monte_carlo_pvalues(cd, props, float("inf"), tested, iters=FEW, seed=1)
    return p.select("cell_idx", "total", F.round("loglik", 4).alias("loglik"), F.round("pvalue", 9).alias("pvalue"))


@query("e09b_emptydrops_few")
def e09b(spark, sf_dir) -> DataFrame:
    """E1-E9 with retain = 150: call at an FDR that few iterations can reach."""
    cd = fx.m1(spark, sf_dir).filter_emptydrops(lower=50, iters=FEW, alpha=float("inf"), seed=1, retain=150.0, fdr=0.2)
    return cd.cells.select("cell_id", F.round("emptydrops_fdr", 9).alias("emptydrops_fdr"))


@query("e06c_monte_carlo_dirichlet_few")
def e06c(spark, sf_dir) -> DataFrame:
    """Finite alpha: Polya-urn draws."""
    from cellgrid.operators.emptydrops import ambient_proportions, monte_carlo_pvalues
    cd = fx.m1(spark, sf_dir)
    props = ambient_proportions(cd, lower=50)
    tested = totals.cell_totals(cd).where(F.col("total") > 50)
    p = monte_carlo_pvalues(cd, props, 25.0, tested, iters=FEW, seed=1)
    return p.select("cell_idx", "total", F.round("loglik", 4).alias("loglik"), F.round("pvalue", 9).alias("pvalue"))


@query("e09c_emptydrops_default_few")
def e09c(spark, sf_dir) -> DataFrame:
    """The default caller (alpha from the data, Polya-urn draws) at an FDR that few iterations can reach."""
    cd = fx.m1(spark, sf_dir).filter_emptydrops(lower=50, iters=FEW, seed=1, retain=150.0, fdr=0.2)
    return cd.cells.select("cell_id", F.round("emptydrops_fdr", 9).alias("emptydrops_fdr"))


@query("e10b_cellranger_few")
def e10b(spark, sf_dir) -> DataFrame:
    cd = fx.m1(spark, sf_dir).filter_emptydrops(cellranger=True, iters=FEW, seed=1, keep_all=True)
    return cd.cells.select("cell_id", "total_umis", F.round("emptydrops_fdr", 9).alias("emptydrops_fdr"))


@query("e12b_ambient_pvalues_few")
def e12b(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.emptydrops import ambient_pvalues
    p = ambient_pvalues(fx.m1(spark, sf_dir), lower=50, alpha=float("inf"), iters=FEW, seed=1)
    return p.select("cell_idx", "total", F.round("pvalue", 9).alias("pvalue"))


# ------------------------------------------------------- D: dispersion test
def _price_pvalues(spark, sf_dir):
    """Deterministic p-like values from the data (price / max price)."""
    o = fx.table(spark, sf_dir, "orders")
    mx = o.agg(F.max("o_totalprice")).scalar()
    return o.select(F.col("o_orderkey").alias("cell_idx"), fx.cell_id_of(F.col("o_orderkey")).alias("cell_id"),
                    (F.col("o_totalprice") / mx).alias("pvalue"))


@query("d01_sample")
def d01(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.dispersion import sample_pvalues
    return sample_pvalues(_price_pvalues(spark, sf_dir), 100, seed=7).select("cell_id", "pvalue")


@query("d02_ks_uniform")
def d02(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.dispersion import ks_uniform, sample_pvalues
    s = sample_pvalues(_price_pvalues(spark, sf_dir), 100, seed=7)
    r = ks_uniform(s)
    return r.select("n", F.round("d", 9).alias("d"), F.round("ks_pvalue", 9).alias("ks_pvalue"), "suitable")


@query("d04_probplot")
def d04(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.dispersion import probplot_table
    _, fit = probplot_table(_price_pvalues(spark, sf_dir))
    return fit.select(F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"),
                      F.round("r", 9).alias("r"))


@query("d04b_probplot_points")
def d04b(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.dispersion import probplot_table
    table, _ = probplot_table(_price_pvalues(spark, sf_dir))
    return table.select("i", F.round("theoretical", 12).alias("theoretical"), "ordered")


@query("d05_dispersion_test")
def d05(spark, sf_dir) -> DataFrame:
    from cellgrid.operators.dispersion import dispersion_test
    summary, _, _ = dispersion_test(fx.m1(spark, sf_dir), alpha="non-dirichlet", lower=50, iters=10000, seed=3)
    return summary


def _dispersion_few(alpha):
    def run(spark, sf_dir) -> DataFrame:
        from cellgrid.operators.dispersion import dispersion_test
        summary, _, _ = dispersion_test(fx.m1(spark, sf_dir), alpha=alpha, lower=50, iters=FEW, seed=3)
        return summary.select("n", F.round("d", 9).alias("d"), F.round("ks_pvalue", 9).alias("ks_pvalue"), "suitable", "n_ambient")
    return run


QUERIES["d05b_dispersion_few"] = _dispersion_few("non-dirichlet")
QUERIES["d05c_dispersion_dirichlet_few"] = _dispersion_few("40")


# ------------------------------------------------------- S/K: sources and sinks (round trips)
def _scratch(spark, name):
    from cellgrid.session import scratch_path
    return scratch_path(spark, name)


@query("k02_mex_roundtrip_cells")
def k02(spark, sf_dir) -> DataFrame:
    """M1 exported as a MEX folder (ordered part files), read back as 10x."""
    from cellgrid.sources.mtx import read_10x_mtx
    path = _scratch(spark, "mex")
    fx.m1(spark, sf_dir).export_mex(path)
    cd = read_10x_mtx(spark, path)
    per = cd.x.groupBy("cell_idx").agg(F.sum("value").alias("total"))
    return cd.cells.join(per, "cell_idx", "left").select("cell_id", F.coalesce("total", F.lit(0.0)).alias("total"))


@query("k02b_mex_roundtrip_genes")
def k02b(spark, sf_dir) -> DataFrame:
    from cellgrid.sources.mtx import read_10x_mtx
    path = _scratch(spark, "mex")
    fx.m1(spark, sf_dir).export_mex(path)
    cd = read_10x_mtx(spark, path)
    per = cd.x.groupBy("gene_idx").agg(F.sum("value").alias("umis"))
    return cd.genes.join(per, "gene_idx", "left").select("gene_id", "gene_ids", "feature_types", "umis")


@query("k03_cell_table_roundtrip")
def k03(spark, sf_dir) -> DataFrame:
    """Cell metadata exported as TSV, read back as an annotation table."""
    from cellgrid.sources.tables import read_annotations
    path = _scratch(spark, "cells") + ".tsv.gz"
    _f_data(spark, sf_dir).export_cells(path)
    back = read_annotations(spark, path)
    return back.select("barcode", "status", "price", F.col("ordered_at").cast("string").alias("ordered_at"), "urgent",
                       "total_umis", "batch", "score")


@query("k04_gene_table")
def k04(spark, sf_dir) -> DataFrame:
    """Gene metadata exported as TSV and read back."""
    from cellgrid.sinks.text import export_table
    from cellgrid.sources.tables import read_annotations
    path = _scratch(spark, "genes") + ".tsv.gz"
    export_table(fx.m1(spark, sf_dir), "gene", path)
    return read_annotations(spark, path).select("gene", "gene_ids", "brand", "type", "size", "retail")


@query("k05_wide_matrix")
def k05(spark, sf_dir) -> DataFrame:
    """Dense pivot of the 25-brand matrix (M1b); cells without counts included."""
    from cellgrid.sinks.text import to_wide
    return to_wide(fx.m1_brands(spark, sf_dir)).drop("cell_idx")


@query("s04_native_roundtrip")
def s04(spark, sf_dir) -> DataFrame:
    """Cells and, from the matrix read back, their totals."""
    from cellgrid.sources.native import load
    path = _scratch(spark, "native")
    _f_data(spark, sf_dir).save(path, force=True)
    back = load(spark, path)
    per = back.x.groupBy("cell_idx").agg(F.sum("value").alias("total"))
    return back.cells.join(per, "cell_idx", "left").select(
        "cell_idx", "cell_id", "status", "price", F.col("ordered_at").cast("string").alias("ordered_at"), "urgent", "total_umis", "batch",
        "score", F.coalesce("total", F.lit(0.0)).alias("total"))


@query("s04b_native_genes_layers_params")
def s04b(spark, sf_dir) -> DataFrame:
    """Genes with sums over the matrix and over a layer read back, and the saved parameter."""
    from cellgrid.sources.native import load
    path = _scratch(spark, "native")
    cd = fx.m1(spark, sf_dir).set_parameter("classic_filter", "threshold", 12.5)
    cd = cd.replace(layers={"twice": cd.x_raw.withColumn("value", F.col("value") * 2)})
    back = load(spark, cd.save(path, force=True).source_path)
    per = back.x.groupBy("gene_idx").agg(F.sum("value").alias("umis"))
    twice = back.layer("twice").groupBy("gene_idx").agg(F.sum("value").alias("twice"))
    return back.genes.join(per, "gene_idx", "left").join(twice, "gene_idx", "left").select(
        "gene_idx", "gene_id", "gene_ids", "brand", "type", "size", "retail", "umis", "twice",
        F.lit(back.get_parameter("classic_filter", "threshold")).alias("threshold"))


@query("a01b_total_umis_saved")
def a01b(spark, sf_dir) -> DataFrame:
    """A1 over a saved dataset: buckets by cell, so neither the sums nor the join shuffle."""
    from cellgrid.operators.totals import with_total_umis
    cd = fx.m1(spark, sf_dir).save(_scratch(spark, "native"), force=True)
    return with_total_umis(cd, materialized=False).cells.select("cell_id", "total_umis")


@query("p07_history_after_saves")
def p07(spark, sf_dir) -> DataFrame:
    """Steps in order with three saves; history (newest first), parameters and the
    snapshots as they are read back."""
    from cellgrid.plans import run
    from cellgrid.sources.native import load, snapshots
    place = _scratch(spark, "native")
    steps = [[("select_cells", {"expr": 'status != "P"'})], [("filter_classic", {})], [("select_genes", {"expr": "size < 25"})]]
    cd = fx.m1(spark, sf_dir)
    for chain in steps:
        cd = run(cd, chain).save(place)
    back = load(spark, place)
    none = F.lit(None).cast("double").alias("value")
    history = back.history_frame().select(F.lit("history").alias("kind"), "seq", F.col("description").alias("text"), none)
    params = spark.createDataFrame([(f"{a}.{k}", float(v)) for a, kv in back.params.items() for k, v in kv.items()], "text string, value double")
    held = snapshots(spark, place).where("slot IN ('cells', 'genes')")
    return (history.unionByName(params.select(F.lit("parameter").alias("kind"), F.lit(0).cast("bigint").alias("seq"), "text", "value"))
            .unionByName(held.select(F.lit("snapshot").alias("kind"), F.col("number").cast("bigint").alias("seq"),
                                     F.col("slot").alias("text"), F.col("rows").cast("double").alias("value"))))


@query("s01_mtx_read")
def s01(spark, sf_dir) -> DataFrame:
    """Matrix Market body written from M1 (cells x genes), read with ``read_mtx``."""
    from cellgrid.sources.mtx import read_mtx
    path = _scratch(spark, "mtx") + ".mtx"
    cd = fx.m1(spark, sf_dir)
    x = cd.x
    n_rows = cd.cells.agg(F.max("cell_idx")).first()[0] + 1
    n_cols = cd.genes.agg(F.max("gene_idx")).first()[0] + 1
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), ("% derived from lineitem",),
                                  (f"{n_rows} {n_cols} {x.count()}",)], "value string").coalesce(1)
    body = x.select(F.format_string("%d %d %s", F.col("cell_idx") + 1, F.col("gene_idx") + 1,
                                    F.col("value").cast("string")).alias("value"))
    head.union(body).write.text(path)
    back = read_mtx(spark, path)
    per = back.x.groupBy("cell_idx").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("nnz"))
    return back.cells.join(per, "cell_idx", "left").select(
        "cell_idx", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("nnz", F.lit(0)).alias("nnz"))


@query("w04_rank_plot_emptydrops")
def w04(spark, sf_dir) -> DataFrame:
    """Segments of the emptyDrops rank plot: retained / middle / ambient, a point
    on a threshold in both; retain = knee at lower 50 (what emptyDrops stores)."""
    from cellgrid.operators.ranks import knee_inflection, rank_plot_table
    cd = fx.m1(spark, sf_dir)
    knee, _ = knee_inflection(cd, lower=50)
    for k, v in (("lower", 50.0), ("alpha", float("inf")), ("retain", knee), ("fdr_cutoff", 0.001)):
        cd = cd.set_parameter("emptydrops", k, v)
    return rank_plot_table(cd)


@query("w04b_rank_plot_after_call")
def w04b(spark, sf_dir) -> DataFrame:
    """W4 and W7 after a real call: the algorithm and its thresholds are what the caller stored."""
    from cellgrid.operators.ranks import rank_plot_table
    return rank_plot_table(fx.m1(spark, sf_dir).filter_emptydrops(lower=50, iters=FEW, alpha=float("inf"), seed=1, keep_all=True))


@query("s03_bustools_read")
def s03(spark, sf_dir) -> DataFrame:
    """M1 written in the bustools layout (cells x genes .mtx, .genes.txt,
    .barcodes.txt with an extra annotation column), read with ``read_bustools``."""
    from cellgrid.functions.positions import dense_positions
    from cellgrid.sources.mtx import read_bustools
    base = _scratch(spark, "bus")
    cd = fx.m1(spark, sf_dir)
    cells = dense_positions(cd.cells.select("cell_idx", "cell_id", "status"), [F.col("cell_idx")], name="r")
    genes = dense_positions(cd.genes.select("gene_idx", "gene_id"), [F.col("gene_idx")], name="c")
    x = (cd.x.join(cells.select("cell_idx", "r"), "cell_idx").join(genes.select("gene_idx", "c"), "gene_idx"))
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",),
                                  (f"{cells.count()} {genes.count()} {x.count()}",)], "value string").coalesce(1)
    body = x.select(F.format_string("%d %d %s", F.col("r") + 1, F.col("c") + 1, F.col("value").cast("string"))
                    .alias("value"))
    head.union(body).write.text(f"{base}.mtx")
    genes.orderBy("c").select(F.col("gene_id").alias("value")).write.text(f"{base}.genes.txt")
    cells.orderBy("r").select(F.concat_ws("\t", "cell_id", "status").alias("value")).write.text(f"{base}.barcodes.txt")
    back = read_bustools(spark, base)
    per = back.x.groupBy("cell_idx").agg(F.sum("value").alias("total"))
    return back.cells.join(per, "cell_idx", "left").select("cell_id", F.col("_c1").alias("status"),
                                                           F.coalesce("total", F.lit(0.0)).alias("total"))
