"""Nothing is lost or invented on the way in and out: headers of any length, bad
entries, symmetric storage, quoting, saving in place, zero proportions."""

import pytest
from pyspark.sql import functions as F

from cellgrid.data import CellData
from cellgrid.operators.annotate import promote
from cellgrid.sources.mtx import read_10x_mtx, read_mtx
from cellgrid.sources.native import load
from cellgrid.sources.tables import read_annotations


def write(path, text):
    import os
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def entries(cd):
    return sorted((r.cell_idx, r.gene_idx, r.value) for r in cd.x.collect())


def test_header_of_any_length_single_file_and_parts(spark, tmpdir_path):
    head = "%%MatrixMarket matrix coordinate real general\n" + "% note\n" * 20_000
    write(f"{tmpdir_path}/a.mtx", head + "2 2 2\n2 2 7\n1 1 3\n")
    assert entries(read_mtx(spark, f"{tmpdir_path}/a.mtx")) == [(0, 0, 3.0), (1, 1, 7.0)]
    write(f"{tmpdir_path}/b.mtx/part-0", head)
    write(f"{tmpdir_path}/b.mtx/part-1", "% more\n2 2 2\n2 2 7\n")
    write(f"{tmpdir_path}/b.mtx/part-2", "1 1 3\n")
    assert entries(read_mtx(spark, f"{tmpdir_path}/b.mtx")) == [(0, 0, 3.0), (1, 1, 7.0)]


@pytest.mark.parametrize("body,what", [("3 3 3\n1 1 1\n2 2 2\n", "declares 3 entries"), ("3 3 2\n1 1 1\n2 2 abc\n", "no number"),
                                       ("3 3 1\n1 1 NaN\n", "no number"), ("3 3 1\n4 1 1\n", "outside")])
def test_bad_entries_fail_the_read(spark, tmpdir_path, body, what):
    write(f"{tmpdir_path}/a.mtx", "%%MatrixMarket matrix coordinate real general\n" + body)
    with pytest.raises(Exception, match=what):
        read_mtx(spark, f"{tmpdir_path}/a.mtx").x.count()


def test_symmetric_pattern_and_array_storage(spark, tmpdir_path):
    for name, body, want in (("symmetric", "3 3 2\n2 1 5\n3 3 4\n", [(0, 1, 5.0), (1, 0, 5.0), (2, 2, 4.0)]),
                             ("skew-symmetric", "2 2 1\n2 1 5\n", [(0, 1, -5.0), (1, 0, 5.0)])):
        write(f"{tmpdir_path}/{name}.mtx", f"%%MatrixMarket matrix coordinate real {name}\n" + body)
        assert entries(read_mtx(spark, f"{tmpdir_path}/{name}.mtx")) == want
    write(f"{tmpdir_path}/p.mtx", "%%MatrixMarket matrix coordinate pattern general\n2 2 1\n2 1\n")
    assert entries(read_mtx(spark, f"{tmpdir_path}/p.mtx")) == [(1, 0, 1.0)]
    write(f"{tmpdir_path}/d.mtx", "%%MatrixMarket matrix array real general\n1 1\n5\n")
    with pytest.raises(ValueError, match="coordinate"):
        read_mtx(spark, f"{tmpdir_path}/d.mtx")


@pytest.fixture()
def tiny(spark):
    cells = spark.createDataFrame([(0, "a", "x\ty", 1.5), (1, "b", '"q', float("nan")), (2, "c", "plain", 3.0)],
                                  "cell_idx bigint, cell_id string, note string, s double")
    genes = spark.createDataFrame([(0, "g0", "G0"), (1, "g1", "G1")], "gene_idx bigint, gene_id string, gene_ids string")
    x = spark.createDataFrame([(0, 0, 2.0), (2, 1, 1.0), (2, 1, 4.0)], "cell_idx bigint, gene_idx bigint, value double")
    return CellData(cells=cells, genes=genes, x_raw=x)


def test_quotes_tabs_and_line_breaks_survive(spark, tiny, tmpdir_path):
    tiny.export_cells(f"{tmpdir_path}/cells.tsv")
    got = {r.barcode: r.note for r in read_annotations(spark, f"{tmpdir_path}/cells.tsv").collect()}
    assert got == {"a": "x\ty", "b": '"q', "c": "plain"}
    broken = tiny.replace(cells=tiny.cells.withColumn("note", F.concat("note", F.lit("\nline"))))
    broken.export_cells(f"{tmpdir_path}/more.tsv")
    got = {r.barcode: r.note for r in read_annotations(spark, f"{tmpdir_path}/more.tsv", multi_line=True).collect()}
    assert got == {"a": "x\ty\nline", "b": '"q\nline', "c": "plain\nline"}


def test_promoted_gene_keeps_three_columns(spark, tiny, tmpdir_path):
    cd = promote(tiny.replace(x_raw=tiny.x_raw.groupBy("cell_idx", "gene_idx").agg(F.sum("value").alias("value")),
                              cells=tiny.cells.drop("note").withColumn("s", F.nanvl("s", F.lit(0.0)))), "s")
    cd.export_mex(f"{tmpdir_path}/mex")
    back = read_10x_mtx(spark, f"{tmpdir_path}/mex")
    genes = {r.gene_id: (r.gene_ids, r.feature_types) for r in back.genes.collect()}
    assert genes == {"g0": ("G0", "Gene Expression"), "g1": ("G1", "Gene Expression"), "s": ("s", "Gene Expression")}


def test_save_in_place_under_another_spelling(spark, tiny, tmpdir_path):
    place = f"{tmpdir_path}/nat"
    first = tiny.save(place, force=True)
    again = load(spark, place).set_parameter("a", "b", 1).save(f"file://{tmpdir_path}//nat", force=True)
    assert again.cells.count() == 3 and first.cells.columns == again.cells.columns and again.get_parameter("a", "b") == 1
    assert load(spark, place).select_cells("s > 2").cells.count() == 1        # NaN became null
    write(f"{place}.old/x", "")
    with pytest.raises(ValueError, match="left over"):
        again.save(place, force=True)


def test_repeated_entries_are_summed_in_the_dense_matrix(spark, tiny, tmpdir_path):
    from cellgrid.sinks.text import to_wide
    assert sorted(map(tuple, to_wide(tiny).drop("cell_idx").collect())) == [("a", 2.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 5.0)]
    tiny.export_textmatrix(f"{tmpdir_path}/m.tsv", single_file=True)
    assert open(f"{tmpdir_path}/m.tsv").read().splitlines() == ["barcode\tg0\tg1", "a\t2\t0", "b\t0\t0", "c\t0\t5"]


def test_no_proportion_is_zero(spark):
    from cellgrid.functions.stats import good_turing_proportions
    no_single = spark.createDataFrame([(i, float(c)) for i, c in enumerate([0, 0, 2, 2, 3, 4, 5, 6, 9, 12])], "gene_idx bigint, count double")
    p = {r.gene_idx: r.prop for r in good_turing_proportions(no_single).collect()}
    assert min(p.values()) > 0 and abs(sum(p.values()) - 1) < 1e-9 and abs(p[0] + p[1] - 1 / 43) < 1e-12
    singles = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 1.0)], "gene_idx bigint, count double")
    assert {r.gene_idx: r.prop for r in good_turing_proportions(singles).collect()} == {0: 0.2, 1: 0.4, 2: 0.4}


def test_fractional_counts_are_refused(spark, tiny):
    from cellgrid.operators import emptydrops as ed
    props = spark.createDataFrame([(0, 0.5), (1, 0.5)], "gene_idx bigint, prop double")
    half = tiny.replace(x_raw=tiny.x_raw.withColumn("value", F.col("value") / 4))
    from cellgrid.operators.totals import cell_totals
    with pytest.raises(ValueError, match="whole counts"):
        ed.monte_carlo_pvalues(half, props, float("inf"), cell_totals(half), iters=10)


def test_non_local_master_needs_a_shared_folder():
    from cellgrid import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class O:
                            @staticmethod
                            def isDefined():
                                return False
                        return O()
                return S()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_scratch_can_be_cleared(spark, monkeypatch, tmpdir_path):
    import os

    from cellgrid import session
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda _: tmpdir_path)  # a folder of its own: others stay
    path = session.scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert spark.sparkContext.applicationId in path and os.path.isdir(path)
    session.clear_scratch(spark)
    assert not os.path.exists(path) and os.path.isdir(tmpdir_path)
