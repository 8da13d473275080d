"""File sources and sinks on small hand-made files."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from cellgrid.sources.fastq import read_fastq_pairs, read_tag_library
from cellgrid.sources.mtx import read_10x_mtx, read_bustools, read_dataset, read_mtx
from cellgrid.sources.native import load
from cellgrid.sources.tables import read_annotations, read_values


def write(path, text, gz=False):
    opener = gzip.open if gz else open
    with opener(path, "wt") as f:
        f.write(text)


TINY = """%%MatrixMarket matrix coordinate integer general
% a comment
3 4 5
1 1 3
3 4 5
1 1 2
2 3 7
3 4 5
"""


def test_mtx_dims_line_and_repeats(spark, tmpdir_path):
    # the triplet "3 4 5" equals the dimensions line and appears twice
    p = f"{tmpdir_path}/tiny.mtx"
    write(p, TINY)
    cd = read_mtx(spark, p)
    x = {(r.cell_idx, r.gene_idx): r.value for r in cd.x.collect()}
    assert x == {(0, 0): 5.0, (2, 3): 10.0, (1, 2): 7.0}
    assert cd.shape() == (3, 4)
    assert [r.cell_id for r in cd.cells.orderBy("cell_idx").collect()] == ["0", "1", "2"]
    t = read_mtx(spark, p, transpose=True)
    assert t.shape() == (4, 3)
    assert "Imported mtx" in t.history[0]["description"]


def test_mtx_out_of_range(spark, tmpdir_path):
    p = f"{tmpdir_path}/bad.mtx"
    write(p, "%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1.0\n")
    with pytest.raises(Exception, match="outside the declared"):
        read_mtx(spark, p).x.count()


def _tenx(d):
    os.makedirs(d)
    write(f"{d}/matrix.mtx.gz", "%%MatrixMarket matrix coordinate real general\n4 3 4\n1 1 1\n2 1 2\n4 2 9\n3 3 4\n",
          gz=True)
    write(f"{d}/barcodes.tsv.gz", "AAAC-1\nAAAG-1\nAAAT-1\n", gz=True)
    write(f"{d}/features.tsv.gz", "E1\tGeneA\tGene Expression\nE2\tGeneA\tGene Expression\n"
                                  "E3\tGeneB\tGene Expression\nAB1\tCD3\tAntibody Capture\n", gz=True)


def test_10x_directory(spark, tmpdir_path):
    d = f"{tmpdir_path}/tenx"
    _tenx(d)
    cd = read_10x_mtx(spark, d)
    genes = {r.gene_idx: (r.gene_id, r.gene_ids) for r in cd.genes.collect()}
    assert genes == {0: ("GeneA", "E1"), 1: ("GeneA-1", "E2"), 2: ("GeneB", "E3")}
    x = {(r.cell_idx, r.gene_idx): r.value for r in cd.x.collect()}
    assert x == {(0, 0): 1.0, (0, 1): 2.0, (2, 2): 4.0}   # antibody row dropped
    assert [r.cell_id for r in cd.cells.orderBy("cell_idx").collect()] == ["AAAC-1", "AAAG-1", "AAAT-1"]


def test_10x_missing_files(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/empty")
    with pytest.raises(ValueError):
        read_10x_mtx(spark, f"{tmpdir_path}/empty")
    with pytest.raises(ValueError):
        read_dataset(spark, f"{tmpdir_path}/x.txt", "mtx")


def test_bustools(spark, tmpdir_path):
    b = f"{tmpdir_path}/out"
    write(f"{b}.mtx", "%%MatrixMarket matrix coordinate real general\n2 3 2\n1 3 4\n2 1 1\n")
    write(f"{b}.genes.txt", "G1\nG2\nG3\n")
    write(f"{b}.barcodes.txt", "AC\tx\nGT\ty\n")
    cd = read_bustools(spark, b)
    assert cd.shape() == (2, 3)
    cells = {r.cell_idx: (r.cell_id, r._c1) for r in cd.cells.collect()}
    assert cells == {0: ("AC", "x"), 1: ("GT", "y")}
    os.remove(f"{b}.genes.txt")
    with pytest.raises(ValueError):
        read_bustools(spark, b)


def test_annotations_header_and_positions(spark, tmpdir_path):
    p = f"{tmpdir_path}/ann.tsv"
    write(p, "score\tbatch\tid\n1.5\tB1\tc0\n\tB2\tc1\n3\t\tc2\n")
    df = read_annotations(spark, p)
    assert df.columns == ["score", "batch", "id"]
    assert dict(df.dtypes) == {"score": "double", "batch": "string", "id": "string"}
    p2 = f"{tmpdir_path}/ann2.tsv"
    write(p2, "c0\t1\tTrue\nc1\t2\tFalse\n")
    df2 = read_annotations(spark, p2, header=False)
    assert df2.dtypes == [("_c0", "string"), ("_c1", "bigint"), ("_c2", "boolean")]


def test_values_file(spark, tmpdir_path):
    p = f"{tmpdir_path}/v.txt"
    write(p, "a\n\n b\na\n")
    assert sorted(r.value for r in read_values(spark, p).collect()) == ["a", "b"]


def _fq(path, seqs):
    write(path, "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs)), gz=True)


def test_fastq_pairs_lockstep(spark, tmpdir_path):
    a1, a2 = f"{tmpdir_path}/a_R1.fq.gz", f"{tmpdir_path}/a_R2.fq.gz"
    b1, b2 = f"{tmpdir_path}/b_R1.fq.gz", f"{tmpdir_path}/b_R2.fq.gz"
    _fq(a1, ["AAAA", "CCCC", "GGGG"])
    _fq(a2, ["TTTT", "GGGG"])            # shorter: stops after two records
    _fq(b1, ["ACGT"])
    _fq(b2, ["TGCA"])
    df = read_fastq_pairs(spark, [(a1, a2), (b1, b2)])
    rows = sorted((r.file_no, r.read_no, r.r1, r.r2) for r in df.collect())
    assert rows == [(0, 0, "AAAA", "TTTT"), (0, 1, "CCCC", "GGGG"), (1, 0, "ACGT", "TGCA")]
    assert df.rdd.getNumPartitions() == 2


def test_tag_library_repeated_sequence(spark, tmpdir_path):
    p = f"{tmpdir_path}/lib.tsv"
    write(p, "t1\tAAAA\nt2\tCCCC\nt3\tAAAA\n")
    lib = {r.seq: (r.pos, r.tag_id) for r in read_tag_library(spark, p).collect()}
    assert lib == {"AAAA": (0, "t3"), "CCCC": (1, "t2")}


def test_native_roundtrip_and_save_rules(spark, tmpdir_path):
    p = f"{tmpdir_path}/tiny.mtx"
    write(p, TINY)
    cd = read_mtx(spark, p).set_parameter("classic_filter", "threshold", 3.5)
    out = f"{tmpdir_path}/ds"
    assert cd.save(out)
    back = load(spark, out)
    assert back.shape() == (3, 4)
    assert back.get_parameter("classic_filter", "threshold") == 3.5
    assert back.history[0]["description"] == cd.history[0]["description"]
    assert not back.save(out)                     # unchanged -> skipped
    assert not cd.save(out, write=False)
    # saving over the folder it was loaded from goes through a staging folder
    changed = back.add_history({}, "touch")
    assert changed.save()                         # default target = the folder it came from
    again = load(spark, out)
    assert again.history[0]["description"] == "touch" and again.shape() == (3, 4)


def test_exports(spark, tmpdir_path):
    from cellgrid.plans.fixtures import m1
    cd = m1(spark, "/root/testdata/sf0.001").with_total_umis()
    mex = f"{tmpdir_path}/mex"
    cd.export_mex(mex, single_file=True)
    with gzip.open(f"{mex}/matrix.mtx.gz", "rt") as f:
        head = [f.readline() for _ in range(2)]
    assert head[0].startswith("%%MatrixMarket")
    n_genes, n_cells, nnz = map(int, head[1].split())
    assert (n_cells, n_genes) == cd.shape() and nnz == cd.x.count()
    with pytest.raises(FileExistsError):
        cd.export_mex(mex)
    cd.export_mex(mex, overwrite=True)          # folder-of-parts form
    folder = f"{mex}/matrix.mtx.gz"
    blob = b"".join(open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder))
                    if n.startswith("part-") and not n.startswith("."))
    text = gzip.decompress(blob).decode().splitlines()
    assert text[0].startswith("%%MatrixMarket") and text[1] == f"{n_genes} {n_cells} {nnz}"
    assert len(text) == nnz + 2
    back = read_10x_mtx(spark, mex)
    assert back.x.agg(F.sum("value")).first()[0] == cd.x.agg(F.sum("value")).first()[0]
    tsv = f"{tmpdir_path}/cells.tsv"
    cd.export_cells(tsv, single_file=True)
    with open(tsv) as f:
        header = f.readline().rstrip("\n").split("\t")
        first = f.readline().rstrip("\n").split("\t")
    assert header[0] == "barcode" and "urgent" in header
    assert first[header.index("urgent")] in ("True", "False")
    tm = f"{tmpdir_path}/matrix.tsv"
    small = cd.select_cells("total_umis > 250", record=False)
    small.export_textmatrix(tm, single_file=True)
    with open(tm) as f:
        lines = f.read().splitlines()
    assert lines[0].split("\t")[0] == "barcode" and len(lines) == small.cells.count() + 1
    totals = {r.cell_id: r.total_umis for r in small.cells.collect()}
    for line in lines[1:]:
        parts = line.split("\t")
        assert abs(sum(float(v) for v in parts[1:]) - totals[parts[0]]) < 1e-9


def test_mtx_header_dropped_with_many_splits(spark, tmpdir_path):
    """The file is cut into many splits; a triplet equal to the dimensions line
    (in a later split and right after the header) must be kept."""
    p = f"{tmpdir_path}/big.mtx"
    lines = ["%%MatrixMarket matrix coordinate real general", "% c", "50 40 302", "50 40 302"]
    lines += [f"{1 + i % 50} {1 + (i * 7) % 40} {i % 9 + 1}" for i in range(300)]
    lines.append("50 40 302")
    write(p, "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        cd = read_mtx(spark, p, sum_repeats=False)
        assert spark.read.text(p).rdd.getNumPartitions() > 3
        rows = cd.x.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 302
    assert sum(r.value for r in rows) == 2 * 302 + sum(i % 9 + 1 for i in range(300))


def test_fastq_lanes_to_tag_assignment(spark, tmpdir_path):
    """R1 fixture reads written as two gzip lanes, read back with the data
    source, give the same tag calls as the in-memory reads."""
    from cellgrid.operators.tags import annotate_tags
    from cellgrid.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    reads = fx.r1_reads(spark, sf).orderBy("read_no").collect()
    lanes = [reads[::2], reads[1::2]]
    pairs = []
    for k, lane in enumerate(lanes):
        a, b = f"{tmpdir_path}/L{k}_R1.fastq.gz", f"{tmpdir_path}/L{k}_R2.fastq.gz"
        _fq(a, [r.r1 for r in lane])
        _fq(b, [r.r2 for r in lane])
        pairs.append((a, b))
    from_files = read_fastq_pairs(spark, pairs)
    cd = fx.r1_cells(spark, sf)
    l14, l30 = fx.r1_lib14(spark, sf), fx.r1_lib30(spark, sf)
    got = annotate_tags(cd, from_files, l14, l30, id_suffix="-1", fastqs=tuple(pairs[0]), log_summary=False)
    want = annotate_tags(cd, fx.r1_reads(spark, sf), l14, l30, id_suffix="-1", log_summary=False)
    assert sorted(got.cells.collect()) == sorted(want.cells.collect())
    assert got.history[0]["description"].startswith("Lineage tags called from read pairs")


def test_replace_from_file_keeps_file_order(spark, tmpdir_path):
    from cellgrid.data import CellData
    p = f"{tmpdir_path}/new.tsv"
    write(p, "id\tgroup\nz9\tg1\na1\tg2\nm5\tg3\n")
    ann = read_annotations(spark, p, line_numbers=True)
    cells = spark.createDataFrame([(10, "c10"), (20, "c20"), (30, "c30")], "cell_idx bigint, cell_id string")
    genes = spark.createDataFrame([(0, "G")], "gene_idx bigint, gene_id string")
    x = spark.createDataFrame([(10, 0, 1.0)], "cell_idx bigint, gene_idx bigint, value double")
    cd = CellData(cells=cells, genes=genes, x_raw=x).replace_cells(ann)
    got = sorted((r.cell_idx, r.cell_id, r.group) for r in cd.cells.collect())
    assert got == [(10, "z9", "g1"), (20, "a1", "g2"), (30, "m5", "g3")]


def test_type_check_of_texts_agrees_with_the_cast(spark):
    from cellgrid.sources import tables
    texts = ["1", " 1.5 ", "+.5", "-1e-3", "1E5", "1f", "2.5D", "0x1.8p3", "-0X1P-2", "NaN", "nan", "Infinity", "-infinity", "+INF", "inf", "1.",
             "\t7\n", "\x7f3", "3\x00", "", " ", ".", "+", "e5", "1995-01-02", "1995-01-02 00:00:00", "C0001-1", "True", "in", "1 2", "0x", "1e", "--1",
             "\u0663", "\u00a05", "1_0", "1,5", "abc", "9223372036854775807", "9223372036854775808", "+12", "t", "T", "yes", " No\t", "0", "y", "TRUE", "fals", "\u017f", None]
    df = spark.createDataFrame([(x,) for x in texts], "v string")
    v = F.col("v")
    for kind in ("bigint", "double", "boolean"):
        got = df.select("v", tables._fits(v, kind).alias("fits"), v.try_cast(kind).isNotNull().alias("casts")).collect()
        assert [r for r in got if r.fits != r.casts] == []
    # names and dates never reach a cast, which throws for each of them
    for kind, looks in tables._LOOKS.items():
        may = {r.v for r in df.where(v.rlike(looks)).collect()}
        assert may.isdisjoint({"1995-01-02 00:00:00", "C0001-1", "abc"}) and may
