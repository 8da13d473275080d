"""Steps whose tasks have to follow the size of the input."""

from cellgrid.plans import catalog
from cellgrid.sources import blocked, tables
from cellgrid.sources.fastq import read_fastq_pairs


def test_lines_are_numbered_without_a_sort_of_the_lines(spark, tmp_path, monkeypatch):
    def sort(*_, **__):
        raise AssertionError("every line was range-partitioned and sorted")
    monkeypatch.setattr(tables, "dense_positions", sort)
    want = []
    for k in range(4):
        lines = [f"{k}-{i}" for i in range(7 * k)] + (["", "same", "same"] if k % 2 else [])
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{x}\n" for x in lines))
        want += lines
    got = tables.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in got] == list(enumerate(want))


def test_small_ranges_go_several_to_a_task(spark, tmp_path):
    files = []
    for side in ("r1", "r2"):
        records = "".join(f"@{i}\n{side.upper()}{i:07d}ACGT\n+\n{'I' * 13}\n" for i in range(20_000)).encode()
        path = tmp_path / f"{side}.gz"
        path.write_bytes(b"".join(blocked.block(records[k:k + 4096]) for k in range(0, len(records), 4096)))
        files.append(str(path))
    ranges = sum(-(-len(open(f, "rb").read()) // 512) for f in files)
    back = read_fastq_pairs(spark, [tuple(files)], range_bytes=512)
    assert ranges > 300
    assert back.rdd.getNumPartitions() < ranges / 4
    got = sorted((r.read_no, r.r1, r.r2) for r in back.collect())
    assert got == [(i, f"R1{i:07d}ACGT", f"R2{i:07d}ACGT") for i in range(20_000)]


def test_lanes_follow_the_reads(spark, tmp_path, monkeypatch):
    spark.range(500).selectExpr("id AS event_id", "id % 40 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(25).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    few = catalog._stored_reads(spark, str(tmp_path))
    assert few.count() > 0
    monkeypatch.setattr(catalog, "READS_PER_LANE", max(1, few.count() // 7))
    seen = []
    whole = type(few).repartitionByRange
    monkeypatch.setattr(type(few), "repartitionByRange", lambda self, n, *c: seen.append(n) or whole(self, n, *c))
    many = catalog._stored_reads(spark, str(tmp_path))
    assert seen[0] >= 7
    assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty()
