"""Saved datasets: commits, snapshots, buckets."""

import pytest
from pyspark.sql import functions as F

from cellgrid.data import CellData
from cellgrid.operators.totals import cell_totals, with_total_umis
from cellgrid.sources import native


@pytest.fixture()
def small(spark):
    cells = spark.createDataFrame([(i, f"c{i}", i / 2, "x") for i in range(40)], "cell_idx bigint, cell_id string, `odd, name` double, s string")
    genes = spark.createDataFrame([(i, f"g{i}") for i in range(6)], "gene_idx bigint, gene_id string")
    x = spark.createDataFrame([(i, j, float(i + j + 1)) for i in range(35) for j in range(6) if (i + j) % 3], "cell_idx bigint, gene_idx bigint, value double")
    return CellData(cells=cells, genes=genes, x_raw=x)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_and_joins_of_a_saved_dataset_do_not_shuffle(spark, small, tmpdir_path):
    cd = small.replace(layers={"raw": small.x_raw}).save(f"{tmpdir_path}/d's", force=True)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # as for tables of any size
        assert "Exchange" not in plan_of(cell_totals(cd))
        joined = with_total_umis(cd, materialized=False).cells
        assert "Exchange" not in plan_of(joined)
        kept = cd.replace(cells=cd.cells.where("s = 'x'"), cells_filtered=True)
        assert "Exchange" not in plan_of(kept.x) and "Exchange" not in plan_of(kept.layer("raw").groupBy("cell_idx").count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {r.cell_idx: r.total for r in cell_totals(small).collect()}
    assert {r.cell_idx: r.total for r in cell_totals(cd).collect()} == want
    assert sum(r.total_umis for r in joined.collect()) == sum(want.values()) and joined.count() == 40
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("cellgrid_")]
    ranges = small.replace(source_path=None)
    assert native.save(ranges, f"{tmpdir_path}/r", force=True, buckets=0).x.count() == small.x.count()


def test_a_save_that_breaks_off_anywhere_leaves_the_old_dataset(spark, small, tmpdir_path, monkeypatch):
    place = f"{tmpdir_path}/d"
    small.save(place, force=True)
    changed = native.load(spark, place).replace(genes=small.genes.where("gene_idx < 3")).set_parameter("a", "b", 1)
    steps = 0
    while True:   # break at the first call of any writing step, then at the second, and so on
        left = [steps]

        def breaking(real):
            def call(*args, **kw):
                if not left[0]:
                    raise KeyboardInterrupt
                left[0] -= 1
                return real(*args, **kw)
            return call

        with monkeypatch.context() as m:
            for name in ("_slot", "_write", "_load", "write_text", "rename_new"):
                m.setattr(native, name, breaking(getattr(native, name)))
            try:
                native.save(changed, place, force=True)
                broke = False
            except KeyboardInterrupt:
                broke = True
        now = native.load(spark, place)
        if not broke:
            break
        if len(native.manifests(spark, place)) == 1:
            assert now.genes.count() == 6 and now.params == {}
        else:   # broken off after the commit: the new dataset, whole
            assert now.genes.count() == 3 and now.params == {"a": {"b": 1}} and now.x.count() == small.x.count()
        steps += 1
    assert steps >= 7 and now.genes.count() == 3
    native.expire(spark, place)
    assert len(native.manifests(spark, place)) == 1 and native.load(spark, place).genes.count() == 3
    from cellgrid.sources.paths import list_names
    assert len(list_names(spark, f"{place}/snapshots")) == 1   # what broken saves left is gone too


def test_readers_keep_their_snapshot(spark, small, tmpdir_path):
    place = f"{tmpdir_path}/d"
    first = small.save(place, force=True)
    second = first.replace(cells=first.cells.where("cell_idx < 5"), cells_filtered=True).save(place, force=True)
    assert first.cells.count() == 40 and second.cells.count() == 5 and native.load(spark, place).cells.count() == 5
    held = {(r.number, r.slot): r.rows for r in native.snapshots(spark, place).collect()}
    assert held[1, "cells"] == 40 and held[2, "cells"] == 5 and held[2, "x"] < held[1, "x"]
    with pytest.raises(ValueError):
        native.expire(spark, place, keep=0)


def test_the_second_of_two_saves_fails(spark, small, tmpdir_path, monkeypatch):
    place = f"{tmpdir_path}/d"
    small.save(place, force=True)
    real, done = native._write, []

    def other_first(cd, *args):
        if not done:
            done.append(1)
            small.set_parameter("by", "other", 1).save(place, force=True)
        return real(cd, *args)

    monkeypatch.setattr(native, "_write", other_first)
    with pytest.raises(RuntimeError, match="another save"):
        small.set_parameter("by", "me", 1).save(place, force=True)
    assert native.load(spark, place).params == {"by": {"other": 1}}


def test_deferred_genes_are_made_once_and_late(spark, small):
    from cellgrid.data import Deferred
    made = []
    cd = small.replace(genes=Deferred(lambda: made.append(1) or small.genes))
    cd = cd.set_parameter("a", "b", 1)
    assert cd.x.agg(F.sum("value")).first()[0] > 0 and made == []
    assert cd.genes.count() == 6 and cd.replace(params={}).genes.count() == 6 and made == [1]
