"""The native dataset: Parquet folders per slot, committed by manifests.

Layout::

    <dir>/snapshots/<id>/cells/ genes/ x/ layers/<name>/ params/ history/
    <dir>/_manifests/<number>.json   which snapshot is current, its slots and their rows

A save writes a snapshot of its own, compares the rows of every slot with what was to be
written, and commits it with one rename of one small file.  Before that rename the
dataset is the old one, after it the new one: a save that breaks off at any point
changes nothing, and no reader sees half of one.  Earlier snapshots stay, so a frame that
was loaded keeps its files; ``expire`` removes old ones.  Of two saves at a time the second
to commit fails.

Matrix, layers and cells are bucketed by ``cell_idx`` and sorted in the buckets: sums per
cell and joins of matrix and cells over a loaded dataset shuffle nothing.  (Buckets need a
catalog that lets the session create a table for a moment; ``buckets=0`` writes cell ranges.)
"""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cellgrid.data import HISTORY_FIELDS, CellData, nan_to_null
from cellgrid.sources.paths import delete, exists, list_names, qualified, read_text, rename_new, write_text

log = logging.getLogger("cellgrid")
MARKER = "_SUCCESS_DATASET"   # of datasets without manifests (one folder, read only)
MANIFESTS = "_manifests"


def _slot(df: DataFrame, path: str, codec: str, buckets: int = 0) -> int:
    """Write one slot; returns its rows, counted while they are written."""
    rows = Observation()
    df = df.observe(rows, F.count(F.lit(1)).alias("n"))
    if buckets:
        order = [c for c in ("cell_idx", "gene_idx") if c in df.columns]
        name = f"cellgrid_{uuid.uuid4().hex}"
        # dealt like the buckets, so every task writes one file
        (df.repartition(buckets, "cell_idx").sortWithinPartitions(*order).write.format("parquet").mode("overwrite")
         .bucketBy(buckets, "cell_idx").sortBy("cell_idx").option("compression", codec).option("path", path).saveAsTable(name))
        df.sparkSession.sql(f"DROP TABLE {name}")   # its files stay
    else:
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    return rows.get["n"]


def _read(spark: SparkSession, path: str, buckets: int = 0) -> DataFrame:
    df = spark.read.parquet(path)
    if not buckets:
        return df
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    name = f"cellgrid_{uuid.uuid4().hex}"
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (cell_idx) SORTED BY (cell_idx) INTO {buckets} BUCKETS LOCATION '{place}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")   # the frame knows its files by now


def _write(cd: CellData, path: str, compress: bool, buckets: int) -> dict[str, int]:
    """Write every slot; returns their row counts."""
    codec = "gzip" if compress else "none"
    by_cell = (lambda m: m) if buckets else (lambda m: m.repartitionByRange("cell_idx").sortWithinPartitions("cell_idx", "gene_idx"))
    rows = {"cells": _slot(cd.cells, f"{path}/cells", codec, buckets), "genes": _slot(cd.genes, f"{path}/genes", codec),
            "x": _slot(by_cell(cd.x), f"{path}/x", codec, buckets)}
    for name in cd.layers:
        rows[f"layers/{name}"] = _slot(by_cell(cd.layer(name)), f"{path}/layers/{name}", codec, buckets)
    prm = [(a, k, json.dumps(v)) for a, kv in cd.params.items() for k, v in kv.items()]
    cd.spark.createDataFrame(prm, "algorithm string, key string, value string").coalesce(1) \
        .write.mode("overwrite").parquet(f"{path}/params")
    cd.history_frame().coalesce(1).write.mode("overwrite").parquet(f"{path}/history")
    return rows


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """The committed manifests of a dataset, oldest first."""
    place = f"{path}/{MANIFESTS}"
    if not exists(spark, place):
        return []
    found = [(n, json.loads(read_text(spark, f"{place}/{n}"))) for n in list_names(spark, place) if n.endswith(".json") and not n.startswith(".")]
    return [{**m, "number": int(n.removesuffix(".json"))} for n, m in sorted(found)]


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """``(number, snapshot, slot, rows)``: what every committed snapshot holds."""
    rows = [(m["number"], m["snapshot"], slot, n) for m in manifests(spark, path) for slot, n in m["rows"].items()]
    return spark.createDataFrame(rows, "number int, snapshot string, slot string, rows bigint")


def expire(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove all snapshots but the last ``keep``, and what broken saves left.  Frames loaded
    from them cannot be read any more."""
    if keep < 1:
        raise ValueError("the current snapshot has to stay")
    known = manifests(spark, path)
    for m in known[:-keep]:
        delete(spark, f"{path}/{MANIFESTS}/{m['number']:08d}.json")
    stay = {m["snapshot"] for m in known[-keep:]}
    if exists(spark, f"{path}/snapshots"):
        for name in list_names(spark, f"{path}/snapshots"):
            if name not in stay:
                delete(spark, f"{path}/snapshots/{name}")


def _commit(spark: SparkSession, place: str, number: int, manifest: dict) -> None:
    """One rename that fails if the number is taken."""
    trial = f"{place}/{MANIFESTS}/.{uuid.uuid4().hex}.json"
    write_text(spark, trial, json.dumps(manifest))
    try:
        rename_new(spark, trial, f"{place}/{MANIFESTS}/{number:08d}.json")
    except Exception as e:
        raise RuntimeError(f"another save of {place} finished first") from e


def save(cd: CellData, path: str | None = None, compress: bool = True, write: bool = True,
         force: bool = False, source: str | None = None, buckets: int | None = None) -> CellData | None:
    """K1: write the dataset; skipped if nothing changed (unless ``force``) or
    writing is disabled.  Returns the dataset as read from its new place, which
    is what to go on with, or None if nothing was written.  ``buckets``: files that
    hold the matrix (by default the session's shuffle partitions; 0: ranges of cells)."""
    if not write:
        log.info("writing disabled, dataset not saved")
        return None
    if not cd.changed and not force:
        log.info("dataset unchanged, not saved")
        return None
    if path is None:
        path = source  # default target: the input
    if path is None:
        raise ValueError("no output path given")
    spark = cd.spark
    place = qualified(spark, path)
    if exists(spark, f"{place}.old"):   # saves once swapped folders
        raise ValueError(f"{place}.old is left over from a broken save; move it back to {place} or delete it")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    known = manifests(spark, place)
    name = uuid.uuid4().hex
    here = f"{place}/snapshots/{name}"
    want = _write(cd, here, compress, buckets)
    manifest = {"snapshot": name, "layers": list(cd.layers), "buckets": buckets, "rows": want}
    back = _load(spark, place, manifest)
    got = {"cells": back.cells.count(), "genes": back.genes.count(), "x": back.x_raw.count(),
           **{f"layers/{n}": back.layers[n].count() for n in back.layers}}
    if got != want:
        raise RuntimeError(f"{here} does not hold what was written: {got} instead of {want}")
    _commit(spark, place, known[-1]["number"] + 1 if known else 1, manifest)
    return _load(spark, place, manifest)


def load(spark: SparkSession, path: str) -> CellData:
    """Load the current snapshot of a saved dataset (lazy Parquet scans)."""
    known = manifests(spark, path)
    if known:
        return _load(spark, path, known[-1])
    if not exists(spark, f"{path}/{MARKER}"):
        raise ValueError(f"{path} is not a saved dataset (no manifest)")
    meta = spark.read.json(f"{path}/{MARKER}").first()
    return _load(spark, path, {"snapshot": None, "layers": [n for n in (meta["layers"] or "").split(",") if n], "buckets": 0})


def _load(spark: SparkSession, path: str, manifest: dict) -> CellData:
    at = f"{path}/snapshots/{manifest['snapshot']}" if manifest["snapshot"] else path
    n = manifest["buckets"]
    prm = spark.read.parquet(f"{at}/params").collect()  # a few rows
    params: dict = {}
    for r in prm:
        params.setdefault(r["algorithm"], {})[r["key"]] = json.loads(r["value"])
    hist = spark.read.parquet(f"{at}/history").orderBy("seq").collect()  # one row per command
    history = tuple({f: r[f] for f in HISTORY_FIELDS} for r in hist)
    return CellData(
        cells=nan_to_null(_read(spark, f"{at}/cells", n)),
        genes=nan_to_null(spark.read.parquet(f"{at}/genes")),
        x_raw=_read(spark, f"{at}/x", n).select("cell_idx", "gene_idx", F.col("value").cast("double")),
        layers={k: _read(spark, f"{at}/layers/{k}", n) for k in manifest["layers"]},
        params=params, history=history, source_path=path)
