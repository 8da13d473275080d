"""Classifiers, web archives, vector search and joins, the pipeline and its registration."""

import base64
import hashlib
import importlib.util
import io
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from cellgrid.llm import ann, common, covertree, oracle, quality, queries, toxicity, warc
from cellgrid.session import scratch_path

SF = "/root/testdata/sf0.01"
VEC = "vec_id bigint, embedding array<float>, label int, node string"


def text(rng, n, extra=()):
    w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]
    for x in extra:
        w.insert(rng.randrange(len(w)), x)
    return " ".join(w)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(1200):
        bad, junk = i % 8 == 0, i % 6 == 0
        t = text(rng, rng.randint(20, 120), [rng.choice(["zorkly", "zorked", "zorking", "quxo"]) for _ in range(3)] if bad else ())
        docs.append((i, " ".join(w.upper() + "%%%" for w in t.split()) if junk else t, "x"))
        if i % 7 < 4:
            labels.append((i, int(not junk), int(bad), 1))
    docs += [(5000, None, "x"), (5001, "", "x"), (5002, text(rng, 30000), "x"), (None, "abc def", "x"), (7, docs[7][1], "x")]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, score string").repartition(3),
            spark.createDataFrame(labels + [(None, 1, 1, 1), (3, None, None, 1)], "doc_id bigint, quality int, toxic int, text int"))


def held_out_scores(scored, labels, column, mod, rest):
    t = scored.join(labels.select("doc_id", column).where(f"{column} is not null"), "doc_id")
    t = t.where(toxicity.fold(F.col("doc_id"), mod) == rest).toPandas()
    return t[t[column] == 1]["score"].to_numpy(), t[t[column] == 0]["score"].to_numpy()


def test_toxicity_learns_and_keeps_clean(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    bad, good = held_out_scores(scored, labels, "toxic", 4, 2)
    assert (bad >= 0.3).mean() > 0.9 and (good >= 0.3).mean() < 0.05
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {5000, 5001, 5002} <= {r.doc_id for r in kept.select("doc_id").collect()}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_sample_is_not_copied_on_the_driver(spark):
    """Features of 200 long documents: the driver's Python heap never holds them twice."""
    words = "transform(sequence(1, 6000), i -> left(md5(concat(id, ' ', i)), 6))"
    docs = spark.range(0, 200, 1, 4).selectExpr("id AS doc_id", f"concat_ws(' ', {words}) AS text")
    toxicity._sample(docs.limit(1), docs.select("doc_id"), 1)
    tracemalloc.start()  # the sample itself is read into this heap
    try:
        rows = toxicity._sample(docs, docs.select("doc_id"), 200)
        toxicity.select(rows[:50], rows[50:])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(rows) == 200 and all(r.dtype == np.int32 and (np.diff(r) > 0).all() for r in rows)
    assert peak < 2 * sum(r.nbytes for r in rows)


def test_toxicity_never_reads_held_out_labels(spark, labelled):
    docs, labels = labelled
    out = toxicity.fold(F.col("doc_id"), 4) == 2
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, flipped)
    assert a.weights == b.weights and a.bias == b.bias


def test_toxicity_without_labels(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, model).select("score").distinct().count() == 1
    assert toxicity.train(docs.limit(0), labels).weights == {}


def test_non_negative_risk_with_a_prior_above_the_truth():
    rng = np.random.default_rng(0)
    pos = [np.unique(np.append(rng.integers(10, 400, 20), rng.integers(0, 3))) for _ in range(200)]
    unl = [np.unique(rng.integers(10, 400, 20)) for _ in range(900)] + pos[:60]
    m = toxicity.fit(pos, unl, 0.2)
    f = lambda x: m.bias + sum(m.weights.get(int(g), 0.0) for g in x)
    assert np.mean([f(x) for x in pos]) > np.mean([f(x) for x in unl[:900]]) + 1


def test_quality_learns_and_is_calibrated(spark, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert scored.count() == docs.count() and scored.where("score is null or score < 0 or score > 1").count() == 0
    good, bad = held_out_scores(scored, labels, "quality", 5, 0)
    assert (good >= 0.3).mean() > 0.95 and (bad >= 0.3).mean() < 0.1
    assert abs(np.concatenate([good, bad]).mean() - len(good) / (len(good) + len(bad))) < 0.1
    empty = quality.train(docs, labels.limit(0))
    assert quality.score(docs, empty).select(F.round("score", 9)).distinct().count() == 1


def test_quality_tokens_of_long_texts_are_whole():
    t = " ".join(f"w{i % 50000}" for i in range(70000))
    x = quality.tokens_of(t + " w0 w0")
    assert x.many.sum() == 70002 and len(x.kinds) == 50000 and len(x.order) == 70002 and x.again == 1


def test_temperature_fits_overconfident_logits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = (rng.random(2000) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    net = quality.fit(x, y)
    p = net.probability(x)
    for lo, hi in ((0, 0.3), (0.3, 0.7), (0.7, 1.01)):
        at = (p >= lo) & (p < hi)
        assert abs(p[at].mean() - y[at].mean()) < 0.08


def test_warc_round_trip_any_split(spark):
    rng = random.Random(4)
    rows = [(i, None if i % 7 == 0 else f"http://x/{i} a\r\nWARC-Type: b", None if i % 5 == 0 else f"<p>é{i % 11}</p>" * (i % 13) * 9, "z")
            for i in range(200)]
    rows += [(1000, "u", "\r\n\r\nWARC/1.1\r\n" * 40), (1001, "u", "".join(chr(rng.randrange(32, 1000)) for _ in range(200000))),
             (None, "u", "zz"), (None, None, "zz"), (1001, "v", "other"), (2, rows[2][1], rows[2][2], )]
    rows = [(*r, "z")[:4] for r in rows]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, sha string").repartition(4)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = sorted(((-1 if i is None else i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                   *(("response", -1) if first.get(h or "", i) == i else ("revisit", first[h or ""]))) for i, _, h, _ in rows)
    folder = scratch_path(spark, "warc")
    warc.write_archives(pages, folder, file_bytes=4000)
    none = lambda v: -1 if v is None else v
    for split in (61, 1500, warc.SPLIT_BYTES):
        got = warc.read_records(spark, folder, split_bytes=split)
        assert sorted((none(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, none(r.refers_to)) for r in got.drop("payload").collect()) == want
    whole = {(none(r.page_id), bytes(r.payload).decode()) for r in got.where("record_type = 'response'").collect()}
    assert (1000, "\r\n\r\nWARC/1.1\r\n" * 40) in whole
    folder = scratch_path(spark, "warc")
    warc.write_archives(pages, folder, min_bytes=100)
    small = warc.read_records(spark, folder).where("record_type = 'revisit' and payload_bytes < 100").count()
    assert small == 0 and not warc.write_archives(pages.limit(0), folder + "-none").count()


def test_warc_magic_inside_a_member_is_no_record():
    inner = warc.record(1, "u", b"inner")
    noise = bytes(range(256)) * 4 + inner[:40] + b"\x1f\x8b\x08" * 50
    data = b"".join(warc.record(i, "u", noise + bytes([i])) for i in range(5))

    class Source(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    for step in (7, 50, 1000):
        got = [warc.parse(r)["warc-record-id"] for s in range(0, len(data), step)
               for r in warc.records_in(Source(data), len(data), s, min(len(data), s + step))]
        assert got == [f"<urn:page:{i}>" for i in range(5)]
    with pytest.raises(ValueError):
        list(warc.records_in(Source(b"junk" + data), len(data) + 4, 0, len(data)))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    rows = [(i, v.tolist(), i % 3, "n") for i, v in enumerate(x)]
    rows += [(1000 + i, (x[i % 5] * (1 + i % 2)).tolist(), (i % 5) % 3, "n") for i in range(80)]                 # copies, also scaled
    rows += [(2000 + i, (x[7] + rng.normal(size=16) * 0.05).tolist(), 7 % 3, "n") for i in range(60)]            # near copies
    rows += [(3000, None, 1, "n"), (3001, [0.0] * 16, 1, "n"), (3020, [1.0] * 15 + [float("nan")], 1, "n"), (3003, [1.0] * 15 + [None], 1, "n"),
             (3004, [1.0] * 15 + [float("inf")], 1, "n"), (3005, [1.0, 2.0], 1, "n"), (3006, x[0].tolist(), None, "n"), (20, x[20].tolist(), 20 % 3, "n")]
    return spark.createDataFrame(rows, VEC).repartition(4), rows


def sound_rows(rows):
    ok = [r for r in rows if r[1] is not None and len(r[1]) == 16 and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and any(r[1])]
    return ok, np.array([np.array(r[1], np.float32) for r in ok], dtype=np.float64)


@pytest.mark.parametrize("leaf,part", [(1024, 4096), (40, 30)])
def test_neighbours_recall_and_exact_scores(vectors, leaf, part):
    df, rows = vectors
    got = ann.search(df, lambda i: i % 20 == 0, k=10, leaf=leaf, part=part).toPandas()
    ok, x = sound_rows(rows)
    ids = np.array([r[0] for r in ok])
    asked = sorted({r[0] for r in ok if r[0] % 20 == 0})
    assert sorted(got["query_id"].unique()) == asked
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        score = x @ x[np.flatnonzero(ids == q)[0]]
        other = ids != q
        order = np.lexsort((ids[other], -np.round(score[other], 9)))[:10]
        hits += len(set(ids[other][order]) & set(g["vec_id"]))
        assert g["rank"].tolist() == list(range(1, 11)) and q not in set(g["vec_id"])
        key = list(zip(-g["score"], g["vec_id"]))
        assert key == sorted(key)
        for v, s in zip(g["vec_id"], g["score"]):
            assert abs(score[ids == v] - s).min() < 1e-9
    assert hits >= 0.9 * 10 * len(asked)


def test_neighbours_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0], 0, "n"), (1, [0.5, 0.0], 0, "n"), (2, [0.5, 0.0], 0, "n"), (None, [9.0, 9.0], 0, "n")], VEC)
    assert [tuple(r) for r in ann.search(df, lambda i: i % 20 == 0).orderBy("rank").collect()] == [(20, 1, 1, 0.5), (20, 2, 2, 0.5)]
    assert ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_best_bin_first_visits_every_leaf_once():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8))
    tree = ann.Tree(x, 3000, leaf=50)
    order = tree.walk(x[0], tree.leaves)
    assert tree.leaves > 30 and sorted(order) == list(range(tree.leaves))
    assert tree.walk(x[0], 3) == order[:3] and set(tree.assign(x)) <= set(order)


@pytest.mark.parametrize("shard", [covertree.SHARD, 30])
def test_embedding_groups_equal_brute_force(vectors, shard):
    df, rows = vectors
    got = covertree.near_duplicates(df, cosine=0.98, shard=shard).toPandas()
    ok, x = sound_rows(rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([-1 if r[2] is None else r[2] for r in ok])
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None, :]) & (lab >= 0)[:, None]
    np.fill_diagonal(link, False)
    comp = np.arange(len(ok))
    for i, j in zip(*np.nonzero(link)):
        if comp[i] != comp[j]:
            comp[comp == max(comp[i], comp[j])] = min(comp[i], comp[j])
    ids = np.array([r[0] for r in ok])
    name = {c: ids[comp == c].min() for c in set(comp)}
    want = [(i, n, name[c], i == name[c]) for i, n, c in zip(ids, link.sum(1), comp)]
    want += [(r[0], 0, r[0], True) for r in rows if not any(r is o for o in ok)]
    assert sorted(map(tuple, got[["vec_id", "n_links", "component_id", "kept"]].values.tolist())) == sorted(map(tuple, want))
    assert covertree.near_duplicates(df.limit(0)).count() == 0


def test_cover_tree_covers_and_traversal_prunes():
    rng = np.random.default_rng(9)
    u = covertree._unit(np.concatenate([rng.normal(size=(300, 6)), rng.normal(size=(1, 6)) + rng.normal(size=(300, 6)) * 0.01]))
    root = covertree.cover_tree(u, np.arange(len(u)))
    todo = [(root, np.inf)]
    while todo:
        n, above = todo.pop()
        gap = covertree._gap(u[n.members], u[n.centre:n.centre + 1])[:, 0]
        assert gap.max() <= n.radius + 1e-7 and n.centre in n.members
        if n.children:
            assert sorted(np.concatenate([c.members for c in n.children])) == sorted(n.members)
            assert n.centre in [c.centre for c in n.children] and max(c.radius for c in n.children) <= n.radius
        todo += [(c, n.radius) for c in n.children]


def test_registration_and_oracles(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(oracle.ORACLE) <= set(queries.QUERIES) and "op3_mixing" in entry.oracle_sql()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "mixing", "packing"]


def test_mixing_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cols = "doc_id, copy, place, source, n_chars, text"
    want = sorted(con.execute(f"SELECT {cols} FROM ({oracle.ORACLE['op3_mixing']})").fetchall())
    got = sorted(map(tuple, queries.QUERIES["op3_mixing"](spark, SF).selectExpr(*cols.split(", ")).collect()))
    assert got == want


def test_pipeline_stages_take_effect_and_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, before, SF), "stage")
        if name == "toxicity":
            gone = before.join(after, "doc_id", "left_anti").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
            assert 0 < before.count() - after.count() < 0.25 * before.count() and gone.where("toxic = 1").count() > 0.5 * gone.count()
        elif name == "line dedup":
            chars = lambda d: d.agg(F.sum(F.length("text"))).first()[0]
            assert after.count() == before.count() and chars(after) < chars(before)
            assert after.where("n_chars <> length(text)").count() == 0
        elif name == "simhash near-dedup":
            comp = queries.simhash.near_duplicates(before).select("component_id").distinct().count()
            assert after.count() == comp and after.select("doc_id").distinct().count() == comp
        elif name == "mixing":
            assert 0.7 * before.count() < after.count() < 1.3 * before.count()
        if name != "packing":
            assert after.columns == start
        else:
            assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
            assert after.where("piece = 0").count() == before.count()
        before = after


def test_entry_works_without_this_subpackage():
    """The guard is in the entry module alone: nothing else mentions the subpackage."""
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for f in [*root.glob("cellgrid/**/*.py"), root / "bench.py"]:
        if "llm" not in f.relative_to(root).parts:
            assert "cellgrid.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text(), f
    assert importlib.util.find_spec("corpus_pipeline") is not None
