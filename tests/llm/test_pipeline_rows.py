"""Rows of the pipeline's stages against plain versions: nulls, copies, clashing names, ties, an empty table."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cellgrid.llm import common, oracle, queries
from test_text_operators import edit_distance, groups, slow_fingerprint, slow_norm, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int, copy string, `Place` int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    base = ["\n".join(words(rng, rng.randint(9, 15)) for _ in range(rng.randint(1, 5))) for _ in range(30)]
    line = base[3].split("\n")[0]
    texts = dict(enumerate(base))
    texts |= {100 + i: base[i % 3] for i in range(12)}                                   # exact copies
    texts |= {200 + i: line[:9 + i] + "Z" + line[10 + i:] for i in range(4)}             # near copies of one line
    texts |= {300: None, 301: "", 302: "---\n\n!", 303: "Les.", 304: "les!\nother", 305: words(rng, 5000), (1 << 53) + 1: base[8] + "\nlast"}
    out = [(i, t, "en", "hot" if i % 3 else "s1", None if t is None else len(t), f"c{i}", i % 5) for i, t in texts.items()]
    out += [out[7], (None, words(rng, 12), "en", "alone", 1, "x", None), (400, words(rng, 9), None, None, 2, None, 1)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return common.stored(spark.createDataFrame(rows, SCHEMA).repartition(3), "fixture")


def ordered(found):
    return sorted(map(tuple, found), key=repr)


def place(i):
    return (i is None, i or 0)


def test_line_stage(spark, docs, rows):
    first = {}
    for r in sorted(rows, key=lambda r: place(r[0])):
        for k, x in enumerate((r[1] or "").split("\n")):
            if slow_norm(x):
                first.setdefault(slow_norm(x), (place(r[0]), k))
    names = list(first)
    near = [(i, j) for i, a in enumerate(names) for j, b in enumerate(names[:i])
            if min(len(a), len(b)) >= 10 and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and len(a) < 1000
            and edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-6]
    assert near
    best = {}
    for n, g in zip(names, groups(len(names), near)):
        best[g] = min(best.get(g, first[n]), first[n])
    stay = set(best.values())

    def cut(r):
        if r[1] is None:
            return r
        t = "\n".join(x for k, x in enumerate(r[1].split("\n")) if not slow_norm(x) or (place(r[0]), k) in stay)
        return (r[0], t, r[2], r[3], len(t), *r[5:])

    out = corpus_pipeline.line_stage(spark, docs, SF)
    assert out.schema.names == docs.schema.names
    assert ordered(out.collect()) == ordered(map(cut, rows))


def test_near_dedup_stage(spark, docs, rows):
    fps = [slow_fingerprint(r[1]) for r in rows]
    top = groups(len(rows), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    best = {}
    for r, g in zip(rows, top):
        best[g] = min(best.get(g, r), r, key=lambda x: place(x[0]))
    out = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert out.schema.names == docs.schema.names
    assert ordered(out.collect()) == ordered(best.values())


def test_mixing_stage_equals_sql(spark, docs, tmp_path):
    import duckdb

    path = f"{tmp_path}/documents.parquet"
    docs.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text, lang, source, n_chars FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT doc_id, text, lang, source, n_chars FROM ({oracle.ORACLE['op3_mixing']})").fetchall()
    out = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert out.schema.names == docs.schema.names
    got = out.collect()
    assert ordered(r[:5] for r in got) == ordered(want)
    assert {tuple(r) for r in got} <= {tuple(r) for r in docs.collect()}   # copy and Place as they came


def test_packing_stage(spark, docs, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    got, sequences = Counter(), {}
    for r in out:
        got[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = Counter()
    for r in rows:
        want[r[0]] += len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_toxicity_stage_removes_what_the_query_predicts(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    gone = {r.doc_id for r in queries.op7_toxicity(spark, SF).where("predicted = 1").collect()}
    out = corpus_pipeline.toxicity_stage(spark, before, SF)
    assert gone and ordered(out.collect()) == ordered(r for r in before.collect() if r.doc_id not in gone)


@pytest.mark.parametrize("n", range(5))
def test_empty_table(spark, docs, n):
    out = corpus_pipeline.STAGES[n][1](spark, docs.limit(0), SF)
    assert out.count() == 0 and (n == 4 or out.schema.names == docs.schema.names)
