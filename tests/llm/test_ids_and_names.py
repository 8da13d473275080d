"""Ids pass through every operator as they are; extra columns may have any name."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellgrid.llm import exact, mixing, packing, quality, simhash, tokenfile, toxicity
from cellgrid.llm.oracle import ORACLE

BIG = 9_007_199_254_740_993   # 2 ** 53 + 1: not a double
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [(BIG, "one two three four five"), (None, "one two three four five"), (BIG + 2, "a <|endoftext|> b"), (-BIG, ""), (7, None),
         (2 ** 63 - 1, "É <|startoftext|><|endoftext|>x ½ it's")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string").coalesce(1)   # all in one batch


def ids_of(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


WANT = sorted((i for i, _ in TEXTS), key=str)


def test_packing(docs):
    tok = Tokenizer.from_file(BYTE)
    found = packing.pack(docs, BYTE, size=64, end_id=0)
    assert ids_of(found) == WANT
    got = {r.doc_id: (r.length, r.ids_crc32) for r in found.collect()}
    for i, t in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_token_files(docs):
    tok = Tokenizer.from_file(WORD)
    files = tokenfile.write_tokens(docs, tokenfile.token_folder(docs.sparkSession), WORD, end_id=2)
    found = tokenfile.read_documents(files)
    assert ids_of(found) == WANT
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in found.collect()}
    for i, t in TEXTS:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert {r.doc_id: r.start for r in found.collect()}[None] == 0


def test_simhash(docs):
    found = simhash.near_duplicates(docs)
    assert ids_of(found) == WANT
    assert {r.doc_id: r.component_id for r in found.collect()}[None] == BIG


def test_classifiers(spark, docs):
    labels = spark.createDataFrame([(BIG, 1, 1), (BIG + 2, 0, 0), (7, 1, 0), (-BIG, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert ids_of(quality.score(docs, quality.train(docs, labels))) == WANT
    assert ids_of(toxicity.score(docs, toxicity.train(docs, labels, held_out=2, mod=4))) == WANT


def test_exact(docs):
    assert ids_of(exact.duplicates(docs)) == WANT


def test_mixing_with_clashing_names(spark):
    rows = [(i, f"t{i}", f"s{i % 3}", 5, "p", 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, Copy int, PLACE string, _key int")
    found = mixing.mix(df)
    assert found.columns == ["doc_id", "text", "source", "_key", "copy", "place"]
    assert {r.copy for r in found.collect()} >= {0, 1}
    kept = mixing.mix(df, copy_name="nth", place_name="where")
    assert kept.columns == [*df.columns, "nth", "where"] and {(r.Copy, r.PLACE) for r in kept.collect()} == {(5, "p")}


def test_mixing_sql_with_rates_above_one_draw(spark):
    """A source of one row beside a large one repeats over 16 times."""
    rows = [(i, f"text {i}", "large", "en", 6) for i in range(400)] + [(1000 + i, f"text {i}", f"one{i}", "en", 6) for i in range(3)]
    rows += [(2000, None, None, "en", None), (5, "text 5", "large", "en", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint")
    found = mixing.mix(df, alpha=0.5, seed=7).toPandas()
    assert found.groupby("source", dropna=False).size().drop("large").max() > 16
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"n_chars": "Int64"}))
    sql = con.execute(ORACLE["op3_mixing"]).fetchall()
    assert sorted((r[0], r[3], r[5], r[6]) if r[3] else (r[0], "", r[5], r[6]) for r in sql) == sorted(
        (r.doc_id, r.source or "", r.copy, r.place) for r in found.itertuples())
