"""SimHash, line dedup, mixing, packing and token files against plain versions."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellgrid.llm import common, lines, mixing, packing, simhash, tokenfile, tokens

SCHEMA = "doc_id bigint, text string, source string, fp string, _h int, key int"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, empty, null and long texts, repeated rows, null ids and clashing columns."""
    rng = random.Random(1)
    base = ["\n".join(words(rng, rng.randint(3, 14)) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 4]) for i in range(60)]                          # a hot group of copies
    rows += [(200 + i, base[5] + " " + words(rng, 1)) for i in range(15)]        # near copies
    rows += [(300, None), (301, ""), (302, ""), (303, "   "), (None, base[3]), (None, "only here once"), (304, "Ab ÄB"), (305, "ab Äb")]
    rows += [(306, words(rng, 6000)), (7, base[7]), (7, base[7])]
    return [(i, t, f"s{(i or 0) % 3}" if i != 301 else None, "x", 1, 2) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


def slow_fingerprint(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if x]
    grams = ([b" ".join(w)] if len(w) < 3 else [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)]) if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def groups(n, linked):
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shard", [simhash.SHARD, 16])
def test_simhash_groups_equal_brute_force(spark, docs, corpus, shard):
    fps = [slow_fingerprint(r[1]) for r in corpus]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    top = groups(len(fps), near)
    first = {}
    for g, r in zip(top, corpus):
        if r[0] is not None:
            first[g] = min(first.get(g, math.inf), r[0])
    want = sorted((r[0] if r[0] is not None else -1, f"{f:016x}", first.get(g, -1)) for r, f, g in zip(corpus, fps, top))
    got = simhash.near_duplicates(docs, shard=shard).select("doc_id", simhash.as_hex(F.col("fp")).alias("f"), "component_id")
    assert sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1) for r in got.collect()) == want
    kept = simhash.keep_first(docs, shard=shard)
    assert kept.columns == docs.columns and kept.count() == len(set(top))
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(first.values()) <= ids


def test_simhash_shard_links_random_and_clustered():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (4, 900)).astype(np.uint64)
    x = np.unique(np.concatenate([x, x[:900] ^ flips[0], x[:900] ^ flips[1] ^ flips[2], x[0] ^ flips[3] ^ flips[0], x[0] ^ flips[1] ^ flips[2] ^ flips[3]]))
    near = [(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 3)]
    want = groups(len(x), near)
    a, b = simhash.shard_links(x, np.zeros(len(x), int), 3)
    place = {v: i for i, v in enumerate(x.tolist())}
    got = groups(len(x), [(place[i], place[j]) for i, j in zip(a.tolist(), b.tolist())])
    assert got == want


def test_components_of_a_path_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(500, 500)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{200 + i: 100 for i in range(50)}, 100: 100}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def slow_norm(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def slow_line_fp(norm):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in set(norm.split(" "))]
    return sum(1 << b for b in range(63) if sum(x >> b & 1 for x in h) * 2 > len(h))


def tight_cluster(n=6000, spread=9):
    """Distinct fingerprints in a ball that no pivot cuts, some far from all others."""
    rng = np.random.default_rng(8)
    picks = np.argsort(rng.random((n, 64)), axis=1)[:, :spread]
    x = np.bitwise_or.reduce(np.uint64(1) << picks.astype(np.uint64), axis=1)
    return np.unique(np.concatenate([x, rng.integers(0, 1 << 63, 40, dtype=np.uint64)]))


@pytest.mark.parametrize("spread", [2, 5, 9])
def test_simhash_tight_cluster_is_dealt_into_bounded_shards(spark, spread):
    x = tight_cluster(3000, spread)
    near = [(i, j) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[:i] ^ x[i]) <= 3)]
    want = groups(len(x), near)
    shard = 256
    tree = simhash.grow(x, len(x), 3, shard)
    sizes = {}
    for number, side, part in simhash.walk(tree, x, 3):
        sizes[number] = sizes.get(number, 0) + len(part)
    assert simhash.dealt(tree) and max(sizes.values()) <= 2 * shard
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp bigint").repartition(4)
    found = simhash.links(df, 3, shard=shard).collect()
    place = {v: i for i, v in enumerate(x.view(np.int64).tolist())}
    assert groups(len(x), [(place[r.a], place[r.b]) for r in found]) == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def slow_line_dedup(rows):
    """``{id: text}`` for rows with distinct, non-null ids."""
    seen = {}
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            n = slow_norm(line)
            if n.count(" ") >= 4:
                seen.setdefault(n, (i, k))
    names = list(seen)
    fps = [slow_line_fp(n) for n in names]
    near = [(i, j) for i in range(len(names)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3
            and edit_distance(names[i], names[j]) <= 0.2 * max(len(names[i]), len(names[j])) + 1e-6]
    top = groups(len(names), near)
    best = {}
    for n, g in zip(names, top):
        best[g] = min(best.get(g, (math.inf, 0)), seen[n])
    stay = set(best.values())
    return {i: None if t is None else "\n".join(line for k, line in enumerate(t.split("\n"))
                                                if slow_norm(line).count(" ") < 4 or (i, k) in stay) for i, t in rows}, len(near)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    base = [words(rng, rng.randint(5, 60)) for _ in range(30)]
    variants = [b[:len(b) // 2] + c + b[len(b) // 2 + 1:] for b in base for c in "XYZ"]
    pool = base + variants + [b.upper() + "!!" for b in base] + [" ".join(words(rng, 1) for _ in range(3)), "", "a b c d", "short line"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 5)))) for i in range(120)]
    rows += [(500 + i, pool[0]) for i in range(60)] + [(900, None), (901, ""), (902, "\n\n")]
    want, near = slow_line_dedup(rows)
    df = spark.createDataFrame([(i, t, None if t is None else len(t), "q") for i, t in rows], "doc_id bigint, text string, n_chars int, fp string")
    out = lines.dedup_lines(df.repartition(4), length_col="n_chars")
    assert out.columns == df.columns and near > 30
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(v[1] == (None if v[0] is None else len(v[0])) for v in got.values())


def test_line_dedup_ties_nulls_and_empty_table(spark):
    line = "one two three four five six"
    df = spark.createDataFrame([(None, line), (3, line), (3, line), (2, line + "\n" + line), (2, "x")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.text) for r in lines.dedup_lines(df).collect()) == [(0, ""), (2, line), (2, "x"), (3, ""), (3, "")]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_line_simhash_widths_agree(spark):
    rng = random.Random(2)
    rows = [(k, [rng.getrandbits(64) - (1 << 63) for _ in range(k)]) for k in (1, 2, 5, 127, 128, 300)]
    df = spark.createDataFrame(rows, "n int, h array<bigint>")
    got = df.select("n", lines.simhash("h").alias("a"), F.expr(lines._majority("h", 21)).alias("b"), F.expr(lines._majority("h", 63)).alias("c")).collect()
    for r, (n, h) in zip(got, rows):
        want = sum(1 << b for b in range(63) if sum((x >> b) & 1 for x in h) * 2 > n)
        assert (r.a, r.b, r.c) == (want,) * 3


def test_mixing_follows_weights_and_is_repeatable(spark, docs):
    rows = [(i, f"t{i}", "big" if i % 3 else f"s{i % 2}", "x", 1, 2) for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    w = spark.createDataFrame([("big", 1.0), ("s0", 3.0), ("s1", None), ("other", 9.0)], "source string, weight double")
    out = mixing.mix(df, w, total=4000).cache()
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {"big", "s0"} and abs(n["big"] - 1000) < 5 * 1000 ** 0.5 and abs(n["s0"] - 3000) < 5 * 3000 ** 0.5
    again = mixing.mix(df.repartition(2), w, total=4000)
    assert sorted(map(tuple, out.select("doc_id", "copy", "place").collect())) == sorted(map(tuple, again.select("doc_id", "copy", "place").collect()))
    large = mixing.mix(df.where("doc_id < 5"), total=500, alpha=0.0)   # mean far above one draw's step
    assert abs(large.count() - 500) < 5 * 500 ** 0.5
    assert mixing.mix(df.limit(0)).count() == 0
    odd = mixing.mix(docs, alpha=1.0)
    assert odd.columns == docs.columns + ["copy", "place"] and odd.where("source is null").count() <= 12


def test_cut_keeps_the_short_piece_first():
    for n in (1, 5, 2047, 2048, 2049, 4096, 5000, 9999):
        got = packing.cut(n, 2048)
        assert sum(x for _, x in got) == n and all(x == 2048 for _, x in got[1:]) and len(got) == -(-n // 2048)
        assert [s for s, _ in got] == [sum(x for _, x in got[:k]) for k in range(len(got))]


def test_fullest_finds_the_best_sum():
    rng = random.Random(4)
    for _ in range(200):
        lengths = sorted({rng.randint(1, 30) for _ in range(rng.randint(1, 6))}, reverse=True)
        counts = {v: rng.randint(1, 3) for v in lengths}
        room = rng.randint(0, 60)
        sums = {0}
        for v in lengths:
            sums = {s + k * v for s in sums for k in range(counts[v] + 1)}
        used = packing.fullest(lengths, counts, room)
        assert sum(used) == max(s for s in sums if s <= room) and all(used.count(v) <= counts[v] for v in used)


@pytest.mark.parametrize("group", [packing.GROUP, 20])
def test_packing_is_whole_gapless_and_tight(spark, docs, corpus, group):
    size = 256
    got = packing.pack(docs, BYTE, size=size, end_id=0, group=group).toPandas()
    tok = Tokenizer.from_file(BYTE)
    want = []
    for r in corpus:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(-1 if r[0] is None else r[0], k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids), size))]
    have = [(-1 if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(have) == sorted(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1].tolist()] and g["length"].sum() <= size
    bins, least = got["sequence_id"].nunique(), -(-got["length"].sum() // size)
    assert bins <= least + (1 if group > 1000 else -(-len(got) // 10))
    assert packing.pack(docs.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_the_library(path, corpus):
    rng = random.Random(8)
    spaces = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "　", " "]
    latin = ["It's", "'s", "x'LL", "Hello,", "12ab3", "ÀÉ", "é", "a" * 300, "²3", "_", "×ßŒ÷", "ªµºŉǅ", "¼½", "\xad", "\x1f", "S'ſ", "ɏ"]
    parts = latin + ["́", "ΑΣ", "日本語", "😀!", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "İ", "ɐ"]
    texts = ["".join(rng.choice(some) + rng.choice(blanks) * rng.randint(0, 2) for _ in range(rng.randint(0, 30)))
             for some, blanks in ((parts, spaces), (latin, spaces[:-2])) for _ in range(250)]
    tok = Tokenizer.from_file(path)   # as it is loaded
    enc = tokens.Encoder(path)
    assert enc.rule is not None
    for t in [None, "", " ", *texts, *[r[1] for r in corpus]] * 2:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_token_file_random_access(tmp_path):
    import pyarrow as pa

    rng = np.random.default_rng(1)
    x = rng.choice([0, 1, 255, 256, 65535, 65536, 2 ** 24, 2 ** 32 - 1], size=5000).astype("<u4")
    uri = str(tmp_path / "a.dac")
    tokenfile.write_documents(uri, pa.array([1, None, 9]), [x[:100].tobytes(), b"", x[100:].tobytes()])
    f = tokenfile.TokenFile(uri)
    assert len(f) == 5000 and (f.tokens(0, 5000) == x).all() and len(f.tokens(7, 7)) == 0
    assert all(f.token(i) == x[i] for i in range(0, 5000, 13))
    for _ in range(200):
        a, b = sorted(rng.integers(0, 5001, 2))
        assert (f.tokens(int(a), int(b)) == x[a:b]).all()
    assert f.documents()[0].to_pylist() == [1, None, 9] and f.documents()[1].tolist() == [0, 100, 100, 5000]


def test_token_files_round_trip(spark, docs, corpus):
    files = tokenfile.write_tokens(docs, tokenfile.token_folder(spark), WORD, end_id=2, file_tokens=500)
    assert files.count() > 3
    got = tokenfile.read_documents(files).collect()
    tok = Tokenizer.from_file(WORD)
    want = sorted((-1 if r[0] is None else r[0], len(e), zlib.crc32(np.array(e, "<u4").tobytes()))
                  for r in corpus for e in [tok.encode(r[1] or "", add_special_tokens=False).ids + [2]])
    assert sorted((-1 if r[0] is None else r[0], r[2], r[3]) for r in got) == want
    order = sorted(got, key=lambda r: (r.start, r.n_tokens))
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids) and [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1].tolist()]
    none = tokenfile.write_tokens(docs.limit(0), tokenfile.token_folder(spark), WORD)
    assert tokenfile.read_documents(none).count() == 0
