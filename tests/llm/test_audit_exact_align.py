"""Filter interactions, exact duplicates and tokenizer alignment against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import accumulate, permutations

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cellgrid.llm import align, audit, exact, queries

SCHEMA = "doc_id bigint, text string, source string, sha string, run int, keep struct<id:int>, `a.b` string, N int"
BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BIG = 9_007_199_254_740_993   # not a double


def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(rng.choice((30, 220, 400)))) for _ in range(25)]
    base += ["UPPER Case TEXT " * 5, "cost $5 & more", "same " * 300, " ".join(["x"] * 150 + ["y"] * 150), "\t\x0b\x1c  nbsp"]
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [(100 + i, base[i % 3]) for i in range(40)]            # a hot group of copies
    texts += [(200, base[0].upper()), (201, "Äb ÄB"), (202, "äb äb"), (203, "ÄB äB"), (204, "İ I"), (205, "i̇ i")]
    texts += [(300, None), (301, ""), (None, None), (None, base[1]), (None, "without an id"), (None, "without an id"), (302, "   ")]
    texts += [(7, base[7]), (7, base[7]), (7, base[8]), (BIG, base[2]), (BIG + 2, "a <|endoftext|> b <s>x</s> <unk> <0x41>")]
    texts += [(400, "a▁b"), (401, "  two  blanks\n and\r\n lines \t end  "), (402, "日本語のテキスト、漢字。 한국어 עברית 😀 ﬁ é é"),
              (403, "x" * 3000 + " " * 700 + "don't we'll ''s"), (404, "one two\u0085 three 　four"), (405, "\x00 nul"), (406, " "), (407, "é" * 400)]
    return [(i, t, None if k % 9 == 0 else "" if k % 9 == 1 else f"s{k % 4}", "x", 1, (2,), "y", 3) for k, (i, t) in enumerate(texts)]


LABELS = "doc_id bigint, quality int, toxic int, text string"


def labels():
    return [(i, i % 2, int(i % 5 == 0), "t") for i in range(0, 400, 3)] + [(3, 0, 1, None), (None, 1, 1, None), (BIG, 1, None, ""), (8, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def test_filter_audit_equals_brute_force(spark, docs):
    data, marks = rows(), defaultdict(set)
    for i, q, t, _ in labels():
        marks[i] |= {"good"} if q == 1 else set()
        marks[i] |= {"toxic"} if t == 1 else set()
    low = {}
    for r in data:
        if r[0] is not None:
            low[r[1] or ""] = min(low.get(r[1] or "", r[0]), r[0])
    judged = []
    for r in data:
        t, w = r[1] or "", re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        fails = {f for f, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                                             re.search(r"[#$%&*|]", t), r[0] is not None and r[0] > low[t])) if x}
        judged.append((r[2] or "", fails, set() if r[0] is None else marks[r[0]]))
    want = {}
    for part in {j[0] for j in judged}:
        removed = Counter()
        for order in permutations("ABCDE"):
            alive = [j for j in judged if j[0] == part]
            for k, f in enumerate(order):
                gone = [j for j in alive if f in j[1]]
                alive = [j for j in alive if f not in j[1]]
                removed[f] += len(gone)
                failing = [j for j in judged if j[0] == part and f in j[1]]
                want[part, "".join(order), k + 1] = [len(alive), len(gone), len(failing) - len(gone), sum(j[1] == {f} for j in failing),
                                                     sum("good" in j[2] for j in gone), sum("toxic" in j[2] for j in gone), f]
        for key in [k for k in want if k[0] == part]:
            want[key][6] = removed[want[key][6]]
    got = audit.audit(docs, spark.createDataFrame(labels(), LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want
    assert len(got) == len(want) and got[0].__fields__ == ["part", "filter_order", "step", *audit.COUNTS, "shapley"]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("largest,fan_in", [(True, 8), (True, 2), (False, 4)])
def test_exact_duplicates_equal_brute_force(docs, largest, fan_in):
    groups = defaultdict(list)
    for r in rows():
        groups[low(r[1])].append(r[0])
    want = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            want.append((i, keep, len(ids), i == keep and first, sha))
            first &= i != keep
    found = exact.duplicates(docs, largest=largest, fan_in=fan_in)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_runs_need_as_many_rounds_as_the_logarithm(spark, docs, monkeypatch):
    kept = []
    real = exact.stored
    monkeypatch.setattr(exact, "stored", lambda df, name: kept.append(name) or real(df, name))
    many = spark.createDataFrame([(i, f"t{i % 50}") for i in range(2000)], "doc_id bigint, text string").repartition(27)
    found = exact.duplicates(many, fan_in=4)
    assert found.where("kept").count() == 50 and found.agg({"group_size": "max"}).first()[0] == 40
    assert kept.count("runs") == 1 + 3   # 27 runs -> 7 -> 2 -> 1


def test_merging_keeps_collisions_of_the_digest_apart(spark):
    """Rows that agree in the digest but not in length or second hash are two texts."""
    rows = [(1, 0, 1, b"\x01" * 32, 5, 1), (2, 0, 2, b"\x01" * 32, 6, 1), (3, 1, 3, b"\x01" * 32, 5, 1), (4, 1, 4, b"\x01" * 32, 5, 2)]
    df = spark.createDataFrame(rows, "row bigint, run int, id bigint, sha binary, bytes bigint, check bigint")
    import pyspark.sql.functions as F
    got = exact.merged(exact.runs_of(df, F.max, F.col("id")), F.max).collect()
    assert sorted((r.bytes, r.check, r.keep, r.n) for r in got) == [(5, 1, 3, 2), (5, 2, 4, 1), (6, 1, 2, 1)]


def slow_alignment(data):
    """Whole texts, the libraries' own calls, every occurrence pair."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    codes = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    alphabet = {chr(c): c for c in codes} | {chr(256 + k): c for k, c in enumerate(x for x in range(256) if x not in codes)}
    done = []
    for r in data:
        t = r[1] or ""
        done.append(([], ""))
        if not t:
            continue
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        xa = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ia]
        xb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(xa) != (" " + t).encode() or b"".join(xb) != (" " + t).encode():
            continue
        ea, eb = list(accumulate(map(len, xa))), list(accumulate(map(len, xb)))
        groups, pa_, pb = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            groups.append((ia[pa_:ea.index(e) + 1], ib[pb:eb.index(e) + 1]))
            pa_, pb = ea.index(e) + 1, eb.index(e) + 1
        done[-1] = (groups, ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups))
    links = [[(x, y) for ga, gb in g for x in ga for y in gb] for g, _ in done]
    count = Counter(p for ls in links for p in set(ls))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(r[0], sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(ls), sum(count[p] == best[p[0]] for p in ls),
             sum(count[p] for p in ls), hashlib.sha256(s.encode()).hexdigest() if g else "") for r, (g, s), ls in zip(data, done, links)]


@pytest.mark.parametrize("block", [align.BLOCK, 2000])
def test_alignment_equals_brute_force(docs, block):
    want = sorted(map(repr, slow_alignment(rows())))
    found = align.align(docs, BYTE, PIECE, block=block)
    assert sorted(map(repr, map(tuple, found.collect()))) == want
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_random_characters(spark):
    """Chunks give what whole texts give, for any mix of blanks, symbols and scripts."""
    rng = random.Random(9)
    some = list("ab  \n\t\r'sll0.9-Zé日　 \u0085 <s>▁|") + ["  ", " a", " the", "\n\n ", "ing", "\x1c ", "\x1f"]
    data = [(i, "".join(rng.choice(some) for _ in range(rng.randint(1, 40))).replace("▁", "▁" if i % 20 == 0 else "_")) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(2)
    assert sorted(map(tuple, align.align(df, BYTE, PIECE).collect())) == sorted(slow_alignment(data))


def test_whole_chunks_when_the_vocabulary_cannot_be_cut(docs, monkeypatch):
    pair = align._pair(BYTE, PIECE)
    text = "the cat  sat\n on it's mat"
    cut, whole = align.Chunks(pair), align.Chunks(pair)
    a = cut.block([text], align.np.array([3]))
    monkeypatch.setattr(pair, "cuts", False)
    b = whole.block([text], align.np.array([3]))
    assert len(whole.parts) == 1 < len(cut.parts)
    for x in (a, b):   # pairs of a text come in any order
        x["pair"] = sorted(zip(align.np.frombuffer(x["pair"], "<u4").tolist(), align.np.frombuffer(x.pop("times"), "<i8").tolist()))
    assert {k: str(v) for k, v in a.items()} == {k: str(v) for k, v in b.items()}


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert exact.duplicates(none).count() == 0 and align.align(none, BYTE, PIECE).count() == 0
    assert audit.audit(none, spark.createDataFrame([], LABELS)).count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op11_filter_audit", "op12_exact_dedup", "op13_alignment"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
