"""Files of many gzip members, read by byte ranges."""

import gzip
import random

import pytest

from cellgrid.sources import blocked
from cellgrid.sources.fastq import read_fastq_pairs


def fastq(n, length, end="\n", seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGT") for _ in range(length + rng.randint(0, 9))) for _ in range(n)], end


def text_of(reads, end):
    return "".join(f"@r{k} some words{end}{s}{end}+{end}{'I' * len(s)}{end}" for k, s in enumerate(reads)).encode()


def as_file(path, text, kind):
    if kind == "plain":
        raw = text
    elif kind == "blocked":
        raw = b"".join(blocked.block(text[i:i + 700]) for i in range(0, len(text), 700)) + blocked.block(b"")
    elif kind == "members":   # of uneven sizes, with names in their headers, some of them empty
        cuts, rng = [0], random.Random(7)
        while cuts[-1] < len(text):
            cuts.append(cuts[-1] + rng.choice((0, 1, 50, 3000)))
        raw = b"".join(gzip.compress(text[a:b], 1 + a % 9) for a, b in zip(cuts, cuts[1:]))
    elif kind == "padded":
        raw = as_bytes_one(text) + bytes(300)
    else:
        raw = as_bytes_one(text)
    path.write_bytes(raw)
    return str(path)


def as_bytes_one(text):
    return gzip.compress(text)


@pytest.mark.parametrize("k1,k2", [("blocked", "members"), ("members", "plain"), ("plain", "blocked"), ("one", "blocked"), ("padded", "one")])
def test_ranges_pair_by_record(spark, tmp_path, k1, k2):
    """Any kinds of files, lines that straddle blocks, no last line end, R2 longer or shorter."""
    pairs, want = [], []
    for lane, (n1, n2) in enumerate(((500, 500), (400, 437), (333, 300))):
        r1, _ = fastq(n1, 26, seed=lane)
        r2, end = fastq(n2, 48, "\r\n" if lane == 1 else "\n", seed=10 + lane)
        t1, t2 = text_of(r1, "\n"), text_of(r2, end)
        pairs.append((as_file(tmp_path / f"L{lane}, R1;.fq.gz", t1[:-1] if lane == 0 else t1, k1), as_file(tmp_path / f"L{lane}_R2.fq.gz", t2, k2)))
        want += [(lane, k, a, b) for k, (a, b) in enumerate(zip(r1, r2))]
    for size in (1500, 9001):
        df = read_fastq_pairs(spark, pairs, range_bytes=size)
        assert sorted(map(tuple, df.collect())) == want
    if k1 in ("blocked", "plain"):
        assert df.rdd.getNumPartitions() > len(pairs)   # several tasks for a file
    whole = read_fastq_pairs(spark, pairs)              # small files: lockstep
    assert sorted(map(tuple, whole.collect())) == want


def test_every_cut_of_a_file_finds_every_line(tmp_path):
    text = text_of(*fastq(60, 20))
    for kind in ("blocked", "members", "plain", "one"):
        path = as_file(tmp_path / kind, text, kind)
        size = (tmp_path / kind).stat().st_size
        for step in (97, 640, 5000):
            got = [blocked._count(path, s, s + step) for s in range(0, size, step)]
            assert sum(g[1] for g in got) == text.count(b"\n") and sum(g[2] for g in got) == len(text)
            seen = [g[0] for g in got if g[0] is not None]
            assert len(set(seen)) == len(seen)


def test_magic_inside_a_member_is_no_member(tmp_path):
    """Stored blocks show the text as it is, magic bytes included."""
    import zlib
    inner = (blocked.MEMBER + b"\x00" * 7 + b"line\n") * 500
    one = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = one.compress(inner) + one.flush()
    path = tmp_path / "stored.gz"
    path.write_bytes(raw + gzip.compress(b"a\nb\n"))
    got = [blocked._count(str(path), s, s + 400) for s in range(0, path.stat().st_size, 400)]
    assert sum(g[1] for g in got) == inner.count(b"\n") + 2
    assert [g[0] for g in got if g[0] is not None] == [0, len(raw)]


def test_cut_off_file_fails(tmp_path):
    path = tmp_path / "cut.gz"
    path.write_bytes(gzip.compress(b"x\n" * 5000)[:-9])
    with pytest.raises(EOFError):
        blocked._count(str(path), 0, 1 << 20)


def test_empty_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(gzip.compress(b""))
    (tmp_path / "c").write_bytes(blocked.block(text_of(*fastq(5, 20))))
    assert read_fastq_pairs(spark, [(str(tmp_path / "a"), str(tmp_path / "b")), (str(tmp_path / "a"), str(tmp_path / "c"))], range_bytes=10).count() == 0
