"""Statistical operators against plain numpy / brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgrid.data import CellData
from cellgrid.functions.stats import bh_adjust, lgamma
from cellgrid.operators import emptydrops as ed
from cellgrid.operators.ranks import knee_inflection
from cellgrid.operators.tags import match_tags
from cellgrid.operators.totals import cr_thresholds


def test_lgamma_accuracy(spark):
    zs = [1e-6, 1e-3, 0.1, 0.5, 1.0, 2.5, 7.9, 10.0, 123.4, 1e4, 1e6]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(lgamma(F.col("z"))).collect()]
    for z, g in zip(zs, got):
        want = math.lgamma(z)
        assert abs(g - want) <= 2e-10 * max(1.0, abs(want)), (z, g, want)


def test_bh_matches_numpy(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(size=400), 2)  # ties on purpose
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(999, None)], "id bigint, pvalue double")
    got = {r.id: r.fdr for r in bh_adjust(df).collect()}
    m = p.size
    order = np.argsort(p)[::-1]
    ranks = np.empty(m)
    ranks[np.argsort(p, kind="stable")] = np.arange(1, m + 1)
    q = np.minimum.accumulate(p[order] * m / ranks[order])
    want = np.empty(m)
    want[order] = np.minimum(q, 1)
    # ties share the value of their highest rank
    for i in range(m):
        assert abs(got[i] - want[p == p[i]].min()) < 1e-12
    assert got[999] is None


def _mutate(seq, k, rng):
    s = list(seq)
    for pos in rng.choice(len(s), size=k, replace=False):
        s[pos] = "ACGT"[("ACGT".index(s[pos]) + 1 + rng.integers(3)) % 4]
    return "".join(s)


@pytest.mark.parametrize("length", [14, 30])
def test_hamming_matching_equals_brute_force(spark, length):
    rng = np.random.default_rng(length)
    lib = ["".join(rng.choice(list("ACGT"), size=length)) for _ in range(40)]
    lib.append(lib[3])  # repeated sequence: first position, last id
    obs = [_mutate(lib[rng.integers(40)], int(rng.integers(0, 5)), rng) for _ in range(400)]
    obs.append(lib[0][:-1])  # shorter: never matches
    lib_df = spark.createDataFrame([(i, f"t{i}", s) for i, s in enumerate(lib)], "pos bigint, tag_id string, seq string")
    got = {r.seq: r.tag_id for r in match_tags(spark.createDataFrame([(s,) for s in obs], "seq string"),
                                                lib_df).collect()}
    first_pos, last_id = {}, {}
    for i, s in enumerate(lib):
        first_pos.setdefault(s, i)
        last_id[s] = f"t{i}"
    ordered = sorted(first_pos, key=first_pos.get)
    for s in set(obs):
        if s in last_id:
            want = last_id[s]
        else:
            want = next((last_id[t] for t in ordered
                         if len(t) == len(s) and sum(a != b for a, b in zip(s, t)) < 3), None)
        assert got.get(s) == want, s


def m3(spark, small_mean=150):
    """Ambient barcodes plus two cell types with known truth (see FIXTURES.md)."""
    rng = np.random.default_rng(7)
    g = 200
    prof = 1.0 / np.arange(1, g + 1)
    prof /= prof.sum()
    perm1, perm2 = rng.permutation(g), rng.permutation(g)
    amb = rng.poisson(20 * prof, size=(5000, g))
    large = rng.poisson(2000 * prof[perm1], size=(200, g))
    small = rng.poisson(small_mean * prof[perm2], size=(100, g))
    mat = np.vstack([amb, large, small])
    r, c = np.nonzero(mat)
    x = spark.createDataFrame([(int(i), int(j), float(mat[i, j])) for i, j in zip(r, c)],
                              "cell_idx bigint, gene_idx bigint, value double")
    cells = spark.range(mat.shape[0]).select(F.col("id").alias("cell_idx"),
                                             F.concat(F.lit("B"), F.col("id").cast("string")).alias("cell_id"))
    genes = spark.range(g).select(F.col("id").alias("gene_idx"), F.col("id").cast("string").alias("gene_id"))
    return CellData(cells=cells, genes=genes, x_raw=x), mat


@pytest.fixture(scope="module")
def mixture(spark):
    return m3(spark)


def test_classic_on_mixture(mixture):
    cd, mat = mixture
    _, retain = cr_thresholds(cd, expect=3000)
    totals = mat.sum(axis=1)
    assert abs(retain - np.sort(totals)[::-1][30] * 0.1) < 1e-9
    kept = totals >= retain
    assert kept[5000:5200].all() and not kept[5200:].any()


def test_knee_inflection_on_mixture(mixture):
    cd, mat = mixture
    knee, infl = knee_inflection(cd, lower=100)
    totals = mat.sum(axis=1)
    # both points lie on the large-cell plateau of the curve
    assert totals[5000:5200].min() <= infl <= knee <= totals[5000:5200].max()


def test_emptydrops_recovers_cells(mixture):
    cd, mat = mixture
    table, got = ed.emptydrops_table(cd, lower=100, iters=1000, retain=None, alpha=float("inf"), seed=0)
    fdr = {r.cell_idx: r.fdr for r in table.collect()}
    called = [i for i in range(5000, 5300) if fdr.get(i) is not None and fdr[i] <= 0.001]
    assert len(called) >= 0.95 * 300
    assert got["alpha"] == float("inf")


def test_ambient_false_positives_are_rare(spark, mixture):
    cd, mat = mixture
    amb = cd.select_cells("cell_idx < 5000", record=False) if False else cd.replace(
        cells=cd.cells.where("cell_idx < 5000"), cells_filtered=True)
    table, _ = ed.emptydrops_table(amb, lower=20, iters=500, retain=float("inf"), alpha=float("inf"), seed=1)
    n_called = table.where(F.col("fdr") <= 0.001).count()
    n_tested = table.where(F.col("fdr").isNotNull()).count()
    assert n_tested > 0 and n_called <= 0.01 * n_tested


def observed_levels(spark, totals, per_total, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(float(t), round(float(-rng.exponential(t ** 0.5) * 4), 6)) for t in totals for _ in range(per_total)]
    return spark.createDataFrame(sorted(set(rows)), "total double, level double")


@pytest.mark.parametrize("alpha", [float("inf"), 3.0])
def test_counts_do_not_depend_on_blocks_or_shares(spark, alpha):
    """Any cut of levels and iterations gives the counts of plain simulated paths."""
    prof = np.arange(1, 21) / 210.0
    obs = observed_levels(spark, (3, 15, 40), 60)
    levels = [tuple(r) for r in obs.collect()]
    totals = np.array([3.0, 15.0, 40.0])
    sims = np.round([ed._simulate(prof, alpha, totals, 5, i) for i in range(64)], ed.LIKELIHOOD_DIGITS)
    want = sorted((t, v, int((sims[:, (3, 15, 40).index(int(t))] <= v).sum())) for t, v in levels)
    assert any(0 < w[2] < 64 for w in want)
    for shares, most in ((1, 10 ** 6), (8, 10 ** 6), (5, 25)):   # the last cuts one total's levels as well
        got = ed.simulated_below(obs, prof, alpha, 64, seed=5, shares=shares, most=most)
        assert sorted(map(tuple, got.collect())) == want


def test_rows_of_the_simulation_do_not_grow_with_iterations(spark, monkeypatch):
    obs, prof = observed_levels(spark, (4, 9), 20), np.full(10, 0.1)
    rows, real = [], ed._counted
    for iters in (16, 4096):
        got = ed.simulated_below(obs, prof, 2.0, iters, shares=4)
        rows.append(got.count())
        one = real(obs.toPandas(), prof, 2.0, range(0, iters, 4), 0)
        assert len(one) == obs.count()   # what a task returns
    assert rows == [obs.count()] * 2


def test_iterations_share_the_cumulative_proportions(monkeypatch):
    """A path costs its draws: the genes-long running sum is made once, not for every iteration."""
    levels, prof, seen, real = pd.DataFrame({"total": [4.0, 9.0], "level": [-5.0, -9.0]}), np.full(1000, 0.001), [], ed.urn_draws
    monkeypatch.setattr(ed, "urn_draws", lambda upto, *rest: seen.append(upto) or real(upto, *rest))
    ed._counted(levels, prof, 2.0, range(16), 0)
    assert len(seen) == 16 and all(u is seen[0] for u in seen)


def test_urn_draws_are_dirichlet_multinomial():
    """Mean, variance (inflated by (n + alpha) / (1 + alpha)) and covariance of counts."""
    p, alpha, n = np.array([0.5, 0.3, 0.2]), 4.0, 12
    x = np.array([np.bincount(ed.urn_draws(np.cumsum(p), alpha, n, 17, i), minlength=3) for i in range(40_000)])
    more = (n + alpha) / (1 + alpha)
    assert np.allclose(x.mean(axis=0), n * p, atol=0.05)
    assert np.allclose(np.cov(x.T), more * n * (np.diag(p) - np.outer(p, p)), atol=0.2)
    # the exact probability of one composition
    def prob(c):
        return math.exp(math.lgamma(n + 1) + math.lgamma(alpha) - math.lgamma(n + alpha) + sum(
            math.lgamma(k + alpha * q) - math.lgamma(k + 1) - math.lgamma(alpha * q) for k, q in zip(c, p)))
    for c in ((12, 0, 0), (6, 4, 2), (0, 6, 6)):
        assert abs((x == c).all(axis=1).mean() - prob(c)) < 4 * math.sqrt(prob(c) / 40_000) + 1e-4


def test_urn_of_tiny_alpha_repeats_one_gene():
    draws = ed.urn_draws(np.cumsum([0.25] * 4), 1e-9, 500, 1, 2)
    assert len(set(draws.tolist())) == 1   # a chain of repeats is followed to its first draw


def test_simulated_path_matches_direct_likelihood():
    # the incremental path equals the lnGamma formula evaluated on the drawn counts
    prof = np.full(10, 0.1)
    for alpha in (float("inf"), 3.0):
        vals = ed._simulate(prof, alpha, np.array([5.0, 12.0]), 9, 0)
        draws = ed.urn_draws(np.cumsum(prof / prof.sum()), alpha, 12, 9, 0)
        for t, v in zip((5, 12), vals):
            x = np.bincount(draws[:t], minlength=10)
            if math.isinf(alpha):
                want = math.lgamma(t + 1) + sum(xi * math.log(pi) - math.lgamma(xi + 1) for xi, pi in zip(x, prof))
            else:
                want = (math.lgamma(t + 1) + math.lgamma(alpha) - math.lgamma(t + alpha)
                        + sum(math.lgamma(xi + alpha * pi) - math.lgamma(xi + 1) - math.lgamma(alpha * pi)
                              for xi, pi in zip(x, prof)))
            assert abs(v - want) < 1e-9


def test_alpha_mle_is_the_best_of_the_lgamma_likelihood(mixture):
    """Tail counts: their derivative is that of the log-gamma likelihood, which no neighbour beats."""
    cd, mat = mixture
    props = ed.ambient_proportions(cd, lower=100)
    a = ed.estimate_alpha(cd, props, lower=100)
    p = {r.gene_idx: r.prop for r in props.collect()}
    amb = mat[mat.sum(axis=1) <= 100]
    pv = np.array([p.get(j, 0.0) for j in range(amb.shape[1])])
    lg = np.vectorize(math.lgamma)

    def ll(alpha):
        out = 0.0
        for x in amb[amb.sum(axis=1) > 0]:
            k = np.flatnonzero(x)
            out += math.lgamma(alpha) - math.lgamma(x.sum() + alpha) + (lg(x[k] + alpha * pv[k]) - lg(alpha * pv[k])).sum()
        return out

    if 0.01 < a < 10000:
        assert ll(a) >= max(ll(a * 1.01), ll(a / 1.01))
    else:
        assert ll(a) >= ll(a / 1.1 if a > 1 else a * 1.1)


def test_alpha_needs_whole_counts(spark):
    x = spark.createDataFrame([(0, 0, 1.5), (1, 1, 2.0)], "cell_idx bigint, gene_idx bigint, value double")
    cells = spark.createDataFrame([(0, "a"), (1, "b")], "cell_idx bigint, cell_id string")
    cd = CellData(cells=cells, genes=cells.toDF("gene_idx", "gene_id"), x_raw=x)
    with pytest.raises(Exception, match="whole counts"):
        ed.estimate_alpha(cd, ed.ambient_proportions(cd, lower=100), lower=100)


def test_alpha_mle_recovers_dirichlet(spark):
    rng = np.random.default_rng(11)
    g, alpha = 60, 40.0
    prof = 1.0 / np.arange(1, g + 1)
    prof /= prof.sum()
    rows = []
    for i in range(1500):
        q = rng.dirichlet(alpha * prof)
        counts = rng.multinomial(int(rng.integers(20, 80)), q)
        rows += [(i, j, float(v)) for j, v in enumerate(counts) if v]
    x = spark.createDataFrame(rows, "cell_idx bigint, gene_idx bigint, value double")
    cells = spark.range(1500).select(F.col("id").alias("cell_idx"), F.col("id").cast("string").alias("cell_id"))
    genes = spark.range(g).select(F.col("id").alias("gene_idx"), F.col("id").cast("string").alias("gene_id"))
    cd = CellData(cells=cells, genes=genes, x_raw=x)
    props = ed.ambient_proportions(cd, lower=100)
    a = ed.estimate_alpha(cd, props, lower=100)
    assert 30 < a < 55, a
    called = cd.filter_emptydrops(lower=60, iters=50, seed=1, retain=1e9, fdr=0.01, keep_all=True)   # the default: alpha from the data
    assert 30 < called.get_parameter("emptydrops", "alpha") < 60
    p = called.cells.where("emptydrops_fdr <= 0.01").count()
    assert p <= 0.02 * 1500   # all barcodes are ambient: the estimate explains their spread


def test_kmer_nearest_blocks_agree(spark):
    from cellgrid.operators.tags import kmer_nearest
    rng = np.random.default_rng(5)
    lib = ["".join(rng.choice(list("ACGT"), size=30)) for _ in range(30)]
    obs = [_mutate(lib[rng.integers(30)], int(rng.integers(0, 8)), rng) for _ in range(200)] + ["NNNNN", "AC"]
    lib_df = spark.createDataFrame([(i, f"t{i}", s) for i, s in enumerate(lib)], "pos bigint, tag_id string, seq string")
    obs_df = spark.createDataFrame([(s,) for s in obs], "seq string")
    a = {r.seq: (r.tag_id, round(r.distance, 9)) for r in kmer_nearest(obs_df, lib_df).collect()}
    b = {r.seq: (r.tag_id, round(r.distance, 9)) for r in kmer_nearest(obs_df, lib_df, block=7).collect()}
    assert a == b and "NNNNN" not in a and "AC" not in a
