"""The operators against values stated for a small matrix, against NumPy, and against what must hold of any result."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quantloom.functions.stats import t_pvalue
from quantloom.matrix import Matrix
from quantloom.operators import annotate, cluster, compare, decoys, impute, learn, normalize, quantify, scaling
from quantloom.sources import diann, tables

# A matrix of three peptides and samples.
MINIMAL = [("PEPTIK", 1, 10.0), ("EFMEEVIQR", 2, 20.0), ("SSSGTPDLPVLLTDLK", 3, 30.0)]


def cells_of(spark, x, names=None):
    rows = [(i, f"s{j:02d}", None if np.isnan(v) else float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "row_id long, sample string, value double")


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r["value"] is not None:
            out[r["row_id"], int(r["sample"][1:])] = r["value"]
    return out


def samples_of(spark, n, groups=None):
    groups = groups or [1 if j < n // 2 else 2 for j in range(n)]
    return spark.createDataFrame([(f"s{j:02d}", j, groups[j], j % 3 + 1, f"s{(j + n // 2) % n:02d}", float(j * 7 % 5), "ab"[j % 2]) for j in range(n)], "sample string, sample_ord int, group int, batch int, pair string, age double, sex string")


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(5, 1, (40, 12)))
    x[rng.random(x.shape) < 0.15] = np.nan
    return x


def test_read_split_and_write(spark, tmp_path):
    lines = ["PeptideSequence\tCharge\tDecoy\tProtein\tRetentionTime\tS1\tS2", "B\t2\t0\tP2\t9.5\t4\tNaN", "A\t1\t0\tP1\t3.5\t1\t2", "C\t2\t1\tP1\t5.0\t0\t8"]
    (tmp_path / "q.tsv").write_text("\n".join(lines))
    (tmp_path / "d.tsv").write_text("Sample\tGroup\nS1\t1\nS2\t2\n")
    m = Matrix.read(spark, str(tmp_path / "q.tsv"), str(tmp_path / "d.tsv"))
    assert [(r["PeptideSequence"], r["row_id"]) for r in m.features.orderBy("row_id").collect()] == [("A", 0), ("C", 1), ("B", 2)]
    assert m.get_samples() == ["S1", "S2"] and m.get_samples(2) == ["S2"] and m.proteins == ["P1", "P2"] and m.precursors == ["A_1", "C_2", "B_2"]
    wide = {r["PeptideSequence"]: (r["S1"], r["S2"]) for r in m.to_df().collect()}
    assert wide == {"A": (1.0, 2.0), "B": (4.0, None), "C": (0.0, 8.0)}
    m.write(str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).count() == 3
    with pytest.raises(KeyError):
        tables.split_matrix(m.features, ["none"])
    with pytest.raises(ValueError):
        Matrix.read(spark, m.features, m.samples, quant_type="other")


def test_mean_normalisation_equals_the_formula(spark, noisy):
    got = dense(normalize.normalize(cells_of(spark, noisy), "mean", log_transform=False), noisy.shape)
    m = np.nanmean(noisy, 0)
    assert np.allclose(got, noisy / m * m.mean(), equal_nan=True)
    assert np.allclose(np.nanmean(got, 0), m.mean())
    logs = dense(normalize.normalize(cells_of(spark, noisy), "tic"), noisy.shape)
    s = np.nansum(noisy, 0)
    assert np.allclose(logs, np.log2(noisy / s * np.median(s)), equal_nan=True)
    with pytest.raises(ValueError):
        normalize.normalize(cells_of(spark, noisy), "other")


def test_scaling(spark, noisy):
    cells = cells_of(spark, noisy)
    z = dense(scaling.scale(cells, "zscore"), noisy.shape)
    assert np.allclose(z, (noisy - np.nanmean(noisy, 1, keepdims=True)) / np.nanstd(noisy, 1, keepdims=True), equal_nan=True)
    assert np.allclose(np.nansum(z, 1), 0)
    assert np.allclose(dense(scaling.scale(cells, "absmax"), noisy.shape), noisy / np.nanmax(noisy, 1, keepdims=True), equal_nan=True)
    flat = dense(scaling.scale(cells_of(spark, np.ones((2, 3))), "zscore"), (2, 3))
    assert np.isnan(flat).all()


def brute_windows(x, rt, minimum, stride):
    lo, hi = rt.min(), rt.max()
    nb = max(1, math.ceil((hi - lo) / stride))
    bins = np.minimum(np.floor((rt - lo) / stride).astype(int), nb - 1)
    expanded = []
    for b in range(nb):
        e = 0
        while (np.abs(bins - b) <= e).sum() < minimum and e < nb - 1:
            e += 1
        expanded.append(np.flatnonzero(np.abs(bins - b) <= e))
    windows = [np.concatenate([expanded[k] for k in range(max(0, i - 1), min(nb, i + 2))]) for i in range(nb)]
    total, seen = np.zeros_like(x), np.zeros(x.shape)
    for w in windows:
        m = np.nanmean(x[w], 0)
        part = x[w] / m * m.mean()
        for k, i in enumerate(w):
            ok = ~np.isnan(part[k])
            total[i, ok] += part[k, ok]
            seen[i, ok] += 1
    return np.where(seen > 0, total / np.maximum(seen, 1), np.nan)


def test_windows_of_retention_time(spark):
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(3, 1, (60, 5)))
    x[rng.random(x.shape) < 0.1] = np.nan
    rt = np.sort(rng.uniform(0, 30, 60))
    features = spark.createDataFrame([(i, float(t)) for i, t in enumerate(rt)], "row_id long, RetentionTime double")
    for minimum, stride in ((8, 2.0), (100, 5.0), (1, 50.0)):
        got = dense(normalize.by_rt_window(cells_of(spark, x), features, "mean", minimum, stride), x.shape)
        assert np.allclose(got, brute_windows(x, rt, minimum, stride), equal_nan=True)


def brute_lfq(x):
    """Least squares over all pairs, in groups of one step from the first uncovered sample."""
    n = x.shape[1]
    have = ~np.isnan(x)
    out, covered = np.full(n, np.nan), set()
    for s in range(n):
        if s in covered or not have[:, s].any():
            continue
        group = np.flatnonzero(have[have[:, s]].any(0))
        covered |= set(group.tolist())
        y = x[:, group]
        if len(group) == 1:
            out[group] = np.nanmedian(y)
            continue
        k = len(group)
        a, b = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
        for i in range(k):
            for j in range(i + 1, k):
                d = y[:, j] - y[:, i]
                r = np.nanmedian(d) if (~np.isnan(d)).any() else 0.0
                a[i, i] += 1
                a[j, j] += 1
                a[i, j] = a[j, i] = -1
                b[i] -= r
                b[j] += r
        a[:k, k] = a[k, :k] = 1
        b[k] = np.nanmean(y) * k
        out[group] = np.linalg.lstsq(a, b, rcond=None)[0][:k]
    return out


def test_ratio_profiles_equal_least_squares(spark):
    rng = np.random.default_rng(3)
    blocks, rows, feats, want = [], [], [], {}
    for g in range(12):
        x = rng.normal(10, 2, (rng.integers(1, 7), 8))
        x[rng.random(x.shape) < [0.1, 0.5, 0.75][g % 3]] = np.nan
        base = len(feats)
        feats += [(base + i, f"P{g}") for i in range(len(x))]
        rows += [(base + i, f"s{j:02d}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if not np.isnan(v)]
        want[f"P{g}"] = brute_lfq(x)
        blocks.append(x)
    cells, features = spark.createDataFrame(rows, "row_id long, sample string, value double"), spark.createDataFrame(feats, "row_id long, Protein string")
    got = {k: np.full(8, np.nan) for k in want}
    for r in quantify.maxlfq(cells, features, samples_of(spark, 8)).collect():
        got[r["key"]][int(r["sample"][1:])] = np.nan if r["value"] is None else r["value"]
    for k in want:
        assert np.allclose(got[k], want[k], equal_nan=True), k
    with pytest.raises(ValueError):
        quantify.maxlfq(cells, features, samples_of(spark, 8), level="none")


def test_top_n(spark):
    x = np.array([[1.0, np.nan], [5.0, np.nan], [0.0, np.nan], [3.0, 2.0]])
    features = spark.createDataFrame([(0, "A"), (1, "A"), (2, "A"), (3, "B")], "row_id long, Protein string")
    get = lambda n, how: {(r["key"], r["sample"]): r["value"] for r in quantify.top_n(cells_of(spark, x), features, "protein", n, how).collect()}
    assert get(2, "sum") == {("A", "s00"): 6.0, ("A", "s01"): 0.0, ("B", "s00"): 3.0, ("B", "s01"): 2.0}
    assert get(1, "sum")["A", "s00"] == 5.0 and get(1, "mean")["A", "s01"] is None
    assert get(3, "mean")["A", "s00"] == 3.0 and get(3, "median")["A", "s01"] is None


def test_t_distribution(spark):
    # T, degrees of freedom, two-sided p.
    table = [(12.706204736432095, 1, 0.05), (4.302652729911275, 2, 0.05), (2.570581835636314, 5, 0.05), (2.2281388519649385, 10, 0.05), (3.169272667, 10, 0.01), (0.0, 7, 1.0), (1.9623390808264078, 1000, 0.05)]
    got = spark.createDataFrame(table, "t double, df int, p double").select("p", t_pvalue(F.col("t"), F.col("df")).alias("q")).collect()
    assert all(abs(r.p - r.q) < 1e-8 for r in got)


def test_paired_and_covariates_against_numpy(spark, noisy):
    logs = np.log2(noisy)
    cells, s = cells_of(spark, logs), samples_of(spark, 12)
    for r in compare.paired(cells, s, (1, 2)).collect():
        d = logs[r["row_id"], :6] - logs[r["row_id"], 6:]
        d = d[~np.isnan(d)]
        assert r["n_pairs"] == len(d) and (len(d) == 0 or abs(r["mean_difference"] - d.mean()) < 1e-9)
    design = s.orderBy("sample").toPandas()
    x = np.stack([np.ones(12), (design["group"] == 1).astype(float), design["age"], (design["sex"] == "b").astype(float)], 1)
    for r in compare.with_covariates(cells, s, (1, 2), ["age", "sex"]).collect():
        y = logs[r["row_id"]]
        ok = ~np.isnan(y)
        w = np.linalg.lstsq(x[ok], y[ok], rcond=None)[0]
        if r["effect"] is not None:
            assert abs(r["effect"] - w[1]) < 1e-7 and 0 <= r["p"] <= 1
    with pytest.raises(ValueError):
        compare.with_covariates(cells, s, (1, 2), ["none"])


def brute_corrected(p, how):
    m, order = len(p), np.argsort(p, kind="stable")
    s, k = p[order], np.arange(1, len(p) + 1)
    bh = np.minimum.accumulate((s * m / k)[::-1])[::-1].clip(max=1)
    out = {
        "bonferroni": (s * m).clip(max=1), "sidak": 1 - (1 - s) ** m, "holm": np.maximum.accumulate(s * (m - k + 1)).clip(max=1), "holm-sidak": np.maximum.accumulate(1 - (1 - s) ** (m - k + 1)),
        "simes-hochberg": np.minimum.accumulate((s * (m - k + 1))[::-1])[::-1].clip(max=1), "fdr_bh": bh, "fdr_by": np.minimum.accumulate((s * m / k * (1 / k).sum())[::-1])[::-1].clip(max=1),
    }
    r = (bh <= 0.05).sum()
    out["fdr_tsbh"] = bh if r in (0, m) else (bh * (m - r) / m).clip(max=1)
    back = np.empty(m)
    back[order] = out[how]
    return back


@pytest.mark.parametrize("how", [c for c in compare.CORRECTIONS if c != "fdr_tsbky"])
def test_corrections(spark, how):
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.uniform(0, 1, 60), rng.uniform(0, 1e-4, 20), [0.5, 0.5]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)] + [(500, None)], "row_id long, p double")
    got = {r["row_id"]: r["corrected"] for r in compare.correct_p(df, how).collect()}
    assert got.pop(500) is None and np.allclose([got[i] for i in range(len(p))], brute_corrected(p, how), rtol=1e-8)


def test_running_sums_over_many_ranges(spark):
    rng = random.Random(5)
    rows = [(i, float(rng.choice([0, 1, 1, 1, 2, rng.random() * 9]))) for i in range(3000)]
    got = decoys.running(spark.createDataFrame(rows, "row_id long, x double").repartition(5), [("x", False), ("row_id", True)], {"n": F.lit(1).cast("long")}, parts=7)
    want = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r["row_id"]: r["n"] for r in got.collect()} == want


def test_decoys_keep_the_margins(spark, noisy):
    cells = cells_of(spark, noisy)
    got = dense(decoys.decoy_shuffle(cells), noisy.shape)
    assert np.allclose(np.sort(got, 1), np.sort(noisy, 1), equal_nan=True) and not np.allclose(got, noisy, equal_nan=True)
    features = spark.createDataFrame([(i, f"P{i}") for i in range(40)], "row_id long, Protein string")
    both, rows = decoys.append(cells, features)
    assert rows.count() == 80 and rows.where("Decoy = 1").count() == 40 and both.select("row_id").distinct().count() == 80
    with pytest.raises(ValueError):
        decoys.append(cells, features, "other")


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 6))
    x[rng.random(x.shape) < 0.2] = np.nan
    features = spark.createDataFrame([(i,) for i in range(30)], "row_id long")
    for weights in ("distance", "uniform"):
        got = dense(impute.knn(impute.grid(cells_of(spark, x), features, samples_of(spark, 6)), 3, weights, donors_per_block=7), x.shape)
        for i, j in zip(*np.where(np.isnan(x)), strict=True):
            d = [(math.sqrt(np.nansum((x[i] - x[k]) ** 2) * 6 / (~np.isnan(x[i] - x[k])).sum()), k) for k in range(30) if k != i and not np.isnan(x[k, j]) and (~np.isnan(x[i] - x[k])).any()]
            best = sorted(d)[:3]
            w = [1 / a if weights == "distance" else 1 for a, _ in best]
            assert abs(got[i, j] - sum(a * x[k, j] for a, (_, k) in zip(w, best, strict=True)) / sum(w)) < 1e-9


def test_knn_of_copies_far_from_zero_copies_no_donors(spark):
    """Values whose squares would hide their differences, rows without values, and copies that ask and give at once."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(25, 5)) * 1e-4 + 1e6
    x[rng.random(x.shape) < 0.25] = np.nan
    x[3] = np.nan
    x = np.concatenate([x, x, x, x])
    features = spark.createDataFrame([(i,) for i in range(len(x))], "row_id long")
    out = impute.knn(impute.grid(cells_of(spark, x), features, samples_of(spark, 5)), 3, donors_per_block=16)
    got = dense(out, x.shape)
    for i, j in zip(*np.where(np.isnan(x)), strict=True):
        d = [(math.sqrt(np.nansum((x[i] - x[k]) ** 2) * 5 / (~np.isnan(x[i] - x[k])).sum()), k) for k in range(len(x)) if not np.isnan(x[k, j]) and (~np.isnan(x[i] - x[k])).any()]
        best = sorted(d)[:3]
        zero = [x[k, j] for a, k in best if a == 0]
        want = np.nanmean(x[:, j]) if not best else np.mean(zero) if zero else sum(x[k, j] / a for a, k in best) / sum(1 / a for a, _ in best)
        assert abs(got[i, j] - want) < 2e-8
    # a block of donors is read where it is met and not copied for each block of rows
    ends = [impute.Nearest(np.arange(4), np.array([[0.0, np.nan]] * 4), 2) for _ in range(2)]
    far, close = np.array([[9.0, 1.0], [8.0, 2.0]]), np.array([[1.0, 5.0], [-1.0, 6.0]])
    for e, turns in zip(ends, ((far, close), (close, far)), strict=True):
        for ids, y in ((np.array([7, 8]), y) if y is close else (np.array([5, 6]), y) for y in turns):
            e.meet(ids, y)
    assert all(e.donor.tolist() == [[7, 8]] * 4 and e.value.tolist() == [[5.0, 6.0]] * 4 for e in ends)


def test_knn_of_copies_meets_each_kind_of_row_once(spark):
    """A donor stands for its copies: of equal distances the smallest rows count, whatever the donors' leaves and blocks."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 5)).round(1)  # many equal distances
    x[rng.random(x.shape) < 0.15] = np.nan
    x[::90] *= 1e25  # far off by themselves
    x = x[~np.isnan(x).all(1)]
    n = rng.integers(1, 4, len(x))
    every = rng.permutation(n.sum())
    ids = np.full((len(x), 3), -1)
    for i, e in enumerate(np.split(every, np.cumsum(n)[:-1])):
        ids[i, : n[i]] = sorted(e)
    rows = np.flatnonzero(np.isnan(x).any(1))[:60]
    e = impute.Nearest(ids[rows, 0], x[rows], 3)
    for part in (slice(300, None), slice(0, 300)):
        e.meet(ids[part], x[part], n[part])
    got = {(r["row_id"], r["s"]): [(g["d"], g["donor"], g["x"]) for g in r["near"]] for r in e.found(pa.int64()).to_pylist()}
    want = {}
    for i, s in zip(*np.where(np.isnan(x[rows])), strict=True):
        a = x[rows[i]]
        both = ~np.isnan(a - x)
        has = both.any(1) & ~np.isnan(x[:, s])
        d = np.sqrt((np.where(both, a - x, 0) ** 2).sum(1) * 5 / np.maximum(both.sum(1), 1))
        want[ids[rows[i], 0], s] = sorted((d[k], donor, x[k, s]) for k in np.flatnonzero(has) for donor in ids[k, : n[k]])[:3]
    assert got == {k: v for k, v in want.items() if v}


def test_clusters_of_copies(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(4, 20))
    x = np.concatenate([base + rng.normal(scale=0.05, size=base.shape) for _ in range(5)])
    features = spark.createDataFrame([(i,) for i in range(20)], "row_id long")
    cells = cells_of(spark, x)
    # at 0.3 each copy's group is a component of its own, at 0.8 components hold several groups
    for height in (0.8, 0.3):
        labels = {r["row_id"]: r["FeatureCluster"] for r in cluster.ward(cells, features, height, 5).collect()}
        assert len(set(labels.values())) == 4 and all(labels[i] == labels[i % 4] for i in range(20))
    assert [labels[i] for i in range(4)] == [1, 2, 3, 4]
    assert len({r["FeatureCluster"] for r in cluster.ward(cells, features, None).collect()}) == 20


def brute_ward(x, height):
    """One merge after another over the whole matrix of distances, by the recurrence of Lance and Williams."""
    rank = np.array([[np.mean([k for k, v in enumerate(sorted(row)) if v == value]) for value in row] for row in x])
    rank = rank - rank.mean(1, keepdims=True)
    norm = np.sqrt((rank**2).sum(1, keepdims=True))
    v = np.divide(rank, norm, out=np.zeros_like(rank), where=norm > 0)
    d = {(i, j): float((1 - min(1, abs(v[i] @ v[j]))) ** 2) for i in range(len(x)) for j in range(i + 1, len(x))}
    size, to = dict.fromkeys(range(len(x)), 1), list(range(len(x)))
    while d:
        h, a, b = min((round(h, 12), a, b) for (a, b), h in d.items())
        if h > round(height**2, 12):
            break
        for c in size:
            if c not in (a, b):
                ka, kb = (min(a, c), max(a, c)), (min(b, c), max(b, c))
                d[ka] = ((size[a] + size[c]) * d[ka] + (size[b] + size[c]) * d.pop(kb) - size[c] * d[a, b]) / (size[a] + size[b] + size[c])
        del d[a, b]
        size[a] += size.pop(b)
        to = [a if t == b else t for t in to]
    return to


@pytest.mark.parametrize("seed, heights", [(0, (0.0, 0.6)), (1, (0.25, 1.7)), (2, (0.8, 1.0))])
def test_ward_equals_merging_one_by_one(spark, seed, heights):
    """Random features with few samples, so many ties, with copies, reversed copies and constant features among them."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(45, 5 + 2 * seed)) if seed else rng.integers(0, 3, size=(45, 6)).astype(float)
    x[5], x[6], x[7], x[8] = x[1] * 2, -x[1], 3.0, 3.0
    x[20:26] = x[2] + rng.normal(scale=0.3, size=(6, x.shape[1]))
    features = spark.createDataFrame([(i,) for i in range(45)], "row_id long")
    cells = cut_of(cells_of(spark, x))
    for height in heights:
        got = {r["row_id"]: r["FeatureCluster"] for r in cluster.ward(cells, features, height, 6).collect()}
        want = brute_ward(x, height)
        number = {c: k for k, c in enumerate(sorted(set(want)), 1)}
        assert [got[i] for i in range(45)] == [number[c] for c in want], height


def cut_of(df):
    from quantloom.functions.storage import cut

    return cut(df)


def test_features_that_lack_values_are_refused(spark, noisy):
    x = np.where(np.isnan(noisy), 5.0, noisy)
    x[0, 0] = x[1, 1] = np.nan
    for f in (cluster.nearest, cluster.spearman):
        with pytest.raises(ValueError, match="2 features lack values"):
            f(cells_of(spark, x))
    features = spark.createDataFrame([(i, f"P{i}") for i in range(len(x))], "row_id long, Protein string")
    m = Matrix(cells_of(spark, x), features, samples_of(spark, x.shape[1]))
    with pytest.raises(ValueError, match="lack values"):
        m.cluster()
    assert m.impute("constant").cluster(q_value=0.5).features.count() == len(x)


def test_blocks_that_cannot_hold_a_nearer_feature_are_not_met(spark):
    """Groups far apart: few of all pairs are met, and the result is that of all pairs."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(8, 60))
    x = np.concatenate([b + rng.normal(scale=0.1, size=(40, 60)) for b in base])
    cells = cut_of(cells_of(spark, x))
    d = 1 - np.abs(np.corrcoef(np.argsort(np.argsort(x, 1), 1)))
    np.fill_diagonal(d, np.inf)
    near = {r["row_id"]: r["distance"] for r in cluster.nearest(cells, 20).collect()}
    assert all(abs(near[i] - d[i].min()) < 1e-9 for i in range(320))
    assert {(r["a"], r["b"]) for r in cluster.spearman(cells, 0.2, 20).collect()} == {(i, j) for i in range(320) for j in range(i + 1, 320) if d[i, j] <= 0.2}
    index = cluster.Index(cluster.vectors(cells), 20)
    first = cut_of(cluster._nearest_in(index, index.visits(index.placed, "own")))
    met = index.met(index.visits(index.placed, "own")) + index.met(index.visits(cluster._reaching(index, first), "other"))
    assert met < 0.35 * 320 * 320
    rows = index.placed.withColumn("reach", cluster.angle_of(0.2))
    assert index.met(index.visits(rows, "own")) + index.met(index.visits(rows, "later")) < 0.25 * 320 * 320


def test_distances_by_blocks(spark):
    """Whatever the blocks' size: all pairs, those within a distance, and the nearest."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(23, 9))
    cells, rank = cells_of(spark, x), np.argsort(np.argsort(x, 1), 1)
    d = 1 - np.abs(np.corrcoef(rank))
    for rows in (4, 100):
        got = {(r["a"], r["b"]): r["distance"] for r in cluster.spearman(cells, rows=rows).collect()}
        assert set(got) == {(i, j) for i in range(23) for j in range(i + 1, 23)} and all(abs(v - d[k]) < 1e-9 for k, v in got.items())
        some = {(r["a"], r["b"]) for r in cluster.spearman(cells, 0.6, rows).collect()}
        assert some == {k for k, v in got.items() if v <= 0.6}
        near = {r["row_id"]: r["distance"] for r in cluster.nearest(cells, rows).collect()}
        assert all(abs(near[i] - np.delete(d[i], i).min()) < 1e-9 for i in range(23))


def test_level_pools_the_features_of_one_name(spark, noisy):
    """All values of a name are one test, as if its features' samples stood side by side."""
    logs = np.log2(noisy)
    features = spark.createDataFrame([(i, f"P{i // 4}") for i in range(40)], "row_id long, Protein string")
    m = Matrix(cells_of(spark, logs), features, samples_of(spark, 12))
    rows = {r["row_id"]: r for r in m.compare((1, 2), level="protein").features.collect()}
    for i in range(40):
        r = rows[i]
        if i % 4:
            assert r["PValue1-2"] is None and r["Group1RepCounts"] is None
            continue
        a, b = logs[i : i + 4, :6].ravel(), logs[i : i + 4, 6:].ravel()
        a, b = a[~np.isnan(a)], b[~np.isnan(b)]
        assert (r["Group1RepCounts"], r["Group2RepCounts"]) == (len(a), len(b)) and abs(r["Log2FoldChange1-2"] - (a.mean() - b.mean())) < 1e-9
        t = (a.mean() - b.mean()) / math.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2) * (1 / len(a) + 1 / len(b)))
        want = spark.range(1).select(t_pvalue(F.lit(float(t)), F.lit(len(a) + len(b) - 2))).first()[0]
        assert abs(r["PValue1-2"] - want) < 1e-9
    with pytest.raises(ValueError):
        m.compare((1, 2), level="precursor")


def test_score_distributions(spark):
    """q-values on the grid of automatic bins, against NumPy."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(3, 1, 300), rng.normal(0, 1, 200)])
    y = np.array([0] * 300 + [1] * 200)
    df = spark.createDataFrame([(i, float(v), int(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))] + [(999, None, 0)], "row_id long, score double, Decoy int")
    edges = np.histogram_bin_edges(x, "auto")
    assert decoys.automatic_bins(df) == len(edges) - 1
    mid = (edges[1:] + edges[:-1]) / 2
    t, d = (np.histogram(x[y == c], mid)[0] for c in (0, 1))
    centre = (mid[1:] + mid[:-1]) / 2
    for r in decoys.qvalue_of_scores(df, pit=0.7).collect():
        if r["score"] is None:
            assert r["q_value"] is None
            continue
        grid = np.arange(r["score"], x.max(), 0.1)
        a, b = np.trapezoid(np.interp(grid, centre, t)), np.trapezoid(np.interp(grid, centre, d)) * 0.7
        assert abs(r["q_value"] - (0.0 if a == b == 0 else b / (a + b))) < 1e-6


def test_score_distributions_take_the_fewer_of_steps_and_knots(spark):
    """No expression holds an entry a bin, and both ways give the trapezoids."""
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.pow(F.col("id") / 3000, F.lit(6.0)).alias("score"), (F.col("id") % 3).cast("int").alias("Decoy"))
    assert decoys.automatic_bins(df) > 30
    assert "aggregate(" not in decoys.qvalue_of_scores(df)._jdf.queryExecution().toString()
    knots, values, v = np.linspace(0, 1, 9), np.random.default_rng(5).random(9), np.array([-0.3, 0.05, 0.62, 1.0])
    for step in (0.3, 0.01):
        n = np.ceil((1.0 - v) / step).astype(int)
        want = [np.trapezoid(np.interp(a + step * np.arange(k), knots, values), dx=step) if k > 1 else 0.0 for a, k in zip(v, n, strict=True)]
        assert np.allclose(decoys._stepped_area(v, n, knots, values, step), want)


def test_vectors_without_a_row_for_each_missing_cell(spark):
    """Missing cells, null values and samples without cells are zeros; a sample's values meet once."""
    cells = spark.createDataFrame([(3, "a", 1.0), (1, "a", 2.0), (2, "b", None), (10, "b", 4.0), (5, "x", 9.0)], "row_id long, sample string, value double")
    samples = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "sample string, group int")
    rows = learn.to_ml(cells, samples)
    assert {r["sample"]: (r["label"], list(r["features"].toArray())) for r in rows.collect()} == {"a": (0.0, [2.0, 0.0, 1.0, 0.0]), "b": (1.0, [0.0, 0.0, 0.0, 4.0]), "c": (1.0, [0.0] * 4)}
    assert learn.to_ml(cells.where("sample = 'x'"), samples).isEmpty()
    assert "LeftOuter, ((row_id" not in rows._jdf.queryExecution().optimizedPlan().toString()


def learnable(spark, n=60, f=6):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(f, n))
    groups = [1 if j < n // 2 else 2 for j in range(n)]
    x[1, n // 2 :] += 3
    return Matrix(cells_of(spark, x), spark.createDataFrame([(10 * i, f"P{i}") for i in range(f)], "row_id long, Protein string"), samples_of(spark, n, groups)), x


def test_importances_of_the_users_classifier(spark):
    """The feature that tells the groups apart comes first with a linear model, a tree and a bootstrap of either."""
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from quantloom.operators import learn

    m, x = learnable(spark)
    m = Matrix(m.cells.withColumn("row_id", F.col("row_id") * 10), m.features, m.samples)  # row_ids aren't places
    for clf in (LogisticRegression(maxIter=20, regParam=0.1), DecisionTreeClassifier(maxDepth=2)):
        out = m.interpret(m.train(clf, validate=False).model).features.collect()
        assert max(out, key=lambda r: r["Importance"])["Protein"] == "P1" and all(r["Importance"] >= 0 for r in out)
        told = m.explain(clf, (1, 2), n_iterations=3).features.orderBy("row_id").collect()
        assert told[1]["MeanRank1-2"] == 1 and told[1]["MeanImportance1-2"] == 1.0 and all(r["StdevRank1-2"] is not None for r in told)
        rfe = learn.bootstrap_rfe(m.to_ml((1, 2)), 2, 1, 2, classifier=clf)
        ranks = {r["k"]: r["mean_rank"] for r in learn.rfe_ranks(rfe).collect()}
        assert len(ranks) == 6 and min(ranks, key=ranks.get) == 1
    rows = m.to_ml((1, 2))
    kept = learn.kept_features(rows, spark.createDataFrame([(1,), (4,)], "k int"))
    for a, b in zip(rows.orderBy("sample").collect(), kept.orderBy("sample").collect(), strict=True):
        assert a["features"].toArray()[[1, 4]].tolist() == b["features"].toArray().tolist()


def test_local_importance_of_any_model_equals_the_linear_one(spark):
    """What a linear model's weights give is what scoring the shuffled rows gives."""
    from pyspark.ml.classification import LogisticRegression
    from quantloom.operators import learn

    m, _ = learnable(spark, 20, 3)
    rows = m.to_ml((1, 2))
    model = LogisticRegression(maxIter=10, regParam=0.1).fit(rows)
    fast = {(r["k"], r["sample"]): r["value"] for r in learn.local_importance(rows, model, 2).collect()}

    class Wrapped:  # hides what it is
        transform = staticmethod(model.transform)

    slow = {(r["k"], r["sample"]): r["value"] for r in learn.local_importance(rows, Wrapped(), 2).collect()}
    assert len(fast) == 60 and all(abs(v - slow[k]) < 1e-9 for k, v in fast.items())


def test_enrichment_tail(spark):
    rows = [(x, n, k, d) for n, k, d in ((50, 10, 12), (20, 20, 5), (500, 30, 40)) for x in range(1, min(k, d) + 1)]
    got = spark.createDataFrame(rows, "x long, n long, k long, d long").select("*", annotate.upper_tail(F.col("x"), F.col("n"), F.col("k"), F.col("d")).alias("p")).collect()
    for r in got:
        want = sum(math.comb(r.k, j) * math.comb(r.n - r.k, r.d - j) for j in range(r.x, min(r.k, r.d) + 1) if r.d - j <= r.n - r.k) / math.comb(r.n, r.d)
        assert abs(r.p - want) < 1e-9 or (r.d - r.x > r.n - r.k and r.p == 0), r


def test_long_reports(spark):
    names = ["Run", "Protein.Ids", "Precursor.Id", "Modified.Sequence", "Precursor.Charge", "RT", "Precursor.Quantity", "Q.Value", "Lib.Q.Value", "Lib.PG.Q.Value"]
    rows = [("a.x.raw", "P", "k1", "K", 2, 1.0, 5.0, 0.5, 0.001, 0.0), ("b.raw", "P", "k1", "K", 2, 3.0, 0.0, 0.5, 0.001, 0.0), ("b.raw", "P", "k2", "K", 2, 3.0, 7.0, 0.001, 0.5, 0.0)]
    df = spark.createDataFrame(rows, names)
    got = sorted(map(tuple, diann.scan_diann(df).select("PrecursorId", "sample", "value", "RetentionTime", "PeptideQValue").collect()), key=str)
    assert got == [("k1", "a", 5.0, 2.0, 0.001), ("k1", "b", None, 2.0, 0.001)]
    assert diann.pick_columns(df.drop("Lib.PG.Q.Value")).select("ProteinQValue").distinct().collect()[0][0] == 0.0
    with pytest.raises(Exception, match="twice"):
        diann.scan_diann(df.union(df)).collect()
    cells, features = diann.to_matrix(diann.scan_diann(df))
    assert features.count() == 1 and cells.count() == 2
    more = [("a.raw", "P", f"k{k}", "K", 2, float(9 - k), 5.0 + k, 0.5, 0.001, 0.0) for k in range(5)] + [("b.raw", "P", "k3", "K", 2, 6.0, 1.0, 0.5, 0.001, None)]
    design = spark.createDataFrame([("a", 1), ("b", 2)], "Sample string, Group int")
    m = Matrix.read(spark, spark.createDataFrame(more, names), design, quant_type="diann")
    rows = m.features.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(6)) and [r["PrecursorId"] for r in rows] == ["k4", "k3", "k3", "k2", "k1", "k0"]
    assert m.cells.count() == 6
    for method in ("mean", "shuffle"):
        both = m.append(method)
        assert both.features.count() == 12 and sorted(r[0] for r in both.features.select("row_id").collect()) == list(range(12)) and both.cells.count() == 12


def test_filters_and_dispatch(spark):
    features = spark.createDataFrame([(0, "A", 0.001, 0.001, 0), (1, "B;C", 0.001, 0.001, 0), (2, "contam_A", 0.001, 0.001, 0), (3, "D", 0.5, 0.001, 0), (4, "E", 0.001, 0.001, 1), (5, "F", 0.001, 0.001, 0)], "row_id long, Protein string, PeptideQValue double, ProteinQValue double, Decoy int")
    x = np.ones((6, 4))
    x[5] = [0, np.nan, 0, np.nan]
    m = Matrix(cells_of(spark, x), features, samples_of(spark, 4))
    kept = lambda **kw: sorted(r["row_id"] for r in m.filter(**kw).features.collect())
    assert kept() == [0] and kept(compat=True) == [0, 3] and kept(remove_zero_rows=False) == [0, 5]
    # both filters hold: a feature of zeros only goes, however many zeros are allowed
    assert kept(remove_n_zero_rows=True, max_n_zeros=4) == [0] and kept(remove_n_zero_rows=True, max_n_zeros=4, remove_zero_rows=False) == [0, 5]
    for call in (lambda: m.filter(remove_n_zero_rows=True), lambda: m.scale("x"), lambda: m.quantify("x"), lambda: m.impute("x"), lambda: m.correct("x"), lambda: m.correct("mean", 9), lambda: m.compare((1, 2), method="x"), lambda: m.compare((1, 2), multiple_testing_correction_method="x"), lambda: annotate.select_genes(features)):
        with pytest.raises(ValueError):
            call()


def test_probabilities_by_constant_work_keep_their_digits(spark):
    """Against exact fractions, at small and at large numbers."""
    from fractions import Fraction

    from quantloom.functions.stats import harmonic, ln_binomial

    cases = [(x, n, p) for n in (1, 2, 5, 15, 16, 17, 40, 300, 2000) for x in {0, 1, n // 3, n // 2, n - 1, n} for p in (0.01, 0.3, 0.5, 0.97) if 0 <= x <= n]
    got = spark.createDataFrame(cases, "x long, n long, p double").select("*", ln_binomial(F.col("x"), F.col("n"), F.col("p")).alias("l")).collect()
    for r in got:
        f = Fraction(r["p"])
        want = Fraction(math.comb(r["n"], r["x"])) * f ** r["x"] * (1 - f) ** (r["n"] - r["x"])
        log = math.log(want.numerator) - math.log(want.denominator)
        assert abs(r["l"] - log) < 1e-12 * max(1, abs(log)), r
    rows = [(m, r["h"]) for m, r in ((r["m"], r) for r in spark.createDataFrame([(m,) for m in (0, 1, 2, 3, 7, 50, 100000)], "m long").select("m", harmonic(F.col("m")).alias("h")).collect())]
    assert all(abs(h - math.fsum(1 / i for i in range(1, m + 1))) < 1e-13 for m, h in rows)
    big = [(3, 10**9, 5, 10**6), (40, 10**6, 5000, 8000), (0, 50, 10, 7), (7, 50, 10, 7), (8, 50, 10, 7), (300, 10**5, 90_000, 400), (200, 10**5, 90_000, 400), (3, 8, 8, 3)]
    got = spark.createDataFrame(big, "x long, n long, k long, d long").select("*", annotate.upper_tail(F.col("x"), F.col("n"), F.col("k"), F.col("d")).alias("p")).collect()
    for r in got:
        x, n, k, d = r["x"], r["n"], r["k"], r["d"]
        low, t = max(0, k + d - n), Fraction(1)
        terms = {low: Fraction(1)}
        for j in range(low, min(k, d)):
            t = t * (k - j) * (d - j) / ((j + 1) * (n - k - d + j + 1))
            if j + 1 > low + 600 and t < Fraction(1, 10**60):
                break
            terms[j + 1] = t
        want = sum(v for j, v in terms.items() if j >= x) / sum(terms.values())
        assert abs(r["p"] - float(want)) <= 1e-10 * float(want), (tuple(r), float(want))


def test_maps_of_terms_with_a_hot_gene(spark):
    """Whatever the chunks, and with a threshold: the pairs that a plain program finds."""
    rng = random.Random(8)
    sets = {f"T{t:03d}": {"hot"} | {f"g{rng.randrange(60)}" for _ in range(rng.randrange(1, 12))} for t in range(120)}
    sets |= {f"U{t}": set(sets[f"T{t:03d}"]) for t in range(10)}
    df = spark.createDataFrame([(t, g) for t, gs in sets.items() for g in gs for _ in range(2)], "term string, gene string")
    names = sorted(sets)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(names) for b in names[i + 1 :] if sets[a] & sets[b]}
    for chunk in (7, 500):
        got = annotate.enrichment_map(df, chunk=chunk).collect()
        assert len(got) == len(want) and all(abs(r["jaccard"] - want[r["a"], r["b"]]) < 1e-12 and r["common"] == len(sets[r["a"]] & sets[r["b"]]) for r in got)
    for least in (0.3, 0.5, 1.0):
        got = {(r["a"], r["b"]) for r in annotate.enrichment_map(df, at_least=least, chunk=7).collect()}
        assert got == {k for k, v in want.items() if v >= least - 1e-12}


def test_blocks_of_long_vectors_hold_fewer_and_visits_carry_none(spark, monkeypatch):
    monkeypatch.setattr(cluster, "NUMBERS", 60)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 12))
    index = cluster.Index(cluster.vectors(cells_of(spark, x)))
    assert index.rows == 5
    rows = index.placed.withColumn("reach", F.lit(math.pi))
    assert index.visits(rows, "own").columns == index.visits(rows, "later").columns == ["row_id", "block"]
    got = {(r["a"], r["b"]): r["distance"] for r in cluster.spearman(cells_of(spark, x)).collect()}
    want = 1 - np.abs(np.corrcoef(np.argsort(np.argsort(x, 1), 1)))
    assert len(got) == 190 and all(abs(want[k] - d) < 1e-9 for k, d in got.items())
