"""Tests of differences between two groups of samples, and corrections for many tests.

One conditional aggregate per feature gives all moments; the p-value is a closed form of them. Several comparisons
are aggregated in the same pass. Zeros count as missing here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import harmonic, t_pvalue
from ..functions.storage import cut
from .quantify import level_column

CORRECTIONS = ("bonferroni", "sidak", "holm", "holm-sidak", "simes-hochberg", "fdr_bh", "fdr_by", "fdr_tsbh", "fdr_tsbky")


def _v() -> F.Column:
    return F.nullif(F.col("value"), F.lit(0.0))


def pooled(cells: DataFrame, features: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(cells, members): the cells of all features with one value of `column` under the first of their row_ids, with
    `part`, the feature they come from; and (row_id, members), how many features that are."""
    named = features.where(F.col(f"`{column}`").isNotNull()).select("row_id", F.col(f"`{column}`").alias("__key"))
    first = named.groupBy("__key").agg(F.min("row_id").alias("first"), F.count("*").alias("members"))
    rows = named.join(first, "__key").select(F.col("row_id").alias("part"), "first")
    out = cells.withColumnRenamed("row_id", "part").join(rows, "part").select(F.col("first").alias("row_id"), "part", "sample", "value")
    return out, first.select(F.col("first").alias("row_id"), "members")


def group_stats(cells: DataFrame, samples: DataFrame, comparison: tuple, min_samples: int = 2, members: DataFrame | None = None) -> DataFrame:
    """(row_id, n_a, n_b, mean_a, mean_b, sd_a, sd_b, log2_fc): deviations by n; with too few values in a group there is
    no fold change, and the other group's mean and deviation are given only if all its samples have values. members:
    how many features stand under a row_id, where cells are pooled."""
    a, b = (F.lit(g) for g in comparison)
    size = samples.agg(F.count(F.when(F.col("group") == a, 1)).alias("size_a"), F.count(F.when(F.col("group") == b, 1)).alias("size_b"))
    rows = cells.join(F.broadcast(samples.select("sample", "group").where((F.col("group") == a) | (F.col("group") == b))), "sample")
    in_a, in_b = F.when(F.col("group") == a, _v()), F.when(F.col("group") == b, _v())
    stats = rows.groupBy("row_id").agg(F.count(in_a).alias("n_a"), F.count(in_b).alias("n_b"), F.avg(in_a).alias("mean_a"), F.avg(in_b).alias("mean_b"), F.stddev_pop(in_a).alias("sd_a"), F.stddev_pop(in_b).alias("sd_b")).crossJoin(F.broadcast(size))
    if members is not None:
        stats = stats.join(members, "row_id").withColumns({c: F.col(c) * F.col("members") for c in ("size_a", "size_b")}).drop("members")
    enough = (F.col("n_a") >= min_samples) & (F.col("n_b") >= min_samples)
    given = lambda c, n, s: F.when(enough | (F.col(n) == F.col(s)), F.col(c))
    own = lambda c, n, s: F.when(F.col(n) < min_samples, F.lit(None).cast("double")).otherwise(given(c, n, s)).alias(c)
    fc = F.when(enough, F.col("mean_a") - F.col("mean_b")).alias("log2_fc")
    return stats.select("row_id", "n_a", "n_b", own("mean_a", "n_a", "size_a"), own("mean_b", "n_b", "size_b"), own("sd_a", "n_a", "size_a"), own("sd_b", "n_b", "size_b"), fc)


def ttest(stats: DataFrame) -> DataFrame:
    """stats with p: the equal-variance t test, whose p-value is also that of one-way ANOVA on two groups (F = t^2) and
    of the slope of a regression on the group."""
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    pooled = (na * F.col("sd_a") ** 2 + nb * F.col("sd_b") ** 2) / (na + nb - 2)
    t = F.try_divide(F.col("log2_fc"), F.sqrt(F.nullif(pooled, F.lit(0.0)) * (1 / na + 1 / nb)))
    return stats.withColumn("p", F.when(F.col("log2_fc").isNotNull(), t_pvalue(t, F.col("n_a") + F.col("n_b") - 2)))


def paired(cells: DataFrame, samples: DataFrame, comparison: tuple, min_samples: int = 2) -> DataFrame:
    """(row_id, n_pairs, mean_difference, p): partners by the design's pair; incomplete pairs don't count."""
    mates = samples.where(F.col("group") == F.lit(comparison[0])).select("sample", F.col("pair").cast(samples.schema["sample"].dataType).alias("mate"))
    rows = ["row_id", *[c for c in ("part",) if c in cells.columns]]
    one = cells.join(F.broadcast(mates), "sample").select(*rows, F.col("mate").alias("pair"), _v().alias("x"))
    two = cells.join(F.broadcast(mates.select(F.col("mate").alias("sample"))), "sample").select(*rows, F.col("sample").alias("pair"), _v().alias("y"))
    d = one.unionByName(two, allowMissingColumns=True).groupBy(*rows, "pair").agg((F.first("x", True) - F.first("y", True)).alias("d"))
    out = d.groupBy("row_id").agg(F.count("d").alias("n_pairs"), F.avg("d").alias("mean_difference"), F.stddev_samp("d").alias("sd"))
    t = F.try_divide(F.col("mean_difference"), F.nullif(F.col("sd"), F.lit(0.0)) / F.sqrt(F.col("n_pairs")))
    return out.select("row_id", "n_pairs", "mean_difference", F.when(F.col("n_pairs") >= min_samples, t_pvalue(t, F.col("n_pairs") - 1)).alias("p"))


def with_covariates(cells: DataFrame, samples: DataFrame, comparison: tuple, covariates: list[str], min_samples: int = 2) -> DataFrame:
    """(row_id, n, effect, p) of the group's slope in a regression with covariates; text covariates are coded by level.

    The design (one row per sample) is coded on the driver; X'X and X'y are sums over a feature's samples, and each
    task solves its features' small systems.
    """
    import numpy as np
    import pandas as pd

    for c in covariates:
        if c not in samples.columns:
            raise ValueError(f"the design has no covariate {c!r}")
    design = samples.where(F.col("group").isin(list(comparison))).select("sample", "group", *covariates).orderBy("sample").toPandas()
    columns = [np.ones(len(design)), (design["group"] == comparison[0]).to_numpy(float)]
    for c in covariates:
        if design[c].map(lambda x: isinstance(x, str)).any():
            levels = sorted(design[c].dropna().unique())
            columns += [(design[c] == x).to_numpy(float) for x in levels[1:]]
        else:
            columns.append(design[c].to_numpy(float))
    x = np.stack(columns, 1)
    coded = cells.sparkSession.createDataFrame(pd.DataFrame({"sample": design["sample"], "x": [list(map(float, r)) for r in x]}))
    counts = design["group"].to_dict(), x.shape[1]
    rows = cells.where(_v().isNotNull()).join(F.broadcast(coded), "sample")
    k = counts[1]
    sums = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col("x")[i] * _v()).alias(f"b{i}") for i in range(k)]
    held = rows.groupBy("row_id").agg(F.count("*").alias("n"), F.sum(F.col("x")[1]).alias("n_a"), F.sum(_v() * _v()).alias("yy"), *sums)

    def solve(batches):
        for pdf in batches:
            a = np.zeros((len(pdf), k, k))
            for i in range(k):
                for j in range(i, k):
                    a[:, i, j] = a[:, j, i] = pdf[f"a{i}_{j}"]
            b = np.stack([pdf[f"b{i}"] for i in range(k)], 1)
            n, na = pdf["n"].to_numpy(), pdf["n_a"].to_numpy()
            ok = (na >= min_samples) & (n - na >= min_samples) & (n > k) & (np.linalg.matrix_rank(a) == k if len(a) else n > 0)
            effect, t = np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
            if ok.any():
                inv = np.linalg.inv(a[ok])
                w = np.einsum("nij,nj->ni", inv, b[ok])
                rest = np.maximum(pdf["yy"].to_numpy()[ok] - (w * b[ok]).sum(1), 0)
                effect[ok] = w[:, 1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    t[ok] = w[:, 1] / np.sqrt(rest / (n[ok] - k) * inv[:, 1, 1])
            yield pd.DataFrame({"row_id": pdf["row_id"], "n": n, "effect": pd.Series(effect).where(~np.isnan(effect), None), "t": pd.Series(t).where(np.isfinite(t), None)})

    kind = cells.schema["row_id"].dataType.simpleString()
    out = held.mapInPandas(solve, f"row_id {kind}, n long, effect double, t double")
    return out.select("row_id", "n", F.nanvl("effect", F.lit(None)).alias("effect"), t_pvalue(F.nanvl("t", F.lit(None)), F.col("n") - k).alias("p"))


def correct_p(tests: DataFrame, method: str = "fdr_tsbh", p: str = "p", tie: str = "row_id", out: str = "corrected", alpha: float = 0.05) -> DataFrame:
    """tests with the corrected p-value; null ones don't count and stay null.

    A rank counts the smaller p-values; running minima and maxima over ranges of p are closed over one row a range, so
    no task gets all tests.
    """
    from .decoys import running

    if method not in CORRECTIONS:
        raise ValueError(f"unknown correction {method!r}; known: {', '.join(CORRECTIONS)}")
    tests = cut(tests)  # one row a test, read by each step below
    valid, none = tests.where(F.col(p).isNotNull()), tests.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    m = F.col("__m")
    total = tests.agg(F.count(p).alias("__m"))
    x = F.col(p)
    if method in ("bonferroni", "sidak"):
        value = x * m if method == "bonferroni" else F.lit(1.0) - F.pow(F.lit(1.0) - x, m)
        return valid.crossJoin(F.broadcast(total)).withColumn(out, F.least(value, F.lit(1.0))).drop("__m").unionByName(none)
    ranked = running(valid, [(p, True), (tie, True)], {"__rank": F.lit(1).cast("long")}).crossJoin(F.broadcast(total))
    k = F.col("__rank")
    if method in ("holm", "holm-sidak"):
        own = x * (m - k + 1) if method == "holm" else F.lit(1.0) - F.pow(F.lit(1.0) - x, m - k + 1)
        return _closed(ranked.withColumn("__own", own), True, out, F.lit(1.0)).unionByName(none)
    if method == "simes-hochberg":
        return _closed(ranked.withColumn("__own", x * (m - k + 1)), False, out, F.lit(1.0)).unionByName(none)
    own = x * m / k
    if method == "fdr_by":
        ranked = ranked.crossJoin(F.broadcast(total.select(harmonic(m).alias("__h"))))
        return _closed(ranked.withColumn("__own", own * F.col("__h")), False, out, F.lit(1.0)).drop("__h").unionByName(none)
    bh = _closed(ranked.withColumn("__own", own), False, out, F.lit(1.0), keep="__m")
    if method in ("fdr_tsbh", "fdr_tsbky"):
        level = alpha if method == "fdr_tsbh" else alpha / (1 + alpha)
        found = bh.agg(F.count(F.when(F.col(out) <= level, 1)).alias("__r"))
        share = F.when((F.col("__r") == 0) | (F.col("__r") == m), F.lit(1.0)).otherwise((m - F.col("__r")) / m)
        widen = 1.0 if method == "fdr_tsbh" else 1 + alpha
        bh = bh.crossJoin(F.broadcast(found)).withColumn(out, F.least(F.col(out) * share * widen, F.lit(1.0))).drop("__r")
    return bh.drop("__m").unionByName(none)


def _closed(ranked: DataFrame, upwards: bool, out: str, most: F.Column, keep: str = "") -> DataFrame:
    """The running maximum of __own over growing ranks, or its running minimum over falling ones, at most `most`."""
    parts = max(2, int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = ranked.withColumn("__range", F.floor((F.col("__rank") - 1) * parts / F.col("__m")).cast("int"))
    best = F.max if upwards else F.min
    sign = (lambda c: F.col(c).asc()) if upwards else (lambda c: F.col(c).desc())
    totals = dealt.groupBy("__range").agg(best("__own").alias("__t"))
    starts = totals.select("__range", best("__t").over(Window.orderBy(sign("__range")).rowsBetween(Window.unboundedPreceding, -1)).alias("__b"))
    w = Window.partitionBy("__range").orderBy(sign("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(starts), "__range")
    run, before = best("__own").over(w), F.col("__b")
    value = (F.greatest if upwards else F.least)(run, F.coalesce(before, run))
    drop = [c for c in ("__range", "__own", "__rank", "__b", "__m") if c != keep]
    return joined.withColumn(out, F.least(value, most)).drop(*drop)


def score(tests: DataFrame, p: str = "p", fc: str = "log2_fc") -> DataFrame:
    """tests with de_score: the length of (-ln p, fold change), each over its largest absolute value; a p of zero has none."""
    top = tests.agg(F.max(-F.ln(p)).alias("__p"), F.max(F.abs(fc)).alias("__f"))
    return tests.crossJoin(F.broadcast(top)).withColumn("de_score", F.sqrt(F.try_divide(-F.ln(p), F.col("__p")) ** 2 + F.try_divide(F.col(fc), F.col("__f")) ** 2)).drop("__p", "__f")


def compare(cells: DataFrame, features: DataFrame, samples: DataFrame, comparisons: list[tuple] | tuple, method: str = "ttest", min_samples_per_group: int = 2, multiple_testing_correction_method: str = "fdr_tsbh", covariates: list[str] | None = None, level: str | None = None) -> DataFrame:
    """features with the columns of each comparison: DEScore, Log2FoldChange, PValue, CorrectedPValue and
    -Log10CorrectedPValue with the suffix a-b, and Mean, Stdev and RepCounts of each group. With a level all features of
    one value of its column are one test, whose results the first of them has; without, each feature is."""
    if method not in ("ttest", "ttest_paired", "anova", "linregress"):
        raise ValueError(f"unknown method {method!r}; known: ttest, ttest_paired, anova, linregress")
    pairs = [comparisons] if isinstance(comparisons, tuple) and not isinstance(comparisons[0], tuple) else list(comparisons)
    out, done, members = features, set(), None
    if level is not None:
        cells, members = pooled(cells, features, level_column(features, level))
    for a, b in pairs:
        tests = cut(ttest(group_stats(cells, samples, (a, b), min_samples_per_group, members)))
        if method == "ttest_paired" or covariates:
            other = paired(cells, samples, (a, b), min_samples_per_group) if method == "ttest_paired" else with_covariates(cells, samples, (a, b), covariates, min_samples_per_group)
            tests = tests.drop("p").join(other.select("row_id", "p"), "row_id", "left")
        done_tests = correct_p(score(tests), multiple_testing_correction_method)
        s = f"{a}-{b}"
        named = [F.col("de_score").alias(f"DEScore{s}"), F.col("log2_fc").alias(f"Log2FoldChange{s}"), F.col("p").alias(f"PValue{s}"), F.col("corrected").alias(f"CorrectedPValue{s}"), (-F.log10("corrected")).alias(f"-Log10CorrectedPValue{s}")]
        for g, x in ((a, "a"), (b, "b")):
            named += [] if g in done else [F.col(f"mean_{x}").alias(f"Group{g}Mean"), F.col(f"sd_{x}").alias(f"Group{g}Stdev"), F.col(f"n_{x}").alias(f"Group{g}RepCounts")]
            done.add(g)
        out = out.join(done_tests.select("row_id", *named), "row_id", "left")
    return out


def pr_curve(tests: DataFrame, positive: F.Column, p: str = "corrected", cutoffs: int = 9999) -> DataFrame:
    """(cutoff, recall, precision, fpr) at k / (cutoffs + 1): tests are counted by the first cutoff they pass, then
    the counts run over the cutoffs."""
    n = cutoffs + 1
    rows = tests.where(F.col(p).isNotNull()).select(F.ceil(F.col(p) * n).alias("k"), positive.cast("long").alias("y"))
    held = rows.groupBy("k").agg(F.sum("y").alias("tp"), F.sum(1 - F.col("y")).alias("fp"))
    every = tests.sparkSession.range(0, n + 1).withColumnRenamed("id", "k").join(held, "k", "left")
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # over the cutoffs
    run = every.select("k", F.sum(F.coalesce("tp", F.lit(0))).over(w).alias("tp"), F.sum(F.coalesce("fp", F.lit(0))).over(w).alias("fp"))
    total = rows.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    return run.where((F.col("k") >= 1) & (F.col("k") <= cutoffs)).crossJoin(F.broadcast(total)).select((F.col("k") / n).alias("cutoff"), F.try_divide("tp", "p").alias("recall"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("fp", "n").alias("fpr"))
