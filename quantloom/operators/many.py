"""Many logistic regressions over the same rows at once: all candidates, folds and resamples share each pass.

A row has an array of training weights and one of test weights, an entry for each weighting: a fold left out, a resample
(how often it drew the row). A step of Newton's method is one job: each task sums losses, gradients and second derivatives
of all fits over its rows, the sums are added up by fit, and each fit's next direction is worked out where its sums are.
Only coefficients and losses, as many as a model has, reach the driver. So the number of jobs is that of the steps,
whatever the number of fits. What is minimised is what MLlib's logistic regression minimises: the weighted mean of the
losses, and an elastic net over coefficients of features scaled to unit deviation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, TOLERANCE = 40, 1e-8


@dataclass(frozen=True)
class Fit:
    """A regression: which weighting it has, its penalty as in MLlib (regParam, elasticNetParam), and which features it
    sees (None: all)."""

    weighting: int
    reg: float = 0.0
    mix: float = 0.0
    features: tuple[int, ...] | None = None
    standardize: bool = True
    intercept: bool = True


def fit_of(classifier, weighting: int, features: tuple[int, ...] | None = None) -> Fit | None:
    """The fit that a logistic regression of two classes asks for; None for any other classifier."""
    if type(classifier) is not LogisticRegression or classifier.getFamily() == "multinomial" or classifier.getThreshold() != 0.5 or classifier.isSet("lowerBoundsOnCoefficients") or classifier.isSet("upperBoundsOnCoefficients"):
        return None
    return Fit(weighting, classifier.getRegParam(), classifier.getElasticNetParam(), features, classifier.getStandardization(), classifier.getFitIntercept())


def packed(rows: DataFrame, w: F.Column, t: F.Column, base: F.Column | None = None) -> DataFrame:
    """(label, x, w, t, b): rows with their training and test weights, of which those without either are left out. b is
    the weight of a row that is drawn once: a row of training weight w counts as w / b rows."""
    some = lambda c: F.exists(c, lambda v: v != 0)
    return rows.select("label", vector_to_array("features").alias("x"), w.alias("w"), t.alias("t"), (F.lit(1.0) if base is None else base).alias("b")).where(some("w") | some("t"))


def arrays(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    out = []
    for name in names:
        c = b.column(b.schema.get_field_index(name))
        flat = c.flatten().to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False)
        out.append(flat.astype(float).reshape(b.num_rows, -1) if pa.types.is_list(c.type) else flat.astype(float))
    return out


def added(rows: DataFrame, run) -> DataFrame:
    """(m, v): the sums by m of the vectors that `run` makes of batches of rows."""
    made = rows.mapInArrow(run, "m int, v array<double>")
    return made.groupBy("m").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))


def _sent(out: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([m for m, _ in out], pa.int32()), pa.array([v for _, v in out], pa.list_(pa.float64()))], ["m", "v"])


def descend(h: np.ndarray, g: np.ndarray, at: np.ndarray, l1: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """The direction that minimises the quadratic model and l1 * |coefficients|, by coordinates."""
    d, hd = np.zeros(len(g)), np.zeros(len(g))
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(g)):
            a, b, c = h[j, j], g[j] + hd[j], at[j] + d[j]
            new = np.sign(z := c - b / a) * max(abs(z) - l1[j] / a, 0.0) - c
            if new:
                d[j] += new
                hd += h[:, j] * new
                most = max(most, abs(new))
        if most < 1e-10:
            break
    return d


def gathered(rows: DataFrame, number: int, each: int = 2000) -> DataFrame:
    """rows, `number` of them, in no more partitions than hold `each` rows: a pass over few rows takes few tasks."""
    return rows.coalesce(max(1, -(-number // each)))


def moments_of(rows: DataFrame) -> tuple[int, dict[int, float], dict[int, np.ndarray]]:
    """(the number of features, each weighting's sum of weights, and its features' variances)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, w, one = arrays(b, "x", "w", "b")
                yield _sent([(k, np.concatenate([[v.sum(), v @ one], v @ x, v @ (x * x)])) for k in range(w.shape[1]) if (v := w[:, k]).any()])

    width, weight, spread = 0, {}, {}
    for k, v in added(rows.select("x", "w", "b"), moments).collect():  # a row a weighting
        v, width = np.array(v), len(v) // 2 - 1
        total, mean = v[0], v[2 : 2 + width] / v[0]
        weight[k], spread[k] = total, np.maximum(v[2 + width :] - total * mean**2, 0) / max(total - v[1] / total, 1e-300)
    if not weight and (first := rows.select(F.size("x").alias("f")).first()):
        width = first["f"]
    return width, weight, spread


def fit_many(rows: DataFrame, fits: list[Fit], steps: int = STEPS, start: np.ndarray | None = None, moments: tuple | None = None) -> np.ndarray:
    """Coefficients of each fit and, last, its intercept; features that a fit doesn't see have 0. rows are as `packed`
    has them, and should be kept. start: coefficients to begin at, of the same form; moments: what moments_of says of
    the rows, where it is known."""
    sc, n = rows.sparkSession.sparkContext, len(fits)
    width, weight, spread = moments or moments_of(rows)
    base = np.zeros((n, width + 1))
    if not width or not n:
        return base
    seen = [np.arange(width) if f.features is None else np.array(sorted(f.features), int) for f in fits]
    seen = [s[spread[f.weighting][s] > 1e-24] if f.weighting in weight else s[:0] for f, s in zip(fits, seen, strict=True)]
    ridge, lasso = [], []
    for f, s in zip(fits, seen, strict=True):
        scale = spread[f.weighting][s] if f.standardize and len(s) else np.ones(len(s))
        ridge.append(np.append(f.reg * (1 - f.mix) * scale, 0.0))
        lasso.append(np.append(f.reg * f.mix * np.sqrt(scale), 0.0))

    def penalty(m: int, c: np.ndarray) -> float:
        return float((ridge[m] * c * c).sum() / 2 + (lasso[m] * np.abs(c)).sum())

    own = lambda m: np.append(seen[m], width)
    way, part, loss = np.zeros_like(base), np.zeros(n), np.full(n, np.inf)
    live = [m for m in range(n) if fits[m].weighting in weight]
    for m in live if start is not None else ():
        at = own(m) if fits[m].intercept else seen[m]
        base[m, at] = start[m, at]
    for _ in range(steps):
        given = sc.broadcast((base + part[:, None] * way, live))

        def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, on = given.value  # noqa: B023
            for b in batches:
                if not b.num_rows:
                    continue
                x, w, y = arrays(b, "x", "w", "label")
                x = np.concatenate([x, np.ones((len(x), 1))], 1)
                for m in on:
                    v = w[:, fits[m].weighting]
                    if not (has := v != 0).any():
                        continue
                    xm, v, ym = x[np.ix_(has, own(m))], v[has], y[has]
                    z = xm @ now[m, own(m)]
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    yield _sent([(m, np.concatenate([[(v * (np.logaddexp(0, z) - ym * z)).sum()], xm.T @ (v * (p - ym)), ((xm * (v * p * (1 - p))[:, None]).T @ xm).ravel()]))])

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now = given.value[0]  # noqa: B023
            for pdf in batches:
                out = []
                for m, v in zip(pdf["m"], pdf["v"], strict=True):
                    k = len(own(m))
                    c, v = now[m, own(m)], np.asarray(v) / weight[fits[m].weighting]
                    g, h = v[1 : 1 + k] + ridge[m] * c, v[1 + k :].reshape(k, k) + np.diag(ridge[m] + 1e-9)
                    if not fits[m].intercept:
                        g[-1], h[-1], h[:, -1], h[-1, -1] = 0, 0, 0, 1
                    out.append(descend(h, g, c, lasso[m]) if lasso[m].any() else -np.linalg.solve(h, g))
                yield pd.DataFrame({"m": pdf["m"], "loss": [v[0] for v in pdf["v"]], "d": out})

        told = added(rows.select("x", "w", "label"), slopes).mapInPandas(solve, "m int, loss double, d array<double>").collect()
        for m, sum_, d in told:
            at = base[m] + part[m] * way[m]
            value = sum_ / weight[fits[m].weighting] + penalty(m, at[own(m)])
            if value <= loss[m] + 1e-14:  # the step is taken, the next one is in sight
                done = loss[m] - value < 1e-10 and part[m] > 0
                base[m], loss[m], part[m] = at, value, 0.0 if done else 1.0
                way[m] = 0
                way[m, own(m)] = d
                if done or np.abs(d).max() < TOLERANCE * (1 + np.abs(at).max()):
                    base[m], part[m] = at + (0 if done else way[m]), 0.0
            else:
                part[m] /= 2
                if part[m] < 1e-6:
                    part[m] = 0.0
        given.unpersist()
        live = [m for m in live if part[m] > 0]
        if not live:
            break
    return base


def counts_many(rows: DataFrame, fits: list[Fit], models: np.ndarray) -> np.ndarray:
    """(hits, false alarms, rejects, misses, the loss) of each fit over its weighting's test weights."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, t, y = arrays(b, "x", "t", "label")
            z = x @ models[:, :-1].T + models[:, -1]
            out = []
            for m, f in enumerate(fits):
                if (v := t[:, f.weighting]).any():
                    yes, is_ = z[:, m] > 0, y == 1
                    out.append((m, np.array([v[yes & is_].sum(), v[yes & ~is_].sum(), v[~yes & ~is_].sum(), v[~yes & is_].sum(), (v * (np.logaddexp(0, z[:, m]) - y * z[:, m])).sum()])))
            if out:
                yield _sent(out)

    got = np.full((len(fits), 5), np.nan)
    for m, v in added(rows.select("x", "t", "label"), count).collect():  # a row a fit
        got[m] = v
    return got


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


#: Scores by name, the higher the better, of (hits, false alarms, rejects, misses, loss).
SCORES = {
    "accuracy": lambda tp, fp, tn, fn, _: _share(tp + tn, tp + fp + tn + fn),
    "balanced_accuracy": lambda tp, fp, tn, fn, _: (_share(tp, tp + fn) + _share(tn, tn + fp)) / 2,
    "precision": lambda tp, fp, tn, fn, _: _share(tp, tp + fp),
    "recall": lambda tp, fp, tn, fn, _: _share(tp, tp + fn),
    "f1": lambda tp, fp, tn, fn, _: _share(2 * tp, 2 * tp + fp + fn),
    "neg_log_loss": lambda tp, fp, tn, fn, loss: -_share(loss, tp + fp + tn + fn),
}


def scorer(name: str):
    if name not in SCORES:
        raise ValueError(f"unknown scoring {name!r}; known: {', '.join(SCORES)}")
    return SCORES[name]


def score_many(rows: DataFrame, fits: list[Fit], scoring: str = "accuracy", start: np.ndarray | None = None) -> np.ndarray:
    """Each fit's score over its weighting's test rows; nan where there are none."""
    score = scorer(scoring)
    got = counts_many(rows, fits, fit_many(rows, fits, start=start))
    return np.where(np.isnan(got[:, 0]), np.nan, score(*np.nan_to_num(got).T))
