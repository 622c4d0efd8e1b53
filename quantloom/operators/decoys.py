"""Decoy features, and q-values from the scores of targets and decoys."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal, uniform
from ..functions.storage import cut

#: How many numbers a task works out at a time for the areas under the curves.
POINTS = 1 << 20


def decoy_shuffle(cells: DataFrame, seed: int = 0) -> DataFrame:
    """Each feature's values in another order of its samples, drawn by hash."""
    h = F.md5(F.concat_ws("|", "row_id", "sample", F.lit(seed))).alias("h")
    # both orders are arrays of a feature, each sorted once: no join, and no array in each row
    packed = cells.select("row_id", F.struct("sample").alias("a"), F.struct(h, "sample", "value").alias("b")).groupBy("row_id")
    both = packed.agg(F.array_sort(F.collect_list("a")).alias("a"), F.array_sort(F.collect_list("b")).alias("b"))
    return both.select("row_id", F.explode(F.arrays_zip("a", "b")).alias("x")).select("row_id", "x.a.sample", "x.b.value")


def decoy_mean(cells: DataFrame, seed: int = 0) -> DataFrame:
    """Normal numbers with each feature's mean and deviation."""
    w = Window.partitionBy("row_id")
    u1, u2 = (uniform("row_id", "sample", seed=seed, salt=s) for s in ("a", "b"))
    return cells.select("row_id", "sample", (F.avg(F.col("value")).over(w) + F.stddev_pop(F.col("value")).over(w) * normal(u1, u2)).alias("value"))


DECOYS = {"shuffle": decoy_shuffle, "mean": decoy_mean}


def append(cells: DataFrame, features: DataFrame, method: str = "shuffle", feature_column: str = "Protein", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Targets and one decoy of each: its row_id follows all targets', its name begins with decoy_."""
    if method not in DECOYS:
        raise ValueError(f"unknown decoy method {method!r}; known: {', '.join(DECOYS)}")
    shift = features.agg((F.coalesce(F.max("row_id"), F.lit(-1)) + 1).alias("shift"))
    decoys = DECOYS[method](cells, seed).crossJoin(F.broadcast(shift)).select((F.col("row_id") + F.col("shift")).alias("row_id"), "sample", "value")
    named = F.concat(F.lit("decoy_"), F.col(f"`{feature_column}`"))
    rows = features.withColumn(feature_column, named).crossJoin(F.broadcast(shift)).withColumn("row_id", F.col("row_id") + F.col("shift")).drop("shift")
    flag = F.col(f"`{feature_column}`").contains("decoy").cast("int")
    both = features.drop("Decoy").unionByName(rows.drop("Decoy")).withColumn("Decoy", F.coalesce(flag, F.lit(0)))
    return cells.select("row_id", "sample", "value").unionByName(decoys), both


def running(df: DataFrame, order: list[tuple[str, bool]], sums: dict[str, F.Column], parts: int | None = None) -> DataFrame:
    """Running sums over all rows in an order ((column, whether ascending)), without sending all rows to one task: rows
    are dealt out by ranges of the whole order, so ties of its first column are split by the others; the ranges' totals
    (one row a range) are added up, and each range runs on its own."""
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    dealt = cut(df.withColumns({f"__{k}": v for k, v in sums.items()}).repartitionByRange(parts, *by).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(*[F.sum(f"__{k}").alias(f"__t_{k}") for k in sums])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = totals.select("__range", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    own = Window.partitionBy("__range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(starts), "__range").withColumns({k: F.sum(f"__{k}").over(own) + F.col(f"__b_{k}") for k in sums})
    return out.drop("__range", *[f"__{k}" for k in sums], *[f"__b_{k}" for k in sums])


def qvalue_counter(scores: DataFrame, score: str = "score", decoy: str = "Decoy", tie: str = "row_id", pit: float = 1.0) -> DataFrame:
    """scores with q_value: from the highest score down, pit * decoys / (pit * decoys + targets). Not made monotone."""
    is_decoy = (F.col(decoy) == 1).cast("long")
    counted = running(scores.where(F.col(score).isNotNull()), [(score, False), (tie, True)], {"__d": is_decoy, "__n": F.lit(1).cast("long")})
    decoys = F.col("__d") * pit
    return counted.withColumn("q_value", decoys / (decoys + F.col("__n") - F.col("__d"))).drop("__d", "__n")


def quartiles(scores: DataFrame, score: str, n: int) -> tuple[float, float]:
    """The quartiles of the n scores by straight lines, from their ranks: no task holds all of them."""
    places = [(n - 1) * p for p in (0.25, 0.75)]
    ranked = running(scores.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("__v")), [("__v", True)], {"__r": F.lit(1).cast("long")})
    wanted = sorted({f(at) + 1 for at in places for f in (math.floor, math.ceil)})
    held = dict(ranked.where(F.col("__r").isin(wanted)).select("__r", "__v").collect())  # four rows at most
    lower, upper = [(held[math.floor(at) + 1], held[math.ceil(at) + 1]) for at in places]
    return tuple(a + (at - math.floor(at)) * (b - a) for at, (a, b) in zip(places, (lower, upper), strict=True))


def automatic_bins(scores: DataFrame, score: str = "score") -> int:
    """How many bins a histogram of the scores takes: the larger number of Sturges' rule and that of Freedman and
    Diaconis; at least one."""
    n, span = scores.agg(F.count(score), F.max(score) - F.min(score)).first()
    if not n or not span:
        return 1
    low, high = quartiles(scores, score, n)
    sturges = span / (math.log2(n) + 1)
    spread = 2 * (high - low) / n ** (1 / 3)
    return math.ceil(span / (min(sturges, spread) if spread else sturges))


def qvalue_distribution(scores: DataFrame, score: str = "score", decoy: str = "Decoy", bins: int | None = 50, pit: float = 1.0) -> DataFrame:
    """(score, target, decoy, q_value) on a grid of bins (None: automatic_bins): each class's histogram as a density,
    interpolated at the bins' centres; the areas above a score give its q-value. Only the histograms leave the rows,
    `bins` counts each. qvalue_of_scores gives each row the value of its own score."""
    bins = bins or automatic_bins(scores, score)
    span = scores.where(F.col(score).isNotNull()).agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col(score) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    binned = scores.where(F.col(score).isNotNull()).crossJoin(F.broadcast(span)).groupBy(F.coalesce(at, F.lit(0)).alias("bin"), "lo", "hi").agg(F.sum((F.col(decoy) == 1).cast("long")).alias("nd"), F.sum((F.col(decoy) != 1).cast("long")).alias("nt"))
    every = span.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"), "lo", "hi")
    full = every.join(binned.drop("lo", "hi"), "bin", "left").select("bin", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("score"), width.alias("w"), F.coalesce("nt", F.lit(0)).alias("nt"), F.coalesce("nd", F.lit(0)).alias("nd"))
    whole = Window.partitionBy()  # over `bins` rows
    dense = full.withColumns({"target": F.try_divide(F.col("nt"), F.sum("nt").over(whole) * F.col("w")), "decoy": F.try_divide(F.col("nd"), F.sum("nd").over(whole) * F.col("w"))})
    up = Window.orderBy("bin")
    step = lambda c: F.coalesce((F.col(c) + F.lead(c).over(up)) / 2 * F.col("w"), F.lit(0.0))
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    area = dense.withColumns({"__t": step("target"), "__d": step("decoy")}).withColumns({"__t": F.sum("__t").over(above), "__d": F.sum("__d").over(above)})
    return area.select("score", "target", "decoy", F.try_divide(F.col("__d") * pit, F.col("__d") * pit + F.col("__t")).alias("q_value"))


def qvalue_of_scores(scores: DataFrame, score: str = "score", decoy: str = "Decoy", pit: float = 1.0, step: float = 0.1) -> DataFrame:
    """scores with q_value by score distributions: each class is counted between the centres of automatic_bins of all
    scores, both curves are read off by straight lines on steps of `step` from a score to the largest one, and the
    q-value is the decoys' share of the areas under them (trapezoids). The curves, two numbers a bin, are what every task
    has. Between two knots the steps' values are an arithmetic series, so a score takes as much work as there are knots or
    steps, whichever are fewer."""
    scores = cut(scores)
    bins = automatic_bins(scores, score)
    lo, hi = scores.agg(F.min(score), F.max(score)).first()
    if lo is None:
        return scores.withColumn("q_value", F.lit(None).cast("double"))
    width = (hi - lo) / bins or 1.0
    edges = [lo + (k + 0.5) * width for k in range(bins)]  # the centres of the bins are edges of the curves' bins
    at = F.least(F.floor((F.col(score) - F.lit(edges[0])) / F.lit(width)), F.lit(max(bins - 2, 0)))
    inside = scores.where(F.col(score).between(edges[0], edges[-1])).groupBy(at.alias("k")).agg(F.sum((F.col(decoy) == 1).cast("long")).alias("d"), F.sum((F.col(decoy) != 1).cast("long")).alias("t"))
    held = {r["k"]: (float(r["t"]), float(r["d"])) for r in inside.collect()}  # one row a bin
    centres = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)] or edges
    curves = [[held.get(k, (0.0, 0.0))[c] for k in range(len(centres))] for c in (0, 1)]
    v = F.col(score).cast("double")
    n = F.greatest(F.ceil((F.lit(hi) - v) / step), F.lit(0)).cast("long")  # points from the score on
    kind = "target double, decoy double"

    @F.arrow_udf(kind)
    def areas(v: pa.Array, n: pa.Array) -> pa.Array:
        v, n = v.to_numpy(zero_copy_only=False).astype(float), n.to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(_stepped_area(v, n, np.array(centres), np.array(curve), step)) for curve in curves], ["target", "decoy"])

    x = areas(F.coalesce(v, F.lit(hi)), F.when(F.isnan(v), 0).otherwise(F.coalesce(n, F.lit(0))))
    found = scores.withColumn("__a", x)
    target, own = F.col("__a.target"), F.col("__a.decoy") * pit
    return found.withColumn("q_value", F.when(v.isNull() | F.isnan(v), F.lit(None)).when((target == 0) & (own == 0), 0.0).otherwise(own / (own + target))).drop("__a")


def _stepped_area(v: np.ndarray, n: np.ndarray, knots: np.ndarray, values: np.ndarray, step: float) -> np.ndarray:
    """The trapezoids under the line through (knots, values), level beyond them, at the n points v, v + step, .. of each."""
    line, out = lambda g: np.interp(g, knots, values), np.zeros(len(v))
    if not (n > 1).any():
        return out
    by_points = n.max() <= len(knots)
    rows = max(1, POINTS // int(min(n.max(), len(knots))))
    for i in range(0, len(v), rows):
        x, m = v[i : i + rows], n[i : i + rows]
        if by_points:
            first = np.cumsum(m) - m
            of = np.repeat(np.arange(len(x)), m)
            total = np.bincount(of, weights=line(x[of] + (np.arange(len(of)) - first[of]) * step), minlength=len(x))
        else:
            # the first point at or beyond each knot, as a number from 0 to n
            at = np.clip(np.ceil((knots - x[:, None]) / step), 0, m[:, None])
            j, slope = np.diff(at, axis=1), np.diff(values) / np.diff(knots)
            between = j * (values[:-1] + slope * (x[:, None] - knots[:-1])) + slope * step * (at[:, :-1] + at[:, 1:] - 1) * j / 2
            total = at[:, 0] * values[0] + (m - at[:, -1]) * values[-1] + between.sum(axis=1)
        out[i : i + rows] = np.where(m > 1, (total - (line(x) + line(x + (m - 1) * step)) / 2) * step, 0.0)
    return out
