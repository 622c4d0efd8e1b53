"""Classifiers over samples: training, prediction, importance by shuffling, bootstrap, elimination and search.

A classifier is an MLlib estimator with features and label columns, whichever the user has. A sample is a row with a
vector of all features; samples stay distributed rows, and no matrix passes through the driver. What is repeated
(bootstrap iterations, folds, candidates) is drawn by hash, so results don't depend on partitions. Logistic regressions
of two classes are fitted all at once (many.py): a fold, or how often a resample drew a sample, is a weight of the row.
Other classifiers are fitted one by one, THREADS of them at a time. Of a fitted model only its coefficients are on the
driver, as MLlib has them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import digest, uniform
from ..functions.storage import cut
from . import many
from .scaling import standard

THREADS = 4


def plain_classifier() -> Estimator:
    return LogisticRegression(maxIter=30, regParam=0.01)


def label_encode(samples: DataFrame, column: str = "group", out: str = "label") -> DataFrame:
    """0, 1, .. by sorted distinct values. The window is over the distinct values only."""
    codes = samples.select(column).where(F.col(column).isNotNull()).distinct().withColumn(out, F.row_number().over(Window.orderBy(column)).cast("double") - 1)
    return samples.join(F.broadcast(codes), column, "left")


def numbered(cells: DataFrame) -> DataFrame:
    """(k, row_id): the places that features have in to_ml's vectors."""
    from .decoys import running

    rows = running(cells.select("row_id").distinct(), [("row_id", True)], {"k": F.lit(1).cast("long")})
    return rows.select((F.col("k") - 1).cast("int").alias("k"), "row_id")


def to_ml(cells: DataFrame, samples: DataFrame, comparison: tuple | None = None, label_column: str = "group") -> DataFrame:
    """(sample, label, features): a vector per sample in the order of row_id, missing values as zero."""
    chosen = samples if comparison is None else samples.where(F.col(label_column).isin(list(comparison)))
    coded = label_encode(chosen, label_column)
    rows = cells.join(F.broadcast(coded.select("sample")), "sample", "left_semi")
    # each sample's own values meet once; features that it lacks are added from the list of all, which is as long as a vector
    ids = rows.agg(F.sort_array(F.collect_set("row_id")).alias("__ids")).where(F.size("__ids") > 0)
    own = rows.groupBy("sample").agg(F.collect_list(F.struct("row_id", F.coalesce("value", F.lit(0.0)).alias("value"))).alias("v"))
    every = coded.select("sample", "label").join(own, "sample", "left").crossJoin(F.broadcast(ids))
    none = F.array().cast(own.schema["v"].dataType)
    given = F.coalesce("v", none)
    lacking = F.transform(F.array_except("__ids", F.transform(given, lambda x: x["row_id"])), lambda i: F.struct(i.alias("row_id"), F.lit(0.0).alias("value")))
    full = F.sort_array(F.when(F.size(given) < F.size("__ids"), F.concat(given, lacking)).otherwise(given))
    return every.select("sample", "label", array_to_vector(full["value"]).alias("features"))


def balanced(rows: DataFrame) -> DataFrame:
    """rows with weight n / (classes * rows of the class)."""
    n = rows.groupBy("label").agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    return rows.join(F.broadcast(n), "label").crossJoin(F.broadcast(total)).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).drop("__n", "__all", "__k")


def folds(rows: DataFrame, k: int = 3, seed: int = 0, key: str = "sample") -> DataFrame:
    """rows with fold: each class dealt out evenly in an order drawn by hash."""
    w = Window.partitionBy("label").orderBy(uniform(key, seed=seed, salt="fold"), key)
    return rows.withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(k)))


@dataclass
class TrainResult:
    model: Model
    scores: list[float] = field(default_factory=list)


def checked(classifier) -> Estimator:
    if not isinstance(classifier, Estimator):
        raise ValueError("a classifier is an MLlib estimator")
    return classifier


def base_weight(classifier) -> F.Column:
    """The weights that a classifier gives the rows."""
    return F.col(classifier.getWeightCol()).cast("double") if classifier.hasParam("weightCol") and classifier.isSet("weightCol") else F.lit(1.0)


def told(rows: DataFrame) -> DataFrame:
    """(tp, fp, tn, fn, loss, n) of rows with prediction and label; loss is null without a probability."""
    is_, yes = F.col("label") == 1, F.col("prediction") == 1
    loss = F.sum(-F.ln(F.greatest(vector_to_array("probability")[F.col("label").cast("int")], F.lit(1e-15)))) if "probability" in rows.columns else F.lit(None).cast("double")
    return rows.agg(*[F.count_if(c).cast("double") for c in (yes & is_, yes & ~is_, ~yes & ~is_, ~yes & is_)], loss, F.count("*"), F.avg((F.col("prediction") == F.col("label")).cast("double")))


def score_of(model: Model, rows: DataFrame, scoring: str = "accuracy") -> float | None:
    """A model's score on rows; None without rows. Accuracy is that of any number of classes."""
    *counts, n, accuracy = told(model.transform(rows)).first()
    if not n:
        return None
    if scoring == "accuracy":
        return accuracy
    if scoring == "neg_log_loss" and counts[4] is None:
        raise ValueError("neg_log_loss needs a classifier with probabilities")
    return float(many.scorer(scoring)(*np.array([[c or 0.0] for c in counts]))[0])


def cross_many(classifiers: list[Estimator], rows: DataFrame, k: int = 3, seed: int = 0, scoring: str = "accuracy", features: list[tuple[int, ...]] | None = None) -> list[list[float]]:
    """The scores of each classifier on each fold of a model of the others; features: which each classifier sees. The
    logistic regressions with equal weights share their passes over the rows."""
    many.scorer(scoring)
    dealt, out = folds(rows, k, seed).cache(), [None] * len(classifiers)
    two, shared = dealt.select("label").distinct().count() <= 2, {}
    for c, classifier in enumerate(classifiers):
        fit = many.fit_of(checked(classifier), 0) if two else None
        if fit is not None:
            shared.setdefault(classifier.getWeightCol() if classifier.isSet("weightCol") else None, []).append(c)
    for group in shared.values():
        base = base_weight(classifiers[group[0]])
        one = lambda test: F.array(*[F.when((F.col("fold") == i) == F.lit(test), 1.0 if test else base).otherwise(0.0) for i in range(k)])  # noqa: B023, E731
        rows_of = many.packed(dealt, one(False), one(True), base).cache()
        fits = [many.fit_of(classifiers[c], i, features[c] if features else None) for c in group for i in range(k)]
        for c, scores in zip(group, many.score_many(rows_of, fits, scoring).reshape(len(group), k), strict=True):
            out[c] = [float(x) for x in scores if not np.isnan(x)]
        rows_of.unpersist()
    for c, classifier in enumerate(classifiers):
        if out[c] is None:
            slim = dealt if features is None else sliced(dealt, features[c])
            found = [score_of(classifier.fit(slim.where(F.col("fold") != i)), slim.where(F.col("fold") == i), scoring) for i in range(k)]
            out[c] = [x for x in found if x is not None]
    dealt.unpersist()
    return out


def cross_scores(classifier: Estimator, rows: DataFrame, k: int = 3, seed: int = 0, scoring: str = "accuracy") -> list[float]:
    """The score on each fold of a model of the others."""
    return cross_many([classifier], rows, k, seed, scoring)[0]


def sliced(rows: DataFrame, features: tuple[int, ...]) -> DataFrame:
    """rows with some of the features, by their places."""
    slicer = VectorSlicer(inputCol="__all", outputCol="features", indices=list(features))
    return slicer.transform(rows.withColumnRenamed("features", "__all")).drop("__all")


def train(cells: DataFrame, samples: DataFrame, classifier: Estimator, comparison: tuple = (1, 2), scale: bool = True, validate: bool = True, num_folds: int = 3, random_state: int = 42, scoring: str = "accuracy", scaler: Callable[[DataFrame], DataFrame] | None = None) -> TrainResult:
    """A fitted classifier and its scores by folds. scaler: what scales the cells, if not `standard`."""
    rows = balanced(to_ml((scaler or standard)(cells) if scale else cells, samples, comparison)).cache()
    scores = cross_scores(classifier, rows, num_folds, random_state, scoring) if validate else []
    model = checked(classifier).fit(rows)
    rows.unpersist()
    return TrainResult(model, scores)


def predict(cells: DataFrame, samples: DataFrame, model: Model, scale: bool = True) -> DataFrame:
    """samples with Prediction."""
    rows = to_ml(standard(cells) if scale else cells, samples)
    return samples.join(model.transform(rows).select("sample", F.col("prediction").alias("Prediction")), "sample", "left")


def shuffled(long: DataFrame, turns: int, seed: int | F.Column = 0, by: tuple[str, ...] = ("k",), at: str = "sample") -> DataFrame:
    """(*by, at, x, y) of rows (*by, at, sample, x): y has what each of `turns` shuffles puts in x's place. The places are
    in the order of `at`, which is unique within `by`; the values are dealt out in an order drawn by hash.

    A group holds one feature's numbers, each row once for all shuffles, and sorts them once for each. What an order is
    drawn by are the first eight hex digits of a hash, whose order as text is that of `uniform`'s numbers."""
    keys = [*by, at]
    kind = ", ".join(f"{c} {long.schema[c].dataType.simpleString()}" for c in keys)
    drawn = [F.substring(digest("k", "sample", seed=seed + i, salt="shuffle"), 1, 8).alias(f"u{i}") for i in range(turns)]

    def deal(group: pa.Table) -> pa.Table:
        group = group.sort_by(at).combine_chunks()
        x = group["x"].to_numpy()
        number = lambda c: np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c), "")[0].as_buffer(), ">u8")
        y = np.stack([x[np.lexsort((x, number(group[f"u{i}"].combine_chunks()).astype(np.uint64)))] for i in range(turns)], 1)
        ends = pa.array(np.arange(0, y.size + 1, turns), pa.int32())
        return group.select([*keys, "x"]).append_column("y", pa.ListArray.from_arrays(ends, pa.array(y.ravel())))

    return long.select(*keys, "x", *drawn).groupBy(*by).applyInArrow(deal, f"{kind}, x double, y array<double>")


def mean_change(turns: int) -> F.Column:
    """What `shuffled` takes from x, on the mean of its shuffles."""
    total = F.lit(0.0)
    for i in range(turns):
        total = total + F.col("x") - F.col("y")[i]
    return total / turns


def long_rows(rows: DataFrame) -> DataFrame:
    return rows.select("sample", F.posexplode(vector_to_array("features")).alias("k", "x"))


def linear_importance(rows: DataFrame, weights: list[float], iterations: int = 3, seed: int = 0) -> DataFrame:
    """(k, importance) of a linear model: shuffling a feature moves a prediction by its weight times the values'
    difference, so nothing is predicted again."""
    w = rows.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(weights)], "k int, w double")
    local = shuffled(long_rows(rows), iterations, seed).select("k", mean_change(iterations).alias("d")).join(sized_weights(w), "k")
    return local.groupBy("k").agg(F.avg(F.abs(F.col("d") * F.col("w"))).alias("importance"))


def sized_weights(w: DataFrame) -> DataFrame:
    from .annotate import sized

    return sized(w)


@dataclass
class Linear:
    """A linear score by its weights, for what no MLlib model was fitted for."""

    weights: list[float]


def weights_of(model) -> np.ndarray | None:
    """The weights of a linear score of two classes, or None."""
    if isinstance(model, Linear):
        return np.array(model.weights, float)
    w = getattr(model, "coefficients", None) if getattr(model, "numClasses", 2) == 2 else None
    return None if w is None else np.array(w.toArray(), float)


def scores_of(model: Model, rows: DataFrame) -> F.Column:
    """A model's score of the second class, as a column of what it makes of rows."""
    for name in ("rawPrediction", "probability"):
        if name in rows.columns:
            return vector_to_array(name)[1]
    return F.col("prediction")


def split_features(model) -> list[int] | None:
    """The features that a tree model splits on; None for any other model."""
    text = getattr(model, "toDebugString", None)
    return None if not isinstance(text, str) else sorted({int(k) for k in re.findall(r"feature (\d+)", text)})


def local_importance(rows: DataFrame, model: Model | Linear, iterations: int = 3, seed: int = 0) -> DataFrame:
    """(k, sample, value) of a fitted model: the mean change of each sample's score when feature k's values are dealt to
    other samples.

    For a linear model the change is the weight times the difference of the values, so nothing is scored again; any
    other scores each sample once for each feature and iteration, where the sample is. A tree model does so only for
    the features that it splits on: others can't change a score, so theirs is 0.
    """
    weights, long = weights_of(model), long_rows(rows)
    used, none = split_features(model), None
    if weights is None and used is not None:
        none = long.where(~F.col("k").isin(used)).select("k", "sample", F.lit(0.0).alias("value"))
        long = long.where(F.col("k").isin(used))
    moved = shuffled(long, iterations, seed)
    if weights is not None:
        w = rows.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(weights)], "k int, w double")
        local = moved.select("k", "sample", mean_change(iterations).alias("d")).join(sized_weights(w), "k")
        return local.select("k", "sample", (F.col("d") * F.col("w")).alias("value"))
    base = model.transform(rows)
    base = base.select("sample", vector_to_array("features").alias("v"), scores_of(model, base).alias("score"))
    other = moved.select("sample", "k", F.explode("y").alias("y")).join(base, "sample")
    other = other.select("sample", "k", "score", array_to_vector(F.transform("v", lambda x, i: F.when(i == F.col("k"), F.col("y")).otherwise(x))).alias("features"))
    again = model.transform(other)
    found = again.groupBy("k", "sample").agg(F.avg(F.col("score") - scores_of(model, again)).alias("value"))
    return found if none is None else found.unionByName(none)


def feature_importance(rows: DataFrame, model: Model | Linear, iterations: int = 3, seed: int = 0) -> DataFrame:
    """(k, importance): the mean absolute value of local_importance."""
    return local_importance(rows, model, iterations, seed).groupBy("k").agg(F.avg(F.abs("value")).alias("importance"))


def interpret(cells: DataFrame, features: DataFrame, samples: DataFrame, model: Model | Linear, scale: bool = True, downsample_background: bool = True, iterations: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(features with Importance, local importances) of a fitted model."""
    rows = to_ml(standard(cells) if scale else cells, samples)
    rows = cut(undersample(rows, seed) if downsample_background else rows)
    local = cut(local_importance(rows, model, iterations, seed).join(sized_weights(numbered(cells)), "k"))
    found = local.groupBy("row_id").agg(F.avg(F.abs("value")).alias("Importance"))
    return features.join(found, "row_id", "left"), local


def undersample(rows: DataFrame, seed: int = 0, key: str = "sample") -> DataFrame:
    """As many rows of each class as the smallest has, drawn by hash."""
    w = Window.partitionBy("label").orderBy(uniform(key, seed=seed, salt="under"), key)
    least = rows.groupBy("label").count().agg(F.min("count").alias("__least"))
    return rows.withColumn("__rank", F.row_number().over(w)).crossJoin(F.broadcast(least)).where("__rank <= __least").drop("__rank", "__least")


def bootstrap_resample(rows: DataFrame, iterations: int, seed: int = 0, rate: float = 1.0, replace: bool = True) -> DataFrame:
    """(iteration, label, slot, sample): of each class's samples `rate` times as many, one at least, drawn with
    replacement or without."""
    w = Window.partitionBy("label").orderBy("sample")
    placed = rows.select("sample", "label", (F.row_number().over(w) - 1).alias("place"), F.count("*").over(Window.partitionBy("label")).alias("n"))
    slots = placed.select("label", "n", F.col("place").alias("slot")).where(F.col("slot") < F.greatest(F.floor(F.col("n") * rate), F.lit(1)))
    slots = slots.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    chance = uniform("iteration", "label", "slot", seed=seed, salt="boot")
    if replace:
        drawn = slots.withColumn("place", F.floor(chance * F.col("n")))
        return drawn.join(placed.select("label", "place", "sample"), ["label", "place"]).select("iteration", "label", "slot", "sample")
    each = placed.withColumnRenamed("place", "slot").withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    order = Window.partitionBy("iteration", "label").orderBy(chance, "slot")
    each = each.withColumn("slot", F.row_number().over(order) - 1)
    return each.where(F.col("slot") < F.greatest(F.floor(F.col("n") * rate), F.lit(1))).select("iteration", "label", "slot", "sample")


def drawn_rows(rows: DataFrame, draws: DataFrame, iteration: int) -> DataFrame:
    """The rows of one resample: each draw is a row, with a sample of its own."""
    return rows.join(named_draws(draws.where(F.col("iteration") == iteration)).select("sample", "name"), "sample").drop("sample").withColumnRenamed("name", "sample")


def named_draws(draws: DataFrame) -> DataFrame:
    """draws with the name that a draw has as a row."""
    return draws.withColumn("name", F.concat_ws("#", F.col("sample").cast("string"), F.col("slot").cast("string"), F.col("label").cast("string")))


def even_draws(draws: DataFrame, seed: int) -> DataFrame:
    """Of each iteration's draws (with names) as many of each class as the smallest has, as `undersample` has them."""
    w = Window.partitionBy("iteration", "label").orderBy(uniform("name", seed=F.col("iteration") + seed, salt="under"), "name")
    ranked = draws.withColumn("__rank", F.row_number().over(w))
    least = ranked.groupBy("iteration", "label").agg(F.max("__rank").alias("__n")).groupBy("iteration").agg(F.min("__n").alias("__least"))
    return ranked.join(F.broadcast(least), "iteration").where("__rank <= __least").drop("__rank", "__least")


def weightings(rows: DataFrame, counts: DataFrame, n: int, base: F.Column) -> DataFrame:
    """many.packed of rows and counts (sample, at, w, t): the training and test weights of each of n weightings."""
    held = counts.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("w", "t")))).alias("__by"))
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("__by", i)[c], F.lit(0.0)))
    return many.packed(rows.withColumn("__base", base).join(held, "sample"), F.transform(at("w"), lambda v: v * F.col("__base")), at("t"), F.col("__base"))


def bootstrap_importance(rows: DataFrame, iterations: int = 100, downsample: bool = True, shuffles: int = 3, seed: int = 0, classifier: Estimator | None = None) -> DataFrame:
    """(iteration, k, importance, rank) of a classifier fitted on each resample; importances are divided by the
    iteration's largest, ranks average ties, the most important first. A window holds one iteration's features, which
    a single sample's vector holds as well.

    Resamples of logistic regressions are weights: all are fitted together, and their shuffles are one query."""
    rows, classifier = cut(rows), checked(classifier or plain_classifier())
    draws = cut(bootstrap_resample(rows, iterations, seed))
    if many.fit_of(classifier, 0) is not None and rows.select("label").distinct().count() == 2:
        out = _importance_by_weights(rows, draws, iterations, downsample, shuffles, seed, classifier)
    else:

        def one(i: int) -> DataFrame:
            part = cut(undersample(drawn_rows(rows, draws, i), seed + i) if downsample else drawn_rows(rows, draws, i))
            found = feature_importance(part, classifier.fit(part), shuffles, seed + i * shuffles)
            return cut(found.select(F.lit(i).alias("iteration"), "k", "importance"))

        with ThreadPool(THREADS) as pool:
            found = pool.map(one, range(iterations), chunksize=1)
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
    whole, by = Window.partitionBy("iteration"), Window.partitionBy("iteration").orderBy(F.desc("importance"))
    top = F.nullif(F.max("importance").over(whole), F.lit(0.0))
    tied = F.count("*").over(Window.partitionBy("iteration", "importance"))
    return out.select("iteration", "k", (F.col("importance") / F.coalesce(top, F.lit(1.0))).alias("importance"), (F.rank().over(by) + (tied - 1) / 2).alias("rank"))


def _importance_by_weights(rows: DataFrame, draws: DataFrame, iterations: int, downsample: bool, shuffles: int, seed: int, classifier: Estimator) -> DataFrame:
    """(iteration, k, importance) of all resamples."""
    spark, draws = rows.sparkSession, named_draws(draws)
    draws = cut(even_draws(draws, seed) if downsample else draws)
    counts = draws.groupBy("sample", F.col("iteration").alias("at")).agg(F.count("*").cast("double").alias("w")).withColumn("t", F.lit(0.0))
    weighed = weightings(rows, counts, iterations, base_weight(classifier)).cache()
    models = many.fit_many(weighed, [many.fit_of(classifier, i) for i in range(iterations)])[:, :-1]
    weighed.unpersist()
    w = spark.createDataFrame([(i, k, float(x)) for i, m in enumerate(models) for k, x in enumerate(m)], "iteration int, k int, w double")
    order = Window.partitionBy("iteration").orderBy("name")
    placed = draws.select("iteration", "sample", "name", F.row_number().over(order).alias("place"))
    long = placed.join(rows.select("sample", "features"), "sample").select("iteration", F.col("name").alias("sample"), "place", F.posexplode(vector_to_array("features")).alias("k", "x"))
    moved = shuffled(long, shuffles, F.lit(seed) + F.col("iteration") * shuffles, ("iteration", "k"), "place")
    local = moved.groupBy("iteration", "k").agg(F.avg(F.abs(mean_change(shuffles))).alias("d")).join(sized_weights(w), ["iteration", "k"])
    return local.select("iteration", "k", (F.col("d") * F.abs("w")).alias("importance"))


def summarise(importance: DataFrame) -> DataFrame:
    """Mean, median and deviation (by n - 1) of each feature's importance and rank."""
    return importance.groupBy("k").agg(*[f(c).alias(n + c.capitalize()) for c in ("importance", "rank") for n, f in (("Mean", F.avg), ("Median", F.median), ("Stdev", F.stddev_samp))])


def explain(cells: DataFrame, features: DataFrame, samples: DataFrame, comparisons: list[tuple] | tuple, n_iterations: int = 100, downsample_background: bool = True, seed: int = 0, classifier: Estimator | None = None) -> DataFrame:
    """features with the six columns of each comparison: {Mean,Median,Stdev}{Importance,Rank}a-b."""
    out, pairs = features, [comparisons] if isinstance(comparisons, tuple) and not isinstance(comparisons[0], tuple) else list(comparisons)
    names = cut(numbered(cells))
    filled = cells.withColumn("value", F.coalesce("value", F.lit(0.0)))
    for a, b in pairs:
        two = samples.where(F.col("group").isin([a, b]))
        rows = to_ml(standard(filled.join(F.broadcast(two.select("sample")), "sample", "left_semi")), two)
        found = summarise(bootstrap_importance(rows, n_iterations, downsample_background, seed=seed, classifier=classifier)).join(sized_weights(names), "k")
        out = out.join(found.select("row_id", *[F.col(c).alias(f"{c}{a}-{b}") for c in found.columns if c not in ("k", "row_id")]), "row_id", "left")
    return out


def select_features(importance: DataFrame, method: str = "count", top_n: int = 10, percent: float = 0.5, cutoff: str = "percent") -> DataFrame:
    """(k, score) of the features that stay. count: the share of iterations in which a feature is among the top_n;
    mean: its mean importance. cutoff percent keeps scores above it, knee those up to the point of the falling curve
    that lies furthest from its chord."""
    if method not in ("count", "mean") or cutoff not in ("percent", "knee"):
        raise ValueError("method is 'count' or 'mean', cutoff 'percent' or 'knee'")
    if method == "count":
        n = importance.agg(F.count_distinct("iteration").alias("__n"))
        best = importance.withColumn("__r", F.row_number().over(Window.partitionBy("iteration").orderBy("rank", "k"))).where(F.col("__r") <= top_n)
        scores = best.groupBy("k").agg(F.count("*").alias("c")).crossJoin(F.broadcast(n)).select("k", (F.col("c") / F.col("__n")).alias("score"))
    else:
        scores = importance.groupBy("k").agg(F.avg("importance").alias("score"))
    if cutoff == "percent":
        return scores.where(F.col("score") > percent)
    from .decoys import running

    ranked = running(scores, [("score", False), ("k", True)], {"r": F.lit(1).cast("long")})
    span = scores.agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    gap = 1 - F.try_divide(F.col("score") - F.col("lo"), F.col("hi") - F.col("lo")) - F.try_divide(F.col("r") - 1, F.col("n") - 1)
    far = ranked.crossJoin(F.broadcast(span)).withColumn("gap", gap)
    knee = far.agg(F.max_by("r", F.struct("gap", -F.col("r"))).alias("knee"))
    return far.crossJoin(F.broadcast(knee)).where(F.col("r") <= F.col("knee")).select("k", "score")


def kept_features(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows with the features of kept (k) only, in their order."""
    long = long_rows(rows).join(sized_weights(kept.select("k")), "k", "left_semi")
    packed = long.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("__v"))
    return rows.drop("features").join(packed, "sample").withColumn("features", array_to_vector("__v")).drop("__v")


def strength(model: Model, rows: DataFrame, seed: int) -> np.ndarray:
    """How much each feature of a fitted model counts: absolute weights, a tree model's importances, or shuffling."""
    if (w := weights_of(model)) is not None:
        return np.abs(w)
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    found = feature_importance(rows, model, seed=seed).orderBy("k").select("importance").toPandas()  # a number a feature
    return found["importance"].to_numpy()


def _levels(width: int, min_features: int, step: int) -> list[int]:
    """How many features are left at each level of the elimination."""
    out = [width]
    while out[-1] > min_features:
        out.append(max(out[-1] - step, min_features))
    return out


def bootstrap_rfe(rows: DataFrame, iterations: int = 10, min_features: int = 1, step: int = 1, seed: int = 0, classifier: Estimator | None = None, downsample_rate: float = 1.0, replace: bool = True, scoring: str = "accuracy", k_folds: int = 3) -> DataFrame:
    """(iteration, k, rank, n_features, score): in each resample (of `downsample_rate` times the samples, with or without
    replacement) the least important features go, `step` at a time; a feature's rank is the number of features left when
    it went. score is the mean over k_folds folds of the resample's draws with the features that were left then.

    Resamples of logistic regressions are weights: a level's models are fitted together, and those of all folds."""
    many.scorer(scoring)
    rows, classifier = cut(rows), checked(classifier or plain_classifier())
    draws = named_draws(bootstrap_resample(rows, iterations, seed, downsample_rate, replace))
    order = Window.partitionBy("iteration", "label").orderBy(uniform("name", seed=F.col("iteration") + seed, salt="rfe"), "name")
    draws = cut(draws.withColumn("fold", F.pmod(F.row_number().over(order) - 1, F.lit(k_folds))))
    first = rows.select(F.size(vector_to_array("features")).alias("n")).first()
    levels = _levels(first["n"] if first else 0, min_features, step)
    joint = many.fit_of(classifier, 0) is not None and rows.select("label").distinct().count() == 2
    left, scores = (_eliminated_jointly if joint else _eliminated_singly)(rows, draws, iterations, levels, classifier, scoring, k_folds, seed)
    out = []
    for i in range(iterations):
        for k, (n, live) in enumerate(zip(levels, left[i], strict=True)):
            gone = np.setdiff1d(live, left[i][k + 1]) if k + 1 < len(levels) else live
            value = float(np.nanmean(scores[i][k])) if not np.isnan(scores[i][k]).all() else None
            out += [(i, int(f), float(n), int(n), value) for f in gone]
    return rows.sparkSession.createDataFrame(out, "iteration int, k int, rank double, n_features int, score double")


def _eliminated_jointly(rows, draws, iterations, levels, classifier, scoring, k_folds, seed):
    """(each iteration's features at each level, the scores of their folds)."""
    one = lambda c: F.sum(c.cast("double"))
    whole = draws.groupBy("sample", F.col("iteration").alias("at")).agg(one(F.lit(1)).alias("w")).withColumn("t", F.lit(0.0))
    apart = draws.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(k_folds - 1))))
    apart = apart.groupBy("sample", (F.col("iteration") * k_folds + F.col("f")).alias("at")).agg(one(F.col("fold") != F.col("f")).alias("w"), one(F.col("fold") == F.col("f")).alias("t"))
    number = rows.count()
    weighed = many.gathered(weightings(rows, whole, iterations, base_weight(classifier)), number).cache()
    moments, models, near = many.moments_of(weighed), None, []
    left = [[np.arange(levels[0])] for _ in range(iterations)]
    for n in levels[1:]:
        # a level's models lie near those of the level before, and those of folds near those of the resample
        models = many.fit_many(weighed, [many.fit_of(classifier, i, tuple(x[-1])) for i, x in enumerate(left)], start=models, moments=moments)
        near.append(models)
        for i, x in enumerate(left):
            order = np.lexsort((x[-1], np.abs(models[i, x[-1]])))
            x.append(np.sort(x[-1][order[len(x[-1]) - n :]]))
    weighed.unpersist()
    parts = many.gathered(weightings(rows, apart, iterations * k_folds, base_weight(classifier)), number).cache()
    fits = [many.fit_of(classifier, i * k_folds + f, tuple(live)) for i, x in enumerate(left) for live in x for f in range(k_folds)]
    near.append(near[-1] if near else None)  # of the last level's features too
    start = np.array([near[k][i] for i in range(iterations) for k in range(len(levels)) for _ in range(k_folds)]) if near[0] is not None else None
    scores = many.score_many(parts, fits, scoring, start).reshape(iterations, len(levels), k_folds)
    parts.unpersist()
    return left, scores


def _eliminated_singly(rows, draws, iterations, levels, classifier, scoring, k_folds, seed):
    """As _eliminated_jointly, with a model at a time."""

    def one(i: int):
        part = cut(rows.join(draws.where(F.col("iteration") == i).select("sample", "name", "fold"), "sample").drop("sample").withColumnRenamed("name", "sample"))
        left = [np.arange(levels[0])]
        for n in levels[1:]:
            slim = sliced(part, left[-1])
            order = np.lexsort((left[-1], strength(classifier.fit(slim), slim, seed)))
            left.append(np.sort(left[-1][order[len(left[-1]) - n :]]))
        scores = []
        for live in left:
            slim = sliced(part, live)
            found = [score_of(classifier.fit(slim.where(F.col("fold") != f)), slim.where(F.col("fold") == f), scoring) for f in range(k_folds)]
            scores.append([np.nan if x is None else x for x in found])
        return left, scores

    with ThreadPool(THREADS) as pool:
        found = pool.map(one, range(iterations), chunksize=1)
    return [x for x, _ in found], np.array([y for _, y in found], float)


def rfe_scores(rfe: DataFrame) -> DataFrame:
    """(n_features, mean_score, sd_score) over the iterations."""
    one = rfe.select("iteration", "n_features", "score").distinct()
    return one.groupBy("n_features").agg(F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("sd_score"))


def rfe_ranks(rfe: DataFrame) -> DataFrame:
    """(k, mean_rank, sd_rank, median_rank, adjusted_rank), the last being median and deviation together."""
    out = rfe.groupBy("k").agg(F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("sd_rank"), F.median("rank").alias("median_rank"))
    return out.withColumn("adjusted_rank", F.col("median_rank") + F.coalesce("sd_rank", F.lit(0.0)))


def rfe_evaluate(rows: DataFrame, ranks: DataFrame, cutoffs: list[float], classifier: Estimator | None = None, k: int = 3, scoring: str = "accuracy") -> list[tuple[float, int, float]]:
    """(cutoff, features, score) of the features with an adjusted rank up to each cutoff, all cutoffs together."""
    kept = ranks.select("k", "adjusted_rank").toPandas()  # a number a feature
    sets = [(c, tuple(sorted(int(x) for x in kept["k"][kept["adjusted_rank"] <= c]))) for c in cutoffs]
    sets = [(c, s) for c, s in sets if s]
    scores = cross_many([classifier or plain_classifier()] * len(sets), rows, k, scoring=scoring, features=[s for _, s in sets])
    return [(c, len(s), float(np.mean(x))) for (c, s), x in zip(sets, scores, strict=True)]


@dataclass
class SearchResult:
    best_params: dict
    best_score: float
    history: list[list[tuple[float, dict]]]


def _draw(grid: dict[str, list], seed: int, n: int) -> list[dict]:
    rng = np.random.default_rng(seed)
    return [{k: v[int(rng.integers(len(v)))] for k, v in sorted(grid.items())} for _ in range(n)]


def _scores(rows: DataFrame, make: Callable[..., Estimator], people: list[dict], k: int, seed: int, scoring: str) -> list[tuple[float, dict]]:
    """Each candidate's mean score over the folds; candidates that are equal are fitted once."""
    keys = [tuple(sorted(p.items())) for p in people]
    once = list(dict.fromkeys(keys))
    found = dict(zip(once, cross_many([make(**dict(p)) for p in once], rows, k, seed, scoring), strict=True))
    return [(float(np.mean(found[key])), p) for key, p in zip(keys, people, strict=True)]


def search_random(rows: DataFrame, make: Callable[..., Estimator], grid: dict[str, list], n_iter: int = 30, k: int = 3, seed: int = 0, scoring: str = "accuracy") -> SearchResult:
    found = _scores(rows, make, _draw(grid, seed, n_iter), k, seed, scoring)
    best = max(found, key=lambda x: x[0])
    return SearchResult(best[1], best[0], [found])


def search_genetic(rows: DataFrame, make: Callable[..., Estimator], grid: dict[str, list], generations: int = 3, population: int = 6, survivors: int = 2, k: int = 3, seed: int = 0, compat: bool = False, scoring: str = "accuracy") -> SearchResult:
    """Each generation keeps its best and draws the rest anew. The best of all generations wins; with compat, of the first."""
    people, history = _draw(grid, seed, population), []
    for g in range(generations):
        scored = sorted(_scores(rows, make, people, k, seed, scoring), key=lambda x: -x[0])
        history.append(scored)
        people = [p for _, p in scored[:survivors]] + _draw(grid, seed + g + 1, population - survivors)
    best = max(history[0] if compat else [x for h in history for x in h], key=lambda x: x[0])
    return SearchResult(best[1], best[0], history)


def optimize(rows: DataFrame, make: Callable[..., Estimator], method: str, grid: dict[str, list], **kw) -> SearchResult:
    if method not in ("random", "genetic"):
        raise ValueError(f"unknown search {method!r}; known: random, genetic")
    return (search_random if method == "random" else search_genetic)(rows, make, grid, **kw)


def evaluate(features: DataFrame, score_columns: list[str], classifier: Estimator | None = None, k: int = 3, seed: int = 0, names: tuple[str, str] = ("FeatureScore", "FeatureQValue")) -> tuple[DataFrame, list[float]]:
    """(features with a score and its q-value, the accuracy on each fold): each fold's features are scored by a
    target-against-decoy model of the other folds, on standardised score columns."""
    from .decoys import qvalue_counter

    if "Decoy" not in features.columns:
        raise ValueError("evaluation needs features with a Decoy column")
    missing = [c for c in score_columns if c not in features.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    filled = features.select("row_id", "Decoy", *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate(score_columns)])
    stats = filled.agg(*[F.struct(F.avg(f"s{i}"), F.stddev_pop(f"s{i}")) for i in range(len(score_columns))]).first()
    scaled = [(F.col(f"s{i}") - F.lit(m or 0.0)) / F.lit(s or 1.0) for i, (m, s) in enumerate(stats)]
    rows = filled.select("row_id", (1 - F.col("Decoy")).cast("double").alias("label"), F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(k)).alias("fold"), array_to_vector(F.array(*scaled)).alias("features"))
    rows, out, right = cut(rows), None, []
    for i in range(k):
        model = (classifier or LogisticRegression(maxIter=50)).fit(rows.where(F.col("fold") != i))
        told = model.transform(rows.where(F.col("fold") == i))
        right.append(told.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
        one = told.select("row_id", scores_of(model, told).alias("FeatureScore"))
        out = one if out is None else out.unionByName(one)
    q = qvalue_counter(out.join(features.select("row_id", "Decoy"), "row_id"), "FeatureScore").select("row_id", F.col("FeatureScore").alias(names[0]), F.col("q_value").alias(names[1]))
    return features.join(q, "row_id", "left"), right


# The columns that evaluate_by takes by the method's name; a and b are the groups of a comparison.
DEG_COLUMNS = ["DEScore{a}-{b}", "Group{a}Mean", "Group{b}Mean", "Group{a}Stdev", "Group{b}Stdev", "Log2FoldChange{a}-{b}", "CorrectedPValue{a}-{b}"]
SCORE_COLUMNS = {
    "all": [*DEG_COLUMNS, "MeanImportance{a}-{b}", "MeanRank{a}-{b}"],
    "ml": ["MeanImportance{a}-{b}", "MeanRank{a}-{b}", "MedianImportance{a}-{b}", "MedianRank{a}-{b}"],
    "deg": DEG_COLUMNS,
}


def evaluate_by(features: DataFrame, comparisons: list[tuple] | tuple, method: str = "all", base_score_columns: list[str] | None = None, classifier: Estimator | None = None, k: int = 3, seed: int = 0) -> tuple[DataFrame, dict[tuple, list[float]]]:
    """(features, accuracies by comparison): for each comparison {Method}FeatureScorea-b and {Method}FeatureQValuea-b,
    from the method's columns or from base_score_columns with the comparison's suffix."""
    if method not in SCORE_COLUMNS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(SCORE_COLUMNS)}")
    pairs = [comparisons] if isinstance(comparisons, tuple) and not isinstance(comparisons[0], tuple) else list(comparisons)
    right = {}
    for a, b in pairs:
        columns = [f"{c}{a}-{b}" for c in base_score_columns] if base_score_columns else [c.format(a=a, b=b) for c in SCORE_COLUMNS[method]]
        names = tuple(f"{method.capitalize()}Feature{x}{a}-{b}" for x in ("Score", "QValue"))
        features, right[a, b] = evaluate(features, columns, classifier, k, seed, names)
    return features, right


def local_importance_top(local: DataFrame, n: int = 10) -> DataFrame:
    """(k, sample, value, mean_abs) of the n features with the largest mean absolute value."""
    means = local.groupBy("k").agg(F.avg(F.abs("value")).alias("mean_abs"))
    return local.join(F.broadcast(means.orderBy(F.desc("mean_abs"), "k").limit(n)), "k")


def plot_importance_data(local: DataFrame, n: int = 10, bins: int = 20) -> DataFrame:
    """(k, sample, value, mean_abs, bin, in_bin): what a summary plot of the n most important features shows."""
    top = local_importance_top(local, n)
    w = Window.partitionBy("k")
    width = F.nullif((F.max("value").over(w) - F.min("value").over(w)) / bins, F.lit(0.0))
    at = F.least(F.coalesce(F.floor((F.col("value") - F.min("value").over(w)) / width), F.lit(0)), F.lit(bins - 1))
    return top.withColumn("bin", at).withColumn("in_bin", F.count("*").over(Window.partitionBy("k", "bin")))


def plot_rfe_pca_data(rows: DataFrame, ranks: DataFrame, cutoffs: list[float]) -> DataFrame:
    """(cutoff, sample, label, pc1, pc2, explained1, explained2) of the features with an adjusted rank up to a cutoff."""
    from pyspark.ml.feature import PCA, StandardScaler

    ranks, out = cut(ranks), None
    for c in cutoffs:
        keep = ranks.where(F.col("adjusted_rank") <= c)
        if keep.count() < 2:
            continue
        part = cut(kept_features(rows.select("sample", "label", "features"), keep).withColumnRenamed("features", "v"))
        scaled = StandardScaler(inputCol="v", outputCol="s", withMean=True).fit(part).transform(part)
        model = PCA(k=2, inputCol="s", outputCol="p").fit(scaled)
        e = model.explainedVariance
        p = vector_to_array("p")
        one = model.transform(scaled).select(F.lit(float(c)).alias("cutoff"), "sample", "label", p[0].alias("pc1"), p[1].alias("pc2"), F.lit(float(e[0])).alias("explained1"), F.lit(float(e[1])).alias("explained2"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no cutoff leaves two features")
    return out
