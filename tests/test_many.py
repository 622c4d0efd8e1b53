"""Many fits in one pass against the same fits one by one."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from quantloom.functions.storage import cut
from quantloom.operators import decoys, learn, many


class OneByOne(LogisticRegression):
    """A classifier that isn't known to be a logistic regression, so that each of its models is fitted by itself."""


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(54, 5))
    y = (x[:, 1] - 0.7 * x[:, 3] + rng.normal(scale=0.9, size=54) > 0).astype(float)
    x[:, 4] = 2.0  # says nothing
    x[:, 2] *= 30
    df = spark.createDataFrame([(f"s{i:03d}", float(b), a.tolist(), 1.0 + i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))], "sample string, label double, v array<double>, weight double")
    return cut(df.withColumn("features", array_to_vector("v")).drop("v"))


def test_fits_equal_mllibs(spark, rows):
    dealt = cut(learn.folds(rows, 3))
    packed = cut(many.packed(dealt, F.array(*[F.when(F.col("fold") != i, F.col("weight")).otherwise(0.0) for i in range(3)]), F.array(*[(F.col("fold") == i).cast("double") for i in range(3)]), F.col("weight")))
    own = [dict(regParam=r, elasticNetParam=m, standardization=s, fitIntercept=i) for r, m, s, i in ((0.01, 0.0, True, True), (0.1, 0.5, True, True), (0.05, 1.0, True, True), (0.1, 0.0, False, True), (0.2, 0.3, False, True), (0.1, 0.0, True, False))]
    clfs = [LogisticRegression(maxIter=500, tol=1e-13, weightCol="weight", **kw) for kw in own]
    fits = [many.fit_of(c, i) for c in clfs for i in range(3)] + [many.Fit(1, 0.1, 0.0, (1, 3))]
    found = many.fit_many(packed, fits)
    at = 0
    for c in clfs:
        for i in range(3):
            model = c.fit(dealt.where(F.col("fold") != i))
            assert np.allclose(found[at, :-1], model.coefficients.toArray(), atol=2e-5) and abs(found[at, -1] - model.intercept) < 2e-5, (at, c.extractParamMap())
            at += 1
    assert np.all(found[at, [0, 2, 4]] == 0) and np.all(found[:, 4] == 0)
    for k, f in enumerate(fits):  # whatever else is fitted with it
        if k % 4 == 0:
            assert np.allclose(many.fit_many(packed, [f])[0], found[k], atol=1e-9)
    right = many.score_many(packed, fits[:3])
    for i in range(3):
        model = clfs[0].fit(dealt.where(F.col("fold") != i))
        for name in many.SCORES:
            assert abs(learn.score_of(model, dealt.where(F.col("fold") == i), name) - many.score_many(packed, fits[i : i + 1], name)[0]) < 1e-4
    assert np.all((right > 0.4) & (right <= 1))


def jobs(spark, what):
    spark.sparkContext.setJobGroup(f"counted-{what}", "")
    try:
        what()
    finally:
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"counted-{what}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def test_a_search_takes_as_many_jobs_whatever_its_candidates(spark, rows):
    grid = {"regParam": [0.003 * 2**k for k in range(12)]}
    make = lambda **kw: LogisticRegression(maxIter=300, tol=1e-12, **kw)
    few, most = (jobs(spark, lambda n=n: learn.search_random(rows, make, grid, n, 3)) for n in (2, 16))
    assert most <= 1.5 * few
    found = learn.search_random(rows, make, grid, 4, 3)
    slow = learn.search_random(rows, lambda **kw: OneByOne(maxIter=300, tol=1e-12, **kw), grid, 4, 3)
    assert [s for s, _ in found.history[0]] == pytest.approx([s for s, _ in slow.history[0]]) and found.best_params == slow.best_params
    told = learn.search_genetic(rows, make, grid, 2, 3, 1, scoring="f1")
    assert len(told.history) == 2 and told.best_score == max(s for h in told.history for s, _ in h)


def test_resamples_as_weights_equal_resamples_as_rows(spark, rows):
    kw = dict(maxIter=300, tol=1e-13, regParam=0.1)
    for downsample in (True, False):
        fast = {(r["iteration"], r["k"]): r for r in learn.bootstrap_importance(rows, 3, downsample, 2, 5, LogisticRegression(**kw)).collect()}
        slow = {(r["iteration"], r["k"]): r for r in learn.bootstrap_importance(rows, 3, downsample, 2, 5, OneByOne(**kw)).collect()}
        assert set(fast) == set(slow) and len(fast) == 15
        for k, r in fast.items():
            assert abs(r["importance"] - slow[k]["importance"]) < 1e-5 and r["rank"] == slow[k]["rank"]


def test_elimination_of_all_resamples_equals_that_of_each(spark, rows):
    kw = dict(maxIter=300, tol=1e-13, regParam=0.1)
    for how in (dict(), dict(downsample_rate=0.6, replace=False, scoring="balanced_accuracy")):
        fast = sorted(map(tuple, learn.bootstrap_rfe(rows, 2, 2, 2, 1, LogisticRegression(**kw), **how).collect()))
        slow = sorted(map(tuple, learn.bootstrap_rfe(rows, 2, 2, 2, 1, OneByOne(**kw), **how).collect()))
        assert [r[:4] for r in fast] == [r[:4] for r in slow] and [r[4] for r in fast] == pytest.approx([r[4] for r in slow])
        assert {r[3] for r in fast} == {5, 3, 2}
    with pytest.raises(ValueError):
        learn.bootstrap_rfe(rows, 1, scoring="none")


def test_resamples_without_replacement(spark, rows):
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    got = learn.bootstrap_resample(rows, 4, 0, 0.5, False).collect()
    for i in range(4):
        for y, m in n.items():
            drawn = [r["sample"] for r in got if r["iteration"] == i and r["label"] == y]
            assert len(drawn) == len(set(drawn)) == m // 2
    assert learn.bootstrap_resample(rows, 2, 0, 0.001).count() == 4


def test_subsets_are_scored_together_and_other_classifiers_one_by_one(spark, rows):
    ranks = spark.createDataFrame([(k, float(r)) for k, r in enumerate((3, 1, 5, 2, 4))], "k int, adjusted_rank double")
    kw = dict(maxIter=300, tol=1e-13, regParam=0.1)
    fast = learn.rfe_evaluate(rows, ranks, [0.5, 1.0, 3.0, 9.0], LogisticRegression(**kw))
    slow = learn.rfe_evaluate(rows, ranks, [0.5, 1.0, 3.0, 9.0], OneByOne(**kw))
    assert [x[:2] for x in fast] == [x[:2] for x in slow] == [(1.0, 1), (3.0, 3), (9.0, 5)] and [x[2] for x in fast] == pytest.approx([x[2] for x in slow])
    assert len(learn.cross_scores(DecisionTreeClassifier(maxDepth=2), rows, 3, scoring="recall")) == 3


def test_trees_score_again_only_what_they_split_on(spark, rows):
    """The features that no tree splits on have exactly 0, and all have what scoring every feature gives."""
    from pyspark.ml.classification import RandomForestClassifier

    for clf in (DecisionTreeClassifier(maxDepth=2), RandomForestClassifier(numTrees=3, maxDepth=2, seed=1)):
        model = clf.fit(rows)

        class Hidden:  # no tree can be seen in it
            transform = staticmethod(model.transform)

        used = learn.split_features(model)
        fast = {(r["k"], r["sample"]): r["value"] for r in learn.local_importance(rows, model, 2).collect()}
        slow = {(r["k"], r["sample"]): r["value"] for r in learn.local_importance(rows, Hidden(), 2).collect()}
        assert 0 < len(used) < 5 and set(fast) == set(slow) and all(abs(v - slow[k]) < 1e-12 for k, v in fast.items())
        assert all(v == 0 for (k, _), v in fast.items() if k not in used)


def test_shuffles_of_many_samples_take_room_in_proportion(spark):
    """20,000 samples: an array of all of a feature's values in each row would take 10 GB."""
    n = 20_000
    df = spark.range(n, numPartitions=4).select(F.format_string("s%06d", "id").alias("sample"), (F.col("id") % 2).cast("double").alias("label"), array_to_vector(F.array(F.col("id").cast("double"), F.col("id") % 7 * 1.0)).alias("features"))
    got = learn.shuffled(learn.long_rows(df), 2, 5).where("k = 0").orderBy("x").collect()
    u = {i: {r["x"]: r["u"] for r in df.select(F.col("sample"), F.lit(0).alias("k"), F.substring("sample", 2, 6).cast("double").alias("x")).withColumn("u", learn.uniform("k", "sample", seed=5 + i, salt="shuffle")).collect()} for i in range(2)}
    for i in range(2):
        assert [r["y"][i] for r in got] == sorted(u[i], key=lambda x: (u[i][x], x))
    assert learn.bootstrap_importance(df, 2, shuffles=2).count() == 4


def test_decoys_of_many_samples_take_room_in_proportion(spark):
    cells = spark.range(60_000, numPartitions=4).select((F.col("id") % 3).alias("row_id"), F.format_string("s%06d", "id").alias("sample"), F.col("id").cast("double").alias("value"))
    got = decoys.decoy_shuffle(cells)
    drawn = cells.where("row_id = 1").orderBy(F.md5(F.concat_ws("|", "row_id", "sample", F.lit(0))), "sample")
    assert [r["value"] for r in got.where("row_id = 1").orderBy("sample").collect()] == [r["value"] for r in drawn.collect()]
    assert got.count() == 60_000


def test_levels_of_an_elimination_begin_where_the_last_one_ended(spark, rows):
    packed = many.packed(rows, F.array(F.lit(1.0)), F.array(F.lit(0.0))).cache()
    width = len(rows.first()["features"])
    fewer = [many.Fit(0, 0.01, 0.0, tuple(range(width - 1)))]
    moments, models = many.moments_of(packed), many.fit_many(packed, [many.Fit(0, 0.01)])
    found = {}
    cold = jobs(spark, lambda: found.update(cold=many.fit_many(packed, fewer)))
    warm = jobs(spark, lambda: found.update(warm=many.fit_many(packed, fewer, start=models, moments=moments)))
    assert np.allclose(found["cold"], found["warm"], atol=1e-7) and found["warm"][0, width - 1] == 0
    assert warm < cold
    steps = jobs(spark, lambda: found.update(rfe=learn.bootstrap_rfe(rows, 2, 1, 1, classifier=LogisticRegression(regParam=0.01))))
    assert steps <= 50 and found["rfe"].count() == 2 * width
