"""Normalisation of samples: a statistic per sample, broadcast as one factor per sample (or per window and sample)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut
from .annotate import sized

#: statistic of a sample, and how the samples' statistics become their common centre
STATISTICS = {"tic": (F.sum, F.median), "median": (F.median, F.avg), "mean": (F.avg, F.avg)}


def log2(cells: DataFrame) -> DataFrame:
    """Null for values of zero and below."""
    return cells.withColumn("value", F.log2(F.col("value")))


def factors(cells: DataFrame, method: str) -> DataFrame:
    """(sample, factor). There are as many rows as samples, which a matrix's design bounds."""
    statistic, centre = STATISTICS[method]
    stat = cells.groupBy("sample").agg(statistic(F.col("value")).alias("stat"))
    # a sample without values leaves no centre for the methods that take a plain mean
    whole = F.lit(True) if method == "tic" else F.count("stat") == F.count(F.lit(1))
    return stat.crossJoin(F.broadcast(stat.agg(F.when(whole, centre("stat")).alias("centre")))).select("sample", F.try_divide(F.col("centre"), F.col("stat")).alias("factor"))


def by_sample(cells: DataFrame, method: str) -> DataFrame:
    return cells.join(F.broadcast(factors(cells, method)), "sample").withColumn("value", F.col("value") * F.col("factor")).drop("factor")


def rt_bins(features: DataFrame, stride: float = 1.0, rt_unit: str = "minute", rt_column: str = "RetentionTime") -> DataFrame:
    """(row_id, bin, n_bins) of each feature with a retention time; equal times make a single bin."""
    rt = F.col(rt_column) / (60.0 if rt_unit == "seconds" else 1.0)
    rows = features.where(F.col(rt_column).isNotNull()).select("row_id", rt.alias("rt"))
    span = rows.agg(F.min("rt").alias("lo"), F.max("rt").alias("hi"))
    n = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / stride), F.lit(1))
    return rows.crossJoin(F.broadcast(span)).select("row_id", F.least(F.floor((F.col("rt") - F.col("lo")) / stride), n - 1).alias("bin"), n.alias("n_bins"))


def rt_expand(bins: DataFrame, minimum: int = 100) -> DataFrame:
    """(bin, radius, n_bins): how many bins on either side a bin takes in to hold `minimum` features. Rows: the bins.

    The features up to each bin are counted once; a bin's radius is found among these sums by halving.
    """
    filled = bins.groupBy("bin").agg(F.count("*").alias("n"))
    every = bins.agg(F.max("n_bins").alias("n_bins")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin"), "n_bins")
    upto = every.join(filled, "bin", "left").select("bin", "n_bins", F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("bin")).alias("c"))  # over the bins
    sums = cut(upto.agg(F.first("n_bins").alias("n_bins"), F.transform(F.array_sort(F.collect_list(F.struct("bin", "c"))), lambda x: x["c"]).alias("c")))
    rows = sums.select(F.posexplode("c").alias("bin", "own"), "n_bins", "c").drop("own").withColumn("bin", F.col("bin").cast("long"))
    at = lambda k: F.when(k < 0, F.lit(0)).otherwise(F.get("c", k.cast("int")))
    held = lambda r: at(F.least(F.col("bin") + r, F.col("n_bins") - 1)) - at(F.greatest(F.col("bin") - r, F.lit(0)) - 1)

    def halve(s: F.Column, _: F.Column) -> F.Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2)
        enough = held(mid) >= minimum
        return F.struct(F.when(enough, s["lo"]).otherwise(F.least(mid + 1, s["hi"])).alias("lo"), F.when(enough, mid).otherwise(s["hi"]).alias("hi"))

    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.col("n_bins").cast("double"))).cast("int") + 1)
    first = F.struct(F.lit(0).cast("long").alias("lo"), (F.col("n_bins") - 1).alias("hi"))
    return rows.select("bin", F.aggregate(turns, first, halve, lambda s: s["hi"]).alias("radius"), "n_bins")


def rt_pieces(expanded: DataFrame, overlapping: bool = True) -> DataFrame:
    """(window, first, last, times): the bins of each window, a window being a bin with its neighbours' reach, as runs of
    bins that count equally often: five at most, whatever the reach."""
    reach = 1 if overlapping else 0
    near = F.sequence(F.greatest(F.col("bin") - reach, F.lit(0)), F.least(F.col("bin") + reach, F.col("n_bins") - 1))
    covers = expanded.select(F.explode(near).alias("window"), F.greatest(F.col("bin") - F.col("radius"), F.lit(0)).alias("from"), (F.least(F.col("bin") + F.col("radius"), F.col("n_bins") - 1) + 1).alias("to"))
    steps = covers.select("window", F.explode(F.array(F.struct(F.col("from").alias("at"), F.lit(1).alias("up")), F.struct(F.col("to").alias("at"), F.lit(-1).alias("up")))).alias("x"))
    steps = steps.groupBy("window", "x.at").agg(F.sum("x.up").alias("up"))
    w = Window.partitionBy("window").orderBy("at")  # six rows a window
    runs = steps.select("window", F.col("at").alias("first"), (F.lead("at").over(w) - 1).alias("last"), F.sum("up").over(w).alias("times"))
    return runs.where("times > 0")


def rt_overlap(expanded: DataFrame, overlapping: bool = True) -> DataFrame:
    """(window, bin, times): how often each bin counts in each window."""
    return rt_pieces(expanded, overlapping).select("window", F.explode(F.sequence("first", "last")).alias("bin"), "times")


def rt_factors(cells: DataFrame, bins: DataFrame, pieces: DataFrame, method: str) -> DataFrame:
    """(bin, sample, factor): the mean of a bin's windows' factors, by how often it counts in each. pieces: rt_pieces.

    Sums over a window are differences of sums up to a bin, and what the windows give their bins is added up where their
    pieces begin and taken off where they end: nothing has a row for each bin of each window, but values for medians.
    """
    held, pieces = cells.join(bins.select("row_id", "bin"), "row_id"), cut(pieces)
    centre, samples = STATISTICS[method][1], cells.select("sample").distinct()
    if method == "median":
        at = held.join(sized(pieces.select("window", F.explode(F.sequence("first", "last")).alias("bin"), "times")), "bin").where("value IS NOT NULL")
        stat = at.groupBy("window", "sample").agg(F.expr("percentile(value, 0.5, times)").alias("stat"))
    else:
        own = held.groupBy("bin", "sample").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
        ends = pieces.select("window", F.explode(F.array(F.struct((F.col("first") - 1).alias("bin"), (-F.col("times")).alias("k")), F.struct(F.col("last").alias("bin"), F.col("times").alias("k")))).alias("x")).select("window", "x.*")
        # a piece's end meets the sums up to it: both are rows of a sample's bins in order, so no join is needed
        asked = ends.crossJoin(F.broadcast(samples)).select("sample", "bin", "window", "k", F.lit(None).cast("double").alias("s"), F.lit(None).cast("long").alias("n"))
        rows = asked.unionByName(own.select("sample", "bin", F.lit(None).cast("long").alias("window"), F.lit(None).cast("long").alias("k"), "s", "n"))
        upto = Window.partitionBy("sample").orderBy("bin")  # a sample's bins and pieces
        summed = rows.select("sample", "window", "k", F.coalesce(F.sum("s").over(upto), F.lit(0.0)).alias("s"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n")).where("window IS NOT NULL")
        totals = summed.groupBy("window", "sample").agg(F.sum(F.col("s") * F.col("k")).alias("s"), F.sum(F.col("n") * F.col("k")).alias("n")).where("n > 0")
        stat = totals.select("window", "sample", (F.col("s") if method == "tic" else F.col("s") / F.col("n")).alias("stat"))
    grid = pieces.select("window").distinct().crossJoin(F.broadcast(samples)).join(stat, ["window", "sample"], "left")
    # a sample without values in a window leaves no centre for the methods that take a plain mean
    centres = grid.groupBy("window").agg(centre("stat").alias("centre"), (F.count("stat") == F.count(F.lit(1))).alias("whole"))
    centred = grid.join(sized(cut(centres)), "window").where(F.lit(method == "tic") | F.col("whole"))
    factor = centred.select("window", "sample", F.try_divide(F.col("centre"), F.col("stat")).alias("factor")).where("factor IS NOT NULL")
    given = pieces.join(factor, "window").select("sample", F.col("times").alias("k"), (F.col("times") * F.col("factor")).alias("v"), F.array(F.struct(F.col("first").alias("bin"), F.lit(1).alias("up")), F.struct((F.col("last") + 1).alias("bin"), F.lit(-1).alias("up"))).alias("e"))
    steps = given.select("sample", "k", "v", F.explode("e").alias("e")).groupBy("sample", "e.bin").agg(F.sum(F.col("k") * F.col("e.up")).alias("k"), F.sum(F.col("v") * F.col("e.up")).alias("v"))
    rows = steps.select("sample", "bin", "k", "v", F.lit(False).alias("asked")).unionByName(held.select("sample", "bin").distinct().select("sample", "bin", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("v"), F.lit(True).alias("asked")))
    upto = Window.partitionBy("sample").orderBy("bin")
    run = rows.select("sample", "bin", "asked", F.sum("k").over(upto).alias("k"), F.sum("v").over(upto).alias("v"))
    return run.where("asked AND k > 0").select("bin", "sample", (F.col("v") / F.col("k")).alias("factor"))


def by_rt_window(cells: DataFrame, features: DataFrame, method: str, minimum: int = 100, stride: float = 1.0, overlapping: bool = True, rt_unit: str = "minute", rt_column: str = "RetentionTime") -> DataFrame:
    """The base method in each window of retention time, averaged over all windows that a feature appears in."""
    bins = rt_bins(features, stride, rt_unit, rt_column)
    table = rt_factors(cells, bins, rt_pieces(rt_expand(bins, minimum), overlapping), method)
    placed = cells.join(bins.select("row_id", "bin"), "row_id", "left")
    return placed.join(sized(cut(table)), ["bin", "sample"], "left").select("row_id", "sample", (F.col("value") * F.col("factor")).alias("value"))


def normalize(cells: DataFrame, method: str, log_transform: bool = True, features: DataFrame | None = None, use_rt_sliding_window_filter: bool = False, **window) -> DataFrame:
    """method: log2, or tic, median or mean, then log2 unless log_transform is off."""
    if method == "log2":
        return log2(cells)
    if method not in STATISTICS:
        raise ValueError(f"unknown normalisation method {method!r}; known: log2, {', '.join(STATISTICS)}")
    if use_rt_sliding_window_filter and features is None:
        raise ValueError("windows of retention time need the features")
    out = by_rt_window(cells, features, method, **window) if use_rt_sliding_window_filter else by_sample(cells, method)
    return log2(out) if log_transform else out


def correct_mean(cells: DataFrame, samples: DataFrame, reference_batch) -> DataFrame:
    """Each feature's batch gets the mean and spread of the reference batch. Raises ValueError if no sample is of it."""
    if not samples.where(F.col("batch") == F.lit(reference_batch)).limit(1).count():
        raise ValueError(f"no sample is of batch {reference_batch!r}")
    placed = cells.join(F.broadcast(samples.select("sample", "batch")), "sample")
    own = Window.partitionBy("row_id", "batch")
    whole = Window.partitionBy("row_id")
    ref = F.when(F.col("batch") == F.lit(reference_batch), F.col("value"))
    moved = (F.col("value") - F.avg(F.col("value")).over(own)) * F.try_divide(F.stddev_pop(ref).over(whole), F.stddev_pop(F.col("value")).over(own)) + F.avg(ref).over(whole)
    return placed.select("row_id", "sample", moved.alias("value"))


def correct(cells: DataFrame, samples: DataFrame, method: str = "mean", reference_batch=None) -> DataFrame:
    if method != "mean":
        raise ValueError(f"unknown correction method {method!r}; known: mean")
    return correct_mean(cells, samples, reference_batch)
