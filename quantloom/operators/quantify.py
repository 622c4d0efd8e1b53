"""From features to a higher level: the sum, mean or median of the largest values, or profiles of pairwise ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut

LEVELS = {"protein": "Protein", "peptide": "PeptideSequence", "precursor": "PrecursorId"}


def level_column(features: DataFrame, level: str) -> str:
    name = LEVELS.get(level, level)
    if name not in features.columns:
        raise ValueError(f"no level {level!r}: features have no column {name!r}")
    return name


def top_n(cells: DataFrame, features: DataFrame, level: str = "protein", n: int = 1, method: str = "sum") -> DataFrame:
    """(key, sample, value) of the n largest values of each key and sample. Missing counts as zero when values are
    ranked and as missing when they are summed up; a sum of nothing is zero, a mean or median of nothing is missing.

    Values are ranked within (key, sample), so no task holds more than one key's values of one sample.
    """
    if method not in ("sum", "mean", "median"):
        raise ValueError(f"unknown summarization method {method!r}; known: sum, mean, median")
    key = level_column(features, level)
    rows = cells.join(features.select("row_id", F.col(f"`{key}`").alias("key")), "row_id")
    if n == 1:  # a maximum needs no sorting, and tasks reduce their rows before the shuffle
        top = rows.groupBy("key", "sample").agg(F.max(F.coalesce(F.col("value"), F.lit(0.0))).alias("v"))
        return top.select("key", "sample", (F.col("v") if method == "sum" else F.nullif("v", F.lit(0.0))).alias("value"))
    w = Window.partitionBy("key", "sample").orderBy(F.coalesce(F.col("value"), F.lit(0.0)).desc())
    best = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("value", F.nullif(F.col("value"), F.lit(0.0)))
    how = {"sum": F.coalesce(F.sum("value"), F.lit(0.0)), "mean": F.avg("value"), "median": F.median("value")}[method]
    return best.groupBy("key", "sample").agg(how.alias("value"))


def lfq_order(cells: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """(row_id, key, rank): a key's features by mean abundance, largest first, then by row_id."""
    means = cells.groupBy("row_id").agg(F.avg("value").alias("mean"))
    rows = features.select("row_id", F.col(f"`{key}`").alias("key")).where("key IS NOT NULL").join(means, "row_id")
    return rows.select("row_id", "key", F.row_number().over(Window.partitionBy("key").orderBy(F.desc_nulls_last("mean"), "row_id")).alias("rank"))


def lfq_rows(cells: DataFrame, features: DataFrame, key: str, top_n: int = 0, minimum_subgroups: int = 1) -> DataFrame:
    """(key, row_id, sample, value): the observed values of the top_n features (0: all) of each key that keeps at least
    minimum_subgroups features with values."""
    ranked = lfq_order(cells, features, key)
    kept = ranked.where(F.col("rank") <= top_n) if top_n else ranked
    rows = cells.where("value IS NOT NULL").join(kept.select("row_id", "key"), "row_id")
    if minimum_subgroups <= 1:
        return rows.select("key", "row_id", "sample", "value")
    enough = rows.groupBy("key").agg(F.count_distinct("row_id").alias("n")).where(F.col("n") >= minimum_subgroups).select("key")
    return rows.join(enough, "key", "left_semi").select("key", "row_id", "sample", "value")


def lfq_ratios(rows: DataFrame) -> DataFrame:
    """(key, i, j, ratio): the median of x_i - x_j over the features that both samples have. A feature gives its own
    pairs of samples from one array, without a join, and each pair once; the other direction is its negative."""
    one = rows.groupBy("key", "row_id").agg(F.collect_list(F.struct("sample", "value")).alias("a"))
    pair = one.select("key", F.explode("a").alias("p"), "a").select("key", "p", F.explode(F.filter("a", lambda q: q["sample"] > F.col("p.sample"))).alias("q"))
    half = pair.groupBy("key", F.col("p.sample").alias("i"), F.col("q.sample").alias("j")).agg(F.median(F.col("p.value") - F.col("q.value")).alias("ratio"))
    both = F.array(F.struct("i", "j", "ratio"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("ratio")).alias("ratio")))
    return half.select("key", F.explode(both).alias("x")).select("key", "x.i", "x.j", "x.ratio")


def lfq_graph(rows: DataFrame, order: DataFrame) -> DataFrame:
    """(key, sample, seed, n): each sample's group and its size. In the order of the samples, each one that no group
    has yet takes all samples it shares a feature with, also such that an earlier group had."""
    placed = rows.join(F.broadcast(order), "sample")
    sets = placed.groupBy("key", "row_id").agg(F.collect_set("sample_ord").alias("a"))
    # distinct pairs of samples first, so that no group holds more than the samples there are
    met = sets.select("key", F.explode("a").alias("s"), "a").select("key", "s", F.explode("a").alias("t")).distinct()
    near = met.groupBy("key", "s").agg(F.array_sort(F.collect_list("t")).alias("near"))
    lists = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("s", "near"))).alias("all"))
    empty = F.struct(F.array().cast("array<int>").alias("seen"), F.array().cast("array<struct<seed:int,near:array<int>>>").alias("groups"))
    step = lambda st, x: F.when(F.array_contains(st["seen"], x["s"]), st).otherwise(F.struct(F.array_union(st["seen"], x["near"]).alias("seen"), F.concat(st["groups"], F.array(F.struct(x["s"].alias("seed"), x["near"].alias("near")))).alias("groups")))
    groups = lists.select("key", F.explode(F.aggregate("all", empty, step, lambda st: st["groups"])).alias("g"))
    member = groups.select("key", F.explode("g.near").alias("sample_ord"), F.col("g.seed").alias("seed"), F.col("g.near").alias("members"))
    last = member.groupBy("key", "sample_ord").agg(F.max_by(F.struct("seed", "members"), "seed").alias("g"))
    return last.join(F.broadcast(order), "sample_ord").select("key", "sample", "g.seed", "g.members")


def maxlfq(cells: DataFrame, features: DataFrame, samples: DataFrame, level: str = "protein", top_n: int = 0, minimum_subgroups: int = 1) -> DataFrame:
    """(key, sample, value): profiles that fit all pairwise median ratios by least squares, with the group's mean kept.

    The least-squares system has the complete graph's Laplacian whatever ratios are missing, so its solution is the
    group's mean plus each sample's mean ratio to the others, a missing ratio being zero. A profile of exactly zero is
    missing. A key of one sample gets its median.
    """
    key = level_column(features, level)
    order = samples.select("sample", F.col("sample_ord").cast("int").alias("sample_ord"))
    rows = cut(lfq_rows(cells, features, key, top_n, minimum_subgroups))  # read by each step below
    graph = lfq_graph(rows, order)
    ratios = lfq_ratios(rows).join(F.broadcast(order.select(F.col("sample").alias("j"), F.col("sample_ord").alias("jo"))), "j")
    inside = graph.join(ratios, (graph["key"] == ratios["key"]) & (graph["sample"] == ratios["i"]), "left").select(graph["key"], "sample", "seed", "members", F.when(F.array_contains("members", F.col("jo")), F.col("ratio")).alias("ratio"))
    pull = inside.groupBy("key", "sample", "seed").agg((F.coalesce(F.sum("ratio"), F.lit(0.0)) / F.first(F.size("members"))).alias("pull"), F.first("members").alias("members"))
    groups = pull.select("key", "seed", "members").distinct().select("key", "seed", F.explode("members").alias("sample_ord"), F.size("members").alias("n"))
    level_of = rows.join(F.broadcast(order), "sample").join(groups, ["key", "sample_ord"]).groupBy("key", "seed", "n").agg(F.avg("value").alias("mean"), F.median("value").alias("middle"))
    out = pull.drop("members").join(level_of, ["key", "seed"]).select("key", "sample", F.when(F.col("n") == 1, F.col("middle")).otherwise(F.nullif(F.col("mean") + F.col("pull"), F.lit(0.0))).alias("value"))
    return out


def lfq_annotate(profiles: DataFrame, features: DataFrame, level: str) -> DataFrame:
    """(key and its annotations): of a peptide one row per protein, of another level the feature with the smallest row_id."""
    key = level_column(features, level)
    keys = profiles.select("key").distinct()
    by = [key, "Protein"] if level == "peptide" and "Protein" in features.columns else [key]
    rest = [c for c in features.columns if c not in by]
    one = features.groupBy(*by).agg(F.min_by(F.struct(*rest), "row_id").alias("r")).select(*by, "r.*")
    return one.join(keys, F.col(f"`{key}`") == F.col("key"), "left_semi")
