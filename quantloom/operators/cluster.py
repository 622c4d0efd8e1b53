"""Clusters of features by rank correlation, with a cutoff calibrated on decoys.

The distance of two features is one less their absolute rank correlation. Their rank vectors have length one, so the angle
between the lines that they span is a metric, and the distance grows with it. Features are dealt into blocks around a few
pivots; a block knows the least and greatest angle of its features to each pivot. By the triangle inequality a feature is
only sent to blocks that can hold what is asked for: another one within a distance, or one nearer than the nearest so far.
The result is that of all pairs, however many are met.

Ward's linkage is done in rounds. It never brings clusters closer by merging others (it is reducible), so all pairs of
clusters that are each other's nearest merge at once, as they would one after another; their distance follows from the
sums of squared distances between and within them, which are added up as clusters merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import Tables, cut
from .decoys import decoy_shuffle, qvalue_counter, running

#: Features of a block (two of which a task holds at a time), and the most blocks, whose angles every task has.
BLOCK, BLOCKS = 1000, 100_000
#: Pivots, the vectors and numbers of a sample that they are chosen from (a block holds as many numbers, too), and what
#: rounding may do to an angle.
PIVOTS, SAMPLE, NUMBERS, MARGIN = 16, 1000, 4_000_000, 1e-6
#: Decimals of distances, and of squared ones in Ward's linkage, so that ties stay ties.
DECIMALS = 12


def ranks(cells: DataFrame) -> DataFrame:
    """(row_id, sample, r): average ranks within each feature, centred and scaled so that products sum to Spearman's rho."""
    w, tie = Window.partitionBy("row_id"), Window.partitionBy("row_id", "value")
    r = cells.select("row_id", "sample", (F.rank().over(w.orderBy("value")) + (F.count("*").over(tie) - 1) / 2).alias("r"))
    c = r.withColumn("r", F.col("r") - F.avg("r").over(w))
    return c.withColumn("r", F.try_divide(F.col("r"), F.sqrt(F.sum(F.col("r") * F.col("r")).over(w))))


def vectors(cells: DataFrame) -> DataFrame:
    """(row_id, v): each feature's ranks in the order of the samples; zeros where all its values are equal. The features
    must have a value for every sample: ranks over different samples can't be compared."""
    sizes = cells.groupBy("row_id").agg(F.count("value").alias("n"))
    samples = cells.agg(F.count_distinct("sample")).first()[0]
    if lacking := sizes.where(F.col("n") != samples).count():
        raise ValueError(f"{lacking} features lack values of some of the {samples} samples; impute or filter them first")
    whole = F.array_sort(F.collect_list(F.struct("sample", F.coalesce("r", F.lit(0.0)).alias("r"))))
    return cut(ranks(cells).groupBy("row_id").agg(F.transform(whole, lambda x: x["r"]).alias("v")))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.abs(a @ b.T), 0, 1))


class Index:
    """Vectors in blocks. `placed` is (row_id, v, t, block), t being the angles to the pivots; `low` and `high` have a
    row of least and greatest angles for each of `ids`."""

    def __init__(self, vecs: DataFrame, rows: int = BLOCK):
        n = vecs.count()
        width = vecs.select(F.size("v")).first()
        held = NUMBERS // max(1, width[0] if width else 1)
        self.rows, most = max(1, min(rows, held), -(-n // BLOCKS)), max(1, min(SAMPLE, held))
        hashed = vecs.withColumn("h", F.xxhash64("row_id"))
        last = hashed.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
        some = hashed.where(F.col("h") <= F.lit(last)).orderBy("h", "row_id").limit(most).toPandas()["v"]
        pivots = self._pivots(np.stack(some.to_numpy())) if n else np.zeros((1, 1))

        @F.pandas_udf("array<double>")
        def to_pivots(v: pd.Series) -> pd.Series:
            return pd.Series([angles(x[None], pivots)[0] for x in v])

        seen = vecs.withColumn("t", to_pivots("v"))
        seen = cut(seen.withColumn("near", F.array_position("t", F.array_min("t")).cast("long")))
        parts = seen.groupBy("near").agg(F.ceil(F.count("*") / self.rows).alias("parts"))  # a row a pivot
        part = F.pmod(F.xxhash64("row_id"), F.col("parts"))
        self.placed = seen.join(F.broadcast(parts), "near").select("row_id", "v", "t", (F.col("near") * (1 << 40) + part).alias("block"))
        ends = [f(F.col("t")[k]) for f in (F.min, F.max) for k in range(len(pivots))]
        blocks = self.placed.groupBy("block").agg(*ends).orderBy("block").toPandas().to_numpy(float)  # a row a block
        self.ids, self.low, self.high = blocks[:, 0].astype(np.int64), blocks[:, 1 : 1 + len(pivots)], blocks[:, 1 + len(pivots) :]

    @staticmethod
    def _pivots(v: np.ndarray) -> np.ndarray:
        """Each as far as can be from those before."""
        chosen, far = [0], angles(v, v[:1])[:, 0]
        while len(chosen) < min(PIVOTS, len(v)):
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, angles(v, v[chosen[-1:]])[:, 0])
        return v[chosen]

    def visits(self, rows: DataFrame, which: str) -> DataFrame:
        """(row_id, block): the blocks that rows (of placed, with an angle `reach`) must be sent to, as they may hold
        a feature within reach. which: their "own" block, all "other" blocks, or "later" ones, so that two blocks meet once."""
        ids, low, high = self.ids, self.low, self.high

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for i in range(0, len(whole), 200):
                    pdf = whole.iloc[i : i + 200]
                    t, reach, own = np.stack(pdf["t"].to_numpy()), pdf["reach"].to_numpy()[:, None] + MARGIN, pdf["block"].to_numpy()[:, None]
                    go = own < ids if which == "later" else own != ids
                    for k in range(t.shape[1]):
                        go &= (low[:, k] - t[:, k, None] <= reach) & (t[:, k, None] - high[:, k] <= reach)
                    a, b = np.nonzero(go)
                    yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy()[a], "block": ids[b]})

        # the vectors, long ones maybe, stay where they are until blocks meet
        if which == "own":
            return rows.select("row_id", "block")
        return rows.select("row_id", "t", "reach", "block").mapInPandas(send, rows.select("row_id", "block").schema)

    def meet(self, visits: DataFrame, reduce, schema: str) -> DataFrame:
        """What `reduce` makes of (the visitors' ids, a block's ids, their distances, infinite for a feature and itself).
        Visitors come in groups of the size of a block, each of which gets the block; of long vectors fewer make one."""
        visits = cut(visits)
        groups = visits.groupBy("block").agg(F.ceil(F.count("*") / self.rows).cast("int").alias("parts"))
        guests = visits.join(groups, "block").join(self.placed.select("row_id", "v"), "row_id").select("block", F.pmod(F.hash("row_id"), F.col("parts")).alias("part"), "row_id", "v", F.lit(False).alias("home"))
        homes = self.placed.join(groups, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "row_id", "v", F.lit(True).alias("home"))

        def near(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf[~pdf["home"]], pdf[pdf["home"]]
            if a.empty:
                return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
            d = np.clip(1 - np.abs(np.stack(a["v"].to_numpy()) @ np.stack(b["v"].to_numpy()).T), 0, 1).round(DECIMALS)
            i, j = a["row_id"].to_numpy(), b["row_id"].to_numpy()
            d[i[:, None] == j[None]] = np.inf
            return reduce(i, j, d)

        return guests.unionByName(homes).groupBy("block", "part").applyInPandas(near, schema)

    def met(self, visits: DataFrame) -> int:
        """How many pairs the visits meet."""
        sizes = self.placed.groupBy("block").agg(F.count("*").alias("n"))
        return visits.groupBy("block").agg(F.count("*").alias("m")).join(sizes, "block").agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0))).first()[0]


def angle_of(distance: float | F.Column) -> F.Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (F.lit(distance) if isinstance(distance, float | int) else distance))))


def pairs_within(index: Index, within: float | None = None) -> DataFrame:
    """(a, b, distance) with a < b of the index's features, those not further apart than `within`."""

    def pairs(once: bool):
        def keep(i, j, d):
            wanted = np.isfinite(d) & (d <= (np.inf if within is None else within))
            if once:  # a block meets itself, so each pair twice
                wanted &= i[:, None] < j[None]
            m, n = np.nonzero(wanted)
            return pd.DataFrame({"a": np.minimum(i[m], j[n]), "b": np.maximum(i[m], j[n]), "distance": d[m, n]})

        return keep

    rows, schema = index.placed.withColumn("reach", F.lit(math.pi) if within is None else angle_of(float(within))), "a long, b long, distance double"
    return index.meet(index.visits(rows, "own"), pairs(True), schema).unionByName(index.meet(index.visits(rows, "later"), pairs(False), schema))


def spearman(cells: DataFrame, within: float | None = None, rows: int = BLOCK) -> DataFrame:
    """(a, b, distance) with a < b: one less the absolute rank correlation, of all pairs or of those not further apart
    than `within`. Features that lack values are refused."""
    return pairs_within(Index(vectors(cells), rows), within)


def nearest(cells: DataFrame, rows: int = BLOCK) -> DataFrame:
    """(row_id, distance) to the nearest other feature: first within a feature's block, then in blocks that can hold a
    nearer one. Features that lack values are refused."""
    index = Index(vectors(cells), rows)
    first = cut(_nearest_in(index, index.visits(index.placed, "own")))
    best = _nearest_in(index, index.visits(_reaching(index, first), "other"))
    return first.unionByName(best).where("distance <= 1").groupBy("row_id").agg(F.min("distance").alias("distance"))


def _reaching(index: Index, first: DataFrame) -> DataFrame:
    return index.placed.join(first, "row_id").withColumn("reach", angle_of(F.col("distance")))


def _nearest_in(index: Index, visits: DataFrame) -> DataFrame:
    def least(i, j, d):
        return pd.DataFrame({"row_id": i, "distance": d.min(1)})

    return index.meet(visits, least, "row_id long, distance double")


def cutoff(targets: DataFrame, decoys: DataFrame, q_value: float = 0.01) -> DataFrame:
    """(cutoff): the distance with the largest q-value that is at most q_value; null if there is none."""
    scores = targets.withColumn("Decoy", F.lit(0)).unionByName(decoys.withColumn("Decoy", F.lit(1))).withColumn("score", 1 - F.col("distance"))
    q = qvalue_counter(scores).where(F.col("q_value") <= q_value)
    return q.agg(F.max_by("distance", F.struct("q_value", "distance")).alias("cutoff"))


def copies(vecs: DataFrame) -> DataFrame:
    """(row_id, rep, v, n, first): features with the same line, of which the smallest id is `rep`. Constant features
    are no copies, as they correlate with nothing."""
    lead = F.get(F.filter("v", lambda x: x != 0), 0)
    line = F.when(lead < 0, F.transform("v", lambda x: F.lit(0.0) - x)).otherwise(F.transform("v", lambda x: x + F.lit(0.0)))
    keyed = vecs.select("row_id", "v", F.struct(line.alias("line"), F.when(lead.isNull(), F.col("row_id")).alias("own")).alias("key"))
    # the line's hash is only there to meet on: the key itself decides
    reps = keyed.groupBy("key").agg(F.min("row_id").alias("rep"), F.count("*").alias("n"))
    return cut(keyed.join(reps, "key").select("row_id", "rep", "v", F.col("n").cast("double").alias("n"), (F.col("row_id") == F.col("rep")).alias("first")))


def ward(cells: DataFrame, features: DataFrame, height: float | None, rows: int = BLOCK) -> DataFrame:
    """(row_id, FeatureCluster): Ward's linkage cut at a height; null: singletons. Clusters are numbered by their
    smallest feature; of equally distant pairs of clusters that with the smaller features merges first. Features that
    lack values are refused.

    A cluster is named by its smallest feature. Two clusters merge below the height only if a feature of one is that near
    to a feature of the other (else all their distances exceed it, and so does theirs), so only such pairs of clusters are
    kept, as rows: with the sums of squared distances, if known, and those of near features, from which a bound follows.
    Sums are worked out from the vectors where the bound doesn't rule the pair out. No task holds a component's distances.
    """
    ids = features.select("row_id")
    if height is None:
        return _numbered(ids.withColumn("low", F.col("row_id")))
    held = copies(vectors(cells))
    lines = cut(held.where("first").select("row_id", "v", "n"))
    index, top = Index(lines.select("row_id", "v"), rows), round(height * height, DECIMALS)
    near = pairs_within(index, height)
    size = lambda c, n: lines.select(F.col("row_id").alias(c), F.col("n").alias(n))
    d2 = F.col("distance") * F.col("distance") * F.col("na") * F.col("nb")
    links, tables = near.join(size("a", "na"), "a").join(size("b", "nb"), "b"), Tables(features.sparkSession)
    links = tables.keep(links.select("a", "b", d2.alias("near"), (F.col("na") * F.col("nb")).alias("seen"), d2.alias("s")))
    members = lines.select("row_id", F.col("row_id").alias("c"))
    groups = lines.select(F.col("row_id").alias("c"), "n", F.lit(0.0).alias("w"))
    while not links.isEmpty():
        done = len(tables.paths)
        links = tables.keep(_with_sums(links, groups, members, lines, top))
        live = links.where(F.col("d2") <= top)
        ends = live.select(F.explode(F.array("a", "b")).alias("c"), F.struct("d2", "a", "b").alias("pair"), "s")
        best = ends.groupBy("c").agg(F.min(F.struct("pair", "s")).alias("x"))
        # each the other's nearest: both ends have chosen the pair
        merged = best.groupBy(F.col("x.pair.a").alias("to"), F.col("x.pair.b").alias("c"), F.col("x.s").alias("s")).count().where("count = 2").drop("count")
        merged = tables.keep(merged)
        if merged.isEmpty():
            break
        move = lambda df, c: df.join(merged.select(F.col("c").alias(c), F.col("to").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")  # noqa: B023, E731
        within = merged.select(F.col("to").alias("c"), F.lit(0.0).alias("n"), F.col("s").alias("w"))
        members = tables.keep(move(members, "c"))
        new = tables.keep(move(groups, "c").unionByName(within).groupBy("c").agg(F.sum("n").alias("n"), F.sum("w").alias("w")))
        # what is known of the parts of a pair adds up; a sum is known if those of all parts are
        parts = links.withColumn("known", F.when(F.col("s").isNotNull(), F.col("na") * F.col("nb")).otherwise(0.0)).drop("na", "nb", "d2")
        parts = move(move(parts, "a"), "b").where("a <> b").withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
        sums = parts.groupBy("a", "b").agg(F.sum("near").alias("near"), F.sum("seen").alias("seen"), F.sum("s").alias("s"), F.sum("known").alias("known"))
        count = lambda c, n: new.select(F.col("c").alias(c), F.col("n").alias(n))  # noqa: B023, E731
        sums = sums.join(count("a", "na"), "a").join(count("b", "nb"), "b")
        links = tables.keep(sums.select("a", "b", "near", "seen", F.when(F.col("known") == F.col("na") * F.col("nb"), F.col("s")).alias("s")))
        groups = new
        tables.forget(done)
    low = held.select("row_id", "rep").join(members.select(F.col("row_id").alias("rep"), F.col("c").alias("low")), "rep")
    low = cut(low.select("row_id", "low"))
    tables.close()
    return _numbered(ids.join(low, "row_id", "left").withColumn("low", F.coalesce("low", "row_id")))


def _with_sums(links: DataFrame, groups: DataFrame, members: DataFrame, lines: DataFrame, top: float) -> DataFrame:
    """links with na, nb, and d2, the squared distance of their clusters; null where it surely exceeds `top`."""
    side = lambda c: groups.select(F.col("c").alias(c), F.col("n").alias(f"n{c}"), F.col("w").alias(f"w{c}"))
    both = links.join(side("a"), "a").join(side("b"), "b")
    na, nb = F.col("na"), F.col("nb")

    def ward2(s: F.Column) -> F.Column:
        return F.when(s.isNotNull(), F.round(F.greatest(F.lit(0.0), 2 * na * nb / (na + nb) * (s / (na * nb) - F.col("wa") / (na * na) - F.col("wb") / (nb * nb))), DECIMALS))

    bound = ward2(F.col("near") + (na * nb - F.col("seen")) * top)
    asked = both.where(F.col("s").isNull() & (bound <= top)).select("a", "b")
    of = lambda c: members.select("row_id", F.col("c").alias(c)).join(lines, "row_id").select(c, F.col("v").alias(f"v{c}"), F.col("n").alias(f"m{c}"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    d = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.abs(dot)))
    sums = asked.join(of("a"), "a").join(of("b"), "b").groupBy("a", "b").agg(F.sum(d * d * F.col("ma") * F.col("mb")).alias("full"))
    whole = both.join(sums, ["a", "b"], "left").withColumn("s", F.coalesce("s", "full"))
    return whole.select("a", "b", "near", "seen", "s", "na", "nb", ward2(F.col("s")).alias("d2"))


def _numbered(found: DataFrame) -> DataFrame:
    """(row_id, FeatureCluster): clusters, named by their smallest features, as numbers from 1."""
    places = running(found.select("low").distinct(), [("low", True)], {"FeatureCluster": F.lit(1).cast("long")})
    return found.join(places, "low").select("row_id", F.col("FeatureCluster").cast("int").alias("FeatureCluster"))


def cluster(cells: DataFrame, features: DataFrame, q_value: float = 0.01, seed: int = 0, feature_column: str | None = None) -> DataFrame:
    """features with FeatureCluster. The cutoff is calibrated on the features that are decoys, where there is a Decoy
    column with some, or on shuffled ones; with a feature_column its values, which must be unique, are kept in Feature."""
    if feature_column is not None and features.groupBy(F.col(f"`{feature_column}`")).count().where(F.col("count") > 1).head(1):
        raise ValueError(f"features of one {feature_column!r} are several; quantify first")
    own = None
    if "Decoy" in features.columns and features.where("Decoy = 1").head(1):
        own = cells.join(features.where("Decoy = 1").select("row_id"), "row_id", "left_semi")
    height = cutoff(nearest(cells), nearest(decoy_shuffle(cells, seed) if own is None else own), q_value).first()[0]
    return features.join(ward(cells, features, height), "row_id", "left")
