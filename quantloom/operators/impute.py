"""Filling in missing values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import uniform
from ..functions.storage import cut


#: Designs of at most as many samples are turned to vectors by a column each.
WIDE = 64


def grid(cells: DataFrame, features: DataFrame, samples: DataFrame) -> DataFrame:
    """A cell for each feature and sample. The samples are the broadcast side: a design names them one by one."""
    every = features.select("row_id").crossJoin(F.broadcast(samples.select("sample")))
    return every.join(cells, ["row_id", "sample"], "left").select("row_id", "sample", "value")


def constant(full: DataFrame, value: float = 0.0) -> DataFrame:
    return full.withColumn("value", F.coalesce(F.col("value"), F.lit(float(value))))


def uniform_range(full: DataFrame, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    """Missing values and zeros become numbers drawn from [low, high)."""
    return full.withColumn("value", F.coalesce(F.nullif(F.col("value"), F.lit(0.0)), F.lit(low) + F.lit(high - low) * uniform("row_id", "sample", seed=seed)))


def uniform_percentile(full: DataFrame, percentile: float = 0.1, seed: int = 0) -> DataFrame:
    """Drawn from [m, m + percentile * largest value), m being the smallest value but zero."""
    span = full.agg(F.min(F.nullif(F.col("value"), F.lit(0.0))).alias("lo"), F.max(F.col("value")).alias("hi"))
    u = uniform("row_id", "sample", seed=seed)
    filled = full.crossJoin(F.broadcast(span)).withColumn("value", F.coalesce(F.nullif(F.col("value"), F.lit(0.0)), F.col("lo") + F.col("hi") * percentile * u))
    return filled.select("row_id", "sample", "value")


class Nearest:
    """The nearest donors so far of each missing cell of a block of rows (a row of x each, nan where a value is missing).

    Donors are met by leaves, and a leaf only by rows that the box around it lies near enough to. Distances are first those
    of a product of matrices of 32 bits, with margins for its rounding; of what passes they are sums over the samples in
    their order. A donor may stand for several equal rows, and counts as often.
    """

    LEAF = 128

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k, self.has = ids, x, k, ~np.isnan(x)
        self.row, self.s = np.nonzero(~self.has)  # the cells, by row
        self.start = np.searchsorted(self.row, np.arange(len(x)))
        self.cell = np.zeros(x.shape, int)
        self.cell[self.row, self.s] = np.arange(len(self.row))
        self.middle = np.where(n := self.has.sum(0), np.where(self.has, x, 0).sum(0) / np.maximum(n, 1), 0)
        x0 = np.where(self.has, x - self.middle, 0)
        self.scale = np.abs(x0).max() or 1.0
        x0 = x0 / self.scale
        self.square, self.one = x0**2, self.has.astype(float)
        self.terms = np.concatenate([self.has, -2 * x0], axis=1).astype(np.float32)
        # what a box must lie above or below of; a missing value is beyond any box
        self.top, self.bottom = (np.where(self.has, np.nextafter(x0.astype(np.float32), np.float32(e)), np.float32(e)) for e in (2e18, -2e18))
        shape = (len(self.row), k)
        self.d, self.value, self.far = np.full(shape, np.inf), np.zeros(shape), np.full(len(self.row), np.inf)
        self.donor, self.copies, self.n = np.empty(shape, ids.dtype), np.empty((*shape, k), ids.dtype), np.zeros(shape, int)

    def reach(self, some: np.ndarray) -> np.ndarray:
        """How far off a donor may be for each row, given which samples the donors have; negative: it needs none."""
        return np.maximum.reduceat(np.where(some[self.s], self.far, -1.0), self.start)

    def bounds(self, y0: np.ndarray, some: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The least distance that a row can have to any donor of a leaf; y0 is scaled, and nan where a sample is missing."""
        low, high = (np.nan_to_num(f.reduceat(y0, starts), nan=e).astype(np.float32) for f, e in ((np.minimum, -2e18), (np.maximum, 2e18)))
        low, high = np.nextafter(low, np.float32(-2e18)), np.nextafter(high, np.float32(2e18))
        least, over, under = (np.zeros((len(self.x), len(starts)), np.float32) for _ in range(3))
        for s in range(y0.shape[1]):
            np.subtract(low[:, s], self.top[:, s, None], out=over)
            np.subtract(self.bottom[:, s, None], high[:, s], out=under)
            np.maximum(over, under, out=over)
            np.maximum(over, 0, out=over)
            least += np.multiply(over, over, out=over)
        common = np.maximum(self.one @ some.T, 1).astype(np.float32)
        return np.sqrt(least * np.float32(y0.shape[1]) / common) * np.float32(1 - 1e-5) * self.scale

    def meet(self, ids: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> None:
        """Meets donors, of which each has a row of y, n ids (one, if n isn't given) and a row of ids, the smallest first."""
        ids, n = ids.reshape(len(y), -1), np.ones(len(y), int) if n is None else n
        width, has, starts = y.shape[1], ~np.isnan(y), np.arange(0, len(y), self.LEAF)
        some, every = np.logical_or.reduceat(has, starts), np.logical_and.reduceat(has, starts)
        y0 = np.clip((y - self.middle) / self.scale, -1e18, 1e18)
        bound = self.bounds(y0, some, starts)
        y0 = np.where(has, y0, 0)
        large = np.maximum.reduceat((y0**2).sum(1), starts)
        one, terms = has.astype(float), np.concatenate([y0**2, y0], axis=1).astype(np.float32)
        sums, waiting = {}, []

        def flush() -> None:
            if waiting:
                self.take(*(np.concatenate(v) for v in zip(*waiting, strict=True)), ids, y, has, n)
                waiting.clear()

        for leaf in np.argsort(bound.sum(0), kind="stable"):
            at, end, alike = starts[leaf], min(starts[leaf] + self.LEAF, len(y)), (some[leaf] == every[leaf]).all()
            while at < end:
                most = self.reach(some[leaf])
                rows = np.flatnonzero(bound[:, leaf] <= most)
                if not len(rows):
                    break
                # the first donors, few of them, say how far off the others may be
                warm = np.isfinite(most[rows]).all()
                to = end if warm else min(at + 4 * self.k, end)
                if alike:  # a number for each row does where all donors have the same samples
                    key = some[leaf].tobytes()
                    if key not in sums:
                        sums[key] = self.one @ one[at][:, None] / width, self.square @ one[at][:, None]
                    common, square = (v[rows] for v in sums[key])
                else:
                    common, square = self.one[rows] @ one[at:to].T / width, self.square[rows] @ one[at:to].T
                with np.errstate(invalid="ignore"):  # without a sample in common there is no distance
                    limit = ((most[rows, None] / self.scale) ** 2 * common - square) + 1e-5 * (1 + self.square[rows].sum(1)[:, None] + large[leaf]) + 1e-5 * np.square(np.minimum(most[rows, None] / self.scale, 1e18))
                    near = self.terms[rows] @ terms[at:to].T <= limit.astype(np.float32)
                hit = np.flatnonzero(near.any(1))
                i, j = np.nonzero(near[hit])
                waiting.append((rows[hit[i]], at + j))
                if not warm or sum(len(v[0]) for v in waiting) >= len(self.x):
                    flush()
                at = to
        flush()

    def take(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, y: np.ndarray, has: np.ndarray, n: np.ndarray) -> None:
        """Keeps what is nearer of the pairs of rows i and donors j."""
        for p in range(0, len(i), 1 << 16):
            r, c = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
            both = self.has[r] & has[c]
            r, c, both = (v[both.any(1)] for v in (r, c, both))
            apart = np.where(both, self.x[r] - y[c], 0) ** 2
            d = np.sqrt(apart.sum(1) * y.shape[1] / both.sum(1))
            of, s = np.nonzero(~self.has[r] & has[c])
            cell, d, c = self.cell[r[of], s], d[of], c[of]
            on = d <= self.far[cell]
            cell, d, c, s = cell[on], d[on], c[on], s[on]
            if not len(cell):
                continue
            old = np.unique(cell)
            kept = np.isfinite(self.d[old])
            cell = np.concatenate([np.repeat(old, kept.sum(1)), cell])
            d, value = np.concatenate([self.d[old][kept], d]), np.concatenate([self.value[old][kept], y[c, s]])
            donor, many = np.concatenate([self.donor[old][kept], ids[c, 0]]), np.concatenate([self.n[old][kept], n[c]])
            copies = np.empty((len(cell), self.k), ids.dtype)
            copies[: len(cell) - len(c)] = self.copies[old][kept]
            copies[len(cell) - len(c) :, : ids.shape[1]] = ids[c]
            order = np.lexsort((np.unique(donor, return_inverse=True)[1], d, cell))  # ties go to the smallest donor
            cell = cell[order]
            place = np.arange(len(cell)) - np.searchsorted(cell, cell)
            cell, order, place = cell[place < self.k], order[place < self.k], place[place < self.k]
            self.d[cell, place], self.value[cell, place], self.donor[cell, place] = d[order], value[order], donor[order]
            self.n[cell, place], self.copies[cell, place] = many[order], copies[order]
            enough = np.cumsum(self.n[old], axis=1) >= self.k
            self.far[old] = np.where(enough.any(1), self.d[old, enough.argmax(1)], np.inf)

    def found(self, kind: pa.DataType) -> pa.RecordBatch:
        """(row_id, s, near): the donors of each cell, the nearest first."""
        cell, place, copy = np.nonzero(np.arange(self.k) < self.n[:, :, None])
        d, donor, value = self.d[cell, place], self.copies[cell, place, copy], self.value[cell, place]
        order = np.lexsort((np.unique(donor, return_inverse=True)[1], d, cell))
        cell = cell[order]
        on = np.arange(len(cell)) - np.searchsorted(cell, cell) < self.k
        cell, order = cell[on], order[on]
        some, count = np.unique(cell, return_counts=True)
        near = pa.StructArray.from_arrays([pa.array(d[order]), pa.array(donor[order], kind), pa.array(value[order])], ["d", "donor", "x"])
        offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row[some]], kind), pa.array(self.s[some].astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), near)], ["row_id", "s", "near"])


def _blocks(vectors: DataFrame, width: int, parts: int, rows: int, names: tuple[str, str, str], by: tuple[str, ...]) -> DataFrame:
    """Rows (ids, v) packed to blocks, ordered by n and p, the number and the pattern of the missing samples, and by c, which
    rows of like values have in common."""
    first = range(min(width, 16))  # more samples than these don't count for the order
    cuts = vectors.agg(*[F.percentile_approx(F.nanvl(F.col("v")[s], F.lit(None)), [0.25, 0.5, 0.75]) for s in first]).first()
    quarter = [sum(F.when(F.nanvl(F.col("v")[s], F.lit(c[1])) > x, 1).otherwise(0) for x in c) if (c := cuts[s]) else F.lit(0) for s in first]
    bits = [F.shiftright(q, 1).cast("long") for q in quarter] + [q.cast("long").bitwiseAND(F.lit(1)) for q in quarter]
    code = sum((b * (1 << n) for n, b in enumerate(reversed(bits))), F.lit(0).cast("long"))
    lacking = F.transform("v", lambda x: F.isnan(x))
    keyed = vectors.select("ids", "v", F.size(F.filter(lacking, lambda x: x)).alias("n"), lacking.alias("p"), code.alias("c"))
    ordered = keyed.repartitionByRange(parts, *by, "ids").sortWithinPartitions(*by, "ids").select("ids", "v")
    kind = vectors.schema["ids"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                one = b.slice(at, rows)
                n = one.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = one.column(0).flatten()
                ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                v = one.column(1).flatten().to_numpy(zero_copy_only=False).astype(float)
                yield pa.RecordBatch.from_arrays([ids, pa.array([n.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], list(names))

    return cut(ordered.mapInArrow(pack, f"{names[0]} {kind}, {names[1]} binary, {names[2]} binary"))


def knn(full: DataFrame, n_neighbors: int = 5, weights: str = "distance", donors_per_block: int = 1024, donor_parts: int = 4) -> DataFrame:
    """Each missing cell from the nearest features that have its sample, by distance over the samples both have.

    Rows with missing values and donors are packed to blocks, and each block of rows meets each block of donors in a
    product that copies nothing to disk: a task has some blocks of rows and one of `donor_parts` parts of the donors, and
    keeps the n_neighbors best donors of each missing cell, which are merged. So what is shuffled grows with the rows.
    Equal rows ask once and give once, for the n_neighbors smallest of them. Without a donor the sample's mean is taken.
    """
    names = [r[0] for r in full.select("sample").distinct().orderBy("sample").collect()]  # the design's samples
    if not names:
        return full.select("row_id", "sample", "value")
    packed = full.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", F.coalesce(F.col("value"), F.lit(float("nan")))))).alias("m"))
    vectors = packed.select("row_id", F.array(*[F.coalesce(F.col("m")[s], F.lit(float("nan"))) for s in names]).alias("v"))
    return _fill(vectors, names, n_neighbors, weights, donors_per_block, donor_parts)


def _vectors(cells: DataFrame, features: DataFrame, names: list) -> DataFrame:
    """(row_id, v) of all features, for samples that are few enough to be columns: no row is made for a missing cell."""
    value = F.coalesce("value", F.lit(float("nan")))
    by = cells.groupBy("row_id").agg(*[F.max(F.when(F.col("sample") == n, value)).alias(f"v{i}") for i, n in enumerate(names)])
    return features.select("row_id").join(by, "row_id", "left").select("row_id", F.array(*[F.coalesce(f"v{i}", F.lit(float("nan"))) for i in range(len(names))]).alias("v"))


def _fill(vectors: DataFrame, names: list, n_neighbors: int, weights: str, donors_per_block: int = 1024, donor_parts: int = 4) -> DataFrame:
    """knn of (row_id, v): the values of the samples called names, nan where one is missing."""
    if weights not in ("distance", "uniform"):
        raise ValueError("weights are 'distance' or 'uniform'")
    vectors = cut(vectors)
    width, known = len(names), vectors.where(F.exists("v", lambda x: ~F.isnan(x)))
    asks = cut(known.where(F.exists("v", lambda x: F.isnan(x))).groupBy("v").agg(F.min("row_id").alias("row_id")).select("row_id", "v"))
    w = Window.partitionBy("v").orderBy("row_id")
    donors = known.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n_neighbors).groupBy("v").agg(F.array_sort(F.collect_list("row_id")).alias("ids"))
    # parts of a few blocks each, of which every core gets several
    left = _blocks(asks.select(F.array("row_id").alias("ids"), "v"), width, min(max(asks.count() // (4 * donors_per_block), 1), 1024), 4 * donors_per_block, ("ids", "one", "x"), ("c", "n", "p"))
    donors = cut(donors.select("ids", "v"))  # a task keeps its part of them, of a million at most
    right = _blocks(donors, width, max(donor_parts, donors.count() >> 20), max(min(8 * donors_per_block, (1 << 17) // width), 1), ("donors", "n", "y"), ("n", "p", "c"))
    kind = vectors.schema["row_id"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for b in batches:
            of = b.schema.field(0).type.value_type
            for i in range(b.num_rows):
                ids, donors = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (0, 3))
                if ids[0] != block:  # a block's pairs come one after the other
                    if now is not None:
                        yield now.found(of)
                    now, block = Nearest(ids, np.frombuffer(b.column(2)[i].as_buffer()).reshape(-1, width), n_neighbors), ids[0]
                n = np.frombuffer(b.column(4)[i].as_buffer(), np.int64)
                each = np.empty((len(n), n_neighbors), donors.dtype)
                each[np.arange(n_neighbors) < n[:, None]] = donors
                now.meet(each, np.frombuffer(b.column(5)[i].as_buffer()).reshape(-1, width), n)
        if now is not None:
            yield now.found(of)

    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    found = pairs.mapInArrow(near, f"row_id {kind}, s int, near array<struct<d: double, donor: {kind}, x: double>>")
    best = found.groupBy("row_id", "s").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, n_neighbors).alias("near"))
    total = lambda of, f: F.aggregate(of, F.lit(0.0), lambda a, e: a + f(e))
    same = F.filter("near", lambda e: e["d"] == 0)
    mean = lambda of: total(of, lambda e: e["x"]) / F.size(of)
    weighted = total(F.col("near"), lambda e: F.try_divide(e["x"], e["d"])) / total(F.col("near"), lambda e: F.try_divide(F.lit(1.0), e["d"]))
    value = mean(F.col("near")) if weights == "uniform" else F.when(F.size(same) > 0, mean(same)).otherwise(weighted)
    guesses = best.select("row_id", F.struct("s", value.alias("x")).alias("g")).groupBy("row_id").agg(F.map_from_entries(F.collect_list("g")).alias("g"))
    shared = asks.join(guesses, "row_id").select("v", "g")
    filled = vectors.join(shared, "v", "left").select("row_id", "g", F.posexplode("v").alias("s", "x"))
    filled = filled.withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    means = vectors.select(F.posexplode("v").alias("s", "x")).where(~F.isnan("x")).groupBy("s").agg(F.avg("x").alias("mean"))
    out = filled.join(F.broadcast(means), "s", "left")
    return out.select("row_id", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("s") + 1).alias("sample"), F.coalesce("x", F.col("g")[F.col("s")], "mean").alias("value"))


def impute(cells: DataFrame, features: DataFrame, samples: DataFrame, method: str, percentile: float = 0.1, minvalue: float = 0.0, maxvalue: float = 1.0, constant_value: float = 0.0, n_neighbors: int = 5, weights: str = "distance", seed: int = 0) -> DataFrame:
    if method == "knn":
        names = [r[0] for r in samples.select("sample").distinct().orderBy("sample").collect()]
        if 0 < len(names) <= WIDE:
            return _fill(_vectors(cells, features, names), names, n_neighbors, weights)
    full = grid(cells, features, samples)
    if method == "constant":
        return constant(full, constant_value)
    if method == "uniform_range":
        return uniform_range(full, minvalue, maxvalue, seed)
    if method == "uniform_percentile":
        return uniform_percentile(full, percentile, seed)
    if method == "knn":
        return knn(full, n_neighbors, weights)
    raise ValueError(f"unknown imputation method {method!r}; known: constant, uniform_range, uniform_percentile, knn")
