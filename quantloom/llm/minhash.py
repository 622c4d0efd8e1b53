"""Near duplicates by MinHash: one permutation, optimal densification, banded buckets, star-shaped candidates.

Words are split at ASCII white space after A-Z became a-z; a document's set is its distinct five-word shingles (the
whole sequence where there are fewer words). One hash per shingle serves all bins: its leading bits choose the bin,
the smallest hash in a bin is its value, and an empty bin takes the value of the first non-empty bin in a random
order of its own. Bands of the signature are buckets. Documents with the same set are one node throughout.

In the first round every bucket has one centre, and only (centre, member) pairs become candidates. In the second one
about FEW members of a bucket in which several components meet are drawn by hash, and each member offers its BEST
candidates among them; so a group's parts grow together with about as many pairs as it has members. Afterwards such a
bucket has about CENTRES of them, drawn from all but its largest component; with each of them all pairs to other
components are decided, so it leaves the bucket. A pair that shares several buckets is decided in the first of them,
where both are until it is. Rounds go on until no bucket holds
two components: no link that a bucket offers is lost, and a group of near copies takes about as many pairs as it has
members. Links are kept between components only, so a round's graph holds one node a component.

A candidate is dropped without its sets when it can't be a link: each set has a digit for every bin, taken from the
bin's smallest hash, and where digits differ the sets differ by one shingle at least. What is left is confirmed on the
full sets.

Defined cases: null texts and texts without words have no shingles, size 0, and are linked with nothing; repeated
rows and repeated ids are rows of their own; a null id is larger than any other; of a component the row with the
smallest id is kept, and of repeated rows with that id one; a text of any length is read whole and gives 256 bins, so
only its set grows; an empty table gives an empty result; other columns are carried by drop_near_duplicates, whatever
their names, and never read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Tables
from .common import LOWER, WordHashes, columns_of, connected, cut, free_names, mix64, spread

WORDS_PER_SHINGLE = 5
BITS = 8
BINS = 1 << BITS
CENTRES, FEW, BEST = 96, 32, 2
#: Words whose hashes a task remembers. Python's workers keep their memory while the joins run, so it is kept small.
HASHES = 60_000
#: For each bin a random order of all bins, as ranks: where an empty bin looks for its value.
RANKS = np.argsort(np.argsort(mix64(np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS) + np.uint64(1)), axis=1), axis=1).astype(np.int16)


def shingle_set(text: str | None, hashes: WordHashes, k: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.array(words)
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(k, len(h))):
            out = (out + h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        if len(h) < k:
            out += np.uint64(len(h))
    return np.unique(mix64(out))


def signature(found: np.ndarray) -> np.ndarray:
    """One value for each bin, of a non-empty set."""
    bins = (found >> np.uint64(64 - BITS)).astype(np.int16)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    have, out = bins[first], np.zeros(BINS, np.uint64)
    out[have] = found[first]
    empty = np.setdiff1d(np.arange(BINS), have, assume_unique=True)
    if len(empty):
        out[empty] = found[first][RANKS[np.ix_(empty, have)].argmin(axis=1)]
    return out


def digits(found: np.ndarray) -> np.ndarray:
    """Four bits for each bin, 16 bins a number: 0 for an empty one, else 1 to 15 from its smallest hash."""
    bins = (found >> np.uint64(64 - BITS)).astype(np.int16)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out = np.zeros(BINS, np.uint64)
    out[bins[first]] = mix64(found[first]) % np.uint64(15) + np.uint64(1)
    return np.bitwise_or.reduce(out.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)


def differing(a: F.Column, b: F.Column) -> F.Column:
    """In how many digits two sets differ."""

    def differ(x: F.Column, y: F.Column) -> F.Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, v: s + v)


def may_link(a: tuple[F.Column, F.Column], b: tuple[F.Column, F.Column], percent: int) -> F.Column:
    """Whether two sets, each as (size, digits), may reach the threshold: no if their sizes don't allow it, nor if even
    sets that differ only where digits do would not."""
    apart, size = differing(a[1], b[1]), a[0] + b[0]
    return (F.least(a[0], b[0]) * 100 >= F.greatest(a[0], b[0]) * percent) & ((size - apart) * 100 >= (size + apart) * percent)


def shape(percent: int) -> tuple[int, int]:
    """Bands and rows: pairs at the threshold are missed in fewer than one of ten thousand cases."""
    rows = 8 if percent >= 85 else 6 if percent >= 75 else 4
    return BINS // rows, rows


def buckets_of(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s, h = sig[: bands * rows].reshape(bands, rows), np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + s[:, i])
    return h


def _key(found: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def _sketches(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """id, n_shingles, sk (the set's 128-bit hash; null without shingles), buckets, digits."""
    bands, rows = shape(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(HASHES)
        for b in columns_of(batches, rows=1000, size=2 << 20):
            n, keys, buckets, marks = [], [], [], []
            for t in b.column(1).to_pylist():
                found = shingle_set(t, hashes)
                n.append(len(found))
                keys.append(_key(found) if len(found) else None)
                buckets.append(buckets_of(signature(found), bands, rows).view(np.int64) if len(found) else np.empty(0, np.int64))
                marks.append(digits(found).view(np.int64) if len(found) else np.empty(0, np.int64))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(list(map(len, x))))).astype(np.int32)), pa.array(np.concatenate(x)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), lists(buckets), lists(marks)], ["id", "n_shingles", "sk", "buckets", "digits"])

    return spread(docs, id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, sk binary, buckets array<long>, digits array<long>")


def _sets(docs: DataFrame, text_col: str) -> DataFrame:
    """sk and the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(HASHES)
        for b in columns_of(batches, rows=500, size=2 << 20):
            sets = [s for t in b.column(0).to_pylist() if len(s := shingle_set(t, hashes))]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *[s.view(np.int64) for s in sets]])
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, sets), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["sk", "shingles"])

    return spread(docs, text_col).mapInArrow(run, "sk binary, shingles array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose full sets reach the threshold, without a and b. Both sides of each join are dealt by
    it, so AQE can split a hot centre."""
    one = lambda x: sets.select(F.concat("sk", F.lit(b"")).alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common * 100 >= (F.size("sa") + F.size("sb") - common) * percent).drop("a", "b", "sa", "sb")


def near_links(docs: DataFrame, sketches: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame | None:
    """(node, comp) of the sets that share a bucket with another; None where there are none."""
    nodes = cut(sketches.where("sk IS NOT NULL").groupBy("sk").agg(F.min("id").alias("id"), F.first(F.struct(F.col("n_shingles").alias("n"), F.col("digits").alias("d"), "buckets")).alias("x")))
    rows = nodes.select("sk", F.explode("x.buckets").alias("bucket"))
    # joins on a bucket are plain ones, so that adaptive execution splits the partitions of large buckets; of buckets
    # with the same members one is kept
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("sk")).alias("x"), F.min("sk").alias("y"), F.max("sk").alias("z"))
    sizes = sizes.where("size > 1").groupBy("size", "x", "y", "z").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    # a round's rows are a table, not a checkpoint: compressed, and removed as soon as the next is written
    fixed, kept = Tables(docs.sparkSession), Tables(docs.sparkSession)
    live = kept.keep(rows.join(sizes, "bucket"))
    if live.isEmpty():
        kept.close()
        return None
    comps = cut(live.select("sk").distinct().withColumn("comp", F.col("sk")))
    mine = comps.join(nodes, "sk")
    some = spread(docs, id_col, text_col).toDF("__id", "__text").join(mine.select(F.col("id").alias("__wanted")).distinct(), F.col("__id").eqNullSafe(F.col("__wanted")), "left_semi")
    sets = fixed.keep(_sets(some, "__text").dropDuplicates(["sk"]))
    at = kept.keep(live.join(mine.select("sk", "comp", "x.n", "x.d"), "sk"))  # a row for each bucket of each set
    kept.forget(-1)

    turn, plain = 0, [F.col("sk").alias("k"), F.col("comp").alias("c"), "n", "d"]
    while True:
        star = F.struct(*plain, *(["l"] if turn > 1 else []))
        if turn == 0:
            first = F.struct(F.xxhash64("sk", "bucket").alias("h"), star.alias("s"))
            split = at.groupBy("bucket").agg(F.array(F.min(first)["s"]).alias("stars"))
        else:
            if turn == 1:  # only the buckets in which components meet
                mixed = at.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
                at = kept.keep(at.join(mixed, "bucket", "left_semi"))
            else:  # each bucket's largest component, and how many rows the others have
                parts = at.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
                parts = parts.groupBy("bucket").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("size"))
                parts = parts.select("bucket", F.col("most.comp").alias("main"), "size", (F.col("size") - F.col("most.m")).alias("others")).where("others > 0")
                at = kept.keep(at.drop("main", "size", "others").join(parts, "bucket"))
            kept.forget(-1)
            if at.isEmpty():
                fixed.close()
                kept.close()
                return comps.withColumnRenamed("sk", "node")
            if turn > 1:  # the buckets that a set is in, so that a pair counts in the first of those that it shares
                lists = at.groupBy("sk").agg(F.collect_list("bucket").alias("l"))
                at = kept.keep(at.join(lists, "sk"))
                kept.forget(-1)
            # the first of them by hash always is one, so that there is one
            many, of = (FEW, "size") if turn == 1 else (CENTRES, "others")
            drawn = F.pmod(F.xxhash64("sk", "bucket", F.lit(turn)), F.lit(1 << 20)) * F.col(of) < F.lit(many << 20)
            aside = at if turn == 1 else at.where("comp != main")
            sure = aside.groupBy("bucket").agg(F.array(F.min(F.struct(F.xxhash64("sk", "bucket", F.lit(turn)).alias("h"), star.alias("s")))["s"]).alias("stars"))
            split = aside.where(drawn).select("bucket", F.array(star).alias("stars")).unionByName(sure)
            split = split.groupBy("bucket").agg(F.array_distinct(F.flatten(F.collect_list("stars"))).alias("stars"))
        held = at.join(split, "bucket")
        # only candidates that may be links become rows
        once = (lambda s: F.array_min(F.array_intersect("l", s["l"])) == F.col("bucket")) if turn > 1 else (lambda s: F.lit(True))
        apt = F.filter("stars", lambda s: (s["c"] != F.col("comp")) & may_link((F.col("n"), F.col("d")), (s["n"], s["d"]), percent) & once(s))  # noqa: B023
        if turn == 1:
            near = F.transform(apt, lambda s: F.struct(differing(F.col("d"), s["d"]).alias("x"), s["k"].alias("k"), s["c"].alias("c")))
            apt = F.slice(F.array_sort(near), 1, BEST)
        two = held.select(F.struct(F.col("sk").alias("k"), F.col("comp").alias("c")).alias("m"), F.explode(F.transform(apt, lambda s: F.struct(s["k"].alias("k"), s["c"].alias("c")))).alias("s"))
        two = two.select(F.least("m", "s").alias("l"), F.greatest("m", "s").alias("g"))
        pairs = kept.keep(two.select(F.col("l.k").alias("a"), F.col("g.k").alias("b"), F.least("l.c", "g.c").alias("u"), F.greatest("l.c", "g.c").alias("v")).distinct())
        # only links between components go on
        found = kept.keep(_confirm(pairs, sets, percent).distinct())
        rest = at.drop("l")
        if turn != 1:  # the centres have met all members of their buckets
            centres = split.select(F.col("bucket").alias("of"), F.explode("stars.k").alias("k"))
            rest = rest.join(centres, (F.col("bucket") == F.col("of")) & (F.col("sk") == F.col("k")), "left_anti")
        if not found.isEmpty():
            moved = connected(found.toDF("a", "b")).toDF("comp", "to")
            join = lambda df: df.join(moved, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).drop("to")  # noqa: B023, E731
            comps, rest = cut(join(comps)), join(rest)
        at, turn = kept.keep(rest), turn + 1
        kept.forget(-1)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that can be reached), sk (a hash of its
    set), stays (it has that id, and of such rows with different sets only one set's rows stay)."""
    sketches = cut(_sketches(docs, id_col, text_col, percent))
    linked = near_links(docs, sketches, id_col, text_col, percent)
    with_words = sketches.where("sk IS NOT NULL").select("id", "n_shingles", "sk")
    nodes = with_words.groupBy("sk").agg(F.min("id").alias("component_id")).withColumn("keeper", F.col("sk"))
    if linked is not None:
        nodes = cut(nodes.join(linked.withColumnRenamed("node", "sk"), "sk", "left"))
        inside = nodes.where("comp IS NOT NULL")
        order = F.struct(F.col("component_id").isNull(), F.col("component_id"), F.col("sk"))
        least = inside.groupBy("comp").agg(F.min_by(F.struct("component_id", "sk"), order).alias("least"))
        inside = inside.select("sk", "comp").join(cut(least), "comp").select("sk", F.col("least.component_id").alias("component_id"), F.col("least.sk").alias("keeper"))
        nodes = inside.unionByName(nodes.where("comp IS NULL").drop("comp"))
    out = with_words.join(cut(nodes), "sk")
    out = out.select("id", "n_shingles", "component_id", "sk", (F.col("id").eqNullSafe(F.col("component_id")) & (F.col("sk") == F.col("keeper"))).alias("stays"))
    none = sketches.where("sk IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"), "sk", F.lit(True).alias("stays"))
    return out.unionByName(none).withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row of each component, with all columns of docs; rows without words all stay."""
    groups = near_groups(docs, id_col, text_col, percent)
    i, sk, again, key = free_names(docs, 4)
    groups = cut(groups.select(F.col(f"`{id_col}`").alias(i), F.col("sk").alias(sk), "stays"))
    kept, same = groups.where("stays").drop("stays"), F.col(f"`{id_col}`").eqNullSafe(F.col(i))
    many = cut(groups.groupBy(F.col(i).alias(again)).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(again).isNull()).select(again))
    if many.isEmpty():
        return docs.join(kept.select(i), same, "left_semi")
    # ids that don't name one row: their sets tell the rows apart
    both = F.col(i).eqNullSafe(F.col(again))
    once = docs.join(kept.join(many, both, "left_anti"), same, "left_semi")
    keyed = docs.join(many, F.col(f"`{id_col}`").eqNullSafe(F.col(again)), "left_semi").withColumn(key, _set_key(F.col(f"`{text_col}`")))
    own = keyed.join(kept.join(many, both, "left_semi"), same & (F.col(key) == F.col(sk)), "left_semi")
    return once.unionByName(own.dropDuplicates([id_col, key]).drop(key)).unionByName(keyed.where(F.col(key).isNull()).drop(key))


def _set_key(text: F.Column) -> F.Column:
    """The hash of each text's set; null without words."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes(HASHES)
        for texts in batches:
            sets = (shingle_set(t.as_py(), hashes) for t in texts)
            yield pa.array([_key(s) if len(s) else None for s in sets], pa.binary())

    return run(text)
