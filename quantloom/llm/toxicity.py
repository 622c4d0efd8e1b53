"""Toxicity by class-conditional Kneser-Ney models of words and pairs of words.

Each class (toxic, ordinary) has an interpolated Kneser-Ney model of order two, counted in distinct labelled texts:

    P_c(w | v) = max(c_c(v, w) - 1, 0) / c_c(v) + l_c(v) P_c(w)
    P_c(w)     = (N_c(w) - d_c) / N_c + l_c P(w)
    P(w)       = (N(w) - d) / N + l / (words + 1)

c_c counts occurrences, N_c(w) is a continuation count: the number of different words that w follows in the class, and
N(w) that number in both classes together. So both classes back off to the same shared counts, and an expression that
is rare in a class is smoothed towards what is known of it in both. Of continuation counts of one, two, and three or
more the discounts d come from counts of counts; a pair's discount is one, so a pair seen once in a class speaks
through its words only. All l are the mass that the discounts leave. The border of a text is a word of its own.

A text's evidence is what its length-normalised toxic log-likelihood exceeds the ordinary one by: of the whole text, and
of parts of it that a long text would hide, its one, two and three most toxic different words and its most toxic counted
pair. Each is a mean over the words that it covers, so nothing depends on the text's length, and no word can hide another.
A logistic curve, fitted on labelled rows that the counts don't include, makes a probability of them; each evidence has a
weight of LEAST or more, so the score grows with every one, that of the whole text among them. Nothing but the text is
read. Where the rows for the curve are of one class only, or there are none, the curve is a fixed one.

The HOT most frequent entries of the model, of the least frequent ones as many as fit, are broadcast. Where there are
more, the words and pairs of texts that the broadcast part hasn't, and that a Bloom filter of BITS bits doesn't rule out,
are joined with the rest. HOT and BITS move work between the two ways; the model is rounded to 32 bits in both. Pairs are
counted by PARTS of the words that follow, one after the other: all texts are read for each, and disk holds the pairs of
one part at a time. Counts and statistics cover all labelled rows; only the curve is fitted on at most FIT of them.

Defined cases: null and empty texts, and texts without words, get the score of no evidence; a text of any length is
read whole; rows are neither merged nor dropped, and equal texts score alike; with labelled training rows of one class
only every score is that class, and with none at all every score is 0, since nothing is known to be toxic; a document
with several labels counts as toxic if one of them says so, null labels don't count; null ids are training rows that
no label can name; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import Tables
from .common import WORDS, columns_of, cut, fold, free_names, if_small, lean, mix64

THRESHOLD, FIT, CURVE, WORST = 0.3, 50_000, 4, 3
#: The least weights of the evidences: a text's likelihood ratio by the word counts for no less than it says.
LEAST = (1.0, 0.5, 0.25, 0.1, 1.0)
HOT, BITS, PROBES = 1 << 21, 1 << 26, 3
#: The word that stands for a text's border, and how many distinct words a task remembers.
BORDER, CACHE = np.uint64(0), 200_000
#: In how many parts pairs are counted.
PARTS = 3


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64 bits for a pair of words' hashes."""
    with np.errstate(over="ignore"):
        return mix64(v * np.uint64(0x9E3779B97F4A7C15) + w)


class Numbered(dict):
    """Words to small numbers; `new` has those that have come since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def hashes(self) -> np.ndarray:
        import xxhash

        out = np.fromiter((xxhash.xxh64_intdigest(w) or 1 for w in self.new), np.uint64, len(self.new))
        self.new = []
        return out

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the words' numbers, how many each text has, how many different ones up to WORST)."""
        parts, distinct = [], []
        for t in texts:
            ws = words_of(t)
            parts.append(np.fromiter(map(self.__getitem__, ws), np.int32, len(ws)))
            few = len(set(ws[:64]))  # most texts have enough in their first words
            distinct.append(min(few if few >= WORST else len(set(ws)), WORST))
        return np.concatenate([np.empty(0, np.int32), *parts]), np.fromiter(map(len, parts), np.int64, len(parts)), np.array(distinct, np.int64)


def count_pairs(train: DataFrame, part: int) -> DataFrame:
    """(w, v, t, o): how often the word w, of that part of the words, follows v in toxic and in ordinary texts of `train`
    (text, y); batches are summed where they are, so that a frequent pair is sent once a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in columns_of(batches, rows=10_000, size=6 << 20):
            known = Numbered()
            ids, sizes, _ = known.read(b.column(0).to_pylist())
            y, sizes = b.column(1).to_numpy(zero_copy_only=False)[sizes > 0].astype(np.int64), sizes[sizes > 0]
            h = np.concatenate([[BORDER], known.hashes()]).astype(np.uint64)
            # the border between two texts ends one and begins the next
            line = np.insert(ids.astype(np.int64) + 1, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), 0)
            ours = ((h >> np.uint64(40)) % np.uint64(PARTS) == part)[line[1:]]
            both, at, n = np.unique((line[:-1] * len(h) + line[1:])[ours], return_inverse=True, return_counts=True)
            t = np.bincount(at, weights=np.repeat(y, sizes + 1)[ours], minlength=len(both)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[x].view(np.int64)) for x in (both % len(h), both // len(h))] + [pa.array(t), pa.array(n - t)], ["w", "v", "t", "o"])

    out = train.select("text", "y").mapInArrow(run, "w long, v long, t long, o long")
    return out.groupBy("w", "v").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def discounts(n: list[int]) -> list[float]:
    """The discounts of counts of one, two, and three or more; n has how many expressions have counts of 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k) if n[k - 1] else y for k in (1, 2, 3)]


def build(train: DataFrame) -> tuple[DataFrame, float, float] | None:
    """The model of `train` (text, y): (key, top, more, n, pair) of each counted word and of each pair that a class has
    twice, with the log-likelihood ratio of an unknown word and what a text's first border adds; None where a class has
    no words. `top` is the mean log-likelihood ratio of the word or pair by itself, `more` what it adds to that of a
    text over as many unknown words."""
    tables = Tables(train.sparkSession)
    try:
        with lean(train.sparkSession):
            return _build(train, tables)
    finally:
        tables.close()


def _counts(pairs: DataFrame) -> DataFrame:
    """(w, v, nt, no, ns, t, o): of count_pairs' rows each word, with null v, and each pair that a class has twice."""
    words = pairs.groupBy("w").agg(*[F.count_if(F.col(c) > 0).alias(f"n{c}") for c in "to"], F.count("*").alias("ns"), F.sum("t").alias("t"), F.sum("o").alias("o"))
    twice = pairs.where("t > 1 OR o > 1").select("w", "v", F.lit(0).alias("nt"), F.lit(0).alias("no"), F.lit(0).alias("ns"), "t", "o")
    return words.withColumn("v", F.lit(None).cast("long")).unionByName(twice)


def _build(train: DataFrame, tables: Tables) -> tuple[DataFrame, float, float] | None:
    both = reduce(DataFrame.unionByName, [tables.keep(_counts(count_pairs(train, k))) for k in range(PARTS)])
    words, twice = both.where("v IS NULL").drop("v"), both.where("v IS NOT NULL").select("w", "v", "t", "o")
    kinds = ("nt", "no", "ns")
    few = [F.count_if(F.col(c) == k) for c in kinds for k in (1, 2, 3, 4)]
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in kinds], F.count("*"), *few).first()
    if not total[0] or not total[1]:
        return None
    less = {c: discounts(total[4 + 4 * k : 8 + 4 * k]) for k, c in enumerate(kinds)}
    taken = lambda c: F.when(F.col(c) < 1, 0.0).when(F.col(c) == 1, less[c][0]).when(F.col(c) == 2, less[c][1]).otherwise(less[c][2])
    left = words.agg(*[F.sum(taken(c)) for c in kinds]).first()
    size, vocabulary = dict(zip(kinds, total[:3], strict=True)), total[3]
    rest = {c: left[k] / size[c] for k, c in enumerate(kinds)}
    own = lambda c: (F.col(c) - taken(c)) / F.lit(float(size[c]))
    shared = own("ns") + F.lit(rest["ns"] / (vocabulary + 1))
    unknown, logs = float(np.log(rest["nt"] / rest["no"])), lambda x, y: F.ln(x / y)

    over = twice.groupBy(F.col("v").alias("w")).agg(*[F.sum(F.greatest(F.col(c) - 1, F.lit(0))).alias(f"x{c}") for c in "to"])
    stays = lambda c: F.when(F.col(c) > 0, 1 - F.coalesce(f"x{c}", F.lit(0)) / F.col(c)).otherwise(1.0)
    # of counts, so that joins carry small numbers and not what follows from them
    p = lambda c: own(f"n{c}") + F.lit(rest[f"n{c}"]) * shared
    by_itself = logs(p("t"), p("o"))
    words = words.join(over, "w", "left").select("w", *kinds, "t", "o", *[stays(c).alias(f"l{c}") for c in "to"])
    words = tables.keep(words.withColumns({"s": by_itself, "g": logs(F.col("lt"), F.col("lo"))}))
    first = words.where(F.col("w") == int(BORDER)).first()["g"]

    before = words.select(F.col("w").alias("v"), F.col("s").alias("sv"), F.col("g").alias("gv"), *[F.col(x + c).alias(f"{x}{c}v") for x, c in (("", "t"), ("", "o"), ("l", "t"), ("l", "o"))])
    after = twice.withColumnsRenamed({"t": "n_t", "o": "n_o"}).join(words.select("w", *kinds), "w").join(before, "v")
    chance = lambda c: F.when(F.col(f"{c}v") > 0, F.greatest(F.col(f"n_{c}") - 1, F.lit(0)) / F.col(f"{c}v")).otherwise(0.0) + F.col(f"l{c}v") * p(c)
    after = after.withColumns({"b": logs(chance("t"), chance("o")), "s": by_itself})

    @F.arrow_udf("long")
    def key(v: pa.Array, w: pa.Array) -> pa.Array:
        return pa.array(pair_key(v.to_numpy().view(np.uint64), w.to_numpy().view(np.uint64)).view(np.int64))

    edge = F.lit(int(BORDER))
    inside = F.when((F.col("v") != edge) & (F.col("w") != edge), (F.col("sv") + F.col("b")) / 2)  # a border is no word to be toxic
    of_pairs = after.select(key(F.col("v"), F.col("w")).alias("key"), inside.alias("top"), (F.col("b") - F.col("gv") - F.col("s")).alias("more"), (F.col("n_t") + F.col("n_o")).alias("n"), F.lit(True).alias("pair"))
    of_words = words.where(F.col("w") != edge).select(F.col("w").alias("key"), F.col("s").alias("top"), (F.col("s") + F.col("g") - F.lit(unknown)).alias("more"), (F.col("t") + F.col("o")).alias("n"), F.lit(False).alias("pair"))
    return cut(of_words.unionByName(of_pairs).withColumns({c: F.col(c).cast("float") for c in ("top", "more")})), unknown, float(first)


class Known:
    """A sorted part of the model, and the filter of the rest."""

    def __init__(self, part: pa.Table, rest: np.ndarray | None):
        key, order = part["key"].to_numpy(), None
        order = np.argsort(key)
        # a sentinel, so that there is always one
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.top, self.more = [np.append(np.nan_to_num(part[c].to_numpy(zero_copy_only=False)[order], nan=-np.inf), 0.0).astype(np.float32) for c in ("top", "more")]
        self.rest = rest

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether it is here, top, more)."""
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return self.key[at] == keys, self.top[at], self.more[at]

    def elsewhere(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key, which isn't here, may be in the rest of the model."""
        if self.rest is None:
            return np.zeros(len(keys), bool)
        return np.all([(self.rest[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) for p in probes(keys)], axis=0) if len(keys) else np.zeros(0, bool)


def probes(keys: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [mix64(keys.view(np.uint64) + np.uint64(k + 1)) & np.uint64(BITS - 1) for k in range(PROBES)]


def bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of (key), BITS bits whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in columns_of(batches, rows=1 << 20, size=64 << 20):
            p = np.unique(np.concatenate(probes(b.column(0).to_numpy())))
            at, first = np.unique(p >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first) if len(p) else p
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(bits.view(np.int64))], ["at", "bits"])

    found = keys.select("key").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def measure(docs: DataFrame, model: DataFrame, unknown: float, first: float, hot: int = HOT) -> DataFrame:
    """docs (..., text) with `x`, the evidences less those of unknown words, in place of text; all are 0 without words."""
    tables = Tables(docs.sparkSession)
    try:
        with lean(docs.sparkSession):
            return cut(_measure(docs, model, unknown, first, hot, tables))
    finally:
        tables.close()


def _measure(docs: DataFrame, model: DataFrame, unknown: float, first: float, hot: int, tables: Tables) -> DataFrame:
    sc, keep = docs.sparkSession.sparkContext, [c for c in docs.columns if c != "text"]
    rank = F.floor(F.log2("n") * 8)
    room, here = hot, F.lit(True)
    for r in model.groupBy(rank.alias("n")).count().orderBy(F.desc("n")).collect():  # a few hundred rows
        if r["count"] > room:
            # of equally frequent ones a share by their keys, which are hashes
            share = F.pmod(F.col("key"), F.lit(1 << 20)) < room * (1 << 20) // r["count"]
            here = (rank > r["n"]) | ((rank == r["n"]) & share)
            break
        room -= r["count"]
    else:
        room = None
    cold = None if room is None else model.where(~here).drop("n")
    given = sc.broadcast(Known(model.where(here).select("key", "top", "more").toArrow(), None if cold is None else bloom(cold)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Numbered(), given.value
        columns = [np.empty(0, t) for t in (np.uint64, bool, np.float64, np.float64, bool)]
        for b in columns_of(batches, rows=1000, size=1 << 20):
            if len(words) > CACHE:
                words, columns = Numbered(), [c[:0] for c in columns]
            ids, sizes, distinct = words.read(b.column(b.num_columns - 1).to_pylist())
            h = words.hashes()
            seen, top, more = known.look(h.view(np.int64))
            new = [h, seen, np.where(seen, top, unknown), np.where(seen, more, 0.0), ~seen]
            new[4][new[4]] = known.elsewhere(h.view(np.int64)[~seen])
            columns = [np.concatenate(c) for c in zip(columns, new, strict=True)]
            hashes, counted, tops, mores, far = [c[ids] for c in columns]
            some = sizes > 0
            start = np.concatenate([[0], np.cumsum(sizes)])
            begin, best = start[:-1][some], np.full(len(sizes), unknown)
            total = sizes * unknown + first
            row = np.repeat(np.arange(len(sizes)), sizes)
            # pairs, those over a text's border too: a border is before a text's first word and after its last one
            v, w = np.insert(hashes, begin, BORDER), np.insert(hashes, begin + sizes[some], BORDER)
            ok = np.insert(counted | far, begin, True) & np.insert(counted | far, begin + sizes[some], True)
            at, of = np.flatnonzero(ok), np.repeat(np.arange(len(sizes)), sizes + some)
            keys = pair_key(v[at], w[at]).view(np.int64)
            hit, ptop, pmore = known.look(keys)
            away = at[~hit][(on := known.elsewhere(keys[~hit]))]
            if len(begin):
                total[some] += np.add.reduceat(mores, begin)
            np.maximum.at(best, of[at[hit]], ptop[hit])
            # each text's different words that are more toxic than an unknown one, the worst first
            bad = np.unique((row[bad] << 32) + ids[bad] if (bad := tops > unknown).any() else np.empty(0, np.int64))
            owner, value = bad >> 32, columns[2][bad & 0xFFFFFFFF] - unknown
            order = np.lexsort((-value, owner))
            owner, value = owner[order], value[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            value, worst = value[place < WORST], np.bincount(owner[place < WORST], minlength=len(sizes))
            total += np.bincount(of[at[hit]], weights=pmore[hit], minlength=len(sizes))
            lost = np.concatenate([row[far], of[away]])
            missing = np.concatenate([hashes[far].view(np.int64), keys[~hit][on]])
            order = np.lexsort((missing, lost))
            lost, missing = lost[order], missing[order]
            # a text asks once for each key, and says how often it has it
            once = np.flatnonzero(np.append(True, (lost[1:] != lost[:-1]) | (missing[1:] != missing[:-1]))[: len(lost)])
            times = np.diff(np.append(once, len(lost))).astype(np.int32)
            lost, missing = lost[once], missing[once]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(lost, minlength=len(sizes)))]).astype(np.int32)
            tops_at = np.concatenate([[0], np.cumsum(worst)]).astype(np.int32)
            out = [pa.array(sizes), pa.array(distinct), pa.ListArray.from_arrays(pa.array(tops_at), pa.array(value)), pa.array(best), pa.array(total), pa.ListArray.from_arrays(pa.array(offsets), pa.array(missing)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], [*keep, "_n", "_d", "_w", "_p", "_s", "_far", "_times"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    seen = docs.select(*[F.col(f"`{c}`") for c in keep], "text").mapInArrow(read, f"{types}, _n long, _d long, _w array<double>, _p double, _s double, _far array<long>, _times array<int>")
    if cold is not None:
        seen = tables.keep(seen.withColumn("_row", F.monotonically_increasing_id()))
        asked = seen.select("_row", F.explode(F.arrays_zip(F.col("_far").alias("key"), F.col("_times").alias("times"))).alias("a")).select("_row", "a.key", "a.times")
        # the words of one text at most come together, as in reading it
        tops = F.collect_list(F.when(~F.col("pair") & (F.col("top") > unknown), F.col("top") - F.lit(unknown))).alias("_w2")
        found = tables.keep(asked.join(cold, "key").groupBy("_row").agg(tops, F.max(F.when(F.col("pair"), F.col("top"))).alias("_p2"), F.sum(F.col("more") * F.col("times")).alias("_s2")))
        seen = seen.drop("_far", "_times").join(found, "_row", "left")
        merged = F.slice(F.sort_array(F.concat("_w", F.coalesce("_w2", F.array().cast("array<double>"))), asc=False), 1, WORST)
        seen = seen.withColumns({"_w": merged, "_p": F.greatest("_p", "_p2"), "_s": F.col("_s") + F.coalesce("_s2", F.lit(0.0))})
    mean = lambda k: F.when(F.col("_d") > 0, F.aggregate(F.slice("_w", 1, k), F.lit(0.0), lambda a, v: a + v) / F.least("_d", F.lit(k))).otherwise(0.0)
    whole = F.when(F.col("_n") > 0, F.col("_s") / F.col("_n") - F.lit(unknown)).otherwise(0.0)
    # a text without counted pairs has no evidence but that of its words
    return seen.select(*[F.col(f"`{c}`") for c in keep], F.array(*map(mean, range(1, WORST + 1)), F.greatest(F.col("_p") - F.lit(unknown), F.lit(0.0)), whole).alias("x"))


def curve(x: np.ndarray, y: np.ndarray, least: tuple[float, ...] = LEAST, ridge: float = 0.1) -> np.ndarray:
    """Weights of x's columns, none of them under its least one, and the offset of a logistic curve, by Newton's method."""
    low = np.array(least[: x.shape[1]])
    on = np.ones(len(low), bool)  # the weights that aren't held at their least
    while True:
        a, held = np.concatenate([x[:, on], np.ones((len(x), 1))], 1), x[:, ~on] @ low[~on]
        mid = np.append(low[on], 0.0)
        c, pull = np.append(low[on], -4.0), np.append(np.full(on.sum(), ridge), 1e-3)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a @ c + held, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull), a.T @ (y - p) - pull * (c - mid))
            c = c + step * min(1.0, 2 / max(np.abs(step).max(), 1e-300))
            if np.abs(step).max() < 1e-9:
                break
        under = c[:-1] - low[on]
        if not on.any() or under.min() >= 0:
            out = np.append(low, c[-1])
            out[:-1][on] = c[:-1]
            return out
        on[np.flatnonzero(on)[np.argmin(under)]] = False


def key_of(text: F.Column) -> tuple[F.Column, F.Column]:
    """Two hashes of a text."""
    x = F.coalesce(text, F.lit(""))
    return F.xxhash64(x), F.hash(x)


def scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "toxic", label_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(id, a, b, score), a row per row of docs; a and b as in key_of.

    Fold 2 is held out; of the other labelled rows one in CURVE goes to the curve, the rest are counted.
    """
    given = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{label_id}`").alias("id")).agg((F.max(F.col(f"`{label_col}`").cast("int")) > 0).cast("int").alias("y"))
    a, b = key_of(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), a.alias("a"), b.alias("b"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    labelled, for_curve = fold("id") != 2, F.pmod(F.xxhash64("id"), F.lit(CURVE)) == 0
    counted = rows.where(labelled & ~for_curve)
    # of equal texts one counts: copies of a text say nothing more about its words
    first = counted.select("id", "a", "b").join(given, "id").groupBy("a", "b").agg(F.min(F.struct("id", "y")).alias("x"))
    chosen = cut(first.select("x.*", "a", "b"))
    one = counted.join(if_small(chosen), ["id", "a", "b"])
    model = build(one)
    if model is None:
        n = chosen.agg(F.sum("y"), F.count("*")).first()
        constant = 0.0 if not n[0] or n[0] < n[1] else 1.0
        return rows.select("id", "a", "b", F.lit(constant).alias("score"))
    seen = measure(rows, *model, hot)
    known = seen.where(labelled & for_curve).join(given, "id").orderBy(F.xxhash64("id"), "id").limit(FIT).select("y", "x").toPandas()
    y, n = known["y"].to_numpy(float), WORST + 2
    # for too few labels a curve in which weak evidence of a word already counts
    c = curve(np.stack(known["x"].to_list()), y) if 0 < y.sum() < len(y) else np.array([2.0, *LEAST[1:], -4.0])
    z = sum((F.col("x")[k] * float(c[k]) for k in range(n)), F.lit(float(c[n])))
    return seen.select("id", "a", "b", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, hot: int = HOT) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    out = scored(docs, labels, id_col, text_col, hot=hot)
    return out.select(F.col("id").alias(id_col), (fold("id") == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    bad_a, bad_b = free_names(docs, 2)
    bad = scored(docs, labels, id_col, text_col).where(F.col("score") >= threshold).select(F.col("a").alias(bad_a), F.col("b").alias(bad_b)).distinct()
    a, b = key_of(F.col(f"`{text_col}`"))
    return docs.join(if_small(cut(bad)), (a == F.col(bad_a)) & (b == F.col(bad_b)), "left_anti")
