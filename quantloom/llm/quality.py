"""A quality classifier by co-training two views of a document.

The text view has measures of the whole text and what is learned from its words: the shares of BUCKETS groups of words,
each with a weight of its own. The metadata view has site, language and length. A logistic model of each view is
fitted on labelled rows; over ROUNDS rounds each view labels the unlabelled rows that it is confident of, and the other
view is fitted again with these pseudo-labels. Of the two classes of pseudo-labels the one that is too frequent, going
by the labels, weighs less. Both views are then calibrated and combined by a logistic curve over their log-odds, fitted
on labelled rows that neither view was fitted on, and all documents are scored.

A document's views are taken once and kept. Pseudo-labels cover every unlabelled row: each step of a fit is a sum of
gradients and second derivatives where the rows are, so that only sums reach the driver. Labelled rows are collected,
at most LABELLED of them (those with the smallest hashes of their ids). Rows of fold 2 are held out of all fitting, and
fold 3 is for the combination.

Defined cases: null and empty texts have measures of zero and are scored; null metadata is a value of its own; null
labels don't count, and of several labels of a document the smallest does; with labels of one class only every score
is that class, with none 0.5; without confident rows of both classes there are no pseudo-labels; a text of any length
is read whole and becomes a fixed number of values; rows are neither merged nor dropped, repeated rows and ids score
alike; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, WordHashes, columns_of, cut, fold

LABELLED, ROUNDS, STEPS, CONFIDENT = 20_000, 3, 6, 0.97
THRESHOLD = 0.5
#: Groups of words, of sites and of languages; words of a passage that is looked for twice.
BUCKETS, SITES, LANGUAGES, PASSAGE = 64, 64, 16, 8
MEASURES, GROUPS = 15, 30.0
NOT_PLAIN = re.compile(rb"[!-/:-@\[-`{-~]")


def measures(text: str | None, hashes: WordHashes) -> np.ndarray:
    """MEASURES numbers about a whole text, and the roots of the shares of its words' groups."""
    data = (text or "").encode()
    words, out = data.split(), np.zeros(MEASURES + BUCKETS, np.float32)
    if not words:
        return out
    n, size = len(words), len(data)
    lines = [x for x in data.split(b"\n") if x.strip()]
    count = lambda a, b: sum(map(data.count, (bytes([c]) for c in range(a, b + 1)))) / size
    marks = len(NOT_PLAIN.findall(data)) / n
    h = hashes.array(words)
    with np.errstate(over="ignore"):
        passages = np.zeros(max(1, n - PASSAGE + 1), np.uint64)
        for i in range(min(PASSAGE, n)):
            passages = (passages + h[i : i + len(passages)]) * np.uint64(0x9E3779B97F4A7C15)
    out[:MEASURES] = [
        np.log1p(n), size / n, sum(map(bytes.isupper, words)) / n, count(65, 90), count(48, 57), marks, len(set(words)) / n, len(np.unique(passages)) / len(passages), len(set(lines)) / len(lines),
        np.log1p(n / len(lines)), max(map(len, words)) ** 0.5, data.count(b"!") / n, data.count(b".") / n, sum(w[-1] in b"%#$&*@" for w in words) / n, data.count(b" the ") / n,
    ]
    plain = hashes.array(data.translate(WORDS).split())
    out[MEASURES:] = np.sqrt(np.bincount((plain % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS) / max(len(plain), 1))
    return out


def text_view(text: F.Column) -> F.Column:
    @F.arrow_udf("array<float>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes(100_000)
        for t in texts:
            flat = np.concatenate([np.empty(0, np.float32), *[measures(x.as_py(), hashes) for x in t]])
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * (MEASURES + BUCKETS)), pa.array(flat))

    return run(text)


def views_of(table: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The two views of rows with t, site, lang and size, as matrices."""
    n = table.num_rows
    lists = table.column("t")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    text = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, MEASURES + BUCKETS)
    meta, at = np.zeros((n, SITES + LANGUAGES + 1)), np.arange(n)
    for name, start in (("site", 0), ("lang", SITES)):
        meta[at, start + table.column(name).to_numpy()] = 1.0
    meta[:, -1] = table.column("size").to_numpy()
    return text, meta


def sums(a: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives of the weighted log-likelihood at c."""
    p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
    return a.T @ (w * (y - p)), (a * (w * p * (1 - p))[:, None]).T @ a


@dataclass
class Logistic:
    """A logistic model over standardised values."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    ridge: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, ridge: np.ndarray | float = 1.0) -> Logistic:
        scale = np.maximum(x.std(0), 1e-9)
        scale[x.std(0) < 1e-9] = 1e9
        out = Logistic(x.mean(0), scale, np.zeros(x.shape[1] + 1), np.append(np.broadcast_to(ridge, x.shape[1]), 1e-3))
        a = out.design(x)
        for _ in range(40):
            if out.step(*sums(a, y, np.ones(len(y)), out.weights)) < 1e-8:
                break
        return out

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], 1)

    def step(self, gradient: np.ndarray, second: np.ndarray) -> float:
        """One of Newton's steps; how far it went."""
        step = np.linalg.solve(second + np.diag(self.ridge), gradient - self.ridge * self.weights)
        self.weights = self.weights + step
        return float(np.abs(step).max())

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.weights


def pseudo_labels(z: np.ndarray, line: float, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """What a view with log-odds z says of rows, and with which weight: none where it isn't confident."""
    return (z > 0).astype(float), np.where(z > line, weights[1], np.where(z < -line, weights[0], 0.0))


class Pool:
    """The unlabelled rows (t, site, lang, size), where they are."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def counts(self, models: list[Logistic], line: float) -> list[tuple[int, int]]:
        """Of each view how many rows it is sure are bad and good."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 2), np.int64)
            for b in columns_of(batches, rows=20_000):
                for k, (m, v) in enumerate(zip(models, views_of(b), strict=True)):
                    z = m.logit(v)
                    total[k] += [(z < -line).sum(), (z > line).sum()]
            yield pa.RecordBatch.from_arrays([pa.array(total.ravel()[i : i + 1]) for i in range(4)], list("abcd"))

        r = self.rows.mapInArrow(run, "a long, b long, c long, d long").agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in "abcd"]).first()
        return [(r[0], r[1]), (r[2], r[3])]

    def sums(self, teachers: list[Logistic], weights: list[tuple[float, float]], line: float, models: list[Logistic]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each view's model the sums over the rows that the other view is confident of."""
        widths = [len(m.weights) for m in models]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros((w + 1, w)) for w in widths]
            for b in columns_of(batches, rows=20_000):
                views = views_of(b)
                for k in (0, 1):
                    y, w = pseudo_labels(teachers[1 - k].logit(views[1 - k]), line, weights[1 - k])
                    on = w > 0
                    gradient, second = sums(models[k].design(views[k][on]), y[on], w[on], models[k].weights)
                    total[k] += np.concatenate([gradient[None], second])
            flat = np.concatenate([t.ravel() for t in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["k", "v"])

        found = self.rows.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(sum(w * (w + 1) for w in widths))
        flat[found["k"].to_numpy()] = found["v"].to_numpy()
        split = np.split(flat, [widths[0] * (widths[0] + 1)])
        return [(x.reshape(w + 1, w)[0], x.reshape(w + 1, w)[1:]) for x, w in zip(split, widths, strict=True)]


def ridges(width: int) -> np.ndarray:
    """The text view's groups of words are many and each says little, so they are held closer to zero than measures."""
    return np.concatenate([np.ones(MEASURES), np.full(BUCKETS, GROUPS)]) if width == MEASURES + BUCKETS else np.ones(width)


def balance(bad: int, good: int, share: float) -> tuple[float, float]:
    """Weights of pseudo-labels, half of a label's at most, that bring the classes to the share of good labels."""
    return 0.5 * min(1.0, (1 - share) * good / max(share * bad, 1e-9)), 0.5 * min(1.0, share * bad / max((1 - share) * good, 1e-9))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: Pool, rounds: int = ROUNDS, confident: float = CONFIDENT) -> list[Logistic]:
    """Two models. In each round what a view is confident of in the pool becomes pseudo-labels for the other one."""
    models, line, share = [Logistic.fit(v, y, ridges(v.shape[1])) for v in views], float(np.log(confident / (1 - confident))), float(y.mean())
    known = [m.design(v) for m, v in zip(models, views, strict=True)]
    for _ in range(rounds):
        weights = [balance(*n, share) for n in pool.counts(models, line)]
        teachers = [Logistic(m.mean, m.scale, m.weights, m.ridge) for m in models]
        for _ in range(STEPS):
            far = 0.0
            for m, a, (gradient, second) in zip(models, known, pool.sums(teachers, weights, line, models), strict=True):
                g, h = sums(a, y, np.ones(len(y)), m.weights)
                far = max(far, m.step(g + gradient, h + second))
            if far < 1e-6:
                break
    return models


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", label_col: str = "quality", label_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, held_out, text_score, metadata_score, score, predicted (1: good)."""
    c = lambda name: F.col(f"`{name}`")
    group = lambda name, n: F.pmod(F.xxhash64(F.coalesce(c(name).cast("string"), F.lit("\0"))), F.lit(n)).cast("int")
    length = F.log1p(F.greatest(F.coalesce(c(size_col).cast("double"), F.lit(0.0)), F.lit(0.0)))
    base = cut(docs.select(c(id_col).alias("id"), fold(id_col).alias("part"), text_view(c(text_col)).alias("t"), group(site_col, SITES).alias("site"), group(lang_col, LANGUAGES).alias("lang"), length.alias("size")))
    given = labels.where(c(label_col).isNotNull() & c(label_id).isNotNull()).groupBy(c(label_id).alias("id")).agg((F.min(c(label_col).cast("int")) > 0).cast("int").alias("y"))
    given = cut(given)
    chosen = given.where(fold("id") != 2).orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    rows = base.join(F.broadcast(chosen), "id").toArrow()  # at most LABELLED keys
    marks, part = rows["y"].to_numpy().astype(float), rows["part"].to_numpy()
    fit, hold = part < 2, part == 3
    y = marks[fit]
    if not len(y) or y.min() == y.max():
        constant = F.lit(0.5 if not len(y) else float(y[0]))
        scored = base.select("id", "part", constant.alias("text_score"), constant.alias("metadata_score"), constant.alias("score"))
    else:
        views = views_of(rows)
        spare = base.where("part != 2 AND id IS NOT NULL").join(given, "id", "left_anti").select("t", "site", "lang", "size")
        models = co_train((views[0][fit], views[1][fit]), y, Pool(cut(spare)))
        calm = hold if hold.any() and np.ptp(marks[hold]) > 0 else fit
        both = Logistic.fit(np.stack([m.logit(v[calm]) for m, v in zip(models, views, strict=True)], 1), marks[calm])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in columns_of(batches, rows=20_000):
                z = np.stack([m.logit(v) for m, v in zip(models, views_of(b), strict=True)], 1)
                scores = [pa.array(1 / (1 + np.exp(-np.clip(x, -700, 700)))) for x in (z[:, 0], z[:, 1], both.logit(z))]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("part"), *scores], ["id", "part", "text_score", "metadata_score", "score"])

        scored = base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, part {base.schema['part'].dataType.simpleString()}, text_score double, metadata_score double, score double")
    return scored.select(F.col("id").alias(id_col), (F.col("part") == 2).alias("held_out"), "text_score", "metadata_score", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
