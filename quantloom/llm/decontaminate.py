"""Benchmark decontamination by pigeonhole edit matching.

Words are what is left between ASCII characters that are neither letters nor digits, after A-Z became a-z. An item of
n words may stand in a text with up to budget(n) word edits (a word put in, left out or changed). It is split into
one piece more than that, so that one piece is untouched wherever it stands; the first SEED words of each piece, or
all if it has fewer, are its seed. The seeds of all texts are compared by hash in one vectorised pass; seed hits give windows, overlapping windows
of an item are joined, and Myers' bit-parallel algorithm finds the least distance in each.

Items are read in blocks of about BLOCK bytes, and each block is broadcast and goes over all rows by itself; with more
items there are more blocks, never a larger one, and what a block has found is kept before the next one.

Defined cases: null texts and texts without words match nothing; nor do items without words; items of so few words
that RATE of them is less than one must stand exactly; a text of any length is read whole; of an item's places in a text the one with the least distance counts, then the
first; repeated rows and ids are rows of their own; equal item ids are items of their own; an empty table on either
side gives no matches; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORDS, WordHashes, columns_of, cut, free_names, if_small, mix64, spread

SEED, RATE = 5, 0.15
BLOCK = 8 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def budget(n: int, rate: float = RATE) -> int:
    """Word edits that an item of n words may have; always fewer than n, so that no piece is empty."""
    return min(int(n * rate), max(n - 1, 0))


def pieces(n: int, errors: int) -> list[tuple[int, int]]:
    cuts = [n * i // (errors + 1) for i in range(errors + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    n = len(h) - k + 1
    out = np.full(max(n, 0), k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k if n > 0 else 0):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def myers(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """(least distance of the pattern to a part of the text, where the first such part ends)."""
    m = len(pattern)
    eq: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        e = eq.get(w, 0)
        d0 = (((e & pv) + pv) ^ pv | e | mv) & full
        hp, hn = mv | (full & ~(d0 | pv)), pv & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        pv, mv = hn | (full & ~(d0 | hp)), hp & d0
        if score < best:
            best, end = score, j + 1
    return best, end


class Finder:
    """Seeds of one block of items, and the matches of a text."""

    def __init__(self, items: list[tuple[object, str | None]], rate: float):
        self.hashes, self.items, seeds = WordHashes(), [], {}
        for key, text in items:
            words = words_of(text)
            if not words:
                continue
            errors, number = budget(len(words), rate), len(self.items)
            self.items.append((key, words, errors))
            h = self.hashes.array(words)
            for a, b in pieces(len(words), errors):
                k = min(SEED, b - a)
                seeds.setdefault(k, {}).setdefault(int(grams(h[a : a + k], k)[0]), []).append((number, a))
        self.seeds = {k: (np.array(sorted(v), np.uint64), v) for k, v in seeds.items()}

    def matches(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item, distance, first word, words after the last)."""
        words = words_of(text)
        if not words:
            return []
        h, windows = self.hashes.array(words), {}
        for k, (known, where) in self.seeds.items():
            g = grams(h, k)
            at = np.searchsorted(known, g)
            for q in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == g).tolist():
                for number, offset in where[int(g[q])]:
                    n, errors = len(self.items[number][1]), self.items[number][2]
                    windows.setdefault(number, set()).add((max(0, q - offset - errors), min(len(words), q - offset + n + errors)))
        out = []
        for number, spans in windows.items():
            key, item, errors = self.items[number]
            joined: list[list[int]] = []
            for a, b in sorted(spans):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            found = []
            for a, b in joined:
                distance, end = myers(item, words[a:b])
                if distance <= errors:
                    back = words[max(a, a + end - len(item) - errors) : a + end][::-1]
                    found.append((distance, a + end - myers(item[::-1], back)[1], a + end))
            if found:
                out.append((key, *min(found)))
        return out


def blocks(items: DataFrame, item_id: str, item_text: str) -> tuple[int, Iterator[list[tuple[object, str | None]]]]:
    """How many blocks of about BLOCK bytes the items make, and the blocks, read one at a time."""
    rows = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = 1 + size // BLOCK

    def read() -> Iterator[list[tuple[object, str | None]]]:
        for part in range(parts):
            block = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part) if parts > 1 else rows
            yield sorted(((r.i, r.t) for r in block.collect()), key=lambda x: (str(x[0]), x[1]))

    return parts, read()


def over_blocks(items: DataFrame, item_id: str, item_text: str, scan: Callable[[Broadcast], DataFrame]) -> DataFrame:
    """What `scan` gives for each block of the items. With several blocks each one's result is kept before the next is
    read, so that no task holds more than one."""
    parts, each = blocks(items, item_id, item_text)
    out, sc = None, items.sparkSession.sparkContext
    for block in each:
        shared = sc.broadcast(block)
        found = scan(shared)
        if parts > 1:
            found = cut(found)
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def find_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per text and item that stands in it: id, item_id, distance, first_word, last_word."""
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_id].dataType
    rows, item_arrow = spread(docs, id_col, text_col), to_arrow_type(item_kind)

    def scan(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, rate)
            for b in columns_of(batches):
                hits = [(i, *m) for i, t in enumerate(b.column(1)) for m in finder.matches(t.as_py())]
                col = list(zip(*hits, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(col[0], pa.int64())), pa.array(col[1], item_arrow), pa.array(col[2], pa.int32()), pa.array(col[3], pa.int64()), pa.array([x - 1 for x in col[4]], pa.int64())], ["id", "item", "distance", "first_word", "last_word"])

        return rows.mapInArrow(run, f"id {kind.simpleString()}, item {item_kind.simpleString()}, distance int, first_word long, last_word long")

    return over_blocks(items, item_id, item_text, scan).withColumnsRenamed({"id": id_col, "item": item_id})


def _clean(block: Broadcast, rate: float) -> Callable[[F.Column], F.Column]:
    """A function of texts: whether no item of the block stands in one."""

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(block.value, rate)
        for t in texts:
            yield pa.array([not finder.matches(x.as_py()) for x in t], pa.bool_())

    return clean


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of docs in which no item stands, with all their columns. One block is looked for where the rows are;
    several give the hashes of the texts that have items of theirs, which then go."""
    text = F.col(f"`{text_col}`")
    parts, each = blocks(items, item_id, item_text)
    if parts == 1:
        return docs.where(_clean(docs.sparkSession.sparkContext.broadcast(next(each)), rate)(text))
    a, b = free_names(docs, 2)
    keys = docs.select(F.xxhash64(text).alias(a), F.hash(text).alias(b), text.alias("t"))
    bad = over_blocks(items, item_id, item_text, lambda block: keys.where(~_clean(block, rate)(F.col("t"))).select(a, b))
    return docs.join(if_small(cut(bad.distinct())), (F.xxhash64(text) == F.col(a)) & (F.hash(text) == F.col(b)), "left_anti")
