"""Sampled segmentations into pieces, and their lossless decoding.

The pieces and their order come from a SentencePiece model file. A piece's weight is (rank + 1) ** -alpha, its rank
being its place in the model's order of scores; a character that no piece holds is spelled with the model's byte
pieces. A text's segmentation is drawn with a probability in proportion to the product of its pieces' weights:
forward filtering sums the weights over the lattice of pieces, backward sampling draws from the end. No piece goes
across the start of a word, so the lattice of a text is a chain of its chunks' lattices: a run of spaces with the word
after it is a chunk. Each distinct chunk is filtered once while its beginning is remembered, and all chunks of a batch
are sampled together. A chunk of more than LONG characters is filtered whole as well, but not remembered: its weights
are kept in scale, and only those of as many characters as the longest piece has are needed at a time.

Draws are 32-bit integers from a counter-based hash of (seed, row key, chunk number, draw number), and cumulated
weights are rounded to 32 bits: a row has the same segmentation in whatever task or cluster.

Defined cases: null text gives null, empty text gives no pieces; a null key is a key of its own; rows with equal key
and text have equal segmentations; every text decodes to itself, also one that holds the model's space sign; unknown
or special pieces in decoding stand for nothing; null decodes to null; a text of any length is one lattice, whose size
grows with the text alone; pieces of the model with a space after another character aren't used.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import mix64

ALPHA, SEED = 0.5, 0
SPACE = "▁"
#: Remembered lattice nodes (about 200 bytes each), and the characters of text that are sampled at a time.
NODES, BATCH = 800_000, 2 << 20
LONG = 48
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def load(path: str) -> tuple[dict[str, tuple[int, int]], list[int], list[bytes]]:
    """(piece with plain spaces -> (id, rank)), the ids of the 256 bytes, and the bytes that each id stands for."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    spelled, byte_ids, pieces, scores = [b""] * n, [0] * 256, {}, []
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)], spelled[i] = i, bytes([int(piece[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            spelled[i] = piece.replace(SPACE, " ").encode()
            if SPACE not in piece.lstrip(SPACE):
                scores.append((-sp.get_score(i), i, piece.replace(SPACE, " ")))
    for rank, (_, i, piece) in enumerate(sorted(scores)):
        pieces[piece] = (i, rank)
    return pieces, byte_ids, spelled


def char_class(chars: set[str]) -> str:
    """A regular expression's class of these characters, as ranges."""
    out, codes = [], sorted(map(ord, chars))
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Lattice:
    def __init__(self, path: str, alpha: float = ALPHA, seed: int = SEED):
        self.pieces, self.byte_ids, self.spelled = load(path)
        self.seed, self.ascii = seed, np.array(self.byte_ids[:128], np.int32)
        self.weight = {p: (i, float(r + 1) ** -alpha) for p, (i, r) in self.pieces.items()}
        self.byte_weight = float(len(self.pieces) + 1) ** -alpha
        self.ends, self.longest = {p[k:] for p in self.pieces for k in range(1, len(p))}, max(map(len, self.pieces))
        # no piece that can be used goes across: the start of a word, a character that is a piece by itself only, and
        # the border of letters and other characters, unless this model has pieces that do
        joined = {c for p in self.pieces if len(p.strip(" ")) > 1 or (len(p) > 1 and p[0] == " ") for c in p.strip(" ")}
        letters = {c for c in joined if c.isalpha()}
        if any(len({c in letters for c in p.strip(" ")}) > 1 for p in self.pieces):
            letters = set()
        kinds = [char_class(x) for x in (letters, joined - letters) if x]
        self.chunk = re.compile("".join(f" *[{k}]+|" for k in kinds) + f" +|[^ {''.join(kinds)}]")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # beginning of a chunk -> its node; a node's beginnings are known too
        self.level = array("d")  # of each node: the summed weights of all ways to it
        self.cum, self.id, self.back = array("Q"), array("i"), array("i")  # of each edge: node and cumulated weight, piece, node before (-1: the start)

    def learn(self, s: str) -> int:
        """Filter one chunk forwards, from the longest beginning that is known; its last node."""
        if len(s) > LONG:
            return self.learn_long(s)
        known, level, weight, ends = self.known, self.level, self.weight, self.ends
        done, size = len(s) - 1, len(s)
        while done and s[:done] not in known:
            done -= 1
        nodes = [-1] * (done + 1)
        for i in range(max(1, done + 1 - self.longest), done + 1):
            nodes[i] = known[s[:i]]
        add_cum, add_id, add_back = self.cum.append, self.id.append, self.back.append
        for j in range(done + 1, size + 1):
            i, node, total, found = j - 1, len(level), 0.0, []
            part = s[i]
            got = weight.get(part) or (-1 - ord(part), self.byte_weight ** len(part.encode()))
            while True:
                if got is not None:
                    total += (level[nodes[i]] if i else 1.0) * got[1]
                    found.append((total, got[0], nodes[i]))
                i -= 1
                if i < 0 or part not in ends:
                    break
                part = s[i:j]
                got = weight.get(part)
            top = node << 32
            scale, last = 4294967295.0 / total, found.pop()
            for so_far, piece, back in found:
                add_cum(top + int(so_far * scale))
                add_id(piece)
                add_back(back)
            add_cum(top + 4294967295)
            add_id(last[1])
            add_back(last[2])
            level.append(total)
            nodes.append(node)
            known[s[:j]] = node
        return nodes[-1]

    def learn_long(self, s: str) -> int:
        """The same for a chunk whose beginnings aren't remembered; weights are relative to each other."""
        weight, ends, first = self.weight, self.ends, len(self.level)
        add_cum, add_id, add_back = self.cum.append, self.id.append, self.back.append
        level = [1.0]  # of the start and of each character, as far back as a piece reaches
        for j in range(1, len(s) + 1):
            i, k, total, found = j - 1, len(level) - 1, 0.0, []
            part = s[i]
            got = weight.get(part) or (-1 - ord(part), self.byte_weight ** len(part.encode()))
            while True:
                if got is not None:
                    total += level[k] * got[1]
                    found.append((total, got[0], first + i - 1 if i else -1))
                i, k = i - 1, k - 1
                if k < 0 or part not in ends:
                    break
                part = s[i:j]
                got = weight.get(part)
            top = (first + j - 1) << 32
            scale, last = 4294967295.0 / total, found.pop()
            for so_far, piece, back in found:
                add_cum(top + int(so_far * scale))
                add_id(piece)
                add_back(back)
            add_cum(top + 4294967295)
            add_id(last[1])
            add_back(last[2])
            self.level.append(total)
            level.append(total)
            if len(level) > self.longest:
                del level[0]
            if total < 1e-200:
                level = [x / total for x in level]
        return first + len(s) - 1

    def encode(self, texts: list[str | None], keys: list[object]) -> list[np.ndarray | None]:
        import xxhash

        out: list = []
        for text, key in zip(texts, keys, strict=True):
            row = xxhash.xxh64_intdigest(b"" if key is None else f"k{key}".encode(), seed=int(self.seed))
            out.append(None if text is None else (text, np.uint64(row)))
        todo, size = [], 0
        for k, x in enumerate(out):
            if x is not None:
                todo.append(k)
                size += len(x[0])
            if todo and (size >= BATCH or k == len(out) - 1):
                for i, ids in zip(todo, self._batch([out[i] for i in todo]), strict=True):
                    out[i] = ids
                todo, size = [], 0
        if todo:
            for i, ids in zip(todo, self._batch([out[i] for i in todo]), strict=True):
                out[i] = ids
        return out

    def _batch(self, rows: list[tuple[str, np.uint64]]) -> list[np.ndarray]:
        chunks = [self.chunk.findall(" " + t) if t else [] for t, _ in rows]
        if len(self.level) > NODES:
            self.forget()
        known, sizes = self.known, np.array([len(c) for c in chunks], np.int64)
        at: list = list(map(known.get, chain.from_iterable(chunks)))
        if None in at:
            every = list(chain.from_iterable(chunks))
            for k, s in enumerate(every):
                if at[k] is None:
                    at[k] = known[s] if s in known else self.learn(s)
        node = np.array(at, np.int64)
        number = np.arange(len(node), dtype=np.uint64) - np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes).astype(np.uint64)
        with np.errstate(over="ignore"):
            draw = mix64(np.repeat(np.array([r for _, r in rows], np.uint64), sizes) + (number + np.uint64(1)) * GOLDEN)
        cum, ids, back = np.frombuffer(self.cum, np.uint64), np.frombuffer(self.id, np.int32), np.frombuffer(self.back, np.int32)
        live, steps, turn = np.arange(len(node)), [], np.uint64(1)
        while len(live):
            with np.errstate(over="ignore"):
                u = mix64(draw[live] + turn * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)
            edge = np.searchsorted(cum, (node[live].astype(np.uint64) << np.uint64(32)) + u, side="left")
            steps.append((live, ids[edge]))
            node[live] = b = back[edge]
            live, turn = live[b >= 0], turn + np.uint64(1)
        del cum, ids, back
        if not steps:
            return [np.empty(0, np.int32) for _ in rows]
        # the last piece of a chunk was drawn first
        counts = np.bincount(np.concatenate([x for x, _ in steps]), minlength=len(node))
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]), np.int32)
        for k, (x, p) in enumerate(steps):
            flat[ends[x] - 1 - k] = p
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(sizes)))]
        return [self._spell(flat[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]

    def _spell(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece, kept as -1 less their code until here, as byte pieces."""
        ids = np.where((ids < 0) & (ids >= -128), self.ascii[np.clip(-1 - ids, 0, 127)], ids)
        if not (ids < 0).any():
            return ids
        out: list[int] = []
        for i in ids.tolist():
            out.extend([i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode()])
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        known = ids if not len(ids) or (ids.min() >= 0 and ids.max() < len(self.spelled)) else ids[(ids >= 0) & (ids < len(self.spelled))]
        return b"".join(map(self.spelled.__getitem__, known.tolist()))[1:].decode(errors="replace")


_loaded: dict[tuple, Lattice] = {}


def lattice(path: str, alpha: float, seed: int) -> Lattice:
    """One for each worker process, so that chunks stay known from task to task."""
    if (key := (path, alpha, seed)) not in _loaded:
        _loaded[key] = Lattice(path, alpha, seed)
    return _loaded[key]


def _lists(found: list[np.ndarray | None]) -> pa.Array:
    some = [x if x is not None else np.empty(0, np.int32) for x in found]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in some]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *some])), mask=pa.array([x is None for x in found]))


def encode(text: F.Column, key: F.Column, path: str, alpha: float = ALPHA, seed: int = SEED) -> F.Column:
    """A column of piece ids, sampled by row key."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        made = lattice(path, alpha, seed)
        for texts, keys in batches:
            parts = [_lists(made.encode(texts[i : i + 1000].to_pylist(), keys[i : i + 1000].to_pylist())) for i in range(0, len(texts), 1000)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return run(text, key.cast("string"))


def encode_and_check(text: F.Column, key: F.Column, path: str, alpha: float = ALPHA, seed: int = SEED) -> F.Column:
    """A column of (ids, lossless): sampled piece ids, and whether they decode to the text; null for null."""

    @F.arrow_udf("struct<ids:array<int>,lossless:boolean>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        made = lattice(path, alpha, seed)
        for texts, keys in batches:
            ids, same = [], []
            for i in range(0, len(texts), 1000):
                own = texts[i : i + 1000].to_pylist()
                found = made.encode(own, keys[i : i + 1000].to_pylist())
                same += [None if x is None else made.decode(x) == t for x, t in zip(found, own, strict=True)]
                ids.append(_lists(found))
            yield pa.StructArray.from_arrays([pa.concat_arrays(ids) if ids else pa.array([], pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["ids", "lossless"])

    return run(text, key.cast("string"))


def decode(ids: F.Column, path: str) -> F.Column:
    """The texts that piece ids stand for."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = lattice(path, ALPHA, SEED)
        for b in batches:
            yield pa.array([None if x.values is None else made.decode(x.values.drop_null().to_numpy(zero_copy_only=False)) for x in b], pa.string())

    return run(ids)
