"""Token counts of whole texts, with overlap resynchronisation for huge ones.

Ordinary texts are cut where the vocabulary's own pre-tokenizer always cuts (before a run of white space that
follows other characters), and the tokenizers library gives each distinct piece's count once per task.
A text of more than HUGE characters is encoded in chunks that overlap. Both chunks' pre-token boundaries are read
from the library's offsets and word numbers; a position in the overlap is a proven boundary if both have it, and if
the left chunk has a whole pre-token after it that ends well before the chunk does: the pre-tokenizer reads from
left to right and looks ahead one character at most, so from a common boundary on both see the same. The counts
are spliced there. Where no such position exists the overlap is widened, up to the whole text.

Defined cases: null text counts as empty (0 bytes, 0 tokens); special strings inside texts are what the library's
default makes of them; rows are neither merged nor dropped, whatever their ids; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns_of, spread

HUGE, CHUNK, OVERLAP = 32_768, 16_384, 512
#: No chunk's end may disturb what lies further before it: longer than any special string.
MARGIN = 64
#: White space in Unicode, as the pre-tokenizer's \s.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECE = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
CACHE = 400_000


class Counter:
    """Counts with one tokenizers file. Pieces' counts are remembered up to CACHE of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok, self.seen = Tokenizer.from_file(path), {}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def ids(self, texts: list[str]) -> list:
        return self.tok.encode_batch_fast(texts, add_special_tokens=False)

    def counts(self, texts: list[str]) -> list[int]:
        """Of texts that aren't huge."""
        pieces, whole, seen = [], [], self.seen
        for t in texts:
            if any(s in t for s in self.special):
                whole.append(t)
                pieces.append(None)
            else:
                pieces.append(PIECE.findall(t))
        if len(seen) > CACHE:
            seen.clear()
        new = list({p for ps in pieces if ps for p in ps if p not in seen})
        for i in range(0, len(new), 10_000):
            seen.update(zip(new[i : i + 10_000], map(len, self.ids(new[i : i + 10_000])), strict=True))
        direct = iter(map(len, self.ids(whole)))
        return [next(direct) if ps is None else sum(map(seen.__getitem__, ps)) for ps in pieces]

    def marks(self, text: str, start: int) -> tuple[list[int], list[int], int]:
        """Where pre-tokens begin, the tokens before each, and the tokens in all."""
        e = self.tok.encode_batch([text], add_special_tokens=False)[0]
        at, before, last = [], [], object()
        for k, (word, (i, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word is None or word != last:
                at.append(start + i)
                before.append(k)
            last = word
        return at, before, len(e)

    def huge(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """The count of one text, holding two chunks at a time."""
        n, total, start = len(text), 0, 0
        left = self.marks(text[:chunk], 0)
        done, end = 0, min(chunk, n)  # tokens of the left chunk that are already counted; where it ends
        while end < n:
            wide, p = overlap, None
            while p is None and wide < end - start:
                right_start = end - wide
                right_end = min(right_start + max(chunk, 2 * wide), n)
                right = self.marks(text[right_start:right_end], right_start)
                known, ok = set(right[0]), left[0]
                # the pre-token after the mark must be whole and end MARGIN before the chunk's end
                p = next((k for k in range(len(ok) - 2, -1, -1) if ok[k + 1] <= end - MARGIN and left[1][k] >= done and ok[k] in known and ok[k] > right_start), None)
                wide *= 2
            if p is None:  # no boundary in the whole left chunk: a longer one
                chunk_end = min(n, start + 2 * (end - start))
                left = self.marks(text[start:chunk_end], start)
                done, end = 0 if start == 0 else left[1][left[0].index(self._from)], chunk_end
                continue
            at = left[0][p]
            total += left[1][p] - done
            done, left, start, end, self._from = right[1][right[0].index(at)], right, right_start, right_end, at
        return total + left[2] - done


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. The file at tokenizer_path must be on every machine."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for b in columns_of(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            small = iter(counter.counts([t for t in texts if len(t) <= huge]))
            tokens = [next(small) if len(t) <= huge else counter.huge(t, chunk, overlap) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])], ["id", "n_bytes", "n_tokens", "over_limit"])

    out = spread(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
