"""License notices in texts: exact base phrases, and short notices with a few edits.

A text's words are what is left between ASCII characters that are neither letters nor digits, after A-Z became a-z;
its word string joins them with single spaces. Base phrases are found as consecutive words. A notice of the list
below may differ by up to `len // 10` edits: it is split into one piece more than that (pigeonhole), an Aho-Corasick
automaton finds the pieces exactly, each hit gives a small window around the place where the notice would stand,
and the regex library's bounded-error matching verifies the edits there and gives the span.

Defined cases: null text counts as empty (no words, no labels, score 0); windows follow hits, never a fixed part of
a text; equal hits are reported once; of matches that overlap, whatever their labels, the one with the fewest edits
counts, then the longest, the earliest, and the first label; a base phrase is a match without edits, and no label of
a base phrase is ever lost; null and repeated ids are rows of their own; rows are neither merged nor dropped; other
columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORDS, columns_of, spread

# Base phrases, and notices as word strings, each with its label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4 0 international license": "cc-by",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "subject to the terms of the mozilla public license": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain under the unlicense": "unlicense",
}
SPAN = "array<struct<label:string,first_word:long,last_word:long,edits:int,matched:string>>"


def blanks_of(line: str) -> list[int]:
    return [m.start() for m in re.finditer(" ", line)]


def budget(notice: str) -> int:
    return len(notice) // 10


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces that cover the text, with their places: `errors` edits leave one of them whole."""
    cuts = [len(text) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Apart:
    """Intervals that don't overlap, in order, with what they stand for."""

    def __init__(self):
        self.starts, self.ends, self.what = [], [], []

    def add(self, a: int, b: int, x: tuple) -> None:
        """Takes the interval from a to b if it overlaps none."""
        k = bisect_left(self.starts, a)
        if (k == 0 or self.ends[k - 1] < a) and (k == len(self.starts) or b < self.starts[k]):
            self.starts.insert(k, a)
            self.ends.insert(k, b)
            self.what.insert(k, x)


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        import ahocorasick
        import regex

        self.base, self.notices, seeds = [(f" {p} ", lab) for p, lab in base.items()], list(notices.items()), {}
        for k, (notice, _) in enumerate(self.notices):
            for at, piece in pieces(notice, budget(notice)):
                seeds.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?<![^ ])(?:{regex.escape(n, special_only=True)}){{e<={budget(n)}}}(?![^ ])") for n, _ in self.notices]

    def exact(self, line: str, blanks: list[int]) -> list[tuple[int, int, str]]:
        """(first word, last word, label) of each place of a base phrase; line has a space at either end, and blanks are
        the places of its spaces."""
        out = []
        for phrase, label in self.base:
            at, size = line.find(phrase), phrase.count(" ") - 2
            while at >= 0:
                first = bisect_left(blanks, at)
                out.append((first, first + size, label))
                at = line.find(phrase, at + 1)
        return out

    def fuzzy(self, line: str, blanks: list[int] | None = None) -> list[tuple[str, int, int, int, str]]:
        """(label, first word, last word, edits, matched text), without overlaps within a label."""
        blanks = blanks_of(line) if blanks is None else blanks
        windows: dict[tuple[int, int], int] = {}
        for end, (size, where) in self.automaton.iter(line):
            for k, at in where:
                start = end + 1 - size - at - budget(self.notices[k][0])
                windows.setdefault((k, start), 0)
        found = []
        reach = -1
        for k, start in sorted(windows):
            notice, label = self.notices[k]
            if (k, start) <= (k, reach) and found and found[-1][0] == k:  # lies within what this notice has matched
                continue
            room = 2 * budget(notice)
            lo, hi = max(0, start - room), start + len(notice) + 2 * room
            if m := self.patterns[k].search(line, lo, min(hi, len(line))):
                s, e = m.span()
                if line[s:e].strip():
                    found.append((k, s, e, sum(m.fuzzy_counts)))
                    reach = e - len(notice)
        best: dict[str, Apart] = {}
        for x in sorted(set(found), key=lambda x: (self.notices[x[0]][1], x[3], x[1], x[2], x[0])):
            best.setdefault(self.notices[x[0]][1], Apart()).add(x[1], x[2] - 1, x)
        out = []
        for k, s, e, edits in sorted((x for kept in best.values() for x in kept.what), key=lambda x: x[1]):
            t = line[s:e].strip()
            first = bisect_left(blanks, s + len(line[s:e]) - len(line[s:e].lstrip())) - 1
            out.append((self.notices[k][1], first, first + t.count(" "), edits, t))
        return out

    @staticmethod
    def settle(spans: list[tuple], base: list[tuple[int, int, str]]) -> list[tuple]:
        """The spans of fuzzy() that overlap neither a better one nor a better base phrase of another label."""
        rank = lambda s: (s[3], -len(s[4]), s[1], s[0])
        taken, phrases = Apart(), {}
        for a, b, label in sorted(base):
            starts, ends = phrases.setdefault(label, ([], []))
            starts.append(a)
            ends.append(max(b, ends[-1] if ends else b))  # the furthest end so far
        for s in sorted(spans, key=rank):
            if not any(label != s[0] and (k := bisect_right(starts, s[2])) and ends[k - 1] >= s[1] for label, (starts, ends) in phrases.items()):
                taken.add(s[1], s[2], s)
        return sorted(taken.what, key=lambda s: (s[1], s[2], s[0]))

    def scan(self, text: str | None) -> tuple:
        words = (text or "").encode().translate(WORDS).split()
        line = f" {b' '.join(words).decode()} "
        blanks = blanks_of(line)
        base = self.exact(line, blanks)
        spans = self.settle(self.fuzzy(line, blanks), base)
        labels = {lab for *_, lab in base}
        longest = {lab: max(len(n) for n, x in self.notices if x == lab) for _, lab in self.notices}
        score = 1.0 if base else max((1 - s[3] / longest[s[0]] for s in spans), default=0.0)
        starts = [w for w, *_ in base]
        return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})), score, spans)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("matched", pa.string())]))]
    keys = ["label", "first_word", "last_word", "edits", "matched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices)
        for b in columns_of(batches):
            rows = [scanner.scan(t) for t in b.column(1).to_pylist()]
            cols = [pa.array([[dict(zip(keys, s, strict=True)) for s in r[i]] if i == 7 else r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPAN}"
    return spread(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
