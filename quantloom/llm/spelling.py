"""Spelling variants: words one letter apart, found by anagram hashing, and the form that each goes back to.

A word's anagram key is the sum of a power of each of its letters, so a letter more, less or other changes the key by a
letter's value, or by the difference of two. For each different letter of a word the key without it is a row: words that
share such a key differ by one exchange, and a word whose whole key is one of those lacks a letter of the other. Of two
such words the half before or the half after the place of the change is equal, so the key is joined together with a
half, which keeps the groups small; the order of the letters is then verified (edit distance 1).

Defined cases: null text has no words; a null id counts as empty text; repeated rows count each; words of any length
take part (keys are residues, so they can't overflow); of near words of equal counts the smallest is the form; without
words the result is empty; only the id and the text are read, so other columns' names can't clash.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Runs of letters; the power of a letter; keys are residues of this prime, so that a sum of two fits in 64 bits.
LETTERS, POWER, PRIME = r"[A-Za-zÀ-ÿ]+", 5, (1 << 61) - 1


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the lower-cased words of at least `shortest` letters that stand at least `least` times. Where `slip`
    divides the checksum of a text's id and a word, a letter of that word is left out first."""
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(LETTERS), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut_one = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % slip == 0, cut_one).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def letter_value(letter: F.Column) -> F.Column:
    """The letter's power, below the prime for code points up to 5,000."""
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def keyed(words: DataFrame) -> DataFrame:
    """(word, n, whole, anagram, half): whole keys, and those without one letter, each with the letters before and with
    those after the middle of what is left."""
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    total = F.aggregate("c", F.lit(0).cast("long"), lambda s, c: (s + letter_value(c)) % PRIME)
    base = words.withColumn("c", letters).withColumn("key", total).withColumn("m", F.size("c"))
    less = base.select("word", "n", F.lit(False).alias("whole"), (F.col("m") - 1).alias("rest"), F.explode(F.array_distinct("c")).alias("d"), "key")
    less = less.select("word", "n", "whole", "rest", F.pmod(F.col("key") - letter_value(F.col("d")), F.lit(PRIME)).alias("anagram"))
    both = base.select("word", "n", F.lit(True).alias("whole"), F.col("m").alias("rest"), F.col("key").alias("anagram")).unionByName(less)
    mid = F.floor(F.col("rest") / 2).cast("int")
    after = mid + F.when(F.col("whole"), 1).otherwise(2)
    ends = F.array(F.xxhash64("rest", F.lit("before"), F.substring(F.col("word"), F.lit(1), mid)), F.xxhash64("rest", F.lit("after"), F.substring(F.col("word"), after, F.length("word"))))
    return both.select("word", "n", "whole", "anagram", F.explode(ends).alias("half"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, m) of all words one letter apart, both ways. words should be cut."""
    rows = keyed(words)
    a = rows.select("anagram", "half", F.col("word").alias("x"), F.col("n").alias("nx"), F.col("whole").alias("wx"))
    b = rows.select("anagram", "half", F.col("word").alias("y"), F.col("n").alias("ny"), F.col("whole").alias("wy"))
    # a whole key meets keys without a letter; those meet each other once
    met = a.join(b, ["anagram", "half"]).where(~F.col("wy") & (F.col("wx") | (F.col("x") < F.col("y"))) & (F.levenshtein("x", "y", 1) == 1))
    pairs = met.select("x", "nx", "y", "ny").distinct()
    return pairs.select(F.col("x").alias("word"), F.col("nx").alias("n"), F.col("y").alias("other"), F.col("ny").alias("m")).union(pairs.select("y", "ny", "x", "nx"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each form's form in turn, to the last. The steps that a round takes double, so
    there are few rounds; whether something changed is all that reaches the driver. forms should be cut."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        on = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        now = cut(on.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 2, slip: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its most frequent near word, if that stands `ratio` times
    as often or more."""
    words = cut(word_counts(docs, id_col, text_col, slip, shortest, least))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("b"))
    told = words.join(best, "word", "left")
    grows = -F.col("b.m") >= F.col("n") * ratio
    told = cut(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(grows, F.col("b.other")).alias("form"), F.when(grows, -F.col("b.m")).alias("form_n")))
    last = roots(told.where(F.col("form").isNotNull()).select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
