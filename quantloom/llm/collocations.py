"""Phrases whose words stand together more often than their parts let expect, per language.

A text is lower-cased (A-Z), split at punctuation and line ends into pieces, and those into words. All phrases of 1 to
max_n words that can be frequent become rows, which a hash aggregate counts per language (each task adds up its own before
the shuffle, so no frequent phrase is a hot key). A candidate of two or more words is cut after each of its words; the counts of both sides
are joined, and the score floor(2000000 * a / (l + r)) is worked out in Decimal. Candidates that nearly always stand
inside a longer one go by an anti join with their one-word extensions: a longer phrase that holds a candidate holds an
extension of it that is at least as frequent, so one word more is enough. The best of each language are ranked within
shards first, so that no task sorts a language.

Defined cases: null text has no words; a null language is `und`; repeated rows count each; a text of any length is cut
into rows of one piece, and those into rows of one phrase; without candidates, or rows, the result is empty; only the
language and the text are read, so other columns' names can't clash.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Marks that end a piece, and blanks between words.
ENDS, BLANKS = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: Groups in which a language's candidates are ranked before the best of each meet.
SHARDS = 256
#: Numbers of 64 bits in the filter of what is frequent: 2 MB.
SLOTS = 1 << 18


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, w): the words of each piece that has some."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    each = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.explode(F.split(text, ENDS)).alias("piece"))
    # lower() is faster by far, and the same where no letter but A-Z can change
    low = F.when(F.col("piece").rlike(r"[^\x00-\x7F\xDF-\xFF]"), F.translate("piece", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower("piece"))
    return each.select("lang", F.array_remove(F.split(low, BLANKS), "").alias("w")).where(F.size("w") > 0)


def spots(h: F.Column) -> list[tuple[F.Column, F.Column]]:
    """(slot, bit) of the filter that a hash sets: two of them."""
    return [(F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(SLOTS - 1)), x.bitwiseAND(F.lit(63)).cast("int")) for x in (h, F.shiftrightunsigned(h, 32))]


def membership(keys: DataFrame) -> F.Column:
    """The hashes `h` of keys as a Bloom filter: one array of SLOTS numbers of 64 bits, whatever the number of keys."""
    one = keys.select(F.explode(F.array(*[F.struct(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")) for slot, bit in spots(F.col("h"))])).alias("x"))
    set_ = one.groupBy("x.slot").agg(F.bit_or("x.b").alias("b"))
    every = keys.sparkSession.range(SLOTS).withColumnRenamed("id", "slot").join(set_, "slot", "left").select("slot", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    bits = cut(every.agg(F.array_sort(F.collect_list(F.struct("slot", "b"))).alias("x")).select(F.col("x.b").alias("bits")))
    return bits.scalar()


def may_hold(bits: F.Column, h: F.Column) -> F.Column:
    (slot, bit), (slot2, bit2) = spots(h)
    return (F.getbit(F.get(bits, slot), bit) == 1) & (F.getbit(F.get(bits, slot2), bit2) == 1)


def phrase_counts(docs: DataFrame, max_n: int = 4, min_count: int = 30, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, f): the phrases of up to max_n words that stand min_count times or more in a language; the empty
    phrase, always there, counts the language's words. The result is cut.

    A phrase can be that frequent only if all it holds is. So words are counted first, then pairs of frequent words, then
    longer phrases of frequent pairs; a filter of fixed size tells which are, and where it errs a row more is counted.
    """
    whole = pieces(docs, text_col, lang_col)
    starts = whole.select("lang", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("i"))
    left, word = F.size("w") - F.col("i"), lambda k: F.get("w", F.col("i") + k)

    def counted(rows: DataFrame, phrase: F.Column, c: F.Column | None = None) -> DataFrame:
        keyed = rows.select("lang", phrase.alias("phrase"), *([] if c is None else [c.cast("long").alias("c")]))
        sums = keyed.groupBy("lang", "phrase").agg((F.count("*") if c is None else F.sum("c")).alias("f"))
        return cut(sums.where((F.col("f") >= min_count) | (F.col("phrase") == "")))

    # a piece's first row stands for its words' number: no word is empty
    first = whole.select("lang", F.size("w").alias("n"), F.explode(F.concat(F.array(F.lit("")), "w")).alias("phrase"))
    out = found = counted(first, F.col("phrase"), F.when(F.col("phrase") == "", F.col("n")).otherwise(1))
    if max_n < 2:
        return out
    bits = membership(found.where("phrase <> ''").select(F.xxhash64("lang", "phrase").alias("h")))
    pair = (left >= 2) & may_hold(bits, F.xxhash64("lang", word(0))) & may_hold(bits, F.xxhash64("lang", word(1)))
    found = counted(starts.where(pair), F.concat(word(0), F.lit(" "), word(1)))
    out = out.unionByName(found)
    if max_n < 3:
        return cut(out)
    two = F.split("phrase", " ")
    bits = membership(found.select(F.xxhash64("lang", two[0], two[1]).alias("h")))
    run = F.least(F.lit(max_n), left)  # the words from i on of which each two neighbours are a frequent pair
    for k in range(max_n - 2, -1, -1):
        run = F.when(may_hold(bits, F.xxhash64("lang", word(k), word(k + 1))), run).otherwise(k + 1)
    runs = starts.where(left >= 3).select("lang", "w", "i", F.least(run, left).alias("run")).where("run >= 3")
    longer = runs.select("lang", "w", "i", F.explode(F.sequence(F.lit(3), F.col("run"))).alias("k"))
    return cut(out.unionByName(counted(longer, F.array_join(F.slice("w", F.col("i") + 1, F.col("k")), " "))))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase of several words: the cut with the lowest score, and of equal ones
    the first. counts should be cut."""
    size = F.size(F.split("phrase", " "))
    cuts = counts.where(F.contains("phrase", F.lit(" "))).select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    first, rest = F.expr("substring_index(phrase, ' ', k)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', k)) + 2)")
    parts = cuts.withColumns({"first": first, "rest": rest})
    left = parts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = left.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("cast(a AS decimal(31, 0)) * 2000000BD div (cast(l AS decimal(31, 0)) + r)")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def extended(counts: DataFrame) -> DataFrame:
    """(lang, phrase, more): how often the most frequent phrase stands that is a phrase and one word more."""
    words = F.split("phrase", " ")
    inner = F.explode(F.array(F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)"), F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")))
    longer = counts.where(F.size(words) > 2).select("lang", F.col("f"), inner.alias("phrase"))
    return longer.groupBy("lang", "phrase").agg(F.max("f").alias("more"))


def collocations(docs: DataFrame, max_n: int = 4, min_count: int = 30, held_percent: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases. Phrases of which held_percent or more
    stand inside one and the same longer phrase of up to max_n words are left out."""
    counts = phrase_counts(docs, max_n, min_count, text_col, lang_col)
    words = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    counts = counts.where("phrase <> ''")
    more = extended(counts).select(F.col("lang").alias("xl"), F.col("phrase").alias("xp"), "more")
    inside = (F.col("lang") == F.col("xl")) & (F.col("phrase") == F.col("xp")) & (F.expr("cast(more AS decimal(31, 0)) * 100") >= F.col("a").cast("decimal(31,0)") * held_percent)
    left = scored(counts).join(more, inside, "left_anti").withColumn("shard", F.pmod(F.xxhash64("phrase"), F.lit(SHARDS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "shard").orderBy(*order))).where(F.col("rank") <= top).drop("shard")
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    # a row a language: the number of languages doesn't grow with the rows, but nothing says so, hence no hint
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
