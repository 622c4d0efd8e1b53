"""Exact duplicates, with the heavy hitters split off before the shuffle.

A digest is the SHA-256 of the text after each run of ASCII white space has become one space. One pass keeps
(id, digest); a Misra-Gries sketch (`approx_top_k`, which keeps a bounded number of counters in every task and
merges them) names the digests that may be frequent; their exact counts and smallest ids are verified by a
partial aggregate and broadcast (at most `tracked` rows), so their rows are decided where they are. All other
digests have few rows each and go through an ordinary shuffle. Only DataFrame functions are used.

Defined cases: null text counts as empty, and empty texts equal each other; of equal texts the smallest id stays,
null ids come last; of repeated rows (same id, same text) exactly one stays; an empty table gives an empty result;
a text is hashed whole, whatever its length; other columns' names can't clash, as own columns take names that are free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, free_names

#: Counters of the sketch, and so the most rows that are ever broadcast. A digest is frequent when it holds more
#: than one row in SHARE, and MIN_ROWS at least.
TRACKED, SHARE, MIN_ROWS = 4096, 2000, 8


def digest(text: str) -> F.Column:
    return F.sha2(F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACES, " "), 256)


def _order(id_: str, row: str) -> F.Column:
    return F.struct(F.col(id_).isNull().alias("n"), F.col(id_).alias("i"), F.col(row).alias("r"))


def frequent(keyed: DataFrame, tracked: int = TRACKED, share: int = SHARE) -> DataFrame:
    """(dg, first, size) of each digest that surely is frequent: named by the sketch, counted exactly."""
    named = keyed.agg(F.expr(f"approx_top_k(xxhash64(dg), {tracked // 4}, {tracked})").alias("top"), F.count("*").alias("n"))
    named = named.select(F.explode("top").alias("t"), "n").where(F.col("t.count") >= F.greatest(F.lit(MIN_ROWS), F.floor(F.col("n") / share)))
    hit = keyed.withColumn("h", F.xxhash64("dg")).join(F.broadcast(named.select(F.col("t.item").alias("h"))), "h")
    return hit.groupBy("dg").agg(F.min(_order("id", "row")).alias("first"), F.count("*").alias("size")).where(F.col("size") >= MIN_ROWS)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, share: int = SHARE) -> DataFrame:
    """One row per input row: id, keep_id (of the row that stays), group_size, kept, text_sha256."""
    keyed = cut(docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(digest(text_col)).alias("dg"), F.monotonically_increasing_id().alias("row")))
    heavy = cut(frequent(keyed, tracked, share))
    hot = keyed.join(F.broadcast(heavy), "dg")
    w = Window.partitionBy("dg")
    cold = keyed.join(F.broadcast(heavy.select("dg")), "dg", "left_anti")
    cold = cold.select("*", F.min(_order("id", "row")).over(w).alias("first"), F.count("*").over(w).alias("size"))
    return hot.unionByName(cold).select(
        F.col("id").alias(id_col), F.col("first.i").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("first.r")).alias("kept"), F.lower(F.hex("dg")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED, share: int = SHARE) -> DataFrame:
    """The rows that stay, with all columns of `docs`. Each whole row is shuffled once at most."""
    own, (dg, first, place) = docs.columns, free_names(docs, 3)
    keyed = cut(docs.select(F.col(f"`{id_col}`").alias("id"), F.unhex(digest(text_col)).alias("dg"), F.lit(0).alias("row")))
    heavy = cut(frequent(keyed, tracked, share).select(F.col("dg").alias(dg), F.col("first.i").alias(first)))
    names = [F.col(f"`{c}`") for c in own]
    rows = docs.select(*names, F.unhex(digest(text_col)).alias(dg))
    any_of = F.xxhash64(*[F.to_json(F.struct(c)) if kind.startswith(("map", "array<map", "struct", "variant")) else c for c, (_, kind) in zip(names, docs.dtypes, strict=True)])
    hot = rows.join(F.broadcast(heavy), dg).where(F.col(f"`{id_col}`").eqNullSafe(F.col(first)))
    hot = hot.groupBy(dg).agg(F.min_by(F.struct(*names), any_of).alias("r")).select("r.*")
    w = Window.partitionBy(dg).orderBy(F.col(f"`{id_col}`").asc_nulls_last(), any_of)
    cold = rows.join(F.broadcast(heavy.select(dg)), dg, "left_anti").withColumn(place, F.row_number().over(w))
    return hot.unionByName(cold.where(F.col(place) == 1).select(*names)).select(*names)
