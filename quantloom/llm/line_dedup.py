"""Lines that stand on many sites, found by HyperLogLog and removed.

A line is what lies between newlines, without ASCII white space at its ends; lines without anything else don't
count. A line that stands in texts of at least `min_sites` different sites is boilerplate and is removed wherever it
stands, with its newline. Texts give (site, line hash) once each; a count keeps hashes that stand in at least
`min_sites` texts (no other can reach as many sites), and a HyperLogLog sketch of the sites is built for each of
these in every task and merged by aggregation. A line whose estimate is further than MARGIN from the threshold is
decided by it; the others get exact distinct counts.

Up to BLOCK boilerplate hashes are broadcast, so that no text is shuffled. Where there are more, each text's lines are
joined with them by hash, and its own ones come back to it; nothing then is broadcast.

Defined cases: null texts stay null and have no lines; a null site is one site of its own; other columns are kept as
they are; rows are neither merged nor dropped; an empty table stays empty; equal lines of one text count once; repeated rows and ids are rows of their own; a text of
any length is read whole, line by line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, join_counted

MIN_SITES, LG_K, MARGIN, BLOCK = 10, 12, 0.1, 1_000_000
BLANKS = " \t\n\x0b\x0c\r"


def line_hashes(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """(site, h) for each line of each text, once a text."""
    lines = F.split(F.col(f"`{text_col}`"), "\n", -1)
    hashes = F.array_distinct(F.transform(F.filter(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != ""), lambda x: F.xxhash64(x)))
    site = F.coalesce(F.concat(F.lit("s"), F.col(f"`{site_col}`").cast("string")), F.lit("none"))  # a sketch ignores empty strings
    return docs.select(site.alias("site"), F.explode(hashes).alias("h"))


def spread_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """(h, sites, exact) of each line that stands on at least min_sites sites; sites is the estimate or the exact count."""
    lines = cut(line_hashes(docs, text_col, site_col))
    counts = cut(lines.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites))
    total = lines.count()
    often = join_counted(lines, counts, "h", "n", total)
    sketches = often.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    guess = cut(sketches.select("h", F.hll_sketch_estimate("sketch").alias("sites")))
    off = F.abs(F.col("sites") - min_sites)
    far = guess.where((off > F.lit(min_sites * margin)) & (F.col("sites") >= min_sites)).select("h", F.col("sites").cast("long").alias("sites"), F.lit(False).alias("exact"))
    near = guess.where(off <= F.lit(min_sites * margin)).select("h").join(counts, "h")
    again = join_counted(lines, cut(near), "h", "n", total, known=counts)
    exact = again.select("h", "site").distinct().groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return cut(far.unionByName(exact.withColumn("exact", F.lit(True))))


def _without(block: Broadcast):
    @F.arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        bad, blanks = set(block.value.tolist()), BLANKS.encode()

        def keeps(line: bytes) -> bool:
            h = xxhash.xxh64_intdigest(line.strip(blanks), seed=42)
            return (h - (1 << 64) if h >> 63 else h) not in bad

        for t in texts:
            out = []
            for x in t:
                text = x.as_py()
                out.append(text if text is None else b"\n".join(filter(keeps, text.encode().split(b"\n"))).decode())
            yield pa.array(out, pa.string())

    return clean


def remove_lines(docs: DataFrame, lines: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the lines whose hashes `lines` has in h. lines should be cut."""
    text = F.col(f"`{text_col}`")
    if lines.count() <= BLOCK:
        block = lines.select("h").toPandas()["h"].to_numpy(np.int64)
        return docs.withColumn(text_col, _without(docs.sparkSession.sparkContext.broadcast(block))(text))
    own = docs.columns
    a, b, h, bad = free_names(docs, 4)
    hashed = F.transform(F.split(text, "\n", -1), lambda x: F.xxhash64(F.btrim(x, F.lit(BLANKS))))
    keys = [F.xxhash64(text).alias(a), F.hash(text).alias(b)]
    # equal texts lose the same lines, so a text's hashes name it
    found = docs.where(text.isNotNull()).select(*keys, F.explode(F.array_distinct(hashed)).alias(h)).distinct()
    found = found.join(lines.select(F.col("h").alias(h)), h).groupBy(a, b).agg(F.collect_list(h).alias(bad))
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(bad, F.xxhash64(F.btrim(x, F.lit(BLANKS))))), "\n")
    both = docs.select(*[F.col(f"`{c}`") for c in own], *keys).join(found, [a, b], "left")
    return both.withColumn(text_col, F.when(F.col(bad).isNull(), text).otherwise(rest)).select(*[F.col(f"`{c}`") for c in own])


def drop_boilerplate_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs, its texts without the lines that stand on at least min_sites sites."""
    return remove_lines(docs, spread_lines(docs, text_col, site_col, min_sites), text_col)
