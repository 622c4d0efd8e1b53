"""Names for features, and over-representation of gene sets among selected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ln_binomial
from ..functions.storage import cut

#: A table of names or of sets below this many rows is sent to all tasks; a larger one is shuffled.
SMALL = 1_000_000
#: Terms of a gene, two lots of which meet at a time.
CHUNK = 500


def sized(df: DataFrame, limit: int = SMALL) -> DataFrame:
    """df, marked for broadcast if it has at most `limit` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def annotate(features: DataFrame, mapping: DataFrame, column: str = "Protein", out: str = "Gene") -> DataFrame:
    """features with `out`: the smallest name that the mapping (accession, name) has, or the accession itself."""
    one = mapping.groupBy("accession").agg(F.min("name").alias("__name"))
    joined = features.join(sized(one), F.col(f"`{column}`") == F.col("accession"), "left")
    return joined.withColumn(out, F.coalesce("__name", F.col(f"`{column}`"))).drop("accession", "__name")


def select_genes(features: DataFrame, gene_column: str = "Gene", pvalue_column: str | None = None, pvalue_cutoff: float = 0.1, importance_column: str | None = None, importance_cutoff: float = 0.0, compat: bool = False) -> DataFrame:
    """(gene): below the p cutoff and above the importance cutoff; with compat the importance alone decides if given."""
    if pvalue_column is None and importance_column is None:
        raise ValueError("select by pvalue_column, importance_column or both")
    keep = F.lit(True)
    if pvalue_column is not None and not (compat and importance_column is not None):
        keep &= F.col(f"`{pvalue_column}`") < pvalue_cutoff
    if importance_column is not None:
        keep &= F.col(f"`{importance_column}`") > importance_cutoff
    return features.where(keep).select(F.col(f"`{gene_column}`").alias("gene")).where("gene IS NOT NULL").distinct()


def subset_library(sets: DataFrame, selected: DataFrame) -> DataFrame:
    """The sets (term, gene) that hold a selected gene."""
    return sets.join(sets.join(selected, "gene", "left_semi").select("term").distinct(), "term", "left_semi")


def overrepresented(sets: DataFrame, selected: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """(term, overlap, size, n_selected, n_background, p, corrected): the hypergeometric upper tail, corrected by
    Benjamini and Hochberg. The background is all genes of the sets where none is given; others don't count.
    """
    from .compare import correct_p

    selected, pairs = cut(selected), sets.select("term", "gene").distinct()
    ground = (pairs.select("gene") if background is None else background.select("gene")).distinct()
    inside = pairs.join(ground, "gene", "left_semi")
    chosen = selected.join(ground, "gene", "left_semi").select("gene", F.lit(1).alias("hit"))
    counts = inside.join(chosen, "gene", "left").groupBy("term").agg(F.count("hit").alias("overlap"), F.count("*").alias("size"))
    totals = ground.agg(F.count("*").alias("n_background")).crossJoin(chosen.agg(F.count("*").alias("n_selected")))
    tail = upper_tail(F.col("overlap"), F.col("n_background"), F.col("size"), F.col("n_selected"))
    tested = counts.where("overlap > 0").crossJoin(F.broadcast(totals)).select("term", "overlap", "size", "n_selected", "n_background", tail.alias("p"))
    return correct_p(tested.withColumn("__term", F.xxhash64("term")), "fdr_bh", tie="__term").drop("__term")


def upper_tail(x: F.Column, big_n: F.Column, k: F.Column, n: F.Column) -> F.Column:
    """P(X >= x) for X successes among n drawn of big_n of which k are successes.

    The first term is a quotient of binomial probabilities, each of constant work; the others follow by their ratio. They
    fall off from the mode, and those further than 30 deviations and 80 steps from it are below the last digit, so the sum
    has twice that many steps at most.
    """
    x = x.cast("long")
    share, top = n.cast("double") / big_n, F.least(k, n)
    spread = F.ceil(30 * F.sqrt(n.cast("double") * k / big_n * (1 - share))) + 80
    mode = F.floor((n + 1).cast("double") * (k + 1) / (big_n + 2))
    least, x = x, F.greatest(x, mode - spread)
    all_drawn = ln_binomial(x, k, share) + ln_binomial(n - x, big_n - k, share) - ln_binomial(n, big_n, share)
    first = F.when(n == big_n, F.when(x == k, 1.0).otherwise(0.0)).otherwise(F.exp(all_drawn))
    step = F.least(top, F.greatest(x, mode) + spread)
    start = F.struct(first.alias("t"), F.lit(0.0).alias("s"))
    ratio = lambda j: (k - j).cast("double") * (n - j) / ((j + 1).cast("double") * (big_n - k - n + j + 1))
    total = F.aggregate(F.sequence(x, F.greatest(x, step)), start, lambda s, j: F.struct(F.when(j < step, s["t"] * ratio(j)).otherwise(F.lit(0.0)).alias("t"), (s["s"] + s["t"]).alias("s")), lambda s: s["s"])
    return F.when(least > top, F.lit(0.0)).when(least <= F.greatest(F.lit(0), n + k - big_n), F.lit(1.0)).otherwise(F.least(total, F.lit(1.0)))


def enrich(features: DataFrame, sets: DataFrame, method: str = "overreptest", gene_column: str = "Gene", background: DataFrame | None = None, subset: bool = False, **selection) -> DataFrame:
    """method enrichr_overreptest names a web service; it is answered by the same local test."""
    if method not in ("overreptest", "enrichr_overreptest"):
        raise ValueError(f"unknown method {method!r}; known: overreptest, enrichr_overreptest")
    selected = select_genes(features, gene_column, **selection)
    return overrepresented(subset_library(sets, selected) if subset else sets, selected, background)


def term_pairs(pairs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b), a < b, once for each gene that two terms of pairs (term, gene) share. A gene's terms are dealt into chunks,
    and two chunks at a time meet, so no task gets all pairs of a gene that stands in many terms."""
    parts = pairs.groupBy("gene").agg(F.ceil(F.count("*") / chunk).cast("int").alias("parts"))
    placed = pairs.join(parts, "gene").withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
    met = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.groupBy("gene", F.least("part", "o").alias("x"), F.greatest("part", "o").alias("y")).agg(F.collect_list(F.struct("part", "term")).alias("ts"))
    first = met.select("x", "y", "ts", F.explode("ts").alias("me")).where("me.part = x")
    other = F.filter("ts", lambda u: (u["part"] == F.col("y")) & ((F.col("x") < F.col("y")) | (u["term"] > F.col("me.term"))))
    two = first.select(F.col("me.term").alias("one"), F.explode(F.transform(other, lambda u: u["term"])).alias("two"))
    return two.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))


def enrichment_map(sets: DataFrame, terms: DataFrame | None = None, at_least: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """(a, b, common, jaccard, overlap) of the pairs of terms that share a gene; given terms only, if any are given, and
    only those whose Jaccard index reaches at_least, if it is given.

    With at_least a pair must share one of the first genes of both terms, rare ones first (of n genes, n less
    at_least * n and one more), and must be of like sizes; only such pairs are counted. So a gene that stands in very
    many terms, which says little, makes hardly any.
    """
    pairs = sets.select("term", "gene").distinct()
    pairs = cut(pairs if terms is None else pairs.join(terms.select("term").distinct(), "term", "left_semi"))
    sizes = sized(pairs.groupBy("term").agg(F.count("*").alias("n")))
    size = lambda c: sizes.select(F.col("term").alias(c), F.col("n").alias(f"n{c}"))
    if at_least is None:
        both = term_pairs(pairs, chunk).groupBy("a", "b").agg(F.count("*").alias("common")).join(size("a"), "a").join(size("b"), "b")
    else:
        if not 0 < at_least <= 1:
            raise ValueError("at_least lies above 0 and is 1 at most")
        rare = pairs.join(pairs.groupBy("gene").agg(F.count("*").alias("f")), "gene").join(sizes, "term")
        place = F.row_number().over(Window.partitionBy("term").orderBy("f", "gene"))
        # a little more than at_least would leave out, for what rounding does to the product
        head = rare.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * at_least - 1e-9) + 1)
        asked = term_pairs(head.select("term", "gene"), chunk).distinct().join(size("a"), "a").join(size("b"), "b")
        asked = asked.where(F.least("na", "nb") >= F.greatest("na", "nb") * at_least - 1e-9)
        mine = asked.join(pairs.select(F.col("term").alias("a"), "gene"), "a")
        both = mine.join(pairs.select(F.col("term").alias("b"), "gene"), ["b", "gene"]).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common"))
    out = both.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"), (F.col("common") / F.least("na", "nb")).alias("overlap"))
    return out if at_least is None else out.where(F.col("jaccard") >= at_least)


def representative(features: DataFrame, cluster: str, p: str) -> DataFrame:
    """The feature with the smallest p of each cluster, then the smallest row_id."""
    w = Window.partitionBy(cluster).orderBy(F.asc_nulls_last(p), "row_id")
    return features.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
