"""The queries of this folder's operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations
from .common import cut, remove_dir, shared_dir, table
from .decontaminate import find_matches
from .exact_dedup import exact_groups
from .html_text import extract_text
from .license_scan import scan_licenses
from .line_dedup import BLANKS, drop_boilerplate_lines
from .minhash import near_groups
from .piece_sampling import encode_and_check
from .quality import quality_scores
from .spelling import spelling_variants
from .token_counts import count_tokens
from .toxicity import toxicity_scores
from .warc import new_folder, normalise_archives, read_archives, read_index, write_archives


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes archives of all pages, normalises them and reads them back by offset."""
    folder = new_folder(spark, shared_dir(spark))
    written = write_archives(table(spark, sf_dir, "pages"), f"{folder}/whole")
    back = read_archives(read_index(normalise_archives(written, f"{folder}/members")))
    out = cut(back.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")))
    remove_dir(spark, folder)
    return out


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, how many of them stand on ten sites or more and go, and the text that stays."""
    lines = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", lines(F.col("text")).alias("n_lines"))
    out = drop_boilerplate_lines(docs).select("doc_id", "n_lines", F.coalesce("text", F.lit("")).alias("text"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - lines(F.col("text"))).alias("n_removed"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").alias("n_spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the size and a hash of its sampled segmentation, and whether it decodes to the text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = docs.withColumn("x", encode_and_check(F.col("text"), F.col("doc_id"), path))
    return coded.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size("x.ids").cast("long").alias("n_pieces"), F.xxhash64("x.ids").alias("pieces_hash"), "x.lossless")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"), percent=85)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("stays"))  # a null id is in no order: the operator says which stays
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that stands in it."""
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_warc, op3_line_dedup, op4_license_scan, op5_quality, op6_piece_sampling, op7_minhash_dedup, op8_exact_dedup, op9_decontamination, op10_token_counts, op11_html_text, op12_collocations, op13_spelling_variants)
}

SQL = {
    "op3_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS k FROM d),
t AS (SELECT *, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS own FROM l),
bad AS (SELECT own FROM t WHERE own <> '' GROUP BY own HAVING count(DISTINCT coalesce('s' || source, '')) >= 10),
x AS (SELECT t.*, own IN (SELECT own FROM bad) AS gone FROM t),
g AS (SELECT r, doc_id, count(*) FILTER (own <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
      coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM x GROUP BY r, doc_id)
SELECT doc_id, n_lines, n_removed, length(kept) AS n_chars, sha256(kept) AS text_sha256 FROM g
""",
    "op8_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, (VALUES (1), (2), (3), (4)) t(k) WHERE i + k - 1 <= len(w)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
b AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM c WHERE f >= 30),
cuts AS (SELECT lang, k, phrase, f AS a, w, unnest(range(1, k)) AS j FROM b WHERE k > 1),
sides AS (SELECT x.lang, x.k, x.phrase, x.a, x.j, l.f AS l, r.f AS r, (x.a::HUGEINT * 2000000) // (l.f::HUGEINT + r.f) AS score FROM cuts x
  JOIN b l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.j], ' ') JOIN b r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.j + 1:], ' ')),
best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
free AS (SELECT * FROM best x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE y.lang = x.lang AND y.k > x.k AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.f >= 80 * x.a)),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM free)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
}
