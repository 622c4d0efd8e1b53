"""Reading and writing matrices as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_quant_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def scan_design_tsv(spark: SparkSession, path: str) -> DataFrame:
    return lower_names(scan_quant_tsv(spark, path))


def lower_names(design: DataFrame) -> DataFrame:
    return design.toDF(*[c.lower() for c in design.columns])


def number_rows(wide: DataFrame) -> DataFrame:
    """wide with row_id, by retention time where there is such a column (RT before RetentionTime), then by all others.

    A row's number is the count of rows before it, added up over ranges of the time, so no task sorts all rows.
    """
    from ..operators.decoys import running

    rt = next((c for c in ("RT", "RetentionTime") if c in wide.columns), None)
    plain = [c for c, t in wide.dtypes if c != rt]
    key = F.xxhash64(*[F.col(f"`{c}`") for c in plain]) if plain else F.lit(0)
    placed = wide.withColumns({"__rt": F.coalesce(F.col(rt).cast("double") if rt else F.lit(0.0), F.lit(float("inf"))), "__key": key, "__mono": F.monotonically_increasing_id()})
    if not rt:  # without a time the rows keep the order they were read in
        placed = placed.withColumn("__rt", F.col("__mono").cast("double"))
    return running(placed, [("__rt", True), ("__key", True), ("__mono", True)], {"row_id": F.lit(1).cast("long")}).withColumn("row_id", F.col("row_id") - 1).drop("__rt", "__key", "__mono")


def split_matrix(numbered: DataFrame, samples: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cells, features): the samples' columns as rows, NaN as null, and all other columns."""
    missing = [s for s in samples if s not in numbered.columns]
    if missing:
        raise KeyError(f"samples without a column: {missing}")
    values = [F.nanvl(F.col(f"`{s}`").cast("double"), F.lit(None)).alias(s) for s in samples]
    cells = numbered.select("row_id", *values).unpivot("row_id", samples, "sample", "value")
    return cells, numbered.drop(*samples)


def number_samples(design: DataFrame) -> DataFrame:
    """The design with sample_ord, the place of each sample. A design is small: one row per sample."""
    if "sample_ord" in design.columns:
        return design
    return design.withColumn("__i", F.monotonically_increasing_id()).withColumn("sample_ord", F.row_number().over(Window.orderBy("__i")).cast("int") - 1).drop("__i")


def to_wide(cells: DataFrame, features: DataFrame, samples: list[str]) -> DataFrame:
    """features with a column per sample."""
    wide = cells.groupBy("row_id").pivot("sample", samples).agg(F.first("value"))
    return features.join(wide, "row_id", "left")


def write_tsv(wide: DataFrame, path: str) -> None:
    wide.write.csv(path, sep="\t", header=True, mode="overwrite")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(accession, name) of each entry: of `db|accession|name` its parts, else the first word twice. Plain or .gz. Of
    entries of one accession the last counts, files in the order of their names."""
    lines = spark.read.text(path)
    return fasta_names(lines.select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at")))


def fasta_names(lines: DataFrame) -> DataFrame:
    """As read_fasta, of lines (value, and `at`, by which they are in order)."""
    word = F.split(F.substring_index(F.substring("value", 2, 1 << 30), " ", 1), "\\|")
    at = F.col("at") if "at" in lines.columns else F.monotonically_increasing_id()
    heads = lines.where(F.col("value").startswith(">")).select(word.alias("w"), at.alias("at"))
    parts = F.size("w") >= 3
    named = heads.select(F.when(parts, F.col("w")[1]).otherwise(F.col("w")[0]).alias("accession"), F.when(parts, F.col("w")[2]).otherwise(F.col("w")[0]).alias("name"), "at")
    return named.groupBy("accession").agg(F.max_by("name", "at").alias("name"))


def read_gmt(spark: SparkSession, path: str, library: str) -> DataFrame:
    """(library, term, gene) from lines of a term, a description and genes."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).select(parts.alias("p"))
    return lines.select(F.lit(library).alias("library"), F.col("p")[0].alias("term"), F.explode(F.slice("p", 3, 1 << 30)).alias("gene")).where("gene != ''")
