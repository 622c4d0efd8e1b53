"""A matrix made of the test tables: parts are features, suppliers' classes are samples, prices are abundances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import Matrix

N = 12
#: The brands whose values are tripled in the second group where an effect is planted.
PLANTED = ("Brand#1", "Brand#2", "Brand#3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name_of(number: F.Column) -> F.Column:
    return F.concat(F.lit("s"), F.lpad(number.cast("string"), 2, "0"))


def design(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(N).select(
        name_of(i).alias("sample"), i.cast("int").alias("sample_ord"), F.when(i < 6, 1).otherwise(2).alias("group"), (i % 3 + 1).cast("int").alias("batch"),
        name_of((i + 6) % N).alias("pair"), (i * 3 + 20).cast("int").alias("age"), F.when(i % 2 == 0, "f").otherwise("m").alias("gender"),
    )


def supplier_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A design in which each supplier is a sample: its nation decides the group and the batch, its neighbour is its mate."""
    k, name = F.col("s_suppkey"), lambda x: F.concat(F.lit("s"), F.lpad(x.cast("string"), 9, "0"))
    return table(spark, sf_dir, "supplier").select(
        name(k).alias("sample"), k.cast("int").alias("sample_ord"), (F.col("s_nationkey") % 2 + 1).cast("int").alias("group"), (F.col("s_nationkey") % 3 + 1).cast("int").alias("batch"),
        name(k + F.when(k % 2 == 1, 1).otherwise(-1)).alias("pair"), F.floor("s_acctbal").cast("int").alias("age"), F.when(k % 2 == 0, "f").otherwise("m").alias("gender"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("row_id"),
        F.concat(F.when(k % 97 == 0, "contam_").otherwise(""), "p_brand", F.lit("/"), "p_type", F.when(k % 89 == 0, ";").otherwise("")).alias("Protein"),
        F.col("p_name").alias("PeptideSequence"), (F.col("p_size") % 4 + 1).alias("Charge"), F.col("p_retailprice").alias("RetentionTime"),
        F.when(k % 10 == 0, 1).otherwise(0).alias("Decoy"), ((k * 7919) % 1000 / 50000.0).alias("PeptideQValue"), ((k * 104729) % 1000 / 50000.0).alias("ProteinQValue"), F.col("p_brand").alias("Brand"),
    )


def matrix(spark: SparkSession, sf_dir: str, planted: bool = False) -> Matrix:
    parts = features(spark, sf_dir)
    sums = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row_id"), (F.col("l_suppkey") % N).alias("s")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    effect = F.when((F.col("s") >= 6) & F.col("Brand").isin(*PLANTED), 3.0).otherwise(1.0) if planted else F.lit(1.0)
    cells = sums.join(parts.select("row_id", "Brand"), "row_id").select("row_id", name_of(F.col("s")).alias("sample"), (F.col("value") * effect).alias("value"))
    return Matrix(cells, parts.drop("Brand"), design(spark))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long report: of each run and precursor the row with the smallest order, a hundred times its key and its line as the
    SQL has it; rows without one don't count. Of rows with the same order the first in the table counts, whatever the
    partitions and however often the report is read."""
    order, place = F.col("l_orderkey") * 100 + F.col("l_linenumber"), [F.col(f"_metadata.{c}") for c in ("file_name", "row_index")]
    at = F.when(order.isNotNull(), F.struct(order.alias("order"), *place))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % N).alias("s"), "l_partkey", at.alias("at"), F.struct("l_quantity", "l_extendedprice", "l_discount").alias("x"))
    first = lines.groupBy("s", "l_partkey").agg(F.min_by("x", "at").alias("x"))
    rows = first.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.concat(F.lit("run"), F.col("s").cast("string"), F.lit(".mzML.x")).alias("Run"), F.col("p_brand").alias("Protein.Ids"), F.col("l_partkey").cast("string").alias("Precursor.Id"), F.col("p_name").alias("Modified.Sequence"),
        F.col("p_size").alias("Precursor.Charge"), F.col("x.l_quantity").alias("RT"), F.when(F.col("l_partkey") % 50 == 0, 0.0).otherwise(F.col("x.l_extendedprice")).alias("Precursor.Quantity"), F.col("x.l_discount").alias("Q.Value"),
        (F.col("l_partkey") % 7 / 1000.0).alias("Global.Q.Value"), (F.col("l_partkey") % 5 / 1000.0).alias("Global.PG.Q.Value"),
    )


def embedding_matrix(spark: SparkSession, sf_dir: str, labels: tuple[int, int] = (0, 1)) -> Matrix:
    """Dimensions are features, vectors are samples, a label plus one is a group."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("label").isin(*labels))
    name = F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 9, "0"))
    cells = rows.select(name.alias("sample"), F.posexplode("embedding").alias("row_id", "value")).select(F.col("row_id").cast("long").alias("row_id"), "sample", F.col("value").cast("double").alias("value"))
    samples = rows.select(name.alias("sample"), F.col("vec_id").cast("int").alias("sample_ord"), (F.col("label") + 1).alias("group"))
    return Matrix(cells, cells.select("row_id").distinct().withColumn("Protein", F.concat(F.lit("dim"), F.col("row_id").cast("string"))), samples)


def gene_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.lit("brands").alias("library"), F.col("p_brand").alias("term"), F.col("p_partkey").cast("string").alias("gene")).unionByName(part.select(F.lit("brands").alias("library"), F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("term"), F.col("p_partkey").cast("string").alias("gene")))
