"""Long reports of one row per run and precursor, taken in as they are: no pivot is needed on the way to cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import number_rows

# The report's names and what they become.
NAMES = {"Protein.Ids": "Protein", "Precursor.Id": "PrecursorId", "Modified.Sequence": "PeptideSequence", "Precursor.Charge": "Charge"}
LIBRARY = {"Lib.Q.Value": "PeptideQValue", "Lib.PG.Q.Value": "ProteinQValue"}
GLOBAL = {"Global.Q.Value": "PeptideQValue", "Global.PG.Q.Value": "ProteinQValue"}
KEYS = list(NAMES)


def q_filter(report: DataFrame, q_value: float = 0.01) -> DataFrame:
    column = "Lib.Q.Value" if "Lib.Q.Value" in report.columns else "Q.Value"
    return report.where(F.col(f"`{column}`") <= q_value)


def pick_columns(report: DataFrame) -> DataFrame:
    """The columns used, with a run column; a library report without protein q-values gets zeros."""
    scores = LIBRARY if "Lib.Q.Value" in report.columns else GLOBAL
    have = lambda c: F.col(f"`{c}`").cast("double") if c in report.columns else F.lit(0.0)
    run = "Run" if "Run" in report.columns else "File.Name"
    return report.select(run_name(F.col(f"`{run}`")).alias("sample"), *[F.col(f"`{k}`") for k in KEYS], F.col("RT"), F.col("`Precursor.Quantity`").alias("value"), *[have(c).alias(n) for c, n in scores.items()])


def run_name(column: F.Column) -> F.Column:
    """What stands before the first dot."""
    return F.substring_index(column, ".", 1)


def rt_medians(rows: DataFrame) -> DataFrame:
    """The median retention time of each key; keys with a null part have none."""
    whole = F.lit(True)
    for k in KEYS:
        whole &= F.col(f"`{k}`").isNotNull()
    return rows.where(whole).groupBy(*[F.col(f"`{k}`") for k in KEYS]).agg(F.median("RT").alias("RetentionTime"))


def pivoted(rows: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    """One row per key, scores and run. Raises on read if a run has a key twice."""
    keys = [f"`{k}`" for k in KEYS] + ["PeptideQValue", "ProteinQValue", "sample"]
    value = F.nullif("value", F.lit(0.0)) if zero_is_missing else F.col("value")
    one = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.first(value, True).alias("value"))
    return one.withColumn("value", F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("a run has a precursor twice: "), F.col("`Precursor.Id`").cast("string"))).cast("double"))).drop("n")


def rename(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in NAMES.items() if k in df.columns})


def scan_diann(report: DataFrame, q_value: float = 0.01, zero_is_missing: bool = True) -> DataFrame:
    """(Protein, PrecursorId, PeptideSequence, Charge, PeptideQValue, ProteinQValue, RetentionTime, sample, value)."""
    rows = pick_columns(q_filter(report, q_value))
    return rename(pivoted(rows, zero_is_missing).join(rt_medians(rows), KEYS, "left"))


def to_matrix(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells, features) of a long table: its distinct features, numbered by retention time and then by all else."""
    names = [c for c in long.columns if c not in ("sample", "value")]
    features = number_rows(long.select(*[F.col(f"`{c}`") for c in names]).distinct())
    keys = features.select("row_id", *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)])
    same = F.lit(True)
    for i, c in enumerate(names):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"__{i}"))
    return long.join(keys, same).select("row_id", "sample", "value"), features.select("row_id", *[F.col(f"`{c}`") for c in names])
