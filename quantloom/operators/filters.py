"""Row filters of a matrix. Predicates on features come before any join; values decide only in the last two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# What the names of contaminants hold.
CONTAMINANTS = ("contam", "cont_crap")


def predicates(columns: list[str], peptide_q_value: float | None = None, protein_q_value: float | None = None, remove_decoys: bool = False, remove_contaminants: bool = False, remove_non_proteotypic: bool = False, compat: bool = False) -> Column:
    """One condition over the features; columns that don't exist impose none. With compat the peptide's q-value counts
    only where there is no protein q-value."""
    out = F.lit(True)
    by_protein = protein_q_value is not None and "ProteinQValue" in columns
    if peptide_q_value is not None and "PeptideQValue" in columns and not (compat and by_protein):
        out &= F.col("PeptideQValue") <= peptide_q_value
    if by_protein:
        out &= F.col("ProteinQValue") <= protein_q_value
    if remove_decoys and "Decoy" in columns:
        out &= F.col("Decoy") == 0
    if remove_contaminants:
        for mark in CONTAMINANTS:
            out &= ~F.col("Protein").contains(mark)
    if remove_non_proteotypic:
        out &= ~F.col("Protein").contains(";")
    return out


def nonzero_rows(cells: DataFrame) -> DataFrame:
    """(row_id) of features with a value that is neither missing nor zero."""
    return cells.where("value IS NOT NULL AND value != 0").select("row_id").distinct()


def few_zero_rows(cells: DataFrame, n_samples: int, max_n_zeros: int) -> DataFrame:
    """(row_id) of features with at most max_n_zeros zero or missing values among n_samples samples."""
    held = cells.groupBy("row_id").agg(F.count(F.when((F.col("value") != 0), 1)).alias("n"))
    return held.where(F.lit(n_samples) - F.col("n") <= max_n_zeros).select("row_id")


def filter_features(cells: DataFrame, features: DataFrame, samples: DataFrame, peptide_q_value: float | None = 0.01, protein_q_value: float | None = 0.01, remove_decoys: bool = True, remove_contaminants: bool = True, remove_non_proteotypic: bool = True, remove_zero_rows: bool = True, remove_n_zero_rows: bool = False, max_n_zeros: int | None = None, compat: bool = False) -> DataFrame:
    """The features that pass all conditions."""
    if remove_n_zero_rows and max_n_zeros is None:
        raise ValueError("remove_n_zero_rows needs max_n_zeros")
    out = features.where(predicates(features.columns, peptide_q_value, protein_q_value, remove_decoys, remove_contaminants, remove_non_proteotypic, compat))
    if remove_zero_rows:
        out = out.join(nonzero_rows(cells), "row_id", "left_semi")
    if remove_n_zero_rows:
        out = out.join(few_zero_rows(cells, samples.count(), max_n_zeros), "row_id", "left_semi")
    return out
