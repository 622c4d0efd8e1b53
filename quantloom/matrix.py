"""A quantitative matrix: cells, features and samples, and the operators as methods that return new matrices."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import annotate as annotation
from .operators import cluster as clusters
from .operators import compare as comparisons_
from .operators import decoys, filters, impute, learn, normalize, quantify, scaling
from .sources import diann, tables


@dataclass(frozen=True)
class Matrix:
    """cells (row_id, sample, value; missing is null), features (row_id, ...), samples (sample, sample_ord, group, ...)."""

    cells: DataFrame
    features: DataFrame
    samples: DataFrame

    @staticmethod
    def read(spark: SparkSession, quantification: str | DataFrame, design: str | DataFrame, fasta: str | None = None, quant_type: str = "gps", q_value: float = 0.01) -> Matrix:
        """From a table with a column per sample (gps) or a long report (diann), and a design with a row per sample."""
        samples = tables.number_samples(tables.lower_names(tables.scan_design_tsv(spark, design) if isinstance(design, str) else design))
        table = tables.scan_quant_tsv(spark, quantification) if isinstance(quantification, str) else quantification
        if quant_type == "diann":
            cells, features = diann.to_matrix(diann.scan_diann(table, q_value))
            cells = cells.join(F.broadcast(samples.select("sample")), "sample", "left_semi").select("row_id", "sample", "value")
        elif quant_type == "gps":
            names = [r[0] for r in samples.orderBy("sample_ord").select("sample").collect()]
            cells, features = tables.split_matrix(tables.number_rows(table), names)
        else:
            raise ValueError(f"unknown quant_type {quant_type!r}; known: gps, diann")
        out = Matrix(cells, features, samples)
        return out if fasta is None else replace(out, features=annotation.annotate(features, tables.read_fasta(spark, fasta), "Protein", "ProteinLabel"))

    # -- accessors

    def distinct(self, column: str) -> list:
        """Distinct values in the order of their first feature."""
        return [r[0] for r in first_seen(self.features, column).orderBy("first").collect()]

    @property
    def proteins(self) -> list:
        return self.distinct("Protein")

    @property
    def peptides(self) -> list:
        return self.distinct("PeptideSequence")

    @property
    def precursors(self) -> list:
        return self.with_precursor_id().distinct("PrecursorId")

    def with_precursor_id(self) -> Matrix:
        return replace(self, features=self.features.withColumn("PrecursorId", F.concat_ws("_", "PeptideSequence", "Charge")))

    def get_samples(self, group=None) -> list:
        rows = self.samples if group is None else self.samples.where(F.col("group") == F.lit(group))
        return [r[0] for r in rows.orderBy("sample_ord").select("sample").collect()]

    def get_pairs(self, samples: list) -> list:
        mates = {r[0]: r[1] for r in self.samples.select("sample", "pair").collect()}
        return [mates[s] for s in samples]

    def get_batches(self) -> list:
        return [r[0] for r in self.samples.orderBy("sample_ord").select("batch").collect()]

    # -- transformations

    def filter(self, **kw) -> Matrix:
        kept = filters.filter_features(self.cells, self.features, self.samples, **kw)
        return replace(self, features=kept, cells=self.cells.join(kept.select("row_id"), "row_id", "left_semi"))

    def scale(self, method: str) -> Matrix:
        return replace(self, cells=scaling.scale(self.cells, method))

    def normalize(self, method: str, log_transform: bool = True, **kw) -> Matrix:
        return replace(self, cells=normalize.normalize(self.cells, method, log_transform, self.features, **kw))

    def correct(self, method: str = "mean", reference_batch=None) -> Matrix:
        return replace(self, cells=normalize.correct(self.cells, self.samples, method, reference_batch))

    def quantify(self, method: str = "top_n", level: str = "protein", top_n: int = 1, summarization_method: str = "sum", minimum_subgroups: int = 1) -> Matrix:
        source = self if "PrecursorId" in self.features.columns or level != "precursor" else self.with_precursor_id()
        if method == "top_n":
            long = quantify.top_n(source.cells, source.features, level, top_n, summarization_method)
        elif method == "maxlfq":
            long = quantify.maxlfq(source.cells, source.features, source.samples, level, top_n, minimum_subgroups)
        else:
            raise ValueError(f"unknown quantification method {method!r}; known: top_n, maxlfq")
        name = quantify.level_column(source.features, level)
        keys = first_seen(source.features, name).select(F.col(f"`{name}`"), F.col("first").alias("row_id"))
        cells = long.join(keys, F.col("key") == F.col(f"`{name}`")).select("row_id", "sample", "value")
        return replace(self, cells=cells, features=keys.select("row_id", F.col(f"`{name}`")))

    def impute(self, method: str, **kw) -> Matrix:
        return replace(self, cells=impute.impute(self.cells, self.features, self.samples, method, **kw))

    def append(self, method: str = "shuffle", feature_column: str = "Protein", seed: int = 0) -> Matrix:
        cells, features = decoys.append(self.cells, self.features, method, feature_column, seed)
        return replace(self, cells=cells, features=features)

    def compare(self, comparisons, **kw) -> Matrix:
        return replace(self, features=comparisons_.compare(self.cells, self.features, self.samples, comparisons, **kw))

    def annotate(self, mapping: DataFrame) -> Matrix:
        return replace(self, features=annotation.annotate(self.features, mapping))

    def cluster(self, feature_column: str | None = None, q_value: float = 0.01) -> Matrix:
        return replace(self, features=clusters.cluster(self.cells, self.features, q_value, feature_column=feature_column))

    def explain(self, classifier, comparisons: list[tuple] | tuple, n_iterations: int = 100, downsample_background: bool = True) -> Matrix:
        """classifier: an MLlib estimator; None: a logistic regression."""
        return replace(self, features=learn.explain(self.cells, self.features, self.samples, comparisons, n_iterations, downsample_background, classifier=classifier))

    def interpret(self, model, scale: bool = True, downsample_background: bool = True) -> Matrix:
        """features with the Importance that a fitted model gives them."""
        return replace(self, features=learn.interpret(self.cells, self.features, self.samples, model, scale, downsample_background)[0])

    def evaluate(self, classifier=None, comparisons: list[tuple] | tuple = (1, 2), method: str = "all", base_score_columns: list[str] | None = None) -> Matrix:
        return replace(self, features=learn.evaluate_by(self.features, comparisons, method, base_score_columns, classifier)[0])

    def predict(self, model, scale: bool = True) -> Matrix:
        return replace(self, samples=learn.predict(self.cells, self.samples, model, scale))

    # -- ways out

    def plot(self, plot_type: str, **kw) -> DataFrame:
        """The data of a plot: importance_summary (model, n_display, n_bins), or rfe_pca (ranks, cutoffs, comparison)."""
        if plot_type == "importance_summary":
            local = learn.interpret(self.cells, self.features, self.samples, kw["model"], kw.get("scale", True), kw.get("downsample_background", True))[1]
            return learn.plot_importance_data(local, kw.get("n_display", 5), kw.get("n_bins", 100))
        if plot_type == "rfe_pca":
            rows = learn.to_ml(scaling.standard(self.cells), self.samples, kw.get("comparison", (1, 2)))
            return learn.plot_rfe_pca_data(rows, kw["ranks"], list(kw.get("cutoffs", [100, 50, 10])))
        raise ValueError(f"unknown plot {plot_type!r}; known: importance_summary, rfe_pca")

    def train(self, classifier, **kw) -> learn.TrainResult:
        return learn.train(self.cells, self.samples, classifier, **kw)

    def optimize(self, make, method: str, grid: dict, comparison: tuple = (1, 2), **kw) -> learn.SearchResult:
        return learn.optimize(self.to_ml(comparison), make, method, grid, **kw)

    def enrich(self, sets: DataFrame, **kw) -> DataFrame:
        return annotation.enrich(self.features, sets, **kw)

    def to_ml(self, comparison: tuple | None = (1, 2)) -> DataFrame:
        return learn.to_ml(self.cells, self.samples, comparison)

    def to_df(self) -> DataFrame:
        return tables.to_wide(self.cells, self.features, self.get_samples())

    def write(self, path: str) -> None:
        tables.write_tsv(self.to_df().drop("row_id"), path)


def first_seen(features: DataFrame, column: str) -> DataFrame:
    """(column, first): its distinct values with their smallest row_id."""
    return features.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`")).agg(F.min("row_id").alias("first"))
