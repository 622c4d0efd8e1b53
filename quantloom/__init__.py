"""Quantitative matrices (features by samples) on Spark: loading, normalising, rolling up, testing and annotating."""
