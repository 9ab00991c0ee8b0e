"""Leakage-safe history features, record linkage and probability evaluation as Spark DataFrame operators."""
