"""Wayglass: incident-retrieval analytics over sensor time series, as composable Spark DataFrame operators."""
