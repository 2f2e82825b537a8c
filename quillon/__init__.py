"""Spark-native grouped statistics, set similarity, spatial neighbourhood and enrichment operators."""
