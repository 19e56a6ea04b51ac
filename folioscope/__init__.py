"""Spark-native analytics for corpora of annotated documents, formulas and vectors."""
