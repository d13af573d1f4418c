"""Corpus and retrieval operators for Spark: every operator is a lazy DataFrame -> DataFrame function."""
