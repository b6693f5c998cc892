"""Corpus-scale markup analytics and training-data preparation on Apache Spark."""
