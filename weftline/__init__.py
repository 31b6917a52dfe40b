"""Corpus preparation, retrieval and evaluation as Spark DataFrame plans."""
