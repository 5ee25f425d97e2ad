"""Corpus curation, retrieval and evaluation as Spark plans."""
