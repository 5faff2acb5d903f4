"""Corpus analytics on Spark: records of documents and metadata as DataFrames."""
