"""Tessera: hybrid retrieval and operational-knowledge analytics on Spark DataFrames."""
