"""Retrieval and knowledge-base analytics over Spark DataFrames."""
