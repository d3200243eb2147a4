"""Operators of a training-data pipeline over text corpora, each a composition of Spark jobs."""
