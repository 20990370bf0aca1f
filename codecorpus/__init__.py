"""Batch analytics over corpora of source repositories, built on Spark DataFrames."""
