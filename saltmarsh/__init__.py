"""Guess-number analytics for string corpora, built on Spark DataFrames."""
