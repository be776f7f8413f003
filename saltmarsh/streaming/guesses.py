"""A stream of test strings against a fixed list of guesses: each line is answered on its own, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """password: the lines of text files as they arrive in a folder; empty ones are left out."""
    return spark.readStream.text(folder).select(F.col("value").alias("password")).filter("password <> ''")


def answered(stream: DataFrame, ranked: DataFrame) -> DataFrame:
    """password, guess: the first rank of each line's string in the guesses (word, rank), -1 if it is in none."""
    first = ranked.groupBy("word").agg(F.min("rank").alias("guess"))
    return stream.join(first, stream["password"] == first["word"], "left").select("password", F.coalesce("guess", F.lit(-1)).cast("long").alias("guess"))
