"""Readers for the text formats, and the corpora that stand for them in the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import text as X

#: word, freq and tags of every corpus.
WORDFREQ = "word string, freq double, tags array<string>"


def tags_of(c) -> F.Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda t: t != "")))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, weight 1; blank lines are skipped."""
    word = F.rtrim(F.col("value"), F.lit("\r\n"))
    return spark.read.text(path).select(word.alias("word")).filter("length(word) > 0").selectExpr("word", "1D AS freq", "cast(array() AS array<string>) AS tags")


def read_wordfreq(spark: SparkSession, path: str) -> DataFrame:
    """word, weight, tags by tabs: a hexadecimal weight with tags, or a whole number without."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter("length(value) > 0").select(parts.alias("p"))
    weight = F.when(F.size("p") == 2, F.get("p", F.lit(1)).cast("double")).otherwise(X.from_hex(F.get("p", F.lit(1))))
    return rows.select(F.get("p", F.lit(0)).alias("word"), weight.alias("freq"), tags_of(F.get("p", F.lit(2))).alias("tags"))


def write_wordfreq(df: DataFrame, path: str, compressed: bool = True) -> None:
    """By weight, largest first, then by word."""
    line = F.concat_ws("\t", "word", F.regexp_replace(X.to_hex("freq"), "^0x", ""), F.concat_ws(",", "tags"))
    df.orderBy(F.desc("freq"), "word").select(line.alias("value")).write.option("compression", "gzip" if compressed else "none").text(path)


def write_by_length(tokens: DataFrame, path: str) -> None:
    """A folder for each length of tokens (token, freq, len), each ordered by weight, largest first, then by token, with hexadecimal weights. Ranges of length and order are dealt to tasks, so that one length may take several."""
    order = ["len", F.desc("freq"), F.asc("token")]
    line = F.concat_ws("\t", "token", F.regexp_replace(X.to_hex("freq"), "^0x", ""))
    dealt = tokens.groupBy("len", "token").agg(F.sum("freq").alias("freq")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("len", line.alias("value")).write.partitionBy("len").text(path)


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    """user_id, policy, password by exactly two tabs; any other line is an error."""
    parts = F.split("value", "\t")
    bad = F.raise_error(F.concat(F.lit("not three columns: "), "value"))
    rows = spark.read.text(path).select(F.when(F.size(parts) == 3, parts).otherwise(bad.cast("array<string>")).alias("p"))
    return rows.selectExpr("p[0] AS user_id", "p[1] AS policy", "p[2] AS password")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Lookup results: seven columns; a negative guess number is a status."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).select(p.alias("p"))
    return rows.select(
        F.get("p", F.lit(0)).alias("workerid"), F.get("p", F.lit(1)).alias("condition"), F.get("p", F.lit(2)).alias("brokenpassword"),
        X.from_hex(F.get("p", F.lit(3))).alias("probability"), F.get("p", F.lit(4)).alias("pattern"),
        F.get("p", F.lit(5)).cast("decimal(38,0)").alias("guess_number"), F.get("p", F.lit(6)).alias("source_ids"),
    )


def smallest_cutoffs(files: DataFrame) -> DataFrame:
    """Of files named base-1e-N, for each base the one with the smallest cutoff."""
    named = files.withColumns({"base": F.regexp_extract("name", r"^(.*)-(1e-[0-9]+)$", 1), "cutoff": F.regexp_extract("name", r"-(1e-[0-9]+)$", 1).cast("double")})
    return named.groupBy("base").agg(F.min("cutoff").alias("cutoff"), F.min_by("name", "cutoff").alias("name"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1: words of all character classes, one row for each occurrence, with the letter of their table."""
    parts = {
        "P": ("part", "replace(concat(p_name, cast(p_size as string)), ' ', '')"), "B": ("part", "p_brand"), "O": ("orders", "o_orderpriority"),
        "N": ("nation", "n_name"), "S": ("supplier", "s_name"), "M": ("customer", "c_mktsegment"),
    }
    out = None
    for tag, (name, word) in parts.items():
        df = table(spark, sf_dir, name).selectExpr(f"{word} AS word", "1D AS freq", f"array('{tag}') AS tags")
        out = df if out is None else out.unionByName(df)
    return out


def token_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2: white-space tokens of documents with the language as tag, and the document."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("doc_id", "lang", F.explode(F.split("text", "[ \\t\\n\\r\\f\\x0B]+")).alias("word")).filter("word <> ''")
    return words.selectExpr("doc_id", "word", "1D AS freq", "array(lang) AS tags")


def results_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3: events as lookup results: condition, guess (a status below 0 where the value is low) and probability."""
    guess = "CASE WHEN value < 5 THEN -4 WHEN value < 10 THEN -2 ELSE event_id + 1 END"
    return table(spark, sf_dir, "events").selectExpr("event_type AS condition", f"cast({guess} AS bigint) AS guess", "event_id")
