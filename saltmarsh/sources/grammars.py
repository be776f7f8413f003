"""Readers and writers of what is learned and looked up: structures, terminals, patterns, lookup tables, results and totals.

Writers order rows by ranges, so a file of the text is a range of it: the parts, by name, are the whole in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.functions import text as X
from saltmarsh.plans.shared import stash
from saltmarsh.sources.corpora import read_results, tags_of

#: The first line of structures, the name of an unseen mass, and of a table's total.
HEADER, UNSEEN, TOTAL = "S ->", "<UNSEEN>", "Total count"


def _line(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *columns).alias("value")


def _field(k: int) -> Column:
    return F.get(F.split("value", "\t"), F.lit(k))


def _probability(c: Column) -> Column:
    """A probability of more than 0 and at most 1; any other ends the job."""
    p = X.from_hex(c)
    return F.when((p > 0) & (p <= 1), p).otherwise(F.raise_error(F.concat(F.lit("not a probability: "), F.col("value"))).cast("double"))


def write_structures(structures: DataFrame, path: str) -> None:
    """The header, then structure, probability and tags, likeliest first, then a blank line."""
    spark = structures.sparkSession
    edges = spark.createDataFrame([(0, HEADER), (2, "")], "_k int, value string").selectExpr("_k", "0D AS prob", "'' AS structure", "value")
    rows = structures.select(F.lit(1).alias("_k"), "prob", "structure", _line("structure", X.to_hex("prob"), F.concat_ws(",", "tags")))
    rows.unionByName(edges).orderBy("_k", F.desc("prob"), F.desc("structure")).select("value").write.text(path)


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """structure, prob, tags. Without the header, or with a probability outside of (0, 1], it is an error; a blank line ends a part."""
    lines = spark.read.text(path)
    if lines.filter(F.col("value") == HEADER).limit(1).count() == 0:
        raise ValueError(f"no structures: {path} lacks the line {HEADER}")
    rows = lines.filter((F.col("value") != HEADER) & (F.col("value") != ""))
    return rows.select(_field(0).alias("structure"), _probability(_field(1)).alias("prob"), tags_of(_field(2)).alias("tags"))


def write_terminals(terminals: DataFrame, path: str, masses: DataFrame | None = None) -> None:
    """A folder for each terminal key: terminal, probability and tags, likeliest first; then a blank line and the unseen mass, if there is one. Quantised terminals are written alike."""
    rows = terminals.select("term_key", "prob", "terminal", _line("terminal", X.to_hex("prob"), F.concat_ws(",", "tags")))
    if masses is not None:
        unseen = masses.filter("unseen_mass > 0").select("term_key", F.lit(-1.0).alias("prob"), F.lit("").alias("terminal"), _line(F.lit(f"\n{UNSEEN}"), X.to_hex("unseen_mass"), "term_key"))
        rows = rows.unionByName(unseen)
    order = ["term_key", F.desc("prob"), F.desc("terminal")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("term_key", "value").write.partitionBy("term_key").text(path)


def read_terminals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terminals, and (term_key, unseen_mass): from the folders that write_terminals makes, or from one file for each key, named by it (LLL.txt)."""
    name = F.input_file_name()
    key = F.coalesce(F.nullif(F.regexp_extract(name, r"/term_key=([LDS]+)/[^/]*$", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"/([LDS]+)\.txt$", 1), F.lit("")))
    unnamed = F.raise_error(F.concat(F.lit("no terminal key in "), name))
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.coalesce(key, unnamed.cast("string")).alias("term_key")).filter("value <> ''")
    seen = rows.filter(_field(0) != UNSEEN).select("term_key", _field(0).alias("terminal"), _probability(_field(1)).alias("prob"), tags_of(_field(2)).alias("tags"))
    return seen, rows.filter(_field(0) == UNSEEN).select("term_key", _probability(_field(1)).alias("unseen_mass"))


def write_patterns(raw: DataFrame, path: str) -> None:
    """Probability, number of strings and pattern, in no order."""
    raw.select(_line(X.to_hex("prob"), F.col("n").cast("string"), "pattern")).write.text(path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(_probability(_field(0)).alias("prob"), _field(1).cast("decimal(38,0)").alias("n"), _field(2).alias("pattern"))


def write_strings(made: DataFrame, path: str) -> None:
    """Strings alone, likeliest first, then by string."""
    made.orderBy(F.desc("prob"), F.desc("string")).select(F.col("string").alias("value")).write.text(path)


def write_table(table: DataFrame, path: str) -> None:
    """Probability, first guess number and pattern in order of guess numbers; the last line has the number of all guesses."""
    spark = table.sparkSession
    rows = table.select(F.lit(0).alias("_k"), "start", _line(X.to_hex("prob"), F.col("start").cast("string"), "pattern"))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(38,0)").alias("start")).select(F.lit(1).alias("_k"), "start", _line(F.lit(TOTAL), F.col("start").cast("string")))
    rows.unionByName(total).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_k", "start").sortWithinPartitions("_k", "start").select("value").write.text(path)


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """prob, start, pattern; and the total of guesses in one row."""
    lines = spark.read.text(path)
    rows = lines.filter(_field(0) != TOTAL).select(_probability(_field(0)).alias("prob"), _field(1).cast("decimal(38,0)").alias("start"), _field(2).alias("pattern"))
    return rows, lines.filter(_field(0) == TOTAL).select(_field(1).cast("decimal(38,0)").alias("total"))


def check_order(table: DataFrame) -> DataFrame:
    """The rows of a table where the probability is larger than that of the guess before; none in a sorted table. Ranges are checked side by side, and their edges by one row for each range."""
    spark = table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = stash(table.select("prob", "start").repartitionByRange(parts, "start").withColumn("_part", F.spark_partition_id()), "ordered")
    inside = kept.withColumn("before", F.lag("prob").over(Window.partitionBy("_part").orderBy("start")))
    edges = kept.groupBy("_part").agg(F.min_by("prob", "start").alias("prob"), F.min("start").alias("start"), F.max_by("prob", "start").alias("_last"))
    edges = edges.withColumn("before", F.lag("_last").over(Window.orderBy("_part")))  # one row for each of the `parts` ranges
    return inside.select("prob", "start", "before").unionByName(edges.select("prob", "start", "before")).filter(F.col("prob") > F.col("before"))


def write_results(results: DataFrame, path: str) -> None:
    """Test string with user and condition, probability, pattern, guess number or negative status, and source ids."""
    results.select(_line("workerid", "condition", "brokenpassword", X.to_hex("probability"), F.coalesce("pattern", F.lit("")), F.col("guess_number").cast("string"), F.coalesce("source_ids", F.lit("")))).write.text(path)


def write_totals(raw: DataFrame, path: str) -> None:
    """The number of all guesses of a table, in one line."""
    total = raw.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(38,0)").cast("string").alias("t"))
    total.select(_line(F.lit(TOTAL), "t")).write.text(path)


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """label, total; a name of a stream before the label is left out."""
    return spark.read.text(path).select(F.regexp_replace(_field(0), "^[^:]*:", "").alias("label"), _field(1).cast("decimal(38,0)").alias("total"))


def read_result_pair(spark: SparkSession, results: str, totals: str) -> DataFrame:
    """Lookup results with the total of their table in each row."""
    return read_results(spark, results).crossJoin(F.broadcast(read_totals(spark, totals).limit(1).select("total")))  # one row
