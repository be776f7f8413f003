"""A lookup table that is written once and searched: tests read the shards of their patterns, numbers the ranges that hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.functions import text as X
from saltmarsh.operators.lookup import guess_numbers, unrank_permutation
from saltmarsh.operators.unseen import unseen_at
from saltmarsh.plans.shared import salted_join


def shard_of(pattern: str, shards: int):
    return F.pmod(F.xxhash64(pattern), F.lit(shards)).cast("int")


def store(table: DataFrame, path: str, shards: int = 64) -> None:
    """Writes a lookup table (prob, n, start, pattern) twice: in folders by the pattern's hash, sorted by pattern, and in folders by ranges of guess numbers; also the first number of each range, and one row with the number of shards, the smallest probability and the number of all guesses."""
    kept = table.withColumn("shard", shard_of("pattern", shards))
    kept.repartition("shard").sortWithinPartitions("shard", "pattern").write.partitionBy("shard").parquet(f"{path}/by_pattern")
    ranged = table.repartitionByRange(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), "start").sortWithinPartitions("start")
    ranged.withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{path}/by_start")
    spark = table.sparkSession
    schema = "prob double, n decimal(38,0), start decimal(38,0), pattern string, block int"
    written = spark.read.schema(schema).parquet(f"{path}/by_start")
    written.groupBy("block").agg(F.min("start").alias("first"), F.max_by(F.col("start") + F.col("n"), "start").cast("decimal(38,0)").alias("after")).coalesce(1).write.parquet(f"{path}/ranges")  # a row for each range
    facts = written.agg(F.min("prob").alias("least"), F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(38,0)").alias("total"))
    facts.withColumn("shards", F.lit(shards)).write.parquet(f"{path}/facts")


def shards_read(spark: SparkSession, path: str, best: DataFrame) -> DataFrame:
    """The part of a stored table that holds the tests' patterns: a scan of their shards alone. At most as many numbers as there are shards reach the driver."""
    shards = spark.read.parquet(f"{path}/facts").first().shards
    asked = [r.shard for r in best.filter("pattern is not null").select(shard_of("pattern", shards).alias("shard")).distinct().collect()]
    schema = "prob double, n decimal(38,0), start decimal(38,0), pattern string, shard int"
    return spark.read.schema(schema).parquet(f"{path}/by_pattern").filter(F.col("shard").isin(asked))


def find(spark: SparkSession, path: str, best: DataFrame) -> DataFrame:
    """Guess numbers of best parses from a stored table."""
    return guess_numbers(best, shards_read(spark, path, best), spark.read.parquet(f"{path}/facts").select("least"))


def patterns_at(spark: SparkSession, path: str, numbers: DataFrame) -> DataFrame:
    """row_id, number, pattern, prob, rank (of the number in its pattern) for guess numbers (row_id, number); numbers beyond the table are left out. Reads the ranges that hold a number; inside a range the pattern is the last that starts before it."""
    ranges = spark.read.parquet(f"{path}/ranges")
    placed = numbers.select("row_id", F.col("number").cast("decimal(38,0)").alias("number")).join(F.broadcast(ranges), (F.col("number") >= F.col("first")) & (F.col("number") < F.col("after")))  # a row for each range
    blocks = [r.block for r in placed.select("block").distinct().collect()]
    schema = "prob double, n decimal(38,0), start decimal(38,0), pattern string, block int"
    table = spark.read.schema(schema).parquet(f"{path}/by_start").filter(F.col("block").isin(blocks))
    rows = table.select("block", F.col("start").alias("at"), F.struct("start", "pattern", "prob").alias("row"), F.lit(None).cast("long").alias("row_id"), F.lit(False).alias("asked"))
    asks = placed.select("block", F.col("number").alias("at"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col("row_id").cast("long").alias("row_id"), F.lit(True).alias("asked"))
    before = Window.partitionBy("block").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(asks).withColumn("row", F.last("row", ignorenulls=True).over(before)).filter("asked")
    return found.select("row_id", F.col("at").alias("number"), "row.pattern", "row.prob", (F.col("at") - F.col("row.start")).cast("decimal(38,0)").alias("rank"))


def strings_at(found: DataFrame, terminals: DataFrame, groups: DataFrame) -> DataFrame:
    """row_id, string (with breaks) of each rank in a pattern: the inverse of a lookup. terminals have ranks; groups may have unseen ones.

    A rank is the arrangement's number times the strings of one arrangement, and a digit for each piece.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    pieces = found.select("row_id", "rank", F.posexplode(F.split("pattern", X.BREAK)).alias("k", "first"))
    named = pieces.withColumn("piece", X.structure("first")).withColumn("term_key", X.term_key("piece"))
    own = groups.select("term_key", "group_idx", F.col("prob").alias("p"), "size", "is_unseen", F.col("first_string").alias("lowered"))
    joined = named.withColumn("lowered", X.ascii_lower("first")).join(own, ["term_key", "lowered"])
    fields = F.struct("k", "piece", "term_key", "group_idx", "p", "size", "is_unseen")
    rows = joined.groupBy("row_id", "rank").agg(F.array_sort(F.collect_list(fields)).alias("x"))
    whole = F.aggregate("x", exact(F.lit(1)), lambda a, e: exact(a * e["size"]))
    turn = X.div(F.col("rank"), whole)
    order = unrank_permutation(F.transform("x", lambda e: e["piece"]), F.transform("x", lambda e: e["group_idx"]), turn)
    rows = rows.withColumns({"rest": exact(F.col("rank") % whole), "order": order})
    # each place gets the group that its arrangement has there, among those of its own nonterminal
    chosen = F.transform("x", lambda e, i: F.struct(e["k"].alias("k"), e["piece"].alias("piece"), F.get(F.filter("x", lambda o: (o["piece"] == e["piece"]) & (o["group_idx"] == F.get("order", i))), F.lit(0)).alias("g")))
    rows = rows.withColumn("chosen", chosen)
    start = F.struct(F.col("rest").alias("rest"), F.expr("cast(array() AS array<decimal(38,0)>)").alias("digits"))

    def step(a, e):
        digit = exact(a["rest"] % e["g"]["size"])
        return F.struct(exact((a["rest"] - digit) / e["g"]["size"]).alias("rest"), F.concat(F.array(digit), a["digits"]).alias("digits"))

    rows = rows.withColumn("digits", F.aggregate(F.reverse("chosen"), start, step, lambda a: a["digits"]))
    places = rows.select("row_id", F.explode(F.arrays_zip("chosen", "digits")).alias("z")).select("row_id", "z.chosen.k", "z.chosen.piece", "z.chosen.g.term_key", "z.chosen.g.p", "z.chosen.g.is_unseen", F.col("z.digits").alias("rank"))
    seen = salted_join(places.filter("not is_unseen"), terminals.select("term_key", F.col("prob").alias("p"), "rank", "terminal"), ["term_key", "p", "rank"])
    asked = places.filter("is_unseen")
    unseen = asked.join(unseen_at(asked.select("term_key", "rank"), terminals), ["term_key", "rank"])
    columns = ["row_id", "k", "piece", "terminal"]
    both = seen.select(columns).unionByName(unseen.select(columns)).withColumn("text", X.in_case_of("terminal", "piece"))
    return both.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda e: e["text"]), X.BREAK).alias("string"))
