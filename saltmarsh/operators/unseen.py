"""Strings of a mask that no terminal has: their ranks, the strings of ranks, and all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import text as X
from saltmarsh.plans.shared import lag_within, running_sums_within


def unseen_ranks(probes: DataFrame, terminals: DataFrame) -> DataFrame:
    """term_key, idx, rank of each probe (term_key, idx) that isn't a terminal: its index less the seen ones below it. Both are wide numbers. The seen ones are counted by ranges over all keys, so no task has a whole mask."""
    seen = terminals.filter(X.generatable("terminal", "term_key")).select("term_key", X.wide_index("terminal").alias("idx"), F.lit(1).alias("seen"))
    both = probes.select("term_key", "idx", F.lit(0).alias("seen")).unionByName(seen.join(probes.select("term_key").distinct(), "term_key", "left_semi"))
    per = both.groupBy("term_key", "idx").agg(F.max("seen").cast("decimal(38,0)").alias("seen"), F.count_if(F.col("seen") == 0).alias("probes"))
    counted = running_sums_within(per, "term_key", [F.asc("idx")], {"below": "seen"})
    return counted.filter("seen = 0 and probes > 0").select("term_key", "idx", X.wide_less(F.col("idx"), F.col("below")).alias("rank"))


def unseen_at(probes: DataFrame, terminals: DataFrame) -> DataFrame:
    """term_key, rank, terminal of each probe (term_key, rank): the inverse of unseen_ranks, for decimal ranks. The seen strings before it are those with no more unseen ones below them than the rank."""
    one = F.lit(1).cast("decimal(38,0)").alias("one")
    seen = terminals.filter(X.generatable("terminal", "term_key")).join(probes.select("term_key").distinct(), "term_key", "left_semi").select("term_key", X.wide_index("terminal").alias("idx"), one)
    below = running_sums_within(seen, "term_key", [F.asc("idx")], {"before": "one"}).select("term_key", X.wide_less(F.col("idx"), F.col("before")).alias("at"), F.lit(0).alias("kind"), "one")
    asked = probes.select("term_key", "rank").distinct().select("term_key", X.wide_of("rank").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("decimal(38,0)").alias("one"))
    counted = running_sums_within(below.unionByName(asked), "term_key", [F.asc("at"), F.asc("kind")], {"before": "one"}).filter("kind = 1")
    return counted.select("term_key", X.wide_narrow(F.col("at")).alias("rank"), X.wide_string(X.wide_plus(F.col("at"), F.col("before")), "term_key").alias("terminal"))


def unseen_strings(keys: DataFrame, terminals: DataFrame, block: int = 10_000) -> DataFrame:
    """term_key, terminal: all strings of some masks (term_key) that no terminal has. Gaps between seen indices, by ranges, are cut into blocks that Spark deals to tasks. For masks whose unseen strings are to be written out; all must have an index of 38 digits at most."""
    seen = terminals.filter(X.generatable("terminal", "term_key")).join(keys.select("term_key").distinct(), "term_key", "left_semi").select("term_key", X.unseen_index("terminal").alias("idx"))
    ends = keys.select("term_key").distinct().select("term_key", X.wide_narrow(X.wide_combinations("term_key")).alias("idx"))
    gaps = lag_within(seen.unionByName(ends), "term_key", "idx", "last")
    start, size = F.coalesce(F.col("last") + 1, F.lit(0)).cast("decimal(38,0)"), (F.col("idx") - F.coalesce(F.col("last") + 1, F.lit(0))).cast("decimal(38,0)")
    gaps = gaps.select("term_key", start.alias("start"), size.alias("n")).filter("n > 0")
    blocks = gaps.select("term_key", "start", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {block})")).alias("b"))
    dealt = blocks.repartition("term_key", "start", "b")
    offsets = F.explode(F.expr(f"sequence(b * {block}, least(cast(n - 1 AS bigint), b * {block} + {block - 1}))"))
    return dealt.select("term_key", "start", offsets.alias("o")).select("term_key", X.unseen_string((F.col("start") + F.col("o")).cast("decimal(38,0)"), "term_key").alias("terminal"))
