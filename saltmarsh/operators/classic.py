"""The 2009 model: structures by character and by run, terminals by length, and dictionaries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions.text import strip_breaks
from saltmarsh.operators.grammar import terminal_groups
from saltmarsh.operators.patterns import enumerate_groups, pieces, strings
from saltmarsh.plans.shared import running_sum, stash


def micro(c: str = "word"):
    """One letter for each character: L letters of any script, D digits, S others."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c), r"[^\p{L}0-9]", "\x02"), r"\p{L}", "L"), "[0-9]", "D")


def structures(df: DataFrame) -> DataFrame:
    """macro, micro and prob: P(macro) * P(micro given macro)."""
    named = df.withColumn("micro", F.replace(micro(), F.lit("\x02"), F.lit("S"))).withColumn("macro", F.regexp_replace("micro", r"(.)\1+", "$1"))
    small = named.groupBy("macro", "micro").agg(F.sum("freq").alias("n"))
    large = small.groupBy("macro").agg(F.sum("n").alias("m"))
    total = small.agg(F.sum("n").alias("t"))
    joined = small.join(large, "macro").crossJoin(F.broadcast(total))  # one row
    return joined.select("macro", "micro", (F.col("m") / F.col("t") * (F.col("n") / F.col("m"))).alias("prob"))


def terminals(df: DataFrame, pattern: str) -> DataFrame:
    """len, terminal, prob: runs of digits or of symbols, as shares of the runs of their length."""
    found = df.select(F.explode(F.regexp_extract_all("word", F.lit(f"({pattern})"), 1)).alias("terminal"), "freq").groupBy("terminal").agg(F.sum("freq").alias("n")).withColumn("len", F.length("terminal"))
    return found.join(found.groupBy("len").agg(F.sum("n").alias("m")), "len").select("len", "terminal", (F.col("n") / F.col("m")).alias("prob"))


def read_dictionary(words: DataFrame, remove_upper: bool = False, remove_special: bool = False, remove_digits: bool = False) -> DataFrame:
    """Words of 1 to 16 characters, without those that have what is to be removed."""
    out = words.filter("length(word) between 1 and 16")
    for drop, pattern in ((remove_upper, "[A-Z]"), (remove_special, r"[^\p{L}0-9]"), (remove_digits, "[0-9]")):
        out = out.filter(~F.col("word").rlike(pattern)) if drop else out
    return out


def dictionary(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """word, len, prob: each dictionary's probability is even over its words of a length; a word in several keeps the highest."""
    made = []
    for words, share in parts:
        own = words.select("word").distinct().withColumn("len", F.length("word"))
        made.append(own.join(own.groupBy("len").agg(F.count("*").alias("n")), "len").select("word", "len", (F.lit(share) / F.col("n")).alias("prob")))
    return reduce(DataFrame.unionByName, made).groupBy("word", "len").agg(F.max("prob").alias("prob"))


def grammar(words: DataFrame, dictionaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The 2009 grammar in the form that patterns are made of: structures (micro, with E between its runs; prob), and terminals (term_key, terminal, prob): dictionary words, digits and symbols by length. Runs of over 15 characters end a structure's use."""
    made = structures(words).groupBy("micro").agg(F.sum("prob").alias("prob"))
    runs = F.array_join(F.regexp_extract_all("micro", F.lit("(L+|D+|S+)"), 1), "E")
    long = F.exists(F.split(runs, "E"), lambda r: F.length(r) >= 16)
    parts = [dictionaries.select(F.lit("L").alias("c"), F.col("word").alias("terminal"), "len", "prob")]
    for letter, pattern in (("D", "[0-9]+"), ("S", r"[^\p{L}0-9]+")):
        parts.append(terminals(words, pattern).select(F.lit(letter).alias("c"), "terminal", "len", "prob"))
    named = reduce(DataFrame.unionByName, parts).select(F.expr("repeat(c, len)").alias("term_key"), "terminal", "prob")
    return made.filter(~long).select(runs.alias("structure"), "prob"), named


def guesses(structures: DataFrame, terminals: DataFrame, limit: int, step: float = 16.0) -> DataFrame:
    """rank, prob, string: the `limit` most likely strings in strict order of probability, then by pre-terminal and string.

    Each pre-terminal (a structure with a group of equally likely terminals for each run) is made once, by its places
    in order. The probability of the last guess is found by cutoffs that fall by a step until enough strings are above
    one; only what is above it is written out.
    """
    groups = stash(terminal_groups(terminals), "groups")
    kept = stash(structures, "structures")
    # the likeliest pre-terminal, and a bound that none is under
    placed = pieces(kept).select("structure", "structure_prob", F.explode("pieces").alias("term_key"))
    ends = groups.groupBy("term_key").agg(F.max("prob").alias("most"), F.min("prob").alias("least"))
    logs = placed.join(ends, "term_key", "left").groupBy("structure", "structure_prob").agg(F.count_if(F.col("most").isNull()).alias("lacking"), F.sum(F.ln("most")).alias("most"), F.sum(F.ln("least")).alias("least"))
    edges = logs.filter("lacking = 0").agg(F.max(F.ln("structure_prob") + F.col("most")).alias("most"), F.min(F.ln("structure_prob") + F.col("least")).alias("least")).first()
    if edges.most is None:
        return terminals.sparkSession.createDataFrame([], "rank long, prob double, string string")
    cutoff, floor = math.exp(edges.most) / step, math.exp(edges.least) * (1 - 1e-9)
    product = F.aggregate("sizes", F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    while cutoff > floor and (enumerate_groups(kept, groups, cutoff, canonical=False).agg(F.sum(product)).first()[0] or 0) < limit:
        cutoff = max(cutoff / step, floor)
    made = strings(kept, terminals, groups, cutoff).withColumn("one", F.lit(1).cast("decimal(38,0)"))
    order = [F.desc("prob"), F.asc("structure"), F.asc("string")]
    ranked = running_sum(made.select("prob", "structure", strip_breaks("string").alias("string"), "one"), order, "one", "before")
    return ranked.filter(F.col("before") < limit).select((F.col("before") + 1).cast("long").alias("rank"), "prob", "string")


def top_guesses(strings: DataFrame, limit: int) -> DataFrame:
    """The most likely strings (string, prob), in strict order of probability: a top-k."""
    best = strings.orderBy(F.desc("prob"), "string").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("prob"), "string")).cast("long"))  # `limit` rows
