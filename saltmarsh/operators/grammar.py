"""Learning the grammar: structures, terminals, unseen mass and groups of equal probability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions import text as X
from saltmarsh.plans.shared import running_sums_within


def short_enough(df: DataFrame) -> DataFrame:
    return df.filter(F.octet_length("word") <= X.LONGEST)


def learn_structures(tokenized: DataFrame) -> DataFrame:
    """structure, prob and tags from tokenized words; prob is the share of the weight."""
    sums = short_enough(tokenized).groupBy(X.structure("word").alias("structure")).agg(F.sum("freq").alias("freq"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))
    total = sums.agg(F.sum("freq").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("structure", (F.col("freq") / F.col("total")).alias("prob"), "tags")  # one row


def terminal_counts(tokenized: DataFrame) -> DataFrame:
    """term_key, terminal, freq, tags: every piece of every word counts the word's weight."""
    pieces = short_enough(tokenized).select(F.explode(F.split("word", X.BREAK)).alias("piece"), "freq", "tags").filter("piece <> ''")
    named = pieces.select(X.term_key(X.structure("piece")).alias("term_key"), X.ascii_lower("piece").alias("terminal"), "freq", "tags")
    return named.groupBy("term_key", "terminal").agg(F.sum("freq").alias("freq"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))


def singleton_mass(counts: DataFrame) -> DataFrame:
    """For each key its total, smallest and most common frequency (the smallest of those that tie) and that one's number of terminals."""
    by_freq = counts.groupBy("term_key", "freq").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("freq")).alias("neg"))).alias("best")
    return by_freq.groupBy("term_key").agg(F.sum(F.col("freq") * F.col("n")).alias("total"), F.min("freq").alias("min_freq"), F.sum("n").alias("seen"), best).select(
        "term_key", "total", "min_freq", "seen", (-F.col("best.neg")).alias("common_freq"), F.col("best.n").alias("common_n")
    )


def unseen_mass(counts: DataFrame) -> DataFrame:
    """The share of unseen terminals for each key: what the most common frequency holds, at most 0.999, made smaller where an unseen terminal would be likelier than a seen one; 0 if all were seen."""
    facts = singleton_mass(counts).withColumn("combos", X.combinations("term_key"))
    k = F.col("combos") - F.col("seen")
    first = F.least(F.col("common_freq") * F.col("common_n") / F.col("total"), F.lit(0.999))
    facts = facts.withColumns({"k": k, "u": first})
    grown = F.col("total") / (1 - F.col("u"))
    too_likely = 1.25 * F.col("u") / F.col("k") > F.col("min_freq") / grown
    smaller = 1 / (1 + 1.25 * F.col("total") / (F.col("k") * F.col("min_freq")))
    u = F.when(F.col("k") <= 0, 0.0).when(too_likely, smaller).otherwise(F.col("u"))
    return facts.select("term_key", "total", "seen", "combos", "common_freq", "common_n", "min_freq", u.alias("unseen_mass"))


def learn_terminals(tokenized: DataFrame, unseen: bool = False) -> DataFrame:
    """term_key, terminal, prob, tags; with unseen, the seen ones share what the unseen mass leaves."""
    counts = terminal_counts(tokenized)
    totals = unseen_mass(counts).select("term_key", "total", "unseen_mass") if unseen else counts.groupBy("term_key").agg(F.sum("freq").alias("total")).withColumn("unseen_mass", F.lit(0.0))
    prob = F.col("freq") / (F.col("total") / (1 - F.col("unseen_mass"))) if unseen else F.col("freq") / F.col("total")
    return counts.join(totals, "term_key").select("term_key", "terminal", prob.alias("prob"), "tags")


def terminal_groups(terminals: DataFrame, unseen: DataFrame | None = None) -> DataFrame:
    """term_key, group_idx, prob, size, size_text, first_string: terminals of equal probability, most likely first; ties are in descending order of strings, so the first is the largest. size is null where size_text has more than 38 digits. The window sees groups, not terminals."""
    sums = terminals.groupBy("term_key", "prob").agg(F.count("*").cast("decimal(38,0)").alias("size"), F.max("terminal").alias("first_string"))
    sums = sums.withColumns({"size_text": F.col("size").cast("string"), "is_unseen": F.lit(False)}).select("term_key", "prob", "size", "size_text", "first_string", "is_unseen")
    if unseen is not None:
        sums = sums.unionByName(unseen.select("term_key", "prob", "size", "size_text", "first_string", F.lit(True).alias("is_unseen")))
    order = Window.partitionBy("term_key").orderBy(F.desc("prob"), "is_unseen")
    return sums.withColumn("group_idx", (F.row_number().over(order) - 1).cast("int"))


def unseen_groups(terminals: DataFrame, masses: DataFrame) -> DataFrame:
    """One group for each key with unseen mass: its size (null with more than 38 digits; size_text has them all), the probability of each string, and its first string (the smallest index that no terminal has)."""
    seen = terminals.filter(X.generatable("terminal", "term_key")).select("term_key", X.wide_index("terminal").alias("index"))
    n = seen.groupBy("term_key").agg(F.count("*").alias("n"))
    after = seen.select("term_key", X.wide_next(F.col("index")).alias("index")).join(seen, ["term_key", "index"], "left_anti")
    gaps = after.groupBy("term_key").agg(F.min("index").alias("gap"))
    zero = X.wide(F.lit(0), F.lit(0))
    has_zero = seen.filter(F.col("index") == zero).select("term_key", F.lit(True).alias("has_zero"))
    facts = masses.filter("unseen_mass > 0").join(n, "term_key", "left").join(gaps, "term_key", "left").join(has_zero, "term_key", "left")
    first = F.when(F.coalesce("has_zero", F.lit(False)), F.col("gap")).otherwise(zero)
    left = X.wide_less(X.wide_combinations("term_key"), F.coalesce("n", F.lit(0)).cast("decimal(38,0)"))
    facts = facts.select("term_key", "unseen_mass", left.alias("left"), first.alias("first"))
    return facts.select(
        "term_key", (F.col("unseen_mass") / X.wide_double(F.col("left"))).alias("prob"), X.wide_narrow(F.col("left")).alias("size"),
        X.wide_text(F.col("left")).alias("size_text"), X.wide_string("first", "term_key").alias("first_string"),
    )


def terminal_ranks(terminals: DataFrame) -> DataFrame:
    """Adds the 0-based rank inside the group of equal probability, by descending string: a running number by ranges, so that no task has a whole group."""
    one = terminals.withColumn("_one", F.lit(1).cast("decimal(38,0)"))
    return running_sums_within(one, ["term_key", "prob"], [F.desc("terminal")], {"rank": "_one"}).select(*terminals.columns, "rank")


def nonterminal_mass(structures: DataFrame) -> DataFrame:
    """The structures' probability by terminal key, for each occurrence, as shares."""
    parts = structures.select(F.explode(F.split("structure", "E")).alias("piece"), "prob").groupBy(X.term_key("piece").alias("term_key")).agg(F.sum("prob").alias("mass"))
    total = parts.agg(F.sum("mass").alias("total"))
    return parts.crossJoin(F.broadcast(total)).select("term_key", (F.col("mass") / F.col("total")).alias("share"))  # one row


def levels(shares: list[float], total: int) -> list[int]:
    """How many levels each key gets: ceil(M * share), with the M where they sum to keys + total."""
    import math

    low, high = 0.0, 1.0
    need = len(shares) + total
    while sum(math.ceil(high * p) for p in shares) < need:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(math.ceil(mid * p) for p in shares) < need else (low, mid)
    return [math.ceil(high * p) for p in shares]
