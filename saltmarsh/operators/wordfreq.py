"""Weighted string corpora: aggregation, tags, weights, filters, sampling and tokenizers. A corpus is (word, freq, tags)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import text as X
from saltmarsh.plans.shared import running_sum, stash


def legal(allow_breaks: bool = False) -> Column:
    """A word without tab, and without breaks unless they are allowed."""
    return ~F.contains("word", F.lit("\t")) & (F.lit(True) if allow_breaks else ~F.contains("word", F.lit(X.BREAK)))


def wordfreq(df: DataFrame, weight: float = 1.0, replace_tag: str | None = None, add_tag: str | None = None, allow_breaks: bool = False) -> DataFrame:
    """Sums weight * freq by word and unites tags; the tag of every word can be replaced or added to."""
    # words are summed by their tags first, so that few rows reach the sets
    sums = df.filter(legal(allow_breaks)).groupBy("word", "tags").agg(F.sum(F.col("freq") * weight).alias("freq"))
    sums = sums.groupBy("word").agg(F.sum("freq").alias("freq"), F.flatten(F.collect_set("tags")).alias("tags"))
    tags = F.col("tags")
    if replace_tag is not None:
        tags = F.array(F.lit(replace_tag))
    elif add_tag is not None:
        tags = F.array_union("tags", F.array(F.lit(add_tag)))
    return sums.select("word", "freq", F.array_sort(F.array_distinct(tags)).alias("tags"))


def summary(df: DataFrame, allow_breaks: bool = False) -> DataFrame:
    """Kept and discarded rows, distinct words, the largest frequency, its inverse and the total."""
    good = legal(allow_breaks)
    counts = df.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("discarded"))
    words = wordfreq(df, allow_breaks=allow_breaks).agg(F.count("*").alias("distinct_words"), F.max("freq").alias("max_freq"), F.sum("freq").alias("total"))
    return counts.crossJoin(words).withColumn("inverse_max", 1 / F.col("max_freq"))  # one row each


def measure(df: DataFrame) -> DataFrame:
    """The total without weights."""
    return df.agg(F.sum("freq").alias("total"))


def relative_weight(total_so_far: DataFrame, source: DataFrame, times: float = 1.0, compat: bool = False) -> DataFrame:
    """Scales a source to `times` the total so far; compat ignores the number, as the original tool does."""
    ratio = total_so_far.agg(F.sum("freq").alias("t")).crossJoin(source.agg(F.sum("freq").alias("s")))  # one row
    ratio = ratio.select(((F.col("t") / F.col("s")) * (1.0 if compat else times)).alias("ratio"))
    return source.crossJoin(F.broadcast(ratio)).withColumn("freq", F.col("freq") * F.col("ratio")).drop("ratio")


def equal_weight(target: DataFrame, source: DataFrame) -> DataFrame:
    """The union of both after the source's total was made the target's."""
    return wordfreq(target.unionByName(relative_weight(target, source)))


def policy(df: DataFrame, name: str, keep: bool = True, word: str = "word") -> DataFrame:
    """Words that satisfy a policy, or all others."""
    good = X.POLICIES[name](F.col(word))
    return df.filter(good if keep else ~good)


def strings_of(df: DataFrame, lower: bool = True) -> DataFrame:
    """Every run of letters, with its word's weight and tags."""
    piece = F.explode(X.runs("word", "[A-Za-z]+"))
    out = df.select(piece.alias("word"), "freq", "tags")
    return out.withColumn("word", X.ascii_lower("word")) if lower else out


def digits_and_symbols_of(df: DataFrame) -> DataFrame:
    """Every run of digits, then every run of symbols."""
    both = F.concat(X.runs("word", "[0-9]+"), X.runs("word", "[^A-Za-z0-9]+"))
    return df.select(F.explode(both).alias("word"), "freq", "tags")


def tokenize(df: DataFrame, hybrid_weight: float | None = None) -> DataFrame:
    """Breaks words between character classes; a hybrid corpus holds the word itself, and its tokens with a weight if they differ."""
    tokens = X.tokenize("word")
    if hybrid_weight is None:
        return df.withColumn("word", tokens)
    other = F.struct(tokens.alias("word"), (F.col("freq") * hybrid_weight).alias("freq"))
    same = F.struct(F.col("word"), F.col("freq"))
    rows = F.explode(F.when(tokens == F.col("word"), F.array(same)).otherwise(F.array(same, other)))
    return df.select(rows.alias("r"), "tags").select("r.word", "r.freq", "tags")


def three_columns(df: DataFrame, source: str) -> DataFrame:
    return df.select(F.lit("no_user").alias("user_id"), F.lit(source).alias("policy"), F.col("word").alias("password"))


def sample(df: DataFrame, count: int, seed: int, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """`count` rows in the order of a seeded hash of their key, and the remainder; of equal keys as many are taken as there is room for. The last hash that is taken is found by a top-k; no row order is gathered."""
    if count <= 0:
        return df.limit(0), df
    marked = df.withColumn("_h", F.xxhash64(*key, F.lit(seed)))
    mark = F.struct("_h", *key)
    top = marked.select(mark.alias("_mark")).orderBy("_mark").limit(count)
    # how many rows of the last key are taken: only equal keys share it
    last = top.groupBy("_mark").agg(F.count("*").alias("_taken")).agg(F.max(F.struct("_mark", "_taken")).alias("_last"))
    both = marked.withColumn("_mark", mark).crossJoin(F.broadcast(last))  # one row
    before, at = F.coalesce(F.col("_mark") < F.col("_last._mark"), F.lit(False)), F.col("_mark").eqNullSafe(F.col("_last._mark"))
    columns = [*df.columns]
    # rows of the last key are numbered in a written table of their own
    tied = stash(both.filter(at).select(*columns, F.col("_last._taken").alias("_taken")).withColumn("_row", F.monotonically_increasing_id()), "tied")
    chosen = running_sum(tied.withColumn("_one", F.lit(1).cast("decimal(38,0)")), [F.asc("_row")], "_one", "_n").withColumn("_n", F.col("_n") + 1)
    rest = both.filter(~at)
    taken = rest.filter(before).select(columns).unionByName(chosen.filter("_n <= _taken").select(columns))
    return taken, rest.filter(~before).select(columns).unionByName(chosen.filter("_n > _taken").select(columns))


def combine(parts: list[DataFrame]) -> DataFrame:
    return wordfreq(reduce(DataFrame.unionByName, parts), allow_breaks=True)


def uniformize(df: DataFrame) -> DataFrame:
    """Tokens by word: alphabetic ones count once, others keep their sum."""
    tokens = df.select(F.explode(F.split("word", X.BREAK)).alias("word"), "freq", "tags").filter("word <> ''")
    sums = tokens.groupBy("word").agg(F.sum("freq").alias("freq"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"))
    return sums.withColumn("freq", F.when(F.col("word").rlike("^[A-Za-z]+$"), 1.0).otherwise(F.col("freq")))


def split_by_length(df: DataFrame) -> DataFrame:
    """Tokens with their length, to be written by length."""
    return df.select(F.explode(F.split("word", X.BREAK)).alias("token"), "freq").withColumn("len", F.octet_length("token"))
