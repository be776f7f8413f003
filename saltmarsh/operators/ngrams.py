"""Tokenizers that look up n-grams. A table is (key, tokens, freq): the key is the tokens without breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import text as X
from saltmarsh.plans.shared import stash

#: What a mode's number stands for: the search in letters (best match, or extended with what it keeps),
#: whether whole words or letter runs are tokenized, and whether classes are broken after it.
WHOLE = {10: None, 12: None, 15: "all", 16: "first", 17: "all"}
RUNS = {20: None, 22: None, 25: "first", 27: "first", 28: "first", 30: None, 35: "first", 40: None, 45: "first"}
CLASSES_BROKEN = (28, 40, 45)


def key_of(c: Column | str) -> Column:
    """The key of an n-gram of words: lower case, no blanks."""
    return F.replace(X.ascii_lower(c), F.lit(" "), F.lit(""))


def table_of(grams: DataFrame) -> DataFrame:
    """key, tokens, freq from (gram, freq): alphabetic n-grams, duplicates summed."""
    good = grams.filter(F.col("gram").rlike("^[A-Za-z ]+$"))
    sums = good.groupBy(F.translate("gram", X.UPPER + " ", X.LOWER + X.BREAK).alias("tokens")).agg(F.sum("freq").cast("long").alias("freq"))
    return sums.select(X.strip_breaks("tokens").alias("key"), "tokens", "freq")


def best_tokens(table: DataFrame) -> DataFrame:
    """key, best: the most frequent tokenization of each key, the first by text on ties. One pass."""
    best = F.min(F.struct((-F.col("freq")).alias("f"), "tokens"))
    return table.groupBy("key").agg(best.alias("_b")).select("key", F.col("_b.tokens").alias("best"))


def top_tokenization(words: DataFrame, table: DataFrame) -> DataFrame:
    """word, tokens: the most frequent tokenization of each word; the word itself if the table lacks it."""
    return words.join(best_tokens(table), X.ascii_lower("word") == F.col("key"), "left").select("word", F.coalesce("best", F.col("word")).alias("tokens"))


def prefixes(words: DataFrame, table: DataFrame) -> DataFrame:
    """word, key: all keys that begin a word."""
    cut = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("k")).filter("length(word) > 0")
    return cut.select("word", F.expr("substring(word, 1, k)").alias("key")).join(table.select("key").distinct(), "key").select("word", "key")


def _halves(longest: int) -> int:
    """Steps of a search by halving over 1 to longest."""
    return longest.bit_length()


def markers(keys: DataFrame, longest: int) -> DataFrame:
    """marker, best, k: the prefixes of keys at which a search by halving passes on its way to a key's length, each with the longest key that begins it (null if none does)."""
    steps = _halves(longest)
    start = F.struct(F.lit(1).alias("lo"), F.lit(longest).alias("hi"), F.expr("cast(array() AS array<int>)").alias("at"))

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        inside = a["lo"] <= a["hi"]
        on = inside & (mid <= F.length("key"))
        low, high = F.when(on, mid + 1).otherwise(a["lo"]), F.when(inside & ~on, mid - 1).otherwise(a["hi"])
        return F.struct(low.alias("lo"), high.alias("hi"), F.when(on, F.concat(a["at"], F.array(mid))).otherwise(a["at"]).alias("at"))

    at = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["at"])
    found = keys.select("key", F.explode(at).alias("n")).select(F.expr("substring(key, 1, n)").alias("marker")).distinct()
    begun = found.select("marker", F.explode(F.sequence(F.lit(1), F.length("marker"))).alias("k")).withColumn("key", F.expr("substring(marker, 1, k)")).join(keys, "key")
    return found.join(begun.groupBy("marker").agg(F.max(F.struct("k", "best")).alias("_m")), "marker", "left").select("marker", F.col("_m.best").alias("best"), F.col("_m.k").alias("k"))


def longest_prefixes(rests: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds best and k to rests (rest): the longest key that begins each. A search by halving over prefix lengths: each step is one join with the markers, and there are as many as the bits of the longest key's length."""
    longest = keys.agg(F.max(F.length("key"))).first()[0] or 0
    known = stash(markers(keys, longest), "markers") if longest else keys.select(F.col("key").alias("marker"), "best", F.lit(0).alias("k"))
    state = rests.withColumns({"_lo": F.lit(1), "_hi": F.lit(longest), "best": F.lit(None).cast("string"), "k": F.lit(None).cast("int")})
    for _ in range(_halves(longest)):
        mid = F.floor((F.col("_lo") + F.col("_hi")) / 2).cast("int")
        asked = state.withColumn("_mid", F.when(F.col("_lo") <= F.col("_hi"), F.least(mid, F.lit(longest))))
        # beyond the rest's end there is no marker
        probe = F.when(F.col("_mid") <= F.length("rest"), F.expr("substring(rest, 1, _mid)"))
        met = asked.withColumn("_probe", probe).join(known.select(F.col("marker").alias("_probe"), F.lit(True).alias("_hit"), F.col("best").alias("_best"), F.col("k").alias("_k")), "_probe", "left")
        hit, tried = F.coalesce("_hit", F.lit(False)), F.col("_mid").isNotNull()
        state = met.select(
            *rests.columns, F.when(hit, F.col("_mid") + 1).otherwise(F.col("_lo")).alias("_lo"), F.when(tried & ~hit, F.col("_mid") - 1).otherwise(F.col("_hi")).alias("_hi"),
            F.when(hit, F.coalesce("_best", "best")).otherwise(F.col("best")).alias("best"), F.when(hit, F.coalesce("_k", "k")).otherwise(F.col("k")).alias("k"),
        )
    return state.drop("_lo", "_hi")


def greedy(words: DataFrame, table: DataFrame, keep: str = "first") -> DataFrame:
    """word, tokens: the longest key that begins a word's rest, its best tokens; the first token (or all but the last) is kept and the search goes on after it. A word for which no key begins the rest is null; the empty word has no tokens.

    The longest keys of all rests of all words are found at once; a word's tokens are then a walk over the answers of its
    own places, so the number of shuffles doesn't depend on the words.
    """
    distinct = words.select("word").distinct()
    places = distinct.filter("word <> ''").select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    rests = places.withColumn("rest", F.expr("substring(word, at)")).withColumn("rest", X.ascii_lower("rest"))
    answers = longest_prefixes(rests.select("rest").distinct(), best_tokens(table))
    tokens = F.split("best", X.BREAK)
    whole = F.col("k") == F.length("rest")
    count = F.when(whole | (F.size(tokens) == 1), F.size(tokens)).when(F.lit(keep == "first"), 1).otherwise(F.size(tokens) - 1)
    taken = F.slice(tokens, 1, count)
    used = F.aggregate(taken, F.lit(0), lambda a, t: a + F.length(t))
    told = answers.filter("best is not null").select("rest", F.array_join(taken, X.BREAK).alias("taken"), used.alias("used"))
    by_word = rests.join(told, "rest", "left").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "taken", "used"))).alias("x"))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("done"), F.lit(True).alias("good"))

    def step(a: Column, e: Column) -> Column:
        here = (e["at"] == a["at"]) & a["good"]
        good = a["good"] & (~here | e["taken"].isNotNull())
        done = F.when(here & e["taken"].isNotNull(), F.when(a["done"] == "", e["taken"]).otherwise(F.concat(a["done"], F.lit(X.BREAK), e["taken"]))).otherwise(a["done"])
        return F.struct((a["at"] + F.when(here, F.coalesce(e["used"], F.lit(0))).otherwise(F.lit(0))).alias("at"), done.alias("done"), good.alias("good"))

    walked = by_word.select("word", F.aggregate("x", start, step, lambda a: F.when(a["good"], a["done"])).alias("tokens"))
    return walked.unionByName(distinct.filter("word = ''").select("word", F.lit("").alias("tokens")))


def _reassembled(between: str) -> Column:
    """Breaks inside each letter run of `word` as its tokens (arrays runs, values) say, with the word's own letters."""
    pieces = F.regexp_extract_all("word", F.lit("([A-Za-z]+|[0-9]+|[^A-Za-z0-9]+)"), 1)

    def cut(piece: Column) -> Column:
        place = F.array_position("runs", X.ascii_lower(piece))
        own = F.split(F.when(place > 0, F.get("values", (place - 1).cast("int"))).otherwise(piece), X.BREAK)
        start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() AS array<string>)").alias("out"))
        step = lambda a, t: F.struct((a["at"] + F.length(t)).alias("at"), F.concat(a["out"], F.array(F.substring(piece, a["at"], F.length(t)))).alias("out"))
        return F.aggregate(own, start, step, lambda a: F.array_join(a["out"], X.BREAK))

    return F.array_join(F.transform(pieces, cut), between)


def tokenize_words(words: DataFrame, table: DataFrame, extended: bool = False, break_classes: bool = False) -> DataFrame:
    """word, tokens: letter runs tokenized by the table, case kept; breaks between classes only if asked for. A word with a run that the extended search can't begin is null."""
    found = words.select("word").distinct().select("word", F.explode(F.array_distinct(X.runs(X.ascii_lower("word"), "[a-z]+"))).alias("run"))
    runs = found.select(F.col("run").alias("word")).distinct()
    known = (greedy(runs, table) if extended else top_tokenization(runs, table)).select(F.col("word").alias("run"), "tokens")
    by_word = found.join(known, "run").groupBy("word").agg(F.collect_list("run").alias("runs"), F.collect_list("tokens").alias("values"), F.count("*").alias("n"))
    empty = F.expr("cast(array() AS array<string>)")
    joined = words.select("word").distinct().join(by_word, "word", "left").withColumns({"runs": F.coalesce("runs", empty), "values": F.coalesce("values", empty)})
    made = _reassembled(X.BREAK if break_classes else "")
    return joined.select("word", F.when(F.coalesce("n", F.lit(0)) == F.size("values"), made).alias("tokens"))


def tokenize_ngram(words: DataFrame, table: DataFrame, mode: int, duplicate: bool = False, weight: float = 1.0, hybrid: bool = False) -> DataFrame:
    """The modes by number, with all columns of the words (word, and freq or tags where they have some) and tokens.

    1 gives all rows of the table for each key; 10 to 17 tokenize whole words, the others letter runs inside words, 28, 40
    and 45 break classes, too. 28 multiplies freq by the weight; hybrid adds the word broken by classes alone, with its
    own freq, where it differs; duplicate adds each word as it is.
    """
    if mode == 1:
        return words.join(table.select(F.col("key").alias("word"), "tokens", F.col("freq").alias("table_freq")), "word")
    if mode in WHOLE:
        distinct = words.select("word").distinct()
        made = greedy(distinct, table, WHOLE[mode]) if WHOLE[mode] else top_tokenization(distinct, table)
    else:
        made = tokenize_words(words, table, RUNS[mode] is not None, mode in CLASSES_BROKEN)
    out = words.join(made, "word")
    if mode == 28:
        out = out.withColumn("freq", F.col("freq") * weight)
        if hybrid:
            broken = words.withColumn("tokens", X.tokenize("word")).join(made.withColumnRenamed("tokens", "other"), "word").filter(~F.col("tokens").eqNullSafe(F.col("other"))).drop("other")
            out = out.unionByName(broken)
    return out.unionByName(words.withColumn("tokens", F.col("word"))) if duplicate else out
