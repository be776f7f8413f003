"""Statistics of lookup results. A frame has condition and guess; a guess below zero is a status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.plans.shared import running_max, running_sum, running_sums_within

INFINITY = float("inf")
STATUS = {-2: "Beyond cutoff", -40: "Chunk not found", -4: "Structure not found"}


def status_label(guess: str = "guess") -> Column:
    out = F.when(F.col(guess) > 0, "Guessed")
    for code, name in STATUS.items():
        out = out.when(F.col(guess) == code, name)
    return out


def rename_conditions(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.replace(names, subset=["condition"])


def split_guessed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("guess > 0"), df.filter("guess < 0")


def ordered_output(df: DataFrame, prob: str = "prob") -> tuple[DataFrame, DataFrame]:
    """Guessed by condition and guess; the others by condition, status and probability, descending."""
    guessed, rest = split_guessed(df)
    return guessed.orderBy("condition", "guess"), rest.orderBy("condition", F.desc("guess"), F.desc(prob))


def counts_by_guess(df: DataFrame) -> DataFrame:
    """condition, guess, n for what was guessed: windows run over distinct guesses."""
    return df.filter("guess > 0").groupBy("condition", "guess").agg(F.count("*").alias("n"))


def totals(df: DataFrame) -> DataFrame:
    return df.groupBy("condition").agg(F.count("*").alias("total"))


def ecdf(df: DataFrame) -> DataFrame:
    """condition, guess, found, share: what is guessed so far of all tests, with those never guessed."""
    steps = running_sums_within(counts_by_guess(df), "condition", [F.asc("guess")], {"before": "n"})
    steps = steps.withColumn("found", (F.col("before") + F.col("n")).cast("long"))
    return steps.join(totals(df), "condition").select("condition", "guess", "found", (F.col("found") / F.col("total")).alias("share"))


def quantiles(df: DataFrame, share: float) -> DataFrame:
    """The smallest guess by which that share of the tests is guessed; infinite if never."""
    first = ecdf(df).filter(F.col("share") >= share).groupBy("condition").agg(F.min("guess").cast("double").alias("quantile"))
    return totals(df).join(first, "condition", "left").select("condition", F.coalesce("quantile", F.lit(INFINITY)).alias("quantile"))


def guesswork(df: DataFrame) -> DataFrame:
    """For each guess what an attacker spends on all tests who stops there, over the tests: sum of smaller guesses, and the guess for each test left."""
    counts = counts_by_guess(df).withColumn("cost", (F.col("guess").cast("decimal(28,0)") * F.col("n")).cast("decimal(38,0)"))
    steps = running_sums_within(counts, "condition", [F.asc("guess")], {"spent": "cost", "done": "n"})
    work = (F.col("spent") + F.col("guess").cast("decimal(28,0)") * (F.col("total") - F.col("done"))).cast("double") / F.col("total")
    return steps.join(totals(df), "condition").select("condition", "guess", work.alias("guesswork"))


def maxima(df: DataFrame) -> DataFrame:
    """The largest guess, guesswork and share of each condition, most guessed first."""
    work = guesswork(df).groupBy("condition").agg(F.max("guess").alias("max_guess"), F.max("guesswork").alias("max_guesswork"))
    share = ecdf(df).groupBy("condition").agg(F.max("share").alias("max_share"))
    return work.join(share, "condition").orderBy(F.desc("max_share"))


def percent_table(df: DataFrame, points: list[int]) -> DataFrame:
    """Percent guessed within each number of guesses."""
    at = F.explode(F.array(*(F.lit(p).cast("long") for p in points))).alias("point")
    hit = F.avg(F.when((F.col("guess") > 0) & (F.col("guess") <= F.col("point")), 100.0).otherwise(0.0))
    return df.select("condition", "guess", at).groupBy("condition", "point").agg(hit.alias("percent"))


def status_proportions(df: DataFrame) -> DataFrame:
    """The share of each status in each condition, zeros too."""
    labelled = df.withColumn("status", status_label())
    columns = [F.count_if(F.col("status") == s).alias(s) for s in ("Guessed", *STATUS.values())]
    wide = labelled.groupBy("condition").agg(F.count("*").alias("total"), *columns)
    names = ["Guessed", *STATUS.values()]
    return wide.selectExpr("condition", "total", f"stack({len(names)}, {', '.join(f'{n!r}, `{n}`' for n in names)}) AS (status, n)").select("condition", "status", "n", (F.col("n") / F.col("total")).alias("share"))


def contingency(df: DataFrame, cutoff: int) -> DataFrame:
    """Guessed within the cutoff and not, with the percent guessed."""
    hit = (F.col("guess") > 0) & (F.col("guess") <= cutoff)
    return df.groupBy("condition").agg(F.count_if(hit).alias("guessed"), F.count_if(~hit).alias("not_guessed")).withColumn("percent", 100 * F.col("guessed") / (F.col("guessed") + F.col("not_guessed")))


def chi_square(df: DataFrame, cutoff: int) -> DataFrame:
    """Pearson's statistic and degrees of freedom for condition by guessed; two conditions get the continuity correction."""
    rows = contingency(df, cutoff)
    sums = rows.agg(F.sum("guessed").alias("g"), F.sum("not_guessed").alias("u"), F.count("*").alias("k"))
    cells = rows.crossJoin(F.broadcast(sums)).withColumn("cells", F.array(F.struct(F.col("guessed").alias("o"), F.col("g").alias("c")), F.struct(F.col("not_guessed").alias("o"), F.col("u").alias("c"))))  # one row
    each = cells.select("k", F.explode("cells").alias("x"), (F.col("guessed") + F.col("not_guessed")).alias("r"), (F.col("g") + F.col("u")).alias("t"))
    expected = F.col("r") * F.col("x.c") / F.col("t")
    gap = F.abs(F.col("x.o") - expected)
    fixed = F.when(F.col("k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    return each.agg(F.sum(fixed * fixed / expected).alias("chi2"), (F.max("k") - 1).alias("df"))


def logrank_pairs(df: DataFrame, rho: float = 1.0) -> DataFrame:
    """first, second, observed, expected, variance: of all pairs of conditions at once, with each step weighted by the survival before it to the power rho.

    Nobody leaves before the end but by being guessed, so the survival is the share that is left. Steps are the distinct
    guesses of a pair; what is left at each is a running sum by ranges.
    """
    sizes = df.groupBy("condition").agg(F.count("*").cast("double").alias("n"))
    one, two = sizes.select(F.col("condition").alias("first"), F.col("n").alias("n1")), sizes.select(F.col("condition").alias("second"), F.col("n").alias("n2"))
    pairs = one.join(two, F.col("first") < F.col("second"))  # a row for each pair of conditions
    counts = counts_by_guess(df)
    of_first, of_second = (pairs.select("first", "second", F.col(c).alias("condition"), F.lit(k).alias("k")) for k, c in enumerate(("first", "second")))
    steps = counts.join(of_first.unionByName(of_second), "condition").groupBy("first", "second", "guess").agg(F.sum("n").alias("d"), F.sum(F.when(F.col("k") == 0, F.col("n")).otherwise(0)).alias("d1"))
    steps = running_sums_within(steps, ["first", "second"], [F.asc("guess")], {"gone": "d", "gone1": "d1"}).join(pairs, ["first", "second"])
    number = lambda c: F.col(c).cast("double")
    n = F.col("n1") + F.col("n2")
    risk = steps.select("first", "second", number("d").alias("d"), number("d1").alias("d1"), (n - number("gone")).alias("left"), (F.col("n1") - number("gone1")).alias("left1"), n.alias("n"))
    w = F.pow(F.col("left") / F.col("n"), F.lit(rho))
    expected = F.col("d") * F.col("left1") / F.col("left")
    spread = F.when(F.col("left") > 1, expected * (1 - F.col("left1") / F.col("left")) * (F.col("left") - F.col("d")) / (F.col("left") - 1)).otherwise(0.0)
    return risk.groupBy("first", "second").agg(F.sum(w * F.col("d1")).alias("observed"), F.sum(w * expected).alias("expected"), F.sum(w * w * spread).alias("variance"))


def logrank_terms(df: DataFrame, first: str, second: str, rho: float = 1.0) -> DataFrame:
    """Observed and expected guesses of the first of two conditions, and the variance."""
    pair = df.filter(F.col("condition").isin(first, second)).withColumn("condition", F.when(F.col("condition") == first, "1").otherwise("2"))
    return logrank_pairs(pair, rho).select("observed", "expected", "variance")


def chi2_tail(x: Column) -> Column:
    """P(chi-square with one degree of freedom > x): the complementary error function at the root of x/2, by its series, or by its continued fraction from 2 on."""
    z = F.sqrt(x / 2)
    term = lambda a, k: F.struct((a["t"] * 2 * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * z * z / (2 * k + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("s")), term, lambda a: a["s"])
    near = 1 - 2 / F.sqrt(F.pi()) * F.exp(-z * z) * series
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), F.lit(1.0), lambda a, k: 1 + k / (2 * z * z) / a)
    far = F.exp(-z * z) / (z * F.sqrt(F.pi())) / fraction
    return F.when(z < 2, near).otherwise(far)


def holm(df: DataFrame, p: str = "p", order: list[str] | None = None, out: str = "adjusted") -> DataFrame:
    """Adds Holm-adjusted p-values: the largest, up to a row in the order of p, of p times the number of rows from there on."""
    by = [F.asc(p), *map(F.asc, order or [])]
    ranked = running_sum(df.withColumn("_one", F.lit(1).cast("decimal(38,0)")), by, "_one", "_rank").drop("_one")
    total = df.agg(F.count("*").alias("_m"))
    scaled = ranked.crossJoin(F.broadcast(total)).withColumn("_scaled", F.least(F.lit(1.0), (F.col("_m") - F.col("_rank")).cast("double") * F.col(p)))  # one row
    return running_max(scaled, by, "_scaled", out).drop("_m", "_rank", "_scaled")


def logrank(df: DataFrame, rho: float = 1.0) -> DataFrame:
    """All pairs of conditions with statistic, p-value and Holm-adjusted p-value."""
    terms = logrank_pairs(df, rho)
    statistic = F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), F.lit(2)) / F.col("variance")).otherwise(0.0)
    tested = terms.select("first", "second", statistic.alias("statistic")).withColumn("p", chi2_tail(F.col("statistic")))
    return holm(tested, "p", ["first", "second"])


def shaped_curves(df: DataFrame, cutoff: int) -> DataFrame:
    """ECDF points up to a cutoff, each curve carried on to the cutoff and begun at (0, 0)."""
    points = ecdf(df).filter(F.col("guess") <= cutoff).select("condition", "guess", "share")
    ends = points.groupBy("condition").agg(F.max("share").alias("share")).select("condition", F.lit(cutoff).cast("long").alias("guess"), "share")
    starts = totals(df).select("condition", F.lit(0).cast("long").alias("guess"), F.lit(0.0).alias("share"))
    return points.unionByName(ends).unionByName(starts).distinct()


def combine_results(frames: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """All rows, and for each condition the smallest of its cutoffs. Each pair: results, and (condition, cutoff)."""
    rows = reduce(DataFrame.unionByName, (r for r, _ in frames))
    cutoffs = reduce(DataFrame.unionByName, (c for _, c in frames))
    return rows, cutoffs.groupBy("condition").agg(F.min("cutoff").alias("cutoff"))


def checked(df: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """The frame itself; an error if a needed column is missing, a value is null or a condition has no cutoff."""
    missing = {"condition", "guess"} - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    if not df.filter("condition is null or guess is null").isEmpty():
        raise ValueError("null in condition or guess")
    if not df.select("condition").distinct().join(cutoffs, "condition", "left_anti").isEmpty():
        raise ValueError("a condition has no cutoff")
    return df


def crack_curve(guesses: DataFrame, tests: DataFrame, limit: int | None = None) -> DataFrame:
    """guess, found: after each guess that hits how many tests are found; a repeated guess counts once. guesses: (rank, word); tests: (password)."""
    firsts = guesses.groupBy("word").agg(F.min("rank").alias("guess"))
    if limit is not None:
        firsts = firsts.filter(F.col("guess") <= limit)
    hits = firsts.join(tests.groupBy(F.col("password").alias("word")).agg(F.count("*").alias("n")), "word").groupBy("guess").agg(F.sum("n").alias("n"))
    return running_sum(hits, [F.asc("guess")], "n", "before").select("guess", (F.col("before") + F.col("n")).cast("long").alias("found"))


def crack_totals(guesses: DataFrame, tests: DataFrame) -> DataFrame:
    """guesses, tests, found and percent, one row; nothing is counted before it is asked for."""
    sums = tests.groupBy("password").agg(F.count("*").alias("n")).join(guesses.select(F.col("word").alias("password")).distinct().withColumn("hit", F.lit(True)), "password", "left")
    counts = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tests"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).cast("int").alias("found"))
    return guesses.agg(F.count("*").alias("guesses")).crossJoin(counts).withColumn("percent", 100.0 * F.col("found") / F.col("tests"))  # one row each


def ranked_words(source: DataFrame) -> DataFrame:
    """word, rank: from 1 by weight, then word."""
    sums = source.groupBy("word").agg(F.sum("freq").alias("freq")).withColumn("_one", F.lit(1).cast("decimal(38,0)"))
    return running_sum(sums, [F.desc("freq"), F.asc("word")], "_one", "_rank").select("word", (F.col("_rank") + 1).cast("long").alias("rank"))


def simple_guess(source: DataFrame, tests: DataFrame) -> DataFrame:
    """Each test with the rank of its first mention in an ordered source (word, freq): by weight, then word; -1 if it is not there."""
    return tests.join(ranked_words(source).withColumnRenamed("word", "password"), "password", "left").select("password", F.coalesce("rank", F.lit(-1)).alias("guess"))
