"""Quality rules (operator 8) with risk-controlled cutoffs, in DataFrame functions alone.

Each rule rejects documents whose measure is over a cutoff. For each stratum (documents of like length) and
rule, cutoffs are tried from lenient to strict on labelled good documents. A cutoff holds if the exact binomial
probability of so few false rejections, were the rate over the limit, is below the error level; the first
that fails ends the sequence, which keeps the level for all of it. The level is divided by the number of
sequences, so with confidence 1 - DELTA no rule rejects more than ALPHA of the good documents of any stratum.
A stratum with too few labelled rows certifies no cutoff, and none of its documents is rejected.

Defined results: null and empty texts have no words and fail the base rules; repeated rows give repeated rows;
null labels are not used; texts of any length are measured whole; a measure equal to a cutoff isn't over it; of rows with
one labelled doc_id the one with the least measures is a trial, so that copies aren't independent ones; other columns
are not read; an empty table gives an empty table. Equal windows are equal 64-bit hashes of their words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import common

ALPHA, DELTA = 0.01, 0.05
#: Upper ends of the strata, in words.
STRATA = (150, 600)
#: Each rule's measure and its cutoffs, lenient first.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("try_divide(n_symbols, word_chars)", (0.8, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03)),
    "dup_lines": ("try_divide(n_dup_lines, n_lines)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "repeats": ("try_divide(n_repeat_words, n_words)", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "long_words": ("try_divide(word_chars, n_words)", (40, 30, 25, 20, 16, 14, 12, 10)),
    "short_words": ("try_divide(n_words, word_chars)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3)),
}

#: White space of `[^\x20\x09-\x0D]+`, and that set inside a pattern.
_BLANK = "\t\n\x0b\f\r"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spaced = text
    for c in _BLANK:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    df = docs.select(
        F.col("doc_id").cast("long"),
        F.array_remove(F.split(spaced, " "), "").alias("w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    df = df.select(
        "doc_id", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "w")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(w) < 4 THEN array() ELSE transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) END").alias("h"),
    )
    # windows that occur again, by sorting (hash, place); then the words under their places
    repeats = F.expr(
        """CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
        transform(array(sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))), s ->
          aggregate(
            sort_array(transform(filter(s, (e, k) -> (k > 0 AND s[k - 1].x = e.x) OR (k < size(s) - 1 AND s[k + 1].x = e.x)), e -> e.i)),
            named_struct('n', 0L, 'last', -3),
            (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p),
            a -> a.n))[0] END"""
    )
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"))


def with_base(measures: DataFrame) -> DataFrame:
    """Adds base_failed and the stratum."""
    stratum = F.lit(0)
    for k, top in enumerate(STRATA, 1):
        stratum = F.when(F.col("n_words") > top, k).otherwise(stratum)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures.withColumns({"base_failed": failed, "stratum": stratum})


def cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff, n, rejected, p_value: the strictest certified cutoff; good: measures of labelled good documents that pass the base rules."""
    sums = [F.count("*").alias("n")]
    for rule, (measure, grid) in RULES.items():
        sums += [F.count_if(F.expr(measure) > c).alias(f"{rule}_{j}") for j, c in enumerate(grid)]
    rows = [f"'{rule}', {j}, cast({c} as double), {rule}_{j}" for rule, (_, grid) in RULES.items() for j, c in enumerate(grid)]
    wide = good.groupBy("stratum").agg(*sums)
    tests = wide.selectExpr("stratum", "n", f"stack({len(rows)}, {', '.join(rows)}) AS (rule, place, cutoff, rejected)")
    # P(Bin(n, alpha) <= rejected), term by term in logarithms
    p_value = F.expr(
        f"""CASE WHEN rejected >= n THEN 1D ELSE aggregate(sequence(0, cast(least(rejected, n) as int)), named_struct('l', 0D, 'p', 0D),
        (a, i) -> named_struct(
          'l', CASE WHEN i = 0 THEN n * ln(1 - {alpha}D) ELSE a.l + ln((n - i + 1) / i) + ln({alpha}D / (1 - {alpha}D)) END,
          'p', a.p + exp(CASE WHEN i = 0 THEN n * ln(1 - {alpha}D) ELSE a.l + ln((n - i + 1) / i) + ln({alpha}D / (1 - {alpha}D)) END)),
        a -> least(1D, a.p)) END"""
    )
    level = delta / (len(RULES) * (len(STRATA) + 1))
    tests = tests.withColumn("p_value", p_value)
    first_failure = tests.groupBy("stratum", "rule").agg(F.min(F.when(F.col("p_value") > level, F.col("place"))).alias("stop"))
    held = tests.join(first_failure, ["stratum", "rule"]).filter(F.col("stop").isNull() | (F.col("place") < F.col("stop")))
    return held.groupBy("stratum", "rule").agg(F.max(F.struct("place", "cutoff", "n", "rejected", "p_value")).alias("best")).select("stratum", "rule", "best.cutoff", "best.n", "best.rejected", "best.p_value")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Measures, base_failed, kept and failed_rules of each document; labels: (doc_id, quality), 1 for good."""
    rows = common.stash(with_base(measured(docs)), "measures")
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long")).distinct()
    measures = [c for c in rows.columns if c != "doc_id"]
    trials = rows.filter("not base_failed").join(good, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*measures)).alias("m")).select("doc_id", "m.*")
    chosen = cutoffs(trials, alpha, delta)
    # one row per stratum: its size doesn't depend on the data
    table = chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    out = rows.join(F.broadcast(table), "stratum", "left")
    failed = F.array_compact(F.array(*(F.when(F.expr(measure) > F.col(rule), F.lit(rule)) for rule, (measure, _) in RULES.items())))
    out = out.withColumn("failed_rules", F.when(F.col("n_words") > 0, failed).otherwise(F.expr("cast(array() as array<string>)")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(*RULES)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
