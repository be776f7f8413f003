"""Quantizing terminal probabilities, so that more terminals share a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.operators.grammar import levels, nonterminal_mass
from saltmarsh.plans.shared import salted_join


def best_levels(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The level of each value: of all divisions into k bins of neighbouring values the one with the smallest squared error, weighted by probability. Each level is its bin's mean, so mass is kept.

    A dynamic programme over sorted values: the best division of the first j into b bins ends with a bin (i, j]. Sums of
    powers give a bin's error at once. All ends are tried, as the error of a bin about its plain mean doesn't allow to
    leave any out (it isn't Monge); time is k times the square of the number of values.
    """
    if k >= len(values):
        return values
    order = np.argsort(values)
    v, c = values[order].astype(float), counts[order].astype(float)
    s0, s1, s2, s3 = (np.concatenate([[0.0], np.cumsum(c * v**e)]) for e in range(4))
    m = len(v)
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    from_where = np.zeros((k + 1, m + 1), np.int32)
    block = max(1, 2_000_000 // (m + 1))
    starts = np.arange(m + 1)[:, None]
    for b in range(1, k + 1):
        new = np.full(m + 1, np.inf)
        for lo in range(1, m + 1, block):
            ends = np.arange(lo, min(m + 1, lo + block))
            i = starts[: ends[-1]]
            n = s0[ends] - s0[i]
            with np.errstate(divide="ignore", invalid="ignore"):
                mean = (s1[ends] - s1[i]) / n
                cost = (s3[ends] - s3[i]) - 2 * mean * (s2[ends] - s2[i]) + mean * mean * (s1[ends] - s1[i])
            total = np.where(i < ends, best[: ends[-1], None] + np.maximum(cost, 0.0), np.inf)
            from_where[b, ends] = total.argmin(0)
            new[ends] = total.min(0)
        best = new
    out, j = np.empty(m), m
    for b in range(k, 0, -1):
        i = int(from_where[b, j])
        out[order[i:j]] = (s1[j] - s1[i]) / (s0[j] - s0[i])
        j = i
    return out


def quantize(terminals: DataFrame, structures: DataFrame, total_levels: int = 500) -> DataFrame:
    """Terminals with quantized probabilities. Keys get levels by their share of the structures' mass; each key's distinct probabilities, with their numbers of terminals, are one group in a task."""
    shares = nonterminal_mass(structures).orderBy("term_key").collect()  # a row for each key
    given = dict(zip((r.term_key for r in shares), levels([r.share for r in shares], total_levels)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = given.get(pdf["term_key"].iloc[0], 1)
        return pdf.assign(level=best_levels(pdf["prob"].to_numpy(), pdf["n"].to_numpy(float), k))[["term_key", "prob", "level"]]

    distinct = terminals.groupBy("term_key", "prob").agg(F.count("*").alias("n"))
    made = distinct.groupBy("term_key").applyInPandas(run, "term_key string, prob double, level double")
    return salted_join(terminals, made, ["term_key", "prob"]).select("term_key", "terminal", F.col("level").alias("prob"), F.col("prob").alias("raw_prob"), "tags")


def error(quantized: DataFrame) -> DataFrame:
    gap = F.col("raw_prob") - F.col("prob")
    return quantized.agg(F.sum(gap * gap * F.col("raw_prob")).alias("mse"))
