"""One entry from a condition to lookup results: corpora, grammar, levels, tables and lookups at each cutoff, and their files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.operators import grammar as G
from saltmarsh.operators import lookup as L
from saltmarsh.operators import patterns as P
from saltmarsh.operators import quantize as Q
from saltmarsh.operators import wordfreq as W
from saltmarsh.operators.config import Condition, Filters, Read, build_tests, build_training
from saltmarsh.plans.shared import running_sum, stash
from saltmarsh.sources import grammars as S


@dataclass
class Learned:
    """A condition's grammar; masses are of unseen terminals, if the condition has them."""

    structures: DataFrame
    terminals: DataFrame
    groups: DataFrame
    masses: DataFrame | None


def learn(condition: Condition, structures: DataFrame, pieces: DataFrame) -> Learned:
    """structures are tokenized words, pieces the corpus of terminals. totalquantlevels 0 leaves probabilities as they are."""
    if condition.uniformize_strings:
        pieces = W.uniformize(pieces)
    tokens = stash(pieces, "pieces")
    found = stash(G.learn_structures(structures), "structures")
    terminals = G.learn_terminals(tokens, condition.generate_unseen_terminals)
    if condition.totalquantlevels:
        terminals = Q.quantize(stash(terminals, "terminals"), found, condition.totalquantlevels).drop("raw_prob")
    ranked = stash(G.terminal_ranks(terminals), "terminals")
    masses = stash(G.unseen_mass(G.terminal_counts(tokens)), "masses") if condition.generate_unseen_terminals else None
    groups = G.terminal_groups(ranked, G.unseen_groups(ranked, masses) if masses is not None else None)
    return Learned(found, ranked, stash(groups, "groups"), masses)


def results_at(tests: DataFrame, learned: Learned, cutoff: float) -> tuple[DataFrame, DataFrame]:
    """Lookup results of tests (row_id, user_id, policy, password), and the patterns of the table."""
    raw = stash(P.patterns(learned.structures, learned.groups, cutoff), "raw")
    unseen = learned.masses is not None
    best = L.best_parses(tests, L.parses(tests, learned.structures, learned.terminals, learned.groups, unseen, cutoff), learned.structures)
    numbers = L.guess_numbers(best, P.lookup_table(raw)).join(tests.select("row_id", "user_id", "policy"), "row_id")
    results = numbers.select(F.col("user_id").alias("workerid"), F.col("policy").alias("condition"), F.col("password").alias("brokenpassword"), F.col("prob").alias("probability"), "pattern", "guess_number", "source_ids")
    return results, raw


def run(
    spark: SparkSession, condition: Condition, read: Read, filters: Filters | None = None, tokenizers: dict[str, Callable[..., DataFrame]] | None = None, seed: int = 0, path: str | None = None
) -> dict[str, DataFrame]:
    """Lookup results for each cutoff of a condition, by its text. read gives a corpus by file name. With a path, the grammar, and each cutoff's table, total and results are written there as text."""
    condition.check()
    tests, remainders = build_tests(condition.test_sources, read, filters, seed)
    one = tests.withColumn("_one", F.lit(1).cast("decimal(38,0)"))
    numbered = running_sum(one, [F.asc("policy"), F.asc("password"), F.asc("user_id")], "_one", "_n").withColumn("row_id", (F.col("_n") + 1).cast("long")).drop("_one", "_n")
    numbered = stash(numbered, "tests")
    learned = learn(condition, *build_training(condition, read, tokenizers, filters, remainders))
    if path:
        S.write_structures(learned.structures, f"{path}/structures")
        S.write_terminals(learned.terminals.drop("rank"), f"{path}/terminalRules", learned.masses)
    out = {}
    for name in condition.cutoffs():
        results, raw = results_at(numbered, learned, float(name))
        out[name] = stash(results, "results")
        if path:
            S.write_table(P.lookup_table(raw), f"{path}/lookuptable.{condition.name}-{name}")
            S.write_totals(raw, f"{path}/totalcounts.{condition.name}-{name}")
            S.write_results(out[name], f"{path}/lookupresults.{condition.name}-{name}")
    return out
