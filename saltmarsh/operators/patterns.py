"""Patterns above a cutoff, strings, and the lookup table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import text as X
from saltmarsh.operators.unseen import unseen_strings
from saltmarsh.plans.shared import running_sum, salted_join, stash


def pieces(structures: DataFrame) -> DataFrame:
    """structure, prob, pieces: the nonterminals in order."""
    return structures.select("structure", F.col("prob").alias("structure_prob"), F.filter(F.split("structure", "E"), lambda p: p != "").alias("pieces"))


def permutations(indices: Column, nonterminals: Column) -> Column:
    """In how many ways the group indices of equal nonterminals can be placed: n! over the factorials of their multiplicities, for each."""
    pairs = F.arrays_zip(nonterminals.alias("p"), indices.alias("i"))
    counted = lambda values: F.transform(F.array_distinct(values), lambda v: F.factorial(F.size(F.filter(values, lambda w: w == v))))
    product = lambda numbers: F.aggregate(numbers, F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    return (product(counted(nonterminals)) / product(counted(pairs))).cast("decimal(38,0)")


#: Bands of probability for each factor of two.
BANDS = 2


def band(p: Column) -> Column:
    """Rising as the probability falls."""
    return F.floor(-F.log2(p) * BANDS).cast("int")


def affordable(state: DataFrame, choice: DataFrame, k: int, cutoff: float, canonical: bool) -> DataFrame:
    """States with the groups of their next nonterminal that they may still take: a join by key and band. Bands before a state's last one are taken whole, so few more rows are joined than are kept."""
    slack = 1 - 1e-9
    state = state.withColumns({"piece": F.get("pieces", F.lit(k)), "term_key": X.term_key(F.get("pieces", F.lit(k)))})
    rest = F.aggregate(F.slice("bests", k + 2, F.greatest(F.size("bests") - k - 1, F.lit(0))), F.lit(1.0), lambda a, x: a * x)
    # without a cutoff all bands are affordable
    last = F.floor(-F.log2(cutoff * slack / (F.col("prob") * rest)) * BANDS + 1e-6).cast("int") if cutoff > 0 else F.lit(1 << 30)
    state = state.withColumns({"rest": rest, "last_band": last})
    first = F.lit(0)
    if canonical:
        same = F.filter(F.arrays_zip(F.slice("pieces", 1, k).alias("p"), F.col("indices").alias("i"), F.col("probs").alias("q")), lambda x: x["p"] == F.col("piece"))
        state = state.withColumn("before", same)
        # equal nonterminals have indices that don't decrease, so probabilities that don't grow
        first = F.coalesce(F.array_max(F.transform("before", lambda x: band(x["q"]))), F.lit(0))
    bands = F.filter(F.get("bands", F.lit(k)), lambda b: (b >= first) & (b <= F.col("last_band")))
    return state.withColumn("band", F.explode(bands)).join(choice, ["term_key", "band"])


def enumerate_groups(structures: DataFrame, groups: DataFrame, cutoff: float, canonical: bool = True, most: int = 20) -> DataFrame:
    """All choices of one group for each nonterminal with probability >= cutoff.

    A step for each place joins the next nonterminal's groups. A state goes on only if the largest groups of
    the places left can still reach the cutoff; with `canonical`, equal nonterminals have indices that don't
    decrease. Probabilities are left-fold products, so they are the same doubles wherever they are computed.
    """
    groups = groups.withColumn("band", band(F.col("prob")))
    best = groups.groupBy("term_key").agg(F.max("prob").alias("best"), F.array_sort(F.collect_set("band")).alias("bands"))
    placed = pieces(structures).select("structure", "structure_prob", "pieces", F.posexplode("pieces").alias("k", "piece"))
    bounds = placed.join(best, X.term_key("piece") == F.col("term_key")).groupBy("structure", "structure_prob", "pieces").agg(F.array_sort(F.collect_list(F.struct("k", "best", "bands"))).alias("b"))
    # a structure with a nonterminal that has no group makes nothing
    state = bounds.filter(F.size("b") == F.size("pieces")).select(
        "structure", "pieces", F.col("b.best").alias("bests"), F.col("b.bands").alias("bands"), F.col("structure_prob").alias("prob"), F.expr("cast(array() AS array<double>)").alias("probs"),
        F.expr("cast(array() AS array<int>)").alias("indices"), F.expr("cast(array() AS array<string>)").alias("firsts"), F.expr("cast(array() AS array<decimal(38,0)>)").alias("sizes"),
    )
    state = stash(state, "starts")
    choice = groups.select("term_key", "band", F.col("prob").alias("p"), "group_idx", "size", "first_string")
    longest = state.agg(F.max(F.size("pieces"))).first()[0] or 0
    if longest > most:
        raise ValueError("a structure has more nonterminals than a word can have")
    done = None
    for k in range(longest):
        state = affordable(state, choice, k, cutoff, canonical).filter(F.col("prob") * F.col("p") * F.col("rest") >= cutoff * (1 - 1e-9))
        if canonical:
            state = state.filter(F.forall("before", lambda x: x["i"] <= F.col("group_idx")))
        state = state.select(
            "structure", "pieces", "bests", "bands", (F.col("prob") * F.col("p")).alias("prob"), F.concat("probs", F.array("p")).alias("probs"), F.concat("indices", F.array("group_idx")).alias("indices"),
            F.concat("firsts", F.array(X.in_case_of("first_string", "piece"))).alias("firsts"), F.concat("sizes", F.array("size")).alias("sizes"),
        )
        if k + 1 < longest:
            state = stash(state, "patterns")  # read twice: by its finished rows and by the next step
        ended = state.filter(F.size("pieces") == k + 1).filter(F.col("prob") >= cutoff)
        done = ended if done is None else done.unionByName(ended)
        state = state.filter(F.size("pieces") > k + 1)
    return done if done is not None else state


def patterns(structures: DataFrame, groups: DataFrame, cutoff: float) -> DataFrame:
    """prob, n, pattern: every pattern >= cutoff once, with the strings of all its permutations."""
    out = enumerate_groups(structures, groups, cutoff)
    product = F.aggregate("sizes", F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    n = (product * permutations(F.col("indices"), F.col("pieces"))).cast("decimal(38,0)")
    return out.select("prob", n.alias("n"), F.array_join("firsts", X.BREAK).alias("pattern"))


def lookup_table(raw: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds start, the first guess number: by probability, then by count as text and by pattern, all descending."""
    order = [F.desc("prob"), F.desc(F.col("n").cast("string")), F.desc("pattern")]
    return running_sum(raw, order, "n", "before", parts).select("prob", "n", (F.col("before") + 1).cast("decimal(38,0)").alias("start"), "pattern")


def total_count(raw: DataFrame) -> DataFrame:
    return raw.agg(F.sum("n").cast("decimal(38,0)").alias("total"))


def strings(structures: DataFrame, terminals: DataFrame, groups: DataFrame, cutoff: float, unseen: bool = False) -> DataFrame:
    """prob, string, structure: every string of every pattern >= cutoff; with unseen, those of unseen terminals, too."""
    used = groups if unseen else groups.filter("not is_unseen")
    choices = stash(enumerate_groups(structures, used, cutoff, canonical=False).select("structure", "pieces", "prob", "indices"), "choices")
    seen = groups.filter("not is_unseen").select("term_key", "prob", "group_idx")
    members = salted_join(terminals.select("term_key", "terminal", "prob"), seen, ["term_key", "prob"]).select("term_key", "group_idx", "terminal")
    if unseen:
        # no group under the cutoff is in a pattern, so few strings are made in vain
        likely = groups.filter("is_unseen").filter(F.col("prob") >= cutoff).select("term_key", "group_idx")
        members = members.unionByName(unseen_strings(likely, terminals).join(likely, "term_key").select("term_key", "group_idx", "terminal"))
    state = choices.withColumn("string", F.lit(""))
    longest = choices.agg(F.max(F.size("pieces"))).first()[0] or 0
    out = None
    for k in range(longest):
        state = state.withColumns({"term_key": X.term_key(F.get("pieces", F.lit(k))), "group_idx": F.get("indices", F.lit(k))}).join(members, ["term_key", "group_idx"])
        text = F.concat("string", F.when(F.lit(k > 0), F.lit(X.BREAK)).otherwise(""), X.in_case_of("terminal", F.get("pieces", F.lit(k))))
        state = state.withColumn("string", text).select("structure", "pieces", "prob", "indices", "string")
        ended = state.filter(F.size("pieces") == k + 1).select("prob", "string", "structure")
        out = ended if out is None else out.unionByName(ended)
        state = state.filter(F.size("pieces") > k + 1)
    return out


def accurate_strings(made: DataFrame) -> DataFrame:
    """Each string once, without breaks: the sum over its structures and the most likely one's tokens."""
    bare = made.withColumn("bare", X.strip_breaks("string"))
    return bare.groupBy("bare").agg(F.sum("prob").alias("prob"), F.max(F.struct("prob", "string")).alias("best"), F.count("*").alias("parses")).select("bare", "prob", F.col("best.string").alias("string"), "parses")
