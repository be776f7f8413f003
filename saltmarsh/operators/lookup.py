"""Ranking test strings: parses, best parse, guess numbers and statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import text as X
from saltmarsh.operators import patterns as P
from saltmarsh.operators.unseen import unseen_ranks
from saltmarsh.plans.shared import salted_join

#: Parse statuses.
PARSED, BEYOND_CUTOFF, NO_STRUCTURE, NO_TERMINAL, COLLISION, NOT_GENERATABLE, FAILED = 1, 2, 4, 8, 16, 32, 64


def _ways(values):
    """In how many ways an array can be arranged."""
    same = F.transform(F.array_distinct(values), lambda v: F.factorial(F.size(F.filter(values, lambda w: w == v))))
    return X.div(F.factorial(F.size(values)), F.aggregate(same, F.lit(1).cast("long"), lambda a, x: a * x))


def permutation_rank(nonterminals, indices):
    """The rank of an arrangement among all arrangements of the group indices of equal nonterminals; several such are digits of a number, first appearance first.

    Of the arrangements of what is left at a place, those with a smaller element there are the share of smaller elements.
    """
    places = F.arrays_zip(nonterminals.alias("p"), indices.alias("i"))

    def own(digits):
        def step(a, k):
            rest = F.slice(digits, k, F.size(digits))
            smaller = F.size(F.filter(rest, lambda x: x < F.get(digits, k - 1)))
            return a + X.div((_ways(rest) * smaller.cast("decimal(38,0)")).cast("decimal(38,0)"), F.size(rest))

        return F.aggregate(F.sequence(F.lit(1), F.size(digits)), F.lit(0).cast("long"), step)

    def digit(a, p):
        digits = F.transform(F.filter(places, lambda x: x["p"] == p), lambda x: x["i"])
        return (a * _ways(digits) + own(digits)).cast("decimal(38,0)")

    return F.aggregate(F.array_distinct(nonterminals), F.lit(0).cast("decimal(38,0)"), digit)


def unrank_permutation(nonterminals, indices, rank):
    """The arrangement of group indices at a rank: the inverse of permutation_rank. Of what is left, sorted, the element at rank * size / ways comes next."""

    def arranged(digits, own):
        def step(a, _):
            left, ways, n = a["left"], _ways(a["left"]), F.size(a["left"])
            chosen = F.get(left, X.div(a["own"].cast("decimal(38,0)") * n, ways).cast("int"))
            smaller = F.size(F.filter(left, lambda x: x < chosen))
            skipped = X.div((ways * smaller.cast("decimal(38,0)")).cast("decimal(38,0)"), n)
            at = F.array_position(left, chosen).cast("int")
            rest = F.concat(F.slice(left, 1, at - 1), F.slice(left, at + 1, n))
            return F.struct(rest.alias("left"), (a["own"] - skipped).alias("own"), F.concat(a["out"], F.array(chosen)).alias("out"))

        start = F.struct(F.array_sort(digits).alias("left"), own.cast("long").alias("own"), F.expr("cast(array() AS array<int>)").alias("out"))
        return F.aggregate(digits, start, step, lambda a: a["out"])

    places = F.arrays_zip(nonterminals.alias("p"), indices.alias("i"))
    names = F.array_distinct(nonterminals)
    own_digits = lambda p: F.transform(F.filter(places, lambda x: x["p"] == p), lambda x: x["i"])
    start = F.struct(rank.cast("long").alias("left"), F.expr("cast(map() AS map<string, array<int>>)").alias("out"))

    def digit(a, p):
        ways = _ways(own_digits(p))
        return F.struct(X.div(a["left"], ways).alias("left"), F.map_concat(a["out"], F.create_map(p, arranged(own_digits(p), a["left"] % ways))).alias("out"))

    found = F.aggregate(F.reverse(names), start, digit, lambda a: a["out"])
    nth = lambda p, i: F.size(F.filter(F.slice(nonterminals, 1, i), lambda q: q == p))
    return F.transform(nonterminals, lambda p, i: F.get(F.element_at(found, p), nth(p, i)))


def _with_unseen(placed: DataFrame, terminals: DataFrame, groups: DataFrame, cutoff: float) -> DataFrame:
    """Pieces that no terminal has, but their key's unseen group can make, get that group and their rank in it. A group under the cutoff is in no pattern of the table, so its strings need no rank; it is null."""
    group = groups.filter("is_unseen").select("term_key", F.col("prob").alias("u_p"), F.col("group_idx").alias("u_group"), F.col("size").alias("u_size"), F.col("first_string").alias("u_first"))
    lacking = placed.filter(F.col("p").isNull() & X.generatable("terminal", "term_key")).select("term_key", "terminal").distinct()
    likely = lacking.join(group.filter(F.col("u_p") >= cutoff).select("term_key"), "term_key", "left_semi").withColumn("idx", X.wide_index("terminal"))
    ranks = unseen_ranks(likely.select("term_key", "idx"), terminals).select("term_key", "idx", X.wide_narrow(F.col("rank")).alias("u_rank"))
    ranked = likely.join(ranks, ["term_key", "idx"]).select("term_key", "terminal", "u_rank")
    found = lacking.join(group, "term_key").join(ranked, ["term_key", "terminal"], "left")
    both = placed.join(found, ["term_key", "terminal"], "left")
    either = {"p": "u_p", "rank": "u_rank", "group_idx": "u_group", "size": "u_size", "first_string": "u_first"}
    return both.withColumns({c: F.coalesce(c, u) for c, u in either.items()}).drop(*either.values())


def parses(tests: DataFrame, structures: DataFrame, terminals: DataFrame, groups: DataFrame, unseen: bool = False, cutoff: float = 0.0) -> DataFrame:
    """One row for each test and structure of its class string: row_id, structure, parsed, prob, pattern, rank and tags. tests: (row_id, password). With unseen, groups have unseen ones, which take pieces that no terminal has. A parse under the cutoff has no rank (null), nor one whose rank has more than 38 digits."""
    bare = structures.select("structure", F.col("prob").alias("structure_prob"), F.replace("structure", F.lit("E"), F.lit("")).alias("classes"))
    matched = tests.withColumn("classes", X.structure(X.strip_breaks("password"))).join(bare, "classes")
    spans = matched.withColumn("pieces", F.filter(F.split("structure", "E"), lambda p: p != ""))
    ends = F.transform(F.sequence(F.lit(1), F.size("pieces")), lambda k: F.aggregate(F.slice("pieces", 1, k), F.lit(0), lambda a, p: a + F.length(p)))
    spans = spans.withColumn("ends", ends).select("row_id", "password", "structure", "structure_prob", "pieces", F.posexplode("pieces").alias("k", "piece"), "ends")
    start = F.get("ends", F.col("k")) - F.length("piece")
    text = F.substring(X.byte_view(X.strip_breaks("password")), start + 1, F.length("piece"))
    parts = spans.select("row_id", "structure", "structure_prob", "pieces", "k", "piece", X.term_key("piece").alias("term_key"), X.ascii_lower(text).alias("terminal"))
    known = parts.join(terminals.select("term_key", "terminal", F.col("prob").alias("p"), "rank", "tags"), ["term_key", "terminal"], "left")
    placed = salted_join(known, groups.filter("not is_unseen").select("term_key", F.col("prob").alias("p"), "group_idx", "size", "first_string"), ["term_key", "p"], "left")
    if unseen:
        placed = _with_unseen(placed, terminals, groups, cutoff)
    placed = placed.withColumn("tags", F.coalesce("tags", F.expr("cast(array() as array<string>)")))
    fields = F.struct("k", "piece", "p", "rank", "group_idx", "size", "first_string", "tags")
    rows = placed.groupBy("row_id", "structure", "structure_prob", "pieces").agg(F.array_sort(F.collect_list(fields)).alias("x"))
    parsed = ~F.exists("x", lambda e: e["p"].isNull())
    rows = rows.withColumn("parsed", parsed)
    # group indices of equal nonterminals in ascending order, each nonterminal keeping its places
    nth = lambda e: F.size(F.filter("x", lambda o: (o["piece"] == e["piece"]) & (o["k"] < e["k"])))
    ordered = lambda e: F.array_sort(F.transform(F.filter("x", lambda o: o["piece"] == e["piece"]), lambda o: F.struct(o["group_idx"].alias("g"), o["p"].alias("p"), o["first_string"].alias("f"))))
    rows = rows.withColumn("canonical", F.when(F.col("parsed"), F.transform("x", lambda e: F.get(ordered(e), nth(e)))))
    prob = F.aggregate("canonical", F.col("structure_prob"), lambda a, c: a * c["p"])
    pattern = F.array_join(F.zip_with("canonical", "pieces", lambda c, p: X.in_case_of(c["f"], p)), X.BREAK)
    exact = lambda c: c.cast("decimal(38,0)")
    digits = F.aggregate("x", exact(F.lit(0)), lambda a, e: exact(F.try_add(F.try_multiply(a, e["size"]), e["rank"])))
    size = F.aggregate("x", exact(F.lit(1)), lambda a, e: exact(F.try_multiply(a, e["size"])))
    repeated = F.size(F.array_distinct("pieces")) < F.size("pieces")
    rows = rows.withColumn("prob", F.when(F.col("parsed"), prob))
    needed = F.col("parsed") & (F.col("prob") >= cutoff)
    turn = F.when(needed & repeated, permutation_rank(F.col("pieces"), F.transform("x", lambda e: e["group_idx"]))).otherwise(exact(F.lit(0)))
    return rows.withColumn("turn", turn).select(
        "row_id", "structure", "parsed", "prob", F.when(F.col("parsed"), pattern).alias("pattern"),
        F.when(needed, exact(F.try_add(F.try_multiply("turn", size), digits))).alias("rank"),
        F.when(F.col("parsed"), F.array_sort(F.array_distinct(F.flatten("x.tags")))).alias("tags"),
    )


def best_parses(tests: DataFrame, found: DataFrame, structures: DataFrame) -> DataFrame:
    """For each test the most likely parse (the likelier, then first structure wins ties), all parses' sum, their number, and a status."""
    order = structures.select("structure", F.col("prob").alias("sp"))
    tied = found.join(order, "structure").withColumn("_s", F.struct("prob", "sp", "structure", "pattern", "rank", "tags"))
    sums = tied.groupBy("row_id").agg(
        F.max(F.when(F.col("parsed"), F.col("_s"))).alias("best"), F.count_if("parsed").alias("parses"), F.count("*").alias("structures"), F.sum(F.when(F.col("parsed"), F.col("prob"))).alias("sum_prob")
    )
    out = tests.select("row_id", "password").join(sums, "row_id", "left")
    status = F.when(F.col("structures").isNull(), NO_STRUCTURE).when(F.col("parses") == 0, NO_TERMINAL | NOT_GENERATABLE).otherwise(PARSED)
    return out.select(
        "row_id", "password", status.alias("status"), F.coalesce("best.prob", F.lit(-1.0)).alias("prob"), "best.pattern", "best.rank", "best.tags",
        F.coalesce("parses", F.lit(0)).alias("parses"), F.coalesce("sum_prob", F.lit(0.0)).alias("sum_prob"),
    )


def guess_numbers(best: DataFrame, table: DataFrame, least: DataFrame | None = None) -> DataFrame:
    """The guess number of each test, or its status below zero: -2 if its probability is under the table's smallest. A likelier pattern that the table lacks ends the run: table and grammar don't belong together. `least` has that probability in one row, where the table is a part of the whole."""
    at = table.select("pattern", "start", F.col("prob").alias("table_prob"))
    least = table.agg(F.min("prob").alias("least")) if least is None else least
    joined = best.join(at, "pattern", "left").crossJoin(F.broadcast(least))  # one row
    found = (F.col("status") == PARSED) & F.col("start").isNotNull() & (F.col("prob") == F.col("table_prob"))
    beyond = (F.col("status") == PARSED) & (F.col("least").isNull() | (F.col("prob") < F.col("least")))
    wrong = F.raise_error(F.concat(F.lit("not in the table, though above its cutoff: "), F.coalesce("pattern", F.lit("")))).cast("decimal(38,0)")
    number = F.when(found, F.col("start") + F.col("rank")).when(beyond, F.lit(-BEYOND_CUTOFF)).when(F.col("status") == PARSED, wrong).otherwise(-F.col("status"))
    return joined.select(
        "row_id", "password", "prob", F.when(found, F.col("pattern")).otherwise("").alias("pattern"), number.cast("decimal(38,0)").alias("guess_number"),
        F.coalesce(F.array_join("tags", ""), F.lit("")).alias("source_ids"),
    )


def lookup(tests: DataFrame, structures: DataFrame, terminals: DataFrame, groups: DataFrame, cutoff: float, unseen: bool = False) -> DataFrame:
    """From tests to guess numbers; terminals have ranks."""
    table = P.lookup_table(P.patterns(structures, groups, cutoff))
    return guess_numbers(best_parses(tests, parses(tests, structures, terminals, groups, unseen, cutoff), structures), table)
