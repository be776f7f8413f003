"""Unseen terminals in lookups, and streams, on small fixtures."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import grammar as G
from saltmarsh.operators import lookup as L
from saltmarsh.operators import wordfreq as W
from saltmarsh.streaming import guesses


def test_all_strings_of_a_mask_have_their_own_guess_number(spark):
    words = spark.createDataFrame([("12", 3.0, ["A"]), ("34", 1.0, ["B"]), ("77", 1.0, ["A"]), ("a1", 2.0, ["A"])], "word string, freq double, tags array<string>")
    tokens = W.tokenize(words)
    terminals = G.terminal_ranks(G.learn_terminals(tokens, unseen=True))
    masses = G.unseen_mass(G.terminal_counts(tokens))
    groups = G.terminal_groups(terminals, G.unseen_groups(terminals, masses))
    tests = [f"{i:02d}" for i in range(100)] + ["a1", "b7", "Z9", "é1"]
    frame = spark.createDataFrame(list(enumerate(tests)), "row_id long, password string")
    got = {r.password: r for r in L.lookup(frame, G.learn_structures(tokens), terminals, groups, 1e-9, unseen=True).collect()}
    two = sorted((r for p, r in got.items() if p.isdigit()), key=lambda r: r.guess_number)
    assert len({r.guess_number for r in two}) == 100 and min(r.guess_number for r in two) >= 0
    assert two[0].password == "12" and all(a.prob >= b.prob for a, b in zip(two, two[1:]))
    mass = {r.term_key: r.unseen_mass for r in masses.collect()}["DD"]
    assert abs(sum(r.prob for r in two) - 5 / 7) < 1e-9 and abs(got["00"].prob - 5 / 7 * mass / 97) < 1e-9
    # by index, whose first digit counts least, less the seen ones before
    unseen = [p for p in sorted((p for p in got if p.isdigit()), key=lambda p: int(p[::-1])) if p not in ("12", "34", "77")]
    order = [got[p].guess_number for p in unseen]
    assert order == sorted(order) and order[-1] - order[0] == 96
    assert got["b7"].guess_number >= 0 and got["Z9"].guess_number == -4 and got["é1"].guess_number == -4
    assert L.lookup(frame, G.learn_structures(tokens), terminals, groups, 1e-9).filter("guess_number = -40").count() > 90


def test_wide_numbers_are_indices_and_back(spark):
    from pyspark.sql import functions as F

    from saltmarsh.functions import text as X

    rng = random.Random(3)
    sizes = {"L": (26, X.LOWER), "D": (10, "0123456789"), "S": (33, X.SYMBOLS)}
    rows = []
    for n in [1, 2, 5, 17, 27, 28, 38, 39, 40] * 4:
        mask = "".join(rng.choice("LDS") for _ in range(n)) if n < 40 else "S" * 40
        word = "".join(rng.choice(sizes[m][1]) for m in mask) if len(rows) % 5 else "".join(sizes[m][1][-1] for m in mask)
        index = combos = 0
        for m, c in zip(reversed(mask), reversed(word)):
            index = index * sizes[m][0] + sizes[m][1].index(c)
        for m in mask:
            combos = (combos or 1) * sizes[m][0]
        rows.append((mask, word, str(index), str(combos), str(index + 1), str(index - min(index, 7))))
    df = spark.createDataFrame(rows, "mask string, word string, i string, n string, next string, less string")
    index = X.wide_index("word")
    got = df.select("*", X.wide_text(index).alias("gi"), X.wide_text(X.wide_combinations("mask")).alias("gn"), X.wide_text(X.wide_next(index)).alias("gnext"), X.wide_string(index, "mask").alias("gw"),
                    X.wide_text(X.wide_less(index, F.least(F.lit(7).cast("decimal(38,0)"), F.coalesce(X.wide_narrow(index), F.lit(7))))).alias("gless"), X.unseen_index("word").cast("string").alias("narrow")).collect()
    for r in got:
        assert (r.gi, r.gn, r.gnext, r.gw, r.gless) == (r.i, r.n, r.next, r.word, r.less)
        assert r.narrow == (r.i if len(r.i) <= 38 else None)
    assert [r.word for r in df.orderBy(F.length("mask"), "mask", X.wide_index("word")).collect()] == [x[1] for x in sorted(rows, key=lambda x: (len(x[0]), x[0], int(x[2])))]


def test_permutation_ranks_number_the_arrangements(spark):
    from itertools import permutations

    cases = [["L", "L", "L", "D"], ["L", "D", "L", "D", "L"], ["S", "D", "S", "S", "D", "D"]]
    digits = [[0, 1, 2, 5], [1, 4, 2, 4, 3], [2, 0, 1, 3, 3, 0]]
    rows = []
    for case, (names, own) in enumerate(zip(cases, digits)):
        by_name = {n: sorted(set(permutations([d for x, d in zip(names, own) if x == n]))) for n in dict.fromkeys(names)}
        every = [[]]
        for n in by_name:
            every = [e + [(n, p)] for e in every for p in by_name[n]]
        for rank, chosen in enumerate(every):
            left = {n: list(p) for n, p in chosen}
            rows.append((case, names, [left[n].pop(0) for n in names], rank))
    df = spark.createDataFrame(rows, "case int, p array<string>, i array<int>, rank int")
    ranked = df.withColumn("got", L.permutation_rank(df["p"], df["i"]))
    got = ranked.select("rank", "got", "i", L.unrank_permutation(df["p"], df["i"], F.col("got")).alias("back")).collect()
    assert len(got) >= 30 and all(int(r.got) == r.rank and r.back == r.i for r in got)


def learned(spark, words, cutoff, tests):
    tokens = W.tokenize(spark.createDataFrame([(w, f, ["A"]) for w, f in words], "word string, freq double, tags array<string>"))
    terminals = G.terminal_ranks(G.learn_terminals(tokens, unseen=True))
    groups = G.terminal_groups(terminals, G.unseen_groups(terminals, G.unseen_mass(G.terminal_counts(tokens))))
    frame = spark.createDataFrame(list(enumerate(tests)), "row_id long, password string")
    return groups, terminals, {r.password: r for r in L.lookup(frame, G.learn_structures(tokens), terminals, groups, cutoff, unseen=True).collect()}


def test_strings_with_unseen_terminals_and_their_numbers(spark, tmp_path):
    """All strings of a small grammar, each with its number; and from numbers back to strings, over a stored table."""
    from saltmarsh.operators import patterns as P
    from saltmarsh.operators import stored
    from saltmarsh.operators import unseen as U

    tokens = W.tokenize(spark.createDataFrame([("12", 3.0, ["A"]), ("34", 1.0, ["B"]), ("7a9", 2.0, ["A"]), ("3b7", 1.0, []), ("5C5", 1.0, [])], "word string, freq double, tags array<string>"))
    terminals = G.terminal_ranks(G.learn_terminals(tokens, unseen=True))
    structures = G.learn_structures(tokens)
    groups = G.terminal_groups(terminals, G.unseen_groups(terminals, G.unseen_mass(G.terminal_counts(tokens))))
    masks = spark.createDataFrame([("DD",), ("L",)], "term_key string")
    made = {(r.term_key, r.terminal) for r in U.unseen_strings(masks, terminals, block=7).collect()}
    seen = {(r.term_key, r.terminal) for r in terminals.collect()}
    assert made == ({("DD", f"{i:02d}") for i in range(100)} | {("L", c) for c in "abcdefghijklmnopqrstuvwxyz"}) - seen
    every = [f"{i:02d}" for i in range(100)] + [f"{a}{c}{b}" for a in range(10) for b in range(10) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    cutoff = 1e-6
    table = P.lookup_table(P.patterns(structures, groups, cutoff))
    stored.store(table, str(tmp_path / "t"), shards=5)
    frame = spark.createDataFrame(list(enumerate(every)), "row_id long, password string")
    best = L.best_parses(frame, L.parses(frame, structures, terminals, groups, True, cutoff), structures)
    numbers = {r.password: (r.guess_number, r.prob) for r in stored.find(spark, str(tmp_path / "t"), best).collect()}
    assert numbers == {r.password: (r.guess_number, r.prob) for r in L.lookup(frame, structures, terminals, groups, cutoff, True).collect()}
    ranked = {p: n for p, (n, _) in numbers.items() if n > 0}
    assert len(ranked) > 1000 and len(set(ranked.values())) == len(ranked)
    made = {r.string.replace("\x01", ""): r.prob for r in P.strings(structures, terminals, groups, cutoff, unseen=True).collect()}
    assert set(made) == set(ranked) and all(abs(made[p] - numbers[p][1]) < 1e-12 for p in ranked)
    # every number of the table is a string's, and back; numbers beyond it are left out
    total = int(table.agg(F.sum("n")).first()[0])
    assert total == len(ranked) and set(map(int, ranked.values())) == set(range(1, total + 1))
    asked = spark.range(0, total + 3).select(F.col("id").alias("row_id"), F.col("id").alias("number"))
    found = stored.patterns_at(spark, str(tmp_path / "t"), asked)
    back = {r.row_id: r.string.replace("\x01", "") for r in stored.strings_at(found, terminals, groups).collect()}
    assert back == {int(n): p for p, n in ranked.items()}


def test_a_few_tests_read_a_few_shards(spark, tmp_path):
    from saltmarsh.operators import stored

    table = spark.createDataFrame([(1.0 / (i + 2), Decimal(2), Decimal(1 + 2 * i), f"p{i}") for i in range(500)], "prob double, n decimal(38,0), start decimal(38,0), pattern string")
    stored.store(table, str(tmp_path / "t"), shards=32)
    best = spark.createDataFrame([(1, "x", 1, 1.0 / 7, "p5", Decimal(0), ["A"]), (2, "y", 4, -1.0, None, None, None)], "row_id long, password string, status int, prob double, pattern string, rank decimal(38,0), tags array<string>")
    part = stored.shards_read(spark, str(tmp_path / "t"), best)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [(shard" in plan
    assert part.select("shard").distinct().count() == 1 and part.count() < 100
    got = {r.row_id: int(r.guess_number) for r in stored.find(spark, str(tmp_path / "t"), best).collect()}
    assert got == {1: 11, 2: -4}
    few = stored.patterns_at(spark, str(tmp_path / "t"), spark.createDataFrame([(1, 12), (2, 1000), (3, 1001)], "row_id long, number long"))
    assert sorted((r.row_id, r.pattern, int(r.rank)) for r in few.collect()) == [(1, "p5", 1), (2, "p499", 1)]


def test_long_masks_keep_their_unseen_group(spark):
    long = ["a" * 30, "b" * 29 + "c", "~" * 40, "!" * 40]
    groups, terminals, got = learned(spark, [(w, 1.0) for w in [*long, "12", "34"]], 1e-9, ["z" * 30, long[0], " " * 40, "55", "x" * 20 + "1234567890", "12"])
    rows = {(r.term_key, r.is_unseen): r for r in groups.collect()}
    for key, seen, radix in (("L" * 30, 2, 26), ("S" * 40, 2, 33)):
        own = rows[key, True]
        assert own.size is None and int(own.size_text) == radix ** len(key) - seen
        mass = own.prob * int(own.size_text) + sum(r.prob for r in terminals.filter(terminals.term_key == key).collect())
        assert abs(mass - 1) < 1e-9
    assert rows["S" * 40, True].first_string == " " * 40 and rows["L" * 30, True].first_string == "b" + "a" * 29
    assert int(got["z" * 30].guess_number) == int(got[" " * 40].guess_number) == -2
    assert got[long[0]].guess_number > 0 and got["55"].guess_number > 0
    assert int(got["x" * 20 + "1234567890"].guess_number) == -4


def test_digits_after_long_letters_are_beyond_the_cutoff(spark):
    _, _, got = learned(spark, [("abcdefghijklmnopqrst1234567890", 2.0), ("zyxwvutsrqponmlkjihg0987654321", 1.0), ("q7", 3.0)], 1e-6, ["qwertyuiopasdfghjklz5556667778", "a7", "abcdefghijklmnopqrst1234567890"])
    assert int(got["qwertyuiopasdfghjklz5556667778"].guess_number) == -2
    assert got["a7"].guess_number > 0 and got["abcdefghijklmnopqrst1234567890"].guess_number > 0


def test_a_table_of_another_grammar_is_an_error(spark):
    best = spark.createDataFrame([(1, "ab", 1, 0.5, "zz", Decimal(0), ["A"])], "row_id long, password string, status int, prob double, pattern string, rank decimal(38,0), tags array<string>")
    table = spark.createDataFrame([(0.1, Decimal(1), Decimal(1), "yy")], "prob double, n decimal(38,0), start decimal(38,0), pattern string")
    with pytest.raises(Exception, match="above its cutoff"):
        L.guess_numbers(best, table).collect()


def test_stream_of_test_strings(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.txt").write_text("one\ntwo\n\n")
    (source / "b.txt").write_text("one\nnine\n")
    ranked = spark.createDataFrame([("one", 5), ("one", 2), ("two", 3)], "word string, rank long")
    out = guesses.answered(guesses.lines(spark, str(source)), ranked)
    out.writeStream.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(sink)).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(sink)).collect())) == [("nine", -1), ("one", 2), ("one", 2), ("two", 3)]
