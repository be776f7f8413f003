"""Operators whose plans were made for hot keys, against plain forms of the same thing."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from saltmarsh.operators import analysis as A
from saltmarsh.operators import config as C
from saltmarsh.operators import ngrams as N
from saltmarsh.operators import patterns as P
from saltmarsh.operators import quantize as Q
from saltmarsh.operators import wordfreq as W
from saltmarsh.plans.shared import running_max, running_sums_within, salted_join

ONE = "cast(1 AS decimal(38,0)) AS one"


def test_running_sums_within_keys_over_many_ranges(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc") if rng.random() < 0.9 else None, i, rng.randrange(5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    for parts in (1, 3, 40):
        got = {r.i: (int(r.n), int(r.s)) for r in running_sums_within(df.selectExpr("*", ONE), "k", [F.asc("i")], {"n": "one", "s": "v"}, parts).collect()}
        seen = {}
        for k, i, v in rows:
            n, s = seen.get(k, (0, 0))
            assert got[i] == (n, s)
            seen[k] = n + 1, s + v
    most = {r.i: r.m for r in running_max(df, [F.asc("i")], "v", "m", 7).collect()}
    assert all(most[i] == max(v for _, _, v in rows[: i + 1]) for i in most)
    assert running_sums_within(df.limit(0).selectExpr("*", ONE), "k", [F.asc("i")], {"n": "one"}).count() == 0


def test_salted_join_is_the_join(spark):
    left = spark.createDataFrame([(i % 3 and i, i) for i in range(100)], "k int, x int")
    right = spark.createDataFrame([(i, str(i)) for i in range(50)], "k int, y string")
    for how in ("inner", "left"):
        assert sorted(map(tuple, salted_join(left, right, ["k"], how).collect()), key=str) == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)


def test_bands_join_few_more_rows_than_are_kept(spark):
    rng = random.Random(2)
    groups = []
    for key in ("LLL", "DD", "S"):
        probs = sorted({rng.random() ** 6 for _ in range(400)}, reverse=True)
        total = sum(probs)
        groups += [(key, i, p / total, 1, f"{key}{i}") for i, p in enumerate(probs)]
    from decimal import Decimal

    g = spark.createDataFrame([(k, i, p, Decimal(n), f) for k, i, p, n, f in groups], "term_key string, group_idx int, prob double, size decimal(38,0), first_string string")
    structures = spark.createDataFrame([("LLLEDD", 0.5), ("LLLEDDELLL", 0.3), ("SEDDES", 0.2)], "structure string, prob double")
    for cutoff in (1e-4, 1e-5):
        got = {(r.structure, tuple(r.indices)): r.prob for r in P.enumerate_groups(structures, g, cutoff).collect()}
        want = {}
        own = {k: [(i, p) for kk, i, p, _, _ in groups if kk == k] for k in ("LLL", "DD", "S")}
        for s, sp in (("LLLEDD", 0.5), ("LLLEDDELLL", 0.3), ("SEDDES", 0.2)):
            names = s.split("E")

            def walk(k, prob, chosen, s=s, names=names):
                if k == len(names):
                    want[s, tuple(chosen)] = prob
                    return
                low = max((c for n, c in zip(names, chosen) if n == names[k]), default=0)
                for i, p in own[names[k]]:
                    if prob * p < cutoff:
                        break
                    if i >= low:
                        walk(k + 1, prob * p, [*chosen, i])

            walk(0, sp, [])
        assert got == want and len(want) > 100
    # of the first step's candidates, most are kept
    best = {k: max(p for _, p in v) for k, v in own.items()}
    bands = g.withColumn("band", P.band(F.col("prob")))
    every = {r.term_key: sorted(r.b) for r in bands.groupBy("term_key").agg(F.collect_set("band").alias("b")).collect()}
    state = spark.createDataFrame([(["LLL", "DD"], [best["LLL"], best["DD"]], [every["LLL"], every["DD"]], 0.5, [], [])], "pieces array<string>, bests array<double>, bands array<array<int>>, prob double, probs array<double>, indices array<int>")
    choice = bands.select("term_key", "band", F.col("prob").alias("p"), "group_idx", "size", "first_string")
    tried = P.affordable(state, choice, 0, 1e-4, True)
    kept = tried.filter(F.col("prob") * F.col("p") * F.col("rest") >= 1e-4).count()
    assert 20 < kept <= tried.count() <= 1.3 * kept + 10 < 400


def test_quantizer_is_the_best_division(spark):
    rng = np.random.default_rng(5)

    def error(values, counts, levels):
        return float((counts * values * (values - levels) ** 2).sum())

    for _ in range(40):
        m, k = int(rng.integers(2, 9)), int(rng.integers(1, 5))
        values, counts = rng.random(m) ** 3, rng.integers(1, 50, m).astype(float)
        got = Q.best_levels(values, counts, k)
        assert math.isclose((got * counts).sum(), (values * counts).sum())
        order = np.argsort(values)
        best = math.inf
        for cuts in itertools.combinations(range(1, m), min(k, m) - 1):
            levels = np.empty(m)
            for lo, hi in zip((0, *cuts), (*cuts, m)):
                part = order[lo:hi]
                levels[part] = np.average(values[part], weights=counts[part])
            best = min(best, error(values, counts, levels))
        assert error(values, counts, got) <= best * (1 + 1e-9) + 1e-15
    terminals = spark.createDataFrame([("LL", f"t{i}", p / 210, ["A"]) for i, p in enumerate([*range(1, 21)])] + [("D", "1", 1.0, ["A"])], "term_key string, terminal string, prob double, tags array<string>")
    structures = spark.createDataFrame([("LLED", 1.0)], "structure string, prob double")
    few = Q.quantize(terminals, structures, 6)
    assert few.filter("term_key = 'LL'").select("prob").distinct().count() == 4 and abs(few.agg(F.sum("prob")).first()[0] - 2) < 1e-9
    all_levels = Q.quantize(terminals, structures, C.Condition("x").totalquantlevels)
    assert all_levels.filter("prob <> raw_prob").isEmpty() and Q.error(all_levels).first().mse == 0 < Q.error(few).first().mse


def test_samples_take_as_many_as_asked_and_leave_the_rest(spark):
    rows = spark.createDataFrame([("a",)] * 5 + [("b",), (None,)], "word string")
    for n in (0, 1, 3, 6, 7, 50):
        taken, left = W.sample(rows, n, 3, ["word"])
        assert taken.count() == min(n, 7) and sorted(map(str, [*taken.collect(), *left.collect()])) == sorted(map(str, rows.collect()))
    assert W.sample(rows.limit(0), 3, 1, ["word"])[0].count() == 0
    # the draw doesn't depend on how the rows lie
    draw = lambda df: sorted(str(r) for r in C.build_tests([C.Source("s", "f", count=3, save_remainder=True)], lambda _: df, seed=4)[0].collect())
    assert draw(rows) == draw(rows.repartition(5).sortWithinPartitions(F.desc("word")))
    tests, rest = C.build_tests([C.Source("s", "f", count=0, save_remainder=True)], lambda _: rows)
    assert tests.count() == 0 and rest["f"].count() == 7
    many = C._numbered(rows, block=2).groupBy("word").agg(F.sort_array(F.collect_list("_nth")).alias("n")).collect()
    assert {r.word: list(r.n) for r in many} == {"a": [1, 2, 3, 4, 5], "b": [1], None: [1]}


def test_longest_prefixes_by_halving(spark):
    rng = random.Random(6)
    keys = {"".join(rng.choices("ab", k=rng.randrange(1, 14))) for _ in range(60)}
    rests = {"".join(rng.choices("abc", weights=[5, 5, 1], k=rng.randrange(1, 25))) for _ in range(200)}
    got = N.longest_prefixes(spark.createDataFrame([(r,) for r in rests], "rest string"), spark.createDataFrame([(k, k.upper()) for k in keys], "key string, best string"))
    want = {r: max((k for k in keys if r.startswith(k)), key=len, default=None) for r in rests}
    assert {r.rest: r.best and r.best.lower() for r in got.collect()} == want and sum(w is not None for w in want.values()) > 50
    none = N.longest_prefixes(spark.createDataFrame([("ab",)], "rest string"), spark.createDataFrame([], "key string, best string")).first()
    assert none.best is None


def test_log_rank_of_pairs(spark):
    rng = random.Random(7)
    rows = [(c, rng.choice([-2, -4, *range(1, 40)]) * (1 if c != "z" else 1)) for c in "xyz" for _ in range(80)] + [("z", 1)] * 60
    got = {(r["first"], r["second"]): r for r in A.logrank(spark.createDataFrame(rows, "condition string, guess long")).collect()}
    assert set(got) == {("x", "y"), ("x", "z"), ("y", "z")}
    for (a, b), r in got.items():
        left, left1 = sum(c in (a, b) for c, _ in rows), sum(c == a for c, _ in rows)
        n, survival, o, e, v = left, 1.0, 0.0, 0.0, 0.0
        for g in sorted({g for c, g in rows if c in (a, b) and g > 0}):
            d, d1 = sum(c in (a, b) and x == g for c, x in rows), sum(c == a and x == g for c, x in rows)
            o, e = o + survival * d1, e + survival * d * left1 / left
            if left > 1:
                v += survival**2 * d * left1 / left * (1 - left1 / left) * (left - d) / (left - 1)
            survival *= 1 - d / left
            left, left1 = left - d, left1 - d1
        assert math.isclose(r.statistic, (o - e) ** 2 / v, rel_tol=1e-9)
        assert math.isclose(r.p, math.erfc(math.sqrt(r.statistic / 2)), rel_tol=1e-7)
    ordered = sorted(got.values(), key=lambda r: r.p)
    worst = 0.0
    for i, r in enumerate(ordered):
        worst = max(worst, min(1.0, (3 - i) * r.p))
        assert math.isclose(r.adjusted, worst, rel_tol=1e-9)
    tails = spark.createDataFrame([(x,) for x in (0.0, 1e-6, 0.5, 3.84, 7.9, 8.1, 40.0, 300.0)], "x double").select("x", A.chi2_tail(F.col("x")).alias("p")).collect()
    assert all(math.isclose(r.p, math.erfc(math.sqrt(r.x / 2)), rel_tol=1e-6) for r in tails)
