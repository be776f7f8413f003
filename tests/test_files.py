"""Round trips of grammars, tables and results, and corpora from a configuration."""

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import config as C
from saltmarsh.operators import grammar as G
from saltmarsh.operators import patterns as P
from saltmarsh.operators import wordfreq as W
from saltmarsh.sources import grammars as S

CORPUS = "word string, freq double, tags array<string>"


def rows(df):
    return sorted(map(str, df.collect()))


def learned(spark):
    words = spark.createDataFrame([("12", 3.0, ["A"]), ("34", 1.0, ["B"]), ("77", 1.0, ["A"]), ("a1", 2.0, ["A", "B"]), ("Z9!", 1.0, []), ("é", 1.0, ["A"])], CORPUS)
    tokens = W.tokenize(words)
    return tokens, G.learn_structures(tokens), G.learn_terminals(tokens, unseen=True), G.unseen_mass(G.terminal_counts(tokens))


def test_grammar_round_trip(spark, tmp_path):
    _, structures, terminals, masses = learned(spark)
    S.write_structures(structures, str(tmp_path / "s"))
    assert rows(S.read_structures(spark, str(tmp_path / "s")).select(structures.columns)) == rows(structures)
    lines = [r.value for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert S.HEADER in lines and "" in lines
    S.write_terminals(terminals, str(tmp_path / "t"), masses)
    seen, unseen = S.read_terminals(spark, str(tmp_path / "t"))
    assert rows(seen.select(terminals.columns)) == rows(terminals)
    assert rows(unseen) == rows(masses.filter("unseen_mass > 0").select("term_key", "unseen_mass"))
    S.write_terminals(terminals.limit(0), str(tmp_path / "empty"))


def test_structures_need_header_and_probabilities(spark, tmp_path):
    (tmp_path / "a.txt").write_text("DD\t0x1.8p-1\tA\n")
    with pytest.raises(ValueError):
        S.read_structures(spark, str(tmp_path / "a.txt"))
    (tmp_path / "b.txt").write_text("S ->\nDD\t0x1.8p+1\tA\n\n")
    with pytest.raises(Exception, match="not a probability"):
        S.read_structures(spark, str(tmp_path / "b.txt")).collect()


def test_table_round_trip_order_and_totals(spark, tmp_path):
    _, structures, terminals, _ = learned(spark)
    raw = P.patterns(structures, G.terminal_groups(terminals), 1e-6)
    S.write_patterns(raw, str(tmp_path / "p"))
    assert rows(S.read_patterns(spark, str(tmp_path / "p"))) == rows(raw)
    table = P.lookup_table(raw)
    S.write_table(table, str(tmp_path / "l"))
    got, total = S.read_table(spark, str(tmp_path / "l"))
    assert rows(got) == rows(table.select("prob", "start", "pattern"))
    assert total.first().total == P.total_count(raw).first().total
    assert S.check_order(got).count() == 0
    swapped = got.withColumn("prob", F.when(F.col("start") == got.agg(F.max("start")).first()[0], F.lit(1.0)).otherwise(F.col("prob")))
    assert S.check_order(swapped).count() >= 1
    S.write_totals(raw, str(tmp_path / "n"))
    results = spark.createDataFrame([("u", "c", "a\x011", 0.25, "a\x011", 7, "AB"), ("u", "c", "??", -1.0, None, -40, None)], "workerid string, condition string, brokenpassword string, probability double, pattern string, guess_number long, source_ids string")
    S.write_results(results, str(tmp_path / "r"))
    pair = {r.brokenpassword: r for r in S.read_result_pair(spark, str(tmp_path / "r"), str(tmp_path / "n")).collect()}
    assert pair["a\x011"].guess_number == 7 and pair["??"].probability == -1.0 and pair["??"].guess_number == -40
    assert pair["??"].total == total.first().total
    made = spark.createDataFrame([("b", 0.1), ("a", 0.5), ("c", 0.1)], "string string, prob double")
    S.write_strings(made.coalesce(1), str(tmp_path / "o"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o")).collect()) == ["a", "b", "c"]


def test_remainders_counts_and_tokenizers(spark):
    files = {"leak": [("p4ss", 1.0, []), ("p4ss", 1.0, []), ("word", 1.0, []), ("12ab", 1.0, []), ("Zoo", 1.0, [])], "list": [("Blue-Sky", 1.0, [])]}
    read = lambda name: spark.createDataFrame(files[name], CORPUS)
    test, train = C.Source("t", "leak", count=2, save_remainder=True), C.Source("s", "leak", id="L", use_remainder=True)
    tests, left = C.build_tests([test], read, seed=3)
    assert tests.count() == 2 and left["leak"].count() == 3
    assert sorted([r.password for r in tests.collect()] + [r.word for r in left["leak"].collect()]) == sorted(w for w, *_ in files["leak"])
    with pytest.raises(ValueError):
        C.build_corpus([train], read)
    plan = C.Condition("c", structure_sources=[train], test_sources=[test], tokenized_sources=[C.Source("w", "list", id="W")], tokenize_tts_method="dash")
    dash = lambda df, structures: df.withColumn("word", F.translate("word", "-", "\x01"))
    assert C.Condition.from_json(plan.to_json()) == plan
    structures, pieces = C.build_training(plan.check(), read, {"dash": dash}, remainders=left)
    assert structures.agg(F.sum("freq")).first()[0] == 3.0
    got = {r.word: r for r in pieces.collect()}
    assert got["blue"].tags == ["W"] and got["sky"].freq == 1.0 and all(w == w.lower() for w in got)
    with pytest.raises(ValueError):
        C.Condition("c", structure_sources=[train], test_sources=[test], tokenized_sources=[train]).check()
