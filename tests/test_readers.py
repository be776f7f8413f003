"""Readers, writers and checks of corpora and results, on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import analysis as A
from saltmarsh.operators import config as C
from saltmarsh.operators import grammar as G
from saltmarsh.operators import wordfreq as W
from saltmarsh.sources import corpora as S

CORPUS = "word string, freq double, tags array<string>"


def test_corpora_of_all_kinds(spark, tmp_path):
    (tmp_path / "plain.txt").write_text("one\n\ntwo\r\none\n")
    with gzip.open(tmp_path / "more.txt.gz", "wt") as f:
        f.write("zip\n")
    plain = S.read_plain(spark, str(tmp_path / "plain.txt"))
    assert sorted((r.word, r.freq, r.tags) for r in plain.collect()) == [("one", 1.0, []), ("one", 1.0, []), ("two", 1.0, [])]
    assert [r.word for r in S.read_plain(spark, str(tmp_path / "more.txt.gz")).collect()] == ["zip"]
    S.write_wordfreq(W.wordfreq(plain.withColumn("tags", F.array(F.lit("R"), F.lit("Y")))), str(tmp_path / "freq"))
    back = S.read_wordfreq(spark, str(tmp_path / "freq"))
    assert [(r.word, r.freq, r.tags) for r in back.collect()] == [("one", 2.0, ["R", "Y"]), ("two", 1.0, ["R", "Y"])]
    (tmp_path / "counts.txt").write_text("word\t12\nother\t0x1.8p+1\tA,B\n")
    assert sorted((r.word, r.freq, r.tags) for r in S.read_wordfreq(spark, str(tmp_path / "counts.txt")).collect()) == [("other", 3.0, ["A", "B"]), ("word", 12.0, [])]


def test_test_strings_have_three_columns(spark, tmp_path):
    (tmp_path / "good.txt").write_text("no_user\tpolicy\tpass word\n")
    assert [tuple(r) for r in S.read_tests(spark, str(tmp_path / "good.txt")).collect()] == [("no_user", "policy", "pass word")]
    (tmp_path / "bad.txt").write_text("no_user\tpolicy\ta\tb\n")
    with pytest.raises(Exception, match="not three columns"):
        S.read_tests(spark, str(tmp_path / "bad.txt")).collect()


def test_smallest_cutoffs_and_checks_of_results(spark):
    files = spark.createDataFrame([("own-1e-12",), ("own-1e-14",), ("other-1e-9",)], "name string")
    assert sorted((r.base, r.name) for r in S.smallest_cutoffs(files).collect()) == [("other", "other-1e-9"), ("own", "own-1e-14")]
    rows = spark.createDataFrame([("a", 5), ("a", -4), ("b", 2), ("b", -2)], "condition string, guess long")
    cutoffs = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "condition string, cutoff double")
    assert A.checked(rows, cutoffs) is rows
    with pytest.raises(ValueError, match="columns missing"):
        A.checked(rows.drop("guess"), cutoffs)
    with pytest.raises(ValueError, match="null"):
        A.checked(rows.unionByName(spark.createDataFrame([(None, 1)], rows.schema)), cutoffs)
    with pytest.raises(ValueError, match="no cutoff"):
        A.checked(rows, cutoffs.limit(1))
    guessed, rest = A.ordered_output(rows.withColumn("prob", F.lit(0.5)))
    assert [(r.condition, r.guess) for r in guessed.collect()] == [("a", 5), ("b", 2)] and [(r.condition, r.guess) for r in rest.collect()] == [("a", -4), ("b", -2)]
    assert [d.count() for d in A.split_guessed(rows)] == [2, 2]


def test_tokens_by_length_are_written_in_order(spark, tmp_path):
    words = spark.createDataFrame([("ab1", 2.0, []), ("cd1", 1.0, []), ("é2", 1.0, [])], CORPUS)
    S.write_by_length(W.split_by_length(W.tokenize(words)), str(tmp_path / "len"))
    lines = lambda n: [r.value for r in spark.read.text(str(tmp_path / "len" / f"len={n}")).collect()]
    assert lines(2) == ["ab\t1p1", "cd\t1p0", "é\t1p0"] and lines(1) == ["1\t1.8p1", "2\t1p0"]


def test_levels_filters_and_weights(spark):
    assert G.levels([0.5, 0.3, 0.2], 7) == [5, 3, 2] and sum(G.levels([0.97, 0.02, 0.01], 500)) == 503
    rows = spark.createDataFrame([("keep", 1.0, []), ("drop", 1.0, [])], CORPUS)
    sources = [C.Source("a", "f", id="A", filter="own", weight="3"), C.Source("b", "f", id="B", weight="2x")]
    got = {r.word: (r.freq, r.tags) for r in C.build_corpus(sources, lambda _: rows, {"own": lambda df: df.filter("word = 'keep'")}).collect()}
    assert got == {"keep": (3.0 + 3.0, ["A", "B"]), "drop": (3.0, ["B"])}
    with pytest.raises(KeyError):
        C.build_corpus(sources, lambda _: rows)
    assert C.Condition("x").cutoffs() == ["1e-12"] and C.Condition("x", cutoffmin=3, cutoffmax=5).cutoffs() == ["1e-3", "1e-4", "1e-5"]
