"""A condition from its settings to results and files, and files in the shapes that other tools write."""

from collections import Counter

import pytest

from saltmarsh.operators import analysis as A
from saltmarsh.operators import config as C
from saltmarsh.plans import experiment
from saltmarsh.sources import corpora
from saltmarsh.sources import grammars as S

CORPUS = "word string, freq double, tags array<string>"


def test_a_condition_from_settings_to_files(spark, tmp_path):
    files = {
        "leak": [("pass12", 4.0, []), ("word12", 2.0, []), ("pass34", 1.0, []), ("Zoo!", 1.0, []), ("a1b2c3", 1.0, [])],
        "list": [("Blue", 1.0, []), ("word", 7.0, [])],
        "asked": [("pass12", 1.0, []), ("word34", 1.0, []), ("blue99", 1.0, []), ("???", 1.0, []), ("Zoo!", 1.0, []), ("Cat!", 1.0, [])],
    }
    read = lambda name: spark.createDataFrame(files[name], CORPUS)
    plan = C.Condition("own", structure_sources=[C.Source("s", "leak", id="L")], untokenized_sources=[C.Source("w", "list", id="W", weight="0.5")], test_sources=[C.Source("t", "asked")], totalquantlevels=0, cutoffmin=2, cutoffmax=6)
    out = experiment.run(spark, plan, read, path=str(tmp_path))
    assert list(out) == ["1e-2", "1e-3", "1e-4", "1e-5", "1e-6"]
    deep, shallow = ({r.brokenpassword: r for r in out[c].collect()} for c in ("1e-6", "1e-2"))
    # word counts its half weight from the list, too, so word12 comes first
    assert deep["pass12"].guess_number == 2 and deep["pass12"].source_ids == "L"
    assert deep["word34"].guess_number > deep["pass12"].guess_number and deep["word34"].source_ids == "LW"
    assert [int(deep[w].guess_number) for w in ("blue99", "???", "Cat!")] == [-40, -4, -40]
    assert int(shallow["Zoo!"].guess_number) in (-2, *range(1, 99)) and sum(r.guess_number == -2 for r in shallow.values()) >= sum(r.guess_number == -2 for r in deep.values())
    pair = {r.brokenpassword: r for r in S.read_result_pair(spark, f"{tmp_path}/lookupresults.own-1e-6", f"{tmp_path}/totalcounts.own-1e-6").collect()}
    assert {p: (r.guess_number, r.probability) for p, r in pair.items()} == {p: (r.guess_number, r.probability) for p, r in deep.items()}
    table, total = S.read_table(spark, f"{tmp_path}/lookuptable.own-1e-6")
    assert total.first().total == pair["???"].total and S.check_order(table).count() == 0
    assert S.read_structures(spark, f"{tmp_path}/structures").count() == 3
    unseen = experiment.run(spark, C.Condition("u", structure_sources=plan.structure_sources, test_sources=plan.test_sources, generate_unseen_terminals=True, cutoffmin=12, cutoffmax=12), read)["1e-12"]
    codes = {r.brokenpassword: int(r.guess_number) for r in unseen.collect()}
    assert codes["blue99"] > 0 and codes["Cat!"] > 0 and codes["???"] == -4 and -40 not in codes.values()


#: Lines of results: user, source, string, probability, pattern, number or status, ids.
RESULTS = """no_user\tOne\tsun\x01set\t0x1.8p-20\ttea\x01pot\t120\tAB
no_user\tOne\tqx0!8zz\t-0x1p+0\t\t-40\t
no_user\tOne\trivers\t0x1.4p-19\tgarden\t31\tA
no_user\tTwo\tmoon77\t0x1.037d8fce8e9e6p-48\t\t-2\tAB
no_user\tTwo\t!?!?!?x1\t-0x1p+0\t\t-4\t
no_user\tTwo\twillow\t0x1.2p-21\tpepper\t990\tB
"""


def test_results_in_the_shape_of_other_tools(spark, tmp_path):
    (tmp_path / "lookupresults.x-1e-12").write_text(RESULTS)
    (tmp_path / "totalcounts.x-1e-12").write_text("(standard input):Total count\t8590967875\n")
    rows = S.read_result_pair(spark, str(tmp_path / "lookupresults.x-1e-12"), str(tmp_path / "totalcounts.x-1e-12")).collect()
    labels = Counter(r.s for r in corpora.read_results(spark, str(tmp_path / "lookupresults.x-1e-12")).select(A.status_label("guess_number").alias("s")).collect())
    assert labels == {"Guessed": 3, "Chunk not found": 1, "Beyond cutoff": 1, "Structure not found": 1}
    assert {int(r.total) for r in rows} == {8590967875}
    ranked = sorted((r.guess_number, r.probability) for r in rows if r.guess_number > 0)
    assert [p for _, p in ranked] == sorted((p for _, p in ranked), reverse=True)
    assert all((r.probability == -1.0) == (r.guess_number in (-4, -40)) for r in rows)
    assert all(bool(r.pattern) == (r.guess_number > 0) and (r.guess_number != -2 or r.probability > 0) for r in rows)


def test_terminals_of_one_file_for_each_key(spark, tmp_path):
    folder = tmp_path / "terminalRules"
    folder.mkdir()
    (folder / "DDD.txt").write_text("973\t0x1p-1\tR\n011\t0x1p-1\tR,Y\n")
    (folder / "LL.txt").write_text("ab\t0x1p-3\tR\n\n<UNSEEN>\t0x1.cp-1\tLL\n")
    seen, unseen = S.read_terminals(spark, str(folder))
    assert sorted((r.term_key, r.terminal, r.prob, tuple(r.tags)) for r in seen.collect()) == [("DDD", "011", 0.5, ("R", "Y")), ("DDD", "973", 0.5, ("R",)), ("LL", "ab", 0.125, ("R",))]
    assert [(r.term_key, r.unseen_mass) for r in unseen.collect()] == [("LL", 0.875)]
    # what is written is read by the same reader
    S.write_terminals(seen, str(tmp_path / "again"), unseen)
    again, masses = S.read_terminals(spark, str(tmp_path / "again"))
    assert sorted(map(str, again.collect())) == sorted(map(str, seen.collect())) and masses.count() == 1
    (folder / "notes.md").write_text("ab\t0x1p-3\tR\n")
    with pytest.raises(Exception, match="no terminal key"):
        S.read_terminals(spark, str(folder))[0].collect()
