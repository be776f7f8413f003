"""What operator 8 keeps, against its rules in plain Python; copies of a labelled row are one trial."""

import math

from saltmarsh.llm import quality

SCHEMA = "doc_id long, text string, n_words string"


def rows_of():
    rows = []
    for i in range(900):
        words = [f"w{i}x{k}" for k in range(60 + i % 30)]
        if i % 7 == 0:
            words[: len(words) // 2] = ["#$%&"] * (len(words) // 2)
        rows.append((i, " ".join(words), "clash"))
    return rows


def test_kept_follows_from_certified_cutoffs(spark):
    rows = rows_of()
    labels = [(i, int(i % 7 != 0 or i % 21 == 0)) for i in range(0, 900, 2)] + [(1, None)]
    out = quality.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r.doc_id: r for r in out.collect()}
    good = [got[i] for i, q in labels if q == 1 and not got[i].base_failed]
    ratio = {"symbols": lambda r: r.n_symbols / r.word_chars, "dup_lines": lambda r: r.n_dup_lines / r.n_lines, "repeats": lambda r: r.n_repeat_words / r.n_words, "long_words": lambda r: r.word_chars / r.n_words}
    level, chosen = quality.DELTA / (len(quality.RULES) * (len(quality.STRATA) + 1)), {}
    for rule, (_, grid) in quality.RULES.items():
        for stratum in {r.stratum for r in good}:
            own = [ratio[rule](r) for r in good if r.stratum == stratum]
            for c in grid:
                bad = sum(x > c for x in own)
                p = sum(math.comb(len(own), j) * quality.ALPHA**j * (1 - quality.ALPHA) ** (len(own) - j) for j in range(bad + 1))
                if p > level:
                    break
                chosen[stratum, rule] = c
    for r in got.values():
        failed = sorted(rule for rule in quality.RULES if r.n_words and (r.stratum, rule) in chosen and ratio[rule](r) > chosen[r.stratum, rule])
        assert sorted(r.failed_rules) == failed and r.kept == (not r.base_failed and not failed)


def test_copies_of_a_labelled_row_are_one_trial(spark):
    rows, labels = rows_of()[:40], [(i, 1) for i in range(40)]
    once = quality.with_base(quality.measured(spark.createDataFrame(rows, SCHEMA)))
    frame = spark.createDataFrame(rows * 30, SCHEMA)
    out = quality.judge(frame, spark.createDataFrame(labels * 3, "doc_id long, quality int"))
    # forty trials certify nothing, however often they are repeated
    assert out.filter("size(failed_rules) > 0").count() == 0 and out.count() == 1200 and once.count() == 40


def test_odd_labels(spark):
    nulls = spark.createDataFrame([(None, None, None)] * 3, SCHEMA)
    tied = spark.createDataFrame([(i, q) for i in range(5) for q in (0, 1)] + [(None, None)], "doc_id long, quality int")
    assert [(r.n_words, r.base_failed, r.kept) for r in quality.judge(nulls, tied).collect()] == [(0, True, False)] * 3
    assert quality.judge(nulls.limit(0), tied).count() == 0 and quality.judge(nulls, tied.limit(0)).count() == 3
