import re

import corpus_pipeline
from saltmarsh.llm import common


def test_stages_keep_columns_and_do_their_work(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    some = docs.filter("length(text) > 800").orderBy("doc_id").limit(30)
    clean = some.first()
    rows = [(*r, "clash", "clash", "clash", 0.5) for r in some.collect()]
    rows += [(70001, clean.text, clean.lang, "s", 1, "x", "y", "z", 0.1), (70002, f"{clean.text[:200]} {item}", "en", "s", 1, "x", "y", "z", 0.1)]
    rows += [(70003, None, None, None, None, None, None, None, None), (70004, "", "en", "s", 0, "x", "y", "z", 0.1), (70005, "1234 5678", "en", "s", 9, "x", "y", "z", 0.1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_key string, spans string, lang_pred string, score double"
    table = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = table
        table = common.stash(stage(spark, table, sf), name)
        assert table.columns == before.columns
        if name == "language_id":
            ids = {r.doc_id for r in table.collect()}
            assert not ids & {70003, 70004, 70005} and clean.doc_id in ids
        if name == "ngram_jaccard_join":
            ids = {r.doc_id for r in table.collect()}
            assert 70001 not in ids
        if name == "benchmark_decontamination":
            assert 70002 not in {r.doc_id for r in table.collect()}
        if name == "pii":
            assert all(r.n_chars == len(r.text) for r in table.collect())
            mails = lambda df: {m for r in df.collect() for m in re.findall(r"[\w.+-]+@\w+(?:\.\w+)+", r.text)}
            assert not mails(before) & mails(table)
    packed = corpus_pipeline.STAGES[-1][1](spark, table, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in table.collect()}


def test_stages_take_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        table = stage(spark, table, sf)
        assert table.count() == 0, name
