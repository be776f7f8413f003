"""Results of the numbered queries' base columns against plain Python, on a small table with odd rows."""

import math
import re
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import common, decontam, language, ngram_join, packing, pii, pitman_yor, quality, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, chunk int"
SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def rows(spark):
    read = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    read += [(9001, None, None), (9002, "", "en"), (9003, "  \n\t ", "en"), (9004, "one two three", "en"), (9005, "word " * 20000, None), (None, "nobody knows this id at all", "en")]
    return read + [read[0], read[0], (9006, read[0][1], "xx")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "clash", 2) for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORDS.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))


def test_near_duplicates(rows, docs, empty):
    sets = []
    for _, text, _ in rows:
        w = words(text)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    want = sorted(((d, len(sets[i]), least.get(root(i), d)) for i, (d, *_) in enumerate(rows)), key=str)
    got = ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    assert ngram_join.near_duplicates(empty).count() == 0


def test_token_counts_and_packing(rows, docs, empty):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    library = Tokenizer.from_file(path)
    ids = {(d, t): library.encode(t or "", add_special_tokens=False).ids for d, t, _ in rows}
    got = sorted(((r.doc_id, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, path, 1024).collect()), key=str)
    assert got == sorted(((d, len(ids[d, t]), len(ids[d, t]) > 1024) for d, t, _ in rows), key=str)

    pieces = packing.pack_documents(docs, path, with_ids=True, per_partition=40).collect()
    placed: dict[int, list] = {}
    for p in pieces:
        placed.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    for spans in placed.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    want = Counter()
    for d, t, _ in rows:
        want[d, struct.pack(f"<{len(ids[d, t]) + 1}I", *ids[d, t], 2)] += 1
    of_doc: dict = {}
    for p in pieces:
        of_doc.setdefault(p.doc_id, []).append(p)
    for d, parts in of_doc.items():
        assert sum(p.length for p in parts) == sum(n * len(b) // 4 for (x, b), n in want.items() if x == d)
    total = sum(p.length for p in pieces)
    assert len(placed) <= math.ceil(total / 1024) * 1.1 + 2
    assert packing.pack_documents(empty, path).count() == 0


def test_lower_bound_is_no_more_than_any_packing():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 200):
        sizes = rng.integers(1, 1025, n)
        bins, offsets, count = packing.best_fit_decreasing(sizes, 1024)
        assert packing.lower_bound(sizes, 1024) <= count


def test_base_of_language_model(rows, docs, empty):
    held = [zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2 for d, *_ in rows]
    counts = Counter()
    for (_, t, _), h in zip(rows, held):
        if not h:
            counts.update([*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    want = []
    for (d, t, _), h in zip(rows, held):
        w = [*words(t), b""]
        want.append((str(d), h, len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    held_out = (common.remainder("doc_id", 7) == 2).alias("held_out")
    got = pitman_yor.score_texts(docs.select("doc_id", "text", held_out)).collect()
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] < 0
    unseen = [g for g in got if g[1]]
    assert unseen and sum(g[6] for g in unseen) > sum(g[5] for g in unseen)  # better than add-one where it didn't learn
    assert pitman_yor.score_texts(empty.select("doc_id", "text", held_out)).count() == 0


def test_quality_measures(spark, rows, docs, empty):
    def base(t):
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.judge(docs, labels).collect()
    want = sorted((str(d), *base(t)) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality.judge(empty, labels).count() == 0


def test_binomial_bound_is_exact(spark):
    n, k, alpha = 900, 3, quality.ALPHA
    exact = sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))
    good = spark.range(n).select(F.lit(0).alias("stratum"), F.lit(100).alias("n_words"), F.lit(100).alias("word_chars"), F.lit(0).alias("n_dup_lines"), F.lit(1).alias("n_lines"), F.lit(0).alias("n_repeat_words"), F.when(F.col("id") < k, 99).otherwise(0).alias("n_symbols"))
    best = quality.cutoffs(good, delta=1.0).filter("rule = 'symbols'").first()
    assert best.rejected == k and best.p_value == pytest.approx(exact, rel=1e-9)


def test_language_of_held_out_rows(spark, docs, empty):
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = common.remainder("doc_id", 5) == 0
    out = language.identify(all_docs, all_docs.filter(~held).select("text", "lang")).filter(held).select("lang", "lang_pred").collect()
    known = [r for r in out if r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in known) >= 0.9 * len(known)
    odd = {r.doc_id: r for r in language.identify(docs, all_docs.select("text", "lang")).collect()}
    assert odd[9001].lang_pred == odd[9002].lang_pred == odd[9003].lang_pred == "und" and odd[9001].score == 0
    assert language.identify(empty, empty.select("text", "lang")).count() == 0


def test_toxicity_of_held_out_rows(spark, docs, empty):
    all_docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = common.remainder("doc_id", 3) != 1
    tested = labels.filter(~train & F.col("toxic").isNotNull())
    got = toxicity.score_documents(all_docs.join(tested.select("doc_id"), "doc_id", "left_semi"), labels.limit(0)).count()
    assert got == tested.count()
    scored = toxicity.score_documents(all_docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.filter(train)).join(tested, "doc_id").select("score", "toxic").collect()
    right = sum((r.score >= 0.7) == bool(r.toxic) for r in scored)
    assert right >= 0.9 * len(scored)
    assert toxicity.score_documents(docs, labels).count() == docs.count()
    assert toxicity.score_documents(empty, labels.limit(0)).count() == 0


def test_contamination_with_odd_rows(spark, docs, empty):
    items = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (None, "nobody knows this id"), (3, "ONE, two; three")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, items).collect()}
    assert got[9004].n_hit == 3 and got[9004].item_ids == ["1", "3"] and got[9004].contaminated
    assert got[None].n_hit == 4 and got[None].n_items == 0
    assert got[9001].n_words == 0 and not got[9001].contaminated
    assert decontam.decontaminate(empty, items).count() == 0
    assert decontam.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0


def test_surrogates_are_distinct_and_coreferent(spark, empty):
    texts = ["Mail ada.lovelace@example.org or +1 555 123 4567.", "Again ada.lovelace@example.org here", "Other bob@example.org", None, ""]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.text for r in pii.pseudonymise(docs, pii.QUERY_KEY).collect()}
    mails = [re.search(r"\S+@\S+", got[i])[0] for i in (0, 1, 2)]
    assert mails[0] == mails[1] != mails[2] and "ada.lovelace@example.org" not in mails
    assert len(mails[0]) == len("ada.lovelace@example.org") and "4567" not in got[0]
    assert got[3] is None and got[4] == ""
    assert pii.pseudonymise(empty, pii.QUERY_KEY).count() == 0
