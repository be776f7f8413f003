"""Fingerprints: edits and order against plain Python, estimates against true similarities, near copies against all pairs."""

import hashlib
import re

import numpy as np

from saltmarsh.llm import fingerprints

SCHEMA = "doc_id long, text string, fingerprint string, tie int"
WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def padded(text):
    w = [b"\0"] * 4 + WORDS.findall(text.encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    read = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    copy = read[7][1]
    rows = read + [(9001, None), (9002, ""), (9003, "\n "), (9004, "one"), (9005, "one two three"), (9006, "word " * 30000), (9007, copy), (9008, copy + " and more"), (9010, "ONE TWO Three"), (None, "no id 日本")]
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0]))
    texts = [t or "" for _, t in order]
    errors, known = [], {}
    for k, (doc_id, _) in enumerate(order):
        t, following = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        new = t[: len(t) - half] + following[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        errors += [r.near_edited - jaccard(padded(t), padded(new)), r.near_next - jaccard(padded(t), padded(following))]
        assert known.setdefault(t, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 512
    errors = np.array(errors)
    assert abs(errors).max() < 0.2 and abs(errors.mean()) < 0.02 and errors.std() < 0.05
    assert got[9005].fingerprint == got[9010].fingerprint != got[9004].fingerprint

    sets, comp = [padded(t) for t in texts], list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(order):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    assert {d: r.class_id for d, r in got.items()} == {d: least.get(root(i)) for i, (d, _) in enumerate(order)}


def test_buckets_in_several_components(spark):
    """A centre that is like neither of two groups doesn't keep them apart; chains of copies are one class."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:k] + [f"x{i}"] + words[k + 1 :])) for i, k in enumerate(range(0, 400, 10))]
    rows += [(100 + i, " ".join(words[: 200 + i] + [f"y{j}" for j in range(150)])) for i in range(20)]
    sets = {d: padded(t) for d, t in rows}
    comp = {d: d for d, _ in rows}
    for _ in rows:
        for a in sets:
            for b in sets:
                if jaccard(sets[a], sets[b]) >= 0.75:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == comp


def test_few_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert fingerprints.fingerprint_documents(docs).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(5, "a b c d e f", "", 1)], SCHEMA)).first()
    assert (one.near_next, one.class_id, one.edited_sha256) == (1.0, 5, hashlib.sha256(b"a b c a b c"[:6] + b"a b c").hexdigest())
    nulls = fingerprints.fingerprint_documents(spark.createDataFrame([(None, None, None, None)] * 3, SCHEMA)).collect()
    assert [(r.doc_id, r.n_chars, r.near_edited, r.near_next, r.class_id) for r in nulls] == [(None, 0, 1.0, 1.0, None)] * 3
