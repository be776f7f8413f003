"""Alignments against a plain merge of the whole encodings, document by document."""

import hashlib
import random
from collections import Counter, defaultdict

from saltmarsh.llm import alignment
from saltmarsh.llm.tokens import vocabulary_path

A, B = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a int, chunk string"


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    stand_in = {}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in plain:
        stand_in[chr(b)] = b
    for i, b in enumerate(x for x in range(256) if x not in plain):
        stand_in[chr(256 + i)] = b
    found, having = [], Counter()
    for doc_id, text in rows:
        a, b, links, groups = [], [], [], []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            a_bytes = [bytes(stand_in[c] for c in a_model.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                a, b = [], []
            i = j = end_a = end_b = start_i = start_j = 0
            while i < len(a):
                links.append((a[i], b[j]))
                next_a, next_b = end_a + len(a_bytes[i]), end_b + len(b_bytes[j])
                if next_a <= next_b:
                    i, end_a = i + 1, next_a
                if next_b <= next_a:
                    j, end_b = j + 1, next_b
                if next_a == next_b:
                    groups.append(",".join(map(str, a[start_i:i])) + "|" + ",".join(map(str, b[start_j:j])))
                    start_i, start_j = i, j
        found.append((doc_id, a, b, groups, links))
        having.update(set(links))
    best = defaultdict(int)
    for (x, _), n in having.items():
        best[x] = max(best[x], n)
    return sorted(
        ((d, len(a), len(b), len(g), len(k), sum(having[x] == best[x[0]] for x in k), sum(having[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, a, b, g, k in found),
        key=str,
    )


def ours(docs):
    out = alignment.align(docs, A, B).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r) for r in out.collect()), key=str)


def odd_texts():
    rng = random.Random(5)
    parts = ["a", "The ", " ", "  ", "\n", "\t", "\r\n", "'s", "é", "ß", "日本", "🙂", " ", " ", "\x1c", "▁", "<s>", "<0x41>", "<|endoftext|>", "ﬁ", "é", "1234", "!?", "word", "ing", "\u0000", "﻿", "　", "Straße", "don't"]
    return ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(400)]


def test_alignment(spark, monkeypatch):
    read = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = read + [(9001, None), (9002, ""), (9003, " "), (9004, "  "), (None, "nobody knows this id"), (9005, "x" * 30000), read[0], (read[0][0], "same id"), (9006, read[0][1])]
    docs = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], SCHEMA)
    assert ours(docs) == brute(rows)
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    assert ours(spark.createDataFrame([(None, None, None, None)] * 2, SCHEMA)) == [(None, 0, 0, 0, 0, 0, 0, "")] * 2


def test_odd_texts_as_the_libraries_encode_them(spark):
    rows = list(enumerate(odd_texts()))
    assert ours(spark.createDataFrame([(d, t, 1, "") for d, t in rows], SCHEMA)) == brute(rows)
    # segments are forgotten between texts, and chunks are of one document each
    known = alignment.Segments(A, B)
    facts = known.described([t for _, t in rows])
    for k in range(0, 400, 7):
        known.clear()
        one = known.described([rows[k][1]])
        assert (one[0][0] == facts[0][k]).all() and one[1][0] == facts[1][k]
