"""Counts at every prefix, against the library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import tokens

PARTS = ["don't ", "<|endoftext|>", "'", " hello", " world", "\t\t", " x", "<|endo", "|>", "  ", "\n", "é", "漢字", "1234", "!!!", "'re", "we'll ", "🙂", "a" * 9]
ODD = "don't <|endoftext|> ' hello world\t\t x<|endo"


@pytest.fixture(scope="module")
def made():
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    library, rng = Tokenizer.from_file(path), random.Random(4)
    texts = ["", ODD, *("".join(rng.choice(PARTS) for _ in range(rng.randint(1, 9))) for _ in range(150))]
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    return path, {t: [count(t[:i]) for i in range(len(t) + 1)] for t in texts}


def test_every_prefix_by_either_way(made):
    path, want = made
    c = tokens.counter(path)
    for text, counts in want.items():
        assert c.table(text).tolist() == counts == c.stored(text).tolist(), text
        assert tokens.unpack_counts(tokens.pack_counts(c.stored(text))).tolist() == counts


def test_every_prefix_of_usual_texts():
    from tokenizers import Tokenizer

    path, rng = tokens.vocabulary_path(), random.Random(9)
    library, c = Tokenizer.from_file(path), tokens.counter(path)
    parts = ["don't", "'ll", "'", "l", " the", " ", "  ", "\n", "\t ", "Straße", " élan", "x1y22", "...", "?! ", "we're", " 'tis", "12345", "(", ")", "\r\n", "ing"]
    for _ in range(120):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 12)))
        assert tokens.LATIN(text)
        assert c.stored(text).tolist() == [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], text


def test_the_query_answers_from_stored_counts(spark, made):
    path, want = made
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*want, None])], "doc_id long, text string, prefix_counts string")
    out = tokens.token_counts(docs, path, 4)
    rows = out.select("*", tokens.stored_tokens_within("prefix_counts", F.lit(5)).alias("first"), tokens.stored_chars_within("prefix_counts", 3).alias("chars")).collect()
    texts = [*want, ""]
    for r in rows:
        counts = np.array(want[texts[r.doc_id]])
        assert (r.n_tokens, r.over_limit, r.keep_chars) == (counts[-1], counts[-1] > 4, np.flatnonzero(counts <= 4)[-1])
        assert (r.first, r.chars, r.n_bytes) == (counts[min(5, len(counts) - 1)], np.flatnonzero(counts <= 3)[-1], len(texts[r.doc_id].encode()))


def test_stored_tables_answer_questions(spark, made):
    path, want = made
    docs = spark.createDataFrame([(t,) for t in want] + [(None,)], "text string")
    out = tokens.prefix_tables(docs, path).select("text", tokens.tokens_within("prefix_tokens", F.lit(5)).alias("first"), tokens.chars_within("prefix_tokens", 3).alias("chars"))
    for r in out.collect():
        counts = want[r.text or ""]
        assert r.first == counts[min(5, len(counts) - 1)] and r.chars == int(np.flatnonzero(np.array(counts) <= 3)[-1])


def test_pieces_that_begin_alike_share_their_prefixes():
    class Counted(dict):
        asked = 0

        def __contains__(self, token):
            self.asked += 1
            return dict.__contains__(self, token)

    c = tokens.PrefixCounter(tokens.vocabulary_path())
    text = " heineable heineables heineabled heineabling éauxauxment éauxauxments 'heineable we'llheine"
    want = c.table(text).tolist()
    c.ids = Counted(c.ids)
    assert c.stored(" heineables").tolist() == c.table(" heineables").tolist()
    c.differences.clear()
    c.ids.asked = 0
    c.stored(" heineable")
    once, c.ids.asked = c.ids.asked, 0
    c.differences.clear()
    c.stored(" heineable heineables heineabled")
    assert c.ids.asked < 2 * once
    c.differences.clear()
    assert [x.tolist() for x in c.all_stored(["", text, " heineable", text])] == [[0], want, c.table(" heineable").tolist(), want]
