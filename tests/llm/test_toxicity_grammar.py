"""The transducers against sentences, their composition against the parts in turn, and odd labels."""

import random

import pytest

from saltmarsh.llm import toxicity

SCHEMA = "doc_id long, text string, score string, features int"
FOUND = {k: i for i, k in enumerate(toxicity.FEATURES)}


@pytest.fixture(scope="module")
def matcher():
    return toxicity.Matcher({"moron$": 1.0, "idiot": 1.0})


@pytest.mark.parametrize(
    "text",
    [
        "I will kill you.", "I'm going to hurt you badly", "We'll burn them all!", "He will kill you", "I am going to destroy your family", "i’ll stab him",
        "Ich werde dich töten.", "Wir werden euch umbringen!", "Ich töte dich", "Ich werde Sie erschießen", "Dich werde ich umbringen",
        "Je vais te tuer.", "Nous allons vous frapper", "je te tuerai", "On va te brûler",
        "Te voy a matar.", "Voy a matarte", "Te mataré", "Vamos a quemarte",
    ],
)
def test_threats(matcher, text):
    assert matcher.features(text)[FOUND["threat"]] > 0 and matcher.features(text)[FOUND["negated"]] == 0


@pytest.mark.parametrize(
    "text",
    [
        "You will kill me.", "He kills time.", "You should kill the process", "I like you. Kill the process", "They beat the drum", "I burn wood", "You shoot photos",
        "Sie töten die Zeit", "Du wirst mich töten", "Vous allez tuer le temps", "Tu vas me tuer", "Vas a matar el tiempo", "Ella va a quemar pan",
    ],
)
def test_no_threats(matcher, text):
    assert matcher.features(text)[FOUND["threat"]] == 0


def test_negation_and_reports_hold_within_a_clause(matcher):
    f = lambda text: dict(zip(toxicity.FEATURES, matcher.features(text)))
    assert f("I do not ever want to kill you")["negated"] > 0 and f("I do not ever want to kill you")["threat"] == 0
    assert f("You are certainly not in any way a moron")["negated"] > 0 and f("You are certainly not in any way a moron")["aimed"] == 0
    assert f("Not today, you moron")["aimed"] > 0 and f("This is no good but you moron")["aimed"] > 0
    assert f("No. You are a moron")["aimed"] > 0 and f("No. You are a moron")["negated"] == 0
    assert f("He said you are a moron")["reported"] > 0 and f("He said so. You are a moron")["reported"] == 0
    assert f("a moron and an idiot")["direct"] > f("a moron and a tree")["direct"] > 0
    assert not any(matcher.features("")) and not any(matcher.features("plain words, nothing else"))


def test_the_composition_equals_its_parts_in_turn():
    rng, whole, parts = random.Random(2), toxicity.grammar(), toxicity.parts()
    for _ in range(5000):
        symbols = rng.choices(toxicity.SYMBOLS, k=rng.randrange(1, 14))
        out, total = symbols, 0.0
        for t in parts:
            out, w = t.run(out)
            total += w
        got = whole.run(symbols)
        assert got[0] == out and abs(got[1] - total) < 1e-9


def test_scores_of_odd_tables(spark):
    nulls = spark.createDataFrame([(None, None, None, None)] * 2 + [(1, "", "clash", 1)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(nulls, labels)
    assert [r.score for r in got.collect()] == [0.0] * 3
    # all kinds of labels on equal texts: no stem is learned, and all get one score
    docs = spark.createDataFrame([(i, "same words here", "", 1) for i in range(20)] + [(99, None, "", 1)], SCHEMA)
    tied = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    scores = {r.score for r in toxicity.score_documents(docs, tied).collect()}
    assert len({round(s, 9) for s in scores}) == 1 and all(0 <= s <= 1 for s in scores)


def test_scores_follow_from_features_and_labels(spark):
    """Brute force: the stems' counts in plain Python, and the likelihood's maximum found by small steps."""
    import numpy as np

    rng = random.Random(4)
    words = [f"w{chr(97 + i)}x" for i in range(20)]
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        text = " ".join(rng.choices(words, k=12) + ["you"] * (i % 2) + ["grumblefoot"] * (bad and i % 9 > 0 or i in (1, 2)))
        rows.append((i, text, "", 1))
    labels = [(i, int(i % 3 == 0)) for i in range(300)]
    got = {r.doc_id: (r.score, list(r.features)) for r in toxicity.score_documents(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    y = np.array([t for _, t in labels], float)
    has = [sum("grumblefoot" in r[1] and t == v for r, (_, t) in zip(rows, labels)) for v in (0, 1)]
    weight = np.log((has[1] + 0.5) / (y.sum() + 1)) - np.log((has[0] + 0.5) / ((1 - y).sum() + 1))
    m = toxicity.Matcher({"gru": weight})
    x = np.array([m.features(r[1]) for r in rows])
    assert np.allclose(x, [got[i][1] for i in range(300)])
    full, w = np.hstack([x, np.ones((300, 1))]), np.zeros(x.shape[1] + 1)
    penalty = np.array([0.05] * x.shape[1] + [1e-6])
    for _ in range(100_000):
        w -= 0.002 * (full.T @ (1 / (1 + np.exp(-full @ w)) - y) + penalty * w)
    assert np.allclose(1 / (1 + np.exp(-full @ w)), [got[i][0] for i in range(300)], atol=0.01)
