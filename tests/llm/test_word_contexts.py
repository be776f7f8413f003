"""Scores of the language model depend on the words before."""

import numpy as np

from saltmarsh.llm import pitman_yor

SCHEMA = "doc_id long, text string, held_out boolean"


def test_word_order_counts(spark):
    train = [(i, f"the old grey {('cat', 'dog')[i % 2]} sat down", False) for i in range(40)]
    docs = spark.createDataFrame([*train, (100, "the old grey cat sat down", True), (101, "down cat grey sat the old", True), (102, "the old grey zebra sat down", True), (103, None, True)], SCHEMA)
    got = {r.doc_id: r for r in pitman_yor.score_texts(docs).collect()}
    assert len(got) == 44
    assert got[100].score > got[101].score + 3 and abs(got[100].base_score - got[101].base_score) < 1e-9
    assert got[102].spelled_score < got[102].score < got[100].score
    assert abs(got[100].score - got[0].score) < 1e-6 and got[100].spelled_score == got[100].score


def test_without_training_words_are_spelled(spark):
    docs = spark.createDataFrame([(1, "a b", True), (2, "", True)], SCHEMA)
    got = {r.doc_id: r for r in pitman_yor.score_texts(docs).collect()}
    assert got[1].train_tokens == 0 and np.isfinite([got[1].score, got[1].spelled_score, got[2].score]).all()


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(3)
    v, w = rng.integers(0, 3, (2, 500))
    every = np.stack(np.meshgrid(np.arange(3), np.arange(5))).reshape(2, -1)
    hashes = np.array([7, 11, 13, 17, 19], np.uint64)
    pairs = [(v, w), tuple(every)]
    x = pitman_yor.Contexts.of([hashes, hashes], pairs, [np.ones(500, int), np.zeros(15, int)])
    x = pitman_yor.Contexts.unpack(x.pack())
    for _ in range(3):
        p = x.sweep(np.array([0.1, 0.2, 0.3, 0.25, 0.15]), 0.4, rng)
    assert np.allclose(np.bincount(x.room, weights=p), 1)
    assert (x.t <= x.k).all() and (x.t[x.k > 0] > 0).all() and (x.t[x.k == 0] == 0).all() and x.up().sum() == x.t.sum()
    assert (x.k[x.places(hashes, v, w)] > 0).all() and x.k.sum() == 500


def test_tables_follow_the_exact_posterior():
    """The chain's table counts of two dishes in one restaurant against all seatings, enumerated."""
    d, a, counts, base = 0.4, 1.0, np.array([4, 3]), np.array([0.3, 0.2])

    def ways(c):
        """Weights of t tables for c customers, from the seatings one by one."""
        out = {(1,): 1.0}
        for _ in range(c - 1):
            new = {}
            for seats, p in out.items():
                new[(*seats, 1)] = new.get((*seats, 1), 0) + p
                for i, n in enumerate(seats):
                    more = (*seats[:i], n + 1, *seats[i + 1 :])
                    new[more] = new.get(more, 0) + p * (n - d)
            out = new
        total = np.zeros(c + 1)
        for seats, p in out.items():
            total[len(seats)] += p
        return total

    exact = np.zeros((5, 4))
    for i in range(1, 5):
        for j in range(1, 4):
            exact[i, j] = ways(4)[i] * ways(3)[j] * base[0] ** i * base[1] ** j * np.prod([a + d * m for m in range(i + j)])
    exact /= exact.sum()
    rng, t, seen = np.random.default_rng(5), np.array([1, 1]), np.zeros((5, 4))
    for _ in range(30_000):
        mass = np.full(2, pitman_yor.draw_mass(t.sum(), d, a, rng))
        t = pitman_yor.draw_tables(counts, np.log(base), mass, t.sum() - t, d, a, rng)
        seen[t[0], t[1]] += 1
    assert np.abs(seen / seen.sum() - exact).max() < 0.02


def test_chunks_send_their_pairs_once(spark, monkeypatch):
    sent, parts = [], pitman_yor._pair_parts
    monkeypatch.setattr(pitman_yor, "_pair_parts", lambda *a: sent.append(a) or parts(*a))
    docs = spark.createDataFrame([(i, f"a b c{i} a", i % 3 == 0) for i in range(9)] + [(9, None, False)], SCHEMA)
    got = pitman_yor.score_texts(docs).collect()
    assert len(got) == 10 and len(sent) == 1 and all(r.score < 0 for r in got)


def test_pairs_stand_in_one_order_in_chunks_and_contexts():
    rng, chunks = np.random.default_rng(8), []
    for n in (40, 60):
        hashes = np.append(np.sort(rng.choice(2**62, n, replace=False).astype(np.uint64)), [pitman_yor.END, pitman_yor.BEGIN])
        sizes = rng.integers(0, 9, 50)
        pairs = np.unique(pitman_yor._pairs_of(rng.integers(0, n, sizes.sum()).astype(np.uint32), sizes, n))
        pairs = pairs[pairs // (n + 2) <= n]  # the begin is a part of its own
        chunks.append((hashes, (pairs // (n + 2), pairs % (n + 2)), rng.integers(0, 9, len(pairs))))
    x = pitman_yor.Contexts.of(*map(list, zip(*chunks)))
    for at, (hashes, pairs, k) in zip(x.parts, chunks):
        assert (np.diff(at) > 0).all() and (at == x.places(hashes, *pairs)).all() and (x.k[at] >= k).all()
    x.sweep(np.full(len(x.hashes), 0.01), 0.4, rng)
    x.sum = rng.random(len(x.code)).astype(np.float32)
    y = pitman_yor.Contexts.unpack(x.pack(), x.pack_seats())
    assert (y.t == x.t).all() and (y.k == x.k).all() and np.abs(y.sum / x.sum - 1).max() < 1e-4
