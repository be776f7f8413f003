import hashlib
import random
from collections import Counter

from saltmarsh.llm import suffix_dedup

COLUMNS = "doc_id long, text string, lang string, row_key string, chunk int"


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(hash(b[i : i + 400]) for _, b in texts for i in range(len(b) - 399))
    out = []
    for doc_id, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[hash(b[i : i + 400])] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    out = suffix_dedup.repeated_strings(spark.createDataFrame(rows, COLUMNS))
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()), key=str)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_planted_repeats_and_odd_texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    passage = prose(rng, 120, words)
    short = passage.encode()[:399].decode(errors="ignore")
    rows = [(1, None), (2, ""), (3, "x"), (4, "a" * 1500), (5, " " * 399), (6, "ab" * 600), (7, passage), (8, passage), (8, passage)]
    for i in range(9, 24):
        rows.append((i, prose(rng, 200, words)))
    for i in range(24, 40):
        cut = rng.randrange(0, 300)
        rows.append((i, prose(rng, rng.randint(0, 80), words) + passage[cut : cut + rng.choice([380, 399, 400, 401, 430, 600])] + prose(rng, rng.randint(0, 80), words)))
    rows.append((40, short + "!"))
    rows.append((41, "?" + short))
    base = prose(rng, 400, words)
    for i in range(42, 50):  # near copies
        at = rng.randrange(len(base))
        rows.append((i, base[:at] + "#" + base[at + 1 :]))
    rows.append((None, base))
    rows.append((50, base + base))
    rows = [(i, t, "en", "clash", 7) for i, t in rows]
    assert found(spark, rows) == brute(rows)


def test_long_text_is_cut_into_pieces(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    passage = prose(rng, 150, words)
    long = prose(rng, 380_000, words)[: suffix_dedup.PIECE - 300]
    text = long + passage + prose(rng, 900, words) + passage  # the first lies over the edge of two pieces
    rows = [(1, text, None, None, None), (2, prose(rng, 500, words) + text[3000:5000], None, None, None)]
    assert found(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_passages_under_the_limit_are_reported_not_removed(spark):
    rng = random.Random(8)
    words = {x: ["".join(rng.choice(x) for _ in range(rng.randint(2, 9))) for _ in range(4000)] for x in ("abcdefghijklmno", "éèàçabcdefg", "äöüßabcdefgh", "ñáíóúabcdef")}
    rows, planted = [], set()
    for k, own in enumerate(words.values()):
        for p in range(12):
            passage = prose(rng, rng.randint(52, 90), own)
            for j in range(3):
                i = 1000 * k + 10 * p + j
                planted.add(i)
                rows.append((i, f"{prose(rng, 150, own)} {passage} {prose(rng, 150, own)}", None, None, None))
        rows += [(1000 * k + 500 + j, prose(rng, 350, own), None, None, None) for j in range(40)]
    out = suffix_dedup.repeated_strings(spark.createDataFrame(rows, COLUMNS)).collect()
    assert found(spark, rows) == brute(rows)
    got = {r.doc_id for r in out if r.n_passage > 0}
    assert got <= planted and len(got) >= 0.9 * len(planted)
