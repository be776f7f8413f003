"""Language ID (operator 7): each document is a mixture of languages, fitted by expectation-maximisation.

Every language has a model of byte trigrams inside words. A word's likelihood under a language is the product
of its trigrams'; a document's language proportions are fitted to its words, for the one, two and three
languages with the largest proportions; the set with the best likelihood less half a log of the words for
each language is chosen. The prediction is the largest proportion in that set, which is also the score.

Defined results: null texts and texts without a letter are `und` with score 0; with no labelled row all are
`und`; a null lang is not learned; texts of any length are read whole; of equal shares the first language by name is
predicted; repeated rows give repeated rows; other columns are kept (but for has_letter, lang_pred, score and lang_set, which
are replaced); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm import common

#: Trigrams are hashed into so many cells; a model is as large, whatever it learns from.
CELLS = 1 << 16
#: Labelled rows that models are fitted to, about; more rows are thinned by hash.
FIT_ROWS = 40_000
#: Largest language set and steps for each.
LARGEST_SET, STEPS = 3, 6
#: Text handled at once, in bytes; longer texts are read in such blocks.
BLOCK = 1 << 20
LETTER = common.ALNUM.copy()
LETTER[0x30:0x3A] = False
SPACE = np.where(LETTER, np.arange(256), 0x20).astype(np.uint8)


def _blocks(buf: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a text that end where a word ends, if one ends at all."""
    start = 0
    while start < len(buf):
        stop = min(len(buf), start + BLOCK)
        if stop < len(buf):
            ends = np.flatnonzero(buf[start:stop] == 0x20)
            stop = start + int(ends[-1]) + 1 if len(ends) else stop
        yield buf[start:stop]
        start = stop


def _trigrams(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells of the trigrams of each word with a space around it, and where each word's begin."""
    for part in _blocks(SPACE[np.frombuffer(text.lower(), np.uint8)]):
        b = np.concatenate([[0x20], part, [0x20]]).astype(np.uint64)
        letter = b[1:-1] != 0x20  # a trigram is its middle letter with both neighbours
        code = (b[:-2] << np.uint64(16)) | (b[1:-1] << np.uint64(8)) | b[2:]
        at = np.flatnonzero(letter)
        first = np.ones(len(at), bool)
        first[1:] = np.diff(at) > 1
        yield (common.mix(code[at] + np.uint64(1)) & np.uint64(CELLS - 1)).astype(np.int64), np.flatnonzero(first)


def fit(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """Log-probabilities of trigram cells under each language, from rows (text, lang)."""
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(langs), CELLS), np.uint32)
        for batch in batches:
            for text, lang in zip(common.as_bytes(batch.column("text")), batch.column("lang").to_pylist()):
                for cells, _ in _trigrams(text):
                    counts[place[lang]] += np.bincount(cells, minlength=CELLS).astype(np.uint32)
        slots = common.slots(counts.reshape(-1), len(langs))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in slots], pa.int32()), pa.array([x for _, x in slots], pa.binary())], names=["slot", "blob"])

    got = common.merged(rows.select("text", "lang").mapInArrow(run, "slot int, blob binary"), CELLS * len(langs), "uint32", "sum")
    counts = got.reshape(len(langs), CELLS) + 0.5
    return np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32)


def word_likelihoods(texts: list[bytes], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the texts its log-likelihoods, and the words of each text."""
    parts, n = [], []
    for text in texts:
        k = 0
        for cells, first in _trigrams(text):
            if len(first):
                parts.append(np.add.reduceat(model[cells], first, axis=0))
                k += len(first)
        n.append(k)
    return np.concatenate(parts) if parts else np.zeros((0, model.shape[1]), np.float32), np.array(n, np.int64)


def _proportions(likelihood: np.ndarray, start: np.ndarray, doc: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of all documents at once; share: where each begins. Also the log-likelihood, without the words' maxima."""
    n = np.bincount(doc, minlength=len(share))[:, None]
    for k in range(steps + 1):
        joint = share[doc] * likelihood
        total = joint.sum(1, keepdims=True)
        if k == steps:
            break
        share = np.add.reduceat(joint / total, start, axis=0) / n
    return share, np.add.reduceat(np.log(total[:, 0]), start)


def mixtures(texts: list[bytes], model: np.ndarray) -> np.ndarray:
    """The fitted language proportions of each text; all 0 for a text without words."""
    ll, n = word_likelihoods(texts, model)
    out = np.zeros((len(texts), model.shape[1]))
    own = np.flatnonzero(n)
    if not len(own):
        return out
    n = n[own]
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    doc = np.repeat(np.arange(len(own)), n)
    likelihood = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60.0)).astype(np.float64)
    share, _ = _proportions(likelihood, start, doc, np.full((len(own), model.shape[1]), 1.0 / model.shape[1]), STEPS)
    order = np.argsort(-share, axis=1, kind="stable")
    best, chosen = np.full(len(own), -np.inf), share
    for k in range(1, min(LARGEST_SET, model.shape[1]) + 1):
        within = np.zeros_like(share)
        np.put_along_axis(within, order[:, :k], 1.0 / k, axis=1)
        fitted, value = _proportions(likelihood, start, doc, within, 0 if k == 1 else STEPS)
        value = value - 0.5 * k * np.log(n + 1)
        better = value > best
        chosen = np.where(better[:, None], fitted, chosen)
        best = np.where(better, value, best)
    out[own] = chosen
    return out


def identify(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Adds lang_pred, score and lang_set (languages of the chosen set) to documents; labelled: rows (text, lang) to learn from."""
    spark = docs.sparkSession
    common.batch_rows(spark)
    labelled = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    keep = min(1.0, fit_rows / max(1, sum(counts.values())))
    sample = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1)
    model = spark.sparkContext.broadcast(fit(sample, langs) if langs else np.zeros((CELLS, 1), np.float32))

    columns = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_set", "has_letter")]
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_bytes(batch.column("text"))
            shares = [mixtures(texts[a:b], model.value) for a, b in common.chunks(texts, BLOCK)]
            share = np.concatenate(shares) if shares else np.zeros((0, model.value.shape[1]))
            best = share.argmax(1) if len(share) else np.zeros(0, int)
            known = np.array(batch.column("has_letter").to_pylist(), bool) & (share.sum(1) > 0) & bool(langs)
            pred = [langs[i] if ok else "und" for i, ok in zip(best.tolist(), known.tolist())]
            score = np.where(known, np.minimum(1.0, share.max(1, initial=0)), 0.0)
            sets = [[langs[i] for i in np.flatnonzero(s)] if ok else [] for s, ok in zip(share, known.tolist())]
            names = [*columns, "lang_pred", "score", "lang_set"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))], names=names)
        common.give_back()

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn("has_letter", has_letter).mapInArrow(run, schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.remainder("doc_id", 5) == 0
    out = identify(docs.select("doc_id", "text"), docs.filter(~held_out).select("text", "lang"))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
