"""Benchmark decontamination (operator 4): a prefix-filtered join of item windows with documents.

Windows are 10 consecutive words of an item (a shorter item is one window). Their shingles are ordered by
rarity, counted over all documents. A window is found only where all its shingles are found, so its rarest
shingle alone is its necessary prefix: only that one is joined. Where it occurs, its place in the window
and the lengths bound where the window may start, and the words there are compared themselves.

Defined results: null and empty texts have no words and no hits; an item without words is never found;
equal item ids count once, a null item id marks words as hit but is in no list; repeated documents give
repeated rows; empty tables give no hits; columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import common

WINDOW, SHINGLE = 10, 5
#: Bits of the filter that documents' shingles pass before they are joined; its size is fixed and hits are joined exactly.
FILTER_BITS = 24


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """item_id, words, k (words in a shingle) and the shingles' hashes, for each distinct window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            texts, ids = common.as_bytes(batch.column("text")), batch.column("item_id").to_pylist()
            for a, b in common.chunks(texts):
                hashes, starts, ends, before = common.word_hashes(texts[a:b], common.ALNUM)
                buf = b"\n".join(texts[a:b]).lower()
                for d in range(b - a):
                    lo, hi = before[d], before[d + 1]
                    n = min(window, hi - lo)
                    k = min(shingle, n)
                    for i in range(lo, hi - n + 1) if n else ():
                        words = [buf[s:e].decode() for s, e in zip(starts[i : i + n], ends[i : i + n])]
                        out.append((ids[a + d], words, int(k), common.shingle_hashes(hashes[i : i + n], k).view(np.int64).tolist()))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.list_(pa.string())), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int64()))],
                names=["item_id", "words", "k", "shingles"],
            )

    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "item_id string, words array<string>, k int, shingles array<long>")
    return rows.distinct()


def bits_of(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for the high part of each 64-bit number in column h."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << (bits - 3), np.uint8)
        for pdf in batches:
            at = pdf["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)
            np.bitwise_or.at(seen, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        yield pd.DataFrame(common.slots(seen), columns=["slot", "blob"])

    return common.merged(hashes.mapInPandas(run, "slot int, blob binary"), 1 << (bits - 3), "uint8", "or")


def passes(seen: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(seen).bit_length() + 2))
    return (seen[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _scan(batch: pa.RecordBatch, filters: dict[int, np.ndarray]):
    """For each chunk of a batch: the first row, its texts, words, and per shingle size the places in the filter."""
    texts = common.as_bytes(batch.column("text"))
    for a, b in common.chunks(texts):
        hashes, starts, ends, before = common.word_hashes(texts[a:b], common.ALNUM)
        found = {}
        for k, seen in filters.items():
            h = common.shingle_hashes(hashes, k)
            at = np.flatnonzero(passes(seen, h))
            doc = np.searchsorted(before, at, "right") - 1
            inside = at + k <= before[doc + 1]
            found[k] = at[inside], doc[inside], h[at[inside]]
        yield a, texts[a:b], starts, ends, before, found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row_key, n_words, n_hit, n_items, item_ids (sorted), contaminated and spans (word ranges that are hit) for each document."""
    spark = docs.sparkSession
    common.batch_rows(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row_key", common.row_key())
    made = common.stash(windows(items, window, shingle), "windows")
    sizes = [r.k for r in made.select("k").distinct().collect()]
    wanted = made.select("k", F.explode("shingles").alias("h")).distinct()
    filters = spark.sparkContext.broadcast({k: bits_of(wanted.filter(F.col("k") == k)) for k in sizes})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, found in _scan(batch, filters.value):
                for k, (_, _, h) in found.items():
                    u, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), k, np.int32)), pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["k", "h", "n"])

    rarity = texts.select("text").mapInArrow(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    # a window with a shingle that no document has is found nowhere: the inner join drops the shingle, the count drops the window
    placed = made.select("words", "k", F.size("shingles").alias("m"), F.posexplode("shingles").alias("place", "h")).distinct()
    rarest = placed.join(rarity, ["k", "h"]).groupBy("words", "k", "m").agg(F.count("*").alias("known"), F.min(F.struct("n", "h", "place")).alias("rare"))
    prefixes = common.stash(rarest.filter("known = m").select("words", "k", F.col("rare.h").alias("h"), F.col("rare.place").alias("place")), "prefixes")
    chosen = spark.sparkContext.broadcast({k: bits_of(prefixes.filter(F.col("k") == k).select("h").distinct()) for k in sizes})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("row_key")
            n_words = np.zeros(batch.num_rows, np.int64)
            out: list[tuple] = []
            for a, part, starts, ends, before, found in _scan(batch, chosen.value):
                n_words[a : a + len(part)] = np.diff(before)
                buf = b"\n".join(part).lower()
                for k, (at, doc, h) in found.items():
                    for i, d, x in zip(at.tolist(), doc.tolist(), h.view(np.int64).tolist()):
                        lo = max(int(before[d]), i - window + k)
                        hi = min(int(before[d + 1]), i + window)
                        words = [buf[s:e].decode() for s, e in zip(starts[lo:hi], ends[lo:hi])]
                        out.append((row + a + d, k, x, i - int(before[d]), i - lo, words))
            cols = list(zip(*out)) if out else [[]] * 6
            m, n = batch.num_rows, len(out)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            names = ["row_id", "k", "h", "at", "left", "around", "doc_id", "row_key", "n_words"]
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + m), pa.int64()), *(pa.nulls(m, t) for t in kinds[1:]), ids, keys, pa.array(n_words)], names=names)
            if n:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], names=names)
            row += m

    seen = common.stash(texts.mapInArrow(find, "row_id long, k int, h long, at long, left long, around array<string>, doc_id long, row_key string, n_words long"), "places")
    start = F.col("left") - F.col("place")  # where the window starts in the words around
    hits = (
        seen.filter("k is not null").select("row_id", "k", "h", "at", "left", "around").join(prefixes, ["k", "h"])
        .filter((start >= 0) & (start + F.size("words") <= F.size("around")))
        .filter(F.slice("around", F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words"))
        .select("row_id", (F.col("at") - F.col("place")).alias("start"), F.size("words").alias("length"), "words")
    )
    hits = common.stash(hits, "hits")
    span = F.struct("start", (F.col("start") + F.col("length")).alias("stop"))
    merged = F.aggregate(
        F.array_sort("found"),
        F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["stop"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], x["stop"]).alias("stop")))))
        .otherwise(F.concat(done, F.array(x))),
    )
    spans = hits.groupBy("row_id").agg(F.collect_set(span).alias("found")).select("row_id", merged.alias("spans"))
    named = hits.select("row_id", "words").distinct().join(made.select("words", "item_id").distinct(), "words").groupBy("row_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = seen.filter("k is null").select("row_id", "doc_id", "row_key", "n_words").join(spans, "row_id", "left").join(named, "row_id", "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"]), F.lit(0))
    no_ids = F.expr("cast(array() as array<string>)")
    out = out.withColumns({"n_hit": n_hit.cast("long"), "item_ids": F.coalesce("item_ids", no_ids)})
    return out.select("doc_id", "row_key", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"), "spans")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
