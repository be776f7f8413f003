"""Document fingerprints (operator 13): MinHash signatures, their likeness, and near copies by bands.

A text's shingles are five words (A-Z lower-cased); the first four words make shingles with blanks before them, so that
short texts have some, too. Each of 128 universal permutations of 32-bit numbers takes the least image of the shingles;
16 bits of each are the fingerprint, in hexadecimal. The likeness of two fingerprints is the share of places where they
are equal, an estimate of the Jaccard similarity.

Next documents: the table is sorted by doc_id over range partitions, and each task knows the next of all its rows but
the last; that one and each partition's first row meet in a small table with two rows for each partition.

Near copies: documents with equal sets of shingles (those with blanks included) are one class; 32 bands of a signature
are joined in Spark, classes of a band's bucket are tried with its least one, and pairs are links if the Jaccard
similarity of their whole sets is at least 0.75. Buckets that links leave in several components are compared in blocks,
so no pair of a bucket is passed over. Two texts of similarity 0.75 share no band with a probability under 0.00001.

Defined results: null and empty texts have no words; texts without words have the fingerprint of ones alone, are alike
(1) to each other, not (0) to others, and stand alone in their class; a text of any length is read whole; rows of one
doc_id follow each other by the hash of their texts, repeated rows in any order; null doc_ids come first, and are a
class's smallest id only where all are null; a single document is its own next; other columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import common
from saltmarsh.llm.components import components
from saltmarsh.llm.decontam import bits_of, passes
from saltmarsh.llm.ngram_join import BLOCK, _compare, fingerprint, verified

#: Permutations of a signature, and places of one band.
PERMUTATIONS, BAND = 128, 4
SHINGLE, PERCENT = 5, 75
_rng = np.random.Generator(np.random.PCG64(13))
FACTORS = _rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADDENDS = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
BLANK = np.uint64(0x5851F42D4C957F2D)


def _windows(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle that ends at each word of some texts, and the number of words before each text and after the last."""
    words, _, _, before = common.word_hashes(texts, common.SPACED)
    n = np.diff(before)
    # each text's words stand after k - 1 blanks
    at = np.arange(len(words)) + (k - 1) * (np.repeat(np.arange(len(texts)), n) + 1)
    padded = np.full(len(words) + (k - 1) * len(texts), BLANK)
    padded[at] = words
    return (common.shingle_hashes(padded, k)[at - (k - 1)] if len(words) else words), before


def signatures(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """A row of 16-bit numbers for each text, and whether it has words."""
    out = np.full((len(texts), PERMUTATIONS), 0xFFFF, np.uint16)
    some = np.zeros(len(texts), bool)
    for a, b in common.chunks(texts):
        shingles, before = _windows(texts[a:b], k)
        if not len(shingles):
            continue
        values = (shingles >> np.uint64(32)).astype(np.uint32)
        rows = np.flatnonzero(np.diff(before))
        least = np.empty((len(rows), PERMUTATIONS), np.uint32)
        for i in range(PERMUTATIONS):
            least[:, i] = np.minimum.reduceat(values * FACTORS[i] + ADDENDS[i], before[:-1][rows])
        out[a + rows] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
        some[a + rows] = True
    return out, some


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for a, b in common.chunks(texts):
        shingles, before = _windows(texts[a:b], k)
        for lo, hi in zip(before[:-1].tolist(), before[1:].tolist()):
            yield np.unique(shingles[lo:hi])


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """The share of equal places, row by row."""
    return np.where(some_a & some_b, (a == b).mean(1), (some_a == some_b).astype(float))


def edited(text: str, following: str) -> str:
    """The last half of the characters gives way to the first as many of the next text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


DONE, TAIL, HEAD = 0, 1, 2
RESULT = ["doc_id", "tie", "fp", "n_shingles", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
SCHEMA = "part int, kind int, text string, doc_id long, tie long, fp long, n_shingles long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _rows(ids: list, ties: list, texts: list[str], part: int) -> Iterator[pa.RecordBatch]:
    """The results of all texts but the last, each with the one after it as its next."""
    m = len(texts) - 1
    if m < 1:
        return
    raw = [t.encode() for t in texts]
    sig, some = signatures(raw)
    new = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
    new_sig, new_some = signatures(new)
    sets = list(shingle_sets(raw[:m]))
    columns = [
        ids[:m], ties[:m], [fingerprint(s) if len(s) else None for s in sets], [len(s) for s in sets], [len(t) for t in texts[:m]], [hashlib.sha256(t).hexdigest() for t in new], [x.tobytes() for x in sig[:m]], [x.tobytes() for x in new_sig],
        likeness(sig[:m], new_sig, some[:m], new_some), likeness(sig[:m], sig[1:], some[:m], some[1:]),
    ]
    head = [pa.array([part] * m, pa.int32()), pa.array([DONE] * m, pa.int32()), pa.nulls(m, pa.string())]
    yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, t) for c, t in zip(columns, RESULT_TYPES))], names=["part", "kind", "text", *RESULT])


def _edge(part: int, kind: int, doc_id, tie, text: str) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([text], pa.string()), pa.array([doc_id], pa.int64()), pa.array([tie], pa.int64()), *(pa.nulls(1, t) for t in RESULT_TYPES[2:])]
    return pa.RecordBatch.from_arrays(columns, names=["part", "kind", "text", *RESULT])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are compressed before they are shuffled."""
    for batch in batches:
        blobs = [common.squeeze(t) for t in common.as_bytes(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(blobs, pa.binary())], names=["doc_id", "tie", "packed"])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition the results of all rows but the last, then its first and last row."""
    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, ties = (batch.column(c).to_pylist() for c in ("doc_id", "tie"))
        texts = [str(common.unsqueeze(b), "utf-8") for b in batch.column("packed").to_pylist()]
        if last is None:
            yield _edge(part, HEAD, ids[0], ties[0], texts[0])
        else:
            ids, ties, texts = [last[0], *ids], [last[1], *ties], [last[2], *texts]
        yield from _rows(ids, ties, texts, part)
        last = ids[-1], ties[-1], texts[-1]
    if last is not None:
        yield _edge(part, TAIL, *last)
    common.give_back()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of the partitions' last rows."""
    for batch in batches:
        for part, doc_id, tie, text, following in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "tie", "text", "following"))):
            yield from _rows([doc_id, None], [tie, None], [text, following], part)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text), fp (of the set of shingles; null without words), n_shingles, n_chars, edited_sha256, fingerprint and edited_fingerprint as bytes, near_edited, near_next; written to the shared folder."""
    spark = docs.sparkSession
    common.batch_rows(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    packed = texts.mapInArrow(_packed, "doc_id long, tie long, packed binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = common.stash(packed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").mapInArrow(_in_order, SCHEMA), "fingerprints")
    common.free_shuffles(spark)
    # a row for each partition of the sort, no more
    parts = sorted(r.part for r in found.filter(F.col("kind") == HEAD).select("part").collect())
    follows = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1])], "part int, next_part int")
    heads = found.filter(F.col("kind") == HEAD).select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    tails = found.filter(F.col("kind") == TAIL).select("part", "doc_id", "tie", "text").join(follows, "part").join(heads, "next_part")
    return found.filter(F.col("kind") == DONE).select(RESULT).unionByName(tails.mapInArrow(_across, SCHEMA).select(RESULT))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp and whole set of each text."""
    for batch in batches:
        seen: dict[int, np.ndarray] = {}
        for s in shingle_sets(common.as_bytes(batch.column("text"))):
            if len(s):
                seen[fingerprint(s)] = s.view(np.int64)
        if seen:
            ends = np.cumsum([0] + [len(s) for s in seen.values()]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(list(seen.values()))))], names=["fp", "members"])


def _wanted_sets(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """fp and members of some classes: one text of each is read again; a filter of fixed size is broadcast, and no text is shuffled."""
    wanted = texts.sparkSession.sparkContext.broadcast(bits_of(classes.select(F.col("tie").alias("h")).distinct(), 26))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(passes(wanted.value, h.to_numpy(np.int64).view(np.uint64)))

    read = texts.filter(maybe(F.xxhash64("text")))
    found = read.mapInArrow(_sets, "fp long, members array<long>")
    return common.stash(found.join(classes.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]), "sets")


def _packed_sets(sets: DataFrame) -> DataFrame:
    """The sets as sorted numbers of 48 bits, in about five bytes each: two sets of a thousand shingles have a false match with a probability of 4 in 10^9."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [common.pack_sorted(np.sort(np.array(m, np.int64).view(np.uint64) >> np.uint64(16))) for m in batch.column("members").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(blobs, pa.binary())], names=["fp", "packed"])

    return sets.mapInArrow(run, "fp long, packed binary")


def _compare_packed(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    return _compare(pdf.assign(members=[common.unpack_sorted(b) for b in pdf["packed"]]), percent)


def _in_blocks(placed: DataFrame) -> DataFrame:
    """Rows (place, family, i, j, side, fp, comp) that bring the classes outside of a bucket's largest component together with all of the bucket, in blocks; placed has bucket, fp and comp."""
    spark = placed.sparkSession
    shares = placed.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    home = shares.groupBy("bucket").agg(F.sum("m").alias("members"), F.max(F.struct("m", "comp")).alias("home"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    home = home.select("bucket", blocks(F.col("members")).alias("bj"), blocks(F.col("members") - F.col("home.m")).alias("bi"), F.col("home.comp").alias("home"))
    rest = placed.join(home, "bucket").withColumnRenamed("bucket", "family")
    few = F.pmod(F.xxhash64("family"), F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    place = F.when((F.col("bi") == 1) & (F.col("bj") == 1), few).otherwise(F.col("family"))
    own = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["place", "family", "i", "j", "side", "fp", "comp"]
    outside = rest.filter("comp <> home").withColumns({"place": place, "i": own("bi"), "j": each("bj"), "side": F.lit(0)}).select(columns)
    whole = rest.withColumns({"place": place, "i": each("bi"), "j": own("bj"), "side": F.lit(1)}).select(columns)
    return outside.unionByName(whole)


def near_classes(texts: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(fp, comp) of all classes that have links; found has fp, n_shingles, tie and fingerprint, texts has text."""
    spark = texts.sparkSession
    classes = common.stash(found.filter("fp is not null").groupBy("fp").agg(F.min("n_shingles").alias("n"), F.min("tie").alias("tie"), F.min("fingerprint").alias("sig")), "classes")
    band = F.transform(F.sequence(F.lit(0), F.lit(PERMUTATIONS // BAND - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * 2 * BAND + 1, F.lit(2 * BAND))))
    entries = classes.select("fp", F.explode(band).alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("fp").alias("centre"), F.count("*").alias("m")).filter("m > 1")
    entries = common.stash(entries.join(shared, "bucket"), "buckets")
    common.free_shuffles(spark)
    sizes = classes.select(F.col("fp").alias("a"), F.col("n").alias("na"))
    sizes = classes.select("fp", "n")
    tried = entries.filter("fp <> centre").select(F.col("centre").alias("a"), F.col("fp").alias("b")).distinct()
    tried = tried.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    tried = common.stash(tried.select("a", "b"), "tried")
    used = tried.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sets = _wanted_sets(texts, classes.join(used, "fp", "left_semi"))
    links = common.stash(verified(tried, sets, percent), "links")
    common.drop(sets, tried)
    comp = components(links)
    common.drop(links)

    # buckets of more than two classes in several components; buckets of the same classes are one
    placed = entries.filter("m > 2").select("bucket", "fp", "m").join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    mixed = F.sum(F.xxhash64("fp").cast("decimal(38,0)")).alias("mixed")
    open_ones = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"), mixed).filter("low <> high").dropDuplicates(["mixed", "m"])
    open_ones = common.stash(placed.drop("m").join(open_ones.select("bucket"), "bucket", "left_semi"), "open")
    if not open_ones.isEmpty():
        sets = common.stash(_packed_sets(_wanted_sets(texts, classes.join(open_ones.select("fp").distinct(), "fp", "left_semi"))), "packed")
        common.free_shuffles(spark)
        blocks = _in_blocks(open_ones).join(sets, "fp")
        more = common.stash(blocks.groupBy("place", "i", "j").applyInPandas(lambda pdf: _compare_packed(pdf, percent), "a long, b long"), "found")
        common.drop(sets)
        if not more.isEmpty():
            comp = components(comp.select(F.col("comp").alias("a"), F.col("fp").alias("b")).unionByName(more))
    common.drop(classes, entries, open_ones)
    return comp


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """The results of fingerprints() with hexadecimal fingerprints, and class_id: the smallest doc_id among a document's near copies, its own included."""
    found = fingerprints(docs)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    comp = near_classes(texts, found.select("fp", "n_shingles", "tie", "fingerprint"))
    out = found.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = out.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = out.join(least, "comp", "left")
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return out.select("doc_id", "n_chars", "edited_sha256", *hexed, "near_edited", "near_next", F.coalesce("least", "doc_id").alias("class_id"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(common.table(spark, sf_dir, "documents"))
