"""Best-fit packing (operator 2) with certified bin counts.

Each partition packs its pieces by best-fit decreasing. Dual feasible functions give a lower bound of
the partition's bins; where bins and bound differ, the pieces of bins that aren't full are exchanged
between such partitions, and best-fit decreasing runs again over larger pools, until bounds certify the
count, one pool is left or a round gains nothing.

Defined results: a null text is empty and is packed as its end token alone; texts of any length are encoded whole and
cut into pieces; pieces of equal length are packed in any order (the number of bins doesn't depend on it); repeated rows
and ids are packed one by one; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import binascii
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import common
from saltmarsh.llm.tokens import PATTERN, PrefixCounter, counter, vocabulary_path

#: Pieces that one task packs; the number of partitions follows from it.
PIECES_PER_PARTITION = 40_000
#: Exchanges between partitions with gaps.
ROUNDS = 6


class Encoder:
    """Ids of texts as little-endian 32-bit numbers; ids of pieces are kept."""

    def __init__(self, path: str):
        import tiktoken

        self.base: PrefixCounter = counter(path)
        library = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=self.base.ids, special_tokens={})

        class Known(dict):
            def __missing__(self, piece):
                ids = library.encode_ordinary(piece)
                out = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
                return out

        self.known = Known()

    def encode(self, text: str) -> bytes:
        out = []
        for k, part in enumerate(self.base.split(text)):
            if k % 2:
                out.append(struct.pack("<I", self.base.special[part]))
            elif part:
                out += map(self.known.__getitem__, self.base.findall(part))
        if len(self.known) > 150_000:
            self.known.clear()
        return b"".join(out)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Cuts each document's ids into pieces of the capacity; only the first may be shorter. row_id is unique; full_id numbers the pieces that fill a sequence alone."""
    end = struct.pack("<I", end_id)
    schema = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long, full_id long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, task = encoder(path), TaskContext.get().partitionId()
        row, full = task << 33, task << 38
        for batch in batches:
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = e.encode(text or "") + end
                n = len(ids) // 4
                start = 0
                for k in range(-(-n // capacity)):
                    stop = start + (n % capacity or capacity if not k else capacity)
                    part = ids[4 * start : 4 * stop]
                    whole = stop - start == capacity
                    for column, x in zip(out, (row, doc_id, k, start, stop - start, binascii.crc32(part), full if whole else None, part)):
                        column.append(x)
                    full += whole
                    start = stop
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["row_id", "doc_id", "piece", "start", "length", "ids_crc32", "full_id", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names[: len(out)])
        common.give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the largest sum under two families of dual feasible functions.

    One rounds a share x of the bin to floor((k+1)x)/k, unless (k+1)x is whole; the other counts items over
    1-e as whole bins and drops those under e. All sums are of integers.
    """
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    for k in range(1, 25):
        whole = (k + 1) * x % capacity == 0
        f = np.where(whole, k * x, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((count * f).sum()) // (k * capacity)))
    items, mass = np.cumsum(count), np.cumsum(count * x)
    e = np.arange(1, capacity // 2 + 1)
    large = items[-1] - items[capacity - e]
    middle = mass[capacity - e] - mass[e - 1]
    return max(best, int((-(-(large * capacity + middle) // capacity)).max(initial=0)))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and the offset of each item, and the number of bins. The fullest bin with room is found by a bit mask of the rooms that exist."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        found = mask >> s
        if found:
            room = s + (found & -found).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            b, room, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - room
        if left := room - s:
            rooms[left].append(b)
            mask |= 1 << left
    return bins, offsets, n


def pack_partition(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Packs one partition; gap: bins beyond the bound; fill: tokens in the item's bin."""
    sizes = pdf["length"].to_numpy()
    bins, offsets, n = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
    return pd.DataFrame({"row_id": pdf["row_id"], "length": sizes, "part": pdf["part"], "bin": bins, "offset": offsets, "fill": fill[bins], "bins": n, "gap": n - lower_bound(sizes, capacity)})


def assign(items: DataFrame, capacity: int, per_partition: int = PIECES_PER_PARTITION, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Gives each item (row_id, length) a sequence_id and an offset; also one row per round: its partitions, bins and how many were certified."""
    spark = items.sparkSession
    done, report, pool, last = [], [], items, None
    for k in range(rounds):
        n = pool.count()
        parts = max(1, -(-n // per_partition))
        dealt = pool.withColumn("part", F.pmod(F.xxhash64("row_id", F.lit(k)), F.lit(parts)))
        packed = common.stash(
            dealt.groupBy("part").applyInPandas(lambda pdf: pack_partition(pdf, capacity), "row_id long, length long, part long, bin long, offset long, fill long, bins long, gap long"), "packed"
        )
        facts = packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("gap").alias("gap")).agg(F.sum("bins").alias("bins"), F.sum(F.when(F.col("gap") > 0, F.col("bins"))).alias("open"), F.sum("gap").alias("gap")).first()
        report.append((k, parts, facts.bins or 0, (facts.bins or 0) - (facts.open or 0), facts.gap or 0))
        numbered = packed.withColumn("sequence_id", F.lit(k + 1) * F.lit(1 << 56) + F.col("part") * F.lit(1 << 24) + F.col("bin"))
        again = (F.col("gap") > 0) & (F.col("fill") < capacity)
        if not facts.gap or parts == 1 or k == rounds - 1 or (last is not None and facts.gap >= last):
            done.append(numbered.select("row_id", "sequence_id", "offset"))
            break
        done.append(numbered.filter(~again).select("row_id", "sequence_id", "offset"))
        pool, last = packed.filter(again).select("row_id", "length"), facts.gap
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out, spark.createDataFrame(report, "round int, partitions long, bins long, certified long, gap long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, per_partition: int = PIECES_PER_PARTITION) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds the ids as bytes."""
    common.batch_rows(docs.sparkSession)
    pieces = common.stash(encoded_pieces(docs, path, capacity, end_id, with_ids), "pieces")
    where, _ = assign(pieces.filter("full_id is null").select("row_id", "length"), capacity, per_partition)
    short = pieces.filter("full_id is null").join(where, "row_id")
    full = pieces.filter("full_id is not null").withColumns({"sequence_id": -F.col("full_id") - 1, "offset": F.lit(0).cast("long")})
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    return short.select(columns).unionByName(full.select(columns))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), vocabulary_path())
