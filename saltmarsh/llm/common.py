"""What the operators share: shared-folder tables, word hashing and bounded array merges."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

pa.set_memory_pool(pa.system_memory_pool())  # gives memory back that the other pools would keep in idle workers

#: Text handled at once inside a task, in bytes; a longer document is handled alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session may set its own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="saltmarsh-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stash(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: the lineage ends there. by: columns whose values have folders of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def drop(*frames: DataFrame, part: str = "") -> None:
    """Deletes stashed tables, or a folder of theirs, that nothing reads any more. Spark removes the shuffle files behind them when the driver collects its garbage, so that is asked for, too."""
    jvm = None
    for df in frames:
        path = getattr(df, "stash_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
    if jvm:
        free_shuffles(df.sparkSession, 0.05)


def free_shuffles(spark: SparkSession, wait: float = 0.5) -> None:
    """Asks the driver for its garbage, so that Spark removes the shuffle files of plans that are done with; what the first collection frees lets go of more."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(wait)


def row_key():
    """Column: 128 bits that stand for a row's doc_id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.when(F.col("text").isNull(), "-").otherwise("+"), F.col("text").cast("string")).cast("binary"))


def batch_rows(spark: SparkSession, n: int = 1000) -> None:
    """Rows in one Arrow batch of this session from now on: texts of a batch are held by the executor and by its Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(n))


def give_back() -> None:
    """Returns freed memory of this Python worker to the system: idle workers count to an executor's memory."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def remainder(col: str, by: int):
    """crc32 of the id as text, mod `by`; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % by


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of the words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(9, 14)]] = False
#: Bytes of the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z were lower-cased.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 4096), POWER, np.uint64))])
    return _powers


def word_hashes(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, A-Z lower-cased; the words' starts and ends in the joined text; the number of words before each text and after the last."""
    buf = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    mask = is_word[buf]
    step = np.diff(mask.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    before = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, before
    lens = ends - starts
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    inside = np.arange(int(lens.sum())) - np.repeat(first, lens)
    values = BYTE_KEYS[buf[mask]] * powers(int(lens.max()) + 1)[inside]
    return mix(np.add.reduceat(values, first) + lens.astype(np.uint64)), starts, ends, before


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, at each position where k words are left."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out += words[j : j + n] * STEPS[j]
    return mix(out)


_codec = pa.Codec("zstd", compression_level=1)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _codec.compress(data, asbytes=True)


def unsqueeze(blob: bytes) -> memoryview:
    return memoryview(_codec.decompress(pa.py_buffer(blob)[8:], int.from_bytes(blob[:8], "little")))


def pack(a: np.ndarray) -> bytes:
    return squeeze(a.tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(unsqueeze(blob), dtype)


def pack_ints(a: np.ndarray) -> bytes:
    """Numbers of at least 0, in as few bytes as the largest needs; the bytes of a place stand together."""
    width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << (8 * w))
    planes = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + squeeze(planes.tobytes())


def unpack_ints(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(blob[1:]), np.uint8).reshape(blob[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{blob[0]}").reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted numbers, as their differences."""
    return int(a[0] if len(a) else 0).to_bytes(8, "little") + pack_ints(np.diff(a, prepend=a[:1]))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(blob[8:]), dtype=np.uint64) + np.uint64(int.from_bytes(blob[:8], "little"))


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; a sort takes a twentieth of the time of a table of hashes."""
    a = np.sort(a)
    return a[np.append(True, a[1:] != a[:-1])] if len(a) else a


def placed(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct codes of so many bits, where each given code is among them, and how often each occurs. Code and place are sorted as one number if both fit."""
    n = len(codes)
    wide = max(1, n.bit_length())
    if bits + wide <= 64:
        both = np.sort((codes.astype(np.uint64) << np.uint64(wide)) | np.arange(n, dtype=np.uint64))
        ordered, order = both >> np.uint64(wide), (both & np.uint64((1 << wide) - 1)).astype(np.int64)
    else:
        order = np.argsort(codes, kind="stable")
        ordered = codes[order].astype(np.uint64)
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[first], inverse, np.diff(np.append(first, n))


def merged(parts: DataFrame, size: int, dtype: str, how: str) -> np.ndarray:
    """An array of fixed size, from rows (slot int, blob binary) that hold parts of partial arrays; how: sum or or. Only `size` numbers reach the driver."""
    ufunc = {"sum": np.add, "or": np.bitwise_or}[how]

    def one(batches):
        import pandas as pd

        kept: dict[int, np.ndarray] = {}
        for pdf in batches:
            for slot, blob in zip(pdf["slot"], pdf["blob"]):
                a = unpack(blob, dtype)
                kept[slot] = a.copy() if slot not in kept else ufunc(kept[slot], a)
        if kept:
            yield pd.DataFrame({"slot": list(kept), "blob": [pack(a) for a in kept.values()]})

    n = max(8, min(64, parts.rdd.getNumPartitions() // 4))
    rows = parts.select("slot", "blob").repartition(n, "slot").mapInPandas(one, "slot int, blob binary").collect()
    got = {r.slot: unpack(r.blob, dtype) for r in rows}
    out = np.zeros(size, dtype)
    for slot, a in got.items():
        out[slot * len(a) : (slot + 1) * len(a)] = a
    return out


def slots(a: np.ndarray, n: int = 16) -> list[tuple[int, bytes]]:
    """The parts of an array for merged(), without parts that are all zero."""
    return [(i, pack(x)) for i, x in enumerate(np.split(a, n)) if x.any()]
