"""N-gram Jaccard join (operator 6): a grouped prefix join of word-shingle sets.

1. Each shingle has a cell, some bits of its hash; there are sixteen or more cells for each shingle of the input.
   Chunks of documents send their cells to buckets, which count them over all documents and answer.
2. Shingles are ordered from rare to frequent cells. Sets that share three quarters of their union share one of the
   first n - ceil(3n/4) + 1 of that order, the prefix. Cells that only one shingle has can't be shared, so a document
   whose prefix has no others has no links and goes no further; the others keep their shared prefix cells.
3. Documents with equal sets are one class; classes with the same prefix and size are one group. Each group of a
   cell's list is paired with the list's least edited group; sizes and a bound of the overlap, from counts of the
   shingles by hash, drop most pairs; the others are verified with the whole sets.
4. Lists with classes that those links leave in different components are open. Open lists with classes in common are
   families; all classes outside of a family's largest component are compared with the whole sets of the family, in
   blocks. So no link between different components is lost, and none inside a component is made twice.

Defined results: null texts and texts without words have size 0 and stand alone; fewer words than a shingle
are one shingle; texts of any length are read whole; of equal ids and ties the least id names a component; repeated rows share a component; a null doc_id is never a component's smallest id unless all
are null; other columns are not read; an empty table gives an empty table. Sets are of 64-bit hashes, and classes are
told apart by 64-bit fingerprints of them. A list with very many groups is split by Spark's skew join.
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
from saltmarsh.llm.components import components
from saltmarsh.llm.decontam import bits_of, passes

#: Shingles in one chunk of documents, and cells in one bucket of counts.
CHUNK, BUCKET = 1_000_000, 1_500_000
#: Members of a family in one block.
BLOCK = 1000
EMPTY = np.zeros(0, np.uint64)
U = np.uint64


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for a, b in common.chunks(texts):
        words, _, _, before = common.word_hashes(texts[a:b], common.SPACED)
        all_k = common.shingle_hashes(words, k)
        for lo, hi in zip(before[:-1].tolist(), before[1:].tolist()):
            n = hi - lo
            yield np.unique(all_k[lo : hi - k + 1]) if n >= k else common.shingle_hashes(words[lo:hi], n) if n else EMPTY


def prefix_size(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def fingerprint(values: np.ndarray) -> int:
    """Of a set of 64-bit numbers, in any order."""
    s = common.mix(values * common.STEPS[7]).sum(dtype=U, keepdims=True) + np.array([len(values)], U) * common.STEPS[9]
    return int(common.mix(s).view(np.int64)[0])


ROW = ["chunk", "doc_id", "row_key", "n", "fp", "bucket", "blob", "counts"]


def _described(texts: DataFrame, k: int, bits: int, buckets: int) -> DataFrame:
    """Rows of documents (chunk, doc_id, row_key, n, fp), of chunks (chunk, bucket -1, the cells of each document one after another, their numbers) and of a chunk's cells by bucket (chunk, bucket, cells, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

        def closed(sets: list[np.ndarray], fps: list[int], at: int) -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.int64)
            cells = np.concatenate(sets) >> U(64 - bits)
            u, _, times = common.placed(cells, bits)
            bucket = (u * U(buckets) >> U(bits)).astype(np.int64) if bits < 40 else (u >> U(bits - 32)) * U(buckets) >> U(32)
            edges = np.flatnonzero(np.diff(bucket)) + 1
            # of each document its first cell, then the differences of the sorted ones
            steps = np.diff(cells, prepend=U(0))
            first = np.cumsum(sizes) - sizes
            steps[first] = cells[first]
            out = [(-1, common.pack_ints(steps), common.squeeze(sizes.tobytes() + np.array(fps, np.int64).tobytes()))]
            out += [(int(bucket[x]), common.pack_sorted(u[x:y]), common.pack_ints(np.minimum(times[x:y], 65535))) for x, y in zip([0, *edges.tolist()], [*edges.tolist(), len(u)])]
            cols = list(zip(*out))
            m = len(out)
            return pa.RecordBatch.from_arrays([pa.array([at] * m, kinds[0]), *(pa.nulls(m, t) for t in kinds[1:5]), *(pa.array(c, t) for c, t in zip(cols, kinds[5:]))], names=ROW)

        sets, fps, size = [], [], 0
        for batch in batches:
            n, fp, of = [], [], []
            for s in shingle_sets(common.as_bytes(batch.column("text")), k):
                n.append(len(s))
                fp.append(fingerprint(s) if len(s) else None)
                of.append(chunk)
                if len(s):
                    sets.append(s)
                    fps.append(fp[-1])
                    size += len(s)
                    if size >= CHUNK:
                        yield closed(sets, fps, chunk)
                        sets, fps, size = [], [], 0
                        chunk += 1
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), batch.column("doc_id"), batch.column("row_key"), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), *(pa.nulls(m, t) for t in kinds[5:])], names=ROW)
        if sets:
            yield closed(sets, fps, chunk)
        common.give_back()

    return texts.mapInArrow(run, "chunk long, doc_id long, row_key string, n long, fp long, bucket int, blob binary, counts binary")


def _counted(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Answers each chunk: how many shingles of all documents are in each of its cells."""
    parts = [common.unpack_sorted(b) for b in pdf["blob"]]
    _, inverse, _ = common.placed(np.concatenate(parts), bits)
    times = np.concatenate([common.unpack_ints(c) for c in pdf["counts"]]).astype(np.float64)
    total = np.minimum(np.bincount(inverse, weights=times), 65535).astype(np.int64)[inverse]
    split = np.split(total, np.cumsum([len(p) for p in parts])[:-1])
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "answer": [common.pack_ints(x) for x in split]})


def signature(cells: np.ndarray) -> bytes:
    """How many of the shingles fall into each hash class; about four a class."""
    k = 1 << max(3, (len(cells) // 4).bit_length())
    return np.minimum(np.bincount(common.mix(cells).astype(np.int64) & (k - 1), minlength=k), 255).astype(np.uint8).tobytes()


def overlap_bound(a: bytes, b: bytes) -> int:
    """No two sets with these signatures have more shingles in common."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if (len(x) and x.max() == 255) or (len(y) and y.max() == 255):
        return 1 << 40
    k = min(len(x), len(y))
    x, y = x.reshape(-1, k).sum(0, dtype=np.int64), y.reshape(-1, k).sum(0, dtype=np.int64)
    return int(np.minimum(x, y).sum())


def prefixes(cells: np.ndarray, sizes: np.ndarray, counts: np.ndarray, percent: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of documents whose prefix has shared cells: number, own cells in the prefix, and the prefix, rare cells first."""
    first = np.cumsum(sizes) - sizes
    alone = np.add.reduceat((counts == 1).astype(np.int64), first) if len(first) else first
    for d in np.flatnonzero(alone < prefix_size(sizes, percent)).tolist():
        lo, n = int(first[d]), int(sizes[d])
        order = np.lexsort((cells[lo : lo + n], counts[lo : lo + n]))[: prefix_size(n, percent)]
        yield d, int(alone[d]), cells[lo : lo + n][order]


def _classes(bits: int, percent: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """fp, gid (of its prefix and size), n, edited (own cells in a million), signature and shared prefix cells of a chunk's classes that may have links."""
        out = {}
        if not left.empty:
            row = left.iloc[0]
            steps = common.unpack_ints(row["blob"]).astype(U)
            sizes, fps = np.frombuffer(common.unsqueeze(row["counts"]), np.int64).reshape(2, -1)
            first = np.cumsum(sizes) - sizes
            cells = np.cumsum(steps, dtype=U)
            cells -= np.repeat(np.concatenate([[U(0)], cells[first[1:] - 1]]), sizes)
            counts = np.concatenate([common.unpack_ints(a).astype(np.int64) for a in right.sort_values("bucket")["answer"]])[common.placed(cells, bits)[1]]
            for d, alone, prefix in prefixes(cells, sizes, counts, percent):
                fp, n = int(fps[d]), int(sizes[d])
                if fp not in out:
                    out[fp] = fp, fingerprint(prefix) ^ n, n, 1_000_000 * alone // n, signature(cells[first[d] : first[d] + n]), np.unique(prefix[alone:]).view(np.int64)
        common.give_back()
        return pd.DataFrame(list(out.values()), columns=["fp", "gid", "n", "edited", "sig", "cells"])

    return run


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """fp and whole set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, np.ndarray] = {}
            for s in shingle_sets(common.as_bytes(batch.column("text")), k):
                if len(s):
                    seen[fingerprint(s)] = s.view(np.int64)
            if seen:
                ends = np.cumsum([0] + [len(s) for s in seen.values()]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(list(seen.values()))))], names=["fp", "members"])

    return texts.select("text").mapInArrow(run, "fp long, members array<long>")


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that the sizes and the overlap bound allow."""

    @F.pandas_udf("boolean")
    def allowed(na: pd.Series, sa: pd.Series, nb: pd.Series, sb: pd.Series) -> pd.Series:
        return pd.Series([(100 + percent) * overlap_bound(x, y) >= percent * (i + j) for i, x, j, y in zip(na, sa, nb, sb)])

    left, right = (classes.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return both.filter(allowed("na", "sa", "nb", "sb")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar."""
    left, right = (sets.select(F.col("fp").alias(x), F.col("members").alias(f"m{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common_n = F.size(F.array_intersect("ma", "mb"))
    return both.filter(100 * common_n >= percent * (F.size("ma") + F.size("mb") - common_n)).select("a", "b")


def _family(pdf: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between the left and right sets of a block that join components which nothing joins yet; at most one fewer than there are components."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    if left.empty or right.empty:
        return []
    sets = [*left["members"], *right["members"]]
    sizes = np.array([len(x) for x in sets], np.int64)
    _, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    use = times[ids] > 1
    _, ids = np.unique(ids[use], return_inverse=True)
    owner = owner[use]
    order = np.argsort(ids, kind="stable")
    ids, owner, m = ids[order], owner[order], len(left)
    shared = np.zeros((m, len(right)), np.float32)
    wide = 4096 if len(sets) > 64 else 512
    for start in range(0, int(ids[-1]) + 1 if len(ids) else 0, wide):
        lo, hi = np.searchsorted(ids, [start, start + wide])
        part = np.zeros((len(sets), wide), np.float32)
        part[owner[lo:hi], ids[lo:hi] - start] = 1
        shared += part[:m] @ part[m:].T
    i, j = np.nonzero((100 + percent) * shared.astype(np.int64) >= percent * (sizes[:m, None] + sizes[None, m:]))
    comp = {c: c for c in pdf["comp"]}

    def root(c):
        while comp[c] != c:
            comp[c] = c = comp[comp[c]]
        return c

    out = []
    lf, lc, rf, rc = (x.to_numpy() for x in (left["fp"], left["comp"], right["fp"], right["comp"]))
    for x, y in zip(i.tolist(), j.tolist()):
        if lc[x] != rc[y] and (u := root(lc[x])) != (v := root(rc[y])):
            comp[u] = v
            out.append((lf[x], rf[y]))
    return out


def _compare(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links found in a block; small families share one."""
    out = [x for _, part in pdf.groupby("family", sort=False) for x in _family(part, percent)]
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def wanted_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts whose row_key is among the keys, and few others: a filter of fixed size is broadcast, and no text is shuffled."""
    wanted = texts.sparkSession.sparkContext.broadcast(bits_of(keys.select(F.xxhash64("row_key").alias("h")).distinct(), 26))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(passes(wanted.value, h.to_numpy(np.int64).view(U)))

    return texts.filter(maybe(F.xxhash64("row_key")))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, row_key, n_shingles and component_id of each document. Two documents link when 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    common.batch_rows(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row_key", common.row_key())
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # a shingle takes two bytes at least
    bits = min(48, max(16, (size // 6).bit_length() + 4))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (6 * BUCKET) + 1)
    described = common.stash(_described(texts, k, bits, buckets), "described")
    rows = described.filter("row_key is not null").select("doc_id", "row_key", "n", "fp")
    answers = described.filter("bucket >= 0").select("chunk", "bucket", "blob", "counts").groupBy("bucket").applyInPandas(lambda pdf: _counted(pdf, bits), "chunk long, bucket int, answer binary")
    chunks = described.filter("bucket = -1").select("chunk", "blob", "counts")
    found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_classes(bits, percent), "fp long, gid long, n long, edited long, sig binary, cells array<long>")
    every = common.stash(found, "classes_of_chunks")
    classes = common.stash(every.dropDuplicates(["fp"]), "classes")
    common.drop(every)

    # the classes of a group are tried with its first one, the groups of a cell's list with the least edited one
    facts = F.struct("edited", "n", "fp")
    groups = common.stash(classes.groupBy("gid").agg(F.min(facts).alias("first"), F.count("*").alias("m"), F.first("cells").alias("cells")), "groups")
    entries = groups.select("gid", "first", "m", F.explode("cells").alias("cell"))
    lists = entries.groupBy("cell").agg(F.min("first").alias("centre"), F.sum("m").alias("classes"), F.count("*").alias("k")).filter("classes > 1")
    entries = common.stash(entries.select("cell", "gid", F.col("first.fp").alias("first"), "m").join(lists.select("cell", F.col("centre.fp").alias("centre"), "classes", "k"), "cell"), "entries")
    star = entries.filter("first <> centre").select(F.col("centre").alias("a"), F.col("first").alias("b"))
    inside = classes.join(groups.filter("m > 1").select("gid", F.col("first.fp").alias("a")), "gid").filter("fp <> a").select("a", F.col("fp").alias("b"))
    tried = common.stash(possible(star.unionByName(inside).distinct(), classes, percent), "tried")

    def sets_of(fps: DataFrame) -> DataFrame:
        """One text of each class is read again."""
        keys = rows.join(fps, "fp", "left_semi").groupBy("fp").agg(F.min("row_key").alias("row_key"))
        return common.stash(_sets(wanted_texts(texts, keys), k).join(fps, "fp", "left_semi").dropDuplicates(["fp"]), "sets")

    fps = common.stash(tried.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fps")
    sets = sets_of(fps)
    links = common.stash(verified(tried, sets, percent), "links")
    common.drop(sets, fps)
    comp = components(links)

    # lists of more than two classes, in different components: not all of their pairs were tried
    placed = classes.select("gid", "fp").join(comp, "fp", "left").select("gid", "fp", F.coalesce("comp", "fp").alias("comp"))
    of_groups = placed.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    open_lists = entries.filter("classes > 2").join(of_groups, "gid").groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("cell")
    inner = common.stash(entries.join(open_lists, "cell", "left_semi").select("cell", "gid"), "open")
    if not inner.isEmpty():
        centres = entries.join(open_lists, "cell", "left_semi").filter("first <> centre").select(F.col("centre").alias("a"), F.col("first").alias("b"))
        members = placed.join(inner.select("gid").distinct(), "gid", "left_semi")
        firsts = groups.select("gid", F.col("first.fp").alias("first"))
        ties = centres.unionByName(members.join(firsts, "gid").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))).distinct()
        named = common.stash(members.select("fp", "comp").join(components(ties).withColumnRenamed("comp", "family"), "fp"), "named")
        shares = named.groupBy("family", "comp").agg(F.count("*").alias("m"))
        families = shares.groupBy("family").agg(F.sum("m").alias("members"), F.count("*").alias("parts"), F.max(F.struct("m", "comp")).alias("home")).filter("parts > 1")
        blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
        sizes = families.select("family", blocks(F.col("members")).alias("bj"), blocks(F.col("members") - F.col("home.m")).alias("bi"), F.col("home.comp").alias("home"))
        of_families = common.stash(named.join(sizes, "family"), "families")
        sets = sets_of(of_families.select("fp").distinct())
        rest = of_families.join(sets, "fp")
        columns = ["place", "family", "i", "j", "side", "fp", "comp", "members"]
        few = F.pmod(F.xxhash64("family"), F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
        place = F.when((F.col("bi") == 1) & (F.col("bj") == 1), few).otherwise(F.col("family"))
        own = lambda n: F.pmod(F.xxhash64("fp"), n).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        outside = rest.filter("comp <> home").withColumns({"place": place, "i": own("bi"), "j": each("bj"), "side": F.lit(0)}).select(columns)
        whole = rest.withColumns({"place": place, "i": each("bi"), "j": own("bj"), "side": F.lit(1)}).select(columns)
        more = common.stash(outside.unionByName(whole).groupBy("place", "i", "j").applyInPandas(lambda pdf: _compare(pdf, percent), "a long, b long"), "found")
        common.drop(sets)
        if not more.isEmpty():
            # the components are stars by now, so fewer rounds are left than for all links
            comp = components(comp.select(F.col("comp").alias("a"), F.col("fp").alias("b")).unionByName(more))
        common.drop(named, of_families, more)
    common.drop(classes, groups, entries, tried, links, inner)

    out = rows.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    low = out.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = out.join(low, "comp", "left")
    return out.select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
