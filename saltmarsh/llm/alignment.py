"""Cross-tokenizer alignment (operator 11): which tokens of two encodings of a text cover the same bytes.

Both encodings are of a space and the text. Their tokens' ends, summed up, are two rising lists of byte offsets; a merge
of the two gives the groups (between offsets where both end) and the links (a token of each that overlap: one for each
distinct offset of the merged list). Links are counted in Spark by the number of documents that have them; each pair's
count and the largest counts of both its sides are joined back.

A text is cut before a space that follows a character which isn't white space. No token of either vocabulary crosses
such a place (checked when the vocabularies are read), so a text's groups and links are those of its segments, one
after another, and a segment that comes again isn't encoded again.

Tasks describe chunks of documents: a row for each document, one with the chunk's links by document in packed arrays,
and the chunk's distinct pairs with their numbers of documents. Only pairs are shuffled, a row for each chunk and pair.

Defined results: a null or empty text, or one whose bytes an encoding doesn't keep (such as U+2581, which one of the
vocabularies takes for a space), has no tokens: zeros and ''; texts of any length are read whole, one longer than a
chunk is a chunk; repeated rows, also under one doc_id, are documents of their own; ties for the largest count are all
the largest; a null doc_id stays null; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import common
from saltmarsh.llm.packing import Encoder
from saltmarsh.llm.tokens import vocabulary_path

#: Links in one chunk of documents; distinct segments that a task keeps.
CHUNK_LINKS, KEPT_SEGMENTS = 3_000_000, 400_000
#: Text that a task encodes at once, in characters.
AT_ONCE = 1 << 20
#: A segment: a space, and what follows up to the next space after a character that isn't white space.
SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*").findall
BLANK = "▁"


class Pieces:
    """Segments' ids and token bytes by a model of sentence pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        names = self.model.id_to_piece(list(range(n)))
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self.blank = self.model.piece_to_id(BLANK)
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in names):
            raise ValueError("pieces cross the ends of words: segments can't be encoded alone")

    def encode(self, segments: list[str]) -> list[list[int]]:
        """The model itself adds the first space."""
        return [ids or [self.blank] for ids in self.model.encode([s[1:] for s in segments], num_threads=1)]


class Segments:
    """What the merge says of each distinct segment: numbers of tokens, groups and links, the links' pairs, the text of the groups."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = Encoder(a_path), Pieces(b_path)
        self.a_bytes = {i: t for t, i in self.a.base.ids.items()}
        self.a_len = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_len[list(self.a_bytes)] = [len(t) for t in self.a_bytes.values()]
        self.b_len = np.array([len(x) for x in self.b.bytes], np.int64)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.texts: list[str] = []
        #: of each segment: tokens of both kinds, groups, links (-1: the bytes differ)
        self.facts = np.zeros((0, 4), np.int64)
        self.first, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.a.known.clear()

    def learn(self, segments: list[str]) -> None:
        """Encodes new segments and merges their tokens' ends."""
        ids_a = [np.frombuffer(self._plain(s), np.uint32).astype(np.int64) for s in segments]
        ids_b = self.b.encode(segments)
        good = np.array([b"".join(map(self.b.bytes.__getitem__, b)) == s.encode() == b"".join(map(self.a_bytes.__getitem__, a.tolist())) for s, a, b in zip(segments, ids_a, ids_b)])
        na, nb = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
        # a segment that an encoding changes has no offsets in common
        na, nb = np.where(good, na, 0), np.where(good, nb, 0)
        a = np.concatenate([np.zeros(0, np.int64), *(x for x, g in zip(ids_a, good) if g)])
        b = np.fromiter(chain.from_iterable(x for x, g in zip(ids_b, good) if g), np.int64)
        # all segments stand one after another, so the ends rise over all of them
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        both = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, both), np.searchsorted(ends_b, both)
        cut = (ends_a[at_a] == both) & (ends_b[at_b] == both)
        last = np.cumsum(na)
        of_link = np.searchsorted(last, at_a, "right")  # the segment of each link
        m = len(segments)
        links, groups = np.bincount(of_link, minlength=m), np.bincount(of_link[cut], minlength=m)
        facts = np.stack([na, nb, groups, np.where(good, links, -1)], 1)
        self.texts += self._written(a, b, ends_a, ends_b, both[cut], na, nb)
        for s in segments:
            self.place[s] = len(self.place)
        self.facts = np.concatenate([self.facts, facts])
        self.pairs = np.concatenate([self.pairs, a[at_a] << 16 | b[at_b]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(links)])

    def _plain(self, segment: str) -> bytes:
        """Strings of special tokens inside texts are plain text."""
        return b"".join(map(self.a.known.__getitem__, self.a.base.findall(segment)))

    @staticmethod
    def _written(a, b, ends_a, ends_b, cuts, na, nb) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each segment: ids of the first kind, then of the second, group by group."""
        if not len(a):
            return [""] * len(na)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=len(cuts)))])
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=len(cuts)))])
        ids, follows = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ",")
        at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + before_a[group_b + 1]
        ids[at_a], ids[at_b] = a, b
        follows[at_a[np.flatnonzero(np.append(group_a[1:] != group_a[:-1], True))]] = "|"
        follows[at_b[np.flatnonzero(np.append(group_b[1:] != group_b[:-1], True))]] = ";"
        words = [f"{i}{s}" for i, s in zip(ids.tolist(), follows.tolist())]
        ends = np.cumsum(na + nb).tolist()
        return ["".join(words[lo:hi])[:-1] for lo, hi in zip([0, *ends[:-1]], ends)]

    def described(self, texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        """Of each text its facts and the hash of its groups; of all links the text's number and the pair."""
        if len(self.place) > KEPT_SEGMENTS:
            self.clear()
        cut = [SEGMENT(" " + t) if t else [] for t in texts]
        new = list(dict.fromkeys(s for segments in cut for s in segments if s not in self.place))
        if new:
            self.learn(new)
        place, wrote = self.place.__getitem__, self.texts.__getitem__
        at = [list(map(place, segments)) for segments in cut]
        of = np.repeat(np.arange(len(texts)), [len(x) for x in at])
        flat = np.fromiter(chain.from_iterable(at), np.int64, len(of))
        bad = np.bincount(of[self.facts[flat, 3] < 0], minlength=len(texts)) > 0
        use = ~bad[of]
        of, flat = of[use], flat[use]
        facts = np.stack([np.bincount(of, weights=self.facts[flat, c], minlength=len(texts)).astype(np.int64) for c in range(4)], 1) if len(of) else np.zeros((len(texts), 4), np.int64)
        hashes = [hashlib.sha256(";".join(map(wrote, x)).encode()).hexdigest() if x and not b else "" for x, b in zip(at, bad.tolist())]
        many = self.facts[flat, 3]
        total = np.cumsum(many)
        where = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(self.first[flat] - (total - many), many)
        return facts, hashes, np.repeat(of, many), self.pairs[where]


@cache
def segments(a_path: str, b_path: str) -> Segments:
    return Segments(a_path, b_path)


ROW = "chunk long, slot long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, linked binary, pairs binary, documents binary"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents (slot from 0 in their chunk), and a row for each chunk (slot -1): its links by document, its distinct pairs and their numbers of documents."""
    names = [x.split()[0] for x in ROW.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] + [pa.binary()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk = segments(a_path, b_path), TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # slots, pairs, times
        slot = links = 0

        def closed() -> pa.RecordBatch:
            slots, pairs, times = (np.concatenate(x) for x in zip(*held))
            distinct, place, having = common.placed(pairs, 33)
            sizes = np.bincount(slots, minlength=slot)
            steps = np.diff(place, prepend=0)  # within a document places rise
            first = (np.cumsum(sizes) - sizes)[sizes > 0]
            steps[first] = place[first]
            linked = [common.pack_ints(sizes), common.pack_ints(steps), common.pack_ints(times)]
            blob = b"".join(len(x).to_bytes(8, "little") + x for x in linked)
            row = [chunk, -1, *[None] * 6, blob, common.pack_sorted(distinct), common.pack_ints(having)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id")
            lo = 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size + len(texts[hi]) <= AT_ONCE:
                    size += len(texts[hi])
                    hi += 1
                facts, hashes, of, pairs = known.described(texts[lo:hi])
                distinct, times = np.unique(of << 33 | pairs, return_counts=True)
                held.append(((distinct >> 33) + slot, distinct & ((1 << 33) - 1), times))
                m = hi - lo
                columns = [pa.array([chunk] * m, pa.int64()), pa.array(np.arange(slot, slot + m)), ids.slice(lo, m), *(pa.array(facts[:, c]) for c in range(4)), pa.array(hashes, pa.string()), *(pa.nulls(m, pa.binary()) for _ in range(3))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                slot, links, lo = slot + m, links + len(of), hi
                if links >= CHUNK_LINKS:
                    yield closed()
                    held.clear()
                    chunk, slot, links = chunk + 1, 0, 0
        if held:
            yield closed()
        common.give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROW)


def chunk_pairs(described: DataFrame) -> DataFrame:
    """A row (chunk, place, a, b, n) for each distinct pair of a chunk: n of the chunk's documents link it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, having in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "documents"))):
                pairs, having = common.unpack_sorted(pairs).astype(np.int64), common.unpack_ints(having).astype(np.int64)
                for lo in range(0, len(pairs), 50_000):
                    p, n = pairs[lo : lo + 50_000], having[lo : lo + 50_000]
                    columns = [np.full(len(p), chunk), np.arange(lo, lo + len(p), dtype=np.int32), (p >> 16).astype(np.int32), (p & 0xFFFF).astype(np.int32), n]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["chunk", "place", "a", "b", "n"])

    return described.filter("slot = -1").select("chunk", "pairs", "documents").mapInArrow(run, "chunk long, place int, a int, b int, n long")


def _of_documents(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The sums over a chunk's links, by document."""
    docs = left[left["slot"] >= 0].sort_values("slot")
    blob, parts = left.loc[left["slot"] < 0, "linked"].iloc[0], []
    while blob:
        n = 8 + int.from_bytes(blob[:8], "little")
        parts.append(common.unpack_ints(blob[8:n]).astype(np.int64))
        blob = blob[n:]
    sizes, place, times = parts
    first = np.cumsum(sizes) - sizes
    place = np.cumsum(place)
    start = np.where(first > 0, place[np.maximum(first - 1, 0)] if len(place) else 0, 0)
    place -= np.repeat(start, sizes)
    right = right.sort_values("place")
    count, best_a, best_b = (right[c].to_numpy(np.int64)[place] * times for c in ("count", "best_a", "best_b"))
    running = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.append(first, len(x))])
    out = docs[["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].assign(n_best=running(best_a), count_sum=running(count), n_best_b=running(best_b))
    common.give_back()
    return out


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_b, count_sum, groups_sha256 of each document."""
    common.batch_rows(docs.sparkSession)
    described = common.stash(aligned(docs, a_path, b_path), "aligned")
    pairs = chunk_pairs(described)
    counts = common.stash(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair_counts")
    best_a, best_b = (counts.groupBy(c).agg(F.max("count").alias(f"most_{c}")) for c in ("a", "b"))
    facts = counts.join(best_a, "a").join(best_b, "b").select("a", "b", "count", *((F.col("count") == F.col(f"most_{c}")).cast("int").alias(f"best_{c}") for c in ("a", "b")))
    told = pairs.drop("n").join(facts, ["a", "b"]).select("chunk", "place", "count", "best_a", "best_b")
    of_chunks = described.drop("pairs", "documents").groupBy("chunk").cogroup(told.groupBy("chunk"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, n_best_b long"
    return of_chunks.applyInPandas(_of_documents, schema)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"), vocabulary_path(), vocabulary_path("piece_bpe_32k.model"))
