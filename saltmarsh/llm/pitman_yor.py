"""LM scoring (operator 3): a hierarchical Pitman-Yor model of words in their contexts, over one of their spelling.

Each word v is the restaurant of the words that follow it; all of these share one parent, the restaurant of words,
whose parent is the model of spelling, whose contexts of up to three symbols share parents alike. Each training token
is a customer of the context before it; tables are customers of the parent, and are drawn
by Gibbs sampling from their conditional given the parent's probabilities (generalised Stirling numbers, and a gamma
variable for each restaurant that makes its dishes independent); dishes of over 200 customers are seated in blocks. The spelling model is first seated by one table a word, and after burn-in by the tables drawn.
A text's score is the sum over its words and its end, each with the mean over the samples after burn-in of its
probability in its context; a context that training lacks is its parent. As for the base score, all words
that training lacks are one type. spelled_score has each such word's own probability instead.

Contexts are dealt by hash of v; each sweep sends tables up to the words' buckets and gets probabilities back. Words
are told apart by 64-bit hashes; a bucket is a range of hashes, so that sorted hashes are kept as differences. Chunks of
documents are stored once, as numbers and words; each sends its distinct pairs and words to their buckets once, when they
are counted. Where a chunk's pairs stand in their context, and the counts of its words, are kept for the scores. The spelling model has at most 64 symbols (frequent bytes, and one for all others), so 64^4 numbers bound what is broadcast.

`score` is thus the log10 probability of a text of known words and one type for all lacking words; the base score is
over the same events. A probability of each string itself is spelled_score.

Defined results: texts of any length are scored whole; equal counts and ties between words have no order that a result
depends on; null and empty texts are their end token alone; without training tokens every count is 0
and words are scored by spelling alone; repeated rows are trained on and scored one by one; other columns
are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import common

SYMBOLS = 64
#: Sweeps of the sampler, and how many of them are burnt.
SWEEPS, BURN_IN = 5, 2
#: Dishes up to this many customers are seated by their conditional, others in blocks.
EXACT = 200
#: Text bytes in one chunk of documents, and for each bucket of words.
CHUNK_BYTES, BUCKET_BYTES = 12 << 20, 12 << 20
CONCENTRATION = 1.0
#: Logarithms of a pair's probability are kept in steps of one in so many.
STEP = 8192


@cache
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logs of the generalised Stirling numbers: ways to seat c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = out[c] + np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def draw_mass(tables: np.ndarray, discount: float, concentration: float, rng: np.random.Generator) -> np.ndarray:
    """Log of the discount times a gamma variable of each restaurant. Given it, the table counts of a restaurant's dishes are independent, as prod_{i<T} (concentration + discount * i) is its expectation to the power T."""
    return np.log(discount * np.maximum(rng.gamma(concentration / discount + np.asarray(tables, float)), 1e-300))


def draw_tables(counts: np.ndarray, log_base: np.ndarray, mass: np.ndarray, tables: np.ndarray, discount: float, concentration: float, rng: np.random.Generator) -> np.ndarray:
    """New table counts of dishes, given base probabilities and the masses of their restaurants: p(t) is proportional to S(c, t) * (base * mass)^t.

    A dish of over EXACT customers is seated in blocks of an eighth, next to the tables that the rest of its restaurant had.
    """
    out = np.minimum(counts, 1).astype(np.int64)
    several = np.flatnonzero((counts > 1) & (counts <= EXACT))
    several = several[np.argsort(counts[several].astype(np.uint16), kind="stable")]
    for i in np.split(several, np.flatnonzero(np.diff(counts[several])) + 1) if len(several) else []:
        c = counts[i[0]]
        t = np.arange(1, c + 1)
        for part in np.array_split(i, max(1, len(i) * int(c) // 1_000_000 + 1)):
            logp = log_stirling(discount)[c, 1 : c + 1] + t * (log_base[part] + mass[part])[:, None]
            out[part] = 1 + np.argmax(logp + rng.gumbel(size=logp.shape), axis=1)
    large = np.flatnonzero(counts > EXACT)
    if len(large):
        c, base, rest = counts[large], np.exp(log_base[large]), tables[large]
        seated, t = np.ones(len(large), np.int64), np.ones(len(large), np.int64)
        while (seated < c).any():
            block = np.minimum(np.maximum(seated // 8, 1), c - seated)
            new = (concentration + discount * (rest + t)) * base
            t += rng.binomial(block, np.clip(new / (new + np.maximum(seated - discount * t, 1e-9)), 0, 1))
            seated += block
        out[large] = np.minimum(t, c)
    return out


def discount_of(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return float(np.clip((once + 0.5) / (once + 2 * twice + 1.0), 0.05, 0.95))


class Spelling:
    """What tasks need to spell words: a symbol for each byte, and predictive log-probabilities (context cell, symbol)."""

    def __init__(self, symbol: np.ndarray, predictive: np.ndarray):
        self.symbol, self.predictive = symbol, predictive
        sizes = np.bincount(symbol, minlength=SYMBOLS)
        self.share = -np.log(np.maximum(sizes, 1))[symbol]  # bytes of one symbol are alike

    def __getstate__(self) -> dict:
        return self.__dict__ | {"predictive": (self.predictive.shape, common.pack(self.predictive))}  # contexts that training lacks are alike

    def __setstate__(self, state: dict) -> None:
        shape, blob = state["predictive"]
        self.__dict__ |= state | {"predictive": common.unpack(blob, np.float32).reshape(shape)}

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Natural logs; the empty word is the end of a text."""
        if not words:
            return np.zeros(0)
        cells, symbols, data, first = spell(words, self.symbol)
        return np.add.reduceat(self.predictive[cells, symbols].astype(np.float64) + self.share[data], first)


def spell(words: list[bytes], symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context cell, symbol and byte at each place of some words with a closing space, and where each word begins. The context x, y, z is read from the space before."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    s = symbol[data].astype(np.int64)
    ends = np.flatnonzero(data == 0x20)
    first = np.concatenate([[0], ends[:-1] + 1])
    edge = int(symbol[0x20])
    place = np.arange(len(data)) - np.repeat(first, ends - first + 1)
    before = [np.where(place >= k, np.concatenate([np.full(k, edge), s])[: len(s)], edge) for k in (1, 2, 3)]
    return (before[0] * SYMBOLS + before[1]) * SYMBOLS + before[2], s, data, first


def _sample_subtree(counts: np.ndarray, levels: list[np.ndarray], root: np.ndarray, discounts: list[float], rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray]:
    """One sweep over the restaurants that end in one symbol: contexts of three, two and one. levels: their table counts; returns new ones and the predictive of the deepest."""
    shapes = [(1,), (SYMBOLS,), (SYMBOLS, SYMBOLS)]
    customers = [levels[1].sum(0, keepdims=True), levels[2].sum(1), counts]  # of levels one, two, three
    predictive = root[None, :]
    out = []
    for depth, (c, shape) in enumerate(zip(customers, shapes)):
        c, t = c.reshape(-1, SYMBOLS), levels[depth].reshape(-1, SYMBOLS)
        parent = np.repeat(predictive, c.shape[0] // predictive.shape[0], axis=0)
        d = discounts[depth]
        r, k = np.nonzero(c)
        rest = t.sum(1)[r] - t[r, k]
        new = np.zeros_like(t)
        new[r, k] = draw_tables(c[r, k], np.log(parent[r, k]), draw_mass(t.sum(1), d, CONCENTRATION, rng)[r], rest, d, CONCENTRATION, rng)
        total, all_t = c.sum(1, keepdims=True), new.sum(1, keepdims=True)
        predictive = (np.maximum(c - d * new, 0) + (CONCENTRATION + d * all_t) * parent) / (CONCENTRATION + total)
        out.append(new.reshape(*shape, SYMBOLS))
    return out, predictive


def sample_spelling(counts: DataFrame, spark: SparkSession, symbol: np.ndarray, discounts: list[float], sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 7) -> np.ndarray:
    """Averaged predictive probabilities, from rows (x, blob) with the counts of all contexts that end in symbol x. Subtrees are sampled side by side, given the root; the root is the driver's 64 numbers."""
    used = np.zeros(SYMBOLS)
    used[np.unique(symbol)] = 1
    uniform = used / used.sum()
    tables_of_root, root = np.zeros(SYMBOLS), np.maximum(uniform, 1e-12)
    state = counts.withColumn("tables", F.lit(None).cast("binary"))
    total = None

    for sweep in range(sweeps):

        def run(batches: Iterator[pd.DataFrame], root: np.ndarray = root, sweep: int = sweep) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for x, blob, tables in zip(pdf["x"], pdf["blob"], pdf["tables"]):
                    c = common.unpack(blob, np.uint32).astype(np.int64).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
                    if tables is None:
                        three = np.minimum(c, 1)
                        two = np.minimum(three.sum(1), 1)
                        levels = [np.minimum(two.sum(0, keepdims=True), 1), two, three]
                    else:
                        t = common.unpack(tables, np.int32).astype(np.int64)
                        levels = [t[:SYMBOLS].reshape(1, SYMBOLS), t[SYMBOLS : SYMBOLS + SYMBOLS**2].reshape(SYMBOLS, SYMBOLS), t[SYMBOLS + SYMBOLS**2 :].reshape(SYMBOLS, SYMBOLS, SYMBOLS)]
                    levels, predictive = _sample_subtree(c, levels, root, discounts, np.random.default_rng([seed, sweep, int(x)]))
                    packed = common.pack(np.concatenate([a.reshape(-1) for a in levels]).astype(np.int32))
                    out.append((x, blob, packed, common.pack(levels[0].reshape(-1).astype(np.int64)), common.pack(predictive.astype(np.float32))))
                yield pd.DataFrame(out, columns=["x", "blob", "tables", "up", "predictive"])

        new = common.stash(state.select("x", "blob", "tables").mapInPandas(run, "x int, blob binary, tables binary, up binary, predictive binary"), "sweep")
        customers = np.zeros(SYMBOLS, np.int64)
        for r in new.select("up").collect():
            customers += common.unpack(r.up, np.int64)
        rng = np.random.default_rng([seed, sweep])
        own = np.flatnonzero(customers)
        t = np.zeros(SYMBOLS)
        mass = np.full(len(own), draw_mass(tables_of_root.sum(), 0.5, CONCENTRATION, rng))
        t[own] = draw_tables(customers[own], np.log(np.maximum(uniform[own], 1e-12)), mass, tables_of_root.sum() - tables_of_root[own], 0.5, CONCENTRATION, rng)
        tables_of_root = t
        root = np.maximum((np.maximum(customers - 0.5 * t, 0) + (CONCENTRATION + 0.5 * t.sum()) * uniform) / (CONCENTRATION + customers.sum()), 1e-12)
        if sweep >= burn_in:
            if total is None:
                total = np.zeros((SYMBOLS**3, SYMBOLS), np.float32)
            seen = np.zeros(SYMBOLS, bool)
            for r in new.select("x", "predictive").toLocalIterator():
                total[r.x * SYMBOLS**2 : (r.x + 1) * SYMBOLS**2] += common.unpack(r.predictive, np.float32).reshape(-1, SYMBOLS)
                seen[r.x] = True
            for x in np.flatnonzero(~seen):  # a context that training lacks is its parent, the root
                total[x * SYMBOLS**2 : (x + 1) * SYMBOLS**2] += root.astype(np.float32)
        if "stash_path" in state.__dict__:
            common.drop(state)
        state = new
    common.drop(state)
    return np.log(np.maximum(total / (sweeps - burn_in), 1e-30)).astype(np.float32)


#: What stands before a text and after it, in place of a word's hash. The end is the last of hashes, as it is of a chunk's numbers, so that pairs stand in one order in chunks and contexts.
BEGIN, END = common.STEPS[50], np.uint64(2**64 - 1)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return common.word_hashes([b" ".join(words)], common.SPACED)[0]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The range of hashes that each is in."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts in order of their hashes, the number of each word of the texts, and the words of each text."""
    hashes, spans, sizes, at = [], [], [], 0
    for a, b in common.chunks(texts):
        h, starts, ends, before = common.word_hashes(texts[a:b], common.SPACED)
        hashes.append(h)
        spans.append(np.stack([starts, ends]).astype(np.int64) + at)
        sizes.append(np.diff(before))
        at += sum(map(len, texts[a:b])) + b - a
    h, (starts, ends) = np.concatenate(hashes), np.concatenate(spans, axis=1)
    wide = max(1, len(h).bit_length())
    order = (np.sort((h >> np.uint64(wide) << np.uint64(wide)) | np.arange(len(h), dtype=np.uint64)) & np.uint64((1 << wide) - 1)).astype(np.int64)
    ordered = h[order]
    if (ordered[1:] < ordered[:-1]).any():  # words that differ in the last bits of their hashes alone
        order = np.argsort(h, kind="stable")
        ordered = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    ids = np.empty(len(h), np.uint32)
    ids[order] = (np.cumsum(new) - 1).astype(np.uint32)
    joined = b"\n".join(texts).lower()
    where = order[first]
    words = [joined[x:y] for x, y in zip(starts[where].tolist(), ends[where].tolist())]
    return words, ids, np.concatenate(sizes).astype(np.int64)


def _pairs_of(ids: np.ndarray, sizes: np.ndarray, n_words: int) -> np.ndarray:
    """A code for each word of some texts and each text's end, after the word before: begin and end follow the words' numbers."""
    ends = np.cumsum(sizes)
    w = np.insert(ids.astype(np.int64), ends, n_words)
    v = np.concatenate([[n_words + 1], w[:-1]])
    v[(ends + np.arange(len(sizes)))[:-1] + 1] = n_words + 1
    return v * (n_words + 2) + w


def _chunked(docs: DataFrame) -> DataFrame:
    """Chunks of documents: their pickled ids, flags, sizes, word numbers and distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = common.as_bytes(batch.column("text"))
            doc_ids, held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            for a, b in common.chunks(texts, CHUNK_BYTES):
                words, ids, sizes = _numbered(texts[a:b])
                blob = pickle.dumps((doc_ids[a:b], held[a:b], common.pack_ints(sizes), common.pack_ints(ids), common.squeeze(b" ".join(words))))
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "docs"])
                chunk += 1

    return docs.mapInArrow(run, "chunk long, docs binary")


class Chunk:
    """The documents of one chunk, with their words in order of hashes."""

    def __init__(self, blob: bytes):
        self.doc_ids, self.held, sizes, ids, words = pickle.loads(blob)
        self.sizes, self.ids = common.unpack_ints(sizes).astype(np.int64), common.unpack_ints(ids).astype(np.int64)
        self.words = _words(words)
        self.known = ~np.array(self.held, bool)

    def codes(self) -> np.ndarray:
        return _pairs_of(self.ids, self.sizes, len(self.words))


def _word_parts(chunks: DataFrame, buckets: int) -> DataFrame:
    """The words of chunks by bucket, with their training counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, blob in zip(pdf["chunk"], pdf["docs"]):
                x = Chunk(blob)
                at = bucket_of(hashes_of(x.words), buckets)
                n = np.bincount(x.ids[np.repeat(x.known, x.sizes)], minlength=len(x.words)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
                out = [(number, int(at[i]), common.squeeze(b" ".join(x.words[i:j])), common.pack_ints(n[i:j])) for i, j in zip(cuts, cuts[1:]) if i < j]
                yield pd.DataFrame(out, columns=["chunk", "bucket", "words", "n"])

    return chunks.mapInPandas(run, "chunk long, bucket int, words binary, n binary")


def _pair_parts(chunks: DataFrame, buckets: int) -> DataFrame:
    """The distinct pairs of chunks by context (bucket of the first word): hashes, the places of first and second words in hashes, and training counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, blob in zip(pdf["chunk"], pdf["docs"]):
                x = Chunk(blob)
                hashes = np.append(hashes_of(x.words), [END, BEGIN])
                m = len(hashes)
                code = x.codes()
                pairs, which, _ = common.placed(code, (m * m).bit_length())
                pairs, k = pairs.astype(np.int64), np.bincount(which[np.repeat(x.known, x.sizes + 1)], minlength=len(pairs))
                v, w = pairs // m, pairs % m
                context = bucket_of(hashes, buckets)[v]  # words stand in order of their buckets, the begin is a part of its own
                cuts = [0, *(np.flatnonzero((np.diff(context) != 0) | ((v[1:] == m - 1) & (v[:-1] != m - 1))) + 1).tolist(), len(pairs)]
                out = []
                for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    own = common.distinct(np.concatenate([v[a:b], w[a:b]]))
                    at = [np.searchsorted(own, x[a:b]) for x in (v, w)]
                    out.append((number, j, int(context[a]), common.pack_sorted(hashes[own]), pickle.dumps((common.pack_sorted(at[0]), common.pack_ints(at[1]))), common.pack_ints(k[a:b])))
                yield pd.DataFrame(out, columns=["chunk", "part", "context", "hashes", "pairs", "k"])
                common.give_back()

    return chunks.mapInPandas(run, "chunk long, part int, context int, hashes binary, pairs binary, k binary")


def _unpaired(pairs: bytes) -> tuple[np.ndarray, np.ndarray]:
    v, w = pickle.loads(pairs)
    return common.unpack_sorted(v).astype(np.int64), common.unpack_ints(w).astype(np.int64)


def coarse(p: np.ndarray) -> np.ndarray:
    """Bits of 32-bit floats without their last ten: 13 of 23 bits of the fraction are kept, which changes it by 1 in 16,384 at most."""
    return (p.astype(np.float32).view(np.uint32) + np.uint32(1 << 9)) >> np.uint32(10)


def fine(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint32) << np.uint32(10)).view(np.float32)


class Contexts:
    """The restaurants of one bucket: each first word v is one, its dishes are the words w that follow it. Dishes without customers are there to be scored. All arrays follow from the sorted codes of the pairs."""

    @classmethod
    def of(cls, hashes: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], k: list[np.ndarray]) -> Contexts:
        self = cls()
        self.all_hashes = common.distinct(np.concatenate(hashes))
        at = [np.searchsorted(self.all_hashes, h) for h in hashes]
        size = len(self.all_hashes)
        code = np.concatenate([a[v] * size + a[w] for a, (v, w) in zip(at, pairs)])
        self.code, which, _ = common.placed(code, (size * size).bit_length())
        self.parts = np.split(which, np.cumsum([len(v) for v, _ in pairs])[:-1])
        self.k = np.bincount(which, weights=np.concatenate(k), minlength=len(self.code)).astype(np.int64)
        self.t = np.minimum(self.k, 1)
        self.sum = np.zeros(len(self.code), np.float32)
        return self._placed()

    def _placed(self) -> Contexts:
        size = np.uint64(len(self.all_hashes))
        v = self.code // size
        w = (self.code - v * size).astype(np.int64)
        self.room = np.cumsum(np.diff(v, prepend=v[:1]) != 0)
        used = np.zeros(int(size), bool)
        used[w] = True
        self.hashes, self.word = self.all_hashes[used], (np.cumsum(used) - 1)[w]
        return self

    def pack(self) -> bytes:
        """What stays: the pairs and their customers."""
        return pickle.dumps([common.pack_sorted(self.all_hashes), common.pack_sorted(self.code), common.pack_ints(self.k)])

    def pack_seats(self) -> bytes:
        """What a sweep changes: tables, and sums of probabilities."""
        return pickle.dumps([common.pack_ints(self.t), common.pack_ints(coarse(self.sum))])

    def pack_means(self) -> bytes:
        """Negative logarithms of the pairs' mean probabilities, in steps."""
        return common.pack_ints(np.rint(np.maximum(-np.log10(np.maximum(self.sum / (SWEEPS - BURN_IN), 1e-30)), 0) * STEP).astype(np.int64))

    @classmethod
    def unpack(cls, blob: bytes, seats: bytes | None = None) -> Contexts:
        """Without seats: one table a dish."""
        self = cls()
        hashes, code, k = pickle.loads(blob)
        self.all_hashes, self.code, self.k = common.unpack_sorted(hashes), common.unpack_sorted(code), common.unpack_ints(k).astype(np.int64)
        if seats is None:
            self.t, self.sum = np.minimum(self.k, 1), np.zeros(len(self.code), np.float32)
        else:
            t, total = pickle.loads(seats)
            self.t, self.sum = common.unpack_ints(t).astype(np.int64), fine(common.unpack_ints(total))
        return self._placed()

    def places(self, hashes: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Where pairs of words stand."""
        at = np.searchsorted(self.all_hashes, hashes)  # unsorted only by the begin
        return np.searchsorted(self.code, (at[v] * len(self.all_hashes) + at[w]).astype(np.uint64))

    def up(self) -> np.ndarray:
        """Tables of each word, customers of the restaurant of words."""
        return np.bincount(self.word, weights=self.t, minlength=len(self.hashes)).astype(np.int64)

    def sweep(self, base: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
        """Seats all customers anew; gives the probability of each dish in its context."""
        p, room, c = base[self.word], self.room, self.k
        own = np.flatnonzero(c)
        new = np.zeros_like(c)
        tables = np.bincount(room, weights=self.t)
        mass = draw_mass(tables, discount, CONCENTRATION, rng)[room]
        new[own] = draw_tables(c[own], np.log(p[own]), mass[own], (tables[room] - self.t)[own], discount, CONCENTRATION, rng)
        self.t = new
        return (np.maximum(c - discount * new, 0) + (CONCENTRATION + discount * np.bincount(room, weights=new)[room]) * p) / (CONCENTRATION + np.bincount(room, weights=c)[room])


def _vocabulary(pdf: pd.DataFrame) -> pd.DataFrame:
    """The training words of one bucket with their counts; also counts of counts and of bytes. For each chunk: the counts of its words, and the words that training lacks."""
    total: dict[bytes, int] = {}
    for words, n in zip(pdf["words"], pdf["n"]):
        for w, k in zip(_words(words), common.unpack_ints(n).tolist()):
            if k:
                total[w] = total.get(w, 0) + k
    n = np.array(list(total.values()), np.int64)
    joined = b" ".join(total)
    letters = np.bincount(np.frombuffer(joined, np.uint8), minlength=256).astype(np.int64)
    bucket = int(pdf["bucket"].iloc[0])
    out = [(bucket, common.squeeze(joined), common.pack_ints(n), int(n.sum()), len(n), int((n == 1).sum()), int((n == 2).sum()), common.pack(letters), None, None)]
    for chunk, words in zip(pdf["chunk"], pdf["words"]):
        ws = _words(words)
        own = [total.get(w, 0) for w in ws]
        lacking = b" ".join(w for w, k in zip(ws, own) if not k)
        out.append((bucket, None, common.pack_ints(np.array(own, np.int64)), 0, 0, 0, 0, None, chunk, common.squeeze(lacking)))
    return pd.DataFrame(out, columns=[f.split()[0] for f in WORDS.split(", ")])


def _words(blob: bytes) -> list[bytes]:
    joined = bytes(common.unsqueeze(blob))
    return joined.split(b" ") if joined else []


def _discount(once: float, twice: float) -> float:
    return float(np.clip((once + 0.5) / (once + 2 * twice + 1.0), 0.05, 0.95))


def _train_spelling(tables: DataFrame, symbol: np.ndarray, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> Spelling:
    """The model of spelling from rows (words, t): each word comes as often as it has tables in the restaurant of words."""

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SYMBOLS**4, np.uint32)
        for pdf in batches:
            for blob, t in zip(pdf["words"], pdf["t"]):
                if ws := _words(blob):
                    cells, s, _, first = spell(ws, symbol)
                    times = np.repeat(common.unpack_ints(t).astype(np.int64), np.diff([*first, len(s)]))
                    at, which, _ = common.placed(cells * SYMBOLS + s, (SYMBOLS**4).bit_length())
                    counts[at] += np.bincount(which, weights=times).astype(np.uint32)
        yield pd.DataFrame(common.slots(counts, SYMBOLS), columns=["slot", "blob"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(SYMBOLS**3, np.uint32)
        for b in pdf["blob"]:
            c += common.unpack(b, np.uint32)
        return pd.DataFrame({"x": [int(pdf["slot"].iloc[0])], "blob": [common.pack(c)], "once": [int((c == 1).sum())], "twice": [int((c == 2).sum())]})

    counts = common.stash(tables.select("words", "t").mapInPandas(spelled, "slot int, blob binary").groupBy("slot").applyInPandas(added, "x int, blob binary, once long, twice long"), "letters")
    seen = counts.agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).first()
    predictive = sample_spelling(counts.select("x", "blob"), tables.sparkSession, symbol, [0.5, 0.5, _discount(seen.once or 0, seen.twice or 0)], sweeps, burn_in)
    common.drop(counts)
    return Spelling(symbol, predictive)


def _ups(context: int, hashes: np.ndarray, up: np.ndarray, buckets: int) -> list[tuple]:
    """Rows that send the tables of words up to the words' buckets."""
    at = bucket_of(hashes[hashes != END], buckets)  # in order, as hashes are
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    return [(UPS, context, int(at[i]), None, common.pack_sorted(hashes[i:j]), common.pack_ints(up[i:j]), 0, 0, 0) for i, j in zip(cuts, cuts[1:]) if i < j]


#: Kinds of rows about contexts, each in its own folder: their state, the tables they send up, and where chunks' pairs stand in them.
STATE, UPS, PLACES = 0, 1, 2
WORDS = "bucket int, words binary, n binary, tokens long, types long, once long, twice long, letters binary, chunk long, lacking binary"
ROOMS = "kind int, context int, bucket int, state binary, hashes binary, up binary, ends long, once long, twice long"
BUILT = ROOMS + ", chunk long, part int, places binary"


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score; docs: (doc_id, text, held_out)."""
    spark = docs.sparkSession
    common.batch_rows(spark, 5000)  # chunks are parts of batches
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(spark.sparkContext.defaultParallelism, size // BUCKET_BYTES + 1))
    texts = common.stash(_chunked(docs), "chunks")
    stored = common.stash(_word_parts(texts, buckets).groupBy("bucket").applyInPandas(_vocabulary, WORDS), "vocabulary")
    words = stored.filter("chunk is null")
    facts = words.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types"))).first()
    ends = docs.filter("not held_out").count()
    n_tokens, n_types = facts.tokens + ends, facts.types + (ends > 0)

    letters = np.zeros(256, np.int64)
    for r in words.select("letters").toLocalIterator():
        letters += common.unpack(r.letters, np.int64)
    letters[0x20] = facts.types + 1  # each word ends
    common_bytes = np.argsort(-letters, kind="stable")[: SYMBOLS - 1]
    symbol = np.full(256, SYMBOLS - 1, np.int64)
    symbol[common_bytes[letters[common_bytes] > 0]] = np.arange((letters[common_bytes] > 0).sum())

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = Contexts.of([common.unpack_sorted(h) for h in pdf["hashes"]], [_unpaired(p) for p in pdf["pairs"]], [common.unpack_ints(k) for k in pdf["k"]])
        up, bucket = x.up(), int(pdf["context"].iloc[0])
        mine = (STATE, bucket, None, x.pack(), None, None, int(up[x.hashes == END].sum()), int((x.k == 1).sum()), int((x.k == 2).sum()), None, None, None)
        out = [mine, *(r + (None, None, None) for r in _ups(bucket, x.hashes, up, buckets))]
        out += [(PLACES, bucket, None, None, None, None, 0, 0, 0, chunk, part, common.pack_sorted(at)) for chunk, part, at in zip(pdf["chunk"], pdf["part"], x.parts)]
        del x
        common.give_back()
        return pd.DataFrame(out, columns=[f.split()[0] for f in BUILT.split(", ")])

    common.free_shuffles(spark, 0.05)
    fixed = rooms = common.stash(_pair_parts(texts, buckets).groupBy("context").applyInPandas(build, BUILT), "rooms", "kind")
    common.free_shuffles(spark, 0.05)
    seen = rooms.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("once", "twice"))).first()
    discount = _discount(seen.once, seen.twice)

    def one_table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"words": pdf["words"], "t": [common.pack_ints(np.ones(len(common.unpack_ints(n)), np.int64)) for n in pdf["n"]]})

    ones = words.select("words", "n").mapInPandas(one_table, "words binary, t binary")
    spelling = spark.sparkContext.broadcast(_train_spelling(ones, symbol, 2, 1))
    state = words.select("bucket", "words", F.lit(None).cast("binary").alias("t"), F.lit(None).cast("binary").alias("base"))
    tables, end_tables, d = float(facts.types), 1.0, 0.5
    for sweep in range(SWEEPS):
        # the restaurant of words: its customers are the tables of the contexts
        end_customers = int(rooms.agg(F.sum("ends")).first()[0] or 0)
        mass = float(draw_mass(tables, d, CONCENTRATION, np.random.default_rng([19, sweep])))

        def seat(left: pd.DataFrame, right: pd.DataFrame, *, sweep: int = sweep, tables: float = tables, mass: float = mass, d: float = d, spelling=spelling) -> pd.DataFrame:
            out = []
            for r in left.itertuples(index=False):
                ws = _words(r.words)
                hashes = hashes_of(ws)
                order = np.argsort(hashes)
                n = np.zeros(len(ws), np.int64)
                for h, up in zip(right["hashes"], right["up"]):
                    h, up = common.unpack_sorted(h), common.unpack_ints(up)
                    if len(ws):
                        i = order[np.minimum(np.searchsorted(hashes, h, sorter=order), len(ws) - 1)]
                        same = hashes[i] == h
                        n[i[same]] += up[same]
                old = np.ones(len(ws), np.int64) if r.t is None else common.unpack_ints(r.t).astype(np.int64)
                base = spelling.value.log_probability(ws) if r.base is None else common.unpack(r.base, np.float64)
                t = draw_tables(n, base, np.full(len(n), mass), np.maximum(tables - old, 0), d, CONCENTRATION, np.random.default_rng([11, sweep, int(r.bucket)])) if len(ws) else n
                out.append((r.bucket, r.words, common.pack_ints(t), common.pack_ints(n), common.pack(base), common.pack_sorted(hashes), int(n.sum()), int(t.sum()), int((n == 1).sum()), int((n == 2).sum()), float(np.exp(base).sum())))
            return pd.DataFrame(out, columns=["bucket", "words", "t", "n", "base", "hashes", "customers", "tables", "once", "twice", "spelled"])

        ups = rooms.filter(F.col("kind") == UPS).select("context", "bucket", "hashes", "up")
        last = state if sweep else None
        state = common.stash(state.select("bucket", "words", "t", F.lit(None).cast("binary").alias("base") if sweep == BURN_IN else "base").groupBy("bucket").cogroup(ups.groupBy("bucket")).applyInPandas(seat, "bucket int, words binary, t binary, n binary, base binary, hashes binary, customers long, tables long, once long, twice long, spelled double"), "seats")
        sums = state.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("customers", "tables", "once", "twice", "spelled"))).first()
        if last is not None:
            common.drop(last)
        end_base = float(spelling.value.log_probability([b""])[0])
        if end_customers:
            one = lambda x, t: np.array([x], t)
            end_tables = float(draw_tables(one(end_customers, np.int64), one(end_base, float), one(mass, float), one(float(sums.tables), float), d, CONCENTRATION, np.random.default_rng([13, sweep]))[0])
        else:
            end_tables = 0.0
        tables, norm = float(sums.tables) + end_tables, CONCENTRATION + sums.customers + end_customers
        new_table = (CONCENTRATION + d * tables) / norm
        end_p = max(0.0, end_customers - d * end_tables) / norm + new_table * np.exp(end_base)
        # words that training lacks are one type
        lacking = max(1e-9, 1.0 - float(sums.spelled) - float(np.exp(end_base)))

        def offer(left: pd.DataFrame, right: pd.DataFrame, *, d: float = d, norm: float = norm, new_table: float = new_table, lacking: float = lacking) -> pd.DataFrame:
            known, p = np.zeros(0, np.uint64), np.zeros(0)
            for r in right.itertuples(index=False):
                known, n, t, base = common.unpack_sorted(r.hashes), common.unpack_ints(r.n).astype(np.int64), common.unpack_ints(r.t), common.unpack(r.base, np.float64)
                order = np.argsort(known)
                known, p = known[order], (np.maximum(n - d * t, 0) / norm + new_table * np.exp(base))[order]
            out = []
            for r in left.itertuples(index=False):
                h = common.unpack_sorted(r.hashes)
                got = np.full(len(h), new_table * lacking, np.float32)
                if len(known):
                    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    got = np.where(known[i] == h, p[i], got).astype(np.float32)
                out.append((r.context, r.bucket, common.pack_ints(got.view(np.uint32))))
            return pd.DataFrame(out, columns=["context", "bucket", "p"])

        offers = ups.select("context", "bucket", "hashes").groupBy("bucket").cogroup(state.select("bucket", "t", "n", "base", "hashes").groupBy("bucket")).applyInPandas(offer, "context int, bucket int, p binary")
        offers = common.stash(offers, "offers")
        common.drop(rooms, part=f"kind={UPS}")

        def reseat(left: pd.DataFrame, right: pd.DataFrame, *, sweep: int = sweep, end_p: float = end_p) -> pd.DataFrame:
            bucket = int(left["context"].iloc[0])
            x = Contexts.unpack(left["state"].dropna().iloc[0], next(iter(left["seats"].dropna()), None))
            base = np.full(len(x.hashes), end_p)
            at = np.where(x.hashes == END, buckets, bucket_of(x.hashes, buckets))  # in order
            for b, p in zip(right["bucket"], right["p"]):
                base[np.searchsorted(at, b) : np.searchsorted(at, b, "right")] = common.unpack_ints(p).view(np.float32)
            p = x.sweep(base, discount, np.random.default_rng([17, sweep, bucket]))
            if sweep >= BURN_IN:
                x.sum = (x.sum + p).astype(np.float32)
            up = x.up()
            # after the last sweep only the pairs' probabilities are asked for
            mine = (STATE, bucket, None, x.pack_seats() if sweep < SWEEPS - 1 else x.pack_means(), None, None, int(up[x.hashes == END].sum()), 0, 0)
            hashes = x.hashes
            del x, p, base
            common.give_back()
            return pd.DataFrame([mine, *(_ups(bucket, hashes, up, buckets) if sweep < SWEEPS - 1 else [])], columns=[f.split()[0] for f in ROOMS.split(", ")])

        none = F.lit(None).cast("binary")
        own = fixed.filter(F.col("kind") == STATE).select("context", "state", none.alias("seats"))
        if sweep:
            own = own.unionByName(rooms.filter(F.col("kind") == STATE).select("context", none.alias("state"), F.col("state").alias("seats")))
        new = common.stash(own.groupBy("context").cogroup(offers.groupBy("context")).applyInPandas(reseat, ROOMS), "rooms", "kind")
        common.drop(offers, *([rooms] if sweep else []))
        rooms, d = new, _discount(sums.once, sums.twice)
        if sweep == BURN_IN - 1:  # from here on, letters are seated by the tables that were drawn
            spelling.destroy()
            spelling = spark.sparkContext.broadcast(_train_spelling(state, symbol))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of words: training counts, and what spelling says of those that training lacks, given that they are lacking."""
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                n = common.unpack_ints(r.n)
                more = np.zeros(len(n))
                more[n == 0] = (spelling.value.log_probability(_words(r.lacking)) - np.log(lacking)) / np.log(10)
                out.append((r.chunk, r.bucket, None, r.n, common.pack(more.astype(np.float32))))
            yield pd.DataFrame(out, columns=["chunk", "bucket", "part", "n", "logp"])

    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Of pairs: the mean over the samples of the second word's probability after the first."""
        logp = common.unpack_ints(right["state"].iloc[0])
        out = [(r.chunk, None, r.part, None, common.pack_ints(logp[common.unpack_sorted(r.places).astype(np.int64)])) for r in left.itertuples(index=False)]
        return pd.DataFrame(out, columns=["chunk", "bucket", "part", "n", "logp"])

    common.free_shuffles(spark)
    schema = "chunk long, bucket int, part int, n binary, logp binary"
    answers = stored.filter("chunk is not null").select("chunk", "bucket", "n", "lacking").mapInPandas(answer, schema)
    answers = answers.unionByName(fixed.filter(F.col("kind") == PLACES).select("chunk", "part", "context", "places").groupBy("context").cogroup(rooms.filter(F.col("kind") == STATE).select("context", "state").groupBy("context")).applyInPandas(found, schema))
    answers = common.stash(answers, "answers")
    common.drop(rooms, state, stored, fixed)
    unit = float(n_tokens + n_types + 1)

    def total(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of_words, of_pairs = right[right["bucket"].notna()].sort_values("bucket"), right[right["part"].notna()].sort_values("part")
        n = np.concatenate([np.zeros(0, np.int64), *(common.unpack_ints(b) for b in of_words["n"])]).astype(np.int64)
        more = np.concatenate([np.zeros(0), *(common.unpack(b, np.float32) for b in of_words["logp"])])
        logp = -np.concatenate([common.unpack_ints(b) for b in of_pairs["logp"]]).astype(np.float64) / STEP
        base = np.log10((n + 1) / unit)
        x = Chunk(left["docs"].iloc[0])
        sizes, ids = x.sizes, x.ids
        which = common.placed(x.codes(), ((len(x.words) + 2) ** 2).bit_length())[1]
        sums = lambda a: np.diff(np.concatenate([[0], np.cumsum(a)])[np.concatenate([[0], np.cumsum(sizes)])])
        score = np.add.reduceat(logp[which], np.cumsum(sizes + 1) - sizes - 1)
        out = {"doc_id": pd.array(x.doc_ids, "Int64"), "held_out": x.held, "n_tokens": sizes + 1, "n_known": sums(n[ids] > 0) + (ends > 0), "train_tokens": n_tokens}
        return pd.DataFrame(out | {"base_score": sums(base[ids]) + np.log10((ends + 1) / unit), "score": score, "spelled_score": score + sums(more[ids])})

    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (common.remainder("doc_id", 7) == 2).alias("held_out")))
