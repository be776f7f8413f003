"""Suffix-array dedup (operator 5): a distributed difference-cover sort of suffixes finds every repeated string.

A string of LEAST bytes that starts at two places is removed at both. Texts are cut where the hash of 8 bytes is
a strict minimum among its neighbours, so equal strings have equal cuts inside; suffixes start at cuts and their
symbols are the phrases between cuts (64-bit hashes; equal hashes count as equal phrases).

1. Phrases whose place in the text is 1 or 2 modulo 3, the difference cover, are sampled. Their triples are sorted,
   each bucket of tasks a range of the order, and get their rank as a name; a triple that occurs once gets none.
2. The same again on names: triples of names three places apart are sorted and named, which spans nine phrases.
   That is as deep as suffixes of LEAST bytes go, as phrases have at least 17 bytes.
3. Remaining suffixes are merged: two suffixes of any places have sampled places 0, 1 or 2 phrases on, in both. So
   the phrases before it and the names from it on order them; each suffix goes to the two lists that it can need.
4. Adjacent prefixes are compared. Those alike in all phrases and in the phrases around them are repeated at every
   byte. Where only the phrases inside agree, the strings at each byte are compared themselves, by 64-bit hashes.

Strings with fewer than two cuts inside go to the last comparison at once, so texts without cuts lose nothing.
Shorter passages are only reported: n_passage counts the bytes in runs of PASSAGE bytes or more where each named
triple of phrases starts elsewhere, too. None is removed, and one in the bytes that two pieces share isn't counted.

Defined results: null and empty texts have no bytes, nothing is removed and the hash is that of no bytes; texts
shorter than LEAST are kept whole; repeated rows repeat all their strings; other columns are not read; an empty
table gives an empty table. Very long texts are handled in pieces that overlap by LEAST - 1 bytes.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm import common
from saltmarsh.llm.decontam import bits_of, passes

LEAST = 400
#: Repeated triples of phrases are reported if they cover so many bytes side by side; about 30 words.
PASSAGE = 180
#: A cut's hash covers so many bytes, and is the least of so many on either side.
GRAM, SIDE = 8, 16
#: Text in one piece, and in one chunk of pieces, in bytes.
PIECE = CHUNK = 2 << 20
#: Text bytes for each bucket of the order.
BUCKET_BYTES = 16 << 20
#: Names are a bucket and a rank in it.
RANK_BITS = 40

U = np.uint64
INVERSE = U(pow(int(common.POWER), -1, 1 << 64))
_inverses = np.ones(1, U)


def inverses(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        _inverses = np.concatenate([np.ones(1, U), np.cumprod(np.full(n, INVERSE, U))])
    return _inverses


class Hashes:
    """Hashes of any part of a text."""

    def __init__(self, text: bytes):
        n = len(text)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(common.BYTE_KEYS[np.frombuffer(text, np.uint8)] * common.powers(n + 1)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        shift = inverses(len(self.sums))
        return common.mix((self.sums[stop] - self.sums[start]) * shift[start] + (stop - start).astype(U) * common.STEPS[3])

    def windows(self, size: int) -> np.ndarray:
        """Of all parts of one size."""
        n = len(self.sums) - size
        return common.mix((self.sums[size:] - self.sums[:n]) * inverses(len(self.sums))[:n]) if n > 0 else np.zeros(0, U)


def cuts_of(h: Hashes) -> np.ndarray:
    """Places whose 8 bytes have a hash below that of the 16 places on either side."""
    g = h.windows(GRAM)
    if len(g) <= 2 * SIDE:
        return np.zeros(0, np.int64)
    low, width = g, 1
    while width < SIDE:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    n = len(g) - 2 * SIDE
    inner = g[SIDE : SIDE + n]
    return np.flatnonzero((inner < low[:n]) & (inner < low[SIDE + 1 : SIDE + 1 + n])) + SIDE


def phrases(pieces: list[bytes]) -> dict[str, np.ndarray]:
    """Of some pieces side by side: where phrases start and their symbols, the first phrase of each piece and where pieces end. What is before the first cut and after the last one are phrases with a mark."""
    h = Hashes(b"".join(pieces))
    stops = np.cumsum([len(x) for x in pieces])
    starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
    cuts = cuts_of(h)
    own = np.searchsorted(stops, cuts, "right")
    cuts = cuts[(cuts - SIDE >= starts[own]) & (cuts + SIDE + GRAM <= stops[own])]
    start = np.sort(np.concatenate([starts, cuts]))
    stop = np.append(start[1:], stops[-1])
    sym = h.of(start, stop)
    first = np.searchsorted(start, starts)
    last = np.append(first[1:], len(start)) - 1
    sym[first] = common.mix(sym[first] + common.STEPS[4])
    sym[last] = common.mix(sym[last] + common.STEPS[5])
    return {"start": start.astype(np.uint32), "sym": sym, "first": first.astype(np.uint32), "stops": stops.astype(np.uint32)}


def covered(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each phrase: its place in the text modulo 3, and the phrases of its piece from it on."""
    n, first = len(s["sym"]), s["first"].astype(np.int64)
    count = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, count)
    return place % 3, np.repeat(count, count) - place


def distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct rows, where each row is among them, how often each occurs, and its first row."""
    n = len(columns[0])
    order = np.lexsort(columns[::-1])
    sorted_columns = [c[order] for c in columns]
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    at = np.flatnonzero(new)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return [c[at] for c in sorted_columns], inverse, np.diff(np.append(at, n)), order[at]


def triples(s: dict[str, np.ndarray], names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sampled phrases whose triples are to be named, and the triples: of symbols, or of names three places apart."""
    mod, left = covered(s)
    if names == "sym":
        at, step = np.flatnonzero((mod != 0) & (left >= 3)), 1
    else:
        at, step = np.flatnonzero((mod != 0) & (left >= 9)), 3
    columns = [s[names][at + k * step] for k in range(3)]
    if names != "sym":
        known = np.logical_and.reduce([c != 0 for c in columns])
        at, columns = at[known], [c[known] for c in columns]
    return at, columns


def bucket_of(column: np.ndarray, buckets: int) -> np.ndarray:
    return ((column >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def questions(columns: list[np.ndarray], count: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sorted distinct rows, cut where the bucket changes."""
    table = np.stack([*columns, np.minimum(count, 2).astype(U)])
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(bucket)]) if len(bucket) else ():
        yield int(bucket[lo]), common.pack(table[:, lo:hi])


def answered(pdf: pd.DataFrame, how) -> pd.DataFrame:
    """Gathers one bucket's rows of all chunks, and sends each chunk an answer for each of its rows."""
    tables = [common.unpack(b, U).reshape(int(w), -1) for b, w in zip(pdf["blob"], pdf["width"])]
    sizes = [t.shape[1] for t in tables]
    answers = how(np.concatenate(tables, axis=1), int(pdf["bucket"].iloc[0]))
    parts = np.split(answers, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "answer": [common.pack(p) for p in parts]})


def named(table: np.ndarray, bucket: int) -> np.ndarray:
    """Sorts triples and names each by its rank; 0 for one that occurs once."""
    rows, inverse, _, _ = distinct(list(table[:-1]))
    n = np.bincount(inverse, weights=table[-1].astype(float), minlength=len(rows[0]))
    names = (U(bucket) << U(RANK_BITS)) + np.arange(1, len(rows[0]) + 1, dtype=U)
    return np.where(n > 1, names, U(0))[inverse]


def judged(table: np.ndarray, bucket: int) -> np.ndarray:
    """Of suffixes (key of the phrases inside, key of those around), sorted: 0 if no other has the phrases inside; 1 if another has those around as well; 2 if only others around differ; 3 as 1, and this one stands for its like among those that differ."""
    (inside, _), inverse, _, first = distinct([table[0], table[1]])
    n = np.bincount(inverse, weights=table[2].astype(float), minlength=len(inside))
    new = np.ones(len(inside), bool)
    new[1:] = inside[1:] != inside[:-1]
    group = np.cumsum(new) - 1
    kinds = np.bincount(group)[group]
    verdict = np.where(kinds > 1, np.where(n > 1, 1, 2), np.where(n > 1, 1, 0)).astype(np.uint8)
    out = verdict[inverse]
    stands = first[(kinds > 1) & (n > 1)]
    out[stands] = 3
    return out


def suffixes(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Ranges lo..hi of byte places whose strings of LEAST bytes have the same phrases a..z-1 inside; m is their number, 0 where there are none."""
    start = s["start"].astype(np.int64)
    stops = s["stops"].astype(np.int64)
    starts = np.concatenate([[0], stops[:-1]])
    cuts = np.delete(start, s["first"].astype(np.int64))
    own = np.searchsorted(stops, cuts, "right")
    reach = LEAST - SIDE - GRAM
    points = np.concatenate([cuts - SIDE + 1, cuts - reach])
    own = np.concatenate([own, own])
    points = points[(points > starts[own]) & (points <= stops[own] - LEAST)]
    lo = np.unique(np.concatenate([starts, points]))
    piece = np.searchsorted(stops, lo, "right")
    hi = np.minimum(np.append(lo[1:], stops[-1]) - 1, stops[piece] - LEAST)
    a = np.searchsorted(start, lo + SIDE)
    z = np.searchsorted(start, lo + reach, "right") - 1
    whole = hi >= lo  # shorter pieces have no string of LEAST bytes
    lo, hi, piece, a, z = lo[whole], hi[whole], piece[whole], a[whole], z[whole]
    return {"lo": lo, "hi": hi, "piece": piece, "a": a, "z": z, "m": np.maximum(z - a, 0)}


def merge_keys(s: dict[str, np.ndarray], x: dict[str, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For the lists of the merge: the suffix's number, and the keys of the phrases inside and around it."""
    mod, left = covered(s)
    sym, one, nine = (np.concatenate([s[k], np.zeros(32, U)]) for k in ("sym", "one", "nine"))
    live = np.flatnonzero(x["m"] > 0)
    a, z, m = x["a"][live], x["z"][live], x["m"][live]
    first = s["first"].astype(np.int64)[x["piece"][live]]
    stop = z + left[z]  # one past the piece's phrases
    outside = [np.where(a - k >= first, sym[a - k], U(0)) for k in (1, 2)] + [np.where(z + k < stop, sym[z + k], U(0)) for k in (0, 1, 2)]
    # whole ranges are alike, so their lengths are, too
    start = s["start"].astype(np.int64)
    outside += [(start[a] - x["lo"][live]).astype(U), (x["hi"][live] - x["lo"][live]).astype(U)]
    around = np.zeros(len(live), U)
    for k, c in enumerate(outside):
        around += common.mix(c + common.STEPS[10 + k]) * common.STEPS[20 + k]
    number, inside, out = [], [], []
    for shift in range(3):
        j = a + shift
        rest = np.maximum(m - shift, 0)
        # lists: both sampled; places 0 and 1; places 0 and 2
        ok = (mod[a] != 0) if shift == 0 else (mod[a] == 0) | (mod[a] == shift)
        span = np.where(rest >= 9, 9, np.where(rest >= 3, 3, 0))
        last = 3 * np.where(span > 0, (rest - span) // 3, 0)
        names = []
        for o in (np.zeros_like(last), np.minimum(last, span), last):
            names.append(np.where(span == 9, nine[j + o], np.where(span == 3, one[j + o], U(1))))
        tail, t = j + span + last, rest - span - last
        before = np.minimum(shift, m)
        parts = [*names, np.where(t > 0, sym[tail], U(0)), np.where(t > 1, sym[tail + 1], U(0)), np.where(before > 0, sym[a], U(0)), np.where(before > 1, sym[a + 1], U(0)), m.astype(U)]
        ok &= np.logical_and.reduce([n != 0 for n in names])
        key = np.full(len(live), common.STEPS[shift])
        for k, c in enumerate(parts):
            key += common.mix(c + common.STEPS[30 + k]) * common.STEPS[40 + k]
        number.append(live[ok])
        inside.append(common.mix(key)[ok])
        out.append(around[ok])
    return np.concatenate(number), [np.concatenate(inside), common.mix(np.concatenate(out))]


def passages(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of named triples: piece, start in the piece and length. Runs within the bytes that a piece shares with the one before or after are left out."""
    at = np.flatnonzero(s["one"])
    start, stops = s["start"].astype(np.int64), s["stops"].astype(np.int64)
    piece = np.searchsorted(stops, start[at], "right")
    lo, hi = start[at], np.append(start, stops[-1])[at + 3]
    if not len(at):
        return piece, lo, hi
    new = np.ones(len(at), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (lo[1:] > hi[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    base = np.concatenate([[0], stops[:-1]])[piece[first]]
    lo, n = lo[first] - base, hi[last] - lo[first]
    keep = (n >= PASSAGE) & ((s["offset"][piece[first]] == 0) | (lo + n >= LEAST)) & (lo < PIECE)
    return piece[first][keep], lo[keep], n[keep]


def _pack(s: dict) -> bytes:
    return common.squeeze(pickle.dumps(s, protocol=5))


def _unpack(blob: bytes) -> dict:
    return pickle.loads(common.unsqueeze(blob))


ROW = "chunk long, bucket int, width int, blob binary"


def _rows(chunk: int, state: dict | None, asked: Iterator[tuple[int, bytes]], width: int) -> pd.DataFrame:
    out = [] if state is None else [(chunk, -1, 0, _pack(state))]
    out += [(chunk, b, width, blob) for b, blob in asked]
    return pd.DataFrame(out, columns=["chunk", "bucket", "width", "blob"])


def _first(texts: DataFrame, buckets: int) -> DataFrame:
    """Chunks of pieces as phrases (bucket -1), and their sampled triples of symbols by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            pieces, keys, offsets = [], [], []
            for text, key in zip(common.as_bytes(batch.column("text")), batch.column("row_key").to_pylist()):
                for at in range(0, max(min(1, len(text)), len(text) - LEAST + 1), PIECE):
                    pieces.append(text[at : at + PIECE + LEAST - 1])
                    keys.append(key)
                    offsets.append(at)
            for lo, hi in common.chunks(pieces, CHUNK):
                s = phrases(pieces[lo:hi]) | {"key": np.array(keys[lo:hi]), "offset": np.array(offsets[lo:hi], np.int64)}
                _, columns = triples(s, "sym")
                rows, _, count, _ = distinct(columns)
                out = _rows(chunk, s, questions(rows, count, bucket_of(rows[0], buckets)), 4)
                yield pa.RecordBatch.from_pandas(out, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("width", pa.int32()), ("blob", pa.binary())]), preserve_index=False)
                chunk += 1

    return texts.mapInArrow(run, ROW)


def _joined(answers: pd.DataFrame, kind) -> np.ndarray:
    """A chunk's answers, in the order of its sorted rows."""
    parts = [common.unpack(b, kind) for b in answers.sort_values("bucket")["answer"]]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _name(s: dict, names: str, into: str, answers: pd.DataFrame) -> None:
    at, columns = triples(s, names)
    _, inverse, _, _ = distinct(columns)
    s[into] = np.zeros(len(s["sym"]), U)
    s[into][at] = _joined(answers, U)[inverse]


def _round(rows: DataFrame, how, then, schema: str) -> DataFrame:
    """Sends the questions to their buckets, and the answers back to the chunks, which go on."""
    asked = rows.filter("bucket >= 0")
    answers = asked.groupBy("bucket").applyInPandas(lambda pdf: answered(pdf, how), "chunk long, bucket int, answer binary")
    return rows.filter("bucket < 0").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(then, schema)


def _recurse(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Takes the names of triples, and asks for names of triples of names."""
    if left.empty:
        return _rows(0, None, iter(()), 0)
    s = _unpack(left["blob"].iloc[0])
    _name(s, "sym", "one", right)
    _, columns = triples(s, "one")
    rows, _, count, _ = distinct(columns)
    return _rows(int(left["chunk"].iloc[0]), s, questions(rows, count, (rows[0] >> U(RANK_BITS)).astype(np.int64)), 4)


def _merge(buckets: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Takes the names of nine phrases, and deals all suffixes that may repeat to the lists of the merge."""
        if left.empty:
            return _rows(0, None, iter(()), 0)
        s = _unpack(left["blob"].iloc[0])
        _name(s, "one", "nine", right)
        x = suffixes(s)
        number, columns = merge_keys(s, x)
        rows, inverse, count, first = distinct(columns)
        # what is left of the chunk: the suffixes in lists, and those without phrases inside
        ids, at = np.unique(number, return_inverse=True)
        bare = np.flatnonzero(x["m"] == 0)
        place = lambda i: (x["lo"][i] - np.concatenate([[0], s["stops"][:-1]]).astype(np.int64)[x["piece"][i]] + s["offset"][x["piece"][i]], x["piece"][i], (x["hi"] - x["lo"])[i])
        of, lo, n = passages(s)
        state = {"key": s["key"], "passages": (lo + s["offset"][of], of, n - 1), "in": place(ids), "bare": place(bare), "at": at.astype(np.uint32), "inverse": inverse.astype(np.uint32), "first": first.astype(np.uint32)}
        return _rows(int(left["chunk"].iloc[0]), state, questions(rows, count, bucket_of(rows[0], buckets)), 3)

    return run


def _found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """row_key, kind and ranges (lo, length): kind 0 repeats at every place, kind 1 is still to be compared, kind 2 are the bytes of passages."""
    out = []
    if not left.empty:
        s = _unpack(left["blob"].iloc[0])
        verdict = _joined(right, np.uint8)
        each = verdict[s["inverse"]]
        other = np.ones(len(each), bool)
        other[s["first"]] = False
        each[(each == 3) & other] = 1  # one stands for its like
        n = len(s["in"][0])
        sure, open_ = np.zeros(n, bool), np.zeros(n, bool)
        sure[s["at"][(each == 1) | (each == 3)]] = True
        open_[s["at"][each >= 2]] = True
        for kind, (lo, key, more), pick in ((0, s["in"], sure), (1, s["in"], open_), (1, s["bare"], slice(None)), (2, s["passages"], slice(None))):
            lo, key, more = lo[pick], key[pick], more[pick]
            order = np.argsort(key, kind="stable")
            lo, key, more = lo[order], key[order], more[order]
            edges = np.flatnonzero(np.diff(key)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]) if len(key) else ():
                out.append((str(s["key"][key[i]]), kind, common.pack(np.stack([lo[i:j], more[i:j] + 1]).astype(np.int64))))
    return pd.DataFrame(out, columns=["row_key", "kind", "ranges"])


def spread(ranges: np.ndarray) -> np.ndarray:
    """All places in ranges (lo, length)."""
    lo, n = ranges
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))


def _ranges(blobs) -> np.ndarray:
    parts = [common.unpack(b, np.int64).reshape(2, -1) for b in blobs if b is not None] if blobs is not None else []
    return np.unique(np.concatenate(parts, axis=1), axis=1) if parts else np.zeros((2, 0), np.int64)


def window_hashes(text: bytes, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ranges and the hashes of the strings there. Only the text around is hashed, in blocks."""
    places, hashes = [], []
    group = np.concatenate([[0], np.cumsum((ranges[0][1:] > ranges[0][:-1] + ranges[1][:-1] + LEAST) | (ranges[0][1:] // PIECE != ranges[0][:-1] // PIECE))]) if ranges.shape[1] else np.zeros(0, int)
    for g in range(int(group[-1]) + 1 if len(group) else 0):
        r = ranges[:, np.searchsorted(group, g) : np.searchsorted(group, g, "right")]
        at, base = spread(r), int(r[0, 0])
        places.append(at)
        hashes.append(Hashes(text[base : int(at.max()) + LEAST]).windows(LEAST)[at - base])
    return (np.concatenate(places), np.concatenate(hashes)) if places else (np.zeros(0, np.int64), np.zeros(0, U))


def _numbered(texts: DataFrame) -> DataFrame:
    """Adds the chunk of each text: some MB of neighbours."""
    schema = T.StructType([*texts.schema, T.StructField("chunk", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = np.zeros(batch.num_rows, np.int64)
            for lo, hi in common.chunks(common.as_bytes(batch.column("text")), 2 * CHUNK):
                ids[lo:hi] = chunk
                chunk += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids)], names=[*batch.schema.names, "chunk"])

    return texts.mapInArrow(run, schema)


def _strings(texts: DataFrame, buckets: int) -> DataFrame:
    """The hashes of all open strings of each chunk of texts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: dict[int, list[np.ndarray]] = {}
            for text, chunk, blobs in zip(common.as_bytes(batch.column("text")), batch.column("chunk").to_pylist(), batch.column("open").to_pylist()):
                hashes.setdefault(chunk, []).append(window_hashes(text, _ranges(blobs))[1])
            out: list[tuple[int, int, bytes]] = []
            for chunk, parts in hashes.items():
                u, n = np.unique(np.concatenate(parts), return_counts=True)
                out += ((chunk, b, blob) for b, blob in questions([u], n, bucket_of(u, buckets)))
            cols = list(zip(*out)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["chunk", "bucket", "blob"])

    return texts.mapInArrow(run, "chunk long, bucket int, blob binary")


def _twice(pdf: pd.DataFrame) -> pd.DataFrame:
    """The strings of each chunk that occur again."""
    tables = [common.unpack(b, U).reshape(2, -1) for b in pdf["blob"]]
    table = np.concatenate(tables, axis=1)
    values, inverse = np.unique(table[0], return_inverse=True)
    again = (np.bincount(inverse, weights=table[1].astype(float), minlength=len(values)) > 1)[inverse]
    out = []
    for chunk, part, ok in zip(pdf["chunk"], tables, np.split(again, np.cumsum([t.shape[1] for t in tables])[:-1])):
        if ok.any():
            out.append((chunk, common.pack(part[0][ok])))
    return pd.DataFrame(out, columns=["chunk", "hashes"])


def repeated_runs(n: int, places: np.ndarray) -> np.ndarray:
    """Maximal runs (start, stop) of bytes under strings at these sorted places."""
    if not len(places):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.diff(places) > LEAST) + 1
    return np.stack([places[np.concatenate([[0], new])], places[np.concatenate([new - 1, [len(places) - 1]])] + LEAST], 1)


RESULT = "doc_id long, row_key string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, n_passage long"


def _removed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Applies what was found to the whole texts of a chunk."""
    again = common.distinct(np.concatenate([common.unpack(b, U) for b in right["hashes"]])) if len(right) else np.zeros(0, U)
    out = []
    for r in left.itertuples(index=False):
        text = (r.text or "").encode()
        places = spread(_ranges(r.sure))
        if len(again) and r.open is not None:
            at, h = window_hashes(text, _ranges(r.open))
            near = np.minimum(np.searchsorted(again, h), len(again) - 1)
            places = np.concatenate([places, at[again[near] == h]])
        runs = repeated_runs(len(text), np.unique(places))
        digest, last = hashlib.sha256(), 0
        for a, b in runs.tolist():
            digest.update(text[last:a])
            last = b
        digest.update(text[last:])
        out.append((None if r.doc_id is None else int(r.doc_id), r.row_key, len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), digest.hexdigest(), runs.tolist(), len(np.unique(spread(_ranges(r.passages))))))
    return pd.DataFrame(out, columns=["doc_id", "row_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_passage"], dtype=object).astype({"doc_id": "Int64"})  # ids come as text: a null would make them floats


def repeated_strings(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop in bytes) and n_passage of each document."""
    spark = docs.sparkSession
    common.batch_rows(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row_key", common.row_key())
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    first = common.stash(_first(texts.filter(F.octet_length("text") >= PASSAGE).select("text", "row_key"), buckets), "triples")
    second = common.stash(_round(first, named, _recurse, ROW), "names")
    common.drop(first)
    third = common.stash(_round(second, named, _merge(buckets), ROW), "suffixes")
    common.drop(second)
    found = common.stash(_round(third, judged, _found, "row_key string, kind int, ranges binary"), "ranges")
    common.drop(third)

    # only texts with something found are joined; the filter has a fixed size
    per_text = found.groupBy("row_key").agg(F.collect_set(F.when(F.col("kind") == 0, F.col("ranges"))).alias("sure"), F.collect_set(F.when(F.col("kind") == 1, F.col("ranges"))).alias("open"), F.collect_set(F.when(F.col("kind") == 2, F.col("ranges"))).alias("passages"))
    wanted = spark.sparkContext.broadcast(bits_of(found.select(F.xxhash64("row_key").alias("h")).distinct()))

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(passes(wanted.value, keys.to_numpy(np.int64).view(U)))

    split = texts.withColumn("maybe", maybe(F.xxhash64("row_key")))
    some = common.stash(_numbered(split.filter("maybe").drop("maybe").join(per_text, "row_key", "left")), "found")
    again = _strings(some.filter(F.size("open") > 0).select("text", "chunk", "open"), buckets).groupBy("bucket").applyInPandas(_twice, "chunk long, hashes binary")
    changed = some.select("chunk", F.col("doc_id").cast("string"), "row_key", "text", "sure", "open", "passages").groupBy("chunk").cogroup(again.groupBy("chunk")).applyInPandas(_removed, RESULT)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    none = F.lit(0).cast("long")
    rest = split.filter(~F.col("maybe")).select("doc_id", "row_key", F.octet_length(data).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"), F.expr("cast(array() as array<array<long>>)").alias("spans"), none.alias("n_passage"))
    return changed.unionByName(rest)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_strings(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage")
