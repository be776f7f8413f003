"""Token counts (operator 9): exact counts at every prefix by dynamic programming.

A byte-pair encoding is fixed by its adjacent pairs: a sequence of tokens is the encoding of its bytes
if and only if each adjacent pair is the encoding of the pair's bytes. So each prefix of a piece has
exactly one last token, and the count at a prefix is one more than the count before that token.

The query stores the counts of all prefixes of each text, as compressed differences, and answers from them: the number
of tokens is the last count, and the longest prefix within a limit is the last count that isn't larger. A piece's own
counts are worked out once and kept. New pieces of several texts are taken in order: a prefix's last token is the same in
all pieces that begin with it, so each goes on from where it differs from the one before. White space is counted by
runs, as a prefix may end inside one.

Defined results: null and empty texts have 0 tokens, one prefix (the empty one) and n_bytes 0; texts of any length are
read whole; prefixes with equal counts: the longest is kept; repeated rows give repeated rows; other columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.llm import common

#: The split before merges; a fixed value of the public vocabulary.
PATTERN = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts of these characters, in classes that the faster standard module has.
LATIN = re.compile(r"[\t-\r -~À-ɏ]*").fullmatch
LATIN_PATTERN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-zÀ-ÖØ-öø-ɏ0-9]+|\s+(?!\S)|\s+").findall
BLANKS = re.compile(r"\s{2,}").finditer
#: Distinct pieces kept in memory by a task; beyond it the store is emptied.
CACHE_PIECES = 200_000
#: Text, in characters, whose new pieces are taken in order together.
TOGETHER = 4 << 20


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in vocabulary files: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Encodes pieces and counts tokens at their prefixes."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        stand_in = byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {bytes(stand_in[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.ranks = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[bytes(stand_in[c] for c in a), bytes(stand_in[c] for c in b)] = r
        # by their last three bytes: the lengths of tokens, longest first
        ends: dict[bytes, set[int]] = {}
        for token in self.ids:
            if len(token) > 2:
                ends.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {end: (*sorted(n, reverse=True), 2, 1) for end, n in ends.items()}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        #: Of pieces: what each character adds to the count.
        self.differences: dict[str, bytes] = {}
        self.any_text = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]

    def findall(self, text: str) -> list[str]:
        return LATIN_PATTERN(text) if LATIN(text) else self.any_text(text)

    def merge(self, piece: bytes) -> list[bytes]:
        """The encoding itself: lowest rank first, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(ranked)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens, side by side, are what their bytes are encoded as."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 400_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def lasts(self, piece: bytes, out: list[bytes] | None = None) -> list[bytes]:
        """The last token of the encoding of each prefix of a piece, the empty one first. out: those of a shorter prefix, to go on from."""
        out, ids, pairs, lengths = [b""] if out is None else out, self.ids, self.pairs, self.lengths
        for end in range(len(out), len(piece) + 1):
            for n in lengths.get(piece[end - 3 if end > 3 else 0 : end], (2, 1)):
                start = end - n
                if start < 0:
                    continue
                token = piece[start:end]
                if token in ids:
                    if not start:
                        break
                    good = pairs.get((out[start], token))
                    if self.fits(out[start], token) if good is None else good:
                        break
            else:
                raise ValueError("bytes that the vocabulary lacks")
            out.append(token)
        return out

    def counts(self, piece: bytes) -> np.ndarray:
        """Token counts at each byte prefix."""
        return np.array(self._counted(piece), np.int64)

    def _counted(self, piece: bytes) -> list[int]:
        out = [0]
        for i, last in enumerate(self.lasts(piece)[1:], 1):
            out.append(out[i - len(last)] + 1)
        return out

    def whole(self, piece: str) -> int:
        """The count at the end of a piece: the last entry of its prefix counts."""
        data = piece.encode()
        if data in self.ids:
            return 1
        lasts = self.lasts(data)
        at, n = len(data), 0
        while at:
            at -= len(lasts[at])
            n += 1
        return n

    def tokens(self, piece: str) -> list[int]:
        """Ids of a piece, read back from its last tokens."""
        data = piece.encode()
        lasts, at, out = self.lasts(data), len(data), []
        while at:
            out.append(self.ids[lasts[at]])
            at -= len(lasts[at])
        return out[::-1]

    def learn(self, pieces: set[str]) -> None:
        """Keeps the differences of pieces, each from where it differs from the one before. A contraction's prefixes are split as such."""
        before, lasts, counts, steps = b"", [b""], [0], []
        for piece in sorted(pieces):
            data = piece.encode()
            same = 0
            for x, y in zip(data, before):
                if x != y:
                    break
                same += 1
            before = data
            del lasts[same + 1 :], counts[same + 1 :], steps[same:]
            for i, last in enumerate(self.lasts(data, lasts)[same + 1 :], same + 1):
                counts.append(n := counts[i - len(last)] + 1)
                steps.append((n - counts[i - 1]) & 255)
            if len(piece) > 1 and piece[0] == "'" and piece[1].isalpha():
                own = [0, *(sum(map(self.whole, self.findall(piece[:j]))) for j in range(1, len(piece))), counts[-1]]
            elif len(data) > len(piece):  # a character ends where the next byte begins one
                own = [0, *(n for n, b in zip(counts[1:], data[1:] + b" ") if b & 0xC0 != 0x80)]
            else:
                self.differences[piece] = bytes(steps)
                continue
            self.differences[piece] = bytes([(y - x) & 255 for x, y in zip(own, own[1:])])

    def stored(self, text: str) -> np.ndarray:
        """The same as table(), by kept pieces for texts of usual characters without special strings."""
        return next(self.all_stored([text]))

    def all_stored(self, texts: list[str]) -> Iterator[np.ndarray]:
        """stored() of each text."""
        for a, b in common.chunks(texts, TOGETHER):
            if len(self.differences) > CACHE_PIECES:
                self.differences.clear()
            split = [LATIN_PATTERN(t) if LATIN(t) and not any(s in t for s in self.special) else None for t in texts[a:b]]
            self.learn(set().union(*filter(None, split)).difference(self.differences))
            for text, pieces in zip(texts[a:b], split):
                yield self.table(text) if pieces is None else self._joined(text, pieces)

    def _joined(self, text: str, pieces: list[str]) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.int32)
        np.cumsum(np.frombuffer(b"".join(map(self.differences.__getitem__, pieces)), np.int8), out=out[1:], dtype=np.int32)
        for m in BLANKS(text):
            start, end = m.span()
            # a prefix that ends in white space has all of the run so far in one piece
            out[start + 1 : end + 1] = out[start] + self._piece_counts(m[0])[1:]
        return out

    def _piece_counts(self, piece: str) -> np.ndarray:
        """Token counts at each character prefix of a piece."""
        by_byte = self.counts(piece.encode())
        if piece.isascii():
            return by_byte
        return by_byte[np.cumsum([0] + [len(c.encode()) for c in piece])]

    def table(self, text: str) -> np.ndarray:
        """The exact number of tokens of text[:i], for every i from 0 to len(text).

        Three prefixes don't end as the whole text is split: within white space (its run counts as one
        piece), within a contraction (an apostrophe, then letters) and within a special string (plain text).
        """
        out = np.zeros(len(text) + 1, np.int32)
        base = at = 0
        for k, part in enumerate(self.split(text)):
            if k % 2:
                head = text[:at]
                for j in range(1, len(part)):
                    out[at + j] = self._plain(head, part[:j])
                base += 1
                at += len(part)
                out[at] = base
                continue
            run_at, run_base = None, 0
            for piece in self.findall(part):
                if piece[0].isspace():
                    if run_at is None:
                        run_at, run_base = at, base
                else:
                    run_at = None
                inner = self._piece_counts(piece)
                out[at + 1 : at + len(piece) + 1] = base + inner[1:]
                if len(piece) > 1 and piece[0] == "'" and piece[1].isalpha():
                    for j in range(2, len(piece)):
                        out[at + j] = base + sum(map(self.whole, self.findall(piece[:j])))
                if run_at is not None:
                    upto = at + (len(piece) if piece.isspace() else 1)
                    run = self._piece_counts(text[run_at:upto])
                    out[at + 1 : upto + 1] = run_base + run[at + 1 - run_at :]
                if not piece.isspace():
                    run_at = None
                base += int(inner[-1])
                at += len(piece)
        return out

    def _plain(self, head: str, tail: str) -> int:
        """Tokens of head + tail, where the tail is an unfinished special string."""
        parts = self.split(head)
        done = sum(1 if k % 2 else sum(map(self.whole, self.findall(p))) for k, p in enumerate(parts[:-1]))
        return done + sum(map(self.whole, self.findall(parts[-1] + tail)))


@cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def longest_within(table: np.ndarray, budget: int) -> int:
    """The longest prefix, in characters, that has at most `budget` tokens."""
    return int(np.flatnonzero(np.asarray(table) <= budget)[-1])


def prefix_tables(docs: DataFrame, path: str, text: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """Adds an array: the exact token count of each prefix, in characters, of a text."""
    schema = T.StructType([*[f for f in docs.schema if f.name != out], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for pdf in batches:
            pdf[out] = [c.table(t or "") for t in pdf[text]]
            yield pdf[schema.names]

    return docs.mapInPandas(run, schema)


def tokens_within(prefix_tokens: str, n_chars):
    """Column: tokens of the first n_chars characters, from a stored prefix table."""
    return F.element_at(F.col(prefix_tokens), F.least(n_chars + 1, F.size(prefix_tokens)))


def chars_within(prefix_tokens: str, budget: int):
    """Column: characters of the longest prefix within a token budget, from a stored prefix table."""
    good = F.transform(F.col(prefix_tokens), lambda n, i: F.when(n <= budget, i))
    return F.array_max(good)


def pack_counts(table: np.ndarray) -> bytes:
    """A table of prefix counts as compressed differences."""
    return common.squeeze(np.diff(table).astype(np.int16).tobytes())


def unpack_counts(blob: bytes) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(common.unpack(blob, np.int16), dtype=np.int64)])


def stored_tokens_within(prefix_counts: str, n_chars):
    """Column: tokens of the first n_chars characters, from stored counts."""

    @F.pandas_udf("long")
    def answer(blobs: pd.Series, n: pd.Series) -> pd.Series:
        tables = map(unpack_counts, blobs)
        return pd.Series([int(t[min(int(k), len(t) - 1)]) for t, k in zip(tables, n)])

    return answer(F.col(prefix_counts), n_chars)


def stored_chars_within(prefix_counts: str, budget: int):
    """Column: characters of the longest prefix within a token budget, from stored counts."""

    @F.pandas_udf("long")
    def answer(blobs: pd.Series) -> pd.Series:
        return pd.Series([longest_within(unpack_counts(b), budget) for b in blobs])

    return answer(F.col(prefix_counts))


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, keep_chars (the longest prefix within the limit) and prefix_counts, the stored counts of all prefixes, from which the others follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n, keep, blobs = [], [], []
            for table in c.all_stored(texts):
                n.append(int(table[-1]))
                keep.append(longest_within(table, limit))
                blobs.append(pack_counts(table))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n]), pa.array(keep, pa.int64()), pa.array(blobs, pa.binary())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "keep_chars", "prefix_counts"],
            )
        common.give_back()

    common.batch_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, keep_chars long, prefix_counts binary")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"), vocabulary_path(), 1024)
