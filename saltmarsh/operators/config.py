"""Condition and corpora settings; they are data and are never evaluated."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.functions import text as X
from saltmarsh.functions.text import cutoff_text
from saltmarsh.operators import wordfreq as W
from saltmarsh.plans.shared import stash


@dataclass
class Source:
    name: str
    filename: str
    id: str = ""
    weight: str = "1"
    filter: str | None = None
    use_remainder: bool = False
    count: int | None = None
    save_remainder: bool = False

    def check(self) -> None:
        if not self.name or not self.filename:
            raise ValueError("a source needs a name and a file")
        if not re.fullmatch(r"\d+(\.\d+)?x?", self.weight):
            raise ValueError(f"not a weight: {self.weight}")


@dataclass
class Condition:
    name: str
    description: str = ""
    structure_sources: list[Source] = field(default_factory=list)
    tokenized_sources: list[Source] = field(default_factory=list)
    untokenized_sources: list[Source] = field(default_factory=list)
    test_sources: list[Source] = field(default_factory=list)
    tokenize_structures_method: str = "character_class"
    tokenize_tts_method: str | None = None
    generate_unseen_terminals: bool = False
    uniformize_strings: bool = False
    #: 0 leaves probabilities as they are
    totalquantlevels: int = 500
    #: kept in settings that are shared with other tools; the quantizer is exact and has no restarts
    quantizeriters: int = 1000
    cutoffmin: int = 12
    cutoffmax: int = 12

    def check(self) -> Condition:
        if not re.fullmatch(r"[\w.-]+", self.name) or self.name.startswith((".", "-")):
            raise ValueError(f"not a condition name: {self.name}")
        if not self.structure_sources or not self.test_sources:
            raise ValueError("a condition needs structure and test sources")
        if self.tokenized_sources and not self.tokenize_tts_method:
            raise ValueError("terminal sources to tokenize need a tokenizer")
        for s in [*self.structure_sources, *self.tokenized_sources, *self.untokenized_sources, *self.test_sources]:
            s.check()
        if self.cutoffmax < self.cutoffmin:
            raise ValueError("the last cutoff is larger than the first")
        return self

    def cutoffs(self) -> list[str]:
        return [cutoff_text(n) for n in range(self.cutoffmin, self.cutoffmax + 1)]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def from_json(text: str) -> Condition:
        raw = json.loads(text)
        for k in ("structure_sources", "tokenized_sources", "untokenized_sources", "test_sources"):
            raw[k] = [Source(**s) for s in raw.get(k, [])]
        return Condition(**raw).check()


Read = Callable[[str], DataFrame]
Filters = dict[str, Callable[[DataFrame], DataFrame]]


def build_tests(sources: list[Source], read: Read, filters: Filters | None = None, seed: int = 0) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Test strings (user_id, policy, password), and by file name what sources that save it leave over.

    A source's rows are filtered, and equal ones numbered; `count` of them are sampled by the hash of row and number, so
    that equal words are drawn one by one and the draw doesn't depend on the files. Without a count all are taken and
    nothing is left.
    """
    tests: list[DataFrame] = []
    remainders: dict[str, DataFrame] = {}
    for s in sources:
        df = read(s.filename)
        if s.filter:
            df = (filters or {})[s.filter](df)
        left = df.limit(0)
        if s.count is not None:
            columns = df.columns
            df, left = W.sample(stash(_numbered(df), "tests"), s.count, seed, [*columns, "_nth"])
            df, left = df.select(columns), left.select(columns)
        if s.save_remainder:
            if s.filename in remainders:
                raise ValueError(f"two test sources save the remainder of {s.filename}")
            remainders[s.filename] = left
        tests.append(W.three_columns(df, s.name))
    return reduce(DataFrame.unionByName, tests), remainders


def _numbered(df: DataFrame, block: int = 100_000) -> DataFrame:
    """Adds _nth, from 1 on for equal rows. Rows are counted, and made again in blocks, so that no task has all of a word's."""
    counts = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    blocks = counts.withColumn("_block", F.explode(F.expr(f"sequence(0, cast((_n - 1) div {block} AS int))"))).repartition(*df.columns, "_block")
    return blocks.select(*df.columns, F.explode(F.expr(f"sequence(cast(_block AS bigint) * {block} + 1, least(_n, (cast(_block AS bigint) + 1) * {block}))")).alias("_nth"))


def build_corpus(sources: list[Source], read: Read, filters: Filters | None = None, compat: bool = False, remainders: dict[str, DataFrame] | None = None) -> DataFrame:
    """Reads, tags, filters and weighs sources one after the other and sums them; a weight like 2x is times the total so far. A source that uses a remainder reads what the test source of that file left over."""
    done: list[DataFrame] = []
    for s in sources:
        if s.use_remainder and s.filename not in (remainders or {}):
            raise ValueError(f"source {s.name} uses a remainder, but no test source saved that of {s.filename}")
        df = W.wordfreq(remainders[s.filename] if s.use_remainder else read(s.filename), replace_tag=s.id or None)
        if s.filter:
            df = (filters or {})[s.filter](df)
        if s.weight.endswith("x"):
            if done:
                df = W.relative_weight(reduce(DataFrame.unionByName, done), df, float(s.weight[:-1]), compat)
        else:
            df = df.withColumn("freq", df["freq"] * float(s.weight))
        done.append(df)
    return W.combine(done)


def build_training(condition: Condition, read: Read, tokenizers: dict[str, Callable[..., DataFrame]] | None = None, filters: Filters | None = None, remainders: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Tokenized structures, and the pieces that terminals are learned from.

    A tokenizer of structures takes a corpus and returns it with breaks; one of terminals also takes the tokenized
    structures, and its result is split, lower-cased and summed. Pieces of structures always count as terminals, too.
    """
    known = {"character_class": lambda df, *_: W.tokenize(df)} | (tokenizers or {})
    structures = known[condition.tokenize_structures_method](build_corpus(condition.structure_sources, read, filters, remainders=remainders))
    parts = [_pieces(structures)]
    if condition.tokenized_sources:
        parts.append(_pieces(known[condition.tokenize_tts_method](build_corpus(condition.tokenized_sources, read, filters, remainders=remainders), structures)))
    if condition.untokenized_sources:
        parts.append(_pieces(build_corpus(condition.untokenized_sources, read, filters, remainders=remainders)))
    return structures, W.combine(parts)


def _pieces(tokenized: DataFrame) -> DataFrame:
    return tokenized.select(F.explode(F.split("word", X.BREAK)).alias("word"), "freq", "tags").filter("word <> ''").withColumn("word", X.ascii_lower("word"))
