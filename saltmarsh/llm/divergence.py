"""Source divergence audit (operator 12): how far each source's words are from its language and from other sources.

Each language keeps the terms of at least three of its documents. A group (lang, source), and each language, gives a
kept term the share p = 1 + floor(10^9 (count + 1) / (N + V)); the divergence from q is floor((p - q)^2 / q).

1. Tasks count terms and documents by group and send sums; one shuffle by (lang, term) makes the postings, a row for
   each kept term and source that has it.
2. Terms: a group's postings fall into buckets of about equal counts. A bucket's largest p and the smallest q of the
   language bound its divergences. Buckets are read best first, in waves that double; a group ends when the bounds of
   all that it has not read are strictly below its k-th value, so ties are read, too.
3. Pairs: were all counts 0, a pair's sum would be V times one value. Histograms of a group's counts correct it for
   terms that one of the two has, and postings for terms that both have; only sums by pair leave a task.

All arithmetic is of whole numbers: exact up to 9 * 10^13 tokens in a language.

Defined results: a null text, lang or source is ''; texts of any length are read whole; repeated rows count as often as
they occur; equal values are ranked by the item's bytes; a group without terms has pairs, too (0 if its language keeps
no term); an empty table gives an empty table; other columns are not read. A language's pairs are as many as the square
of its sources, so that many sums are made and shuffled.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.llm import common

#: Terms of a language stand in so many of its documents; terms listed for each group.
LEAST_DOCUMENTS, LISTED = 3, 200
#: Terms that a task holds before it sends their sums, and pairs of postings handled at once.
HELD, PAIRS = 300_000, 1_000_000
ONE = 1_000_000_000
#: A join of a language's groups with each other is dealt over so many parts.
SALTS = 8

_terms = re.compile(rb"[a-z\x80-\xff]+").findall


def term_sums(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs) that add up to the occurrences and the documents of each term in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        having: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), of in counts.items():
                m, d = len(of), having[lang, source]
                columns = [pa.array([lang] * m, pa.string()), pa.array([source] * m, pa.string()), pa.array(of.keys(), pa.binary()).cast(pa.string()), pa.array(of.values(), pa.int64()), pa.array([d[t] for t in of], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            counts.clear()
            having.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), common.as_bytes(batch.column("text"))):
                found = _terms(text.lower())
                counts[lang, source].update(found)
                having[lang, source].update(set(found))
            if sum(map(len, counts.values())) > HELD:
                yield from sums()
        yield from sums()
        common.give_back()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), in two steps of which neither leaves 64 bits."""
    high = (count + 1) * 10_000
    return F.expr("1L") + _div(high, total) * 100_000 + _div((high % total) * 100_000, total)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def bucket(n: Column) -> Column:
    """Counts to 16 stand alone, larger ones with those of the same quarter of an octave."""
    return F.when(n <= 16, n).otherwise(F.floor(F.log2(n) * 4)).cast("int")


def postings_of(docs: DataFrame, least: int) -> DataFrame:
    """lang, term, source, n; total: the term's count in the language; sources: how many sources have it. Kept terms only."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = term_sums(docs).repartition(parts, "lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    out = sums.withColumns({"total": F.sum("n").over(of_term), "having": F.sum("docs").over(of_term), "sources": F.count("*").over(of_term)})
    return out.filter(F.col("having") >= least).select("lang", "term", "source", "n", "total", "sources")


def top_terms(postings: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """lang, source, item, value, rank: each group's k terms that exceed the language the most."""
    shares = postings.join(sizes, ["lang", "source"]).select(
        "lang", "source", "term", bucket(F.col("n")).alias("bucket"), share(F.col("n"), F.col("size") + F.col("v")).alias("p"), share(F.col("total"), F.col("lang_size") + F.col("v")).alias("q")
    )
    bounds = shares.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("m")).filter("p > q")
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = bounds.withColumn("bound", divergence(F.col("p"), F.col("q")))
    before = F.coalesce(F.sum("m").over(best_first), F.lit(0))
    # wave 0 has the buckets that start within the first k terms, wave w those within k 2^w
    wave = F.when(before < k, 0).otherwise(F.floor(F.log2(before / k)) + 1).cast("int")
    left = common.stash(bounds.select("lang", "source", "bucket", "bound", wave.alias("wave")), "bounds")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = kth = None
    while True:
        if kth is not None:
            of_group = left.join(kth, ["lang", "source"], "left")
            open_ones = of_group.filter("kth is null or bound >= kth")
        else:
            open_ones = left.withColumn("kth", F.lit(None).cast("long"))
        now = open_ones.agg(F.min(F.when(F.col("kth").isNull(), F.col("wave")))).first()[0]
        if now is None and open_ones.isEmpty():
            return best if best is not None else shares.limit(0).select("lang", "source", F.col("term").alias("item"), F.col("p").alias("value"), F.lit(0).alias("rank"))
        # a group that knows a k-th value reads all that may still reach it; others go on with the next wave
        read = common.stash(open_ones.filter(F.col("kth").isNotNull() | (F.col("wave") == F.lit(now if now is not None else -1))).select("lang", "source", "bucket"), "wave")
        found = shares.join(read, ["lang", "source", "bucket"], "left_semi").filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        last = best
        best = common.stash(found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k), "best")
        rest = common.stash(left.join(read, ["lang", "source", "bucket"], "left_anti"), "bounds")
        kth = best.filter(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
        common.drop(left, read, *[last] * (last is not None))
        left = rest


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def shared_terms(postings: DataFrame) -> DataFrame:
    """Rows (lang, a, b, value) that add up to what a pair's terms in common change; input rows (lang, term, source, p, zero) of terms with several sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def sums(lang: str, names: np.ndarray, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            total = np.add.reduceat(values, first)
            a, b = np.divmod(keys[first], len(names))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(total)], names=["lang", "a", "b", "value"])

        def pairs(lang: str, rows) -> Iterator[pa.RecordBatch]:
            names, source = np.unique(rows["source"].to_numpy(object), return_inverse=True)
            p, zero = rows["p"].to_numpy(), rows["zero"].to_numpy()
            term = rows["term"].to_numpy(object)
            first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            many = np.diff(np.append(first, len(term)))
            start = np.repeat(first, many)  # of the own term, for each posting
            width = np.repeat(many, many)
            done = np.cumsum(width)
            lo = 0
            while lo < len(term):
                hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, "right")))
                i = np.repeat(np.arange(lo, hi), width[lo:hi])
                j = np.arange(len(i)) - np.repeat(np.cumsum(width[lo:hi]) - width[lo:hi], width[lo:hi]) + start[i]
                other = i != j
                i, j = i[other], j[other]
                value = _f(p[i], p[j]) - _f(p[i], zero[j]) - _f(zero[i], p[j]) + _f(zero[i], zero[j])
                if len(i):
                    yield sums(lang, names, source[i].astype(np.int64) * len(names) + source[j], value)
                lo = hi

        rest = None
        import pandas as pd

        for batch in batches:
            rows = batch.to_pandas()
            if rest is not None:
                rows = pd.concat([rest, rows], ignore_index=True)
            if rows.empty:
                continue
            # the last term may go on in the next batch
            end = rows.iloc[-1]
            unfinished = (rows["lang"] == end["lang"]) & (rows["term"] == end["term"])
            rest, rows = rows[unfinished], rows[~unfinished]
            for lang, part in rows.groupby("lang", sort=False):
                held.setdefault(lang, []).append(part)
            # rows come by language, so only the last one's go on
            for lang in [x for x, parts in held.items() if x != end["lang"] or sum(map(len, parts)) >= HELD]:
                yield from pairs(lang, pd.concat(held.pop(lang), ignore_index=True))
        if rest is not None and len(rest):
            held.setdefault(rest["lang"].iloc[0], []).append(rest)
        for lang, parts in held.items():
            yield from pairs(lang, pd.concat(parts, ignore_index=True))
        common.give_back()

    return postings.mapInArrow(run, "lang string, a string, b string, value long")


def pair_sums(postings: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: the divergence of each source from each other source of its language, over all kept terms."""
    shuffles = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    zero = share(F.lit(0).cast("long"), F.col("size") + F.col("v"))
    spread = sizes.filter("v > 0").withColumn("zero", zero)
    salted = spread.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)))
    others = spread.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))

    def with_others(df: DataFrame) -> DataFrame:
        return df.join(others, ["lang", "salt"]).filter("source <> other")

    both_zero = divergence(F.col("zero"), F.col("other_zero"))
    exact = lambda x: x.cast("decimal(38,0)").alias("value")
    base = with_others(salted).select("lang", F.col("source").alias("a"), F.col("other").alias("b"), exact(both_zero * F.col("v")))
    # how many terms of a group have which count, against all other sources as if they had none
    histogram = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(salted, ["lang", "source"])
    histogram = with_others(histogram.withColumn("p", share(F.col("n"), F.col("size") + F.col("v"))).select("lang", "source", "salt", "p", "m", "zero"))
    own = histogram.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), exact(F.col("m") * (divergence(F.col("p"), F.col("other_zero")) - both_zero)))
    against = divergence(F.col("other_zero"), F.col("p")) - divergence(F.col("other_zero"), F.col("zero"))
    other = histogram.select("lang", F.col("other").alias("a"), F.col("source").alias("b"), exact(F.col("m") * against))
    several = postings.filter("sources > 1").join(spread, ["lang", "source"]).select("lang", "term", "source", share(F.col("n"), F.col("size") + F.col("v")).alias("p"), "zero")
    common_terms = shared_terms(several.repartition(shuffles, "lang", "term").sortWithinPartitions("lang", "term")).select("lang", "a", "b", exact(F.col("value")))
    every = base.unionByName(own).unionByName(other).unionByName(common_terms)
    summed = every.groupBy("lang", "a", "b").agg(F.sum("value").cast("long").alias("value"))
    # a language that keeps no term has pairs of value 0
    bare = sizes.filter("v = 0").select("lang", F.col("source").alias("a"))
    none = bare.join(bare.withColumnRenamed("a", "b"), "lang").filter("a <> b").withColumn("value", F.lit(0).cast("long"))
    ranked = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")
    return summed.unionByName(none).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value", F.row_number().over(ranked).alias("rank"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, k: int = LISTED) -> DataFrame:
    """lang, source, part ('term' or 'pair'), item, value, rank."""
    common.batch_rows(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    postings = common.stash(postings_of(docs, least), "postings")
    groups = docs.select("lang", "source").distinct()
    langs = postings.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_size"))
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    sizes = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    sizes = common.stash(sizes.select("lang", "source", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("size", "v", "lang_size"))), "sizes")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    terms = top_terms(postings, sizes, k).withColumn("part", F.lit("term"))
    pairs = pair_sums(postings, sizes).withColumn("part", F.lit("pair"))
    return terms.select(columns).unionByName(pairs.select(columns))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row_id) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS size FROM kept GROUP BY ALL),
counted AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS size FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counted USING (lang, source) GROUP BY ALL),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.size + l.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (k.n + 1) // (l.size + l.v))::BIGINT AS q
 FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
