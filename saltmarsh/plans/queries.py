"""Named queries over the driver's tables, each with DuckDB SQL where SQL can express it.

C1 mixes character classes, C2 is tokens of documents (ASCII ones), C3 is lookup results made from events.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.functions import text as X
from saltmarsh.operators import analysis as A
from saltmarsh.operators import classic as C
from saltmarsh.operators import grammar as G
from saltmarsh.operators import lookup as L
from saltmarsh.operators import ngrams as N
from saltmarsh.operators import patterns as P
from saltmarsh.operators import quantize as Q
from saltmarsh.operators import stored as T
from saltmarsh.operators import unseen as U
from saltmarsh.operators import wordfreq as W
from saltmarsh.operators.config import Condition, Source
from saltmarsh.plans import experiment
from saltmarsh.plans.shared import running_sum, shared_path, stash
from saltmarsh.sources import corpora as S

CUTOFF = 1e-6
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# what the SQL is made of
C1 = """c1 AS (SELECT replace(p_name || CAST(p_size AS VARCHAR), ' ', '') AS word, 'P' AS tag FROM part UNION ALL SELECT p_brand, 'B' FROM part
 UNION ALL SELECT o_orderpriority, 'O' FROM orders UNION ALL SELECT n_name, 'N' FROM nation UNION ALL SELECT s_name, 'S' FROM supplier UNION ALL SELECT c_mktsegment, 'M' FROM customer)"""
C2 = r"""c2 AS (SELECT * FROM (SELECT doc_id, lang AS tag, unnest(string_split_regex(text, '[ \t\n\r\f\v]+')) AS word FROM documents) WHERE word <> '')"""
C3 = "c3 AS (SELECT event_type AS condition, CAST(CASE WHEN value < 5 THEN -4 WHEN value < 10 THEN -2 ELSE event_id + 1 END AS BIGINT) AS guess, event_id FROM events)"
CLASSES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[^a-zA-Z0-9\x01]', '~', 'g'), '[a-z]', 'l', 'g'), '[A-Z]', 'U', 'g'), '[0-9]', 'D', 'g')"


def classes(x: str) -> str:
    return f"translate({CLASSES.format(x)}, '~l' || chr(1), 'SLE')"


TOKENS = "array_to_string(regexp_extract_all({0}, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+'), chr(1))"
LEARN = f"""{C1}, tok AS (SELECT {TOKENS.format('word')} AS word, tag FROM c1),
sts AS (SELECT {classes('word')} AS structure, count(*) AS n FROM tok GROUP BY 1),
structures AS (SELECT structure, n / CAST(sum(n) OVER () AS DOUBLE) AS prob FROM sts),
pieces AS (SELECT unnest(string_split(word, chr(1))) AS piece, tag FROM tok),
tcounts AS (SELECT translate({classes('piece')}, 'U', 'L') AS term_key, lower(piece) AS terminal, CAST(count(*) AS DOUBLE) AS freq FROM pieces GROUP BY 1, 2),
terminals AS (SELECT term_key, terminal, freq / sum(freq) OVER (PARTITION BY term_key) AS prob FROM tcounts),
groups AS (SELECT term_key, prob, count(*) AS size, max(terminal) AS first_string, row_number() OVER (PARTITION BY term_key ORDER BY prob DESC) - 1 AS group_idx FROM terminals GROUP BY 1, 2)"""
CASED = "array_to_string(list_transform(range(1, len({1}) + 1), lambda i: CASE WHEN {1}[i] = 'U' THEN upper({0}[i]) ELSE {0}[i] END), '')"
ENUMERATE = f"""WITH RECURSIVE {LEARN},
walk AS (SELECT structure, string_split(structure, 'E') AS ps, prob, CAST([] AS BIGINT[]) AS idx, CAST([] AS VARCHAR[]) AS firsts, CAST(1 AS HUGEINT) AS n, 0 AS k FROM structures
 UNION ALL
 SELECT w.structure, ps, w.prob * g.prob, list_append(idx, g.group_idx), list_append(firsts, {CASED.format('g.first_string', 'ps[k + 1]')}), n * g.size, k + 1
 FROM walk w JOIN groups g ON g.term_key = translate(ps[k + 1], 'U', 'L') WHERE k < len(ps) AND w.prob * g.prob >= {CUTOFF}),
alls AS (SELECT structure, ps, prob, idx, firsts, n FROM walk WHERE k = len(ps)),
canon AS (SELECT *, list_transform(range(1, len(ps) + 1), lambda i: ps[i] || '/' || idx[i]) AS pairs FROM alls
 WHERE len(list_filter(range(1, len(ps) + 1), lambda i: len(list_filter(range(1, len(ps) + 1), lambda j: j < i AND ps[j] = ps[i] AND idx[j] > idx[i])) > 0)) = 0),
pats AS (SELECT structure, prob, array_to_string(firsts, chr(1)) AS pattern, CAST(n
 * list_reduce(list_transform(list_distinct(ps), lambda p: factorial(CAST(len(list_filter(ps, lambda q: q = p)) AS INT))), lambda a, b: a * b)
 // list_reduce(list_transform(list_distinct(pairs), lambda p: factorial(CAST(len(list_filter(pairs, lambda q: q = p)) AS INT))), lambda a, b: a * b) AS BIGINT) AS n FROM canon),
lt AS (SELECT prob, n, pattern, CAST(1 + coalesce(sum(n) OVER (ORDER BY prob DESC, CAST(n AS VARCHAR) DESC, pattern DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM pats)"""
# tests: words of C1 and changed ones
TESTS = """tests AS (SELECT CAST(row_number() OVER (ORDER BY word) AS BIGINT) AS row_id, word AS password FROM (SELECT DISTINCT word FROM c1 UNION SELECT 'Brand#99x' UNION SELECT '1-LOW' UNION SELECT 'zzz9' UNION SELECT '9-SPECIFIED NOT'))"""
PARSE = f"""{TESTS},
m AS (SELECT row_id, password, structure, prob AS sp, string_split(structure, 'E') AS ps FROM tests JOIN structures ON {classes('password')} = replace(structure, 'E', '')),
cut AS (SELECT row_id, password, structure, sp, ps, k, ps[k] AS piece, substr(password, 1 + CAST(coalesce(list_sum(list_transform(ps[1 : k - 1], lambda p: len(p))), 0) AS BIGINT), len(ps[k])) AS raw
 FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM m)),
ranked AS (SELECT term_key, terminal, prob, row_number() OVER (PARTITION BY term_key, prob ORDER BY terminal DESC) - 1 AS rank FROM terminals),
known AS (SELECT c.row_id, c.structure, c.sp, c.ps, c.k, c.piece, t.prob AS p, t.rank, g.group_idx, g.size, g.first_string FROM cut c
 LEFT JOIN ranked t ON t.term_key = translate(piece, 'U', 'L') AND t.terminal = lower(raw) LEFT JOIN groups g ON g.term_key = t.term_key AND g.prob = t.prob),
canonical AS (SELECT a.*, row_number() OVER (PARTITION BY row_id, structure, piece ORDER BY k) AS by_place, row_number() OVER (PARTITION BY row_id, structure, piece ORDER BY group_idx) AS by_group FROM known a),
placed AS (SELECT a.row_id, a.structure, a.sp, a.ps, a.k, a.piece, a.p AS own_p, a.rank, a.size, a.group_idx, b.p, b.first_string FROM canonical a LEFT JOIN canonical b
 ON a.row_id = b.row_id AND a.structure = b.structure AND a.piece = b.piece AND a.by_place = b.by_group),
parses AS (SELECT row_id, structure, sp, count(*) = count(own_p) AS parsed, list_reduce(list_prepend(sp, list(p ORDER BY k)), lambda a, b: a * b) AS prob,
 array_to_string(list({CASED.format('first_string', 'piece')} ORDER BY k), chr(1)) AS pattern,
 list_reduce(list_prepend(CAST(0 AS HUGEINT), list(CAST(rank AS HUGEINT) * 1000000000 + size ORDER BY k)), lambda a, b: a * (b % 1000000000) + b // 1000000000) AS digits,
 list_reduce(list(CAST(size AS HUGEINT) ORDER BY k), lambda a, b: a * b) AS whole,
 count(*) FILTER (piece = 'S') = 2 AND arg_min(group_idx, k) FILTER (piece = 'S') > arg_max(group_idx, k) FILTER (piece = 'S') AS turned
 FROM placed GROUP BY row_id, structure, sp)"""
BEST = f"""{PARSE},
best AS (SELECT row_id, arg_max(p, (prob, sp, structure)) FILTER (parsed) AS b, count(*) FILTER (parsed) AS parses, sum(prob) FILTER (parsed) AS sum_prob FROM parses p GROUP BY row_id),
found AS (SELECT t.row_id, t.password, CASE WHEN best.row_id IS NULL THEN 4 WHEN parses = 0 THEN 40 ELSE 1 END AS status, b.prob AS prob, b.pattern AS pattern, CASE WHEN b.turned THEN b.whole ELSE 0 END + b.digits AS rank, parses, sum_prob
 FROM tests t LEFT JOIN best USING (row_id))"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def c1(s: SparkSession, d: str) -> DataFrame:
    return S.mixed_corpus(s, d)


def c2(s: SparkSession, d: str) -> DataFrame:
    return S.token_corpus(s, d)


def c3(s: SparkSession, d: str) -> DataFrame:
    return S.results_frame(s, d)


def tagged(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.array_join("tags", ","))


class Grammar:
    """Learned from C1 when it is asked for; what is read more than once is written. With unseen, groups of unseen terminals are there, too."""

    def __init__(self, s: SparkSession, d: str, unseen: bool = False):
        self.s, self.d, self.unseen = s, d, unseen

    @cached_property
    def tokens(self) -> DataFrame:
        return stash(tokens_of(self.s, self.d), "tokens")

    @cached_property
    def structures(self) -> DataFrame:
        return stash(G.learn_structures(self.tokens), "structures")

    @cached_property
    def terminals(self) -> DataFrame:
        return G.learn_terminals(self.tokens, self.unseen)

    @cached_property
    def ranked(self) -> DataFrame:
        return stash(G.terminal_ranks(self.terminals), "terminals")

    @cached_property
    def groups(self) -> DataFrame:
        seen = self.__dict__.get("ranked", self.terminals)
        made = G.unseen_groups(seen, G.unseen_mass(G.terminal_counts(self.tokens))) if self.unseen else None
        return stash(G.terminal_groups(seen, made), "groups")

    def looked_up(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Structures, terminals with ranks, and groups."""
        ranked = self.ranked
        return self.structures, ranked, self.groups


def tokens_of(s: SparkSession, d: str) -> DataFrame:
    """Repeated words are summed first."""
    return W.tokenize(W.wordfreq(c1(s, d)))


def tests(s: SparkSession, d: str) -> DataFrame:
    """Distinct words of C1 and some changed ones, numbered by text."""
    extra = s.createDataFrame([("Brand#99x",), ("1-LOW",), ("zzz9",), ("9-SPECIFIED NOT",)], "word string")
    words = c1(s, d).select("word").union(extra).distinct().withColumn("one", F.lit(1).cast("decimal(38,0)"))
    return running_sum(words, [F.asc("word")], "one", "n").select((F.col("n") + 1).cast("long").alias("row_id"), F.col("word").alias("password"))


def whole(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# corpora


@query("wordfreq_basic", f"WITH {C2} SELECT word, CAST(count(*) AS DOUBLE) AS freq, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM c2 GROUP BY word")
def _(s, d):
    return tagged(W.wordfreq(c2(s, d)))


@query("wordfreq_weighted", f"WITH {C2} SELECT word, 2.5 * count(*) AS freq, 'X' AS tags FROM c2 GROUP BY word".replace("2.5 * count(*)", "CAST(2.5 * count(*) AS DOUBLE)"))
def _(s, d):
    return tagged(W.wordfreq(c2(s, d), 2.5, replace_tag="X"))


@query("tag_add", f"WITH {C1} SELECT word, CAST(count(*) AS DOUBLE) AS freq, string_agg(DISTINCT t, ',' ORDER BY t) AS tags FROM (SELECT word, unnest([tag, 'A']) AS t, tag FROM c1) GROUP BY word".replace("count(*)", "count(*) / 2"))
def _(s, d):
    return tagged(W.wordfreq(c1(s, d), add_tag="A"))


@query("corpus_summary", f"WITH {C2}, w AS (SELECT word, CAST(count(*) AS DOUBLE) AS f FROM c2 WHERE NOT contains(word, chr(1)) GROUP BY word) SELECT (SELECT count(*) FROM c2 WHERE NOT contains(word, chr(1))) AS kept, (SELECT count(*) FROM c2 WHERE contains(word, chr(1))) AS discarded, count(*) AS distinct_words, max(f) AS max_freq, sum(f) AS total, 1 / max(f) AS inverse_max FROM w")
def _(s, d):
    return W.summary(c2(s, d))


@query("only_measure", f"WITH {C2} SELECT CAST(count(*) AS DOUBLE) AS total FROM c2")
def _(s, d):
    return W.measure(c2(s, d))


@query("relative_weight", f"WITH {C2}, a AS (SELECT count(*) AS n FROM c2 WHERE doc_id % 10 < 8), b AS (SELECT count(*) AS n FROM c2 WHERE doc_id % 10 >= 8) SELECT word, round(sum(CAST(a.n AS DOUBLE) / b.n * 3), 6) AS freq FROM c2, a, b WHERE doc_id % 10 >= 8 GROUP BY word")
def _(s, d):
    df = c2(s, d)
    out = W.relative_weight(df.filter("doc_id % 10 < 8"), df.filter("doc_id % 10 >= 8"), 3)
    return W.wordfreq(out).select("word", F.round("freq", 6).alias("freq"))


@query("equal_weight", f"WITH {C1}, a AS (SELECT count(*) AS n FROM c1 WHERE tag = 'P'), b AS (SELECT count(*) AS n FROM c1 WHERE tag = 'O') SELECT word, round(sum(CASE WHEN tag = 'P' THEN 1 ELSE CAST(a.n AS DOUBLE) / b.n END), 6) AS freq, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM c1, a, b WHERE tag IN ('P', 'O') GROUP BY word")
def _(s, d):
    df = c1(s, d)
    out = W.equal_weight(df.filter("tags[0] = 'P'"), df.filter("tags[0] = 'O'"))
    return tagged(out).withColumn("freq", F.round("freq", 6))


for _name, _keep, _pred in (
    ("filter_basic6", True, "strlen(word) >= 6"),
    ("filter_4class8", True, "strlen(word) >= 8 AND regexp_matches(word, '[a-z]') AND regexp_matches(word, '[A-Z]') AND regexp_matches(word, '[0-9]') AND regexp_matches(word, '[^a-zA-Z0-9]')"),
    ("filter_non4class8", False, "NOT (strlen(word) >= 8 AND regexp_matches(word, '[a-z]') AND regexp_matches(word, '[A-Z]') AND regexp_matches(word, '[0-9]') AND regexp_matches(word, '[^a-zA-Z0-9]'))"),
):
    query(_name, f"WITH {C1} SELECT word, count(*) AS n FROM c1 WHERE {_pred} GROUP BY word")(
        lambda s, d, name=_name, keep=_keep: W.policy(c1(s, d), name.split("_")[1].removeprefix("non"), keep).groupBy("word").agg(F.count("*").alias("n"))
    )


@query("extract_strings", f"WITH {C1} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(word), '[a-z]+')) AS word FROM c1) GROUP BY word")
def _(s, d):
    return W.strings_of(c1(s, d)).groupBy("word").agg(F.count("*").alias("n"))


@query("extract_strings_cased", f"WITH {C1} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(word, '[A-Za-z]+')) AS word FROM c1) GROUP BY word")
def _(s, d):
    return W.strings_of(c1(s, d), lower=False).groupBy("word").agg(F.count("*").alias("n"))


@query("extract_digsym", f"WITH {C1} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(word, '[0-9]+') || regexp_extract_all(word, '[^A-Za-z0-9]+')) AS word FROM c1) GROUP BY word")
def _(s, d):
    return W.digits_and_symbols_of(c1(s, d)).groupBy("word").agg(F.count("*").alias("n"))


@query("tokenize_charclass", f"WITH {C1} SELECT {TOKENS.format('word')} AS word, CAST(count(*) AS DOUBLE) AS freq FROM c1 GROUP BY 1")
def _(s, d):
    return W.wordfreq(W.tokenize(c1(s, d)), allow_breaks=True).select("word", "freq")


@query("tokenize_hybrid", f"WITH {C1}, t AS (SELECT word, {TOKENS.format('word')} AS tok FROM c1) SELECT word, sum(f) AS freq FROM (SELECT word, 1.0::DOUBLE AS f FROM t UNION ALL SELECT tok, 0.25::DOUBLE FROM t WHERE tok <> word) GROUP BY word")
def _(s, d):
    return W.wordfreq(W.tokenize(c1(s, d), 0.25), allow_breaks=True).select("word", "freq")


@query("strip_breaks", f"WITH {C1} SELECT DISTINCT word FROM c1")
def _(s, d):
    return W.tokenize(c1(s, d)).select(X.strip_breaks("word").alias("word")).distinct()


@query("to_three_column", "SELECT 'no_user' AS user_id, 'suppliers' AS policy, s_name AS password FROM supplier")
def _(s, d):
    return W.three_columns(S.table(s, d, "supplier").selectExpr("s_name AS word"), "suppliers")


@query("sample_remainder", "SELECT least(1000, count(*)) AS taken, greatest(count(*) - 1000, 0) AS remainder, count(*) - count(DISTINCT o_orderkey) AS both_sides FROM orders")
def _(s, d):
    rows = S.table(s, d, "orders").select("o_orderkey")
    a, b = W.sample(rows, 1000, 17, ["o_orderkey"])
    one = a.withColumn("x", F.lit(1)).unionByName(b.withColumn("x", F.lit(2))).groupBy("o_orderkey").agg(F.sum("x").alias("x"))
    return one.agg(F.count_if(F.col("x") == 1).alias("taken"), F.count_if(F.col("x") == 2).alias("remainder"), F.count_if(F.col("x") > 2).alias("both_sides"))


@query("uniformize", f"WITH {C1}, t AS (SELECT unnest(string_split({TOKENS.format('word')}, chr(1))) AS word FROM c1) SELECT word, CASE WHEN regexp_full_match(word, '[A-Za-z]+') THEN 1.0::DOUBLE ELSE CAST(count(*) AS DOUBLE) END AS freq FROM t GROUP BY word")
def _(s, d):
    return W.uniformize(W.tokenize(c1(s, d))).select("word", "freq")


@query("combine_terminals", f"WITH {C1}, t AS (SELECT {TOKENS.format('word')} AS word, tag FROM c1 WHERE tag = 'P' UNION ALL SELECT word, tag FROM c1 WHERE tag <> 'P') SELECT word, CAST(count(*) AS DOUBLE) AS freq, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM t GROUP BY word")
def _(s, d):
    df = c1(s, d)
    return tagged(W.combine([W.tokenize(df.filter("tags[0] = 'P'")), df.filter("tags[0] <> 'P'")]))


@query("tokens_by_length", f"WITH {C1}, t AS (SELECT unnest(string_split({TOKENS.format('word')}, chr(1))) AS token FROM c1) SELECT CAST(strlen(token) AS INTEGER) AS len, count(*) AS tokens FROM t GROUP BY 1")
def _(s, d):
    return W.split_by_length(W.tokenize(c1(s, d))).groupBy("len").agg(F.count("*").alias("tokens"))


@query("max_length_filter", f"WITH {C2} SELECT count(*) FILTER (strlen(word) <= 40) AS short, count(*) FILTER (strlen(word) > 40) AS long FROM c2")
def _(s, d):
    good = F.octet_length("word") <= X.LONGEST
    return c2(s, d).agg(F.count_if(good).alias("short"), F.count_if(~good).alias("long"))


# grammar


#: Each byte of a character is a symbol of its own.
BYTES = r"regexp_replace(regexp_replace(regexp_replace(word, '[\x{80}-\x{7FF}]', '~~', 'g'), '[\x{800}-\x{FFFF}]', '~~~', 'g'), '[\x{10000}-\x{10FFFF}]', '~~~~', 'g')"


@query("class_string", f"WITH {C2} SELECT {classes(BYTES)} AS structure, count(*) AS n FROM c2 GROUP BY 1")
def _(s, d):
    return c2(s, d).groupBy(X.structure("word").alias("structure")).agg(F.count("*").alias("n"))


@query("learn_structures", f"WITH {LEARN} SELECT structure, prob FROM structures")
def _(s, d):
    return G.learn_structures(tokens_of(s, d)).select("structure", "prob")


@query("learn_terminals", f"WITH {LEARN} SELECT term_key, terminal, prob FROM terminals")
def _(s, d):
    return G.learn_terminals(tokens_of(s, d)).select("term_key", "terminal", "prob")


@query("terminal_ranks", f"WITH {LEARN} SELECT term_key, terminal, CAST(row_number() OVER (PARTITION BY term_key, prob ORDER BY terminal DESC) - 1 AS BIGINT) AS rank FROM terminals")
def _(s, d):
    return whole(G.terminal_ranks(G.learn_terminals(tokens_of(s, d))).select("term_key", "terminal", "rank"), "rank")


@query("terminal_groups", f"WITH {LEARN} SELECT term_key, CAST(group_idx AS INTEGER) AS group_idx, prob, size, first_string FROM groups")
def _(s, d):
    return whole(G.terminal_groups(G.learn_terminals(tokens_of(s, d))).select("term_key", "group_idx", "prob", "size", "first_string"), "size")


@query("singleton_mass", f"WITH {LEARN}, f AS (SELECT term_key, freq, count(*) AS n FROM tcounts GROUP BY 1, 2) SELECT term_key, sum(freq * n) AS total, min(freq) AS min_freq, CAST(sum(n) AS BIGINT) AS seen, arg_max(freq, (n, -freq)) AS common_freq, max(n) AS common_n FROM f GROUP BY 1")
def _(s, d):
    return G.singleton_mass(G.terminal_counts(W.tokenize(c1(s, d))))


MASS = """f AS (SELECT term_key, freq, count(*) AS n FROM tcounts GROUP BY 1, 2),
facts AS (SELECT term_key, sum(freq * n) AS total, min(freq) AS mf, sum(n) AS seen, arg_max(freq, (n, -freq)) AS cf, max(n) AS cn,
 pow(26, len(term_key) - len(replace(term_key, 'L', ''))) * pow(10, len(term_key) - len(replace(term_key, 'D', ''))) * pow(33, len(term_key) - len(replace(term_key, 'S', ''))) AS combos FROM f GROUP BY 1),
us AS (SELECT *, least(cf * cn / total, 0.999::DOUBLE) AS u, combos - seen AS k FROM facts),
masses AS (SELECT term_key, seen, combos, CASE WHEN k <= 0 THEN 0 WHEN 1.25::DOUBLE * u / k > mf / (total / (1 - u)) THEN 1 / (1 + 1.25::DOUBLE * total / (k * mf)) ELSE u END AS unseen_mass FROM us)"""


@query("good_turing_unseen", f"WITH {LEARN}, {MASS} SELECT term_key, CAST(seen AS BIGINT) AS seen, CAST(round(unseen_mass, 9) AS DOUBLE) AS unseen_mass FROM masses")
def _(s, d):
    return G.unseen_mass(G.terminal_counts(W.tokenize(c1(s, d)))).select("term_key", "seen", F.round("unseen_mass", 9).alias("unseen_mass"))


@query("terminals_with_unseen", f"WITH {LEARN}, {MASS} SELECT term_key, terminal, round(prob * (1 - unseen_mass), 9) AS prob FROM terminals JOIN masses USING (term_key)")
def _(s, d):
    return G.learn_terminals(W.tokenize(c1(s, d)), unseen=True).select("term_key", "terminal", F.round("prob", 9).alias("prob"))


SYMBOLS = X.SYMBOLS.replace("'", "''").replace("{", "{{").replace("}", "}}")  # what follows is formatted
RADIX = "CASE {0} WHEN 'D' THEN 10 WHEN 'S' THEN 33 ELSE 26 END"
#: The index of a terminal, and the terminal of an index, first character least significant.
INDEX = f"""list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(list_reverse(string_split({{0}}, '')), lambda c: CAST(CASE WHEN c BETWEEN 'a' AND 'z' THEN (ord(c) - 97) * 100 + 26
 WHEN c BETWEEN '0' AND '9' THEN (ord(c) - 48) * 100 + 10 ELSE (strpos('{SYMBOLS}', c) - 1) * 100 + 33 END AS HUGEINT))), lambda a, x: a * (x % 100) + x // 100)"""
UNINDEX = f"""array_to_string(list_transform(range(1, len({{1}}) + 1), lambda k: substr(CASE {{1}}[k] WHEN 'D' THEN '0123456789' WHEN 'S' THEN '{SYMBOLS}' ELSE 'abcdefghijklmnopqrstuvwxyz' END, 1 + CAST(({{0}}
 // list_reduce(list_prepend(CAST(1 AS HUGEINT), list_transform(range(1, k), lambda j: CAST({RADIX.format('{1}[j]')} AS HUGEINT))), lambda a, b: a * b)) % {RADIX.format('{1}[k]')} AS BIGINT), 1)), '')"""


@query("unseen_index", f"WITH {LEARN} SELECT terminal, CAST({INDEX.format('terminal')} AS BIGINT) AS idx FROM terminals")
def _(s, d):
    return whole(G.learn_terminals(tokens_of(s, d)).select("terminal", X.unseen_index("terminal").alias("idx")), "idx")


#: Probes: the first hundred strings of each mask, and those after a seen one.
PROBED = f"""si AS (SELECT term_key, {INDEX.format('terminal')} AS idx FROM terminals), ks AS (SELECT DISTINCT term_key FROM terminals),
probes AS (SELECT term_key, CAST(range AS HUGEINT) AS idx FROM ks, range(100) UNION SELECT term_key, idx + 1 FROM si),
possible AS (SELECT * FROM probes WHERE idx < list_reduce(list_prepend(CAST(1 AS HUGEINT), list_transform(string_split(term_key, ''), lambda m: CAST({RADIX.format('m')} AS HUGEINT))), lambda a, b: a * b))"""


@query("unseen_rank", f"WITH {LEARN}, {PROBED}, l AS (SELECT term_key, idx, max(seen) AS seen, coalesce(sum(max(seen)) OVER (PARTITION BY term_key ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT term_key, idx, 1 AS seen FROM si UNION ALL SELECT term_key, idx, 0 FROM possible) GROUP BY term_key, idx) SELECT term_key, CAST(idx AS BIGINT) AS idx, CAST(idx - below AS BIGINT) AS rank FROM l WHERE seen = 0")
def _(s, d):
    terminals = stash(G.learn_terminals(tokens_of(s, d)), "terminals")
    after = terminals.filter(X.generatable("terminal", "term_key")).select("term_key", X.wide_next(X.wide_index("terminal")).alias("idx"))
    first = terminals.select("term_key").distinct().select("term_key", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("n"))
    probes = first.select("term_key", X.wide_of(F.col("n").cast("decimal(38,0)")).alias("idx")).unionByName(after).distinct()
    ranks = U.unseen_ranks(probes.filter(F.col("idx") < X.wide_combinations("term_key")), terminals)
    return whole(ranks.select("term_key", X.wide_narrow(F.col("idx")).alias("idx"), X.wide_narrow(F.col("rank")).alias("rank")), "idx", "rank")


@query("nonterminal_mass", f"WITH {LEARN}, x AS (SELECT translate(unnest(string_split(structure, 'E')), 'U', 'L') AS term_key, prob FROM structures) SELECT term_key, round(sum(prob) / (SELECT sum(prob) FROM x), 9) AS share FROM x GROUP BY 1")
def _(s, d):
    return G.nonterminal_mass(G.learn_structures(tokens_of(s, d))).select("term_key", F.round("share", 9).alias("share"))


@query("quant_level_need", f"WITH {LEARN}, x AS (SELECT translate(unnest(string_split(structure, 'E')), 'U', 'L') AS term_key, prob FROM structures) SELECT term_key, CAST(ceil(round(100 * sum(prob) / (SELECT sum(prob) FROM x), 9)) AS BIGINT) AS need FROM x GROUP BY 1")
def _(s, d):
    return G.nonterminal_mass(G.learn_structures(tokens_of(s, d))).select("term_key", F.ceil(F.round(100 * F.col("share"), 9)).alias("need"))


@query("quantized_terminals")
def _(s, d):
    """Without SQL: tests/test_quantize.py tries all divisions."""
    g = Grammar(s, d)
    return Q.quantize(g.terminals, g.structures, Condition("c1").totalquantlevels)


# patterns and lookups


@query("patterns_cutoff", f"{ENUMERATE} SELECT prob, n, pattern FROM pats")
def _(s, d):
    g = Grammar(s, d)
    structures, groups = g.structures, g.groups
    return whole(P.patterns(structures, groups, CUTOFF), "n")


@query("lookup_table", f"{ENUMERATE} SELECT prob, n, start, pattern FROM lt")
def _(s, d):
    g = Grammar(s, d)
    structures, groups = g.structures, g.groups
    return whole(P.lookup_table(P.patterns(structures, groups, CUTOFF)), "n", "start")


@query("total_count", f"{ENUMERATE} SELECT CAST(sum(n) AS BIGINT) AS total FROM pats")
def _(s, d):
    g = Grammar(s, d)
    structures, groups = g.structures, g.groups
    return whole(P.total_count(P.patterns(structures, groups, CUTOFF)), "total")


@query("grammar_size", f"WITH {LEARN}, x AS (SELECT structure, k, ps[k] AS piece FROM (SELECT structure, string_split(structure, 'E') AS ps, unnest(range(1, len(string_split(structure, 'E')) + 1)) AS k FROM structures)), n AS (SELECT term_key, sum(size) AS n FROM groups GROUP BY 1) SELECT structure, CAST(list_reduce(list(n.n ORDER BY k), lambda a, b: a * b) AS BIGINT) AS strings FROM x JOIN n ON n.term_key = translate(piece, 'U', 'L') GROUP BY structure")
def _(s, d):
    g = Grammar(s, d)
    structures, groups = g.structures, g.groups
    n = groups.groupBy("term_key").agg(F.sum("size").alias("n"))
    parts = P.pieces(structures).select("structure", F.posexplode("pieces").alias("k", "piece")).join(n, X.term_key("piece") == F.col("term_key"))
    product = F.aggregate(F.collect_list("n"), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))
    return whole(parts.groupBy("structure").agg(product.alias("strings")), "strings")


@query("generate_strings", f"""{ENUMERATE}, chosen AS (SELECT structure, ps, prob, idx FROM alls),
mem AS (SELECT t.term_key, group_idx, terminal FROM terminals t JOIN groups g ON t.term_key = g.term_key AND t.prob = g.prob),
str AS (SELECT structure, ps, prob, idx, '' AS string, 0 AS k FROM chosen UNION ALL
 SELECT structure, ps, prob, idx, string || CASE WHEN k > 0 THEN chr(1) ELSE '' END || {CASED.format('terminal', 'ps[k + 1]')}, k + 1 FROM str JOIN mem ON mem.term_key = translate(ps[k + 1], 'U', 'L') AND mem.group_idx = idx[k + 1] WHERE k < len(ps))
SELECT prob, string FROM str WHERE k = len(ps)""")
def _(s, d):
    g = Grammar(s, d)
    structures, terminals, groups = g.structures, g.terminals, g.groups
    return P.strings(structures, terminals, groups, CUTOFF).select("prob", "string")


@query("accurate_strings", SQL["generate_strings"].replace("SELECT prob, string FROM str WHERE k = len(ps)", "SELECT replace(string, chr(1), '') AS bare, round(sum(prob), 12) AS prob, count(*) AS parses FROM str WHERE k = len(ps) GROUP BY 1"))
def _(s, d):
    g = Grammar(s, d)
    structures, terminals, groups = g.structures, g.terminals, g.groups
    made = P.strings(structures, terminals, groups, CUTOFF)
    return P.accurate_strings(made).select("bare", F.round("prob", 12).alias("prob"), "parses")


@query("count_parses", f"WITH {LEARN}, {BEST} SELECT row_id, CAST(coalesce(parses, 0) AS BIGINT) AS parses FROM found")
def _(s, d):
    structures, terminals, groups = Grammar(s, d).looked_up()
    t = tests(s, d)
    return L.best_parses(t, L.parses(t, structures, terminals, groups), structures).select("row_id", "parses")


@query("lookup_best_parse", f"WITH {LEARN}, {BEST} SELECT row_id, password, CAST(status AS INTEGER) AS status, coalesce(prob, -1) AS prob, coalesce(pattern, '') AS pattern, CAST(coalesce(rank, -1) AS BIGINT) AS rank FROM found")
def _(s, d):
    structures, terminals, groups = Grammar(s, d).looked_up()
    t = tests(s, d)
    best = L.best_parses(t, L.parses(t, structures, terminals, groups), structures)
    rank = F.coalesce("rank", F.lit(-1)).cast("long").alias("rank")
    return best.select("row_id", "password", "status", "prob", F.coalesce("pattern", F.lit("")).alias("pattern"), rank)


@query("lookup_sum", f"WITH {LEARN}, {BEST} SELECT row_id, round(coalesce(sum_prob, 0), 12) AS sum_prob FROM found")
def _(s, d):
    structures, terminals, groups = Grammar(s, d).looked_up()
    t = tests(s, d)
    return L.best_parses(t, L.parses(t, structures, terminals, groups), structures).select("row_id", F.round("sum_prob", 12).alias("sum_prob"))


GUESSES = f"{ENUMERATE}, {BEST}, guesses AS (SELECT row_id, password, f.prob, CASE WHEN start IS NOT NULL THEN start + rank WHEN status = 1 THEN -2 ELSE -status END AS guess FROM found f LEFT JOIN lt ON lt.pattern = f.pattern AND lt.prob = f.prob)"


@query("guess_numbers", f"{GUESSES} SELECT row_id, password, coalesce(prob, -1) AS prob, CAST(guess AS BIGINT) AS guess_number FROM guesses")
def _(s, d):
    structures, terminals, groups = Grammar(s, d).looked_up()
    return whole(L.lookup(tests(s, d), structures, terminals, groups, CUTOFF).select("row_id", "password", "prob", "guess_number"), "guess_number")


def with_unseen(sql: str) -> str:
    """The SQL of a grammar or a lookup, with groups of unseen terminals."""
    learned = "terminals AS (SELECT term_key, terminal, freq / sum(freq) OVER (PARTITION BY term_key) AS prob FROM tcounts)"
    made = f"""{MASS}, terminals AS (SELECT term_key, terminal, freq / (total / (1 - unseen_mass)) AS prob FROM tcounts JOIN masses USING (term_key) JOIN (SELECT term_key, sum(freq) AS total FROM tcounts GROUP BY 1) USING (term_key)),
si AS (SELECT term_key, {INDEX.format('terminal')} AS idx FROM terminals),
gaps AS (SELECT term_key, min(idx) AS gap FROM (SELECT term_key, CAST(0 AS HUGEINT) AS idx FROM masses UNION SELECT term_key, idx + 1 FROM si) p WHERE NOT EXISTS (SELECT 1 FROM si WHERE si.term_key = p.term_key AND si.idx = p.idx) GROUP BY 1),
unseen AS (SELECT term_key, unseen_mass / (combos - seen) AS prob, CAST(combos AS HUGEINT) - CAST(seen AS HUGEINT) AS size, {UNINDEX.format('gap', 'term_key')} AS first_string FROM masses JOIN gaps USING (term_key) WHERE unseen_mass > 0)"""
    plain = "groups AS (SELECT term_key, prob, count(*) AS size, max(terminal) AS first_string, row_number() OVER (PARTITION BY term_key ORDER BY prob DESC) - 1 AS group_idx FROM terminals GROUP BY 1, 2)"
    both = "groups AS (SELECT term_key, prob, size, first_string, is_unseen, row_number() OVER (PARTITION BY term_key ORDER BY prob DESC, is_unseen) - 1 AS group_idx FROM (SELECT term_key, prob, CAST(count(*) AS HUGEINT) AS size, max(terminal) AS first_string, false AS is_unseen FROM terminals GROUP BY 1, 2 UNION ALL SELECT term_key, prob, size, first_string, true FROM unseen))"
    known = "t.prob AS p, t.rank, g.group_idx, g.size, g.first_string FROM cut c"
    joined = "g.prob AS p, coalesce(CAST(t.rank AS HUGEINT), u.rank) AS rank, g.group_idx, g.size, g.first_string FROM cut c"
    on = "LEFT JOIN groups g ON g.term_key = t.term_key AND g.prob = t.prob)"
    lacking = f"""LEFT JOIN lacking u ON t.terminal IS NULL AND u.term_key = translate(piece, 'U', 'L') AND u.terminal = lower(raw)
 LEFT JOIN groups g ON (t.terminal IS NOT NULL AND g.term_key = t.term_key AND g.prob = t.prob AND NOT g.is_unseen) OR (u.terminal IS NOT NULL AND g.term_key = u.term_key AND g.is_unseen))"""
    asked = f"""lacking AS (SELECT term_key, terminal, idx - (SELECT count(*) FROM si WHERE si.term_key = q.term_key AND si.idx < q.idx) AS rank FROM (SELECT DISTINCT translate(piece, 'U', 'L') AS term_key, lower(raw) AS terminal, {INDEX.format('lower(raw)')} AS idx
 FROM cut WHERE regexp_full_match(raw, '[ -~]+')) q WHERE NOT EXISTS (SELECT 1 FROM terminals t WHERE t.term_key = q.term_key AND t.terminal = q.terminal)),
known AS ("""
    for old, new in ((learned, made), (plain, both), (known, joined), (on, lacking), ("known AS (", asked), ("1000000000", "1000000000000000000"), ("n * g.size", "CAST(n AS HUGEINT) * g.size")):
        sql = sql.replace(old, new)
    return sql


@query("groups_with_unseen", with_unseen(f"WITH {LEARN} SELECT term_key, CAST(group_idx AS INTEGER) AS group_idx, prob, CAST(size AS VARCHAR) AS size_text, first_string, is_unseen FROM groups"))
def _(s, d):
    return Grammar(s, d, unseen=True).groups.select("term_key", "group_idx", "prob", "size_text", "first_string", "is_unseen")


@query("guess_numbers_unseen", with_unseen(f"{GUESSES} SELECT row_id, password, coalesce(prob, -1) AS prob, CAST(guess AS BIGINT) AS guess_number FROM guesses"))
def _(s, d):
    structures, terminals, groups = Grammar(s, d, unseen=True).looked_up()
    return whole(L.lookup(tests(s, d), structures, terminals, groups, CUTOFF, unseen=True).select("row_id", "password", "prob", "guess_number"), "guess_number")


def stored_table(g: Grammar, cutoff: float) -> str:
    """Writes the grammar's lookup table into the shared folder, once for each call."""
    path = shared_path(g.s, "table")
    T.store(P.lookup_table(P.patterns(g.structures, g.groups, cutoff)), path)
    return path


@query("guess_numbers_stored", SQL["guess_numbers"])
def _(s, d):
    g = Grammar(s, d)
    structures, terminals, groups = g.looked_up()
    t = tests(s, d)
    best = stash(L.best_parses(t, L.parses(t, structures, terminals, groups, cutoff=CUTOFF), structures), "best")
    return whole(T.find(s, stored_table(g, CUTOFF), best).select("row_id", "password", "prob", "guess_number"), "guess_number")


#: Every number of the table is that of one string, so the strings in the order of their numbers follow from those of the patterns.
@query("strings_of_numbers", f"{ENUMERATE}, {BEST}, guesses AS (SELECT password, start + rank AS guess FROM found f JOIN lt ON lt.pattern = f.pattern AND lt.prob = f.prob) SELECT CAST(guess AS BIGINT) AS number, password AS string FROM guesses")
def _(s, d):
    """From tests to numbers to strings: the tests come back."""
    g = Grammar(s, d)
    structures, terminals, groups = g.looked_up()
    path = stored_table(g, CUTOFF)
    t = tests(s, d)
    best = stash(L.best_parses(t, L.parses(t, structures, terminals, groups, cutoff=CUTOFF), structures), "best")
    numbers = stash(T.find(s, path, best).filter("guess_number > 0").select("row_id", F.col("guess_number").alias("number")), "numbers")
    found = stash(T.patterns_at(s, path, numbers), "found")
    made = T.strings_at(found, terminals, groups).join(numbers, "row_id")
    return whole(made.select("number", X.strip_breaks("string").alias("string")), "number")


@query("experiment", with_unseen(f"{GUESSES} SELECT 'tests' AS condition, password AS brokenpassword, coalesce(prob, -1) AS probability, CAST(guess AS BIGINT) AS guess_number FROM guesses"))
def _(s, d):
    """A whole condition, from its settings to results."""
    plan = Condition("c1", structure_sources=[Source("words", "c1")], test_sources=[Source("tests", "tests")], generate_unseen_terminals=True, totalquantlevels=0, cutoffmin=6, cutoffmax=6)
    read = {"c1": lambda: c1(s, d), "tests": lambda: tests(s, d).select(F.col("password").alias("word"))}
    results = experiment.run(s, plan, lambda name: read[name]())["1e-6"]
    return whole(results.select("condition", "brokenpassword", "probability", "guess_number"), "guess_number")


UNSEEN_STRINGS = with_unseen(SQL["generate_strings"].replace(str(CUTOFF), "1e-05")).replace(
    "mem AS (SELECT t.term_key, group_idx, terminal FROM terminals t JOIN groups g ON t.term_key = g.term_key AND t.prob = g.prob)",
    f"""mem AS (SELECT t.term_key, group_idx, terminal FROM terminals t JOIN groups g ON t.term_key = g.term_key AND t.prob = g.prob AND NOT g.is_unseen
 UNION ALL SELECT * FROM (SELECT term_key, group_idx, {UNINDEX.format('idx', 'term_key')} AS terminal FROM (SELECT g.term_key, group_idx, CAST(unnest(range(CAST(combos AS BIGINT))) AS HUGEINT) AS idx FROM groups g JOIN masses USING (term_key) WHERE is_unseen AND prob >= 1e-05)) m
 WHERE NOT EXISTS (SELECT 1 FROM terminals t WHERE t.term_key = m.term_key AND t.terminal = m.terminal))""",
)


@query("generate_strings_unseen", UNSEEN_STRINGS)
def _(s, d):
    g = Grammar(s, d, unseen=True)
    return P.strings(g.structures, g.terminals, g.groups, 1e-5, unseen=True).select("prob", "string")


@query("lookup_status", f"{GUESSES} SELECT CASE WHEN guess > 0 THEN 'Guessed' WHEN guess = -2 THEN 'Beyond cutoff' WHEN guess = -4 THEN 'Structure not found' WHEN guess = -40 THEN 'Chunk not found' END AS status, count(*) AS n FROM guesses GROUP BY 1")
def _(s, d):
    structures, terminals, groups = Grammar(s, d).looked_up()
    out = L.lookup(tests(s, d), structures, terminals, groups, CUTOFF)
    return out.groupBy(A.status_label("guess_number").alias("status")).agg(F.count("*").alias("n"))


# analysis


@query("status_labels", f"WITH {C3} SELECT condition, CASE WHEN guess > 0 THEN 'Guessed' WHEN guess = -2 THEN 'Beyond cutoff' ELSE 'Structure not found' END AS status, count(*) AS n FROM c3 GROUP BY 1, 2")
def _(s, d):
    return c3(s, d).groupBy("condition", A.status_label().alias("status")).agg(F.count("*").alias("n"))


@query("rename_conditions", f"WITH {C3} SELECT CASE condition WHEN 'view' THEN 'seen' WHEN 'click' THEN 'pressed' ELSE condition END AS condition, count(*) AS n FROM c3 GROUP BY 1")
def _(s, d):
    return A.rename_conditions(c3(s, d), {"view": "seen", "click": "pressed"}).groupBy("condition").agg(F.count("*").alias("n"))


STEPS = f"{C3}, t AS (SELECT condition, count(*) AS total FROM c3 GROUP BY 1), g AS (SELECT condition, guess, count(*) AS n FROM c3 WHERE guess > 0 GROUP BY 1, 2), e AS (SELECT condition, guess, CAST(sum(n) OVER (PARTITION BY condition ORDER BY guess) AS BIGINT) AS found, total FROM g JOIN t USING (condition))"


@query("ecdf", f"WITH {STEPS} SELECT condition, guess, found, found / CAST(total AS DOUBLE) AS share FROM e")
def _(s, d):
    return A.ecdf(c3(s, d))


@query("quantile_type1", f"WITH {C3} SELECT condition, percentile_disc(0.75) WITHIN GROUP (ORDER BY CASE WHEN guess > 0 THEN CAST(guess AS DOUBLE) ELSE 'infinity'::DOUBLE END) AS quantile FROM c3 GROUP BY 1")
def _(s, d):
    return A.quantiles(c3(s, d), 0.75)


WORK = f"{STEPS}, w AS (SELECT condition, guess, (coalesce(sum(guess * n) OVER b, 0) + guess * (total - coalesce(sum(n) OVER b, 0))) / CAST(total AS DOUBLE) AS guesswork FROM g JOIN t USING (condition) WINDOW b AS (PARTITION BY condition ORDER BY guess ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query("guesswork", f"WITH {WORK} SELECT condition, guess, round(guesswork, 6) AS guesswork FROM w")
def _(s, d):
    return A.guesswork(c3(s, d)).withColumn("guesswork", F.round("guesswork", 6))


@query("max_per_condition", f"WITH {WORK} SELECT condition, max(guess) AS max_guess, round(max(guesswork), 6) AS max_guesswork, (SELECT max(found / CAST(total AS DOUBLE)) FROM e WHERE e.condition = w.condition) AS max_share FROM w GROUP BY condition")
def _(s, d):
    return A.maxima(c3(s, d)).withColumn("max_guesswork", F.round("max_guesswork", 6))


POINTS = [1, 1000, 3000, 10_000, 1_000_000]


@query("guess_table", f"WITH {C3} SELECT condition, CAST(point AS BIGINT) AS point, round(avg(CASE WHEN guess > 0 AND guess <= point THEN 100.0::DOUBLE ELSE 0 END), 9) AS percent FROM c3, unnest({POINTS}) AS p(point) GROUP BY 1, 2")
def _(s, d):
    return A.percent_table(c3(s, d), POINTS).withColumn("percent", F.round("percent", 9))


@query("status_proportions", f"WITH {C3}, l AS (SELECT unnest(['Guessed', 'Beyond cutoff', 'Chunk not found', 'Structure not found']) AS status, unnest([1, -2, -40, -4]) AS code), t AS (SELECT condition, count(*) AS total FROM c3 GROUP BY 1) SELECT t.condition, l.status, count(c3.event_id) AS n, count(c3.event_id) / CAST(any_value(total) AS DOUBLE) AS share FROM t CROSS JOIN l LEFT JOIN c3 ON c3.condition = t.condition AND CASE WHEN guess > 0 THEN 1 ELSE guess END = code GROUP BY 1, 2")
def _(s, d):
    return A.status_proportions(c3(s, d))


CELLS = f"{C3}, r AS (SELECT condition, CAST(count(*) FILTER (guess > 0 AND guess <= 3000) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT (guess > 0 AND guess <= 3000)) AS DOUBLE) AS b FROM c3 GROUP BY 1)"


@query("contingency", f"WITH {CELLS} SELECT condition, CAST(a AS BIGINT) AS guessed, CAST(b AS BIGINT) AS not_guessed, round(100 * a / (a + b), 9) AS percent FROM r")
def _(s, d):
    return A.contingency(c3(s, d), 3000).withColumn("percent", F.round("percent", 9))


@query("chi_square", f"WITH {CELLS}, s AS (SELECT sum(a) AS sa, sum(b) AS sb, count(*) AS k FROM r), x AS (SELECT a AS o, (a + b) * sa / (sa + sb) AS e, k FROM r, s UNION ALL SELECT b, (a + b) * sb / (sa + sb), k FROM r, s) SELECT round(sum((o - e) * (o - e) / e), 6) AS chi2, max(k) - 1 AS df FROM x")
def _(s, d):
    return A.chi_square(c3(s, d), 3000).withColumn("chi2", F.round("chi2", 6))


@query("logrank_terms", f"""WITH {C3}, pr AS (SELECT * FROM c3 WHERE condition IN ('click', 'view')), z AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (condition = 'click') AS DOUBLE) AS n1 FROM pr),
g AS (SELECT guess, CAST(count(*) AS DOUBLE) AS d, CAST(count(*) FILTER (condition = 'click') AS DOUBLE) AS d1 FROM pr WHERE guess > 0 GROUP BY 1),
r AS (SELECT guess, d, d1, n - coalesce(sum(d) OVER b, 0) AS y, n1 - coalesce(sum(d1) OVER b, 0) AS y1 FROM g, z WINDOW b AS (ORDER BY guess ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, exp(coalesce(sum(CASE WHEN y > d THEN ln(1 - d / y) ELSE -1e9 END) OVER b, 0)) AS w FROM r WINDOW b AS (ORDER BY guess ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT round(sum(w * d1), 5) AS observed, round(sum(w * d * y1 / y), 5) AS expected, round(sum(w * w * CASE WHEN y > 1 THEN d * y1 / y * (1 - y1 / y) * (y - d) / (y - 1) ELSE 0 END), 5) AS variance FROM v""")
def _(s, d):
    return A.logrank_terms(c3(s, d), "click", "view").select(*(F.round(c, 5).alias(c) for c in ("observed", "expected", "variance")))


#: erfc by its series under 2, else by its continued fraction.
TAIL = """CASE WHEN z < 2 THEN 1 - 2 / sqrt(pi()) * exp(-z * z) * list_sum(list_transform(range(0, 61), lambda k: z * list_product(list_prepend(1.0::DOUBLE, list_transform(range(1, k + 1), lambda j: 2 * z * z / (2 * j + 1))))))
 ELSE exp(-z * z) / (z * sqrt(pi())) / list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(60, 0, -1), lambda k: CAST(k AS DOUBLE))), lambda a, k: 1 + k / (2 * z * z) / a) END"""


@query("logrank_pairs", f"""WITH {C3}, names AS (SELECT condition, CAST(count(*) AS DOUBLE) AS n FROM c3 GROUP BY 1), pr AS (SELECT a.condition AS first, b.condition AS second, a.n AS n1, a.n + b.n AS n FROM names a JOIN names b ON a.condition < b.condition),
g AS (SELECT first, second, n, n1, guess, CAST(count(*) AS DOUBLE) AS d, CAST(count(*) FILTER (condition = first) AS DOUBLE) AS d1 FROM pr JOIN c3 ON condition IN (first, second) WHERE guess > 0 GROUP BY ALL),
r AS (SELECT *, n - coalesce(sum(d) OVER b, 0) AS y, n1 - coalesce(sum(d1) OVER b, 0) AS y1 FROM g WINDOW b AS (PARTITION BY first, second ORDER BY guess ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT first, second, sum(y / n * d1) AS o, sum(y / n * d * y1 / y) AS e, sum(y / n * y / n * CASE WHEN y > 1 THEN d * y1 / y * (1 - y1 / y) * (y - d) / (y - 1) ELSE 0 END) AS v FROM r GROUP BY 1, 2),
st AS (SELECT first, second, (o - e) * (o - e) / v AS statistic, sqrt((o - e) * (o - e) / v / 2) AS z FROM s), p AS (SELECT *, {TAIL} AS p FROM st), h AS (SELECT *, row_number() OVER (ORDER BY p, first, second) AS i, count(*) OVER () AS m FROM p)
SELECT first, second, round(statistic, 5) AS statistic, round(p, 7) AS p, round(max(least(1.0::DOUBLE, (m - i + 1) * p)) OVER (ORDER BY i), 7) AS adjusted FROM h""")
def _(s, d):
    return A.logrank(c3(s, d)).select("first", "second", F.round("statistic", 5).alias("statistic"), F.round("p", 7).alias("p"), F.round("adjusted", 7).alias("adjusted"))


@query("shaped_curves", f"WITH {STEPS}, p AS (SELECT condition, guess, found / CAST(total AS DOUBLE) AS share FROM e WHERE guess <= 2000) SELECT * FROM p UNION SELECT condition, 2000, max(share) FROM p GROUP BY 1 UNION SELECT condition, 0, 0 FROM t")
def _(s, d):
    return A.shaped_curves(c3(s, d), 2000)


@query("combine_results_min_cutoff", f"WITH {C3}, x AS (SELECT condition, 1e12::DOUBLE AS cutoff FROM c3 UNION ALL SELECT condition, 1e9::DOUBLE FROM c3 WHERE condition < 'e') SELECT condition, min(cutoff) AS cutoff FROM x GROUP BY 1")
def _(s, d):
    df = c3(s, d)
    low = df.filter("condition < 'e'")
    with_cutoff = lambda x, c: (x, x.select("condition", F.lit(c).alias("cutoff")).distinct())
    return A.combine_results([with_cutoff(df, 1e12), with_cutoff(low, 1e9)])[1]


RANKED = f"{C2}, tr AS (SELECT word, count(*) AS n FROM c2 WHERE doc_id % 10 < 8 GROUP BY 1), rk AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rank FROM tr), te AS (SELECT word AS password FROM c2 WHERE doc_id % 10 >= 8)"


@query("simple_guess", f"WITH {RANKED} SELECT password, CAST(coalesce(rank, -1) AS BIGINT) AS guess FROM te LEFT JOIN rk ON password = word")
def _(s, d):
    df = c2(s, d)
    return A.simple_guess(df.filter("doc_id % 10 < 8"), df.filter("doc_id % 10 >= 8").select(F.col("word").alias("password")))


def _training(s: SparkSession, d: str) -> DataFrame:
    return c2(s, d).filter("doc_id % 10 < 8")


@query("crack_curve", f"WITH {RANKED}, h AS (SELECT rank AS guess, count(*) AS n FROM te JOIN rk ON password = word GROUP BY 1) SELECT CAST(guess AS BIGINT) AS guess, CAST(sum(n) OVER (ORDER BY guess) AS BIGINT) AS found FROM h")
def _(s, d):
    return A.crack_curve(A.ranked_words(_training(s, d)), c2(s, d).filter("doc_id % 10 >= 8").select(F.col("word").alias("password")))


@query("crack_totals", f"WITH {RANKED} SELECT (SELECT count(*) FROM rk) AS guesses, count(*) AS tests, CAST(count(*) FILTER (password IN (SELECT word FROM rk)) AS INTEGER) AS found, round(100.0::DOUBLE * count(*) FILTER (password IN (SELECT word FROM rk)) / count(*), 9) AS percent FROM te")
def _(s, d):
    return A.crack_totals(_training(s, d).select("word").distinct(), c2(s, d).filter("doc_id % 10 >= 8").select(F.col("word").alias("password"))).withColumn("percent", F.round("percent", 9))


# the 2009 model and n-grams

MICRO = "regexp_replace(regexp_replace(regexp_replace(word, '[^a-zA-Z0-9]', '~', 'g'), '[a-zA-Z]', 'L', 'g'), '[0-9]', 'D', 'g')"


@query("weir09_structures", f"WITH {C1}, m AS (SELECT replace({MICRO}, '~', 'S') AS micro, count(*) AS n FROM c1 GROUP BY 1) SELECT regexp_replace(regexp_replace(regexp_replace(micro, 'L+', 'L', 'g'), 'D+', 'D', 'g'), 'S+', 'S', 'g') AS macro, micro, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS prob FROM m")
def _(s, d):
    return C.structures(c1(s, d)).withColumn("prob", F.round("prob", 9))


for _name, _pattern in (("weir09_digits", "[0-9]+"), ("weir09_symbols", "[^A-Za-z0-9]+")):
    query(_name, f"WITH {C1}, t AS (SELECT unnest(regexp_extract_all(word, '{_pattern}')) AS terminal FROM c1), n AS (SELECT terminal, count(*) AS n FROM t GROUP BY 1) SELECT CAST(len(terminal) AS INTEGER) AS len, terminal, n / CAST(sum(n) OVER (PARTITION BY len(terminal)) AS DOUBLE) AS prob FROM n")(lambda s, d, p=_pattern: C.terminals(c1(s, d), p))


@query("weir09_dictionary", f"WITH {C2}, a AS (SELECT DISTINCT lower(word) AS word FROM c2 WHERE tag = 'en' AND regexp_full_match(word, '[A-Za-z]+') AND len(word) <= 16), b AS (SELECT DISTINCT lower(word) AS word FROM c2 WHERE tag = 'fr' AND regexp_full_match(word, '[A-Za-z]+') AND len(word) <= 16), u AS (SELECT word, 0.7::DOUBLE / count(*) OVER (PARTITION BY len(word)) AS p FROM a UNION ALL SELECT word, 0.3::DOUBLE / count(*) OVER (PARTITION BY len(word)) FROM b) SELECT word, CAST(len(word) AS INTEGER) AS len, max(p) AS prob FROM u GROUP BY word")
def _(s, d):
    df = c2(s, d).filter(F.col("word").rlike("^[A-Za-z]+$"))
    part = lambda tag: C.read_dictionary(df.filter(F.col("tags")[0] == tag).select(X.ascii_lower("word").alias("word")), remove_digits=True, remove_special=True)
    return C.dictionary([(part("en"), 0.7), (part("fr"), 0.3)])


@query("top_guesses", SQL["generate_strings"].replace("SELECT prob, string FROM str WHERE k = len(ps)", "SELECT prob, string, CAST(row_number() OVER (ORDER BY prob DESC, string) AS BIGINT) AS rank FROM (SELECT prob, string FROM str WHERE k = len(ps) ORDER BY prob DESC, string LIMIT 500)"))
def _(s, d):
    g = Grammar(s, d)
    structures, terminals, groups = g.structures, g.terminals, g.groups
    return C.top_guesses(P.strings(structures, terminals, groups, CUTOFF).select("prob", "string"), 500)


OLD_WORDS = "d1 AS (SELECT DISTINCT lower(word) AS word FROM c2 WHERE regexp_full_match(word, '[A-Za-z]+') AND len(word) <= 15)"
OLD_GRAMMAR = f"""{C1}, {C2}, {OLD_WORDS}, m AS (SELECT replace({MICRO}, '~', 'S') AS micro, count(*) AS n FROM c1 GROUP BY 1),
mac AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(micro, 'L+', 'L', 'g'), 'D+', 'D', 'g'), 'S+', 'S', 'g') AS macro FROM m),
st AS (SELECT micro, CAST(sum(n) OVER (PARTITION BY macro) AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) * (n / CAST(sum(n) OVER (PARTITION BY macro) AS DOUBLE)) AS prob FROM mac),
structures AS (SELECT array_to_string(regexp_extract_all(micro, 'L+|D+|S+'), 'E') AS structure, prob FROM st WHERE NOT regexp_matches(micro, 'L{{16}}|D{{16}}|S{{16}}')),
runs AS (SELECT unnest(regexp_extract_all(word, '[0-9]+') || regexp_extract_all(word, '[^A-Za-z0-9]+')) AS terminal FROM c1),
rc AS (SELECT repeat(CASE WHEN terminal SIMILAR TO '[0-9]+' THEN 'D' ELSE 'S' END, len(terminal)) AS term_key, terminal, count(*) AS n FROM runs GROUP BY 1, 2),
terminals AS (SELECT term_key, terminal, n / CAST(sum(n) OVER (PARTITION BY term_key) AS DOUBLE) AS prob FROM rc UNION ALL SELECT repeat('L', len(word)), word, 1.0::DOUBLE / count(*) OVER (PARTITION BY len(word)) FROM d1),
groups AS (SELECT term_key, prob, count(*) AS size, row_number() OVER (PARTITION BY term_key ORDER BY prob DESC) - 1 AS group_idx FROM terminals GROUP BY 1, 2)"""


@query("weir09_guesses", f"""WITH RECURSIVE {OLD_GRAMMAR},
walk AS (SELECT structure, string_split(structure, 'E') AS ps, prob, CAST([] AS BIGINT[]) AS idx, CAST(1 AS HUGEINT) AS n, 0 AS k FROM structures
 UNION ALL SELECT structure, ps, w.prob * g.prob, list_append(idx, g.group_idx), n * g.size, k + 1 FROM walk w JOIN groups g ON g.term_key = ps[k + 1] WHERE k < len(ps)),
pre AS (SELECT structure, ps, prob, idx, coalesce(sum(n) OVER (ORDER BY prob DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(n) OVER (PARTITION BY prob) AS before FROM walk WHERE k = len(ps)),
str AS (SELECT structure, ps, prob, idx, '' AS string, 0 AS k FROM pre WHERE before < 2000
 UNION ALL SELECT structure, ps, str.prob, idx, string || terminal, k + 1 FROM str JOIN groups g ON g.term_key = ps[k + 1] AND g.group_idx = idx[k + 1] JOIN terminals t ON t.term_key = g.term_key AND t.prob = g.prob WHERE k < len(ps))
SELECT CAST(row_number() OVER (ORDER BY prob DESC, structure, string) AS BIGINT) AS rank, prob, string FROM str WHERE k = len(ps) ORDER BY rank LIMIT 2000""")
def _(s, d):
    words = c2(s, d).filter(F.col("word").rlike("^[A-Za-z]+$") & (F.length("word") <= 15)).select(X.ascii_lower("word").alias("word"))
    structures, terminals = C.grammar(c1(s, d), C.dictionary([(words, 1.0)]))
    return C.guesses(structures, stash(terminals, "terminals"), 2000)


GRAMS = r"""w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS ws FROM documents),
bg AS (SELECT ws[i] || ' ' || ws[i + 1] AS gram FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM w)),
tb AS (SELECT replace(lower(gram), ' ', '') AS key, replace(lower(gram), ' ', chr(1)) AS tokens, count(*) AS freq FROM bg WHERE regexp_full_match(gram, '[A-Za-z ]+') GROUP BY 1, 2)"""


def bigrams(s: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split("text", "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")
    pairs = F.expr("transform(filter(sequence(0, size(ws)), i -> i + 1 < size(ws)), i -> concat(ws[i], ' ', ws[i + 1]))")
    return S.table(s, d, "documents").select(words.alias("ws")).select(F.explode(pairs).alias("gram"), F.lit(1).alias("freq"))


@query("ngram_collapse", f"WITH {GRAMS} SELECT key, tokens, freq FROM tb")
def _(s, d):
    return N.table_of(bigrams(s, d))


@query("ngram_top_tokenization", f"WITH {GRAMS} SELECT key AS word, arg_min(tokens, (-freq, tokens)) AS tokens FROM tb GROUP BY key")
def _(s, d):
    table = N.table_of(bigrams(s, d))
    return N.top_tokenization(table.select(F.col("key").alias("word")).distinct(), table)


@query("ngram_prefixes", f"WITH {C1}, ws AS (SELECT DISTINCT lower(word) AS word FROM c1 WHERE regexp_full_match(word, '[A-Za-z]+')), ks AS (SELECT DISTINCT substr(word, 1, 3) AS key FROM ws) SELECT word, key FROM ws JOIN ks ON starts_with(word, key)")
def _(s, d):
    words = c1(s, d).filter(F.col("word").rlike("^[A-Za-z]+$")).select(X.ascii_lower("word").alias("word")).distinct()
    return N.prefixes(words, words.select(F.substring("word", 1, 3).alias("key")).distinct())


WORD_GRAMS = """names AS (SELECT p_name AS gram FROM part), tb AS (SELECT replace(lower(gram), ' ', '') AS key, replace(lower(gram), ' ', chr(1)) AS tokens, count(*) AS freq
 FROM (SELECT gram FROM names UNION ALL SELECT unnest(string_split(gram, ' ')) FROM names) WHERE regexp_full_match(gram, '[A-Za-z ]+') GROUP BY 1, 2),
best AS (SELECT key, arg_min(tokens, (-freq, tokens)) AS best FROM tb GROUP BY key)"""
#: The extended search: the longest key, its first token (or all but the last), and so on with the rest.
EXTENDED = """walk AS (SELECT DISTINCT run, run AS rest, '' AS done FROM runs
 UNION ALL SELECT run, substr(rest, 1 + CAST(list_sum(list_transform(took, lambda t: len(t))) AS BIGINT)), done || CASE WHEN done = '' THEN '' ELSE chr(1) END || array_to_string(took, chr(1))
 FROM (SELECT run, rest, done, CASE WHEN len(key) = len(rest) OR len(ts) = 1 THEN ts WHEN {all} THEN ts[1 : len(ts) - 1] ELSE ts[1 : 1] END AS took
  FROM (SELECT run, rest, done, key, string_split(best, chr(1)) AS ts, row_number() OVER (PARTITION BY run ORDER BY len(key) DESC) AS n FROM walk JOIN best ON starts_with(rest, key) WHERE rest <> '') WHERE n = 1)),
done AS (SELECT run, done FROM walk WHERE rest = '')"""


def word_grams(s: SparkSession, d: str) -> DataFrame:
    names = S.table(s, d, "part").select(F.col("p_name").alias("gram"), F.lit(1).alias("freq"))
    return N.table_of(names.unionByName(names.select(F.explode(F.split("gram", " ")).alias("gram"), "freq")))


#: Letter runs keep their case: tokens are cut from the run itself.
CUT = "array_to_string(list_transform(range(1, len(ts) + 1), lambda i: substr(p, 1 + CAST(coalesce(list_sum(list_transform(ts[1 : i - 1], lambda t: len(t))), 0) AS BIGINT), len(ts[i]))), chr(1))"
ALL_WORDS = "ws AS (SELECT DISTINCT word FROM c1)"


def _ngram_query(mode: int, hybrid: bool = False, duplicate: bool = False) -> None:
    extended, weighed = (N.WHOLE | N.RUNS)[mode], mode == 28
    freq = ", 0.5::DOUBLE AS freq" if weighed else ""
    if mode in N.WHOLE:
        runs = f"{ALL_WORDS}, runs AS (SELECT DISTINCT lower(word) AS run FROM ws)"
        tokens = "(SELECT done FROM done WHERE run = lower(word))" if extended else "coalesce((SELECT best FROM best WHERE key = lower(word)), word)"
        sql = f"SELECT word, {tokens} AS tokens FROM ws"
    else:
        pieces = "regexp_extract_all(word, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+')"
        runs = f"{ALL_WORDS}, pieces AS (SELECT word, unnest({pieces}) AS p, generate_subscripts({pieces}, 1) AS k FROM ws), runs AS (SELECT DISTINCT lower(p) AS run FROM pieces WHERE regexp_full_match(p, '[A-Za-z]+'))"
        found = "(SELECT done FROM done WHERE run = lower(p))" if extended else "coalesce((SELECT best FROM best WHERE key = lower(p)), p)"
        between = "chr(1)" if mode in N.CLASSES_BROKEN else "''"
        sql = f"SELECT word, CASE WHEN count(*) = count(t) THEN string_agg(t, {between} ORDER BY k) END AS tokens{freq} FROM (SELECT word, k, CASE WHEN ts IS NULL THEN NULL ELSE {CUT} END AS t FROM (SELECT word, k, p, CASE WHEN regexp_full_match(p, '[A-Za-z]+') THEN string_split({found}, chr(1)) ELSE [p] END AS ts FROM pieces)) GROUP BY word"
    if hybrid:
        sql = f"SELECT * FROM ({sql}) UNION ALL SELECT word, {TOKENS.format('word')} AS tokens, 1.0::DOUBLE AS freq FROM ({sql}) WHERE tokens IS DISTINCT FROM {TOKENS.format('word')}"
    if duplicate:
        sql = f"SELECT * FROM ({sql}) UNION ALL SELECT word, word AS tokens FROM ws"
    name = f"ngram_mode_{mode}" + "_hybrid" * hybrid + "_duplicate" * duplicate
    walk = EXTENDED.format(all=extended == "all")
    query(name, f"WITH RECURSIVE {C1}, {WORD_GRAMS}, {runs}, {walk} {sql}")(
        lambda s, d: N.tokenize_ngram(c1(s, d).select("word", *[F.lit(1.0).alias("freq")] * weighed).distinct(), word_grams(s, d), mode, duplicate, 0.5, hybrid)
    )


for _mode in sorted(N.WHOLE | N.RUNS):
    _ngram_query(_mode)
_ngram_query(28, hybrid=True)
_ngram_query(20, duplicate=True)


@query("ngram_mode_1", f"WITH {WORD_GRAMS} SELECT key AS word, tokens, freq AS table_freq FROM tb JOIN (SELECT DISTINCT key FROM tb) USING (key)")
def _(s, d):
    table = word_grams(s, d)
    return N.tokenize_ngram(table.select(F.col("key").alias("word")).distinct(), table, 1)


@query("ngram_greedy", f"WITH RECURSIVE {C1}, {WORD_GRAMS}, runs AS (SELECT DISTINCT unnest(regexp_extract_all(lower(word), '[a-z]+')) AS run FROM c1), {EXTENDED.format(all=False)} SELECT runs.run AS word, done AS tokens FROM runs LEFT JOIN done ON runs.run = done.run")
def _(s, d):
    words = c1(s, d).select(F.explode(X.runs(X.ascii_lower("word"), "[a-z]+")).alias("word")).distinct()
    return N.greedy(words, word_grams(s, d))
