"""Toxicity (operator 10): a weighted finite-state grammar over clauses.

Words become symbols (insult, threatening verb, several kinds of targets, first person, negation, report, break or
other). Five small transducers rewrite a clause's symbols and add weights: insults and threats, their targets, negation
and reported speech. Their composition reads a clause once; what it writes says which clauses are direct, aimed, negated
or reported. A threat is a verb and whom it is for: after it (kill you), before it where the language has objects there
(dich töten, te matar), or possessives and polite forms if the first person does it (I ... your, je ... vous). A
negation holds for what follows it up to a comma, a word like `but` or the clause's end.
Insult stems with their weights are learned from labelled rows by a test that is corrected for all stems
tried; a logistic model over the clause scores, learned from the same rows, gives the document's score.

Defined results: null and empty texts get the score of a text without matches; without labelled rows of
both kinds every score is 0; a null label is not learned, and of several labels of an id the largest is; texts of any length
are read whole; equal features give equal scores; repeated rows give repeated rows; columns other than doc_id, text and
toxic are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm import common

#: Labelled rows to learn from, about; more are thinned by a hash of the id.
FIT_ROWS = 20_000
#: Stem lengths tried, in characters; whole words are tried too.
STEMS = (3, 4, 5, 6, 8)
#: Closed classes of words in the languages at hand.
TARGETS = "yourself ur he she they his their du er tu toi il elle ils elles tú usted ustedes ellos ellas".split()
OBJECTS = "you u ya him her them ihn ihnen".split()
OBJECTS_BEFORE = "dich dir euch te ti os".split()
OBJECTS_OF_FIRST = "your yours dein deine deinen deiner ihr ihre sie vous ton ta tes votre vos tus".split()
FIRST = "i i'll i'm i'd i've we we'll we're ich wir je nous yo nosotros voy vamos".split()
NEGATIONS = "not no never nobody isn't aren't wasn't don't doesn't didn't won't wouldn't can't couldn't cannot nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás ni sin".split()
BREAKS = ", but though however aber sondern doch mais cependant pero sino".split()
REPORTS = "said says say told tells wrote writes called calls quoted quote according reported reports sagte sagt schrieb nannte laut dit disait écrit selon appelé dijo dice escribió según llamó".split()
THREATS = "kill kills killing hurt destroy murder beat shoot stab burn hang strangle töte töten tötet umbringen umlegen schlagen schlage erschießen erschieße erwürgen tuer tue tuerai frapper frapperai brûler égorger matar mataré mato golpear golpearé quemar quemaré disparar".split()
#: Verbs that end with their object.
THREATS_AIMED = "matarte matarlo matarla matarlos golpearte quemarte dispararte".split()
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
TOKEN = re.compile(WORD.pattern + "|,")
FEATURES = ("direct", "aimed", "negated", "reported", "threat", "clauses", "share")


class Transducer:
    """A deterministic weighted transducer: (state, symbol) to (state, output, weight). A symbol without an arc keeps the state and is written as it is."""

    def __init__(self, arcs: dict[tuple[str, str], tuple[str, str, float]], start: str = "0"):
        self.arcs, self.start = arcs, start

    def step(self, state: str, symbol: str) -> tuple[str, str, float]:
        return self.arcs.get((state, symbol)) or (self.arcs[state, "*"][0] if (state, "*") in self.arcs else state, symbol, 0.0)

    def then(self, other: Transducer, symbols: list[str]) -> Transducer:
        """The composition: what this one writes, the other reads. Only states that can be reached are made."""
        arcs, todo, seen = {}, [(self.start, other.start)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            for s in symbols:
                a2, out, w = self.step(a, s)
                b2, out, v = other.step(b, out)
                arcs[f"{a}|{b}", s] = f"{a2}|{b2}", out, w + v
                todo.append((a2, b2))
        return Transducer(arcs, f"{self.start}|{other.start}")

    def run(self, symbols: list[str]) -> tuple[list[str], float]:
        state, out, total = self.start, [], 0.0
        for s in symbols:
            state, o, w = self.step(state, s)
            out.append(o)
            total += w
        return out, total


#: Insult, threatening verb, target, object, object before the verb, object of the first person's threats, first person, negation, report, break, other.
SYMBOLS = ["I", "T", "A", "O", "C", "V", "P", "N", "R", "B", "-"]


def threats() -> Transducer:
    """T where a threat is complete; t for a verb that hasn't found whom it is for (yet). Objects are targets, too."""
    arcs: dict[tuple[str, str], tuple[str, str, float]] = {}

    def state(name: str, own: dict[str, tuple[str, str, float]]) -> None:
        kind, left = name[0], int(name[1:] or 0)
        rest = {"P": ("p5", "P", 0.0), "T": ("t3", "t", 0.0), "O": ("0", "A", 0.0), "V": ("0", "A", 0.0), "C": ("c4", "A", 0.0), "*": (f"{kind}{left - 1}" if left > 1 else "0", "", 0.0)}
        arcs.update({(name, s): x for s, x in (rest | own).items()})

    state("0", {})
    for k in "54321":
        # the first person, then a verb or an object
        state(f"p{k}", {"T": ("u3", "t", 0.0), "C": ("q4", "A", 0.0), "V": ("q4", "A", 0.0), "O": (f"p{int(k) - 1}" if k > "1" else "0", "A", 0.0)})
    for k in "4321":
        state(f"c{k}", {"T": ("0", "T", 1.0), "P": ("q4", "P", 0.0)})
        state(f"q{k}", {"T": ("0", "T", 1.5), "P": ("q4", "P", 0.0)})
    for k in "321":
        state(f"t{k}", {"O": ("0", "T", 1.0), "C": ("0", "T", 1.0)})
        state(f"u{k}", {"O": ("0", "T", 1.5), "C": ("0", "T", 1.5), "V": ("0", "T", 1.5)})
    return Transducer(arcs)


def parts() -> list[Transducer]:
    """Insults, threats, targets, negation, reported speech."""
    insult = Transducer({("0", "I"): ("1", "I", 1.0), ("1", "I"): ("1", "I", 1.5)})  # piled-up insults weigh more
    # a target up to three words before an insult aims it
    aim = {("0", "A"): ("3", "A", 0.0)}
    for k in "321":
        aim |= {(k, "I"): ("0", "J", 0.5), (k, "A"): ("3", "A", 0.0), (k, "*"): (str(int(k) - 1), "", 0.0)}
    # a negation takes most of what follows back
    deny = {("0", "N"): ("1", "N", 0.0), ("1", "B"): ("0", "B", 0.0)} | {("1", x): ("1", "n", -0.7) for x in ("I", "J", "T")}
    report = {("0", "R"): ("1", "R", 0.0)} | {("1", x): ("1", "r", -0.3) for x in ("I", "J", "T")}
    return [insult, threats(), Transducer(aim), Transducer(deny), Transducer(report)]


def grammar() -> Transducer:
    """The composition of all parts."""
    out, *rest = parts()
    for t in rest:
        out = out.then(t, SYMBOLS)
    return out


class Matcher:
    """Finds clauses with an insult or a threat and gives a document's features."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.stems = stems
        classes = (("A", TARGETS), ("O", OBJECTS), ("C", OBJECTS_BEFORE), ("V", OBJECTS_OF_FIRST), ("P", FIRST), ("N", NEGATIONS), ("B", BREAKS), ("R", REPORTS), ("T", THREATS))
        self.closed = {w: s for s, ws in classes for w in ws} | {w: "TO" for w in THREATS_AIMED}
        self.find = ahocorasick.Automaton()
        for w in [*stems, *(t + "$" for t in THREATS + THREATS_AIMED)]:
            self.find.add_word(w.rstrip("$"), w)
        self.find.make_automaton()
        self.machine = grammar()

    def insult(self, word: str) -> float:
        best = self.stems.get(word + "$", 0.0)
        for n in STEMS:
            if n <= len(word):
                best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def features(self, text: str) -> list[float]:
        out = dict.fromkeys(FEATURES, 0.0)
        low = text.lower()
        if not any(not at - len(w.rstrip("$")) + 1 or not low[at - len(w.rstrip("$"))].isalnum() for at, w in self.find.iter(low)):
            return [0.0] * len(FEATURES)
        words = 0
        for clause in CLAUSE.split(low):
            ws = TOKEN.findall(clause.replace("’", "'"))
            words += len(ws) - ws.count(",")
            weights = [self.insult(w) for w in ws]
            symbols = "".join("I" if x else self.closed.get(w, "-") for w, x in zip(ws, weights))
            if "I" not in symbols and "T" not in symbols:
                continue
            written, total = self.machine.run(list(symbols))
            if (value := max(0.0, total) * max([1.0, *weights])) == 0 and not any(o in "nr" for o in written):
                continue
            out["clauses"] += 1
            out["direct"] += value if "I" in written else 0
            out["aimed"] += value if "J" in written else 0
            out["negated"] += "n" in written
            out["reported"] += "r" in written
            out["threat"] += "T" in written
        out["share"] = 100 * out["clauses"] / max(words, 100)
        return [math.log1p(out[k]) for k in FEATURES]


def count_stems(sample: DataFrame) -> DataFrame:
    """stem, toxic, clean: labelled texts with a word of that stem ($: that word)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def partial() -> pd.DataFrame:
            stems = list({*counts[0], *counts[1]})
            out = pd.DataFrame({"stem": pd.Series(stems, dtype=str), "toxic": [counts[1][s] for s in stems], "clean": [counts[0][s] for s in stems]})
            counts[0].clear()
            counts[1].clear()
            return out

        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                words = set(WORD.findall(text.lower()))
                counts[toxic].update({w[:n] for w in words for n in STEMS if n <= len(w)} | {w + "$" for w in words if len(w) > 1})
                if len(counts[0]) + len(counts[1]) > 1_000_000:
                    yield partial()
        yield partial()

    parts = sample.mapInPandas(run, "stem string, toxic long, clean long")
    return parts.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_stems(sample: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Stems whose texts are toxic far more often than others: nine in ten, with an exponential bound on chance that holds for all stems tried at once."""
    counts = common.stash(count_stems(sample), "stems")
    base = toxic / (toxic + clean)
    n, share = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    # stems too rare to pass at any outcome need no correction: the least bound that holds for the stems that can reach it
    sizes = sorted(((r.n, r.stems) for r in counts.groupBy(F.least(n, F.lit(2000)).alias("n")).agg(F.count("*").alias("stems")).collect()), reverse=True)
    testable = 0
    for size, stems in sizes:
        if size * math.log(1 / base) < math.log((testable + stems) / 0.01):
            break
        testable += stems
    bound = math.log(max(1, testable) / 0.01)
    far = F.col("toxic") * F.log(share / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    sure = counts.filter((share > base) & (share >= 0.9)).filter(far >= bound)
    found = {r.stem: math.log((r.toxic + 0.5) / (toxic + 1)) - math.log((r.clean + 0.5) / (clean + 1)) for r in sure.collect()}
    # the shortest stem covers its longer ones
    short = {s: w for s, w in found.items() if not any(s[:k] in found for k in STEMS if k < len(s.rstrip("$")))}
    return {s: w for s, w in short.items() if not (s.endswith("$") and s[:-1] in short)}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights by Newton's method; the last is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_documents(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score and the clause features of every document; labelled: (doc_id, toxic) to learn from."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    labels = labelled.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    thin = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, fit_rows / max(1, labels.count())) * (1 << 20)) + 1
    sample = common.stash(texts.filter("text is not null").filter(thin).join(labels.filter(thin), "doc_id").select("text", "toxic"), "labelled")
    seen = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stems, weights = {}, np.zeros(0)
    if seen.get(0) and seen.get(1):
        stems = learn_stems(sample, seen[1], seen[0])

        def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = Matcher(stems)
            for pdf in batches:
                yield pd.DataFrame({"f": [m.features(t) for t in pdf["text"]], "toxic": pdf["toxic"]})

        got = sample.mapInPandas(features, "f array<double>, toxic int").toPandas()
        weights = logistic(np.array(got["f"].tolist()), got["toxic"].to_numpy(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(stems)
        for batch in batches:
            x = np.array([m.features(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))) if len(weights) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "score", "features"])

    return texts.mapInArrow(run, "doc_id long, score double, features array<double>")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.table(spark, sf_dir, "labels").filter(common.remainder("doc_id", 3) != 1).select("doc_id", "toxic")
    out = score_documents(common.table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
