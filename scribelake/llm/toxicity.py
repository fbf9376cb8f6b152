"""Toxicity by a weighted finite-state pattern grammar.

The words of a clause become symbols (insult, target, harm, intent, negation, reported speech,
quote, other). Five transducers, each a table of weighted arcs, are composed into one machine: the
output of one is the input of the next, weights add up along the path. What comes out of a clause is
its reading: aimed insult, insult inside a statement, threat, negated or reported one, or nothing. An insult
that stands alone in its clause is no match. A clause counts once, with its heaviest reading. Insult
and harm words and stems, and the weight of each reading, are learned from the labels; nothing but
the text is an input of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, in_sample, materialize, sample_share

_TOKEN = re.compile(r"\w+|[\"“”«»]")
_CLAUSE = re.compile(r"[.!?;:\n]+")
STEMS = (4, 5, 6, 7)

# Closed word classes of the grammar, in English, German, French and Spanish.
TARGETS = frozenset("you your yours he they him her them his their du dich dir ihr sie er euch tu te toi vous il ils elles tú usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not no never nobody without nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans nunca jamás sin tampoco isn't aren't wasn't don't".split())
REPORTERS = frozenset("said says saying told tells wrote writes quoted claimed called shouted sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())
INTENTS = frozenset("will shall gonna going must werde wirst vais va voy vas".split())
# Where learning starts from: insults and harms that need no label.
HARMS = frozenset("kill hurt destroy burn beat stab shoot töten verletzen schlagen tuer frapper détruire matar golpear destruir".split())
SEEDS = {w: 3.0 for w in "idiot moron stupid scum loser pathetic worthless disgusting dumbass bastard".split()}

#: Symbols of words: insult, target, harm, intent, negation, reporter, quote, other.
INSULT, TARGET, HARM, INTENT, NEGATION, REPORTER, QUOTE, OTHER = "I", "T", "H", "F", "N", "R", "Q", "o"
#: Symbols that transducers put in their place: negated and reported match, aimed insult, aim at an earlier insult.
NEGATED, REPORTED, AIMED, AIM = "j", "r", "A", "B"
WORD_SYMBOLS = INSULT + TARGET + HARM + INTENT + NEGATION + REPORTER + QUOTE + OTHER
#: Words that are never learned.
CLOSED = ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORTER, REPORTERS), (INTENT, INTENTS), (QUOTE, frozenset('"“”«»')))
ALPHABET = WORD_SYMBOLS + NEGATED + REPORTED + AIMED + AIM
READINGS = ("aimed", "embedded", "threat", "negated", "reported")
#: Weight that an arc of the grammar gives a match before learning scales its reading.
ARC = {"aimed": 1.5, "embedded": 1.0, "threat": 1.5, "negated": 0.1, "reported": 0.1}
#: Words after a negation that it reaches, before an insult that a target reaches, after an intent that it reaches.
SCOPE, AIM_SCOPE, WILL_SCOPE = 3, 6, 4
FEATURES = (*READINGS, "share")
#: Where the fit starts, what it is drawn to where labels say little, and the bounds of each coefficient.
PRIOR = np.array([2.4, 2.0, 2.2, 0.0, 0.0, 0.6])
LOW = np.array([0.3, 0.3, 0.3, -3.0, -3.0, 0.0])
HIGH = np.array([9.0, 9.0, 9.0, 0.0, 0.0, 9.0])


@dataclass(frozen=True)
class Transducer:
    """Weighted arcs {(state, symbol): (state, output, weight)}; a symbol without an arc is copied and the state stays."""

    arcs: dict

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol)) or (state, symbol, 0.0)


class Composed:
    """Composition of two transducers; its arcs are made when they are first asked for."""

    def __init__(self, first, second):
        self.first, self.second, self.made = first, second, {}

    def step(self, state, symbol: str):
        arc = self.made.get((state, symbol))
        if arc is None:
            p, out, w = self.first.step(state[0], symbol)
            q, out, v = self.second.step(state[1], out)
            arc = self.made[state, symbol] = ((p, q), out, w + v)
        return arc


def negation() -> Transducer:
    """Insults and harms up to ``SCOPE`` words after a negation are negated. The state is what is left of the scope."""
    arcs = {(k, s): (max(0, k - 1), NEGATED if k and s in (INSULT, HARM) else s, 0.0) for k in range(SCOPE + 1) for s in WORD_SYMBOLS}
    return Transducer(arcs | {(k, NEGATION): (SCOPE, NEGATION, 0.0) for k in range(SCOPE + 1)})


def reported() -> Transducer:
    """Matches inside quotes (state 2), or after a reporting verb (state 1) to the end of the clause, are reported."""
    arcs = {(0, REPORTER): (1, REPORTER, 0.0), (0, QUOTE): (2, QUOTE, 0.0), (1, QUOTE): (2, QUOTE, 0.0), (2, QUOTE): (0, QUOTE, 0.0)}
    return Transducer(arcs | {(k, s): (k, REPORTED, 0.0) for k in (1, 2) for s in (INSULT, HARM, NEGATED)})


def target() -> Transducer:
    """An insult near a target is aimed, whichever comes first. State k: words left of a target's reach; "open": an insult waits."""
    states = [*range(AIM_SCOPE + 1), "open"]
    arcs = {(k, s): (k if k == "open" else max(0, k - 1), s, 0.0) for k in states for s in WORD_SYMBOLS + NEGATED + REPORTED}
    arcs |= {(k, TARGET): (AIM_SCOPE, AIM if k == "open" else TARGET, 0.0) for k in states}
    return Transducer(arcs | {(k, INSULT): (k, AIMED, 0.0) if k and k != "open" else ("open", INSULT, 0.0) for k in states})


def insult() -> Transducer:
    """Reads insult matches. State 0: no word yet, 1: inside a statement, "alone": an insult waits for a second word."""
    arcs = {(k, s): (1, s, 0.0) for k in (0, 1) for s in ALPHABET if s != QUOTE}
    arcs |= {("alone", s): (1, "embedded", ARC["embedded"]) for s in ALPHABET if s != QUOTE}
    arcs |= {(0, INSULT): ("alone", OTHER, 0.0), ("alone", INSULT): ("alone", OTHER, 0.0), (1, INSULT): (1, "embedded", ARC["embedded"])}
    for k in (0, 1, "alone"):
        arcs |= {(k, s): (1, r, ARC[r]) for s, r in ((AIMED, "aimed"), (AIM, "aimed"), (NEGATED, "negated"), (REPORTED, "reported"))}
    return Transducer(arcs)


def threat() -> Transducer:
    """A harm within ``WILL_SCOPE`` words after an intent is a threat; without one it is none."""
    others = [s for s in ALPHABET if s not in (INTENT, HARM)] + list(READINGS)
    arcs = {(k, s): (max(0, k - 1), s, 0.0) for k in range(WILL_SCOPE + 1) for s in others}
    arcs |= {(k, INTENT): (WILL_SCOPE, INTENT, 0.0) for k in range(WILL_SCOPE + 1)}
    return Transducer(arcs | {(k, HARM): (0, "threat", ARC["threat"]) if k else (0, OTHER, 0.0) for k in range(WILL_SCOPE + 1)})


class Grammar:
    """The five transducers as one machine."""

    def __init__(self):
        self.machine = Composed(Composed(Composed(Composed(negation(), reported()), target()), insult()), threat())
        self.start = ((((0, 0), 0), 0), 0)

    def read(self, symbols: list[str], strengths: list[float]) -> tuple[str, float] | None:
        """Heaviest reading of a clause and its weight: the arc's times the strength of the words it reads."""
        state, best, held = self.start, None, 0.0
        for s, strength in zip(symbols, strengths):
            state, out, weight = self.machine.step(state, s)
            held = max(held, strength)  # a reading may come after its word, as when a target follows
            if weight and (best is None or weight * held > best[1]):
                best = (out, weight * held)
        return best


@dataclass
class ToxicityModel:
    words: dict[str, float]
    stems: dict[str, float]
    harms: frozenset[str] = HARMS
    coefficients: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    intercept: float = -2.5

    def insult(self, word: str) -> float:
        """Weight of a lower-case word: its own, or that of its longest weighted stem."""
        w = self.words.get(word)
        if w is not None:
            return w
        for k in reversed(STEMS):
            if len(word) > k and (w := self.stems.get(word[:k])) is not None:
                return w
        return 0.0


class Scorer:
    """Readings of whole texts; words are weighed once and remembered."""

    def __init__(self, model: ToxicityModel):
        self.model, self.grammar, self.known = model, Grammar(), {}

    def _weigh(self, word: str) -> tuple[str, float]:
        """Symbol and strength of a lower-case token; a strength above 0 makes its clause worth reading."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            if word in self.model.harms:
                got = (HARM, 1.0)
            elif closed := next((name for name, words in CLOSED if word in words), None):
                got = (closed, 0.0)
            else:
                w = self.model.insult(word)
                got = (INSULT, min(w, 8.0) / 4) if w > 0 else (OTHER, 0.0)
            self.known[word] = got
        return got

    def features(self, text: str) -> np.ndarray:
        x = np.zeros(len(FEATURES))
        low = text.lower()
        hit, weigh = self.known, self._weigh
        words = _TOKEN.findall(low)
        if not any([(hit[w] if w in hit else weigh(w))[1] for w in words]):
            return x
        sums: dict[str, float] = {}
        clauses = 0
        for clause in _CLAUSE.split(low):
            read = [weigh(w) for w in _TOKEN.findall(clause)]
            if any(strength for _, strength in read):
                clauses += 1
                got = self.grammar.read([s for s, _ in read], [w for _, w in read])
                if got:
                    sums[got[0]] = sums.get(got[0], 0.0) + got[1]
        for i, k in enumerate(READINGS):
            x[i] = math.log1p(sums.get(k, 0.0))
        meant = sum(sums.get(k, 0.0) for k in ("aimed", "embedded", "threat"))
        x[5] = math.log1p(100.0 * meant / (len(words) + 20))
        return x


def _mask(previous: str) -> int:
    return 1 << (xxhash.xxh32_intdigest(previous) & 63)


def _features_of(words: list[str]):
    for w in words:
        yield "=" + w
        for k in STEMS:
            if len(w) > k:
                yield w[:k]


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 20_000,
    fold: tuple[int, int] | None = (5, 0),
    least: int = 3,
) -> ToxicityModel:
    """Learn insult and harm words, stems and reading weights from a seeded sample of labelled documents.

    About ``sample_rows`` documents with a label of 0 or 1 are used, none in the held-out ``fold``
    (parts, part). A word or stem is learned when it is in ``least`` toxic documents or more, after as many
    different words (a copied passage shows it after one only), and is much rarer elsewhere; it is
    a harm if it mostly follows an intent, else an insult. All that pass are learned. Without labels only
    the seed words are known. Labels of ids that are null or not in ``docs`` don't count; of several labels
    of an id the greatest does; null texts are not sampled; an empty table gives the seed model.
    """
    rows = labels.select(F.col("doc_id").alias("__doc"), F.col("toxic").cast("int").alias("y")).filter("y in (0, 1) and __doc is not null")
    if fold:
        rows = rows.filter(~held_out(F.col("__doc"), *fold))
    rows = rows.groupBy("__doc").agg(F.max("y").alias("y"))
    share = sample_share(rows.count(), sample_rows)
    key = lambda c: F.col(c).cast("string")
    some = rows.filter(in_sample(key("__doc"), share, "toxic")).select(key("__doc").alias("__doc"), "y")
    sampled = docs.filter("text is not null").filter(in_sample(key("doc_id"), share, "toxic")).select(key("doc_id").alias("doc_id"), "text")
    return _fit(materialize(sampled.join(some, F.col("doc_id") == F.col("__doc")).select("text", "y")), least)


def _fit(sampled: DataFrame, least: int) -> ToxicityModel:
    spark = sampled.sparkSession
    by_label = {r["y"]: r["n"] for r in sampled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = by_label.get(1, 0), by_label.get(0, 0)
    words, stems, harms = dict(SEEDS), {}, set(HARMS)
    if not n_toxic:
        return ToxicityModel(words, stems)

    def toxic_counts(batches):
        for pdf in batches:
            n, masks, after = Counter(), {}, Counter()
            for text in pdf["text"]:
                seen, before, will = {}, "", 0
                for w in re.findall(r"\w+", text.lower()):
                    m = _mask(before)
                    for f in _features_of((w,)):
                        seen[f] = seen.get(f, False) or will > 0
                        masks[f] = masks.get(f, 0) | m
                    before, will = w, WILL_SCOPE if w in INTENTS else will - 1
                n.update(seen.keys())
                after.update(f for f, a in seen.items() if a)
            keys = list(n)
            if keys:
                yield pd.DataFrame({"f": keys, "n": [n[k] for k in keys], "m": np.array([masks[k] for k in keys], dtype=np.uint64).view(np.int64), "a": [after[k] for k in keys]})

    positive = (
        sampled.filter("y = 1")
        .mapInPandas(toxic_counts, "f string, n long, m long, a long")
        .groupBy("f")
        .agg(F.sum("n").alias("p"), F.bit_or("m").alias("m"), F.sum("a").alias("a"))
        .filter((F.col("p") >= least) & (F.bit_count("m") >= least))
    )
    found = {r["f"]: (r["p"], r["a"]) for r in positive.select("f", "p", "a").collect()}  # of a bounded sample
    shared = spark.sparkContext.broadcast(frozenset(found))

    def clean_counts(batches):
        wanted, cache = shared.value, {}
        for pdf in batches:
            n = Counter()
            for text in pdf["text"]:
                seen = set()
                for w in set(re.findall(r"\w+", text.lower())):
                    hits = cache.get(w)
                    if hits is None:
                        hits = cache[w] = [f for f in _features_of((w,)) if f in wanted]
                    seen.update(hits)
                n.update(seen)
            if n:
                yield pd.DataFrame({"f": list(n), "n": list(n.values())})

    clean = sampled.filter("y = 0").mapInPandas(clean_counts, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    negative = {r["f"]: r["n"] for r in clean.collect()}
    # evidence a feature needs grows with how many are tried
    need = math.log(len(found) + 1) + 1.0
    base = math.log((n_toxic + 1) / (n_clean + 1))
    for f, (p, a) in found.items():
        q = negative.get(f, 0)
        odds = math.log((p + 0.5) / (q + 0.5)) - base
        rate = (p + q) / (n_toxic + n_clean)
        surprise = p * math.log(max(p / max(rate * n_toxic, 1e-9), 1e-9))  # log-likelihood of p toxic by chance
        if odds >= 2.5 and surprise >= need:
            if f[0] == "=" and 2 * a > p:
                harms.add(f[1:])
            elif f[0] == "=":
                words[f[1:]] = max(words.get(f[1:], 0.0), min(odds, 8.0))
            else:
                stems[f] = min(odds, 8.0)
    model = ToxicityModel(words, stems, frozenset(harms))
    shared_model = spark.sparkContext.broadcast(model)

    def readings(batches):
        scorer = Scorer(shared_model.value)
        for pdf in batches:
            x = np.stack([scorer.features(t) for t in pdf["text"]]) if len(pdf) else np.zeros((0, len(FEATURES)))
            yield pd.DataFrame(x, columns=list(FEATURES)).assign(y=pdf["y"].to_numpy())

    schema = ", ".join(f"{k} double" for k in FEATURES) + ", y int"
    # equal readings are one row with a count
    grouped = sampled.mapInPandas(readings, schema).groupBy(*FEATURES, "y").agg(F.count("*").alias("n")).toPandas()
    model.coefficients, model.intercept = _logistic(grouped[list(FEATURES)].to_numpy(), grouped["y"].to_numpy(), grouped["n"].to_numpy())
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, strength: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps for a logistic fit drawn to PRIOR, projected onto the bounds of each coefficient.

    No meant reading may lower a score, and no negated or reported one may raise it.
    """
    order = np.lexsort(tuple(x.T) + (y,))
    x, y, n = x[order], y[order], n[order].astype(float)
    xs = np.hstack([x, np.ones((len(x), 1))])
    start = np.append(PRIOR, -2.5)
    pull = np.append(np.full(len(PRIOR), strength), 0.01)
    beta = start.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(xs @ beta, -30, 30)))
        gradient = xs.T @ (n * (y - p)) - pull * (beta - start)
        hessian = (xs * (n * p * (1 - p))[:, None]).T @ xs + np.diag(pull)
        before = beta
        beta = beta + np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        beta[:-1] = np.clip(beta[:-1], LOW, HIGH)
        beta[-1] = min(beta[-1], -0.5)  # a text without a match is not toxic
        if np.abs(beta - before).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def toxicity_udf(spark: SparkSession, model: ToxicityModel):
    """text -> score from 0 to 1. Null and empty texts get the score of a text without a match."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        scorer = Scorer(m)
        for texts in batches:
            x = np.stack([scorer.features(t or "") for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)))
            yield pd.Series(1 / (1 + np.exp(-(x @ m.coefficients + m.intercept))))

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with score and predicted (1 from 0.5), one row per row of ``docs``.

    Each text is scored whole and by itself; rows that repeat an id get a row each.
    """
    scored = docs.select(*keep, toxicity_udf(docs.sparkSession, model)("text").alias("__score"))
    return scored.select(*keep, F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
