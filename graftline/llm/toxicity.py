"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns words into symbols (insult, threat verb, modal, copula, target, negation, reporting verb, other).  Five weighted
transducers rewrite the symbols of a clause one after the other:

* insults: an insult right behind another one counts half;
* targets: an insult that a target addresses within three words (a copula keeps it going) becomes addressed, and a target
  within two words behind an insult addresses it back, at half weight;
* threats: a threat verb behind a modal, completed by a target before or behind it, is a threat; without a modal, at half weight;
* negation: what is addressed, insulted or threatened within three words of a negation is negated;
* reported speech: the same behind a reporting verb is reported.

Their composition runs as one machine over a clause: each word's weight is multiplied by the weights of the arcs that it takes, and
the clause adds its matches by kind.  A document's score is a logistic function of these sums, so that single words do not decide by themselves.

The lexicon's insults, whole words and stems, are learned from labelled documents: forms that toxic documents have in at least
``MIN_SHARE`` as many different contexts as there are toxic documents (contexts, so that copies do not count again) and that other
documents have next to never.  At most ``LABEL_BOUND`` labelled documents are used, those with the smallest hash of
doc_id outside the held-out fold; they alone bound the lexicon.  Each of four parts of these documents is scored by a lexicon of the others for
the weights, and the lexicon of all scores the corpus.  Every document is scored over its whole text.

Defined results: null and empty texts get the score of a text without matches; a null doc_id is held out; rows
that repeat a doc_id are scored one by one (for learning, the smallest label and text count); without toxic labels every
score is the prior; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graftline.llm.memory import lean
from graftline.staging import stage

LABEL_BOUND = 20_000
MIN_SHARE, MIN_CONTEXTS, PURITY = 0.004, 4, 0.97
STEMS = range(4, 8)
FOLDS = 4
COUNTED_AT_ONCE = 512

#: Symbols of words, and those that the grammar makes of them.
OTHER, INSULT, VERB, MODAL, COPULA, TARGET, NEGATION, REPORT = range(8)
ADDRESSED, BACK, THREAT, NEGATED, REPORTED = range(8, 13)

CUES = {
    TARGET: "you your yours u he she they him her them his their du dich dir ihr euch sie er tu toi te vous vos votre ton il elle eux tú usted ustedes vosotros él ella ellos",
    COPULA: "are is was were be being bist ist seid sind war es est êtes sont était eres son era",
    MODAL: "will shall would gonna going must want i'll we'll werde werden wird will'n wollen muss vais va allons veux voy vamos quiero debo",
    NEGATION: "not no never isn't aren't wasn't won't don't doesn't didn't nobody nicht kein keine keinen nie niemals pas jamais aucun ni nunca jamás ningún",
    REPORT: "said says say wrote writes called calls quoted claimed told sagte sagt schrieb nannte behauptet dit disait écrit appelle dijo dice escribió llamó",
}
#: A threat verb is one of the stems with one of the endings.
THREAT_STEMS = "kill murder hurt destroy burn stab shoot beat strangl töt umbring verletz zerstör erschieß schlag tuer frapp détrui brûl étrangl matar mat golpe destru dispar".split()
THREAT_ENDINGS = ["", *"s es ed d ing e en st t er ez ent rai erai ai ar aré arte arle é o a as an r re te".split()]
_CUE = {stem + ending: VERB for stem in THREAT_STEMS for ending in THREAT_ENDINGS if len(stem + ending) > 3} | {w: symbol for symbol, words in CUES.items() for w in words.split()}
#: Words that a target, an insult, a modal or a negation reaches.
TARGET_SCOPE, BACK_SCOPE, MODAL_SCOPE, NEGATION_SCOPE = 3, 2, 3, 3

_WORD = regex.compile(r"[\p{L}\p{M}']+|[.!?;:\n|]")
_BREAKS = frozenset(".!?;:\n|")
KINDS = ("plain", "targeted", "negated", "reported", "threat")
_KIND = {INSULT: 0, ADDRESSED: 1, BACK: 1, NEGATED: 2, REPORTED: 3, THREAT: 4}


class Transducer:
    """Deterministic and weighted: arcs (state, symbol) -> (state, symbol out, weight); other symbols pass with weight 1 and follow default, which runs down to 0 from scopes."""

    def __init__(self, arcs: dict[tuple, tuple], default: dict):
        self.arcs, self.default = arcs, default

    def step(self, state, symbol: int) -> tuple:
        return self.arcs.get((state, symbol)) or (self.default.get(state, 0), symbol, 1.0)


def _scopes(*named: tuple[str, int]) -> dict:
    """Defaults of states (name, n): the next word leaves n - 1, and then 0."""
    return {(name, n): (name, n - 1) if n > 1 else 0 for name, most in named for n in range(1, most + 1)}


def insults() -> Transducer:
    return Transducer({(0, INSULT): (1, INSULT, 1.0), (1, INSULT): (1, INSULT, 0.5)}, {})


def targets(ahead: int = TARGET_SCOPE, back: int = BACK_SCOPE) -> Transducer:
    """States ("to", n) behind a target, ("of", n) behind an insult that nobody was addressed by."""
    default = _scopes(("to", ahead), ("of", back))
    arcs = {(s, TARGET): (("to", ahead), TARGET, 1.0) for s in (0, *default)}
    arcs |= {(("of", n), TARGET): (("to", ahead), BACK, 0.5) for n in range(1, back + 1)}
    arcs |= {(s, INSULT): (("of", back), INSULT, 1.0) for s in (0, *default)}
    arcs |= {(("to", n), INSULT): (0, ADDRESSED, 1.0) for n in range(1, ahead + 1)}
    arcs |= {(("to", n), COPULA): (("to", ahead), COPULA, 1.0) for n in range(1, ahead + 1)}
    return Transducer(arcs, default)


def threats(scope: int = MODAL_SCOPE) -> Transducer:
    """States ("will", n) behind a modal, ("at", n) behind a modal and a target, ("do", n) behind a modal and a verb, ("bare", n) behind a verb alone."""
    default = _scopes(("will", scope), ("at", scope), ("do", scope), ("bare", scope - 1))
    every = (0, *default)
    arcs = {(s, MODAL): (("will", scope), MODAL, 1.0) for s in every} | {(s, VERB): (("bare", scope - 1), VERB, 1.0) for s in every}
    for n in range(1, scope + 1):
        arcs |= {(("will", n), VERB): (("do", scope), VERB, 1.0), (("at", n), VERB): (0, THREAT, 1.0), (("do", n), VERB): (("do", scope), VERB, 1.0)}
        for to in (TARGET, BACK):
            arcs |= {(("will", n), to): (("at", scope), to, 1.0), (("do", n), to): (0, THREAT, 1.0)}
    arcs |= {(("bare", n), to): (0, THREAT, 0.5) for n in range(1, scope) for to in (TARGET, BACK)}
    return Transducer(arcs, default)


_MATCHES = (INSULT, ADDRESSED, BACK, THREAT)


def negation(scope: int = NEGATION_SCOPE) -> Transducer:
    """State ("no", n): the next n words are negated."""
    default = _scopes(("no", scope))
    arcs = {(s, NEGATION): (("no", scope), NEGATION, 1.0) for s in (0, *default)}
    arcs |= {(s, m): (default[s], NEGATED, 1.0) for s in default for m in _MATCHES}
    return Transducer(arcs, default)


def reported() -> Transducer:
    """State 1: behind a reporting verb, as far as the clause goes."""
    return Transducer({(0, REPORT): (1, REPORT, 1.0)} | {(1, m): (1, REPORTED, 1.0) for m in _MATCHES}, {1: 1})


class Composition:
    """Transducers one behind the other, as one machine whose states and arcs are made when they are first met."""

    def __init__(self, *machines: Transducer):
        self.machines, self.states, self.names, self.arcs = machines, {(0,) * len(machines): 0}, [(0,) * len(machines)], {}

    def run(self, symbols: list[int]) -> list[tuple[int, float]]:
        """The last machine's symbols and the product of the weights on the way."""
        at, out = 0, []
        for symbol in symbols:
            arc = self.arcs.get((at, symbol))
            if arc is None:
                state, s, weight = [], symbol, 1.0
                for machine, own in zip(self.machines, self.names[at], strict=True):
                    new, s, w = machine.step(own, s)
                    state.append(new)
                    weight *= w
                key = tuple(state)
                if key not in self.states:
                    self.states[key] = len(self.names)
                    self.names.append(key)
                arc = self.arcs[at, symbol] = self.states[key], (s, weight)
            at, made = arc
            out.append(made)
        return out


GRAMMAR = Composition(insults(), targets(), threats(), negation(), reported())


def clause_weights(symbols: list[int], weights: list[float]) -> list[float]:
    """The weights of a clause's matches by kind; weights are those of insults, 1 for other words."""
    sums = [0.0] * len(KINDS)
    for (s, w), own in zip(GRAMMAR.run(symbols), weights, strict=True):
        if s in _KIND:
            sums[_KIND[s]] += w * own
    return sums


class Lexicon:
    """Weights of whole words and of stems, by which words begin."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.heads = {s[: STEMS[0]] for s in stems}

    def insult(self, word: str) -> float:
        if (w := self.words.get(word)) is not None:
            return w
        if word[: STEMS[0]] in self.heads:
            return max((self.stems.get(word[:n], 0.0) for n in STEMS if n <= len(word)), default=0.0)
        return 0.0

    def features(self, text: str | None) -> list[float]:
        """The sums of all clauses by kind."""
        sums, symbols, weights, hit = [0.0] * len(KINDS), [], [], False
        for word in _WORD.findall((text or "").lower()):
            if word in _BREAKS:
                if hit:
                    sums = [a + b for a, b in zip(sums, clause_weights(symbols, weights), strict=True)]
                symbols, weights, hit = [], [], False
                continue
            w = self.insult(word)
            symbol = INSULT if w else _CUE.get(word, OTHER)
            hit = hit or symbol in (INSULT, VERB)
            symbols.append(symbol)
            weights.append(w or 1.0)
        if hit:
            sums = [a + b for a, b in zip(sums, clause_weights(symbols, weights), strict=True)]
        return [math.log1p(x) for x in sums]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND) -> DataFrame:
    """text, toxic, fold (0 to 3) of at most bound labelled documents outside the held-out fold; equal texts once."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    chosen = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("order")).orderBy("order", "doc_id", "toxic").limit(bound).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    return met.groupBy("text").agg(F.min("toxic").alias("toxic")).select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By fold, how many toxic and other documents have a form (context null), and toxic documents' forms with their contexts; ``COUNTED_AT_ONCE`` documents at a time."""
    for b in (batch.slice(at, COUNTED_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, COUNTED_AT_ONCE)):
        documents: tuple[dict[tuple[str, int], int], dict[tuple[str, int], int]] = ({}, {})
        contexts: set[tuple[str, int, int]] = set()
        for text, label, fold in zip(*(b[c].to_pylist() for c in ("text", "toxic", "fold")), strict=True):
            words = [w for w in _WORD.findall(text.lower()) if w not in _BREAKS]
            own = set()
            for i, w in enumerate(words):
                forms = ("=" + w, *("^" + w[:n] for n in STEMS if n <= len(w)))
                own.update(forms)
                if label:
                    around = crc32(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode())
                    contexts.update((f, fold, around) for f in forms)
            n = documents[1 if label else 0]
            for f in own:
                n[f, fold] = n.get((f, fold), 0) + 1
        clean, toxic = documents
        keys = [*clean, *toxic, *((f, fold) for f, fold, _ in contexts)]
        yield pa.RecordBatch.from_arrays([
            pa.array([f for f, _ in keys], pa.string()),
            pa.array([fold for _, fold in keys], pa.int32()),
            pa.array([None] * (len(clean) + len(toxic)) + [c for *_, c in contexts], pa.int64()),
            pa.array([0] * len(clean) + list(toxic.values()) + [0] * len(contexts), pa.int64()),
            pa.array(list(clean.values()) + [0] * (len(toxic) + len(contexts)), pa.int64()),
        ], ["form", "fold", "context", "toxic", "clean"])


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """The lexicon of all rows(text, toxic, fold), and those without each fold, from one count."""
    without = [None, *range(FOLDS)]
    kept = [F.lit(True) if v is None else F.col("fold") != v for v in without]
    some = lambda c, k: F.coalesce(F.sum(F.when(k, F.col(c))), F.lit(0))
    got = rows.agg(*[F.count_if(k & (F.col("toxic") == t)) for k in kept for t in (1, 0)]).first()
    pairs = rows.mapInArrow(lean(_forms), "form string, fold int, context long, toxic long, clean long").groupBy("form", "context")
    pairs = pairs.agg(*[x for v, k in enumerate(kept) for x in (some("toxic", k).alias(f"t{v}"), some("clean", k).alias(f"c{v}"), F.max(k).alias(f"k{v}"))])
    own = [x for v in range(len(without)) for x in (F.count_if(F.col("context").isNotNull() & F.col(f"k{v}")).alias(f"n{v}"), F.sum(f"t{v}").alias(f"t{v}"), F.sum(f"c{v}").alias(f"c{v}"))]
    counts = pairs.groupBy("form").agg(*own)
    made, any_of = [], F.lit(False)
    for v in range(len(without)):
        n_toxic, n_clean = max(1, got[2 * v]), max(1, got[2 * v + 1])
        share = F.col(f"t{v}") / n_toxic
        purity = share / (share + (F.col(f"c{v}") + 0.5) / n_clean)
        good = (F.col(f"n{v}") >= max(MIN_CONTEXTS, MIN_SHARE * n_toxic)) & (F.col(f"t{v}") >= MIN_CONTEXTS) & (purity >= PURITY)
        made.append(F.when(good, purity).alias(f"p{v}"))
        any_of = any_of | good
    best = counts.filter(any_of).select("form", *made).toArrow().to_pylist()
    weight = lambda p: min(6.0, math.log(p / (1 - p)) / 2)
    pick = lambda v, mark: {r["form"][1:]: weight(r[f"p{v}"]) for r in best if r["form"][0] == mark and r[f"p{v}"] is not None}
    return [Lexicon(pick(v, "="), pick(v, "^")) for v in range(len(without))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.r_[np.ones(len(w) - 1), 1e-3]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray]:
    rows = stage(training_rows(docs, labels), "labelled")
    lexicon, *without = learn_lexicons(rows)

    def features(text: pa.Array, fold: pa.Array) -> pa.Array:
        return pa.array([without[f].features(t) for t, f in zip(text.to_pylist(), fold.to_pylist(), strict=True)], pa.list_(pa.float64()))

    features.__annotations__ = {"text": pa.Array, "fold": pa.Array, "return": pa.Array}
    got = rows.select(F.arrow_udf(features, T.ArrayType(T.DoubleType()))("text", "fold").alias("x"), "toxic").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(KINDS))
    return lexicon, logistic(x, got["toxic"].to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each document."""
    lexicon, w = fit(docs, labels)

    def rate(text: pa.Array) -> pa.Array:
        z = [sum(a * b for a, b in zip(w, lexicon.features(t), strict=False)) + w[-1] for t in text.to_pylist()]
        return pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z], pa.float64())

    rate.__annotations__ = {"text": pa.Array, "return": pa.Array}
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.arrow_udf(rate, T.DoubleType())(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
