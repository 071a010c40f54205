"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers, composed from left to right: a trie of weighted word stems (learned from labelled rows) and
lists of threats, targets, negations and verbs of reported speech turn a word into a class and a weight;
the clause transducer reads the classes and writes each insult's or threat's weight to the channel that
its state names: said plainly, at a target, negated (within NEGATED words) or reported.  A document's
score is a logistic function of its channels' sums and its strongest clause, so matched clauses count,
not isolated words.

Learning uses at most SAMPLE labelled rows (those with the least hash of their id) that are not held out.
A stem is kept if toxic documents hold it clearly more often.  Labels, language, source and id are never
inputs of a score.

Defined results: null or empty text scores as a text without matches; repeated rows score alike; a null id
is never labelled and counts as not held out; an id with several labels is toxic if any says so; without
labelled toxic rows every score is 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, pieces

SAMPLE = 20_000
#: stems: shortest and longest prefix, least toxic documents (a number and a share), least log odds
SHORTEST, LONGEST, LEAST, LEAST_SHARE, LEAST_ODDS = 4, 8, 8, 0.005, 2.5
NEGATED = 3
PREDICT = 0.7
RIDGE, ROUNDS = 1e-2, 30

# FIXED VALUES: word classes in English, German, French and Spanish
THREATS = "kill hurt beat destroy shoot stab burn töten schlagen verletzen umbringen vernichten tuer frapper brûler détruire matar golpear herir quemar destruir".split()
TARGETS = "you your yours he she they them him her these those du dich dein ihr euch sie er tu toi vous votre ils elles lui tú usted ustedes ellos ellas".split()
NEGATIONS = "not no never neither nor without nicht kein keine nie ohne ne pas jamais sans non nunca ni sin".split()
REPORTS = "said says say wrote writes called calls quoted reported sagte sagt schrieb nannte dit écrit appelle dijo dice escribió llamó".split()

PLAIN, TARGETED, NEGATIVE, REPORTED = range(4)
FEATURES = 6
_CLAUSE = re.compile(r"[.,;:!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_CLASSES = {w: "T" for w in TARGETS} | {w: "N" for w in NEGATIONS} | {w: "R" for w in REPORTS}


def stems(word: str) -> list[str]:
    """The whole word (marked by a blank) and its prefixes, longest first."""
    return [word + " ", *(word[:n] for n in range(min(LONGEST, len(word)), SHORTEST - 1, -1))]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Grammar:
    """The composed transducers, with the document score on top."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.theta, self.known = weights, None, {}
        self.threat = float(np.median(list(weights.values()))) if weights else 0.0

    def read(self, word: str) -> tuple[str, float]:
        """Class and weight of a word: I(nsult), H(arm), T(arget), N(egation), R(eport) or nothing."""
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known.clear()
            weight = next((self.weights[s] for s in stems(word) if s in self.weights), 0.0)
            kind = "I" if weight else "H" if word in THREATS else _CLASSES.get(word, "")
            self.known[word] = (kind, weight or (self.threat if kind == "H" else 0.0))
        return self.known[word]

    def clause(self, found: list[tuple[str, float]]) -> list[float]:
        """Weights by channel. A threat counts only at a target; a report covers the rest of its clause."""
        out, targeted = [0.0] * 4, any(k == "T" for k, _ in found)
        negated, reported = 0, False
        for kind, weight in found:
            if kind == "N":
                negated = NEGATED + 1
            elif kind == "R":
                reported = True
            elif kind == "I" or (kind == "H" and targeted):
                out[REPORTED if reported else NEGATIVE if negated else TARGETED if targeted else PLAIN] += weight
            negated = max(0, negated - 1)
        return out

    def features(self, text: str) -> list[float]:
        sums, most = [0.0] * 4, 0.0
        low = text.lower()
        read, known = self.read, self.known
        for clause in _CLAUSE.split(low):
            found = [known.get(w) or read(w) for w in _WORD.findall(clause)]
            if any(k == "I" or k == "H" for k, _ in found):
                channels = self.clause(found)
                sums = [a + b for a, b in zip(sums, channels, strict=True)]
                most = max(most, sum(channels))
        return [1.0, *(math.log1p(s) for s in sums), math.log1p(most)]

    def score(self, text: str) -> float:
        if self.theta is None:
            return 0.0
        x = float(np.dot(self.theta, self.features(text)))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the constant is not shrunk."""
    theta, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE * len(y) / 100 + RIDGE)
    shrink[0] = 1e-6
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (y - p) - shrink * theta)
        theta += step
        if np.abs(step).max() < 1e-8:
            break
    return theta


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Stems from document counts in Spark; the logistic fit takes FEATURES numbers per sampled row."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    # a little over the bound by a threshold on the hash, so that no task sends many rows, then the bound
    rank = F.xxhash64("_id").cast("double") / 2.0**64 + 0.5
    share = 1.2 * SAMPLE / max(chosen.count(), 1)
    chosen = chosen.where(rank < share).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    rows = rows.select("text", F.col("_y").cast("int").alias("y")).checkpoint()

    def counted(allowed, want):
        def run(batches):
            n = Counter()
            for b in batches:
                for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                    if y == want:
                        found = {s for w in set(words(text)) for s in stems(w)}
                        n.update(found if allowed is None else found & allowed)
            items = list(n.items())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in items], pa.string()), pa.array([v for _, v in items], pa.int64())], names=["stem", "n"])

        return rows.mapInArrow(run, "stem string, n long").groupBy("stem").agg(F.sum("n").alias("n"))

    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad:
        return Grammar({})
    least = max(LEAST, LEAST_SHARE * bad)
    toxic = {r["stem"]: r["n"] for r in counted(None, 1).where(F.col("n") >= least).collect()}  # bounded by SAMPLE
    clean = {r["stem"]: r["n"] for r in counted(frozenset(toxic), 0).collect()}
    weights = {s: math.log((n + 0.5) / (bad + 1)) - math.log((clean.get(s, 0) + 0.5) / (good + 1)) for s, n in toxic.items()}
    grammar = Grammar({s: w for s, w in weights.items() if w >= LEAST_ODDS})

    def features(batches):
        for b in batches:
            found = [grammar.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.float64()) for i in range(FEATURES)] + [b.column("y")], names=[f"f{i}" for i in range(FEATURES)] + ["y"])

    got = np.array([tuple(r) for r in rows.mapInArrow(features, ", ".join(f"f{i} double" for i in range(FEATURES)) + ", y int").collect()])
    order = np.lexsort(got.T)  # the same sums whatever the order of the rows
    grammar.theta = logistic(got[order, :-1], got[order, -1])
    return grammar


def scored(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row."""

    def run(batches):
        for b in (p for whole in batches for p in pieces(whole)):
            scores = [grammar.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= PREDICT) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of the held-out fold are never read."""
    grammar = train(docs, labels.where(fold("doc_id", parts) != held))
    return scored(docs, grammar).select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", "predicted")
