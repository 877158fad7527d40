"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of what stands around.

The lexicon holds terms and stems. A word runs through the product of the trie and the
Levenshtein automata of all its terms, built state by state as words ask for it, so most
words end after a few letters. Each hit is weighed by what stands around it: quotation
marks and words of report speak for a quotation, words of address for abuse. Learned weights
turn counts of hits into a probability.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, small_batches, tidy, written

# English terms of abuse that need no labels; words of report; words of address; quotation marks.
TERMS = ("bastard", "clown", "disgusting", "dumb", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
REPORT = frozenset("said says saying called calling quote quoted quotes wrote writes word term phrase slur insult reported alleged".split())
ADDRESS = frozenset("you your yours yourself u ur he she they".split())
QUOTES = "\"'“”„«»‘’‹›"

WINDOW = 6
_WORD = re.compile(r"[^\W_](?:[\w@$*]*[^\W_])?")


def edits_allowed(term: str) -> int:
    """No edit in terms of up to 4 letters, one up to 8, two beyond."""
    return 0 if len(term) <= 4 else 1 if len(term) <= 8 else 2


class FuzzyLexicon:
    """``terms`` are met as whole words, ``stems`` as beginnings of words; each within its edits. A
    stem's edits could hide in what follows it: it is allowed one less, unless ``stem_edits``."""

    def __init__(self, terms: list[str], stems: list[str], stem_edits: bool = False):
        self.child: list[dict[str, int]] = [{}]
        self.term_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.reach = [0]
        for words, where, spare in ((terms, self.term_at, 0), (stems, self.stem_at, 0 if stem_edits else 1)):
            for word in words:
                allowed = max(0, edits_allowed(word) - spare)
                node = 0
                self.reach[0] = max(self.reach[0], allowed)
                for c in word:
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        self.reach.append(0)
                    node = self.child[node][c]
                    self.reach[node] = max(self.reach[node], allowed)
                where[node] = allowed
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.step: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.begins: list[int] = []
        self.start = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """The number of a set of (node, edits so far); letters left out of the word are followed first."""
        todo = list(least)
        while todo:
            node = todo.pop()
            edits = least[node] + 1
            for to in self.child[node].values():
                if edits <= self.reach[to] and edits < least.get(to, 99):
                    least[to] = edits
                    todo.append(to)
        key = tuple(sorted(least.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            self.ends.append(min((e for n, e in key if e <= self.term_at.get(n, -1)), default=99))
            self.begins.append(min((e for n, e in key if e <= self.stem_at.get(n, -1)), default=99))
        return self.ids[key]

    def _next(self, state: int, c: str) -> int:
        least: dict[int, int] = {}
        for node, edits in self.sets[state]:
            for letter, to in self.child[node].items():
                e = edits + (letter != c)
                if e <= self.reach[to] and e < least.get(to, 99):
                    least[to] = e
            if edits + 1 <= self.reach[node] and edits + 1 < least.get(node, 99):
                least[node] = edits + 1
        self.step[state][c] = to = self._state(least) if least else -1
        return to

    def match(self, word: str) -> int:
        """The fewest edits with which the word is in the lexicon; 99 if it isn't."""
        if len(self.sets) > 200_000:
            self.reset()
        state, best = self.start, 99
        for c in word:
            to = self.step[state].get(c)
            state = self._next(state, c) if to is None else to
            if state < 0:
                return best
            if self.begins[state] < best:
                best = self.begins[state]
        return min(best, self.ends[state])


#: log1p of: plain exact hits, plain hits with an edit, quoted hits, hits with a word of address near; any exact hit, any hit with an edit; exact hits per word
FEATURES = ("exact", "edited", "quoted", "addressed", "any_exact", "any_edited", "density")
_PRIOR = np.array([1.0, 0.2, -0.5, 0.5, 1.5, 0.2, 0.5])


def context_features(text: str, lexicon: FuzzyLexicon, known: dict[str, int]) -> np.ndarray:
    """FEATURES of the whole text."""
    lower = text.lower()
    words = _WORD.findall(lower)
    hits = {}
    for word in set(words):
        edits = known.get(word)
        if edits is None:
            known[word] = edits = lexicon.match(word)
        if edits < 99:
            hits[word] = edits
    out = np.zeros(len(FEATURES))
    if not hits:
        return out
    n = Counter()
    spots = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(lower)]
    for i, (a, b, word) in enumerate(spots):
        if word in hits:
            before = [w for _, _, w in spots[max(0, i - WINDOW) : i]]
            near = before + [w for _, _, w in spots[i : i + WINDOW + 1]]
            left, right = lower[max(0, a - 40) : a], lower[b : b + 40]
            quoted = (any(q in left[-2:] for q in QUOTES) and any(q in right[:2] for q in QUOTES)) or (any(q in left for q in QUOTES[2:]) and any(q in right for q in QUOTES[2:])) or bool(REPORT & set(before) and left.count('"') % 2 and '"' in right)
            kind = "quoted" if quoted else "exact" if hits[word] == 0 else "edited"
            n[kind] += 1
            if not quoted and ADDRESS & set(near):
                n["addressed"] += 1
    out[:4] = [np.log1p(n[k]) for k in FEATURES[:4]]
    out[4:] = n["exact"] > 0, n["edited"] > 0, min(1.0, 20 * n["exact"] / len(spots))
    return out


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=lambda: sorted(TERMS))
    stems: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: _PRIOR.copy())
    base: float = -2.0

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights + self.base)))


@tidy
def _candidates(batches: Iterator[pa.RecordBatch], shortest: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of texts, toxic and not, with each whole word ("word$") and each beginning of a word
    of ``shortest`` to ``longest`` letters."""
    for batch in small_batches(batches, "text", 8 << 20):
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = set(_WORD.findall(text.lower()))
            found = {w[:k] for w in words for k in range(shortest, min(longest, len(w)) + 1)} | {w + "$" for w in words}
            (toxic if label > 0.5 else clean).update(found)
            (toxic if label > 0.5 else clean).update([""])
        names = sorted(set(toxic) | set(clean))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([clean[t] for t in names], pa.int64())], names=["term", "toxic", "clean"])


def mine_lexicon(sample: DataFrame, most: int = 400) -> tuple[list[str], list[str]]:
    """(terms, stems) that toxic training texts have and others don't; at most ``most``.

    A candidate needs 3 toxic texts, 1% of them, and to be 20 times as likely in a toxic
    text. The strongest are taken first; a stem that begins with, or is the beginning of, one
    already taken that does no worse adds nothing. Whole words can have any length and are
    taken beside the stems that cover them, as they may have edits where the stem has none
    or ends; these don't count towards ``most``.
    """
    counts = written(sample.mapInArrow(partial(_candidates, shortest=4, longest=8), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxicity-terms")
    totals = counts.where("term = ''").first()
    if not totals or not totals.toxic:
        return [], []
    odds = (F.col("toxic") / totals.toxic) / ((F.col("clean") + 0.5) / (totals.clean + 1))
    good = counts.where("term <> ''").where((F.col("toxic") >= max(3, 0.01 * totals.toxic)) & (odds >= 20))
    rows = good.withColumn("odds", odds).orderBy(F.desc("toxic"), F.desc("odds"), F.desc(F.length("term")), "term").limit(50 * most).collect()
    terms: list[str] = []
    stems: list[str] = []
    free = most
    for r in sorted(rows, key=lambda r: (-(r.toxic - 20 * r.clean), r.clean, -len(r.term), r.term)):
        word = r.term.rstrip("$")
        if r.term.endswith("$"):
            covered = any(word.startswith(s) for s in stems)
            if covered or free:
                terms.append(word)
                free -= not covered
        elif free and not any(word.startswith(s) or s.startswith(word) for s in stems) and word not in terms:
            stems.append(word)
            free -= 1
    return terms, stems


@tidy
def _sampled(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    lexicon, known = FuzzyLexicon(model.terms, model.stems, stem_edits=True), {}
    for batch in small_batches(batches, "text"):
        x = [context_features(t, lexicon, known) for t in batch.column("text").to_pylist()]
        known.clear()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, its weights pulled towards the prior ones."""
    full = np.hstack([x, np.ones((len(x), 1))])
    prior = np.append(_PRIOR, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        g = full.T @ (y - p) - pull * (w - prior)
        h = (full * (p * (1 - p))[:, None]).T @ full + pull * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxic", limit: int = 20_000) -> ToxicityModel:
    """Mine a lexicon and fit weights on at most about ``limit`` labelled training rows. Without
    labels the fixed terms and prior weights stand."""
    sample = labelled_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, column, limit)
    terms, stems = mine_lexicon(sample)
    model = ToxicityModel(sorted({*TERMS, *terms}), sorted(stems))
    rows = sample.mapInArrow(partial(_sampled, model=model), "doc_id long, label double, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    if len(rows):
        model.weights, model.base = fit_weights(np.array(rows["x"].tolist()), (rows["label"].to_numpy() > 0.5).astype(float))
    return model


@tidy
def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel, at: int) -> Iterator[pa.RecordBatch]:
    lexicon, known = FuzzyLexicon(model.terms, model.stems, stem_edits=True), {}
    for batch in small_batches(batches, at):
        x = []
        for text in batch.column(at).to_pylist():
            x.append(context_features(text or "", lexicon, known))
            if len(known) > 200_000:
                known.clear()
        score = model.score(np.array(x).reshape(-1, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with score (0 to 1, higher is more toxic), from ``text`` alone and all of it.

    Null and empty texts score as texts without a hit. A column score that ``docs`` has is
    replaced. Equal texts get equal scores.
    """
    docs = docs.drop("score")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(partial(_score, model=model, at=docs.columns.index("text")), f"{ddl}, score double")
