"""Toxicity by a counterfactually regularised classifier.

A text's features are its distinct words (lower-cased) and their beginnings of 4 to 6 letters, hashed. From a bounded sample of
labelled rows the `features` most telling ones are kept and a logistic model with an L1 penalty is fitted. For every
sample text that mentions an identity term, the text with each such term replaced by the next of its group is a
counterfactual: `balance` times the mean squared change of the log-odds between the two is added to the loss, so that a
group's name by itself can't move a score, however the labels lean.

Sample: the `sample` labelled rows with the smallest id hashes, each distinct text once (toxic if any of its copies is);
it, the kept features and the model are bounded by these parameters. Scores cover whole texts.

The penalty and the weight of toxic rows are chosen from CHOICES by `folds`-fold cross-validation among the sample, that is among
training rows only: the pair with the smallest cost at the threshold wins, a missed toxic text costing MISS false alarms; of
equal ones the first.

Cases: null and empty texts have no features and score as the model's base rate; texts labelled null are not learned from; with
no labels every score is 0; null ids, repeated rows and empty tables pass through; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store

# Identity terms; within a group each stands for the next.
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "refugees", "natives"),
    ("american", "african", "european", "mexican", "chinese"),
    ("old", "young"),
    ("blind", "deaf", "disabled"),
)
STARTS = (4, 5, 6)
#: Pairs (l1, lift) to choose from, and what a missed toxic text costs in false alarms.
CHOICES = ((5e-4, 1.0), (5e-4, 3.0), (1.5e-3, 1.0), (1.5e-3, 3.0))
MISS = 3
_WORD = re.compile(r"[^\W\d_]+")


def swaps(groups: tuple[tuple[str, ...], ...] = IDENTITY) -> dict[str, str]:
    return {a: b for g in groups for a, b in zip(g, (*g[1:], g[0]))}


def _hash(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature)


def word_features(word: str) -> list[int]:
    return [_hash(word), *(_hash(f"{word[:n]}-") for n in STARTS if len(word) >= n)]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(found: set[str]) -> set[int]:
    return {f for w in found for f in word_features(w)}


@dataclass
class Model:
    base: float
    weights: dict[int, float]

    def score(self, log_odds: float) -> float:
        if self.base == -np.inf:  # nothing was learned
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(log_odds, -30, 30))))


class Scorer:
    """Scores of texts; what a word's features add up to is remembered for up to `known` words."""

    def __init__(self, model: Model, known: int = 300_000) -> None:
        self.model, self.known, self.told = model, known, {}

    def __call__(self, text: str | None) -> float:
        told, weights = self.told, self.model.weights
        if len(told) > self.known:
            told.clear()
        telling: set[int] = set()
        for w in words(text):
            if (found := told.get(w)) is None:
                told[w] = found = tuple(f for f in word_features(w) if f in weights)
            if found:
                telling.update(found)
        return self.model.score(self.model.base + sum(weights[f] for f in sorted(telling)))


def _times(of: np.ndarray, column: np.ndarray, value: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of, weights=w[column] * value, minlength=n) if len(of) else np.zeros(n)


def fit(rows: list[list[int]], toxic: list[int], changes: list[list[tuple[int, int]]], width: int, l1: float = 5e-4, balance: float = 1.0, lift: float = 1.0, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Base and weights: accelerated proximal gradient on the mean log loss, plus balance times the mean squared change of
    the log-odds over the counterfactual pairs, plus l1 times the weights' sum. Toxic rows count `lift` times, as they are
    few and missing one is worse than a second look. changes: of each pair (column, +1 or -1)."""
    n, m, y = len(rows), max(1, len(changes)), np.array(toxic, dtype=float)
    of = np.repeat(np.arange(n), [len(r) for r in rows])
    column = np.array([c for r in rows for c in r], dtype=np.int64)
    one = np.ones(len(column))
    pair = np.repeat(np.arange(len(changes)), [len(r) for r in changes]).astype(np.int64)
    moved = np.array([c for r in changes for c, _ in r], dtype=np.int64)
    sign = np.array([s for r in changes for _, s in r], dtype=float)
    most = lambda o, c, v, k: _largest(o, c, v, k, width)
    cost = 1 + (lift - 1) * y
    step = 1 / (0.25 * max(1.0, lift) * (most(of, column, one, n) / n + 1) + 2 * balance * most(pair, moved, sign, m) / m + 1e-9)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base, w = float(np.log(rate / (1 - rate))), np.zeros(width)
    ahead_b, ahead_w, t = base, w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ahead_b + _times(of, column, one, ahead_w, n), -30, 30)))
        g = np.bincount(column, weights=((p - y) * cost)[of], minlength=width) / n
        if len(pair):
            g = g + 2 * balance / m * np.bincount(moved, weights=_times(pair, moved, sign, ahead_w, m)[pair] * sign, minlength=width)
        new = ahead_w - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_b = ahead_b - step * float(((p - y) * cost).mean())
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - base)
        w, base, t = new, new_b, t_next
    return base, w


def choose(rows: list[list[int]], toxic: list[int], changes: list[list[tuple[int, int]]], width: int, balance: float = 1.0, threshold: float = 0.3, folds: int = 3, choices: tuple[tuple[float, float], ...] = CHOICES, rounds: int = 150) -> tuple[float, float]:
    """The (l1, lift) of which models fitted on the other folds cost least on each fold. Rows are dealt out by their place, the toxic and
    the others each in turn, so every fold has both."""
    y = np.array(toxic)
    fold = np.zeros(len(y), dtype=np.int64)
    for kind in (0, 1):
        fold[y == kind] = np.arange((y == kind).sum()) % folds
    edge = np.log(threshold / (1 - threshold))
    costs = []
    for l1, lift in choices:
        cost = 0
        for f in range(folds):
            own, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(own) and len(rest):
                base, w = fit([rows[i] for i in rest], y[rest].tolist(), changes, width, l1, balance, lift, rounds)
                flagged = np.array([base + sum(w[c] for c in rows[i]) >= edge for i in own])
                cost += MISS * int((~flagged & (y[own] == 1)).sum()) + int((flagged & (y[own] == 0)).sum())
        costs.append(cost)
    return choices[int(np.argmin(costs))]


def _largest(of: np.ndarray, column: np.ndarray, value: np.ndarray, n: int, width: int) -> float:
    """The largest eigenvalue of X'X, by power iteration."""
    if not len(of):
        return 0.0
    v, size = np.ones(width) / np.sqrt(width), 0.0
    for _ in range(30):
        v = np.bincount(column, weights=_times(of, column, value, v, n)[of] * value, minlength=width)
        size = float(np.linalg.norm(v))
        if not size:
            return 0.0
        v /= size
    return size * 1.05


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000, keep: int = 4096, groups: tuple[tuple[str, ...], ...] = IDENTITY, balance: float = 1.0) -> Model:
    """From labels(id, label 0 or 1) and the documents' texts."""
    store, swap = Store(docs.sparkSession, "toxicity"), swaps(groups)
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    picked = store.put(picked.orderBy(F.xxhash64(id_col), id_col).limit(sample), "picked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            has, lost, won = [], [], []
            for t in texts:
                found = words(t)
                own = features(found)
                other = features({swap.get(w, w) for w in found}) if not swap.keys().isdisjoint(found) else own
                has.append(sorted(own))
                lost.append(sorted(own - other))
                won.append(sorted(other - own))
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(t or "") >> 1 for t in texts], pa.int64()), batch.column(1), pa.array(has, ints), pa.array(lost, ints), pa.array(won, ints)], names=["h", "toxic", "has", "lost", "won"])

    # picked has at most `sample` rows of two numbers
    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(picked), id_col).select("text", "toxic")
    rows = chosen.mapInArrow(run, "h long, toxic int, has array<long>, lost array<long>, won array<long>")
    rows = store.put(rows.groupBy("h").agg(F.max("toxic").alias("toxic"), *(F.first(c).alias(c) for c in ("has", "lost", "won"))), "rows")
    n, bad = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not n:
        return Model(-np.inf, {})
    counts = rows.select("toxic", F.explode("has").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    gap = F.col("bad") - F.col("n") * F.lit(bad / n)
    telling = counts.where("n >= 3").select("f", (gap * gap / F.col("n")).alias("gain")).orderBy(F.desc("gain"), "f").limit(keep).collect()
    kept = sorted({r.f for r in telling} | {f for w in swap for f in word_features(w)})
    place = {f: i for i, f in enumerate(kept)}

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pa.array([[place[f] for f in x if f in place] for x in column.to_pylist()], pa.list_(pa.int32())) for column in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["toxic", "has", "lost", "won"])

    held = rows.select("toxic", "has", "lost", "won").mapInArrow(narrow, "toxic int, has array<int>, lost array<int>, won array<int>").collect()
    order = sorted(held, key=lambda r: (r.toxic, r.has))
    has, marks = [r.has for r in order], [r.toxic for r in order]
    changes = [[*((c, -1) for c in r.lost), *((c, 1) for c in r.won)] for r in order if r.lost or r.won]
    l1, lift = choose(has, marks, changes, len(kept), balance)
    base, w = fit(has, marks, changes, len(kept), l1, balance, lift)
    return Model(base, {f: float(w[i]) for f, i in place.items() if w[i]})


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score and predicted (1 if score >= threshold) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by learn()'s keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
