"""Language identification by cross-parsing entropy.

A suffix automaton of a bounded sample of labelled text is built for each language. A text is parsed greedily from end to end into
phrases, each the longest match in that sample (a letter that the sample lacks is a phrase of its own), and the language
whose automaton needs the fewest phrases wins; phrases are normalised to bits a symbol: phrases * log2(sample size) /
symbols. Texts are lower-cased; a run of characters other than letters is one space. Texts of a batch are parsed side by side: one
table lookup moves each of them by a symbol; the few that are much longer than the rest end one by one.

Sample: for each language and each of `slots` hash slots the training document with the smallest id hash, of those of up to an eighth of
`chars` characters where the slot has one; of these, in hash order and each distinct text once, whole texts up to `chars` symbols. Only
where they are too few the beginnings of longer documents follow. Every language is learned. Its alphabet is that of all samples; transitions are a
table of states and letters while all languages' tables together take up to DENSE bytes, and sorted pairs beyond.

Cases: a null text or one without a letter is "und" with score 0, as is any text if nothing was learned; ties go to
the language that sorts first; null ids, repeated rows and empty tables pass through; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # makes pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

DENSE = 256 << 20
FEW = 48
_PLANES = 0x110000


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.frombuffer(bytes(map(str.isalpha, map(chr, range(_PLANES)))), dtype=np.uint8).astype(bool)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Steps:
    """From a state and a symbol: four times the next state, plus the phrases that end on the way."""

    def __init__(self, moves: list[dict[int, int]], symbols: int, dense: bool) -> None:
        self.symbols = symbols
        start = np.array([4 * moves[0][c] if c in moves[0] else 1 for c in range(symbols)], dtype=np.int32)
        self.anew = start + 1  # a match ends, the next begins with the symbol; or the symbol is a phrase too
        pairs = [(state * symbols + c, 4 * t) for state, to in enumerate(moves) if state for c, t in sorted(to.items())]
        keys, to = (np.array(x, dtype=np.int64) for x in (zip(*pairs) if pairs else ((), ())))
        keys, to = np.r_[np.arange(symbols), keys], np.r_[start, to].astype(np.int32)
        self.table = self.keys = None
        if dense:
            self.table = np.tile(self.anew, len(moves))
            self.table[keys] = to
        else:
            self.keys, self.to = keys, to

    def __call__(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.symbols + symbol
        if self.keys is None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], self.anew[symbol])

    def rest(self, state: int, symbols: np.ndarray) -> tuple[int, int]:
        """The state after all of the symbols, and the phrases that ended."""
        count, n = 0, self.symbols
        if self.keys is None:
            table = memoryview(self.table)
            for c in symbols.tolist():
                got = table[state * n + c]
                count += got & 3
                state = got >> 2
            return state, count
        known, anew = dict(zip(self.keys.tolist(), self.to.tolist())) if not hasattr(self, "_known") else self._known, self.anew.tolist()
        self._known = known
        for c in symbols.tolist():
            got = known.get(state * n + c)
            got = anew[c] if got is None else got
            count += got & 3
            state = got >> 2
        return state, count

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_known"}


@dataclass
class Model:
    """Of each language its name, steps and bits a phrase; the symbol of each code point (0: no letter, 1: an unknown letter)."""

    names: list[str]
    tables: list[Steps]
    bits: list[float]
    alphabet: dict[int, int]

    def __post_init__(self) -> None:
        self.size = len(self.alphabet) + 2

    def __getstate__(self) -> dict:
        return {"names": self.names, "tables": self.tables, "bits": self.bits, "alphabet": self.alphabet, "size": self.size}

    def code(self) -> np.ndarray:
        code = _letters().astype(np.int32)
        for point, symbol in self.alphabet.items():
            code[point] = symbol
        return code


def normalise(text: str, code: np.ndarray) -> np.ndarray:
    """Symbols of a text, runs of non-letters being one 0."""
    out = code[points(text.lower())]
    return out[(out > 0) | np.r_[True, out[:-1] > 0]] if len(out) else out


def train(samples: dict[str, list[str]], chars: int, dense: int = DENSE) -> Model:
    letters = _letters()
    found = sorted({int(c) for docs in samples.values() for t in docs for c in np.unique(points(t.lower())) if letters[c]})
    model = Model([], [], [], {c: i + 2 for i, c in enumerate(found)})
    code, built = model.code(), []
    for name in sorted(samples):
        text: list[int] = []
        for t in dict.fromkeys(samples[name]):
            text += [*normalise(t, code).tolist(), 0]
            if len(text) >= chars:
                break
        if any(text):
            model.names.append(name)
            built.append(automaton(text[:chars]))
            model.bits.append(math.log2(len(text[:chars]) + 1))
    fits = sum(map(len, built)) * model.size * 4 <= dense
    model.tables += [Steps(moves, model.size, fits) for moves in built]
    return model


def phrases(symbols: np.ndarray, table: Steps, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Phrases of each text symbols[first : first + length]; lengths must fall."""
    state, count = np.zeros(len(first), dtype=np.int64), np.zeros(len(first), dtype=np.int64)
    many = int(length[FEW - 1]) if len(length) >= FEW else 0  # as far as FEW texts reach
    live = np.searchsorted(-length, -np.arange(many), side="left")  # texts longer than k
    for k, n in enumerate(live.tolist()):
        got = table(state[:n], symbols[first[:n] + k])
        count[:n] += got & 3
        state[:n] = got >> 2
    for i in range(int(np.searchsorted(-length, -many, side="left"))):
        state[i], more = table.rest(int(state[i]), symbols[first[i] + many : first[i] + length[i]])
        count[i] += more
    return count + (state > 0)


def predict(texts: list[str | None], model: Model, code: np.ndarray) -> list[tuple[str, float, float]]:
    """(language, score, bits a symbol beyond the first phrase) of each text; score: by how much the winner needs fewer bits than the
    second."""
    parts = [normalise(t or "", code) for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    has = np.array([bool(p.any()) for p in parts], dtype=bool)
    if not model.names or not has.any():
        return [("und", 0.0, 0.0)] * len(texts)
    symbols, first = np.concatenate(parts), np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    cost = np.empty((len(model.names), len(texts)))
    for own, table, bits in zip(cost, model.tables, model.bits):
        own[order] = bits * phrases(symbols, table, first[order], sizes[order])
    bare = (cost - np.array(model.bits)[:, None]) / np.maximum(sizes - 1, 1)
    cost /= np.maximum(sizes, 1)
    best = cost.argmin(axis=0)
    low, beyond = cost[best, np.arange(len(texts))], bare[best, np.arange(len(texts))]
    second = np.partition(cost, 1, axis=0)[1] if len(model.names) > 1 else np.full(len(texts), np.inf)
    score = np.clip(1 - low / second, 0, 1)
    return [(model.names[b], float(s), float(x)) if h else ("und", 0.0, 0.0) for b, s, x, h in zip(best, score, beyond, has)]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars: int = 24_000, slots: int = 64) -> Model:
    """From the rows that have a language."""
    most = max(1, chars // 8)
    named = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"), (F.length(text_col) > most).alias("long"))
    # of each slot one hash: at most `slots` rows a language
    firsts = named.groupBy("lang", F.pmod("h", F.lit(slots)).alias("slot")).agg(F.min(F.struct("long", "h")).alias("m")).select("lang", "m.*")
    rows = named.join(F.broadcast(firsts), ["lang", "h", "long"]).groupBy("lang", "h", "long").agg(F.min(F.when(F.col("long"), F.substring("text", 1, most)).otherwise(F.col("text"))).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.long, r.h % (1 << 64))):
        samples.setdefault(r.lang, []).append(r.text)
    return train(samples, chars)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, bits of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # chars and the number of languages bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        code = own.code()
        for batch in batches:
            column, out = batch.column(1), []
            at, size = 0, 0
            for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
                size += n or 0
                if size > 4_000_000 or i + 1 == len(column):
                    out += predict(column.slice(at, i + 1 - at).to_pylist(), own, code)
                    at, size = i + 1, 0
            lang, score, bits = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=["id", "lang_pred", "score", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, bits double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", most_bits: float = 7.0) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language: not "und", and at most most_bits bits a symbol beyond the first
    phrase, which any text needs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        code = own.code()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = predict(part.column(text_col).to_pylist(), own, code)
                yield part.filter(pa.array([lang != "und" and bits <= most_bits for lang, _, bits in found], pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)
