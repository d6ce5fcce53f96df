"""SentencePiece BPE encoding with seeded merge-dropout, and its decoding.

Symbols start as characters; the agenda always holds every pair of neighbours whose concatenation is a piece, best
score first, then leftmost. A candidate is known by its document (a keyed hash of the text), its pre-token, the character at which it
starts and the piece it would make; a keyed hash of these and of the seed decides whether it is skipped, for good. So a
seed gives the same segmentation on every machine and in every run, another seed or document another one, and dropout 0 the
library's. Inside a document equal pre-tokens are cut alike, across documents each time anew. Characters that are no piece become their UTF-8 bytes; so does U+2581, which would decode as a space. Hence
decoding returns every text exactly.

Short pre-tokens are encoded many at a time: one merge in each at every step. Long ones have an agenda (a heap) each.

Cases: null and empty texts have no pieces (null decodes as empty); null ids, repeated rows and empty tables pass
through; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, trim
from .pieces import SPACE, default_model, exact_pre_tokens, load, model_bytes

SHORT = 32
_NONE = np.int32(2**31 - 1)


def _gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[s : s + n] of each start and size, one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    def __init__(self, model: bytes, seed: int = 0, dropout: float = 0.1) -> None:
        sp = load(model)
        self.n = sp.get_piece_size()
        normal = [i for i in range(self.n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        by_score = sorted(normal, key=lambda i: -sp.get_score(i))
        rank, at = np.full(self.n, _NONE, dtype=np.int32), -1
        for n, i in enumerate(by_score):
            at = at if n and sp.get_score(by_score[n - 1]) == sp.get_score(i) else n
            rank[i] = at
        self.rank = rank
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = self.symbol(piece[:k]), self.symbol(piece[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        self.pairs = pairs
        self.table = np.arange(self.n, self.n + 0x110000, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.table[ord(piece)] = i
        self.table[ord(" ")], self.table[ord(SPACE)] = self.ids[SPACE], self.n + ord(SPACE)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        self.key = np.uint64(xxhash.xxh64_intdigest(f"merge {seed}"))
        self.below = np.uint64(min(2**64 - 1, int(dropout * 2**64)))
        raw = [b"" if rank[i] == _NONE else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.n)]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), dtype=np.uint8), np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size

    def symbol(self, text: str) -> int | None:
        """A piece's id, or for a character that is none a number above all ids."""
        return self.ids.get(text, self.n + ord(text) if len(text) == 1 else None)

    def symbols(self, text: str) -> np.ndarray:
        """Of each character: the id of the piece that it is, or a number above all ids."""
        return self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]

    def unit(self, own: int, token: str) -> int:
        return xxhash.xxh64_intdigest(token, int(self.key) ^ own)

    def skipped(self, unit: np.ndarray, start: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return mix64(unit ^ mix64(start.astype(np.uint64) * np.uint64(1 << 32) + piece.astype(np.uint64) + self.key)) < self.below

    def bytes_of(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            out += [s] if s < self.n else [self.byte_ids[b] for b in chr(s - self.n).encode("utf-8", "surrogatepass")]
        return out

    def encode_long(self, own: int, token: str) -> list[int]:
        """One pre-token with an agenda of its own."""
        symbol, unit = self.symbols(token).tolist(), np.uint64(self.unit(own, token))
        after, before = list(range(1, len(symbol))) + [-1], list(range(-1, len(symbol) - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def propose(pairs: list[int]) -> None:
            found = [(i, m) for i in pairs if i >= 0 and after[i] >= 0 and (m := self.pairs.get((symbol[i] << 32) | symbol[after[i]])) is not None]
            if found:
                at, made = (np.array(x, dtype=np.int64) for x in zip(*found))
                for (i, m), out in zip(found, self.skipped(np.full(len(at), unit), at, made)):
                    if not out:
                        heapq.heappush(agenda, (int(self.rank[m]), i, m, symbol[i], symbol[after[i]]))

        propose(list(range(len(symbol))))
        while agenda:
            _, i, m, left, right = heapq.heappop(agenda)
            j = after[i]
            if symbol[i] != left or j < 0 or symbol[j] != right:
                continue
            symbol[i], symbol[j], after[i] = m, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            propose([before[i], i])
        return self.bytes_of([s for s in symbol if s >= 0])

    def _lookup(self, left: np.ndarray, right: np.ndarray, unit: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; no rank if it makes none or is skipped."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = self.made[at]
        out = (self.keys[at] != key) | (left < 0) | (right < 0)
        out |= self.skipped(unit, start, piece)
        return np.where(out, _NONE, self.rank[piece]), piece

    def encode_short(self, owners: list[int], tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short pre-tokens, one after another, and how many each has. One merge is made in each at every step."""
        n, sizes = len(tokens), np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        width = int(sizes.max()) + 1
        sym = np.full((n, width), -1, dtype=np.int32)
        sym[np.arange(width) < sizes[:, None]] = self.symbols("".join(tokens))
        units = np.array([self.unit(v, t) for v, t in zip(owners, tokens)], dtype=np.uint64)
        start = np.broadcast_to(np.arange(width, dtype=np.int32), (n, width)).copy()
        rank = np.full((n, width), _NONE, dtype=np.int32)
        piece = np.zeros((n, width), dtype=np.int32)
        r, c = np.nonzero(sym[:, 1:] >= 0)
        rank[r, c], piece[r, c] = self._lookup(sym[r, c], sym[r, c + 1], units[r], start[r, c])
        live, done = np.arange(n), np.full((n, width), -1, dtype=np.int32)
        columns = np.arange(width - 1)
        while len(live):
            at = rank.argmin(axis=1)
            go = rank[np.arange(len(live)), at] != _NONE
            if not go.all():
                done[live[~go]] = sym[~go]
                live, at, sym, start, rank, piece, units = live[go], at[go], sym[go], start[go], rank[go], piece[go], units[go]
                if not len(live):
                    break
            rows = np.arange(len(live))
            sym[rows, at] = piece[rows, at]
            for x, fill in ((sym, -1), (start, 0), (rank, _NONE), (piece, 0)):
                x[:, :-1] = np.where(columns > at[:, None], x[:, 1:], x[:, :-1])
                x[:, -1] = fill
            # the merged symbol took its right neighbour's place: shift the symbol after it next to it
            for here in (at, at - 1):
                ok = here >= 0
                k, h = rows[ok], here[ok]
                rank[k, h], piece[k, h] = self._lookup(sym[k, h], sym[k, h + 1], units[k], start[k, h])
        held = done >= 0
        flat, sizes = done[held], held.sum(axis=1)
        if (flat >= self.n).any():
            spelled = [[x] if x < self.n else self.bytes_of([x]) for x in flat.tolist()]
            own = np.repeat(np.arange(n), sizes)
            sizes = np.bincount(own, weights=[len(x) for x in spelled], minlength=n).astype(np.int64)
            flat = np.array([y for x in spelled for y in x], dtype=np.int32)
        return flat, sizes

    def encode(self, units: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all (document key, pre-token), and where each one's begin and how many they are."""
        at, size, parts, end = np.zeros(len(units), dtype=np.int64), np.zeros(len(units), dtype=np.int64), [np.zeros(0, dtype=np.int32)], 0
        by_size: dict[int, list[int]] = {}
        for i, (v, t) in enumerate(units):
            if len(t) > SHORT:
                parts.append(np.array(self.encode_long(v, t), dtype=np.int32))
                at[i], size[i], end = end, len(parts[-1]), end + len(parts[-1])
            else:
                by_size.setdefault((len(t) + 1) // 2, []).append(i)
        for some in by_size.values():
            for k in range(0, len(some), 20_000):
                part = some[k : k + 20_000]
                flat, sizes = self.encode_short([units[i][0] for i in part], [units[i][1] for i in part])
                parts.append(flat)
                at[part], size[part], end = end + np.cumsum(sizes) - sizes, sizes, end + len(flat)
        return np.concatenate(parts), at, size

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a document's ids; the space put before it goes."""
        return _gather(self.raw, self.raw_at[ids], self.raw_size[ids]).tobytes()[1:]


class Encoder:
    """Ids of documents. Each distinct pre-token of a document is encoded once, under the document's own key."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec

    def __call__(self, documents: list[str]) -> list[np.ndarray]:
        place: dict[str, int] = {}
        units: list[tuple[int, str]] = []
        coded: list[np.ndarray] = []
        for d in documents:
            if d not in place:
                place[d] = len(coded)
                tokens, own = exact_pre_tokens(d), xxhash.xxh64_intdigest(d, int(self.codec.key))
                code = {t: n for n, t in enumerate(dict.fromkeys(tokens), len(units))}
                units += [(own, t) for t in code]
                coded.append(np.fromiter(map(code.__getitem__, tokens), dtype=np.int64, count=len(tokens)))
        flat, at, size = self.codec.encode(units)
        ids = [_gather(flat, at[c], size[c]) if len(c) else np.zeros(0, dtype=np.int32) for c in coded]
        return [ids[place[d]] for d in documents]


def _slices(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, seed: int = 0, dropout: float = 0.1, emit: str = "ids") -> DataFrame:
    """emit="ids": id and the piece ids of each row. emit="digest": id, n_bytes, n_pieces, pieces_sha256 (of the ids as 32-bit
    little-endian integers), decoded_sha256 (of the text decoded from them) and lossless (whether it is the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model or default_model()))  # half a megabyte, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Codec(shared.value, seed, dropout))
        for batch in batches:
            at = 0
            for some in _slices([x or "" for x in batch.column(1).to_pylist()]):
                ids, who = encoder(some), batch.column(0).slice(at, len(some))
                at += len(some)
                if emit == "ids":
                    yield pa.RecordBatch.from_arrays([who, pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])
                    continue
                raw = [x.encode() for x in some]
                decoded = [encoder.codec.decode(x) if len(x) else b"" for x in ids]
                columns = [pa.array([len(x) for x in raw], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded]), pa.array([a == b for a, b in zip(raw, decoded)])]
                yield pa.RecordBatch.from_arrays([who, *columns], names=["id", "n_bytes", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"])
        del encoder
        trim()

    kind = docs.schema[id_col].dataType.simpleString()
    tail = "ids array<int>" if emit == "ids" else "n_bytes long, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {tail}")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """id and text of each row of encode()'s ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(model or default_model()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            out = [codec.decode(np.array(x, dtype=np.int64)).decode() if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
