"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash over GRAM-byte strings places triggers: the trigger of a window of `width` bytes is its string of
smallest hash, so it depends on the window's bytes alone, every window has one, and equal windows have equal ones.
A run of window starts with one smallest hash forms a phrase, whose text reaches to the end of its last window and so overlaps the
next phrase's. The dictionary is the set of distinct phrases with counts, the parse is their order
in each document:

1. Documents are packed into blocks (Arrow, zstd) in the shared folder, each with its parse. A block sends its distinct (trigger,
   phrase) pairs, with a flag for repeats inside the block, to the dictionary, which is dealt out by trigger.
2. A dictionary part answers for each pair: does the phrase occur again, is it to be compared? All windows of a phrase that occurs
   again are repeats; a phrase whose trigger is unique has none. Phrases are told apart by 128 bits (trigger and XXH3 of the text).
3. Where one trigger stands in different phrases (the ends of copied passages), one copy of each of them is sent as text. Each
   dictionary part builds the suffix array of its phrases, by prefix doubling on the bytes up to `width`, so it compares bytes and
   no hashes: suffixes of one rank are equal windows.

A phrase overlaps the next by all but one byte of a window, so no compared string runs past its phrase. Of the parse's order the result
therefore needs only how often each phrase stands in it; where two windows are in corpus order is decided inside the dictionary.

A trigger with more than HOT different phrases (a passage copied into a large part of all texts has as many as copies at either
end) would be one task's: windows of such phrases are dealt out one by one, by 96 bits of their own hash (XXH3), and compared by that.
Parts grow in number with the bytes of text and are worked off in chunks of CHUNK bytes, so memory doesn't grow. A hot phrase costs one
entry a block, whatever its count. Nothing is collected; a block has at most `block_bytes` bytes of text or one document.

Cases: null text is empty; texts under `width` bytes and empty tables give no removal; repeated rows remove each
other; null ids pass through; extra columns are carried only by emit="documents".
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # makes pa.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, mix64, pack, partitions, texts, trim, unpack

GRAM = 64
SEGMENT = 1 << 20
BLOCK_BYTES = 1 << 20
PART_BYTES = 16 << 20
HOT, CHUNK = 4096, 4 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(12, (n - 1).bit_length()), base, dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all substrings of one size, from prefix sums. They only place triggers: two strings of one hash cost a comparison."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
    return (sums[size:] - sums[:-size]) * _powers(_INVERSE, len(data) + 1)[: len(sums) - size]


def _slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op (of min and max) over every run of width values, by doubling."""
    size = 1
    while 2 * size <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return x if size == width else op(x[: len(x) - width + size], x[width - size :])


def _segment(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each phrase the trigger's hash, the first and the last window start, and whether it holds its trigger twice, without
    which none of its windows can equal another."""
    run, grams = width - gram + 1, rolling(data, gram)
    high = (grams >> np.uint64(32)).astype(np.uint32)
    least = _slide(high, run, np.minimum)
    changed = np.ones(len(least), dtype=bool)
    np.not_equal(least[1:], least[:-1], out=changed[1:])
    first = np.flatnonzero(changed)
    last = np.append(first[1:], len(least)) - 1
    around = np.zeros(len(least) + 2 * (run - 1), dtype=np.uint32)
    around[run - 1 : len(around) - run + 1] = least
    places = np.flatnonzero(_slide(around, run, np.maximum) == high)
    value = high[places]
    k = np.searchsorted(places, first)
    while len(off := np.flatnonzero(value[k] != least[first])):
        k[off] += 1
    nearby = np.minimum(k + 1, len(places) - 1)
    twice = (nearby > k) & (value[nearby] == least[first]) & (places[nearby] < last + run)
    return mix64(grams[places[k]]), first, last, twice


class Parse:
    """Phrases of one text: window starts first..last (both included), trigger hash, hash of the whole phrase, whether it holds its
    trigger twice."""

    def __init__(self, data: bytes, width: int, gram: int) -> None:
        array, parts = np.frombuffer(data, dtype=np.uint8), []
        for at in range(0, len(array) - width + 1, SEGMENT):
            trigger, first, last, twice = _segment(array[at : at + SEGMENT + width - 1], width, gram)
            parts.append((trigger, first + at, last + at, twice))
        empty = [np.zeros(0, dtype=d) for d in (np.uint64, np.int64, np.int64, bool)]
        self.trigger, self.first, self.last, self.twice = (np.concatenate(x) for x in zip(*parts)) if parts else empty
        digest = xxhash.xxh3_64_intdigest
        self.whole = np.fromiter((digest(data[a : b + width]) for a, b in zip(self.first.tolist(), self.last.tolist())), dtype=np.uint64, count=len(self.first))


def _distinct(keys: np.ndarray, extra: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """Distinct pairs in order, dealt into parts by key: keys, extras, flag for repeats, (part, from, to) of each part, and
    the place of each pair that was given."""
    part = ((keys >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)
    order = np.argsort((part << np.uint64(48)) | (mix64(keys + extra * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(16)), kind="stable")
    k, e, part = keys[order], extra[order], part[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (e[1:] != e[:-1])
    place = np.empty(len(k), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    k, e, part = k[new], e[new], part[new]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(k) else np.zeros(1, dtype=np.int64)
    return k, e, np.bincount(place, minlength=len(k)) > 1, [(int(part[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:])], place


ASKED = "block string, part long, key binary, extra binary, again binary, data binary, parse binary"
TOLD = "block string, part long, flags binary"
SENT = "block string, part long, key binary, extra binary, again binary, sizes binary, texts binary"
_asked, _told, _sent = (pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in ddl.split(", "))]) for ddl in (ASKED, TOLD, SENT))


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: [r.get(c) for r in rows] for c in schema.names}, schema=schema)


def _groups(batches: Iterator[pa.RecordBatch], text_col: str, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Runs of documents of about block_bytes of text."""
    for batch in batches:
        column = batch.column(text_col)
        ends = np.cumsum(np.fromiter((0 if x is None else x for x in pa.compute.binary_length(column).to_pylist()), dtype=np.int64, count=batch.num_rows))
        at = 0
        while at < batch.num_rows:
            past = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block_bytes, side="right")))
            yield batch.slice(at, past - at)
            at = past


def _packed(batch: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue()


def _parsed(batch: pa.RecordBatch, text_col: str, width: int, gram: int, parts: int) -> list[dict]:
    """Rows of ASKED of one block: its documents with their parse, and its distinct pairs by dictionary part."""
    block, parses = uuid.uuid4().hex, [Parse(x, width, gram) for x in texts(batch.column(text_col))]
    trigger, whole, first, last, twice = (np.concatenate([getattr(p, c) for p in parses]) for c in ("trigger", "whole", "first", "last", "twice"))
    key, extra, again, cuts, place = _distinct(trigger, whole, parts)
    kept = {"phrases": [[len(p.first) for p in parses]], "first": [first.astype(np.int32)], "sizes": [(last - first + 1).astype(np.int32)], "twice": [twice], "place": [place.astype(np.int32)], "part": [[p for p, _, _ in cuts]], "to": [[b for _, _, b in cuts]]}
    rows = [{"block": block, "data": _packed(batch), "parse": pack(kept)}]
    return rows + [{"block": block, "part": p, "key": key[a:b].tobytes(), "extra": extra[a:b].tobytes(), "again": again[a:b].tobytes()} for p, a, b in cuts]


class Block:
    """A block's parse with what the dictionary told of it."""

    def __init__(self, parse: bytes, width: int) -> None:
        table = unpack(parse)
        held = {c: table[c].combine_chunks().values.to_numpy(zero_copy_only=False) for c in table.column_names}
        self.width, self.first, self.sizes, self.twice, self.place = width, held["first"].astype(np.int64), held["sizes"].astype(np.int64), held["twice"].astype(bool), held["place"].astype(np.int64)
        self.past, self.part, self.to = np.r_[0, np.cumsum(held["phrases"])].astype(np.int64), held["part"].astype(np.int64), held["to"].astype(np.int64)

    def learn(self, part: list[int], flags: list[bytes]) -> None:
        """Which phrases occur again; which are sent as text, in the order of their parts, and which as hashes of their windows."""
        got = dict(zip(part, flags))
        told = np.concatenate([np.frombuffer(got[p], dtype=np.uint8) for p in self.part.tolist()]) if len(self.part) else np.zeros(0, dtype=np.uint8)
        told = told[self.place] if len(told) else np.zeros(len(self.place), dtype=np.uint8)
        self.again, hot = (told & 1) > 0, (told & 4) > 0
        wanted, self.bucket = (told & 2) > 0, told >> 3
        _, one = np.unique(self.place, return_index=True)
        rep = np.zeros(len(self.place), dtype=bool)
        rep[one] = True  # of equal phrases of the block the first is sent
        send = wanted & rep | self.twice & ~self.again
        self.dealt = self.part[np.searchsorted(self.to, self.place, side="right")] if len(self.part) else self.place
        self.whole = np.flatnonzero(send & ~hot)
        self.whole = self.whole[np.argsort(self.dealt[self.whole], kind="stable")]
        self.single = np.flatnonzero(send & hot)

    def text_of(self, raw: list[bytes], phrases: np.ndarray) -> list[bytes]:
        doc = np.searchsorted(self.past, phrases, side="right") - 1
        return [raw[d][a : a + n + self.width - 1] for d, a, n in zip(doc.tolist(), self.first[phrases].tolist(), self.sizes[phrases].tolist())]

    def windows(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document and the start of each window of these phrases, in order."""
        sizes = self.sizes[phrases]
        start = np.repeat(self.first[phrases] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.repeat(np.searchsorted(self.past, phrases, side="right") - 1, sizes), start

    def hashes(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of each window of the phrases that are sent so."""
        doc, start = self.windows(self.single)
        cut = [raw[d][a : a + self.width] for d, a in zip(doc.tolist(), start.tolist())]
        return np.fromiter(map(xxhash.xxh3_64_intdigest, cut), dtype=np.uint64, count=len(cut)), np.fromiter((xxhash.xxh3_64_intdigest(x, 7) & 0xFFFFFFFF for x in cut), dtype=np.uint64, count=len(cut))


def _array(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _pairs(part: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair that was sent: whether it occurs again, whether it stands for its pair, its key's number of pairs; and where rows end."""
    key, extra, again = _array(part["key"], np.uint64), _array(part["extra"], kind).astype(np.uint64), _array(part["again"], bool)
    order = np.lexsort((extra, key))
    k, e, twice = key[order], extra[order], again[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new_pair = new_key | np.r_[True, e[1:] != e[:-1]]
    group, kin = np.cumsum(new_pair) - 1, np.cumsum(new_key) - 1
    out = [np.empty(len(key), dtype=t) for t in (bool, bool, np.int64)]
    for to, value in zip(out, (((np.bincount(group) > 1) | (np.bincount(group, weights=twice) > 0))[group], new_pair, np.bincount(kin, weights=new_pair).astype(np.int64)[kin])):
        to[order] = value
    return *out, np.cumsum([len(x) // 8 for x in part["key"].to_pylist()])


def _answers(part: pa.Table, flags: list[bytes]) -> pa.Table:
    return pa.table({"block": part["block"], "part": part["part"], "flags": pa.array(flags, pa.binary())}, schema=_told)


def answer_pairs(hot: int):
    """For one part of the dictionary, a byte for every pair: 1 if the phrase occurs again, 2 if it is to be sent (the first of its pair, where
    the trigger has several), 4 if the trigger has more than `hot`, and above these bits the trigger's bucket of 32."""

    def run(part: pa.Table) -> pa.Table:
        again, new, many, ends = _pairs(part, np.uint64)
        bucket = (mix64(_array(part["key"], np.uint64)) & np.uint64(31)).astype(np.uint8)
        flags = (again * 1 + (new & (many > 1)) * 2 + (many > hot) * 4).astype(np.uint8) | bucket << 3
        return _answers(part, [flags[a:b].tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends)])

    return run


def answer_hashes(part: pa.Table) -> pa.Table:
    """A byte for every window that was sent as hashes: 1 if it occurs again."""
    again, _, _, ends = _pairs(part, "u4")
    return _answers(part, [again[a:b].astype(np.uint8).tobytes() for a, b in zip(np.r_[0, ends[:-1]], ends)])


def ranks(text: np.ndarray, width: int) -> np.ndarray:
    """The rank of every position of text among all by its next `width` bytes (zeros past the end): a suffix array up to that depth, by
    prefix doubling. Equal ranks are equal bytes."""
    n, size = len(text), min(8, width)
    padded = np.r_[text, np.zeros(width + size, dtype=np.uint8)]
    word = np.zeros(n + width, dtype=np.uint64)
    for k in range(size):
        word = (word << np.uint64(8)) | padded[k : k + n + width]
    rank = np.unique(word, return_inverse=True)[1].astype(np.uint64)
    while size < width:
        step = min(size, width - size)
        far = np.r_[rank[step:], np.full(step, rank[-1], dtype=np.uint64)]
        rank = np.unique((rank << np.uint64(32)) | far, return_inverse=True)[1].astype(np.uint64)
        size += step
    return rank[:n]


def repeats(phrases: list[bytes], width: int) -> np.ndarray:
    """Whether each window of the phrases, in order, equals another."""
    text = np.frombuffer(b"".join(phrases), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in phrases])
    sizes = np.array([len(p) - width + 1 for p in phrases])
    start = np.repeat(ends - sizes - width + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    own = ranks(text, width)[start]
    return (np.bincount(own.astype(np.int64)) > 1)[own.astype(np.int64)]


def answer_texts(width: int, chunk: int):
    """For the phrases that were sent to one part: a byte for every window, 1 if it equals another."""

    def run(part: pa.Table) -> pa.Table:
        key, sizes, texts_ = _array(part["key"], np.uint8), _array(part["sizes"], np.int32).astype(np.int64), b"".join(part["texts"].to_pylist())
        to = np.cumsum(sizes)
        order = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        past = np.r_[0, np.cumsum(sizes[order])]
        flags: list = [b""] * len(key)
        at = 0
        while at < len(new):  # as many buckets at once as a chunk holds, one at least
            end = max(at + 1, int(np.searchsorted(past[new], past[new[at]] + chunk)))
            some = order[new[at] : new[end] if end < len(new) else len(order)].tolist()
            found, begin = repeats([texts_[to[i] - sizes[i] : to[i]] for i in some], width).astype(np.uint8), 0
            for i in some:
                n = int(sizes[i]) - width + 1
                flags[i] = found[begin : begin + n].tobytes()
                begin += n
            at = end
        ends = np.cumsum([len(x) for x in part["key"].to_pylist()])
        return _answers(part, [b"".join(flags[a:b]) for a, b in zip(np.r_[0, ends[:-1]], ends)])

    return run


def spans(size: int, first: np.ndarray, past: np.ndarray, starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal removed runs [from, to) for whole runs [first, past) and single window starts."""
    if not size:
        return []
    depth = np.zeros(size + 1, dtype=np.int32)
    np.add.at(depth, first, 1)
    np.add.at(depth, past, -1)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + width, -1)
    change = np.flatnonzero(np.diff(np.r_[0, np.cumsum(depth)[:-1] > 0, 0]))
    return list(zip(change[::2].tolist(), change[1::2].tolist()))


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200, emit: str = "digest", gram: int = GRAM, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """Every byte under a `width`-byte string that also starts elsewhere is removed.

    emit="digest": id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans. emit="documents": the rows of
    docs, all columns, with what is left as text (characters that a cut breaks go) and null texts kept null.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    store, gram = Store(spark, "repeats"), min(gram, width)
    rows = docs.select(id_col, text_col) if emit == "digest" else docs
    parts = max(partitions(spark), (rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // part_bytes)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, text_col, block_bytes):
            yield _rows(_asked, _parsed(batch, text_col, width, gram, parts))
        trim()

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        for block, data, parse in zip(*(left[c].to_pylist() for c in ("block", "data", "parse"))):
            held, raw = Block(parse, width), texts(unpack(data)[text_col])
            held.learn(right["part"].to_pylist(), right["flags"].to_pylist())
            cuts = np.flatnonzero(np.diff(held.dealt[held.whole], prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                some = held.whole[a:b]
                found = held.text_of(raw, some)
                out.append({"block": block, "part": int(held.dealt[some[0]]), "key": held.bucket[some].tobytes(), "sizes": np.array([len(x) for x in found], dtype=np.int32).tobytes(), "texts": b"".join(found)})
            if len(held.single):
                key, extra, again, dealt, _ = _distinct(*held.hashes(raw), parts)
                out += [{"block": block, "part": p, "key": key[a:b].tobytes(), "extra": extra[a:b].astype(np.uint32).tobytes(), "again": again[a:b].tobytes()} for p, a, b in dealt]
        return pa.Table.from_batches([_rows(_sent, out)])

    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string(DIGEST).fields]) if emit == "digest" else docs.schema
    target = to_arrow_schema(schema)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out, level = [], np.array(right["level"].to_pylist(), dtype=np.int64)
        told = [dict(zip(*(right.filter(pa.array(level == k))[c].to_pylist() for c in ("part", "flags")))) for k in range(3)]
        for data, parse in zip(left["data"].to_pylist(), left["parse"].to_pylist()):
            table, held = unpack(data), Block(parse, width)
            raw = texts(table[text_col])
            held.learn(list(told[0]), list(told[0].values()))
            doc, start = held.windows(held.whole)
            hit = np.concatenate([np.frombuffer(told[1][p], dtype=np.uint8) for p in dict.fromkeys(held.dealt[held.whole].tolist())] or [np.zeros(0, dtype=np.uint8)]) > 0
            if len(held.single):
                key, extra = held.hashes(raw)
                _, _, _, dealt, place = _distinct(key, extra, parts)
                also = np.concatenate([np.frombuffer(told[2][p], dtype=np.uint8) for p, _, _ in dealt])[place] > 0
                doc_, start_ = held.windows(held.single)
                doc, start, hit = np.r_[doc, doc_], np.r_[start, start_], np.r_[hit, also]
            doc, start = doc[hit], start[hit]
            order = np.argsort(doc, kind="stable")
            doc, start = doc[order], start[order]
            at = np.searchsorted(doc, np.arange(len(raw) + 1))
            found = []
            for i, x in enumerate(raw):
                own = slice(held.past[i], held.past[i + 1])
                gone = held.again[own]
                found.append(spans(len(x), held.first[own][gone], (held.first[own] + held.sizes[own])[gone] + width - 1, start[at[i] : at[i + 1]], width))
            kept = [b"".join(x[a:b] for a, b in zip([0, *(e for _, e in s)], [*(b for b, _ in s), len(x)])) for x, s in zip(raw, found)]
            if emit == "digest":
                values = [table[id_col], [len(x) for x in raw], [len(x) - len(y) for x, y in zip(raw, kept)], [len(s) for s in found], [hashlib.sha256(y).hexdigest() for y in kept], [[{"begin": a, "end": b} for a, b in s] for s in found]]
            else:
                left_over = [None if x is None else y.decode("utf-8", "ignore") for x, y in zip(table[text_col].to_pylist(), kept)]
                values = [left_over if name == text_col else table[name] for name in target.names]
            out.append(pa.table([v.combine_chunks().cast(f.type) if isinstance(v, pa.ChunkedArray) else pa.array(v, f.type) for v, f in zip(values, target)], schema=target))
        trim()
        return pa.concat_tables(out) if out else target.empty_table()

    asked = store.put(rows.mapInArrow(parse, ASKED), "asked")
    blocks = asked.where("part is null").select("block", "data", "parse")
    told = store.put(asked.where("part is not null").select("block", "part", "key", "extra", "again").groupBy("part").applyInArrow(answer_pairs(hot), TOLD), "told")
    sent = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(send, SENT)
    sent = store.put(sent, "sent")
    by_text = sent.where("texts is not null").select("block", "part", "key", "sizes", "texts").groupBy("part").applyInArrow(answer_texts(width, chunk), TOLD)
    by_hash = sent.where("texts is null").select("block", "part", "key", "extra", "again").groupBy("part").applyInArrow(answer_hashes, TOLD)
    all_ = told.withColumn("level", F.lit(0)).unionByName(by_text.withColumn("level", F.lit(1))).unionByName(by_hash.withColumn("level", F.lit(2)))
    out = blocks.groupBy("block").cogroup(all_.groupBy("block")).applyInArrow(cut, schema)
    return store.only(out) if emit == "digest" else out
