"""Token counts of a SentencePiece model without token ids of documents.

Documents are taken in blocks of about `block_bytes` of text. A block holds each document's pre-token frequencies as pairs (place among
the block's distinct pre-tokens, count) and deals the distinct pre-tokens out to the parts of a dictionary by hash. A part lets the
library encode each distinct pre-token once, whatever number of blocks has it, and answers with the numbers of pieces; joined
to their block they are multiplied by the frequencies and summed. A frequent pre-token is a row a block, not a row a document,
and what moves is a block's distinct pre-tokens and packed pairs, never a row for each (document, pre-token).

The number of parts grows with the bytes of text, so a part stays within memory.

Cases: null and empty texts have 0 tokens; null ids, repeated rows and empty tables pass through; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # makes pa.compute
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, pack, partitions, trim, unpack
from .pieces import default_model, load, model_bytes, pre_tokens

BLOCK_BYTES, PART_BYTES = 8 << 20, 64 << 20
ASKED = "block string, part long, tokens binary, docs binary"


def count_pieces(sp: sentencepiece.SentencePieceProcessor, tokens: list[str]) -> np.ndarray:
    """Pieces of each pre-token."""
    before = len(sp.encode("\n"))  # a line break merges with nothing, so what stands after it begins anew
    out = [len(ids) - before for at in range(0, len(tokens), 4096) for ids in sp.encode(["\n" + t for t in tokens[at : at + 4096]], num_threads=1)]
    return np.array(out, dtype=np.int32)


def _small(values: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers that are mostly below 255 as bytes, the others beside them."""
    return {"low": np.minimum(values, 255).astype(np.uint8), "high": values[values >= 255].astype(np.uint32)}


def _large(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = low.astype(np.int64)
    out[out == 255] = high
    return out


class Block:
    """Documents with their pre-token frequencies."""

    def __init__(self) -> None:
        self.ids, self.bytes, self.code, self.size = [], [], {}, 0
        self.held, self.many = [], []

    def add(self, own, n_bytes: int, text: str | None) -> None:
        found, code = Counter(pre_tokens(text)) if text else {}, self.code
        self.ids.append(own)
        self.bytes.append(n_bytes)
        self.held.append(np.array([code.setdefault(t, len(code)) for t in found], dtype=np.int64))
        self.many.append(np.array(list(found.values()), dtype=np.int64))
        self.size += n_bytes

    def rows(self, parts: int, kind: pa.DataType) -> dict[str, list]:
        """Columns of ASKED: a row with the documents, and one for each part that has pre-tokens of the block."""
        # frequent ones first and each document's in order, so that the gaps between places are small numbers
        order = np.argsort(-np.bincount(np.concatenate(self.held), minlength=len(self.code)), kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        known = list(self.code)
        tokens = [known[i] for i in order.tolist()]
        sort = [np.argsort(place[x]) for x in self.held]
        gaps = _small(np.concatenate([np.diff(place[x][o], prepend=0) for x, o in zip(self.held, sort)]))
        counts = _small(np.concatenate([x[o] for x, o in zip(self.many, sort)]))
        dealt = np.array([xxhash.xxh32_intdigest(t) % parts for t in tokens], dtype=np.int64)
        docs = {"ids": pa.array([self.ids], pa.list_(kind)), "n_bytes": [self.bytes], "sizes": [[len(x) for x in self.held]], "dealt": [dealt.astype(np.uint16 if parts < 1 << 16 else np.int64)]}
        docs |= {f"{name}_{k}": [x] for name, packed in (("gaps", gaps), ("counts", counts)) for k, x in packed.items()}
        name = uuid.uuid4().hex
        out: dict[str, list] = {"block": [name], "part": [None], "tokens": [None], "docs": [pack(docs)]}
        by_part = np.argsort(dealt, kind="stable")
        for group in np.split(by_part, np.flatnonzero(np.diff(dealt[by_part])) + 1) if len(by_part) else []:
            for c, x in zip(out, (name, int(dealt[group[0]]), pack({"tokens": [[tokens[i] for i in group]]}), None)):
                out[c].append(x)
        return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) of each row. model: path of the model file."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model_bytes(model or default_model()))  # half a megabyte, whatever the data
    store, kind = Store(spark, "tokens"), to_arrow_type(docs.schema[id_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    parts = max(partitions(spark), (rows.agg(F.sum("n_bytes")).first()[0] or 0) // part_bytes)
    asked_schema = pa.schema([("block", pa.string()), ("part", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for own, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                block.add(own, n, text)
                if block.size >= block_bytes or len(block.ids) >= 1 << 16:
                    yield pa.RecordBatch.from_pydict(block.rows(parts, kind), schema=asked_schema)
                    block = Block()
        if block.ids:
            yield pa.RecordBatch.from_pydict(block.rows(parts, kind), schema=asked_schema)
        trim()

    told_schema = pa.schema([("block", pa.string()), ("part", pa.int64()), ("pieces", pa.binary())])

    def answer(part: pa.Table) -> pa.Table:
        lists = [unpack(x)["tokens"].combine_chunks() for x in part["tokens"].to_pylist()]
        sizes = [len(x.values) for x in lists]
        coded = pa.chunked_array([x.values.cast(pa.large_string()) for x in lists]).combine_chunks().dictionary_encode()
        found = count_pieces(load(shared.value), coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ends = np.cumsum(sizes)
        return pa.table({"block": part["block"], "part": part["part"], "pieces": [pack({"n": [found[b - n : b]]}) for b, n in zip(ends, sizes)]}, schema=told_schema)

    counted_schema = pa.schema([("id", kind), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for data in left["docs"].to_pylist():
            docs = unpack(data)
            held = {c: docs[c].combine_chunks().values for c in docs.column_names}
            ids, n_bytes = held.pop("ids"), held.pop("n_bytes")
            x = {c: v.to_numpy(zero_copy_only=False) for c, v in held.items()}
            dealt, sizes, gaps, counts = x["dealt"].astype(np.int64), x["sizes"].astype(np.int64), _large(x["gaps_low"], x["gaps_high"]), _large(x["counts_low"], x["counts_high"])
            ends = np.r_[0, np.cumsum(sizes)]
            run = np.cumsum(gaps)  # each document's gaps begin anew
            places = run - np.repeat(np.r_[0, run][ends[:-1]], sizes)
            pieces = np.zeros(len(dealt), dtype=np.int64)
            order = np.argsort(dealt, kind="stable")
            for part, told in zip(right["part"].to_pylist(), right["pieces"].to_pylist()):
                a, b = np.searchsorted(dealt[order], [part, part + 1])
                pieces[order[a:b]] = unpack(told)["n"].combine_chunks().values.to_numpy()
            each = np.r_[0, np.cumsum(pieces[places] * counts)]
            out.append(pa.table([ids, n_bytes.cast(pa.int64()), pa.array(each[ends[1:]] - each[ends[:-1]])], schema=counted_schema))
        trim()
        return pa.concat_tables(out) if out else counted_schema.empty_table()

    asked = store.put(rows.mapInArrow(ask, ASKED), "asked")
    told = asked.where("part is not null").select("block", "part", "tokens").groupBy("part").applyInArrow(answer, "block string, part long, pieces binary")
    blocks = asked.where("part is null").select("block", "docs")
    name = docs.schema[id_col].dataType.simpleString()
    found = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(total, f"id {name}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
