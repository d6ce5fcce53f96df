"""Near duplicates by 64-bit SimHash with pigeonring filtering.

Fingerprints: words are runs of bytes other than space and \\t\\n\\v\\f\\r after lower-casing A-Z; every `shingle` words in a
row (repeats included; a shorter text is one shingle) are joined by a space and hashed by XXH64, seed 42; a bit is 1 if it is set
in over half the hashes. A text without words has fingerprint zero.

Pairs at `bits` = 3 or fewer differing bits: the four 16-bit segments form a ring. By the pigeonring principle some
segment starts a chain whose first l segments differ in at most floor(3 l / 4) bits for l = 1..4, that is 0, 1, 2 and 3. The
first two budgets are an equality join: every fingerprint is filed under (start, two segments) and asks for its own two
segments and for each with one more 0 bit set, so the partner whose bit is set is found once. The third and
fourth budgets are checked on the pairs met, the fourth being the full Hamming distance. Work is 4 + about 36 rows a distinct
fingerprint and the pairs that pass two budgets; copies share one fingerprint, so groups of copies of any size make no pairs.

The pipeline's stage keeps one document of each component (`one_of_each_linked`). `similar_documents` and `one_of_each` link by the Jaccard
similarity of word shingles instead, by a prefix filter and without fingerprints; no query uses them.

Cases: null and empty texts have fingerprint zero; null ids take the smallest id of their component and never give it;
repeated rows stay repeated; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, mix64, texts, trim
from .components import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_RUN = 1 << 16
SMALL = 16
SAMPLE, OFTEN = 8, 10_000
SEEN = 1_000_000
STARS = 1


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """As a signed 64-bit integer."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), _RUN):
        hashes = np.array([digest(x, 42) for x in shingles[at : at + _RUN]], dtype=">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(shingles)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: str | None = None) -> DataFrame:
    """(id, fp long) of each row; before fp the long column `keep`, if given."""
    kept = [keep] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(x, shingle) for x in texts(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], fps], names=[id_col, *kept, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col, *kept).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"`{c}` long" for c in kept), "fp long"]))


def close_pairs(fps: DataFrame) -> DataFrame:
    """(a, b) of distinct values fp (long) that differ in 1 to 3 bits, each pair once."""
    ring = "transform(sequence(0, 3), i -> struct(i as i, (shiftrightunsigned(fp, 16 * i) | IF(i = 0, 0L, shiftleft(fp, 64 - 16 * i))) & 4294967295L as k))"
    cell = "shiftleft(cast(s.i as bigint), 32) | s.k"
    filed = fps.selectExpr("fp as b", f"explode(transform({ring}, s -> {cell})) as cell")
    asked = fps.selectExpr("fp as a", f"explode(flatten(transform({ring}, s -> transform(filter(sequence(15, 31), j -> j = 15 OR (s.k & shiftleft(1L, j)) = 0), j -> ({cell}) | IF(j = 15, 0L, shiftleft(1L, j)))))) as cell")
    start = "cast(shiftrightunsigned(cell, 32) as int)"
    turned = f"shiftrightunsigned(a ^ b, 16 * {start}) | IF({start} = 0, 0L, shiftleft(a ^ b, 64 - 16 * {start}))"
    met = asked.join(filed, "cell").where("a <> b").where(f"bit_count(({turned}) & 281474976710655L) <= 2").where("bit_count(a ^ b) <= 3")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id: the smallest id reachable over links of 3 or fewer bits."""
    store = Store(docs.sparkSession, "simhash")
    marked = store.put(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = store.put(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    links = store.put(close_pairs(classes.select("fp")), "links")
    return store.only(_named(marked, "fp", classes, links, store).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def one_of_each_linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """docs without near duplicates: of each component over links of 3 or fewer bits the row with the smallest id stays.

    Of rows that share that id the one with the smallest text hash stays, and one of equal ones. Rows without an id come last, so one of
    them stays only where no row of the component has an id. Texts are read twice and dealt once; between, a row is two hashes and its id.
    """
    store, linked = Store(docs.sparkSession, "kept"), Store(docs.sparkSession, "linked")
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    marked = linked.put(fingerprints(read, "id", "text", shingle, "th"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("without"), "id", "th")).alias("first")
    classes = linked.put(marked.groupBy("fp").agg(first), "classes")
    links = linked.put(close_pairs(classes.select("fp")), "links")
    roots = components(links, linked).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").select("first.*", F.coalesce("root", "fp").alias("root"))
    kept = store.put(rooted.groupBy("root").agg(first).select("first.id", "first.th"), "kept")
    same = marked.groupBy("id", "th").count().where("count > 1").alias("m")
    repeated = not same.join(kept.alias("k"), F.col("m.id").eqNullSafe(F.col("k.id")) & (F.col("m.th") == F.col("k.th")), "left_semi").isEmpty()
    linked.clear()
    # the same join at every size: what is kept grows with the documents
    key = F.col(f"d.{id_col}").eqNullSafe(F.col("k.id")) & (F.xxhash64(F.col(f"d.{text_col}")) == F.col("k.th"))
    out = docs.alias("d").join(kept.hint("merge").alias("k"), key, "left_semi")
    return out.dropDuplicates([id_col, text_col]) if repeated else out


def _hashes(text: bytes, shingle: int) -> tuple[int, np.ndarray]:
    """A 64-bit hash of the sequence of words (0: no words) and the sorted distinct hashes of the shingles, a shorter text being one."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0, np.zeros(1, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    whole = digest(b" ".join(words), 42)
    n = len(words) - shingle + 1
    if n < 1:
        return whole, np.array([whole], dtype=np.uint64)
    one, out = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words)), np.zeros(n, dtype=np.uint64)
    for i in range(shingle):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + one[i : i + n])
    return whole, np.unique(out)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _common(docs: DataFrame, shingle: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in many documents of a sample, sorted, and in how many. Only the order of the index depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hashes(x, shingle)[1] for x in texts(batch.column(0))]
            h, n = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([*h.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), len(found)], pa.int64())], names=["h", "n"])
        trim()

    rows = docs.where(f"pmod(xxhash64(text), {SAMPLE}) = 0").select("text").mapInArrow(run, "h long, n long")
    counts = store.put(rows.groupBy("h").agg(F.sum("n").alias("n")).where("n >= 4 or h is null"), "common")
    size = counts.where("h is null").first()
    found = counts.where(F.col("h").isNotNull() & (F.col("n") * OFTEN >= (size.n if size else 0))).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _within(sizes: np.ndarray, places: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether pairs whose first shared shingle is this one can be similar enough, by their sizes and what follows it."""
    rest = np.minimum(sizes[i] - places[i], sizes[j] - places[j])
    return rest >= (sizes[i] + sizes[j]) * (similarity / (1 + similarity)) - 1e-6


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """id and component_id of each row, linking texts whose distinct word shingles have a Jaccard similarity of `similarity` or more.

    Candidates come from a prefix filter: shingles are ordered, those of many documents last, and a text of n shingles is filed
    under its first n - ceil(similarity * n) + 1. Texts that are similar enough share one of these cells, whatever the order
    is; sizes, how many cells they share and the places of a shared shingle leave out more pairs, none of which can be similar enough.
    Every candidate's similarity is then computed from the two sets of 64-bit shingle hashes.

    In cells of up to SMALL texts all pairs are candidates. In a larger one each text is compared with one, the centre: the text that
    is in most large cells, so that of a group of near copies it is the one with the fewest changes. STARS times the texts that are not
    in one component are compared with a further centre; after that those outside a cell's largest component with all of the cell that
    they aren't joined to. So a group of thousands of near copies gives about as many candidates as it has texts, not pairs, and
    no pair is lost: two texts are compared or in one component already.
    """
    store = Store(docs.sparkSession, "similar")
    return store.only(_similar(docs, id_col, text_col, shingle, similarity, store).select(F.col("id").alias(id_col), "component_id"))


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, store: Store) -> DataFrame:
    """id, th (the text's hash), root (a node of the component) and component_id of each row; the tables on the way are in store."""
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
    shared = docs.sparkSession.sparkContext.broadcast(_common(read, shingle, store))  # at most OFTEN times the shingles of a document

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = shared.value
        seen: set[int] = set()
        for batch in batches:
            sigs, sizes, cells = [], [], []
            for text in texts(batch.column(1)):
                whole, hashes = _hashes(text, shingle)
                n = len(hashes)
                sigs.append(_signed(whole))
                sizes.append(n)
                if whole in seen:  # copies are filed once a task
                    cells.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(whole)
                count = n - math.ceil(similarity * n - 1e-9) + 1
                if len(common):
                    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                    hashes = hashes[np.argsort(np.where(common[at] == hashes, often[at], 0), kind="stable")]
                cells.append(hashes[:count].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(cells, pa.list_(pa.int64()))], names=["id", "th", "sig", "n", "cells"])
        trim()

    marked = store.put(read.mapInArrow(filed, f"id {kind}, th long, sig long, n int, cells array<long>"), "signatures")
    classes = store.put(marked.groupBy("sig").agg(F.min("id").alias("least")), "classes")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b) of small cells, their sizes and how many cells they share; of large ones each text a, its cell, size and place."""
        columns = [[b.column(c).to_numpy() for c in range(4)] for b in batches]
        if not columns:
            return
        cell, sig, n, place = (np.concatenate(c) for c in zip(*columns))
        del columns
        order = np.lexsort((sig, cell))
        cell, sig, n, place = cell[order], sig[order], n[order], place[order]
        new = np.r_[True, (cell[1:] != cell[:-1]) | (sig[1:] != sig[:-1])]  # copies filed by several tasks
        cell, sig, n, place = cell[new], sig[new], n[new], place[new]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sizes = np.diff(np.r_[first, len(cell)])
        pairs = [np.zeros((4, 0), dtype=np.int64)]
        for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
            begin = first[sizes == size]
            for a in range(size):
                for b in range(a + 1, size):
                    i, j = begin + a, begin + b
                    ok = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-6
                    pairs.append(np.stack([sig[i[ok]], sig[j[ok]], n[i[ok]], n[j[ok]]]))
        a, b, n_a, n_b = np.concatenate(pairs, axis=1)
        order = np.lexsort((b, a))
        a, b, n_a, n_b = a[order], b[order], n_a[order], n_b[order]
        begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
        shares = np.diff(np.r_[begin, len(a)])
        a, b, n_a, n_b = a[begin], b[begin], n_a[begin], n_b[begin]
        large = np.repeat(sizes > SMALL, sizes)
        none, void = pa.nulls(len(a), pa.int64()), pa.nulls(int(large.sum()), pa.int64())
        for c in ((pa.array(a), pa.array(b), none, pa.array(n_a, pa.int64()), none, pa.array(n_b, pa.int64()), pa.array(shares, pa.int64())), (pa.array(sig[large]), void, pa.array(cell[large]), pa.array(n[large], pa.int64()), pa.array(place[large], pa.int64()), void, void)):
            yield from pa.table(list(c), names=["a", "b", "cell", "n", "place", "n_b", "shares"]).to_batches(max_chunksize=100_000)
        trim()

    index = marked.where("cells is not null").selectExpr("sig", "n", "posexplode(cells) as (place, cell)").select("cell", "sig", "n", "place")
    met = store.put(index.repartition("cell").mapInArrow(meet, "a long, b long, cell long, n long, place long, n_b long, shares long"), "met")
    # shared shingles are in both prefixes, or among those that follow one text's; how many of a large cell's are shared isn't known
    in_large = met.where("cell is not null").groupBy("a").agg(F.count("*").alias("m"))
    small = met.where("cell is null").groupBy("a", "b").agg(F.first("n").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("shares").alias("k"))
    small = small.join(in_large, "a", "left").join(in_large.select(F.col("a").alias("b"), F.col("m").alias("m_b")), "b", "left")
    most = f"k + least(coalesce(m, 0), coalesce(m_b, 0)) + ceil({similarity}D * greatest(n_a, n_b) - 1e-9D) - 1"
    small = small.where(f"{most} >= (n_a + n_b) * {similarity / (1 + similarity)}D - 1e-6D").select("a", "b")
    large = met.where("cell is not null").select("cell", F.col("a").alias("sig"), "n", "place")
    weight = store.put(large.groupBy("sig").agg(F.count("*").alias("weight")), "weight")
    near = f"least(n - n_place, m - m_place) >= (n + m) * {similarity / (1 + similarity)}D - 1e-6D"

    def starred(rows: DataFrame, apart: str = "true") -> DataFrame:
        """Each row of a cell with the cell's centre, if they can be similar."""
        heads = rows.join(weight.hint("merge"), "sig").groupBy("cell").agg(F.max_by(F.struct(*(F.col(c) for c in rows.columns if c != "cell")), F.struct("weight", "sig")).alias("head"))
        met_head = rows.join(heads.hint("merge"), "cell").where("sig <> head.sig").where(apart).withColumns({"m": F.col("head.n"), "n_place": F.col("place"), "m_place": F.col("head.place")})
        return met_head.where(near).select(F.least("sig", "head.sig").alias("a"), F.greatest("sig", "head.sig").alias("b")).distinct()

    # every text of a large cell may yet be asked for
    star = store.put(small.unionByName(starred(large)).distinct(), "pairs")
    asked_for = star.select(F.explode(F.array("a", "b")).alias("sig")).unionByName(weight.select("sig"))
    wanted = asked_for.distinct()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for text in texts(batch.column(0)):
                words = _WORD.findall(text.translate(_LOWER))
                whole = xxhash.xxh64_intdigest(b" ".join(words), 42) if words else 0
                if whole not in seen:
                    out.append((_signed(whole), text))
                    if len(seen) < SEEN:
                        seen.add(whole)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([t for _, t in out], pa.binary())], names=["sig", "text"])
        trim()

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            sigs = batch.column(0).to_pylist()
            new = [s != t for s, t in zip(sigs, [last, *sigs])]  # the merge join leaves copies side by side
            last = sigs[-1] if sigs else last
            batch = batch.filter(pa.array(new, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_hashes(x, shingle)[1].tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["sig", "hashes"])
        trim()

    found = read.select("text").mapInArrow(keyed, "sig long, text binary").join(wanted.hint("merge"), "sig", "left_semi")
    sets = store.put(found.mapInArrow(whole_sets, "sig long, hashes binary"), "sets")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both = len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True))
                ok.append(both >= similarity * ((len(x) + len(y)) // 8 - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        trim()

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) whose sets are similar."""
        left, right = sets.select(F.col("sig").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("sig").alias("b"), F.col("hashes").alias("y"))
        return store.put(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(checked, "a long, b long"), name)

    links = similar(star, "links")
    rows = large
    for turn in range(STARS + 1):
        roots = store.put(components(links, store).select(F.col("node").alias("sig"), "root"), f"roots{turn}")
        rooted = rows.drop("root").join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        mixed = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell")
        rows = store.put(rooted.join(mixed.hint("merge"), "cell", "left_semi").select("cell", "sig", "n", "place", "root"), f"mixed{turn}")
        if rows.isEmpty():
            break
        if turn < STARS:
            # a centre has been compared with all of its cell: the next is another
            old = rows.join(weight.hint("merge"), "sig").groupBy("cell").agg(F.max_by("sig", F.struct("weight", "sig")).alias("sig"))
            rows = store.put(rows.join(old.hint("merge"), ["cell", "sig"], "left_anti").select(*rows.columns), f"left{turn}")
            rest = starred(rows, "root <> head.root")
        else:
            major = rows.groupBy("cell", "root").count().groupBy("cell").agg(F.max_by("root", F.struct("count", "root")).alias("major"))
            named = store.put(rows.join(major.hint("merge"), "cell"), "named")
            one, two = (named.select("cell", *(F.col(c).alias(f"{c}_{k}") for c in ("sig", "n", "place", "root", "major"))) for k in "ab")
            both = one.where("root_a <> major_a").join(two.hint("merge"), "cell").where("root_a <> root_b and (root_b = major_b or sig_a < sig_b)").selectExpr("least(sig_a, sig_b) as a", "greatest(sig_a, sig_b) as b", "n_a as n", "n_b as m", "place_a as n_place", "place_b as m_place")
            rest = both.where(near).select("a", "b").distinct()
        links = store.put(links.unionByName(similar(store.put(rest, f"rest{turn}"), f"others{turn}")).distinct(), f"all{turn}")
    return _named(marked.select("id", "th", "sig"), "sig", classes, links, store)


def _named(marked: DataFrame, node: str, classes: DataFrame, links: DataFrame, store: Store) -> DataFrame:
    """marked with root and component_id, the smallest id of the classes that links join."""
    roots = components(links, store).select(F.col("node").alias(node), "root")
    linked = classes.select(node, "least").join(roots, node, "left").select(node, "least", F.coalesce("root", node).alias("root"))
    joined = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = store.put(linked.join(joined, "root").select(node, "root", "component_id"), "named")
    return marked.join(named, node)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near duplicates: of each component the row with the smallest id stays, one row if that id is repeated.

    Rows without an id can't stand for a component: only where no row of the component has an id one of them stays, that with the
    smallest text hash.
    """
    store = Store(docs.sparkSession, "kept")
    similar = Store(docs.sparkSession, "similar")
    found = store.put(_similar(docs, id_col, text_col, shingle, similarity, similar), "found")
    similar.clear()
    kept = store.put(found.where("id = component_id").groupBy(F.col("id").alias(id_col)).agg(F.count("*").alias("copies")), "ids")
    repeated = kept.where("copies > 1").limit(1).count()
    # the same join at every size: what is kept grows with the documents
    out = docs.alias("d").join(kept.hint("merge").alias("k"), F.col(f"d.{id_col}") == F.col(f"k.{id_col}"), "left_semi")
    if repeated:
        out = out.dropDuplicates([id_col])
    alone = found.where("component_id is null").groupBy("root").agg(F.min("th").alias("th")).select("th").alias("k")
    without = docs.where(F.col(id_col).isNull()).alias("d").join(alone, F.xxhash64(F.col(f"d.{text_col}")) == F.col("k.th"), "left_semi")
    return out.unionByName(without.dropDuplicates([text_col]))
