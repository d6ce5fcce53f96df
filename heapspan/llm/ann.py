"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy search on it.

Equal vectors form one class, which stands in the graph once; so a vector that many rows share costs no more than
any other. Class vectors are quantised to 16 bits a component for building and searching; scores are computed at the end, in double precision, on the
original vectors, of all visited classes that the quantisation error leaves a chance to be among the k nearest.

Graph: every class starts with its nearest in the cells of `trees` random hyperplane partitions, cells of about `leaf`
classes (larger ones are split by a hash). A round of NN-descent joins each class's neighbours, forward and reverse,
to their vectors (8 bits a component) and compares them with one another: neighbours of neighbours that beat a class's worst neighbour
are proposed to it. Two that a round has compared at a centre are not compared there again. Rounds go on until one changes less than `settle`
of all neighbours. The reverse neighbours of a hub are dealt into groups of at most `crowd` instead of being cut.

Search: a query starts from its own neighbours; a hop joins its `beam` best classes not yet expanded to their adjacency. What is found is
asked for where its vectors are: the query's vector goes once to each part of the table that holds some of it, and only scores
come back. It ends when every query has expanded all of its `beam` best. The beam grows with the fourth root of the
number of classes beyond BASE. A query's state is one row of about `beam` classes; each hop is a table in the shared folder.

Cost grows as n * (trees + rounds * neighbours): no step looks at all pairs. The tests demand a recall of 0.9 of 64 independent
dimensions, the hardest case; the README has what was measured at larger sizes.

Cases: vectors that are null, empty, zero or hold null or non-finite components, of another size than most, or without an id
take no part; repeated rows are candidates of each other; with fewer than k candidates all are returned; empty tables give
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # makes pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, mix64, partitions

BASE, PART = 50_000, 32_768
LISTS = "node long, nbrs array<long>, sims array<float>"
STATE = "q long, qv binary, ids array<long>, sims array<float>, done array<boolean>"
ASKED = "part long, q long, qv binary, ids array<long>"


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind=np.int16) -> np.ndarray:
    """Unit vectors from their bytes."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, dim).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _ragged(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, kind))


def _lists(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray) -> pa.Table:
    """Rows sorted by node as lists."""
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[first, len(node)])
    return pa.table({"node": pa.array(node[first], pa.int64()), "nbrs": _ragged(nbr, sizes, pa.int64()), "sims": _ragged(sim, sizes, pa.float32())})


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    sizes = pa.compute.list_value_length(table["nbrs"]).to_numpy()
    return np.repeat(table["node"].to_numpy(), sizes), pa.compute.list_flatten(table["nbrs"]).to_numpy(), pa.compute.list_flatten(table["sims"]).to_numpy()


def best(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar distinct neighbours of each node, most similar first."""
    order = np.lexsort((nbr, node))
    node, nbr, sim = node[order], nbr[order], sim[order]
    new = np.ones(len(node), dtype=bool)
    new[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])
    node, nbr, sim = node[new], nbr[new], sim[new]
    order = np.lexsort((nbr, -sim, node))
    node, nbr, sim = node[order], nbr[order], sim[order]
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else np.zeros(0, dtype=np.int64)
    keep = np.arange(len(node)) - np.repeat(first, np.diff(np.r_[first, len(node)])) < k
    return node[keep], nbr[keep], sim[keep]


def leaders(ids: np.ndarray, sims: np.ndarray, k: int, least: int, slack: float) -> np.ndarray:
    """All that can be among the k best if angles are wrong by half of slack each; the `least` best at least."""
    order = np.lexsort((ids, -sims))
    if len(order) <= least:
        return ids[order]
    angle = np.arccos(np.clip(sims[order].astype(np.float64), -1, 1))
    # 0.001: what float32 loses near a cosine of 1
    return ids[order[: max(least, int(np.searchsorted(angle, angle[k - 1] + slack + 0.001, side="right")))]]


def proposals(table: pa.Table, dim: int, propose: int, neighbours: int) -> pa.Table:
    """Neighbours of one centre with one another: for each its `propose` most similar that beat its worst neighbour, of those it hasn't
    met at this centre before. Two that met were proposed to each other then if they were near enough."""
    table = table.combine_chunks()
    order = np.lexsort((table["member"].to_numpy(), table["salt"].to_numpy(), table["centre"].to_numpy()))
    table = table.take(pa.array(order))
    centre, salt, member, worst = (table[c].to_numpy() for c in ("centre", "salt", "member", "worst"))
    fresh = table["fresh"].to_numpy()
    x = _matrix(table["b"], dim, np.int8)
    cuts = np.flatnonzero(np.r_[True, (centre[1:] != centre[:-1]) | (salt[1:] != salt[:-1]), True])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        count, new = min(propose, b - a - 1), fresh[a:b]
        if count > 0 and new.any():
            sims = x[a:b] @ x[a:b].T
            np.fill_diagonal(sims, -2)
            sims[np.ix_(~new, ~new)] = -2
            near = np.argpartition(-sims, count - 1, axis=1)[:, :count]
            found = np.take_along_axis(sims, near, 1)
            r, c = np.nonzero(found > worst[a:b, None])
            out.append((member[a:b][r], member[a:b][near[r, c]], found[r, c]))
    if not out:
        return _lists(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float32)))
    return _lists(*best(*(np.concatenate(c) for c in zip(*out)), neighbours))


def classes(vectors: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """vid (smallest id), vec, ids (the k + 1 smallest) and n of each distinct usable vector."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null and vec is not null")
    usable = rows.where("size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vec, x -> x <> 0)")
    usual = usable.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    usable = usable.where(F.size("vec") == (usual.dim if usual else 0)).withColumn("h", F.xxhash64("vec"))
    # ids of a hot vector are dealt out before they are gathered, and cut in each part
    some = usable.groupBy("h", F.pmod(F.xxhash64("id"), F.lit(4096)).alias("part")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"), F.first("vec").alias("vec"), F.count("*").alias("n"))
    return some.groupBy("h").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"), F.first("vec").alias("vec"), F.sum("n").alias("n")).select(F.col("ids")[0].alias("vid"), "vec", "ids", "n")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50, neighbours: int = 24, trees: int = 6, leaf: int = 2048, settle: float = 0.1, propose: int = 6, beam: int = 160, crowd: int = 512, rerank: int = 40) -> DataFrame:
    """query_id, rank, id and score (cosine) of the k nearest rows of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    store, parts = Store(spark, "ann"), partitions(spark)
    own = store.put(classes(vectors, id_col, vec_col, k), "classes")
    n, dim = own.agg(F.count("*"), F.max(F.size("vec"))).first()
    beam, wide_v = max(beam, int(beam * (n / BASE) ** 0.25)), max(parts, n // PART)
    dim, bits = dim or 1, max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
    planes = np.random.default_rng(20).standard_normal((dim, trees * bits)).astype(np.float32)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.compute.list_flatten(batch.column(1)).to_numpy().astype(np.float64).reshape(-1, dim)
            exact = x / np.abs(x).max(axis=1, keepdims=True) * 32767
            x = np.rint(exact).astype(np.int16)
            off = np.arcsin(np.minimum(1, np.linalg.norm(exact - x, axis=1) / np.linalg.norm(exact, axis=1)))  # the angle between them, or more
            side = (x.astype(np.float32) @ planes > 0).reshape(len(x), trees, bits)
            cells = (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
            small = np.rint(exact / 32767 * 127).astype(np.int8)
            part = (mix64(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(wide_v)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in small], pa.binary()), pa.array(part), _ragged(cells.ravel(), np.full(len(x), trees), pa.int64()), pa.array(off)], names=["vid", "v", "b", "part", "cells", "off"])

    v = store.put(own.select("vid", "vec").mapInArrow(quantise, "vid long, v binary, b binary, part long, cells array<long>, off double"), "vectors")
    off = v.agg(F.max("off")).first()[0] or 0.0

    def block(table: pa.Table) -> pa.Table:
        ids, x = table["vid"].to_numpy(), _matrix(table["b"], dim, np.int8)
        count = min(neighbours, len(ids) - 1)
        if count < 1:
            return _lists(*(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float32)))
        out = []
        for at in range(0, len(ids), 1024):
            sims = x[at : at + 1024] @ x.T
            sims[np.arange(len(sims)), at + np.arange(len(sims))] = -2
            near = np.argpartition(-sims, count - 1, axis=1)[:, :count]
            out.append((np.repeat(ids[at : at + 1024], count), ids[near].ravel(), np.take_along_axis(sims, near, 1).ravel()))
        return _lists(*(np.concatenate(c) for c in zip(*out)))

    def merge(table: pa.Table) -> pa.Table:
        old = table.filter(table["old"])
        node, nbr, _ = _flat(old)
        mine, theirs, sim = best(*_flat(table), neighbours)
        # of each neighbour whether it is new
        code = lambda a, b: mix64(a.view(np.uint64)) ^ b.view(np.uint64)
        out = _lists(mine, theirs, sim)
        return out.append_column("fresh", _ragged(~np.isin(code(mine, theirs), code(node, nbr)), pa.compute.list_value_length(out["nbrs"]).to_numpy(), pa.bool_()))

    def merged(lists: DataFrame, name: str) -> DataFrame:
        wide = max(parts, n // 4096)
        return store.put(lists.groupBy(F.pmod(F.xxhash64("node"), F.lit(wide))).applyInArrow(merge, f"{LISTS}, fresh array<boolean>"), name)

    cells = v.select("vid", "b", F.posexplode("cells").alias("tree", "cell"))
    crowds = cells.groupBy("tree", "cell").count()
    dealt = cells.join(crowds, ["tree", "cell"]).withColumn("salt", F.expr(f"pmod(xxhash64(vid, tree), cast(ceil(count / {2 * leaf}) as bigint))"))
    graph = merged(dealt.groupBy("tree", "cell", "salt").applyInArrow(block, LISTS).withColumn("old", F.lit(False)), "graph0")

    def compare(table: pa.Table) -> pa.Table:
        return proposals(table, dim, propose, neighbours)

    def around(lists: DataFrame) -> DataFrame:
        """(centre, member) both ways, each once, and whether neither way was there before."""
        out = lists.select(F.col("node").alias("centre"), F.explode(F.arrays_zip("nbrs", "fresh")).alias("x")).select("centre", F.col("x.nbrs").alias("member"), "x.fresh")
        return out.unionByName(out.select(F.col("member").alias("centre"), F.col("centre").alias("member"), "fresh")).groupBy("centre", "member").agg(F.bool_and("fresh").alias("fresh"))

    def salted(edges: DataFrame) -> DataFrame:
        """Groups of about `crowd`. Where there are several, or may have been, members may meet for the first time: all count as new."""
        counted = edges.join(edges.groupBy("centre").count(), "centre")
        return counted.withColumns({"salt": F.expr(f"pmod(xxhash64(member), cast(ceil(count / {crowd}) as bigint))"), "fresh": F.expr(f"fresh or 2 * count > {crowd}")}).drop("count")

    r, changed = 0, n * neighbours
    while changed > settle * n * neighbours:
        r += 1
        worst = F.when(F.size("sims") < neighbours, F.lit(-2.0)).otherwise(F.array_min("sims")).cast("float")
        known = v.join(graph.select(F.col("node").alias("vid"), worst.alias("worst")), "vid").select(F.col("vid").alias("member"), "b", "worst")
        edges = salted(store.put(around(graph), f"edges{r}")).join(known, "member")
        wide = max(parts, n // 512)
        proposed = edges.groupBy(F.pmod(F.xxhash64("centre", "salt"), F.lit(wide))).applyInArrow(compare, LISTS)
        graph = merged(graph.drop("fresh").withColumn("old", F.lit(True)).unionByName(proposed.withColumn("old", F.lit(False))), f"graph{r}")
        changed = graph.agg(F.sum(F.expr("size(filter(fresh, x -> x))"))).first()[0] or 0
        store.drop(f"edges{r}")
        store.drop(f"graph{r - 1}")

    rows = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.xxhash64(vec_col).alias("h")).where(F.col("query_id") % every == 0)
    hashed = own.select(F.xxhash64("vec").alias("h"), "vid")
    queries = store.put(rows.join(hashed, "h").select("query_id", "vid"), "queries")
    asked = queries.select("vid").distinct()
    edges = salted(around(graph))
    adjacent = store.put(edges.groupBy("centre", "salt").agg(F.collect_list("member").alias("nbrs")).select(F.col("centre").alias("node"), "nbrs"), "adjacent")
    state = asked.join(v.select("vid", "v"), "vid").select(F.col("vid").alias("q"), F.col("v").alias("qv"), F.array("vid").alias("ids"), F.array(F.lit(-2.0).cast("float")).alias("sims"), F.array(F.lit(False)).alias("done"))
    state = store.put(state, "state0")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The classes of each query that are to be expanded: of its `beam` best those that aren't yet. Lists are kept best first."""
        for batch in batches:
            found = [np.array(i, dtype=np.int64)[:beam][~np.array(d, dtype=bool)[:beam]] for i, d in zip(batch.column("ids").to_pylist(), batch.column("done").to_pylist())]
            q = np.repeat(batch.column("q").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate(found) if found else [], pa.int64())], names=["q", "node"])

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        """What each query has to ask of each part of the vectors."""
        answers: dict[int, list[np.ndarray]] = {}
        for q, nbrs in zip(right["q"].to_pylist(), right["nbrs"].to_pylist()):
            answers.setdefault(q, []).append(np.array(nbrs, dtype=np.int64))
        out: dict[str, list] = {c: [] for c in ("part", "q", "qv", "ids")}
        for q, qv, ids in zip(left["q"].to_pylist(), left["qv"].to_pylist(), left["ids"].to_pylist()):
            if q in answers:
                new = np.setdiff1d(np.concatenate(answers[q]), np.array([q, *ids], dtype=np.int64))
                part = (mix64(new.view(np.uint64)) % np.uint64(wide_v)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(new) else []:
                    for c, x in zip(out, (int(part[some[0]]), q, qv, new[some])):
                        out[c].append(x)
        return pa.table({c: pa.array(x, k) for (c, x), k in zip(out.items(), (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))})

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        """Similarities of the classes asked for, in the part that has their vectors."""
        q, qv, ids = left["q"].to_pylist(), left["qv"].to_pylist(), left["ids"].to_pylist()
        if not q:
            return pa.table({"q": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "sims": pa.array([], pa.list_(pa.float32()))})
        vid = right["vid"].to_numpy()
        order = np.argsort(vid)
        x, vid, mine = _matrix(right["v"], dim)[order], vid[order], _matrix(left["qv"], dim)
        sims = [x[np.searchsorted(vid, i)] @ m for i, m in zip(ids, mine)]
        return pa.table({"q": pa.array(q, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())), "sims": pa.array(sims, pa.list_(pa.float32()))})

    def update(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each query's best classes: `beam` of them, and all that the quantisation can't tell from its k-th."""
        got: dict[int, list[tuple]] = {}
        for q, ids, sims in zip(right["q"].to_pylist(), right["ids"].to_pylist(), right["sims"].to_pylist()):
            got.setdefault(q, []).append((ids, sims))
        out: dict[str, list] = {c: [] for c in ("q", "qv", "ids", "sims", "done")}
        for q, qv, ids, sims, done in zip(*(left[c].to_pylist() for c in out)):
            done = np.r_[np.ones(min(beam, len(ids)), dtype=bool), np.array(done, dtype=bool)[beam:]]
            ids, sims = np.array(ids, dtype=np.int64), np.array(sims, dtype=np.float32)
            for i, s in got.get(q, []):
                ids, sims, done = np.r_[ids, np.array(i, dtype=np.int64)], np.r_[sims, np.array(s, dtype=np.float32)], np.r_[done, np.zeros(len(i), dtype=bool)]
            if ids[0] == q and len(ids) > 1:  # a query is no candidate of its own
                ids, sims, done = ids[1:], sims[1:], done[1:]
            order = np.lexsort((ids, -sims))
            order = order[: max(beam, len(leaders(ids, sims, k, rerank, 4 * off)))]
            for c, x in zip(out, (q, qv, ids[order], sims[order], done[order])):
                out[c].append(x)
        kinds = {"q": pa.int64(), "qv": pa.binary(), "ids": pa.list_(pa.int64()), "sims": pa.list_(pa.float32()), "done": pa.list_(pa.bool_())}
        return pa.table({c: pa.array(x, kinds[c]) for c, x in out.items()})

    mine = F.pmod(F.xxhash64("q"), F.lit(max(parts, n // (every * 64))))
    h = 0
    while True:
        led = store.put(state.mapInArrow(lead, "q long, node long"), f"led{h}")
        if led.isEmpty():
            break
        h += 1
        answers = led.join(adjacent, "node").select("q", "nbrs")
        wanted = state.groupBy(mine).cogroup(answers.groupBy(mine)).applyInArrow(ask, ASKED)
        found = wanted.groupBy("part").cogroup(v.select("part", "vid", "v").groupBy("part")).applyInArrow(score, "q long, ids array<long>, sims array<float>")
        state = store.put(state.groupBy(mine).cogroup(found.groupBy(mine)).applyInArrow(update, STATE), f"state{h}")
        store.drop(f"state{h - 1}")
        store.drop(f"led{h - 1}")

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [leaders(np.array(i, dtype=np.int64), np.array(s, dtype=np.float32), k, rerank, 4 * off) for i, s in zip(batch.column("ids").to_pylist(), batch.column("sims").to_pylist())]
            found = [x[x != q] for q, x in zip(batch.column("q").to_pylist(), found)]
            q = np.repeat(batch.column("q").to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate(found) if found else [], pa.int64())], names=["q", "node"])

    dot = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (a, x) -> a + x)"
    near = state.mapInArrow(leading, "q long, node long").unionByName(asked.select(F.col("vid").alias("q"), F.col("vid").alias("node")))
    near = near.join(own.select(F.col("vid").alias("node"), F.col("vec").alias("b"), "ids"), "node").join(own.select(F.col("vid").alias("q"), F.col("vec").alias("a")), "q")
    exact = near.selectExpr("q", "ids", f"{dot.format('a', 'b')} / (sqrt({dot.format('a', 'a')}) * sqrt({dot.format('b', 'b')})) as score")
    # per query class the best k + 1 rows: one of them may be the query's own
    pairs = F.expr("transform(ids, i -> struct(-score as s, i as i))")
    listed = exact.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k + 1).alias("found"))
    # a query id past the first k + 1 of a hot class isn't in the list: nothing is to be left out then
    told = queries.join(listed, queries.vid == listed.q).withColumn("found", F.expr(f"slice(IF(array_position(transform(found, x -> x.i), query_id) > 0, concat(slice(found, 1, cast(array_position(transform(found, x -> x.i), query_id) as int) - 1), slice(found, cast(array_position(transform(found, x -> x.i), query_id) as int) + 1, {k + 1})), found), 1, {k})"))
    return store.only(told.selectExpr("query_id", "posexplode(found) as (rank, x)").selectExpr("query_id", "cast(rank + 1 as int) as rank", f"x.i as `{id_col}`", "-x.s as score"))
