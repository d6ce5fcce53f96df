import numpy as np
import pyarrow as pa
import pytest

from heapspan.llm.ann import nearest, proposals


def brute(ids, x, k, every):
    x = x.astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    out = {}
    for i, q in enumerate(ids):
        if q % every == 0:
            s = x @ x[i] / (norm * norm[i])
            order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[j], 9), ids[j]))[:k]
            out[q] = [(ids[j], s[j]) for j in order]
    return out


def compare(got, want):
    hits = total = 0
    mine = {}
    for r in got:
        mine.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q, rows in want.items():
        found = mine.get(q, {})
        assert sorted(found) == list(range(1, len(rows) + 1))
        assert all(found[i][1] >= found[i + 1][1] - 1e-12 for i in range(1, len(found)))
        hits += len({i for i, _ in rows} & {i for i, _ in found.values()})
        total += len(rows)
    assert set(mine) <= set(want)
    return hits / total


@pytest.mark.parametrize(("n", "dim", "options"), [(1500, 24, {"beam": 64}), (1500, 24, {"beam": 64, "leaf": 150}), (6000, 64, {"leaf": 512})])
def test_recall(spark, n, dim, options):
    x = np.random.default_rng(1).standard_normal((n, dim)).astype(np.float32)
    ids = list(range(0, 2 * n, 2))
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, q string")
    got = nearest(df, every=20, **options).collect()
    assert compare(got, brute(ids, x, 5, 20)) >= (0.9 if "leaf" in options else 0.999)


def test_hot_vector_asks(spark):
    """A third of all rows hold one vector, many of them queries; ids repeat."""
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 16)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=3).collect()
    hot = sorted((g.query_id, g["rank"], g.vec_id) for g in got if g.query_id % 3 == 0 and g.query_id < 30)
    assert hot == sorted((q, k + 1, i) for q in range(0, 30, 3) for k, i in enumerate([i for i in range(0, 300, 3) if i != q][:5]))
    assert {g.query_id for g in got} == {i for i in range(300) if i % 3 == 0}


def test_copies_and_cases(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((60, 8)).astype(np.float32)
    x[10:40] = x[0]
    x[41] = x[42]
    ids = list(range(60))
    rows = [(i, v.tolist()) for i, v in zip(ids, x)]
    odd = [(100, None), (110, []), (120, [0.0] * 8), (130, [1.0] * 7 + [None]), (140, [float("nan")] + [1.0] * 7), (150, [float("inf")] + [1.0] * 7), (160, [1.0] * 9), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = nearest(df, every=10, leaf=16).collect()
    want = brute(ids, x, 5, 10)
    for q, found in want.items():
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for i, _ in found]
    assert {r.query_id for r in got} == set(want)
    few = nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>"), every=1).collect()
    assert len(few) == 6
    assert nearest(df.limit(0)).collect() == [] and nearest(spark.createDataFrame(odd, df.schema).where("vec_id = 100")).collect() == []


@pytest.mark.parametrize("noise", [0.01, 0.001])
def test_near_copies(spark, noise):
    r = np.random.default_rng(4)
    x = np.concatenate([r.standard_normal((400, 32)), r.standard_normal(32) + noise * r.standard_normal((600, 32))]).astype(np.float32)
    ids = list(range(1000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    want = {q: f for q, f in brute(ids, x, 5, 25).items() if q >= 400}
    got = [g for g in nearest(df, every=25).collect() if g.query_id >= 400]
    assert compare(got, want) >= 0.9


def test_met_pairs_are_not_proposed_again():
    """Of two centres' neighbours those pairs are proposed in which one is new at the centre: each one's nearest of these."""
    r, rows, want = np.random.default_rng(5), [], set()
    for centre in (1, 2):
        x = r.integers(-127, 128, (40, 16)).astype(np.int8)
        unit = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        sims, fresh, ids = unit @ unit.T, np.arange(40) % 5 == 0, centre * 100 + np.arange(40)
        worst = np.where(np.arange(40) < 30, -2.0, 0.3)
        rows += [{"centre": centre, "salt": 0, "member": int(ids[i]), "b": x[i].tobytes(), "worst": worst[i], "fresh": bool(fresh[i])} for i in range(40)]
        for i in range(40):
            met = sorted((j for j in range(40) if j != i and (fresh[i] or fresh[j])), key=lambda j: -sims[i, j])[:6]
            want |= {(int(ids[i]), int(ids[j])) for j in met if sims[i, j] > worst[i]}
    kinds = {"centre": pa.int64(), "salt": pa.int64(), "member": pa.int64(), "b": pa.binary(), "worst": pa.float32(), "fresh": pa.bool_()}
    table = pa.table({c: pa.array([x[c] for x in rows], k) for c, k in kinds.items()})
    found = proposals(table, 16, 6, 24)
    assert {(n, m) for n, nbrs in zip(found["node"].to_pylist(), found["nbrs"].to_pylist()) for m in nbrs} == want
    settled = table.set_column(5, "fresh", pa.array([False] * len(rows)))
    assert proposals(settled, 16, 6, 24).num_rows == 0
