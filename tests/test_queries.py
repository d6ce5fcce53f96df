import pytest

from compare import connect, differences
from heapspan import registry
from heapspan.operators import diff
from heapspan.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE:
        assert not differences(df, con, registry.ORACLE[name])
    else:
        assert name == "graph_idom_cycles"  # below


def test_idom_with_cycles(spark):
    """Against intersection of dominators along a depth-first order, until nothing changes."""
    nodes = {r.nid: r.shallow_size for r in tables.nodes(spark, SF).collect()}
    after, before = {}, {}
    for r in tables.edges(spark, SF, cycles=True).select("src", "dst").distinct().collect():
        if r.src in nodes and r.dst in nodes:
            after.setdefault(r.src, []).append(r.dst)
            before.setdefault(r.dst, []).append(r.src)
    order, seen, todo = [], {0}, [(0, iter(after[0]))]
    while todo:
        v, rest = todo[-1]
        w = next((x for x in rest if x not in seen), None)
        if w is None:
            order.append(v)
            todo.pop()
        else:
            seen.add(w)
            todo.append((w, iter(after.get(w, []))))
    rank, idom, changed = {v: i for i, v in enumerate(order)}, {0: 0}, True
    while changed:
        changed = False
        for v in reversed(order[:-1]):
            new = None
            for p in before[v]:
                if p in idom:
                    a = p
                    b = p if new is None else new
                    while a != b:
                        if rank[a] < rank[b]:
                            a = idom[a]
                        else:
                            b = idom[b]
                    new = a
            changed |= idom.get(v) != new
            idom[v] = new
    kept = dict(nodes)
    for v in order[:-1]:  # a dominated node comes before its dominator
        kept[idom[v]] += kept[v]
    got = registry.QUERIES["graph_idom_cycles"](spark, SF).collect()
    assert len(got) == len(nodes)
    for r in got:
        assert (r.idom, r.retained_size) == ((None, kept[0]) if r.nid == 0 else (idom[r.nid], kept[r.nid]) if r.nid in idom else (0, 0))


def test_diagnosis_and_advice(spark):
    rows = [("app.BigCache", 5, 0, 400), ("app.Cache", 5, 0, 200), ("byte[]", 9, 0, 300), ("net.ConnectionImpl", 3, 0, 110), ("app.LinkedQueue", 3, 0, 100), ("app.Listener", 3, 0, 120), ("app.Item", 200_000, 0, 40), ("app.Other", 200_000, 0, 20)]
    histogram = spark.createDataFrame(rows, "class_name string, instance_count long, shallow_size long, retained_size long")
    suspects = spark.createDataFrame([("app.Listener", 30.0, 1), ("app.BigCache", 60.0, 0), ("app.Small", 15.0, 2)], "class_name string, retained_percentage double, position int")
    got = [(r.severity, r.title, r.advice) for r in diff.diagnosis(histogram, suspects, 1000).collect()]
    assert got == [
        ("critical", "app.BigCache retains 60.0% of heap", "cache, critical"),
        ("warning", "app.Listener retains 30.0% of heap", "other"),
        ("warning", "byte[] occupies 30.0% of heap", "arrays"),
        ("warning", "app.Cache pattern detected (20.0% heap)", "cache"),
        ("warning", "net.ConnectionImpl pattern detected (11.0% heap)", "connections"),
        ("info", "200,000 instances of app.Item (4.0% heap)", "count"),
    ]
    assert {r.advice for r in diff.diagnosis(histogram, suspects, 1000).collect()} <= set(diff.SAYS)
