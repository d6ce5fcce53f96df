import json

import pytest

from heapspan.operators import graph
from heapspan.sources import snapshot


def document(classes, total=8192, suspects=(), waste=None):
    out = {"summary": {"total_heap_size": total, "reachable_heap_size": total, "total_instances": 4, "total_classes": 3, "total_arrays": 1, "total_gc_roots": 1}, "class_histogram": [dict(zip(("class_name", "instance_count", "shallow_size", "retained_size"), c)) for c in classes], "leak_suspects": [dict(zip(("class_name", "object_id", "retained_size", "retained_percentage", "description"), s)) for s in suspects]}
    return json.dumps(out | ({"waste_analysis": waste} if waste else {}))


A = [("net.shop.Till", 3, 72, 5000), ("net.shop.Basket", 7, 392, 3000), ("char[]", 12, 9000, 640)]
B = [("net.shop.Till", 4, 96, 9500), ("net.shop.Basket", 7, 392, 3000), ("char[]", 30, 20000, 1640), ("net.shop.Ledger", 2, 80, 4500)]


def test_compare(spark):
    a = snapshot.read(spark, document(A, 10_000, [("net.shop.Till", 2**64 - 1, 5000, 50.0, "half"), ("old", 1, 5, 1.0, "gone")]))
    b = snapshot.read(spark, document(B, 20_000, [("net.shop.Till", 44, 9500, 47.5, "less"), ("net.shop.Ledger", 55, 4500, 22.5, "more")]))
    out = a.compare(b)
    assert [(r.class_name, r.retained_size_delta, r.change_type) for r in out["histogram"].collect()] == [("net.shop.Ledger", 4500, "new"), ("net.shop.Till", 4500, "grew"), ("char[]", 1000, "grew"), ("net.shop.Basket", 0, "unchanged")]
    assert {(r.class_name, r.status, r.description) for r in out["suspects"].collect()} == {("net.shop.Till", "persisted", "less"), ("net.shop.Ledger", "new", "more"), ("old", "resolved", "Previously: gone")}
    assert out["summary"].first().total_heap_size_delta == 10_000 and out["waste"] is None
    assert int(a.suspects.orderBy("position").first().object_id) == 2**64 - 1


def test_timeline_of_files(spark, tmp_path):
    """By the files' times, without those that are missing; too many are refused."""
    import os

    for name, when, rows in (("late", 2000, B), ("early", 1000, A)):
        (tmp_path / name).write_text(document(rows))
        os.utime(tmp_path / name, (when, when))
    found = snapshot.timeline(spark, [f"{tmp_path}/{n}" for n in ("late", "none", "early")], 2).collect()
    assert [(r.snapshot.rsplit("/", 1)[1], r.class_name, r["rank"]) for r in found] == [("early", "net.shop.Till", 1), ("early", "net.shop.Basket", 2), ("late", "net.shop.Till", 1), ("late", "net.shop.Ledger", 2)]
    with pytest.raises(snapshot.SnapshotError):
        snapshot.timeline(spark, [f"{tmp_path}/late"] * 65)


def test_compare_report(spark):
    a, b = snapshot.read(spark, document(A, 10_000)), snapshot.read(spark, document(B, 20_000))
    got = snapshot.compare_report(a, b, rows=2, models=("one", "two"))
    assert [r["class_name"] for r in got["histogram"]] == ["net.shop.Ledger", "net.shop.Till"] and got["histogram_truncated"] and got["size_models_differ"]
    assert not snapshot.compare_report(a, b)["size_models_differ"] and got["summary"]["total_heap_size_delta"] == 10_000


def test_bad(spark):
    for bad in ("", "{}", "[1]", document([("x", 1, 2, 2**63)])):
        with pytest.raises(snapshot.SnapshotError):
            snapshot.read(spark, bad)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 2), ('a"b,c', 3), ("x|y", None)], "name string, n long")
    snapshot.write_csv_file(df, f"{tmp_path}/a.csv")
    assert open(f"{tmp_path}/a.csv").read() == '"name","n"\n"\'=1+1","2"\n"a""b,c","3"\n"x|y",""\n'
    with pytest.raises(FileExistsError):
        snapshot.write_csv_file(df, f"{tmp_path}/a.csv")
    snapshot.write_markdown(df, f"{tmp_path}/a.md")
    assert open(f"{tmp_path}/a.md").read().splitlines()[-1] == "| x\\|y |  |"


def test_older_policies(spark):
    nodes = spark.createDataFrame([(0, "SuperRoot", "", 0), (1, "Instance", "a", 10), (2, "Class", "b", 0), (3, "Instance", "c", 5), (4, "Array", "d", 7)], "nid long, node_type string, class_name string, shallow_size long")
    nodes = nodes.withColumn("object_id", nodes.nid.cast("decimal(20,0)"))
    edges = spark.createDataFrame([(0, 1, 0, None), (0, 2, 0, None), (1, 3, 1, "f"), (2, 4, 1, "s"), (1, 4, 1, "g")], "src long, dst long, label int, field string")
    tree = graph.dominators(nodes, edges)
    assert [(r.nid, r.field) for r in graph.labelled_children(tree, edges, 1).collect()] == [(3, "f")]
    assert [(r.nid, r.field) for r in graph.labelled_children(tree, edges, 0).collect()] == [(1, None), (4, "g")]
    assert [(r.nid, r.field) for r in graph.labelled_referrers(tree, edges, 4).collect()] == [(1, "g")]
    assert [int(r.object_id) for r in graph.top_layers(tree, 1, 10).collect()] == [1, 4]
