import json
import struct

import pytest

from heapspan.analysis import HeapAnalysis
from heapspan.cache import Cache, digest
from heapspan.operators import derive, waste
from heapspan.plans.dialect import QueryError
from heapspan.sources import hprof
from heapspan.tools import Tools
from test_hprof import Builder


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    b = Builder(8)
    b.cls(0x100, "java/lang/Object")
    b.cls(0x110, "app/Registry", 0x100, [("items", 2), ("n", 10)])
    b.cls(0x120, "[Lapp/Item;", 0x100)
    b.cls(0x130, "app/Item", 0x100, [("data", 2)])
    b.instance(0x200, 0x110, b.i(0x300) + struct.pack(">i", 5))
    b.objects(0x300, 0x120, [0x1000 + 16 * k for k in range(40)])
    for k in range(40):
        b.instance(0x1000 + 16 * k, 0x130, b.i(0x9000 + 64 * k))
        b.array(0x9000 + 64 * k, 8, bytes(40))
    b.root(0x200)
    return b.done(tmp_path_factory.mktemp("dump") / "a.hprof")


@pytest.fixture(scope="module")
def heap(spark, path):
    return HeapAnalysis.of_dump(hprof.read(spark, path), hprof.Layout())


def test_accumulation(heap):
    got = {r.class_name: (r.accumulation_class, r.accumulation_id and int(r.accumulation_id)) for r in heap.accumulated().collect()}
    assert got["app.Registry"] == ("app.Item[]", 0x300) and got["app.Item"] == (None, None)


def test_older_suspects_and_drill_down(heap):
    got = [(r.kind, r.class_name) for r in heap.legacy_suspects().collect()]
    assert got == [("object", "app.Item[]"), ("class", "app.Item"), ("class", "byte[]")]
    drilled = heap.class_drill("app.Item", 3).collect()
    assert [int(r.object_id) for r in drilled] == [0x1000, 0x1010, 0x1020] and heap.class_drill("none").isEmpty()


def test_tables_before_edges(heap):
    tables = derive.unlinked_tables(heap.nodes)
    rows = tables["instances"].collect()
    assert len(rows) == 82 and {r.retained_size for r in rows} == {0} and tables["dominator_tree"].isEmpty() and tables["leak_suspects"].isEmpty()
    assert {r.class_name: r.instance_count for r in tables["class_histogram"].collect()}["app.Item"] == 40


def test_stages(heap):
    told = []
    heap.stages(lambda stage, numbers: told.append((stage, numbers)))
    assert [s for s, _ in told] == ["records", "shallow", "references", "dominators", "complete"]
    assert told[0][1]["Instance"] == 41 and "reachable_heap_size" not in told[1][1]


def test_investigation(heap, monkeypatch):
    for bad in ("0", "01", "-1", "1.5", "18446744073709551616", "", "x"):
        with pytest.raises(QueryError):
            heap.investigate("object", bad)
    with pytest.raises(QueryError):
        heap.investigate("query", "1")
    own = str(0x200)
    assert [(r.name, r.value, r.target_class) for r in heap.investigate("fields", own).collect()] == [("items", str(0x300), "app.Item[]"), ("n", "5", None)]
    assert len(heap.investigate("outbound", str(0x300)).collect()) == 32 and heap.investigate("children", own).count() == 1
    assert [int(r.object_id) for r in heap.investigate("root_path", str(0x9000)).collect()][-1] == 0x9000
    for limit, operation in (("edges", "outbound"), ("nodes", "children"), ("bytes", "outbound")):
        monkeypatch.setitem(HeapAnalysis.LIMITS, limit, 5)
        with pytest.raises(QueryError):
            heap.investigate(operation, str(0x300))
        monkeypatch.undo()


def test_reports(heap, tmp_path):
    heap.write_report(f"{tmp_path}/r.json", 2, waste=True)
    told = json.load(open(f"{tmp_path}/r.json"))
    assert told["version"] == 1 and len(told["report"]["histogram"]) == 2 and told["report"]["histogram_truncated"] and told["report"]["waste"]["totals"]
    with pytest.raises(FileExistsError):
        heap.write_report(f"{tmp_path}/r.json")
    heap.write_report(f"{tmp_path}/r.txt", 2, form="text")
    assert "histogram (cut)" in open(f"{tmp_path}/r.txt").read()
    heap.export_json(f"{tmp_path}/e.json")
    heap.export_json(f"{tmp_path}/e.json", 1)
    assert json.load(open(f"{tmp_path}/e.json"))["waste"] is None


def test_waste_shown(spark):
    df = spark.createDataFrame([("a.Map", 3, 10), ("b.List", 1, 30), ("c.MAP", 2, 10)], "class_name string, count long, wasted_bytes long")
    assert [r.class_name for r in waste.shown(df).collect()] == ["b.List", "a.Map", "c.MAP"]
    assert [r.class_name for r in waste.shown(df, "count", False, "map").collect()] == ["c.MAP", "a.Map"]
    with pytest.raises(ValueError):
        waste.shown(df, "x")


def test_cache_and_tools(spark, path, tmp_path):
    cache = Cache(spark, f"file://{tmp_path}")
    assert cache.get(digest(spark, path)) is None
    one = cache.analyze(path)
    assert cache.get(digest(spark, path)) is not None and one.totals == cache.analyze(path).totals
    tools = Tools(spark, [path])
    with pytest.raises(QueryError):
        tools.get_summary("1")
    with pytest.raises(QueryError):
        tools.analyze_heap("2")
    assert tools.analyze_heap("1")["total_instances"] == 41 and tools.list_dumps()[0]["open"]
    assert tools.investigate_heap("1", "object", str(0x200))[0]["class_name"] == "app.Registry"
    assert any(r["accumulation_class"] == "app.Item[]" for r in tools.get_evidence("1")["suspects"])
    tools.close_dump("1")
    assert not tools.list_dumps()[0]["open"]
