import struct

import pytest
from pyspark.sql import functions as F

from heapspan.analysis import HeapAnalysis
from heapspan.operators import waste
from heapspan.sources import hprof


class Builder:
    """HPROF bytes."""

    def __init__(self, size=8):
        self.size, self.out, self.heap, self.names = size, bytearray(b"JAVA PROFILE 1.0.2\0" + struct.pack(">IQ", size, 0)), bytearray(), {}

    def i(self, x):
        return x.to_bytes(self.size, "big")

    def record(self, tag, body):
        self.out += struct.pack(">BII", tag, 0, len(body)) + body

    def name(self, text):
        if text not in self.names:
            self.names[text] = 0x900000 + len(self.names)
            self.record(1, self.i(self.names[text]) + text.encode())
        return self.names[text]

    def cls(self, id_, name, sup=0, fields=(), statics=(), loader=0):
        self.record(2, struct.pack(">I", 1) + self.i(id_) + struct.pack(">I", 0) + self.i(self.name(name)))
        body = b"\x20" + self.i(id_) + b"\0\0\0\0" + self.i(sup) + self.i(loader) + self.i(0) * 4 + struct.pack(">I", 0) + struct.pack(">H", 0)
        body += struct.pack(">H", len(statics)) + b"".join(self.i(self.name(n)) + bytes([t]) + v for n, t, v in statics)
        self.heap += body + struct.pack(">H", len(fields)) + b"".join(self.i(self.name(n)) + bytes([t]) for n, t in fields)

    def instance(self, id_, cls, body=b""):
        self.heap += b"\x21" + self.i(id_) + b"\0\0\0\0" + self.i(cls) + struct.pack(">I", len(body)) + body

    def objects(self, id_, cls, ids):
        self.heap += b"\x22" + self.i(id_) + struct.pack(">II", 0, len(ids)) + self.i(cls) + b"".join(map(self.i, ids))

    def array(self, id_, kind, data):
        self.heap += b"\x23" + self.i(id_) + struct.pack(">II", 0, len(data) // hprof.WIDTHS[kind]) + bytes([kind]) + data

    def root(self, id_):
        self.heap += b"\xff" + self.i(id_)

    def flush(self):
        self.record(0x1C, bytes(self.heap))
        self.heap = bytearray()

    def done(self, path):
        self.flush()
        self.record(0x2C, b"")
        path.write_bytes(bytes(self.out))
        return str(path)


def dump(tmp_path, size):
    b = Builder(size)
    b.cls(0x100, "java/lang/Object")
    b.cls(0x110, "java/lang/ref/Reference", 0x100, [("referent", 2), ("next", 2)])
    b.cls(0x120, "app/Owner", 0x100, [("left", 2), ("n", 10), ("c", 5), ("d", 7)], [("shared", 2, b.i(0x500)), ("k", 11, bytes(8))])
    b.cls(0x130, "app/Child", 0x120, [("more", 2)])
    b.cls(0x140, "[Lapp/Owner;", 0x100)
    b.cls(0x150, "java/lang/String", 0x100, [("value", 2)])
    b.flush()
    b.root(0x400)
    b.root(0x777)
    b.root(0x120)
    b.instance(0x400, 0x130, b.i(0x410) + b.i(0x420) + struct.pack(">iHd", -5, ord("x"), 2.5))
    b.instance(0x410, 0x110, b.i(0x430) + b.i(0x440))
    b.objects(0x420, 0x140, [0x440, 0, 0x450, 0x9999])
    b.instance(0x430, 0x100)
    b.instance(0x440, 0x100)
    b.flush()
    b.instance(0x440, 0x130)
    b.array(0x450, 10, bytes(40))
    b.array(0x500, 8, b"abc")
    for k, backing in enumerate((0x600, 0x600, 0x610, 0x620)):
        b.instance(0x700 + 16 * k, 0x150, b.i(backing))
        b.root(0x700 + 16 * k)
    b.array(0x600, 8, b"same")
    b.array(0x610, 8, b"same")
    b.array(0x620, 5, "other".encode("utf-16-be"))
    return b.done(tmp_path / "a.hprof")


@pytest.mark.parametrize("size", [4, 8])
def test_graph(spark, tmp_path, size):
    d = hprof.read(spark, dump(tmp_path, size))
    assert d.records.where("tag < 0").isEmpty()
    nodes, edges, _ = hprof.as_graph(d, hprof.Layout(8, 4, 4, 8))
    n = {int(r.object_id): r for r in nodes.collect()}
    assert n[0x777].node_type == "Root" and n[0x120].node_type == "Class" and n[0x400].node_type == "Instance"
    assert n[0x420].class_name == "app.Owner[]" and n[0x450].class_name == "int[]" and n[0x120].class_name == "app.Owner"
    assert n[0x440].class_name == "java.lang.Object"  # the first record counts
    assert (n[0x400].shallow_size, n[0x420].shallow_size, n[0x450].shallow_size, n[0x500].shallow_size, n[0x430].shallow_size) == (40, 32, 56, 24, 16)
    names = {r.nid: int(r.object_id) for r in n.values()}
    found = {(names[e.src], names[e.dst], e.label) for e in edges.collect()}
    assert (0x410, 0x440, hprof.INSTANCE_FIELD) in found and (0x410, 0x430, hprof.INSTANCE_FIELD) not in found
    assert (0x400, 0x410, hprof.INSTANCE_FIELD) in found and (0x400, 0x420, hprof.INSTANCE_FIELD) in found
    assert (0x420, 0x450, hprof.ARRAY_ELEMENT) in found and (0x120, 0x500, hprof.CLASS_STATIC) in found and (0x130, 0x120, hprof.SUPER_CLASS) in found
    heap = HeapAnalysis(nodes, edges)
    kept = {int(r.object_id): r.retained_size for r in heap.tree.collect()}
    assert kept[0x430] == 0 and kept[0x420] == 32 + 56 and kept[0x400] >= 40 + 88
    fields = {f["name"]: f["value"] for f in hprof.inspect(d, 0x400)}
    assert fields == {"more": str(0x410), "left": str(0x420), "n": "-5", "c": "'x'", "d": "2.5"}
    strings = waste.duplicate_strings(*hprof.string_values(d, hprof.Layout(8, 4, 4, 8))).collect()
    assert [(r["preview"], r["count"], r["wasted_bytes"]) for r in strings] == [("same", 3, 2 * (16 + 24))]
    assert {r.class_name for r in hprof.quick_scan(d).collect()} >= {"app.Child", "int[]"}


def test_pieces_duplicates_and_class_edges(spark, tmp_path):
    """Segments cut into small pieces; a second record of an id adds no edge; arrays of primitives and classes refer to their classes."""
    b = Builder(8)
    b.cls(0x100, "java/lang/Object")
    b.cls(0x110, "java/lang/Class", 0x100)
    b.cls(0x120, "[B", 0x100)
    b.cls(0x130, "app/Pair", 0x100, [("a", 2), ("b", 2)])
    for k in range(50):
        b.instance(0x1000 + k, 0x130, b.i(0x2000 + k) + b.i(0x2000))
        b.array(0x2000 + k, 8, b"12345678" * (k % 7))
        b.objects(0x3000 + k, 0x100, [0x1000 + k])
    b.instance(0x1000, 0x130, b.i(0x2003) + b.i(0x2004))
    b.array(0x4000, 8, bytes(3000))  # longer than a piece
    path = b.done(tmp_path / "p.hprof")
    whole, cut = hprof.read(spark, path), hprof.read(spark, path, piece=200)
    rows = lambda d: sorted((r.position, r.tag, r.object_id) for r in d.records.collect())
    assert len(rows(whole)) == 4 + 150 + 2 and rows(whole) == rows(cut)
    found = {(r.src, r.dst, r.label) for r in hprof.references(cut).collect()}
    assert (0x1000, 0x2000, hprof.INSTANCE_FIELD) in found and not {(0x1000, 0x2003, hprof.INSTANCE_FIELD), (0x1000, 0x2004, hprof.INSTANCE_FIELD)} & found
    assert (0x2001, 0x120, hprof.RUNTIME_CLASS) in found and (0x130, 0x110, hprof.RUNTIME_CLASS) in found
    told = {r.tag: r.n for r in hprof.statistics(cut).collect()}
    assert told[-hprof.LOAD_CLASS] == 4 and told[-hprof.STRING] == 6 and told[hprof.CLASS_DUMP] == 4


def test_folder_of_dumps(spark, tmp_path):
    """Two dumps with the same ids don't mix."""
    for name, n in (("one", 1), ("two", 2)):
        b = Builder(8)
        b.cls(0x100, f"app/{name.title()}", 0, [("x", 2)] * n)
        b.instance(0x200, 0x100, b.i(0x300) * n)
        b.array(0x300, 8, b"x" * n)
        b.root(0x200)
        b.done(tmp_path / f"{name}.hprof")
    d = hprof.read(spark, str(tmp_path))
    with pytest.raises(hprof.HprofError):
        hprof.as_graph(d)
    files = sorted(r.file for r in d.versions.collect())
    for file, name in zip(files, ("app.One", "app.Two")):
        nodes, edges, _ = hprof.as_graph(d, file=file)
        assert {r.class_name for r in nodes.collect()} == {"", name, "byte[]"} and edges.distinct().count() == 3
    assert {(r.file, r.class_name): r.n for r in hprof.object_records(d).groupBy("file", "class_name").agg(F.count("*").alias("n")).collect()} == {(files[0], "app.One"): 2, (files[1], "app.Two"): 2, (files[0], "byte[]"): 1, (files[1], "byte[]"): 1}


def test_waste_of_a_dump(spark, tmp_path):
    b = Builder(8)
    b.cls(0x100, "java/lang/Object")
    b.cls(0x110, "java/util/HashMap", 0x100, [("table", 2), ("entries", 2), ("size", 10), ("changes", 10)])
    b.cls(0x120, "java/util/ArrayList", 0x100, [("size", 10), ("data", 2)])
    b.cls(0x130, "java/lang/String", 0x100, [("hash", 10), ("value", 2), ("other", 2)])
    b.cls(0x140, "[Ljava/lang/Object;", 0x100)
    for k, (size, capacity) in enumerate(((0, 16), (0, 64), (3, 64), (3, 12), (20, 64), (1, 17))):
        b.objects(0x1000 + k, 0x140, [0] * capacity)
        b.instance(0x2000 + k, 0x110, b.i(0x1000 + k) + b.i(0) + struct.pack(">ii", size, 9))
        b.instance(0x3000 + k, 0x120, struct.pack(">i", size) + b.i(0x1000 + k if k else 0))
        b.root(0x2000 + k)
    # the first reference field counts, though the other array has the smaller id
    for k, text in enumerate((b"twin", b"twin", b"alone")):
        b.array(0x5000 + k, 8, text)
        b.array(0x4000 + k, 8, b"decoy")
        b.instance(0x6000 + k, 0x130, struct.pack(">i", 0) + b.i(0x5000 + k) + b.i(0x4000 + k))
    d = hprof.read(spark, b.done(tmp_path / "c.hprof"))
    heap = HeapAnalysis.of_dump(d, hprof.Layout(8, 4, 4, 8))
    waste_ = heap.waste
    assert [(r["preview"], r["count"]) for r in waste_["duplicate_strings"].collect()] == [("twin", 2)]
    assert {(r["class_name"], r["count"]) for r in waste_["empty_collections"].collect()} == {("java.util.HashMap", 2), ("java.util.ArrayList", 2)}
    got = {r["class_name"]: (r["count"], r["wasted_bytes"]) for r in waste_["oversized_collections"].collect()}
    assert got == {"java.util.HashMap": (2, (61 + 16) * 4), "java.util.ArrayList": (2, (61 + 16) * 4)}
    assert waste_["totals"].first().total_wasted_bytes > 2 * 77 * 4
    assert hprof.nth_field(b"\0\0\0\7" + bytes(7) + b"\5", [10, 2], 8, 2) == 5 and hprof.nth_field(bytes(3), [10], 8, 10) is None and hprof.nth_field(bytes(8), [10, 10], 8, 10, 2) is None


def test_payload_sizes(spark, tmp_path):
    b = Builder(4)
    b.out[:19] = b"JAVA PROFILE 1.0.3\0"
    b.cls(0x100, "app/A", 0, [("x", 10)])
    b.array(0x200, 10, bytes(12))
    b.objects(0x300, 0x100, [0, 0, 0])
    d = hprof.read(spark, b.done(tmp_path / "v.hprof"))
    assert hprof.payload_only(d)
    assert {r.raw_id: r.shallow_size for r in hprof.object_records(d).collect()} == {0x100: 0, 0x200: 12, 0x300: 12}


def test_wide_ids_and_damage(spark, tmp_path):
    b = Builder(8)
    for x in (2**53, 2**53 + 1, 2**64 - 1):
        b.array(x, 8, b"12")
        b.root(x)
    nodes, _, _ = hprof.as_graph(hprof.read(spark, b.done(tmp_path / "w.hprof")))
    assert {int(r.object_id) for r in nodes.collect()} == {0, 2**53, 2**53 + 1, 2**64 - 1}
    b = Builder(8)
    b.array(5, 8, b"123")
    b.heap += b"\x21\0\0"
    d = hprof.read(spark, b.done(tmp_path / "t.hprof"))
    assert sorted(r.tag for r in d.records.collect()) == [-1, 0x23]
    with pytest.raises(hprof.HprofError):
        hprof.header(b"PK\3\4")
    assert hprof.statistics(d).where(F.col("tag") == 0x23).first().bytes == 3


def test_layout(spark, tmp_path):
    for gap, want in ((16 + 8 * 10 + 16, 8), (16 + 4 * 10, 4)):
        b = Builder(8)
        for k in range(40):
            b.objects(0x1000 + k * gap, 0x100, [0] * 10)
        found = hprof.infer_layout(hprof.read(spark, b.done(tmp_path / f"l{gap}.hprof")))
        assert found.reference == want and found.align == (16 if gap % 16 == 0 else 8)
    b = Builder(8)
    for k in range(20):
        b.objects(0x10000 + k * 256, 0x100, [0] * 4)
    assert hprof.infer_layout(hprof.read(spark, b.done(tmp_path / "few.hprof"))).align == 8
