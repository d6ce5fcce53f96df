"""HPROF heap dumps as DataFrames.

A dump is cut into its strings, loaded classes and heap segments by one pass over the record headers, in a task a dump that reads a
stream and holds PIECE bytes at a time, so dumps may have any size; segments are cut between sub-records into pieces, which are dealt
out and read in parallel. Everything is big-endian; ids are unsigned and kept as signed longs inside, as
decimal(20,0) in `object_id`. A truncated record ends its segment with an error row instead of failing the dump.

records: file, position (unique and rising in a dump), tag, object_id, class_id, super_id, loader_id, signers_id, domain_id, length, element (type
code of an array), body, statics and fields (name_id, type, value).
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph
from ..store import Rounds

# Fixed values of the format: tags of records and sub-records, types with their widths, fields that follow a root's id.
STRING, LOAD_CLASS, HEAP_DUMP, HEAP_SEGMENT, HEAP_END = 0x01, 0x02, 0x0C, 0x1C, 0x2C
CLASS_DUMP, INSTANCE_DUMP, OBJECT_ARRAY, PRIMITIVE_ARRAY, NO_DATA_ARRAY, HEAP_INFO = 0x20, 0x21, 0x22, 0x23, 0xC3, 0xFE
OBJECT = 2
WIDTHS = {4: 1, 5: 2, 6: 4, 7: 8, 8: 1, 9: 2, 10: 4, 11: 8}
TYPE_NAMES = {4: "boolean", 5: "char", 6: "float", 7: "double", 8: "byte", 9: "short", 10: "int", 11: "long"}
ROOTS = {0xFF: ("unknown", ""), 0x01: ("jni global", "i"), 0x02: ("jni local", "44"), 0x03: ("java frame", "44"), 0x04: ("native stack", "4"), 0x05: ("sticky class", ""), 0x06: ("thread block", "4"), 0x07: ("monitor", ""), 0x08: ("thread object", "44"), 0x89: ("interned string", ""), 0x8A: ("finalizing", ""), 0x8B: ("debugger", ""), 0x8C: ("reference cleanup", ""), 0x8D: ("vm internal", ""), 0x8E: ("jni monitor", "44"), 0x90: ("unreachable", "")}
# Labels of edges, smaller wins.
GC_ROOT, INSTANCE_FIELD, ARRAY_ELEMENT, CLASS_STATIC, SUPER_CLASS, CLASS_LOADER, UNKNOWN, RUNTIME_CLASS, SIGNERS, DOMAIN = range(10)

PIECE = 32 << 20
SEGMENT = "file string, position long, id_size int, kind string, id long, value binary, class_name_id long"
RECORD = "file string, position long, id_size int, tag int, object_id long, class_id long, super_id long, loader_id long, signers_id long, domain_id long, length long, element int, body binary, statics array<struct<name_id:long,type:int,value:long>>, fields array<struct<name_id:long,type:int>>"
RECORD_FIELDS = [x.split(" ", 1)[0] for x in RECORD.split(", ")]


class HprofError(ValueError):
    pass


@dataclass(frozen=True)
class Layout:
    """Widths in bytes of a word, a reference and a class pointer; alignment of objects."""

    word: int = 8
    reference: int = 4
    pointer: int = 4
    align: int = 8


class Reader:
    def __init__(self, data: bytes, id_size: int, at: int = 0) -> None:
        self.data, self.id_size, self.at = data, id_size, at

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise HprofError(f"truncated at {self.at}")
        self.at += n
        return out

    def u(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def id(self) -> int:
        return int.from_bytes(self.take(self.id_size), "big", signed=self.id_size == 8)

    def value(self, kind: int) -> int:
        if kind == OBJECT:
            return self.id()
        if kind not in WIDTHS:
            raise HprofError(f"unknown type {kind} at {self.at}")
        return int.from_bytes(self.take(WIDTHS[kind]), "big", signed=True)


def header(data: bytes) -> tuple[str, int, int]:
    """Version, id width, and where the records begin."""
    end = data.find(b"\0", 0, 64)
    if end < 0 or not data.startswith(b"JAVA PROFILE ") or len(data) < end + 13:
        raise HprofError("not an HPROF dump")
    size = int.from_bytes(data[end + 1 : end + 5], "big")
    if size not in (4, 8):
        raise HprofError(f"id width {size}")
    return data[:end].decode(), size, end + 13


class Stream:
    """A binary file that is read forward, with as much of it held as is asked for."""

    def __init__(self, file, chunk: int = PIECE) -> None:
        self.file, self.chunk, self.held, self.at = file, chunk, b"", 0

    def peek(self, n: int) -> bytes:
        """Up to n bytes from here on."""
        while len(self.held) < n and (more := self.file.read(max(self.chunk, n - len(self.held)))):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.held, self.at = self.held[len(out) :], self.at + len(out)
        return out


def whole_records(data: bytes, size: int) -> int:
    """How many bytes from the start of data hold whole sub-records; all of it if it can't be read."""
    r, done = Reader(data, size), 0
    try:
        while r.at < len(data):
            tag = r.u(1)
            if tag in ROOTS:
                r.at += size + sum(size if c == "i" else 4 for c in ROOTS[tag][1])
            elif tag == CLASS_DUMP:
                r.at += 7 * size + 8
                for _ in range(r.u(2)):
                    r.take(2)
                    r.value(r.u(1))
                for _ in range(r.u(2)):
                    r.take(size)
                    r.value(r.u(1))
                n = r.u(2)
                r.at += n * (size + 1)
            elif tag == INSTANCE_DUMP:
                r.at += 2 * size + 4
                n = r.u(4)
                r.at += n
            elif tag == OBJECT_ARRAY:
                r.at += size + 4
                n = r.u(4)
                r.at += size * (n + 1)
            elif tag in (PRIMITIVE_ARRAY, NO_DATA_ARRAY):
                r.at += size + 4
                n, kind = r.u(4), r.u(1)
                r.at += n * WIDTHS[kind] if tag == PRIMITIVE_ARRAY else 0
            elif tag == HEAP_INFO:
                r.at += 4 + size
            else:
                return len(data)
            if r.at > len(data):
                break
            done = r.at
    except HprofError:  # the last one goes on behind the data
        pass
    except KeyError:
        return len(data)
    return done


def top_records(file: str, stream: Stream) -> Iterator[tuple]:
    """Rows of SEGMENT."""
    version, size, begin = header(stream.peek(128))
    stream.take(begin)
    yield file, 0, size, "header", None, version.encode(), None
    while len(head := stream.take(9)) == 9:
        tag, length, start = head[0], int.from_bytes(head[5:], "big"), stream.at
        if tag in (HEAP_DUMP, HEAP_SEGMENT):
            left = length
            while left and (piece := stream.peek(min(left, stream.chunk))):
                n = len(piece)
                if n < left:  # up to the last whole sub-record; more of it if there is none
                    while not (n := whole_records(piece, size)) and len(piece) < left and len(more := stream.peek(min(left, 2 * len(piece)))) > len(piece):
                        piece = more
                    n = n or len(piece)
                yield file, stream.at, size, "segment", None, stream.take(n), None
                left -= n
        elif tag in (STRING, LOAD_CLASS):
            body = stream.take(length)
            if tag == STRING and len(body) >= size:
                yield file, start, size, "string", int.from_bytes(body[:size], "big", signed=size == 8), body[size:], None
            elif tag == LOAD_CLASS and len(body) >= 8 + 2 * size:
                r = Reader(body, size, 4)
                own, _, name = r.id(), r.u(4), r.id()
                yield file, start, size, "class", own, None, name
        else:
            while length and (gone := stream.take(min(length, stream.chunk))):
                length -= len(gone)


def sub_records(file: str, start: int, size: int, data: bytes) -> Iterator[dict]:
    """Rows of RECORD of one segment; a row with tag -1 where it breaks off."""
    r = Reader(data, size)
    while r.at < len(data):
        row = {"file": file, "position": start + r.at, "id_size": size}
        try:
            tag = row["tag"] = r.u(1)
            if tag in ROOTS:
                row["object_id"] = r.id()
                for c in ROOTS[tag][1]:
                    r.take(size if c == "i" else 4)
            elif tag == CLASS_DUMP:
                row["object_id"] = r.id()
                r.take(4)
                row["super_id"], row["loader_id"], row["signers_id"], row["domain_id"] = r.id(), r.id(), r.id(), r.id()
                r.take(2 * size)
                row["length"] = r.u(4)
                for _ in range(r.u(2)):
                    r.take(2)
                    r.value(r.u(1))
                row["statics"] = [{"name_id": r.id(), "type": (t := r.u(1)), "value": r.value(t)} for _ in range(r.u(2))]
                row["fields"] = [{"name_id": r.id(), "type": r.u(1)} for _ in range(r.u(2))]
            elif tag == INSTANCE_DUMP:
                row["object_id"] = r.id()
                r.take(4)
                row["class_id"] = r.id()
                row["body"] = r.take(r.u(4))
            elif tag == OBJECT_ARRAY:
                row["object_id"] = r.id()
                r.take(4)
                row["length"] = r.u(4)
                row["class_id"], row["element"] = r.id(), OBJECT
                row["body"] = r.take(row["length"] * size)
            elif tag in (PRIMITIVE_ARRAY, NO_DATA_ARRAY):
                row["object_id"] = r.id()
                r.take(4)
                row["length"], row["element"] = r.u(4), r.u(1)
                if row["element"] not in WIDTHS:
                    raise HprofError("unknown element type")
                if tag == PRIMITIVE_ARRAY:
                    row["body"] = r.take(row["length"] * WIDTHS[row["element"]])
            elif tag == HEAP_INFO:
                r.take(4 + size)
                continue
            else:
                raise HprofError(f"unknown tag {tag}")
        except HprofError:
            yield {"file": file, "position": row["position"], "id_size": size, "tag": -1}
            return
        yield row


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


@dataclass
class Dump:
    strings: DataFrame  # file, id, text
    classes: DataFrame  # file, class_id, class_name
    records: DataFrame
    versions: DataFrame  # file, version

    def one(self, file: str | None = None) -> "Dump":
        """The dump of one file; there must be only one if it isn't named."""
        names = [file] if file else [r.file for r in self.versions.select("file").limit(2).collect()]
        if len(names) != 1:
            raise HprofError("name the dump to take" if names else "no dump")
        return Dump(*(df.where(F.col("file") == names[0]) for df in (self.strings, self.classes, self.records, self.versions)))


def _open(path: str):
    """A path that the machine or an Arrow file system opens."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    return system.open_input_stream(name)


def read(spark: SparkSession, path: str, batch: int = 4096, piece: int = PIECE) -> Dump:
    """One or more dumps: a file, a folder or a pattern, listed by Spark. A task a dump streams it; where only Spark can open the path, its
    binary reader does, which takes 2 GB a dump."""
    segment, record = _schema(SEGMENT), _schema(RECORD)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, file in enumerate(b.column("path").to_pylist()):
                source = io.BytesIO(b.column("content")[n].as_py()) if "content" in b.schema.names else _open(file)
                rows: list[tuple] = []
                for row in top_records(file, Stream(source, piece)):
                    rows.append(row)
                    if len(rows) >= batch or row[3] == "segment":
                        yield pa.RecordBatch.from_pydict(dict(zip(segment.names, map(list, zip(*rows)))), schema=segment)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(segment.names, map(list, zip(*rows)))), schema=segment)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, at, size, data in zip(*(b.column(c).to_pylist() for c in ("file", "position", "id_size", "value"))):
                rows: list[dict] = []
                for row in sub_records(file, at, size, data):
                    rows.append(row)
                    if len(rows) >= batch:
                        yield pa.RecordBatch.from_pylist(rows, schema=record)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=record)

    rounds = Rounds(spark)
    files = spark.read.format("binaryFile").load(path)
    listed = files.select("path")
    try:
        for r in listed.limit(1).collect():
            _open(r.path).close()
    except (OSError, ValueError, pa.ArrowException):
        listed = files.select("path", "content")
    else:
        listed = listed.repartition(F.col("path"))
    top = rounds.cut(listed.mapInArrow(split, SEGMENT))
    strings = top.where("kind = 'string'").select("file", "id", F.expr("make_valid_utf8(cast(value as string))").alias("text"))
    loaded = top.where("kind = 'class'").groupBy("file", F.col("id").alias("class_id")).agg(F.min_by("class_name_id", "position").alias("name"))
    classes = loaded.join(strings.withColumnRenamed("id", "name"), ["file", "name"], "left").select("file", "class_id", text.class_name(F.coalesce("text", F.lit("unknown"))).alias("class_name"))
    segments = top.where("kind = 'segment'").repartition("file", "position")
    versions = top.where("kind = 'header'").select("file", F.col("value").cast("string").alias("version"))
    return Dump(rounds.cut(strings), rounds.cut(classes), rounds.cut(segments.mapInArrow(parse, RECORD)), rounds.cut(versions))


def statistics(dump: Dump) -> DataFrame:
    """Records and bytes of bodies by tag; strings (and their bytes) and loaded classes by the tags of their records, negative."""
    heap = dump.records.groupBy("tag").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("bytes"))
    strings = dump.strings.agg(F.lit(-STRING).alias("tag"), F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))
    loaded = dump.classes.agg(F.lit(-LOAD_CLASS).alias("tag"), F.count("*").alias("n"), F.lit(0).cast("long").alias("bytes"))
    return heap.unionByName(strings).unionByName(loaded)


def layouts(dump: Dump, most: int = 100) -> DataFrame:
    """class_id, fields (own first, then the superclass's, and so on): name, type, strong; cycles end."""
    own = dump.records.where(F.col("tag") == CLASS_DUMP).groupBy("file", F.col("object_id").alias("class_id")).agg(F.min_by(F.struct("super_id", "fields"), "position").alias("r")).select("file", "class_id", "r.*")
    named = own.select("file", "class_id", "super_id", F.posexplode_outer("fields").alias("pos", "f")).join(dump.strings.select("file", F.col("id").alias("name_id"), "text"), (F.col("f.name_id") == F.col("name_id")) & (dump.strings["file"] == own["file"]), "left").select(own["file"], "class_id", "super_id", "pos", "f.type", "text")
    referent = dump.classes.where("class_name = 'java.lang.ref.Reference'").select("file", "class_id", F.lit(True).alias("is_reference"))
    named = named.join(F.broadcast(referent), ["file", "class_id"], "left")
    strong = ~((F.col("text") == "referent") & F.coalesce("is_reference", F.lit(False)))
    rows = named.groupBy("file", "class_id", "super_id").agg(F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("pos", F.col("text").alias("name"), "type", F.coalesce(strong, F.lit(True)).alias("strong"))))).alias("own"))
    rounds = Rounds(dump.records.sparkSession)
    own = rounds.cut(rows)
    now = rounds.cut(own.select("file", "class_id", F.col("super_id").alias("up"), F.col("own").alias("fields"), F.array("class_id").alias("seen")))
    for _ in range(most):
        more = now.join(own.select("file", F.col("class_id").alias("up"), F.col("super_id").alias("next"), F.col("own").alias("extra")), ["file", "up"], "left")
        ends = F.col("extra").isNull() | F.array_contains("seen", F.col("up"))
        step = more.select("file", "class_id", F.when(ends, 0).otherwise(F.col("next")).alias("up"), F.when(ends, F.col("fields")).otherwise(F.concat("fields", "extra")).alias("fields"), F.when(ends, F.col("seen")).otherwise(F.concat("seen", F.array("up"))).alias("seen"))
        now = rounds.cut(step)
        if now.where("up <> 0").isEmpty():
            break
    return now.select("file", "class_id", "fields")


def infer_layout(dump: Dump, enough: int = 32) -> Layout:
    """The widest layout of which no array reaches past the address of the next record's object, in the dump's order; evidence that would
    leave none is ignored. Objects are aligned as their addresses are (8 to 256), 8 with fewer than `enough` of them."""
    real = dump.records.where(F.col("tag").isin(CLASS_DUMP, INSTANCE_DUMP, OBJECT_ARRAY, PRIMITIVE_ARRAY))
    word = 8 if not dump.records.where("id_size = 8").isEmpty() else 4
    widths = (8, 4) if word == 8 else (4,)
    candidates = [Layout(word, r, k, 8) for r in widths for k in widths]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, int] = {}
        last: tuple | None = None
        for b in batches:
            for at, address, length, element in zip(*(c.to_pylist() for c in b.columns)):
                address %= 1 << 64
                if not address:
                    continue
                if last and last[2] is not None and address > last[0]:
                    fits = 0
                    for i, c in enumerate(candidates):
                        e = c.reference if last[2] == OBJECT else WIDTHS[last[2]]
                        to = max(c.word, e)
                        bare = -(-(c.word + c.pointer + 4) // to) * to + last[1] * e
                        fits |= (last[0] + -(-bare // 8) * 8 <= address) << i
                    first.setdefault(fits, at)
                last = (address, length, element)
        yield pa.RecordBatch.from_pydict({"fits": list(first), "at": list(first.values())}, schema=pa.schema([("fits", pa.int32()), ("at", pa.int64())]))

    element = F.when(F.col("tag").isin(OBJECT_ARRAY, PRIMITIVE_ARRAY), F.col("element")).alias("element")
    ordered = real.select("position", "object_id", "length", element).repartitionByRange("position").sortWithinPartitions("position")
    possible = (1 << len(candidates)) - 1
    # what a later repeat of the same evidence says is known: its first place decides
    for r in ordered.mapInArrow(check, "fits int, at long").groupBy("fits").agg(F.min("at").alias("at")).orderBy("at").collect():
        possible = possible & r.fits or possible
    found = next(c for i, c in enumerate(candidates) if possible >> i & 1)
    n, some, all_ = real.where("object_id <> 0").agg(F.count("*"), F.bit_or("object_id"), F.bit_and("object_id")).first()
    differ = (some & ~all_) % (1 << 64) if n else 0
    return Layout(found.word, found.reference, found.pointer, min(256, max(8, differ & -differ)) if n >= enough and differ else 8)


def payload_only(dump: Dump) -> bool:
    """Dumps of version 1.0.3 have another object layout: sizes are those of their payloads."""
    return not dump.versions.where("version like '%1.0.3'").isEmpty()


def _element_name() -> F.Column:
    names = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    return F.concat(names[F.col("element")], F.lit("[]"))


def object_records(dump: Dump, layout: Layout | None = None) -> DataFrame:
    """One row an object, the first record of its id (a real one before a root): nid, raw_id, node_type, class_name, shallow_size."""
    payload = layout is None and payload_only(dump)
    layout = layout or (Layout(w := 8 if not dump.records.where("id_size = 8").isEmpty() else 4, w, w, 8) if payload else infer_layout(dump))
    declared = dump.records.where(F.col("tag") == CLASS_DUMP).groupBy("file", F.col("object_id").alias("class_id")).agg(F.min_by("length", "position").alias("declared"))
    widths = F.create_map(*[F.lit(x) for pair in WIDTHS.items() for x in pair])
    fields = layouts(dump).select("file", F.col("class_id"), F.expr(f"aggregate(fields, 0L, (a, f) -> a + IF(f.type = {OBJECT}, {layout.reference}, 0))").alias("refs"), F.transform("fields", lambda f: f.type).alias("types"))
    fields = fields.withColumn("bytes", F.aggregate(F.transform("types", lambda t: F.coalesce(F.try_element_at(widths, t), F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)).drop("types")
    kind = F.when(F.col("tag") == CLASS_DUMP, graph.CLASS).when(F.col("tag") == INSTANCE_DUMP, graph.INSTANCE).when(F.col("tag").isin(OBJECT_ARRAY, PRIMITIVE_ARRAY, NO_DATA_ARRAY), graph.ARRAY).otherwise(graph.ROOT)
    rows = dump.records.where("tag >= 0 and object_id <> 0").select("file", "position", "object_id", "class_id", "length", "element", F.length("body").alias("body_bytes"), kind.alias("node_type"))
    rows = graph.first_definitions(rows.withColumn("key", F.struct("file", "object_id")).withColumn("is_root", F.col("node_type") == graph.ROOT).drop("file", "object_id"), "key").select("key.*", "position", "class_id", "length", "element", "body_bytes", "node_type")
    named = rows.join(dump.classes, ["file", "class_id"], "left").join(fields, ["file", "class_id"], "left").join(declared, ["file", "class_id"], "left")
    own_class = dump.classes.select("file", F.col("class_id").alias("object_id"), F.col("class_name").alias("own_name"))
    named = named.join(own_class, ["file", "object_id"], "left")
    header_bytes = layout.word + layout.pointer
    array = lambda e: text.array_size(F.col("length"), e, layout.word, layout.pointer, layout.align)
    primitive = F.lit(None).cast("long")
    for t, w in WIDTHS.items():
        primitive = F.when(F.col("element") == t, array(w)).otherwise(primitive)
    size = F.when(F.col("node_type") == graph.INSTANCE, text.round_up(F.lit(header_bytes) + F.coalesce(F.col("refs") + F.col("bytes"), F.col("body_bytes")), layout.align)).when(F.col("element") == OBJECT, array(layout.reference)).when(F.col("node_type") == graph.ARRAY, primitive).otherwise(F.lit(0))
    if payload:
        each = F.coalesce(*[F.when(F.col("element") == t, F.lit(w)) for t, w in (*WIDTHS.items(), (OBJECT, layout.word))])
        size = F.when(F.col("node_type") == graph.INSTANCE, F.coalesce("declared", "body_bytes")).when(F.col("node_type") == graph.ARRAY, F.col("length") * each).otherwise(F.lit(0))
    name = F.when(F.col("node_type") == graph.CLASS, F.coalesce("own_name", F.lit("unknown"))).when((F.col("node_type") == graph.ARRAY) & (F.col("element") != OBJECT), _element_name()).when(F.col("node_type") == graph.ROOT, "").otherwise(F.coalesce("class_name", F.lit("unknown")))
    return Rounds(dump.records.sparkSession).cut(named.select("file", (F.col("position") + 1).alias("nid"), F.col("object_id").alias("raw_id"), "node_type", name.alias("class_name"), size.cast("long").alias("shallow_size")))


def unsigned(raw: F.Column) -> F.Column:
    return F.when(raw < 0, raw.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(raw).cast("decimal(20,0)")


def references(dump: Dump) -> DataFrame:
    """file, src (raw id, 0 is the super root), dst (raw id), label, field, place (which of the object's references it is): every strong
    reference that isn't null, of each object's first record. A class refers to java.lang.Class, an array of primitives to its class."""
    every = dump.records.where("tag >= 0")
    defined = every.where(~F.col("tag").isin(*ROOTS))
    first = defined.groupBy("file", "object_id").agg(F.min("position").alias("position"))
    r = defined.join(first, ["file", "object_id", "position"], "left_semi")
    link = lambda df, src, dst, label: df.select("file", src.alias("src"), dst.alias("dst"), F.lit(label).alias("label"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("int").alias("place"))
    c = F.col
    classes = r.where(c("tag") == CLASS_DUMP)
    parts = [link(every.where(c("tag").isin(*ROOTS)), F.lit(0).cast("long"), c("object_id"), GC_ROOT)]
    parts += [link(classes, c("object_id"), c(n), label) for n, label in (("super_id", SUPER_CLASS), ("loader_id", CLASS_LOADER), ("signers_id", SIGNERS), ("domain_id", DOMAIN))]
    statics = classes.select("file", "object_id", F.explode("statics").alias("s")).where(c("s.type") == OBJECT)
    parts.append(link(statics, c("object_id"), c("s.value"), CLASS_STATIC))
    parts.append(link(r.where(c("tag").isin(INSTANCE_DUMP, OBJECT_ARRAY)), c("object_id"), c("class_id"), RUNTIME_CLASS))
    named = dump.classes.groupBy("file", "class_name").agg(F.min("class_id").alias("dst"))
    meta = named.where("class_name = 'java.lang.Class'").select("file", "dst")
    parts.append(link(classes.join(F.broadcast(meta), "file"), c("object_id"), c("dst"), RUNTIME_CLASS))
    plain = named.where(c("class_name").isin(*(f"{n}[]" for n in TYPE_NAMES.values())))
    parts.append(link(r.where(c("tag").isin(PRIMITIVE_ARRAY, NO_DATA_ARRAY)).withColumn("class_name", _element_name()).join(F.broadcast(plain), ["file", "class_name"]), c("object_id"), c("dst"), RUNTIME_CLASS))
    bodies = r.where(c("tag").isin(INSTANCE_DUMP, OBJECT_ARRAY) & (F.length("body") > 0)).select("file", "object_id", "class_id", "id_size", "tag", "body").join(layouts(dump), ["file", "class_id"], "left")

    edge_ddl = "file string, src long, dst long, label int, field string, place int"
    edge = _schema(edge_ddl)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("file", "src", "dst", "label", "field", "place")}
            for file, own, size, tag, body, fields in zip(*(b.column(n).to_pylist() for n in ("file", "object_id", "id_size", "tag", "body", "fields"))):
                ids: list[tuple[int, int, str | None]] = []
                if tag == OBJECT_ARRAY or fields is None:
                    n = len(body) // size
                    found = np.frombuffer(body[: n * size], dtype=f">{'i8' if size == 8 else 'u4'}").tolist()
                    ids = [(x, ARRAY_ELEMENT if tag == OBJECT_ARRAY else UNKNOWN, None) for x in found]
                else:
                    at = 0
                    for f in fields:
                        width = size if f["type"] == OBJECT else WIDTHS.get(f["type"], 0)
                        if at + width > len(body) or not width:
                            break
                        if f["type"] == OBJECT and f["strong"]:
                            ids.append((int.from_bytes(body[at : at + size], "big", signed=size == 8), INSTANCE_FIELD, f["name"]))
                        at += width
                for place, (x, label, name) in enumerate(ids):
                    if x:
                        for k, v in zip(out, (file, own, x, label, name, place)):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=edge)

    parts.append(bodies.select("file", "object_id", "id_size", "tag", "body", "fields").mapInArrow(decode, edge_ddl))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("dst <> 0")


def as_graph(dump: Dump, layout: Layout | None = None, file: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and class loaders (nid) for HeapAnalysis, of one dump; name it if there are several."""
    dump = dump.one(file)
    objects, spark = object_records(dump, layout), dump.records.sparkSession
    ids = objects.select("raw_id", "nid").unionByName(spark.createDataFrame([(0, 0)], "raw_id long, nid long"))
    edges = references(dump).join(ids.select(F.col("raw_id").alias("src"), F.col("nid").alias("s")), "src").join(ids.select(F.col("raw_id").alias("dst"), F.col("nid").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "label")
    root = spark.createDataFrame([(0, graph.SUPER, "", 0)], "nid long, node_type string, class_name string, shallow_size long").withColumn("object_id", F.lit(0).cast("decimal(20,0)"))
    nodes = objects.select("nid", "node_type", "class_name", "shallow_size", unsigned(F.col("raw_id")).alias("object_id")).unionByName(root)
    loaders = dump.records.where((F.col("tag") == CLASS_DUMP) & (F.col("loader_id") != 0)).select(F.col("loader_id").alias("raw_id")).distinct().join(ids, "raw_id").select("nid")
    return nodes, edges, loaders


def quick_scan(dump: Dump, layout: Layout | None = None) -> DataFrame:
    """The shallow histogram without a graph; largest first."""
    rows = object_records(dump, layout).where(F.col("node_type").isin(graph.INSTANCE, graph.ARRAY))
    return rows.groupBy("class_name").agg(F.count("*").alias("instance_count"), F.sum("shallow_size").alias("shallow_size")).orderBy(F.desc("shallow_size"), "class_name")


def nth_field(body: bytes, types: list[int], id_size: int, kind: int, n: int = 0) -> int | None:
    """The bytes, as a number, of the n-th field of a type among an instance's fields; none if there are fewer or the body ends before."""
    at = 0
    for t in types:
        width = id_size if t == OBJECT else WIDTHS.get(t, 0)
        if not width or at + width > len(body):
            return None
        if t == kind:
            if not n:
                return int.from_bytes(body[at : at + width], "big", signed=t == OBJECT and id_size == 8)
            n -= 1
        at += width
    return None


def first_fields(dump: Dump, names: tuple[str, ...]) -> DataFrame:
    """file, object_id, position, class_name, reference and number of every instance of the named classes: its first reference and its
    first int field."""
    kinds = dump.classes.where(F.col("class_name").isin(*names))
    rows = dump.records.where(F.col("tag") == INSTANCE_DUMP).select("file", "object_id", "position", "class_id", "id_size", "body").join(F.broadcast(kinds), ["file", "class_id"]).join(layouts(dump), ["file", "class_id"])
    first = dump.records.where((F.col("tag") >= 0) & ~F.col("tag").isin(*ROOTS)).groupBy("file", "object_id").agg(F.min("position").alias("position"))
    rows = rows.join(first, ["file", "object_id", "position"], "left_semi").select("file", "object_id", "position", "class_name", "id_size", "body", F.col("fields.type").alias("types"))
    ddl = "file string, object_id long, position long, class_name string, reference long, number long"
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, body, types = (b.column(c).to_pylist() for c in ("id_size", "body", "types"))
            found = [pa.array([nth_field(x, t, n, kind) for x, t, n in zip(body, types, size)], pa.int64()) for kind in (OBJECT, 10)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema.names[:4]), *found], schema=schema)

    return rows.mapInArrow(run, ddl)


def string_values(dump: Dump, layout: Layout | None = None, file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Strings and their backing arrays of one dump, for duplicate_strings: the first reference field of a java.lang.String to a byte[] or
    char[]."""
    dump = dump.one(file)
    objects = object_records(dump, layout)
    found = first_fields(dump, ("java.lang.String",)).where("reference <> 0").select("object_id", F.col("reference").alias("backing_id"), "position")
    s = found.join(objects.select(F.col("raw_id").alias("object_id"), "shallow_size"), "object_id").select("object_id", "backing_id", "shallow_size", "position")
    arrays = dump.records.where((F.col("tag") == PRIMITIVE_ARRAY) & F.col("element").isin(5, 8)).select(F.col("object_id"), F.col("body").alias("content"), (F.col("element") == 5).alias("is_chars"), (F.col("position") + 1).alias("nid"))
    b = arrays.join(objects.select(F.col("raw_id").alias("object_id"), "nid", "shallow_size"), ["object_id", "nid"]).select("object_id", "content", "shallow_size", "is_chars")
    return s, b


def collection_sizes(dump: Dump, layout: Layout | None = None, file: str | None = None) -> DataFrame:
    """class_name, shallow_size, size (the first int field) and capacity (elements of the array that the first reference field holds, or
    null) of each collection of one dump, for the waste rules."""
    from ..operators.waste import COLLECTIONS

    dump = dump.one(file)
    objects = object_records(dump, layout)
    found = first_fields(dump, COLLECTIONS).where("number is not null")
    sized = found.join(objects.select(F.col("raw_id").alias("object_id"), "shallow_size"), "object_id")
    arrays = dump.records.where(F.col("tag").isin(OBJECT_ARRAY, PRIMITIVE_ARRAY)).groupBy(F.col("object_id").alias("reference")).agg(F.min_by("length", "position").alias("capacity"))
    return sized.join(arrays, "reference", "left").select("class_name", "shallow_size", F.col("number").alias("size"), "capacity")


def inspect(dump: Dump, raw_id: int) -> list[dict[str, object]]:
    """An object's fields: name, type, value as text; references as ids."""
    row = dump.records.where((F.col("object_id") == raw_id) & (F.col("tag") == INSTANCE_DUMP)).select("file", "position", "id_size", "class_id", "body").join(layouts(dump), ["file", "class_id"], "left").orderBy("position").first()
    if row is None or row.fields is None:
        return []
    out, at = [], 0
    for f in row.fields:
        width = row.id_size if f.type == OBJECT else WIDTHS.get(f.type, 0)
        raw = bytes(row.body[at : at + width])
        if not width or len(raw) < width:
            break
        at += width
        number = int.from_bytes(raw, "big", signed=f.type != OBJECT)
        value = ("null" if not number else str(number)) if f.type == OBJECT else str(bool(number)).lower() if f.type == 4 else f"'{raw.decode('utf-16-be', 'replace')}'" if f.type == 5 else str(struct.unpack(">f" if f.type == 6 else ">d", raw)[0]) if f.type in (6, 7) else str(number)
        out.append({"name": f.name, "type": "object" if f.type == OBJECT else TYPE_NAMES[f.type], "value": value})
    return out
