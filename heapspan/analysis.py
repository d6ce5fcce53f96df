"""One analyzed heap: the graph's derived tables, the query language and the navigation commands."""

from __future__ import annotations

import json
import threading
import uuid
from functools import cached_property

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import derive, diff, graph, waste
from .plans.compiler import ORDINAL, Catalog, Compiler
from .plans.dialect import TABLES, Command, QueryError
from .sources import hprof
from .store import Rounds, parts_of


class HeapAnalysis:
    """nodes and edges as in operators.graph; loaders: nid of class loaders; rows: about how many nodes there are, if that is known."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, loaders: DataFrame | None = None, strings: tuple[DataFrame, DataFrame] | None = None, collections: DataFrame | None = None, reference: int = 4, rows: int = 0) -> None:
        self.reference = reference  # bytes of a reference
        self.spark = nodes.sparkSession
        rounds = Rounds(self.spark)
        parts, same = parts_of(self.spark, rows), F.col("nid").cast("decimal(20,0)")
        kept = rounds.dealt(nodes.withColumn("object_id", F.when(F.col("object_id") != same, F.col("object_id"))), "nid", parts)
        self.nodes = kept.withColumn("object_id", F.coalesce("object_id", same))
        self.edges = rounds.dealt(graph.unique_edges(graph.known_edges(edges, self.nodes)), "dst", parts)
        self.loaders = loaders if loaders is not None else self.spark.createDataFrame([], "nid long")
        self._strings, self._collections = strings, collections
        self.dump: hprof.Dump | None = None

    @classmethod
    def of_dump(cls, dump: hprof.Dump, layout: hprof.Layout | None = None, file: str | None = None) -> "HeapAnalysis":
        """With what the waste rules need; name the file if there are several dumps."""
        own = dump.one(file)
        layout = layout or (None if hprof.payload_only(own) else hprof.infer_layout(own))
        nodes, edges, loaders = hprof.as_graph(own, layout, file)
        out = cls(nodes, edges, loaders, hprof.string_values(own, layout, file), hprof.collection_sizes(own, layout, file), layout.reference if layout else 4)
        out.dump = own
        return out

    @classmethod
    def of_tables(cls, nodes: DataFrame, edges: DataFrame, tree: DataFrame, loaders: DataFrame) -> "HeapAnalysis":
        """From tables that were kept: nothing is computed again."""
        out = cls.__new__(cls)
        out.spark, out.nodes, out.edges, out.loaders, out.reference = nodes.sparkSession, nodes, edges, loaders, 4
        out._strings = out._collections = out.dump = None
        out.__dict__["tree"] = tree
        return out

    def stages(self, report) -> "HeapAnalysis":
        """Works through the analysis and calls report(stage, numbers) after each: counts, then the shallow histogram, then the graph.
        Retained sizes are told when they are final, never before."""
        kinds = {r.node_type: r.n for r in self.nodes.groupBy("node_type").agg(F.count("*").alias("n")).collect()}
        report("records", kinds)
        report("shallow", {"classes": derive.shallow_histogram(self.nodes).count(), "bytes": self.total})
        report("references", {"edges": self.edges.count()})
        report("dominators", self.totals)
        report("complete", {"classes": self.histogram.count(), "suspects": self.suspects.count()})
        return self

    @cached_property
    def tree(self) -> DataFrame:
        return graph.dominators(self.nodes, self.edges, lined=False)

    @cached_property
    def totals(self) -> dict[str, int]:
        return graph.heap_totals(self.tree).first().asDict()

    @cached_property
    def total(self) -> int:
        return self.nodes.agg(F.sum("shallow_size")).first()[0] or 0

    @property
    def reachable(self) -> int:
        return self.totals["reachable_heap_size"] or 0

    @cached_property
    def histogram(self) -> DataFrame:
        return Rounds(self.spark).cut(derive.retained_histogram(self.tree, self.total))

    @cached_property
    def suspects(self) -> DataFrame:
        """accumulated() tells where what they retain piles up."""
        return derive.leak_suspects(self.tree, self.histogram, self.loaders, self.reachable)

    def accumulated(self, suspects: DataFrame | None = None) -> DataFrame:
        return derive.accumulations(self.tree, suspects if suspects is not None else self.suspects)

    def class_drill(self, class_name: str, n: int = 200) -> DataFrame:
        return derive.class_drill(self.tree, class_name, n)

    def legacy_suspects(self) -> DataFrame:
        return derive.legacy_suspects(self.tree, self.histogram, self.reachable)

    def object_suspects(self, policy: str = "indexed") -> DataFrame:
        return derive.legacy_object_suspects(self.tree, self.reachable) if policy == "legacy" else derive.object_suspects(self.tree, self.loaders, self.reachable)

    @cached_property
    def waste(self) -> dict[str, DataFrame]:
        """The four kinds and the totals; computed when asked for."""
        none = self.spark.createDataFrame([], "object_id long, backing_id long, shallow_size long, position long"), self.spark.createDataFrame([], "object_id long, content binary, shallow_size long, is_chars boolean")
        full = self._collections if self._collections is not None else self.spark.createDataFrame([], "class_name string, shallow_size long, size long, capacity long")
        kinds = {"duplicate_strings": waste.duplicate_strings(*(self._strings or none)), "empty_collections": waste.empty_collections(full), "oversized_collections": waste.oversized_collections(full, self.reference), "boxed_numbers": waste.boxed_numbers(self.nodes)}
        return kinds | {"totals": waste.totals(*kinds.values(), self.total)}

    # tables of the query language

    def _numbered(self, df: DataFrame, table: str, *order) -> DataFrame:
        return df.select(*TABLES[table], F.row_number().over(Window.orderBy(*order)).alias(ORDINAL))

    @cached_property
    def catalog(self) -> Catalog:
        instances = self.tree.where(F.col("node_type").isin(graph.INSTANCE, graph.ARRAY) & (F.col("retained_size") > 0)).select(*TABLES["instances"], F.col("nid").alias(ORDINAL))
        histogram = self._numbered(self.histogram, "class_histogram", F.desc("retained_size"), "class_name")  # a row a class
        tables = {"instances": instances, "class_histogram": histogram, "leak_suspects": self._numbered(self.suspects, "leak_suspects", "position")}
        return Catalog(tables, lambda object_id: self.children(object_id, ORDINAL), self.command)

    def query(self, text: str) -> DataFrame:
        return Compiler(self.catalog).run(text)

    def page(self, text: str, page: int = 1, size: int = 500) -> tuple[DataFrame, dict[str, int]]:
        return Compiler(self.catalog).page(text, page, size)

    # navigation

    def nid(self, object_id: int) -> int:
        if object_id == 0:
            return 0
        row = self.nodes.where(F.col("object_id") == F.lit(str(object_id)).cast("decimal(20,0)")).select("nid").first()
        if row is None:
            raise QueryError(f"no object {object_id}")
        return row.nid

    def children(self, object_id: int, ordinal: str | None = None) -> DataFrame:
        found = graph.children(self.tree, self.nid(object_id), self.total)
        return found.withColumnRenamed("nid", ordinal) if ordinal else found.drop("nid").orderBy(*graph.by_retained())

    def referrers(self, object_id: int) -> DataFrame:
        return graph.referrers(self.tree, self.edges, self.nid(object_id)).orderBy("nid").drop("nid")

    def outbound(self, object_id: int, limit: int | None = None) -> DataFrame:
        found = graph.outbound(self.tree, self.edges, self.nid(object_id)).orderBy("nid").drop("nid")
        return found if limit is None else found.limit(limit)

    def info(self, object_id: int) -> DataFrame:
        return graph.object_info(self.tree, self.edges, self.nid(object_id))

    def root_path(self, object_id: int, depth: int = 100) -> DataFrame:
        return graph.root_path(self.tree, self.edges, self.nid(object_id), depth)

    def subtree(self, object_id: int = 0, depth: int = 6, width: int = 20) -> DataFrame:
        return graph.subtree(self.tree, self.nid(object_id), depth, width)

    def command(self, c: Command) -> DataFrame:
        if c.name == "path":
            return self.root_path(c.object_id).drop("position")
        if c.name == "info":
            return self.info(c.object_id)
        if c.name == "children":
            found = self.children(c.object_id)
            if found.isEmpty():
                raise QueryError(f"object {c.object_id} has no children")
            return found
        try:
            return self.referrers(c.object_id)
        except QueryError:
            return self.tree.limit(0).select(*graph.REPORT)

    # bounded investigation

    LIMITS = {"rows": 32, "nodes": 4096, "edges": 16_384, "depth": 32, "bytes": 65_536, "seconds": 60}

    def investigate(self, operation: str, object_id: str) -> DataFrame:
        """One of object, fields, outbound, referrers, children, root_path of a positive decimal id, at most LIMITS rows; class names are
        cut at 256. A node with more edges or children than LIMITS, an answer that is longer and a job that takes too long are errors."""
        if not isinstance(object_id, str) or not object_id.isdecimal() or not object_id.isascii() or object_id.startswith("0") or int(object_id) >= 2**64:
            raise QueryError("an object id is a positive decimal number without leading zeros")
        call = {"object": self.info, "fields": self.fields, "outbound": self.outbound, "referrers": self.referrers, "children": self.children, "root_path": lambda i: self.root_path(i, self.LIMITS["depth"])}.get(operation)
        if call is None:
            raise QueryError(f"unknown operation {operation}")
        sc, group = self.spark.sparkContext, f"investigation-{uuid.uuid4().hex}"
        timer = threading.Timer(self.LIMITS["seconds"], lambda: sc.cancelJobGroup(group))
        sc.setJobGroup(group, f"{operation} of {object_id}", True)
        timer.start()
        try:
            nid = self.nid(int(object_id))
            for side, kind in (("src", "outbound"), ("dst", "referrers")):
                if operation == kind and self.edges.where(F.col(side) == nid).limit(self.LIMITS["edges"] + 1).count() > self.LIMITS["edges"]:
                    raise QueryError("too many edges")
            if operation == "children" and self.tree.where(F.col("idom") == nid).limit(self.LIMITS["nodes"] + 1).count() > self.LIMITS["nodes"]:
                raise QueryError("too many children")
            found = call(int(object_id)).limit(self.LIMITS["rows"])
            if "class_name" in found.columns:
                found = found.withColumn("class_name", F.substring("class_name", 1, 256))
            rows = found.collect()
        except PySparkException as e:
            raise QueryError("the investigation took too long") if "cancelled" in str(e) else e
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)
        if len(json.dumps([r.asDict() for r in rows], default=str).encode()) > self.LIMITS["bytes"]:
            raise QueryError("the answer is too long")
        return self.spark.createDataFrame(rows, found.schema)

    def fields(self, object_id: int) -> DataFrame:
        """An instance's fields: name, type, value as text, and of references the class name and shallow size of what they refer to."""
        if self.dump is None:
            raise QueryError("the heap is not from a dump")
        found = hprof.inspect(self.dump, object_id if object_id < 2**63 else object_id - 2**64)
        rows = self.spark.createDataFrame([(n, f["name"], f["type"], f["value"]) for n, f in enumerate(found)], "place int, name string, type string, value string")
        known = self.nodes.select(F.col("object_id").cast("string").alias("value"), F.lit("object").alias("type"), F.col("class_name").alias("target_class"), F.col("shallow_size").alias("target_size"))
        return rows.join(known, ["value", "type"], "left").select("place", "name", "type", "value", "target_class", "target_size").orderBy("place")

    # comparison and export

    def summary(self) -> DataFrame:
        return self.spark.createDataFrame([self.totals])

    def compare(self, current: "HeapAnalysis") -> dict[str, DataFrame | None]:
        has = self._strings is not None and current._strings is not None
        return {"histogram": diff.histogram_delta(self.histogram, current.histogram), "suspects": diff.suspect_changes(self.suspects, current.suspects), "summary": diff.summary_delta(self.summary(), current.summary()), "waste": diff.waste_delta(self.waste["totals"], current.waste["totals"]) if has else None}

    def report(self, rows: int = 50, waste: bool = False) -> dict[str, object]:
        """A document of all sections, each of at most `rows` (1 to 10000) rows; ids as text. Waste is null unless it is asked for."""
        if not 1 <= rows <= 10_000:
            raise ValueError("rows must be from 1 to 10000")
        sections = {"histogram": self.histogram.orderBy(F.desc("retained_size"), "class_name"), "suspects": self.suspects.drop("position").orderBy(F.desc("retained_size"), "class_name", "object_id"), "object_suspects": self.object_suspects(), "top_objects": derive.top_objects(self.tree, rows + 1, self.total)}
        plain = lambda r: {k: str(v) if k == "object_id" else v for k, v in r.asDict().items()}
        out: dict[str, object] = {"summary": self.totals, "waste": None}
        for name, df in sections.items():
            found = [plain(r) for r in df.limit(rows + 1).collect()]
            out[name], out[f"{name}_truncated"] = found[:rows], len(found) > rows
        if waste:
            out["waste"] = {name: [plain(r) for r in df.limit(rows).collect()] for name, df in self.waste.items()}
        return out

    def export_json(self, path: str, rows: int = 100) -> None:
        """The report as a file; one that is there is replaced."""
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.report(rows), f)

    VERSION, MOST_BYTES = 1, 8 * 1024 * 1024

    def write_report(self, path: str, rows: int = 50, waste: bool = False, form: str = "json") -> None:
        """The report in an envelope that names its version, as JSON or as text; the file must be new and stays under 8 MiB."""
        document = self.report(rows, waste)
        if form == "json":
            body = json.dumps({"version": self.VERSION, "kind": "analysis", "report": document}, default=str)
        else:
            lines = [f"heap analysis, version {self.VERSION}", *(f"{k}: {v}" for k, v in document["summary"].items())]
            for name, part in document.items():
                if isinstance(part, list):
                    lines += ["", f"{name}{' (cut)' if document[f'{name}_truncated'] else ''}", *("  " + "  ".join(str(v) for v in r.values()) for r in part)]
            body = "\n".join(lines) + "\n"
        if len(body.encode()) > self.MOST_BYTES:
            raise ValueError("the report is too large")
        with open(path, "x", encoding="utf-8") as f:
            f.write(body)
