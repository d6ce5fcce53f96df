"""From the syntax tree to DataFrames.

Only what the language means differently from Spark is decided here; pushing filters, pruning columns, choosing joins
and top-k are Catalyst's. Types are known before anything runs, so a comparison that can never hold becomes a false literal.

Rules of the language: LIKE ignores case and takes % at its ends only; an integer literal cuts the fraction of a real
column off before comparing; a condition on an unknown column is false, while selecting one is an error; LIMIT without
ORDER BY ends the scan, that is below any aggregate (LIMIT 0 still lets one row in); a group's key is text; SUM is shown as an integer if it is one; AVG is
rounded to hundredths, half away from zero; MIN and MAX are of numbers only. In a join keys are compared as text, WHERE needs
qualified names, unknown projections vanish, and grouping, aggregates and subqueries don't apply.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import TABLES, Command, Condition, Item, Logic, QueryError, Select, Source, UnknownColumn, conditions, parse

MAX_DEPTH = 3
#: Position of a row in its table; decides ties and what LIMIT keeps.
ORDINAL = "__ordinal"


@dataclass
class Catalog:
    """The four tables as DataFrames with a column ORDINAL, and the graph's commands."""

    tables: dict[str, DataFrame]
    children: object = None  # object_id -> DataFrame of dominator_tree
    commands: object = None  # Command -> DataFrame

    def scan(self, source: Source) -> DataFrame:
        return self.tables[source.table]


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0


def _compare(left: Column, op: str, right: Column) -> Column:
    out = {"=": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]
    return F.coalesce(out, F.lit(False))


def like(column: Column, pattern: str) -> Column:
    low = pattern.lower()
    starts, ends = low.startswith("%"), low.endswith("%")
    core = low.strip("%") if low.strip("%") == "" else low[starts : len(low) - ends]
    if not core:
        return F.coalesce(column.isNotNull(), F.lit(False))
    text = F.lower(column)
    if starts and ends:
        out = text.contains(core)
    else:
        out = text.endswith(core) if starts else text.startswith(core) if ends else text == core
    return F.coalesce(out, F.lit(False))


def _integer(value: int) -> Column:
    return F.lit(value) if value < 2**63 else F.lit(str(value)).cast("decimal(20,0)")


def literal_condition(df: DataFrame, name: str, op: str, value: object) -> Column:
    """A column against a literal."""
    fields = {f.name: f.dataType for f in df.schema}
    if name not in fields:
        return F.lit(False)
    column, kind = F.col(f"`{name}`"), fields[name]
    if op == "like":
        return like(column, str(value)) if isinstance(kind, T.StringType) else F.lit(False)
    if isinstance(value, str):
        return _compare(column, op, F.lit(value)) if isinstance(kind, T.StringType) else F.lit(False)
    if not _numeric(kind):
        return F.lit(False)
    if isinstance(value, int):
        return _compare(column if _whole(kind) else F.expr(f"cast(`{name}` as decimal(38,0))") if value >= 2**63 else column.cast("long"), op, _integer(value))
    return _compare(column.cast("double"), op, F.lit(value))


class Compiler:
    def __init__(self, catalog: Catalog) -> None:
        self.catalog = catalog

    def run(self, query: str) -> DataFrame:
        tree = parse(query)
        if isinstance(tree, Command):
            return self.catalog.commands(tree)
        return self.select(tree)

    def page(self, query: str, page: int = 1, size: int = 500) -> tuple[DataFrame, dict[str, int]]:
        """Rows of one page (from 1; size 0 is 500), and what it is out of."""
        page, size = max(1, page), size or 500
        found = self.run(query)
        total = found.count()
        return found.offset((page - 1) * size).limit(size), {"page": page, "page_size": size, "total_rows": total, "total_pages": max(1, -(-total // size))}

    # conditions

    def condition(self, df: DataFrame, c: Condition, resolve: bool = True) -> Column | tuple[str, DataFrame]:
        """A predicate, or for IN the column and the frame to semi-join."""
        if isinstance(c.value, Select):
            if not resolve or c.column not in df.columns:
                return F.lit(False)
            found = self.select(c.value)
            if c.op == "in":
                return c.column, found.select(F.col(f"`{found.columns[0]}`").alias("__in"))
            rows = found.limit(2).collect()
            if len(rows) != 1 or len(found.columns) != 1:
                raise QueryError("a compared subquery must give one row of one column")
            value = rows[0][0]
            if value is None:
                return F.lit(False)
            value = int(value) if not isinstance(value, (str, float)) else value
            return literal_condition(df, c.column, c.op, value)
        return literal_condition(df, c.column, c.op, c.value)

    def filtered(self, df: DataFrame, where: object, resolve: bool = True) -> DataFrame:
        if where is None:
            return df
        found = conditions(where)
        if resolve and any(isinstance(c.value, Select) for c in found) and len(found) > MAX_DEPTH + 1:
            raise QueryError("conditions beside a subquery are nested too deeply")
        columns: list[Column] = []
        for i, c in enumerate(found):
            made = self.condition(df, c, resolve)
            if isinstance(made, tuple):
                name, inner = made
                text = isinstance(df.schema[name].dataType, T.StringType)
                if text != isinstance(inner.schema[0].dataType, T.StringType):
                    made = F.lit(False)
                else:
                    flag = f"__in{i}"
                    df = df.join(inner.where("__in is not null").distinct().withColumn(flag, F.lit(True)), df[f"`{name}`"] == F.col("__in"), "left").drop("__in")
                    made = F.coalesce(F.col(flag), F.lit(False))
            columns.append(made)
        ops, tree = [], where
        while isinstance(tree, Logic):
            ops.append(tree.op)
            tree = tree.left
        keep = reduce(lambda a, x: a & x[1] if x[0] == "and" else a | x[1], zip(reversed(ops), columns[1:]), columns[0])
        return df.where(keep).drop(*(f"__in{i}" for i in range(len(found))))

    # one table

    def drill(self, s: Select) -> tuple[DataFrame, object]:
        """dominator_tree shows one node's children: of the object_id = n on the left spine of ANDs, else of the super root."""

        def spine(w: object) -> int | None:
            if isinstance(w, Condition):
                return w.value if w.column == "object_id" and w.op == "=" and isinstance(w.value, int) else None
            return spine(w.left) if isinstance(w, Logic) and w.op == "and" else None

        def strip(w: object) -> object:
            if isinstance(w, Logic) and w.op == "and":
                left, right = strip(w.left), strip(w.right)
                return replace(w, left=left, right=right) if left is not None and right is not None else left if right is None else right
            if isinstance(w, Condition) and w.column == "object_id" and w.op == "=" and isinstance(w.value, int):
                return None
            return w

        parent = spine(s.where)
        return self.catalog.children(0 if parent is None else parent), s.where if parent is None else strip(s.where)

    def select(self, s: Select) -> DataFrame:
        if s.join:
            return self.joined(s)
        known = TABLES[s.source.table]
        for item in s.items:
            if not (item.function and item.column == "*") and item.column not in known:
                raise UnknownColumn(item.column)
        if s.group and s.group not in known:
            raise UnknownColumn(s.group)
        df, where = self.drill(s) if s.source.table == "dominator_tree" else (self.catalog.scan(s.source), s.where)
        df = self.filtered(df, where)
        if s.limit is not None and not s.order:
            df = df.orderBy(ORDINAL).limit(max(1, s.limit))
        calls = [i for i in s.items if i.function]
        if s.group:
            if not calls:
                raise QueryError("GROUP BY needs an aggregate")
            if any(not i.function and i.column != s.group for i in s.items):
                raise QueryError("a selected column is neither grouped nor aggregated")
            key = F.col(s.group).cast("string")
            out = df.groupBy(key.alias("__key")).agg(F.min(ORDINAL).alias(ORDINAL), *self.aggregates(df, s.items))
            out = out.select(*(F.col("__key").alias(f"__c{n}") if not i.function else F.col(f"__c{n}") for n, i in enumerate(s.items)), ORDINAL)
            return self.shown(out, s)
        if calls:
            if len(calls) != len(s.items):
                raise QueryError("aggregates and columns need GROUP BY")
            return self.shown(df.agg(*self.aggregates(df, s.items)).withColumn(ORDINAL, F.lit(0)), s)
        items = s.items or tuple(Item(c) for c in known)
        if s.order and s.order[0] not in known and s.order[0] not in {i.shown for i in items}:
            raise UnknownColumn(s.order[0])
        if s.order:
            by = s.order[0] if s.order[0] in known else next(i.column for i in items if i.shown == s.order[0])
            df = self.sorted(df, by, s)
        return df.select(*(F.col(i.column).alias(i.shown) for i in items))

    def sorted(self, df: DataFrame, by: str, s: Select) -> DataFrame:
        key = F.col(f"`{by}`")
        df = df.orderBy(key.desc() if s.order[1] else key.asc(), ORDINAL)
        return df if s.limit is None else df.limit(s.limit)

    def aggregates(self, df: DataFrame, items: tuple[Item, ...]) -> list[Column]:
        kinds = {f.name: f.dataType for f in df.schema}
        out = []
        for n, i in enumerate(items):
            if not i.function:
                continue
            real = F.col(i.column).cast("double") if i.column != "*" and _numeric(kinds[i.column]) else F.lit(None).cast("double")
            if i.function == "count":
                made = F.count("*") if i.column == "*" else F.count(i.column)
            elif i.column == "*":
                made = F.lit(0).cast("long") + F.count("*") * 0
            elif i.function == "sum":
                made = F.sum(real)
                made = made.cast("decimal(38,0)").cast("long") if _whole(kinds[i.column]) and not isinstance(kinds[i.column], T.DecimalType) else made
            elif i.function == "avg":
                made = F.round(F.avg(real) * 100) / 100
            else:
                made = (F.min if i.function == "min" else F.max)(real)
                made = made.cast("decimal(38,0)").cast("long") if _whole(kinds[i.column]) and not isinstance(kinds[i.column], T.DecimalType) else made
            out.append(made.alias(f"__c{n}"))
        return out

    def shown(self, out: DataFrame, s: Select) -> DataFrame:
        if s.order:
            place = next((n for n, i in enumerate(s.items) if i.shown == s.order[0]), None)
            if place is None:
                raise UnknownColumn(s.order[0])
            out = self.sorted(out, f"__c{place}", s)
        return out.select(*(F.col(f"__c{n}").alias(i.shown) for n, i in enumerate(s.items)))

    # two tables

    def joined(self, s: Select) -> DataFrame:
        join = s.join
        sides = []
        for source, name, prefix in ((s.source, join.left, "l"), (join.source, join.right, "r")):
            column = name.split(".", 1)[1] if "." in name and name.split(".", 1)[0] in (s.source.alias, join.source.alias) else name
            if column not in TABLES[source.table]:
                raise UnknownColumn(name)
            full = self.catalog.scan(Source("instances", source.alias) if source.table == "dominator_tree" else source)
            columns = TABLES[source.table]
            sides.append((full.select(*(F.col(c).alias(f"__{prefix}{n}") for n, c in enumerate(columns)), F.col(ORDINAL).alias(f"__{prefix}o")), f"__{prefix}{columns.index(column)}", [(f"__{prefix}{n}", f"{source.alias}.{c}") for n, c in enumerate(columns)]))
        (left, lk, lnames), (right, rk, rnames) = sides
        met = left.join(right, F.col(lk).cast("string") == F.col(rk).cast("string"), join.kind)
        names: dict[str, str] = {}
        for physical, shown in lnames + rnames:
            names.setdefault(shown, physical)

        def physical(name: str) -> str | None:
            return names.get(name) or next((p for p, n in lnames + rnames if n.endswith("." + name)), None)

        where = s.where
        if where is not None:
            ghost = "__none"
            rename = lambda w: replace(w, column=names.get(w.column, ghost)) if isinstance(w, Condition) else replace(w, left=rename(w.left), right=rename(w.right))
            met = self.filtered(met, rename(where), resolve=False)
        if s.limit is not None and not s.order:
            met = met.orderBy("__lo", "__ro").limit(max(1, s.limit))
        if s.order:
            by = physical(s.order[0])
            if by is None:
                raise UnknownColumn(s.order[0])
            met = met.orderBy(F.col(by).desc() if s.order[1] else F.col(by).asc(), "__lo", "__ro")
            met = met if s.limit is None else met.limit(s.limit)
        if not s.items:
            return met.select(*(F.col(p).alias(n) for p, n in lnames + rnames))
        kept = [(p, i.column) for i in s.items if not i.function and (p := physical(i.column))]
        return met.select(*(F.col(p).alias(n) for p, n in kept))
