"""The queries over the driver's tables, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import HeapAnalysis
from .functions import text
from .operators import derive, diff, graph, waste
from .sources import tables
from .store import Rounds
from .streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_KEPT: dict[tuple[str, str], HeapAnalysis] = {}


def heap(spark: SparkSession, sf_dir: str) -> HeapAnalysis:
    """The tables' graph, analyzed once in a session: what is kept are tables in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        line = Rounds(spark).cut(tables.lines(spark, sf_dir))
        _KEPT[key] = HeapAnalysis(tables.nodes(spark, sf_dir, line), tables.edges(spark, sf_dir, line=line), rows=2 * line.count())
    return _KEPT[key]


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---- the graph in SQL: levels are fixed, so a lot's dominator is the deepest level with one distinct ancestor

K = tables.KIND
GRAPH = f"""
lines as (select l_orderkey, l_linenumber, min(row(l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_returnflag)) as r from lineitem group by all),
line as (select l_orderkey, l_linenumber, r[1] as partkey, r[2] as suppkey, cast(r[4] as bigint) as qty, r[6] as flag, {5 * K} + l_orderkey * 8 + l_linenumber + 1 as line_id, {6 * K} + r[1] * 64 + cast(r[4] as bigint) + 1 as lot_id from lines),
nodes as (
  select 0::bigint as nid, 'SuperRoot' as node_type, '' as class_name, 0::bigint as shallow_size
  union all select {1 * K} + r_regionkey + 1, 'Instance', 'shop.Region', 24 from region
  union all select {2 * K} + n_nationkey + 1, 'Instance', 'shop.Nation', 32 from nation
  union all select {3 * K} + c_custkey + 1, 'Instance', 'shop.Customer.' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)), 40 from customer
  union all select {4 * K} + o_orderkey + 1, 'Instance', 'shop.Order.' || o_orderstatus, 48 from orders
  union all select line_id, 'Instance', 'shop.Line.' || flag, 16 + qty from line
  union all select distinct lot_id, 'Array', 'byte[]', 16 + 8 * (partkey % 50) from line
  union all select {7 * K} + s_suppkey + 1, 'Instance', 'shop.Supplier', 56 from supplier),
up as (select lot_id, line_id, {4 * K} + o_orderkey + 1 as order_id, {3 * K} + c_custkey + 1 as customer_id, {2 * K} + n_nationkey + 1 as nation_id, {1 * K} + n_regionkey + 1 as region_id
  from line join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey),
lot as (select lot_id, case when count(distinct line_id) = 1 then min(line_id) when count(distinct order_id) = 1 then min(order_id) when count(distinct customer_id) = 1 then min(customer_id)
  when count(distinct nation_id) = 1 then min(nation_id) when count(distinct region_id) = 1 then min(region_id) else 0 end as idom from up group by lot_id),
parent as (
  select {1 * K} + r_regionkey + 1 as nid, 0::bigint as idom from region
  union all select {2 * K} + n_nationkey + 1, {1 * K} + n_regionkey + 1 from nation
  union all select {3 * K} + c_custkey + 1, {2 * K} + c_nationkey + 1 from customer
  union all select {4 * K} + o_orderkey + 1, {3 * K} + o_custkey + 1 from orders
  union all select line_id, {4 * K} + l_orderkey + 1 from line
  union all select lot_id, idom from lot),
p0 as (select nid, idom as a from parent),
anc as (select nid, nid as a from nodes where nid < {7 * K}
  union select nid, a from p0
  union select x.nid, b.a from p0 x join p0 b on x.a = b.nid
  union select x.nid, c.a from p0 x join p0 b on x.a = b.nid join p0 c on b.a = c.nid
  union select x.nid, d.a from p0 x join p0 b on x.a = b.nid join p0 c on b.a = c.nid join p0 d on c.a = d.nid
  union select x.nid, e.a from p0 x join p0 b on x.a = b.nid join p0 c on b.a = c.nid join p0 d on c.a = d.nid join p0 e on d.a = e.nid
  union select x.nid, f.a from p0 x join p0 b on x.a = b.nid join p0 c on b.a = c.nid join p0 d on c.a = d.nid join p0 e on d.a = e.nid join p0 f on e.a = f.nid),
kept as (select a as nid, sum(shallow_size)::bigint as retained_size from anc join nodes using (nid) group by a),
tree as (select n.nid, node_type, class_name, shallow_size, coalesce(retained_size, 0) as retained_size, case when n.nid = 0 then null else coalesce(idom, 0) end as idom, n.nid < {7 * K} as reachable
  from nodes n left join kept using (nid) left join parent using (nid)),
inst as (select nid as object_id, node_type, class_name, shallow_size, retained_size from tree where node_type in ('Instance', 'Array') and retained_size > 0)
"""


def over(select: str) -> str:
    return f"with {GRAPH.strip()}\n{select}"


HIST = """, topmost as (select t.nid, t.class_name, t.retained_size from tree t where reachable and nid <> 0 and not exists (select 1 from anc join tree u on u.nid = anc.a where anc.nid = t.nid and anc.a <> t.nid and u.class_name = t.class_name and u.nid <> 0)),
hist as (select class_name, count(*) as instance_count, sum(shallow_size)::bigint as shallow_size, coalesce((select sum(retained_size) from topmost p where p.class_name = n.class_name), 0)::bigint as retained_size from nodes n where node_type <> 'SuperRoot' group by class_name)"""


def hist(select: str) -> str:
    return f"with {GRAPH.strip()}{HIST}\n{select}"


# ---- the query language

LANGUAGE = {
    "hql_group_agg": ("SELECT class_name, COUNT(*) AS n, SUM(shallow_size) AS bytes FROM instances WHERE shallow_size >= 48 GROUP BY class_name ORDER BY bytes DESC LIMIT 10", over("select class_name, count(*) as n, sum(shallow_size)::bigint as bytes from inst where shallow_size >= 48 group by 1 order by bytes desc limit 10")),
    "hql_select_filter": ("SELECT object_id, class_name, retained_size FROM instances WHERE retained_size > 2KB AND node_type = 'Instance'", over("select object_id, class_name, retained_size from inst where retained_size > 2048 and node_type = 'Instance'")),
    "hql_select_all": ("SELECT * FROM instances WHERE shallow_size > 400", over("select * from inst where shallow_size > 400")),
    "hql_alias_duplicates": ("SELECT class_name AS name, class_name AS again, shallow_size AS size FROM instances WHERE class_name = 'shop.Nation'", over("select class_name as name, class_name as again, shallow_size as size from inst where class_name = 'shop.Nation'")),
    "hql_like_ci": ("SELECT object_id, class_name FROM instances WHERE class_name LIKE '%CUSTOMER.b%'", over("select object_id, class_name from inst where contains(lower(class_name), 'customer.b')")),
    "hql_like_prefix": ("SELECT class_name, COUNT(*) AS n FROM instances WHERE class_name LIKE 'SHOP.l%' GROUP BY class_name", over("select class_name, count(*) as n from inst where starts_with(lower(class_name), 'shop.l') group by 1")),
    "hql_size_literal": ("SELECT object_id, retained_size FROM instances WHERE retained_size >= 0.5 KB AND retained_size < 1.5KB AND class_name LIKE 'shop.customer%'", over("select object_id, retained_size from inst where retained_size >= 512 and retained_size < 1536 and starts_with(lower(class_name), 'shop.customer')")),
    "hql_and_or_leftassoc": ("SELECT object_id FROM instances WHERE class_name = 'shop.Nation' OR class_name = 'shop.Region' AND retained_size > 100000", over("select object_id from inst where (class_name = 'shop.Nation' or class_name = 'shop.Region') and retained_size > 100000")),
    "hql_unknown_where": ("SELECT object_id FROM instances WHERE colour = 'red' OR class_name = 'shop.Region'", over("select object_id from inst where class_name = 'shop.Region'")),
    "hql_type_mismatch": ("SELECT object_id FROM instances WHERE class_name > 5 OR shallow_size = '24' OR class_name = 'shop.Region'", over("select object_id from inst where class_name = 'shop.Region'")),
    "hql_avg_round": ("SELECT class_name, AVG(retained_size) AS mean FROM instances GROUP BY class_name", over("select class_name, round(avg(retained_size::double) * 100) / 100 as mean from inst group by 1")),
    "hql_min_max": ("SELECT MIN(shallow_size) AS low, MAX(retained_size) AS high, MIN(class_name) AS text, COUNT(class_name) AS n FROM instances", over("select min(shallow_size) as low, max(retained_size) as high, null::double as text, count(class_name) as n from inst")),
    "hql_sum_star": ("SELECT SUM(*) AS zero, COUNT(*) AS n FROM instances", over("select 0::bigint as zero, count(*) as n from inst")),
    "hql_group_key_text": ("SELECT shallow_size, COUNT(*) AS n FROM instances GROUP BY shallow_size", over("select shallow_size::varchar as shallow_size, count(*) as n from inst group by 1")),
    "hql_limit_before_agg": ("SELECT COUNT(*) AS n, SUM(shallow_size) AS bytes FROM instances LIMIT 1000", over("select count(*) as n, sum(shallow_size)::bigint as bytes from (select * from inst order by object_id limit 1000)")),
    "hql_order_limit": ("SELECT object_id, retained_size FROM instances ORDER BY retained_size DESC LIMIT 25", over("select object_id, retained_size from inst order by retained_size desc, object_id limit 25")),
    "hql_order_unprojected": ("SELECT object_id FROM instances ORDER BY shallow_size DESC LIMIT 30", over("select object_id from inst order by shallow_size desc, object_id limit 30")),
    "hql_inner_join": ("SELECT i.object_id, h.instance_count FROM instances i JOIN class_histogram h ON i.class_name = h.class_name WHERE h.instance_count < 50", hist("select i.object_id as \"i.object_id\", h.instance_count as \"h.instance_count\" from inst i join hist h using (class_name) where h.instance_count < 50")),
    "hql_left_join": ("SELECT h.class_name, s.retained_percentage FROM class_histogram h LEFT JOIN leak_suspects s ON h.class_name = s.class_name", None),
    "hql_in_subquery": ("SELECT object_id, class_name FROM instances WHERE class_name IN (SELECT class_name FROM class_histogram WHERE instance_count < 50)", hist("select object_id, class_name from inst where class_name in (select class_name from hist where instance_count < 50)")),
    "hql_scalar_subquery": ("SELECT object_id, retained_size FROM instances WHERE retained_size = (SELECT MAX(retained_size) FROM instances)", over("select object_id, retained_size from inst where retained_size = (select max(retained_size) from inst)")),
    "hql_dominator_drill": (f"SELECT object_id, class_name, retained_size FROM dominator_tree WHERE object_id = {K + 1} AND retained_size > 100", over(f"select nid as object_id, class_name, retained_size from tree where idom = {K + 1} and retained_size > 100")),
    "hql_dominator_root": ("SELECT object_id, class_name FROM dominator_tree", over("select nid as object_id, class_name from tree where idom = 0 and retained_size > 0")),
    "hql_command_children": (f":children {K + 2}", over(f"select nid as object_id, node_type, class_name, shallow_size, retained_size from tree where idom = {K + 2} and retained_size > 0")),
    "hql_command_refs": (f":refs {2 * K + 1}", over(f"select r.nid as object_id, r.node_type, r.class_name, r.shallow_size, r.retained_size from nation join tree r on r.nid = {K} + n_regionkey + 1 where n_nationkey = 0")),
    "hql_command_info": (f":info {2 * K + 3}", over(f"select nid as object_id, node_type, class_name, shallow_size, retained_size, (select count(*) from tree where idom = {2 * K + 3}) as child_count, 1 as referrer_count from tree where nid = {2 * K + 3}")),
}


def _language(statement: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = heap(spark, sf_dir).query(statement)
        return out.withColumns({c: F.col(f"`{c}`").cast("long") for c, kind in out.dtypes if kind == "decimal(20,0)"})

    return run


for _name, (_statement, _sql) in LANGUAGE.items():
    query(_name, _sql)(_language(_statement))


def _long_ids(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if kind == "decimal(20,0)"})


@query("hql_page", over("select object_id, retained_size from (select object_id, retained_size, row_number() over (order by retained_size desc, object_id) as n from inst) where n > 200 and n <= 300"))
def hql_page(spark, sf_dir):
    return _long_ids(heap(spark, sf_dir).page("SELECT object_id, retained_size FROM instances ORDER BY retained_size DESC", 3, 100)[0])


# ---- the graph

@query("graph_first_definition", "select l_orderkey, l_linenumber, min(row(l_partkey, l_suppkey))[1] as l_partkey from lineitem group by all")
def graph_first_definition(spark, sf_dir):
    records = tables.load(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("object_id"), "l_partkey", F.struct("l_partkey", "l_suppkey").alias("position"), F.lit(False).alias("is_root"))
    return graph.first_definitions(records).select("object_id.*", "l_partkey")


@query("graph_edges_dedup", f"select distinct {4 * K} + l_orderkey + 1 as src, {5 * K} + l_orderkey * 8 + l_linenumber + 1 as dst, 2 as label from lineitem")
def graph_edges_dedup(spark, sf_dir):
    return graph.unique_edges(tables.edges(spark, sf_dir)).where(F.col("label") == tables.ELEMENT)


@query("graph_reachable", over("select nid from tree where reachable"))
def graph_reachable(spark, sf_dir):
    return graph.reachable(heap(spark, sf_dir).edges).select("nid")


@query("graph_idom", over("select nid, idom from tree"))
def graph_idom(spark, sf_dir):
    return heap(spark, sf_dir).tree.select("nid", "idom")


@query("graph_idom_cycles")
def graph_idom_cycles(spark, sf_dir):
    line = Rounds(spark).cut(tables.lines(spark, sf_dir))
    h = HeapAnalysis(tables.nodes(spark, sf_dir, line), tables.edges(spark, sf_dir, cycles=True, line=line), rows=2 * line.count())
    return h.tree.select("nid", "idom", "depth", "retained_size")


@query("graph_retained", over("select nid, retained_size, reachable from tree"))
def graph_retained(spark, sf_dir):
    return heap(spark, sf_dir).tree.select("nid", "retained_size", "reachable")


@query("graph_totals", over("select sum(shallow_size)::bigint as total_heap_size, sum(shallow_size) filter (reachable)::bigint as reachable_heap_size, count(*) filter (node_type = 'Instance') as total_instances, 0::bigint as total_classes, count(*) filter (node_type = 'Array') as total_arrays, count(*) filter (idom = 0 and reachable) as top_level_nodes from tree"))
def graph_totals(spark, sf_dir):
    return graph.heap_totals(heap(spark, sf_dir).tree)


@query("graph_children", over(f"select nid as object_id, node_type, class_name, shallow_size, retained_size from tree where idom = {K + 3} and retained_size > 0"))
def graph_children(spark, sf_dir):
    return _long_ids(heap(spark, sf_dir).children(K + 3))


@query("graph_referrers", over(f"select distinct t.nid as object_id, t.node_type, t.class_name, t.shallow_size, t.retained_size from line join tree t on t.nid = line_id where lot_id = (select min(lot_id) from line)"))
def graph_referrers(spark, sf_dir):
    h = heap(spark, sf_dir)
    lot = h.nodes.where(F.col("node_type") == graph.ARRAY).agg(F.min("nid")).first()[0]
    return _long_ids(h.referrers(lot))


@query("graph_outbound", over(f"select nid as object_id, node_type, class_name, shallow_size, retained_size from tree where nid in (select {2 * K} + n_nationkey + 1 from nation where n_regionkey = 1)"))
def graph_outbound(spark, sf_dir):
    return _long_ids(heap(spark, sf_dir).outbound(K + 2))


@query("graph_object_info", over(f"select nid as object_id, node_type, class_name, shallow_size, retained_size, (select count(*) from tree where idom = {K + 2}) as child_count, 1 as referrer_count from tree where nid = {K + 2}"))
def graph_object_info(spark, sf_dir):
    return _long_ids(heap(spark, sf_dir).info(K + 2))


@query("graph_root_path", over(f"select case nid // {K} when 0 then 0 when 1 then 1 when 2 then 2 else 3 end::int as position, nid as object_id, node_type, class_name, shallow_size, retained_size from tree where nid in (select unnest([0, {3 * K + 1}, {2 * K} + c_nationkey + 1, {K} + n_regionkey + 1]) from customer join nation on n_nationkey = c_nationkey where c_custkey = 0)"))
def graph_root_path(spark, sf_dir):
    return _long_ids(heap(spark, sf_dir).root_path(3 * K + 1)).withColumn("position", F.col("position").cast("int"))


@query("graph_subtree_fold", over("""
, c as (select *, row_number() over (partition by idom order by retained_size desc, nid) as k from tree where retained_size > 0 and nid <> 0),
l1 as (select * from c where idom = 0 and k <= 8), l2 as (select c.* from c join l1 on c.idom = l1.nid where c.k <= 8)
select 0 as depth, 0::bigint as object_id, '' as class_name, shallow_size, retained_size from tree where nid = 0
union all select 1, nid, class_name, shallow_size, retained_size from l1
union all select 2, nid, class_name, shallow_size, retained_size from l2
union all select 1, 0, '[' || count(*) || ' others]', sum(shallow_size)::bigint, sum(retained_size)::bigint from c where idom = 0 and k > 8 having count(*) > 0
union all select 2, 0, '[' || count(*) || ' others]', sum(c.shallow_size)::bigint, sum(c.retained_size)::bigint from c join l1 on c.idom = l1.nid where c.k > 8 group by c.idom
""").replace("\n\n, c as", ", c as").replace("\n, c as", ", c as"))
def graph_subtree_fold(spark, sf_dir):
    return _long_ids(heap(spark, sf_dir).subtree(0, 2, 8).select("depth", "object_id", "class_name", "shallow_size", "retained_size"))


@query("graph_accumulation", over("""
, top as (select idom, max(retained_size) as most, min(nid) filter (retained_size = m) as low, max(nid) filter (retained_size = m) as high from (select *, max(retained_size) over (partition by idom) as m from tree where idom is not null and retained_size > 0) group by idom),
step as (select top.*, t.retained_size as own from top join tree t on t.nid = top.idom),
f(here, n) as (select 0::bigint, 0 union all select low, n + 1 from f join step on idom = here where most >= own * 0.15::double),
l(here, n) as (select 0::bigint, 0 union all select high, n + 1 from l join step on idom = here where most > own * 0.15::double)
select (select arg_max(here, n) from f) as first_end, (select arg_max(here, n) from l) as last_end
""").replace("\n\n, top as", ", top as").replace("with ", "with recursive ", 1).strip())
def graph_accumulation(spark, sf_dir):
    h = heap(spark, sf_dir)
    return spark.createDataFrame([(graph.accumulation_point(h.tree, 0, 0.15), graph.accumulation_point(h.tree, 0, 0.15, last=True))], "first_end long, last_end long")


# ---- derived tables

@query("hist_shallow", over("select class_name, count(*) as instance_count, sum(shallow_size)::bigint as shallow_size from nodes where node_type in ('Instance', 'Array') group by 1"))
def hist_shallow(spark, sf_dir):
    return derive.shallow_histogram(tables.nodes(spark, sf_dir))


@query("hist_retained_topmost", hist("select * from hist"))
def hist_retained_topmost(spark, sf_dir):
    return heap(spark, sf_dir).histogram


@query("top_objects", over("select object_id, node_type, class_name, shallow_size, retained_size from inst order by retained_size desc, object_id limit 50"))
def top_objects(spark, sf_dir):
    return _long_ids(derive.top_objects(heap(spark, sf_dir).tree))


TOTAL = "(select sum(shallow_size) from tree where reachable)"


@query("leak_loader", over(f"select class_name, nid as object_id, retained_size, retained_size * 100.0::double / {TOTAL} as retained_percentage from tree where nid // {K} = 1 and retained_size >= {TOTAL} * 5 // 100 order by retained_size desc, nid limit 5"))
def leak_loader(spark, sf_dir):
    h = heap(spark, sf_dir)
    regions = h.nodes.where(F.floor(F.col("nid") / K) == 1).select("nid")
    return _long_ids(derive.loader_suspects(h.tree, regions, h.reachable).select("class_name", "object_id", "retained_size", "retained_percentage"))


@query("leak_class", hist(f"select class_name, 0::bigint as object_id, retained_size, least(retained_size * 100.0::double / {TOTAL}, 99.9) as retained_percentage from hist where retained_size * 100.0 / {TOTAL} > 10 and instance_count > 1"))
def leak_class(spark, sf_dir):
    h = heap(spark, sf_dir)
    return _long_ids(derive.class_suspects(h.histogram, h.reachable).drop("description"))


@query("leak_candidates", over(f"select nid as object_id, retained_size from tree where node_type in ('Instance', 'Array') and retained_size >= {TOTAL} * 10 // 100 order by retained_size desc, nid desc limit 10"))
def leak_candidates(spark, sf_dir):
    h = heap(spark, sf_dir)
    return _long_ids(derive.object_candidates(h.tree, h.reachable).select("object_id", "retained_size"))


SUSPECT_SQL = f""", kinds as (select class_name, 0::bigint as object_id, retained_size, least(retained_size * 100.0::double / {TOTAL}, 99.9) as retained_percentage, printf('%d instances of %s retain %.1f%% of the heap (%.2f MB)', instance_count, class_name, least(retained_size * 100.0::double / {TOTAL}, 99.9), retained_size / 1048576.0::double) as description, row_number() over (order by retained_size desc, class_name) as k from hist where retained_size * 100.0 / {TOTAL} > 10 and instance_count > 1),
cand as (select * from tree where node_type in ('Instance', 'Array') and retained_size >= {TOTAL} * 10 // 100 and retained_size > 0 order by retained_size desc, nid desc limit 10),
singles as (select class_name, nid as object_id, retained_size, retained_size * 100.0::double / {TOTAL} as retained_percentage, printf('Object of %s retains %.1f%% of the heap (%.2f MB)', class_name, retained_size * 100.0::double / {TOTAL}, retained_size / 1048576.0::double) as description, row_number() over (order by retained_size desc, nid desc) as k from cand where class_name not in (select class_name from kinds) qualify row_number() over (partition by class_name order by retained_size desc, nid desc) = 1),
listed as (select * exclude (k), 1 as part, k from kinds union all (select * exclude (k), 2, k from singles order by k limit greatest(0, 10 - (select count(*) from kinds)))),
suspects as (select class_name, object_id, retained_size, retained_percentage, description, (row_number() over (order by retained_percentage desc, part, k) - 1)::int as position from listed)"""


def suspected(select: str) -> str:
    return hist("@").replace("\n@", f"{SUSPECT_SQL}{select if select.startswith(',') else chr(10) + select}")


ORACLE["hql_left_join"] = suspected("select h.class_name as \"h.class_name\", s.retained_percentage as \"s.retained_percentage\" from hist h left join suspects s using (class_name)")


@query("leak_suspects", suspected("select * from suspects"))
def leak_suspects(spark, sf_dir):
    return _long_ids(heap(spark, sf_dir).suspects)


@query("leak_object", over(f""", cand as (select * from tree where node_type in ('Instance', 'Array') and retained_size >= {TOTAL} * 10 // 100 and retained_size > 0 order by retained_size desc, nid desc limit 10)
select class_name, nid as object_id, retained_size, retained_size * 100.0::double / {TOTAL} as retained_percentage, printf('Object of %s retains %.1f%% of the heap (%.2f MB)', class_name, retained_size * 100.0::double / {TOTAL}, retained_size / 1048576.0::double) as description from cand where idom not in (select nid from cand)""").replace("\n, cand as", ", cand as"))
def leak_object(spark, sf_dir):
    return _long_ids(heap(spark, sf_dir).object_suspects())


@query("leak_object_legacy", over(f""", f as (select * from tree where node_type in ('Instance', 'Array') and retained_size * 100 >= {TOTAL} * 5 and retained_size > 0)
select class_name, nid as object_id, retained_size from f where not exists (select 1 from f c where c.idom = f.nid and c.retained_size * 10 > f.retained_size * 9) order by retained_size desc, nid limit 10""").replace("\n, f as", ", f as"))
def leak_object_legacy(spark, sf_dir):
    return _long_ids(heap(spark, sf_dir).object_suspects("legacy").select("class_name", "object_id", "retained_size"))


# ---- waste

@query("waste_dup_strings", """select left(text, 120) as preview, count(*) as count, (count(*) - 1) * (strlen(any_value(text)) + 40) as wasted_bytes, count(*) * (strlen(any_value(text)) + 40) as total_bytes
from documents where text is not null group by text having count(*) > 1 order by wasted_bytes desc, preview, count desc, total_bytes desc limit 50""")
def waste_dup_strings(spark, sf_dir):
    s, b = tables.strings(spark, sf_dir)
    content = b.withColumn("content", F.encode(F.decode("content", "UTF-8"), "UTF-16BE")).withColumn("is_chars", F.lit(True))
    return waste.duplicate_strings(s, content)


COLLECTIONS = "c as (select case when o_orderpriority < '2' then 'java.util.HashMap' when o_orderpriority < '4' then 'java.util.ArrayList' else 'java.util.LinkedHashMap' end as class_name, coalesce(n, 0) as size, 8 + o_custkey % 57 as capacity from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey)"


@query("waste_empty", f"with {COLLECTIONS} select class_name, count(*) as count, count(*) * 48 as wasted_bytes from c where size = 0 group by 1")
def waste_empty(spark, sf_dir):
    return waste.empty_collections(tables.collections(spark, sf_dir))


@query("waste_overalloc", f"with {COLLECTIONS} select class_name, count(*) as count, sum((capacity - size) * 4)::bigint as wasted_bytes, round(avg(size::double / capacity) * 100, 6) as avg_fill_percent from c where size > 0 and capacity > 16 and capacity > 4 * size group by 1")
def waste_overalloc(spark, sf_dir):
    return waste.oversized_collections(tables.collections(spark, sf_dir)).withColumn("avg_fill_percent", F.round("avg_fill_percent", 6))


@query("waste_boxed", over("select class_name, count(*) as count, greatest(sum(shallow_size) - count(*) * case class_name when 'shop.Line.A' then 8 else 4 end, 0)::bigint as wasted_bytes from nodes where class_name in ('shop.Line.A', 'shop.Line.R') group by class_name"))
def waste_boxed(spark, sf_dir):
    return waste.boxed_numbers(tables.nodes(spark, sf_dir), {"shop.Line.A": 8, "shop.Line.R": 4})


@query("waste_totals", f"""with {GRAPH.strip()}, {COLLECTIONS},
d as (select (count(*) - 1) * (strlen(any_value(text)) + 40) as w from documents where text is not null group by text having count(*) > 1 order by w desc, left(text, 120), count(*) desc limit 50),
t as (select (select coalesce(sum(w), 0) from d)::bigint as duplicate_strings_bytes, (select coalesce(count(*) * 48, 0) from c where size = 0)::bigint as empty_collections_bytes, (select coalesce(sum((capacity - size) * 4), 0) from c where size > 0 and capacity > 16 and capacity > 4 * size)::bigint as oversized_collections_bytes, 0::bigint as boxed_numbers_bytes)
select *, duplicate_strings_bytes + empty_collections_bytes + oversized_collections_bytes as total_wasted_bytes, (duplicate_strings_bytes + empty_collections_bytes + oversized_collections_bytes) * 100.0::double / (select sum(shallow_size) from nodes) as wasted_percentage from t""")
def waste_totals(spark, sf_dir):
    h = HeapAnalysis(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir), None, tables.strings(spark, sf_dir), tables.collections(spark, sf_dir))
    return h.waste["totals"]


# ---- comparison and time

SNAPSHOTS = "s as (select 'y' || year(o_orderdate) as snapshot, year(o_orderdate) as taken, 'shop.' || o_orderstatus || '.' || left(o_orderpriority, 1) as class_name, count(*) as instance_count, count(*) * 48 as shallow_size, sum(floor(o_totalprice)::bigint)::bigint as retained_size from orders group by all)"


def _year(spark, sf_dir, year: int) -> DataFrame:
    return tables.snapshots(spark, sf_dir).where(F.col("taken") == year).drop("snapshot", "taken")


@query("diff_histogram", f"""with {SNAPSHOTS}, b as (select * from s where taken = 1996), c as (select * from s where taken = 1997 and class_name <> 'shop.O.1')
select class_name, coalesce(c.instance_count, 0) - coalesce(b.instance_count, 0) as instance_count_delta, coalesce(c.shallow_size, 0) - coalesce(b.shallow_size, 0) as shallow_size_delta, coalesce(c.retained_size, 0) - coalesce(b.retained_size, 0) as retained_size_delta, coalesce(b.retained_size, 0) as baseline_retained_size, coalesce(c.retained_size, 0) as current_retained_size, coalesce(c.instance_count, 0) as current_instance_count,
case when b.class_name is null then 'new' when c.class_name is null then 'removed' when c.retained_size > b.retained_size then 'grew' when c.retained_size < b.retained_size then 'shrank' else 'unchanged' end as change_type from b full join c using (class_name)""".replace("when b.class_name is null", "when b.snapshot is null").replace("when c.class_name is null", "when c.snapshot is null"))
def diff_histogram(spark, sf_dir):
    return diff.histogram_delta(_year(spark, sf_dir, 1996), _year(spark, sf_dir, 1997).where("class_name <> 'shop.O.1'"))


@query("diff_largest", f"with {SNAPSHOTS} select class_name, c.retained_size - b.retained_size as retained_size_delta from (select * from s where taken = 1996) b join (select * from s where taken = 1997) c using (class_name) where c.retained_size <> b.retained_size order by abs(c.retained_size - b.retained_size) desc, class_name limit 10")
def diff_largest(spark, sf_dir):
    return diff.largest_changes(diff.histogram_delta(_year(spark, sf_dir, 1996), _year(spark, sf_dir, 1997))).select("class_name", "retained_size_delta")


def _suspects(spark, sf_dir, year: int) -> DataFrame:
    h = _year(spark, sf_dir, year)
    whole = h.agg(F.sum("retained_size")).first()[0] or 0
    found = derive.class_suspects(h, whole, 6.6)
    return found.withColumn("description", F.concat(F.lit("retained "), "retained_size")).withColumn("position", F.col("retained_size"))


SUSPECTS = "t as (select taken, sum(retained_size) as whole from s group by 1), u as (select s.* from s join t using (taken) where retained_size * 100.0 / whole > 6.6 and instance_count > 1)"


@query("diff_suspects", f"""with {SNAPSHOTS}, {SUSPECTS}, b as (select * from u where taken = 1996), c as (select * from u where taken = 1999)
select class_name, case when b.taken is null then 'new' else 'persisted' end as status, 'retained ' || c.retained_size as description, c.retained_size, c.retained_size - coalesce(b.retained_size, 0) as retained_size_delta, c.retained_size as position from c left join b using (class_name)
union all select class_name, 'resolved', 'Previously: retained ' || retained_size, 0, -retained_size, retained_size from b where class_name not in (select class_name from c)""")
def diff_suspects(spark, sf_dir):
    return diff.suspect_changes(_suspects(spark, sf_dir, 1996), _suspects(spark, sf_dir, 1999))


@query("diff_summary", f"with {SNAPSHOTS} select sum(case when taken = 1997 then instance_count when taken = 1996 then -instance_count end)::bigint as instances_delta, sum(case when taken = 1997 then retained_size when taken = 1996 then -retained_size end)::bigint as bytes_delta from s")
def diff_summary(spark, sf_dir):
    total = lambda y: _year(spark, sf_dir, y).agg(F.sum("instance_count").alias("instances"), F.sum("retained_size").alias("bytes"))
    return diff.summary_delta(total(1996), total(1997))


@query("timeline_top", f"with {SNAPSHOTS} select snapshot, taken, class_name, retained_size, rank from (select *, row_number() over (partition by snapshot order by retained_size desc, class_name)::int as rank from s) where rank <= 3")
def timeline_top(spark, sf_dir):
    return diff.timeline(tables.snapshots(spark, sf_dir), 3).select("snapshot", "taken", "class_name", "retained_size", "rank")


@query("timeline_growth_anomaly", f"""with {SNAPSHOTS}, shots as (select distinct snapshot, taken from s), steps as (select *, row_number() over (order by taken) as step from shots),
grid as (select class_name, step, coalesce(retained_size, 0) as r from (select distinct class_name from s) cross join steps left join s using (class_name, snapshot)),
j as (select *, lag(r) over (partition by class_name order by step) as before from grid),
k as (select *, case when before is null then false when before > 0 then r - before > 0.5 * before else false end as jumped from j),
g as (select class_name, arg_min(r, step) as first_size, arg_max(r, step) as last_size, count(*) as n, coalesce(max(step) filter (not jumped), 1) as calm from k group by 1)
select class_name, first_size, last_size, last_size - first_size as growth, case when first_size > 0 then (last_size - first_size) * 100.0::double / first_size when last_size > 0 then 100.0 else 0.0 end as growth_percent, n >= 3 and n - calm >= 2 as anomaly from g""")
def timeline_growth_anomaly(spark, sf_dir):
    return diff.growth(tables.snapshots(spark, sf_dir))


@query("timeline_lines", f"""with {SNAPSHOTS}, shots as (select distinct snapshot, taken from s), steps as (select *, row_number() over (order by taken)::int as step from shots),
grid as (select class_name, step, coalesce(retained_size, 0) as retained_size from (select distinct class_name from s) cross join steps left join s using (class_name, snapshot)),
g as (select class_name, arg_max(retained_size, step) - arg_min(retained_size, step) as growth from grid group by 1 order by abs(growth) desc, class_name limit 10)
select * from grid where class_name in (select class_name from g)""")
def timeline_lines(spark, sf_dir):
    return diff.class_lines(tables.snapshots(spark, sf_dir))


@query("alerts", f"""with {SNAPSHOTS}, {SUSPECTS}, b as (select * from s where taken = 1996 and class_name <> 'shop.O.1'), c as (select * from s where taken = 1999),
size as (select (select sum(retained_size) from b) as old, (select sum(retained_size) from c) as new),
bu as (select * from u where taken = 1996), cu as (select * from u where taken = 1999),
fresh as (select class_name, row_number() over (order by retained_size, class_name) as k from cu where class_name not in (select class_name from bu)),
gone as (select class_name, row_number() over (order by retained_size, class_name) as k from bu where class_name not in (select class_name from cu)),
burst as (select class_name, c.instance_count - coalesce(b.instance_count, 0) as more, c.retained_size as size, abs(c.retained_size - coalesce(b.retained_size, 0)) as moved from c left join b using (class_name) where more > 0 and more >= c.instance_count - more and c.retained_size > 1048576)
select 'heap-growth' as id, 'warning' as severity, printf('Heap grew by %.0f%% (+%.1f MB)', (new - old) * 100.0::double / old, (new - old) / 1048576.0::double) as message from size where (new - old) * 100.0 / old > 1
union all select 'new-leak-suspects', 'warning', count(*) || ' new leak suspect(s): ' || (select string_agg(class_name, ', ' order by k) from fresh where k <= 3) || case when count(*) > 3 then printf(' and %d more', count(*) - 3) else '' end from fresh having count(*) > 0
union all (select 'class-explosion', 'warning', printf('%s has %d more instances, twice as many or more, and retains %.1f MB', class_name, more, size / 1048576.0::double) from burst order by moved desc, class_name limit 1)
union all select 'resolved-leaks', 'info', count(*) || ' leak suspect(s) resolved: ' || (select string_agg(class_name, ', ' order by k) from gone where k <= 3) || case when count(*) > 3 then printf(' and %d more', count(*) - 3) else '' end from gone having count(*) > 0""")
def alerts(spark, sf_dir):
    b, c = _year(spark, sf_dir, 1996).where("class_name <> 'shop.O.1'"), _year(spark, sf_dir, 1999)
    size = lambda df: df.agg(F.sum("retained_size")).first()[0] or 0
    return diff.alerts(diff.histogram_delta(b, c), diff.suspect_changes(_suspects(spark, sf_dir, 1996), _suspects(spark, sf_dir, 1999)), size(b), size(c), 1.0)


@query("diagnosis", suspected(f""", f as (select position as place, 0 as part, 0 as rule, class_name, case when retained_percentage > 50 then 'critical' else 'warning' end as severity, 'high' as confidence, printf('%s retains %.1f%% of heap', class_name, retained_percentage) as title, case when class_name = 'byte[]' then 'arrays' else 'other' end as advice from suspects where retained_percentage > 20
union all select -retained_size, 1, 0, class_name, 'warning', 'medium', printf('%s occupies %.1f%% of heap', class_name, retained_size * 100.0::double / {TOTAL}), 'arrays' from hist where class_name = 'byte[]' and retained_size * 100.0 / {TOTAL} > 20
union all select -retained_size, 1, 2, class_name, 'info', 'low', printf('%s instances of %s (%.1f%% heap)', format('{{:,}}', instance_count), class_name, retained_size * 100.0::double / {TOTAL}), 'count' from hist where instance_count > 100000 and retained_size * 100.0 / {TOTAL} > 3)
select severity, confidence, title, case when rule = 2 or severity <> 'critical' then advice else advice || ', critical' end as advice from f where part = 0 or not exists (select 1 from f g where (g.part, g.place, g.rule) < (f.part, f.place, f.rule) and contains(g.title, f.class_name))"""))
def diagnosis(spark, sf_dir):
    h = heap(spark, sf_dir)
    return diff.diagnosis(h.histogram, h.suspects, h.reachable)


# ---- functions

@query("class_name_decode", "select p_partkey, repeat('[', (p_partkey % 3)::int) || case p_partkey % 4 when 0 then 'I' when 1 then 'J' else 'L' || replace(p_brand, '#', '/') || ';' end as raw, case p_partkey % 4 when 0 then case when p_partkey % 3 = 0 then 'I' else 'int' end when 1 then case when p_partkey % 3 = 0 then 'J' else 'long' end else case when p_partkey % 3 = 0 then 'L' || replace(p_brand, '#', '.') || ';' else replace(p_brand, '#', '.') end end || repeat('[]', (p_partkey % 3)::int) as name from part")
def class_name_decode(spark, sf_dir):
    key = F.col("p_partkey")
    raw = F.concat(F.repeat(F.lit("["), (key % 3).cast("int")), F.when(key % 4 == 0, "I").when(key % 4 == 1, "J").otherwise(F.concat(F.lit("L"), F.translate("p_brand", "#", "/"), F.lit(";"))))
    return tables.load(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).withColumn("name", text.class_name(F.col("raw")))


@query("hist_percentage", hist(f"select class_name, printf('%.1f', retained_size * 100.0::double / {TOTAL}) || '%' as share from hist"))
def hist_percentage(spark, sf_dir):
    h = heap(spark, sf_dir)
    return h.histogram.select("class_name", text.share_text(F.col("retained_size"), F.lit(h.reachable)).alias("share"))


@query("csv_histogram", hist("select '\"' || class_name || '\",\"' || instance_count || '\",\"' || shallow_size || '\",\"' || retained_size || '\"' as line from hist"))
def csv_histogram(spark, sf_dir):
    return heap(spark, sf_dir).histogram.select(text.csv_line(*(F.col(c) for c in ("class_name", "instance_count", "shallow_size", "retained_size"))).alias("line"))


@query("sizes", "select p_partkey, ((12 + p_size + 7) // 8 * 8)::bigint as instance_size, ((16 + p_size * 4 + 7) // 8 * 8)::bigint as array_size from part")
def sizes(spark, sf_dir):
    return tables.load(spark, sf_dir, "part").select("p_partkey", text.instance_size(F.col("p_size"), F.lit(0)).alias("instance_size"), text.array_size(F.col("p_size"), 4).alias("array_size"))


# ---- live metrics

@query("monitor_heap_pct", "select event_id, case when value > 0 then floor(event_id % 100 * 1000.0 / 100) / 10 end as heap_percent from (select event_id, value from events)")
def monitor_heap_pct(spark, sf_dir):
    e = tables.load(spark, sf_dir, "events")
    points = e.select("event_id", (F.col("event_id") % 100).cast("long").alias("heapUsed"), F.when(F.col("value") > 0, F.lit(100)).otherwise(F.lit(0)).cast("long").alias("heapMax"))
    return points.select("event_id", monitor.heap_percent().alias("heap_percent"))


@query("monitor_latest", "select event_type, event_id from (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc) as n from events) where n <= 5")
def monitor_latest(spark, sf_dir):
    return monitor.latest(tables.load(spark, sf_dir, "events"), "event_type", ("ts", "event_id"), 5).select("event_type", "event_id")


@query("monitor_stream", "select ts::date as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def monitor_stream(spark, sf_dir):
    counted = monitor.windowed_counts(spark, f"{sf_dir}/events.parquet")
    return counted.select(F.col("start").cast("date").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("live_histogram_text", "select o_orderstatus as class_name, count(*) as instances, (count(*) * 48) as bytes from orders group by 1")
def live_histogram_text(spark, sf_dir):
    counts = tables.load(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    lines = counts.select(F.format_string("   1: %12d %12d  %s", F.col("n"), F.col("n") * 48, F.col("o_orderstatus")).alias("value")).unionByName(spark.createDataFrame([(" num     #instances         #bytes  class name",), ("Total        1        2",)], "value string"))
    return monitor.parse_histogram(lines)
