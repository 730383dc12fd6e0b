"""A property graph, its memories and its history, derived from star-schema and conversation tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEPT: dict[tuple, tuple[str, str]] = {}


def remembered(spark: SparkSession, sf_dir: str, name: str, tables: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from ``tables`` of ``sf_dir``, written to the shared folder the first time the session asks for it and
    read from there afterwards, so that a graph is derived once and not in each hop of each query. It is written as it is
    derived: to lay it out anew would shuffle and sort all of it. When a table's files change it is derived anew."""
    from ..operators.graph import shared_base

    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = lambda at: at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = lambda at: [s for one in fs(at).listStatus(at) for s in (files(one.getPath()) if one.isDirectory() else [(one.getPath().getName(), one.getLen(), one.getModificationTime())])]
    now = str(sorted(s for t in tables for s in files(path(f"{sf_dir}/{t}.parquet"))))
    key = (spark.sparkContext.applicationId, sf_dir, name)
    known, at = _KEPT.get(key, ("", ""))
    if known != now or not fs(path(at)).exists(path(at)):
        at = f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        make().write.parquet(at)
        _KEPT[key] = (now, at)
    return spark.read.parquet(at)


@dataclass(frozen=True)
class GraphCatalog:
    """Plans, not data: every frame is lazy until an operator over it runs."""

    nodes: DataFrame  # id, name, label
    node_props: DataFrame  # node_id, key, value
    edges: DataFrame  # source, relationship, destination, weight, created_at, updated_at


def _id(name):
    return F.concat(F.lit("ent::"), F.upper(name))


def _part():
    return F.concat(F.lit("PART#"), F.col("p_partkey").cast("string"))


#: Rows of line items that a task joins or groups at once, about 100 bytes each.
LINES = 500_000


def tasks(frame: DataFrame) -> int:
    """Partitions for a shuffle of all rows of a table as it is read, which are counted by its files' footers. Spark alone
    joins partitions until there are as few as cores, so that what a task holds grows with the table."""
    return max(frame.sparkSession.sparkContext.defaultParallelism, math.ceil(frame.count() / LINES))


def order_evidence(spark: SparkSession, sf_dir: str, suppliers: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """(c_custkey, s_suppkey, weight, created_at, updated_at): lines a customer ordered from a supplier, accumulated
    before any name is joined to them; of the few ``suppliers(s_suppkey)`` only, where they are given. A customer's rows lie
    together, in ``n`` partitions, else :func:`tasks` of the line items."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    n = n or tasks(lines)
    if suppliers is not None:
        lines = lines.join(F.broadcast(suppliers), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    # orders read from files are many times larger than what Spark takes them for, so they may not be broadcast on that guess
    met = orders.repartition(n, "o_orderkey").hint("merge").join(lines.repartition(n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    dealt = met.select(F.col("o_custkey").alias("c_custkey"), F.col("l_suppkey").alias("s_suppkey"), "o_orderdate").repartition(n, "c_custkey")
    return dealt.groupBy("c_custkey", "s_suppkey").agg(F.count("*").cast("double").alias("weight"), F.min("o_orderdate").alias("created_at"), F.max("o_orderdate").alias("updated_at"))


def named_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`order_evidence` with c_name and s_name. Customers are joined where their evidence lies."""
    n = tasks(table(spark, sf_dir, "lineitem"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(n, "c_custkey")
    return order_evidence(spark, sf_dir, n=n).join(customer.hint("merge"), "c_custkey").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey")


#: Relationships, and the tables that their edges are derived from.
KINDS = {"IN_NATION": ["customer", "supplier", "nation"], "IN_REGION": ["nation", "region"], "ORDERED_FROM": ["customer", "supplier", "orders", "lineitem"], "SUPPLIES": ["supplier", "lineitem"]}


def catalog(spark: SparkSession, sf_dir: str, kinds: Iterable[str] | None = None) -> GraphCatalog:
    """The graph, its edges settled: those of ``kinds`` of relationships where they are given, each derived on its own, so
    that who asks for a few edges of nations does not wait for every line item."""
    wanted = KINDS if kinds is None else {k.upper() for k in kinds}
    nodes, props = _nodes(spark, sf_dir)
    edges = [remembered(spark, sf_dir, f"edges-{k}", KINDS[k], lambda k=k: _edges(spark, sf_dir, k)) for k in KINDS if k in wanted]
    return GraphCatalog(nodes, props, reduce(DataFrame.union, edges) if edges else _edges(spark, sf_dir, "IN_REGION").limit(0))


def derived(spark: SparkSession, sf_dir: str) -> GraphCatalog:
    return GraphCatalog(*_nodes(spark, sf_dir), reduce(DataFrame.union, (_edges(spark, sf_dir, k) for k in KINDS)))


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda name: table(spark, sf_dir, name)
    region, nation, customer, supplier, part = map(t, ("region", "nation", "customer", "supplier", "part"))
    named = [
        region.select(F.col("r_name").alias("name"), F.lit("REGION").alias("label")),
        nation.select(F.col("n_name").alias("name"), F.lit("NATION").alias("label")),
        customer.select(F.col("c_name").alias("name"), F.lit("CUSTOMER").alias("label")),
        supplier.select(F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("label")),
        part.select(_part().alias("name"), F.lit("PART").alias("label")),
    ]
    nodes = reduce(DataFrame.union, named).select(_id("name").alias("id"), "name", "label")
    prop = lambda frame, name, key, value: frame.select(_id(name).alias("node_id"), F.lit(key).alias("key"), F.col(value).cast("string").alias("value"))
    props = [prop(customer, "c_name", "segment", "c_mktsegment"), prop(part.withColumn("n", _part()), "n", "brand", "p_brand"), prop(part.withColumn("n", _part()), "n", "size", "p_size")]
    return nodes, reduce(DataFrame.union, props)


def _edges(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    region, nation, customer, supplier, lineitem = (table(spark, sf_dir, name) if name in KINDS[kind] else None for name in ("region", "nation", "customer", "supplier", "lineitem"))
    none, one = F.lit(None).cast("timestamp"), F.lit(1.0)
    link = lambda frame, a, b, w=one, start=none, end=none: frame.select(_id(a).alias("source"), F.lit(kind).alias("relationship"), _id(b).alias("destination"), w.alias("weight"), start.alias("created_at"), end.alias("updated_at"))
    if kind == "IN_NATION":
        of = link(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "n_name")
        return of.union(link(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "n_name"))
    if kind == "IN_REGION":
        return link(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name")
    if kind == "ORDERED_FROM":
        return link(named_orders(spark, sf_dir), "c_name", "s_name", F.col("weight"), F.col("created_at"), F.col("updated_at"))
    lines = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
    supplied = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).withColumn("n", F.concat(F.lit("PART#"), F.col("l_partkey").cast("string")))
    return link(supplied, "s_name", "n", F.col("weight"))


#: The same edges and nodes for the SQL side.
SQL_EDGES = """
WITH ordered AS (SELECT o_custkey, l_suppkey, CAST(count(*) AS DOUBLE) AS weight, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at
                 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
supplied AS (SELECT l_suppkey, l_partkey, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2),
nodes AS (SELECT 'ent::' || upper(name) AS id, name, label FROM (
    SELECT r_name AS name, 'REGION' AS label FROM region UNION ALL SELECT n_name, 'NATION' FROM nation UNION ALL SELECT c_name, 'CUSTOMER' FROM customer
    UNION ALL SELECT s_name, 'SUPPLIER' FROM supplier UNION ALL SELECT 'PART#' || p_partkey, 'PART' FROM part)),
edges AS (
    SELECT 'ent::' || upper(c_name) AS source, 'IN_NATION' AS relationship, 'ent::' || upper(n_name) AS destination, CAST(1 AS DOUBLE) AS weight, CAST(NULL AS TIMESTAMP) AS updated_at FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'ent::' || upper(s_name), 'IN_NATION', 'ent::' || upper(n_name), 1, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT 'ent::' || upper(n_name), 'IN_REGION', 'ent::' || upper(r_name), 1, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'ent::' || upper(c_name), 'ORDERED_FROM', 'ent::' || upper(s_name), weight, updated_at FROM ordered JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    UNION ALL SELECT 'ent::' || upper(s_name), 'SUPPLIES', 'ent::PART#' || l_partkey, weight, NULL FROM supplied JOIN supplier ON l_suppkey = s_suppkey)
"""
