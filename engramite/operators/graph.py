"""Graph operators over edge tables: neighbours, expansion, paths, components, chains."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shared_base(spark) -> str:
    """The session's reliable checkpoint folder; one of our own only in local mode where none is set."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="engramite-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder."""
    shared_base(df.sparkSession)
    return df.checkpoint(eager=True)


def accumulate(edges: DataFrame) -> DataFrame:
    """Repeated triples become one edge: weights add up, times span, map-side combined."""
    return edges.groupBy("source", "relationship", "destination").agg(F.sum("weight").alias("weight"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def scan(edges: DataFrame, relationships: list[str] | None = None, source: str | None = None, destination: str | None = None) -> DataFrame:
    """Conjunction of equality tests; all given relationship types count, and there is no hidden limit."""
    if relationships:
        edges = edges.where(F.upper("relationship").isin([r.upper() for r in relationships]))
    if source is not None:
        edges = edges.where(F.col("source") == source)
    return edges if destination is None else edges.where(F.col("destination") == destination)


def duplicate_counts(edges: DataFrame) -> DataFrame:
    """Per upper-cased triple: how many edges say it, and the drawing width min(max(1.5, 0.8 n), 4)."""
    n = edges.groupBy(F.upper("source").alias("source"), F.upper("relationship").alias("relationship"), F.upper("destination").alias("destination")).agg(F.count("*").alias("n"))
    return n.withColumn("width", F.least(F.greatest(F.lit(1.5), F.col("n") * 0.8), F.lit(4.0)))


def neighbors(edges: DataFrame, entity: str, direction: str = "both", relationship: str | None = None) -> DataFrame:
    """(neighbor, relationship, weight, direction); under ``both`` a loop counts once."""
    edges = scan(edges, [relationship] if relationship else None)
    out = edges.where(F.col("source") == entity).select(F.col("destination").alias("neighbor"), "relationship", "weight", F.lit("out").alias("direction"))
    into = edges.where(F.col("destination") == entity)
    into = (into.where(F.col("source") != entity) if direction == "both" else into).select(F.col("source").alias("neighbor"), "relationship", "weight", F.lit("in").alias("direction"))
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


def props_json(props: DataFrame) -> DataFrame:
    """(node_id, props) of ``props(node_id, key, value)``: a node's properties as one JSON text, keys in order; null keys and
    values are left out, of a repeated key the greatest value counts."""
    once = props.where("key is not null and value is not null").groupBy("node_id", "key").agg(F.max("value").alias("value"))
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))  # a node's distinct keys
    return once.groupBy("node_id").agg(F.to_json(F.map_from_entries(pairs)).alias("props"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight): each pair of ends both ways once, at its least weight; null and 0 weights count 1."""
    w = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    both = edges.select(F.col("source").alias("a"), F.col("destination").alias("b"), w.alias("weight")).union(edges.select(F.col("destination").alias("a"), F.col("source").alias("b"), w.alias("weight")))
    return both.where("a <> b").groupBy("a", "b").agg(F.min("weight").alias("weight"))


def degrees(edges: DataFrame, cap: int = 200, wanted: DataFrame | None = None) -> DataFrame:
    """(id, degree, penalty): distinct neighbours, capped, and min(0.3, ln(1 + degree) / 20); of the first column of
    ``wanted`` only, where it is given."""
    if wanted is None:  # each pair of ends is made distinct one way only
        once = edges.where("source <> destination").select(F.least("source", "destination").alias("a"), F.greatest("source", "destination").alias("b")).distinct()
        near = once.select(F.explode(F.array("a", "b")).alias("a"))
    else:
        near = undirected(edges).join(wanted.toDF("a").distinct(), "a", "left_semi")
    n = near.groupBy(F.col("a").alias("id")).agg(F.least(F.count("*"), F.lit(cap)).alias("degree"))
    return n.withColumn("penalty", F.least(F.lit(0.3), F.log1p("degree") / 20))


#: Rows of a front that is sent to every task, of an id, a cost and a path of a few ids each; a larger one is joined by shuffling.
FRONT = 20_000


def _met(front: DataFrame, n: int) -> DataFrame:
    """A settled front of ``n`` rows as one side of a join with all edges, which are not shuffled for a small one."""
    return F.broadcast(front) if n <= FRONT else front.hint("merge")


def khop_nodes(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(id, hop): level-synchronous expansion from ``start(id)``. One equi-join a hop; visited nodes by anti-join. Edges are
    read in each hop as they are: to make them distinct and to write them both ways costs more than their repeats."""
    way = lambda a, b: edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    near = way("source", "destination").union(way("destination", "source"))
    seen = front = settled(start.select("id", F.lit(0).alias("hop")).distinct())
    for hop in range(1, hops + 1):
        found = near.join(front, near.a == front.id, "left_semi").select(F.col("b").alias("id")).distinct()
        front = settled(found.join(seen, "id", "left_anti").select("id", F.lit(hop).alias("hop")))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def khop_edges(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Distinct edges met within ``hops`` with the first hop that meets them."""
    seen = khop_nodes(edges, start, max(0, hops - 1))
    reach = lambda end: edges.join(seen.select(F.col("id").alias(end), "hop"), end).select("source", "relationship", "destination", (F.col("hop") + 1).alias("hop"))
    return reach("source").union(reach("destination")).groupBy("source", "relationship", "destination").agg(F.min("hop").alias("hop"))


def distances(edges: DataFrame, start: str, max_rounds: int = 50, weighted: bool = True, inverse: bool = False, paths: bool = True) -> DataFrame:
    """(id, dist, path): least-cost paths from ``start`` by relaxation to a fixpoint; ties go to the lesser path. Without
    ``paths`` only (id, dist): nothing is carried along, and no node is relaxed again for a lesser path.

    Costs are weights (more evidence looks longer), ``inverse`` ones 1 / weight, or 1 an edge. Only nodes improved in
    a round are relaxed in the next."""
    near = undirected(edges)
    if not weighted:
        near = near.withColumn("weight", F.lit(1.0))
    elif inverse:
        near = near.withColumn("weight", 1 / F.col("weight"))
    near = settled(near)
    told = ["dist", "path"] if paths else ["dist"]
    step_to = {"dist": (F.col("dist") + F.col("weight")).alias("dist"), "path": F.concat("path", F.array("b")).alias("path")}
    spark = edges.sparkSession
    best = front = settled(spark.createDataFrame([(start, 0.0, [start])], "id string, dist double, path array<string>").select("id", *told))
    n = 1
    for _ in range(max_rounds):
        step = near.join(_met(front, n), F.col("a") == F.col("id")).select(F.col("b").alias("id"), *(step_to[c] for c in told))
        offered = step.groupBy("id").agg(F.min(F.struct(*told)).alias("s")).select("id", *(f"s.{c}" for c in told))
        old = best.select(F.col("id").alias("old"), F.struct(*told).alias("had"))
        front = settled(offered.join(old, offered.id == F.col("old"), "left").where(F.col("had").isNull() | (F.struct(*told) < F.col("had"))).select("id", *told))
        n = front.count()
        if not n:
            return best
        best = settled(best.join(front.select("id"), "id", "left_anti").unionByName(front))
    raise RuntimeError("distances did not settle")


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, seq, a, b, relationship, weight): each step's forward edge, else the reverse, else CONNECTS at weight 1."""
    steps = paths.select("id", F.posexplode(F.expr("transform(sequence(1, greatest(1, size(path) - 1)), i -> struct(get(path, i - 1) AS a, get(path, i) AS b))")).alias("seq", "s")).select("id", "seq", "s.a", "s.b").where("b is not null")
    # both ways of a pair of ends meet in one row, so that edges and steps are each shuffled once
    way = lambda c, name: F.min(F.when(F.col("source") == F.col(c), F.struct("relationship", "weight"))).alias(name)
    ends = edges.select(F.least("source", "destination").alias("p"), F.greatest("source", "destination").alias("q"), "source", "relationship", "weight")
    one = ends.groupBy("p", "q").agg(way("p", "up"), way("q", "down"))
    met = steps.join(one, (F.least("a", "b") == F.col("p")) & (F.greatest("a", "b") == F.col("q")), "left")
    of = lambda c: F.when(F.col("a") == F.col("p"), F.coalesce(f"up.{c}", f"down.{c}")).otherwise(F.coalesce(f"down.{c}", f"up.{c}"))
    return met.select("id", "seq", "a", "b", F.coalesce(of("relationship"), F.lit("CONNECTS")).alias("relationship"), F.coalesce(of("weight"), F.lit(1.0)).alias("weight"))


def _contracted(links: DataFrame, max_rounds: int) -> DataFrame:
    """(id, to): the least end reachable over ``links(a, b)``, of every end. Each round every node goes to its least neighbour
    and on to where that one went, to the end; the links between where their ends went are those of the next round."""
    of = None
    for _ in range(max_rounds):
        both = links.select("a", "b").union(links.select("b", "a"))
        to = settled(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("to")))
        for _ in range(64):
            ahead = to.select(F.col("id").alias("to"), F.col("to").alias("next"))
            to = settled(to.join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            if to.where("moved").isEmpty():
                break
            to = to.select("id", "to")
        to = to.select("id", "to")
        of = to if of is None else settled(of.join(to.toDF("to", "next"), "to", "left").select("id", F.coalesce("next", "to").alias("to")))
        links = settled(_moved(links, to))
        if links.isEmpty():
            return of
    raise RuntimeError("components did not settle")


def _moved(links: DataFrame, to: DataFrame) -> DataFrame:
    """``links(a, b)`` between where ``to(id, to)`` sends their ends, each once, without loops."""
    one = links.join(to.toDF("a", "na"), "a").select("na", "b").join(to.toDF("b", "nb"), "b").where("na <> nb")
    return one.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, cluster_id): least id reachable. Each node's least and greatest neighbour are contracted first, in rounds on few
    links; all edges are read once more for what that left apart."""
    links = edges.select(F.col("source").alias("a"), F.col("destination").alias("b")).where("a <> b")
    both = links.union(links.select("b", "a"))
    ends = settled(both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")))
    near = _contracted(ends.select("a", F.col("low").alias("b")).union(ends.select("a", "high")), max_rounds)
    rest = settled(_moved(links, near))
    if rest.isEmpty():
        return near.toDF("id", "cluster_id")
    far = _contracted(rest, max_rounds).toDF("to", "far")
    return settled(near.join(far, "to", "left").select("id", F.coalesce("far", "to").alias("cluster_id")))


def component_sizes(edges: DataFrame) -> DataFrame:
    """(cluster_id, nodes, connections); an edge counts from either end."""
    of = settled(components(edges))
    out = edges.where("source <> destination").groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n"))
    inner = out.join(of, "id").groupBy("cluster_id").agg((2 * F.sum("n")).alias("connections"))
    return of.groupBy("cluster_id").agg(F.count("*").alias("nodes")).join(inner, "cluster_id")


def label_match(label, term):
    """1 for an equal or contained label, 0.85 without underscores, else the shared share of letters, 0.6 at most. ``term``
    is a string or a column."""
    want = F.upper(F.lit(term))
    up = F.upper(label)
    bare = lambda c: F.replace(c, F.lit("_"), F.lit(""))
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    share = F.size(F.array_intersect(letters(up), letters(want))) / F.greatest(F.lit(1), F.char_length(want))
    return F.when(up.contains(want) | want.contains(up), 1.0).when(bare(up).contains(bare(want)), 0.85).otherwise(F.least(F.lit(0.6), share))


def recency(at, as_of):
    """max(0, 1 / (1 + days / 7)); 0 without a time."""
    days = (F.unix_micros(as_of) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000.0
    return F.coalesce(F.when(days >= 0, 1 / (1 + F.floor(days) / 7)), F.lit(0.0))


def traverse_chain(edges: DataFrame, start: str, terms: list[str], as_of, limit: int = 10) -> DataFrame:
    """(id, score, path): best walk over one edge a term. Layered: one join a term, the best gain per node kept, which
    is exact because later gains don't depend on the way there. A match under 0.2 is no step."""
    deg = settled(degrees(edges).select(F.col("id").alias("d_id"), "penalty"))
    both = edges.select("source", "relationship", "destination", "weight", "updated_at").union(edges.select(F.col("destination").alias("source"), "relationship", F.col("source").alias("destination"), "weight", "updated_at"))
    now, n = edges.sparkSession.createDataFrame([(start, 0.0, [start])], "id string, score double, path array<string>"), 1
    for term in terms:
        match = label_match(F.col("relationship"), term)
        gain = F.greatest(F.lit(0.0), 0.65 * match + 0.2 * F.least(F.lit(1.0), F.col("weight")) + 0.15 * recency(F.col("updated_at"), as_of) - F.coalesce("penalty", F.lit(0.0)))
        # what the walk is at comes first: only steps from there are weighed
        step = both.join(_met(now, n), F.col("source") == F.col("id")).where(match >= 0.2).join(deg, F.col("destination") == F.col("d_id"), "left")
        next_ = step.select(F.col("destination").alias("id"), (F.col("score") + gain).alias("score"), F.concat("path", F.array("destination")).alias("path"))
        now = settled(next_.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("c"), "path")).alias("s")).select("id", (-F.col("s.c")).alias("score"), F.col("s.path").alias("path")))
        n = now.count()
    return now.orderBy(F.desc("score"), "id").limit(limit)


def ranked_neighbors(edges: DataFrame, entity: str, as_of, limit: int = 10) -> DataFrame:
    """(neighbor, score): 0.5 + 0.3 weight + 0.2 recency, best edge, less the degree penalty once."""
    scored = edges.where((F.col("source") == entity) | (F.col("destination") == entity)).select(F.when(F.col("source") == entity, F.col("destination")).otherwise(F.col("source")).alias("neighbor"), (0.5 + 0.3 * F.col("weight") + 0.2 * recency(F.col("updated_at"), as_of)).alias("s"))
    best = scored.groupBy("neighbor").agg(F.max("s").alias("s"))
    deg = degrees(edges).select(F.col("id").alias("neighbor"), "penalty")
    return best.join(deg, "neighbor", "left").select("neighbor", (F.col("s") - F.coalesce("penalty", F.lit(0.0))).alias("score")).orderBy(F.desc("score"), "neighbor").limit(limit)


def _first_pairs(a_side: DataFrame, b_side: DataFrame, key_a: str, key_b: str, other: str | None, limit: int) -> DataFrame:
    """The first ``limit`` pairs by (eid1, eid2) of edges with eid1 < eid2 that meet at a node, their ``other`` ends unlike.

    Only ``limit`` first edges can be in them: the least ones with any partner, told by the greatest edges at each node.
    They are few, so they are broadcast, and the pairs formed are a few nodes' degrees, never all pairs of a hub."""
    far = F.col(other) if other else F.lit(None).cast("string")
    # edges read from files are many times larger than what Spark takes them for, so no side may be broadcast on that guess
    a_side, b_side = a_side.hint("merge"), b_side.hint("merge")
    most = b_side.groupBy(F.col(key_b).alias("k")).agg(F.max(F.struct("eid", far.alias("o"))).alias("m"))
    if other:
        unlike = b_side.join(most.hint("merge"), F.col(key_b) == F.col("k")).where(F.col(other) != F.col("m.o")).groupBy("k").agg(F.max("eid").alias("next"))
        most = most.join(unlike.hint("merge"), "k", "left")
    bound = F.when(far == F.col("m.o"), F.col("next")).otherwise(F.col("m.eid")) if other else F.col("m.eid")
    first = a_side.join(most.hint("merge"), F.col(key_a) == F.col("k")).where(F.col("eid") < bound).select(F.col("eid").alias("eid1"), F.col(key_a).alias("at"), far.alias("far")).orderBy("eid1").limit(limit)
    met = b_side.join(F.broadcast(first), (F.col(key_b) == F.col("at")) & (F.col("eid1") < F.col("eid")))
    met = met.where(F.col("far") != F.col(other)) if other else met
    return met.select("eid1", F.col("eid").alias("eid2")).orderBy("eid1", "eid2").limit(limit)


def reasoning_chains(edges: DataFrame, limit: int = 3) -> DataFrame:
    """Pairs of edges i < j that chain (d1 = s2, 0.8), converge (d1 = d2, 0.6) or diverge (s1 = s2, 0.7); first rule wins,
    so loops, which chain with whatever they meet, are left to that rule. The rules' strengths are fixed: the first
    ``limit`` pairs of each hold those of all."""
    numbered = settled(edges.select(F.concat_ws("|", "source", "relationship", "destination").alias("eid"), "source", "destination"))
    plain = numbered.where("source <> destination")
    rules = [
        (_first_pairs(numbered, numbered, "destination", "source", None, limit), "chain", 0.8),
        (_first_pairs(numbered, plain, "destination", "destination", "source", limit), "converge", 0.6),
        (_first_pairs(plain, numbered, "source", "source", "destination", limit), "diverge", 0.7),
    ]
    every = reduce(DataFrame.union, (pairs.select("eid1", "eid2", F.lit(name).alias("kind"), F.lit(strength).alias("strength")) for pairs, name, strength in rules))
    return every.orderBy(F.desc("strength"), "eid1", "eid2").limit(limit)


def fan_out(edges: DataFrame, most: int) -> DataFrame:
    """At most ``most`` edges a source, by weight, then relationship and destination: what a hop may follow."""
    order = Window.partitionBy("source").orderBy(F.desc("weight"), "relationship", "destination")
    return edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def touching(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with either end among ``names(name)``, whatever the case; each once."""
    known = names.select(F.lower("name").alias("_known")).distinct()
    at = lambda end: edges.join(known, F.lower(end) == F.col("_known"), "left_semi")
    return at("source").union(at("destination")).distinct()


def first_of_triples(edges: DataFrame, order: str) -> DataFrame:
    """The first row of each triple by ``order``."""
    one = edges.groupBy("source", "relationship", "destination").agg(F.min_by(F.struct(*(F.col(c) for c in edges.columns)), order).alias("e"))
    return one.select("e.*")


def roles(edges: DataFrame) -> DataFrame:
    """(id, as_source, as_destination): the relationships an entity has at either end, sorted."""
    one = lambda end, name: edges.groupBy(F.col(end).alias("id")).agg(F.array_sort(F.collect_set("relationship")).alias(name))
    return one("source", "as_source").join(one("destination", "as_destination"), "id", "full")
