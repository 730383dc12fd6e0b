"""A pattern language for one relationship, parsed to a small tree and compiled to a DataFrame plan.

``MATCH (a:Label {key:'v'})-[r:T1|T2*min..max]->(b) WHERE a.key = 'v' AND NOT (b.size > 3 OR r.weight < 2) RETURN a, b.key LIMIT n``

``SIMILAR(a, 'text', k, least)`` holds for the nodes that a caller's search finds. ``a.id`` is a node's id. A variable at both
ends asks for loops. ``*0..n`` takes in the start itself, ``*n..`` has no upper end.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import settled

TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(<>|<=|>=|\.\.|->|<-|[()\[\]{}:|*,.=<>-]))")


@dataclass(frozen=True)
class Node:
    var: str
    label: str | None = None
    props: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Rel:
    var: str | None
    types: tuple[str, ...] = ()
    low: int = 1
    high: int | None = 1
    direction: str = "both"


@dataclass(frozen=True)
class Query:
    left: Node
    rel: Rel
    right: Node
    where: tuple | None = None
    returns: tuple[tuple[str, str | None], ...] = ()
    limit: int | None = None


@dataclass
class Parser:
    text: str
    tokens: list = field(default_factory=list)
    at: int = 0

    def __post_init__(self):
        pos, text = 0, self.text.rstrip()
        while pos < len(text):
            if not (m := TOKEN.match(text, pos)):
                raise ValueError(f"can't read {text[pos:pos + 20]!r}")
            self.tokens.append(m[0].strip())
            pos = m.end()

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *want: str) -> str:
        got = self.peek()
        if want and got.upper() not in want:
            raise ValueError(f"expected {' or '.join(want)}, found {got or 'the end'!r}")
        self.at += 1
        return got

    def maybe(self, *want: str) -> bool:
        if self.peek().upper() in want:
            self.at += 1
            return True
        return False

    def literal(self) -> str:
        got = self.take()
        return got[1:-1].replace("''", "'") if got.startswith("'") else got

    def node(self, default: str) -> Node:
        self.take("(")
        var = self.take() if re.match(r"[A-Za-z_]", self.peek()) else default
        label = self.take() if self.maybe(":") else None
        props = []
        if self.maybe("{"):
            while not self.maybe("}"):
                key = self.take()
                self.take(":")
                props.append((key, self.literal()))
                self.maybe(",")
        self.take(")")
        return Node(var, label, tuple(props))

    def rel(self) -> Rel:
        back = self.take("-", "<-") == "<-"
        var, types, low, high = None, [], 1, 1
        if self.maybe("["):
            if re.match(r"[A-Za-z_]", self.peek()):
                var = self.take()
            if self.maybe(":"):
                types.append(self.take().upper())
                while self.maybe("|"):
                    self.maybe(":")
                    types.append(self.take().upper())
            if self.maybe("*"):
                exact = self.peek().isdigit()
                low = high = int(self.take()) if exact else 1
                if self.maybe("..") or not exact:
                    high = int(self.take()) if self.peek().isdigit() else None
            self.take("]")
        forward = self.take("-", "->") == "->"
        return Rel(var, tuple(types), low, high, "both" if back == forward else "in" if back else "out")

    def either(self) -> tuple:
        out = self.both()
        while self.maybe("OR"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.test()
        while self.maybe("AND"):
            out = ("and", out, self.test())
        return out

    def test(self) -> tuple:
        if self.maybe("NOT"):
            return ("not", self.test())
        if self.maybe("("):
            out = self.either()
            self.take(")")
            return out
        if self.peek().upper() == "SIMILAR":
            self.take()
            self.take("(")
            var, more = self.take(), []
            while self.maybe(","):
                more.append(self.literal())
            self.take(")")
            return ("similar", var, more[0], int(more[1]) if len(more) > 1 else 50, float(more[2]) if len(more) > 2 else 0.2)
        var = self.take()
        self.take(".")
        key, op = self.take(), self.take("=", "<>", "<", "<=", ">", ">=", "CONTAINS", "IN").upper()
        if op == "IN":
            self.take("[", "(")
            values = [self.literal()]
            while self.maybe(","):
                values.append(self.literal())
            self.take("]", ")")
            return ("test", var, key, op, tuple(values))
        return ("test", var, key, op, self.literal())

    def query(self) -> Query:
        self.take("MATCH")
        left, rel, right = self.node("_a"), self.rel(), self.node("_b")
        where = self.either() if self.maybe("WHERE") else None
        returns = []
        if self.maybe("RETURN"):
            while True:
                var = self.take()
                returns.append((var, self.take() if self.maybe(".") else None))
                if not self.maybe(","):
                    break
        limit = int(self.take()) if self.maybe("LIMIT") else None
        if self.peek():
            raise ValueError(f"unexpected {self.peek()!r}")
        return Query(left, rel, right, where, tuple(returns), limit)


def parse(text: str) -> Query:
    return Parser(text).query()


def _leaves(tree: tuple | None) -> list[tuple]:
    return [] if tree is None else [tree] if tree[0] in ("test", "similar") else [x for part in tree[1:] for x in _leaves(part)]


def _condition(tree: tuple, column) -> Column:
    if tree[0] == "not":
        return ~_condition(tree[1], column)
    if tree[0] in ("and", "or"):
        a, b = (_condition(x, column) for x in tree[1:])
        return a & b if tree[0] == "and" else a | b
    if tree[0] == "similar":
        return column(tree[1], tree)
    _, var, key, op, value = tree
    c = column(var, key)
    if op == "IN":
        return c.isin(*value)
    if op == "CONTAINS":
        return c.contains(value)
    number = re.fullmatch(r"\d+(\.\d+)?", value) is not None and op not in ("=", "<>")
    left, right = (c.try_cast("double"), F.lit(float(value))) if number else (c.cast("string"), F.lit(value))
    return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def _walks(left: DataFrame, step: DataFrame, low: int, high: int | None, most: int = 1000) -> DataFrame:
    """(l, r, hops): the ends of walks of ``low`` to ``high`` steps with their least number of steps. A pair that was met is
    not walked on from again; without ``high`` it goes on until no new pair is met."""
    front = left.select("l", F.col("l").alias("r"))
    seen = settled(front.withColumn("hops", F.lit(0))) if low == 0 else None
    for n in range(1, (most if high is None else high) + 1):
        front = front.join(step, F.col("r") == F.col("from")).select("l", F.col("to").alias("r")).distinct()
        if n < low:
            continue
        new = front if seen is None else front.join(seen.select("l", "r"), ["l", "r"], "left_anti")
        level = settled(new.withColumn("hops", F.lit(n)))
        seen, front = level if seen is None else seen.union(level), level.select("l", "r")
        if level.isEmpty():
            return seen
    if high is None:
        raise RuntimeError(f"walks did not end in {most} steps")
    return seen


def compile_query(query: Query | str, nodes: DataFrame, node_props: DataFrame, edges: DataFrame, similar=None) -> DataFrame:
    """The plan: typed edge scan, label and property joins on the ends that ask for them, WHERE, RETURN, ordered LIMIT.

    Variable lengths expand breadth first, one join a hop; pairs come with their least number of hops. Without RETURN the
    ends' names, the relationship and the weight are returned. ``similar(text, k, least)`` gives the ids, as a DataFrame of
    one column, that SIMILAR asks for; no hit is no match.
    """
    q = parse(query) if isinstance(query, str) else query
    alike = [x for x in _leaves(q.where) if x[0] == "similar"]
    if alike and similar is None:
        raise ValueError("SIMILAR needs a search")
    used = {(x[1], x[2]) for x in _leaves(q.where) if x[0] == "test"} | {(v, k) for v, k in q.returns if k} | {(n.var, k) for n in (q.left, q.right) for k, _ in n.props}
    scan = edges.where(F.upper("relationship").isin(*q.rel.types)) if q.rel.types else edges
    fwd = scan.select(F.col("source").alias("l"), F.col("destination").alias("r"), "relationship", "weight")
    back = scan.select(F.col("destination").alias("l"), F.col("source").alias("r"), "relationship", "weight")
    hop = {"out": fwd, "in": back, "both": fwd.union(back.where("l <> r"))}[q.rel.direction]

    def end(side: str, node: Node) -> DataFrame:
        own = nodes.where(F.upper("label") == node.label.upper()) if node.label else nodes
        own = own.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name"), F.col("label").alias(f"{side}_label"))
        for key in sorted(k for v, k in used if v == node.var and k not in ("id", "name", "label")):
            value = node_props.where(F.col("key") == key).groupBy(F.col("node_id").alias("_n")).agg(F.max("value").alias(f"{side}_{key}"))
            own = own.join(value, F.col(side) == F.col("_n"), "left").drop("_n")
        for key, value in node.props:
            own = own.where(F.col(side if key == "id" else f"{side}_{key}") == value)
        for i, (_, var, text, k, least) in enumerate(alike):
            if var == node.var:
                hits = similar(text, k, least)
                hits = hits.select(F.col(hits.columns[0]).alias("_hit")).distinct().withColumn(f"{side}_alike{i}", F.lit(True))
                own = own.join(hits, F.col(side) == F.col("_hit"), "left").drop("_hit")
        return own

    left, right = end("l", q.left), end("r", q.right)
    if q.rel.low == q.rel.high == 1:
        found = hop.withColumn("hops", F.lit(1)).join(left, "l").join(right, "r")
    else:
        step = hop.select(F.col("l").alias("from"), F.col("r").alias("to")).distinct()
        found = _walks(left, settled(step), q.rel.low, q.rel.high).withColumn("relationship", F.lit("|".join(q.rel.types) or "*")).withColumn("weight", F.lit(None).cast("double"))
        found = found.join(left, "l").join(right, "r")

    if q.left.var == q.right.var:
        found = found.where("l = r")

    def column(var: str, key: str | tuple | None) -> Column:
        if isinstance(key, tuple):
            side = "l" if var == q.left.var else "r"
            return F.coalesce(F.col(f"{side}_alike{alike.index(key)}"), F.lit(False))
        if key == "id" and var in (q.left.var, q.right.var):
            return F.col("l" if var == q.left.var else "r")
        if var in (q.left.var, q.right.var):
            return F.col(f"{'l' if var == q.left.var else 'r'}_{key or 'name'}")
        if var == q.rel.var:
            return F.col({"type": "relationship", None: "relationship"}.get(key, key))
        raise ValueError(f"unknown variable {var}")

    if q.where:
        found = found.where(_condition(q.where, column))
    names = q.returns or ((q.left.var, "name"), (q.right.var, "name"))
    out = [column(v, k).alias(f"{v}_{k}" if k else v) for v, k in names] + ([] if q.returns else [F.col("relationship"), F.col("weight"), F.col("hops")])
    result = found.select(*out)
    return result.orderBy(*result.columns).limit(q.limit) if q.limit is not None else result
