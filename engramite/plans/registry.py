"""The registered queries over the derived tables, each next to the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import graph, lifecycle, style, vector
from ..sources.star import SQL_EDGES, catalog, derived, order_evidence, remembered, table
from ..streaming import windows
from . import dsl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "1999-01-01 00:00:00"
CUSTOMER = "ent::CUSTOMER#1"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remembered(spark, sf_dir, "ordered", ["orders", "lineitem"], lambda: _ordered_edges(spark, sf_dir))


def _ordered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_evidence(spark, sf_dir).select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("source"), F.lit("ORDERED_FROM").alias("relationship"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("destination"), "weight", "updated_at")


SQL_ORDERED = """
WITH RECURSIVE ordered AS (SELECT 'C' || o_custkey AS source, 'S' || l_suppkey AS destination, CAST(count(*) AS DOUBLE) AS weight, max(o_orderdate) AS updated_at
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
near AS (SELECT a, b, min(weight) AS weight FROM (SELECT source AS a, destination AS b, weight FROM ordered UNION ALL SELECT destination, source, weight FROM ordered) GROUP BY 1, 2)
"""


def _start(edges: DataFrame) -> str:
    """The least source: one row, so that paths start at a node that is there at every size."""
    return edges.agg(F.min("source")).first()[0] or ""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


# --- edges, neighbours, degrees


@query("SELECT o_custkey AS c_custkey, l_suppkey AS s_suppkey, CAST(count(*) AS DOUBLE) AS weight, min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def edge_accumulate(spark, sf_dir):
    return order_evidence(spark, sf_dir)


@query(SQL_EDGES + "SELECT source, relationship, destination, weight FROM edges WHERE relationship IN ('IN_NATION', 'IN_REGION')")
def edge_scan_filtered(spark, sf_dir):
    return graph.scan(catalog(spark, sf_dir, ["IN_NATION", "IN_REGION"]).edges, ["in_nation", "IN_REGION"]).select("source", "relationship", "destination", "weight")


@query("SELECT upper(c_mktsegment) AS source, 'ORDERED' AS relationship, upper(o_orderpriority) AS destination, count(*) AS n, CAST(least(greatest(1.5, count(*) * 0.8), 4.0) AS DOUBLE) AS width FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 3")
def edge_dedupe_counts(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    said = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("source"), F.lit("ordered").alias("relationship"), F.col("o_orderpriority").alias("destination"))
    return graph.duplicate_counts(said)


_FIRST = "(SELECT min(source) FROM edges WHERE relationship = 'SUPPLIES')"
_NEAR = "neighbor, relationship, weight, direction"


def _supplier(edges: DataFrame) -> str:
    return edges.where("relationship = 'SUPPLIES'").agg(F.min("source")).first()[0] or ""


@query(SQL_EDGES + f"SELECT destination AS neighbor, relationship, weight, 'out' AS direction FROM edges WHERE source = {_FIRST}")
def neighbors_out(spark, sf_dir):
    edges = catalog(spark, sf_dir).edges
    return graph.neighbors(edges, _supplier(edges), "out")


@query(SQL_EDGES + f"SELECT source AS neighbor, relationship, weight, 'in' AS direction FROM edges WHERE destination = {_FIRST}")
def neighbors_in(spark, sf_dir):
    edges = catalog(spark, sf_dir).edges
    return graph.neighbors(edges, _supplier(edges), "in")


@query(SQL_EDGES + f"SELECT destination AS neighbor, relationship, weight, 'out' AS direction FROM edges WHERE source = {_FIRST} UNION ALL SELECT source, relationship, weight, 'in' FROM edges WHERE destination = {_FIRST} AND source <> destination")
def neighbors_both(spark, sf_dir):
    edges = catalog(spark, sf_dir).edges
    return graph.neighbors(edges, _supplier(edges), "both")


@query(SQL_EDGES + ", near AS (SELECT source AS a, destination AS b FROM edges UNION SELECT destination, source FROM edges) SELECT a AS id, CAST(least(count(*), 200) AS BIGINT) AS degree, round(least(0.3, ln(1 + least(count(*), 200)) / 20), 9) AS penalty FROM near WHERE a <> b GROUP BY a")
def degree_capped(spark, sf_dir):
    return graph.degrees(derived(spark, sf_dir).edges).select("id", F.col("degree").cast("long").alias("degree"), F.round("penalty", 9).alias("penalty"))


# --- pattern language


def _match(text_):
    kinds = dsl.parse(text_).rel.types or None
    return lambda spark, sf_dir: dsl.compile_query(text_, *(lambda c: (c.nodes, c.node_props, c.edges))(catalog(spark, sf_dir, kinds)))


@query(SQL_EDGES + "SELECT a.name AS c_name, b.name AS s_name, weight AS r_weight FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON destination = b.id JOIN customer ON c_name = a.name WHERE relationship = 'ORDERED_FROM' AND a.label = 'CUSTOMER' AND b.label = 'SUPPLIER' AND c_mktsegment = 'BUILDING' AND weight >= 2 ORDER BY 1, 2, 3 LIMIT 500")
def dsl_single_hop(spark, sf_dir):
    return _match("MATCH (c:CUSTOMER)-[r:ORDERED_FROM]->(s:SUPPLIER) WHERE c.segment='BUILDING' AND r.weight >= 2 RETURN c.name, s.name, r.weight LIMIT 500")(spark, sf_dir)


@query(SQL_EDGES + "SELECT a.name AS a_name, relationship AS r_type, b.name AS b_name FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON destination = b.id WHERE relationship IN ('IN_NATION', 'IN_REGION') AND (b.label = 'REGION' OR NOT a.label = 'CUSTOMER')")
def dsl_type_alternation(spark, sf_dir):
    return _match("MATCH (a)-[r:IN_NATION|IN_REGION]->(b) WHERE b.label='REGION' OR NOT a.label='CUSTOMER' RETURN a.name, r.type, b.name")(spark, sf_dir)


@query(SQL_EDGES + "SELECT b.name AS n_name, a.name AS s_name FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON destination = b.id WHERE relationship = 'IN_NATION' AND a.label = 'SUPPLIER' AND b.label = 'NATION' AND a.name LIKE '%1%'")
def dsl_directed_reverse(spark, sf_dir):
    return _match("MATCH (n:NATION)<-[:IN_NATION]-(s:SUPPLIER) WHERE s.name CONTAINS '1' RETURN n.name, s.name")(spark, sf_dir)


@query(SQL_EDGES + ", step AS (SELECT DISTINCT source, destination FROM edges WHERE relationship IN ('IN_NATION', 'IN_REGION')), two AS (SELECT x.source AS l, y.destination AS r FROM step x JOIN step y ON x.destination = y.source UNION SELECT source, destination FROM step) SELECT a.name AS s_name, b.name AS r_name FROM two JOIN nodes a ON l = a.id JOIN nodes b ON r = b.id WHERE a.label = 'SUPPLIER' AND b.label = 'REGION'")
def dsl_variable_length(spark, sf_dir):
    return _match("MATCH (s:SUPPLIER)-[:IN_NATION|IN_REGION*1..2]->(r:REGION) RETURN s.name, r.name")(spark, sf_dir)


# --- expansion, paths, components

_WALK = ", walk(id, hop) AS (SELECT min(source), 0 FROM ordered UNION SELECT b, hop + 1 FROM walk JOIN near ON a = id WHERE hop < {k}), seen AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id) "


@query(SQL_ORDERED + _WALK.format(k=4) + "SELECT id, CAST(hop AS INTEGER) AS hop FROM seen")
def khop_nodes(spark, sf_dir):
    edges = _ordered(spark, sf_dir)
    return graph.khop_nodes(edges, spark.createDataFrame([(_start(edges),)], "id string"), 4)


@query(SQL_ORDERED + _WALK.format(k=2) + "SELECT source, 'ORDERED_FROM' AS relationship, destination, CAST(min(hop) + 1 AS INTEGER) AS hop FROM ordered JOIN seen ON id = source OR id = destination GROUP BY 1, 3")
def khop_edges(spark, sf_dir):
    edges = _ordered(spark, sf_dir)
    return graph.khop_edges(edges, spark.createDataFrame([(_start(edges),)], "id string"), 3)


@query(SQL_ORDERED + _WALK.format(k=12) + "SELECT id, CAST(hop AS DOUBLE) AS dist FROM seen")
def shortest_path_len(spark, sf_dir):
    edges = _ordered(spark, sf_dir)
    return graph.distances(edges, _start(edges), weighted=False, paths=False)


@query()
def shortest_path_edges(spark, sf_dir):
    edges = _ordered(spark, sf_dir)
    return graph.path_edges(graph.distances(edges, _start(edges)), edges)


@query(SQL_ORDERED + ", walk(id, hop, dist) AS (SELECT min(source), 0, CAST(0 AS DOUBLE) FROM ordered UNION SELECT b, hop + 1, dist + weight FROM walk JOIN near ON a = id WHERE hop < 12) SELECT id, min(dist) AS dist FROM walk GROUP BY id")
def weighted_distance(spark, sf_dir):
    edges = _ordered(spark, sf_dir)
    return graph.distances(edges, _start(edges), paths=False)


_LABELS = ", reach(id, to_) AS (SELECT a, a FROM near UNION SELECT id, b FROM reach JOIN near ON a = to_), comp AS (SELECT id, min(to_) AS cluster_id FROM reach GROUP BY id) "


@query(SQL_ORDERED + _LABELS + "SELECT id, cluster_id FROM comp")
def connected_components(spark, sf_dir):
    return graph.components(_ordered(spark, sf_dir))


@query(SQL_ORDERED + _LABELS + ", sizes AS (SELECT cluster_id, count(*) AS nodes FROM comp GROUP BY 1), links AS (SELECT cluster_id, 2 * count(*) AS connections FROM ordered JOIN comp ON id = source GROUP BY 1) SELECT cluster_id, nodes, CAST(connections AS BIGINT) AS connections FROM sizes JOIN links USING (cluster_id)")
def component_sizes(spark, sf_dir):
    return graph.component_sizes(_ordered(spark, sf_dir))


_RECENCY = f"coalesce(CASE WHEN updated_at <= TIMESTAMP '{AS_OF}' THEN 1 / (1 + floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(updated_at)) / 86400000000.0) / 7) END, 0)"


@query(SQL_ORDERED + f""", deg AS (SELECT a AS id, least(0.3, ln(1 + least(count(*), 200)) / 20) AS penalty FROM near GROUP BY a),
best AS (SELECT destination AS neighbor, max(0.5 + 0.3 * weight + 0.2 * {_RECENCY}) AS s FROM ordered WHERE source = (SELECT min(source) FROM ordered) GROUP BY 1)
SELECT neighbor, round(s - penalty, 6) AS score FROM best JOIN deg ON id = neighbor ORDER BY s - penalty DESC, neighbor LIMIT 10""")
def ranked_neighbors(spark, sf_dir):
    edges = _ordered(spark, sf_dir)
    return graph.ranked_neighbors(edges, _start(edges), F.lit(AS_OF).cast("timestamp")).select("neighbor", F.round("score", 6).alias("score"))


@query(SQL_ORDERED + f""", deg AS (SELECT a AS id, least(0.3, ln(1 + least(count(*), 200)) / 20) AS penalty FROM near GROUP BY a),
steps AS (SELECT x.f, x.t, greatest(0, 0.65 + 0.2 * least(1, weight) + 0.15 * {_RECENCY} - penalty) AS gain FROM (SELECT source AS f, destination AS t, weight, updated_at FROM ordered UNION ALL SELECT destination, source, weight, updated_at FROM ordered) x JOIN deg ON id = t),
one AS (SELECT t AS id, max(gain) AS g FROM steps WHERE f = (SELECT min(source) FROM ordered) GROUP BY 1), two AS (SELECT t AS id, max(g + gain) AS g FROM one JOIN steps ON f = one.id GROUP BY 1)
SELECT id, round(g, 6) AS score FROM two ORDER BY g DESC, id LIMIT 10""")
def traverse_chain(spark, sf_dir):
    edges = _ordered(spark, sf_dir)
    return graph.traverse_chain(edges, _start(edges), ["ORDERED", "ORDERED_FROM"], F.lit(AS_OF).cast("timestamp")).select("id", F.round("score", 6).alias("score"))


@query(SQL_ORDERED + """, e AS (SELECT source || '|ORDERED_FROM|' || destination AS eid, source, destination FROM ordered)
SELECT x.eid AS eid1, y.eid AS eid2, CASE WHEN x.destination = y.source THEN 'chain' WHEN x.destination = y.destination THEN 'converge' ELSE 'diverge' END AS kind,
CASE WHEN x.destination = y.source THEN 0.8 WHEN x.destination = y.destination THEN 0.6 ELSE 0.7 END::DOUBLE AS strength
FROM e x JOIN e y ON x.eid < y.eid AND (x.destination = y.source OR (x.destination = y.destination AND x.source <> y.source) OR (x.source = y.source AND x.destination <> y.destination)) ORDER BY 4 DESC, 1, 2 LIMIT 50""")
def reasoning_chains(spark, sf_dir):
    return graph.reasoning_chains(_ordered(spark, sf_dir), limit=50)


# --- vectors


def _probe(spark, sf_dir, where="true"):
    vectors = table(spark, sf_dir, "embeddings").where(where).select("vec_id", "embedding")
    return vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
_TOP = "WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE {where}), s AS (SELECT q.vec_id AS qid, v.vec_id AS vec_id, {score} AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {way}, vec_id) AS rank FROM s) SELECT qid, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10"
_AB = _DOT.format(a="q.embedding", b="v.embedding")
_COS = f"{_AB} / (sqrt({_DOT.format(a='q.embedding', b='q.embedding')}) * sqrt({_DOT.format(a='v.embedding', b='v.embedding')}))"


def _top(spark, sf_dir, metric, where="true"):
    return vector.top_k(*_probe(spark, sf_dir, where), 10, metric).withColumn("score", F.round("score", 6))


@query(_TOP.format(where="true", score=_COS, way="DESC"))
def vector_topk_cosine(spark, sf_dir):
    return _top(spark, sf_dir, "cosine")


@query(_TOP.format(where="true", score=_AB, way="DESC"))
def vector_topk_ip(spark, sf_dir):
    return _top(spark, sf_dir, "ip")


@query(_TOP.format(where="true", score="list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE))))", way="ASC"))
def vector_topk_l2(spark, sf_dir):
    return _top(spark, sf_dir, "l2")


@query(_TOP.format(where="label IN (1, 2)", score=_COS, way="DESC"))
def vector_topk_filtered(spark, sf_dir):
    return _top(spark, sf_dir, "cosine", "label in (1, 2)")


@query(f"WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS vec_id, {_COS} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS k FROM s) SELECT qid, CASE WHEN score >= 0.38 THEN vec_id END AS \"into\", round(score, 6) AS score FROM r WHERE k = 1")
def vector_nn_dedupe(spark, sf_dir):
    return vector.nearest_merge(*_probe(spark, sf_dir), 0.38).withColumn("score", F.round("score", 6))


@query(f"SELECT vec_id, CAST(80 AS INTEGER) AS width, round(sqrt({_DOT.format(a='embedding', b='embedding')}), 6) AS norm FROM embeddings")
def normalize_pad(spark, sf_dir):
    padded = table(spark, sf_dir, "embeddings").select("vec_id", scoring.padded(F.col("embedding"), 80).alias("v"))
    return padded.select("vec_id", F.size("v").alias("width"), F.round(scoring.norm(F.col("v")), 6).alias("norm"))


# --- ranking

_FEATURES = "SELECT l_orderkey, l_linenumber, l_discount * 10 AS sim, l_linenumber % 4 AS overlap, l_returnflag <> 'R' AS timed, l_tax * 2 AS evidence, l_quantity / 50 AS lexical FROM lineitem"


@query(f"WITH f AS ({_FEATURES}) SELECT l_orderkey, l_linenumber, round(0.6 * sim + 0.2 * least(1.0, overlap / 3.0) + 0.15 * CASE WHEN timed THEN 0.5 ELSE 0 END + 0.05 * least(1.0, evidence) + 0.2 * lexical, 6) AS score FROM f")
def hybrid_score(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem")
    score = scoring.hybrid(F.col("l_discount") * 10, F.col("l_linenumber") % 4, F.col("l_returnflag") != "R", F.col("l_tax") * 2, F.col("l_quantity") / 50)
    return f.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("SELECT l_orderkey, l_linenumber, round(k * o + (1 - k) * q, 6) AS score FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS o, l_quantity / 50 AS q, CASE WHEN l_linenumber % 4 > 1 AND l_quantity / 50 > 0.7 THEN 0.25 WHEN l_linenumber % 4 > 0 AND l_quantity / 50 > 0.4 THEN 0.4 WHEN l_quantity / 50 > 0.2 THEN 0.6 ELSE 0.8 END AS k FROM lineitem)")
def fusion_graph(spark, sf_dir):
    score = scoring.blended(F.col("l_discount") * 10, F.col("l_quantity") / 50, F.col("l_linenumber") % 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query()
def fusion_adaptive(spark, sf_dir):
    """All documents with all benchmark items that share a token with them. Pairs carry counts, never texts: a shared token is
    also contained, and how many are shared is how often the pair is met."""
    read = lambda frame, key, c: frame.where(F.col(key).isNotNull()).select(key, F.monotonically_increasing_id().alias(f"{key}_row"), F.lower(c).alias("low"))
    # a document is in one task from here on, so that its pairs are counted where they are met
    docs = read(table(spark, sf_dir, "documents"), "doc_id", "text").repartition("doc_id_row").withColumn("d", scoring.fusion_words(F.col("low")))
    asked = read(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("q", scoring.fusion_words(F.col("low")))
    tokens = asked.select("item_id_row", F.explode(F.array_distinct("q")).alias("token"))
    traits = asked.select("item_id", "item_id_row", scoring.asks(F.col("low")).alias("asks"), F.size("q").alias("n"))
    said = docs.select("doc_id", "doc_id_row", F.size("d").alias("length"), F.explode(F.array_distinct("d")).alias("token"))
    met = said.join(tokens, "token").groupBy("doc_id_row", "item_id_row", "doc_id", "length").agg(F.count("*").alias("shared"))
    part = lambda k: F.pmod(F.xxhash64("doc_id", "item_id", F.lit(k)), F.lit(1000)) / 1000.0
    score = scoring.adaptive_fusion_of(F.col("asks"), F.col("n"), F.col("shared"), F.lit(True), F.col("length"), part(1), part(2), part(3))
    return met.join(traits, "item_id_row").select("doc_id", "item_id", F.round(score, 6).alias("score"))


@query("WITH h AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY strlen(d.text), doc_id) AS k, b.item_id % 3 = doc_id % 3 AS good FROM benchmark b JOIN documents d ON contains(d.text, b.text)), f AS (SELECT item_id, min(CASE WHEN good THEN k END) AS k FROM h GROUP BY 1) SELECT round(avg(CASE WHEN k <= 5 THEN 1.0 ELSE 0.0 END), 6) AS acc, round(avg(CASE WHEN k <= 5 THEN 1.0 / k ELSE 0.0 END), 6) AS mrr FROM f")
def eval_acc_mrr(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    if bench.count() > vector.MAX_QUERIES:
        raise ValueError("search the questions in blocks")
    hits = table(spark, sf_dir, "documents").join(F.broadcast(bench), F.col("text").contains(F.col("passage")))
    order = Window.partitionBy("item_id").orderBy(F.octet_length("text"), "doc_id")
    first = hits.select("item_id", F.row_number().over(order).alias("k"), (F.col("item_id") % 3 == F.col("doc_id") % 3).alias("good")).groupBy("item_id").agg(F.min(F.when(F.col("good"), F.col("k"))).alias("k"))
    return first.agg(F.round(F.avg(F.when(F.col("k") <= 5, 1.0).otherwise(0.0)), 6).alias("acc"), F.round(F.avg(F.when(F.col("k") <= 5, 1.0 / F.col("k")).otherwise(0.0)), 6).alias("mrr"))


# --- text


@query()
def entity_extract(spark, sf_dir):
    """The dialects differ on words that touch other letters than ASCII ones, so this is tested against Python."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.size(F.array_distinct(text.entities(F.coalesce("text", F.lit(""))))).alias("n"))


@query("SELECT md5(coalesce(text, '')) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def md5_exact_dups(spark, sf_dir):
    hashed = table(spark, sf_dir, "documents").select("doc_id", text.text_hash(F.col("text")).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


_TOLD = "CASE o_orderkey % 5 WHEN 0 THEN 'Met LAST NIGHT on ' WHEN 1 THEN 'this morning ' WHEN 2 THEN 'since last week, ' WHEN 3 THEN 'Last Month: ' ELSE 'then ' END || CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS {s}) ELSE '' END"


@query(f"WITH t AS (SELECT o_orderkey, {_TOLD.format(s='VARCHAR')} AS x FROM orders) SELECT o_orderkey, CASE WHEN lower(x) LIKE '%last night%' THEN 'YESTERDAY' WHEN lower(x) LIKE '%this morning%' THEN 'TODAY' WHEN lower(x) LIKE '%last week%' THEN 'LAST_WEEK' WHEN lower(x) LIKE '%last month%' THEN 'LAST_MONTH' END AS span, nullif(regexp_extract(x, '(20[0-9][0-9]-[0-9][0-9]-[0-9][0-9])', 1), '') AS day FROM t")
def time_tags(spark, sf_dir):
    told = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TOLD.format(s="STRING")).alias("x"))
    return told.select("o_orderkey", text.time_window(F.col("x")).alias("span"), text.date_literal(F.col("x")).alias("day"))


@query("SELECT p_partkey, upper(replace(p_brand, '#', '')) AS s, CASE WHEN p_partkey % 2 = 0 THEN 'LIKES' ELSE 'WORKS_AT' END AS r, upper(p_name) AS d FROM part")
def triplet_parse(spark, sf_dir):
    line = F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.when(F.col("p_partkey") % 2 == 0, " -- likes -- ").otherwise(" — Works at - "), F.col("p_name"))
    found = table(spark, sf_dir, "part").select("p_partkey", text.triplet(line).alias("t")).where("t is not null")
    return found.select("p_partkey", F.col("t.src").alias("s"), text.canonical_relation(F.col("t.rel")).alias("r"), F.col("t.dst").alias("d"))


def _words(spark, sf_dir):
    return style.words(_turns(spark, sf_dir)).groupBy("word").agg(F.count("*").alias("n"))


_SQL_WORDS = "w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[a-z]+')) AS word FROM conversations) GROUP BY 1)"


@query(f"WITH {_SQL_WORDS} SELECT x.word AS a, y.word AS b FROM w x JOIN w y ON x.word < y.word AND abs(length(x.word) - length(y.word)) <= 1 WHERE levenshtein(x.word, y.word) <= 1")
def edit_distance_pairs(spark, sf_dir):
    return style.edit_pairs(_words(spark, sf_dir))


@query()
def elongation_groups(spark, sf_dir):
    return style.elongation_groups(_words(spark, sf_dir)).where("variants > 1")


# --- history


def _history(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "UPDATE").when(F.col("event_id") % 17 == 0, "DELETE").otherwise("ADD")
    at = F.when(kind == "ADD", F.col("ts"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("memory_id"), kind.alias("event"), F.get_json_object("props", "$.k").alias("new_memory"), at.alias("created_at"), F.col("ts").alias("updated_at"))


_SQL_HISTORY = "h AS (SELECT event_id AS id, user_id AS memory_id, CASE WHEN event_type = 'purchase' THEN 'UPDATE' WHEN event_id % 17 = 0 THEN 'DELETE' ELSE 'ADD' END AS event, json_extract_string(props, '$.k') AS new_memory, ts FROM events)"


@query(f"WITH {_SQL_HISTORY} SELECT id, memory_id, event, CAST(row_number() OVER (PARTITION BY memory_id ORDER BY ts, id) AS INTEGER) AS seq FROM h")
def history_timeline(spark, sf_dir):
    return lifecycle.timeline(_history(spark, sf_dir)).select("id", "memory_id", "event", "seq")


@query(f"WITH {_SQL_HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY ts DESC, id DESC) AS k, count(*) OVER (PARTITION BY memory_id) AS n_events FROM h) SELECT memory_id, event, new_memory AS memory, id AS last_id, n_events FROM r WHERE k = 1 AND event <> 'DELETE'")
def history_current_state(spark, sf_dir):
    return lifecycle.current_state(_history(spark, sf_dir))


@query("SELECT c_mktsegment AS source, 'ORDERED' AS relationship, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'FAST' ELSE o_orderpriority END AS destination, CAST(count(*) AS DOUBLE) AS weight FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 3")
def merge_entities(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    edges = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("source"), F.lit("ORDERED").alias("relationship"), F.col("o_orderpriority").alias("destination")).agg(F.count("*").cast("double").alias("weight"))
    fast = orders.select(F.col("o_orderpriority").alias("source_name")).distinct().where("source_name like '1%' or source_name like '2%'").withColumn("target_name", F.lit("FAST"))
    return lifecycle.merge_entities(edges, fast)


# --- style


@query("WITH w AS (SELECT regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[a-z]+') AS w FROM conversations), g AS (SELECT w[i] || ' ' || w[i + 1] AS gram FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w) UNION ALL SELECT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM w)) SELECT gram, count(*) AS n FROM g GROUP BY 1")
def ngram_counts(spark, sf_dir):
    return style.ngrams(_turns(spark, sf_dir), 2).union(style.ngrams(_turns(spark, sf_dir), 3))


@query(f"WITH {_SQL_WORDS}, s AS (SELECT substr(word, 1, 1) AS letter, word, n, round(100.0 * n / sum(n) OVER (PARTITION BY substr(word, 1, 1)), 4) AS pct, row_number() OVER (PARTITION BY substr(word, 1, 1) ORDER BY n DESC, word) AS rank FROM w) SELECT letter, word, n, pct, CAST(rank AS INTEGER) AS rank FROM s WHERE rank <= 5")
def phrase_shares_topn(spark, sf_dir):
    return style.shares(_words(spark, sf_dir).select(F.substring("word", 1, 1).alias("letter"), "word", "n"), "letter", "word", "n", 5)


@query("WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[a-z]+')) AS word FROM conversations), c AS (SELECT conv_id, turn, word, count(*) AS n FROM w GROUP BY 1, 2, 3), l AS (SELECT conv_id, max(turn) AS last FROM c GROUP BY 1) SELECT c.conv_id AS conv_id, word, round(sum(0.1 * pow(0.9, last - turn) * n) + 1e-9, 6) AS score FROM c JOIN l ON c.conv_id = l.conv_id GROUP BY 1, 2")
def session_ema(spark, sf_dir):
    counts = style.words(_turns(spark, sf_dir)).groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))
    return style.session_ema(counts).select("conv_id", "word", F.round(F.col("score") + 1e-9, 6).alias("score"))


@query("SELECT conv_id, turn, role, CAST(back AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 2")
def last_n_messages(spark, sf_dir):
    return style.last_messages(_turns(spark, sf_dir), 2).select("conv_id", "turn", "role", "back")


_SQL_COUNT = "CAST(len(regexp_extract_all(t, '{p}')) AS INTEGER) AS {n}"
_MARKS = {"commas": ",", "semicolons": ";", "colons": ":", "dashes": "[-—]", "curly_quotes": "[“”‘’]", "ellipses": "\\.{3}|…", "multi_exclaim": "!{2,}", "multi_ask": "\\?{2,}", "mixed_marks": "(?:!\\?|\\?!)+", "emojis": "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{1F1E6}-\\x{1F1FF}]", "links": "(?i)https?://\\S+|www\\.\\S+", "handles": "[@#]\\w+"}
_CASED = {"all_caps": "^[A-Z]{2,}$", "title": "^[A-Z][a-z]+$", "lower_case": "^[a-z]{2,}$"}
_SQL_TURNS = "t AS (SELECT conv_id, turn, coalesce(text, '') AS t, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS folded, list_filter(string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)https?://\\S+|www\\.\\S+', ' ', 'g'), '[@#]\\w+', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM conversations), f AS (SELECT *, list_transform(w, lambda x: regexp_replace(x, '[^A-Za-z]', '', 'g')) AS bare, greatest(1, len(regexp_extract_all(folded, '[.!?…] ')) + 1) AS s FROM t)"


@query(f"WITH {_SQL_TURNS} SELECT conv_id, turn, CAST(len(w) AS INTEGER) AS n_tokens, CAST(s AS INTEGER) AS n_sentences, round(len(w)::DOUBLE / s, 6) AS words_per_sentence, round((len(regexp_extract_all(folded, '\\. ')) + CASE WHEN folded LIKE '%.' THEN 1 ELSE 0 END)::DOUBLE / s, 6) AS stating, {', '.join(_SQL_COUNT.format(p=p, n=n) for n, p in _MARKS.items())}, {', '.join(f'CAST(len(list_filter(bare, lambda x: regexp_matches(x, {chr(39)}{p}{chr(39)}))) AS INTEGER) AS {n}' for n, p in _CASED.items())} FROM f")
def message_features(spark, sf_dir):
    found = _turns(spark, sf_dir).select("conv_id", "turn", *text.message_features(F.col("text")))
    return found.select("conv_id", "turn", "n_tokens", "n_sentences", "words_per_sentence", "stating", *_MARKS, *_CASED)


@query()
def message_marks(spark, sf_dir):
    """The features that need what the other dialect's patterns lack; tested against Python."""
    found = _turns(spark, sf_dir).select("conv_id", "turn", *text.message_features(F.col("text")))
    return found.select("conv_id", "turn", "with_oxford", "without_oxford", "oxford_ratio", "low_starts", "small_i", "elongated", "repeats", "keysmashes")


@query()
def profile_lifetime(spark, sf_dir):
    return style.lifetime(_turns(spark, sf_dir))


# --- streams, drained over what is there


def _stream(spark, sf_dir, name):
    """A file stream over the table, which may be one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_events_window(spark, sf_dir):
    return windows.drained(spark, windows.event_windows(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))), ["window_start", "event_type"]).withColumn("total", F.round("total", 4))


@query("SELECT 'U' || user_id AS source, upper(event_type) AS relationship, json_extract_string(props, '$.k') AS destination, CAST(count(*) AS DOUBLE) AS weight FROM events GROUP BY 1, 2, 3")
def stream_edges(spark, sf_dir):
    said = _stream(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("source"), F.upper("event_type").alias("relationship"), F.get_json_object("props", "$.k").alias("destination"), F.lit(1.0).alias("weight"))
    return windows.drained(spark, windows.evidence(said), ["source", "relationship", "destination"])


# --- entity index, aliases, lexicons, blueprint

_LEXICON = {"function": ["the", "of", "and", "to", "in"], "hedge": ["maybe", "perhaps", "some"], "filler": ["er", "haha", "well", "so"]}
_SQL_LEXICON = "(VALUES " + ", ".join(f"('{c}', '{w}')" for c, ws in _LEXICON.items() for w in ws) + ") AS lex(category, word)"
_SQL_SAID = "said AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[a-z]+')) AS word FROM conversations)"
_SQL_HITS = f"{_SQL_SAID}, hits AS (SELECT conv_id, turn, category, count(*) AS n FROM said JOIN {_SQL_LEXICON} USING (word) GROUP BY 1, 2, 3)"
_SIGNATURE, _RARE = "[xzq]|(ness|ment|able|ious)$", "[zq]|y.*y|(ae|oe|ph|rh|ps|mn)"


@query("SELECT s_name AS entity, CASE WHEN s_suppkey % 3 = 0 THEN 'HOUSE ' || s_nationkey ELSE s_name END AS canonical FROM supplier")
def alias_resolve(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    aliases = supplier.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("alias"), F.concat(F.lit("HOUSE "), F.col("s_nationkey").cast("string")).alias("canonical"))
    return lifecycle.resolve_aliases(supplier.select(F.col("s_name").alias("entity")), aliases)


@query()
def entity_index_join(spark, sf_dir):
    index = lifecycle.entity_index(_turns(spark, sf_dir), ["conv_id", "turn"], text.entities(F.col("text")))
    folded = index.select("conv_id", "turn", F.lower("entity").alias("entity")).distinct()
    return folded.groupBy("entity").agg(F.count("*").alias("memories"), F.min("conv_id").alias("first_conv"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'ing') OR contains(lower(text), 'the')")
def delete_by_query_candidates(spark, sf_dir):
    return lifecycle.delete_candidates(_turns(spark, sf_dir), "ing of The").select("conv_id", "turn")


@query(f"WITH {_SQL_HITS} SELECT conv_id, turn, category, n FROM hits")
def lexicon_hits(spark, sf_dir):
    return style.lexicon_hits(_turns(spark, sf_dir), _LEXICON)


@query(f"WITH {_SQL_SAID}, w AS (SELECT conv_id, turn, word, count(*) AS n FROM said WHERE length(word) > 1 GROUP BY 1, 2, 3) SELECT conv_id, turn, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS frequent, CAST(sum(CASE WHEN length(word) > 6 OR regexp_matches(word, '{_SIGNATURE}') THEN n ELSE 0 END) AS BIGINT) AS signature, CAST(sum(CASE WHEN length(word) > 8 OR regexp_matches(word, '{_RARE}') THEN 1 ELSE 0 END) AS BIGINT) AS rare FROM w GROUP BY 1, 2")
def user_word_classes(spark, sf_dir):
    return style.word_classes(_turns(spark, sf_dir), _SIGNATURE, _RARE)


@query(f"WITH {_SQL_HITS}, p AS (SELECT *, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (PARTITION BY conv_id, turn), 2) AS p, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, category) AS k FROM hits) SELECT conv_id, turn, category, round(p + CASE WHEN k = 1 THEN 100 - sum(p) OVER (PARTITION BY conv_id, turn) ELSE 0 END, 2) AS pct FROM p")
def emotion_distribution(spark, sf_dir):
    """Percentages of a pluggable scorer; here the scorer is the lexicon."""
    return style.percentages(style.lexicon_hits(_turns(spark, sf_dir), _LEXICON), "category")


@query(f"WITH {_SQL_HITS}, o AS (SELECT category, round(least(CAST(100 AS DOUBLE), CAST(100 AS DOUBLE) * sum(n) / (SELECT greatest(count(*), 1) FROM conversations)), 2) AS overall FROM hits GROUP BY 1) SELECT category, overall, round(CAST(100 AS DOUBLE) * overall / sum(overall) OVER (), 1) AS share FROM o WHERE overall > 0")
def blueprint_normalized(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return style.blueprint(style.lexicon_hits(turns, _LEXICON), turns)


from . import memory_queries, search_queries, style_queries  # noqa: E402, F401 - they register themselves here
