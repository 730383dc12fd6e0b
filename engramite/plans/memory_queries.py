"""Registered queries over memories derived from the star schema: what messages ask, what facts say, how the store changes and
what retrieval finds. Each stands next to its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranking, scoring, talk, text
from ..operators import graph, retrieval, search, store, vector
from ..sources.star import SQL_EDGES, catalog, derived, named_orders, order_evidence, table
from . import dsl
from .registry import _COS, query

# --- what a message asks for and says of its speaker

_ASKED = "CASE c_custkey % 8 WHEN 0 THEN '@store ' || c_name || ' called' WHEN 1 THEN '@UPDATEQ who is ' || c_name WHEN 2 THEN '@update x' WHEN 3 THEN 'haha OK' WHEN 4 THEN 'abc' WHEN 5 THEN 'what happened when ' || c_name || ' and the others of this nation came to the store' WHEN 6 THEN 'my name is ' || c_mktsegment || '. I am ' || CAST(c_custkey % 170 AS {s}) || ' years old, I live in ' || c_mktsegment || '.' ELSE 'call you Bob: the connection between ' || c_name || chr(39) || 's sisters and Al' || chr(39) || 's dog' END"


def _asked(spark, sf_dir):
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.select("c_custkey", F.expr(_ASKED.format(s="STRING")).alias("x"))


_SQL_ASKED = f"WITH a AS (SELECT c_custkey, {_ASKED.format(s='VARCHAR')} AS x FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_SQL_WORDS = "list_filter(string_split_regex(lower(x), '\\s+'), lambda w: w <> '')"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(_SQL_ASKED + " SELECT c_custkey, CASE WHEN lower(x) LIKE '@store%' THEN 'store' WHEN lower(x) LIKE '@updateq%' THEN 'updateq' WHEN lower(x) LIKE '@update%' THEN 'update' ELSE 'chat' END AS command, trim(regexp_replace(x, '^@(store|updateq|update)', '', 'i')) AS argument FROM a")
def command_routes(spark, sf_dir):
    return _asked(spark, sf_dir).select("c_custkey", talk.command(F.col("x")).alias("command"), talk.argument(F.col("x")).alias("argument"))


@query(_SQL_ASKED + f" SELECT c_custkey, CASE WHEN len({_SQL_WORDS}) <= 2 AND len(list_filter({_SQL_WORDS}, lambda w: NOT list_contains({_LIST(talk.FILLERS)}, w))) = 0 THEN 'greeting_filler' WHEN length(trim(x)) < 4 THEN 'too_short' END AS skipped FROM a")
def query_gate(spark, sf_dir):
    return _asked(spark, sf_dir).select("c_custkey", talk.gate(F.col("x")).alias("skipped"))


@query(_SQL_ASKED + f", w AS (SELECT c_custkey, {_SQL_WORDS} AS w FROM a) SELECT c_custkey, CAST(CASE WHEN list_has_any(w, {_LIST(talk.TIMING)}) THEN 25 ELSE 40 END + CASE WHEN len(w) > 8 THEN 10 ELSE 0 END AS INTEGER) AS vector_limit, CAST(5 AS INTEGER) AS hops, CAST(CASE WHEN list_has_any(w, {_LIST(talk.RELATING)}) THEN 12 ELSE 8 END AS INTEGER) AS paths, CAST(CASE WHEN len(w) < 3 THEN 0.35 ELSE 0.25 END AS DOUBLE) AS threshold, len(w) <= 8 AS expand FROM w")
def search_strategy(spark, sf_dir):
    return _asked(spark, sf_dir).select("c_custkey", talk.strategy(F.col("x")).alias("s")).select("c_custkey", "s.*")


@query(_SQL_ASKED + " SELECT c_custkey, CASE WHEN c_custkey % 8 = 6 THEN regexp_extract(upper(x), 'MY NAME IS ([A-Z]+)', 1) END AS own_name, CASE WHEN c_custkey % 8 = 7 THEN 'BOB' END AS your_name, CASE WHEN c_custkey % 8 = 6 AND c_custkey % 170 BETWEEN 1 AND 150 THEN CAST(c_custkey % 170 AS INTEGER) END AS age, CASE WHEN c_custkey % 8 = 6 THEN upper(regexp_extract(x, 'live in ([A-Z]+)', 1)) END AS place FROM a")
def profile_facts(spark, sf_dir):
    x = F.col("x")
    found = _asked(spark, sf_dir).select("c_custkey", talk.own_name(x).alias("own_name"), talk.your_name(x).alias("your_name"), talk.age(x).alias("age"), talk.place(x).alias("place"))
    return found.select("c_custkey", "own_name", "your_name", "age", F.nullif("place", F.lit("")).alias("place"))


@query(_SQL_ASKED + " SELECT c_custkey, CASE WHEN c_custkey % 8 = 7 THEN 'SISTER,DOG' ELSE '' END AS terms FROM a")
def possessive_terms(spark, sf_dir):
    return _asked(spark, sf_dir).select("c_custkey", F.array_join(talk.possessive_terms(F.col("x")), ",").alias("terms"))


# --- facts and their ingestion

_FACTS = "'<think>a - b' || chr(10) || '- c</think>Output: x - y - z' || chr(10) || s_name || ' - located at - ' || n_name || chr(10) || 'sup ' || CAST(s_suppkey % 7 AS {s}) || ' – MARRIED – x1' || chr(10) || 'A b! - was-likes - c - d' || chr(10) || 'no fact here' || chr(10) || 'sup ' || CAST(s_suppkey % 7 AS {s}) || ' - the - you'"
_SQL_NAME = "upper(trim(regexp_replace(s_name, '[^a-zA-Z0-9_\\s]+', '', 'g')))"
_SQL_FACTS = f"WITH f AS (SELECT s_suppkey AS memory_id, {_SQL_NAME} AS src, 'LOCATED_AT' AS rel, upper(n_name) AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, 'SUP ' || (s_suppkey % 7), 'MARRIED_TO', 'X1' FROM supplier UNION ALL SELECT s_suppkey, 'A B', 'WASLIKE', 'C  D' FROM supplier)"


def _facts(spark, sf_dir):
    met = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return met.select(F.col("s_suppkey").alias("memory_id"), F.expr(_FACTS.format(s="STRING")).alias("text"))


@query(_SQL_FACTS + " SELECT memory_id, src, rel, dst FROM f")
def triplet_lines(spark, sf_dir):
    return _facts(spark, sf_dir).select("memory_id", F.explode(text.triplets(F.col("text"))).alias("t")).select("memory_id", "t.src", "t.rel", "t.dst")


@query(_SQL_FACTS + " SELECT 'ent::' || upper(src) AS source, rel AS relationship, 'ent::' || upper(dst) AS destination, CAST(count(*) AS DOUBLE) AS weight, max(memory_id) AS memory_id FROM f GROUP BY 1, 2, 3")
def ingest_edges(spark, sf_dir):
    return store.ingested(_facts(spark, sf_dir))["edges"]


@query(_SQL_FACTS + " SELECT DISTINCT 'ent::' || upper(name) AS id, name FROM (SELECT src AS name FROM f UNION ALL SELECT dst FROM f)")
def ingest_nodes(spark, sf_dir):
    return store.ingested(_facts(spark, sf_dir))["nodes"]


@query(_SQL_FACTS + " SELECT DISTINCT memory_id, unnest([src, dst]) AS entity FROM f")
def ingest_index(spark, sf_dir):
    return store.ingested(_facts(spark, sf_dir))["memory_entities"]


@query(_SQL_FACTS + ", m AS (SELECT upper('ent::' || src) AS source, upper(rel) AS relationship, upper('ent::' || dst) AS destination, memory_id FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY source, relationship, destination ORDER BY memory_id) AS k FROM m) SELECT source, relationship, destination, count(*) AS n, CAST(least(greatest(1.5, 0.8 * count(*)), 4.0) AS DOUBLE) AS width, string_agg(CASE WHEN k <= 5 THEN CAST(memory_id AS VARCHAR) END, ', ' ORDER BY memory_id) AS memories, CASE WHEN count(*) > 1 THEN relationship || ' ×' || count(*) ELSE relationship END AS label FROM r GROUP BY 1, 2, 3")
def graph_export(spark, sf_dir):
    return store.exported(store.ingested(_facts(spark, sf_dir))["mentions"])


_RELATION = "concat(CASE p_size % 3 WHEN 0 THEN 'is-' WHEN 1 THEN 'WERE_' ELSE '' END, replace(p_type, ' ', '-'), CASE p_size % 2 WHEN 0 THEN '_of' ELSE 's' END)"


@query(f"WITH r AS (SELECT DISTINCT {_RELATION} AS relation FROM part), k AS (SELECT relation, array_to_string(list_filter(string_split(replace(upper(relation), '-', '_'), '_'), lambda t: NOT list_contains({_LIST(text.FILLER_TOKENS)}, t)), '_') AS k FROM r) SELECT relation, CASE WHEN length(k) > 3 AND k LIKE '%S' THEN left(k, length(k) - 1) ELSE k END AS key FROM k")
def relation_keys(spark, sf_dir):
    """Relations made of what parts are called."""
    said = table(spark, sf_dir, "part").select(F.expr(_RELATION).alias("relation")).distinct()
    return said.select("relation", text.relation_key(F.col("relation")).alias("key"))


# --- nodes, edges and their text

_SQL_ORDERED = SQL_EDGES + ", o AS (SELECT * FROM edges WHERE relationship = 'ORDERED_FROM')"


def _ordered(spark, sf_dir):
    node = lambda c: F.concat(F.lit("ent::"), F.upper(c))
    return named_orders(spark, sf_dir).select(node("c_name").alias("source"), F.lit("ORDERED_FROM").alias("relationship"), node("s_name").alias("destination"), "weight", "updated_at")


@query(SQL_EDGES + "SELECT id, name, label FROM nodes")
def node_scan(spark, sf_dir):
    return derived(spark, sf_dir).nodes


@query(SQL_EDGES + "SELECT id, name, label FROM nodes JOIN (SELECT DISTINCT 'ent::' || upper(s_name) AS id FROM supplier WHERE s_nationkey < 10) USING (id)")
def node_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").where("s_nationkey < 10").select(F.concat(F.lit("ent::"), text.name_key(F.col("s_name"))).alias("id")).distinct()
    return derived(spark, sf_dir).nodes.join(wanted, "id", "left_semi")


@query(SQL_EDGES + "SELECT 'node' AS part, label AS kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', relationship, count(*) FROM edges GROUP BY 2")
def graph_dump(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return c.nodes.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "kind", "n").union(c.edges.groupBy(F.col("relationship").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge"), "kind", "n"))


@query(SQL_EDGES + "SELECT source || ' --' || relationship || '--> ' || destination AS line, source || ' is ' || lower(replace(relationship, '_', ' ')) || ' ' || destination AS said, destination AS back FROM edges")
def edge_lines(spark, sf_dir):
    e = derived(spark, sf_dir).edges
    line = talk.edge_line(F.col("source"), F.col("relationship"), F.col("destination"))
    return e.select(line.alias("line"), talk.edge_sentence(F.col("source"), F.col("relationship"), F.col("destination")).alias("said")).withColumn("back", talk.parsed_edge(F.col("line"))["destination"])


@query(SQL_EDGES + "SELECT a.source || ' in nation ' || a.destination || ', which in region ' || b.destination AS said FROM edges a JOIN edges b ON a.destination = b.source WHERE a.relationship = 'IN_NATION' AND b.relationship = 'IN_REGION'")
def path_sentences(spark, sf_dir):
    e = catalog(spark, sf_dir, ["IN_NATION", "IN_REGION"]).edges
    pick = lambda kind, name: e.where(F.col("relationship") == kind).select(F.struct("source", "relationship", "destination").alias(name))
    met = pick("IN_NATION", "a").join(pick("IN_REGION", "b"), F.col("a.destination") == F.col("b.source"))
    return met.select(talk.path_sentence(F.array("a", "b")).alias("said"))


@query(_SQL_ORDERED + " SELECT source, relationship, destination, weight, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, relationship, destination) AS place FROM o) WHERE place <= 5")
def fan_out_capped(spark, sf_dir):
    return graph.fan_out(_ordered(spark, sf_dir).drop("updated_at"), 5)


@query(SQL_EDGES + "SELECT DISTINCT source, relationship, destination FROM edges WHERE lower(source) IN (SELECT lower('ent::' || n_name) FROM nation WHERE n_regionkey = 1) OR lower(destination) IN (SELECT lower('ent::' || n_name) FROM nation WHERE n_regionkey = 1)")
def edges_touching(spark, sf_dir):
    names = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("ENT::"), F.lower("n_name")).alias("name"))
    return graph.touching(catalog(spark, sf_dir).edges.select("source", "relationship", "destination"), names)


@query("SELECT o_custkey AS source, 'ORDERED' AS relationship, o_orderpriority AS destination, min(o_orderkey) AS memory_id FROM orders GROUP BY 1, 3")
def first_of_triples(spark, sf_dir):
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.lit("ORDERED").alias("relationship"), F.col("o_orderpriority").alias("destination"), F.col("o_orderkey").alias("memory_id"))
    return graph.first_of_triples(said, "memory_id")


@query(SQL_EDGES + ", s AS (SELECT source AS id, string_agg(DISTINCT relationship, ',' ORDER BY relationship) AS as_source FROM edges GROUP BY 1), d AS (SELECT destination AS id, string_agg(DISTINCT relationship, ',' ORDER BY relationship) AS as_destination FROM edges GROUP BY 1) SELECT id, as_source, as_destination FROM s FULL JOIN d USING (id)")
def entity_roles(spark, sf_dir):
    return graph.roles(catalog(spark, sf_dir).edges).select("id", F.array_join("as_source", ",").alias("as_source"), F.array_join("as_destination", ",").alias("as_destination"))


@query(SQL_EDGES + "SELECT destination AS id, string_agg(DISTINCT source, ',' ORDER BY source) AS entities, string_agg(DISTINCT relationship, ',' ORDER BY relationship) AS relations FROM edges GROUP BY 1")
def distinct_collections(spark, sf_dir):
    e = derived(spark, sf_dir).edges
    return e.groupBy(F.col("destination").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("entities"), F.array_join(F.array_sort(F.collect_set("relationship")), ",").alias("relations"))


_SPLIT = "list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')"


@query(f"WITH x AS (SELECT conv_id, turn, text AS t, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS u FROM conversations), p AS (SELECT conv_id, turn, t AS a, u AS b, {_SPLIT} AS wa, {_SPLIT.replace('(t,', '(u,')} AS wb FROM x WHERE t IS NOT NULL AND u IS NOT NULL), e AS (SELECT conv_id, turn, w, min(i) AS i FROM (SELECT conv_id, turn, unnest(list_concat(wa, wb)) AS w, generate_subscripts(list_concat(wa, wb), 1) AS i FROM p) GROUP BY 1, 2, 3), m AS (SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS merged FROM e GROUP BY 1, 2), l AS (SELECT conv_id, turn, list_distinct(list_transform(wa, lambda w: lower(w))) AS la, list_distinct(list_transform(wb, lambda w: lower(w))) AS lb FROM p) SELECT p.conv_id AS conv_id, p.turn AS turn, CASE WHEN a = b THEN a ELSE coalesce(merged, '') END AS merged, round(coalesce(len(list_intersect(la, lb))::DOUBLE / nullif(len(list_distinct(list_concat(la, lb))), 0), 0), 9) AS shared FROM p LEFT JOIN m USING (conv_id, turn) JOIN l USING (conv_id, turn)")
def text_merge(spark, sf_dir):
    """Each turn merged with the one after it."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    met = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", after.alias("next")).where("text is not null and next is not null")
    return met.select("conv_id", "turn", text.merged_text(F.col("text"), F.col("next")).alias("merged"), F.round(text.jaccard(F.col("text"), F.col("next")), 9).alias("shared"))


# --- the store


@query(f"WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS vec_id, {_COS} AS score FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 AND v.vec_id % 20 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS k FROM s) SELECT qid, CASE WHEN score >= 0.4 THEN 'UPDATE' ELSE 'ADD' END AS event, CASE WHEN score >= 0.4 THEN vec_id END AS target, score < 0.4 AND score >= 0.35 AS related, round(score, 6) AS score FROM r WHERE k = 1")
def memory_add(spark, sf_dir):
    """Rows with ids divisible by 20 arrive; the others are stored."""
    v = table(spark, sf_dir, "embeddings")
    new = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    return store.classify(new, v.where("vec_id % 20 <> 0"), 0.4, 0.35).withColumn("score", F.round("score", 6))


@query("SELECT o_custkey AS memory_id, string_agg(w, ' ' ORDER BY first) AS text FROM (SELECT o_custkey, w, min(o_orderkey) AS first FROM (SELECT o_custkey, o_orderkey, o_orderstatus || o_orderpriority[1] AS w FROM orders) GROUP BY 1, 2) GROUP BY 1")
def memory_update(spark, sf_dir):
    said = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("memory_id"), F.col("o_orderkey").alias("seq"), F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1)).alias("text"))
    none = said.where("false").select("memory_id", "text")
    return store.updated(none, said)


@query(f"WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS vec_id, {_COS} AS score FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 AND v.vec_id % 20 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS k FROM s), said AS (SELECT vec_id AS memory_id, -1 AS seq, ['s' || coalesce(CAST(label AS VARCHAR), ''), 'm' || vec_id % 7] AS w FROM embeddings WHERE vec_id % 20 <> 0 UNION ALL SELECT r.vec_id, qid, ['q' || qid % 5, 's' || coalesce(CAST(label AS VARCHAR), '')] FROM r JOIN embeddings e ON e.vec_id = qid WHERE k = 1), t AS (SELECT memory_id, seq, unnest(w) AS w, unnest([1, 2]) AS i FROM said), d AS (SELECT memory_id, w, min(10 * seq + i) AS first FROM t GROUP BY 1, 2) SELECT memory_id, string_agg(w, ' ' ORDER BY first) AS text FROM d GROUP BY 1")
def memory_update_by_query(spark, sf_dir):
    """Rows with ids divisible by 20 ask; the memories nearest to them among the others take their words."""
    v = table(spark, sf_dir, "embeddings")
    about = F.concat(F.lit("s"), F.coalesce(F.col("label").cast("string"), F.lit("")))
    stored, new = v.where("vec_id % 20 <> 0"), v.where("vec_id % 20 = 0")
    memories = stored.select(F.col("vec_id").alias("memory_id"), F.concat(about, F.lit(" m"), (F.col("vec_id") % 7).cast("string")).alias("text"))
    return store.updated_by_query(memories, stored, new.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"), F.concat(F.lit("q"), (F.col("vec_id") % 5).cast("string"), F.lit(" "), about).alias("text")))


@query("WITH gone AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT 'orders' AS part, count(*) AS n, min(o_orderkey) AS least FROM orders ANTI JOIN gone ON o_custkey = c_custkey UNION ALL SELECT 'names', count(*), min(c_custkey) FROM customer ANTI JOIN gone USING (c_custkey)")
def memory_delete(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "memory_id"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "memory_id")
    left = store.without({"orders": orders, "names": customer}, customer.where("c_acctbal < 0"))
    count = lambda name, key: left[name].agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.min(key).alias("least"))
    return count("orders", "o_orderkey").union(count("names", "memory_id"))


@query("WITH e AS (SELECT o_custkey AS source, o_orderpriority AS destination, count(*) AS w, max(o_orderkey) AS m, o_orderkey % 2 AS new FROM orders GROUP BY 1, 2, 5) SELECT source, 'SAID' AS relationship, destination, CAST(sum(w) AS DOUBLE) AS weight, max_by(m, new) AS memory_id FROM e GROUP BY 1, 3")
def edge_upsert(spark, sf_dir):
    said = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source"), F.lit("SAID").alias("relationship"), F.col("o_orderpriority").alias("destination"), (F.col("o_orderkey") % 2).alias("new")).agg(F.count("*").cast("double").alias("weight"), F.max("o_orderkey").alias("memory_id"))
    return store.upserted_edges(said.where("new = 0").drop("new"), said.where("new = 1").drop("new"))


@query("SELECT o_custkey AS node_id, 'status' AS key, max_by(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1")
def props_upsert(spark, sf_dir):
    props = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node_id"), F.lit("status").alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"))
    return store.upserted_props(props.where("seq % 3 <> 0"), props.where("seq % 3 = 0"))


@query("SELECT s_name AS source, 'FROM' AS relationship, lower(n_name) AS destination, NULL::VARCHAR AS source_id, 'ent::' || n_name AS destination_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def attach_ids(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    edges = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("source"), F.lit("FROM").alias("relationship"), F.lower("n_name").alias("destination"))
    return store.attached(edges, nation.select(F.concat(F.lit("ent::"), F.col("n_name")).alias("id"), F.col("n_name").alias("name")))


@query(SQL_EDGES + "SELECT source, 'PART_OF' AS relationship, destination, CAST(sum(weight) AS DOUBLE) AS weight FROM edges WHERE relationship IN ('IN_NATION', 'IN_REGION') GROUP BY 1, 3")
def merge_relations(spark, sf_dir):
    return store.merged_relations(graph.scan(catalog(spark, sf_dir, ["IN_NATION", "IN_REGION"]).edges, ["IN_NATION", "IN_REGION"]), {"IN_NATION": "PART_OF", "IN_REGION": "PART_OF"})


_CAPITALS = "array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_REWRITTEN = "said"
for _case in ("{c}", "upper({c})", "lower({c})", _CAPITALS):
    _REWRITTEN = f"replace({_REWRITTEN}, {_case.format(c='n_name')}, {_case.format(c='r_name')})"


@query(f"WITH s AS (SELECT c_custkey, n_name, r_name, c_name || ' of ' || n_name || ', once ' || lower(n_name) || ' or ' || {_CAPITALS.format(c='n_name')} || ' near ' || c_mktsegment AS said FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT c_custkey, {_REWRITTEN} AS x FROM s")
def rewrite_text(spark, sf_dir):
    """Each customer's nation becomes its region, in every case that it is written in."""
    t = lambda name: table(spark, sf_dir, name)
    met = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = F.concat("c_name", F.lit(" of "), "n_name", F.lit(", once "), F.lower("n_name"), F.lit(" or "), F.initcap("n_name"), F.lit(" near "), "c_mktsegment")
    return met.select("c_custkey", store.rewritten(said, F.col("n_name"), F.col("r_name")).alias("x"))


@query("SELECT event_id AS id, user_id AS memory_id, 'ADD' AS event, ts AS created_at, ts AS updated_at FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, user_id, 'DELETE', NULL, ts FROM events WHERE event_id % 2 = 1")
def history_append(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("memory_id"), F.when(F.col("event_id") % 2 == 0, "ADD").otherwise("DELETE").alias("event"), "ts")
    old = e.where("event = 'ADD'").select("id", "memory_id", "event", F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    return store.appended(old, e.where("event = 'DELETE'"), F.col("ts")).drop("ts")


@query("SELECT vec_id, label FROM (SELECT vec_id, label FROM embeddings WHERE label <> 1 AND vec_id % 3 <> 0 UNION ALL SELECT vec_id, 99 FROM embeddings WHERE vec_id % 3 = 0 AND label <> 1)")
def vector_upsert_delete(spark, sf_dir):
    """Every third vector replaced, those of one label pruned."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    changed = vector.upsert(v, v.where("vec_id % 3 = 0").withColumn("label", F.lit(99)))
    return vector.delete(changed, v.where("label = 1"))


@query(SQL_EDGES + ", f AS (SELECT 'ent::' || upper(n_name) AS n, 'ent::' || upper(r_name) AS r FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY n_name LIMIT 1) SELECT source, relationship, destination, weight FROM edges, f WHERE relationship = 'IN_NATION' AND destination = n OR relationship = 'IN_REGION' AND source = n AND destination = r")
def edge_lookup(spark, sf_dir):
    """Edges by relationship and an end, and one by its whole triple: those of the first nation."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    first = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_name").select(F.upper("n_name"), F.upper("r_name")).first()
    n, r = (f"ent::{x}" for x in first or ("", ""))
    e = catalog(spark, sf_dir, ["IN_NATION", "IN_REGION"]).edges
    found = graph.scan(e, ["IN_NATION"], destination=n).union(graph.scan(e, ["IN_REGION"], n, r))
    return found.select("source", "relationship", "destination", "weight")


@query("SELECT o_orderkey AS memory_id, o_custkey AS source, 'ORDERED' AS relationship, o_orderpriority AS destination, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE strftime(o_orderdate, '%m') = '03' AND o_orderstatus = 'F'")
def edge_props_lookup(spark, sf_dir):
    """Edges by two of their properties, each a row of its own."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("memory_id"), F.col("o_custkey").alias("source"), F.lit("ORDERED").alias("relationship"), F.col("o_orderpriority").alias("destination"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("status"))
    edges = orders.select("memory_id", "source", "relationship", "destination")
    props = orders.select("memory_id", F.stack(F.lit(2), F.lit("month"), F.col("month"), F.lit("status"), F.col("status")).alias("key", "value"))
    return store.with_props(edges, props, {"month": lambda v: v.endswith("-03"), "status": lambda v: v == "F"}).select("memory_id", "source", "relationship", "destination", "month")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id % 1000 = 7")
def payload_get(spark, sf_dir):
    """Payloads by a table of ids."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return events.join(table(spark, sf_dir, "events").where("event_id % 1000 = 7").select("event_id").distinct(), "event_id", "left_semi")


@query("SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 100")
def payload_page(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(100).select("event_id", "event_type")


# --- retrieval


def _probe(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


_SQL_NEAR = f"near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, memory_id) AS k FROM (SELECT q.vec_id AS qid, v.vec_id AS memory_id, {_COS} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)) WHERE k <= 30)"


@query()
def vector_topk_lsh(spark, sf_dir):
    """Ids divisible by 20 against all; recall is measured in the tests."""
    v, q = _probe(spark, sf_dir)
    return retrieval.lsh_top_k(v, q, 10).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


_SQL_TALE = "tale AS (SELECT vec_id AS memory_id, 'S' || vec_id % 37 AS entity FROM embeddings UNION SELECT vec_id, 'L' || label FROM embeddings)"


@query(f"WITH {_SQL_NEAR}, {_SQL_TALE}, asked AS (SELECT memory_id AS qid, entity FROM tale WHERE memory_id % 20 = 0), linked AS (SELECT DISTINCT qid, t.memory_id FROM asked a JOIN tale t ON a.entity = t.entity AND a.entity LIKE 'S%' AND qid <> t.memory_id), found AS (SELECT qid, memory_id, max(s) AS similarity, max(b) AS boost FROM (SELECT qid, memory_id, score AS s, 0.0::DOUBLE AS b FROM near UNION ALL SELECT qid, memory_id, 0, 0.46::DOUBLE FROM linked) GROUP BY 1, 2), deg AS (SELECT entity, count(*) AS d FROM tale GROUP BY 1), f AS (SELECT f.qid, f.memory_id, similarity, boost, sum(CASE WHEN a.entity IS NULL THEN 0 ELSE 1 END) AS overlap, sum(0.02::DOUBLE * least(d, 5)) AS evidence FROM found f JOIN tale t ON f.memory_id = t.memory_id JOIN deg ON deg.entity = t.entity LEFT JOIN asked a ON a.qid = f.qid AND a.entity = t.entity GROUP BY 1, 2, 3, 4), s AS (SELECT qid, memory_id, round(0.6::DOUBLE * greatest(similarity, boost) + 0.2::DOUBLE * least(1.0::DOUBLE, overlap / 3::DOUBLE) + CASE WHEN memory_id % 2 = 0 THEN 0.075::DOUBLE ELSE 0 END + 0.05::DOUBLE * least(1.0::DOUBLE, evidence), 6) AS score FROM f) SELECT qid, memory_id, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, memory_id) AS k FROM s) WHERE k <= 10")
def hybrid_search_batch(spark, sf_dir):
    v, q = _probe(spark, sf_dir)
    index = v.select(F.col("vec_id").alias("memory_id"), F.explode(F.array(F.concat(F.lit("S"), (F.col("vec_id") % 37).cast("string")), F.concat(F.lit("L"), F.col("label").cast("string")))).alias("entity"))
    asked = index.where("memory_id % 20 = 0").select(F.col("memory_id").alias("qid"), "entity")
    hits = graph.settled(vector.top_k(v, q, 30).select("qid", F.col("vec_id").alias("memory_id"), "score"))
    timed = index.where("memory_id % 2 = 0")
    linked = retrieval.linked(asked.where("entity like 'S%'"), index, timed, hits, 10).withColumn("boost", ranking.traversal_boost(F.lit(0.2)))
    degrees = index.groupBy("entity").agg(F.count("*").alias("degree"))
    return retrieval.hybrid(retrieval.candidates(hits, linked), asked, index, degrees, timed, 10)


@query(f"WITH {_SQL_NEAR} SELECT qid, string_agg(line, chr(10) ORDER BY k, part) AS context FROM (SELECT qid, line, min(k) AS k, min_by(part, k * 2 + part) AS part FROM (SELECT qid, k, 0 AS part, 'M' || memory_id || ' --HAS--> L' || label AS line FROM near JOIN embeddings ON vec_id = memory_id WHERE k <= 3 UNION ALL SELECT qid, k, 1, 'text ' || memory_id % 5 FROM near WHERE k <= 3) GROUP BY 1, 2) GROUP BY 1")
def context_text(spark, sf_dir):
    v, q = _probe(spark, sf_dir)
    results = vector.top_k(v, q, 3).select("qid", F.col("vec_id").alias("memory_id"), "rank", F.concat(F.lit("text "), (F.col("vec_id") % 5).cast("string")).alias("text"))
    name = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    lines = v.select(F.col("vec_id").alias("memory_id"), talk.edge_line(name("vec_id", "M"), F.lit("HAS"), name("label", "L")).alias("line"))
    return retrieval.context(results, lines, 3)


@query(f"WITH {_SQL_NEAR}, w AS (SELECT vec_id AS memory_id, unnest(['word' || vec_id % 23, 'tag' || label, 'wd' || label]) AS word FROM embeddings), s AS (SELECT qid, word, max(score) AS score FROM near JOIN w USING (memory_id) WHERE score > 0.3 AND score < 0.7 AND length(word) > 3 GROUP BY 1, 2), x AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.memory_id = qid AND w.word = s.word)) SELECT qid, word, round(score, 6) AS score, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, word) AS k FROM x) WHERE k <= 5")
def query_expansion(spark, sf_dir):
    v, q = _probe(spark, sf_dir)
    near = vector.top_k(v, q, 30).select("qid", F.col("vec_id").alias("memory_id"), "score")
    part = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    words = v.select(F.col("vec_id").alias("memory_id"), F.explode(F.array(part("word", F.col("vec_id") % 23), part("tag", F.col("label")), part("wd", F.col("label")))).alias("word"))
    return retrieval.expansion(near, words, words.select(F.col("memory_id").alias("qid"), "word"), 0.3, 0.7, 5).withColumn("score", F.round("score", 6))


@query()
def diverse_context(spark, sf_dir):
    """The greedy pick over each query's ranked candidates."""
    v, q = _probe(spark, sf_dir)
    best = vector.top_k(v, q, 20).join(v.select("vec_id", "label"), "vec_id")
    kind = F.when(F.col("vec_id") % 2 == 0, "memory").otherwise("edge")
    items = best.select("qid", F.col("vec_id").alias("item"), kind.alias("kind"), (F.col("score") * 2).alias("score"), (F.col("vec_id") % 3).alias("n_edges"), (F.col("vec_id") % 2).alias("n_chains"), F.array(F.col("label").cast("string"), (F.col("vec_id") % 11).cast("string")).alias("entities"))
    return retrieval.diverse(items)


@query("SELECT l_orderkey, l_linenumber, round(greatest(l_discount::DOUBLE, CASE WHEN l_returnflag = 'R' THEN 0.2::DOUBLE ELSE 0 END, CASE WHEN l_linestatus = 'O' THEN 0.25::DOUBLE ELSE 0 END), 6) AS temporal, round(greatest(0, least(1, 0.4::DOUBLE + 0.3::DOUBLE * l_quantity / 10)), 6) AS traversal FROM lineitem")
def temporal_boost(spark, sf_dir):
    boost = ranking.temporal_boost(F.col("l_discount"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(boost, 6).alias("temporal"), F.round(ranking.traversal_boost(F.col("l_quantity") / 10), 6).alias("traversal"))


_D = "::DOUBLE"


@query(f"WITH f AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS d, l_tax * 5 AS s, l_quantity / 100 AS t, l_linenumber % 5 AS o, l_quantity / 50 AS c, l_discount * 9 AS g, l_returnflag = 'R' AS rel FROM lineitem), b AS (SELECT *, least(0.3{_D}, 0.15{_D} * o) AS e, least(0.2{_D}, 0.1{_D} * c) AS k, least(0.25{_D}, 0.12{_D} * g) AS h FROM f), x AS (SELECT *, d + e + 0.5{_D} * k AS d1, s + 1.5{_D} * e + k AS s1, t + h + 0.8{_D} * e AS t1 FROM b), y AS (SELECT *, (CASE WHEN o > 2 THEN 0.3{_D} * d1 + 0.4{_D} * s1 + 0.3{_D} * t1 WHEN rel AND c > 0.6 THEN 0.3{_D} * d1 + 0.3{_D} * s1 + 0.4{_D} * t1 WHEN g > 0.7 THEN 0.4{_D} * d1 + 0.3{_D} * s1 + 0.3{_D} * t1 ELSE 0.35{_D} * d1 + 0.35{_D} * s1 + 0.3{_D} * t1 END) * (1 + 0.1{_D} * c) AS v FROM x) SELECT l_orderkey, l_linenumber, round(CASE WHEN o > 1 AND c > 0.8 THEN least(1.0{_D}, 1.1{_D} * v) ELSE v END + 1e-9, 5) AS score, round(least(1.0{_D}, least(0.6{_D}, 0.2{_D} * (l_linenumber % 4)) + least(0.4{_D}, 0.2{_D} * o) + least(0.3{_D}, 0.3{_D} * c)) + 1e-9, 5) AS trust FROM y")
def fusion_graph_aware(spark, sf_dir):
    c = F.col
    score = ranking.graph_aware(c("l_discount") * 5, c("l_tax") * 5, c("l_quantity") / 100, c("l_linenumber") % 5, c("l_quantity") / 50, c("l_discount") * 9, c("l_returnflag") == "R")
    trust = ranking.confidence(c("l_linenumber") % 4, c("l_linenumber") % 5, c("l_quantity") / 50)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score + 1e-9, 5).alias("score"), F.round(trust + 1e-9, 5).alias("trust"))


@query(SQL_EDGES + "SELECT destination AS id, CAST(least(count(*), 5) AS INTEGER) AS capped, round(least(1.0::DOUBLE, 0.4::DOUBLE + sum(0.2::DOUBLE * (CASE WHEN source LIKE '%1%' THEN 1 ELSE 0 END) + 0.15::DOUBLE * (CASE WHEN relationship LIKE '%ORDERED%' THEN 1 ELSE 0 END))), 6) AS score FROM edges WHERE relationship = 'ORDERED_FROM' GROUP BY 1")
def relation_scores(spark, sf_dir):
    one = lambda c: F.when(c, 1).otherwise(0)
    part = ranking.relation_score(F.lit(0.0), one(F.col("source").contains("1")), one(F.col("relationship").contains("ORDERED")))
    return _ordered(spark, sf_dir).groupBy(F.col("destination").alias("id")).agg(F.least(F.count("*"), F.lit(5)).cast("int").alias("capped"), F.round(F.least(F.lit(1.0), 0.4 + F.sum(part)), 6).alias("score"))


_LEX_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(f"WITH t AS (SELECT conv_id, turn, unnest({_LEX_WORDS}) AS w FROM conversations), n AS (SELECT conv_id, turn, w, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY conv_id, turn) AS s FROM t GROUP BY 1, 2, 3), m AS (SELECT a.conv_id AS conv_id, a.turn AS turn, sum(a.s * b.s) AS score FROM n a JOIN n b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn AND a.w = b.w GROUP BY 1, 2) SELECT x.conv_id AS conv_id, x.turn AS turn, round(coalesce(score, 0), 6) AS score FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn + 1 = y.turn LEFT JOIN m ON m.conv_id = x.conv_id AND m.turn = x.turn")
def lexical_match(spark, sf_dir):
    """How much each turn and the one after it say the same, by the shares of their words."""
    turns = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    bags = search.word_weights(turns, "id").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("bag"))  # the words of one turn
    bag = lambda c: F.coalesce(c, F.create_map().cast("map<string,double>"))
    pairs = turns.select("conv_id", "turn", "id", (F.col("id") + 1).alias("then")).join(turns.select(F.col("id").alias("then")), "then")
    met = pairs.join(bags, "id", "left").join(bags.select(F.col("id").alias("then"), F.col("bag").alias("next")), "then", "left")
    return met.select("conv_id", "turn", F.round(ranking.lexical_match(bag(F.col("bag")), bag(F.col("next"))), 6).alias("score"))


@query(f"WITH near AS (SELECT v.vec_id, {_COS} AS score FROM embeddings q JOIN embeddings v ON q.vec_id = 0 AND v.vec_id <> 0 ORDER BY score DESC, v.vec_id LIMIT 50) SELECT DISTINCT o_custkey AS source, l_suppkey AS destination FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey IN (SELECT vec_id FROM near WHERE score >= 0.2)")
def dsl_similar(spark, sf_dir):
    """Edges whose far end is among the 50 entities most like a vector, at 0.2 or more."""
    v = table(spark, sf_dir, "embeddings")
    near = vector.top_k(v, v.where("vec_id = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), 50).where("score >= 0.2").select(F.col("vec_id").alias("s_suppkey"))
    return order_evidence(spark, sf_dir, near).select(F.col("c_custkey").alias("source"), F.col("s_suppkey").alias("destination"))


@query(_SQL_ASKED + f", n AS (SELECT o_custkey, count(*) AS related, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS payloads FROM orders GROUP BY 1) SELECT c_custkey, CASE WHEN len({_SQL_WORDS}) <= 2 AND len(list_filter({_SQL_WORDS}, lambda w: NOT list_contains({_LIST(talk.FILLERS)}, w))) = 0 THEN 'greeting_filler' WHEN length(trim(x)) < 4 THEN 'too_short' WHEN related IS NULL AND x LIKE '%Customer%' THEN 'vector_fallback' WHEN related IS NULL THEN 'no_entities' WHEN payloads = 0 THEN 'relations_only' ELSE 'ranked' END AS status FROM a LEFT JOIN n ON c_custkey = o_custkey")
def graph_first_search(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("related"), F.count_if(F.col("o_orderstatus") == "F").alias("payloads"))
    met = _asked(spark, sf_dir).join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    known = F.when(F.col("x").contains("Customer"), 1).otherwise(0)
    return met.select("c_custkey", retrieval.outcome(talk.gate(F.col("x")), zero("related"), known, zero("payloads")).alias("status"))


@query(SQL_EDGES + "SELECT a.name AS a_name, a.id AS a_id, b.id AS b_id FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON destination = b.id WHERE relationship = 'IN_NATION' AND a.label = 'SUPPLIER' AND b.id IN (SELECT 'ent::' || upper(n_name) FROM nation WHERE n_regionkey = 2)")
def dsl_similar_nodes(spark, sf_dir):
    """SIMILAR with a caller's search: here the nations of one region."""
    c = catalog(spark, sf_dir, ["IN_NATION"])
    search = lambda text_, k, least: table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.concat(F.lit("ent::"), F.upper("n_name")).alias("id"))
    return dsl.compile_query("MATCH (a:SUPPLIER)-[:IN_NATION]->(b) WHERE SIMILAR(b, 'region two', 50, 0.2) RETURN a.name, a.id, b.id", c.nodes, c.node_props, c.edges, search)
