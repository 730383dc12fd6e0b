"""Registered queries of search end to end, the vector index and streams with state, next to their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, search, style
from ..operators.vector_index import VectorIndex
from ..sources.star import table
from ..streaming import states, windows
from .registry import _stream, query

# --- memories: the turns of conversations, the capitalised words in them as entities, said one after the other as triples

_NAME = "[A-Z][a-zA-Z0-9_-]+"


def _entities(frame, key):
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_NAME), F.lit(0)), F.upper))
    return frame.select(key, "role", F.posexplode(found).alias("place", "entity")) if "role" in frame.columns else frame.select(key, F.posexplode(found).alias("place", "entity"))


def _memory(spark, sf_dir) -> search.Memory:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.coalesce("role", F.lit("none")).alias("role"), "text")
    named = _entities(turns, "memory_id")
    after = F.lead("entity").over(Window.partitionBy("memory_id").orderBy("place"))
    said = named.select("memory_id", F.col("entity").alias("source"), F.concat(F.upper("role"), F.lit("_SAID")).alias("relationship"), after.alias("destination")).where("destination is not null")
    edges = said.groupBy("source", "relationship", "destination").agg(F.count("*").cast("double").alias("weight"), F.lit(None).cast("timestamp").alias("updated_at"))
    return search.Memory(turns.select("memory_id", "text"), named.select("memory_id", "entity"), graph.settled(said), edges)


def _questions(spark, sf_dir):
    """The benchmark's items, and what users said in every twentieth conversation."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    users = table(spark, sf_dir, "conversations").where("role = 'user' and conv_id % 20 = 0").select((F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    return items.union(users)


def _own(questions):
    """A user's question is not answered by itself."""
    return questions.where("qid >= 1000000000").select("qid", (F.col("qid") - 1_000_000_000).alias("memory_id"))


def _as_of():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


_HOW = {"hops": 2, "fan_out": 5}

_SQL_MEMORY = f"""
WITH mem AS MATERIALIZED (SELECT conv_id * 1000 + turn AS memory_id, coalesce(role, 'none') AS role, text FROM conversations),
q AS MATERIALIZED (SELECT item_id AS qid, text FROM benchmark UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, text FROM conversations WHERE role = 'user' AND conv_id % 20 = 0),
raw AS (SELECT memory_id, role, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{_NAME}'), lambda x: upper(x))) AS entity, generate_subscripts(regexp_extract_all(coalesce(text, ''), '{_NAME}'), 1) AS i FROM mem),
ent AS MATERIALIZED (SELECT memory_id, role, entity, min(i) AS place FROM raw GROUP BY ALL),
said AS MATERIALIZED (SELECT * FROM (SELECT memory_id, entity AS source, upper(role) || '_SAID' AS relationship, lead(entity) OVER (PARTITION BY memory_id ORDER BY place) AS destination FROM ent) WHERE destination IS NOT NULL),
edges AS MATERIALIZED (SELECT source, relationship, destination, CAST(count(*) AS DOUBLE) AS weight FROM said GROUP BY ALL),
both_ways AS (SELECT source AS f, destination AS t, weight FROM edges UNION ALL SELECT destination, source, weight FROM edges WHERE source <> destination),
near AS MATERIALIZED (SELECT f AS a, t AS b, min(weight) AS weight FROM both_ways WHERE f <> t GROUP BY ALL),
deg AS MATERIALIZED (SELECT a AS id, least(count(*), 200) AS degree, least(0.3::DOUBLE, ln(1 + least(count(*), 200)) / 20) AS penalty FROM near GROUP BY 1),
qraw AS (SELECT qid, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '{_NAME}'), lambda x: upper(x))) AS entity, generate_subscripts(regexp_extract_all(coalesce(text, ''), '{_NAME}'), 1) AS i FROM q),
named AS MATERIALIZED (SELECT qid, entity, min(i) AS place FROM qraw GROUP BY ALL)"""
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_SQL_HYBRID = f"""{_SQL_MEMORY},
strong AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS k FROM near) WHERE k <= 5),
one AS MATERIALIZED (SELECT qid, entity AS id FROM named UNION SELECT qid, b FROM named JOIN strong ON entity = a), two AS MATERIALIZED (SELECT qid, id FROM one UNION SELECT qid, b FROM one JOIN strong ON id = a),
seeds AS (SELECT qid, arg_min(entity, place) AS id FROM named GROUP BY 1),
ranked AS (SELECT qid, t, max(0.5::DOUBLE + 0.3::DOUBLE * weight) - any_value(penalty) AS score FROM seeds JOIN both_ways ON f = id LEFT JOIN deg ON deg.id = t GROUP BY 1, 2),
ends AS (SELECT qid, t AS node, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, t) AS k FROM ranked) WHERE k <= 30),
linked AS (SELECT qid, memory_id, max(boost) AS boost FROM (SELECT qid, memory_id, 0.0::DOUBLE AS boost FROM two JOIN ent ON entity = id UNION ALL SELECT qid, memory_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.4::DOUBLE + 0.3::DOUBLE * score)) FROM ends JOIN ent ON entity = node) GROUP BY 1, 2),
tq AS MATERIALIZED (SELECT qid, token, count(*) AS n FROM (SELECT qid, unnest({_WORDS}) AS token FROM q) GROUP BY 1, 2), tm AS MATERIALIZED (SELECT memory_id, token, count(*) AS n FROM (SELECT memory_id, unnest({_WORDS}) AS token FROM mem) GROUP BY 1, 2),
lex AS MATERIALIZED (SELECT tq.qid AS qid, memory_id, sum((tm.n::DOUBLE / am.a) * (tq.n::DOUBLE / aq.a)) AS lexical FROM tq JOIN tm ON tq.token = tm.token JOIN (SELECT qid, sum(n) AS a FROM tq GROUP BY 1) aq ON aq.qid = tq.qid JOIN (SELECT memory_id, sum(n) AS a FROM tm GROUP BY 1) am USING (memory_id) GROUP BY 1, 2),
code AS MATERIALIZED (SELECT token, h % 256 AS slot, CASE WHEN (h // 256) % 2 = 1 THEN -1 ELSE 1 END AS sign FROM (SELECT token, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS h FROM (SELECT token FROM tq UNION SELECT token FROM tm))),
vq AS MATERIALIZED (SELECT qid, slot, CAST(sum(n * sign) AS DOUBLE) AS v FROM tq JOIN code USING (token) GROUP BY 1, 2), vm AS MATERIALIZED (SELECT memory_id, slot, CAST(sum(n * sign) AS DOUBLE) AS v FROM tm JOIN code USING (token) GROUP BY 1, 2),
cosine AS (SELECT qid, memory_id, round(sum(vq.v * vm.v) / (any_value(nq.n) * any_value(nm.n)), 12) AS score FROM vq JOIN vm USING (slot) JOIN (SELECT qid, sqrt(sum(v * v)) AS n FROM vq GROUP BY 1) nq USING (qid) JOIN (SELECT memory_id, sqrt(sum(v * v)) AS n FROM vm GROUP BY 1) nm USING (memory_id) WHERE nq.n > 0 AND nm.n > 0 GROUP BY 1, 2),
hits AS (SELECT qid, memory_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, memory_id) AS k FROM cosine) WHERE k <= 50 AND score > 0),
found AS MATERIALIZED (SELECT qid, memory_id, max(s) AS similarity, max(b) AS boost FROM (SELECT qid, memory_id, score AS s, 0.0::DOUBLE AS b FROM hits UNION ALL SELECT qid, memory_id, 0, boost FROM linked) WHERE qid < 1000000000 OR memory_id <> qid - 1000000000 GROUP BY 1, 2),
shared AS (SELECT qid, memory_id, sum(CASE WHEN named.entity IS NULL THEN 0 ELSE 1 END) AS overlap, sum(0.02::DOUBLE * least(coalesce(degree, 0), 5)) AS evidence FROM found JOIN ent USING (memory_id) LEFT JOIN named USING (qid, entity) LEFT JOIN deg ON deg.id = ent.entity GROUP BY 1, 2),
score AS (SELECT qid, memory_id, round(0.6::DOUBLE * greatest(similarity, boost) + 0.2::DOUBLE * least(1.0::DOUBLE, coalesce(overlap, 0) / 3::DOUBLE) + 0.075::DOUBLE + 0.05::DOUBLE * least(1.0::DOUBLE, coalesce(evidence, 0)) + 0.2::DOUBLE * coalesce(lexical, 0), 6) AS score FROM found LEFT JOIN shared USING (qid, memory_id) LEFT JOIN lex USING (qid, memory_id)),
best AS MATERIALIZED (SELECT * FROM (SELECT qid, memory_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, memory_id) AS rank FROM score) WHERE rank <= 10)"""


def _hybrid(spark, sf_dir):
    memory, questions = _memory(spark, sf_dir), _questions(spark, sf_dir)
    names = _entities(questions, "qid")
    return memory, questions, names, search.hybrid_search(questions, memory, _as_of(), 10, names=names, exclude=_own(questions), **_HOW)


@query(_SQL_HYBRID + " SELECT qid, memory_id, score, CAST(rank AS INTEGER) AS rank FROM best")
def hybrid_search(spark, sf_dir):
    """R1 over the turns of conversations."""
    return _hybrid(spark, sf_dir)[3]


@query(_SQL_HYBRID + """,
ends_of AS MATERIALIZED (SELECT memory_id, source AS entity FROM said UNION SELECT memory_id, destination FROM said), rel AS (SELECT memory_id, count(*) AS relations FROM (SELECT DISTINCT memory_id, source, relationship, destination FROM said) GROUP BY 1),
met AS MATERIALIZED (SELECT qid, memory_id, entity, row_number() OVER (PARTITION BY qid, memory_id ORDER BY entity) AS k FROM best JOIN ends_of USING (memory_id) JOIN named USING (qid, entity)),
walk AS (SELECT f, t, max(0.5::DOUBLE + 0.3::DOUBLE * weight) - any_value(penalty) AS s FROM both_ways JOIN deg ON deg.id = t GROUP BY 1, 2), sums AS (SELECT f AS entity, sum(s) AS s, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY round(s, 9) DESC, t) AS k FROM walk) WHERE k <= 8 AND s > 0 GROUP BY 1),
overlap_of AS (SELECT qid, memory_id, count(*) AS overlap FROM met GROUP BY 1, 2), strong_of AS (SELECT qid, memory_id, least(1.0::DOUBLE, sum(s) / sum(n)) AS strength FROM met JOIN sums USING (entity) WHERE k <= 5 GROUP BY 1, 2),
asked AS (SELECT DISTINCT qid, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) AS word FROM q),
kinds AS (SELECT DISTINCT memory_id, relationship FROM said), toks AS (SELECT memory_id, lower(entity) AS word, 0.2::DOUBLE AS v FROM ends_of UNION ALL SELECT memory_id, unnest(list_distinct(string_split(lower(relationship), '_'))), 0.1::DOUBLE FROM kinds),
about AS (SELECT qid, memory_id, least(1.0::DOUBLE, sum(v)) AS relevance FROM best JOIN toks USING (memory_id) JOIN asked USING (qid, word) GROUP BY 1, 2),
f AS (SELECT qid, memory_id, coalesce(relations, 0) AS relations, coalesce(overlap, 0) AS overlap, coalesce(strength, 0.0::DOUBLE) AS strength, coalesce(relevance, 0.0::DOUBLE) AS relevance FROM best LEFT JOIN rel USING (memory_id) LEFT JOIN overlap_of USING (qid, memory_id) LEFT JOIN strong_of USING (qid, memory_id) LEFT JOIN about USING (qid, memory_id)),
g AS (SELECT *, least(1.0::DOUBLE, least(0.6::DOUBLE, 0.2::DOUBLE * relations) + least(0.4::DOUBLE, 0.2::DOUBLE * overlap) + least(0.3::DOUBLE, 0.3::DOUBLE * strength)) AS confidence FROM f)
SELECT qid, memory_id, relations, overlap, round(strength, 6) AS strength, round(confidence, 6) AS confidence, round(relevance, 6) AS relevance, round((confidence + strength + relevance) / 3, 6) AS overall FROM g""")
def graph_context_score(spark, sf_dir):
    """G11 of what the hybrid search finds."""
    memory, questions, names, found = _hybrid(spark, sf_dir)
    scores = search.context_scores(graph.settled(found), questions, names, memory, _as_of())
    return scores.select("qid", "memory_id", "relations", "overlap", *(F.round(c, 6).alias(c) for c in ("strength", "confidence", "relevance", "overall")))


def _unified(spark, sf_dir):
    memory, questions = _memory(spark, sf_dir), _questions(spark, sf_dir)
    return memory, questions, search.unified_search(questions, memory, _as_of(), 10, names=_entities(questions, "qid"), exclude=_own(questions), **_HOW)


@query()
def unified_search(spark, sf_dir):
    """R9; its fusion is tested against enumerated pairs."""
    return _unified(spark, sf_dir)[2]


@query()
def unified_search_accuracy(spark, sf_dir):
    """R16 over R9: a user's turn is answered by any other turn of its conversation."""
    memory, questions, found = _unified(spark, sf_dir)
    own = _own(questions)
    same = own.join(memory.texts.select(F.col("memory_id").alias("other")), F.floor(F.col("memory_id") / 1000) == F.floor(F.col("other") / 1000)).where("other <> memory_id")
    return search.accuracy(found, same.select("qid", F.col("other").alias("memory_id")))


@query()
def graph_first_answers(spark, sf_dir):
    """R8 with its ranks."""
    memory, questions = _memory(spark, sf_dir), _questions(spark, sf_dir)
    return search.graph_first_search(questions, memory, _as_of(), 10, names=_entities(questions, "qid"), **_HOW)[1]


@query(_SQL_MEMORY + """,
trip AS MATERIALIZED (SELECT source, relationship AS key, destination, relationship, weight FROM edges),
ways AS MATERIALIZED (SELECT source AS a, * FROM trip UNION ALL SELECT destination, * FROM trip WHERE source <> destination),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY weight DESC, source, key, destination) AS k FROM ways) WHERE k <= 15),
pick AS (SELECT memory_id, entity, row_number() OVER (PARTITION BY memory_id ORDER BY place) AS nth FROM ent),
met AS MATERIALIZED (SELECT memory_id, source, key, destination, relationship, min((nth, k)) AS o FROM pick JOIN top ON entity = a WHERE nth <= 5 GROUP BY ALL),
near_ AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY o, source, key, destination) AS p FROM met),
tip AS (SELECT memory_id, source AS a FROM met UNION SELECT memory_id, destination FROM met),
early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY source, key, destination) AS k FROM ways) WHERE k <= 87),
rest AS (SELECT DISTINCT memory_id, source, key, destination, relationship FROM tip JOIN early USING (a)),
more AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY source, key, destination) AS p FROM rest ANTI JOIN met USING (memory_id, source, key, destination)),
every AS (SELECT memory_id, 0 AS part, p, source, relationship, destination FROM near_ WHERE p <= 8 UNION ALL SELECT memory_id, 1, p, source, relationship, destination FROM more WHERE p <= 12)
SELECT memory_id, CAST(place AS INTEGER) AS place, line FROM (SELECT memory_id, row_number() OVER (PARTITION BY memory_id ORDER BY part, p) AS place, source || ' --' || relationship || '-- ' || destination AS line FROM every) WHERE place <= 12""")
def extraction_context(spark, sf_dir):
    """D19: what the extraction of a turn's facts is told of the graph."""
    memory = _memory(spark, sf_dir)
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    return search.extraction_context(memory.texts, graph.settled(memory.edges), _entities(turns, "qid"))


# --- vectors


@query(f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS token FROM documents), c AS (SELECT doc_id, h % 256 AS slot, CASE WHEN (h // 256) % 2 = 1 THEN -1 ELSE 1 END AS sign FROM (SELECT doc_id, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) AS h FROM w)), v AS (SELECT doc_id, slot, CAST(sum(sign) AS DOUBLE) AS v FROM c GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n, count(*) FILTER (WHERE v <> 0) AS used FROM v GROUP BY 1), b AS (SELECT doc_id, min(slot) FILTER (WHERE abs(v) = m) AS first_at FROM (SELECT *, max(abs(v)) OVER (PARTITION BY doc_id) AS m FROM v) GROUP BY 1) SELECT d.doc_id AS doc_id, coalesce(used, 0) AS used, CASE WHEN used > 0 THEN CAST(first_at AS INTEGER) END AS slot, round(CASE WHEN used > 0 THEN v.v / n ELSE 0 END, 6) AS value FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN v ON v.doc_id = d.doc_id AND v.slot = b.first_at")
def text_embed(spark, sf_dir):
    """Hashed words of whole documents: how many numbers are used, and the first of the largest."""
    v = search.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    size = F.array_max(F.transform("embedding", F.abs))
    at = F.when(size > 0, F.array_position(F.transform("embedding", F.abs), size).cast("int") - 1)
    return v.select("doc_id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("used"), at.alias("slot"), F.round(F.coalesce(F.get("embedding", at), F.lit(0.0)), 6).alias("value"))


@query()
def vector_topk_ivf(spark, sf_dir):
    """Ids divisible by 20 against all rows through an inverted file; recall is measured in the tests. Vectors without
    clusters, as most of these, need many probes."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = VectorIndex(spark, f"{graph.shared_base(spark).rstrip('/')}/ivf-{spark.sparkContext.applicationId}-{id(v)}")
    index.build(v, lists=32)
    found = index.search(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query")), 10, probes=24)
    return found.select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


# --- streams with state

_SPOKEN = "regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[a-z]+')"


def _spoken(spark, sf_dir):
    turns = _stream(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.explode(style.letter_words(F.col("text"))).alias("word"))


@query(f"WITH w AS (SELECT conv_id, turn, unnest({_SPOKEN}) AS word FROM conversations), c AS (SELECT conv_id, turn, word, count(*) AS n FROM w GROUP BY 1, 2, 3), l AS (SELECT conv_id, max(turn) AS last FROM c GROUP BY 1) SELECT c.conv_id AS conv_id, word, round(sum(0.1 * pow(0.9, last - turn) * n) + 1e-9, 6) AS score FROM c JOIN l ON c.conv_id = l.conv_id GROUP BY 1, 2")
def stream_session_ema(spark, sf_dir):
    scores = windows.drained(spark, states.session_scores(_spoken(spark, sf_dir)), ["conv_id", "word"])
    return states.as_of_last_turn(scores).withColumn("score", F.round(F.col("score") + 1e-9, 6))


@query()
def stream_patterns(spark, sf_dir):
    """Pattern memory; the other dialect has no back references, so it is tested against the batch form."""
    return windows.drained(spark, states.patterns(_spoken(spark, sf_dir).select("word")), ["form"])


@query("SELECT conv_id, back, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(role, '')) AS back FROM conversations) WHERE back <= 60")
def stream_last_messages(spark, sf_dir):
    return windows.drained(spark, states.last_messages(_stream(spark, sf_dir, "conversations")), ["conv_id", "back"])
