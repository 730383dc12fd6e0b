"""The memory store as tables: adds, updates, deletes, merges and what they leave in the history. Each operator takes the
tables as they are and returns them as they will be; nothing is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import graph, vector


def classify(new: DataFrame, vectors: DataFrame, same: float = 0.9, related: float = 0.82) -> DataFrame:
    """(qid, event, target, related, score): each of ``new(qid, query)`` as an UPDATE of its nearest stored vector at
    cosine ``same`` or more, else an ADD; ``related`` marks a nearest one between the thresholds."""
    best = vector.top_k(vectors, new, 1)
    hit = F.col("score") >= same
    found = best.select("qid", "score", F.when(hit, "UPDATE").otherwise("ADD").alias("event"), F.when(hit, F.col("vec_id")).alias("target"), (~hit & (F.col("score") >= related)).alias("related"))
    return new.select("qid").join(found, "qid", "left").select("qid", F.coalesce("event", F.lit("ADD")).alias("event"), "target", F.coalesce("related", F.lit(False)).alias("related"), "score")


def updated(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """``memories(memory_id, text)`` with the texts of ``changes(memory_id, seq, text)`` merged in by ``seq``, and new ids
    added. Tokens stay in first-seen order."""
    every = memories.select("memory_id", F.lit(-1).cast("long").alias("seq"), "text").unionByName(changes.select("memory_id", F.col("seq").cast("long").alias("seq"), "text"))
    said = every.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("said"))
    fold = F.aggregate(F.col("said"), F.lit(None).cast("string"), lambda s, x: F.when(s.isNull(), x["text"]).otherwise(F.coalesce(text.merged_text(s, x["text"]), s)))
    return said.select("memory_id", fold.alias("text"))


def updated_by_query(memories: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """:func:`updated` where each of ``asked(qid, query, text)`` changes the memory whose vector is nearest to its query;
    several that meet in one memory are merged by ``qid``."""
    best = vector.top_k(vectors, asked.select("qid", "query"), 1).select("qid", "vec_id")
    return updated(memories, best.join(asked, "qid").select(F.col("vec_id").alias("memory_id"), F.col("qid").alias("seq"), "text"))


def without(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table of rows by ``memory_id`` without those of ``gone(memory_id)``: memories, edges, their properties,
    vectors and index entries go together."""
    ids = gone.select("memory_id").distinct()
    return {name: t.join(ids, "memory_id", "left_anti") for name, t in tables.items()}


def appended(history: DataFrame, events: DataFrame, at) -> DataFrame:
    """``history`` with ``events(memory_id, event, old_memory, new_memory)``; only an ADD has a time of creation."""
    added = F.when(F.col("event") == "ADD", at)
    return history.unionByName(events.withColumn("created_at", added).withColumn("updated_at", at), allowMissingColumns=True)


def upserted_edges(edges: DataFrame, new: DataFrame, add: bool = True) -> DataFrame:
    """Edges with ``new`` ones; a triple's weights add up, or the new weight stands. The last memory to say it is kept."""
    every = edges.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    weight = F.sum("weight") if add else F.max_by("weight", "_new")
    return every.groupBy("source", "relationship", "destination").agg(weight.alias("weight"), F.max_by("memory_id", F.struct("_new", "memory_id")).alias("memory_id"))


def upserted_props(props: DataFrame, new: DataFrame) -> DataFrame:
    """(node_id, key, value) where the value of the greatest ``seq`` stands."""
    every = props.unionByName(new)
    return every.groupBy("node_id", "key").agg(F.max_by("value", "seq").alias("value"))


def with_props(edges: DataFrame, props: DataFrame, wanted: dict) -> DataFrame:
    """``edges`` by ``memory_id`` whose properties in ``props(memory_id, key, value)`` all fit ``wanted``, a test a key, with
    the values as columns. The tests reach the scan of the properties; only what fits any of them is gathered."""
    fits = F.lit(False)
    for key, test in wanted.items():
        fits = fits | ((F.col("key") == key) & test(F.col("value")))
    kept = props.where(fits).groupBy("memory_id").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in wanted))
    return edges.join(kept.dropna(subset=list(wanted)), "memory_id")


def merged_relations(edges: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Relationship types renamed; triples that meet add their weights."""
    to = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return edges.groupBy("source", F.coalesce(F.try_element_at(to, F.col("relationship")), "relationship").alias("relationship"), "destination").agg(F.sum("weight").alias("weight"))


def rewritten(column, old, new):
    """A text after its entity was merged: the name as it is, upper, lower and with capitals, one after the other."""
    for case in (lambda c: c, F.upper, F.lower, F.initcap):
        column = F.replace(column, case(old), case(new))
    return column


def ingested(memories: DataFrame, column: str = "text") -> dict[str, DataFrame]:
    """``nodes(id, name)``, ``edges`` accumulated over what the facts in ``memories(memory_id, text)`` say, ``mentions`` with
    each edge's memories, and the entity index. A fact said twice in a memory, by its key, counts once."""
    said = memories.select("memory_id", F.posexplode(text.triplets(F.col(column))).alias("place", "t")).select("memory_id", "place", "t.src", "t.rel", "t.dst")
    once = said.groupBy("memory_id", "src", text.relation_key(F.col("rel")).alias("key"), "dst").agg(F.min_by("rel", "place").alias("rel"))
    node = lambda c: F.concat(F.lit("ent::"), text.name_key(F.col(c)))
    mentions = once.select("memory_id", node("src").alias("source"), F.col("rel").alias("relationship"), node("dst").alias("destination"))
    ends = once.select(F.col("src").alias("name")).union(once.select("dst")).distinct()
    edges = mentions.groupBy("source", "relationship", "destination").agg(F.count("*").cast("double").alias("weight"), F.max("memory_id").alias("memory_id"))
    index = once.select("memory_id", F.explode(F.array("src", "dst")).alias("entity")).distinct()
    return {"nodes": ends.select(node("name").alias("id"), "name"), "edges": edges, "mentions": mentions, "memory_entities": index}


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between names with their ends' ids; an end without a node has none."""
    end = lambda side: nodes.select(F.upper("name").alias(f"_{side}"), F.col("id").alias(f"{side}_id"))
    met = edges.join(end("source"), F.upper("source") == F.col("_source"), "left").join(end("destination"), F.upper("destination") == F.col("_destination"), "left")
    return met.drop("_source", "_destination")


def exported(mentions: DataFrame, most: int = 5) -> DataFrame:
    """The drawing's edge list: each triple once, with its count, line width, label and first ``most`` memories."""
    up = [F.upper(c).alias(c) for c in ("source", "relationship", "destination")]
    first = mentions.select(*up, "memory_id").withColumn("k", F.row_number().over(Window.partitionBy("source", "relationship", "destination").orderBy("memory_id")))
    n = graph.duplicate_counts(mentions)
    tip = first.where(F.col("k") <= most).groupBy("source", "relationship", "destination").agg(F.array_join(F.transform(F.array_sort(F.collect_list("memory_id")), lambda x: x.cast("string")), ", ").alias("memories"))
    return n.join(tip, ["source", "relationship", "destination"]).withColumn("label", F.when(F.col("n") > 1, F.concat("relationship", F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.col("relationship")))
