"""Memory, entity and history tables: versions, merges, replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def timeline(history: DataFrame) -> DataFrame:
    """Events of each memory in order of creation, or of update where that is null."""
    at = F.coalesce("created_at", "updated_at")
    order = Window.partitionBy("memory_id").orderBy(at, "id")
    return history.withColumn("seq", F.row_number().over(order))


def current_state(history: DataFrame) -> DataFrame:
    """The last event of each memory, deleted ones gone. One map-side combined aggregate."""
    at = F.struct(F.coalesce("created_at", "updated_at").alias("at"), "id")
    last = history.groupBy("memory_id").agg(F.max_by(F.struct("event", "new_memory", "id"), at).alias("e"), F.count("*").alias("n_events"))
    return last.where(F.col("e.event") != "DELETE").select("memory_id", F.col("e.event").alias("event"), F.col("e.new_memory").alias("memory"), F.col("e.id").alias("last_id"), "n_events")


def resolve_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Canonical name of each ``names(entity)``; the last alias row wins, unknown names stand for themselves."""
    last = aliases.groupBy("alias").agg(F.max("canonical").alias("canonical"))
    return names.join(last, F.col("entity") == F.col("alias"), "left").select("entity", F.coalesce("canonical", "entity").alias("canonical"))


def merge_entities(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends rewritten by ``mapping(source_name, target_name)``; triples that meet add their weights."""
    m = lambda end: mapping.select(F.col("source_name").alias(end), F.col("target_name").alias(f"{end}_to"))
    moved = edges.join(m("source"), "source", "left").join(m("destination"), "destination", "left")
    return moved.groupBy(F.coalesce("source_to", "source").alias("source"), "relationship", F.coalesce("destination_to", "destination").alias("destination")).agg(F.sum("weight").alias("weight"))


def delete_candidates(memories: DataFrame, query: str, column: str = "text") -> DataFrame:
    """Memories whose lower-cased text holds any token of ``query`` longer than two characters."""
    tokens = [t for t in query.lower().split() if len(t) > 2]
    hit = F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(F.col(column)), t)) if tokens else F.lit(False)
    return memories.where(hit)


def entity_index(memories: DataFrame, keys: list[str], entities) -> DataFrame:
    """(keys..., entity): the entities of each memory, each once."""
    return memories.select(*keys, F.explode(F.array_distinct(entities)).alias("entity"))
