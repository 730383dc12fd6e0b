"""A memory store one can write to: memories with their vectors, facts, entities and history, changed by commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, search, store
from .versions import Versions

#: Tables of rows by memory; a row counts until a later commit lets go of its memory.
PARTS = ("memories", "vectors", "said", "index")
HISTORY = "memory_id long, event string, old_memory string, new_memory string, created_at timestamp, updated_at timestamp"
GONE = "memory_id long, seq long"


class MemoryStore:
    """Memories ``(memory_id, text)`` below ``root``, a folder that driver and executors share.

    Every change is one commit of :class:`Versions`: texts, vectors, facts, entities and history change together or not at
    all, and any earlier version can be read or restored. A change appends the rows of the memories it touches and who is
    gone; nothing else is rewritten until :meth:`compact`. Ids are integers, unique within a change; null texts are empty."""

    def __init__(self, spark: SparkSession, root: str, width: int = 256):
        self.spark, self.store, self.width = spark, Versions(spark, root), width
        if not self.store.numbers():
            none = self._rows(spark.createDataFrame([], "memory_id long, text string"), 0)
            with self.store.change("new") as change:
                for name in PARTS:
                    change.empty(name, none[name].schema)
                change.empty("history", HISTORY)
                change.empty("gone", GONE)

    # reading

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """``memories``, ``vectors``, ``said(memory_id, source, relationship, destination)`` or ``index(memory_id, entity)`` as
        they are, or ``history``."""
        rows = self.store.read(name, version)
        if name not in PARTS:
            return rows
        last = self.store.read("gone", version).groupBy("memory_id").agg(F.max("seq").alias("until"))
        return rows.join(last, "memory_id", "left").where("until is null or seq > until").drop("until", "seq")

    def edges(self, version: int | None = None) -> DataFrame:
        """(source, relationship, destination, weight): facts, accumulated over memories."""
        return self.read("said", version).groupBy("source", "relationship", "destination").agg(F.count("*").cast("double").alias("weight"))

    # changes

    def add(self, new: DataFrame, at, same: float = 0.9) -> None:
        """Store ``new(memory_id, text)``: what is like a stored memory at cosine ``same`` is merged into its text, the rest is
        added; the new memories are compared with stored ones, not with each other."""
        new = graph.settled(new.select("memory_id", F.coalesce("text", F.lit("")).alias("text")))
        asked = search.embedded(new, "memory_id", width=self.width).select(F.col("memory_id").alias("qid"), F.col("embedding").alias("query"))
        kept = self.read("vectors").select(F.col("memory_id").alias("vec_id"), "embedding")
        told = graph.settled(store.classify(asked, kept, same).join(new.select(F.col("memory_id").alias("qid"), "text"), "qid"))
        old = self.read("memories")
        changes = told.where("event = 'UPDATE'").select(F.col("target").alias("memory_id"), F.col("qid").alias("seq"), "text")
        merged = self._merged(old, changes)
        added = told.where("event = 'ADD'").select(F.col("qid").alias("memory_id"), F.lit(None).cast("string").alias("old_memory"), "text")
        self._put("add", merged.select("memory_id", "old_memory", "text", F.lit("UPDATE").alias("event")).union(added.select("memory_id", "old_memory", "text", F.lit("ADD"))), at)

    def update(self, changes: DataFrame, at) -> None:
        """Merge the texts of ``changes(memory_id, seq, text)`` into the memories of those ids, by ``seq``; ids that are not
        stored are left out."""
        merged = self._merged(self.read("memories"), changes)
        self._put("update", merged.withColumn("event", F.lit("UPDATE")), at)

    def delete(self, ids: DataFrame, at) -> None:
        """Forget the memories of ``ids(memory_id)``; their history ends with a DELETE."""
        gone = graph.settled(self.read("memories").join(ids.select("memory_id").distinct(), "memory_id", "left_semi"))
        with self.store.change("delete") as change:
            change.append("gone", self._gone(gone, change.base + 1))
            change.append("history", self._history(gone.select("memory_id", F.col("text").alias("old_memory"), F.lit(None).cast("string").alias("text"), F.lit("DELETE").alias("event")), at))

    def delete_all(self, at) -> int:
        """Forget all memories; the history keeps what they were. Returns how many there were."""
        known = self.read("memories")
        n = known.count()
        with self.store.change("delete all") as change:
            change.append("history", self._history(known.select("memory_id", F.col("text").alias("old_memory"), F.lit(None).cast("string").alias("text"), F.lit("DELETE").alias("event")), at))
            for name in (*PARTS, "gone"):
                change.clear(name)
        return n

    def forget_entities(self, names: DataFrame) -> None:
        """Facts that touch one of ``names(name)`` go, and so do the names in the index; texts stay."""
        wanted = names.select(F.upper(F.trim("name")).alias("entity")).distinct()
        node = wanted.select(F.concat(F.lit("ent::"), F.col("entity")).alias("node"))
        said, index = self.read("said"), self.read("index")
        hit = said.join(node, said.source == node.node, "left_semi").union(said.join(node, said.destination == node.node, "left_semi")).select("memory_id").union(index.join(wanted, "entity", "left_semi").select("memory_id")).distinct()
        hit = graph.settled(hit)
        of = lambda frame: frame.join(hit, "memory_id", "left_semi")
        left = of(said).join(node, F.col("source") == F.col("node"), "left_anti").join(node, F.col("destination") == F.col("node"), "left_anti")
        self._rewrite("forget entities", hit, {"memories": of(self.read("memories")), "vectors": of(self.read("vectors")), "said": left, "index": of(index).join(wanted, "entity", "left_anti").select("memory_id", "entity")})

    def merge_entities(self, mapping: DataFrame, at) -> None:
        """Names of ``mapping(source_name, target_name)`` become others everywhere: in texts, which get new vectors, facts
        and the index. Memories that don't hold a name are not touched."""
        known = mapping.select(F.upper(F.trim("source_name")).alias("entity"), F.upper(F.trim("target_name")).alias("target")).where("entity <> target").dropDuplicates(["entity"])
        known = graph.settled(known)
        index, said, old = self.read("index"), self.read("said"), self.read("memories")
        pairs = index.join(known, "entity").groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("entity", "target"))).alias("pairs"))  # the names of one memory
        hit = graph.settled(pairs)
        of = lambda frame: frame.join(hit.select("memory_id"), "memory_id", "left_semi")
        fold = F.aggregate("pairs", F.coalesce("text", F.lit("")), lambda t, p: store.rewritten(t, p["entity"], p["target"]))
        texts = graph.settled(old.join(hit, "memory_id").select("memory_id", F.col("text").alias("old_memory"), fold.alias("text")))
        to = known.select(F.concat(F.lit("ent::"), F.col("entity")).alias("from"), F.concat(F.lit("ent::"), F.col("target")).alias("to"))
        end = lambda frame, c: frame.join(to.toDF(f"f{c}", f"t{c}"), F.col(c) == F.col(f"f{c}"), "left").withColumn(c, F.coalesce(f"t{c}", c)).drop(f"f{c}", f"t{c}")
        moved = end(end(of(said), "source"), "destination").select("memory_id", "source", "relationship", "destination").distinct()
        names = of(index).join(known, "entity", "left").select("memory_id", F.coalesce("target", "entity").alias("entity")).distinct()
        vectors = search.embedded(texts, "memory_id", width=self.width)
        history = texts.where("old_memory <> text").select("memory_id", "old_memory", "text", F.lit("UPDATE").alias("event"))
        self._rewrite("merge entities", hit, {"memories": texts.select("memory_id", "text"), "vectors": vectors, "said": moved, "index": names}, self._history(history, at))

    def merge_relations(self, mapping: DataFrame) -> None:
        """Relationships of ``mapping(source_name, target_name)`` become others in all facts."""
        known = mapping.select(F.upper("source_name").alias("relationship"), F.upper("target_name").alias("target")).where("relationship <> target").dropDuplicates(["relationship"])
        said = self.read("said")
        hit = graph.settled(said.join(known, "relationship", "left_semi").select("memory_id").distinct())
        of = lambda frame: frame.join(hit, "memory_id", "left_semi")
        moved = of(said).join(known, "relationship", "left").select("memory_id", "source", F.coalesce("target", "relationship").alias("relationship"), "destination").distinct()
        self._rewrite("merge relations", hit, {"memories": of(self.read("memories")), "vectors": of(self.read("vectors")), "said": moved, "index": of(self.read("index"))})

    def compact(self) -> None:
        """Write what counts anew and forget what is gone."""
        with self.store.change("compact") as change:
            for name in PARTS:
                change.replace(name, self.read(name).withColumn("seq", F.lit(change.base + 1).cast("long")).select(*self.store.read(name).columns))
            change.clear("gone")

    # parts

    def _merged(self, old: DataFrame, changes: DataFrame) -> DataFrame:
        """(memory_id, old_memory, text) of the stored memories that change."""
        ids = changes.select("memory_id").distinct()
        before = graph.settled(old.join(ids, "memory_id", "left_semi"))
        after = store.updated(before, changes.join(before.select("memory_id"), "memory_id", "left_semi"))
        return graph.settled(before.select("memory_id", F.col("text").alias("old_memory")).join(after, "memory_id"))

    def _rows(self, texts: DataFrame, seq: int) -> dict[str, DataFrame]:
        """All parts of ``texts(memory_id, text)``."""
        facts = store.ingested(texts)
        parts = {"memories": texts.select("memory_id", "text"), "vectors": search.embedded(texts, "memory_id", width=self.width), "said": facts["mentions"], "index": facts["memory_entities"].select("memory_id", F.upper(F.trim("entity")).alias("entity")).distinct()}
        return {name: df.withColumn("seq", F.lit(seq).cast("long")) for name, df in parts.items()}

    def _gone(self, ids: DataFrame, seq: int) -> DataFrame:
        return ids.select("memory_id").distinct().withColumn("seq", F.lit(seq).cast("long"))

    def _history(self, events: DataFrame, at) -> DataFrame:
        """``events(memory_id, old_memory, text, event)`` as history rows; only an ADD has a time of creation."""
        rows = events.select("memory_id", "event", "old_memory", F.col("text").alias("new_memory"))
        return rows.select("*", F.when(F.col("event") == "ADD", at).cast("timestamp").alias("created_at"), at.cast("timestamp").alias("updated_at"))

    def _put(self, note: str, changed: DataFrame, at) -> None:
        """Commit ``changed(memory_id, old_memory, text, event)``."""
        changed = graph.settled(changed.select("memory_id", "old_memory", "text", "event"))
        with self.store.change(note) as change:
            for name, rows in self._rows(changed.select("memory_id", "text"), change.base + 1).items():
                change.append(name, rows)
            change.append("gone", self._gone(changed.where("event <> 'ADD'"), change.base))
            change.append("history", self._history(changed, at))

    def _rewrite(self, note: str, hit: DataFrame, parts: dict[str, DataFrame], history: DataFrame | None = None) -> None:
        with self.store.change(note) as change:
            for name, rows in parts.items():
                change.append(name, rows.withColumn("seq", F.lit(change.base + 1).cast("long")))
            change.append("gone", self._gone(hit, change.base))
            if history is not None:
                change.append("history", history)
