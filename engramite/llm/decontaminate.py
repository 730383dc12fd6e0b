"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every ``w`` consecutive k-gram hashes a text keeps the least, so two texts that share ``k + w - 1`` words share a kept
hash at the same place of the shared span. Test fingerprints meet training fingerprints in one equi-join; each hit is
then extended word by word to both sides, which settles it exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_columns, text_key

K, WINDOWS = 5, 6
SPAN = K + WINDOWS - 1
#: Benchmark fingerprints (about 200 bytes each) up to which the benchmark's side is broadcast; beyond it both sides shuffle.
BROADCAST_ROWS = 300_000
#: What stands between words: all of ASCII but digits and letters. Spaces are left to the split.
MARKS = r"[\x00-\x1F\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words, A-Z lower-cased. lower() knows other capitals too, so it is used on ASCII only. Marks become spaces and
    the text is split at spaces: ten times as fast as matching each word by a regular expression."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(F.regexp_replace(low, MARKS, " "), " "), ""), F.array().cast("array<string>"))


def _let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once. A plain column would be inlined into the lambdas that read it and
    evaluated again for each element."""
    return F.transform(F.array(value), body)[0]


def _grams(words: Column, k: int) -> Column:
    n = F.size(words)
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def _context(words: Column, at: Column) -> Column:
    """The k-gram at ``at`` with WINDOWS - 1 words on both sides, null beyond the text's ends."""
    return F.struct(*(F.when(at + j >= 0, F.get(words, at + j)).alias(f"w{i}") for i, j in enumerate(range(1 - WINDOWS, K + WINDOWS - 1))))


def _least_of_windows(g: Column) -> Column:
    n = F.size(g)
    return F.when(n >= WINDOWS, F.transform(F.sequence(F.lit(0), n - WINDOWS), lambda s: F.least(*(F.get(g, s + j) for j in range(WINDOWS))))).otherwise(F.array().cast("array<bigint>"))


def _winnowed(words: Column) -> Column:
    """``array<struct<at, hash>>``: every position that is least in some window. All positions of a tie stay, so
    repetitive texts keep each alignment."""

    def chosen(g: Column, m: Column) -> Column:
        least_in = lambda h, i: F.coalesce(h.isin(*(F.when(i - j >= 0, F.get(m, i - j)) for j in range(WINDOWS))), F.lit(False))
        kept = F.transform(g, lambda h, i: F.when(least_in(h, i), F.struct(i.alias("at"), h.alias("hash"))))
        return F.filter(kept, lambda x: x.isNotNull())

    return _let(_grams(words, K), lambda g: _let(_least_of_windows(g), lambda m: chosen(g, m)))


def fingerprints(texts: DataFrame, word_array: Column) -> DataFrame:
    """``texts`` exploded to ``(..., words, at, hash)``, one row per kept fingerprint."""
    whole = texts.withColumn("x", _let(word_array, lambda w: F.struct(w.alias("words"), _winnowed(w).alias("fps"))))
    return whole.select(*texts.columns, "x", F.explode("x.fps").alias("p")).select(*texts.columns, F.col("x.words").alias("words"), F.col("p.at").alias("at"), F.col("p.hash").alias("hash"))


def _extended(pairs: DataFrame) -> DataFrame:
    """From matching fingerprints to ``(doc_id, tkey, item_id, a, b)``: the shared run around each, SPAN words or longer."""
    same = lambda i: F.coalesce(F.col(f"d.w{i}") == F.col(f"t.w{i}"), F.lit(False))
    side = WINDOWS - 1

    def reach(places: list[int]) -> Column:
        out = F.lit(0)
        for i in reversed(places):
            out = F.when(same(i), out + 1).otherwise(F.lit(0))
        return out

    whole = same(side)
    for i in range(side + 1, side + K):
        whole = whole & same(i)
    runs = pairs.where(whole).select("doc_id", "tkey", "item_id", (F.col("at") - reach(list(range(side - 1, -1, -1)))).alias("a"), (F.col("at") + K + reach(list(range(side + K, 2 * side + K)))).alias("b"))
    return runs.where(F.col("b") - F.col("a") >= SPAN)


def _long_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    whole = items.withColumn("n", F.size(words_of(F.col("text")))).where(F.col("n") >= SPAN).select("item_id", "text")
    test = fingerprints(whole, words_of(F.col("text"))).select("item_id", F.col("hash").alias("t_hash"), _context(F.col("words"), F.col("at")).alias("t"))
    train, on = fingerprints(docs, words_of(F.col("text"))).drop("text"), F.col("hash") == F.col("t_hash")
    if test.count() <= BROADCAST_ROWS:  # counted before the benchmark's side may be broadcast
        met = train.join(F.broadcast(test), on).withColumn("d", _context(F.col("words"), F.col("at")))
    else:
        met = train.select("doc_id", "tkey", "at", "hash", _context(F.col("words"), F.col("at")).alias("d")).join(test, on)
    return _extended(met)


def _grams_of(words: Column, lengths: list[int]) -> Column:
    """``array<struct<at, m, hash>>`` of all runs of ``m`` words, for each of the lengths."""
    named = lambda m: lambda h, i: F.struct(i.alias("at"), F.lit(m).alias("m"), h.alias("hash"))
    each = [F.transform(_grams(words, m), named(m)) for m in lengths]
    return each[0] if len(each) == 1 else F.concat(*each)


def _short_hits(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """Items of fewer than SPAN words are one window each: their whole hash against every run of as many words, all
    lengths in one pass over the documents."""
    short = items.select("item_id", words_of(F.col("text")).alias("own")).withColumn("m", F.size("own")).where((F.col("m") > 0) & (F.col("m") < SPAN))
    lengths = sorted(r[0] for r in short.select("m").distinct().collect())  # at most SPAN - 1 of them
    if not lengths:
        return None
    whole = F.coalesce(*(F.when(F.col("m") == m, F.xxhash64(*(F.get("own", j) for j in range(m)))) for m in lengths))
    test = short.select("item_id", "own", F.col("m").alias("t_m"), whole.alias("t_hash"))
    every = _let(words_of(F.col("text")), lambda w: F.struct(w.alias("words"), _grams_of(w, lengths).alias("g")))
    each = docs.select("doc_id", "tkey", every.alias("x")).select("doc_id", "tkey", "x", F.explode("x.g").alias("g")).select("doc_id", "tkey", "g.at", "g.m", "g.hash", "x")
    on, window = (F.col("hash") == F.col("t_hash")) & (F.col("m") == F.col("t_m")), F.slice("x.words", F.col("at") + 1, F.col("m"))
    if test.count() <= BROADCAST_ROWS:
        met = each.join(F.broadcast(test), on).withColumn("w", window)
    else:
        met = each.select("doc_id", "tkey", "at", "m", "hash", window.alias("w")).join(test, on)
    return met.where(F.col("w") == F.col("own")).select("doc_id", "tkey", "item_id", F.col("at").alias("a"), (F.col("at") + F.col("m")).alias("b"))


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, tkey, item_id, a, b)``: words a to b (exclusive) of the document lie in occurrences of the item's windows."""
    train = text_columns(docs, id_col, text_col).select("doc_id", text_key().alias("tkey"), "text")
    test = items.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    long_, short = _long_hits(train, test), _short_hits(train, test)
    return long_ if short is None else long_.union(short)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs``.

    Windows are SPAN consecutive item words (the whole item if it has fewer). Null and empty texts have no words and no
    hits; rows repeating id and text get equal answers; null item ids find hits but no name in the digest; an empty
    benchmark gives zeros and the digest of nothing.
    """
    # per document: the union of its hit runs, folded in order, and its items; both bounded by the document
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("a", "b"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, r: F.struct(F.greatest(s["end"], r["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(s["end"], r["a"]))).alias("n")),
        lambda s: s["n"],
    )
    by_doc = hits(docs, items, id_col, text_col, item_col, item_text_col).groupBy("doc_id", "tkey").agg(merged.alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = text_columns(docs, id_col, text_col).select("doc_id", text_key().alias("tkey"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    both = rows.join(by_doc, rows.doc_id.eqNullSafe(by_doc.doc_id) & (rows.tkey == by_doc.tkey), "left")
    names = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return both.select(
        rows.doc_id, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the documents that hold an occurrence of a benchmark window.

    Null and empty texts stay; of rows that repeat an id, those whose text holds a window go, all copies alike; null ids are
    told apart by their texts. The columns of ``docs`` may have any names. An empty benchmark drops nothing.
    """
    bad_id, bad_key = fresh(docs, "id"), fresh(docs, "key")
    bad = hits(docs, items, id_col, text_col, item_col, item_text_col).select(F.col("doc_id").alias(bad_id), F.col("tkey").alias(bad_key)).distinct()
    own_key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return docs.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(bad_id)) & (own_key == F.col(bad_key)), "left_anti")
