"""Style analytics over messages: n-grams, shares, decayed profiles, pattern groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def letter_words(c: Column) -> Column:
    """Lower-cased runs of letters, without diacritics; null has none."""
    return F.regexp_extract_all(F.lower(text.without_marks(F.coalesce(c, F.lit("")))), F.lit("[a-z]+"), F.lit(0))


def words(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, word): :func:`letter_words` of each message."""
    w = letter_words(F.col("text"))
    return messages.select("conv_id", "turn", F.posexplode(w).alias("pos", "word"))


def ngrams(messages: DataFrame, n: int) -> DataFrame:
    """(gram, n): counted over all messages, map-side combined."""
    w = letter_words(F.col("text"))
    # the words are bound once; a plain column would be evaluated again for each gram
    grams = F.transform(F.array(w), lambda v: F.when(F.size(v) >= n, F.transform(F.sequence(F.lit(1), F.size(v) - (n - 1)), lambda i: F.array_join(F.slice(v, i, n), " "))))[0]
    return messages.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def shares(counts: DataFrame, by: str, item: str, n: int, top: int) -> DataFrame:
    """(by, item, n, pct, rank): share of the group's total in percent, and the ``top`` items, ties by item."""
    group = Window.partitionBy(by)
    ranked = counts.withColumn("pct", F.round(100.0 * F.col(n) / F.sum(n).over(group), 4)).withColumn("rank", F.row_number().over(group.orderBy(F.desc(n), item)))
    return ranked.where(F.col("rank") <= top)


def lifetime(messages: DataFrame) -> DataFrame:
    """Sums of message features over each conversation, ratios recomputed from the sums."""
    f = messages.select("conv_id", *text.message_features(F.col("text")))
    sums = f.groupBy("conv_id").agg(F.count("*").alias("messages"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_sentences", "commas", "all_caps", "title", "lower_case")))
    return sums.withColumn("mean_sentence", text.ratio(F.col("n_tokens"), F.col("n_sentences")))


def session_ema(counts: DataFrame, decay: float = 0.9) -> DataFrame:
    """(conv_id, word, score): exponentially decayed counts at each conversation's last turn, sum of (1 - d) d^(T - t) c.
    The closed form of the running update, so batch and stream agree."""
    last = counts.groupBy("conv_id").agg(F.max("turn").alias("last"))
    return counts.join(last, "conv_id").groupBy("conv_id", "word").agg(F.sum((1 - decay) * F.pow(F.lit(decay), F.col("last") - F.col("turn")) * F.col("n")).alias("score"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)


def elongation_groups(words_: DataFrame) -> DataFrame:
    """(form, canonical, variants, total): words by their collapsed form; the shortest, then first, is canonical."""
    keyed = words_.withColumn("form", text.collapsed(F.col("word")))
    return keyed.groupBy("form").agg(F.min_by("word", F.struct(F.char_length("word"), "word")).alias("canonical"), F.count("*").alias("variants"), F.sum("n").alias("total"))


def edit_pairs(words_: DataFrame, most: int = 1) -> DataFrame:
    """(a, b): words within one edit. Words that far apart share a deletion variant, so the join is on variants and no
    pair is formed that doesn't share one."""
    if most != 1:
        raise ValueError("deletion variants are built for one edit")
    w = words_.select("word").distinct()
    cuts = F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.concat(F.col("word").substr(F.lit(1), i - 1), F.col("word").substr(i + 1, F.char_length("word"))))
    keyed = w.select("word", F.explode(F.array_distinct(F.array_append(cuts, F.col("word")))).alias("v"))
    a, b = keyed.select(F.col("word").alias("a"), "v"), keyed.select(F.col("word").alias("b"), "v")
    return a.join(b, "v").where("a < b").select("a", "b").distinct().where(F.levenshtein("a", "b") <= most)


def lexicon_hits(messages: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """(conv_id, turn, category, n): words of each message found in the lexicon, a parameter and so broadcast."""
    rows = [(c, w) for c, ws in lexicon.items() for w in ws]
    known = messages.sparkSession.createDataFrame(rows, "category string, word string")
    return words(messages).join(F.broadcast(known), "word").groupBy("conv_id", "turn", "category").agg(F.count("*").alias("n"))


def word_classes(messages: DataFrame, signature: str, rare: str) -> DataFrame:
    """(conv_id, turn, frequent, signature, rare): occurrences of words said more than once in the message, occurrences
    of words longer than six letters or matching ``signature``, and distinct words longer than eight or matching ``rare``."""
    said = words(messages).where("char_length(word) > 1").groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))
    size, total = F.char_length("word"), lambda c, n: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    marked, odd = (size > 6) | F.col("word").rlike(signature), (size > 8) | F.col("word").rlike(rare)
    return said.groupBy("conv_id", "turn").agg(total(F.col("n") > 1, F.col("n")).alias("frequent"), total(marked, F.col("n")).alias("signature"), total(odd, F.lit(1)).alias("rare"))


def percentages(scores: DataFrame, item: str) -> DataFrame:
    """``scores(conv_id, turn, item, n)`` as percentages of each message at two places; what rounding leaves of 100 goes to
    the largest, ties to the first item."""
    message = Window.partitionBy("conv_id", "turn")
    pct = scores.withColumn("p", F.round(100.0 * F.col("n") / F.sum("n").over(message), 2))
    first = F.row_number().over(message.orderBy(F.desc("n"), item)) == 1
    drift = F.when(first, 100.0 - F.sum("p").over(message)).otherwise(0.0)
    return pct.select("conv_id", "turn", item, F.round(F.col("p") + drift, 2).alias("pct"))


def blueprint(hits: DataFrame, messages: DataFrame) -> DataFrame:
    """(category, overall, share): hits per hundred messages, at most 100, and the overalls above zero normalised to 100.
    One row a category, so the window over them is small whatever the input."""
    total = messages.agg(F.greatest(F.count("*"), F.lit(1)).alias("messages"))
    summed = hits.groupBy("category").agg(F.sum("n").alias("n")).join(F.broadcast(total))
    overall = summed.select("category", F.round(F.least(F.lit(100.0), 100.0 * F.col("n") / F.col("messages")), 2).alias("overall")).where("overall > 0")
    return overall.withColumn("share", F.round(100.0 * F.col("overall") / F.sum("overall").over(Window.partitionBy()), 1))
