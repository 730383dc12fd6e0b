"""A speaker's style profile: phrases, merged reports, shares, clusters of word forms, and what is printed of them."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text
from . import style


def phrase_bag(messages: DataFrame) -> DataFrame:
    """(conv_id, label, phrase, n): pairs and triples of words, capitals and title words of each conversation."""
    words = style.letter_words(F.col("text"))

    def grams(n: int):
        return lambda v: F.when(F.size(v) >= n, F.transform(F.sequence(F.lit(1), F.size(v) - (n - 1)), lambda i: F.array_join(F.slice(v, i, n), " ")))

    bare = F.filter(F.transform(text.tokens(F.coalesce("text", F.lit(""))), lambda w: F.regexp_replace(w, "[^A-Za-z]", "")), lambda w: w != "")
    part = lambda label, c: messages.select("conv_id", F.lit(label).alias("label"), F.explode(c).alias("phrase"))
    every = part("bigram", F.transform(F.array(words), grams(2))[0]).union(part("trigram", F.transform(F.array(words), grams(3))[0]))
    every = every.union(part("caps", F.filter(bare, lambda w: w.rlike("^[A-Z]{2,}$")))).union(part("title", F.filter(bare, lambda w: w.rlike("^[A-Z][a-z]+$"))))
    return every.groupBy("conv_id", "label", "phrase").agg(F.count("*").alias("n"))


def status(bag: DataFrame) -> DataFrame:
    """One row a conversation of ``bag(conv_id, label, phrase, n)``: distinct phrases in all and of each label, how often
    they were said, and the one said most (ties: the first label, then the first phrase)."""
    of = [F.count_if(F.col("label") == x).alias(f"n_{x}") for x in ("bigram", "trigram", "caps", "title")]
    most = F.min_by("phrase", F.struct(-F.col("n"), "label", "phrase")).alias("most_said")
    return bag.groupBy("conv_id").agg(F.count("*").alias("phrases"), F.sum("n").alias("said"), *of, most)


def prompt_text(bag: DataFrame, top: int = 3) -> DataFrame:
    """(conv_id, prompt): a line for each label with its ``top`` phrases and how often they were said."""
    place = F.row_number().over(Window.partitionBy("conv_id", "label").orderBy(F.desc("n"), "phrase"))
    said = F.struct(F.col("k"), F.concat("phrase", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("text"))
    lines = bag.withColumn("k", place).where(F.col("k") <= top).groupBy("conv_id", "label").agg(F.array_sort(F.collect_list(said)).alias("said"))  # top at most
    line = F.struct("label", F.concat("label", F.lit(": "), F.array_join("said.text", ", ")).alias("text"))
    return lines.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(line))["text"], "\n").alias("prompt"))  # a line a label


def mini_profiles(hits: DataFrame, by: list[str]) -> DataFrame:
    """What is said of a topic under each condition: of ``hits(.., category, n)`` with one row a message and category, the
    messages and words of each ``by``, and the share of the category in all words of the same other conditions."""
    sums = hits.groupBy("category", *by).agg(F.count("*").alias("messages"), F.sum("n").alias("words"))
    every = sums.groupBy(*by).agg(F.sum("words").alias("_all"))
    return sums.join(every, by).select(*by, "category", "messages", "words", F.round(100.0 * F.col("words") / F.col("_all"), 4).alias("pct"))


def merged_reports(messages: DataFrame, by: str) -> DataFrame:
    """Features summed over each ``by``, ratios taken of the sums."""
    f = messages.select(by, *text.message_features(F.col("text")))
    sums = f.groupBy(by).agg(F.count("*").alias("messages"), *(F.sum(c).cast("long").alias(c) for c in ("n_tokens", "n_sentences", "commas", "title", "lower_case")))
    share = lambda a, b, name: text.ratio(F.col(a), F.col(b)).alias(name)
    return sums.select("*", share("n_tokens", "n_sentences", "mean_sentence"), share("commas", "n_tokens", "comma_ratio"), share("title", "n_tokens", "title_ratio"))


def signal_shares(messages: DataFrame, signals: list[str]) -> DataFrame:
    """(signal, n, pct): each signal's share of what all of them count."""
    f = messages.select(*text.message_features(F.col("text")))
    sums = f.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in signals))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("signal"), F.col(c).alias("n")) for c in signals))).alias("s")).select("s.*")
    return rows.withColumn("pct", F.round(F.coalesce(F.try_divide(100.0 * F.col("n"), F.sum("n").over(Window.partitionBy())), F.lit(0.0)), 4))  # a row a signal


def mean_scores(percentages: DataFrame, item: str, top: int = 15) -> DataFrame:
    """(item, mean, share, place): the mean percentage over messages and its share of all means, the ``top`` items."""
    mean = percentages.groupBy(item).agg(F.sum("pct").alias("s"), F.count("*").alias("n")).select(item, F.round(F.col("s") / F.col("n"), 4).alias("mean"))  # a row an emotion
    every = Window.partitionBy()
    shared = mean.withColumn("share", F.round(100.0 * F.col("mean") / F.sum("mean").over(every), 2)).withColumn("place", F.row_number().over(every.orderBy(F.desc("mean"), item)))
    return shared.where(F.col("place") <= top)


def style_blueprint(messages: DataFrame, lexicon: dict[str, list[str]]) -> DataFrame:
    """One row a conversation: how much of its style is each habit, in percent at one place, null where it has none.

    Most are counts over sentences; capitals are a share of tokens, exclamations of sentences. A mean sentence of 15 words is
    the default and says nothing. ``avoids_capitals`` and ``avoids_oxford`` are messages without a capital start, or with
    lists but none with a last comma, over sentences, where they are more than three in ten."""
    f = messages.select("conv_id", "turn", *text.message_features(F.col("text")))
    names = ("n_tokens", "n_sentences", "low_starts", "all_caps", "small_i", "elongated", "emojis", "ellipses", "multi_exclaim", "multi_ask", "mixed_marks", "repeats")
    shout = F.sum(F.round(F.col("exclaiming") * F.col("n_sentences"))).alias("exclaimed")
    no_capital = F.count_if((F.col("n_tokens") > 0) & (F.col("low_starts") >= F.col("n_sentences"))).alias("no_capital")
    no_oxford = F.count_if((F.col("without_oxford") > 0) & (F.col("with_oxford") == 0)).alias("no_oxford")
    sums = f.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in names), shout, no_capital, no_oxford)
    hits = style.lexicon_hits(messages, lexicon).groupBy("conv_id").pivot("category", sorted(lexicon)).agg(F.sum("n"))
    full, n = sums.join(hits.toDF("conv_id", *(f"_{c}" for c in sorted(lexicon))), "conv_id", "left"), F.greatest(F.lit(1), F.col("n_sentences"))
    share = lambda c, name, of=n: F.when(c > 0, F.round(100.0 * c / of, 1)).alias(name)
    often = lambda c, name: F.when(F.col(c) > 0.3 * n, F.round(100.0 * F.col(c) / n, 1)).alias(name)
    mean = F.col("n_tokens") / n
    return full.select(
        "conv_id", share(F.col("low_starts"), "lowercase_starts"), share(F.col("all_caps"), "all_caps", F.greatest(F.lit(1), F.col("n_tokens"))), share(F.col("small_i"), "lowercase_i"), share(F.col("elongated"), "elongations"), share(F.col("emojis"), "emojis"),
        share(F.col("ellipses") + F.col("multi_exclaim") + F.col("multi_ask") + F.col("mixed_marks"), "repeated_punct"), share(F.col("exclaimed"), "exclamations"), *(share(F.col(f"_{c}"), c) for c in sorted(lexicon)), share(F.col("repeats"), "word_repeats"),
        F.when((mean > 0) & (mean != 15.0), F.round(mean, 1)).alias("avg_sentence_length"), often("no_capital", "avoids_capitals"), often("no_oxford", "avoids_oxford"),
    )


def section_report(signals: DataFrame, emotions: DataFrame, bag: DataFrame, min_emotion: float = 1.0, min_count: int = 2, min_share: float = 1.0) -> DataFrame:
    """(section, item, n, pct): the shares of ``signals(signal, n, pct)``, of ``emotions(category, share)`` that reach
    ``min_emotion`` percent, and of the phrases of ``bag(label, phrase, n)`` said ``min_count`` times or more that reach
    ``min_share`` percent of all such."""
    one = signals.select(F.lit(1).alias("section"), F.col("signal").alias("item"), F.col("n").cast("long").alias("n"), "pct")
    two = emotions.where(F.col("share") >= min_emotion).select(F.lit(2), "category", F.lit(None).cast("long"), "share")
    said = bag.groupBy("label", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    total = said.agg(F.sum("n").alias("total"))
    pct = F.round(100.0 * F.col("n") / F.col("total"), 4)
    three = said.join(F.broadcast(total)).select(F.lit(3), F.concat(F.lit("["), "label", F.lit("] "), "phrase"), "n", pct.alias("pct")).where(F.col("pct") >= min_share)  # one row of totals
    return one.union(two).union(three)


def phonetic_pairs(words_: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, score): words that sound alike, found by their collapsed forms; containment, which scores 0.7, lies below."""
    if least <= 0.7:
        raise ValueError("words of different collapsed forms are not met")
    keyed = words_.select("word", text.collapsed(F.col("word")).alias("form"))
    a, b = (keyed.select(F.col("word").alias(c), "form") for c in "ab")
    return a.join(b, "form").where("a < b").select("a", "b", text.phonetic_similarity(F.col("a"), F.col("b")).alias("score")).where(F.col("score") >= least)


def greedy_clusters(words_: DataFrame, category: str) -> DataFrame:
    """(category, word, canonical): words of ``words_(category, word, n)``, most frequent first, join the first canonical
    word of their category within one edit or become one. Words meet through deletion variants, never in all pairs, and
    leaders are found in rounds, so no category is one task."""
    from .similarity import leaders

    of = words_.select(category, "word", "n").groupBy(category, "word").agg(F.sum("n").alias("n"))
    end = lambda c: of.select(F.col("word").alias(c), F.struct(category, "word").alias(f"id_{c}"), F.col(category).alias(f"in_{c}"))
    met = style.edit_pairs(of).join(end("a"), "a").join(end("b"), "b").where(F.col("in_a").eqNullSafe(F.col("in_b")))
    pairs = met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(1.0).alias("score"))
    found = leaders(of.select(F.struct(category, "word").alias("id"), F.struct((-F.col("n")).alias("less"), "word").alias("place")), pairs)
    return found.select(f"id.{category}", "id.word", F.col("leader.word").alias("canonical"))


def semantic_clusters(words_: DataFrame, category: str, least: float = 0.85) -> DataFrame:
    """(category, word, canonical): words of ``words_(category, word, n)``, most frequent first, join the canonical word of
    their category whose trigrams are likest by cosine, ``least`` or more, or become one."""
    from .similarity import leaders, set_pairs, trigrams

    of = words_.select(category, "word", "n").groupBy(category, "word").agg(F.sum("n").alias("n"))
    inside = F.concat(F.coalesce(F.col(category).cast("string"), F.lit("")), F.lit(" "))  # words of two categories share no token
    tokens = F.transform(trigrams(F.col("word")), lambda t: F.concat(inside, t))
    like = set_pairs(of.select(F.struct(category, "word").alias("id"), tokens.alias("tokens")), least, "cosine")
    met = like.where(F.col(f"a.{category}").eqNullSafe(F.col(f"b.{category}")))
    found = leaders(of.select(F.struct(category, "word").alias("id"), F.struct((-F.col("n")).alias("less"), "word").alias("place")), met.select("a", "b", F.round("score", 9).alias("score")), nearest=True)
    return found.select(f"id.{category}", "id.word", F.col("leader.word").alias("canonical"))


def learned(known: DataFrame, counts: DataFrame, category: str, cluster=greedy_clusters) -> tuple[DataFrame, DataFrame]:
    """``known(category, word, canonical)`` with the new words of ``counts(category, word, n)``, and (category, canonical, n):
    what was counted under each canonical word. Words that are known keep theirs; the others are clustered among
    themselves."""
    fresh = counts.join(known, [category, "word"], "left_anti")
    table = known.unionByName(cluster(fresh, category))
    return table, counts.join(table, [category, "word"]).groupBy(category, "canonical").agg(F.sum("n").alias("n"))


def pattern_map(messages: DataFrame) -> DataFrame:
    """``messages`` with ``map``: by bucket, the examples a message gives. Emoji are distinct, 20 at most; words in capitals
    the first 10; what is only counted, such as marks and a small i, is there as often as it occurs."""
    t = F.coalesce("text", F.lit(""))
    each = text.tokens(t)
    bare = F.filter(F.transform(each, lambda w: F.regexp_replace(w, r"[^A-Za-z]", "")), lambda w: w.rlike("^[A-Z]{2,}$"))
    found = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    low = F.filter(text.sentences(t), lambda x: F.regexp_extract(x, r"\p{L}", 0).rlike(r"^\p{Ll}"))
    buckets = {
        "elongations": F.filter(each, lambda w: w.rlike(r"([A-Za-z])\1\1")), "emoji": F.slice(F.array_distinct(found(text.EMOJI)), 1, 20),
        "all_caps": F.slice(bare, 1, 10), "low_starts": F.when(F.size(low) > 0, F.slice(low, 1, 1)).otherwise(F.array().cast("array<string>")),
        "small_i": found("(?<![A-Za-z])i(?![A-Za-z])"), "multi_exclaim": found("!{2,}"), "multi_ask": found(r"\?{2,}"),
        "ellipses": found(r"\.{3}|…"), "mixed_marks": found(r"(?:!\?|\?!)+"), "repeats": found(text.REPEATED),
    }
    return messages.withColumn("map", F.struct(*(c.alias(k) for k, c in buckets.items())))


def ingested(maps: DataFrame, by: str) -> DataFrame:
    """The examples of ``maps(by, map)`` counted by bucket; what a message only shows or doesn't counts once."""
    buckets = maps.schema["map"].dataType.names
    return maps.groupBy(by).agg(*(F.sum(F.size(F.col(f"map.{k}")).cast("long")).alias(k) for k in buckets))


#: Slang by abbreviation and by word, interjections and sounds, and what laughter holds.
ABBREVIATIONS = ("ngl", "af", "rn", "dm", "pm", "ig", "bc", "imo", "gg", "omw", "ftw", "nvm", "atm", "jk", "lmk", "np", "thx", "pls", "plz")
SLANG = ("cap", "periodt", "bestie", "bro", "sis", "fam", "stan", "ship", "vibe", "flex", "ghost", "simp", "cope", "salty", "toxic", "woke", "fire", "slaps", "hits", "lowkey", "highkey", "noob", "pro", "skibidi")
INTERJECTIONS = ("eww", "oh", "ohh", "ah", "ahh", "umm", "mhm", "yay", "wow", "gah", "pfft", "meh", "nah", "yup", "nope", "damn", "dang", "gosh", "jeez", "geez", "ouch", "yikes", "oops", "duh", "psst", "shh")
SOUNDS = ("sigh", "grr", "tsk", "boo", "mwah", "smooch", "giggle", "snort", "sob", "wail", "squeal", "gasp", "gulp", "burp", "hiccup")
LAUGHTER = ("haha", "hehe", "hihi", "hoho", "huhu", "keke", "jaja")


def marked_phrases(messages: DataFrame, lexicon: dict[str, list[str]], signature: str, rare: str) -> DataFrame:
    """(conv_id, label, phrase, n): everything a message is indexed by, added up over a conversation.

    Labels: the categories of ``lexicon``; slang and affective, words of the lists above as often as they stand between
    blanks; user_frequent, user_signature and user_rare as in :func:`style.word_classes`; elongation; punct; case; emoji,
    any and each; special; ngram2 and ngram3 of normalised tokens. A null text has none."""
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    read = messages.select("conv_id", "turn", t.alias("t")).select("conv_id", "turn", "t", text.tokens(F.col("t")).alias("raw"))
    from .graph import settled

    # dealt anew, as a file of few bytes is one task's otherwise and this is much work
    spread = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = settled(read.repartition(spread).select("*", F.transform("raw", text.normalized_token).alias("canon")))  # tokens are taken once
    row = lambda label, phrase, n: F.struct(F.lit(label).alias("label"), phrase.alias("phrase"), n.cast("long").alias("n"))
    rows_of = lambda frame, every: frame.select("conv_id", F.explode(every).alias("x")).select("conv_id", "x.*").where("n > 0")
    part = lambda label, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda w: row(label, w, F.lit(1)))
    count = lambda label, phrase, n: F.array(row(label, F.lit(phrase), n))
    plain = lambda w: w.rlike(r"^\p{L}{2,}$")
    rows = [(c, w) for c, ws in lexicon.items() for w in ws]
    known = messages.sparkSession.createDataFrame(rows, "label string, phrase string")
    said = read.select("conv_id", F.explode("canon").alias("phrase")).join(F.broadcast(known), "phrase").select("conv_id", "label", "phrase", F.lit(1).cast("long").alias("n"))
    each = read.select("conv_id", "turn", F.explode(F.filter("canon", plain)).alias("phrase")).groupBy("conv_id", "turn", "phrase").agg(F.count("*").alias("k"))
    blank = F.split(F.lower("t"), " ")
    stand = lambda label, fits: F.transform(F.array_distinct(F.filter("canon", lambda w: plain(w) & fits(w))), lambda w: row(label, w, F.size(F.filter(blank, lambda x: x == w))))
    size, marked = F.char_length("phrase"), lambda label, c, n: row(label, F.col("phrase"), F.when(c, n).otherwise(0))
    classes = [
        marked("user_frequent", F.col("k") > 1, F.col("k")), marked("user_signature", (size > 6) | F.col("phrase").rlike(signature), F.col("k")), marked("user_rare", (size > 8) | F.col("phrase").rlike(rare), F.lit(1)),
    ]
    parts = [
        stand("slang", lambda w: w.isin(*ABBREVIATIONS, *SLANG)), stand("affective", lambda w: w.isin(*INTERJECTIONS, *SOUNDS) | w.rlike("|".join(LAUGHTER))),
        part("elongation", F.filter("raw", lambda w: w.rlike(r"([A-Za-z])\1\1"))),
        part("emoji", F.regexp_extract_all("t", F.lit(text.EMOJI), F.lit(0))), count("emoji", "any", F.regexp_count("t", F.lit(text.EMOJI))),
        *(count("punct", name, F.regexp_count("t", F.lit(p))) for name, p in (("ellipses", r"\.{3}|…"), ("multi_exclaim", "!{2,}"), ("multi_ask", r"\?{2,}"), ("mixed_marks", r"(?:!\?|\?!)+"))),
        count("case", "ALL_CAPS", F.when(F.exists("raw", lambda w: F.regexp_replace(w, "[^A-Za-z]", "").rlike("^[A-Z]{2,}$")), 1).otherwise(0)),
        count("case", "lowercase_sentence_starts", F.when(F.exists(text.sentences(F.col("t")), lambda s: F.regexp_extract(s, r"\p{L}", 0).rlike(r"^\p{Ll}")), 1).otherwise(0)),
        count("case", "lowercase_i", F.size(F.filter("raw", lambda w: w == "i"))),
        count("special", "keysmash", F.when(F.col("t").rlike(text.KEYSMASH), 1).otherwise(0)),
    ]
    run = lambda k: lambda i: F.slice("canon", i, k)
    for k in (2, 3):
        runs = F.when(F.size("canon") >= k, F.transform(F.sequence(F.lit(1), F.size("canon") - (k - 1)), run(k)))
        parts.append(part(f"ngram{k}", F.transform(F.filter(runs, lambda g: F.forall(g, plain)), lambda g: F.array_join(g, "_"))))
    every = said.union(rows_of(each, F.array(*classes))).union(rows_of(read, F.concat(*parts)))
    return every.groupBy("conv_id", "label", "phrase").agg(F.sum("n").alias("n"))


def cluster_shares(clusters: DataFrame, counts: DataFrame, category: str, top: int = 10) -> DataFrame:
    """(category, canonical, variants, total, pct, place): clusters by total within their category."""
    sums = clusters.join(counts, [category, "word"]).groupBy(category, "canonical").agg(F.count("*").alias("variants"), F.sum("n").alias("total"))
    group = Window.partitionBy(category)
    shared = sums.withColumn("pct", F.round(100.0 * F.col("total") / F.sum("total").over(group), 4)).withColumn("place", F.row_number().over(group.orderBy(F.desc("total"), "canonical")))
    return shared.where(F.col("place") <= top)


def decayed(scores: DataFrame, rate: float = 0.9, turns: int = 1) -> DataFrame:
    """Session scores after ``turns`` messages without the word."""
    return scores.withColumn("score", F.col("score") * rate**turns)


def examples(lifetime: DataFrame, session: DataFrame, by: str, n: int = 5) -> DataFrame:
    """(by, examples): the ``n`` words ranked by 0.7 of the lifetime count and 0.3 of the session's score, padded by ``-``."""
    both = lifetime.join(session, [by, "word"], "left").select(by, "word", (0.7 * F.col("n") + 0.3 * F.coalesce("score", F.lit(0.0))).alias("rank"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("rank", 6)), "word"))
    first = both.withColumn("place", place).where(F.col("place") <= n).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    words = F.transform("w", lambda x: x["word"])
    return first.select(by, F.array_join(F.slice(F.concat(words, F.array_repeat(F.lit("-"), n)), 1, n), ", ").alias("examples"))


#: The header tokens of the chat format.
HEAD, BODY, END = "<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>"


def rendered(messages: DataFrame, last: int = 20) -> DataFrame:
    """(conv_id, prompt): the last turns of each conversation in the chat format, the assistant's header open at the end."""
    kept = style.last_messages(messages, last)
    said = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))  # ``last`` turns
    turns = F.transform("t", lambda x: F.concat(F.lit(HEAD), x["role"], F.lit(BODY), x["text"], F.lit(END)))
    return said.select("conv_id", F.concat(F.array_join(turns, ""), F.lit(f"{HEAD}assistant{BODY}")).alias("prompt"))


def latest_fields(facts: DataFrame, key: str) -> DataFrame:
    """(key, field, value): the value last told of each field."""
    return facts.where("value is not null").groupBy(key, "field").agg(F.max_by("value", "seq").alias("value"))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff and Obershelp's similarity; nulls give null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def name_similarity(a: Column, b: Column, least: float) -> Column:
    """Equal ignoring case 1; one within the other, the share of lengths; the sequence ratio; its mean with the words'
    Jaccard similarity: the greatest of those that reach ``least``, else null."""
    la, lb = F.lower(a), F.lower(b)
    lengths = F.least(F.char_length(la), F.char_length(lb)) / F.greatest(F.char_length(la), F.char_length(lb), F.lit(1))
    inside, ratio, words = F.when(la.contains(lb) | lb.contains(la), lengths), sequence_ratio(la, lb), text.jaccard(a, b)
    reach = lambda x: F.when(x >= least, x)
    return F.when(la == lb, F.lit(1.0)).otherwise(F.coalesce(reach(inside), F.greatest(reach(ratio), F.when(words >= least, reach((ratio + words) / 2)))))


def similar_names(names: DataFrame, least: float, top: int = 5) -> DataFrame:
    """(a, b, score): each name's ``top`` most similar others among those it shares a word or its first three letters with."""
    low = F.lower("name")
    keys = F.array_distinct(F.concat(F.filter(F.split(low, r"\s+"), lambda w: w != ""), F.array(F.concat(F.lit("^"), F.substring(low, 1, 3)))))
    keyed = names.select("name").distinct().select("name", F.explode(keys).alias("k"))
    a, b = (keyed.select(F.col("name").alias(c), "k") for c in "ab")
    pairs = a.join(b, "k").where("a <> b").select("a", "b").distinct()
    scored = pairs.withColumn("score", name_similarity(F.col("a"), F.col("b"), least)).where("score is not null")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return scored.withColumn("place", place).where(F.col("place") <= top).drop("place")


def merge_mapping(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """(source_name, target_name): names joined by ``pairs(a, b)`` all go to the earliest of ``order(name, seq)``."""
    from .graph import components

    of = components(pairs.select(F.col("a").alias("source"), F.lit("SAME").alias("relationship"), F.col("b").alias("destination"), F.lit(1.0).alias("weight")))
    first = of.join(order, of.id == order.name).groupBy("cluster_id").agg(F.min_by("name", F.struct("seq", "name")).alias("target_name"))
    return of.join(first, "cluster_id").where("id <> target_name").select(F.col("id").alias("source_name"), "target_name")
