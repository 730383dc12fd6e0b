"""Registered queries over conversations as a speaker's style, each next to its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import talk, text
from ..operators import graph, lifecycle, profile, similarity, style
from ..sources import files
from ..sources.star import derived, table
from ..streaming import windows
from .registry import _CASED, _LEXICON, _MARKS, _RARE, _SIGNATURE, _SQL_HITS, _SQL_SAID, _SQL_TURNS, _SQL_WORDS, SQL, _stream, _turns, _words, query

_SQL_BARE = "(SELECT conv_id, unnest(list_filter(bare, lambda x: regexp_matches(x, '{p}'))) AS phrase FROM f)"
_SQL_GRAM = "(SELECT conv_id, w[i] || {more} AS phrase FROM (SELECT conv_id, w, unnest(range(1, len(w) - {n})) AS i FROM (SELECT conv_id, regexp_extract_all(lower(strip_accents(t)), '[a-z]+') AS w FROM f)))"


@query(f"WITH {_SQL_TURNS} SELECT conv_id, label, phrase, count(*) AS n FROM (SELECT conv_id, 'caps' AS label, phrase FROM {_SQL_BARE.format(p='^[A-Z]{2,}$')} UNION ALL SELECT conv_id, 'title', phrase FROM {_SQL_BARE.format(p='^[A-Z][a-z]+$')} UNION ALL SELECT conv_id, 'bigram', phrase FROM {_SQL_GRAM.format(more="' ' || w[i + 1]", n=0)} UNION ALL SELECT conv_id, 'trigram', phrase FROM {_SQL_GRAM.format(more="' ' || w[i + 1] || ' ' || w[i + 2]", n=1)}) GROUP BY 1, 2, 3")
def phrase_bag(spark, sf_dir):
    return profile.phrase_bag(_turns(spark, sf_dir))


_SQL_BAG = f"({SQL['phrase_bag']}) AS bag"


@query("SELECT conv_id, count(*) AS phrases, CAST(sum(n) AS BIGINT) AS said, " + ", ".join(f"count(*) FILTER (label = '{x}') AS n_{x}" for x in ("bigram", "trigram", "caps", "title")) + f", first(phrase ORDER BY n DESC, label, phrase) AS most_said FROM {_SQL_BAG} GROUP BY 1")
def profile_status(spark, sf_dir):
    return profile.status(profile.phrase_bag(_turns(spark, sf_dir)))


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, label ORDER BY n DESC, phrase) AS k FROM {_SQL_BAG}), l AS (SELECT conv_id, label, label || ': ' || string_agg(phrase || ' (' || n || ')', ', ' ORDER BY k) AS line FROM r WHERE k <= 3 GROUP BY 1, 2) SELECT conv_id, string_agg(line, chr(10) ORDER BY label) AS prompt FROM l GROUP BY 1")
def profile_prompt(spark, sf_dir):
    return profile.prompt_text(profile.phrase_bag(_turns(spark, sf_dir)))


_SQL_SUMS = "count(*) AS messages, CAST(sum(len(w)) AS BIGINT) AS n_tokens, CAST(sum(s) AS BIGINT) AS n_sentences, CAST(sum(len(regexp_extract_all(t, ','))) AS BIGINT) AS commas, CAST(sum(len(list_filter(bare, lambda x: regexp_matches(x, '^[A-Z][a-z]+$')))) AS BIGINT) AS title, CAST(sum(len(list_filter(bare, lambda x: regexp_matches(x, '^[a-z]{2,}$')))) AS BIGINT) AS lower_case"


@query(f"WITH {_SQL_TURNS}, g AS (SELECT conv_id % 7 AS speaker, {_SQL_SUMS} FROM f GROUP BY 1) SELECT *, round(coalesce(n_tokens::DOUBLE / nullif(n_sentences, 0), 0), 6) AS mean_sentence, round(coalesce(commas::DOUBLE / nullif(n_tokens, 0), 0), 6) AS comma_ratio, round(coalesce(title::DOUBLE / nullif(n_tokens, 0), 0), 6) AS title_ratio FROM g")
def merged_reports(spark, sf_dir):
    return profile.merged_reports(_turns(spark, sf_dir).withColumn("speaker", F.col("conv_id") % 7), "speaker")


@query(f"WITH {_SQL_HITS}, s AS (SELECT conv_id % 7 AS speaker, CAST(floor(turn / 4) AS BIGINT) AS period, category, count(*) AS messages, CAST(sum(n) AS BIGINT) AS words FROM hits GROUP BY 1, 2, 3) SELECT *, round(100::DOUBLE * words / sum(words) OVER (PARTITION BY speaker, period), 4) AS pct FROM s")
def mini_profiles(spark, sf_dir):
    hits = style.lexicon_hits(_turns(spark, sf_dir), _LEXICON)
    return profile.mini_profiles(hits.withColumn("speaker", F.col("conv_id") % 7).withColumn("period", F.floor(F.col("turn") / 4)), ["speaker", "period"])


_SIGNALS = ["commas", "semicolons", "colons", "ellipses", "multi_exclaim", "handles", "links"]


@query(f"WITH {_SQL_TURNS}, n AS (" + " UNION ALL ".join(f"SELECT '{x}' AS signal, CAST(coalesce(sum(len(regexp_extract_all(t, '{_MARKS[x]}'))), 0) AS BIGINT) AS n FROM f" for x in _SIGNALS) + ") SELECT signal, n, round(coalesce(100::DOUBLE * n / nullif(sum(n) OVER (), 0), 0), 4) AS pct FROM n")
def signal_shares(spark, sf_dir):
    return profile.signal_shares(_turns(spark, sf_dir), _SIGNALS)


@query(f"WITH {_SQL_HITS}, p AS (SELECT *, round(CAST(100 AS DOUBLE) * n / sum(n) OVER (PARTITION BY conv_id, turn), 2) AS p, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, category) AS k FROM hits), e AS (SELECT category, round(p + CASE WHEN k = 1 THEN 100 - sum(p) OVER (PARTITION BY conv_id, turn) ELSE 0 END, 2) AS pct FROM p), m AS (SELECT category, round(sum(pct) / count(*), 4) AS mean FROM e GROUP BY 1) SELECT category, mean, round(100::DOUBLE * mean / sum(mean) OVER (), 2) AS share, CAST(row_number() OVER (ORDER BY mean DESC, category) AS INTEGER) AS place FROM m")
def emotion_means(spark, sf_dir):
    return profile.mean_scores(style.percentages(style.lexicon_hits(_turns(spark, sf_dir), _LEXICON), "category"), "category")


_COLLAPSED = "array_to_string(list_filter(string_split(word, ''), lambda c, i: i = 1 OR c <> string_split(word, '')[i - 1]), '')"
SQL["elongation_groups"] = f"WITH {_SQL_WORDS}, g AS (SELECT {_COLLAPSED} AS form, word, n FROM w) SELECT form, min_by(word, (length(word), word)) AS canonical, count(*) AS variants, CAST(sum(n) AS BIGINT) AS total FROM g GROUP BY 1 HAVING count(*) > 1"


@query(f"WITH {_SQL_WORDS}, g AS (SELECT {_COLLAPSED} AS form, word FROM w) SELECT a.word AS a, b.word AS b, CAST(0.8 AS DOUBLE) AS score FROM g a JOIN g b USING (form) WHERE a.word < b.word AND abs(length(a.word) - length(b.word)) <= 2")
def phonetic_pairs(spark, sf_dir):
    return profile.phonetic_pairs(_words(spark, sf_dir))


def _by_letter(spark, sf_dir):
    return _words(spark, sf_dir).select(F.substring("word", 1, 1).alias("letter"), "word", "n")


@query()
def edit_clusters(spark, sf_dir):
    """Greedy, so tested against a plain loop."""
    return profile.greedy_clusters(_by_letter(spark, sf_dir), "letter")


@query()
def semantic_clusters(spark, sf_dir):
    """Leaders of words alike by their trigrams; tested against a plain loop."""
    return profile.semantic_clusters(_by_letter(spark, sf_dir), "letter", 0.7)


@query()
def marked_phrases(spark, sf_dir):
    """All labels that a message is indexed by; tested against Python."""
    return profile.marked_phrases(_turns(spark, sf_dir), _LEXICON, _SIGNATURE, _RARE)


@query()
def emoji_positions(spark, sf_dir):
    """Where in their sentences emoji stand; tested against Python."""
    at = text.emoji_places(F.col("text")).alias("p")
    found = _turns(spark, sf_dir).select("conv_id", "turn", at).select("conv_id", "turn", "p.*")
    return found.select("conv_id", "turn", F.col("total").alias("sentences_with_emoji"), *(text.ratio(F.col(c), F.col("total")).alias(f"{n}_ratio") for c, n in (("first", "start"), ("mid", "mid"), ("last", "end"))))


@query()
def style_blueprint(spark, sf_dir):
    """The flat blueprint; it needs the features that the other dialect's patterns lack, so it is tested against Python."""
    return profile.style_blueprint(_turns(spark, sf_dir), _LEXICON)


@query(f"WITH s AS ({SQL['signal_shares']}), e AS ({SQL['emotion_means']}), b AS (SELECT label, phrase, CAST(sum(n) AS BIGINT) AS n FROM {_SQL_BAG} GROUP BY 1, 2 HAVING sum(n) >= 2), p AS (SELECT '[' || label || '] ' || phrase AS item, n, round(100::DOUBLE * n / sum(n) OVER (), 4) AS pct FROM b) SELECT 1 AS section, signal AS item, n, pct FROM s UNION ALL SELECT 2, category, NULL, share FROM e WHERE share >= 1 UNION ALL SELECT 3, item, n, pct FROM p WHERE pct >= 0.05")
def section_report(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    emotions = profile.mean_scores(style.percentages(style.lexicon_hits(turns, _LEXICON), "category"), "category")
    return profile.section_report(profile.signal_shares(turns, _SIGNALS), emotions, profile.phrase_bag(turns), min_share=0.05)


@query()
def learned_patterns(spark, sf_dir):
    """Words of even conversations are learned first, those of odd ones on top of them."""
    counts = lambda rest: style.words(_turns(spark, sf_dir).where(F.col("conv_id") % 2 == rest)).groupBy(F.substring("word", 1, 1).alias("letter"), "word").agg(F.count("*").alias("n"))
    none = spark.createDataFrame([], "letter string, word string, canonical string")
    known = graph.settled(profile.learned(none, counts(0), "letter")[0])
    return profile.learned(known, counts(1), "letter")[1]


@query()
def client_merges(spark, sf_dir):
    """Clients whose names are alike go to the one who came first; tested against all pairs."""
    names = table(spark, sf_dir, "clients").select(F.col("name"), F.col("client_id").alias("seq")).where("name is not null and seq is not null")
    return similarity.best_targets(similarity.similar(names.select("name"), 0.9), names)


@query()
def cluster_shares(spark, sf_dir):
    counts = _by_letter(spark, sf_dir)
    return profile.cluster_shares(profile.greedy_clusters(counts, "letter"), counts, "letter")


_SQL_LAST = "c AS (SELECT conv_id, turn, word, count(*) AS n FROM said GROUP BY 1, 2, 3), l AS (SELECT conv_id, max(turn) AS last FROM c GROUP BY 1), ema AS (SELECT c.conv_id AS conv_id, word, sum(0.1::DOUBLE * pow(0.9::DOUBLE, last - turn) * n) AS score FROM c JOIN l ON c.conv_id = l.conv_id GROUP BY 1, 2)"


def _session(spark, sf_dir):
    counts = style.words(_turns(spark, sf_dir)).groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))
    return counts, style.session_ema(counts)


@query(f"WITH {_SQL_SAID}, {_SQL_LAST} SELECT conv_id, word, round(score * 0.81::DOUBLE + 1e-9, 6) AS score FROM ema")
def session_decay(spark, sf_dir):
    return profile.decayed(_session(spark, sf_dir)[1], turns=2).select("conv_id", "word", F.round(F.col("score") + 1e-9, 6).alias("score"))


@query(f"WITH {_SQL_SAID}, {_SQL_LAST}, life AS (SELECT conv_id, word, sum(n) AS n FROM c GROUP BY 1, 2), r AS (SELECT conv_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY round(0.7::DOUBLE * n + 0.3::DOUBLE * score, 6) DESC, word) AS k FROM life JOIN ema USING (conv_id, word)) SELECT conv_id, array_to_string(list_concat(list(word ORDER BY k), list_transform(range(greatest(0, 5 - count(*))), lambda x: '-')), ', ') AS examples FROM r WHERE k <= 5 GROUP BY 1")
def blueprint_examples(spark, sf_dir):
    counts, session = _session(spark, sf_dir)
    return profile.examples(counts.groupBy("conv_id", "word").agg(F.sum("n").alias("n")), session, "conv_id")


@query("SELECT conv_id, string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || coalesce(text, '') || '<|eot_id|>', '' ORDER BY turn) || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 20 GROUP BY 1")
def chat_prompt(spark, sf_dir):
    return profile.rendered(_turns(spark, sf_dir))


@query("SELECT conv_id, turn, trim(coalesce(text, '')) AS answer FROM conversations")
def answer_cleanup(spark, sf_dir):
    raw = F.concat(F.lit("<THINK>a\nb</THINK><|eot_id|> "), F.coalesce("text", F.lit("")), F.lit("<thinking>c</thinking> "))
    return _turns(spark, sf_dir).select("conv_id", "turn", talk.clean_answer(raw).alias("answer"))


@query("SELECT user_id, event_type AS field, max_by(json_extract_string(props, '$.k'), event_id) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def latest_fields(spark, sf_dir):
    told = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field"), F.get_json_object("props", "$.k").alias("value"), F.col("event_id").alias("seq"))
    return profile.latest_fields(told, "user_id")


@query()
def sequence_similarity(spark, sf_dir):
    """Part names against each other; the ratio is the standard library's."""
    return profile.similar_names(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), 0.6)


@query("SELECT 'Supplier ' || upper(s_name) AS source_name, 'Supplier ' || s_name AS target_name FROM supplier WHERE upper(s_name) <> s_name")
def merge_mapping(spark, sf_dir):
    """Names equal ignoring case go to the first."""
    s = table(spark, sf_dir, "supplier").where("upper(s_name) <> s_name")
    name = lambda c: F.concat(F.lit("Supplier "), c)
    pairs = s.select(name(F.col("s_name")).alias("a"), name(F.upper("s_name")).alias("b"))
    order = pairs.select(F.col("a").alias("name"), F.lit(0).alias("seq")).union(pairs.select("b", F.lit(1)))
    return profile.merge_mapping(pairs, order)


_FOLD = "strip_accents(trim(word))"
_SQL_RUNS = "array_to_string(list_filter(string_split(x, ''), lambda c, i: i = 1 OR c <> string_split(x, '')[i - 1] OR NOT regexp_matches(c, '[a-z]')), '')"


@query(f"WITH d AS (SELECT DISTINCT unnest(string_split_regex(coalesce(text, ''), '\\s+')) AS word FROM conversations), l AS (SELECT word, lower({_FOLD}) AS x FROM d WHERE word <> '') SELECT word, regexp_replace({_SQL_RUNS}, '^[[:punct:]]+|[[:punct:]]+$', '', 'g') AS token FROM l")
def normalized_tokens(spark, sf_dir):
    words = _turns(spark, sf_dir).select(F.explode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("word")).where("word <> ''").distinct()
    return words.select("word", text.normalized_token(F.col("word")).alias("token"))


@query("SELECT role, count(*) AS n, min(conv_id) AS least FROM conversations WHERE text IS NULL OR NOT (contains(lower(text), 'ing') OR contains(lower(text), 'the')) GROUP BY 1")
def delete_by_query(spark, sf_dir):
    """What is left once the candidates are gone."""
    turns = _turns(spark, sf_dir)
    gone = lifecycle.delete_candidates(turns, "ing of The").select("conv_id", "turn")
    return turns.join(gone, ["conv_id", "turn"], "left_anti").groupBy("role").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))


SQL["profile_lifetime"] = f"WITH {_SQL_TURNS} SELECT conv_id, {_SQL_SUMS}, CAST(sum(len(list_filter(bare, lambda x: regexp_matches(x, '{_CASED['all_caps']}')))) AS BIGINT) AS all_caps, round(coalesce(sum(len(w))::DOUBLE / nullif(sum(s), 0), 0), 6) AS mean_sentence FROM f GROUP BY 1"


@query(SQL["profile_lifetime"])
def stream_profile(spark, sf_dir):
    """The profile kept up to date as messages stream by."""
    return windows.drained(spark, style.lifetime(_stream(spark, sf_dir, "conversations")), ["conv_id"])


# --- files of profiles and patterns


def _counted(spark, sf_dir, rest):
    """Words of every other conversation under their forms without repeated letters."""
    n = style.words(_turns(spark, sf_dir).where(F.col("conv_id") % 2 == rest)).groupBy("word").agg(F.count("*").alias("n"))
    return n.select(F.substring("word", 1, 1).alias("category"), text.collapsed(F.col("word")).alias("canonical"), "word", "n")


@query("WITH n AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[a-z]+')) AS word FROM conversations WHERE conv_id IS NOT NULL) GROUP BY 1) SELECT substr(word, 1, 1) AS category, array_to_string(list_filter(string_split(word, ''), lambda c, i: i = 1 OR c <> word[i - 1]), '') AS canonical, count(*) AS variants, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY 1, 2")
def pattern_memory_file(spark, sf_dir):
    """S10: even conversations are saved first, odd ones appended; clusters as read back."""
    folder = f"{graph.shared_base(spark).rstrip('/')}/patterns-{uuid.uuid4().hex}"
    for rest in (0, 1):
        files.write_patterns(_counted(spark, sf_dir, rest), folder)
    return files.patterns(spark, folder).groupBy("category", "canonical").agg(F.count("*").alias("variants"), F.sum("n").alias("total"))


@query("SELECT conv_id, CAST(CASE WHEN max(turn) > 1 THEN 2 ELSE 1 END AS BIGINT) AS saved, count(*) AS messages, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1")
def profile_file(spark, sf_dir):
    """S11: profiles of the first turns are saved, then those of conversations that went on; each one's last save."""
    folder = f"{graph.shared_base(spark).rstrip('/')}/profiles-{uuid.uuid4().hex}"
    turns = _turns(spark, sf_dir).where("conv_id is not null")
    summed = lambda t: t.groupBy("conv_id").agg(F.count("*").alias("messages"), F.sum(F.char_length(F.coalesce("text", F.lit(""))).cast("long")).alias("chars"), F.max("turn").alias("last"))
    files.write_profiles(summed(turns.where("turn <= 1")).drop("last"), folder, 1, "conv_id")
    files.write_profiles(summed(turns).where("last > 1").drop("last"), folder, 2, "conv_id")
    return files.profiles(spark, folder, "messages long, chars long", "conv_id").withColumn("conv_id", F.col("conv_id").cast("long"))


@query()
def pattern_examples(spark, sf_dir):
    """L10 and L30: examples by bucket, counted a conversation; tested against Python."""
    return profile.ingested(profile.pattern_map(_turns(spark, sf_dir)), "conv_id")


@query("""SELECT 'ent::' || upper(c_name) AS node_id, '{"segment":"' || c_mktsegment || '"}' AS props, NULL AS brand FROM customer WHERE c_mktsegment IS NOT NULL UNION ALL SELECT 'ent::PART#' || p_partkey, '{"brand":"' || p_brand || '","size":"' || p_size || '"}', p_brand FROM part""")
def node_props_json(spark, sf_dir):
    """what a node holds as JSON, and one field of it read back."""
    told = graph.props_json(derived(spark, sf_dir).node_props)
    return told.withColumn("brand", F.get_json_object("props", "$.brand"))
