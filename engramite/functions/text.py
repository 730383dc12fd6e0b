"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relation synonyms by their form without trailing S (two that no such form reaches are left out), and
#: relations that are refused.
SYNONYMS = {
    "WIFE": "WIFE_OF", "WIFEOF": "WIFE_OF", "HUSBAND": "HUSBAND_OF", "HUSBANDOF": "HUSBAND_OF", "MARRIED": "MARRIED_TO", "MARRIEDTO": "MARRIED_TO",
    "LIKE": "LIKES", "LOVE": "LOVES", "HATE": "HATES", "WORKSAT": "WORKS_AT", "WORKS_AT": "WORKS_AT", "WORKSFOR": "WORKS_FOR",
    "FAVOURITE": "FAVORITE", "LIVEIN": "LIVES_IN", "LIVESIN": "LIVES_IN",
}
DENIED = ("I", "YOU", "MY", "YOUR", "A", "AN", "THE")
FILLER_TOKENS = ("OF", "IS", "ARE", "WAS", "WERE")


def name_key(c: Column) -> Column:
    """The key every name joins on."""
    return F.upper(F.trim(c))


# Fixed value: the pattern of a proper name.
def entities(text: Column) -> Column:
    """Capitalised words, then the first word of each double-quoted phrase, capitalised; each once."""
    proper = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-zA-Z0-9_\-]+)\b"), F.lit(1))
    quoted = F.transform(F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)), lambda q: F.split(F.trim(q), r"\s+")[0])
    heads = F.transform(quoted, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000))))
    return F.array_union(proper, F.filter(heads, lambda w: w != ""))


def text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def merged_text(a: Column, b: Column) -> Column:
    """Equal texts stay; others give their white-space tokens, each once, in first-seen order."""
    tokens = F.filter(F.array_distinct(F.concat(F.split(a, r"\s+"), F.split(b, r"\s+"))), lambda x: x != "")
    return F.when(a == b, a).otherwise(F.array_join(tokens, " "))


def canonical_relation(c: Column) -> Column:
    """Upper case, hyphens as underscores, no trailing S where longer than three letters, synonyms; null if refused or under two letters."""
    up = F.regexp_replace(F.upper(c), "-", "_")
    bare = F.when(F.char_length(up) > 3, F.regexp_replace(up, "S+$", "")).otherwise(up)
    known = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv)), bare), bare)
    out = F.regexp_replace(known, "__", "_")
    return F.when(~out.isin(*DENIED) & (F.char_length(out) >= 2), out)


def relation_key(c: Column) -> Column:
    """Key under which relations count as the same: filler tokens go, then one trailing S of what is longer than three."""
    kept = F.filter(F.split(F.replace(F.upper(c), F.lit("-"), F.lit("_")), "_"), lambda t: ~t.isin(*FILLER_TOKENS))
    whole = F.array_join(kept, "_")
    return F.when((F.char_length(whole) > 3) & whole.endswith("S"), F.substring(whole, F.lit(1), F.char_length(whole) - 1)).otherwise(whole)


#: Reasoning blocks, line starts that are no facts, special tokens, and the separators of a fact.
REASONING = r"(?is)<(?:think|thinking)>.*?</(?:think|thinking)>"
NO_FACT = ("Analysis:", "Input:", "Output:")
SPECIAL_TOKENS = r"<\|eot_id\|>|<\|assistant\|>|<\|user\|>"
FACT = r"^\s*([A-Za-z0-9_\s]+)\s*[-–—]{1,2}\s*([A-Za-z0-9_\s]+)\s*[-–—]{1,2}\s*([A-Za-z0-9_\s]+)\s*$"


def triplet(line: Column) -> Column:
    """``src - REL - dst`` with one or two hyphens or dashes, or parted by `` - ``, as struct<src, rel, dst>: upper case,
    spaces of the relation as underscores. Null where a line is no fact, or a part is empty or too long (50, 30, 50)."""
    raw = F.trim(line)
    bare = F.regexp_replace(raw, SPECIAL_TOKENS, "")
    cut = F.split(bare, " - ", -1)
    strict = F.transform(F.array(*(F.regexp_extract(bare, FACT, k) for k in (1, 2, 3))), lambda x: F.trim(x))
    loose = F.when(F.size(cut) >= 3, F.array(F.trim(cut[0]), F.trim(cut[1]), F.trim(F.array_join(F.slice(cut, F.lit(3), F.size(cut)), " - "))))
    parts = F.when(bare.rlike(FACT), strict).otherwise(loose)
    name = lambda c: F.upper(F.trim(F.regexp_replace(c, r"[^a-zA-Z0-9_\s]+", "")))
    src, rel, dst = name(parts[0]), F.upper(F.regexp_replace(F.replace(parts[1], F.lit(" "), F.lit("_")), "[^a-zA-Z0-9_]+", "")), name(parts[2])
    said = ~F.coalesce(F.exists(F.array(*map(F.lit, NO_FACT)), lambda x: F.startswith(raw, x)), F.lit(False))
    good = said & (src != "") & (rel != "") & (dst != "") & (F.char_length(src) <= 50) & (F.char_length(rel) <= 30) & (F.char_length(dst) <= 50)
    return F.when(good, F.struct(src.alias("src"), rel.alias("rel"), dst.alias("dst")))


def triplets(answer: Column, most: int = 6) -> Column:
    """The first ``most`` facts of a text of many lines, relations canonical; blocks of reasoning are no lines."""
    lines = F.split(F.trim(F.regexp_replace(answer, REASONING, "")), "\n")
    found = F.transform(F.transform(lines, triplet), lambda t: F.struct(t["src"].alias("src"), canonical_relation(t["rel"]).alias("rel"), t["dst"].alias("dst")))
    return F.slice(F.filter(found, lambda t: t["rel"].isNotNull()), 1, most)


def time_window(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.rlike("yesterday|last night"), "YESTERDAY").when(low.rlike("today|this morning|this evening|tonight"), "TODAY")
        .when(low.contains("last week"), "LAST_WEEK").when(low.contains("last month"), "LAST_MONTH")
    )


# Fixed value: the pattern of a date.
def date_literal(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(20\d{2}-\d{2}-\d{2})", 1), F.lit(""))


def collapsed(c: Column) -> Column:
    """Lower case with runs of one character as one."""
    return F.regexp_replace(F.lower(c), r"(.)\1+", "$1")


def phonetic_similarity(a: Column, b: Column) -> Column:
    """1 if equal ignoring case; collapsed forms equal: 0.8 within two letters of length, else 0.6; contained: 0.7; else 0."""
    ca, cb = collapsed(a), collapsed(b)
    near = F.abs(F.char_length(a) - F.char_length(b)) <= 2
    return F.when(F.lower(a) == F.lower(b), 1.0).when(ca == cb, F.when(near, 0.8).otherwise(0.6)).when(ca.contains(cb) | cb.contains(ca), 0.7).otherwise(0.0)


#: Patterns of links and handles, sentence ends, repeated words, mashed keys, lists with and without the last comma.
LINK, HANDLE, SENTENCE_END = r"(?i)https?://\S+|www\.\S+", r"[@#]\w+", r"(?<=[.!?…])\s+"
REPEATED, KEYSMASH = r"(?i)\b(\w+)\b(?:\s+\1\b)+", r"(?i)\b(?:[asdfghjkl]{5,}|[qwertyuiop]{5,}|[zxcvbnm]{5,})\b"
OXFORD, NO_OXFORD = r"(?i)\b\w+\b,\s+\b\w+\b,\s+and\s+\b\w+\b", r"(?i)\b\w+\b,\s+\b\w+\b\s+and\s+\b\w+\b"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"


def tokens(text: Column) -> Column:
    """White-space tokens without URLs and handles."""
    bare = F.regexp_replace(F.regexp_replace(text, LINK, " "), HANDLE, " ")
    return F.filter(F.split(bare, r"\s+"), lambda t: t != "")


def sentences(text: Column) -> Column:
    folded = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(folded, SENTENCE_END), lambda s: s != "")


def ratio(n: Column, d: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0)), 6)


def message_features(text: Column) -> list[Column]:
    """Structure, punctuation, casing, emoji and repetition of one message, null as empty."""
    t = F.coalesce(text, F.lit(""))
    each, lines = tokens(t), sentences(t)
    words = F.transform(each, lambda w: F.regexp_replace(w, r"[^A-Za-z]", ""))
    n_tokens, n_sentences = F.size(each), F.greatest(F.lit(1), F.size(lines))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    cased = lambda pattern: F.size(F.filter(words, lambda w: w.rlike(pattern)))
    ending = lambda mark: ratio(F.size(F.filter(lines, lambda s: s.endswith(mark))), n_sentences)
    with_, without = count(OXFORD), count(NO_OXFORD)
    low_start = F.size(F.filter(lines, lambda s: F.regexp_extract(s, r"\p{L}", 0).rlike(r"^\p{Ll}")))
    return [
        n_tokens.alias("n_tokens"), n_sentences.alias("n_sentences"), ratio(n_tokens, n_sentences).alias("words_per_sentence"),
        ending("?").alias("asking"), ending("!").alias("exclaiming"), ending(".").alias("stating"),
        count(",").alias("commas"), count(";").alias("semicolons"), count(":").alias("colons"), count("[-—]").alias("dashes"), count("[\"']").alias("straight_quotes"), count("[“”‘’]").alias("curly_quotes"),
        count(r"\.{3}|…").alias("ellipses"), count("!{2,}").alias("multi_exclaim"), count(r"\?{2,}").alias("multi_ask"), count(r"(?:!\?|\?!)+").alias("mixed_marks"),
        with_.alias("with_oxford"), without.alias("without_oxford"), ratio(with_, with_ + without).alias("oxford_ratio"),
        cased("^[A-Z]{2,}$").alias("all_caps"), cased("^[A-Z][a-z]+$").alias("title"), cased("^[a-z]{2,}$").alias("lower_case"),
        low_start.alias("low_starts"), count("(?<![A-Za-z])i(?![A-Za-z])").alias("small_i"),
        count(EMOJI).alias("emojis"), F.size(F.filter(each, lambda w: w.rlike(r"([A-Za-z])\1\1"))).alias("elongated"),
        count(REPEATED).alias("repeats"), count(KEYSMASH).alias("keysmashes"), count(LINK).alias("links"), count(HANDLE).alias("handles"),
    ]


def emoji_places(text: Column) -> Column:
    """struct<total, first, mid, last>: a text's sentences with an emoji, and how many of them have one in their first
    tenth, in neither end, and in their last tenth; a sentence counts as mid while those at ends are fewer than all so far."""
    at = lambda s: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(s))), lambda i: F.when(F.substring(s, i, F.lit(1)).rlike(EMOJI), i - 1)), lambda i: i.isNotNull())
    seen = F.filter(F.transform(sentences(F.coalesce(text, F.lit(""))), lambda s: F.struct(at(s).alias("at"), F.char_length(s).alias("n"))), lambda x: F.size(x["at"]) > 0)
    one = lambda c: F.when(c, 1).otherwise(0)

    def step(s: Column, x: Column) -> Column:
        total = s["total"] + 1
        first = s["first"] + one(F.array_min(x["at"]) <= F.floor(0.1 * x["n"]).cast("int"))
        last = s["last"] + one(F.array_max(x["at"]) >= F.greatest(F.lit(0), F.floor(0.9 * x["n"]).cast("int") - 1))
        return F.struct(total.alias("total"), first.alias("first"), (s["mid"] + one(first + last < total)).alias("mid"), last.alias("last"))

    return F.aggregate(seen, F.struct(*(F.lit(0).alias(k) for k in ("total", "first", "mid", "last"))), step)


def without_marks(c: Column) -> Column:
    """Letters of Latin-1 and Latin Extended-A without their diacritics, from their canonical decompositions."""
    plain = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xC0, 0x180) if len(unicodedata.normalize("NFD", chr(i))) > 1]
    return F.regexp_replace(F.translate(c, "".join(a for a, _ in plain), "".join(b for _, b in plain)), r"\p{Mn}+", "")


def normalized_token(c: Column) -> Column:
    """Without diacritics, lower case, runs of a letter as one, punctuation stripped at both ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(without_marks(F.trim(c))), r"([A-Za-z])\1+", "$1"), r"^\p{Punct}+|\p{Punct}+$", "")


def jaccard(a: Column, b: Column, sep: str = r"\s+") -> Column:
    """Shared share of two texts' distinct tokens; 0 where both have none."""
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), sep)), lambda w: w != "")
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(a), words(b))).cast("double"), F.size(F.array_union(words(a), words(b))).cast("double")), F.lit(0.0))
