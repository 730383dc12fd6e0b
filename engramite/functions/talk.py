"""What a message asks for and says of its speaker, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The commands, the longer of two with one beginning first.
COMMANDS = ("store", "remember", "updateq", "update", "delete", "query", "path", "viz", "merge", "rebuild", "eval")
#: Words of greetings and fillers, which alone ask for nothing.
FILLERS = (
    "hi", "hey", "hello", "hii", "hiii", "yo", "sup", "heya", "hola", "bye", "goodbye", "later", "cya", "ok", "okay", "k", "kk", "yes", "no", "yeah", "yep",
    "nope", "nah", "sure", "maybe", "thanks", "thank", "thx", "ty", "welcome", "hmm", "hmmmm", "uh", "um", "umm", "ah", "oh", "ooh", "wow", "lol", "lmao",
    "haha", "hehe", "xd", "nice", "cool", "great",
)
#: Words that mark a kind of question.
ASKING = ("who", "what", "when", "where", "why", "how", "tell", "explain", "describe", "about")
RELATING = ("relationship", "connection", "between", "related", "link", "associate", "know")
TIMING = ("before", "after", "when", "during", "recently", "past", "future", "now", "today")
#: How names, ages and places are told, tried in order, and words that are no names.
OWN_NAME = (r"my name is\s+([a-zA-Z]+)", r"i am\s+([a-zA-Z]+)", r"call me\s+([a-zA-Z]+)", r"i'm\s+([a-zA-Z]+)")
YOUR_NAME = (r"your name (?:is|will be)\s+([a-zA-Z]+)", r"call you\s+([a-zA-Z]+)", r"i(?:'ll| will) call you\s+([a-zA-Z]+)")
AGE = (r"i am\s+(\d{1,3})\s+years? old", r"i'm\s+(\d{1,3})\s+years? old", r"my age is\s+(\d{1,3})")
PLACE = (r"i live in\s+([a-zA-Z\s]+?)(?:\.|,|$)", r"i'm from\s+([a-zA-Z\s]+?)(?:\.|,|$)", r"i am from\s+([a-zA-Z\s]+?)(?:\.|,|$)")
NO_YOUR_NAME = ("the", "a", "an", "very", "really", "just", "so")
NO_OWN_NAME = (*NO_YOUR_NAME, "here", "there", "fine", "good", "okay", "happy", "sad")


def command(text: Column) -> Column:
    """The command a text begins with, else chat."""
    low, out = F.lower(F.trim(text)), F.lit("chat")
    for name in reversed(COMMANDS):
        out = F.when(low.startswith(f"@{name}"), name).otherwise(out)
    return F.coalesce(out, F.lit("chat"))


def argument(text: Column) -> Column:
    """The text without its command."""
    return F.trim(F.regexp_replace(F.trim(text), "(?i)^@(?:" + "|".join(COMMANDS) + ")", ""))


def gate(text: Column) -> Column:
    """Why a text asks for no memory: greeting_filler, too_short, else null."""
    low = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    return F.when((F.size(words) <= 2) & F.forall(words, lambda w: w.isin(*FILLERS)), "greeting_filler").when(F.char_length(low) < 4, "too_short")


def strategy(text: Column) -> Column:
    """struct<vector_limit, hops, paths, threshold, expand>: how far a search for this text goes."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    has = lambda known: F.arrays_overlap(words, F.array(*map(F.lit, known)))
    n, timed = F.size(words), has(TIMING)
    return F.struct(
        (F.when(timed, 25).otherwise(40) + F.when(n > 8, 10).otherwise(0)).alias("vector_limit"), F.lit(5).alias("hops"), F.when(has(RELATING), 12).otherwise(8).alias("paths"),
        F.when(n < 3, 0.35).otherwise(0.25).alias("threshold"), (n <= 8).alias("expand"),
    )


def _told(text: Column, patterns: tuple[str, ...], good) -> Column:
    """What the first pattern with a good match says."""
    low = F.lower(F.coalesce(text, F.lit("")))
    each = (F.nullif(F.trim(F.regexp_extract(low, p, 1)), F.lit("")) for p in patterns)
    return F.coalesce(*(F.when(good(x), F.upper(x)) for x in each))


def own_name(text: Column) -> Column:
    return _told(text, OWN_NAME, lambda x: ~x.isin(*NO_OWN_NAME))


def your_name(text: Column) -> Column:
    return _told(text, YOUR_NAME, lambda x: ~x.isin(*NO_YOUR_NAME))


def age(text: Column) -> Column:
    return _told(text, AGE, lambda x: x.cast("int").between(1, 150)).cast("int")


def place(text: Column) -> Column:
    return _told(text, PLACE, lambda x: F.char_length(x) >= 2)


def possessive_terms(text: Column) -> Column:
    """The words after each 's, upper case, without a plural S where longer than three letters."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"['’]s\s+([a-zA-Z_]+)"), F.lit(1))
    return F.transform(found, lambda w: F.upper(F.when((F.char_length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.char_length(w) - 1)).otherwise(w)))


def edge_line(source: Column, relationship: Column, destination: Column) -> Column:
    return F.concat(source, F.lit(" --"), relationship, F.lit("--> "), destination)


def parsed_edge(line: Column) -> Column:
    """struct<source, relationship, destination> of an edge's line, null where it is none."""
    part = lambda k: F.regexp_extract(line, r"(?s)^(.*?) --(.*?)--> (.*)$", k)
    return F.when(line.rlike(r"(?s)^.*? --.*?--> "), F.struct(part(1).alias("source"), part(2).alias("relationship"), part(3).alias("destination")))


def edge_sentence(source: Column, relationship: Column, destination: Column) -> Column:
    return F.concat(source, F.lit(" is "), F.lower(F.replace(relationship, F.lit("_"), F.lit(" "))), F.lit(" "), destination)


def path_sentence(edges: Column) -> Column:
    """An array of edges as ``s r d, which r d``."""
    said = lambda e: F.concat(F.lower(F.replace(e["relationship"], F.lit("_"), F.lit(" "))), F.lit(" "), e["destination"])
    return F.when(F.size(edges) > 0, F.concat(F.get(edges, F.lit(0))["source"], F.lit(" "), F.array_join(F.transform(edges, said), ", which ")))


def clean_answer(text: Column) -> Column:
    """An answer without blocks of reasoning and header tokens."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(think|thinking)>.*?</\1>", ""), r"<\|[a-z_]+\|>", "")
    return F.trim(bare)
