"""Operators against plain Python, on small frames and on the queries that SQL can't say."""

import difflib
import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from engramite.functions import talk, text
from engramite.operators import graph, profile, retrieval, vector
from engramite.plans import dsl, registry
from engramite.sources import files

SF = "/root/testdata/sf0.001"
EDGE = "source string, relationship string, destination string, weight double"


def _said(spark):
    return {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}


def test_entities_of_all_turns(spark):
    def plain(t):
        found = dict.fromkeys(re.findall(r"\b([A-Z][a-zA-Z0-9_\-]+)\b", t))
        heads = [q.split()[0] for q in re.findall(r'"([^"]+)"', t) if q.strip()]
        return len({*found, *(h[:1].upper() + h[1:].lower() for h in heads)})

    got = {(r.conv_id, r.turn): r.n for r in registry.entity_extract(spark, SF).collect()}
    assert got == {k: plain(t) for k, t in _said(spark).items()}


def test_marks_of_all_turns(spark):
    extra = {(-1, 1): "so so good!! i am SOOO, red, blue, and green? asdfgh. no, yes and maybe", (-1, 2): "İi I.i i", (-1, 3): None}
    rows = [(*k, t) for k, t in (_said(spark) | extra).items()]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    for r in frame.select("text", *text.message_features(F.col("text"))).collect():
        t = r.text or ""
        lines = [s for s in re.split(r"(?<=[.!?…])\s+", re.sub(r"\s+", " ", t, flags=re.ASCII).strip()) if s]
        first = [next((c for c in s if c.isalpha()), "") for s in lines]
        tokens = [w for w in re.split(r"\s+", re.sub(r"[@#]\w+", " ", re.sub(r"(?i)https?://\S+|www\.\S+", " ", t), flags=re.ASCII), flags=re.ASCII) if w]
        assert r.low_starts == sum(c.islower() for c in first), t
        assert r.small_i == len(re.findall(r"(?<![A-Za-z])i(?![A-Za-z])", t))
        assert r.elongated == sum(bool(re.search(r"([A-Za-z])\1\1", w)) for w in tokens)
        if t.isascii():
            assert r.repeats == len(re.findall(r"(?i)\b(\w+)\b(?:\s+\1\b)+", t))
            assert r.with_oxford == len(re.findall(r"(?i)\b\w+\b,\s+\b\w+\b,\s+and\s+\b\w+\b", t))
            assert r.keysmashes == len(re.findall(r"(?i)\b(?:[asdfghjkl]{5,}|[qwertyuiop]{5,}|[zxcvbnm]{5,})\b", t))


def test_facts_of_many_lines(spark):
    lines = ["Bob -- works at -- Acme", "<THINK>x - y - z\na - b - c</THINK>Ann – likes – tea", "Output: a - b - c", ".", "A - b", "Q! - is-a - b - c", "x - the - y", "n - " + "r" * 31 + " - m", "", None]
    frame = spark.createDataFrame([(x,) for x in lines], "t string")
    got = [[tuple(t) for t in r.f or []] for r in frame.select(text.triplets(F.col("t")).alias("f")).collect()]
    assert got == [[("BOB", "WORKS_AT", "ACME")], [("ANN", "LIKES", "TEA")], [], [], [], [("Q", "ISA", "B  C")], [], [], [], []]
    many = spark.createDataFrame([("\n".join(f"a{i} - r - b" for i in range(9)),)], "t string")
    assert many.select(F.size(text.triplets(F.col("t"))).alias("n")).first().n == 0  # R is under two letters
    many = spark.createDataFrame([("\n".join(f"a{i} - rel - b" for i in range(9)),)], "t string")
    assert many.select(F.size(text.triplets(F.col("t"))).alias("n")).first().n == 6


def test_relation_keys(spark):
    frame = spark.createDataFrame([("LIKES_CATS", "LIKES_CAT"), ("is-LIKES", "LIKE"), ("WAS", ""), ("has", "HAS"), ("boss_of", "BOS")], "r string, want string")
    assert all(x.k == x.want for x in frame.select("want", text.relation_key(F.col("r")).alias("k")).collect())


def test_speaker_and_commands(spark):
    frame = spark.createDataFrame([("I am tired",), ("i'm 30 years old, i'm from  New York.",), ("@UpdateQ x",), ("hi",), (None,)], "t string")
    t = F.col("t")
    got = [tuple(r) for r in frame.select(talk.own_name(t), talk.age(t), talk.place(t), talk.command(t), talk.gate(t)).collect()]
    assert got == [("TIRED", None, None, "chat", None), ("FROM", 30, "NEW YORK", "chat", None), (None, None, None, "updateq", None), (None, None, None, "chat", "greeting_filler"), (None, None, None, "chat", "greeting_filler")]


def _graph(spark):
    edges = [("a", "R", "a", 1.0), ("a", "R", "b", 2.0), ("b", "S", "c", 1.0), ("c", "R", "a", 3.0), ("x", "R", "y", 1.0)]
    nodes = spark.createDataFrame([(i, i.upper(), "N") for i in "abcxyz"], "id string, name string, label string")
    props = spark.createDataFrame([("a", "k", "1")], "node_id string, key string, value string")
    return nodes, props, spark.createDataFrame(edges, EDGE)


@pytest.mark.parametrize(
    "asked, want",
    [
        ("MATCH (a)-[:R]->(a) RETURN a.id", {("a",)}),
        ("MATCH (a {id:'b'})-[r]->(b) RETURN b.id", {("c",)}),
        ("MATCH (a)-[r]->(b) WHERE a.id = 'x' RETURN b.name", {("Y",)}),
        ("MATCH (a {id:'b'})-[*0..1]->(b) RETURN b.id", {("b",), ("c",)}),
        ("MATCH (a {id:'b'})-[*2..]->(b) RETURN b.id", {("a",), ("b",), ("c",)}),
        ("MATCH (a {id:'b'})-[*2..2]->(b) RETURN b.id", {("a",)}),
        ("MATCH (a {id:'z'})-[*0..]->(b) RETURN b.id", {("z",)}),
        ("MATCH (a)-[r]->(b) WHERE SIMILAR(b, 'q', 5, 0.1) OR a.k = '1' RETURN a.id, b.id", {("a", "a"), ("a", "b"), ("x", "y")}),
    ],
)
def test_patterns(spark, asked, want):
    hits = lambda t, k, least: spark.createDataFrame([("y",), ("z",)], "id string")
    assert {tuple(r) for r in dsl.compile_query(asked, *_graph(spark), similar=hits).collect()} == want


def test_reasoning_chains_against_all_pairs(spark):
    names = "abcd"
    every = [(s, r, d, 1.0) for s, d in itertools.product(names, names) for r in "PQ" if (ord(s) * 7 + ord(d) * 5 + ord(r)) % 3]
    pairs = []
    for e, f in itertools.combinations(sorted(every, key=lambda x: "|".join(x[:3])), 2):
        rule = ("chain", 0.8) if e[2] == f[0] else ("converge", 0.6) if e[2] == f[2] and e[0] != f[0] else ("diverge", 0.7) if e[0] == f[0] and e[2] != f[2] else None
        if rule:
            pairs.append((-rule[1], "|".join(e[:3]), "|".join(f[:3]), rule[0]))
    for k in (3, 20, 200):
        got = [(-r.strength, r.eid1, r.eid2, r.kind) for r in graph.reasoning_chains(spark.createDataFrame(every, EDGE), k).collect()]
        assert got == sorted(pairs)[:k]


def test_path_edges_follow_the_paths(spark):
    edges = registry._ordered(spark, SF)
    known = {(r.source, r.destination): r.weight for r in edges.collect()}
    steps = {(r.id, r.seq): r for r in registry.shortest_path_edges(spark, SF).collect()}
    assert steps
    for (i, seq), r in steps.items():
        assert r.weight == known.get((r.a, r.b), known.get((r.b, r.a)))
        after = steps.get((i, seq + 1))
        assert after.a == r.b if after else r.b == i


def test_clusters_against_a_plain_loop(spark):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    rows = [tuple(r) for r in registry._words(spark, SF).select(F.substring("word", 1, 1), "word", "n").collect()]
    want, heads = {}, {}
    for letter, word, n in sorted(rows, key=lambda r: (-r[2], r[1])):
        own = heads.setdefault(letter, [])
        want[word] = next((h for h in own if near(word, h)), None) or word
        if want[word] == word:
            own.append(word)
    assert {r.word: r.canonical for r in registry.QUERIES["edit_clusters"](spark, SF).collect()} == want


def test_similar_names_against_all_pairs(spark):
    names = ["blue anvil", "Blue Anvil", "blue anvils", "red anvil", "blue", "green door", "green doors open"]

    def score(a, b, least):
        x, y = a.lower(), b.lower()
        if x == y:
            return 1.0
        if (x in y or y in x) and min(len(x), len(y)) / max(len(x), len(y)) >= least:
            return min(len(x), len(y)) / max(len(x), len(y))
        ratio, j = difflib.SequenceMatcher(None, x, y).ratio(), len({*x.split()} & {*y.split()}) / len({*x.split()} | {*y.split()})
        fit = [v for v in (ratio, (ratio + j) / 2 if j >= least else 0) if v >= least]
        return max(fit, default=None)

    got = {(r.a, r.b): round(r.score, 9) for r in profile.similar_names(spark.createDataFrame([(n,) for n in names], "name string"), 0.6, 10).collect()}
    share = lambda a, b: {*a.lower().split()} & {*b.lower().split()} or a[:3].lower() == b[:3].lower()
    assert got == {(a, b): round(s, 9) for a, b in itertools.permutations(names, 2) if share(a, b) and (s := score(a, b, 0.6)) is not None}


def test_recall_of_the_approximate_index(spark):
    exact = {(r.qid, r.vec_id) for r in registry.vector_topk_cosine(spark, SF).collect()}
    found = {(r.qid, r.vec_id) for r in registry.QUERIES["vector_topk_lsh"](spark, SF).collect()}
    recall = len(exact & found) / len(exact)
    print(f"recall {recall:.3f}")
    assert recall >= 0.9


def test_diverse_pick(spark):
    rows = [(1, 1, "memory", 0.9, 1, 0, ["a"]), (1, 2, "memory", 0.8, 1, 0, ["b"]), (1, 3, "memory", 0.7, 1, 0, ["c"]), (1, 4, "edge", 0.6, 1, 0, ["a"]), (1, 5, "edge", 0.5, 0, 1, ["d"]), (1, 6, "edge", 0.5, 2, 0, ["e"]), (2, 7, "edge", 0.1, 0, 0, [])]
    items = spark.createDataFrame(rows, "qid long, item long, kind string, score double, n_edges int, n_chains int, entities array<string>")
    got = sorted((r.qid, r.place, r.item) for r in retrieval.diverse(items).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (1, 3, 6), (1, 4, 5), (2, 1, 7)]


def test_zero_vectors_and_ties(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id in (1, 2)").selectExpr("vec_id as qid", "embedding as query")
    got = {(r.qid, r["rank"]): (r.vec_id, r.score) for r in vector.top_k(v, q, 2).collect()}
    assert got == {(2, 1): (3, 1.0), (2, 2): (1, 0.0), (1, 1): (2, 0.0), (1, 2): (3, 0.0)}
    assert not math.isnan(sum(s for _, s in got.values()))


def test_question_files_skip_bad_lines(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "a", "answers": ["x"]}\nnot json\n{"answers": ["y"]}\n{"query": "b"}\n')
    assert sorted((r["query"], r["answers"]) for r in files.questions(spark, f"file://{tmp_path}/q.jsonl").collect()) == [("a", ["x"]), ("b", [])]


def test_pattern_files_add_up_and_skip_bad_lines(spark, tmp_path):
    rows = [("s", "so", "sooo", 2), ("s", "so", "so", 5)]
    for part in (rows, [("s", "so", "sooo", 3), ("s", "sa", "so", 1), ("t", "to", "too", None)]):
        files.write_patterns(spark.createDataFrame(part, "category string, canonical string, word string, n long"), f"{tmp_path}/p")
    (tmp_path / "p" / "more.json").write_text('{"category": "x"}\nno json\n')
    got = sorted(tuple(r) for r in files.patterns(spark, f"{tmp_path}/p").collect())
    assert got == [("s", "so", "sa", 6), ("s", "sooo", "so", 5), ("t", "too", "to", 0)]


def test_profiles_are_the_last_saved(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "user_id string, words long, name string")
    files.write_profiles(frame([("a", 1, "é"), ("b", 2, None), (None, 9, "x")]), f"{tmp_path}/p", 1)
    files.write_profiles(frame([("a", 5, 'q"')]), f"{tmp_path}/p", 2)
    got = sorted(tuple(r) for r in files.profiles(spark, f"{tmp_path}/p", "words long, name string, later double").collect())
    assert got == [("a", 2, 5, 'q"', None), ("b", 1, 2, None, None)]


def test_pattern_examples_against_python(spark):
    said = [(1, "WOW soooo good!!! i i said... REALLY?? \U0001f600\U0001f600\U0001f602"), (1, None), (2, "lower start. Then the the end?! " + "AB " * 12), (2, ""), (3, "Fine. It is.")]
    rows = [(c, n, t) for n, (c, t) in enumerate(said)]
    got = {r.conv_id: r for r in profile.ingested(profile.pattern_map(spark.createDataFrame(rows, "conv_id long, turn long, text string")), "conv_id").collect()}
    for c in (1, 2, 3):
        texts = [t or "" for k, t in said if k == c]
        count = lambda p: sum(len(re.findall(p, t)) for t in texts)
        caps = sum(min(10, sum(bool(re.fullmatch("[A-Z]{2,}", re.sub("[^A-Za-z]", "", w))) for w in t.split())) for t in texts)
        emoji = sum(len(set(re.findall("[\U0001f300-\U0001faff]", t))) for t in texts)
        long = sum(bool(re.search(r"([A-Za-z])\1\1", w)) for t in texts for w in t.split())
        want = (long, emoji, caps, count("(?<![A-Za-z])i(?![A-Za-z])"), count("!{2,}"), count(r"\?{2,}"), count(r"\.{3}|…"), count(r"(?:!\?|\?!)+"), count(r"(?i)\b(\w+)\b(?:\s+\1\b)+"))
        r = got[c]
        assert (r.elongations, r.emoji, r.all_caps, r.small_i, r.multi_exclaim, r.multi_ask, r.ellipses, r.mixed_marks, r.repeats) == want
    assert [got[c].low_starts for c in (1, 2, 3)] == [1, 1, 0]  # "i i said..." starts a sentence


def test_node_props_as_json(spark):
    props = spark.createDataFrame([("n", "b", "2"), ("n", "a", 'x"y'), ("n", "a", "w"), ("m", None, "1"), ("m", "c", None)], "node_id string, key string, value string")
    assert [tuple(r) for r in graph.props_json(props).collect()] == [("n", '{"a":"x\\"y","b":"2"}')]
