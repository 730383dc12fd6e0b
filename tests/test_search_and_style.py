"""Search end to end and the style operators without SQL, against plain Python."""

import difflib
import hashlib
import itertools
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from engramite.functions import scoring, text
from engramite.operators import graph, profile, search
from engramite.plans import registry
from tests.oracle import compared, connect

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"
AS_OF = "2024-06-01 00:00:00"


def plain(t):
    return re.findall(r"[a-z]+", "".join(c for c in unicodedata.normalize("NFD", t or "") if unicodedata.category(c) != "Mn").lower())


def turns(spark):
    return [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]


@pytest.mark.parametrize("name", ["hybrid_search", "graph_context_score", "extraction_context", "text_embed", "text_merge", "lexical_match"])
def test_against_sql_over_more_rows(spark, name):
    got, want = compared(registry.QUERIES[name](spark, BIG), connect(BIG), registry.SQL[name])
    assert got and got == want


# --- search


def memory(spark, rows, facts):
    texts = spark.createDataFrame(rows, "memory_id long, text string")
    said = spark.createDataFrame(facts, "memory_id long, source string, relationship string, destination string")
    index = said.select("memory_id", F.col("source").alias("entity")).union(said.select("memory_id", "destination")).distinct()
    edges = said.groupBy("source", "relationship", "destination").agg(F.count("*").cast("double").alias("weight"), F.lit(None).cast("timestamp").alias("updated_at"))
    return search.Memory(texts, index, said, edges)


TOLD = [(1, "Bob works at Acme"), (2, "Acme is based in Paris"), (3, "Ann is a friend of Bob"), (4, "Zoe paints on 2024-05-03"), (5, "yesterday Zoe met Ann"), (6, None)]
FACTS = [(1, "BOB", "WORKS_AT", "ACME"), (2, "ACME", "BASED_IN", "PARIS"), (3, "ANN", "FRIEND_OF", "BOB"), (4, "ZOE", "PAINTS", "ART"), (5, "ZOE", "MET", "ANN")]


def ask(spark, rows):
    return spark.createDataFrame(rows, "qid long, text string")


def test_names_of_questions(spark):
    m = memory(spark, TOLD, FACTS)
    q = ask(spark, [(1, "Where does Bob work with Ann?"), (2, "who knows bob and paris"), (3, "nothing here"), (4, None), (5, 'about "acme corp"')])
    got = {(r.qid, r.entity) for r in search.named(q, m.index.select(F.col("entity").alias("name"))).collect()}
    assert got == {(1, "WHERE"), (1, "BOB"), (1, "ANN"), (2, "BOB"), (2, "PARIS"), (5, "ACME")}
    friends = search.friends_of(ask(spark, [(1, "what did Bob's buddy say"), (2, "Zoe's cat")]), m.edges)
    assert [tuple(r) for r in friends.collect()] == [(1, "ANN")]


def test_expansion_from_many_starts(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(30)}", "R", f"n{rng.randrange(30)}", float(rng.randint(1, 3)), None) for _ in range(40)]
    frame = spark.createDataFrame(edges, "source string, relationship string, destination string, weight double, updated_at timestamp")
    near = defaultdict(set)
    for a, _, b, _, _ in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    starts = [(q, f"n{i}") for q in range(4) for i in (q, q + 7)]
    want = {}
    for q in range(4):
        front, seen = {s for k, s in starts if k == q}, {}
        for hop in range(4):
            seen |= {x: hop for x in front}
            front = {y for x in front for y in near[x]} - set(seen)
        want |= {(q, x): h for x, h in seen.items()}
    got = search.expanded(search.strongest(frame, 100), spark.createDataFrame(starts, "qid long, id string"), 3)
    assert {(r.qid, r.id): r.hop for r in got.collect()} == want


def test_walks_of_many_questions_equal_single_walks(spark):
    edges = [("BOB", "FRIEND", "ANN", 1.0), ("ANN", "FATHER", "CARL", 0.5), ("ANN", "FATHER_IN_LAW", "DAN", 1.0), ("BOB", "WORKS_AT", "ACME", 2.0), ("EVE", "FRIEND", "BOB", 1.0), ("CARL", "LIKES", "TEA", 1.0)]
    frame = spark.createDataFrame([(*e, None) for e in edges], "source string, relationship string, destination string, weight double, updated_at timestamp")
    at = F.lit(AS_OF).cast("timestamp")
    starts = spark.createDataFrame([(1, "BOB", ["FRIEND", "FATHER"]), (2, "EVE", ["FRIEND"]), (3, "ACME", ["FRIEND"]), (4, "BOB", [])], "qid long, id string, terms array<string>")
    got = defaultdict(dict)
    for r in search.chained(frame, starts, at, 5).collect():
        got[r.qid][r.node] = round(r.score, 9)
    for qid, start, terms in ((1, "BOB", ["FRIEND", "FATHER"]), (2, "EVE", ["FRIEND"]), (3, "ACME", ["FRIEND"])):
        assert got[qid] == {r.id: round(r.score, 9) for r in graph.traverse_chain(frame, start, terms, at, 5).collect()}
    best = {r.neighbor: round(r.score, 9) for r in search.best_neighbours(frame, spark.createDataFrame([(1, "BOB")], "qid long, id string"), at, 9).collect()}
    assert best == {r.neighbor: round(r.score, 9) for r in graph.ranked_neighbors(frame, "BOB", at, 9).collect()}


def test_times_lift_candidates(spark):
    found = spark.createDataFrame([(q, m, 0.5, 0.1) for q in (1, 2, 3) for m in (4, 5)], "qid long, memory_id long, similarity double, boost double")
    marks = spark.createDataFrame([(4, None, "2024-05-03"), (5, "YESTERDAY", None)], "memory_id long, window string, date string")
    q = ask(spark, [(1, "who painted on 2024-05-03"), (2, "what was last night"), (3, "who paints")])
    got = {(r.qid, r.memory_id): r.boost for r in search.timed_boost(found, q, marks).collect()}
    assert got == {(1, 4): 0.25, (1, 5): 0.1, (2, 4): 0.1, (2, 5): 0.2, (3, 4): 0.1, (3, 5): 0.1}


def weights(t):
    ws = re.findall(search.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {w: n / len(ws) for w, n in Counter(ws).items()}, ws


def vector(t, width=256):
    v = [0.0] * width
    for w in weights(t)[1]:
        h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
        v[h % width] += -1.0 if h // width % 2 else 1.0
    n = math.sqrt(sum(x * x for x in v))
    return [x / n if n else 0.0 for x in v]


def test_hashed_words(spark):
    rows = [(1, "Red red boat"), (2, ""), (3, None), (4, "naïve Ünï 42")]
    got = {r.k: r.embedding for r in search.embedded(spark.createDataFrame(rows, "k long, text string"), "k").collect()}
    assert got == {k: pytest.approx(vector(t)) for k, t in rows}


def pair_scores(spark, pairs):
    """The fusion of enumerated (qid, memory_id, query, doc)."""
    rows = []
    for q, m, query, doc in pairs:
        (wq, _), (wd, _) = weights(query), weights(doc)
        dense = sum(a * b for a, b in zip(vector(query), vector(doc), strict=True))
        rows.append((q, m, query, doc, dense, float(sum(wq[w] * wd[w] for w in wq if w in wd)), len(set(wq) & set(wd)) / len(wq) if wq else 0.0))
    frame = spark.createDataFrame(rows, "q long, m long, query string, doc string, d double, s double, t double")
    return {(r.q, r.m): r.score for r in frame.select("q", "m", F.round(scoring.adaptive_fusion(F.col("query"), F.col("doc"), F.col("d"), F.col("s"), F.col("t")), 6).alias("score")).collect()}


def test_unified_search_against_enumerated_pairs(spark):
    m = memory(spark, TOLD, FACTS)
    questions = [(1, "where does Bob work"), (2, "which city is Acme based in"), (3, "who is a friend of Ann")]
    got = [tuple(r) for r in search.unified_search(ask(spark, questions), m, F.lit(AS_OF).cast("timestamp"), 4, hops=1, fan_out=5).collect()]
    said = {i: f"{t or ''} [Context: Entity Profile: {s} is {r.lower().replace('_', ' ')} {d}]" for (i, t), (_, s, r, d) in zip(TOLD, FACTS, strict=False)} | {6: ""}
    pool = {(r.qid, r.memory_id) for r in search.hybrid_search(ask(spark, questions), m, F.lit(AS_OF).cast("timestamp"), 100, 100, hops=1, fan_out=5).collect()}
    scores = pair_scores(spark, [(q, i, dict(questions)[q], said[i]) for q, i in pool])
    want = []
    for q, _ in questions:
        best = sorted((-s, i) for (k, i), s in scores.items() if k == q and s >= 0.01)[:4]
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want)
    gold = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (3, 99)], "qid long, memory_id long")
    acc = search.accuracy(search.unified_search(ask(spark, questions), m, F.lit(AS_OF).cast("timestamp"), 4, hops=1, fan_out=5), gold).first()
    right = [min((n for q2, i, _, n in want if q2 == q and i == q), default=None) for q, _ in questions]
    assert (acc.questions, acc.acc, acc.mrr) == (3, round(sum(r is not None for r in right) / 3, 6), round(sum(1 / r for r in right if r) / 3, 6))
    assert acc.acc == 1.0


def test_graph_first_says_why(spark):
    m = memory(spark, [*TOLD, (7, "Gil")], FACTS)
    asked = [(1, "hi"), (2, "abc"), (3, "tell me of nothing at all"), (4, "what does Bob do"), (5, "and Xavier went where")]
    status, ranked = search.graph_first_search(ask(spark, asked), m, F.lit(AS_OF).cast("timestamp"), 3, 0.0, hops=1, fan_out=5)
    assert {r.qid: r.status for r in status.collect()} == {1: "greeting_filler", 2: "too_short", 3: "no_entities", 4: "ranked", 5: "vector_fallback"}
    found = [tuple(r) for r in ranked.collect()]
    want = pair_scores(spark, [(4, i, asked[3][1], dict(TOLD)[i]) for i in (1, 2, 3, 5)])
    best = sorted((-s, i) for (_, i), s in want.items())[:3]
    assert sorted((r, i, s) for q, i, s, r in found if q == 4) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)] and {q for q, *_ in found} <= {4, 5}


# --- style


def clustered(rows, near, key):
    heads, out = defaultdict(list), {}
    for group, word, n in sorted(rows, key=lambda r: (-r[2], r[1])):
        like = [h for h in heads[group] if near(word, h)]
        out[group, word] = key(like, word, heads[group]) if like else word
        if not like:
            heads[group].append(word)
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def letters(spark, rest=None):
    n = Counter(w for c, _, _, t in turns(spark) if rest is None or c % 2 == rest for w in plain(t))
    return [(w[0], w, k) for w, k in n.items()]


def test_cluster_shares_against_a_pass(spark):
    rows = letters(spark)
    head = clustered(rows, one_edit, lambda like, w, hs: like[0])
    sums = defaultdict(lambda: [0, 0])
    for g, w, n in rows:
        sums[g, head[g, w]][0] += 1
        sums[g, head[g, w]][1] += n
    want = set()
    for g in {g for g, _, _ in rows}:
        own = sorted(((-t, c, v) for (k, c), (v, t) in sums.items() if k == g))
        total = sum(-t for t, _, _ in own)
        want |= {(g, c, v, -t, round(100.0 * -t / total, 4), i + 1) for i, (t, c, v) in enumerate(own[:10])}
    got = {(r.letter, r.canonical, r.variants, r.total, r.pct, r.place) for r in registry.QUERIES["cluster_shares"](spark, SF).collect()}
    assert {x[:4] + x[5:] for x in got} == {x[:4] + x[5:] for x in want}
    assert {x[:2]: x[4] for x in got} == {x[:2]: pytest.approx(x[4], abs=1e-4) for x in want}


def test_learned_patterns_against_two_passes(spark):
    first = clustered(letters(spark, 0), one_edit, lambda like, w, hs: like[0])
    later = letters(spark, 1)
    fresh = clustered([r for r in later if r[:2] not in first], one_edit, lambda like, w, hs: like[0])
    want = Counter()
    for g, w, n in later:
        want[g, (first | fresh)[g, w]] += n
    assert {(r.letter, r.canonical): r.n for r in registry.QUERIES["learned_patterns"](spark, SF).collect()} == want


def test_semantic_clusters_against_a_pass(spark):
    grams = lambda w: {f"  {w} "[i : i + 3] for i in range(len(w) + 1)}
    cos = lambda a, b: round(len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b))), 9)
    rows = letters(spark)
    rank = {w: (-n, w) for _, w, n in rows}
    want = clustered(rows, lambda a, b: cos(a, b) >= 0.7, lambda like, w, hs: min(like, key=lambda h: (-cos(w, h), rank[h])))
    assert {(r.letter, r.word): r.canonical for r in registry.QUERIES["semantic_clusters"](spark, SF).collect()} == want


def test_entity_index_join_against_python(spark):
    def names(t):
        found = re.findall(r"\b([A-Z][a-zA-Z0-9_\-]+)\b", t or "")
        heads = [q.split()[0] for q in re.findall(r'"([^"]+)"', t or "") if q.strip()]
        return {*found, *(h[:1].upper() + h[1:].lower() for h in heads)}

    of = defaultdict(set)
    for c, n, _, t in turns(spark):
        for e in names(t):
            of[e.lower()].add((c, n))
    got = {(r.entity, r.memories, r.first_conv) for r in registry.QUERIES["entity_index_join"](spark, SF).collect()}
    assert got == {(e, len(m), min(c for c, _ in m)) for e, m in of.items()}


def test_stream_patterns_equal_the_batch_form(spark):
    got = {tuple(r[c] for c in ("form", "canonical", "variants", "total")) for r in registry.QUERIES["stream_patterns"](spark, SF).collect()}
    n = Counter(w for _, _, _, t in turns(spark) for w in plain(t))
    by = defaultdict(list)
    for w in n:
        by[re.sub(r"(.)\1+", r"\1", w)].append(w)
    assert got == {(f, min(ws, key=lambda w: (len(w), w)), len(ws), sum(n[w] for w in ws)) for f, ws in by.items()}


def test_client_merges_against_all_pairs(spark):
    rows = [(r.name, r.client_id) for r in spark.read.parquet(f"{SF}/clients.parquet").collect() if r.name is not None and r.client_id is not None]
    seq = {}
    for name, i in rows:
        seq[name] = min(seq.get(name, i), i)
    names = sorted(x for x in seq if x)

    def score(a, b):
        x, y = a.lower(), b.lower()
        if x == y:
            return 1.0
        if (x in y or y in x) and min(len(x), len(y)) / max(len(x), len(y)) >= 0.9:
            return min(len(x), len(y)) / max(len(x), len(y))
        m = difflib.SequenceMatcher(None, x, y)
        if m.real_quick_ratio() < 0.9 or m.quick_ratio() < 0.9:
            ratio = 0.0
        else:
            ratio = m.ratio()
        j = len({*x.split()} & {*y.split()}) / len({*x.split()} | {*y.split()})
        return max((v for v in (ratio, (m.ratio() + j) / 2 if j >= 0.9 else 0) if v >= 0.9), default=None)

    to = {}
    for a in names:
        best = [(-s, b) for b in names if (seq[b], b) < (seq[a], a) and abs(len(a) - len(b)) <= 12 and (s := score(a, b)) is not None]
        if best:
            to[a] = min(best)[1]
    for a in to:
        while to[a] in to:
            to[a] = to[to[a]]
    assert {r.source_name: r.target_name for r in registry.QUERIES["client_merges"](spark, SF).collect()} == to


def test_marked_phrases_by_hand(spark):
    rows = [(1, 1, "u", "ngl this is SOOO good good!! maybe hahaha"), (1, 2, "u", "i am here... no?! Maybe"), (2, 1, "u", "yay 😀😀 asdfgh lowkey zzz wonderfulness"), (2, 2, "u", None), (3, 1, "u", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.label, r.phrase): r.n for r in profile.marked_phrases(frame, {"hedge": ["maybe"]}, "ness$", "z").collect()}
    want = {
        (1, "hedge", "maybe"): 2, (1, "slang", "ngl"): 1, (1, "affective", "hahaha"): 1, (1, "user_frequent", "god"): 2, (1, "elongation", "SOOO"): 1, (1, "punct", "multi_exclaim"): 1, (1, "punct", "ellipses"): 1, (1, "punct", "mixed_marks"): 1,
        (1, "special", "keysmash"): 1, (1, "case", "ALL_CAPS"): 1, (1, "case", "lowercase_sentence_starts"): 2, (1, "case", "lowercase_i"): 1,
        (2, "slang", "lowkey"): 1, (2, "affective", "yay"): 1, (2, "emoji", "any"): 2, (2, "emoji", "😀"): 2, (2, "special", "keysmash"): 1, (2, "elongation", "zzz"): 1, (2, "user_signature", "wonderfulnes"): 1, (2, "user_rare", "wonderfulnes"): 1, (2, "case", "lowercase_sentence_starts"): 1,
    }
    assert {k: v for k, v in got.items() if not k[1].startswith("ngram")} == want
    assert got[1, "ngram2", "this_is"] == 1 and got[1, "ngram3", "so_god_god"] == 1 and (2, "ngram2", "yay_lowkey") not in got
    assert text.EMOJI and not any(k[0] == 3 for k in got)


def test_chains_of_questions_against_all_pairs(spark):
    rng = random.Random(6)
    paths = [(q, i, rng.choice("ABCD"), "R", rng.choice("ABCD")) for q in range(5) for i in range(8)]
    said = [(0, "a b"), (1, "who is c"), (2, ""), (3, None), (4, "abd")]
    want = []
    for q, words in ((q, (t or "").lower().split()) for q, t in said):
        own = sorted(p[1:] for p in paths if p[0] == q)
        found = []
        for (i, s1, _, d1), (j, s2, _, d2) in itertools.combinations(own, 2):
            rule = (0.8, "chain", [s1, d1, d2]) if d1 == s2 else (0.6, "converge", [s1, s2, d1]) if d1 == d2 and s1 != s2 else (0.7, "diverge", [d1, s1, d2]) if s1 == s2 and d1 != d2 else None
            if rule:
                part = sum(any(w in x.lower() for w in words) for x in rule[2]) / 3
                found.append((-round(rule[0] * part, 9), i, j, rule[1]))
        want += [(q, i, j, kind, -s) for s, i, j, kind in sorted(found)[:3]]
    frame = spark.createDataFrame(paths, "qid long, place long, source string, relationship string, destination string")
    got = [(r.qid, r.i, r.j, r.kind, r.score) for r in search.reasoned(frame, ask(spark, said)).collect()]
    assert sorted(got) == sorted(want)


def test_places_of_emoji(spark):
    emoji = re.compile("[\U0001F300-\U0001FAFF\u2600-\u27BF\U0001F1E6-\U0001F1FF]")
    texts = ["😀 hello there my friend of old.", "so 😀 it goes on and on. then end 😀! 😀😀 all.", "nothing. at all", None, "", "a long sentence with one 😀 in the middle of it. another 😀 one like that here"]
    for t in texts:
        total = first = mid = last = 0
        for s in [x for x in re.split(r"(?<=[.!?…])\s+", re.sub(r"\s+", " ", t or "").strip()) if x]:
            at = [i for i, c in enumerate(s) if emoji.match(c)]
            if at:
                total += 1
                first += at[0] <= int(0.1 * len(s))
                last += at[-1] >= max(0, int(0.9 * len(s)) - 1)
                mid += first + last < total
        got = spark.createDataFrame([(t,)], "t string").select(text.emoji_places(F.col("t")).alias("p")).first().p
        assert tuple(got) == (total, first, mid, last), t


def test_blueprints_follow_the_features(spark):
    rows = [(1, 1, "u", "well i said NO!! and so it goes"), (1, 2, "u", "hmm. soooo what"), (2, 1, "u", "A plain line of words"), (3, 1, "u", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.asDict() for r in profile.style_blueprint(frame, {"filler": ["well", "hmm"]}).collect()}
    f = defaultdict(Counter)
    for r in frame.select("conv_id", *text.message_features(F.col("text"))).collect():
        for k in ("n_sentences", "n_tokens", "low_starts", "all_caps", "small_i", "elongated"):
            f[r.conv_id][k] += r[k]
    for c, n in f.items():
        pct = lambda x, of: round(100 * x / of, 1) if x else None
        assert got[c]["lowercase_starts"] == pct(n["low_starts"], n["n_sentences"]) and got[c]["all_caps"] == pct(n["all_caps"], max(1, n["n_tokens"]))
        assert got[c]["lowercase_i"] == pct(n["small_i"], n["n_sentences"]) and got[c]["elongations"] == pct(n["elongated"], n["n_sentences"])
    assert got[1]["filler"] == pct(2, f[1]["n_sentences"]) and got[2]["filler"] is None and got[1]["avoids_capitals"] and got[2]["avoids_capitals"] is None
    assert got[3]["avg_sentence_length"] is None and got[2]["avg_sentence_length"] == 5.0
