"""The memory store's commits, similarity joins and leaders, against plain Python."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from engramite.operators import similarity
from engramite.operators.memory_store import MemoryStore

AT = F.lit


def when(day):
    return F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")


def texts(spark, rows):
    return spark.createDataFrame(rows, "memory_id long, text string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def kept(spark, tmp_path):
    s = MemoryStore(spark, f"file://{tmp_path}/m", width=64)
    s.add(texts(spark, [(1, "Bob -- works at -- Acme"), (2, "Ann -- lives in -- Paris"), (3, None)]), when(1))
    return s


def test_adds_merge_what_is_alike(spark, kept):
    kept.add(texts(spark, [(10, "Ann -- lives in -- Paris now"), (11, "Zoe -- likes -- green tea")]), when(2), same=0.8)
    assert {r.memory_id: r.text for r in kept.read("memories").collect()} == {1: "Bob -- works at -- Acme", 2: "Ann -- lives in Paris now", 3: "", 11: "Zoe -- likes -- green tea"}
    assert rows(kept.edges()) == [("ent::BOB", "WORKS_AT", "ent::ACME", 1.0), ("ent::ZOE", "LIKES", "ent::GREEN TEA", 1.0)]
    assert rows(kept.read("history").select("memory_id", "event")) == [(1, "ADD"), (11, "ADD"), (2, "ADD"), (2, "UPDATE"), (3, "ADD")]
    assert kept.read("vectors").count() == 4


def test_updates_deletes_and_wipes_are_commits(spark, kept):
    kept.update(spark.createDataFrame([(3, 1, "Cy -- knows -- Bob"), (99, 1, "nobody")], "memory_id long, seq long, text string"), when(2))
    assert dict(rows(kept.read("memories")))[3] == "Cy -- knows -- Bob" or "Cy" in dict(rows(kept.read("memories")))[3]
    kept.delete(texts(spark, [(1, ""), (77, "")]), when(3))
    assert [r.memory_id for r in kept.read("memories").orderBy("memory_id").collect()] == [2, 3]
    assert kept.read("said").where("memory_id = 1").count() == kept.read("index").where("memory_id = 1").count() == 0
    last = kept.store.numbers()[-1]
    assert kept.delete_all(when(4)) == 2
    assert [kept.read(n).count() for n in ("memories", "vectors", "said", "index")] == [0, 0, 0, 0]
    assert rows(kept.read("history").groupBy("event").count()) == [("ADD", 3), ("DELETE", 3), ("UPDATE", 1)]
    assert kept.read("memories", last).count() == 2
    kept.store.restore(last)
    assert kept.read("memories").count() == 2 and kept.read("history").where("event = 'DELETE'").count() == 1


def test_a_failed_add_changes_nothing(spark, kept, monkeypatch):
    before = {n: rows(kept.read(n)) for n in ("memories", "said", "index", "history")}
    history = MemoryStore._history
    monkeypatch.setattr(MemoryStore, "_history", lambda self, e, at: history(self, e, at).withColumn("event", F.raise_error(F.lit("executor lost")).cast("string")))
    with pytest.raises(Exception, match="executor lost"):  # after texts, vectors, facts and index are written
        kept.add(texts(spark, [(20, "Dan -- met -- Eve")]), when(2))
    monkeypatch.undo()
    assert {n: rows(kept.read(n)) for n in before} == before
    kept.add(texts(spark, [(20, "Dan -- met -- Eve")]), when(2))
    assert kept.read("memories").count() == 4


def test_merges_reach_every_table(spark, kept):
    kept.add(texts(spark, [(5, "Bobby -- works at -- Acme Corp"), (6, "Eve -- likes -- Bobby")]), when(2))
    kept.merge_entities(spark.createDataFrame([("bobby", "Bob"), ("ACME CORP", "Acme"), ("NOBODY", "X")], "source_name string, target_name string"), when(3))
    assert rows(kept.edges()) == [("ent::ANN", "LIVES_IN", "ent::PARIS", 1.0), ("ent::BOB", "WORKS_AT", "ent::ACME", 2.0), ("ent::EVE", "LIKES", "ent::BOB", 1.0)]
    assert {r.entity for r in kept.read("index").collect()} == {"ANN", "PARIS", "BOB", "ACME", "EVE"}
    assert dict(rows(kept.read("memories")))[6] == "Eve -- likes -- Bob"
    assert kept.read("memories").count() == kept.read("vectors").count() == 5
    kept.merge_relations(spark.createDataFrame([("LIKES", "LOVES")], "source_name string, target_name string"))
    assert {r.relationship for r in kept.edges().collect()} == {"LIVES_IN", "WORKS_AT", "LOVES"}
    kept.forget_entities(spark.createDataFrame([("bob",)], "name string"))
    assert rows(kept.edges()) == [("ent::ANN", "LIVES_IN", "ent::PARIS", 1.0)] and kept.read("memories").count() == 5
    now = {n: rows(kept.read(n).select("memory_id")) for n in ("memories", "vectors", "said", "index")}
    kept.compact()
    assert {n: rows(kept.read(n).select("memory_id")) for n in now} == now and kept.store.read("gone").count() == 0
    assert kept.store.vacuum() > 0 and kept.read("memories").count() == 5


@pytest.mark.parametrize(("measure", "least"), [("jaccard", 0.5), ("jaccard", 0.8), ("cosine", 0.7), ("dice", 0.75)])
def test_set_pairs_against_all_pairs(spark, measure, least):
    rng = random.Random(least)
    sets = {i: {f"t{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randint(1, 8))} for i in range(120)} | {200: set(), 201: {"t1"}, 202: {"t1"}}
    value = {"jaccard": lambda a, b: len(a & b) / len(a | b), "cosine": lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5, "dice": lambda a, b: 2 * len(a & b) / (len(a) + len(b))}[measure]
    want = {(i, j): round(value(sets[i], sets[j]), 9) for i, j in itertools.combinations(sets, 2) if sets[i] and sets[j] and value(sets[i], sets[j]) >= least - 1e-12}
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()] + [(None, ["t1"]), (0, sorted(sets[0]))], "id long, tokens array<string>")
    assert {(r.a, r.b): round(r.score, 9) for r in similarity.set_pairs(frame, least, measure).collect()} == want


def test_set_pairs_of_a_common_token_meet_block_by_block(spark, monkeypatch):
    """All sets hold one token and nothing rarer: no task may hold all of them, and none of their pairs is lost."""
    monkeypatch.setattr(similarity, "BLOCK", 4)
    frame = spark.createDataFrame([(i, ["x"]) for i in range(30)] + [(99, ["x", "y"])], "id long, tokens array<string>")
    got = [(r.a, r.b) for r in similarity.set_pairs(frame, 0.9, "cosine").collect()]
    assert sorted(got) == [(a, b) for a in range(30) for b in range(a + 1, 30)]


@pytest.mark.parametrize("cells", [1, 4_000_000])
def test_sets_meet_as_arrays_and_a_pair_is_found_once(spark, monkeypatch, cells):
    monkeypatch.setattr(similarity, "CELLS", cells)
    monkeypatch.setattr(similarity, "BLOCK", 7)
    rng = random.Random(4)
    sets = {i: rng.sample(range(14), rng.randint(6, 12)) for i in range(60)}
    frame = spark.createDataFrame([((i % 2 == 0, f"n{i:02}"), [f"t{x}" for x in s]) for i, s in sets.items()], "id struct<even boolean, name string>, tokens array<string>")
    found = similarity.set_pairs(frame, 0.8, "cosine")
    plan = found._jdf.queryExecution().toString()
    assert "array_intersect" not in plan and "MapInArrow" in plan
    value = lambda a, b: len({*sets[a]} & {*sets[b]}) / (len(sets[a]) * len(sets[b])) ** 0.5
    key = lambda i: (i % 2 == 0, f"n{i:02}")
    want = sorted((*sorted((key(a), key(b))), round(value(a, b), 9)) for a, b in itertools.combinations(sets, 2) if value(a, b) >= 0.8 - 1e-12)
    assert sorted((tuple(r.a), tuple(r.b), round(r.score, 9)) for r in found.collect()) == want and len(want) > 100


@pytest.mark.parametrize("sep", [r"\s+", "_"])
def test_similar_names_against_all_pairs(spark, sep):
    join = " " if sep != "_" else "_"
    rng = random.Random(8)
    words = ["works", "work", "at", "for", "lives", "live", "in", "likes", "liked", "by"]
    names = sorted({join.join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)} | {"Works" + join + "at"})
    least = 0.75

    def score(a, b):
        x, y = a.lower(), b.lower()
        if x == y:
            return 1.0
        if sep != "_" and (x in y or y in x) and min(len(x), len(y)) / max(len(x), len(y)) >= least:
            return min(len(x), len(y)) / max(len(x), len(y))
        ratio, j = difflib.SequenceMatcher(None, x, y).ratio(), len({*x.split(join)} & {*y.split(join)}) / len({*x.split(join)} | {*y.split(join)})
        return max((v for v in (ratio, (ratio + j) / 2 if j >= least else 0) if v >= least), default=None)

    want = {(a, b): round(s, 9) for a, b in itertools.permutations(names, 2) if (s := score(a, b)) is not None}
    got = similarity.similar(spark.createDataFrame([(n,) for n in [*names, names[0], None, ""]], "name string"), least, sep, contained=sep != "_")
    assert {(r.a, r.b): round(r.score, 9) for r in got.collect()} == want and want


@pytest.mark.parametrize(("least", "longest"), [(0.8, 60), (0.9, 60), (0.9, 9)])
def test_names_meet_by_segments_and_long_ones_by_letters(spark, monkeypatch, least, longest):
    """Edits anywhere, the frequent segments block by block; few pairs that are not alike are left to compare in Python."""
    monkeypatch.setattr(similarity, "BLOCK", 3)
    monkeypatch.setattr(similarity, "LONGEST", longest)
    rng = random.Random(int(100 * least) + longest)
    names = {"".join(rng.choice("abé ") for _ in range(rng.randint(1, 22))) for _ in range(25)}
    for name in sorted(names):
        for _ in range(6):
            chars = list(name)
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(chars) + 1)
                chars[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "B"])
            names.add("".join(chars))
    names = sorted(names - {""})

    def common(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            row = list(itertools.accumulate(range(len(y)), lambda left, j: max(left, row[j + 1], row[j] + (c == y[j])), initial=0))
        return row[-1]

    near = lambda x, y: 2 * common(x, y) >= least * (len(x) + len(y)) - 1e-9
    frame = spark.createDataFrame([(n, n.lower()) for n in names], "name string, low string")
    got = {(r.a, r.b) for r in similarity.segment_pairs(frame, least).collect()}
    want = {(a, b) for a, b in itertools.combinations(names, 2) if near(a.lower(), b.lower())}
    assert {p for p in want if max(map(len, p)) <= longest} <= got and len(got) < 4 * len(want) + 100
    ratio = lambda a, b: difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()
    found = {(r.a, r.b) for r in similarity.similar(frame.select("name"), least).collect()}
    assert {p for p in want if ratio(*p) >= least} | {p for p in want if p[0].lower() == p[1].lower()} <= found


def test_names_that_differ_by_more_letters_are_let_go_in_the_join_and_all_tasks_cut_them(spark, monkeypatch):
    held = []
    monkeypatch.setattr(similarity.graph, "settled", lambda frame, f=similarity.graph.settled: held.append(f(frame)) or held[-1])
    monkeypatch.setattr(similarity, "NAMES", 1)
    name = "abcdefghijklmnopqr"
    names = [name, name[:6] + "z" + name[7:], name[:6] + "z" + name[7:13] + "y" + name[14:]]
    got = {(r.a, r.b) for r in similarity.segment_pairs(spark.createDataFrame([(n, n) for n in names], "name string, low string"), 0.9).collect()}
    assert got == {(names[0], names[1]), tuple(sorted(names[1:]))}  # two letters changed are four edits, where two are allowed
    assert held[0].rdd.getNumPartitions() >= 8


def test_best_targets_follow_to_the_first(spark):
    pairs = [("c", "b", 0.9), ("c", "a", 0.9), ("b", "a", 0.8), ("d", "c", 0.95), ("d", "a", 0.7), ("e", "f", 1.0)]
    frame = spark.createDataFrame(pairs + [(b, a, s) for a, b, s in pairs], "a string, b string, score double")
    order = spark.createDataFrame([(n, i) for i, n in enumerate("abcdef")], "name string, seq long")
    assert dict(rows(similarity.best_targets(frame, order))) == {"b": "a", "c": "a", "d": "a", "f": "e"}


@pytest.mark.parametrize("nearest", [False, True])
def test_leaders_against_a_pass(spark, nearest):
    rng = random.Random(nearest)
    ids = [f"i{k}" for k in range(150)]
    place = {i: rng.randrange(60) for i in ids}
    pairs = {tuple(sorted(rng.sample(ids, 2))): round(rng.random(), 2) for _ in range(260)} | {(ids[k], ids[k + 1]): 0.5 for k in range(30)}
    like = {}
    for (a, b), s in pairs.items():
        like.setdefault(a, {})[b] = s
        like.setdefault(b, {})[a] = s
    heads, want = [], {}
    for i in sorted(ids, key=lambda x: (place[x], x)):
        near = [h for h in heads if h in like.get(i, {})]
        if near:
            want[i] = max(near, key=lambda h: (like[i][h], -heads.index(h))) if nearest else near[0]
        else:
            heads.append(i)
            want[i] = i
    frame = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a string, b string, score double")
    items = spark.createDataFrame(list(place.items()), "id string, place long")
    assert dict(rows(similarity.leaders(items, frame, nearest))) == want
    assert similarity.leaders(items.limit(0), frame).count() == 0
