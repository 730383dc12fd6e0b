"""The inverted-file index, versioned tables and streams with keyed state."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramite.operators import style, vector
from engramite.operators.vector_index import VectorIndex
from engramite.operators.versions import ConflictError, Versions
from engramite.plans import registry
from engramite.streaming import states, windows

SF = "/root/testdata/sf0.001"


# versions


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, name string")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_versions_read_restore_and_wipe(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/v")
    assert store.numbers() == [] and store.tables() == []
    with store.change("first") as c:
        c.replace("a", frame(spark, [(1, "x")]))
        c.append("b", frame(spark, [(7, "y")]))
    held = store.read("a")
    with store.change() as c:
        c.append("a", frame(spark, [(2, None)]))
    with store.change() as c:
        c.replace("a", frame(spark, [(3, "z")]))
    assert [rows_of(store.read("a", v)) for v in (0, 1, 2)] == [[(1, "x")], [(1, "x"), (2, None)], [(3, "z")]]
    assert rows_of(held) == [(1, "x")]
    store.restore(1)
    assert len(rows_of(store.read("a"))) == 2 and store.manifest()["note"] == "as version 1"
    store.wipe()
    assert rows_of(store.read("a")) == rows_of(store.read("b")) == [] and store.read("a").columns == ["id", "name"]
    assert rows_of(store.read("b", 3)) == [(7, "y")]
    with pytest.raises(ValueError):
        store.read("c")
    with pytest.raises(ValueError), store.change() as c:
        c.append("a", spark.range(1))
    assert store.vacuum(keep=2) == 1 and store.numbers() == [3, 4] and rows_of(store.read("b", 3)) == [(7, "y")]


def test_a_change_that_dies_half_way_leaves_the_version_before(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/v")
    with store.change() as c:
        c.replace("a", frame(spark, [(1, "x")]))
    boom = frame(spark, [(1, "x"), (2, "y")]).select(F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"), "name")
    for fail in (lambda c: c.replace("b", boom), lambda c: 1 / 0):
        with pytest.raises(Exception, match="lost|zero"), store.change() as c:
            c.replace("a", frame(spark, [(9, "new")]))
            fail(c)
        assert store.numbers() == [0] and rows_of(store.read("a")) == [(1, "x")] and store.tables() == ["a"]
    assert len(list((tmp_path / "v" / "data").glob("*/written_as=*"))) == 1


def test_two_changes_at_once_conflict(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/v")
    with pytest.raises(ConflictError), store.change() as c:
        c.replace("a", frame(spark, [(1, "late")]))
        with Versions(spark, store.root).change() as other:
            other.replace("a", frame(spark, [(2, "early")]))
    assert rows_of(store.read("a")) == [(2, "early")]


# exact search in blocks


def brute(x, ids, q, qids, k, metric):
    out = {}
    for qid, v in zip(qids, q, strict=True):
        score = {"cosine": lambda r: float(r @ v) / (np.linalg.norm(r) * np.linalg.norm(v)), "ip": lambda r: float(r @ v), "l2": lambda r: float(((r - v) ** 2).sum())}[metric]
        best = sorted(((score(r), i) for r, i in zip(x, ids, strict=True) if i != qid), key=lambda s: (round(s[0], 9) * (1 if metric == "l2" else -1), s[1]))[:k]
        out |= {(qid, n + 1): i for n, (_, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_top_k_against_all_pairs(spark, metric, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6)).astype(np.float32).astype(float)
    x[40:60] = x[:20]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    q = v.where("vec_id % 7 = 0").selectExpr("vec_id as qid", "embedding as query")
    got = {(r.qid, r["rank"]): r.vec_id for r in vector.top_k(v.repartition(5), q, 4, metric).collect()}
    assert got == brute(x, range(150), x[::7], range(0, 150, 7), 4, metric)


def test_top_k_of_odd_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [0.0, 0.0]), (None, [1.0, 0.0]), (6, [2.0, 2.0])], "vec_id long, embedding array<float>")
    q = v.where("vec_id = 1").selectExpr("vec_id as qid", "embedding as query")
    assert [(r.vec_id, round(r.score, 6)) for r in vector.top_k(v, q, 9).orderBy("rank").collect()] == [(6, 0.707107), (2, 0.0), (3, 0.0), (4, 0.0), (5, 0.0)]
    assert [r.vec_id for r in vector.top_k(v, q, 9, "ip").orderBy("rank").collect()] == [6, 5]
    assert vector.top_k(v, q.limit(0), 3).count() == vector.top_k(v.limit(0), q, 3).count() == 0


# the inverted file


def clustered(spark, n=1200, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(12, 16))
    x = np.repeat(c, n // 12, axis=0) + rng.normal(size=(n, 16)) * 0.6
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def asked(v, step=20):
    return v.where(f"vec_id % {step} = 0").selectExpr("vec_id as qid", "embedding as query")


def pairs(df):
    return {(r.qid, r.vec_id) for r in df.collect()}


def test_inverted_file_recall_and_pruning(spark, tmp_path):
    v = clustered(spark)
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    index.build(v, lists=24, sample=800)
    q, exact = asked(v), pairs(vector.top_k(v, asked(v), 10))
    found = index.search(q, 10, probes=6)
    assert len(exact & pairs(found)) / len(exact) >= 0.9
    assert pairs(index.search(q, 10, probes=24)) == exact
    one = index.search(q.where("qid = 0"), 10, probes=2)
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert one.count() == 10
    assert index.probes_for(q, 10, recall=0.95) <= 24
    assert index.search(q.limit(0), 5).count() == 0


def test_inverted_file_of_the_table(spark):
    exact, found = pairs(registry.vector_topk_cosine(spark, SF)), pairs(registry.QUERIES["vector_topk_ivf"](spark, SF))
    assert len(exact & found) / len(exact) >= 0.9


def test_inverted_file_adds_deletes_and_compacts(spark, tmp_path):
    v = clustered(spark, 240)
    index = VectorIndex(spark, f"file://{tmp_path}/i")
    index.build(v.where("vec_id < 120"), lists=8)
    index.add(v.where("vec_id >= 120"))
    everything = lambda: pairs(index.search(asked(v), 5, probes=8))
    assert everything() == pairs(vector.top_k(v, asked(v), 5))
    index.delete(v.where("vec_id % 3 = 1").select("vec_id"))
    left = v.where("vec_id % 3 <> 1")
    assert everything() == pairs(vector.top_k(left, asked(v), 5)) and index.rows().count() == left.count()
    moved = v.where("vec_id in (0, 1)").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    index.add(moved)  # one replaces, one comes back
    now = left.where("vec_id <> 0").union(moved)
    assert everything() == pairs(vector.top_k(now, asked(v), 5))
    before = index.store.numbers()[-1]
    index.compact()
    assert everything() == pairs(vector.top_k(now, asked(v), 5)) and index.store.read("dead").count() == 0
    assert index.rows(before).count() == now.count()
    index.rebuild(lists=5)
    assert len(index.centroids()) == 5 and everything() == pairs(vector.top_k(now, asked(v), 5))
    index.wipe()
    assert everything() == set() and len(index.centroids()) == 5
    odd = spark.createDataFrame([(1, None), (2, [0.0] * 16), (None, [1.0] * 16), (3, [1.0]), (4, [1.0] * 16)], "vec_id long, embedding array<float>")
    index.add(odd)
    assert [r.vec_id for r in index.rows().collect()] == [4]


# streams


def batches(tmp_path, spark, rows, schema, n, seed):
    """``rows`` in random order as n files, and the folder they go to one after the other."""
    rng = random.Random(seed)
    rows = list(rows)
    rng.shuffle(rows)
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    parts = [rows[i::n] for i in range(n)]

    def put(i):
        spark.createDataFrame(parts[i], schema).coalesce(1).write.parquet(f"file://{tmp_path}/part{i}")
        (file,) = (tmp_path / f"part{i}").glob("part-*.parquet")
        file.rename(folder / f"b{i}.parquet")

    return put, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


WORDS = "conv_id long, turn long, word string"


def said_words(seed=4):
    rng = random.Random(seed)
    return [(c, t, w) for c in range(3) for t in range(9) for w in rng.choices(["so", "soo", "sooo", "good", "goood", "hm"], k=5)]


def test_session_scores_equal_the_batch_form_after_a_restart(spark, tmp_path):
    rows = said_words()
    put, stream = batches(tmp_path, spark, rows, WORDS, 5, 1)
    plan, folder = states.session_scores(stream), f"file://{tmp_path}/run"
    put(0), put(1)
    assert windows.drain(plan, folder)
    put(2), put(3), put(4)
    assert windows.drain(states.session_scores(stream), folder)  # a new query on what the other left
    got = {(r.conv_id, r.word): r.score for r in states.as_of_last_turn(windows.said(plan, folder, ["conv_id", "word"])).collect()}
    counts = spark.createDataFrame(rows, WORDS).groupBy("conv_id", "turn", "word").agg(F.count("*").alias("n"))
    want = {(r.conv_id, r.word): r.score for r in style.session_ema(counts).collect()}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


def test_pattern_memory_equals_the_batch_form_after_a_restart(spark, tmp_path):
    rows = said_words(5)
    put, stream = batches(tmp_path, spark, rows, WORDS, 4, 2)
    plan, folder = states.patterns(stream), f"file://{tmp_path}/run"
    put(0)
    windows.drain(plan, folder)
    put(1), put(2), put(3)
    windows.drain(states.patterns(stream), folder)
    got = {tuple(r) for r in windows.said(plan, folder, ["form"]).select("form", "canonical", "variants", "total").collect()}
    n = Counter(w for _, _, w in rows)
    assert got == {("so", "so", 3, n["so"] + n["soo"] + n["sooo"]), ("god", "good", 2, n["good"] + n["goood"]), ("hm", "hm", 1, n["hm"])}


def test_last_messages_equal_the_batch_form_after_a_restart(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 else "assistant") for c in range(4) for t in range(c * 3 + 1)]
    put, stream = batches(tmp_path, spark, rows, "conv_id long, turn long, role string", 3, 3)
    plan, folder = states.last_messages(stream, 4), f"file://{tmp_path}/run"
    put(0)
    windows.drain(plan, folder)
    put(1), put(2)
    windows.drain(states.last_messages(stream, 4), folder)
    got = {(r.conv_id, r.back, r.turn, r.role) for r in windows.said(plan, folder, ["conv_id", "back"]).collect()}
    assert got == {(c, k + 1, t, "user" if t % 2 else "assistant") for c in range(4) for k, t in enumerate(reversed(range(c * 3 + 1))) if k < 4}


def test_idle_scores_are_closed_by_event_time(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = f"{WORDS}, ts timestamp"
    folder_in = tmp_path / "in"
    folder_in.mkdir()
    for i, rows in enumerate([[(1, 1, "a", at(0)), (1, 2, "a", at(5))], [(2, 1, "b", at(200))], [(2, 2, "b", at(210)), (1, 3, "a", at(205))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/part{i}")
        (file,) = (tmp_path / f"part{i}").glob("part-*.parquet")
        file.rename(folder_in / f"b{i}.parquet")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder_in}").withWatermark("ts", "1 minute")
        windows.drain(states.session_scores(stream, idle_ms=30 * 60_000), f"file://{tmp_path}/run")
    rows = spark.read.parquet(f"file://{tmp_path}/run/rows").where("conv_id = 1").collect()
    closed = [r for r in rows if r.closed]
    assert len(closed) == 1 and closed[0].last == 2 and math.isclose(closed[0].value, 0.1 * 0.9 + 0.1)
    again = [r for r in rows if not r.closed and r.last == 3]
    assert len(again) == 1 and math.isclose(again[0].value, 0.1)  # it begins anew
