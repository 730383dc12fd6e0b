"""What plans must not do at size: broadcast what only looks small, derive what isn't asked for, pair what can't win."""

from __future__ import annotations

from engramite.operators import graph


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reasoning_chains_broadcast_only_the_few_first_edges(spark, tmp_path):
    rows = [(f"C{i}", "ORDERED_FROM", f"S{i % 7}", 1.0, None) for i in range(50)]
    spark.createDataFrame(rows, "source string, relationship string, destination string, weight double, updated_at timestamp").write.parquet(f"{tmp_path}/e")
    edges = spark.read.parquet(f"{tmp_path}/e")  # a small file, whatever it holds
    numbered = edges.selectExpr("concat_ws('|', source, relationship, destination) AS eid", "source", "destination")
    assert plan_of(graph._first_pairs(numbered, numbered, "destination", "destination", "source", 5)).count("BroadcastExchange") == 1
    assert graph.reasoning_chains(edges, 5).count() == 5


def test_edges_of_some_relationships_do_not_read_line_items(spark, tmp_path):
    import os

    from engramite.plans import memory_queries, registry
    from engramite.sources import star

    sf = "/root/testdata/sf0.001"
    for name in ("region", "nation", "customer", "supplier"):
        os.symlink(f"{sf}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    some = star._edges(spark, str(tmp_path), "IN_NATION")
    assert some.count() == spark.read.parquet(f"{sf}/customer.parquet").count() + spark.read.parquet(f"{sf}/supplier.parquet").count()
    whole = star.catalog(spark, sf).edges
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, star.derived(spark, sf).edges.collect()))
    for query in (memory_queries.edge_lookup, registry.dsl_directed_reverse):
        assert "ORDERED_FROM" not in "".join(query(spark, sf).inputFiles()) and "SUPPLIES" not in "".join(query(spark, sf).inputFiles())
    for query in (memory_queries.edge_lines, memory_queries.distinct_collections):  # read once, so not written first
        assert "lineitem.parquet" in "".join(query(spark, sf).inputFiles())


def test_lsh_meets_pairs_in_their_tasks(spark):
    import numpy as np

    from engramite.operators import retrieval
    from engramite.plans import memory_queries

    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, [1.0])], "vec_id long, embedding array<double>")
    found = retrieval.lsh_top_k(v, v.where("vec_id < 5").selectExpr("vec_id AS qid", "embedding AS query"), 60, bits=3, tables=2)
    assert "Join" not in plan_of(found) and "Generate" not in plan_of(found)
    planes = np.random.default_rng(42).standard_normal((8, 6))
    side = ((x @ planes) > 0).reshape(60, 2, 3)
    want = {(q, i) for q in range(5) for i in range(60) if i != q and (side[q] == side[i]).all(axis=1).any()}
    assert {(r.qid, r.vec_id) for r in found.collect()} == want


def test_search_lets_go_of_pairs_that_cannot_be_among_the_best(spark, monkeypatch):
    from pyspark.sql import functions as F

    from engramite.operators import search

    texts = spark.range(400).selectExpr("id AS memory_id", "concat('said ', id % 7, ' of Hub and ', CASE WHEN id % 40 = 0 THEN 'Rare Kin' ELSE concat('Other', id % 11) END, ' w', id) AS text")
    index = texts.selectExpr("memory_id", "explode(array_distinct(transform(regexp_extract_all(text, '[A-Z][a-z0-9]+', 0), x -> upper(x)))) AS entity")
    said = index.where("entity <> 'HUB'").selectExpr("memory_id", "'HUB' AS source", "'SAID' AS relationship", "entity AS destination")
    edges = said.groupBy("source", "relationship", "destination").agg(F.count("*").cast("double").alias("weight"), F.lit(None).cast("timestamp").alias("updated_at"))
    memory = search.Memory(texts, index, said, edges)
    asked = spark.createDataFrame([(1, "what of Hub and Rare Kin"), (2, "Other3 w3"), (3, "nothing"), (4, None)], "qid long, text string")
    pairs, real = [], search.promising
    monkeypatch.setattr(search, "FIRST_LOOK", 100)
    monkeypatch.setattr(search, "promising", lambda *a: pairs.append(real(*a).cache().count()) or real(*a))
    find = lambda: search.hybrid_search(asked, memory, F.lit("2024-01-01").cast("timestamp"), 5, first=3, hops=2, exclude=spark.createDataFrame([(1, 40)], "qid long, memory_id long")).collect()
    got = sorted(find())
    monkeypatch.setattr(search, "promising", lambda nodes, hits, names, memory, *rest: pairs.append(search.linked(nodes, memory.index).count()) or search.linked(nodes, memory.index))
    assert got == sorted(find()) and len(got) >= 10
    assert pairs[0] * 3 < pairs[1] * 2


def _hub(spark):
    from pyspark.sql import functions as F

    from engramite.operators import search

    texts = spark.range(300).selectExpr("id AS memory_id", "concat('said ', id % 7, ' of Hub and Other', id % 11, ' w', id % 50) AS text")
    index = texts.selectExpr("memory_id", "explode(array_distinct(transform(regexp_extract_all(text, '[A-Z][a-z0-9]+', 0), x -> upper(x)))) AS entity")
    said = index.where("entity <> 'HUB'").selectExpr("memory_id", "'HUB' AS source", "'SAID' AS relationship", "entity AS destination")
    edges = said.groupBy("source", "relationship", "destination").agg(F.count("*").cast("double").alias("weight"), F.lit(None).cast("timestamp").alias("updated_at"))
    asked = spark.createDataFrame([(1, "what of Hub and w3"), (2, "Other3 w3 said 5"), (3, "Hub said"), (4, None)], "qid long, text string")
    return search.Memory(texts, index, said, edges), asked, F.lit("2024-01-01").cast("timestamp")


def test_no_more_pairs_of_a_hub_leave_a_task_than_can_be_found(spark, monkeypatch):
    from engramite.operators import search, vector

    memory, asked, at = _hub(spark)
    led, real = [], search.promising
    monkeypatch.setattr(search, "FIRST_LOOK", 64)
    monkeypatch.setattr(search, "promising", lambda *a: led.append(real(*a)) or led[-1])
    exclude = spark.createDataFrame([(1, 3), (1, 14), (2, 3)], "qid long, memory_id long")
    find = lambda: sorted(search.hybrid_search(asked, memory, at, 4, first=6, hops=2, exclude=exclude).collect())
    want = find()
    assert max(r["count"] for r in led[0].groupBy("qid").count().collect()) == 6  # four, and two that are not to be found
    assert "Generate" not in plan_of(led[0]).split("MapInArrow")[0]
    monkeypatch.setattr(vector, "MAX_QUERIES", 2)  # the same in blocks of questions
    assert find() == want and len(want) == 12
    monkeypatch.setattr(search, "promising", lambda nodes, hits, names, memory, *rest: search.linked(nodes, memory.index))
    assert find() == want


def test_neighbours_are_weighed_once_for_all_questions(spark, monkeypatch):
    from engramite.operators import graph, search

    memory, _, at = _hub(spark)
    rows, real = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda frame: rows.append(real(frame)) or rows[-1])
    starts = spark.createDataFrame([(i, "HUB") for i in range(20)] + [(99, "OTHER3")], "qid long, id string")
    got = search.best_neighbours(memory.edges, starts, at, 5).collect()
    assert len(got) == 20 * 5 + 1 and rows[0].count() == 12


def test_texts_are_read_once_for_all_questions_and_not_once_a_pair(spark, monkeypatch):
    from engramite.operators import search, vector

    memory, asked, _ = _hub(spark)
    pairs = asked.select("qid").crossJoin(memory.texts.select("memory_id").where("memory_id < 40"))
    found = search.rescored(pairs, memory.texts, asked)
    assert "Generate" not in plan_of(found) and "embedding" not in plan_of(found)
    want = sorted(found.collect())
    monkeypatch.setattr(vector, "MAX_QUERIES", 2)
    assert len(want) == 160 and sorted(search.rescored(pairs, memory.texts, asked).collect()) == want


def test_words_of_a_conversation_share_one_state():
    import pandas as pd

    from engramite.streaming import states

    class State:
        kept, calls = None, 0

        def exists(self):
            return self.kept is not None

        def get(self):
            self.calls += 1
            return self.kept

        def update(self, value):
            self.calls += 1
            self.kept = value

    state = State()
    scores = states._PartScores(0.9)
    scores.init(type("Handle", (), {"getValueState": lambda self, *a: state})())
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["word", "turn"])])
    list(scores.handleInputRows((1, 0), frame(("a", 3), ("b", 0), ("a", 1)), None))
    (out,) = scores.handleInputRows((1, 0), frame(("a", 2), ("a", 5)), None)
    assert state.calls == 3  # whatever the number of words
    want = sum(0.1 * 0.9 ** (5 - t) for t in (1, 2, 3, 5))
    assert out["word"].tolist() == ["a"] and out["last"].tolist() == [5] and abs(out["value"][0] - want) < 1e-12
    assert state.kept[0] == ["b", "a"] or state.kept[0] == ["a", "b"]


def test_of_memories_that_only_differ_by_their_ids_the_first_are_linked(spark):
    from pyspark.sql import functions as F

    from engramite.operators import retrieval

    index = spark.range(400).selectExpr("id AS memory_id", "explode(array(concat('S', id % 3), concat('L', id % 2), CASE WHEN id % 7 = 0 THEN NULL ELSE 'L9' END)) AS entity")
    asked = index.where("memory_id % 50 = 0").selectExpr("memory_id AS qid", "entity")
    hits = spark.range(0, 400, 50).selectExpr("id AS qid", "explode(sequence(id + 101, id + 140, 3)) AS m").selectExpr("qid", "m % 400 AS memory_id", "0.9 - (m % 5) / 10D AS score")
    timed, degrees = index.where("memory_id % 4 = 0"), index.groupBy("entity").agg(F.count("*").alias("degree"))
    every = asked.where("entity like 'S%'").join(index, "entity").where("qid <> memory_id").select("qid", "memory_id").distinct()
    few = retrieval.linked(asked.where("entity like 'S%'"), index, timed, hits, 5)
    best = lambda x: sorted(map(tuple, retrieval.hybrid(retrieval.candidates(hits, x.withColumn("boost", F.lit(0.46))), asked, index, degrees, timed, 5).collect()))
    assert best(few) == best(every) and len(best(few)) == 40
    assert few.count() * 2 < every.count() and few.subtract(every).isEmpty()


def test_a_task_of_a_search_hands_on_the_best_of_all_its_rows(spark, monkeypatch):
    import numpy as np

    from engramite.operators import vector

    monkeypatch.setattr(vector, "ROWS", 16)
    x = np.round(np.random.default_rng(3).standard_normal((300, 4)), 1)
    x[40:60] = x[7]  # ties go to the lesser id
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(2)
    q = v.where("vec_id < 30").selectExpr("vec_id AS qid", "embedding AS query").cache()
    rows, real = [], vector.ranked
    monkeypatch.setattr(vector, "ranked", lambda found, *rest: rows.append(found.count()) or real(found, *rest))
    got = sorted((r.qid, r.rank, r.vec_id) for r in vector.top_k(v, q, 3, "ip").collect())
    want = [(i, k + 1, j) for i in range(30) for k, j in enumerate(sorted((j for j in range(300) if j != i), key=lambda j: (-round(float(x[i] @ x[j]), 12), j))[:3])]
    assert got == want and rows[0] <= 2 * 30 * 3  # tasks, queries, k


def test_all_edges_are_shuffled_once_for_steps_and_not_for_small_fronts(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "R", "b", 1.0, None), ("b", "Q", "a", 9.0, None), ("c", "S", "b", None, None), ("b", "S", "c", 4.0, None), ("d", "T", "c", 2.0, None), ("a", "R", "d", 8.0, None), ("d", "U", "d", 1.0, None)], "source string, relationship string, destination string, weight double, updated_at timestamp")
    paths = spark.createDataFrame([("d", ["a", "b", "c", "d"]), ("x", ["a", "x"]), ("a", ["a"]), ("b", ["c", "b", "a"])], "id string, path array<string>")
    found = graph.path_edges(paths, edges)
    want = [("b", 0, "c", "b", "S", 4.0), ("b", 1, "b", "a", "Q", 9.0), ("d", 0, "a", "b", "R", 1.0), ("d", 1, "b", "c", "S", 4.0), ("d", 2, "c", "d", "T", 2.0), ("x", 0, "a", "x", "CONNECTS", 1.0)]
    assert sorted(map(tuple, found.collect())) == want
    assert plan_of(found).split("Initial Plan")[-1].count("SortMergeJoin") <= 1
    sides, real = [], graph._met
    monkeypatch.setattr(graph, "_met", lambda front, n: sides.append(n) or real(front, n))
    few = sorted(map(tuple, graph.distances(edges, "a").collect()))
    monkeypatch.setattr(graph, "FRONT", 0)
    assert few == sorted(map(tuple, graph.distances(edges, "a").collect())) and sides[0] == 1
    assert "Broadcast" not in plan_of(edges.join(graph._met(paths, 1), edges.source == paths.id))
    assert {(r.id, r.degree) for r in graph.degrees(edges).collect()} == {("a", 2), ("b", 2), ("c", 2), ("d", 2)}


def test_messages_are_taken_apart_once_for_all_labels(spark):
    from engramite.operators import profile

    frame = spark.createDataFrame([(1, 1, "lowkey good haha"), (1, 2, None)], "conv_id long, turn long, text string")
    marked = profile.marked_phrases(frame, {"hedge": ["maybe"]}, "ness$", "z")
    assert plan_of(marked).split("Initial Plan")[-1].count("Scan ExistingRDD") <= 4  # the lexicon, what it meets, words, all others
    assert {(r.label, r.phrase, r.n) for r in marked.collect() if r.label in ("slang", "affective")} == {("slang", "lowkey", 1), ("affective", "haha", 1)}


def test_texts_are_taken_a_few_at_a_time(spark, monkeypatch):
    from engramite.operators import search

    frame = spark.range(50).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('some words of ', id % 9, ' words') END AS text").coalesce(1)
    whole = sorted(map(tuple, search.embedded(frame, "id").collect()))
    monkeypatch.setattr(search, "EMBEDDED_ROWS", 8)
    assert whole == sorted(map(tuple, search.embedded(frame, "id").collect())) and len(whole) == 50


def test_line_items_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    from engramite.plans import memory_queries
    from engramite.sources import star

    sf, parts = "/root/testdata/sf0.001", lambda df: df.rdd.getNumPartitions()
    whole = sorted(map(tuple, memory_queries.fan_out_capped(spark, sf).collect()))
    lines = star.table(spark, sf, "lineitem").count()
    monkeypatch.setattr(star, "LINES", 500)
    n = -(-lines // 500)
    assert star.tasks(star.table(spark, sf, "lineitem")) == n > 4
    assert parts(star.order_evidence(spark, sf)) == n and parts(star.named_orders(spark, sf)) == n  # not joined again
    plan = plan_of(memory_queries.fan_out_capped(spark, sf)).split("Initial Plan")[-1]
    # what a file holds doesn't decide whether orders or customers go to every task; each is shuffled once, and so are the few best edges
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 5
    assert whole == sorted(map(tuple, memory_queries.fan_out_capped(spark, sf).collect()))


def test_of_orders_only_those_of_like_suppliers_are_joined(spark):
    from engramite.plans import memory_queries

    plan = plan_of(memory_queries.dsl_similar(spark, "/root/testdata/sf0.001")).split("Initial Plan")[-1]
    assert plan.count("BroadcastExchange") == 1 and plan.count("SortMergeJoin") == 1  # the suppliers, at most 50; not all orders


def test_words_of_a_part_of_all_forms_share_one_state(monkeypatch):
    import pandas as pd
    import pyarrow as pa

    from engramite.streaming import states

    class State:
        kept, calls = None, 0

        def exists(self):
            return self.kept is not None

        def get(self):
            self.calls += 1
            return self.kept

        def update(self, value):
            self.calls += 1
            self.kept = value

    state, memory = State(), states._Patterns()
    memory.init(type("Handle", (), {"getValueState": lambda self, *a: state})())
    frame = lambda *rows: iter([pd.DataFrame([(0, *r) for r in rows], columns=["part", "form", "word", "n"])])
    list(memory.handleInputRows((0,), frame(("so", "sooo", 2), ("hm", "hm", 1), ("so", "soo", 1), ("so", "sooo", 1)), None))
    (out,) = memory.handleInputRows((0,), frame(("so", "sso", 4), ("so", "sooo", 1)), None)
    assert state.calls == 3  # whatever the number of words
    assert out.values.tolist() == [["so", "soo", 3, 9]]  # of equal length the first
    assert list(memory.handleInputRows((0,), frame(), None)) == [] and state.kept[2] == [4, 1, 4, 1]
    monkeypatch.setattr(states, "COUNTED", 2)
    said = [pa.RecordBatch.from_arrays([pa.array(w)], ["word"]) for w in (["a", "a"], ["b", "a"], ["a"], [])]
    assert [b.to_pydict() for b in states._counted(iter(said))] == [{"word": ["a", "b"], "n": [3, 1]}, {"word": ["a"], "n": [1]}]
