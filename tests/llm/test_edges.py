"""Registered queries against their SQL, and the awkward cases of single operators."""

import glob
import math
import random
from collections import Counter

import pytest
import xxhash

from engramite.llm import common, decontaminate, language_id, pii, queries, simhash, toxicity, warc
from tests.llm.fixtures import documents
from tests.oracle import compared, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_registered_query_against_sql(spark, name):
    got, want = compared(queries.QUERIES[name](spark, SF), connect(SF), queries.SQL[name])
    assert got and got == want


def test_registered_simhash_against_all_pairs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {i: i for i in fps}
    for i in sorted(fps):
        for j in sorted(fps):
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF).collect()}
    assert got == {(i, f"{fps[i]:016x}", root[i]) for i in fps}


def test_cut_off_archives_are_errors(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 3000), (2, "v", "b" * 2000)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write(warc.records(pages), f"file://{tmp_path}/w")
    assert warc.read(manifest).where("last").count() == 2
    (path,) = glob.glob(f"{tmp_path}/w/*.gz")
    whole = open(path, "rb").read()
    second = whole.index(b"\x1f\x8b\x08", 10)
    for cut in (0, 5, 20, second // 2, second, second + 3, len(whole) - 1):
        open(path, "wb").write(whole[:cut])
        with pytest.raises(Exception, match="cut off|ends inside|no end of record|NoneType|Error"):
            warc.read(manifest).collect()


def test_terms_keep_their_length_in_lower_case(spark):
    rows = [(i, f"İzzetpaşa mail a{i % 2}@x.org") for i in range(4)] + [(i, f"other words {i}") for i in range(4, 200)]
    found = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    assert "term:0:9" in found[0].spans and "İzzetpaşa" not in found[0].sanitised
    assert pii._together("near a@b.cc far\nbelow", pii.base_spans("near a@b.cc far\nbelow")).popitem()[1] == {"near", "far"}


def test_training_takes_int_ids(spark):
    docs = spark.createDataFrame([(i, "vile slur" if i % 2 else "kind word") for i in range(60)], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id int, toxic int")
    assert toxicity.train(docs, labels)["bits"] == toxicity.BITS


def test_ftrl_against_a_plain_loop():
    rng = random.Random(5)
    examples = [(sorted(rng.sample(range(64), 6)), i % 2) for i in range(40)]
    z, n, zb, nb, b = [0.0] * 64, [0.0] * 64, 0.0, 0.0, 0.0
    alpha, beta, l1, l2 = 1.0, 1.0, 0.3, 0.1

    def weight(zi, ni):
        return 0.0 if abs(zi) <= l1 else (math.copysign(l1, zi) - zi) / ((beta + math.sqrt(ni)) / alpha + l2)

    for _ in range(5):
        for slots, y in examples:
            w = {i: weight(z[i], n[i]) for i in slots}
            b = -zb / ((beta + math.sqrt(nb)) / alpha + l2)
            g = 1 / (1 + math.exp(-(b + sum(w.values())))) - y
            for i in slots:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
    import numpy as np

    at, w, bias = toxicity.fit([(np.array(s, np.int32), y) for s, y in examples], bits=6, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=5)
    want = {i: weight(z[i], n[i]) for i in range(64) if weight(z[i], n[i])}
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(want) and bias == pytest.approx(b)


def test_out_of_place_distances_against_a_plain_loop():
    def plain(text):
        n = Counter()
        for w in [f" {' '.join(language_id.LETTERS.findall(text.lower()))} "]:
            for k in (1, 2, 3):
                n.update(w[i : i + k] for i in range(len(w) - k + 1) if w[i : i + k] != " ")
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return [code(g) for g, _ in sorted(n.items(), key=lambda x: (-x[1], code(x[0])))]

    ranks = 12
    profile = {"aa": plain("the cat sat on the mat")[:ranks], "bb": plain("der hund und die katze")[:ranks]}
    scorer = language_id.Scorer([(lang, g, r) for lang, gs in profile.items() for r, g in enumerate(gs)], ranks)
    for text in ("the hat", "und der", "a cat und", "xyz", "tie tie"):
        top = plain(text)[:ranks]
        far = {lang: sum(abs(gs.index(g) - r) if g in gs else ranks for r, g in enumerate(top)) for lang, gs in profile.items()}
        best = min(far, key=lambda x: (far[x], x))
        assert scorer(text) == (best, pytest.approx(1 - far[best] / (ranks * len(top))))


def test_least_hashed_keeps_the_least_of_each_label(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(500)], "doc_id long, label string")
    got = {tuple(r) for r in common.least_hashed(rows, "label", 20).collect()}
    every = sorted((r.label, r.h, r.doc_id) for r in rows.selectExpr("label", "doc_id", "xxhash64(doc_id) h").collect())
    want = {(i, y) for y in "ab" for _, _, i in [x for x in every if x[0] == y][:20]}
    assert got == want and common.least_hashed(rows.where("false"), "label", 3).count() == 0


def test_clashing_columns_and_repeats(spark):
    rows = [(1, "a b c d e f g h i j k", 1, "x", 7), (1, "a b c d e f g h i j k", 1, "y", 7), (2, "other text here", 1, "x", 7), (None, None, 1, "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _stay long, _id string, _key long")
    items = spark.createDataFrame([(5, "A b c d e f g h i j")], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {2, None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == {1: 1, 2: 1, None: 1}


def test_a_repeated_id_takes_one_place_in_the_sample(spark):
    rows = [(7, "zzz qqq", "xx")] * 1000 + [(i, f"ab cd w{chr(97 + i % 26)}", "xx") for i in range(100, 599)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    grams = {r.gram for r in language_id.profiles(docs, per_language=400).collect()}
    assert {ord(c) for c in "abcd"} <= grams and len(grams) > 60
    few = spark.createDataFrame(rows[:1000] + rows[1000:1003], "doc_id long, text string, lang string")
    ranks = {r.gram: r["rank"] for r in language_id.profiles(few, per_language=400).collect()}
    assert ranks[ord("a")] < ranks[ord("z")] < ranks[ord("d")] or ranks[ord("a")] < ranks[ord("q")]  # copies count once


def test_null_ids_are_held_in_by_rule(spark, tmp_path):
    documents(spark, [(i, f"some plain words {i}") for i in range(30)] + [(None, "some plain words")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op6_toxicity", "op9_language_id"):
        assert {r.held_out for r in queries.QUERIES[name](spark, str(tmp_path)).collect()} <= {True, False}


def test_clashing_columns_of_line_dedup(spark):
    from engramite.llm import line_dedup

    rows = [(i, "a line that is repeated everywhere\nown", 1, 2) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _keep_bits long, keep long")
    left = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == ["a line that is repeated everywhere\nown", "own", "own", "own"]


def test_reply_trees_with_null_conversations_and_repeated_nodes(spark):
    from engramite.llm import chat

    rows = [(None, 1, None, 1.0, "user", "a", 5), (None, 2, 1, 1.0, "assistant", "b", 5), (3, 1, None, 1.0, "user", "x", 5), (3, 2, 1, 1.0, "assistant", "y", 5), (3, 2, 1, 1.0, "assistant", "z", 5), (3, 2, 1, 1.0, "assistant", "y", 5), (4, None, 1, 1.0, "user", "lost", 5)]
    messages = spark.createDataFrame(rows, "conv long, node long, parent long, score double, role string, text string, rank int")
    got = {r.conv: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_paths(messages)).collect()}
    assert got == {None: (2, 1), 3: (2, 1)}
    pieces = {r.piece for r in chat.format_paths(messages).where("conv = 3").collect()}
    assert any("\ny<" in p for p in pieces) and not any("\nz<" in p for p in pieces)


def test_long_turns_pass_in_small_batches(spark):
    from engramite.llm import chat

    frame = spark.createDataFrame([(1, i, "assistant", "w" * 1_500_000) for i in range(4)], "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_paths(chat.linear(frame), unique=True)).collect()
    assert [(r.n_turns, r.loss_chars) for r in got] == [(4, 6_000_000)]


def test_training_sample_is_bounded_in_slots(spark):
    docs = spark.createDataFrame([(i, f"{'vile' if i % 2 else 'kind'} words number{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    whole, some = toxicity.train(docs, labels), toxicity.train(docs, labels, most_slots=100)
    assert len(some["at"]) and abs(some["w"]).max() < abs(whole["w"]).max()
    assert len(toxicity.train(docs, labels, most_slots=1)["at"]) == 0
    order = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert (order["at"] == whole["at"]).all() and (order["w"] == whole["w"]).all()
