import itertools

import corpus_pipeline
from engramite.llm import decontaminate, simhash
from engramite.llm.language_id import grams

SF = "/root/testdata/sf0.001"


def _least_of_groups(rows):
    """Every pair compared, by fingerprint and by 5-word shingles."""

    def shingles(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    each = sorted((r.doc_id, simhash.fingerprint(r.text), shingles(r.text)) for r in rows)
    root = {i: i for i, _, _ in each}
    for (i, f, s), (j, g, t) in itertools.combinations(each, 2):
        if (f ^ g).bit_count() <= 2 or s == t or len(s & t) >= 0.8 * len(s | t):
            a, b = sorted((root[i], root[j]))
            root = {k: a if r == b else r for k, r in root.items()}
    return set(root.values())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {"documents": docs.count()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        seen[name] = docs.count()
        if name != "sentencepiece":
            assert docs.columns == before.columns
        if name == "language_id":
            assert seen[name] == sum(bool(len(grams(r.text)[0])) for r in before.collect())
        if name == "simhash_near_dedup":
            assert {r.doc_id for r in docs.collect()} == _least_of_groups(before.collect())
        if name == "benchmark_decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert not decontaminate.contamination(docs, bench).where("contaminated").count()
            assert seen[name] == decontaminate.contamination(before, bench).where("not contaminated").count()
    assert {r.round_trip for r in docs.collect()} == {True}
    assert corpus_pipeline.run(spark, SF).count() == seen["sentencepiece"]
