import itertools
import random

import corpus_pipeline
from engramite.llm import near_copies


def _shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stage_drops_near_copies_with_changed_words(spark):
    rng = random.Random(7)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(150)) for _ in range(20)]
    for base in texts[:15]:
        for changed in (1, 2, 3, 6):
            w = base.split()
            for at in rng.sample(range(len(w)), changed):
                w[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    # one group larger than a bucket that is compared pair by pair
    texts += [f"{texts[15]} y{i}" for i in range(60)]
    sets = [_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert len(set(root)) < 40
    assert kept == set(root)


def test_every_two_components_of_a_large_bucket_are_compared(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(62) for _ in range(100)]
    sets = []
    for _ in range(12):  # families too far from each other, of which some members are near a neighbour's
        family = base[:70] + [rng.getrandbits(62) for _ in range(30)]
        sets += [sorted({*family[:k], *(rng.getrandbits(62) for _ in range(100 - k))}) for k in (100, 97, 92, 90, 88, 85)]
    sets.append([])
    keys = list(range(100, 100 + len(sets)))
    near = [(a, b) for (a, s), (b, t) in itertools.combinations(zip(keys, map(set, sets), strict=True), 2) if len(s & t) >= 0.8 * len(s | t)]
    root = {k: k for k in keys}
    for a, b in near[::3]:  # what an earlier comparison found
        a, b = sorted((root[a], root[b]))
        root = {k: a if r == b else r for k, r in root.items()}
    large = spark.createDataFrame([(0, 5, k, root[k]) for k in keys], "band int, value long, key long, root long")
    held = spark.createDataFrame(list(zip(keys, sets, strict=True)), "key long, shingles array<long>")
    for block in (7, 256):
        found = near_copies.links_across(large, held, block).collect()
        assert {(min(r), max(r)) for r in found} <= set(near)
        joined, wanted = dict(root), dict(root)
        for of, links in ((joined, found), (wanted, near)):
            for u, v in links:
                a, b = sorted((of[u], of[v]))
                of.update({k: a for k, r in of.items() if r == b})
        assert joined == wanted
        assert len(set(wanted.values())) < len(set(root.values()))


def test_a_settled_bucket_asks_nothing(spark):
    large = spark.createDataFrame([(0, 5, k, 1) for k in range(1, 40)], "band int, value long, key long, root long")
    held = spark.createDataFrame([(k, [k]) for k in range(1, 40)], "key long, shingles array<long>")
    assert near_copies.links_across(large, held).count() == 0
    assert near_copies.links_across(large.limit(0), held).count() == 0
