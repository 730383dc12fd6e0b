import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from engramite.llm import decontaminate, language_id, line_dedup, queries, simhash
from tests.llm.fixtures import AWKWARD, documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contaminated(docs, items, span=10):
    windows = defaultdict(set)
    for item, text in items:
        w = WORD.findall(low(text))
        for i in range(max(1, len(w) - span + 1)) if w else []:
            windows[tuple(w[i : i + span])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        names = ",".join(sorted(str(x) for x in found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("bound", [10**9, -1])
def test_decontamination(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    items = [(1, "a b c d e f g h i j k l"), (2, "be be be be be be be be be be be"), (3, "Be"), (4, ""), (5, None), (6, "e f g h"), (7, "nothing of this occurs anywhere in them"), (8, "C D e f g h i j K l m"), (3, "be")]
    own = [*AWKWARD, (11, "x a b c d e f g h i j y " * 3), (12, "word word " * 5)]
    got = decontaminate.contamination(documents(spark, own), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == sorted(contaminated(own, [x for x in items if x[0] is not None]), key=repr)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    every = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = contaminated(every, bench)
    assert any(x[5] for x in want)
    assert rows(queries.op2_decontamination(spark, SF) if bound > 0 else decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))) == sorted(want, key=repr)
    none = decontaminate.contamination(documents(spark, []), spark.createDataFrame(items, "item_id long, text string"))
    assert none.count() == 0
    empty = decontaminate.contamination(documents(spark, own), spark.createDataFrame([], "item_id long, text string"))
    assert {r.n_hit for r in empty.collect()} == {0}
    assert decontaminate.drop_contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == sum(not x[5] for x in want)


# --- line deduplication


def deduplicated(docs, least=20, times=3):
    key = lambda x: low(x.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= least:
                holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key(x)) < least or len(holders[key(x)]) < times or max(holders[key(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_line_dedup(spark, docs):
    line = "  This very line is found all over the place "
    own = [*AWKWARD, *((20 + i, f"{line}\nown {i}\n{line.upper()}\nshared by only a few documents {i // 2}") for i in range(300)), (20, f"{line}\nanother text of an id")]
    got = line_dedup.digests(documents(spark, own), line_dedup.keep_bitmaps(documents(spark, own)))
    assert rows(got) == sorted(deduplicated(own), key=repr)
    every = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows(queries.op8_line_dedup(spark, SF)) == sorted(deduplicated(every), key=repr)
    dropped = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    assert dropped.schema == docs.schema
    assert sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in dropped.collect()) == sorted((x[0], x[3]) for x in deduplicated(every))
    assert line_dedup.keep_bitmaps(documents(spark, [])).count() == 0


# --- SimHash


def fingerprint(text):
    w = [x for x in re.split("[ \t\n\v\f\r]+", low(text)) if x]
    spans = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    every = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(10**6 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    prints = {i: fingerprint(t) for i, t in every}
    linked = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = components(prints, linked)
    got = simhash.groups(documents(spark, every))
    assert {r.doc_id: (r.fp % 2**64, r.component_id) for r in got.collect()} == {i: (prints[i], want[i]) for i in prints}
    assert len(set(want.values())) < len(want)
    kept = simhash.keep_one(documents(spark, [*every, every[0], (None, "alone")]))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want.values()))
    assert kept.count() == len(set(want.values())) + 1
    assert simhash.groups(documents(spark, [])).count() == 0


def test_close_pairs_of_many_fingerprints(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(1500)]
    fps = sorted({b for b in base} | {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base[:400]} | {base[0] ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    forest = simhash.link_forest(spark.createDataFrame([(x,) for x in signed], "fp long"), shard_rows=20)
    got = components(signed, [tuple(r) for r in forest.collect()])
    bits = {s: f for s, f in zip(signed, fps, strict=True)}
    want = components(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if (bits[a] ^ bits[b]).bit_count() <= 2])
    assert Counter(Counter(got.values()).values()) == Counter(Counter(want.values()).values())
    assert all((got[a] == got[b]) == (want[a] == want[b]) for a, b in zip(signed, signed[1:], strict=False))


# --- language identification


def test_language_id(spark, docs):
    found = queries.op9_language_id(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and any(c.isalpha() for c in r.text)]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.85
    profile = language_id.profiles(docs)
    odd = {r.doc_id: r for r in language_id.identify(documents(spark, AWKWARD), profile).collect()}
    assert {i for i, r in odd.items() if r.lang_pred == "und"} == {1, 2, 3, 7}
    assert language_id.keep_identified(documents(spark, AWKWARD), profile).count() == len(AWKWARD) - 4
    assert language_id.identify(documents(spark, []), profile).count() == 0
    nothing = language_id.identify(documents(spark, AWKWARD), profile.limit(0))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_grams_against_counting():
    text = "Der Straße-Lärm, 12 mal x_y"
    words = " " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    want = Counter(words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1))
    want.pop(" ")
    keys, n = language_id.grams(text)
    pack = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == {pack(g): k for g, k in want.items()}
