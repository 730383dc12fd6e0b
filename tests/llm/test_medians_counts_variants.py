"""Rolling medians, token counts and spelling variants against brute force, and their awkward cases."""

import datetime as dt
import math
import random
import zlib
from itertools import combinations

import pytest

from engramite.llm import common, queries, rolling_median, spelling_variants, token_counts
from tests.llm.fixtures import AWKWARD, documents
from tests.oracle import compared, connect

SF = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 3, 31, 1, 30)
CLICKS = "click_id long, ts timestamp_ntz, kind string, value double, chunk int, own string"


@pytest.mark.parametrize("name", ["op12_rolling_median", "op13_spelling_variants"])
def test_registered_query_against_sql_over_more_rows(spark, name):
    got, want = compared(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), queries.SQL[name])
    assert got and got == want


# rolling medians


def doubled(xs):
    return xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]


def by_hand(rows, minutes=60):
    once = {}
    for i, ts, kind, value in rows:
        cents = None if value is None or value != value or abs(value) == float("inf") else math.floor(100 * value + 0.5)
        key = (ts is None, ts or DAY, kind is not None, kind or "", cents is not None, cents or 0)
        if i not in once or key < once[i][0]:
            once[i] = (key, ts, kind, cents)
    kept = {i: r[1:] for i, r in once.items() if r[1] is not None}
    out = {}
    for i, (ts, kind, c) in kept.items():
        xs = sorted(v for t, k, v in kept.values() if k == kind and v is not None and ts - dt.timedelta(minutes=minutes) <= t <= ts)
        m = doubled(xs) if len(xs) > 1 else None
        mad = doubled(sorted(abs(2 * x - m) for x in xs)) if len(xs) > 1 else None
        out[i] = (kind, len(xs), m, mad, None if c is None or m is None else 2 * abs(2 * c - m) > 3 * mad)
    return out


def found(spark, rows, schema=CLICKS, minutes=60):
    df = spark.createDataFrame([(*r, 9, "x") for r in rows], schema)
    return {r.click_id: (r.kind, r.n, r.median2, r.mad4, r.far) for r in rolling_median.rolling_median(df, "click_id", "ts", "value", "kind", minutes).collect()}


def clicks(n, seed, span):
    rng = random.Random(seed)
    at = [DAY + dt.timedelta(microseconds=rng.randrange(span)) for _ in range(n // 2)]
    rows = [(i, rng.choice([*at, None] if i % 40 == 0 else at), rng.choice([None, "a", "a", "a", "b", ""]), rng.choice([None, float("nan"), float("inf"), -0.0, round(rng.gauss(5, 40), 2), 7.25, 1e6]) if i % 3 else round(rng.random(), 2)) for i in range(n)]
    return rows + rng.sample(rows, n // 10) + [(i, DAY, "b", 3.0) for i in rng.sample(range(n), n // 20)]


@pytest.mark.parametrize(("span", "chunks"), [(60 * 3_600_000_000, 4), (1_800_000_000, 16), (3 * 3_600_000_000, 40)])
def test_rolling_median_against_brute_force(spark, span, chunks):
    rows = clicks(400, chunks, span)
    with common.setting(spark, "spark.sql.shuffle.partitions", str(chunks)):
        assert found(spark, rows) == by_hand(rows)


def test_rolling_median_edges(spark):
    hour = dt.timedelta(minutes=60)
    tick = dt.timedelta(microseconds=1)
    rows = [(1, DAY, "a", 1.0), (2, DAY + hour, "a", 2.0), (3, DAY + hour + tick, "a", 3.0), (4, DAY + hour + tick, "a", None), (5, None, "a", 4.0), (None, DAY, "a", 5.0), (None, DAY, "a", 5.0)]
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, rows)[2][1] == 3 and found(spark, rows)[3][1] == 2 and found(spark, rows)[4] == ("a", 2, 500, 200, None)
    assert found(spark, []) == {}
    zoned = [(i, t, k, v) for i, t, k, v in rows if i]
    assert found(spark, zoned, CLICKS.replace("timestamp_ntz", "timestamp")) == by_hand(zoned)


def test_one_instant_and_one_value(spark):
    rows = [(i, DAY, "a", 4.5) for i in range(300)] + [(i, DAY, "a", float(i)) for i in range(300, 305)]
    assert found(spark, rows) == by_hand(rows)


def test_chunks_are_even_and_hold_a_share_of_their_halo():
    rng = random.Random(1)
    keys = [("a", rng.randrange(10**12)) for _ in range(4000)] + [(None, 5)] * 500 + [("b", t) for t in range(2000)]
    points = rolling_median.cut_points(keys, 40, 10**9)
    assert points == sorted(set(points), key=lambda k: (k[0] is not None, k[0] or "", k[1])) and 25 < len(points) < 40
    dense = rolling_median.cut_points([("a", t) for t in range(4000)], 40, 10**9)
    assert len(dense) < 20  # all in one window: each cut copies what lies before it


def test_sorted_blocks_against_a_list(monkeypatch):
    monkeypatch.setattr(rolling_median, "LEAST_BLOCK", 4)
    rng, plain, blocks = random.Random(3), [], rolling_median.SortedBlocks()
    for step in range(6000):
        grow = step < 2500 or 4000 < step < 5000
        if plain and rng.random() > (0.8 if grow else 0.3):
            v = plain.pop(rng.randrange(len(plain)))
            blocks.remove(v)
        else:
            v = rng.randrange(300)
            plain.append(v)
            blocks.add(v)
        plain.sort()
        assert len(blocks) == len(plain)
        if len(plain) > 1 and step % 7 == 0:
            m = doubled(plain)
            assert [blocks[i] for i in range(len(plain))] == plain
            assert rolling_median.doubled_median(blocks) == m
            assert rolling_median.doubled_spread(blocks, m) == doubled(sorted(abs(2 * x - m) for x in plain))


# token counts

ODD = [(20, "end <|endoftext|> of <|endoftext|>"), (21, " a  b\n\n c\t"), (22, "a" * 5000), (23, "x y " * 900), (24, "é 你 😀 don't we'll"), (25, "x y " * 900)]


def library(texts, name="byte_bpe_50k.json"):
    path = token_counts.public_path(name)
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    import tokenizers

    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    return [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, name):
    rows = AWKWARD + ODD
    docs = documents(spark, rows).withColumnRenamed("lang", "digest").withColumnRenamed("source", "n_tokens")
    got = token_counts.count_once(docs, token_counts.Tokenizer(token_counts.public_path(name))).collect()
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, library([t or "" for _, t in rows], name), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_registered_token_counts(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    got = queries.op11_token_counts(spark, SF).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {(i, len(texts[i].encode()), n, n > 512) for i, n in want.items()}


def test_cache_encodes_only_misses(spark, tmp_path, monkeypatch):
    cache, words = f"file://{tmp_path}/cache", token_counts.Tokenizer(token_counts.public_path())
    docs = documents(spark, [*AWKWARD, *ODD])
    first = token_counts.count_tokens(docs, cache, words).collect()
    distinct = len({t or "" for _, t in AWKWARD + ODD})
    assert token_counts.stored(spark, cache, words).count() == distinct
    raw = f"{cache}/tokenizer={words.digest}"
    assert spark.read.parquet(raw).count() == distinct
    more = documents(spark, [*AWKWARD, *ODD, (99, "one more"), (98, "one more")])
    assert len(token_counts.count_tokens(more, cache, words).collect()) == len(first) + 2
    assert spark.read.parquet(raw).count() == distinct + 1
    spark.read.parquet(raw).limit(3).write.mode("append").parquet(raw)  # another run's append
    monkeypatch.setattr(token_counts, "_counter", None)  # nothing is left to encode
    assert sorted(map(repr, token_counts.count_tokens(docs, cache, words).collect())) == sorted(map(repr, first))
    assert token_counts.count_tokens(docs.limit(0), cache, words).count() == 0
    other = token_counts.Tokenizer(token_counts.public_path("word_bpe_49k.json"))
    assert other.digest != words.digest and token_counts.stored(spark, cache, other).count() == 0


def test_many_misses_meet_by_a_shuffle(spark, monkeypatch):
    words = token_counts.Tokenizer(token_counts.public_path())
    docs = documents(spark, AWKWARD + ODD)
    want = sorted(map(repr, token_counts.count_once(docs, words).collect()))
    monkeypatch.setattr(token_counts, "BROADCAST_DIGESTS", 1)
    assert sorted(map(repr, token_counts.count_once(docs, words).collect())) == want


def test_parts_of_long_texts_add_up():
    rng = random.Random(2)
    bits = ["word", " word", "  two", "\n", "'s", " 's", "<|endoftext|>", " 12", "é", " é", "!", " a b", "\t", " "]
    texts = ["".join(rng.choice(bits) for _ in range(400)) for _ in range(30)]
    cut = [token_counts.parts(t, 50) for t in texts]
    assert all("".join(p) == t for p, t in zip(cut, texts, strict=True)) and max(map(len, cut)) > 5
    assert [sum(library(p)) for p in cut] == library(texts)


# spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms(n, ratio=10):
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def words(seed, k, letters="abé", long=(1, 9)):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(*long))) for _ in range(k)}


@pytest.mark.parametrize("seed", range(8))
def test_trie_pairs_against_all_pairs(seed):
    ws = sorted(words(seed, 250, "ab" if seed % 2 else "abcé"))
    got = [tuple(sorted(p)) for p in spelling_variants.one_edit_pairs(ws)]
    want = [(i, j) for i, j in combinations(range(len(ws)), 2) if one_edit(ws[i], ws[j])]
    assert sorted(got) == want  # each once


@pytest.mark.parametrize("shard_words", [3, 20, 10**6])
def test_variants_against_all_pairs(spark, shard_words):
    rng = random.Random(shard_words)
    n = {w: rng.choice([2, 3, 25, 30, 400, 5000]) for w in words(shard_words, 300, "abé", (7, 9)) | {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "a" * 3000, "a" * 3001}}
    vocab = spark.createDataFrame(list(n.items()), "word string, n long")
    got = [tuple(r) for r in spelling_variants.variants(vocab, shard_words=shard_words).collect()]
    assert len(got) == len(n) and set(got) == forms(n)
    assert any(r[1] != r[2] and r[1] for r in got), "no chain of forms"


def test_words_of_awkward_documents(spark):
    rows = [*AWKWARD, (11, "Straße Straße STRAßE×÷ naïveté-naïveté"), (None, "Zwischen zwischen"), (12, "spelling " * 40), (12, "spelling")]
    docs = documents(spark, rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    for every in (None, 1, 3):
        n = {}
        for i, t in rows:
            for m in spelling_variants.RUN.finditer(t or ""):
                w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0])
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                w = w[: h % len(w)] + w[h % len(w) + 1 :] if every and h % every == 0 else w
                n[w] = n.get(w, 0) + 1
        want = {(w, k) for w, k in n.items() if len(w) >= 7 and k > 1}
        assert {tuple(r) for r in spelling_variants.vocabulary(docs, misspell_every=every).collect()} == want
    assert spelling_variants.variants(spelling_variants.vocabulary(docs.limit(0))).count() == 0


def test_long_texts_and_full_dictionaries(spark, monkeypatch):
    docs = documents(spark, [(1, "Another sentence " * 50), (2, "another one, ANOTHER sentencé")])
    want = set(map(tuple, spelling_variants.vocabulary(docs).collect()))
    monkeypatch.setattr(spelling_variants, "LONG", 10)
    monkeypatch.setattr(spelling_variants, "FLUSH", 1)
    assert set(map(tuple, spelling_variants.vocabulary(docs).collect())) == want == {("another", 52), ("sentence", 50)}
