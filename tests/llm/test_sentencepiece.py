import hashlib
import itertools
import os
import random

import pytest

from engramite.llm import sentencepiece_lattice as sp
from tests.llm.fixtures import AWKWARD, documents

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no piece table here")


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces.load()


EXTRA = [(100, " " * 40 + "ab"), (101, "a\nb\tc  d 12345 x." + "z" * 200), (102, "Ａ😀é​…"), (103, "don't (stop), ever!!! http://a.b/c?d=e&f"), (104, "▁x y"), (105, "qqzzvvxx " * 3)]


@pytest.mark.parametrize("most", [10**6, 50, 0])
def test_same_codes_as_the_library_and_back(spark, pieces, most):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    own = [*AWKWARD, *EXTRA, *((1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())]
    texts = {i: t for i, t in own}
    got = sp.decode(sp.encode(documents(spark, own), pieces, max_words=most), pieces).collect()
    assert len(got) == len(own)
    for r in got:
        assert r.ids == lib.encode(texts[r.doc_id] or ""), texts[r.doc_id]
        assert r.text == (texts[r.doc_id] or "").replace("▁", " ")
        assert r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    if most:
        assert {r.round_trip for r in sp.round_trip(documents(spark, own), pieces).collect()} == {True}
        assert sp.encode(documents(spark, []), pieces).count() == 0


def test_viterbi_against_all_segmentations(spark):
    rng = random.Random(3)
    scored = {c: (-5.0 - i, i) for i, c in enumerate("abc▁")}
    for n in (2, 3, 4):
        for t in itertools.product("abc", repeat=n):
            if rng.random() < 0.3:
                scored["".join(t)] = (-rng.uniform(2, 14), len(scored))
    table = sp.Pieces(scored, [k.replace("▁", " ").encode() for k in scored], {}, 0, sp.UNIGRAM, True)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)]

    def best(w):
        if not w:
            return 0.0, []
        return max((scored[w[:k]][0] + rest[0], [scored[w[:k]][1], *rest[1]]) for k in range(1, len(w) + 1) if w[:k] in scored for rest in [best(w[k:])])

    got = sp.lattice(spark.createDataFrame([(w,) for w in set(words)], "word string"), table).collect()
    assert len(got) == len(set(words))
    for r in got:
        score = lambda ids: sum(list(scored.values())[i][0] for i in ids)
        assert b"".join(table.texts[i] for i in r.ids).decode() == r.word
        assert abs(score(r.ids) - best(r.word)[0]) < 1e-9 and abs(score(table.fold(r.word)) - best(r.word)[0]) < 1e-9
