import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest

from engramite.llm import chat, covertree, pii, queries, toxicity, warc
from engramite.llm.common import shared_dir
from tests.llm.fixtures import AWKWARD, documents
from tests.llm.test_text_ops import SF, components, rows

# --- WARC


def archived(pages):
    top = defaultdict(list)
    for page, _, html in pages:
        if page is not None:
            top[html or ""].append(page)
    out = []
    for page, _, html in pages:
        raw = (html or "").encode()
        best = max(top[html or ""], default=None) if len(raw) >= 1000 and sum((h or "") == (html or "") for _, _, h in pages) > 1 else page
        refers = None if best is None or best == page else best
        out.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


def test_warc(spark, monkeypatch):
    big = "é\r\n\r\n<p>" * 700_000
    pages = [(1, "http://a/ü\n", "x" * 1000), (2, None, "x" * 1000), (2, None, "x" * 1000), (3, "http://b", "x" * 999), (4, "", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", big), (None, "u", "x" * 1000), (8, "u", big)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for bound in (10**6, -1):
        monkeypatch.setattr(warc, "BROADCAST_ROWS", bound)
        assert rows(warc.archive(frame)) == sorted(archived(pages), key=repr)
    folder = shared_dir(spark, "warc-test")
    manifest = warc.write(warc.records(frame.where("page_id = 7")), folder)
    parts = warc.read(manifest, data=True).orderBy("chunk_no").collect()
    assert b"".join(p.data for p in parts).decode() == big and len(parts) == math.ceil(len(big.encode()) / warc.CHUNK)
    seen = hashlib.sha1()
    for p in parts:
        seen.update(p.data)
        assert p.sha1_so_far == seen.hexdigest() and p.last == (p is parts[-1])
    assert pafs.FileSystem.from_uri(manifest.first().path)[0].get_file_info(pafs.FileSystem.from_uri(manifest.first().path)[1]).size > 0
    want = archived([tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()])
    assert rows(queries.op1_warc(spark, SF)) == sorted(want, key=repr)
    assert warc.archive(frame.limit(0)).count() == 0


# --- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def spans(text):
    fits = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    found = [(m.start(), i, m.end(), k) for i, k in enumerate(PATTERNS) for m in re.finditer(PATTERNS[k], text or "") if fits[k](m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def test_personal_data(spark):
    rng = random.Random(1)
    noise = ["".join(rng.choice("ab.@-+ 0149()%é") for _ in range(80)) for _ in range(400)]
    own = [*AWKWARD, *enumerate(noise, 100), (900, "a@b.c@d.e @x.y@z.w 4111 1111 1111 1111 256.1.1.1 1.2.3.4.5.6.7.8 +1 (555) 010-9999 1.2.3." + "7" * 4000)]
    own += [(1000 + i, f"zorblatt writes to jo{i % 3}.doe@mail.example.com always and the others") for i in range(9)]
    got = {(r.doc_id, r.spans): r for r in pii.find(documents(spark, own)).collect()}
    joined = {(r.doc_id, r.spans): r for r in pii.find(documents(spark, own), broadcast_terms=-1).collect()}
    assert got.keys() == joined.keys() and len(got) <= len(own)
    by_id = {r.doc_id: r for r in got.values()}
    for i, text in own:
        want, r = spans(text), by_id[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in want) for k in pii.KINDS]
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == want
    few = pii.find(documents(spark, [(i, f"mr zorblatt lives at secret{i}@mail.example.com now" if i < 2 else f"word{i} goes by and the rest") for i in range(200)] + [(500 + i, "mr zorblatt of brackwater sees big@mail.example.com now") for i in range(4)]))
    told = {r.doc_id: r for r in few.collect()}
    assert "term" in told[501].spans and "brackwater" not in told[501].sanitised and "big@" not in told[501].sanitised
    assert told[100].spans == "" and told[100].sanitised == "word100 goes by and the rest"
    assert pii.find(documents(spark, [])).count() == 0
    for r in queries.op3_pii(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        assert r.base_sha256 == hashlib.sha256(",".join(spans(r.text)).encode()).hexdigest()


def disclosed(texts, bits=4.0, least=0.5, docs=2):
    """All pairs of every line, counted one by one."""
    n_term, n_entity, n_pair = Counter(), Counter(), Counter()
    for text in texts:
        found, pairs, entities = pii.base_spans(text or ""), set(), set()
        bare = list(text or "")
        for s, e, _ in found:
            bare[s:e] = " " * (e - s)
        bare = "".join(bare)
        for s, e, kind in found:
            start, end = bare.rfind("\n", 0, s) + 1, bare.find("\n", s)
            entities.add((kind, text[s:e]))
            pairs |= {(t, kind, text[s:e]) for t in pii._terms(bare[start : end if end >= 0 else len(bare)])}
        n_term.update(pii._terms(text or ""))
        n_entity.update(entities)
        n_pair.update(pairs)
    told = {}
    for (t, *e), n in n_pair.items():
        if n >= docs and n / n_term[t] >= least and math.log2(n * len(texts) / (n_term[t] * n_entity[tuple(e)])) >= bits:
            told[t] = max(told.get(t, 0), n / n_term[t])
    return told


@pytest.mark.parametrize("bits, least, docs", [(4.0, 0.5, 2), (1.0, 0.2, 1), (2.5, 0.9, 3)])
def test_disclosing_terms_are_those_of_all_pairs(spark, bits, least, docs):
    rng = random.Random(5)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.choice('mnop')}{rng.choice('xyz')}"
    owner = lambda k: f"u{k}@x.org " + rng.choice(["", f"nick{'abcdefghijklmnopqrst'[k]}", f"{word()}\nnick{'abcdefghijklmnopqrst'[k]}"])
    line = lambda: " ".join(owner(rng.randrange(20)) if rng.random() < 0.15 else word() for _ in range(rng.randrange(12)))
    texts = ["\n".join(line() if rng.random() < 0.25 else "the end of it" for _ in range(rng.randrange(5))) for _ in range(300)]
    texts += texts[:40] * 3 + [None, "", "rare u1@x.org\nrare u2@x.org\nrare u1@x.org", "rare u1@x.org"]
    got = pii.disclosing_terms(documents(spark, list(enumerate(texts))), bits, least, docs)
    want = disclosed(texts, bits, least, docs)
    assert want and {r.term: round(r.share, 9) for r in got.collect()} == {t: round(x, 9) for t, x in want.items()}


def test_lines_of_many_addresses_and_words_are_few_pairs(spark):
    letters = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:05d}")
    dense = " ".join(f"a{i}@x.org {letters(i)}" for i in range(3000))
    rows = [(0, dense), (1, dense), (2, dense + " more"), *((i, "nothing to see") for i in range(3, 100))]
    got = {r.term: r.share for r in pii.disclosing_terms(documents(spark, rows)).collect()}
    assert got == {letters(i): 1.0 for i in range(3000)}


# --- chat formatting


def test_escapes_are_reversible():
    rng = random.Random(2)
    bits = ["<", "\\", "[", "/", "INST]", "s>", "|im_end|>", "<|im_start|>", "<<SYS>>", "</s>", "\n", "x", "[/INST]", "<</SYS>>"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        assert chat.unescape(chat.escape(text)) == text
        assert not re.search(r"</?s>|\[/?INST\]|<\|[a-z_]+\|>|<<?/?SYS>>", chat.escape(text))


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s><|im_end|>\n"), (1, 2, "assistant", None), (1, 2, "user", "again"), (2, None, None, "no turn"), (2, 5, "assistant", "é\\"), (None, 0, "a\nb%<", "x"), *((3, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(70))]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in chat.read_back(chat.format_paths(chat.linear(frame))).collect()}
    by = defaultdict(list)
    for c, t, r, x in turns:
        by[-(2**63) if c is None else c].append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest() if x is not None else "", x or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        own.sort(key=lambda x: x[:4])
        said = "".join(x[4] for x in own if x[2] == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(own), len(said))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[4]}\n" for x in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert {-1} < {r.conv_id for r in queries.op4_chat(spark, SF).collect()}
    assert chat.format_paths(chat.linear(frame.limit(0))).count() == 0


def test_reply_trees(spark):
    rng = random.Random(4)
    nodes = [(c, n, None if n == 0 else 999 if (c, n) == (2, 7) else rng.randrange(n), float(rng.randrange(5))) for c in range(4) for n in range(25)] + [(9, 1, 2, 1.0), (9, 2, 1, 1.0)]
    up = {(c, n): p for c, n, p, _ in nodes}
    cost = {(c, n): s for c, n, _, s in nodes}
    want = {}
    for c in range(4):
        paths = []
        for n in set(range(25)) - {up[c, m] for m in range(25)}:
            path = [n]
            while up[c, path[-1]] is not None and (c, up[c, path[-1]]) in up:
                path.append(up[c, path[-1]])
            paths.append((-sum(cost[c, x] for x in path), -len(path), n, path))
        for rank, p in enumerate(sorted(paths)[:2], 1):
            want[c, rank] = sorted(p[3])
    got = defaultdict(list)
    for r in chat.best_paths(spark.createDataFrame(nodes, "conv long, node long, parent long, score double"), best=2).collect():
        got[r.conv, r.rank].append(r.node)
    assert {k: sorted(v) for k, v in got.items()} == want


# --- toxicity


def test_toxicity(spark):
    own = [(i, " ".join(["plain", "words", f"n{i}", "here"] + (["you", "vile", "wretch"] if i % 5 == 0 else ["you", "kind", "soul"]))) for i in range(400)] + [(1000 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 400) if i % 3] + [(7, None), (99999, 1)], "doc_id long, toxic int")
    model = toxicity.train(documents(spark, own), labels)
    assert 0 < len(model["at"]) < 2000
    got = {r.doc_id: r for r in toxicity.score(documents(spark, own), model).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(400)) and len(got) == len(own)
    none = toxicity.train(documents(spark, own), labels.limit(0))
    assert {r.score for r in toxicity.score(documents(spark, own), none).collect()} == {0.5}
    big = "/root/testdata/sf0.1"
    found = queries.op6_toxicity(spark, big).where("held_out").join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    hit = [r.predicted for r in found if r.toxic == 1]
    false = [r.predicted for r in found if r.toxic == 0]
    assert sum(hit) / len(hit) > 0.85 and sum(false) / len(false) < 0.02


# --- embeddings


@pytest.mark.parametrize("cell", [5, 40, 5000])
def test_cover_trees(spark, monkeypatch, cell):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 8))
    x = np.concatenate([x, x[:60] + rng.normal(size=(60, 8)) * 0.25, x[:5], x[:5] * 3])
    data = [(i, v.astype(np.float32).tolist(), int(i % 3) if i < 180 else int((i - 180) % 5 % 3)) for i, v in enumerate(x)]
    data += [(500, None, 1), (501, [0.0] * 8, 1), (502, [1.0, float("nan")] + [0.0] * 6, 1), (503, data[0][1], None), (504, [], 1), (505, data[0][1][:4], 0), (506, [None] * 8, 1), (1, data[1][1], 1), (None, data[2][1], 2)]
    units = [(i, str(lab), None if v is None or not v or None in v or not np.isfinite(v).all() or not any(v) else np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v, lab in data]
    linked = [(a, b) for a, b in itertools.combinations(range(len(units)), 2) if units[a][2] is not None and units[b][2] is not None and units[a][1] == units[b][1] != "None" and len(units[a][2]) == len(units[b][2]) and units[a][2] @ units[b][2] >= 0.93]
    comp = components(range(len(units)), linked)
    n = defaultdict(int)
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    least = defaultdict(lambda: math.inf)
    for k, c in comp.items():
        least[c] = min(least[c], math.inf if units[k][0] is None else units[k][0])
    want = sorted(((units[k][0], n[k], least[comp[k]] if least[comp[k]] < math.inf else None) for k in comp), key=repr)
    got = covertree.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), cell=cell)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=repr) == want
    assert len(linked) > 50
    monkeypatch.setattr(covertree, "BROADCAST_AREAS", 0)
    again = covertree.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int"), cell=cell)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in again.collect()), key=repr) == want
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
