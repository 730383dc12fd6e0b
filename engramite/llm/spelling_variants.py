"""Spelling variants of a corpus's words: an errata trie. Words are sharded by adaptive prefixes, once as they are and once
reversed; in each shard's trie the light subtrees of a node are merged with the heavy one, one character skipped or
replaced, and terminals that coincide are words one edit apart."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, drop_dir, sliced, table, text_columns

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words of one trie; a prefix that more words share is split by its next character.
SHARD_WORDS = 2000
#: Distinct words a task gathers before it hands them on.
FLUSH = 200_000
#: From texts beyond this many characters, runs are taken one at a time.
LONG = 1 << 20


def _runs(text: str) -> Counter:
    """Runs of letters with A-Z lower-cased, and how often each occurs."""
    found = Counter(RUN.findall(text) if len(text) <= LONG else (m.group() for m in RUN.finditer(text)))
    out: Counter = Counter()
    for run, n in found.items():
        out[run.lower() if run.isascii() else run.translate(LOWER)] += n
    return out


def misspelt(doc_id, run: str, every: int) -> str:
    """``run`` without one code point where the crc32 of ``<doc_id>:<run>`` is divisible by ``every``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, min_chars: int = 7, min_count: int = 2, misspell_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: the distinct runs of letters of all texts, A-Z lower-cased, of ``min_chars`` code points or more that
    occur ``min_count`` times or more.

    With ``misspell_every``, runs first lose a code point as :func:`misspelt` says. Null and empty texts have no words;
    every row of a repeated id counts; a null id reads as an empty one; other columns may have any names. Counts are
    combined in the tasks before they are shuffled, so a frequent word is a row a task.
    """
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for run, n in _runs(text or "").items():
                    word = misspelt(doc, run, misspell_every) if misspell_every else run
                    if len(word) >= min_chars:
                        seen[word] += n
                if len(seen) >= FLUSH:
                    yield batch(out, list(seen), list(seen.values()))
                    seen.clear()
        if seen:
            yield batch(out, list(seen), list(seen.values()))

    counts = text_columns(docs, id_col, text_col).mapInArrow(sliced(count), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Node:
    """A place in a compressed trie where words end or part. ``first`` is one of its words, ``depth`` the length of what
    they share, ``term`` the word that ends here or -1."""

    __slots__ = ("depth", "first", "kids", "size", "term")

    def __init__(self, depth: int, first: int, size: int, term: int):
        self.depth, self.first, self.size, self.term, self.kids = depth, first, size, term, {}


def trie(words: list[str]) -> list[Node]:
    """The nodes of the trie of sorted distinct ``words``; the root is the first. It has two nodes a word at most, so long
    words cost no more than short ones."""
    nodes, todo = [], [(0, len(words), None)]
    while todo:
        low, high, above = todo.pop()
        head = words[low]
        depth = len(head) if high - low == 1 else len(commonprefix([head, words[high - 1]]))
        node = Node(depth, low, high - low, low if len(head) == depth else -1)
        nodes.append(node)
        if above:
            above[0].kids[above[1]] = node
        start = low + (node.term >= 0)
        while start < high:
            c, end = words[start][depth], start + 1
            while end < high and words[end][depth] == c:
                end += 1
            todo.append((start, end, (node, c)))
            start = end
    return nodes


#: The origin of what is read from a node itself, beside the characters of its children.
SELF = ""


def _merge(words: list[str], node: Node):
    """Pairs of words that part at ``node`` and are one edit apart. Each child is read past its own character, which is so
    skipped or replaced, beside the node itself; only what light subtrees hold is enumerated, the heavy child and the node
    are looked up in, so a word is visited once for each light edge above it."""
    heavy = max(node.kids.values(), key=lambda k: k.size)
    start = [(c, kid, node.depth + 1, kid is not heavy) for c, kid in node.kids.items()]
    todo = [(None, [*start, (SELF, node, node.depth, False)])]
    while todo:
        first, here = todo.pop()
        if len(here) == 2 and not here[0][1].kids and not here[1][1].kids:
            (oa, a, da, _), (ob, b, db, _) = here
            if words[a.first][da:] == words[b.first][db:]:
                yield a.term, b.term
            continue
        ends = [(o, n.term) for o, n, d, _ in here if n.depth == d and n.term >= 0]
        for i, (oa, a) in enumerate(ends):
            for ob, b in ends[i + 1 :]:
                if SELF not in (oa, ob) or first not in (oa, ob):
                    yield a, b
        wanted = set()
        for _, n, d, light in here:
            if light:
                wanted.update(n.kids) if n.depth == d else wanted.add(words[n.first][d])
        if first is None:
            wanted |= {c for _, n, _, light in here if light for c in (words[n.first][node.depth],)}
        for c in wanted:
            then = []
            for o, n, d, light in here:
                if n.depth > d:
                    if words[n.first][d] == c:
                        then.append((o, n, d + 1, light))
                elif kid := n.kids.get(c):
                    then.append((o, kid, d + 1, light or o == SELF and first is None and kid is not heavy))
            if len(then) > 1 and any(x[3] for x in then):
                now = c if first is None else first
                if len(then) == 2 and SELF in (then[0][0], then[1][0]) and now in (then[0][0], then[1][0]):
                    continue  # the same skip, one character further on
                todo.append((now, then))


def one_edit_pairs(words: list[str]):
    """Index pairs of sorted distinct ``words`` that differ by one inserted, deleted or replaced code point, each once."""
    for node in trie(words) if len(words) > 1 else ():
        if node.kids and (len(node.kids) > 1 or node.term >= 0):
            yield from _merge(words, node)


PAIR = "u string, v string, nu long, nv long"


def _tries(batches):
    """Streams shards, each sorted by its words; one shard is held at a time."""
    out = pa.schema([("reverse", pa.bool_()), ("u", pa.string()), ("v", pa.string()), ("nu", pa.int64()), ("nv", pa.int64())])
    now, words, counts, send = None, [], [], []

    def settle():
        order = sorted(range(len(words)), key=words.__getitem__)
        ranked = [words[i] for i in order]
        for a, b in one_edit_pairs(ranked):
            send.append((now[0], ranked[a], ranked[b], counts[order[a]], counts[order[b]]))

    for b in batches:
        for reverse, shard, key, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (reverse, shard) != now:
                settle()
                now, words, counts = (reverse, shard), [], []
                if len(send) >= 20_000:
                    yield batch(out, *zip(*send, strict=True))
                    send = []
            words.append(key)
            counts.append(n)
    settle()
    if send:
        yield batch(out, *zip(*send, strict=True))


def near_words(vocab: DataFrame, min_chars: int = 7, shard_words: int = SHARD_WORDS, spent: list[str] | None = None) -> DataFrame:
    """``(u, v, nu, nv)``: every two words of ``vocab(word, n)`` that differ by one inserted, deleted or replaced code
    point, once each, with their counts. Words are distinct, of ``min_chars`` code points or more; null words are ignored.

    Two such words share their first k or their last k code points, k half of ``min_chars`` less one: so each word is in
    two tries, of its beginning's shard and, reversed, of its end's. A prefix that more than ``shard_words`` words share
    is a node that no task holds: its own merge is two joins on the words without the character there, whose groups are
    as large as the alphabet at most, and its children are shards or such nodes in turn. A word and its one-longer
    neighbour are paired at the first place where they differ, and the reversed side leaves out what the other has, so no
    pair comes twice. The folders that the result reads are added to ``spent``; they go once it is written.
    """
    k = max(0, (min_chars - 1) // 2)
    words = vocab.where("word is not null").select("word", "n")
    both = words.select(F.lit(False).alias("reverse"), F.col("word").alias("key"), "n").union(words.select(F.lit(True), F.reverse("word"), "n"))
    rest, at = both.withColumn("shard", F.substring("key", 1, k)), k
    settled, found, spent = [], [], [] if spent is None else spent
    while True:
        full = rest.groupBy("reverse", "shard").agg(F.count("*").alias("c")).where(F.col("c") > shard_words).select("reverse", "shard")
        large, path = table(rest.join(full, ["reverse", "shard"], "left_semi"), "spelling-node")
        if large.isEmpty():
            drop_dir(vocab.sparkSession, path)
            settled.append(rest)
            break
        spent.append(path)
        settled.append(rest.join(large.select("reverse", "shard").distinct(), ["reverse", "shard"], "left_anti"))
        found.append(_node_pairs(large, at))
        at += 1
        rest = large.withColumn("shard", F.substring("key", 1, at))
    shards = settled[0]
    for more in settled[1:]:
        shards = shards.union(more)
    dealt = shards.select("reverse", "shard", "key", "n").repartition("reverse", "shard").sortWithinPartitions("reverse", "shard")
    pairs = dealt.mapInArrow(_tries, f"reverse boolean, {PAIR}")
    for more in found:
        pairs = pairs.union(more)
    turned = lambda c: F.when(F.col("reverse"), F.reverse(c)).otherwise(F.col(c)).alias(c)
    once = pairs.select("reverse", turned("u"), turned("v"), "nu", "nv").where(~F.col("reverse") | (F.substring("u", 1, k) != F.substring("v", 1, k)))
    return once.drop("reverse")


def _node_pairs(large: DataFrame, at: int) -> DataFrame:
    """Pairs of words whose first difference is the character ``at`` (from 0) of a prefix that ``large`` holds."""
    without = large.where(F.length("key") > at).select("reverse", "key", "n", F.concat(F.substring("key", 1, at), F.expr(f"substring(key, {at + 2})")).alias("left"), F.substring("key", at + 1, 1).alias("c"))
    a, b = without.alias("a"), without.alias("b")
    same = [F.col("a.reverse") == F.col("b.reverse"), F.col("a.left") == F.col("b.left"), F.col("a.key") < F.col("b.key")]
    replaced = a.join(b, same).select("a.reverse", F.col("a.key").alias("u"), F.col("b.key").alias("v"), F.col("a.n").alias("nu"), F.col("b.n").alias("nv"))
    whole = large.select("reverse", "key", "n").alias("w")
    skips = [F.col("a.reverse") == F.col("w.reverse"), F.col("a.left") == F.col("w.key"), F.expr(f"substring(w.key, {at + 1}, 1)") != F.col("a.c")]
    return replaced.union(a.join(whole, skips).select("a.reverse", F.col("a.key"), F.col("w.key"), F.col("a.n"), F.col("w.n")))


def variants(vocab: DataFrame, min_chars: int = 7, ratio: int = 10, shard_words: int = SHARD_WORDS, max_rounds: int = 8) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, a row for each word of ``vocab(word, n)``.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them, the first in code-point order among
    ties, if it is ``ratio`` times as frequent as the word at least, with ``form_n`` its count; ``root`` follows forms to
    the last, or is the word. As each form is ``ratio`` times as frequent (at least 2), chains are shorter than the
    digits of the largest count, and doubling settles them in a few rounds of small joins. An empty vocabulary gives no
    rows. A word has a bounded number of neighbours (its length times the alphabet), and they are combined before they
    meet."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms have no circle")
    spark = vocab.sparkSession
    vocab, vocab_at = table(vocab.select("word", "n"), "spelling-words")
    spent: list[str] = []
    pairs, pairs_at = table(near_words(vocab, min_chars, shard_words, spent), "spelling-pairs")
    sides = pairs.select(F.col("u").alias("word"), F.col("v").alias("other"), F.col("nv").alias("m")).union(pairs.select("v", "u", "nu"))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("top"))
    joined = vocab.join(best, "word", "left")
    fits = -F.col("top.less") >= ratio * F.col("n")
    known, known_at = table(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("top.other")).alias("form"), F.when(fits, -F.col("top.less")).alias("form_n")), "spelling-forms")
    roots, at = table(known.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(max_rounds):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped, then = table(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        drop_dir(spark, at)
        at, roots = then, jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"forms did not settle in {max_rounds} rounds")
    found = cut(known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    for path in (vocab_at, pairs_at, known_at, at, *spent):
        drop_dir(spark, path)
    return found
