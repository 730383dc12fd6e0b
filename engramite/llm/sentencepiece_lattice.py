"""SentencePiece encoding over a relational lattice, and decoding.

Texts are cut where no piece of the table can span the cut. The bounded-length substrings of each word meet the piece
table in an equi-join; the edges of a word are grouped and folded by a higher-order aggregate. For a unigram table the
fold is Viterbi's. For a merge table (BPE) the best path by score is not the tokenizer's answer (it differs on over half
of all words), so there the fold takes the edges in merge order and keeps a bit mask of the boundaries that are left.
"""

from __future__ import annotations

import hashlib
import os
import struct
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, by_bytes, drop_dir, shared_dir, sliced, text_columns, text_key, write

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Piece tables are broadcast up to this many rows; vocabularies are fixed and far smaller.
MAX_PIECES = 1_000_000
#: Words of the corpus whose codes are broadcast, the most frequent first, about 20 bytes each; the others are joined.
MAX_WORDS = 2_000_000
#: Characters of a word that the fold's 64-bit mask has room for; longer words are folded over an array, and those of over
#: LONG_CHARS in Python, as the row of a word's edges grows with it.
MASK_CHARS, LONG_CHARS = 60, 400
#: Words in a task of the lattice, about 30 edges each.
WORDS_A_TASK = 40_000
#: Letters around which words are cut, like ASCII marks, where no piece holds the two neighbours: accented Latin-1 letters.
CUT_AROUND = range(0xC0, 0x100)
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes):
    """(number, value) of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at : at + n]
            at += n


@dataclass
class Pieces:
    """A piece table. ``scored`` maps pieces that text can match to (score, id)."""

    scored: dict[str, tuple[float, int]]
    texts: list[bytes]
    bytes_: dict[int, int]
    unk: int
    kind: int
    dummy_prefix: bool

    def __post_init__(self):
        self.longest = max(map(len, self.scored), default=1)
        if any(SPACE in p.lstrip(SPACE) for p in self.scored):
            raise ValueError("a piece has a space inside: words can't be encoded apart")
        many = [p for p in self.scored if len(p) > 1]
        pairs = {(a, b) for p in many for a, b in zip(p, p[1:], strict=False) if a != SPACE}
        ascii_, inside = {chr(i) for i in range(128)} - {" "}, {c for p in many for c in p}
        alone = ascii_ - inside
        marks = ({c for c in ascii_ if not c.isalpha()} | set(map(chr, CUT_AROUND))) & inside
        # characters that behave alike share a class; class 0 is that of all others
        apart = sorted(alone | marks | {x for p in pairs if marks & {*p} for x in p} | {" "})
        self.kinds = np.zeros(0x110000, np.uint16)
        self.kinds[list(map(ord, apart))] = np.arange(1, len(apart) + 1)
        self.held = np.zeros(0x110000, bool)
        self.held[[ord(p) for p in self.scored if len(p) == 1 and p != SPACE] + [32]] = True

        def cut(a: str, b: str) -> bool:
            if " " in (a, b):
                return b in alone or b == " " != a
            return bool(alone & {a, b}) or (bool(marks & {a, b}) and (a, b) not in pairs)

        self.cut = np.array([[cut(a, b) for b in ("", *apart)] for a in ("", *apart)])

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        raw = open(path, "rb").read()
        scored, texts, byte_ids, unk, kind, prefix = {}, [], {}, 0, UNIGRAM, True
        for number, value in _fields(raw):
            if number == 1:
                got = dict(_fields(value))
                piece, score, sort, i = got[1].decode(), struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0], got.get(3, 1), len(texts)
                if sort in (1, 4):
                    scored[piece] = (score, i)
                elif sort == 6:
                    byte_ids[int(piece[3:5], 16)] = i
                elif sort == 2:
                    unk = i
                texts.append(bytes([int(piece[3:5], 16)]) if sort == 6 else b"" if sort in (3, 5) else " ⁇ ".encode() if sort == 2 else piece.replace(SPACE, " ").encode())
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                prefix = bool(dict(_fields(value)).get(3, 1))
        return cls(scored, texts, byte_ids, unk, kind, prefix)

    def words(self, texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
        """Many texts in words that no piece spans, spaces first, and the place of each text's first word (with a last
        place). Two neighbours are cut apart by what they are: before a run of spaces, and at marks that no piece holds next
        to the neighbour."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ").to_pylist()
        if self.dummy_prefix:
            texts = [" " + t if t else t for t in texts]
        rows, whole = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]), "".join(texts)
        chars, data = np.frombuffer(whole.encode("utf-32-le"), np.uint32), whole.encode()
        starts = np.zeros(len(chars) + 1, bool)
        starts[rows] = True
        for i in range(0, len(chars) - 1, 1 << 20):
            kinds = self.kinds[chars[i : i + (1 << 20) + 1]]
            starts[i + 1 : i + len(kinds)] |= self.cut[kinds[:-1], kinds[1:]]
        at = np.nonzero(starts)[0]
        offsets = at
        if len(data) > len(chars):
            width = (chars > 0x7F).astype(np.uint8) + (chars > 0x7FF) + (chars > 0xFFFF) + 1
            offsets = np.concatenate([[0], np.cumsum(width, dtype=np.int32)])[at]
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)), np.searchsorted(at, rows)

    def odd(self, words: pa.StringArray) -> np.ndarray:
        """Of each word, whether it has a character that no piece holds. No word is empty."""
        chars = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        n = pc.utf8_length(words).to_numpy()
        return ~np.logical_and.reduceat(self.held[chars], np.cumsum(n) - n) if len(n) else np.zeros(0, bool)

    def char(self, c: str) -> list[int]:
        """A character no piece holds: its bytes, or the unknown piece."""
        return [self.bytes_[b] for b in c.replace(SPACE, " ").encode("utf-8", "replace")] if self.bytes_ else [self.unk]

    def fold(self, word: str) -> list[int]:
        """One word's codes by the same fold, for words beyond the mask or with characters that no piece holds."""
        w = word.replace(" ", SPACE)
        n = len(w)
        edges = [(*self.scored[w[s:e]], s, e) for s in range(n) for e in range(s + 1, min(n, s + self.longest) + 1) if w[s:e] in self.scored]
        at = {(s, e): i for _, i, s, e in edges}
        if self.kind == BPE:
            left, right = list(range(-1, n)), list(range(1, n + 2))  # boundary before and after each boundary
            stands = [True] * (n + 1)
            for _, _, s, e in sorted(edges, key=lambda x: (-x[0], x[3], -x[2])):
                if stands[s] and stands[e] and right[s] != e and right[right[s]] == e:
                    stands[right[s]], right[s], left[e] = False, e, s
            cuts = [i for i in range(n + 1) if stands[i]]
        else:
            low = min((x[0] for x in edges), default=0.0) - 10.0
            best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            by_end: dict[int, list] = {}
            for score, _, s, e in edges:
                by_end.setdefault(e, []).append((s, score))
            for e in range(1, n + 1):
                for s, score in by_end.get(e, []) + ([] if (e - 1, e) in at else [(e - 1, low)]):
                    if best[s] + score > best[e]:
                        best[e], back[e] = best[s] + score, s
            cuts = [n]
            while cuts[-1] > 0:
                cuts.append(back[cuts[-1]])
            cuts.reverse()
        return [i for s, e in zip(cuts, cuts[1:], strict=False) for i in ([at[s, e]] if (s, e) in at else self.char(w[s:e]))]

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """The texts of many rows of ids; bytes that are no UTF-8 become U+FFFD."""
        found = pa.array(self.texts, pa.binary()).take(pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))
        places = np.frombuffer(found.buffers()[1], np.int32)[np.cumsum([0, *map(len, rows)])].tolist() if len(found) else [0] * (len(rows) + 1)
        data = memoryview(found.buffers()[2] or b"")
        skip = [self.dummy_prefix and a < b and data[a] == 32 for a, b in pairwise(places)]
        return [str(data[a + x : b], "utf-8", "replace") for (a, b), x in zip(pairwise(places), skip, strict=True)]


def piece_table(spark: SparkSession, pieces: Pieces, more: list[str] = ()) -> DataFrame:
    """(piece, rank, cost, id); pieces of equal score share a rank. ``more``: characters that no piece holds, which stand
    alone at any cost and have the id -1 - code point."""
    order = {c: k for k, c in enumerate(sorted({-score for score, _ in pieces.scored.values()}))}
    low = max(order, default=0.0) + 10.0
    rows = [(p, order[-score], -score, i) for p, (score, i) in pieces.scored.items()] + [(c, len(order), low, -1 - ord(c)) for c in more]
    frame = spark.createDataFrame(rows, "piece string, rank long, cost double, id int")
    return F.broadcast(frame) if len(rows) <= MAX_PIECES else frame


def _shl(value: Column, by: Column) -> Column:
    return F.call_function("shiftleft", value, by.cast("int"))


def _edge(kind: int, masked: bool) -> Column:
    """One edge as its fold takes it, computed per row before the rows are grouped, so that the fold stays short. For merges
    ``key`` orders by rank, end and latest start; ``ends`` and ``span`` are an edge's two boundaries, and all from the one
    to the other, as bits; ``at`` is its end and id in one number."""
    one, s, l = F.lit(1).cast("long"), F.col("s"), F.col("l")
    at = (_shl((s + l).cast("long"), F.lit(32)) + F.col("id").cast("long") + (1 << 31)).alias("at")
    if kind != BPE:
        return F.struct((s + l).alias("e"), s.alias("s"), "cost", "id")
    if not masked:
        return F.struct("rank", (s + l).alias("e"), (-s).alias("back"), s.alias("s"), at)
    key = _shl(F.col("rank"), F.lit(14)) + _shl((s + l).cast("long"), F.lit(7)) + (127 - s)
    ends = _shl(one, s).bitwiseOR(_shl(one, s + l))
    return F.struct(key.alias("key"), ends.alias("ends"), (_shl(one, s + l + 1) - _shl(one, s)).alias("span"), at)


def _in_order(kept: Column) -> Column:
    """The ids of edges by their ends."""
    return F.transform(F.sort_array(F.transform(kept, lambda x: x["at"])), lambda a: (a.bitwiseAND(0xFFFFFFFF) - (1 << 31)).cast("int"))


def _merge_fold(edges: Column, n: Column) -> Column:
    """The codes by merges in order: an edge is taken where both its boundaries stand and one stands between them.

    That is one bit of ``mask & span ^ ends``. One bit is also what a missing end gives with nothing between; taking the
    boundaries between away changes nothing then."""
    step = lambda m, x: F.when(F.bit_count(m.bitwiseAND(x["span"]).bitwiseXOR(x["ends"])) == 1, m.bitwiseAND(F.bitwise_not(x["span"].bitwiseXOR(x["ends"])))).otherwise(m)
    mask = F.aggregate(edges, _shl(F.lit(1).cast("long"), n + 1) - 1, step)

    def ids(m: Column) -> Column:
        found = _in_order(F.filter(edges, lambda x: m.bitwiseAND(x["span"]) == x["ends"]))
        return F.transform(F.array(found), lambda f: F.when(F.size(f) == F.bit_count(m) - 1, f))[0]

    return F.transform(F.array(mask), ids)[0]


def _long_merge_fold(edges: Column, n: Column) -> Column:
    """As :func:`_merge_fold` for words beyond the mask: the standing boundaries are an array."""

    def step(stand: Column, x: Column) -> Column:
        here = F.array_contains(stand, x["s"]) & F.array_contains(stand, x["e"])
        one = F.size(F.filter(stand, lambda b: (b > x["s"]) & (b < x["e"]))) == 1
        return F.when(here & one, F.filter(stand, lambda b: (b <= x["s"]) | (b >= x["e"]))).otherwise(stand)

    def ids(stand: Column) -> Column:
        cuts = F.transform(stand, lambda b, i: F.struct(b.alias("s"), F.get(stand, i + 1).alias("e")))
        kept = F.filter(edges, lambda x: F.array_contains(cuts, F.struct(x["s"].alias("s"), x["e"].alias("e"))))
        return F.transform(F.array(_in_order(kept)), lambda f: F.when(F.size(f) == F.size(stand) - 1, f))[0]

    return F.transform(F.array(F.aggregate(edges, F.sequence(F.lit(0), n), step)), ids)[0]


def _viterbi_fold(edges: Column, n: Column) -> Column:
    none = F.array().cast("array<int>")
    start = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.when(i == 0, F.lit(0.0)).alias("cost"), none.alias("ids")))

    def step(best: Column, x: Column) -> Column:
        come = F.get(best, x["s"])
        cost = come["cost"] + x["cost"]
        better = cost.isNotNull() & (F.get(best, x["e"])["cost"].isNull() | (cost < F.get(best, x["e"])["cost"]))
        put = F.transform(best, lambda y, i: F.when(i == x["e"], F.struct(cost.alias("cost"), F.concat(come["ids"], F.array(x["id"])).alias("ids"))).otherwise(y))
        return F.when(better, put).otherwise(best)

    return F.transform(F.array(F.aggregate(edges, start, step)), lambda b: F.when(F.get(b, n)["cost"].isNotNull(), F.get(b, n)["ids"]))[0]


def lattice(words: DataFrame, pieces: Pieces, masked: bool = True, more: list[str] = ()) -> DataFrame:
    """The rows of ``words(word, ...)``, distinct words, with ``ids``: explode, join, group, fold. ``masked``: words of up to MASK_CHARS characters, else
    longer ones. A word with a character that neither a piece holds nor ``more`` has null ids or no row. ``words`` dealt by ``word``
    are not dealt anew."""
    table = piece_table(words.sparkSession, pieces, more)
    size = F.char_length("word")
    keys = ["_row", *words.columns]  # the edges of a row come one after the other: numbered first, they need no sorting
    w = words.where(size.between(1, MASK_CHARS) if masked else size > MASK_CHARS).select(F.monotonically_increasing_id().alias("_row"), "*", F.translate("word", " ", SPACE).alias("_w"))
    n = F.char_length("_w")
    starts = w.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), n - F.col("s")))).alias("l"))
    edges = spans.select(*keys, "s", "l", F.substring("_w", F.col("s") + 1, F.col("l")).alias("piece")).join(table, "piece")
    grouped = edges.select(*keys, _edge(pieces.kind, masked).alias("edge")).groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    fold = _viterbi_fold if pieces.kind != BPE else _merge_fold if masked else _long_merge_fold
    return grouped.select(*words.columns, fold(F.col("edges"), F.char_length("word")).alias("ids"))  # a filter on ids here would fold twice


class Codes:
    """Codes of the frequent words, sorted by the words' hashes."""

    def __init__(self, blobs: list, kind: type):
        join = lambda k, t: np.concatenate([np.frombuffer(b[k], t) for b in blobs] or [np.empty(0, t)])
        h, n, self.ids = join(0, np.uint64), join(1, np.uint16), join(2, kind)
        end = np.cumsum(n, dtype=np.int64)
        order = np.argsort(h)
        self.h, self.start, self.n = h[order], (end - n)[order].astype(np.int32), n[order]

    def of(self, words: pa.StringArray, hole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all codes, how many each word has, whether it is missing); a missing word has one code, ``hole``."""
        if not len(self.h):
            return np.full(len(words), hole, self.ids.dtype), np.ones(len(words), np.int32), np.ones(len(words), bool)
        hashes = _hashes(words)
        at = np.searchsorted(self.h, hashes)
        at[at == len(self.h)] = 0
        miss = self.h[at] != hashes
        n = np.where(miss, 1, self.n[at]).astype(np.int32)
        ids = _spread(self.ids, np.where(miss, 0, self.start[at]), n)
        ids[(np.cumsum(n) - n)[miss]] = hole
        return ids, n, miss


def _spread(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``values[start : start + n]`` of every start, one after the other."""
    ends = np.cumsum(n, dtype=np.int32)
    return values[np.repeat((start - ends + n).astype(np.int32), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def _counts(table, most: int = 400_000):
    """(word, n, odd) of each task's texts, odd: with a character that no piece holds."""

    def send(seen: pa.Table) -> pa.RecordBatch:
        words = seen["word"].combine_chunks()
        return pa.RecordBatch.from_arrays([words, seen["n_sum"].combine_chunks(), pa.array(table.value.odd(words))], names=["word", "n", "odd"])

    def run(batches):
        seen, size = [], 0
        total = lambda: pa.concat_tables(seen).group_by("word").aggregate([("n", "sum")])
        for b in batches:
            counts = pc.value_counts(table.value.words(b.column(0))[0])
            seen.append(pa.table({"word": counts.field(0), "n": counts.field(1)}))
            size += len(counts)
            if size > 2 * most:
                whole = total()
                if len(whole) > most:
                    yield send(whole)
                    seen, size = [], 0
                else:
                    seen, size = [whole.rename_columns(["word", "n"])], len(whole)
        if seen:
            yield send(total())

    return run


CODED = pa.schema([("word", pa.string()), ("n", pa.int64()), ("ids", pa.list_(pa.int32()))])
CODED_DDL = "word string, n long, ids array<int>"


def _folded(table):
    """Words beyond LONG_CHARS, folded one by one."""

    def run(batches):
        for b in batches:
            yield batch(CODED, *b.columns, [table.value.fold(w) for w in b.column(0).to_pylist()])

    return run


def _spelled(table):
    """Ids with the characters that no piece holds written as :meth:`Pieces.char` writes them."""

    def run(batches):
        for b in batches:
            ids = [[i for x in own for i in ([x] if x >= 0 else table.value.char(chr(-1 - x)))] for own in b.column(2).to_pylist()]
            yield batch(CODED, b.column(0), b.column(1), ids)

    return run


def _pack(kind: type):
    def run(batches):
        out = pa.schema([("h", pa.binary()), ("n", pa.binary()), ("ids", pa.binary())])
        for b in batches:
            ids = b.column(1)
            yield batch(out, [_hashes(b.column(0)).tobytes()], [np.asarray(ids.value_lengths()).astype(np.uint16).tobytes()], [np.asarray(ids.flatten()).astype(kind).tobytes()])

    return run


def word_codes(docs: DataFrame, table) -> DataFrame:
    """``(word, n, ids)``: every distinct word of ``docs(text)`` with its occurrences and codes, written to the shared folder.

    Each word goes through the lattice once, however often it occurs. Words with characters that no piece holds go with
    those characters added to the piece table (Unicode bounds their number); words of MASK_CHARS to LONG_CHARS characters
    have a fold of their own; only longer ones, whose edges would be too long a row, are folded in Python by the same rule.
    """
    spark, pieces = docs.sparkSession, table.value
    schema = "word string, n long, odd boolean"
    counted = docs.select("text").mapInArrow(by_bytes(_counts(table), 0), schema).groupBy("word").agg(F.sum("n").alias("n"), F.any_value("odd").alias("odd"))
    write(counted, path := shared_dir(spark, "words"))
    words = spark.read.parquet(path)
    size = F.char_length("word")
    kinds = {(r.odd, r.long): r["count"] for r in words.groupBy("odd", F.when(size > LONG_CHARS, 2).when(size > MASK_CHARS, 1).otherwise(0).alias("long")).count().collect()}
    deal = lambda df, n: df.select("word", "n").repartition(max(1, -(-n // WORDS_A_TASK)), "word")
    parts, target = [], shared_dir(spark, "codes")
    for (odd, long), n in sorted(kinds.items()):
        rows = deal(words.where(F.col("odd") == odd).where(size > LONG_CHARS if long == 2 else size.between(MASK_CHARS + 1, LONG_CHARS) if long else size <= MASK_CHARS), n)
        if long == 2:
            coded = rows.mapInArrow(_folded(table), CODED_DDL)
        else:
            more = [r[0] for r in rows.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r[0] and r[0] not in pieces.scored and r[0] != " "] if odd else []  # Unicode at most
            coded = lattice(rows, pieces, not long, more)
            coded = coded.mapInArrow(_spelled(table), CODED_DDL) if odd else coded
        write(coded, part := f"{target}/{odd}-{long}")
        parts.append(part)
    drop_dir(spark, path)
    return spark.read.schema(CODED_DDL).parquet(*parts) if parts else spark.createDataFrame([], CODED_DDL)


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, back: bool = False) -> DataFrame:
    """``(doc_id, ids array<int>, text_sha256)``, and with ``back`` the decoded ``text`` from the same pass; one row per row of ``docs``, whole texts.

    The codes of the most frequent words (``max_words`` at most, 20 bytes each in every Python worker) are looked up as a
    text is read; words that are rarer, or seen once, leave a hole that a join with the other words' codes fills. Ids may
    be of any type. Null and empty texts have no ids. U+2581 in a text is a space to this encoding, so ``text_sha256`` is
    the digest of the text with it replaced; null ids and repeated rows are answered row by row; an empty table gives no
    rows; columns other than the two are not read, whatever their names.
    """
    spark, rows = docs.sparkSession, text_columns(docs, id_col, text_col)
    kind, hole = dict(rows.dtypes)["doc_id"], len(pieces.texts)
    width = np.uint16 if hole < 1 << 16 else np.uint32
    table = spark.sparkContext.broadcast(pieces)
    every = word_codes(rows, table)
    times = sorted((r[0], r[1]) for r in every.where("n > 1").groupBy(F.least("n", F.lit(1_000_000)).alias("n")).count().collect())
    least, room = 1_000_001, max_words
    for n, k in reversed(times):
        if k > room:
            break
        least, room = n, room - k
    often = (F.col("n") >= least) & (F.size("ids") < 1 << 16)
    codes = spark.sparkContext.broadcast(Codes(every.where(often).select("word", "ids").mapInArrow(_pack(width), "h binary, n binary, ids binary").collect(), width))  # max_words codes at most

    def look_up(batches):
        pieces, found = table.value, codes.value
        for b in batches:
            words, bounds = pieces.words(b.column(2))
            coded = words.dictionary_encode()
            at = coded.indices.to_numpy()
            own, size, miss = found.of(coded.dictionary, hole)
            n = size[at]
            ids = _spread(own, (np.cumsum(size, dtype=np.int32) - size)[at], n)
            packed = [zstandard.compress(ids[i:j].tobytes(), 6) for i, j in pairwise(np.concatenate([[0], np.cumsum(n)])[bounds].tolist())]
            gaps = np.nonzero(miss[at])[0]
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(gaps, bounds).astype(np.int32)), coded.dictionary.take(pa.array(at[gaps])))
            shas = [hashlib.sha256((t or "").replace(SPACE, " ").encode()).digest() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary()), rare, pa.array(shas, pa.binary())], names=["doc_id", "tkey", "packed", "rare", "sha"])

    looked = rows.select("doc_id", text_key().alias("tkey"), "text").mapInArrow(by_bytes(look_up, 2), f"doc_id {kind}, tkey long, packed binary, rare array<string>, sha binary")
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("kid")
    dealt = looked.select(own, "doc_id", F.coalesce("tkey", F.lit(0).cast("long")).alias("tkey"), "packed", "rare", "sha").repartition("kid", "tkey")
    # reads every column and has keys that can't be null (no filter is inferred), so that this branch and the join below
    # share one exchange
    named = F.when((F.octet_length("packed") >= 0) & (F.octet_length("sha") >= 0) & (F.col("doc_id").isNull() | (F.col("doc_id").cast("string") == F.col("kid"))), F.col("rare"))
    wanted = dealt.select("kid", "tkey", F.posexplode(F.array_distinct(named)).alias("at", "word")).distinct()
    late = wanted.join(every.where(~often).select("word", "ids"), "word").groupBy("kid", "tkey").agg(F.collect_list(F.struct("at", "ids")).alias("late"))
    both = dealt.join(late, ["kid", "tkey"], "left").select("doc_id", "packed", "rare", "sha", "late")

    def fill(batches):
        pieces = table.value
        for b in batches:
            out = []
            for packed, rare, late in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                ids = np.frombuffer(zstandard.decompress(packed), width).astype(np.int32)
                if rare:
                    once = list(dict.fromkeys(rare))
                    got = {once[x["at"]]: np.array(x["ids"], np.int32) for x in late}
                    gaps = np.nonzero(ids == hole)[0]
                    parts = np.split(ids, gaps)  # from the second on, each begins with a hole
                    ids = np.concatenate([parts[0], *(y for w, x in zip(rare, parts[1:], strict=True) for y in (got[w], x[1:]))])
                out.append(ids)
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))
            shas = pa.array([x.hex() for x in b.column(3).to_pylist()], pa.string())
            texts = [pa.array(pieces.decode(out), pa.string())] if back else []
            yield pa.RecordBatch.from_arrays([b.column(0), ids, shas, *texts], names=["doc_id", "ids", "text_sha256", *["text"] * back])

    return both.mapInArrow(sliced(fill), f"doc_id {kind}, ids array<int>, text_sha256 string" + ", text string" * back)


def decode(encoded: DataFrame, pieces: Pieces) -> DataFrame:
    """``encoded`` with ``text``, the decoded ids (bytes that are no UTF-8 become U+FFFD). Null ids: a null text."""
    at = encoded.columns.index("ids")

    def run(batches):
        for b in batches:
            rows = [None if x is None else np.array(x, np.int32) for x in b.column(at).to_pylist()]
            found = iter(pieces.decode([x for x in rows if x is not None]))
            texts = [None if x is None else next(found) for x in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return encoded.mapInArrow(sliced(run), ", ".join(f"`{n}` {t}" for n, t in [*encoded.dtypes, ("text", "string")]))


def round_trip(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip)``: codes, and whether decoding them gives the text."""
    back = encode(docs, pieces, id_col, text_col, back=True)
    decoded = F.sha2(F.col("text").cast("binary"), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("round_trip"))
