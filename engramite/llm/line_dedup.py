"""Line deduplication: hashes range-partitioned and sorted, first occurrences streamed, keep bitmaps returned."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut, fresh, sliced, text_columns, text_key

#: ASCII space and the five controls from tab to carriage return.
BLANK = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FLUSH = 50_000


def line_key(line: str) -> str:
    return line.strip(BLANK).translate(LOWER)


def _occurrences(min_chars: int):
    out = pa.schema([("h", pa.binary()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("n_lines", pa.int32()), ("lines", pa.binary())])

    def run(batches):
        rows: list[tuple] = []
        for b in batches:
            for doc, tkey, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if doc is None or text is None:
                    continue
                lines, at = text.split("\n"), {}
                for i, line in enumerate(lines):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        at.setdefault(xxhash.xxh3_128_digest(key.encode("utf-8", "replace")), []).append(i)
                rows += [(h, doc, tkey, len(lines), np.array(p, np.int32).tobytes()) for h, p in at.items()]
                if len(rows) >= FLUSH:
                    yield batch(out, *zip(*rows, strict=True))
                    rows = []
        if rows:
            yield batch(out, *zip(*rows, strict=True))

    return run


SORTED = "h binary, doc_id long, tkey long, n_lines int, lines binary"
VERDICT = f"{SORTED}, n_docs long, sure boolean"


def _verdicts(min_docs: int):
    """Streams one sorted range. Rows that go are sent on with ``sure``; a hash that may have begun in the range before
    (the first) or may go on in the next (the last) has its rows sent without. A row without ``lines`` sums up the
    largest document and the number of documents of a hash already decided here. Held at once: the rows of the
    first ``min_docs - 1`` documents of one hash."""
    out = pa.schema([("h", pa.binary()), ("doc_id", pa.int64()), ("tkey", pa.int64()), ("n_lines", pa.int32()), ("lines", pa.binary()), ("n_docs", pa.int64()), ("sure", pa.bool_())])

    def run(batches):
        send: list[tuple] = []
        now, first, top, last, docs, held = None, True, None, None, 0, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, doc = row[0], row[1]
                if h != now:
                    first = now is None
                    now, top, last, docs, held = h, doc, None, 0, []
                docs += doc != last
                last = doc
                if first:
                    send.append((*row, 1, False))
                elif docs < min_docs:
                    held.append(row)
                else:
                    send += [(*r, 1, True) for r in [*held, row] if r[1] != top]
                    held = []
                if len(send) >= FLUSH:
                    yield batch(out, *zip(*send, strict=True))
                    send = []
        if now is not None and not first:
            send += [(*r, 1, False) for r in held] if docs < min_docs else [(now, top, None, None, None, docs, False)]
        if send:
            yield batch(out, *zip(*send, strict=True))

    return run


def _bitmaps(batches):
    out = pa.schema([("doc_id", pa.int64()), ("tkey", pa.int64()), ("keep", pa.binary())])
    for b in batches:
        keeps = []
        for n, parts in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            bits = np.ones(n, bool)
            bits[np.concatenate([np.frombuffer(p, np.int32) for p in parts])] = False
            keeps.append(zlib.compress(np.packbits(bits).tobytes()))
        yield batch(out, b.column(0), b.column(1), keeps)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(doc_id, tkey, keep)`` for documents that lose a line; ``keep`` is a deflated bitmap of their lines.

    Ids must be integers: the largest one keeps a line. A line's key is the line stripped of ASCII blanks and lower-cased in A-Z. Keys of ``min_chars`` code points or more
    found in ``min_docs`` documents or more lose every line but those of the largest id. Null ids neither count nor
    lose lines; null and empty texts have one empty line; repeated rows of one id count as one document; an empty table
    gives no rows. Equal (hash, id) always share a range, so a hash of a third of all rows spreads over many tasks; the
    hashes at the ranges' ends, two a range, are settled by a broadcast of that size.
    """
    rows = text_columns(docs, id_col, text_col).select("doc_id", text_key().alias("tkey"), "text").mapInArrow(sliced(_occurrences(min_chars)), SORTED)
    ranges = rows.repartitionByRange("h", F.desc("doc_id")).sortWithinPartitions("h", F.desc("doc_id"), "tkey")
    said = cut(ranges.mapInArrow(_verdicts(min_docs), VERDICT))
    open_ = said.where("not sure")
    ends = open_.groupBy("h", "doc_id").agg(F.max("n_docs").alias("n")).groupBy("h").agg(F.sum("n").alias("total"), F.max("doc_id").alias("top")).where(F.col("total") >= min_docs)
    later = open_.where("lines is not null").join(F.broadcast(ends), "h").where("doc_id < top")
    gone = said.where("sure").select("doc_id", "tkey", "n_lines", "lines").union(later.select("doc_id", "tkey", "n_lines", "lines"))
    packed = gone.groupBy("doc_id", "tkey").agg(F.max("n_lines").alias("n_lines"), F.collect_list("lines").alias("parts"))
    return packed.mapInArrow(_bitmaps, "doc_id long, tkey long, keep binary")


# Both joins below build a hash of a partition's bitmaps, a few bytes a document, and stream the texts past it unsorted.


def kept_lines(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """The text that stays, the number of lines before, and how many went."""
    lines = (text or "").split("\n")
    if keep is None:
        return "\n".join(lines), len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).astype(bool)
    stay = [x for x, b in zip(lines, bits, strict=True) if b]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def digests(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of every row of ``docs`` under its bitmap."""
    rows = text_columns(docs, id_col, text_col).withColumn("tkey", text_key())
    both = rows.join(bitmaps.hint("shuffle_hash"), ["doc_id", "tkey"], "left").select("doc_id", "text", "keep")

    def run(batches):
        out = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
        for b in batches:
            found = [kept_lines(t, k) for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield batch(out, b.column(0), [x[1] for x in found], [x[2] for x in found], [hashlib.sha256(x[0].encode("utf-8", "replace")).hexdigest() for x in found])

    return both.mapInArrow(sliced(run), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines gone, all columns kept, whatever their names; a null text stays null."""
    row, bits = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), fresh(docs, "keep_bits")
    keyed = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("tkey"), row)
    both = keyed.join(bitmaps.hint("shuffle_hash"), ["doc_id", "tkey"], "left").select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns), F.col("keep").alias(bits))
    at, names = docs.columns.index(text_col), docs.schema

    def run(batches):
        for b in batches:
            texts = [t if k is None or t is None else kept_lines(t, k)[0] for t, k in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            columns = [b.column(i) if i != at else pa.array(texts, b.schema.field(at).type) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[b.schema.field(i).name for i in range(b.num_columns - 1)])

    return both.mapInArrow(sliced(run), names)
