"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, least_hashed, sliced, text_columns

#: A run of letters; digits, underscores and the rest separate words.
LETTERS = re.compile(r"[^\W\d_]+")
RANKS = 300


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Packed 1- to 3-grams (21 bits a code point) of the lower-cased, space-framed words, and their counts."""
    words = LETTERS.findall((text or "").lower())
    if not any(c.isalpha() for w in words for c in w):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.unique(np.concatenate([c[c != 32], two, three]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent grams, ties by gram."""
    return keys[np.lexsort((keys, -counts))[:ranks]]


def profiles(labelled: DataFrame, lang_col: str = "lang", per_language: int = 400, ranks: int = RANKS) -> DataFrame:
    """``(lang, gram, rank)`` from ``labelled(doc_id, text, lang)``.

    Fitted on a bounded sample: of each language the ``per_language`` ids that hash least, whole texts.
    The ids are chosen without their texts. Rows without a text, a language or an id teach nothing; copies of a row count
    once, other rows that repeat an id in a language are all read; ties of rank go to the lesser gram; other columns may have any names; an empty table
    gives no profile.
    """
    rows = labelled.select("doc_id", "text", F.col(lang_col).alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    chosen = least_hashed(rows.select("doc_id", "lang").distinct(), "lang", per_language)  # ids, not rows: copies take no place
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").dropDuplicates(["doc_id", "lang", "text"])  # at most per_language ids a language

    def count(batches):
        out = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, n = grams(text)
                yield batch(out, [lang] * len(keys), keys, n)

    counts = sample.select("text", "lang").mapInArrow(sliced(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < ranks).select("lang", "gram", "rank")


class Scorer:
    """Out-of-place distances to all profiles at once. Profiles hold at most ``ranks`` grams a language."""

    def __init__(self, rows: list, ranks: int = RANKS):
        self.langs, self.ranks = sorted({r[0] for r in rows}), ranks
        self.keys = np.array(sorted({r[1] for r in rows}), np.int64)
        self.rank = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)
        for lang, gram, rank in rows:
            self.rank[self.langs.index(lang), np.searchsorted(self.keys, gram)] = rank

    def __call__(self, text: str | None) -> tuple[str, float]:
        keys, counts = grams(text)
        if not len(keys) or not self.langs:
            return "und", 0.0
        top = ranked(keys, counts, self.ranks)
        at = np.searchsorted(self.keys, top)
        at[(at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != top)] = len(self.keys)
        theirs = self.rank[:, at]
        far = np.where(theirs < 0, self.ranks, np.abs(theirs - np.arange(len(top)))).sum(axis=1)
        best = int(far.argmin())
        return self.langs[best], 1.0 - float(far[best]) / (self.ranks * len(top))


def identify(docs: DataFrame, profile: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: int = RANKS) -> DataFrame:
    """``(doc_id, lang_pred, score)``, one row per row of ``docs``, over whole texts.

    ``lang_pred`` is the profile at the least out-of-place distance, ties to the first name; ``score`` is 1 minus that
    distance over its maximum. Null texts, texts without a letter and an empty profile table give ``und`` and 0.
    Repeated rows and null ids are answered row by row. Narrow: no shuffle, memory of one Arrow batch.
    """
    scorer = Scorer([tuple(r) for r in profile.select("lang", "gram", "rank").collect()], ranks)  # ranks rows a language

    def run(batches):
        out = None
        for b in batches:
            out = out or pa.schema([b.schema.field(0), pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())])
            found = [scorer(t) for t in b.column(1).to_pylist()]
            yield batch(out, b.column(0), [x[0] for x in found], [x[1] for x in found])

    kind = dict(docs.dtypes)[id_col]
    return text_columns(docs, id_col, text_col).mapInArrow(sliced(run), f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, profile: DataFrame, text_col: str = "text", ranks: int = RANKS) -> DataFrame:
    """Rows of ``docs``, all columns, except those that :func:`identify` answers with ``und``: null texts and texts without
    a letter, or all rows where there is no profile. Null ids and repeated rows stay like others; columns may have any
    names."""
    scorer = Scorer([tuple(r) for r in profile.select("lang", "gram", "rank").collect()], ranks)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([scorer(t)[0] != "und" for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(sliced(run), docs.schema)
