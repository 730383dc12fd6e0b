"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, sliced, text_columns

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BITS = 20
#: Slots of all examples of a training sample together.
MAX_SLOTS = 64 << 20
#: Odd multipliers that keep word pairs at distance one and two apart from single words.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: Bytes of a word's beginning that count as a word of their own, so inflected forms share evidence.
STEMS = (5, 7)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Slots of the words, their beginnings, the pairs of neighbours and the pairs with one word between; repeats stay."""
    words = WORD.findall((text or "").encode("utf-8", "replace").lower())
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    stems = [np.fromiter([digest(w[:k]) + k & 0xFFFFFFFFFFFFFFFF for w in words if len(w) > k], np.uint64) for k in STEMS]
    with np.errstate(over="ignore"):
        every = np.concatenate([h * MIX[0], *(s * MIX[1] for s in stems), (h[:-1] * MIX[1]) ^ (h[1:] * MIX[0]), (h[:-2] * MIX[2]) ^ (h[2:] * MIX[0])])
    return (every >> np.uint64(64 - bits)).astype(np.int64)


def fit(examples, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, epochs: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (slots, label), per-coordinate rates; returns the slots with a weight, the weights, the bias.
    L1 leaves most coordinates at exactly zero."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = bias = 0.0
    weights = lambda zi, ni: np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
    for _ in range(epochs):
        for slots, label in examples:
            w = weights(z[slots], n[slots])
            bias = -zb / ((beta + math.sqrt(nb)) / alpha + l2)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + w.sum())))) - label
            sigma = (np.sqrt(n[slots] + g * g) - np.sqrt(n[slots])) / alpha
            z[slots] += g - sigma * w
            n[slots] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * bias
            nb += g * g
    w = weights(z, n)
    at = np.nonzero(w)[0]
    return at, w[at], bias


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 5000, bits: int = BITS, most_slots: int = MAX_SLOTS) -> dict:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, label)``.

    Fitted on a bounded sample, whole texts: of either class the ``per_class`` labelled rows whose hashed id is least.
    The ids are chosen before any text is read. The examples, each a set of slots, are streamed in order of a hash into one
    task, which holds 4 bytes a slot and ``most_slots`` of them at most: the sample ends there if its texts are very long.
    Ids are integers of any width. Null labels, other labels than 0 and 1, and labelled ids without a document are left
    out; an id labelled both ways counts as 1; of rows that repeat an id all are read; very long texts are read whole,
    their features each once; other columns may have any names.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = least_hashed(known, "label", per_class)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # 2 * per_class ids at most

    def slots(batches):
        for b in batches:
            found = [np.unique(features(t, bits)).astype(np.int32).tobytes() for t in b.column(1).to_pylist()]
            order = [xxhash.xxh3_64_intdigest(str(i)) >> 1 for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), b.column(0), b.column(2), pa.array(found, pa.binary())], names=["order", "doc_id", "label", "slots"])

    def learn(batches):
        examples, total = [], 0
        for b in batches:
            for y, s in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                total += len(s.as_buffer()) // 4
                if total <= most_slots:
                    examples.append((np.frombuffer(s.as_buffer(), np.int32).copy(), y))
        if examples:
            at, w, bias = fit(examples, bits)
            yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()]), pa.array([w.tobytes()]), pa.array([bias])], schema=pa.schema([("at", pa.binary()), ("w", pa.binary()), ("bias", pa.float64())]))

    held = sample.mapInArrow(sliced(slots), "order long, doc_id long, label int, slots binary")
    model = held.repartition(1).sortWithinPartitions("order", "doc_id", "label", "slots").mapInArrow(sliced(learn), "at binary, w binary, bias double").first()
    return {"bits": bits, "at": np.frombuffer(model.at, np.int32) if model else np.empty(0, np.int32), "w": np.frombuffer(model.w) if model else np.empty(0), "bias": model.bias if model else 0.0}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)``, one row per row of ``docs``, over whole texts. A text without words has the bias's
    score; null ids and repeated rows are answered row by row; without any label every score is 0.5."""
    weights = docs.sparkSession.sparkContext.broadcast(model)  # L1 keeps few of 2 ** bits coordinates

    def run(batches):
        m = weights.value
        dense = np.zeros(1 << m["bits"])
        dense[m["at"]] = m["w"]
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                f = features(text, m["bits"])
                f = np.unique(f[dense[f] != 0])
                out.append(1 / (1 + math.exp(-max(-35.0, min(35.0, m["bias"] + dense[f].sum())))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], names=["doc_id", "score", "predicted"])

    rows = text_columns(docs, id_col, text_col)
    return rows.mapInArrow(sliced(run), f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")
