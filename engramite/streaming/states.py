"""Streaming operators with keyed state of their own: decayed session scores, pattern memory, bounded message history. Each
gives what its batch form gives on the same rows, in whatever order and batches they come, and goes on after a restart."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import text

#: State with map, list and timer columns needs this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _SessionScores(StatefulProcessor):
    """A word's score in its conversation as of the greatest turn that held it: late turns are decayed to it, new ones decay
    what was there. With ``idle_ms``, a score that no event renews for that long in event time is closed and forgotten."""

    def __init__(self, decay: float, idle_ms: int | None):
        self.decay, self.idle_ms = decay, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.score = handle.getValueState("score", "value double, last long")
        self.timer = handle.getValueState("timer", "at long") if self.idle_ms else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        value, last = self.score.get() if self.score.exists() else (0.0, None)
        newest = None
        for frame in rows:
            if self.idle_ms:
                at = int(frame["ts"].max().timestamp() * 1000)
                newest = at if newest is None else max(newest, at)
            for turn, n in sorted(Counter(frame["turn"].tolist()).items()):
                if last is None or turn > last:
                    value, last = value * self.decay ** (turn - last if last is not None else 0), turn
                value += (1 - self.decay) * self.decay ** (last - turn) * n
        if last is None:
            return
        self.score.update((value, int(last)))
        if self.idle_ms:
            due = newest + self.idle_ms
            if self.timer.exists():
                old = self.timer.get()[0]
                due = max(due, old)
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)
            self.timer.update((due,))
        yield pd.DataFrame({"conv_id": [key[0]], "word": [key[1]], "value": [value], "last": [int(last)], "closed": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, last = self.score.get()
        self.score.clear()
        self.timer.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "word": [key[1]], "value": [value], "last": [last], "closed": [True]})


#: Groups that the words of a conversation are dealt to, each with a state of its own.
PARTS = 8


class _PartScores(StatefulProcessor):
    """The scores of a part of a conversation's words, as :class:`_SessionScores` gives them for one: one read and one write
    of state for all of them."""

    def __init__(self, decay: float):
        self.decay = decay

    def init(self, handle) -> None:
        self.scores = handle.getValueState("scores", "words array<string>, sums array<double>, lasts array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {w: (x, n) for w, x, n in zip(*self.scores.get(), strict=True)} if self.scores.exists() else {}
        changed = {}
        for frame in rows:
            for (word, turn), n in sorted(Counter(zip(frame["word"].tolist(), frame["turn"].tolist(), strict=True)).items()):
                value, last = known.get(word, (0.0, turn))
                if turn > last:
                    value, last = value * self.decay ** (turn - last), turn
                known[word] = changed[word] = (value + (1 - self.decay) * self.decay ** (last - turn) * n, last)
        if not changed:
            return
        self.scores.update((list(known), [x for x, _ in known.values()], [n for _, n in known.values()]))
        yield pd.DataFrame({"conv_id": key[0], "word": list(changed), "value": [x for x, _ in changed.values()], "last": [n for _, n in changed.values()], "closed": False})


def session_scores(words: DataFrame, decay: float = 0.9, idle_ms: int | None = None) -> DataFrame:
    """(conv_id, word, value, last, closed) of the stream ``words(conv_id, turn, word)``, with a watermarked ``ts`` if
    ``idle_ms`` is given: what changed in each batch. The key is a conversation and a part of its words, with ``idle_ms``
    each word, as timers are a key's own; so a long conversation spreads.
    Rows without a conversation, turn or word count nowhere. :func:`as_of_last_turn` brings the scores to one turn."""
    kept = words.where("conv_id is not null and turn is not null and word is not null")
    columns = [F.col("conv_id").cast("long").alias("conv_id"), "word", F.col("turn").cast("long").alias("turn"), *(["ts"] if idle_ms else [])]
    out = "conv_id long, word string, value double, last long, closed boolean"
    if idle_ms:
        return kept.select(*columns).groupBy("conv_id", "word").transformWithStateInPandas(_SessionScores(decay, idle_ms), out, "update", "EventTime")
    keyed = kept.select(*columns, F.pmod(F.xxhash64("word"), F.lit(PARTS)).alias("part")).groupBy("conv_id", "part")
    return keyed.transformWithStateInPandas(_PartScores(decay), out, "update", "None")


def as_of_last_turn(scores: DataFrame, decay: float = 0.9) -> DataFrame:
    """(conv_id, word, score): scores decayed to the last turn of their conversation in which any word was said."""
    ends = scores.groupBy("conv_id").agg(F.max("last").alias("end"))
    return scores.join(ends, "conv_id").select("conv_id", "word", (F.col("value") * F.pow(F.lit(decay), F.col("end") - F.col("last"))).alias("score"))


#: Groups that collapsed forms are dealt to, each with a state of its own: a million words are a thousand a group. Fixed for
#: the life of a checkpoint.
FORM_PARTS = 1024
#: Different words that a task counts before it hands them on.
COUNTED = 100_000


class _Patterns(StatefulProcessor):
    """The variants of the collapsed forms of a part: a count each, and of each form the shortest, then first, as its canonical
    spelling. One read and one write of state for all of them."""

    def init(self, handle) -> None:
        self.counts = handle.getValueState("counts", "forms array<string>, words array<string>, ns array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[str, int]] = {}
        for form, word, n in zip(*self.counts.get(), strict=True) if self.counts.exists() else ():
            known.setdefault(form, {})[word] = n
        changed = {}
        for frame in rows:
            for form, word, n in zip(frame["form"].tolist(), frame["word"].tolist(), frame["n"].tolist(), strict=True):
                changed[form] = words = known.setdefault(form, {})
                words[word] = words.get(word, 0) + n
        if not changed:
            return
        every = [(form, word, n) for form, words in known.items() for word, n in words.items()]
        self.counts.update(tuple(map(list, zip(*every, strict=True))))
        canonical = [min(words, key=lambda w: (len(w), w.encode())) for words in changed.values()]
        yield pd.DataFrame({"form": list(changed), "canonical": canonical, "variants": [len(w) for w in changed.values()], "total": [sum(w.values()) for w in changed.values()]})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words of a task, :data:`COUNTED` different ones at a time."""
    told = lambda n: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
    n = Counter()
    for b in batches:
        n.update(b.column(0).to_pylist())
        if len(n) >= COUNTED:
            yield told(n)
            n = Counter()
    if n:
        yield told(n)


def patterns(words: DataFrame) -> DataFrame:
    """(form, canonical, variants, total) of the stream ``words(word)``: pattern memory, what changed in each batch. Null
    words count nowhere. Words are counted before they are shuffled; the key is a part of the forms, as a state of each form's
    own takes some calls from Python for each form of a batch."""
    n = words.where("word is not null").select("word").mapInArrow(_counted, "word string, n long")
    keyed = n.select(text.collapsed(F.col("word")).alias("form"), "word", "n").withColumn("part", F.pmod(F.xxhash64("form"), F.lit(FORM_PARTS)))
    return keyed.groupBy("part").transformWithStateInPandas(_Patterns(), "form string, canonical string, variants long, total long", "update", "None")


class _LastMessages(StatefulProcessor):
    """The messages of greatest turn; the others are let go as newer ones come."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.kept = handle.getListState("kept", "turn long, role string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = list(self.kept.get()) if self.kept.exists() else []
        for frame in rows:
            best += [(int(t), r) for t, r in zip(frame["turn"], frame["role"], strict=True)]
            best = sorted(best, key=lambda x: (-x[0], x[1] or ""))[: self.most]
        self.kept.put(best)
        yield pd.DataFrame({"conv_id": [key[0]] * len(best), "back": range(1, len(best) + 1), "turn": [t for t, _ in best], "role": [r for _, r in best]})


def last_messages(messages: DataFrame, most: int = 60) -> DataFrame:
    """(conv_id, back, turn, role) of the stream ``messages(conv_id, turn, role)``: the last ``most`` of each conversation
    that changed in a batch, 1 the last. A conversation's state never holds more; ties of turn go by role."""
    kept = messages.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role")
    return kept.groupBy("conv_id").transformWithStateInPandas(_LastMessages(most), "conv_id long, back long, turn long, role string", "update", "None")
