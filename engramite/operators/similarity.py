"""Exact similarity joins of sets and names, and what they merge into; nothing is compared that can't reach the threshold."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import graph, profile


def _least_overlap(size, measure: str, least: float):
    """How many tokens a set of ``size`` shares at least with any set that is similar enough."""
    part = {"jaccard": least, "cosine": least * least, "dice": least / (2 - least)}[measure]
    return F.ceil(size * part - 1e-9)


#: Sets that are met in one block of a token; those of a token that more hold meet block by block.
BLOCK = 2000


def set_pairs(items: DataFrame, least: float, measure: str = "jaccard") -> DataFrame:
    """(a, b, score), a before b: all pairs of ``items(id, tokens)`` whose token sets have a Jaccard, cosine or Dice
    similarity of ``least`` or more.

    Prefix filter: with the tokens of each set in order of rarity, similar sets share one among their first few, so only
    those are joined, only sets of fitting sizes, and only where what follows the shared token could make up the overlap.
    Sets of a token meet in one task, as numbers and many at once, and what is not similar is let go there: no candidate is written
    or joined again, and a pair is found at the first token that both share only.
    Sets without tokens, null ids and repeats of an id are left out or count once."""
    if not 0 < least <= 1:
        raise ValueError("a threshold above 0, at most 1")
    sets = graph.settled(items.where("id is not null").select("id", F.array_distinct(F.filter("tokens", lambda t: t.isNotNull())).alias("tokens")).where(F.size("tokens") > 0).dropDuplicates(["id"]))
    rare = graph.settled(sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).withColumn("t", F.monotonically_increasing_id()))
    met = sets.select("id", F.explode("tokens").alias("token")).join(rare, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("o"))  # a set's tokens
    ranked = met.select("id", F.transform("o", lambda x: x["t"]).alias("s"), F.size("o").alias("size"))
    # a bit for each token, on where an odd number of them falls: two sets that differ by n tokens differ by n bits at most
    ranked = ranked.withColumn("bits", F.expr("aggregate(s, 0L, (m, t) -> m ^ shiftleft(1L, CAST(pmod(xxhash64(t), 64) AS INT)))"))
    prefix = F.slice("s", F.lit(1), (F.col("size") - _least_overlap(F.col("size"), measure, least) + 1).cast("int"))
    first = graph.settled(ranked.select("id", "s", "size", "bits", F.posexplode(prefix).alias("place", "t")))
    many = first.groupBy("t").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    dealt = first.join(many.drop("n"), "t").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # blocks i <= j of a token meet; a row is in those of its own block and any other
    other = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("t", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "id", "s", "size", "place", "bits")
    spread = max(2 * items.sparkSession.sparkContext.defaultParallelism, math.ceil(first.count() / MET))
    kind = first.schema["id"].dataType.simpleString()
    met = other.repartition(spread, "t", "i", "j").sortWithinPartitions("t", "i", "j").mapInArrow(_meeting(least, measure), f"a {kind}, b {kind}, na int, nb int, shared int")
    na, nb, shared = F.col("na"), F.col("nb"), F.col("shared")
    score = {"jaccard": shared / (na + nb - shared), "cosine": shared / F.sqrt(na.cast("double") * nb), "dice": 2 * shared / (na + nb)}[measure]
    ahead = F.col("a") < F.col("b")
    near = met.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("b"), score.cast("double").alias("score"))
    return near.where(F.col("score") >= least - 1e-12)


#: Rows of sets' beginnings a task; pairs that leave it at once; pairs of tokens that are compared at once.
MET, FOUND, CELLS = 100_000, 20_000, 4_000_000


def _meeting(least: float, measure: str):
    """What a task does with rows ``(t, i, j, own, id, s, size, place, bits)`` in order of t, i and j: the pairs that share t as their
    first token, with their sizes and how many tokens they share, where these may be enough."""

    def needed(na, nb):
        return {"jaccard": lambda: least / (1 + least) * (na + nb), "cosine": lambda: least * np.sqrt(na * nb), "dice": lambda: least / 2 * (na + nb)}[measure]()

    def pairs_of(own, i, j, size, place, bits):
        """Positions of a group's rows that may be alike, each pair once."""
        left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        for at in range(0, len(left), 512):
            a = left[at : at + 512]
            na, nb = size[a][:, None], size[right][None, :]
            least_ = needed(na, nb) - 1e-6
            may = (np.minimum(na - place[a][:, None], nb - place[right][None, :]) >= least_) & (np.bitwise_count(bits[a][:, None] ^ bits[right][None, :]) <= na + nb - 2 * least_)
            if i == j:
                may &= a[:, None] < right[None, :]
            x, y = np.nonzero(may)
            yield a[x], right[y]

    def compared(x, y, lists, size, place):
        """How many tokens the sets of rows x and y share, -1 where another shared token comes before."""
        out = np.empty(len(x), np.int32)
        longest = int(max(size[x].max(), size[y].max()))
        step = max(1, CELLS // longest**2)
        for at in range(0, len(x), step):
            a, b = x[at : at + step], y[at : at + step]
            if step == 1:  # long sets
                u, v = (lists[1][lists[0][r[0]] : lists[0][r[0]] + size[r[0]]] for r in (a, b))
                met = np.isin(u, v, assume_unique=True)[None, :]
            else:
                u, v = (np.where(np.arange(longest) < size[r][:, None], lists[1][np.minimum(lists[0][r][:, None] + np.arange(longest), len(lists[1]) - 1)], none) for r, none in ((a, -1), (b, -2)))
                met = (u[:, :, None] == v[:, None, :]).any(axis=2)
            out[at : at + step] = np.where(met.argmax(axis=1) == place[a], met.sum(axis=1), -1)
        return out

    def run(batches):
        rest = None
        for b in _and_end(batches):
            held = [x for x in (rest, b) if x is not None]
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            rows = table.to_batches()[0] if table.num_rows else None
            if rows is None:
                continue
            key = np.stack([rows.column(c).to_numpy() for c in ("t", "i", "j")])
            begin = np.append(0, np.nonzero((key[:, 1:] != key[:, :-1]).any(axis=0))[0] + 1)
            last = len(key[0]) if b is None else begin[-1]  # the last group may go on
            rest = rows.slice(last) if b is not None else None
            own, size, place, bits = (rows.column(c).to_numpy().astype(np.int64) for c in ("own", "size", "place", "bits"))
            bits = bits.view(np.uint64)  # of a negative number the bits of its absolute value would count
            s = rows.column("s")
            lists = (s.offsets.to_numpy()[:-1].astype(np.int64), s.values.to_numpy())
            found = []
            for g, end in zip(begin, np.append(begin[1:], len(key[0])), strict=True):
                if g < last and end - g > 1:
                    found += [(x + g, y + g) for x, y in pairs_of(own[g:end], key[1, g], key[2, g], size[g:end], place[g:end], bits[g:end]) if len(x)]
            if not found:
                continue
            x, y = (np.concatenate(z) for z in zip(*found, strict=True))
            shared = compared(x, y, lists, size, place)
            keep = shared > 0
            x, y, shared = x[keep], y[keep], shared[keep]
            for at in range(0, len(x), FOUND):
                a, c = x[at : at + FOUND], y[at : at + FOUND]
                yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(a)), rows.column("id").take(pa.array(c)), *(pa.array(z.astype(np.int32)) for z in (size[a], size[c], shared[at : at + FOUND]))], names=["a", "b", "na", "nb", "shared"])

    return run


def _and_end(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def letters(c: Column) -> Column:
    """A name's characters, each with how often it came before: two names share as many as a common subsequence could
    have, so no sequence ratio exceeds the Dice similarity of these."""
    chars = F.filter(F.split(F.lower(c), ""), lambda x: x != "")
    return F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).cast("string")))


#: The least ratio for which names are met by segments, and the longest name that is; names whose segments a task cuts.
SEGMENTS_FROM, LONGEST, NAMES = 0.8, 60, 4000


def _segments(least: float, longest: int) -> tuple[list[tuple], list[tuple]]:
    """(n, key, from, size, left, right, same) of the shorter and of the longer names of length ``n``: where a segment is cut,
    under what key it meets, and how many edits are before and behind it at most."""
    own, tried = [], []
    for long in range(1, longest + 1):
        for short in range(math.ceil(long * least / (2 - least) - 1e-9), long + 1):
            apart = math.floor((1 - least) * (short + long) + 1e-9)
            apart -= (apart - (long - short)) % 2  # characters put in and left out are as odd or even as the lengths differ
            for i in range(apart + 1) if apart > 0 else ():
                at, end = i * short // (apart + 1), (i + 1) * short // (apart + 1)
                of = (end - at, i, apart - i, short == long)
                key = (long * (LONGEST + 1) + short) * (LONGEST + 1) + i
                own.append((short, key, at, *of))
                moves = (m for m in range(-i, i + 1, 2) if abs(long - short - m) <= apart - i)
                tried += [(long, key, at + m, *of) for m in moves if 0 <= at + m and end + m <= long]
    return own, tried


def segment_pairs(names: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs of ``names(name, low)`` whose texts ``low`` have a common subsequence of ``least`` of their mean length
    or more, and some others within that many edits.

    Names of lengths s <= l then differ by at most ``(1 - least) * (s + l)`` characters put in or left out. The shorter one is
    cut into one segment more than that. Counted from the left, the first time that there are fewer edits than segments, the
    segment passed last is whole in the longer name and the i-th of them has just i edits before it, so that it is moved by i at
    most, and the rest behind it. Names meet by such segments, those of a frequent one block by block, and are let go in
    the join where the letters before or behind it differ by more; what is left is compared by the edit distance."""
    fit = names.where(F.char_length("low") <= LONGEST)
    # a number of partitions of its own, as few bytes here are much work
    spread = max(2 * names.sparkSession.sparkContext.defaultParallelism, math.ceil(names.count() / NAMES))
    lows = graph.settled(fit.select("low").distinct().repartition(spread, "low").select("low", F.char_length("low").alias("n")))
    parity = F.expr("transform(sequence(0, n), k -> aggregate(sequence(1, greatest(k, 1)), 0L, (m, i) -> IF(i <= k, m ^ shiftleft(1L, pmod(ascii(substring(low, i, 1)), 32)), m)))")
    sized = lows.select("low", "n", parity.alias("odd"))  # which letters the first 0, 1, ... characters hold an odd number of times
    columns = "n int, key int, from int, size int, left int, right int, same boolean"
    plans = [names.sparkSession.createDataFrame(plan, columns) for plan in _segments(least, lows.agg(F.max("n")).first()[0] or 0)]

    def keyed(plan):
        met = sized.join(F.broadcast(plan), "n")
        part = F.substring("low", F.col("from") + 1, F.col("size"))
        behind = F.get("odd", F.col("n")).bitwiseXOR(F.get("odd", F.col("from") + F.col("size")))
        return met.select(F.xxhash64("key", part).alias("h"), "low", F.shiftleft(F.get("odd", F.col("from")), 32).bitwiseOR(behind).alias("odd"), "left", "right", "same")

    own, tried = keyed(plans[0]), keyed(plans[1]).select("h", "low", "odd")
    many = lambda frame, name: frame.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name)).where(F.col(name) > 1)
    blocks = graph.settled(many(own, "k1").join(many(tried, "k2"), "h", "full").select("h", *(F.coalesce(c, F.lit(1)).alias(c) for c in ("k1", "k2"))))
    keys = ["h"] if blocks.isEmpty() else ["h", "x", "y"]

    def side(frame, c, mine, other, block, blocked):
        if len(keys) > 1:
            dealt = frame.join(blocks, "h", "left").withColumn(block, F.coalesce(F.pmod(F.xxhash64("low"), F.col(mine)).cast("int"), F.lit(0)))
            frame = dealt.withColumn(blocked, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))).drop("k1", "k2")
        return frame.withColumnRenamed("low", f"l{c}").withColumnRenamed("odd", f"odd{c}").repartition(spread, *keys)

    met = side(own, "a", "k1", "k2", "x", "y").join(side(tried, "b", "k2", "k1", "y", "x").hint("merge"), keys)
    far = F.floor((1 - least) * (F.char_length("la") + F.char_length("lb")) + 1e-9)
    odd = F.expr("bit_count(shiftrightunsigned(odda ^ oddb, 32)) <= left AND bit_count((odda ^ oddb) & 4294967295L) <= right AND (NOT same OR la < lb)")
    alike = graph.settled(met.where(odd & (F.levenshtein("la", "lb") <= far)).select("la", "lb").distinct())
    named = lambda c: fit.select(F.col("name").alias(c), F.col("low").alias(f"l{c}"))
    pairs = alike.union(lows.select("low", "low")).join(named("a"), "la").join(named("b"), "lb").where("la <> lb or a < b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar(names: DataFrame, least: float, sep: str = r"\s+", contained: bool = True) -> DataFrame:
    """(a, b, score), both ways: all pairs of ``names(name)`` that are equal ignoring case (1), whose sequence ratio or,
    together with the shared share of their words by ``sep``, its mean with that reaches ``least``; with ``contained``,
    a name within the other counts by the share of lengths where that reaches it. The greatest counts."""
    one = graph.settled(names.where("name is not null and name <> ''").select("name", F.lower("name").alias("low")).distinct())
    lettered = one
    by = [set_pairs(one.select(F.col("name").alias("id"), F.filter(F.array_distinct(F.split("low", sep)), lambda w: w != "").alias("tokens")), least, "jaccard")]
    if least >= SEGMENTS_FROM:
        by.append(segment_pairs(one, least))
        lettered = one.where(F.char_length("low") >= (LONGEST + 1) * least / (2 - least) - 1e-9)  # what can be alike to a longer name
        lettered = lettered if not one.where(F.char_length("low") > LONGEST).isEmpty() else None
    if lettered is not None:
        by.append(set_pairs(lettered.select(F.col("name").alias("id"), letters(F.col("name")).alias("tokens")), least, "dice"))
    found = reduce(DataFrame.union, (x.select("a", "b") for x in by)).distinct()
    found = graph.settled(found.repartition(2 * names.sparkSession.sparkContext.defaultParallelism))  # a pair is few bytes and much work
    both = found.union(found.select("b", "a")).toDF("a", "b")
    la, lb = F.lower("a"), F.lower("b")
    lengths = F.least(F.char_length(la), F.char_length(lb)) / F.greatest(F.char_length(la), F.char_length(lb))
    ratio, words = profile.sequence_ratio(la, lb), text.jaccard(F.col("a"), F.col("b"), sep)
    reach = lambda x: F.when(x >= least, x)
    inside = reach(F.when(la.contains(lb) | lb.contains(la), lengths)) if contained else F.lit(None).cast("double")
    score = F.when(la == lb, 1.0).otherwise(F.coalesce(inside, F.greatest(reach(ratio), F.when(words >= least, reach((ratio + words) / 2)))))
    return both.withColumn("score", score).where("score is not null")


def best_targets(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """(source_name, target_name): of ``pairs(a, b, score)`` each name goes to the most similar one that came before it in
    ``order(name, seq)``, ties to the first name, and on to where that one went. Who came first stays."""
    seq = order.groupBy("name").agg(F.min("seq").alias("seq"))
    at = lambda c: seq.select(F.col("name").alias(c), F.struct("seq", "name").alias(f"s{c}"))
    earlier = pairs.join(at("a"), "a").join(at("b"), "b").where(F.col("sb") < F.col("sa"))
    to = graph.settled(earlier.groupBy("a").agg(F.min_by("b", F.struct(-F.col("score"), F.col("b"))).alias("to")))
    for _ in range(64):
        ahead = to.select(F.col("a").alias("to"), F.col("to").alias("next"))
        jumped = graph.settled(to.join(ahead, "to", "left").select("a", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        to = jumped.select("a", "to")
        if jumped.where("moved").isEmpty():
            return to.toDF("source_name", "target_name")
    raise RuntimeError("targets did not settle")


def trigrams(c: Column) -> Column:
    """A word's runs of three characters, framed by blanks."""
    framed = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(framed) - 2), lambda i: F.substring(framed, i, F.lit(3))))


# --- leaders


def leaders(items: DataFrame, pairs: DataFrame, nearest: bool = False, max_rounds: int = 200) -> DataFrame:
    """(id, leader): what a pass over ``items(id, place)`` in order gives when each item joins the first leader that ``pairs(a,
    b, score)`` says is like it, or with ``nearest`` the likest (ties to the first), and leads itself where there is none.

    Rounds instead of a pass: an item none of whose earlier neighbours is undecided leads, and its later neighbours follow;
    that is the same set of leaders, found in few rounds as chains of ever later neighbours are short. No group of items is
    held by one task; a round is two joins on what is left."""
    place = items.select("id", F.struct("place", "id").alias("at"))
    a, b = place.toDF("a", "pa"), place.toDF("b", "pb")
    ends = pairs.select("a", "b", "score").union(pairs.select("b", "a", "score")).toDF("a", "b", "score").distinct()
    after = graph.settled(ends.join(a, "a").join(b, "b").where(F.col("pb") < F.col("pa")).select("a", "b", "pb", "score"))
    left, open_, heads = graph.settled(items.select("id").distinct()), after, None
    for _ in range(max_rounds):
        if left.isEmpty():
            break
        new = graph.settled(left.join(open_.select(F.col("a").alias("id")).distinct(), "id", "left_anti"))
        gone = open_.join(new.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("a").alias("id")).union(new).distinct()
        heads = new if heads is None else heads.union(new)
        left = graph.settled(left.join(gone, "id", "left_anti"))
        stay = left.select(F.col("id").alias("a"))
        open_ = graph.settled(open_.join(stay, "a", "left_semi").join(stay.toDF("b"), "b", "left_semi").select("a", "b", "pb", "score"))
    else:
        raise RuntimeError(f"leaders did not settle in {max_rounds} rounds")
    heads = heads if heads is not None else items.select("id").limit(0)
    led = after.join(heads.select(F.col("id").alias("b")), "b", "left_semi")
    first = F.struct(-F.col("score"), F.col("pb")) if nearest else F.col("pb")
    follow = led.join(heads.select(F.col("id").alias("a")), "a", "left_anti").groupBy(F.col("a").alias("id")).agg(F.min_by("b", first).alias("leader"))
    return heads.select("id", F.col("id").alias("leader")).union(follow.select("id", "leader"))
