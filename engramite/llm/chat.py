"""Reply trees to chat-formatted conversations, with a reversible template and a loss mask."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, cut, drop_dir, small_batches, table

#: Control strings of the template and of common chat formats. Inside a text each gets a backslash after its first
#: character, one more than it has; reading takes it away again.
CONTROL = r"(?:/?s>|\|[a-z_]+\|>|/?SYS>>)"
ESCAPE = re.compile(rf"(<)(\\*)(?={CONTROL})|(\[)(\\*)(?=/?INST\])")
UNESCAPE = re.compile(rf"(<)\\(\\*)(?={CONTROL})|(\[)\\(\\*)(?=/?INST\])")
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: f"{m[1] or m[3]}\\{m[2] or m[4] or ''}", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: f"{m[1] or m[3]}{m[2] or m[4] or ''}", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn as the template writes it, and its loss mask (start, end) within it; an empty mask but for assistants."""
    head = f"{START}{role.replace('%', '%25').replace(chr(10), '%0A').replace('<', '%3C')}\n"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + (len(body) if role == "assistant" else 0)


def best_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """``(conv, leaf, rank, node, depth)``: the nodes of the ``best`` root-to-leaf paths of each reply tree.

    ``messages(conv, node, parent, score)``, nodes unique within a conversation; a null conversation is one like any other,
    rows without a node are on no path. Branches are ranked by the sum of their scores, then depth, then the lesser leaf. Paths come from iterative self-joins that double the length of the
    pointers, so a chain of n turns takes log2(n) rounds, each written to the shared folder. A parent that is missing
    makes a root; nodes on a cycle have no root and are on no path; an empty table gives no rows.
    """
    spark = messages.sparkSession
    nodes = messages.where("node is not null").select("conv", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("conv").alias("c"), F.col("node").alias("p")).distinct()
    linked = nodes.join(known, nodes.conv.eqNullSafe(F.col("c")) & (nodes.parent == F.col("p")), "left")
    now, path = table(linked.select("conv", "node", F.col("p").alias("up"), F.when(F.col("p").isNotNull(), 1).otherwise(0).cast("long").alias("depth"), "score"), "chat-round")
    first, rounds, steps, spent = now, 0, [], [path]
    most = max(1, (now.groupBy("conv").count().agg(F.max("count")).first()[0] or 0).bit_length() + 1)
    while now.where("up is not null").limit(1).count() and rounds < most:
        steps.append(now.select("conv", "node", "up"))
        far = now.select(F.col("conv").alias("c"), F.col("node").alias("p"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        open_ = now.where("up is not null")  # nodes whose root is known have nothing left to join
        join = open_.join(far, open_.conv.eqNullSafe(far.c) & (open_.up == far.p), "left")
        longer = join.select("conv", "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"))
        now, path = table(longer.union(now.where("up is null").select("conv", "node", "up", "depth", "score")), "chat-round")
        spent.append(path)
        rounds += 1
    rooted = now.where("up is null")
    parents = first.where("up is not null").select(F.col("conv").alias("c"), F.col("up").alias("p")).distinct()
    leaves = rooted.join(parents, rooted.conv.eqNullSafe(parents.c) & (rooted.node == parents.p), "left_anti")
    order = Window.partitionBy("conv").orderBy(F.desc("score"), F.desc("depth"), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("conv")))
    chosen = cut(ranked.where(F.col("rank") <= best).select("conv", F.col("node").alias("leaf"), "rank", "n"))
    # a tree of one leaf is its path; of the others, the leaf's ancestors are gathered by the doubled pointers
    plain = rooted.join(chosen.where("n = 1").select(F.col("conv").alias("c"), "leaf", "rank"), F.col("conv").eqNullSafe(F.col("c"))).select("conv", "leaf", "rank", "node", "depth")
    on = cut(chosen.where("n > 1").select("conv", "leaf", "rank", F.col("leaf").alias("node")))
    if on.limit(1).count():
        for step in steps:
            s = step.select(F.col("conv").alias("c"), F.col("node").alias("p"), "up")
            on = cut(on.union(on.join(s, on.conv.eqNullSafe(F.col("c")) & (on.node == F.col("p"))).where("up is not null").select("conv", "leaf", "rank", F.col("up").alias("node"))).distinct())
    depth = rooted.select(F.col("conv").alias("c"), F.col("node").alias("p"), "depth")
    found = cut(plain.union(on.join(depth, on.conv.eqNullSafe(F.col("c")) & (on.node == F.col("p"))).select("conv", "leaf", "rank", "node", "depth")))
    for path in spent:
        drop_dir(spark, path)
    return found


FORMATTED = "conv long, rank int, seq long, piece string, mask_start int, mask_end int"


def first_of_nodes(messages: DataFrame) -> DataFrame:
    """One row a conversation and node of ``messages``: the first by parent, score, role and text."""
    order = Window.partitionBy("conv", "node").orderBy("parent", "score", "role", "text")
    return messages.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def format_paths(messages: DataFrame, best: int = 1, unique: bool = False) -> DataFrame:
    """``FORMATTED``: each chosen path as one conversation, in pieces by ``seq``; their concatenation is the formatted text.

    ``messages(conv, node, parent, score, role, text)``; a null role or text is empty, a null conversation one like any
    other, rows without a node are left out; of rows that repeat a node the first counts, by parent, score, role and text
    (``unique`` says that none do); other columns may have any names. A conversation is streamed turn by turn in sorted
    order, never gathered, so one that holds a third of all rows takes no more memory than a batch of turns: 512 rows in
    the JVM, 2 MB or one turn in Python.
    """
    small_batches(messages.sparkSession)
    messages = messages.select("conv", "node", "parent", "score", "role", "text").where("node is not null")
    messages = messages if unique else first_of_nodes(messages)
    paths = best_paths(messages, best).select(F.col("conv").alias("c"), "rank", F.col("node").alias("p"), "depth")
    texts = messages.select("conv", "node", "role", "text")
    turns = texts.join(paths, texts.conv.eqNullSafe(F.col("c")) & (texts.node == F.col("p"))).select("conv", "rank", "depth", "role", "text")

    def run(batches):
        for b in batches:
            made = [render(r or "", t or "") for r, t in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            columns = list(zip(*made, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["conv", "rank", "seq", "piece", "mask_start", "mask_end"])

    return turns.repartition("conv", "rank").sortWithinPartitions("conv", "rank", "depth").mapInArrow(by_bytes(run, 4), FORMATTED)


class _Reader:
    """Reads one formatted conversation as it streams by."""

    def __init__(self):
        self.have, self.turns, self.loss = "", hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def feed(self, piece: str, mask: tuple[int, int]) -> None:
        self.chars += len(piece)
        self.have += piece
        while (end := self.have.find(END)) >= 0:
            turn, self.have = self.have[:end], self.have[end + len(END) :]
            role, _, body = turn.removeprefix(START).partition("\n")
            role = role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")
            self.turns.update(f"{role}\n{unescape(body)}\n".encode("utf-8", "replace"))
            self.n += 1
        if mask[1] > mask[0]:
            text = unescape(piece[mask[0] : mask[1]])
            self.loss.update(text.encode("utf-8", "replace"))
            self.loss_chars += len(text)


READ = "conv long, rank int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """``READ``: what the formatted conversations say, parsed from their pieces in order. ``formatted`` is dealt and
    sorted by conversation already, as :func:`format_paths` leaves it."""

    def run(batches):
        key, reader, out = None, None, []
        row = lambda: (*key, reader.n, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars)
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        send = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for conv, rank, _, piece, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (conv, rank) != key:
                    if reader:
                        out.append(row())
                    key, reader = (conv, rank), _Reader()
                reader.feed(piece, (start, end))
            if len(out) > 1000:
                yield send()
                out = []
        if reader:
            out.append(row())
        if out:
            yield send()

    return formatted.mapInArrow(by_bytes(run, 3), READ)


def linear(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of turns as reply trees of one branch each: every row answers the one before it, by turn, then role and
    text where turns repeat. Repeated rows stay rows; null conversation ids are one conversation, turns without a number
    come first."""
    own = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    own = own.withColumn("conv", F.coalesce("conv", F.lit(-(2**63))))
    order = Window.partitionBy("conv").orderBy("turn", "role", F.sha2(F.col("text").cast("binary"), 256))
    numbered = cut(own.select("conv", "turn", "role", "text", F.row_number().over(order).cast("long").alias("node")))
    return numbered.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")
