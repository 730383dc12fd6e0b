"""Token counts behind a digest cache: a text is looked up by the digests of its content and of the tokenizer, only
distinct misses are encoded, and their counts are appended to the cache."""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, by_bytes, cut, drop_dir, shared_dir, small_batches, table

#: A tokenizer's file goes to every worker, up to this size.
MODEL_BYTES = 64 << 20
#: Up to this many missing digests, 32 bytes each, are sent to every task to pick their texts; more meet by a shuffle.
BROADCAST_DIGESTS = 100_000
#: Texts beyond this many characters are encoded in parts where the tokenizer allows it.
PART = 1 << 20

COUNTS = "digest binary, n_tokens long"
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


class Tokenizer:
    """A tokenizer's file and what it is known by: the digest of its bytes, its library and the library's version."""

    def __init__(self, path: str):
        if os.path.getsize(path) > MODEL_BYTES:
            raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
        with open(path, "rb") as f:
            self.data = f.read()
        self.library = "sentencepiece" if path.endswith(".model") else "tokenizers"
        self.digest = hashlib.sha256(f"{self.library} {version(self.library)}\n".encode() + self.data).hexdigest()


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(text: str, most: int) -> list[str]:
    """``text`` cut before single spaces between ASCII letters, about every ``most`` characters: a byte-level splitter
    begins a word there in any case, so the counts of the parts add up."""
    out, start = [], 0
    while len(text) - start > most and (found := _CUT.search(text, start + most)):
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


@lru_cache(maxsize=4)
def _counter(library: str, data: bytes):
    """A function from texts to their numbers of tokens; one a worker."""
    if library == "sentencepiece":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
    import tokenizers

    words = tokenizers.Tokenizer.from_str(data.decode())
    words.no_truncation()
    words.no_padding()
    encode = lambda texts: [len(x) for x in words.encode_batch_fast(texts, add_special_tokens=False)]
    said = json.loads(data)
    pre, added = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
    if said.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(" " in a["content"] for a in added):
        return encode

    def count(texts: list[str]) -> list[int]:
        split = [parts(t, PART) if len(t) > PART else [t] for t in texts]
        short = iter(encode([p[0] for p in split if len(p) == 1]))
        return [next(short) if len(p) == 1 else sum(encode([x])[0] for x in p) for p in split]

    return count


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def stored(spark: SparkSession, cache: str, tokenizer: Tokenizer) -> DataFrame:
    """``(digest, n_tokens)`` of one tokenizer. Two runs that appended at once may have stored a digest twice, with the
    same count; it is answered once."""
    at = f"{cache.rstrip('/')}/tokenizer={tokenizer.digest}"
    if not _exists(spark, at):
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(at).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def plain(text: Column) -> Column:
    """Content as it is counted: null is empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def count_tokens(docs: DataFrame, cache: str, tokenizer: Tokenizer, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", normalise=plain) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per row of ``docs``, over whole texts; the counts of texts that
    ``cache`` lacks are appended to it.

    ``cache`` is a folder that driver and executors share: Parquet below ``tokenizer=<digest>``, a row a content digest
    (SHA-256). ``normalise`` maps the text column to the content that is digested and counted; it must not give null.
    Counts are those of the tokenizer's library without begin, end or other added tokens, truncation or padding; special
    strings inside texts are read as its default does. A null text is empty: no bytes, no tokens. Null ids and repeated
    rows are answered row by row; copies of a text are encoded once; an empty table gives no rows and leaves the cache as
    it is; other columns may have any names. A text beyond ``PART`` characters is counted in parts by byte-level
    tokenizers and whole by others.

    A text is shuffled only if it is missing from the cache, copies combined in the tasks first. A run that fails has
    appended all of its misses or none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = normalise(F.col(f"`{text_col}`"))
    digest = F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    keyed, keyed_at = table(docs.select(F.col(f"`{id_col}`").alias("doc_id"), digest, F.octet_length(text).cast("long").alias("n_bytes")), "token-keys")
    missing, missing_at = table(keyed.select("digest").distinct().join(stored(spark, cache, tokenizer), "digest", "left_anti"), "token-misses")
    n = missing.count()
    if n:
        texts = docs.select(digest, text.alias("text"))
        if n <= BROADCAST_DIGESTS:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            texts = texts.dropDuplicates(["digest"]).join(missing.hint("shuffle_hash"), "digest", "left_semi")
        model = spark.sparkContext.broadcast((tokenizer.library, tokenizer.data))

        def run(batches):
            out = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])
            count = _counter(*model.value)
            for b in batches:
                yield batch(out, b.column(0), count(b.column(1).to_pylist()))

        texts.mapInArrow(by_bytes(run, 1, 1 << 20), COUNTS).write.mode("append").parquet(f"{cache.rstrip('/')}/tokenizer={tokenizer.digest}")
        model.destroy()
    # settled, so that both sides of the last join are plain exchanges and Spark splits a digest that many rows have
    counts, counts_at = table(stored(spark, cache, tokenizer).join(keyed.select("digest").distinct(), "digest", "left_semi"), "token-counts")
    found = cut(keyed.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
    for path in (keyed_at, missing_at, counts_at):
        drop_dir(spark, path)
    return found


def count_once(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """:func:`count_tokens` with a cache of its own that goes afterwards."""
    spark = docs.sparkSession
    cache = shared_dir(spark, "token-cache")
    found = count_tokens(docs, cache, tokenizer)
    drop_dir(spark, cache)
    return found
