"""A training-data pipeline over ``documents``: five stages, each one of the operators at work on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.llm import decontaminate, language_id, line_dedup, near_copies, sentencepiece_lattice, simhash
from engramite.llm.common import shared_dir
from engramite.llm.components import merged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go."""
    return language_id.keep_identified(docs, language_id.profiles(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated over documents go from all but one of them; ``n_chars`` follows the text."""
    left = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    return left.withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays. Documents are joined by SimHash fingerprints
    within 2 bits, found by vantage-point trees, and by a Jaccard similarity of 5-word shingles of 0.8 or more, which
    changed words can put beyond any radius that those trees could still prune."""
    return simhash.keep_least(docs, merged(simhash.groups(docs), near_copies.groups(docs)))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)``: each document's piece ids, and whether they decode to its text."""
    pieces = sentencepiece_lattice.Pieces.load()
    back = sentencepiece_lattice.encode(docs, pieces, back=True)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2(F.col("text").cast("binary"), 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("sentencepiece", encode_pieces),
]

#: SQL has no vantage-point trees, n-gram profiles or piece lattices; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
