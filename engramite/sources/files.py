"""Files that the store reads and writes: question sets, collections, dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(query, answers) of a file of JSON lines; lines that are no JSON or ask nothing are skipped."""
    rows = spark.read.schema("query string, answers array<string>, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and query is not null").select("query", F.coalesce("answers", F.array().cast("array<string>")).alias("answers"))


def collection(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A Parquet collection under the schema asked for: columns that older files lack are null."""
    return spark.read.schema(columns).parquet(path)


def dump(tables: dict[str, DataFrame], folder: str, mode: str = "error") -> None:
    """Every table of a store as Parquet below ``folder``."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def write_patterns(words: DataFrame, folder: str, mode: str = "append") -> None:
    """``words(category, canonical, word, n)`` as lines of JSON, a word each, so that no line grows with its cluster. What
    was counted later is appended."""
    words.select("category", "canonical", "word", "n").write.mode(mode).json(folder)


def patterns(spark: SparkSession, folder: str) -> DataFrame:
    """(category, word, canonical, n) of a pattern memory: the counts of a word's lines add up, its canonical is the least
    it was given. Lines that are no JSON or lack a word or a canonical are skipped."""
    rows = spark.read.schema("category string, canonical string, word string, n long, _bad string").option("columnNameOfCorruptRecord", "_bad").json(folder)
    good = rows.where("_bad is null and word is not null and canonical is not null")
    return good.groupBy("category", "word").agg(F.min("canonical").alias("canonical"), F.sum(F.coalesce("n", F.lit(0))).alias("n"))


def write_profiles(profiles: DataFrame, folder: str, saved: int, key: str = "user_id", mode: str = "append") -> None:
    """A save of profiles, a line of JSON each: the user's key, the number of the save, the profile itself."""
    rest = [c for c in profiles.columns if c != key]
    profiles.select(F.col(key).cast("string").alias("key"), F.lit(saved).cast("long").alias("saved"), F.to_json(F.struct(*rest)).alias("profile")).write.mode(mode).json(folder)


def profiles(spark: SparkSession, folder: str, columns: str, key: str = "user_id") -> DataFrame:
    """(key, saved, columns): each user's last save. Fields that older profiles lack are null, others are left aside; lines
    without a key or a profile that can be read are skipped."""
    rows = spark.read.schema("key string, saved long, profile string").json(folder).where("key is not null and profile is not null")
    read = rows.withColumn("p", F.from_json("profile", columns, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where("p is not null")
    last = read.groupBy(F.col("key").alias(key)).agg(F.max_by(F.struct("saved", "p"), F.struct("saved", "profile")).alias("s"))
    return last.select(key, "s.saved", "s.p.*")
