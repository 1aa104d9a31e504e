"""The tables of a data folder, each row delivered once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "segments").dropDuplicates(["video_id", "seg_index"])


def gold_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gold_words").dropDuplicates(["id"])


def asr_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "asr_chunks").dropDuplicates(["chunk_id"])


def videos(spark: SparkSession, folder: str) -> DataFrame:
    """One row per id: the latest listing."""
    latest = F.max_by(F.struct("handle", "url", "src", "seg_key", "seg_ver", "published"), F.struct("loaded_at", "seg_ver", "published"))
    return table(spark, folder, "videos").groupBy("id").agg(latest.alias("v")).select("id", "v.*")


def transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per model, variant, category and video: the latest text."""
    t = table(spark, folder, "transcripts")
    return t.groupBy("model", "variant", "category", "video_id").agg(F.max(F.struct("loaded_at", "text")).alias("t")).select("model", "variant", "category", "video_id", F.col("t.text").alias("text"))


# The order of difficulty, and the order in which a video's category is looked up.
DIFFICULTY = ["formal", "single_speaker", "multi_speakers", "songs", "difficult", "songs_difficult"]


def difficulty_order(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(DIFFICULTY)], "category string, ord int")


def video_category(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, category): the first category, in order, that holds the video."""
    rank = F.array_position(F.array(*[F.lit(c) for c in DIFFICULTY]), F.col("category"))
    return table(spark, folder, "transcripts").where(rank > 0).groupBy("video_id").agg(F.min_by("category", rank).alias("category"))
