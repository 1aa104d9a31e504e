"""Word streams cut into segments, speaker runs and chunks."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parolumi.functions import text as X

# Marks that end a sentence, and the silence in seconds that ends a segment.
SENTENCE_END = "[։?!.…]$"
GAP = 0.8


def spoken_tokens(words: DataFrame) -> DataFrame:
    """Tokens of raw words: no spacing, no audio events, no blank ones."""
    kept = F.col("type").isNull() | F.col("type").isin("word", "punctuation")
    return words.where(kept & (F.trim(F.coalesce("text", F.lit(""))) != "")).withColumn("text", F.trim("text"))


def segments(tokens: DataFrame, stream: list[str], position: str, gap: float = GAP, with_tokens: bool = False) -> DataFrame:
    """Sentence-like segments of token streams.

    ``tokens`` has the stream's columns, a position, text, start_s, end_s, speaker. A segment
    begins after a sentence-ending token, where the speaker changes (null is a speaker
    of its own) or after a silence of ``gap`` seconds or more; a silence with an unknown
    edge has length 0. Columns: the stream's, segment (from 0), start_s, end_s, text, n_words,
    with ``with_tokens`` tokens (array of text, start_s, end_s).
    """
    w = W.partitionBy(*stream).orderBy(position)
    before = lambda c: F.lag(c).over(w)
    silence = F.coalesce(F.col("start_s") - before("end_s"), F.lit(0.0))
    first = F.row_number().over(w) == 1
    breaks = F.when(first, 0).when(before("text").rlike(SENTENCE_END) | ~F.col("speaker").eqNullSafe(before("speaker")) | (F.round(silence, 6) >= gap), 1).otherwise(0)
    marked = tokens.withColumn("_b", breaks).withColumn("segment", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = marked.groupBy(*stream, "segment").agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), "text", "start_s", "end_s"))).alias("t"))
    return parts.select(*stream, F.col("segment").cast("bigint").alias("segment"), F.get("t", F.lit(0))["start_s"].alias("start_s"), F.element_at("t", -1)["end_s"].alias("end_s"), X.detokenized(F.transform("t", lambda x: x["text"])).alias("text"), F.size("t").alias("n_words"), *([F.transform("t", lambda x: x.dropFields("p")).alias("tokens")] if with_tokens else []))


def speaker_name(speaker: Column) -> Column:
    n = F.regexp_extract(speaker, r"^speaker_(\d+)$", 1)
    return F.when(n != "", F.concat(F.lit("Speaker "), (n.cast("int") + 1).cast("string"))).otherwise(speaker)


def speaker_runs(words: DataFrame, stream: list[str], position: str) -> DataFrame:
    """Runs of words by one speaker, with the text of everything between.

    Only tokens of type 'word' (or null) open a run; others join the run before them, leading
    ones are dropped. A word without speaker belongs to speaker_0. Runs without text
    are left out. Columns: the stream's, run (from 1), speaker, text.
    """
    w = W.partitionBy(*stream).orderBy(position)
    own = F.when(F.coalesce("type", F.lit("word")) == "word", F.coalesce("speaker_id", F.lit("speaker_0")))
    s = words.withColumn("_s", F.last(own, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).where("_s is not null")
    s = s.withColumn("_c", F.when(F.col("_s").eqNullSafe(F.lag("_s").over(w)), 0).otherwise(1)).withColumn("run", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = s.groupBy(*stream, "run", "_s").agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.coalesce("text", F.lit("")).alias("t")))).alias("t"))
    text = F.trim(F.array_join(F.transform("t", lambda x: x["t"]), ""))
    return runs.select(*stream, F.col("run").cast("bigint").alias("run"), speaker_name(F.col("_s")).alias("speaker"), text.alias("text")).where("text <> ''")


def cut_points(duration: float, silences: list[float], longest: float) -> list[float]:
    """Where to cut so that no piece is longer than ``longest``: at the latest silence
    that is in reach, else at the limit; positions are exact, results rounded to 3 digits."""
    places = sorted(silences)
    ends = [0.0]
    while ends[-1] + longest < duration:
        limit = ends[-1] + longest
        # the latest silence up to the limit, if it lies behind the last cut
        k = bisect_right(places, limit)
        ends.append(places[k - 1] if k and places[k - 1] > ends[-1] else limit)
    return [round(x, 3) for x in ends[1:]]


def cuts(streams: DataFrame, key: str, duration: str, silences: str, longest: float) -> DataFrame:
    """(key, cuts) of each stream; null durations give no cuts. A stream's silences are one
    array, so the fold over them stays within its row."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "cuts": [cut_points(d, [x for x in (s if s is not None else []) if x is not None], longest) if d is not None and d == d else [] for d, s in zip(f[duration], f[silences])]})

    kind = dict(streams.dtypes)[key]
    return streams.select(key, duration, silences).mapInPandas(run, f"{key} {kind}, cuts array<double>")


def shifted(chunks: DataFrame, start: str, end: str, offset: str) -> DataFrame:
    """Times inside chunks put on the clip's timeline, rounded to 3 digits; unknown stays unknown."""
    return chunks.withColumns({start: F.round(F.col(start) + F.col(offset), 3), end: F.round(F.col(end) + F.col(offset), 3)})
