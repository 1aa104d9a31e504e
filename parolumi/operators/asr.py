"""Quality and error rates of transcripts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from parolumi.functions import distance as D, stats, text as X

# What stands in a transcript for no output.
PLACEHOLDERS = ["(No output)"]


def named(transcripts: DataFrame) -> DataFrame:
    """Transcripts under one name per model and variant, texts trimmed."""
    return transcripts.withColumn("model", F.concat_ws(".", "model", "variant")).withColumn("text", F.trim(F.coalesce("text", F.lit("")))).drop("variant")


def leaderboard(transcripts: DataFrame, anchor: str) -> DataFrame:
    """Quality of each model without ground truth.

    coverage, empty_rate and loop_rate are shares of its clips; armenian_pct is the mean of
    the clips' script shares; vs_anchor is the upper median, over clips that the anchor
    has a text for, of word edits by anchor words, each rounded to 3 digits; the anchor has none.
    Ordered by coverage, then by nearness to the anchor.
    """
    own = transcripts.withColumn("loop", X.is_loop(F.col("text"))).withColumn("pct", X.script_share(F.col("text")))
    filled = F.col("text") != ""
    base = own.groupBy("model").agg(
        F.count("*").alias("clips"),
        F.round(F.avg(filled.cast("int")), 6).alias("coverage"),
        F.round(F.avg((~filled).cast("int")), 6).alias("empty_rate"),
        F.round(F.avg((filled & F.col("loop")).cast("int")), 6).alias("loop_rate"),
        F.round(F.avg(F.when(filled, F.col("pct"))), 3).alias("armenian_pct"),
    )
    ref = transcripts.where((F.col("model") == anchor) & filled).select("category", "video_id", X.words(X.quality_norm(F.col("text"))).alias("ref"))
    hyp = transcripts.where((F.col("model") != anchor) & filled).select("model", "category", "video_id", X.words(X.quality_norm(F.col("text"))).alias("hyp"))
    far = hyp.join(ref, ["category", "video_id"]).select("model", F.round(D.token_distance(F.col("ref"), F.col("hyp")) / F.greatest(F.lit(1), F.size("ref")), 3).alias("dist"))
    median = stats.ranked_value(far, ["model"], "dist", {"vs_anchor": 0.5}).select("model", "vs_anchor")
    return base.join(median, "model", "left").orderBy(F.desc("coverage"), F.asc_nulls_last("vs_anchor"), "model")


def basics(transcripts: DataFrame) -> DataFrame:
    """The leaderboard without the distance to an anchor."""
    return leaderboard(transcripts, "").drop("vs_anchor")


def error_rates(pairs: DataFrame, ref: Column, hyp: Column, model: str, by: str, infix: bool = False) -> DataFrame:
    """Micro-averaged word and character error rates per model, by group and in all.

    With ``infix`` the reference may be found anywhere inside the hypothesis. Denominators
    are at least 1 per pair and per group.
    """
    rt, ht = X.words(X.wer_norm(ref)), X.words(X.wer_norm(hyp))
    p = pairs.select(model, F.coalesce(F.col(by), F.lit("(none)")).alias(by), rt.alias("rt"), ht.alias("ht"))
    p = p.select(model, by, F.size("rt").alias("words"), F.length(F.array_join("rt", "")).alias("letters"), "rt", "ht")
    if infix:
        p = p.withColumn("e", D.infix_edits(F.array_join("rt", " "), F.array_join("ht", " "))).withColumns({"we": F.col("e.words"), "ce": F.col("e.letters")})
    else:
        p = p.withColumns({"we": D.token_distance(F.col("rt"), F.col("ht")), "ce": F.levenshtein(F.array_join("rt", ""), F.array_join("ht", ""))})
    sums = [F.count("*").alias("pairs"), F.sum("we").alias("we"), F.sum(F.greatest(F.lit(1), F.col("words"))).alias("wn"), F.sum("ce").alias("ce"), F.sum(F.greatest(F.lit(1), F.col("letters"))).alias("cn")]
    out = p.rollup(model, by).agg(F.grouping_id(model, by).alias("g"), *sums).where("g in (0, 1)")
    rate = lambda e, n: F.round(F.col(e) / F.greatest(F.lit(1), F.col(n)), 6)
    return out.select(model, F.when(F.col("g") == 1, "ALL").otherwise(F.col(by)).alias(by), "pairs", rate("we", "wn").alias("wer"), rate("ce", "cn").alias("cer"))


def gate(transcripts: DataFrame, seconds: str) -> DataFrame:
    """Transcripts with the reason why they are unusable, or null."""
    return transcripts.withColumn("reason", X.degenerate(F.col("text"), F.col(seconds)))


def _gram_scores(hyp: list[np.ndarray], ref: list[np.ndarray], orders: int, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Sum of F-beta, and number of orders that both sides are long enough for, of the
    n-grams of two lists of number sequences, all pairs at once."""
    pairs = len(hyp)
    total, known = np.zeros(pairs), np.zeros(pairs, np.int64)
    size = np.array([[len(x) for x in side] for side in (hyp, ref)], np.int64).reshape(2, pairs)
    flat = np.concatenate([*hyp, *ref]) if size.sum() else np.zeros(0, np.int64)
    # position of each symbol from the end of its sequence, and the sequence's number
    owner = np.repeat(np.arange(2 * pairs), size.ravel())
    left = np.cumsum(size.ravel())[owner] - np.arange(len(flat)) if len(flat) else flat
    symbol = np.unique(flat, return_inverse=True)[1] + 1
    gram = np.zeros(len(flat), np.int64)
    for n in range(1, orders + 1):
        ahead = np.concatenate([symbol[n - 1 :], np.zeros(min(n - 1, len(symbol)), np.int64)])
        # numbers of n-grams are made dense again at each order, so they never overflow
        gram = np.unique(gram * (int(symbol.max(initial=0)) + 1) + ahead, return_inverse=True)[1]
        whole = left >= n
        # one cell for each pair and n-gram; the two sides are counted side by side
        cell, at = np.unique((owner[whole] % max(1, pairs)) * (int(gram.max(initial=0)) + 1) + gram[whole], return_inverse=True)
        ours = owner[whole] < pairs
        counts = np.minimum(np.bincount(at[ours], minlength=len(cell)), np.bincount(at[~ours], minlength=len(cell)))
        shared = np.bincount(cell // (int(gram.max(initial=0)) + 1), counts, pairs)
        of_hyp, of_ref = np.maximum(0, size - n + 1)
        both = (of_hyp > 0) & (of_ref > 0)
        total += np.where(both, (1 + beta * beta) * shared / np.maximum(1, beta * beta * of_ref + of_hyp), 0)
        known += both
    return total, known


def chrf_scores(hyps: pd.Series, refs: pd.Series, char_order: int = 6, word_order: int = 2, beta: float = 2.0, letters: int = 2_000_000) -> np.ndarray:
    """Mean F-beta, in percent, over character n-grams (white space removed) and word
    n-grams of each pair; orders for which a side is too short are left out; no order at
    all gives 0. Pairs are taken in slices of about ``letters`` letters, one at least."""
    out = np.zeros(len(hyps))
    upto = np.cumsum(hyps.str.len().fillna(0).to_numpy(np.int64) + refs.str.len().fillna(0).to_numpy(np.int64))
    slices = np.split(np.arange(len(hyps)), np.flatnonzero(np.diff(upto // letters)) + 1)
    for at in slices:
        h, r = hyps.iloc[at], refs.iloc[at]
        bare = lambda side: D.letters_of(side.map(lambda t: "".join((t or "").split())))
        chars, n_chars = _gram_scores(bare(h), bare(r), char_order, beta)
        words, n_words = _gram_scores(*D.numbered(h, r), word_order, beta)
        out[at] = 100.0 * (chars + words) / np.maximum(1, n_chars + n_words)
    return out


def chrf(pairs: DataFrame, hyp: Column, ref: Column, key: list[str], char_order: int = 6, word_order: int = 2, beta: float = 2.0, digits: int = 4) -> DataFrame:
    """chrF++ (``chrf_scores``) of each pair. N-grams are compared in Arrow batches:
    exploded, every pair would become some thousand rows to shuffle."""

    @pandas_udf(T.DoubleType())
    def score(h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(chrf_scores(h, r, char_order, word_order, beta), dtype="float64")

    return pairs.select(*key, F.round(score(hyp, ref), digits).alias("chrf"))


def rank_agreement(board: DataFrame, a: str, b: str) -> DataFrame:
    """Whether two metrics order the models alike, and the correlation of the ranks."""
    r = lambda c: F.row_number().over(W.orderBy(F.asc_nulls_last(c), "model"))
    ranked = board.select("model", r(a).alias("ra"), r(b).alias("rb"))
    return ranked.agg(F.count("*").alias("models"), F.bool_and(F.col("ra") == F.col("rb")).alias("same_order"), F.round(F.corr("ra", "rb"), 6).alias("rank_correlation"))
