"""Text values that were cut off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parolumi.llm import tails
from parolumi.session import written


def limits(values: DataFrame, group: str, value: str = "value", peak: int = 5, measure: Callable[[Column], Column] = F.length) -> DataFrame:
    """(group, size) of lengths at which a group's texts are cut, by ``measure``
    (characters, or bytes with ``F.octet_length``).

    A length is a limit if its different texts are at least ``peak`` times one more
    than a neighbouring length has, on whichever side has more, be it among the next
    four or the next twenty lengths. Lengths that a cut of one limit leaves, for it
    spares whole characters and trims spaces, are no neighbours. Longer texts don't
    matter. The longest lengths in characters are limits, too, if at least ``peak``
    times as many values have them as lengths have in the upper half of the group on
    average (not in bytes, where a limit in characters leaves such a heap).
    """
    sizes = (
        values.select(F.col(group).alias("g"), measure(F.col(value)).alias("size"), F.xxhash64(value).alias("text"))
        .where("size > 0")
        .groupBy("g", "size", "text")
        .agg(F.count("*").alias("n"))
        .groupBy("g", "size")
        .agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    )
    top, line = W.partitionBy("g"), W.partitionBy("g").orderBy("size")
    spared, ends = (1, 4) if measure is F.length else (3, -1)
    near = [F.coalesce(F.sum("texts").over(line.rangeBetween(*sorted((side * (spared + 1), side * (spared + far))))), F.lit(0)) / far for far in (4, 20) for side in (-1, 1)]
    return (
        sizes.withColumn("longest", F.max("size").over(top))
        .withColumn("usual", F.sum(F.when(F.col("size") * 2 >= F.col("longest"), F.col("n")).otherwise(0)).over(top) / (F.col("longest") / 2))
        .withColumn("beside", F.greatest(*near))
        .where(
            (F.col("texts") >= peak * (1 + F.col("beside")))
            | (F.col("n") >= peak * F.greatest(F.lit(1.0), F.col("usual") - F.col("n") / (F.col("longest") / 2))) & (F.col("size") >= F.col("longest") - ends)
        )
        .select(F.col("g").alias("limit_group"), F.col("size").alias("limit_size"))
    )


def truncated(values: DataFrame, key: list[str], group: str, value: str) -> DataFrame:
    """Every non-null value with whether it was cut.

    Columns: the key columns, the group column, size (characters), state, words, last,
    cut (boolean), at_limit (its length in characters or bytes is one at which the group's texts are cut),
    in_word (cut, and the last word occurs nowhere as a whole word). Blank values are
    not cut. A value that lacks nothing but its final mark is not cut. Rows equal
    in key, group and end count once; null keys are kept. ``finish_reason`` and the
    like are not consulted: they are often missing or wrong. Texts are read where
    they lie; only windows and ends are shuffled.
    """
    kept = values.where(F.col(value).isNotNull()).select(*key, group, F.col(value).alias("value"))
    counts = tails.window_counts(kept)
    ends = written(tails.with_tails(kept, [*key, group]).distinct(), "text-ends")
    asked = ends.where(F.col("state").isin("open", "bare", "ellipsis")).select("state", "key1", "key2").distinct().withColumn("end", F.xxhash64("state", "key1", "key2"))
    judged = tails.with_evidence(asked, counts, ["end"]).select("end", F.col("n1").alias("seen"), tails.breaks_off().alias("off"))
    out = ends.withColumn("end", F.xxhash64("state", "key1", "key2")).join(judged, "end", "left")
    for unit, measure in (("size", F.length), ("bytes", F.octet_length)):
        lim = limits(kept, group, measure=measure).select(F.col("limit_group").alias(f"{unit}_group"), F.col("limit_size").alias(f"{unit}_limit"))
        out = out.join(lim, F.col(group).eqNullSafe(F.col(f"{unit}_group")) & (F.col(unit) == F.col(f"{unit}_limit")), "left")
    at_limit = F.col("size_limit").isNotNull() | F.col("bytes_limit").isNotNull()
    cut = F.coalesce("off", F.lit(False)) | (at_limit & (F.col("state") == "bare"))
    in_word = cut & (F.coalesce("seen", F.lit(0)) == 0) & (F.col("state") == "bare")
    return out.select(*key, group, "size", "state", "words", "last", cut.alias("cut"), at_limit.alias("at_limit"), in_word.alias("in_word"))
