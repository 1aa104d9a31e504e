"""Statistics as column expressions and as functions of data frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def wilson(k: Column, n: Column, z: float = 1.96, digits: int = 3) -> tuple[Column, Column, Column]:
    """Proportion with lower and upper bound of Wilson's interval, rounded; n = 0 gives zeros."""
    k, n = k.cast("double"), n.cast("double")
    safe = F.greatest(n, F.lit(1.0))
    p = k / safe
    d = 1 + z * z / safe
    centre = (p + z * z / (2 * safe)) / d
    half = z * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe)) / d
    low = F.greatest(F.lit(0.0), centre - half)
    high = F.least(F.lit(1.0), centre + half)
    return tuple(F.when(n > 0, F.round(x, digits)).otherwise(F.lit(0.0)) for x in (p, low, high))


def with_total(df: DataFrame, by: str, aggregates: list[Column], total: str = "ALL") -> DataFrame:
    """Groups and the pooled total in one pass; null groups are named '(none)'."""
    grouped = df.withColumn(by, F.coalesce(F.col(by), F.lit("(none)"))).rollup(by).agg(F.grouping(by).alias("_all"), *aggregates)
    return grouped.withColumn(by, F.when(F.col("_all") == 1, total).otherwise(F.col(by))).drop("_all")


def auc(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """Area under the ROC curve by tie-averaged ranks: (auc, positives, negatives).

    Scores are counted by value first, so ranks are taken over distinct scores (``placed``); auc is
    null without a positive or a negative. Rows with a null score are left out.
    """
    counted = df.select(score.cast("double").alias("s"), positive.cast("int").alias("y")).where("s is not null and y is not null").groupBy("s").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    ranks = placed(counted.withColumn("held", F.col("n")), [], "s", "held").withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0)
    totals = ranks.agg(F.sum(F.col("p") * F.col("rank")).alias("r"), F.sum("p").alias("pos"), (F.sum("n") - F.sum("p")).alias("neg"))
    return totals.select(
        F.try_divide(F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2.0, F.col("pos").cast("double") * F.col("neg")).alias("auc"),
        F.coalesce("pos", F.lit(0)).cast("bigint").alias("positives"),
        F.coalesce("neg", F.lit(0)).cast("bigint").alias("negatives"),
    )


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters: (n, agreement, expected, kappa); kappa is 1 where
    chance agreement is complete. Rows with a null rating are left out."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("c"))
    sides = pairs.select("c", F.explode(F.array(F.struct(F.col("x").alias("v"), F.col("c").alias("ca"), F.lit(0).cast("bigint").alias("cb")), F.struct(F.col("y").alias("v"), F.lit(0).cast("bigint").alias("ca"), F.col("c").alias("cb")))).alias("s"))
    margins = sides.groupBy("s.v").agg(F.sum("s.ca").alias("ca"), F.sum("s.cb").alias("cb"))
    chance = margins.agg(F.sum(F.col("ca").cast("double") * F.col("cb")).alias("dot"))
    seen = pairs.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("c")).otherwise(0)).alias("same"))
    po = F.try_divide(F.col("same").cast("double"), F.col("n"))
    pe = F.try_divide(F.col("dot"), F.col("n").cast("double") * F.col("n"))
    return seen.crossJoin(F.broadcast(chance)).select(
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), po.alias("agreement"), pe.alias("expected"), F.when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa")
    )


def placed(counted: DataFrame, by: list[str], value: str, count: str, ranges: int = 200) -> DataFrame:
    """``counted`` (a row per group and distinct value, with its count) with upto (rows of
    the group up to this value) and total (rows of the group).

    The values of a group are cut into ranges of about as many distinct values each; a
    sketch gives the limits. Counts are summed inside ranges, and over the ranges before,
    so no group is sorted in one task; the result is exact, whatever the limits are.
    """
    key = [F.col(c) for c in by] or [F.lit(0)]
    rows = counted.withColumn("_g", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)]))
    limits = rows.groupBy("_g").agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_limits"))
    rows = rows.join(limits.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
    rows = rows.withColumn("_range", F.size(F.filter("_limits", lambda x: x < F.col(value)))).drop("_limits")
    held = rows.groupBy("_g", "_range").agg(F.sum(count).alias("_held"))
    before = W.partitionBy("_g").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    held = held.select(F.col("_g").alias("_h"), F.col("_range").alias("_r"), F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"), F.sum("_held").over(W.partitionBy("_g")).alias("total"))
    rows = rows.join(held, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_range") == F.col("_r")))
    inside = W.partitionBy("_g", "_range").orderBy(value)
    return rows.withColumn("upto", F.col("_before") + F.sum(count).over(inside)).drop("_g", "_h", "_r", "_range", "_before")


def ranked_value(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles per group (element floor(share·n) of the sorted values,
    from 0), counted by distinct value so that no group is collected."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    rows = placed(counted, by, value, "c").withColumnRenamed("total", "n")
    at = lambda s: F.least(F.col("n") - 1, F.floor(F.col("n") * s)) + 1
    return rows.groupBy(*by).agg(F.max("n").cast("bigint").alias("n"), *[F.min(F.when(F.col("upto") >= at(s), F.col(value))).alias(name) for name, s in shares.items()])


def mass_by_value(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) of a column, nulls as '(none)'."""
    counted = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(none)")).alias("value")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))
