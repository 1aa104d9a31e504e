"""Accuracy, attribution, operating points, agreement and failures of judged items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parolumi.functions import stats
from parolumi.operators import asr as A, labels as L


def accuracy(rows: DataFrame, by: str) -> DataFrame:
    """Strict and lenient accuracy with Wilson intervals by group and in all."""
    n = F.count("*")
    out = stats.with_total(rows, by, [n.cast("bigint").alias("n"), F.sum(1 - F.col("strict_error")).alias("ks"), F.sum(1 - F.col("lenient_error")).alias("kl")])
    cols = []
    for name, k in (("strict", "ks"), ("lenient", "kl")):
        p, lo, hi = stats.wilson(F.col(k), F.col("n"))
        cols += [p.alias(f"{name}_acc"), lo.alias(f"{name}_lo"), hi.alias(f"{name}_hi")]
    return out.select(by, "n", *cols)


def attribution(rows: DataFrame) -> DataFrame:
    """How many wrong glosses stem from a wrong transcription."""
    wrong = F.count_if(F.col("lenient_error") == 1)
    both = F.count_if((F.col("lenient_error") == 1) & F.col("mistranscribed"))
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if("mistranscribed").alias("n_mistranscribed"),
        wrong.alias("n_errors"),
        both.alias("n_errors_mistranscribed"),
        F.round(F.try_divide(both.cast("double"), wrong), 6).alias("share_of_errors"),
    )


def operating_points(rows: DataFrame, score: str, positive: Column, thresholds: list[float]) -> DataFrame:
    """Flagged rows, precision, recall and coverage of the rule score < threshold; the
    thresholds are columns of one aggregation, so rows are not multiplied."""
    scored = rows.where(F.col(score).isNotNull()).select(F.col(score).alias("s"), positive.cast("int").alias("y"))
    aggs = [F.count("*").alias("n"), F.sum("y").alias("pos")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(F.col("s") < t).alias(f"f{i}"), F.count_if((F.col("s") < t) & (F.col("y") == 1)).alias(f"t{i}")]
    one = scored.agg(*aggs)
    points = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"f{i}").alias("flagged"), F.col(f"t{i}").alias("hits")) for i, t in enumerate(thresholds)])
    return one.select("n", "pos", F.explode(points).alias("p")).select(
        "p.threshold",
        F.col("p.flagged").alias("n_flagged"),
        F.round(F.try_divide(F.col("p.hits").cast("double"), F.col("p.flagged")), 6).alias("precision"),
        F.round(F.try_divide(F.col("p.hits").cast("double"), F.col("pos")), 6).alias("recall"),
        F.round(F.try_divide(F.col("p.flagged").cast("double"), F.col("n")), 6).alias("coverage"),
    )


def confusion(rows: DataFrame, truth: str, said: str) -> DataFrame:
    """(truth, said, n, precision, recall): precision of ``said`` and recall of ``truth`` stand at
    the diagonal; a true 0 stays 0."""
    cells = rows.groupBy(F.col(truth).alias("truth"), F.col(said).alias("said")).agg(F.count("*").alias("n"))
    diagonal = F.col("truth") == F.col("said")
    by = lambda c: F.sum("n").over(W.partitionBy(c))
    return cells.select(
        "truth", "said", "n", F.when(diagonal, F.round(F.col("n") / by("said"), 6)).alias("precision"), F.when(diagonal, F.round(F.col("n") / by("truth"), 6)).alias("recall")
    )


def failures(rows: DataFrame) -> DataFrame:
    """Buckets of the errors, with their share."""
    bucket = L.failure_bucket(F.col("word"), F.col("mistranscribed"), F.col("stratum"), F.col("note"))
    out = rows.where("strict_error = 1").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


def error_examples(rows: DataFrame, k: int = 4) -> DataFrame:
    """The first ``k`` errors of each bucket by id."""
    bucket = L.failure_bucket(F.col("word"), F.col("mistranscribed"), F.col("stratum"), F.col("note"))
    ranked = rows.where("strict_error = 1").withColumn("bucket", bucket).withColumn("place", F.row_number().over(W.partitionBy("bucket").orderBy("id")))
    return ranked.where(F.col("place") <= k).select("bucket", "place", "id", "word", "gloss", F.substring("seg_text", 1, 80).alias("excerpt"))


def arms(rows: DataFrame) -> DataFrame:
    """Accuracy of the shown gloss and of glosses made with and without context, against
    the right meaning, by stratum and in all; rows without a right meaning are left out."""
    gold = L.gold_meaning(F.col("verdict"), F.col("gloss"), F.col("correction"))
    r = rows.withColumn("gold", gold).where("gold is not null")
    ok = {
        "prod": L.glosses_match(F.col("gold"), F.col("gloss")),
        "ctx": L.glosses_match(F.col("gold"), F.concat(F.lit("ctx:"), F.col("word"))),
        "noctx": L.glosses_match(F.col("gold"), F.concat(F.lit("noctx:"), F.col("word"))),
    }
    aggs = [F.round(F.avg(c.cast("int")), 6).alias(f"{name}_acc") for name, c in ok.items()]
    out = stats.with_total(r, "stratum", [F.count("*").alias("n"), *aggs])
    return out.withColumn("context_gain", F.round(F.col("ctx_acc") - F.col("noctx_acc"), 6))


def reproduction(rows: DataFrame) -> DataFrame:
    """A new system's glosses against the judged ones: accuracy, agreement with the old,
    how many wrong ones it fixes, how many right ones it keeps."""
    gold = L.gold_meaning(F.col("verdict"), F.col("gloss"), F.col("correction"), fall_back=True)
    same = L.glosses_match(gold, F.col("candidate")).cast("int")
    right = F.col("verdict") == "correct"
    return rows.where("candidate is not null").agg(
        F.count("*").alias("n"),
        F.round(F.avg(same), 6).alias("accuracy"),
        F.round(F.avg(L.glosses_match(F.col("gloss"), F.col("candidate")).cast("int")), 6).alias("agreement"),
        F.round(F.avg(F.when(~right, same)), 6).alias("fix_rate"),
        F.round(F.avg(F.when(right, same)), 6).alias("keep_rate"),
    )


def sentence_ratings(rated: DataFrame) -> DataFrame:
    """chrF++ of translations by rating and in all: ``rated`` has rating, hypothesis, reference.
    A blank reference means that the translation was accepted as it is. Rows without a rating
    are left out; identical counts translations equal to their reference."""
    ref = F.coalesce(F.nullif(F.trim("reference"), F.lit("")), "hypothesis")
    rows = rated.where(F.coalesce("rating", F.lit("")) != "").select("rating", F.coalesce("hypothesis", F.lit("")).alias("hyp"), F.coalesce(ref, F.lit("")).alias("ref"))
    same = (F.trim("hyp") == F.trim("ref")).cast("int").alias("same")
    scored = A.chrf(rows.select("rating", "hyp", "ref", same), F.col("hyp"), F.col("ref"), ["rating", "same"], digits=1)
    out = stats.with_total(scored, "rating", [F.count("*").alias("n"), F.round(F.avg("chrf"), 1).alias("chrf_mean"), F.sum("same").alias("identical")])
    return out.withColumn("share", F.round(F.col("n") / F.max("n").over(W.partitionBy()), 3))
