"""Seeded samples. A shuffle is an order by the digest of seed and key, so a sample is
the same on any cluster; the scan 'take what is not used and below its cap until k'
equals numbering within the cap's key and limiting in that order."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parolumi.functions import text as X
from parolumi.operators import corpus as C
from parolumi.session import written


def capped(pool: DataFrame, key: list[str], cap_by: list[str], cap: int, k: int, seed: str) -> DataFrame:
    """``k`` rows of the pool in seeded order, at most ``cap`` per value of ``cap_by``."""
    ordered = pool.withColumn("_h", X.digest_order(seed, *[F.col(c).cast("string") for c in key]))
    ranked = ordered.withColumn("_r", F.row_number().over(W.partitionBy(*cap_by).orderBy("_h", *key))).where(F.col("_r") <= cap)
    return ranked.orderBy("_h", *key).limit(k).drop("_r")


def stratified(tagged: DataFrame, sizes: dict[str, int], key: list[str], form: str, seed: str) -> DataFrame:
    """Strata in the order of ``sizes``; a row taken by one is not taken by a later one. Of a
    stratum of size k a form is taken at most max(2, k // 8) times. ``tagged`` has a column
    strata (array of names, null or empty for none). Adds stratum and place.

    One pass over ``tagged`` keeps, by stratum and form, as many rows as may be needed: the
    cap and as many as earlier strata can have taken. The strata are then drawn from what
    was kept.
    """
    keys = [F.col(c) for c in key]
    order = ["_h", *key]
    caps = {name: max(2, k // 8) for name, k in sizes.items()}
    earlier = dict(zip(sizes, accumulate([0, *sizes.values()])))
    allowed = F.create_map(*[F.lit(x) for name in sizes for x in (name, caps[name] + earlier[name])])
    rows = tagged.withColumn("stratum", F.explode(F.filter("strata", lambda s: s.isin(*sizes)))).drop("strata")
    rows = rows.withColumn("_h", F.md5(F.concat_ws("::", F.concat(F.lit(seed), "stratum"), *[k.cast("string") for k in keys])))
    ranked = rows.withColumn("_r", F.row_number().over(W.partitionBy("stratum", form).orderBy(*order)))
    kept = ranked.where((F.col("_r") <= max(caps[n] + earlier[n] for n in sizes)) & (F.col("_r") <= allowed[F.col("stratum")])).drop("_r")
    kept = written(kept, "strata")
    used = out = None
    for i, (name, k) in enumerate(sizes.items()):
        free = kept.where(F.col("stratum") == name)
        free = free if used is None else free.join(used, key, "left_anti")
        part = free.withColumn("_r", F.row_number().over(W.partitionBy(form).orderBy(*order))).where(F.col("_r") <= caps[name])
        part = part.orderBy(*order).limit(k).drop("_r").withColumn("_s", F.lit(i))
        # a stratum is small; written, it is not drawn again by the strata after it
        part = written(part, "stratum")
        used = part.select(*key) if used is None else used.unionByName(part.select(*key))
        out = part if out is None else out.unionByName(part)
    # at most the sum of all sizes is numbered here
    return out.withColumn("place", F.row_number().over(W.orderBy("_s", *order)) - 1).drop("_s", "_h")


#: Rows of each stratum of gold words, and phrases.
STRATA = {"A_colloquial": 35, "B_polysemy": 25, "C_lowconf": 35, "D_codeswitch": 20, "E_control": 25}
PHRASES = 20


def word_strata(occurrences: DataFrame, spoken: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """``occurrences`` with the strata each belongs to; ``spoken`` and ``ambiguous`` are tables of forms."""
    forms = spoken.select("form", F.lit(True).alias("_spoken")).distinct().join(ambiguous.select("form", F.lit(True).alias("_ambiguous")).distinct(), "form", "full")
    o = occurrences.join(forms, "form", "left")
    foreign = X.has_latin(F.col("word")) | X.has_cyrillic(F.col("word")) | X.has_digit(F.col("word"))
    rules = {
        "A_colloquial": F.coalesce("_spoken", F.lit(False)) | (F.coalesce("note", F.lit("")) != ""),
        "B_polysemy": F.coalesce("_ambiguous", F.lit(False)) & (F.length("form") <= 4),
        "C_lowconf": F.col("logprob") < -0.4,
        "D_codeswitch": foreign,
        "E_control": F.col("logprob") > -0.02,
    }
    return o.withColumn("strata", F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))).drop("_spoken", "_ambiguous")


def per_category(pool: DataFrame, key: list[str], category: str, video: str, k: int, cap: int, seed: str) -> DataFrame:
    """``k`` rows of each category in seeded order, at most ``cap`` per category and video."""
    h = pool.withColumn("_h", X.digest_order(seed, *[F.col(c).cast("string") for c in key]))
    r = h.withColumn("_r", F.row_number().over(W.partitionBy(category, video).orderBy("_h", *key))).where(F.col("_r") <= cap)
    t = r.withColumn("place", F.row_number().over(W.partitionBy(category).orderBy("_h", *key))).where(F.col("place") <= k)
    return t.drop("_h", "_r")


def quota_sample(pool: DataFrame, key: list[str], kind: str, video: str, targets: dict[str, int], total: int, cap: int, seed: str) -> DataFrame:
    """A number of rows per kind in turn, at most ``cap`` per video over all kinds, topped
    up to ``total`` from all kinds. Each step counts what earlier steps took per video."""
    rows = pool.dropDuplicates(key)
    taken = None
    for i, (name, k) in enumerate([*targets.items(), (None, total)]):
        part = rows if name is None else rows.where(F.col(kind) == name)
        if taken is not None:
            part = part.join(taken.select(*key), key, "left_anti")
            held = taken.groupBy(video).agg(F.count("*").alias("_held"))
            part = part.join(held, video, "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
            if name is None:
                k = max(0, total - taken.count())
        else:
            part = part.withColumn("_held", F.lit(0))
        step = f"{seed}{name or 'rest'}"
        part = part.withColumn("_h", X.digest_order(step, *[F.col(c).cast("string") for c in key]))
        part = part.withColumn("_r", F.row_number().over(W.partitionBy(video).orderBy("_h", *key)) + F.col("_held")).where(F.col("_r") <= cap)
        part = part.orderBy("_h", *key).limit(k).withColumn("step", F.lit(i)).drop("_h", "_r", "_held")
        taken = part if taken is None else taken.unionByName(part)
        taken = written(taken, "quota")
    return taken


def exemplars(rows: DataFrame, shots: int, verdict: str = "verdict", key: str = "id") -> DataFrame:
    """``shots`` judged rows, the first half of them wrong, filled up with right ones, by id."""
    half = shots // 2
    r = rows.where(F.col(verdict).isin("wrong", "correct")).withColumn("_r", F.row_number().over(W.partitionBy(verdict).orderBy(key)))
    r = r.where(F.col("_r") <= shots)
    wrong = r.where((F.col(verdict) == "wrong") & (F.col("_r") <= half))
    right = r.where(F.col(verdict) == "correct").crossJoin(F.broadcast(wrong.agg(F.count("*").alias("_w")))).where(F.col("_r") <= shots - F.col("_w")).drop("_w")
    return wrong.unionByName(right).drop("_r")


def spoken_forms(segments: DataFrame) -> DataFrame:
    """The listed spoken forms and those with three notes or more."""
    spark = segments.sparkSession
    listed = spark.createDataFrame([(x,) for x in C.SPOKEN_FORMS], "form string")
    return C.noted_forms(segments).select("form").union(listed).distinct()


def phrases(segments: DataFrame, spoken: DataFrame, k: int, seed: str) -> DataFrame:
    """``k`` segments with translation and three words or more: two thirds with a spoken
    form, the rest without."""
    s = segments.where((F.coalesce("explanation", F.lit("")) != "") & (F.size("words") >= 3))
    forms = s.select("video_id", "seg_index", F.explode("words").alias("w")).select("video_id", "seg_index", X.form_norm(F.col("w.text")).alias("form"))
    slangy = forms.join(spoken, "form", "left_semi").select("video_id", "seg_index").distinct()
    key = ["video_id", "seg_index"]
    h = X.digest_order(seed, F.col("video_id"), F.col("seg_index").cast("string"))
    a = s.join(slangy, key, "left_semi").withColumn("_h", h).orderBy("_h", *key).limit(k * 2 // 3).withColumn("slang", F.lit(True))
    b = s.join(slangy, key, "left_anti").withColumn("_h", h).orderBy("_h", *key).limit(k - k * 2 // 3).withColumn("slang", F.lit(False))
    return a.unionByName(b).drop("_h")
