"""Words of segments: occurrences, senses, notes, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parolumi.functions import stats, text as X

# Forms of the copula looked at, and glosses that render it or nothing.
COPULA_FORMS = ["է", "ա", "են", "ես", "եմ", "ենք", "եք"]
COPULA_GLOSSES = ["есть", "это", "быть", "являюсь", "являешься", "является", "являемся", "являетесь", "", "-", "—", "суть", "вот", "эти", "этот"]

# Spoken forms aimed at by the colloquial stratum, beside those with notes.
SPOKEN_FORMS = ["ջան", "սենց", "տենց", "սաղ", "էս", "խի", "հլը", "էլի", "ա", "չէ", "բա", "հա", "դե", "նենց", "էնպես", "ոնց", "ապեր", "ախպեր", "տղա", "չնաշ", "մերսի"]


def words(segments: DataFrame, *keep: str) -> DataFrame:
    """A row per word: keys, word_index (from 0) and the word's fields."""
    return segments.select("video_id", "seg_index", *keep, F.posexplode("words").alias("word_index", "w")).select(
        "video_id", "seg_index", *keep, "word_index", F.col("w.text").alias("text"), F.col("w.start_s").alias("start_s"), F.col("w.end_s").alias("end_s"), F.col("w.translation").alias("gloss"), F.col("w.logprob").alias("logprob")
    )


def first_note(notes: Column, word: Column) -> Column:
    """The first note about a word form, or null."""
    return F.get(F.filter(notes, lambda n: X.form_norm(n["word"]) == X.form_norm(word)), 0)


def occurrences(segments: DataFrame) -> DataFrame:
    """Words with text and gloss, their form key, their first note and their segment's texts."""
    w = segments.select("video_id", "seg_index", "handle", F.col("text").alias("seg_text"), F.col("explanation").alias("seg_explanation"), "notes", F.posexplode("words").alias("word_index", "w"))
    w = w.where("coalesce(w.text, '') <> '' and coalesce(w.translation, '') <> ''").withColumn("n", first_note(F.col("notes"), F.col("w.text")))
    return w.select(
        "video_id", "seg_index", "word_index", "handle", "seg_text", "seg_explanation",
        F.col("w.text").alias("word"), X.form_norm(F.col("w.text")).alias("form"), F.col("w.translation").alias("gloss"), F.col("w.logprob").alias("logprob"),
        F.col("w.start_s").alias("start_s"), F.col("w.end_s").alias("end_s"), F.col("n.note").alias("note"), F.col("n.gloss").alias("note_gloss"),
    )


def senses(segments: DataFrame, form: Column | None = None, least_senses: int = 3, least_uses: int = 5) -> DataFrame:
    """(form, senses, uses, glosses) of forms with several glosses; the counter of
    glosses as a map."""
    w = words(segments).select((X.form_norm(F.col("text")) if form is None else form).alias("form"), F.lower(F.trim(F.coalesce("gloss", F.lit("")))).alias("g")).where("form <> '' and g <> ''")
    counts = w.groupBy("form", "g").agg(F.count("*").alias("n"))
    out = counts.groupBy("form").agg(F.count("*").alias("senses"), F.sum("n").alias("uses"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("g", "n")))).alias("glosses"))
    return out.where((F.col("senses") >= least_senses) & (F.col("uses") >= least_uses))


def noted_forms(segments: DataFrame, least: int = 3) -> DataFrame:
    """(form, notes) of forms with ``least`` notes or more."""
    n = segments.select(F.explode("notes").alias("n")).select(X.form_norm(F.col("n.word")).alias("form")).where("form <> ''")
    return n.groupBy("form").agg(F.count("*").alias("notes")).where(F.col("notes") >= least)


def copula_share(segments: DataFrame, top: int = 8) -> DataFrame:
    """(form, n, non_copula_share, top_glosses) of the copula's forms."""
    w = words(segments).where("gloss is not null").select(X.form_norm(F.col("text")).alias("form"), F.lower(F.trim("gloss")).alias("g")).where(F.col("form").isin(COPULA_FORMS))
    counts = w.groupBy("form", "g").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("place", F.row_number().over(W.partitionBy("form").orderBy(F.desc("n"), "g")))
    return ranked.groupBy("form").agg(
        F.sum("n").alias("n"),
        F.round(F.sum(F.when(~F.col("g").isin(COPULA_GLOSSES), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("non_copula_share"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "g")))), lambda x: x["g"]), "|").alias("top_glosses"),
    )


def confidence(word_rows: DataFrame, by: str, low: float = -0.3) -> DataFrame:
    """Mean and median confidence and share of doubtful words by group; the median is
    interpolated between the two middle values."""
    w = word_rows.where("logprob is not null")
    counted = w.groupBy(by, "logprob").agg(F.count("*").alias("c"))
    ranked = stats.placed(counted, [by], "logprob", "c").withColumnRenamed("total", "n")
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("logprob")))
    middle = ranked.groupBy(by).agg(F.max("n").alias("n"), at(F.floor((F.col("n") + 1) / 2)).alias("lo"), at(F.floor(F.col("n") / 2) + 1).alias("hi"), (F.sum(F.col("c") * F.exp("logprob")) / F.max("n")).alias("mean"), (F.sum(F.when(F.col("logprob") < low, F.col("c")).otherwise(0)) / F.max("n")).alias("lowr"))
    vids = w.groupBy(by).agg(F.countDistinct("video_id").alias("videos"))
    return middle.join(vids, by).select(by, "videos", F.col("n").alias("words"), F.round("mean", 6).alias("mean_conf"), F.round(F.exp((F.col("lo") + F.col("hi")) / 2), 6).alias("median_conf"), F.round("lowr", 6).alias("low_conf_rate"))


def profile(word_rows: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of log probabilities and counts of foreign tokens."""
    p = {f"p{int(s * 100):02d}": s for s in (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90)}
    ranks = stats.ranked_value(word_rows, [], "logprob", p)
    kinds = word_rows.agg(F.count("*").alias("words"), F.count_if(X.has_latin(F.col("text"))).alias("latin"), F.count_if(X.has_cyrillic(F.col("text"))).alias("cyrillic"), F.count_if(X.has_digit(F.col("text"))).alias("numeric"))
    return kinds.crossJoin(F.broadcast(ranks.drop("n")))


def validation(segments: DataFrame, least_share: float = 0.9) -> DataFrame:
    """(severity, place, message) of what keeps segments from evaluation."""
    where = F.format_string("%s#%d", "video_id", "seg_index")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    no_words = F.coalesce(F.size("words"), F.lit(0)) <= 0
    found = segments.select(
        where.alias("place"),
        F.array_compact(
            F.array(
                F.when(empty("text"), F.struct(F.lit("error").alias("severity"), F.lit("missing text").alias("message"))),
                F.when(F.col("explanation").isNull(), F.struct(F.lit("error").alias("severity"), F.lit("missing explanation").alias("message"))),
                F.when(no_words, F.struct(F.lit("error").alias("severity"), F.lit("no words").alias("message"))),
                F.when(F.exists("words", lambda w: F.coalesce(w["logprob"] > 0.0001, F.lit(False))), F.struct(F.lit("warning").alias("severity"), F.lit("logprob above 0").alias("message"))),
                F.when(~F.col("video_id").rlike("^[A-Za-z0-9._]+_[0-9]+$"), F.struct(F.lit("warning").alias("severity"), F.lit("video id out of pattern").alias("message"))),
            )
        ).alias("m"),
    )
    each = found.select(F.explode("m").alias("m"), "place").select("m.severity", "place", "m.message")
    w = words(segments).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("gloss"), F.lit("")) != "").alias("g"), F.count("logprob").alias("p"))
    totals = w.select(F.array_compact(F.array(
        F.when(F.col("g") < F.col("n") * least_share, F.struct(F.lit("error").alias("severity"), F.lit("too few glosses").alias("message"))),
        F.when(F.col("p") < F.col("n") * least_share, F.struct(F.lit("warning").alias("severity"), F.lit("too few log probabilities").alias("message"))),
    )).alias("m"))
    return each.unionByName(totals.select(F.explode("m").alias("m")).select("m.severity", F.lit("(all)").alias("place"), "m.message"))
