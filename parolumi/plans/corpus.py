"""Queries over the words of segments, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from parolumi.functions import text as X
from parolumi.operators import corpus as C, labels as L
from parolumi.sources import tables as T

SEG = "with s as (select distinct on (video_id, seg_index) * from segments order by video_id, seg_index, loaded_at), w as (select video_id, seg_index, handle, unnest(range(len(words))) as word_index, unnest(words) as w from s where words is not null)"
_FORM = "regexp_replace(coalesce({0}, ''), '[։՝՜՞,.\\s]+', '', 'g')"
_CATEGORY = "(select video_id, arg_min(category, list_position(['formal','single_speaker','multi_speakers','songs','difficult','songs_difficult'], category)) as category from transcripts where category in ('formal','single_speaker','multi_speakers','songs','difficult','songs_difficult') group by 1)"


def confidence_by_category(spark, d):
    w = C.words(T.segments(spark, d)).join(T.video_category(spark, d), "video_id")
    return C.confidence(w, "category")


def polysemy_forms(spark, d):
    return C.senses(T.segments(spark, d)).select("form", "senses", "uses")


def polysemy_profile(spark, d):
    """The same over forms of which only trailing marks were deleted."""
    return C.senses(T.segments(spark, d), X.profile_norm(F.col("text"))).select("form", "senses", "uses")


def noted_forms(spark, d):
    return C.noted_forms(T.segments(spark, d))


def copula_share(spark, d):
    return C.copula_share(T.segments(spark, d))


def corpus_profile(spark, d):
    return C.profile(C.words(T.segments(spark, d)))


def first_note_match(spark, d):
    return C.occurrences(T.segments(spark, d)).where("note is not null").select("video_id", "seg_index", "word_index", "form", "note", "note_gloss")


def spoken_segments(spark, d):
    """Segments with a spoken form among their words."""
    forms = F.array(*[F.lit(x) for x in C.SPOKEN_FORMS])
    s = T.segments(spark, d)
    return s.where(F.exists("words", lambda w: F.array_contains(forms, X.form_norm(w["text"])))).select("video_id", "seg_index")


def claim_type_rates(spark, d):
    """Rates of the offline judge's verdicts on notes by type of claim and in all."""
    from parolumi.functions import stats

    n = T.segments(spark, d).select(F.explode("notes").alias("n")).where("coalesce(n.note, '') <> '' and coalesce(n.word, '') <> ''")
    rows = n.select(L.claim_type(F.col("n.note")).alias("claim_type"), L.note_judge(F.col("n.note")).alias("v"))
    rate = lambda v: F.round(F.avg((F.col("v") == v).cast("int")), 6).alias(f"{v}_rate")
    return stats.with_total(rows, "claim_type", [F.count("*").alias("n"), rate("correct"), rate("partial"), rate("wrong")])


def validator_report(spark, d):
    return C.validation(T.segments(spark, d))


def normaliser_table(spark, d):
    """Every distinct gold word under the five normalisers."""
    w = F.col("word")
    return T.gold_words(spark, d).where("word is not null").select("word").distinct().select(
        "word", F.array_join(X.words(X.wer_norm(w)), " ").alias("wer"), F.array_join(X.words(X.quality_norm(w)), " ").alias("quality"), X.form_norm(w).alias("form"), X.gloss_norm(w).alias("gloss"), X.profile_norm(w).alias("profile")
    )


def handle_totals(spark, d):
    """Segments and words by handle, largest first by count, then by name."""
    s = T.segments(spark, d).select(F.coalesce("handle", F.lit("(none)")).alias("handle"), F.coalesce(F.size("words"), F.lit(0)).alias("n"))
    return s.groupBy("handle").agg(F.count("*").alias("segments"), F.sum("n").alias("words")).orderBy(F.desc("segments"), "handle")


QUERIES = {f.__name__: f for f in (confidence_by_category, polysemy_forms, polysemy_profile, noted_forms, copula_share, corpus_profile, first_note_match, spoken_segments, claim_type_rates, validator_report, normaliser_table, handle_totals)}

_SENSES = SEG + ", k as (select {form} as form, lower(trim(coalesce(w.translation, ''))) as g from w), c as (select form, g, count(*) as n from k where form <> '' and g <> '' group by 1, 2) select form, count(*)::BIGINT as senses, sum(n)::BIGINT as uses from c group by 1 having count(*) >= 3 and sum(n) >= 5"
_TRAIL = "trim(regexp_replace(coalesce(w.text, ''), '[։,.\\s]+$', ''))"
_COPULA = ", ".join(f"'{x}'" for x in C.COPULA_FORMS)
_GLOSSES = ", ".join(f"'{x}'" for x in C.COPULA_GLOSSES)
_CLAIM = "case " + " ".join(f"when regexp_matches(lower(n.note), '{p}') then '{k}'" for k, p in L.CLAIMS) + " else 'other' end"
_NORM = "trim(regexp_replace(replace(regexp_replace(lower(word), '{0}', ' ', 'g'), 'եւ', 'և'), '\\s+', ' ', 'g'))"

ORACLES = {
    "confidence_by_category": SEG
    + f", c as {_CATEGORY}, x as (select category, video_id, w.logprob as lp from w join c using (video_id) where w.logprob is not null) select category, count(distinct video_id)::BIGINT as videos, count(*)::BIGINT as words, round(avg(exp(lp)), 6) as mean_conf, round(exp(quantile_cont(lp, 0.5)), 6) as median_conf, round(avg((lp < -0.3)::INT), 6) as low_conf_rate from x group by 1",
    "polysemy_forms": _SENSES.format(form=_FORM.format("w.text")),
    "polysemy_profile": _SENSES.format(form=_TRAIL),
    "noted_forms": SEG + f", n as (select unnest(notes) as n from s) select {_FORM.format('n.word')} as form, count(*)::BIGINT as notes from n where {_FORM.format('n.word')} <> '' group by 1 having count(*) >= 3",
    "copula_share": SEG
    + f", k as (select {_FORM.format('w.text')} as form, lower(trim(w.translation)) as g from w where w.translation is not null), c as (select form, g, count(*) as n, row_number() over (partition by form order by count(*) desc, g) as p from k where form in ({_COPULA}) group by 1, 2) select form, sum(n)::BIGINT as n, round(sum(case when g in ({_GLOSSES}) then 0 else n end)::DOUBLE / sum(n), 6) as non_copula_share, string_agg(g, '|' order by p) filter (where p <= 8) as top_glosses from c group by 1",
    "corpus_profile": SEG
    + ", x as (select list_sort(list(w.logprob) filter (where w.logprob is not null)) as l, count(*)::BIGINT as words, count_if(regexp_matches(w.text, '[A-Za-z]'))::BIGINT as latin, count_if(regexp_matches(w.text, '[А-Яа-яЁё]'))::BIGINT as cyrillic, count_if(regexp_matches(w.text, '\\p{Nd}'))::BIGINT as numeric from w) select words, latin, cyrillic, numeric, "
    + ", ".join(f"l[least(len(l) - 1, floor(len(l) * {s})::BIGINT) + 1] as p{int(s * 100):02d}" for s in (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90))
    + " from x",
    "first_note_match": SEG
    + f", o as (select w.video_id, w.seg_index, word_index::INT as word_index, {_FORM.format('w.w.text')} as form, list_filter(s.notes, lambda n: {_FORM.format('n.word')} = {_FORM.format('w.w.text')})[1] as n from w join s using (video_id, seg_index) where coalesce(w.w.text, '') <> '' and coalesce(w.w.translation, '') <> '') select video_id, seg_index, word_index, form, n.note as note, n.gloss as note_gloss from o where n.note is not null",
    "spoken_segments": SEG + f" select distinct video_id, seg_index from w where {_FORM.format('w.text')} in ({', '.join(chr(39) + x + chr(39) for x in C.SPOKEN_FORMS)})",
    "claim_type_rates": SEG
    + f", n as (select unnest(notes) as n from s), v as (select {_CLAIM} as c, length(n.note) as len from n where coalesce(n.note, '') <> '' and coalesce(n.word, '') <> ''), j as (select c, case when len % 9 = 0 then 'wrong' when len % 5 = 0 then 'partial' else 'correct' end as v from v) select case when grouping(c) = 1 then 'ALL' else c end as claim_type, count(*)::BIGINT as n, round(avg((v = 'correct')::INT), 6) as correct_rate, round(avg((v = 'partial')::INT), 6) as partial_rate, round(avg((v = 'wrong')::INT), 6) as wrong_rate from j group by rollup(c)",
    "validator_report": SEG
    + """, p as (select video_id || '#' || seg_index as place, * from s), t as (select count(*) as n, count_if(coalesce(w.translation, '') <> '') as g, count(w.logprob) as lp from w)
 select 'error' as severity, place, 'missing text' as message from p where coalesce(text, '') = '' union all select 'error', place, 'missing explanation' from p where explanation is null union all select 'error', place, 'no words' from p where coalesce(len(words), 0) = 0
 union all select 'warning', place, 'logprob above 0' from p where len(list_filter(words, lambda w: w.logprob > 0.0001)) > 0 union all select 'warning', place, 'video id out of pattern' from p where not regexp_matches(video_id, '^[A-Za-z0-9._]+_[0-9]+$')
 union all select 'error', '(all)', 'too few glosses' from t where g < n * 0.9 union all select 'warning', '(all)', 'too few log probabilities' from t where lp < n * 0.9""",
    "normaliser_table": "select distinct word, "
    + _NORM.format("[։՝՜՞՛''’,.\\-—«»…:;!?]")
    + " as wer, "
    + _NORM.format("[։՝՜՛''’,.\\-—«»…:;!?]")
    + f" as quality, {_FORM.format('word')} as form, lower({_FORM.format('word')}) as gloss, trim(regexp_replace(word, '[։,.\\s]+$', '')) as profile from gold_words where word is not null",
    "handle_totals": SEG + " select coalesce(handle, '(none)') as handle, count(*)::BIGINT as segments, sum(coalesce(len(words), 0))::BIGINT as words from s group by 1",
}
