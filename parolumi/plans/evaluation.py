"""Queries over judged gold words, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parolumi.functions import stats
from parolumi.operators import evaluation as E, labels as L
from parolumi.sources import tables as T

THRESHOLDS = [-0.2, -0.3, -0.4, -0.5, -0.7, -1.0]


def rows(spark: SparkSession, d: str) -> DataFrame:
    items = T.gold_words(spark, d)
    return items.join(L.judged(L.word_labels(items)), "id")


GOLD = """with g as (select distinct * from gold_words), u as (
  select *, ('0x' || substr(md5('7::' || id), 1, 8))::BIGINT / 4294967296.0 as u, ('0x' || substr(md5('7m::' || id), 1, 8))::BIGINT / 4294967296.0 as m,
    least(0.85, 0.06 + least(0.5, greatest(0.0, -coalesce(logprob, 0.0)) * 0.35) + case stratum when 'A_colloquial' then 0.18 when 'D_codeswitch' then 0.22 when 'B_polysemy' then 0.10 when 'C_lowconf' then 0.15 else 0.0 end) as p from g),
 l as (select *, case when u < p * 0.6 then 'wrong' when u < p then 'acceptable' when u > 0.985 then 'unsure' else 'correct' end as verdict, (coalesce(logprob, 0.0) < -0.6 and m < 0.5) as mistranscribed from u),
 r as (select *, case when verdict in ('wrong','acceptable') then 'fix:' || coalesce(gloss, '') else '' end as correction, (verdict in ('wrong','acceptable'))::INT as strict_error, (verdict = 'wrong')::INT as lenient_error from l where verdict <> 'unsure')
"""

_WILSON = """round({k}/n,3) as {name}_acc,
 round(greatest(0.0, ({k}/n + 3.8416/(2*n))/(1+3.8416/n) - 1.96*sqrt({k}/n*(1-{k}/n)/n + 3.8416/(4*n*n))/(1+3.8416/n)),3) as {name}_lo,
 round(least(1.0, ({k}/n + 3.8416/(2*n))/(1+3.8416/n) + 1.96*sqrt({k}/n*(1-{k}/n)/n + 3.8416/(4*n*n))/(1+3.8416/n)),3) as {name}_hi"""


def _accuracy_sql(by: str) -> str:
    return GOLD + f""", a as (select case when grouping(b) = 1 then 'ALL' else b end as {by}, count(*)::DOUBLE as n, sum(1 - strict_error)::DOUBLE as ks, sum(1 - lenient_error)::DOUBLE as kl
 from (select *, coalesce({by}, '(none)') as b from r) group by rollup(b))
 select {by}, n::BIGINT as n, {_WILSON.format(k='ks', name='strict')}, {_WILSON.format(k='kl', name='lenient')} from a"""


_BUCKET = """case when mistranscribed then 'ASR-propagated' when regexp_matches(word, '[A-Za-z]|[А-Яа-яЁё]|\\p{Nd}') then 'code-switch/NER' when stratum = 'B_polysemy' then 'wrong-sense (polysemy)'
 when stratum = 'A_colloquial' or coalesce(note, '') <> '' then 'colloquial/slang' else 'translation/other' end"""

_JUDGE = "case when length(word) % 7 = 0 then 'wrong' when length(word) % 5 = 0 then 'acceptable' else 'correct' end"


def gloss_accuracy_wilson(spark, d):
    return E.accuracy(rows(spark, d), "asr_difficulty")


def strict_lenient_accuracy(spark, d):
    return E.accuracy(rows(spark, d), "stratum")


def error_attribution(spark, d):
    return E.attribution(rows(spark, d))


def auc_score_error(spark, d):
    a = stats.auc(rows(spark, d), -F.col("logprob"), F.col("lenient_error"))
    return a.withColumn("auc", F.round("auc", 6))


def flag_operating_points(spark, d):
    return E.operating_points(rows(spark, d), "logprob", F.col("lenient_error"), THRESHOLDS)


def _with_judge(spark, d):
    return rows(spark, d).where("word is not null").withColumn("judge", L.gloss_judge(F.col("word")))


def kappa_agreement(spark, d):
    k = stats.kappa(_with_judge(spark, d), "verdict", "judge")
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("agreement", "expected", "kappa")])


def confusion_matrix(spark, d):
    return E.confusion(_with_judge(spark, d), "verdict", "judge")


def failure_taxonomy(spark, d):
    return E.failures(rows(spark, d))


def error_examples_topk(spark, d):
    return E.error_examples(rows(spark, d))


def baseline_arms(spark, d):
    return E.arms(rows(spark, d).where("word is not null and gloss is not null"))


def reproduction_rates(spark, d):
    """Gold words joined to their segment; the candidate is the gloss at the word's place in it."""
    segs = T.segments(spark, d).select("video_id", "seg_index", F.col("words.translation").alias("glosses"))
    r = rows(spark, d).where("gloss is not null").join(segs, ["video_id", "seg_index"])
    return E.reproduction(r.withColumn("candidate", F.get("glosses", F.col("word_index"))))


def label_shares(spark, d):
    return stats.mass_by_value(L.word_labels(T.gold_words(spark, d)), "verdict").withColumn("share", F.round("share", 6))


QUERIES = {
    f.__name__: f
    for f in (gloss_accuracy_wilson, strict_lenient_accuracy, error_attribution, auc_score_error, flag_operating_points, kappa_agreement, confusion_matrix, failure_taxonomy, error_examples_topk, baseline_arms, reproduction_rates, label_shares)
}

ORACLES = {
    "gloss_accuracy_wilson": _accuracy_sql("asr_difficulty"),
    "strict_lenient_accuracy": _accuracy_sql("stratum"),
    "error_attribution": GOLD
    + """ select count(*)::BIGINT as n, count_if(mistranscribed)::BIGINT as n_mistranscribed, count_if(lenient_error = 1)::BIGINT as n_errors, count_if(lenient_error = 1 and mistranscribed)::BIGINT as n_errors_mistranscribed,
 round(count_if(lenient_error = 1 and mistranscribed)::DOUBLE / nullif(count_if(lenient_error = 1), 0), 6) as share_of_errors from r""",
    "auc_score_error": GOLD
    + """, k as (select lenient_error as y, rank() over (order by -logprob) + (count(*) over (partition by logprob) - 1) / 2.0 as rk from r where logprob is not null)
 select round((sum(case when y = 1 then rk else 0 end) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y)::DOUBLE * sum(1 - y), 0), 6) as auc, sum(y)::BIGINT as positives, sum(1 - y)::BIGINT as negatives from k""",
    "flag_operating_points": GOLD
    + """, t as (select unnest([-0.2, -0.3, -0.4, -0.5, -0.7, -1.0]::DOUBLE[]) as threshold), s as (select logprob, lenient_error as y from r where logprob is not null)
 select threshold, count_if(logprob < threshold)::BIGINT as n_flagged, round(count_if(logprob < threshold and y = 1)::DOUBLE / nullif(count_if(logprob < threshold), 0), 6) as precision,
 round(count_if(logprob < threshold and y = 1)::DOUBLE / nullif(sum(y), 0), 6) as recall, round(count_if(logprob < threshold)::DOUBLE / count(*), 6) as coverage from t, s group by threshold""",
    "kappa_agreement": GOLD
    + f""", j as (select verdict as a, {_JUDGE} as b from r where word is not null), c as (select count(*)::DOUBLE as n, count_if(a = b)::DOUBLE as same from j),
 m as (select sum(x.c::DOUBLE * y.c) as dot from (select a as v, count(*) as c from j group by 1) x join (select b as v, count(*) as c from j group by 1) y using (v))
 select n::BIGINT as n, round(same / n, 6) as agreement, round(dot / (n * n), 6) as expected, round(case when dot / (n * n) >= 1 then 1.0 else (same / n - dot / (n * n)) / (1 - dot / (n * n)) end, 6) as kappa from c, m""",
    "confusion_matrix": GOLD
    + f""", j as (select verdict as truth, {_JUDGE} as said from r where word is not null), c as (select truth, said, count(*)::BIGINT as n from j group by 1, 2)
 select truth, said, n, case when truth = said then round(n / (sum(n) over (partition by said))::DOUBLE, 6) end as precision, case when truth = said then round(n / (sum(n) over (partition by truth))::DOUBLE, 6) end as recall from c""",
    "failure_taxonomy": GOLD + f", b as (select {_BUCKET} as bucket, count(*)::BIGINT as n from r where strict_error = 1 group by 1) select bucket, n, round(n / (sum(n) over ())::DOUBLE, 6) as share from b",
    "error_examples_topk": GOLD
    + f", b as (select {_BUCKET} as bucket, id, word, gloss, seg_text from r where strict_error = 1), k as (select *, row_number() over (partition by bucket order by id)::INT as place from b) select bucket, place, id, word, gloss, substr(seg_text, 1, 80) as excerpt from k where place <= 4",
    "baseline_arms": GOLD
    + """, q as (select *, case when verdict = 'correct' then gloss else nullif(trim(correction), '') end as gold from r where word is not null and gloss is not null),
 z as (select coalesce(stratum, '(none)') as b, (lower(trim(gold)) = lower(trim(gloss)))::INT as p, (lower(trim(gold)) = lower(trim('ctx:' || word)))::INT as c, (lower(trim(gold)) = lower(trim('noctx:' || word)))::INT as o from q where gold is not null)
 select case when grouping(b) = 1 then 'ALL' else b end as stratum, count(*)::BIGINT as n, round(avg(p), 6) as prod_acc, round(avg(c), 6) as ctx_acc, round(avg(o), 6) as noctx_acc, round(round(avg(c), 6) - round(avg(o), 6), 6) as context_gain from z group by rollup(b)""",
    "reproduction_rates": GOLD
    + """, s as (select distinct video_id, seg_index, words from segments), q as (select r.*, case when verdict = 'correct' then gloss else coalesce(nullif(trim(correction), ''), gloss) end as gold, s.words[word_index + 1].translation as cand from r join s using (video_id, seg_index) where gloss is not null),
 z as (select verdict, (lower(trim(gold)) = lower(trim(cand)))::INT as ok, (lower(trim(gloss)) = lower(trim(cand)))::INT as same from q where cand is not null)
 select count(*)::BIGINT as n, round(avg(ok), 6) as accuracy, round(avg(same), 6) as agreement, round(avg(case when verdict <> 'correct' then ok end), 6) as fix_rate, round(avg(case when verdict = 'correct' then ok end), 6) as keep_rate from z""",
    "label_shares": GOLD + "select verdict as value, count(*)::BIGINT as n, round(count(*) / (sum(count(*)) over ())::DOUBLE, 6) as share from l group by 1",
}
