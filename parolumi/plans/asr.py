"""Queries over transcripts and chunks, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from parolumi.functions import stats, text as X
from parolumi.operators import asr as A
from parolumi.sources import tables as T

ANCHOR = "kaghni_scribe_v2.basic"


def _transcripts(spark, d):
    return A.named(T.transcripts(spark, d))


def asr_quality_leaderboard(spark, d):
    return A.leaderboard(_transcripts(spark, d), ANCHOR)


def asr_quality_basics(spark, d):
    return A.basics(_transcripts(spark, d))


def degenerate_gate(spark, d):
    """Unusable transcripts; a clip's length is that of its segments."""
    dur = T.segments(spark, d).groupBy("video_id").agg(F.max("end_s").alias("seconds"))
    g = A.gate(_transcripts(spark, d).join(dur, "video_id", "left"), "seconds")
    return g.where("reason is not null").select("model", "category", "video_id", "reason")


def loop_detector(spark, d):
    return _transcripts(spark, d).where(X.is_loop(F.col("text"))).select("model", "category", "video_id")


def script_share(spark, d):
    return _transcripts(spark, d).select("model", "category", "video_id", F.round(X.script_share(F.col("text")), 6).alias("armenian_pct"))


def wer_to_anchor(spark, d):
    """Error rates of all models against the anchor's transcript of the same clip."""
    t = _transcripts(spark, d)
    ref = t.where((F.col("model") == ANCHOR) & (F.col("text") != "")).select("category", "video_id", F.col("text").alias("ref"))
    pairs = t.where(F.col("model") != ANCHOR).join(ref, ["category", "video_id"])
    return A.error_rates(pairs, F.col("ref"), F.col("text"), "model", "category")


def wer_infix(spark, d):
    """Error rates of each gold word's segment sought inside the transcripts of its video."""
    seg = T.gold_words(spark, d).select("video_id", "seg_index", "seg_text", "asr_difficulty").distinct()
    pairs = seg.join(_transcripts(spark, d).select("model", "video_id", "text"), "video_id")
    return A.error_rates(pairs, F.col("seg_text"), F.col("text"), "model", "asr_difficulty", infix=True)


def chrf_pp(spark, d):
    """chrF++ of the joined word glosses against the segment's translation."""
    s = T.segments(spark, d).where("explanation is not null")
    hyp = F.array_join(F.transform("words", lambda w: F.coalesce(w["translation"], F.lit(""))), " ")
    return A.chrf(s.withColumn("hyp", F.coalesce(hyp, F.lit(""))), F.col("hyp"), F.col("explanation"), ["video_id", "seg_index"])


def upper_median_latency(spark, d):
    c = T.asr_chunks(spark, d)
    return stats.ranked_value(c, ["model"], "latency_seconds", {"median": 0.5, "p90": 0.9, "p99": 0.99})


def chunk_texts(spark, d):
    """A clip's chunks joined in order, empty ones left out, with seconds and cost."""
    c = T.asr_chunks(spark, d).groupBy("model", "source").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("c"), F.count("*").alias("chunks"), F.round(F.sum("usage.audio_seconds"), 3).alias("audio_seconds"), F.round(F.sum("usage.cost"), 6).alias("cost")
    )
    texts = F.transform("c", lambda x: F.trim(F.coalesce(x["text"], F.lit(""))))
    return c.select("model", "source", "chunks", "audio_seconds", "cost", F.array_join(F.filter(texts, lambda t: t != ""), " ").alias("text"))


def rank_agreement(spark, d):
    """Whether models are ordered alike by median and by 90th percentile latency."""
    return A.rank_agreement(upper_median_latency(spark, d), "median", "p90")


def benchmark_clips(spark, d):
    """The clips of the first reference model that is there."""
    t = _transcripts(spark, d)
    for name in ("chirp_reference.chunked", ANCHOR):
        clips = t.where(F.col("model") == name).select("category", "video_id").distinct()
        if not clips.isEmpty():
            return clips
    return t.select("category", "video_id").distinct()


QUERIES = {f.__name__: f for f in (asr_quality_leaderboard, asr_quality_basics, degenerate_gate, loop_detector, script_share, wer_to_anchor, wer_infix, chrf_pp, upper_median_latency, chunk_texts, rank_agreement, benchmark_clips)}

TR = "with t as (select model || '.' || variant as model, category, video_id, trim(coalesce(text, '')) as text from (select *, row_number() over (partition by model, variant, category, video_id order by loaded_at desc, text desc nulls last) as rn from transcripts) where rn = 1)"
_COUNT = "length(regexp_replace({0}, '[^{1}]', '', 'g'))"
_ARM, _OTH = "԰-֏", "A-Za-zЀ-ӿ؀-ۿऀ-ॿ"
_PCT = f"case when {_COUNT.format('text', _ARM)} + {_COUNT.format('text', _OTH)} > 0 then 100.0::DOUBLE * {_COUNT.format('text', _ARM)} / ({_COUNT.format('text', _ARM)} + {_COUNT.format('text', _OTH)}) end"
_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_LOOP = TR + f""", lw as (select model, category, video_id, text, {_WORDS} as w from t), lg as (select model, category, video_id, len(w) as n, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as g from lw where len(w) >= 20),
 lc as (select model, category, video_id, n, g, count(*) as c from lg group by all), loops as (select distinct model, category, video_id from (select model, category, video_id, n, max(c) as c from lc group by all) where c >= 15 and c * 5.0 / n > 0.6)"""
_RANK = "with c as (select distinct on (chunk_id) * from asr_chunks order by chunk_id), l as (select model, list_sort(list(latency_seconds)) as l from c where latency_seconds is not null group by 1), m as (select model, len(l)::BIGINT as n, l[least(len(l) - 1, floor(len(l) * 0.5)::BIGINT) + 1] as median, l[least(len(l) - 1, floor(len(l) * 0.9)::BIGINT) + 1] as p90, l[least(len(l) - 1, floor(len(l) * 0.99)::BIGINT) + 1] as p99 from l)"



def chrf_sql(key: str, digits: int) -> str:
    """Common table expressions up to chrf (key, chrf) of the pairs in p (key, h, r)."""
    return f"""q as (select {key}, regexp_replace(h, '\\s+', '', 'g') as h, regexp_replace(r, '\\s+', '', 'g') as r, list_filter(regexp_split_to_array(h, '\\s+'), lambda x: x <> '') as hw, list_filter(regexp_split_to_array(r, '\\s+'), lambda x: x <> '') as rw from p),
 o as (select unnest(range(1, 7)) as n), wo as (select unnest(range(1, 3)) as n),
 hg as (select {key}, 'c' || n as o, unnest(list_transform(range(1, length(h) - n + 2), lambda i: substr(h, i, n))) as g from q, o where length(h) >= n union all select {key}, 'w' || n, unnest(list_transform(range(1, len(hw) - n + 2), lambda i: array_to_string(hw[i:i+n-1], chr(31)))) from q, wo where len(hw) >= n),
 rg as (select {key}, 'c' || n as o, unnest(list_transform(range(1, length(r) - n + 2), lambda i: substr(r, i, n))) as g from q, o where length(r) >= n union all select {key}, 'w' || n, unnest(list_transform(range(1, len(rw) - n + 2), lambda i: array_to_string(rw[i:i+n-1], chr(31)))) from q, wo where len(rw) >= n),
 hc as (select {key}, o, g, count(*) as c from hg group by all), rc as (select {key}, o, g, count(*) as c from rg group by all),
 hn as (select {key}, o, sum(c) as hn from hc group by all), rn as (select {key}, o, sum(c) as rn from rc group by all), b as (select {key}, o, sum(least(hc.c, rc.c)) as common from hc join rc using ({key}, o, g) group by all),
 f as (select {key}, case when coalesce(common, 0) = 0 then 0.0 else 5 * (common / hn) * (common / rn) / (4 * (common / hn) + common / rn) end as f from hn join rn using ({key}, o) left join b using ({key}, o)),
 chrf as (select {key}, round(coalesce(avg(f.f) * 100, 0.0), {digits}) as chrf from p left join f using ({key}) group by {key})"""


ORACLES = {
    "asr_quality_basics": _LOOP
    + f" select t.model, count(*)::BIGINT as clips, round(avg((text <> '')::INT), 6) as coverage, round(avg((text = '')::INT), 6) as empty_rate, round(avg((l.model is not null)::INT), 6) as loop_rate, round(avg(case when text <> '' then {_PCT} end), 3) as armenian_pct from t left join loops l using (model, category, video_id) group by 1",
    "degenerate_gate": _LOOP
    + f""", s as (select video_id, max(end_s) as seconds from segments group by 1), x as (select t.*, seconds, (l.model is not null) as lp, {_COUNT.format('text', _ARM)} as a, {_COUNT.format('text', _ARM + _OTH)} as n, len({_WORDS}) as w from t left join s using (video_id) left join loops l using (model, category, video_id)),
 r as (select model, category, video_id, case when n >= 5 and a < 0.5 * n then 'wrong script' when seconds > 3 and w / seconds > 6.0 then 'impossible rate' when lp then 'loop' end as reason from x) select * from r where reason is not null""",
    "loop_detector": _LOOP + " select * from loops",
    "script_share": TR + f" select model, category, video_id, round({_PCT}, 6) as armenian_pct from t",
    "upper_median_latency": _RANK + " select * from m",
    "rank_agreement": _RANK + ", r as (select row_number() over (order by median, model) as a, row_number() over (order by p90, model) as b from m) select count(*)::BIGINT as models, bool_and(a = b) as same_order, round(corr(a, b), 6) as rank_correlation from r",
    "chunk_texts": "with c as (select distinct on (chunk_id) * from asr_chunks order by chunk_id) select model, source, count(*)::BIGINT as chunks, round(sum(usage.audio_seconds), 3) as audio_seconds, round(sum(usage.cost), 6) as cost, coalesce(string_agg(trim(text), ' ' order by chunk_index, chunk_id) filter (where trim(coalesce(text, '')) <> ''), '') as text from c group by 1, 2",
    "benchmark_clips": TR + f" select distinct category, video_id from t where model = '{ANCHOR}'",
    "chrf_pp": "with s as (select distinct on (video_id, seg_index) * from segments order by video_id, seg_index), p as (select video_id, seg_index, coalesce(array_to_string(list_transform(words, lambda w: coalesce(w.translation, '')), ' '), '') as h, explanation as r from s where explanation is not null), "
    + chrf_sql("video_id, seg_index", 4)
    + " select * from chrf",
}


_SPACE = "[\\s\\x{000b}\\x{0085}\\p{Z}]+"


def _distances_sql(infix: bool) -> str:
    """Tables of edit distances by recursion over the references' places: dist (id, unit, d) of
    the pairs in pr (id, ref, hyp)."""
    start = "0" if infix else "j"
    # up to 126 distinct tokens are spelt in single bytes, for which there is a function
    coded = "false" if infix else "len(v) <= 126"
    last = "min(d)" if infix else "arg_max(d, j)"
    return f"""tok as (select id, 'w' as unit, list_filter(regexp_split_to_array(ref, '{_SPACE}'), lambda x: x <> '') as rt, list_filter(regexp_split_to_array(hyp, '{_SPACE}'), lambda x: x <> '') as ht from pr
 union all select id, 'c', list_filter(regexp_split_to_array(regexp_replace(ref, '{_SPACE}', '', 'g'), ''), lambda x: x <> ''), list_filter(regexp_split_to_array(regexp_replace(hyp, '{_SPACE}', '', 'g'), ''), lambda x: x <> '') from pr),
 every as (select row_number() over () as u, unit, rt, ht, list_distinct(rt || ht) as v from (select distinct unit, rt, ht from tok)),
 spelt as (select u, levenshtein(array_to_string(list_transform(rt, lambda x: chr((1 + list_position(v, x))::INT)), ''), array_to_string(list_transform(ht, lambda x: chr((1 + list_position(v, x))::INT)), '')) as d from every where {coded}),
 uq as (select u, rt, ht from every where not {coded}),
 grid as (select u, j, case when j > 0 then ht[j] end as h from uq, lateral (select unnest(range(len(ht) + 1)) as j)),
 refs as (select u, i, rt[i] as x from uq, lateral (select unnest(range(1, len(rt) + 1)) as i)), size as (select u, len(rt) as n from uq),
 step as (select 0 as i, u, j, h, ({start})::INT as d from grid union all
  select i, u, j, h, (min(best - j) over (partition by u order by j) + j)::INT from (
   select r.i, s.u, s.j, s.h, least(s.d + 1, coalesce(lag(s.d) over (partition by s.u order by s.j) + (case when s.h = r.x then 0 else 1 end), s.d + 1)) as best from step s join refs r on r.u = s.u and r.i = s.i + 1)),
 fin as (select s.u, {last} as d from step s join size z on z.u = s.u and s.i = z.n group by s.u union all select u, d from spelt),
 dist as (select t.id, t.unit, len(t.rt) as n, fin.d from tok t join every q on q.unit = t.unit and q.rt = t.rt and q.ht = t.ht join fin on fin.u = q.u)"""


_WERN = "replace(regexp_replace(lower({0}), '[։՝՜՞՛''’,.\\-—«»…:;!?]', ' ', 'g'), 'եւ', 'և')"
_RATES = """ e as (select {by} as b, model, n1, d1, n2, d2 from (select id, max(case when unit = 'w' then n end) as n1, max(case when unit = 'w' then d end) as d1, max(case when unit = 'c' then n end) as n2, max(case when unit = 'c' then d end) as d2 from dist group by id) x join pr using (id))
 select model, case when grouping(b) = 1 then 'ALL' else b end as {name}, count(*)::BIGINT as pairs, round(sum(d1)::DOUBLE / greatest(1, sum(greatest(1, n1))), 6) as wer, round(sum(d2)::DOUBLE / greatest(1, sum(greatest(1, n2))), 6) as cer from e group by grouping sets ((model, b), (model))"""

_REC = TR.replace("with t as", "with recursive t as", 1)
ORACLES["wer_to_anchor"] = (
    _REC
    + f", pr as (select row_number() over () as id, t.model, t.category, {_WERN.format('a.text')} as ref, {_WERN.format('t.text')} as hyp from t join t a using (category, video_id) where a.model = '{ANCHOR}' and a.text <> '' and t.model <> '{ANCHOR}'), "
    + _distances_sql(False)
    + ","
    + _RATES.format(by="coalesce(category, '(none)')", name="category")
)
_QN = _WERN.replace("՞", "")
ORACLES["asr_quality_leaderboard"] = (
    _LOOP.replace("with t as", "with recursive t as", 1)
    + f", pr as (select row_number() over () as id, t.model, {_QN.format('a.text')} as ref, {_QN.format('t.text')} as hyp from t join t a using (category, video_id) where a.model = '{ANCHOR}' and a.text <> '' and t.model <> '{ANCHOR}' and t.text <> ''), "
    + _distances_sql(False)
    + f""", far as (select model, round(d / greatest(1, n)::DOUBLE, 3) as x from dist join pr using (id) where unit = 'w'), med as (select model, list_sort(list(x))[least(count(*) - 1, floor(count(*) * 0.5)::BIGINT) + 1] as vs_anchor from far group by 1),
 base as (select t.model, count(*)::BIGINT as clips, round(avg((text <> '')::INT), 6) as coverage, round(avg((text = '')::INT), 6) as empty_rate, round(avg((l.model is not null)::INT), 6) as loop_rate, round(avg(case when text <> '' then {_PCT} end), 3) as armenian_pct from t left join loops l using (model, category, video_id) group by 1)
 select base.*, vs_anchor from base left join med using (model)"""
)
ORACLES["wer_infix"] = (
    _REC
    + f", g as (select distinct video_id, seg_index, seg_text, asr_difficulty from gold_words), pr as (select row_number() over () as id, t.model, g.asr_difficulty, {_WERN.format(chr(99) + 'oalesce(g.seg_text, ' + chr(39) * 2 + ')')} as ref, {_WERN.format('t.text')} as hyp from g join t using (video_id)), "
    + _distances_sql(True)
    + ","
    + _RATES.format(by="coalesce(asr_difficulty, '(none)')", name="asr_difficulty")
)
