"""Queries that draw samples, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from parolumi.functions import text as X
from parolumi.operators import corpus as C, labels as L, sampling as S
from parolumi.plans.evaluation import GOLD, rows
from parolumi.sources import tables as T

SEED = "20260808"
NOTE_QUOTA = {"grammar": 20, "derivation": 15, "register": 10, "other": 5}


def stratified_sample(spark, d):
    s = T.segments(spark, d)
    o = C.occurrences(s)
    o = o.select("video_id", "seg_index", "word_index", "form", "word", "note", "logprob")
    tagged = S.word_strata(o, S.spoken_forms(s), C.senses(s)).select("video_id", "seg_index", "word_index", "form", "strata")
    out = S.stratified(tagged, S.STRATA, ["video_id", "seg_index", "word_index"], "form", SEED)
    return out.select(F.format_string("w%03d", "place").alias("id"), "stratum", "video_id", "seg_index", "word_index", "form")


def sample_per_category(spark, d):
    s = T.segments(spark, d).where((F.coalesce("text", F.lit("")) != "") & (F.coalesce(F.size("words"), F.lit(0)) >= 4)).join(T.video_category(spark, d), "video_id")
    return S.per_category(s, ["video_id", "seg_index"], "category", "video_id", 5, 2, SEED).select("category", "place", "video_id", "seg_index")


def note_sample(spark, d):
    n = T.segments(spark, d).select("video_id", F.explode("notes").alias("n")).where("coalesce(n.note, '') <> '' and coalesce(n.word, '') <> ''")
    pool = n.select("video_id", F.col("n.word").alias("word"), F.col("n.note").alias("note"), L.claim_type(F.col("n.note")).alias("claim_type"))
    return S.quota_sample(pool, ["video_id", "word", "note"], "claim_type", "video_id", NOTE_QUOTA, 50, 2, SEED)


def phrase_sample(spark, d):
    s = T.segments(spark, d)
    return S.phrases(s, S.spoken_forms(s), S.PHRASES, SEED).select("video_id", "seg_index", "slang")


def fewshot_exemplars(spark, d):
    return S.exemplars(rows(spark, d), 8).select("id", "verdict", "word", "gloss")


def held_out_rows(spark, d):
    """Judged rows that are no exemplars."""
    r = rows(spark, d).where(F.col("verdict").isin("correct", "acceptable", "wrong"))
    return r.join(S.exemplars(r, 8).select("id"), "id", "left_anti").select("id", "verdict")


QUERIES = {f.__name__: f for f in (stratified_sample, sample_per_category, note_sample, phrase_sample, fewshot_exemplars, held_out_rows)}

_SEG = "with s as (select distinct on (video_id, seg_index) * from segments order by video_id, seg_index)"
_FORM = "regexp_replace(coalesce({0}, ''), '[։՝՜՞,.\\s]+', '', 'g')"
_SPOKEN = f"""w as (select video_id, seg_index, (unnest(range(len(words))))::INT as word_index, unnest(words) as w, notes from s where words is not null),
 nf as (select {_FORM.format('n.word')} as form from (select unnest(notes) as n from s) group by 1 having count(*) >= 3 and {_FORM.format('n.word')} <> ''), sp as (select form from nf union select unnest([{', '.join(chr(39) + x + chr(39) for x in C.SPOKEN_FORMS)}]))"""


def _strata_sql() -> str:
    sql = f"""{_SEG}, {_SPOKEN}, k as (select {_FORM.format('w.text')} as form, lower(trim(coalesce(w.translation, ''))) as g from w), am as (select form from (select form, g, count(*) as n from k where form <> '' and g <> '' group by 1, 2) group by 1 having count(*) >= 3 and sum(n) >= 5),
 o as (select video_id, seg_index, word_index, w.text as word, {_FORM.format('w.text')} as form, w.logprob as lp, list_filter(notes, lambda n: {_FORM.format('n.word')} = {_FORM.format('w.text')})[1].note as note from w where coalesce(w.text, '') <> '' and coalesce(w.translation, '') <> '')"""
    conditions = {
        "A_colloquial": ("form in (select form from sp) or coalesce(note, '') <> ''"),
        "B_polysemy": ("length(form) <= 4 and form in (select form from am)"),
        "C_lowconf": ("lp < -0.4"),
        "D_codeswitch": ("regexp_matches(word, '[A-Za-z]|[А-Яа-яЁё]|\\p{Nd}')"),
        "E_control": ("lp > -0.02"),
    }
    names = []
    for i, (name, cond) in enumerate(conditions.items()):
        k = S.STRATA[name]
        free = "".join(f" and not exists (select 1 from q{j} u where u.video_id = o.video_id and u.seg_index = o.seg_index and u.word_index = o.word_index)" for j in names)
        sql += f""", p{i} as (select video_id, seg_index, word_index, form, md5('{SEED}{name}::' || video_id || '::' || seg_index || '::' || word_index) as h from o where ({cond}){free}),
 q{i} as (select *, {i} as st, '{name}' as stratum from (select *, row_number() over (partition by form order by h, video_id, seg_index, word_index) as r from p{i}) where r <= {max(2, k // 8)} order by h, video_id, seg_index, word_index limit {k})"""
        names.append(i)
    union = " union all ".join(f"select * from q{i}" for i in names)
    return sql + f", a as ({union}) select printf('w%03d', row_number() over (order by st, h, video_id, seg_index, word_index) - 1) as id, stratum, video_id, seg_index, word_index, form from a"



def _note_sql() -> str:
    claim = "case " + " ".join(f"when regexp_matches(lower(n.note), '{p}') then '{k}'" for k, p in L.CLAIMS) + " else 'other' end"
    sql = f"{_SEG}, n as (select video_id, unnest(notes) as n from s), pool as (select distinct video_id, n.word as word, n.note as note, {claim} as claim_type from n where coalesce(n.note, '') <> '' and coalesce(n.word, '') <> '')"
    taken = "(select null as video_id, null as word, null as note where false)"
    for i, (name, k) in enumerate([*NOTE_QUOTA.items(), (None, 50)]):
        kind = f"claim_type = '{name}'" if name else "true"
        limit = k if name else f"(select greatest(0, {k} - count(*)) from {taken})"
        sql += f""", f{i} as (select p.*, md5('{SEED}{name or 'rest'}::' || video_id || '::' || word || '::' || note) as h, (select count(*) from {taken} t where t.video_id = p.video_id) as held from pool p where {kind} and not exists (select 1 from {taken} t where t.video_id = p.video_id and t.word = p.word and t.note = p.note)),
 q{i} as (select video_id, word, note, claim_type, {i} as step from (select *, held + row_number() over (partition by video_id order by h, video_id, word, note) as r from f{i}) where r <= 2 order by h, video_id, word, note limit {limit})"""
        taken = "(" + " union all ".join(f"select video_id, word, note from q{j}" for j in range(i + 1)) + ")"
    return sql + " " + " union all ".join(f"select * from q{i}" for i in range(len(NOTE_QUOTA) + 1))


_CATEGORY = "(select video_id, arg_min(category, list_position(['formal','single_speaker','multi_speakers','songs','difficult','songs_difficult'], category)) as category from transcripts where category in ('formal','single_speaker','multi_speakers','songs','difficult','songs_difficult') group by 1)"

ORACLES = {
    "stratified_sample": _strata_sql(),
    "note_sample": _note_sql(),
    "sample_per_category": _SEG
    + f", c as {_CATEGORY}, h as (select category, video_id, seg_index, md5('{SEED}::' || video_id || '::' || seg_index) as h from s join c using (video_id) where coalesce(text, '') <> '' and coalesce(len(words), 0) >= 4), r as (select * from (select *, row_number() over (partition by category, video_id order by h, video_id, seg_index) as r from h) where r <= 2), p as (select *, row_number() over (partition by category order by h, video_id, seg_index)::INT as place from r) select category, place, video_id, seg_index from p where place <= 5",
    "phrase_sample": f"""{_SEG}, {_SPOKEN}, e as (select video_id, seg_index, md5('{SEED}::' || video_id || '::' || seg_index) as h, len(list_filter(words, lambda x: {_FORM.format('x.text')} in (select form from sp))) > 0 as slang from s where coalesce(explanation, '') <> '' and len(words) >= 3)
 select * exclude(h) from (select * from e where slang order by h, video_id, seg_index limit {S.PHRASES * 2 // 3}) union all select * exclude(h) from (select * from e where not slang order by h, video_id, seg_index limit {S.PHRASES - S.PHRASES * 2 // 3})""",
    "fewshot_exemplars": GOLD
    + ", x as (select *, row_number() over (partition by verdict order by id) as k from r where verdict in ('wrong', 'correct')), ws as (select * from x where verdict = 'wrong' and k <= 4) select id, verdict, word, gloss from ws union all select id, verdict, word, gloss from x where verdict = 'correct' and k <= 8 - (select count(*) from ws)",
    "held_out_rows": GOLD
    + ", x as (select *, row_number() over (partition by verdict order by id) as k from r where verdict in ('wrong', 'correct')), ws as (select id from x where verdict = 'wrong' and k <= 4), ex as (select id from ws union all select id from x where verdict = 'correct' and k <= 8 - (select count(*) from ws)) select id, verdict from r where id not in (select id from ex)",
}
_INNER = f"len(list_filter(words, lambda x: {_FORM.format('x.text')} in (select form from sp))) > 0"
ORACLES["phrase_sample"] = ORACLES["phrase_sample"].replace(_INNER, f"exists (select 1 from w where w.video_id = s.video_id and w.seg_index = s.seg_index and {_FORM.format('w.w.text')} in (select form from sp))")
