"""Queries of the processing pipeline: segmentation, consolidation, memo, exchange of data."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, functions as F

from parolumi.functions import text as X
from parolumi.operators import asr as A, evaluation as E, labels as L, providers as P, sampling as S, segmenting as G
from parolumi.plans.evaluation import rows
from parolumi.session import scratch_dir
from parolumi.sources import files, sinks, tables as T
from parolumi.streaming import sessions as SS

_SIDE = "chunks array<struct<index:int,offset:double,text:string>>, words array<struct<text:string,type:string,start:string,end:string,speaker_id:string,logprob:string>>, events array<struct<message_type:string,text:string,error:string>>, source string, model string, duration_seconds double"


def _sidecars(spark, d) -> DataFrame:
    """Parsed sidecars; a body that doesn't parse has only nulls."""
    s = T.table(spark, d, "raw_sidecars").dropDuplicates(["file_id"])
    return s.select("file_id", "run_dir", "run_no", F.from_json("body", _SIDE).alias("j")).select("file_id", "run_dir", "run_no", "j.*")


def _raw_words(spark, d) -> DataFrame:
    w = _sidecars(spark, d).select("file_id", F.posexplode("words").alias("pos", "w"))
    number = lambda c: F.col(c).try_cast("double")  # noqa: E731 - runs differ in whether numbers are quoted
    return w.select("file_id", "pos", "w.text", "w.type", number("w.start").alias("start_s"), number("w.end").alias("end_s"), "w.speaker_id", number("w.logprob").alias("logprob"))


def segment_tokens(spark, d):
    """A video's words, in order, cut into sentence-like segments."""
    w = T.segments(spark, d).select("video_id", "seg_index", F.posexplode("words").alias("i", "w")).select("video_id", (F.col("seg_index").cast("bigint") * 100000 + F.col("i")).alias("pos"), F.trim("w.text").alias("text"), F.col("w.start_s").alias("start_s"), F.col("w.end_s").alias("end_s"), F.lit(None).cast("string").alias("speaker"))
    return G.segments(w.where("coalesce(text, '') <> ''"), ["video_id"], "pos")


def raw_word_reader(spark, d):
    """Tokens of the word-level sidecars that are spoken."""
    return G.spoken_tokens(_raw_words(spark, d)).select("file_id", "pos", "text", "start_s", "speaker_id", "logprob")


def diarized_runs(spark, d):
    return G.speaker_runs(_raw_words(spark, d), ["file_id"], "pos")


def cut_points(spark, d):
    """Clips cut at the silences between their segments into pieces of 30 seconds at most."""
    s = T.segments(spark, d).groupBy("video_id").agg(F.max("end_s").alias("duration"), F.array_sort(F.collect_list("end_s")).alias("silences"))
    return G.cuts(s, "video_id", "duration", "silences", 30.0).select("video_id", F.posexplode("cuts").alias("place", "cut_s"))


def event_commits(spark, d):
    """Committed texts of the realtime sidecars in order, and how many errors came between."""
    e = _sidecars(spark, d).select("file_id", F.posexplode("events").alias("pos", "e"))
    texts = F.array_sort(F.collect_list(F.when((F.col("e.message_type") == "committed_transcript") & (F.trim(F.coalesce("e.text", F.lit(""))) != ""), F.struct("pos", F.trim("e.text").alias("t")))))
    return e.groupBy("file_id").agg(texts.alias("t"), F.count_if(F.col("e.message_type") == "error").alias("errors")).select("file_id", F.array_join(F.transform("t", lambda x: x["t"]), " ").alias("text"), "errors")


def blind_items(spark, d):
    """Gold words as shown to labellers: without what would bias them."""
    return T.gold_words(spark, d).select("id", "video_id", "url", "src", "seg_index", "seg_text", "seg_explanation", "word", "gloss", "start_s", "end_s")


def consolidated_gold(spark, d):
    """Gold words with their labels, where there are any, and the published date of their video."""
    items = T.gold_words(spark, d)
    labels = L.word_labels(items).where("verdict <> 'unsure'")
    published = T.videos(spark, d).select(F.col("id").alias("video_id"), "published")
    return items.join(labels, "id", "left").join(published, "video_id", "left").select("id", "video_id", "word", "gloss", "stratum", "verdict", "correction", "mistranscribed", "published")


def needed_segments(spark, d):
    """Segments that gold words refer to."""
    return T.segments(spark, d).join(T.gold_words(spark, d).select("video_id", "seg_index").distinct(), ["video_id", "seg_index"], "left_semi").select("video_id", "seg_index", "text")


def unused_segments(spark, d):
    return T.segments(spark, d).join(T.gold_words(spark, d).select("video_id", "seg_index").distinct(), ["video_id", "seg_index"], "left_anti").select("video_id", "seg_index")


def labelled_videos(spark, d):
    """Videos both with gold words and with transcripts."""
    return T.gold_words(spark, d).select("video_id").intersect(T.transcripts(spark, d).select("video_id"))


def json_payload_extract(spark, d):
    """The JSON object inside each sidecar's text, where it is one, and three of its fields."""
    s = T.table(spark, d, "raw_sidecars").dropDuplicates(["file_id"]).select("file_id", F.try_parse_json(X.first_json(F.col("body"))).alias("j"))
    f = lambda path: F.try_variant_get("j", path, "string")
    return s.select("file_id", f("$.source").alias("source"), f("$.model").alias("model"), f("$.requested_language").alias("requested_language")).where("coalesce(source, model, requested_language) is not null")


def cache_miss_merge(spark, d):
    """Glosses asked of two models; the first model's answers of half of the keys are cached."""
    words = T.gold_words(spark, d).where("word is not null").select(F.md5("word").alias("key"), "word").distinct()
    asked = words.crossJoin(F.broadcast(spark.createDataFrame([("alpha",), ("beta",)], "model string"))).withColumn("task", F.lit("gloss"))
    cache = asked.where((F.col("model") == "alpha") & (F.col("key") < "8")).select("task", "model", "key", F.concat(F.lit("old:"), "word").alias("value"))
    answers, _ = P.memoised(asked, cache, lambda q: q.withColumn("value", F.concat(F.lit("new:"), "word")))
    return answers


def leaderboard_upsert(spark, d):
    """A board of chunks by model in which the models of one provider were measured anew."""
    c = T.asr_chunks(spark, d)
    old = c.groupBy("model").agg(F.count("*").alias("chunks"), F.lit("old").alias("run"))
    new = c.where(F.col("model").startswith("ormi")).groupBy("model").agg(F.count_if(F.coalesce("text", F.lit("")) != "").alias("chunks"), F.lit("new").alias("run"))
    return P.upsert(old, new, ["model"])


def prompt_render(spark, d):
    s = T.segments(spark, d).where("text is not null and words is not null")
    return s.select("video_id", "seg_index", F.md5(P.translate_prompt(F.col("text"), F.transform("words", lambda w: F.coalesce(w["text"], F.lit(""))))).alias("prompt_md5"))


def translated_segments(spark, d):
    """The offline translator's output merged into the words by place."""
    s = T.segments(spark, d).where("text is not null and words is not null")
    r = P.offline_translation(F.col("text"), F.transform("words", lambda w: F.coalesce(w["text"], F.lit(""))))
    m = s.withColumn("r", r).select("video_id", "seg_index", F.col("r.sentence").alias("explanation"), P.merged(F.col("words"), F.col("r.glosses")).alias("w"))
    return m.select("video_id", "seg_index", "explanation", F.array_join(F.transform("w", lambda w: w["translation"]), " ").alias("glosses"), F.size("w").alias("n_words"))


def bakeoff_robustness(spark, d):
    """Three models' translations of all segments: the one in use, the offline translator, and
    one that leaves out every fifth sentence and the second half of the glosses."""
    s = T.segments(spark, d).select("video_id", "seg_index", "text", "explanation", F.coalesce("words", F.array()).alias("words"))
    glosses, n = F.col("words.translation"), F.size("words")
    offline = P.offline_translation(F.coalesce("text", F.lit("")), F.transform("words", lambda w: F.coalesce(w["text"], F.lit(""))))
    answers = {
        "in_use": (F.col("explanation"), glosses),
        "offline": (offline["sentence"], offline["glosses"]),
        "sparing": (F.when(F.col("seg_index") % 5 != 0, F.col("explanation")), F.slice(glosses, F.lit(1), F.ceil(n / 2).cast("int"))),
    }
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), said.alias("sentence"), g.alias("glosses")) for m, (said, g) in answers.items()]))
    rows_ = s.select("video_id", "seg_index", n.alias("n_words"), F.col("explanation").alias("incumbent"), each.alias("a")).select("*", "a.*")
    seconds = F.round(X.draw("seconds", "model", "video_id", F.col("seg_index").cast("string")) * 10, 3)
    return P.bakeoff(rows_.withColumns({"seconds": seconds, "error": F.lit(None).cast("string")}))


def fallback_ladder(spark, d):
    """For each clip the first model, by name, whose transcript passes the gate; clips of which
    none does get their recognised chunks joined."""
    t = A.named(T.transcripts(spark, d)).withColumn("reason", F.when(F.col("text") == "", "empty").otherwise(X.degenerate(F.col("text"), F.lit(None).cast("double"))))
    best = P.ladder(t, ["category", "video_id"], ["model"], "reason", "text")
    pieces = T.asr_chunks(spark, d).where("text is not null").select("video_id", "model", "chunk_index", "chunk_id", "text").join(best.select("category", "video_id"), "video_id")
    return P.rescued(best, pieces, ["category", "video_id"], ["model", "chunk_index", "chunk_id"], "reason", "text")


def full_pipeline(spark, d):
    """Sidecars with words to translated segments: spoken tokens, segments, the offline
    translator's answers by memo key, glosses merged by place, named by category and clip."""
    path = T.table(spark, d, "raw_sidecars").groupBy("file_id").agg(F.min("file_path").alias("p"))
    name = F.concat(F.regexp_extract("p", r"([^/]+)/[^/]+$", 1), F.lit("__"), F.regexp_extract("p", r"([^/]+)\.[^./]*$", 1))
    category, clip = X.clip_name(F.col("name"))
    tokens = G.spoken_tokens(_raw_words(spark, d)).withColumnRenamed("speaker_id", "speaker")
    seg = G.segments(tokens, ["file_id"], "pos", with_tokens=True).withColumn("key", F.md5("text"))
    asked = seg.select(F.lit("translate").alias("task"), F.lit("offline").alias("model"), "key", "text", F.col("tokens.text").alias("words"))
    cache = spark.createDataFrame([], P.CACHE_SCHEMA)
    told, _ = P.memoised(asked, cache, lambda q: q.withColumn("value", F.to_json(P.offline_translation(F.col("text"), F.col("words")))))
    answer = F.from_json("value", "sentence string, glosses array<string>")
    out = seg.join(told.select("key", answer.alias("a")), "key").join(path.select("file_id", name.alias("name")), "file_id")
    return out.select("file_id", category.alias("category"), clip.alias("clip"), "segment", "text", "n_words", F.col("a.sentence").alias("explanation"), F.array_join(P.padded(F.col("a.glosses"), F.col("n_words")), "|").alias("glosses"))


def sentence_eval(spark, d):
    """Translations by a drawn rating; a reference, where the rating is not the best, is the
    joined glosses."""
    u = X.draw("rating", "video_id", F.col("seg_index").cast("string"))
    rating = F.when(u < 0.6, "faithful").when(u < 0.85, "minor").when(u < 0.95, "major")
    glosses = F.array_join(F.transform("words", lambda w: F.coalesce(w["translation"], F.lit(""))), " ")
    s = T.segments(spark, d).where("explanation is not null").withColumn("rating", rating)
    return E.sentence_ratings(s.select("rating", F.col("explanation").alias("hypothesis"), F.when(F.col("rating") != "faithful", glosses).alias("reference")))


def prompt_kinds(spark, d):
    """The requests about a gold word, by digest."""
    g = T.gold_words(spark, d)
    c = {"phrase": F.col("seg_text"), "word": F.col("word"), "gloss": F.col("gloss"), "note": F.col("note"), "gold": F.col("note_gloss")}
    return g.select("id", *[F.md5(P.prompt(task, **c)).alias(task) for task in ("judge_gloss", "gloss_in_context", "gloss_alone", "match", "judge_note")])


def fewshot_block(spark, d):
    """The exemplars as they stand before a request."""
    return P.shown_examples(S.exemplars(rows(spark, d), 8))


def item_category(spark, d):
    """Gold words with their video's category and its place in the order of difficulty, if known."""
    known = T.video_category(spark, d).join(F.broadcast(T.difficulty_order(spark)), "category")
    return T.gold_words(spark, d).select("id", "video_id").join(known, "video_id", "left").select("id", "category", "ord")


def word_records(spark, d):
    """Words laid over their segments: a word's own times, where it has them, else the segment's."""
    s = T.segments(spark, d).select(F.struct("video_id", "seg_index", "start_s", "end_s").alias("s"), F.posexplode("words").alias("word_index", "w"))
    own = {c: F.col(f"s.{c}") for c in ("video_id", "seg_index", "start_s", "end_s")}
    return s.select("word_index", *X.splat(own, {c: F.col(f"w.{c}") for c in ("text", "start_s", "end_s")}))


def shifted_chunks(spark, d):
    """Chunks on their clip's timeline."""
    c = T.asr_chunks(spark, d).select("chunk_id", "offset_s", F.lit(0.0).alias("start_s"), F.col("usage.audio_seconds").alias("end_s"))
    return G.shifted(c, "start_s", "end_s", "offset_s").select("chunk_id", "start_s", "end_s")


def event_errors(spark, d):
    """Committed texts and errors of the realtime logs, each from its own channel."""
    e = _sidecars(spark, d).select("file_id", F.explode("events").alias("e")).select("file_id", "e.*")
    count = lambda part, name: part.groupBy("file_id").agg(F.count("*").alias(name))
    return count(SS.commits(e), "commits").join(count(SS.errors(e), "errors"), "file_id", "full").fillna(0)


def base64_payloads(spark, d):
    """Sidecar bodies as they travel inside a request, by digest and length."""
    b = F.regexp_replace(F.base64(F.encode("body", "UTF-8")), "\\s", "")
    return T.table(spark, d, "raw_sidecars").where("body is not null").dropDuplicates(["file_id"]).select("file_id", F.md5(b).alias("digest"), F.length(b).alias("size"))


def prefix_memo(spark, d):
    """Translations by the first 40 characters of their text, as an old memo keyed them."""
    s = T.segments(spark, d).where("text is not null")
    return s.groupBy(F.substring("text", 1, 40).alias("key")).agg(F.countDistinct("text").alias("texts"))


def json_by_stratum(spark, d):
    """Gold words written as JSON, a folder for each stratum, and read again."""
    path = f"{scratch_dir(spark)}/by-stratum-{uuid.uuid4().hex}"
    sinks.json_per_key(T.gold_words(spark, d).select("id", "word", "gloss", "logprob", F.coalesce("stratum", F.lit("none")).alias("stratum")), path, "stratum")
    return files.json_lines(spark, path, "id string, word string, gloss string, logprob double, stratum string")


def memo_appended(spark, d):
    """The memo after two runs: the second asks only for what the first did not."""
    path = f"{scratch_dir(spark)}/memo-{uuid.uuid4().hex}"
    words = T.gold_words(spark, d).where("word is not null").select(F.lit("gloss").alias("task"), F.lit("alpha").alias("model"), F.md5("word").alias("key"), "word", "seg_index").distinct()
    for turn, asked in (("one:", words.where("seg_index < 5")), ("two:", words)):
        held = spark.read.schema(P.CACHE_SCHEMA).parquet(path) if turn == "two:" else spark.createDataFrame([], P.CACHE_SCHEMA)
        _, fresh = P.memoised(asked, held, lambda q, turn=turn: q.withColumn("value", F.concat(F.lit(turn), "word")))
        sinks.append_cache(fresh.select("task", "model", "key", "value"), path)
    return spark.read.schema(P.CACHE_SCHEMA).parquet(path)


def transcripts_to_do(spark, d):
    """Videos of the catalogue that have no transcript of the anchor model yet."""
    t = A.named(T.transcripts(spark, d)).where("model = 'kaghni_scribe_v2.basic'")
    return sinks.missing_only(T.videos(spark, d).select(F.col("id").alias("video_id")), t, ["video_id"])


QUERIES = {
    f.__name__: f
    for f in (segment_tokens, raw_word_reader, diarized_runs, cut_points, event_commits, blind_items, consolidated_gold, needed_segments, unused_segments, labelled_videos, json_payload_extract, cache_miss_merge, leaderboard_upsert, prompt_render, translated_segments, bakeoff_robustness, fallback_ladder, full_pipeline, sentence_eval, prompt_kinds, fewshot_block, item_category, word_records, shifted_chunks, event_errors, base64_payloads, prefix_memo, json_by_stratum, memo_appended, transcripts_to_do)
}

_SEG = "with s as (select distinct on (video_id, seg_index) * from segments order by video_id, seg_index)"
_GOLD = "g as (select distinct * from gold_words)"
_SIDE_SQL = "with f as (select distinct on (file_id) file_id, body from raw_sidecars order by file_id), ok as (select file_id, body::JSON as j from f where json_valid(body)), w as (select file_id, unnest(range(json_array_length(j, '$.words')::BIGINT))::INT as pos, j from ok where json_type(j, '$.words') = 'ARRAY'), r as (select file_id, pos, json_extract(j, '$.words[' || pos || ']') as w from w)"

from parolumi.plans.asr import _LOOP, _ARM, _COUNT, _OTH, TR, chrf_sql  # noqa: E402
from parolumi.plans.evaluation import GOLD  # noqa: E402



def _template_sql(task: str, **columns: str) -> str:
    parts = [p for p in re.split(r"(\{\w+\})", P.PROMPTS[task]) if p]
    quoted = lambda p: "'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(f"coalesce({columns[p[1:-1]]}, '')" if p[:1] == "{" else quoted(p) for p in parts)


ORACLES = {
    "segment_tokens": _SEG
    + """, w0 as (select video_id, seg_index, unnest(range(len(words))) as i, unnest(words) as w from s where words is not null), w as (select video_id, seg_index * 100000 + i as pos, trim(w.text) as text, w.start_s as st, w.end_s as en from w0 where coalesce(trim(w.text), '') <> ''),
 b as (select *, lag(text) over p as pt, lag(en) over p as pe from w window p as (partition by video_id order by pos)), m as (select *, sum(case when pt is not null and (regexp_matches(pt, '[։?!.…]$') or round(coalesce(st - pe, 0.0), 6) >= 0.8) then 1 else 0 end) over (partition by video_id order by pos) as segment from b)
 select video_id, segment::BIGINT as segment, arg_min_null(st, pos) as start_s, arg_max_null(en, pos) as end_s, trim(regexp_replace(string_agg(text, ' ' order by pos), '\\s+([։?!.,…])', '\\1', 'g')) as text, count(*)::INT as n_words from m group by 1, 2""",
    "blind_items": "with " + _GOLD + " select id, video_id, url, src, seg_index, seg_text, seg_explanation, word, gloss, start_s, end_s from g",
    "consolidated_gold": GOLD
    + ", v as (select id as video_id, published from (select *, row_number() over (partition by id order by loaded_at desc, seg_ver desc nulls last, published desc nulls last) as k from videos) where k = 1) select g.id, g.video_id, g.word, g.gloss, g.stratum, r.verdict, r.correction, r.mistranscribed, v.published from g left join r on g.id = r.id left join v on g.video_id = v.video_id",
    "needed_segments": _SEG + " select video_id, seg_index, text from s where (video_id, seg_index) in (select video_id, seg_index from gold_words)",
    "unused_segments": _SEG + " select video_id, seg_index from s where not exists (select 1 from gold_words g where g.video_id = s.video_id and g.seg_index = s.seg_index)",
    "labelled_videos": "select video_id from gold_words intersect select video_id from transcripts",
    "cache_miss_merge": "with w as (select distinct md5(word) as key, word from gold_words where word is not null), m as (select unnest(['alpha', 'beta']) as model) select 'gloss' as task, model, key, case when model = 'alpha' and key < '8' then 'old:' || word else 'new:' || word end as value from w, m",
    "leaderboard_upsert": "with c as (select distinct on (chunk_id) * from asr_chunks order by chunk_id) select model, count(*)::BIGINT as chunks, 'old' as run from c where not starts_with(model, 'ormi') group by 1 union all select model, count_if(coalesce(text, '') <> '')::BIGINT, 'new' from c where starts_with(model, 'ormi') group by 1",
    "prompt_render": _SEG
    + " select video_id, seg_index, md5('Sentence: ' || text || chr(10) || 'Give the translation into Russian and ' || len(words) || ' glosses, one per token, in order:' || chr(10) || array_to_string(list_transform(range(1, len(words) + 1), lambda i: (i - 1) || ': ' || coalesce(words[i].text, '')), chr(10))) as prompt_md5 from s where text is not null and words is not null",
    "translated_segments": _SEG
    + " select video_id, seg_index, '[Russian] ' || text as explanation, coalesce(array_to_string(list_transform(words, lambda w: 'g:' || coalesce(w.text, '')), ' '), '') as glosses, len(words)::INT as n_words from s where text is not null and words is not null",
    "bakeoff_robustness": _SEG
    + """, bk as (select video_id, seg_index, coalesce(len(words), 0) as n, explanation as inc, text, coalesce(words, []) as ws from s),
 a as (select video_id, seg_index, n, inc, 'in_use' as model, inc as said, list_transform(ws, lambda w: w.translation) as g from bk
  union all select video_id, seg_index, n, inc, 'offline', '[Russian] ' || coalesce(text, ''), list_transform(ws, lambda w: 'g:' || coalesce(w.text, '')) from bk
  union all select video_id, seg_index, n, inc, 'sparing', case when seg_index % 5 <> 0 then inc end, list_transform(ws, lambda w: w.translation)[1:ceil(n / 2)::INT] from bk),
 p as (select model, video_id, seg_index, coalesce(said, '') as h, coalesce(inc, '') as r from a), """
    + chrf_sql("model, video_id, seg_index", 4)
    + """, x as (select a.*, round(('0x' || substr(md5('seconds::' || model || '::' || video_id || '::' || seg_index), 1, 8))::BIGINT / 4294967296.0 * 10, 3) as seconds, chrf from a join chrf using (model, video_id, seg_index)),
 l as (select model, list_sort(list(seconds))[least(count(*) - 1, floor(count(*) * 0.5)::BIGINT) + 1] as median_seconds from x group by 1)
 select model, count(*)::BIGINT as segments, round(avg((coalesce(said, '') = '')::INT), 6) as empty_rate, round(avg((len(g) <> n)::INT), 6) as mismatch_rate,
  round(sum(len(list_filter(g, lambda y: coalesce(y, '') <> '' and not regexp_matches(y, '[А-Яа-яЁё]')))) / greatest(1, sum(n))::DOUBLE, 6) as non_cyrillic_rate, round(avg(chrf), 1) as chrf_vs_incumbent, any_value(median_seconds) as median_seconds from x join l using (model) group by model""",
    "fallback_ladder": _LOOP
    + f", x as (select t.*, case when text = '' then 'empty' when {_COUNT.format('text', _ARM + _OTH)} >= 5 and {_COUNT.format('text', _ARM)} < 0.5 * {_COUNT.format('text', _ARM + _OTH)} then 'wrong script' when l.model is not null then 'loop' end as reason from t left join loops l using (model, category, video_id)), best as (select category, video_id, min(model) filter (where reason is null) as model, coalesce(arg_min(text, model) filter (where reason is null), '') as text, case when count(*) filter (where reason is null) = 0 then arg_max(reason, model) end as reason from x group by 1, 2),"
    + " c as (select distinct on (chunk_id) * from asr_chunks order by chunk_id), j as (select video_id, string_agg(trim(text), ' ' order by model, chunk_index, chunk_id) as joined from c where trim(coalesce(text, '')) <> '' group by 1)"
    + " select category, video_id, model, case when reason is not null then coalesce(joined, text) else text end as text, case when joined is null then reason end as reason, (reason is not null and joined is not null) as rescued from best left join j using (video_id)",
    "full_pipeline": _SIDE_SQL
    + """, w1 as (select file_id, pos, trim(w->>'$.text') as text, try_cast(w->>'$.start' as double) as st, try_cast(w->>'$.end' as double) as en, w->>'$.speaker_id' as sp from r where coalesce(w->>'$.type', 'word') in ('word', 'punctuation') and trim(coalesce(w->>'$.text', '')) <> ''),
 b as (select *, row_number() over p as k, lag(text) over p as pt, lag(en) over p as pe, lag(sp) over p as psp from w1 window p as (partition by file_id order by pos)),
 m as (select *, sum(case when k > 1 and (regexp_matches(pt, '[։?!.…]$') or sp is distinct from psp or round(coalesce(st - pe, 0.0), 6) >= 0.8) then 1 else 0 end) over (partition by file_id order by pos) as segment from b),
 g as (select file_id, segment::BIGINT as segment, trim(regexp_replace(string_agg(text, ' ' order by pos), '\\s+([։?!.,…])', '\\1', 'g')) as text, count(*)::INT as n_words, list('g:' || text order by pos) as words, md5(trim(regexp_replace(string_agg(text, ' ' order by pos), '\\s+([։?!.,…])', '\\1', 'g'))) as key from m group by 1, 2),
 n as (select file_id, min(file_path) as p from raw_sidecars group by 1)
 select file_id, regexp_extract(p, '([^/]+)/[^/]+$', 1) as category, regexp_extract(p, '([^/]+)\\.[^./]*$', 1) as clip, segment, text, n_words, '[Russian] ' || text as explanation, array_to_string(words, '|') as glosses from g join n using (file_id)""",
    "sentence_eval": _SEG
    + """, u as (select *, ('0x' || substr(md5('rating::' || video_id || '::' || seg_index), 1, 8))::BIGINT / 4294967296.0 as u from s where explanation is not null),
 t as (select *, case when u < 0.6 then 'faithful' when u < 0.85 then 'minor' when u < 0.95 then 'major' end as rating from u),
 p as (select rating, video_id, seg_index, explanation as h, case when rating <> 'faithful' then coalesce(nullif(trim(coalesce(array_to_string(list_transform(words, lambda w: coalesce(w.translation, '')), ' '), '')), ''), explanation) else explanation end as r from t where rating is not null), """
    + chrf_sql("rating, video_id, seg_index", 1)
    + """, x as (select rating, chrf, (trim(h) = trim(r))::INT as same from p join chrf using (rating, video_id, seg_index)), z as (select case when grouping(rating) = 1 then 'ALL' else rating end as rating, count(*)::BIGINT as n, round(avg(chrf), 1) as chrf_mean, sum(same)::BIGINT as identical from x group by rollup(rating))
 select rating, n, chrf_mean, identical, round(n / (max(n) over ())::DOUBLE, 3) as share from z""",
    "prompt_kinds": "with " + _GOLD + " select id, " + ", ".join(f"md5({_template_sql(t, phrase='seg_text', word='word', gloss='gloss', note='note', gold='note_gloss')}) as {t}" for t in ("judge_gloss", "gloss_in_context", "gloss_alone", "match", "judge_note")) + " from g",
    "fewshot_block": GOLD
    + ", x as (select *, row_number() over (partition by verdict order by id) as k from r where verdict in ('wrong', 'correct')), ws as (select * from x where verdict = 'wrong' and k <= 4), e as (select * from ws union all select * from x where verdict = 'correct' and k <= 8 - (select count(*) from ws)) select coalesce(string_agg('Phrase: ' || coalesce(seg_text, '') || chr(10) || 'Word: ' || coalesce(word, '') || chr(10) || 'Gloss: ' || coalesce(gloss, '') || chr(10) || 'verdict: ' || verdict || ', best gloss: ' || coalesce(nullif(trim(correction), ''), gloss, ''), chr(10) || chr(10) order by id), '') as examples from e",
    "item_category": "with " + _GOLD + ", o as (select unnest(['formal','single_speaker','multi_speakers','songs','difficult','songs_difficult']) as category, unnest(range(6))::INT as ord), c as (select video_id, arg_min(category, ord) as category, min(ord) as ord from transcripts join o using (category) group by 1) select g.id, c.category, c.ord from g left join c using (video_id)",
    "word_records": _SEG + ", w as (select video_id, seg_index, start_s as ss, end_s as se, unnest(range(len(words)))::INT as word_index, unnest(words) as w from s where words is not null) select word_index, video_id, seg_index, coalesce(w.start_s, ss) as start_s, coalesce(w.end_s, se) as end_s, w.text as text from w",
    "shifted_chunks": "with c as (select distinct on (chunk_id) * from asr_chunks order by chunk_id) select chunk_id, round(0.0 + offset_s, 3) as start_s, round(usage.audio_seconds + offset_s, 3) as end_s from c",
    "base64_payloads": "with f as (select distinct on (file_id) file_id, body from raw_sidecars where body is not null order by file_id) select file_id, md5(to_base64(encode(body))) as digest, length(to_base64(encode(body)))::INT as size from f",
    "prefix_memo": _SEG + " select substr(text, 1, 40) as key, count(distinct text)::BIGINT as texts from s where text is not null group by 1",
    "json_by_stratum": "with " + _GOLD + " select id, word, gloss, logprob, coalesce(stratum, 'none') as stratum from g",
    "memo_appended": "select 'gloss' as task, 'alpha' as model, md5(word) as key, case when min(seg_index) < 5 then 'one:' else 'two:' end || word as value from gold_words where word is not null group by word",
    "transcripts_to_do": TR + " select distinct id as video_id from videos where id not in (select video_id from t where model = 'kaghni_scribe_v2.basic' and text <> '')",
    "cut_points": """with recursive s as (select distinct on (video_id, seg_index) * from segments order by video_id, seg_index), v as (select video_id, max(end_s) as dur, list_filter(list(end_s), lambda x: x is not null) as l from s group by 1),
 c as (select video_id, 0 as place, 0.0::DOUBLE as last from v union all select c.video_id, place + 1, coalesce(list_max(list_filter(v.l, lambda x: x > c.last and x <= c.last + 30.0)), c.last + 30.0) from c join v using (video_id) where c.last + 30.0 < v.dur) select video_id, (place - 1)::INT as place, round(last, 3) as cut_s from c where place > 0""",
    "json_payload_extract": """with f as (select distinct on (file_id) file_id, nullif(regexp_extract(body, '(?s)\\{.*\\}', 0), '') as j from raw_sidecars order by file_id), ok as (select file_id, j::JSON as j from f where json_valid(j))
 select * from (select file_id, j->>'$.source' as source, j->>'$.model' as model, j->>'$.requested_language' as requested_language from ok) where coalesce(source, model, requested_language) is not null""",
    "raw_word_reader": _SIDE_SQL
    + " select file_id, pos, trim(w->>'$.text') as text, try_cast(w->>'$.start' as double) as start_s, w->>'$.speaker_id' as speaker_id, try_cast(w->>'$.logprob' as double) as logprob from r where coalesce(w->>'$.type', 'word') in ('word', 'punctuation') and trim(coalesce(w->>'$.text', '')) <> ''",
}
ORACLES["diarized_runs"] = (
    _SIDE_SQL
    + """, o as (select file_id, pos, coalesce(w->>'$.text', '') as t, case when coalesce(w->>'$.type', 'word') = 'word' then coalesce(w->>'$.speaker_id', 'speaker_0') end as own from r),
 l as (select *, last_value(own ignore nulls) over (partition by file_id order by pos rows between unbounded preceding and current row) as sp from o), k as (select * from l where sp is not null),
 c as (select *, case when sp is not distinct from lag(sp) over (partition by file_id order by pos) then 0 else 1 end as n from k), g as (select *, sum(n) over (partition by file_id order by pos) as run from c),
 x as (select file_id, run::BIGINT as run, sp, trim(string_agg(t, '' order by pos)) as text from g group by 1, 2, 3)
 select file_id, run, case when regexp_matches(sp, '^speaker_[0-9]+$') then 'Speaker ' || (substr(sp, 9)::INT + 1) else sp end as speaker, text from x where text <> ''"""
)
ORACLES["event_commits"] = """with f as (select distinct on (file_id) file_id, body from raw_sidecars order by file_id), ok as (select file_id, body::JSON as j from f where json_valid(body)), e as (select file_id, unnest(range(json_array_length(j, '$.events')::BIGINT)) as pos, j from ok where json_type(j, '$.events') = 'ARRAY'),
 r as (select file_id, pos, json_extract(j, '$.events[' || pos || ']') as e from e) select file_id, coalesce(string_agg(trim(e->>'$.text'), ' ' order by pos) filter (where e->>'$.message_type' = 'committed_transcript' and trim(coalesce(e->>'$.text', '')) <> ''), '') as text, count(*) filter (where e->>'$.message_type' = 'error')::BIGINT as errors from r group by 1"""
ORACLES["event_errors"] = """with f as (select distinct on (file_id) file_id, body from raw_sidecars order by file_id), ok as (select file_id, body::JSON as j from f where json_valid(body)), e as (select file_id, unnest(range(json_array_length(j, '$.events')::BIGINT)) as pos, j from ok where json_type(j, '$.events') = 'ARRAY'),
 r as (select file_id, json_extract(j, '$.events[' || pos || ']') as e from e), c as (select file_id, count(*) filter (where e->>'$.message_type' = 'committed_transcript' and trim(coalesce(e->>'$.text', '')) <> '')::BIGINT as commits, count(*) filter (where e->>'$.message_type' = 'error' or coalesce(e->>'$.error', '') <> '')::BIGINT as errors from r group by 1) select * from c where commits + errors > 0"""
