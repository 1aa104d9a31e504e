"""The queries of the training-data operators; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parolumi.llm import language, leakage, lookalikes, packing, pairs, reading_level, truncation
from parolumi.session import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packing(capacity: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return packing.packed(packing.token_counts(_table(spark, sf_dir, "documents")), capacity)

    return run


def p6_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and unused tokens at both capacities; documents are tokenised once."""
    sizes = written(packing.token_counts(_table(spark, sf_dir, "documents")), "token-counts")
    one, two = (packing.summary(packing.packed(sizes, c), c) for c in (2048, 4096))
    return one.unionByName(two)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the documents that leaked items."""
    docs = _table(spark, sf_dir, "documents")
    return leakage.without_leaks(docs, p7_found(spark, sf_dir)).select("doc_id", "source", "n_chars")


def p1_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with text and whether it was cut."""
    return truncation.truncated(_table(spark, sf_dir, "asr_chunks"), ["chunk_id"], "model", "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_chunks(spark, sf_dir).where("cut and chunk_id is not null").select("chunk_id").distinct()


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each model's chunks were cut; chunks without text count as chunks."""
    chunks = _table(spark, sf_dir, "asr_chunks").where("chunk_id is not null").select("chunk_id", "model").distinct()
    cut = p1_found(spark, sf_dir).withColumn("cut", F.lit(1))
    return (
        chunks.join(cut, "chunk_id", "left")
        .groupBy("model")
        .agg(F.count("*").alias("chunks"), F.count("cut").alias("cut_chunks"), (F.count("cut") / F.count("*")).alias("cut_share"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["video_id", "seg_index"]
    segments = _table(spark, sf_dir, "segments").select(*key, "text", "explanation", F.col("words.text").alias("word_texts"), F.col("words.translation").alias("glosses"))
    return pairs.defects(segments, key)


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs by field and kind, as shares of all segments."""
    total = _table(spark, sf_dir, "segments").select("video_id", "seg_index").dropna().distinct().agg(F.count("*").alias("segments"))
    kinds = p3_found(spark, sf_dir).groupBy("field_name", "defect").agg(F.count("*").alias("pairs"))
    return kinds.crossJoin(F.broadcast(total)).withColumn("share", F.col("pairs") / F.col("segments"))


def _spelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "segments").select(F.lit("segments").alias("table_name"), F.concat_ws("#", "video_id", "seg_index").alias("record_id"), F.lit("text").alias("field_name"), F.col("text").alias("value"))
    words = _table(spark, sf_dir, "gold_words").select(F.lit("gold_words").alias("table_name"), F.col("id").alias("record_id"), F.lit("word").alias("field_name"), F.col("word").alias("value"))
    return texts.unionByName(words).where("record_id is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["table_name", "record_id", "field_name"]
    return lookalikes.changed_values(_spelt(spark, sf_dir), key).select(*key).distinct()


def p4_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value in its consistent form, with what was changed in it."""
    key = ["table_name", "record_id", "field_name"]
    values = _spelt(spark, sf_dir).distinct()
    changed = lookalikes.rewritten(lookalikes.changed_values(values, key)).select(*key, "value", "normal", "kinds")
    same = values.join(changed, [*key, "value"], "left_anti").select(*key, "value", F.col("value").alias("normal"), F.array().cast("array<string>").alias("kinds"))
    return changed.unionByName(same)


def _languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs, segments = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "segments")
    model = language.train(docs)
    return language.document_languages(docs, model), language.segment_languages(segments, model, ["video_id", "seg_index"], F.col("words.text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, segments = _languages(spark, sf_dir)
    name = F.concat_ws("#", "video_id", "seg_index")
    both = (
        segments.groupBy("video_id", "seg_index")
        .agg(F.collect_set("lang").alias("langs"))
        .where(F.size("langs") > 1)
        .select(F.lit("segments").alias("table_name"), name.alias("record_id"), F.lit("mixed").alias("issue"), F.explode("langs").alias("lang"))
    )
    own = language.issues(docs).select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("record_id"), "issue", "lang").distinct()
    return own.unionByName(both)


def p5_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir)[0]


def p5_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir)[1].distinct()


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return reading_level.reading_levels(docs, _table(spark, sf_dir, "level_labels"), language.train(docs))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).where("level = 3").select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_chunks": p1_chunks,
    "p1_shares": p1_shares,
    "p3_found": p3_found,
    "p3_shares": p3_shares,
    "p4_found": p4_found,
    "p4_normalised": p4_normalised,
    "p5_found": p5_found,
    "p5_documents": p5_documents,
    "p5_stretches": p5_stretches,
    "p6_packing_2048": _packing(2048),
    "p6_packing_4096": _packing(4096),
    "p6_unused": p6_unused,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_clean": p7_clean,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
}

_TOKENS = "regexp_extract_all(regexp_replace(lower(text), '[՚-՞\\x{00ad}\\x{200b}-\\x{200d}\\x{2060}\\x{feff}\\x{0300}-\\x{036f}]', '', 'g'), '[\\p{L}\\p{N}]+')"
#: Brute force over all diagonals with three equal words in a row, which every passage of items of 25 words and more has.
_LEAKED = f"""with i as (select distinct item_id, {_TOKENS} as w from eval_items where item_id is not null and text is not null), d as (select distinct doc_id, {_TOKENS} as w from documents where doc_id is not null and text is not null),
 ig as (select item_id, unnest(range(1, len(w) - 1)) as k, w from i), dg as (select doc_id, unnest(range(1, len(w) - 1)) as k, w from d),
 it as (select item_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] as g from ig), dt as (select doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] as g from dg),
 di as (select distinct doc_id, item_id, dt.k - it.k as shift from it join dt using (g)),
 e as (select doc_id, item_id, shift, len(i.w) as n, unnest(list_filter(range(1, len(i.w) + 1), lambda k: k + shift between 1 and len(d.w) and i.w[k] = d.w[k + shift])) as k from di join i using (item_id) join d using (doc_id)),
 s as (select *, case when k - lag(k) over p <= 2 then 0 else 1 end as new from e window p as (partition by doc_id, item_id, shift order by k)),
 r as (select *, sum(new) over (partition by doc_id, item_id, shift order by k) as run from s),
 h as (select *, row_number() over (partition by doc_id, item_id, shift, run order by k) as hits, k - min(k) over (partition by doc_id, item_id, shift, run) + 1 as span from r),
 found as (select distinct doc_id, item_id from h where span >= 0.5 * n and hits >= 0.8 * span - 1e-9)"""

ORACLES: dict[str, str] = {
    "p7_found": f"{_LEAKED} select doc_id, item_id from found",
    "p7_clean": f"{_LEAKED} select doc_id, source, n_chars from documents where doc_id is null or doc_id not in (select doc_id from found)",
}
