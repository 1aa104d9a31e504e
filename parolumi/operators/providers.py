"""External model calls behind an interface, memoised; the offline providers are column
expressions, so a pipeline can run and be tested without any network."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parolumi.functions import stats, text as X
from parolumi.operators import asr as A

CACHE_SCHEMA = "task string, model string, key string, value string"


class Provider(Protocol):
    """Answers one prompt; raises on failure."""

    name: str

    def __call__(self, prompt: str) -> str: ...


@dataclass
class Echo:
    """The offline provider: answers with the prompt in a JSON object."""

    name: str = "echo"

    def __call__(self, prompt: str) -> str:
        import json

        return json.dumps({"gloss": prompt}, ensure_ascii=False)


def healthy(providers: list[Provider], probe: str = "ping") -> list[Provider]:
    """Those that answer a probe; the others are left out of a run."""
    out = []
    for p in providers:
        try:
            p(probe)
            out.append(p)
        except Exception:  # noqa: BLE001 - any failure means unavailable
            continue
    return out


@dataclass(frozen=True)
class Retry:
    """When a failed call is tried again: up to ``tries`` calls, with pauses that grow
    linearly or double. With ``statuses`` only failures with such a status are tried again
    (an exception tells it by ``status`` or ``status_code``)."""

    tries: int = 4
    pause: float = 1.5
    doubling: bool = False
    statuses: Callable[[int | None], bool] | None = None

    def wait(self, attempt: int) -> float:
        return self.pause * (2**attempt if self.doubling else attempt + 1)

    def again(self, error: Exception) -> bool:
        return self.statuses is None or self.statuses(getattr(error, "status", getattr(error, "status_code", None)))


def passing_status(status: int | None) -> bool:
    """Time-out, too many requests, or a server's own failure."""
    return status is not None and (status in (408, 429) or status >= 500)


#: For calls over HTTP: only failures that may pass are tried again, after 1, 2, 4 ... seconds.
HTTP_RETRY = Retry(tries=4, pause=1.0, doubling=True, statuses=passing_status)


def call(requests: DataFrame, provider: Provider, retry: Retry = Retry()) -> DataFrame:
    """(task, model, key, value, error, seconds, calls) of each request (task, key, prompt). A call
    that fails for good becomes a row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for f in frames:
            rows = []
            for task, key, prompt in zip(f["task"], f["key"], f["prompt"]):
                began, value, error, calls = time.monotonic(), None, None, 0
                while calls < retry.tries:
                    calls += 1
                    try:
                        value, error = provider(prompt), None
                        break
                    except Exception as e:  # noqa: BLE001 - errors become rows
                        error = str(e)
                        if not retry.again(e):
                            break
                        if calls < retry.tries:
                            time.sleep(retry.wait(calls - 1))
                rows.append((task, provider.name, key, value, error, time.monotonic() - began, calls))
            yield pd.DataFrame(rows, columns=["task", "model", "key", "value", "error", "seconds", "calls"])

    return requests.select("task", "key", "prompt").mapInPandas(run, "task string, model string, key string, value string, error string, seconds double, calls int")


def content_text(reply: Column, path: str = "$.choices[0].message.content") -> Column:
    """The text of a model's reply (JSON), whose content is a string or a list of parts: the
    parts' texts joined; trimmed; '' without any text, null for replies that don't parse."""
    parsed = F.try_parse_json(reply)
    content = F.try_variant_get(parsed, path, "variant")
    parts = F.try_variant_get(parsed, path, "array<variant>")
    texts = F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    plain = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    return F.when(parsed.isNotNull(), F.trim(F.coalesce(F.array_join(texts, ""), plain, F.lit(""))))


def memoised(requests: DataFrame, cache: DataFrame, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all answers, new cache rows): requests found in the cache are not asked again.

    ``requests`` has task, model, key; the cache is keyed by the three, the model included,
    so that another model's answers are never reused.
    """
    id_ = ["task", "model", "key"]
    asked = requests.dropDuplicates(id_)
    fresh = answer(asked.join(cache.select(*id_), id_, "left_anti")).select(*id_, "value")
    return asked.select(*id_).join(cache.unionByName(fresh), id_).select(*id_, "value"), fresh


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows, and the old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def ladder(attempts: DataFrame, key: list[str], rung: list[str], reason: str, text: str) -> DataFrame:
    """The first attempt, in order of ``rung`` (a rung and the tries on it, say), that no gate
    rejected; clips of which all were rejected keep an empty text and the last attempt's reason."""
    at = F.struct(*rung)
    good = F.min_by(F.struct(*rung, text), F.when(F.col(reason).isNull(), at))
    g = attempts.groupBy(*key).agg(good.alias("g"), F.count_if(F.col(reason).isNull()).alias("n"), F.max_by(reason, at).alias("last"))
    some = F.col("n") > 0
    return g.select(*key, *[F.when(some, F.col(f"g.{r}")).alias(r) for r in rung], F.when(some, F.col(f"g.{text}")).otherwise("").alias(text), F.when(~some, F.col("last")).alias(reason))


def rescued(results: DataFrame, pieces: DataFrame, key: list[str], position: list[str], reason: str, text: str) -> DataFrame:
    """``results`` of a ladder in which clips that failed as a whole get the joined texts of
    their ``pieces`` (key, position, text), in order, blank ones left out. Adds rescued."""
    failed = results.where(F.col(reason).isNotNull()).select(*key)
    said = pieces.where(F.trim(F.coalesce(text, F.lit(""))) != "").join(failed, key, "left_semi")
    joined = said.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*position, F.trim(text).alias("_t")))).alias("_p")).select(*key, F.array_join(F.transform("_p", lambda p: p["_t"]), " ").alias("_joined"))
    saved = F.col("_joined").isNotNull()
    return results.join(joined, key, "left").withColumns({text: F.coalesce("_joined", text), reason: F.when(~saved, F.col(reason)), "rescued": saved}).drop("_joined")


def padded(glosses: Column, n: Column) -> Column:
    """Glosses cut or filled with '' to ``n``."""
    return F.slice(F.concat(F.coalesce(glosses, F.array().cast("array<string>")), F.array_repeat(F.lit(""), n)), F.lit(1), n)


def merged(words: Column, glosses: Column) -> Column:
    """Words with the glosses at their places as translations."""
    return F.zip_with(words, padded(glosses, F.size(words)), lambda w, g: F.struct(w["text"].alias("text"), w["start_s"].alias("start_s"), w["end_s"].alias("end_s"), g.alias("translation"), w["logprob"].alias("logprob")))


def _filled(template: str, **fields: Column) -> Column:
    """A template with its {fields} filled in; null fields count as empty."""
    parts = re.split(r"(\{\w+\})", template)
    return F.concat(*[F.coalesce(fields[p[1:-1]], F.lit("")) if p[:1] == "{" and p[1:-1] in fields else F.lit(p) for p in parts if p])


#: Requests to a model, by task; all ask for one JSON object.
PROMPTS = {
    "translate": "Sentence: {sentence}\nGive the translation into {language} and {count} glosses, one per token, in order:\n{tokens}",
    "judge_gloss": "Phrase: {phrase}\nWord: {word}\nGloss: {gloss}\nIs the gloss right for the word in this phrase? Answer with verdict (correct, acceptable or wrong), best gloss and reason.",
    "gloss_in_context": "Phrase: {phrase}\nGive the gloss of the word {word} as it is meant in this phrase.",
    "gloss_alone": "Give the most usual gloss of the word {word}.",
    "match": "Phrase: {phrase}\nWord: {word}\nRight gloss: {gold}\nOther gloss: {gloss}\nDo both mean the same here? Answer with match (true or false).",
    "judge_note": "Sentence: {phrase}\nWord: {word} ({gloss})\nClaim: {note}\nIs the claim true of the word here? Answer with verdict (correct, partial or wrong), reason and correction.",
}


def prompt(task: str, **fields: Column) -> Column:
    return _filled(PROMPTS[task], **fields)


def translate_prompt(sentence: Column, tokens: Column, language: str = "Russian") -> Column:
    """The request for a sentence's translation and one gloss per token."""
    listed = F.array_join(F.transform(tokens, lambda t, i: F.concat(i.cast("string"), F.lit(": "), t)), "\n")
    return prompt("translate", sentence=sentence, language=F.lit(language), count=F.size(tokens).cast("string"), tokens=listed)


def shown_examples(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row: the judged ``rows`` (key, seg_text, word, gloss, verdict, correction) as a block of
    worked examples, by key, to stand before a request. The examples are a few exemplars."""
    best = F.coalesce(F.nullif(F.trim("correction"), F.lit("")), "gloss")
    one = _filled("Phrase: {phrase}\nWord: {word}\nGloss: {gloss}\nverdict: {verdict}, best gloss: {best}", phrase=F.col("seg_text"), word=F.col("word"), gloss=F.col("gloss"), verdict=F.col("verdict"), best=best)
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, one.alias("t")))), lambda x: x["t"]), "\n\n").alias("examples"))


def offline_translation(sentence: Column, tokens: Column, language: str = "Russian") -> Column:
    """The offline provider's answer: struct of sentence and glosses."""
    return F.struct(F.concat(F.lit(f"[{language}] "), sentence).alias("sentence"), F.transform(tokens, lambda t: F.concat(F.lit("g:"), t)).alias("glosses"))


def bakeoff(answers: DataFrame) -> DataFrame:
    """How each model's answers hold up: ``answers`` has model, seconds, error, sentence,
    glosses (array), n_words, incumbent (the translation in use).

    Shares of segments without an answer and with a wrong number of glosses; non-empty glosses
    without Cyrillic by word; mean chrF++ against the incumbent; upper median of seconds.
    """
    none = F.array().cast("array<string>")
    rows = answers.select(
        "model",
        "seconds",
        (F.col("error").isNotNull() | (F.coalesce("sentence", F.lit("")) == "")).cast("int").alias("empty"),
        (F.size(F.coalesce("glosses", none)) != F.col("n_words")).cast("int").alias("mismatch"),
        F.size(F.filter(F.coalesce("glosses", none), lambda g: (F.coalesce(g, F.lit("")) != "") & ~X.has_cyrillic(g))).alias("foreign"),
        "n_words",
        F.coalesce("sentence", F.lit("")).alias("sentence"),
        F.coalesce("incumbent", F.lit("")).alias("incumbent"),
    )
    like = A.chrf(rows, F.col("sentence"), F.col("incumbent"), [c for c in rows.columns if c not in ("sentence", "incumbent")])
    share = lambda c: F.round(F.avg(c), 6).alias(f"{c}_rate")
    board = like.groupBy("model").agg(F.count("*").alias("segments"), share("empty"), share("mismatch"), F.round(F.sum("foreign") / F.greatest(F.lit(1), F.sum("n_words")), 6).alias("non_cyrillic_rate"), F.round(F.avg("chrf"), 1).alias("chrf_vs_incumbent"))
    return board.join(stats.ranked_value(answers, ["model"], "seconds", {"median_seconds": 0.5}).drop("n"), "model", "left")


def gate_passed(kappa: float | None, least: float = 0.4) -> bool:
    """Whether a judge agrees with people well enough to be let loose on all data."""
    return kappa is not None and kappa >= least
