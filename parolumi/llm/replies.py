"""Replies that are about the request and not about the text: refusals.

A translation depends on what it translates.  Runs of words that come back over sources
which have no word in common, in replies that say nothing of what the word glosses say,
are therefore no translation.  Replies that consist of such runs are the examples from
which a linear machine learns what refusals look like; the machine then judges every
doubtful reply, so a wording that occurs once is found by the words it shares.
No wording is listed here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from parolumi.llm import tails
from parolumi.llm.language import Bags, fit_svm, grams
from parolumi.session import written


class Refusals:
    """A linear machine over the letter n-grams of words; without weights it finds none."""

    def __init__(self, weights: np.ndarray | None = None, least: float = 0.0):
        self.weights, self.least = None if weights is None else weights.astype(np.float32), least
        self.kept: dict[str, float] = {}

    def __getstate__(self):
        return {**self.__dict__, "kept": {}}

    def score(self, words: list[str]) -> float:
        if len(self.kept) > 300_000:
            self.kept.clear()
        total = 0.0
        for w in words:
            s = self.kept.get(w)
            if s is None:
                f = grams(w)
                s = self.kept[w] = float(self.weights[f].sum() / np.sqrt(max(1, len(f))))
            total += s
        return total / max(1, len(words))

    def __call__(self, text: str, least_words: int = 3) -> bool:
        """Whether a text of ``least_words`` words or more refuses."""
        if self.weights is None:
            return False
        words = tails.words_of(text)
        return len(words) >= least_words and self.score(words) > self.least


def with_runs(replies: DataFrame, n: int = 3) -> DataFrame:
    """(reply, sid, source, runs): the hashes of the reply's runs of ``n`` words, and of its source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            words = [tails.words_of(r) for r in f["reply"]]
            yield f.assign(runs=[sorted({tails._hash(n, w[i : i + n]) for i in range(max(1, len(w) - n + 1))}) for w in words])

    kept = replies.where("not faithful").select("reply", "source", F.xxhash64(F.array_sort("source")).alias("sid")).distinct()
    return kept.mapInPandas(run, "reply string, source array<string>, sid bigint, runs array<bigint>")


def independent(replies: DataFrame, least_sources: int = 4, usual: float = 0.2, most_shared: float = 0.5) -> DataFrame:
    """(reply) of which half of the runs or more do not depend on the source: they occur with
    ``least_sources`` sources or more, of which no word that fewer than ``usual`` of all sources have
    is in more than ``most_shared``. Runs and words meet as counts; nothing is collected."""
    rows = written(with_runs(replies), "reply-runs")
    sources = rows.select("sid", "source").dropDuplicates(["sid"])
    total = sources.agg(F.count("*").alias("all_sources"))
    common = sources.select(F.explode(F.array_distinct("source")).alias("word")).groupBy("word").agg(F.count("*").alias("held")).crossJoin(F.broadcast(total)).where(F.col("held") > F.col("all_sources") * usual).select("word")
    runs = rows.select("sid", "source", F.explode("runs").alias("run")).dropDuplicates(["sid", "run"])
    often = runs.groupBy("run").agg(F.count("*").alias("sources")).where(F.col("sources") >= least_sources)
    shared = runs.select("run", F.explode(F.array_distinct("source")).alias("word")).join(common, "word", "left_anti").groupBy("run", "word").agg(F.count("*").alias("n")).groupBy("run").agg(F.max("n").alias("most"))
    free = often.join(shared, "run", "left").where(F.coalesce("most", F.lit(0)) <= F.col("sources") * most_shared).select("run", F.lit(1).alias("free"))
    each = rows.select("reply", "runs").dropDuplicates(["reply"]).select("reply", F.explode("runs").alias("run"))
    return each.join(free, "run", "left").groupBy("reply").agg((F.count("free") * 2 >= F.count("*")).alias("free")).where("free").select("reply")


def learnt(replies: DataFrame, told: DataFrame, most_examples: int = 3_000, steps: int = 90) -> Refusals:
    """The machine for ``replies`` (``doubtful``), fitted on the driver.

    Examples of refusals are replies told by ``independent``, examples of others doubtful
    replies that are not, and faithful ones: of each kind at most ``most_examples``, the most
    frequent. A refusal that the machine's limit, set above nearly all others, leaves out
    is still told by ``independent`` if it recurs.
    """
    kinds = [told, replies.where("not faithful").join(told, "reply", "left_anti"), replies.where("faithful")]

    def few(kind: DataFrame) -> list[tuple[str, int]]:
        # counted by hash; the texts of the few that are left are looked up
        hashed = kind.select("reply", F.xxhash64("reply").alias("h"))
        top = hashed.groupBy("h").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "h").limit(most_examples)
        return sorted((r.reply, r.n) for r in hashed.join(F.broadcast(top), "h").groupBy("h").agg(F.first("reply").alias("reply"), F.first("n").alias("n")).collect())

    some = [few(k) for k in kinds]
    if not some[0]:
        return Refusals()
    y = np.repeat([1.0, -1.0, -1.0], [len(k) for k in some])
    rows = Bags([tails.words_of(t) for k in some for t, _ in k])
    w, b = fit_svm(rows, y, np.sqrt([n for k in some for _, n in k]), steps)
    scores = rows.score(w)
    ours, others = scores[y > 0], scores[y < 0]
    # above all but a few of the others; half-way to the refusals where these lie higher
    high = float(np.quantile(others, 0.999)) if len(others) else -b
    low = float(np.quantile(ours, 0.01))
    return Refusals(w, max(high, (high + low) / 2))


def refusing(replies: DataFrame) -> DataFrame:
    """(reply) of the different replies that refuse, of ``replies`` (reply, source, faithful).

    Those told by ``independent`` and those above the machine's limit, except for replies
    that are a faithful translation elsewhere.
    """
    told = written(independent(replies), "refusals-told")
    machine = replies.sparkSession.sparkContext.broadcast(learnt(replies, told))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: Refusals = machine.value
        for f in frames:
            yield f[[own(t) for t in f["reply"]]]

    by_machine = replies.where("not faithful").select("reply").distinct().mapInPandas(run, "reply string")
    faithful = replies.where("faithful").select(F.xxhash64("reply").alias("h")).distinct()
    return told.unionByName(by_machine).distinct().withColumn("h", F.xxhash64("reply")).join(faithful, "h", "left_anti").select("reply")
