"""Reading level of documents, comparable across languages.

A linear ranker is learnt from pairs of graded documents (the more demanding one
has to score higher); isotonic regression turns its scores into the graders' scale.
Vocabulary features are relative to the language's own words: the mean word length
of a sentence is divided by that of its language over all documents. Which words
demanding documents use, a linear machine learns from the graded ones' sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from parolumi.llm.language import Bags, Model, Sentences, fit_svm, in_slices, sentences_of, words_of
from parolumi.session import bounded_sample, spread, written

#: Features of a document, in order.
FEATURES = ["word_length", "long_share", "long_sentences", "demanding_share", "demanding_sentences", "both_share", "mostly_both", "single", "log_sentence", "beyond_twelve", "commas"]

_STATS = "doc_id bigint, lang array<string>, words array<int>, letters array<int>, commas array<int>, piece array<boolean>, demand array<boolean>"


def sentence_stats(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the words, letters and commas of its sentences and their languages."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = told.value
        for f in frames:
            for first, texts in in_slices(f["text"]):
                got = Sentences(m, texts)
                bounds = np.searchsorted(got.text, np.arange(len(texts) + 1))
                cut = lambda a: [a[x:y] for x, y in zip(bounds[:-1], bounds[1:])]  # noqa: B023, E731
                yield pd.DataFrame(
                    {
                        "doc_id": f["doc_id"].to_numpy()[first : first + len(texts)],
                        "lang": cut(got.lang),
                        "words": cut(got.words.astype("int32")),
                        "letters": cut(got.letters.astype("int32")),
                        "commas": cut(got.commas.astype("int32")),
                        "piece": cut(got.piece),
                        "demand": cut(got.further > 0),
                    }
                )

    kept = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return spread(kept).mapInPandas(run, _STATS)


def baselines(stats: DataFrame) -> dict[str, float]:
    """Letters a word of each language has, over all documents."""
    zipped = stats.select(F.explode(F.arrays_zip("lang", "words", "letters")).alias("s"))
    rows = zipped.groupBy("s.lang").agg((F.sum("s.letters") / F.sum("s.words")).alias("n")).collect()
    return {r.lang: r.n for r in rows}


def features(stats: DataFrame, base: dict[str, float], long_excess: float = 0.8, mostly: float = 0.4) -> DataFrame:
    """``stats`` with the columns FEATURES; texts without words get nulls.

    A sentence has long words if their mean length exceeds the language's by
    ``long_excess`` divided by the root of its number of words: means of few words vary
    more. long_share and long_sentences are the shares of words and of sentences in such
    sentences, demanding_share and demanding_sentences in those with a demanding vocabulary,
    both_share in those with both; mostly_both is 1 from a share of ``mostly`` of the sentences
    on; single is 1 for a text of one sentence. log_sentence
    (logarithm of the words in a sentence),
    beyond_twelve (what it has beyond twelve words) and commas (per word) are null
    where most of a text has no sentence marks.
    """
    table = F.create_map(*[F.lit(x) for k, v in sorted(base.items()) for x in (k, float(v))]) if base else F.create_map().cast("map<string,double>")
    s = F.arrays_zip("lang", "words", "letters", "commas", "piece", "demand")
    rel = F.transform(
        s,
        lambda x: F.struct(
            x["words"].alias("words"),
            (x["letters"] / x["words"] / table[x["lang"]]).alias("ratio"),
            F.when(x["piece"], 0).otherwise(x["words"]).alias("whole"),
            F.when(x["piece"], 0).otherwise(x["commas"]).alias("commas"),
            x["demand"].alias("demand"),
        ),
    )
    d = stats.where(F.size("words") > 0).withColumn("s", rel)
    sums = ["n", "whole", "sentences", "marks", "length", "long_words", "long_parts", "hard_words", "hard_parts", "both_words", "both_parts"]
    zero = F.struct(*[F.lit(0.0).alias(c) for c in sums])

    def step(acc: Column, x: Column) -> Column:
        long = (x["ratio"] - 1) * F.sqrt(x["words"].cast("double")) >= long_excess
        more = {
            "n": x["words"].cast("double"),
            "whole": x["whole"].cast("double"),
            "sentences": F.when(x["whole"] > 0, 1.0).otherwise(0.0),
            "marks": x["commas"].cast("double"),
            "length": x["words"] * x["ratio"],
            "long_words": F.when(long, x["words"].cast("double")).otherwise(0.0),
            "long_parts": F.when(long, 1.0).otherwise(0.0),
            "hard_words": F.when(x["demand"], x["words"].cast("double")).otherwise(0.0),
            "hard_parts": F.when(x["demand"], 1.0).otherwise(0.0),
            "both_words": F.when(long & x["demand"], x["words"].cast("double")).otherwise(0.0),
            "both_parts": F.when(long & x["demand"], 1.0).otherwise(0.0),
        }
        return F.struct(*[(acc[c] + more[c]).alias(c) for c in sums])

    d = d.select("doc_id", F.size("s").alias("parts"), F.aggregate("s", zero, step).alias("t")).select("doc_id", "parts", "t.*")
    marked = F.col("whole") * 2 >= F.col("n")
    log_sentence = F.when(marked, F.log(F.greatest(F.lit(1.0), F.col("whole") / F.greatest(F.lit(1.0), F.col("sentences")))))
    return d.select(
        "doc_id",
        (F.col("length") / F.col("n")).alias("word_length"),
        (F.col("long_words") / F.col("n")).alias("long_share"),
        (F.col("long_parts") / F.col("parts")).alias("long_sentences"),
        (F.col("hard_words") / F.col("n")).alias("demanding_share"),
        (F.col("hard_parts") / F.col("parts")).alias("demanding_sentences"),
        (F.col("both_words") / F.col("n")).alias("both_share"),
        F.when(F.col("both_parts") >= F.col("parts") * mostly, 1.0).otherwise(0.0).alias("mostly_both"),
        F.when(F.col("parts") == 1, 1.0).otherwise(0.0).alias("single"),
        log_sentence.alias("log_sentence"),
        F.greatest(F.lit(0.0), log_sentence - F.log(F.lit(12.0))).alias("beyond_twelve"),
        F.when(marked, F.col("marks") / F.greatest(F.lit(1.0), F.col("whole"))).alias("commas"),
    ).withColumn("beyond_twelve", F.when(F.col("log_sentence").isNotNull(), F.col("beyond_twelve")))


def majority(labels: DataFrame, doc_id: str = "doc_id", rater: str = "rater", level: str = "level") -> DataFrame:
    """(doc_id, level) most raters gave; of equally frequent ones the middle. Rows
    repeated in full count once; rows with a null are left out."""
    one = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(rater).alias("r"), F.col(level).cast("int").alias("level")).dropna().distinct()
    votes = one.groupBy("doc_id", "level").agg(F.count("*").alias("n"))
    best = votes.withColumn("top", F.max("n").over(W.partitionBy("doc_id"))).where("n = top")
    return best.groupBy("doc_id").agg(F.sort_array(F.collect_list("level")).alias("l")).select("doc_id", F.expr("l[cast((size(l) - 1) / 2 as int)]").alias("level"))


class Ranker:
    """A linear score and the steps that turn it into levels. A feature that is
    missing counts as its mean."""

    def __init__(self, x: np.ndarray, y: np.ndarray, pairs: int = 400_000, steps: int = 400, reg: float = 1e-3):
        there = ~np.isnan(x)
        self.mean = np.where(there, x, 0).sum(0) / np.maximum(1, there.sum(0))
        x = np.where(there, x, self.mean)
        spread = x.std(0) if len(x) else np.ones(len(FEATURES))
        self.spread = np.where(spread > 1e-9, spread, 1.0)
        z = (x - self.mean) / self.spread
        hi, lo = self._pairs(y, pairs)
        d = z[hi] - z[lo]
        w, v = np.zeros(len(FEATURES)), np.zeros(len(FEATURES))
        if len(d):
            # every pair of levels weighs the same, whatever the number of documents
            kind = y[hi] * 1000 + y[lo]
            _, inverse, count = np.unique(kind, return_inverse=True, return_counts=True)
            c = 1 / count[inverse] / len(count)
            rate = 1 / (2 * (d**2).sum(1).max())
            for t in range(1, steps + 1):
                slack = np.maximum(0, 1 - d @ v)
                w2 = v - rate * (-2 * (c * slack) @ d + reg * v)
                v = w2 + (t - 1) / (t + 2) * (w2 - w)
                w = w2
        self.w = w
        self.graded = len(y)
        self.levels = sorted(set(y.tolist())) or [1]
        self.knots, self.values = self._isotonic(z @ w, y.astype(float)) if len(y) else (np.zeros(1), np.array([1.0]))

    @staticmethod
    def _pairs(y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of unequal levels, or ``most`` of them drawn with a fixed seed."""
        n = len(y)
        if n * n <= 4 * most:
            hi, lo = np.nonzero(y[:, None] > y[None, :])
            return hi, lo
        rng = np.random.default_rng(7)
        a, b = rng.integers(0, n, 4 * most), rng.integers(0, n, 4 * most)
        a, b = a[y[a] != y[b]][:most], b[y[a] != y[b]][:most]
        return np.where(y[a] > y[b], a, b), np.where(y[a] > y[b], b, a)

    @staticmethod
    def _isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pools adjacent violators: block centres of the score and rising means."""
        order = np.lexsort((y, score))
        blocks: list[list[float]] = []  # sum of y, sum of score, number
        for i in order:
            blocks.append([y[i], score[i], 1.0])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][2] >= blocks[-1][0] / blocks[-1][2]:
                b = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], b)]
        return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])

    def cuts(self) -> list[float]:
        """Scores at which the calibrated level, interpolated between blocks, passes
        half-way to the next level."""
        out = []
        for a, b in zip(self.levels, self.levels[1:]):
            half = (a + b) / 2
            if half < self.values[0] or half > self.values[-1]:
                out.append(float("-inf") if half < self.values[0] else float("inf"))
            else:
                out.append(float(np.interp(half, self.values, self.knots)))
        return out

    def score(self) -> Column:
        out = F.lit(0.0)
        for name, w, m, s in zip(FEATURES, self.w, self.mean, self.spread):
            out = out + F.coalesce((F.col(name) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w)), F.lit(0.0))
        return out

    def level(self, score: Column) -> Column:
        out = F.lit(self.levels[0])
        for lv, cut in zip(self.levels[1:], self.cuts()):
            if cut == float("-inf"):
                out = F.lit(lv)
            elif cut != float("inf"):
                out = F.when(score >= cut, lv).otherwise(out)
        return out


def demanding_vocabulary(docs: DataFrame, labels: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 4000, max_sentences: int = 12_000, longest: int = 50_000, rounds: int = 2) -> Model:
    """``model`` with a machine that tells sentences of the highest level from those of the lowest.

    Fitted on the driver, on the sentences of at most ``sample_docs`` graded documents of
    these levels (lowest hash of id) of ``longest`` characters at most, of which
    ``max_sentences`` at most are taken at even steps. Demanding documents have plain
    sentences, too: those that the machine takes for plain are left out and it is fitted again.
    """
    graded = majority(labels)
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t")).where(F.length("t") <= longest)
    ends = graded.agg(F.min("level").alias("low"), F.max("level").alias("high"))
    rows = graded.crossJoin(F.broadcast(ends)).where("low < high and (level = low or level = high)").select("doc_id", (F.col("level") == F.col("high")).alias("high"))
    # at most ``sample_docs`` ids are sent to the texts
    rows = sorted(texts.join(F.broadcast(bounded_sample(rows, "doc_id", sample_docs)), "doc_id").dropDuplicates(["doc_id"]).collect())
    bags, high = [], []
    for r in rows:
        for s in sentences_of(r.t):
            if words := words_of(s):
                bags.append(words)
                high.append(r.high)
    step = max(1, -(-len(bags) // max_sentences))
    bags, y = bags[::step], np.where(np.array(high[::step], dtype=bool), 1.0, -1.0)
    if not (y > 0).any() or not (y < 0).any():
        return model.with_machine(np.zeros(len(model.weights)), -1.0)
    cache: dict[str, np.ndarray] = {}
    every, kept = Bags(bags, cache), np.arange(len(bags))
    for n in range(rounds + 1):
        w, b = fit_svm(Bags([bags[i] for i in kept], cache), y[kept], np.ones(len(kept)))
        fitting = np.flatnonzero((y < 0) | (every.score(w) + b > 0))
        if not (y[fitting] > 0).any():
            break
        kept = fitting
    return model.with_machine(w, b)


def train_ranker(feats: DataFrame, labels: DataFrame, sample_docs: int = 20_000) -> Ranker:
    """Fits on the driver, on at most ``sample_docs`` graded documents (lowest hash of id)."""
    graded = bounded_sample(majority(labels).where("doc_id is not null"), "doc_id", sample_docs)
    # in order of id, so that the pairs drawn are the same on any cluster
    rows = feats.join(graded, "doc_id").select("doc_id", *FEATURES, "level").toPandas().sort_values("doc_id", kind="stable")
    return Ranker(rows[FEATURES].to_numpy(float), rows["level"].to_numpy())


def reading_levels(docs: DataFrame, labels: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, level, features) of every document.

    Null, empty and wordless texts have no reading level: they get null score and
    level. Rows with a null id are left out; repeated rows give repeated rows. Without
    usable labels no document has a score or a level. Extra columns are ignored.
    """
    model = demanding_vocabulary(docs, labels, model, doc_id, text)
    stats = written(sentence_stats(docs, model, doc_id, text), "sentence-stats")
    feats = written(features(stats, baselines(stats)), "reading-features")
    ranker = train_ranker(feats, labels)
    scored = feats.withColumn("score", ranker.score())
    scored = scored.withColumn("level", ranker.level(F.col("score")).cast("int"))
    if not ranker.graded:
        scored = scored.withColumns({"score": F.lit(None).cast("double"), "level": F.lit(None).cast("int")})
    none = stats.where(F.size("words") <= 0).select("doc_id")
    return scored.select("doc_id", "score", "level", *FEATURES).unionByName(none, allowMissingColumns=True)
