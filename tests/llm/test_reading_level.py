import random

import numpy as np
import pandas as pd

from parolumi.llm import language as L, reading_level as R

EASY, HARD = "we go to the old red house and see my cat".split(), "constitutional interdependence reconceptualises methodological representativeness notwithstanding epistemic regularisation".split()


def test_ranker_orders_and_calibrates():
    rng = np.random.default_rng(1)
    y = rng.integers(1, 4, 300)
    x = np.stack([y + rng.normal(0, 0.4, 300)] + [rng.normal(0, 1, 300) for _ in R.FEATURES[1:]], 1)
    x[::17, 2] = np.nan
    r = R.Ranker(x, y)
    z = (np.where(np.isnan(x), r.mean, x) - r.mean) / r.spread
    level = np.array(r.levels)[np.searchsorted(r.cuts(), z @ r.w, side="right")]
    assert (level == y).mean() > 0.8 and r.cuts() == sorted(r.cuts()) and (np.diff(r.values) >= 0).all()


def test_isotonic_is_least_squares():
    score, y = np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 3, 2, 2, 5])
    knots, values = R.Ranker._isotonic(score, y)
    assert values.tolist() == [1.0, 7 / 3, 5.0] and knots.tolist() == [1.0, 3.0, 5.0]


def test_majority(spark):
    rows = [(1, "a", 3), (1, "a", 3), (1, "b", 1), (1, "c", 1), (2, "a", 2), (2, "b", 3), (3, "a", None), (None, "a", 1), (4, "a", 1), (4, "b", 2), (4, "c", 3)]
    got = {r.doc_id: r.level for r in R.majority(spark.createDataFrame(rows, "doc_id bigint, rater string, level int")).collect()}
    assert got == {1: 1, 2: 2, 4: 2}


def test_levels(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(120):
        level = 1 + i % 3
        words, n = (HARD, 18) if level == 3 else (EASY, 5 if level == 1 else 16)
        rows.append((i, " ".join(" ".join(rng.choice(words) for _ in range(n)) + "." for _ in range(8)), "en", 0.5))
        labels += [(i, r, level) for r in "abc"] if i % 2 else []
    rows += [(900, None, "en", 0.1), (901, "", "en", 0.1), (902, "?!", None, 0.1), (None, "we go.", "en", 0.1), (903, "we go " * 50_000, "en", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    lab = spark.createDataFrame(labels, "doc_id bigint, rater string, level int")
    model = L.train(docs)
    got = {r.doc_id: r.level for r in R.reading_levels(docs, lab, model).collect()}
    assert all(got[i] == 1 + i % 3 for i in range(120)) and got[900] is got[901] is got[902] is None and got[903] in (1, 2) and len(got) == 124
    assert {r.level for r in R.reading_levels(docs, lab.where("false"), model).collect()} == {None}
    assert R.reading_levels(docs.where("false"), lab, model).count() == 0


def test_demanding_vocabulary(spark):
    rng = random.Random(4)
    text = lambda words, n: ". ".join(" ".join(rng.choice(words) for _ in range(8)) for _ in range(n)) + ". "
    rows = [(i, text(HARD, 3) + text(EASY, 3) if i % 2 else text(EASY, 6)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, "a", 3 if i % 2 else 1) for i in range(60)], "doc_id bigint, rater string, level int")
    model = R.demanding_vocabulary(docs, lab, L.fit([EASY], ["en"]))
    got = L.Sentences(model, [". ".join([" ".join(HARD), " ".join(EASY)]) + "."])
    assert (got.further > 0).tolist() == [True, False]
    none = R.demanding_vocabulary(docs, lab.where("level = 1"), L.fit([EASY], ["en"]))
    assert (L.Sentences(none, ["we go."]).further > 0).tolist() == [False]


def test_stats_count_words():
    model = L.fit([["we", "go"]], ["en"])
    s = L.Sentences(model, ["We go, home. See!\nmy old cat", None, "", "one " * 100])
    assert s.words.tolist()[:3] == [3, 1, 3] and s.text.tolist()[:3] == [0, 0, 0]
    assert s.words[s.text == 3].sum() == 100 and s.piece[s.text == 3].all() and s.commas.tolist()[0] == 1
    assert isinstance(pd.Series(s.lang), pd.Series)
