import math
import random

import pytest
from pyspark.sql import functions as F

from parolumi.functions import stats
from parolumi.operators import evaluation as E


def _wilson(spark, k, n):
    df = spark.createDataFrame([(k, n)], "k int, n int")
    return tuple(df.select(*stats.wilson(F.col("k"), F.col("n"))).first())


@pytest.mark.parametrize(
    "k,n,low,high", [(100, 113, 0.813, 0.932), (26, 28, 0.774, 0.980), (19, 20, 0.764, 0.991), (22, 28, 0.605, 0.898), (17, 20, 0.640, 0.948), (16, 17, 0.730, 0.990)]
)
def test_wilson(spark, k, n, low, high):
    p, lo, hi = _wilson(spark, k, n)
    assert (lo, hi) == (low, high) and lo <= p <= hi


def test_wilson_of_nothing(spark):
    assert _wilson(spark, 0, 0) == (0.0, 0.0, 0.0)


def _kappa(spark, tp, fp, fn, tn):
    rows = [("bad", "bad")] * tp + [("ok", "bad")] * fp + [("bad", "ok")] * fn + [("ok", "ok")] * tn
    return stats.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()


@pytest.mark.parametrize("cells,po,kappa", [((6, 27, 1, 79), 0.752, 0.220), ((1, 0, 1, 56), 0.983, 0.659), ((0, 0, 5, 42), 0.894, 0.0)])
def test_kappa(spark, cells, po, kappa):
    r = _kappa(spark, *cells)
    assert round(r.agreement, 3) == po and round(r.kappa, 3) == kappa


def test_kappa_of_equal_raters(spark):
    df = spark.createDataFrame([("x", "x"), ("y", "y"), (None, "x")], "a string, b string")
    r = stats.kappa(df, "a", "b").first()
    assert r.n == 2 and r.kappa == 1.0
    assert stats.kappa(df.where("false"), "a", "b").first().n == 0


def test_auc_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0.1, 0.2, 0.33, 1.7, -2.5, 14.0]), rng.random() < 0.4) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "s double, y boolean")
    got = stats.auc(df, F.col("s"), F.col("y")).first()
    turned = stats.auc(df, -F.col("s"), F.col("y")).first()
    assert math.isclose(got.auc, want, abs_tol=1e-12) and math.isclose(got.auc + turned.auc, 1.0, abs_tol=1e-12)
    assert stats.auc(df.where("y"), F.col("s"), F.col("y")).first().auc is None


def test_ranked_value_is_upper(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 7), ("c", None)], "g string, v int")
    got = {r.g: r.m for r in stats.ranked_value(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 3, "b": 7}


def test_flag_table(spark):
    rows = [(-0.5, i < 5) for i in range(31)] + [(-0.1, i < 2) for i in range(82)]
    p = E.operating_points(spark.createDataFrame(rows, "s double, y boolean"), "s", F.col("y"), [-0.3]).first()
    assert (p.n_flagged, round(p.precision, 2), round(p.recall, 2), round(p.coverage, 2)) == (31, 0.16, 0.71, 0.27)


def test_confusion_keeps_zero(spark):
    df = spark.createDataFrame([("wrong", "correct"), ("correct", "correct")], "h string, j string")
    got = {(r.truth, r.said): (r.n, r.precision, r.recall) for r in E.confusion(df, "h", "j").collect()}
    assert got[("correct", "correct")] == (1, 0.5, 1.0) and got[("wrong", "correct")] == (1, None, None)
