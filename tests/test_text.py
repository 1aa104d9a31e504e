import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parolumi.functions import distance as D, text as X
from parolumi.operators import asr as A


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_normalisers_differ(spark):
    t = "Գիտե՞ս, Եւ այո։"
    assert one(spark, F.array_join(X.words(X.wer_norm(F.col("t"))), " "), t=t) == "գիտե ս և այո"
    assert one(spark, F.array_join(X.words(X.quality_norm(F.col("t"))), " "), t=t) == "գիտե՞ս և այո"
    assert one(spark, X.form_norm(F.col("t")), t=t) == "ԳիտեսԵւայո"
    assert one(spark, X.gloss_norm(F.col("t")), t=t) == "գիտեսեւայո"
    assert one(spark, X.profile_norm(F.col("t")), t=t) == "Գիտե՞ս, Եւ այո"
    assert one(spark, X.form_norm(F.col("t")), t=None) == ""


@pytest.mark.parametrize("repeats,rest,loop", [(15, 20, True), (14, 0, False), (15, 55, False)])
def test_loop(spark, repeats, rest, loop):
    text = " ".join(["a b c d e"] * repeats + [f"w{i}" for i in range(rest)])
    w = text.split()
    top = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)).most_common(1)[0][1]
    assert one(spark, X.is_loop(F.col("t")), t=text) is (len(w) >= 20 and top >= 15 and top * 5 / len(w) > 0.6) is loop


def test_degenerate(spark):
    c = X.degenerate(F.col("t"), F.col("s").cast("double"))
    assert one(spark, c, t="hello there", s="1") == "wrong script"
    assert one(spark, c, t="ա " * 40, s="4") == "impossible rate"
    assert one(spark, c, t="բարև ձեզ", s="4") is None
    assert one(spark, c, t="", s=None) is None


def test_script_share(spark):
    assert one(spark, X.script_share(F.col("t")), t="աբ ab") == 50.0
    assert one(spark, X.script_share(F.col("t")), t="12") is None


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def infix(ref, hyp):
    return min(levenshtein(ref, hyp[i:j]) for i in range(len(hyp) + 1) for j in range(i, len(hyp) + 1))


def test_distances_brute_force(spark):
    rng = random.Random(1)
    pairs = [([rng.choice("աbвg") for _ in range(rng.randint(0, 7))], [rng.choice("աbвg") for _ in range(rng.randint(0, 9))]) for _ in range(120)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r.i: (r.d, r.f) for r in df.select("i", D.token_distance(F.col("a"), F.col("b")).alias("d"), D.infix_edits(F.array_join("a", " "), F.array_join("b", " "))["words"].alias("f")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == (levenshtein(a, b), infix(a, b)), (a, b)
        assert got[i][1] <= got[i][0]


def test_many_tokens(spark):
    a = [f"t{i}" for i in range(40_000)]
    df = spark.createDataFrame([(a[:30_000], a[1:30_000] + ["x"])], "a array<string>, b array<string>")
    codes = df.select(F.size(F.array_distinct(F.concat("a", "b"))).alias("n"), F.decode(F.unhex(F.lpad(F.hex(F.lit(0xFFFF + 40_000)), 8, F.lit("0"))), "UTF-32").alias("c")).first()
    assert codes.n == 30_001 and codes.c == chr(0xFFFF + 40_000)
    pairs = [(["a"] * k, [chr(0x4E00 + i) for i in range(k)]) for k in (0, 1, 300)]
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(D.token_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [0, 1, 300]


def chrf_plain(hyp, ref):
    def f(h, r):
        if not h or not r:
            return None
        both = sum((h & r).values())
        if not both:
            return 0.0
        p, q = both / sum(h.values()), both / sum(r.values())
        return 5 * p * q / (4 * p + q)

    grams = lambda s, n: Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    hc, rc, hw, rw = "".join(hyp.split()), "".join(ref.split()), hyp.split(), ref.split()
    scores = [f(grams(hc, n), grams(rc, n)) for n in range(1, 7)] + [f(grams(hw, n), grams(rw, n)) for n in (1, 2)]
    scores = [s for s in scores if s is not None]
    return 100 * sum(scores) / len(scores) if scores else 0.0


def test_chrf_brute_force(spark):
    pairs = [("кот сидит дома", "кот сидит дома"), ("кот", "собака спит"), ("", "слово"), ("аааа аа", "ааа ааа"), ("a", "a")]
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "i int, h string, r string")
    got = {r.i: r.chrf for r in A.chrf(df, F.col("h"), F.col("r"), ["i"]).collect()}
    for i, (h, r) in enumerate(pairs):
        assert abs(got[i] - chrf_plain(h, r)) < 1e-4
    assert got[0] == 100.0


def test_error_rates(spark):
    rows = [("m", "x", "մեկ երկու", "մեկ երեք"), ("m", "x", "", "ավել"), ("m", "y", "ա բ գ", "զ ա բ գ դ")]
    df = spark.createDataFrame(rows, "model string, cat string, ref string, hyp string")
    glob = {(r.model, r.cat): r.wer for r in A.error_rates(df, F.col("ref"), F.col("hyp"), "model", "cat").collect()}
    inf = {(r.model, r.cat): r.wer for r in A.error_rates(df, F.col("ref"), F.col("hyp"), "model", "cat", infix=True).collect()}
    assert glob[("m", "x")] == round(2 / 3, 6) and glob[("m", "ALL")] == round(4 / 6, 6)
    assert inf[("m", "y")] == 0.0
