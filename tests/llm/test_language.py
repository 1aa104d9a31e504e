import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from parolumi.llm import language as L

WORDS = {
    "hy": "տատիկը բանալին գտնում է շուկայում առավոտյան մեր ընկերը նամակը գրում գրադարանում հարևանը երգը լսում".split(),
    "ru": "бабушка находит ключ на рынке утром наш друг пишет письмо в библиотеке сосед слушает песню".split(),
    "en": "grandmother finds the key at market in morning our friend writes a letter library neighbour hears song".split(),
    "fr": "grand mère trouve la clé au marché le matin notre ami écrit une lettre à bibliothèque voisin écoute".split(),
    "fa": "مادربزرگ کلید را در بازار پیدا می‌کند دوست ما نامه می‌نویسد همسایه ترانه می‌شنود".split(),
}
LATIN_HY = "tatiky banalin gtnum e shukayum aravotyan mer ynkery namaky grum gradaranum harevany ergy lsum".split()


def sentence(rng, words, n=8):
    return " ".join(rng.choice(words) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rows, truth = [], {}
    for i in range(600):
        lang = rng.choice(list(WORDS))
        words = LATIN_HY if lang == "hy" and i % 5 == 0 else WORDS[lang]
        label = lang if rng.random() < 0.9 else rng.choice(["hy", "ru", "en", "fr", "fa", "de", None, "und"])
        rows.append((i, " ".join(sentence(rng, words) for _ in range(6)), label))
        truth[i] = lang
    return rows, truth


@pytest.fixture(scope="module")
def model(spark, corpus):
    return L.train(spark.createDataFrame(corpus[0], "doc_id bigint, text string, lang string"))


def test_accuracy_on_noisy_labels(spark, corpus, model):
    got = L.document_languages(spark.createDataFrame(corpus[0], "doc_id bigint, text string, lang string"), model).collect()
    assert sum(r.detected == corpus[1][r.doc_id] for r in got) / len(got) > 0.98
    assert all(0 <= r.confidence <= 1 for r in got)


def test_labels(spark):
    rows = [("hy-AM", "hy"), ("Armenian", "hy"), (" RU ", "ru"), ("fra", "fr"), ("und", None), ("", None), (None, None), ("n/a", None), ("el", "el"), ("Persian", "fa"), ("en_US", "en")]
    df = spark.createDataFrame(rows, "l string, w string")
    assert [r[0] for r in df.select(L.label_language(F.col("l"))).collect()] == [w for _, w in rows]


def test_issues(spark, model):
    rng = random.Random(9)
    s = lambda lang, k=6: " ".join(sentence(rng, WORDS[lang]) for _ in range(k))
    rows = [
        (1, s("ru"), None), (2, s("fr"), "en"), (3, s("en", 4) + " " + s("ru", 2), "eng"), (4, s("hy"), "hye"), (5, s("en", 20) + " " + s("fr", 1), "en"),
        (6, None, None), (7, "", "en"), (8, "123 ...", "en"), (9, s("hy").replace(".", "") + " " + s("ru").replace(".", ""), "hy"), (4, s("hy"), "hye"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, lang string, detected string")
    got = sorted(map(tuple, L.issues(L.document_languages(df, model)).distinct().collect()))
    assert got == [(1, "missing", "ru"), (2, "wrong", "fr"), (3, "mixed", "en"), (3, "mixed", "ru"), (9, "mixed", "hy"), (9, "mixed", "ru")]
    assert L.document_languages(df.where("false"), model).count() == 0


def test_segments(spark, model):
    rows = [
        (1, WORDS["hy"][:5] + WORDS["en"][:3]), (2, WORDS["hy"][:5] + ["OK", "online"]), (3, LATIN_HY[:4] + WORDS["hy"][:4]), (4, []), (5, None), (6, [None, "", "12"]),
        (7, WORDS["ru"][:3] + ["12"] + WORDS["hy"][:6]),
    ]
    df = spark.createDataFrame(rows, "k int, w array<string>")
    by = {}
    for r in L.segment_languages(df, model, ["k"], F.col("w")).collect():
        by.setdefault(r.k, set()).add(r.lang)
    assert by[1] == {"hy", "en"} and by[2] == {"hy"} and by[3] == {"hy"} and by[7] == {"ru", "hy"} and not {4, 5, 6} & set(by)


def test_segments_in_one_script(spark, model):
    rows = [
        (1, WORDS["en"][:6] + WORDS["fr"][1:5] + WORDS["en"][6:12]), (2, LATIN_HY[:6] + WORDS["en"][:4]), (3, WORDS["hy"][:5] + LATIN_HY[:4] + WORDS["en"][8:12]),
        (4, WORDS["en"]), (5, WORDS["fr"][:4] + WORDS["en"][:1] + WORDS["fr"][4:]), (6, LATIN_HY),
    ]
    df = spark.createDataFrame(rows, "k int, w array<string>")
    by = {}
    for r in L.segment_languages(df, model, ["k"], F.col("w")).collect():
        by.setdefault(r.k, set()).add(r.lang)
    assert by == {1: {"en", "fr"}, 2: {"hy", "en"}, 3: {"hy", "en"}, 4: {"en"}, 5: {"fr"}, 6: {"hy"}}


def test_short_text_without_marks(spark, model):
    rows = [(1, " ".join(WORDS["hy"][:9] + WORDS["ru"][:5]), "hy"), (2, " ".join(WORDS["en"][:8] + WORDS["fr"][1:9]), "en"), (3, " ".join(WORDS["en"]), "en"), (4, " ".join(WORDS["hy"][:9] + WORDS["ru"][:1]), "hy")]
    got = L.issues(L.document_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model)).collect()
    assert sorted(map(tuple, got)) == [(1, "mixed", "hy"), (1, "mixed", "ru"), (2, "mixed", "en"), (2, "mixed", "fr")]


def test_borders_are_the_best():
    rng = np.random.default_rng(3)
    for n, least, begun, goes_on in [(n, least, b, g) for n in range(4, 9) for least in (1, 2, 3) for b in (False, True) for g in (False, True)]:
        scores, price = rng.normal(0, 2, (n, 3)), 1.5
        worth = {}
        for inner in range(1 << (n - 1)):
            cuts = [0, *[i for i in range(1, n) if inner >> (i - 1) & 1], n]
            sizes = np.diff(cuts)
            if len(sizes) > 1 and all(s >= least or (k == 0 and begun) or (k == len(sizes) - 1 and goes_on) for k, s in enumerate(sizes)) or len(sizes) == 1:
                langs = [scores[a:b].sum(0) for a, b in zip(cuts, cuts[1:])]
                worth[tuple(cuts[:-1])] = max(sum(x[k] for x, k in zip(langs, ks)) for ks in product(range(3), repeat=len(langs)) if all(p != q for p, q in zip(ks, ks[1:]))) - price * (len(langs) - 1)
        assert tuple(L.borders(scores, least, price, begun, goes_on)) == max(worth, key=worth.get)


def test_long_text(spark, model):
    df = spark.createDataFrame([(1, "բառ ուրիշ " * 100_000, "hy")], "doc_id bigint, text string, lang string")
    assert L.document_languages(df, model).first().detected == "hy"
    empty = L.train(df.where("false"))
    assert L.document_languages(df, empty).count() == 1
