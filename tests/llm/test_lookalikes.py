from parolumi.llm import lookalikes as K


def values(spark, texts):
    return spark.createDataFrame([(str(i), t, "clash", ["x"]) for i, t in enumerate(texts)], "k string, value string, word string, kinds array<string>")


CLEAN = ["գնում է շուկայում։", "և… № 5", "story-ում café", "می\u200cخواهم", "👩\u200d🍳 ok", "чай ещё", "", None, "WiFi-ով", "plain text", "a\tb\nc", "10 × 2"]
DIRTY = {
    "շnւկայում": "շուկայում", "գնո\u200bւմ": "գնում", "\uff43\uff41\uff46é \uff11\uff12": "café 12", "cafe\u0301": "café", "вcё": "всё", "տեքu\u00adտ": "տեքստ", "\ufb15լիոն": "միլիոն",
    "բառ\u00a0բառ": "բառ բառ", "ս\u200cոխ": "սոխ", "й\u0306ога"[0:1] + "ога и\u0306": "йога й", "\ufeffսկիզբ": "սկիզբ", "Sուն": "Տուն",
}


def test_clean_and_dirty(spark):
    texts = CLEAN + list(DIRTY)
    got = {r.value: r.normal for r in K.rewritten(K.changed_values(values(spark, texts), ["k"])).collect()}
    assert set(got) == set(DIRTY)
    assert {v: n for v, n in got.items()} == DIRTY


def test_vocabulary_decides(spark):
    # the frequent spelling wins where the table could not tell, and any case of a repeated row counts
    texts = ["քարտեզը"] * 3 + ["քարտեqը", "քարտեqը"]
    rows = {r.word: (r.canonical, r.in_vocabulary) for r in K.canonical_words(values(spark, texts)).collect()}
    assert rows == {"քարտեqը": ("քարտեզը", True)}


def test_trie():
    t = K.Trie()
    for w, n in (("նուն", 5), ("նուր", 1), ("noun", 9)):
        t.add(w, n)
    assert t.reach("ն\u200bnւն") == [(0.0, "նուն", 5, ("invisible", "look-alike"))] and t.reach("նnւք") == []
    assert K.by_table("տnւն") == "տուն" and K.by_table("chat") == "chat" and K.by_table("сhat") == "chat"
    assert K.folded("տnւն") == K.folded("տուն") and K.folded("\uff11\uff12") == "12"


def test_zero_cost_paths():
    t = K.Trie()
    t.add("շոգ", 2)
    t.add("cafés", 1)
    assert [w for _, w, _, _ in t.reach("շnգ")] == ["շոգ"] and [w for _, w, _, _ in t.reach("շ\u200dոգ")] == ["շոգ"]
    assert t.reach("շոք") == [] and t.reach("շո") == []
    assert t.reach("\uff43afe\u0301s") == [(0.0, "cafés", 1, ("form", "combining"))]


def test_the_trie_finds_what_no_table_lists(spark):
    # ж looks like no Armenian letter of the table; one such letter inside a word is a step of the automaton
    texts = ["մարդիկ գնում են"] * 2 + ["մաжդիկ գնում են", "իжի", "մաжժիկ"]
    found = {r.value: r.normal for r in K.rewritten(K.changed_values(values(spark, texts), ["k"])).collect()}
    assert found == {"մաжդիկ գնում են": "մարդիկ գնում են"}
    assert K.changed_values(values(spark, texts[2:]), ["k"]).count() == 0
    assert K.spell(K.Trie(), "մաжդիկ") == ("մաжդիկ", [], False)


def test_small_tries(spark):
    texts = ["քարտեզը տունը բակը"] * 3 + ["քարտեqը", "տnւնը բаկը", "ս\u200cոխ"]
    want = {r.word: (r.canonical, r.in_vocabulary) for r in K.canonical_words(values(spark, texts)).collect()}
    got = {r.word: (r.canonical, r.in_vocabulary) for r in K.canonical_words(values(spark, texts), trie_words=1).collect()}
    assert got == want and want["տnւնը"] == ("տունը", True) and want["ս\u200cոխ"] == ("սոխ", False)


def test_empty_and_long(spark):
    assert K.changed_values(values(spark, []), ["k"]).count() == 0
    long = "բառ " * 100_000 + "բnռ"
    got = K.rewritten(K.changed_values(values(spark, [long]), ["k"])).collect()
    assert len(got) == 1 and got[0].normal.endswith("բոռ")
    twice = values(spark, ["բnռ"]).union(values(spark, ["բnռ"]))
    assert K.changed_values(twice, ["k"]).count() == 1
