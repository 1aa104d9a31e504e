import random

from parolumi.llm import pairs as P, prefixes, replies as Y, tails, truncation as R

SUBJECTS, VERBS, PLACES = ["տատիկը", "հյուրը", "բժիշկը", "մեր ընկերը"], ["երգում է", "գրում է", "խոսում է"], ["բակում", "դպրոցում", "լճի մոտ"]


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    return [" ".join(f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(VERBS)} {rng.choice(PLACES)}։" for _ in range(rng.randint(1, 3))) for _ in range(n)]


SCHEMA = "chunk_id bigint, model string, text string, size int, words string, key1 string"


def chunks(spark, texts, model="m"):
    return spark.createDataFrame([(i, model, t, 0, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def cut(df):
    return {r.chunk_id for r in R.truncated(df, ["chunk_id"], "model", "text").where("cut").collect()}


def test_cut_chunks(spark):
    whole = corpus()
    odd = {
        "Տատիկը երգում է բա": True, "Տատիկը երգում": True, "Բժիշկը գրում է լճի": True, "Հյուրը խոսում է բակում": False, "Հյուրը խոսում է բակում, ": True, "տատիկը երգում է դպրոցում հյուրը գրում է լճի մոտ": False,
        "Մեր": True, "Հյուրը գրում է բակում։ 🙂": False, "Հյուրը գրում է բակում։ (ծափեր)": False, "Հյուրը գրում է բա…": True, "Հյուրը գրում է բակում…": False, "Հյուրը գր�": True, "": False, "   ": False, "Հյուրը խոսում է բակում։»": False,
    }
    texts = whole + list(odd) + [None]
    got = cut(chunks(spark, texts).union(chunks(spark, texts)))
    assert got == {len(whole) + i for i, bad in enumerate(odd.values()) if bad}


def test_limit(spark):
    whole = [t[:90] for t in corpus(400, 3) if len(t) < 90 or True]
    texts = [t if len(t) < 60 else (t + " " + t)[:60] for t in whole]
    lim = R.limits(chunks(spark, texts), "model", "text").collect()
    assert [(r.limit_group, r.limit_size) for r in lim] == [("m", 60)]


def test_limit_below_longer_texts(spark):
    texts = [t if len(t) < 60 else (t + " " + t)[:60] for t in corpus(400, 3)] + ["Տատիկը երգում է բակում։ " * 9, "Բժիշկը գրում է լճի մոտ։ " * 30]
    lim = R.limits(chunks(spark, texts), "model", "text").collect()
    assert [(r.limit_group, r.limit_size) for r in lim] == [("m", 60)]


def test_limit_in_bytes(spark):
    rng = random.Random(5)
    whole = corpus(400, 6)
    long = []
    for _ in range(40):
        end = f" {rng.choice(whole)} Հյուրը խոսում է բակում"
        long.append("a" * (200 + rng.randint(0, 1) - len(end.encode())) + end)
    texts = whole + long + ["Հյուրը գրում է բակում։ " * 12, "Հյուրը խոսում է բակում"]
    assert cut(chunks(spark, texts)) == set(range(len(whole), len(whole) + len(long)))


def test_truncation_of_nothing(spark):
    assert R.truncated(chunks(spark, []), ["chunk_id"], "model", "text").count() == 0
    assert cut(chunks(spark, [None, "", "բառ " * 100_000, "մի խոսք։"])) == {2}


def test_windows_count():
    assert tails.keys_of(["a"])[1] != tails.keys_of(["a"])[0]
    assert tails.tail_of("Ա բ։ Գ դ")[0] == "bare" and tails.tail_of("♪")[0] == "blank" and tails.tail_of("Ա բ.")[0] == "final"


RU = {"տատիկը": "бабушка", "երգում": "поёт", "է": "—", "բակում": "во дворе", "հյուրը": "гость", "գրում": "пишет", "դպրոցում": "в школе"}


def seg(i, text, explanation, glosses="same", words=None):
    ws = text.rstrip("։").lower().split() if words is None else words
    gs = [RU.get(w) for w in ws] if glosses == "same" else glosses
    return (f"v{i}", i, text, explanation, ws, gs, "clash")


PSCHEMA = "video_id string, seg_index int, text string, explanation string, word_texts array<string>, glosses array<string>, defect string"


def test_defects(spark):
    good = [seg(100 + i, "Տատիկը երգում է բակում։", "Бабушка поёт во дворе.") for i in range(20)] + [seg(200 + i, "Հյուրը գրում է դպրոցում։", "Гость пишет в школе.") for i in range(20)]
    t = "Տատիկը երգում է բակում։"
    ws = t.rstrip("։").lower().split()
    bad = [
        (seg(1, t, None), "explanation", "empty"), (seg(2, t, "(No output)"), "explanation", "empty"), (seg(3, t, "\u200b"), "explanation", "empty"), (seg(4, t, "Տատիկը երգում է բակում"), "explanation", "copied"),
        (seg(5, t, "Sorry, I can't translate this passage."), "explanation", "refusal"), (seg(6, t, "Нет, с таким отрывком я дела иметь не стану."), "explanation", "refusal"), (seg(7, t, "Grandmother sings in the yard."), "explanation", "wrong_language"),
        (seg(8, t, "Бабушка поёт во дв"), "explanation", "truncated"), (seg(9, t, "Бабушка поёт"), "explanation", "truncated"), (seg(10, t, "Бабушка поёт во дворе.", [None] * 4), "words", "empty"), (seg(11, t, "Бабушка поёт во дворе.", []), "words", "empty"),
        (seg(12, t, "Бабушка поёт во дворе.", ws), "words", "copied"), (seg(13, t, "Бабушка поёт во дворе.", ["Sorry, I can't translate this passage.", None, None, None]), "words", "refusal"),
        (seg(14, t, "Бабушка поёт во дворе.", ["grandmother", "sings", "—", "yard"]), "words", "wrong_language"), (seg(15, t, "Бабушка поёт во дворе.", ["бабушка"], ws[:1]), "words", "truncated"),
    ]
    fine = [seg(50, t, "Бабушка поёт во дворе"), seg(51, t, "Бабушка поёт во дворе.", ["бабушка", None, "—", "во дворе"]), seg(52, "Ես չեմ կարող թարգմանել հատվածը։", "Я не могу перевести фрагмент.", ["я", "не", "могу", "перевести", "фрагмент"])]
    # the same two replies to texts that have no word in common; of longer ones most words are missing, too
    for i in range(6):
        other = f"ա{chr(0x561 + i)}բ գ{chr(0x561 + i)}դ ե{chr(0x561 + i)}զ։"
        twice = f"{other} {other}"
        bad.append((seg(400 + i, other, bad[4 + i % 2][0][3], ["раз", "два", "три"]), "explanation", "refusal"))
        longer = seg(420 + i, twice, bad[5 - i % 2][0][3], ["раз", "два", "три", "четыре"], twice.split()[:4])
        bad += [(longer, "explanation", "refusal"), (longer, "words", "truncated")]
    rows = good + list({b[1]: b for b, *_ in bad}.values()) + fine + [bad[0][0]] + [(None, 1, t, None, None, None, "x")]
    got = {(r.seg_index, r.field_name, r.defect) for r in P.defects(spark.createDataFrame(rows, PSCHEMA), ["video_id", "seg_index"]).collect()}
    assert got == {(b[1], f, d) for b, f, d in bad}


def test_translations_cut_at_a_limit(spark):
    t = "Տատիկը երգում է բակում։"
    good = [seg(100 + i, t, "Бабушка поёт во дворе" + "." * (i > 0)) for i in range(20)]
    long = [seg(200 + i, t, f"Бабушка {'аоеиуы'[i] * 30} поёт во дворе") for i in range(6)]
    rows = spark.createDataFrame(good + long + [seg(300, t, "Бабушка поёт во дворе. " * 9)], PSCHEMA)
    got = {(r.seg_index, r.field_name, r.defect) for r in P.defects(rows, ["video_id", "seg_index"]).collect()}
    assert got == {(200 + i, "explanation", "truncated") for i in range(6)}


def test_defects_of_odd_rows(spark):
    e = spark.createDataFrame([], PSCHEMA)
    assert P.defects(e, ["video_id", "seg_index"]).count() == 0
    rows = [("v", 1, None, None, None, None, None), ("v", 2, "", "", [], [], ""), ("v", 3, "բառ " * 50_000, "слово " * 50_000 + ".", ["բառ"] * 50_000, ["слово"] * 50_000, "")]
    got = {(r.seg_index, r.field_name, r.defect) for r in P.defects(spark.createDataFrame(rows, PSCHEMA), ["video_id", "seg_index"]).collect()}
    assert got == {(1, "explanation", "empty"), (1, "words", "empty"), (2, "explanation", "empty"), (2, "words", "empty")}


def test_replies_that_recur_over_unlike_sources(spark):
    rows = []
    for i in range(8):
        own = [f"խոսք{chr(0x561 + i)}", f"բան{chr(0x561 + i)}", "է"]
        rows += [("no such thing is done here", own, False), (f"the {'abcdefgh'[i]} walks home now", ["տուն", own[0]], False), ("he walks slowly to school", ["դպրոց", own[1]], False)]
    rows += [(f"one {i} two {i} three", [f"ուրիշ{i}", "է"], False) for i in range(40)]
    rows += [("a rare one here", ["մեկ"], False), ("мама моет раму", [], True)]
    df = spark.createDataFrame(rows, "reply string, source array<string>, faithful boolean")
    assert {r.reply for r in Y.independent(df).collect()} == {"no such thing is done here"}
    assert {r.reply for r in Y.refusing(df).collect()} == {"no such thing is done here"}
    assert Y.refusing(df.where("faithful")).count() == 0 and Y.refusing(df.limit(0)).count() == 0


def test_shortened_values(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(500)] + ["", "ա" * 50_000, "ա" * 50_001]
    df = spark.createDataFrame([(t,) for t in texts + texts[:9]] + [(None,)], "value string")
    want = {t for t in texts if t and any(x != t and x.startswith(t) for x in texts)}
    got = prefixes.shortened(df).collect()
    assert {r.value for r in got} == want and all(r.longer.startswith(r.value) and r.longer != r.value for r in got) and len(got) == len(want)
    assert prefixes.shortened(df.limit(0)).count() == 0
