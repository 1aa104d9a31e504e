import random

import numpy as np

from parolumi.llm import leakage as K

SCHEMA = "doc_id bigint, text string, item_words string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id bigint, text string, doc_id string")


def test_suffix_array_order():
    rng = random.Random(2)
    a = np.array([rng.randint(0, 3) for _ in range(300)], dtype=np.int64)
    at = np.arange(290)
    got = K.suffix_array(a, at, 2, 4, 12)
    keys = [tuple(a[i : i + 12]) + (0,) * (12 - len(a[i : i + 12])) for i in got]
    assert keys == sorted(keys)


def passage(item, doc):
    """Longest stretch of the item found in the document along one shift, isolated
    differences allowed, with the number of equal words; by brute force."""
    best = (0, 0)
    for shift in range(-len(item), len(doc)):
        same = [0 <= shift + k < len(doc) and doc[shift + k] == item[k] for k in range(len(item))]
        start = last = None
        hits = 0
        for k, s in enumerate(same):
            if not s:
                continue
            if last is None or k - last > 2:
                start, hits = k, 0
            last, hits = k, hits + 1
            if hits >= 0.8 * (k - start + 1):
                best = max(best, (k - start + 1, hits))
    return best


def test_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    its = [(i, [rng.choice(vocab) for _ in range(rng.randint(6, 20))]) for i in range(12)]
    ds = []
    for d in range(40):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        _, it = rng.choice(its)
        cut = rng.randint(3, len(it))
        part = list(it[:cut])
        if rng.random() < 0.5 and len(part) > 7:
            part[4] = "other"
        at = rng.randint(0, len(words))
        ds.append((d, words[:at] + part + words[at:]))
    got = {(r.doc_id, r.item_id): r.passage_words for r in K.leaks(docs(spark, [(i, " ".join(w)) for i, w in ds]), items(spark, [(i, ", ".join(w)) for i, w in its])).collect()}
    want = {}
    for d, doc in ds:
        for i, it in its:
            span, hits = passage(it, doc)
            if span >= len(it) / 2:
                want[(d, i)] = span
    assert set(got) == set(want) and len(want) > 20


def test_case_punctuation_and_spacing(spark):
    text = "One two, three four five six seven eight."
    d = docs(spark, [(1, "xx ONE   TWO three — four\nfive six... yy"), (2, "one two three"), (3, text), (3, text)])
    got = {(r.doc_id, r.item_id) for r in K.leaks(d, items(spark, [(9, text), (9, text)])).collect()}
    assert got == {(1, 9), (3, 9)}


def test_odd_rows(spark):
    long = "ա բ գ " * 100_000 + "one two three four five six"
    d = docs(spark, [(1, None), (2, ""), (3, "  ...  "), (None, "one two three four five six"), (4, long)])
    i = items(spark, [(7, "one two three four five six"), (8, None), (None, "one two three"), (6, "!!"), (5, "ones")])
    assert {(r.doc_id, r.item_id) for r in K.leaks(d, i).collect()} == {(4, 7)}
    assert K.leaks(d.where("false"), i).count() == 0 and K.leaks(d, i.where("false")).count() == 0


def test_blocks_and_shards_change_nothing(spark):
    its = [(i, " ".join(f"t{i}_{k}" for k in range(8))) for i in range(9)]
    d = docs(spark, [(i, "x " * i + its[i % 9][1]) for i in range(30)])
    one = sorted(map(tuple, K.leaks(d, items(spark, its)).collect()))
    many = sorted(map(tuple, K.leaks(d, items(spark, its), block_words=20, shard_words=5).collect()))
    assert one == many and len(one) == 30


def test_few_seeds(spark):
    eight, ten, twenty = ([f"{x}{i}" for i in range(n)] for x, n in (("a", 8), ("b", 10), ("c", 20)))
    part = twenty[4:14]
    part[3] = part[7] = "other"
    mixed = ten[:2] + ["other"] + ten[3:5]
    its = items(spark, [(1, " ".join(eight)), (2, " ".join(ten)), (3, " ".join(twenty))])
    ds = docs(spark, [(1, "so " + " ".join(eight[2:6]) + " on"), (2, "so " + " ".join(mixed)), (3, " ".join(part)), (4, " ".join(eight[:3])), (5, " ".join(twenty[:9]))])
    assert {(r.doc_id, r.item_id) for r in K.leaks(ds, its).collect()} == {(1, 1), (2, 2), (3, 3)}
    for lot in (eight, ten, twenty):
        assert K.leaks(ds, items(spark, [(7, " ".join(lot))])).count() == 1


def test_suffixes_are_searched_as_a_whole():
    rng = random.Random(4)
    index = K.ItemIndex([(i, " ".join(rng.choice("abc") for _ in range(rng.randint(9, 15)))) for i in range(6)], 3)
    tokens = np.array([rng.randint(1, 3) for _ in range(200)] + [0] * 3, dtype=np.int64)
    here = np.flatnonzero(np.isin(K.packed(tokens, index.seed, index.base)[0], index.known) & K.packed(tokens, index.seed, index.base)[1])
    got = K.Matches(tokens, index, here)
    text, doc = index.text.tolist(), tokens.tolist()

    def shared(i, j):
        n = 0
        while i + n < len(text) and j + n < len(doc) and text[i + n] == doc[j + n] > 0:
            n += 1
        return n

    n = index.seed
    for s, length in zip(index.at[got.suffix], got.longest()):
        assert length == max(shared(s, j) for j in range(200)) // n * n
    want, found = {}, {}
    for k, s in enumerate(index.at.tolist()):
        for j in range(200):
            if shared(s, j) >= n:
                d = (int(index.item_of[k]), j - (s - int(index.first[index.item_of[k]])))
                want[d] = want.get(d, 0) + 1
    for item, shift, seeds in got.runs(block=7):
        for i, d, x in zip(item.tolist(), shift.tolist(), seeds.tolist()):
            found[(i, d)] = found.get((i, d), 0) + x
    assert found == want


def test_one_word_again_and_again():
    index = K.ItemIndex([(1, " ".join(["a"] * 200)), (2, "b c d e f g h i")], 3)
    got = K.search_shard(np.array([1] * 3000 + [0] * 3, dtype=np.int64), index, 3)
    assert (got["span"] == 200).sum() == 3000 - 200 + 1 and len(got) < 3000 + 200


def test_corpus_without_leaks(spark):
    d = docs(spark, [(1, "a b c d"), (2, "x"), (None, "a b c d"), (3, None)])
    found = K.leaks(d, items(spark, [(5, "a b c d")]))
    assert [r.doc_id for r in K.without_leaks(d, found).orderBy("doc_id").collect()] == [None, 2, 3]
