import os

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from parolumi.llm import packing as K


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_bins_hold_everything(sizes):
    b = K.Bins(np.array(sizes), 50)
    start = b.used()
    b.search()
    fills = {}
    for i, s in enumerate(sizes):
        fills[b.bin[i]] = fills.get(b.bin[i], 0) + s
    assert all(f <= 50 for f in fills.values()) and sum(fills.values()) == sum(sizes)
    assert b.least() <= b.used() <= start and len(fills) == b.used()
    assert all(b.fill[k] == f for k, f in fills.items())


def test_search_empties_a_bin():
    # longest first leaves 4 containers; exchanging one for one and two for one leaves 3
    sizes = np.array([6, 5, 5, 4, 4, 3, 3])
    b = K.Bins(np.array([6, 6, 4]), 10)
    b.search()
    assert b.used() == 2
    c = K.Bins(sizes, 10)
    c.search()
    assert c.used() == 3


def test_steps_raise_squares():
    rng = np.random.default_rng(3)
    b = K.Bins(rng.integers(200, 700, 300), 1000)
    before = (b.fill**2).sum()
    used = b.used()
    b.search()
    assert (b.fill**2).sum() >= before and b.used() <= used


def pack(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, tokens bigint, container string, part int")
    return K.packed(df, 100, **kw).collect()


@pytest.mark.parametrize("cell", [60, 1000])
def test_packed(spark, cell):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(1, 90, 200))] + [(500, 0), (501, None), (502, 100), (503, 250), (504, 300), (None, 5)]
    got = pack(spark, rows, cell_items=cell)
    by, docs = {}, {}
    for r in got:
        docs.setdefault(r.doc_id, []).append(r)
        if r.container is not None:
            by.setdefault(r.container, []).append(r)
    assert set(docs) == {i for i, _ in rows if i is not None}
    for rs in by.values():
        held = sum(r.tokens for r in rs)
        assert held <= 100 and all(r.container_tokens == held and r.unused == 100 - held for r in rs)
    for i, n in rows:
        if i is not None:
            assert sum(r.tokens for r in docs[i]) == (n or 0)
            assert len(docs[i]) == max(1, -(-(n or 0) // 100)) and len({r.part for r in docs[i]}) == len(docs[i])
    total = sum(n or 0 for i, n in rows if i is not None)
    assert len(by) <= -(-total // 100) * 1.05 + 1


def test_repeated_ids_and_nothing(spark):
    got = pack(spark, [(1, 60), (1, 60), (1, 60), (2, 130), (2, 130)])
    assert sorted((r.doc_id, r.tokens) for r in got) == [(1, 60)] * 3 + [(2, 30)] * 2 + [(2, 100)] * 2
    assert len({(r.doc_id, r.part) for r in got}) == len(got)
    assert pack(spark, []) == []


@pytest.mark.skipif(not os.path.isdir(K.TOKENIZER_DIR), reason="no vocabulary files here")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (None, "x"), (4, "բարև " * 20_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in K.token_counts(df).collect()}
    assert set(got) == {1, 2, 3, 4} and got[2] == got[3] == 0 and 1 <= got[1] <= 6 and got[4] >= 20_000
