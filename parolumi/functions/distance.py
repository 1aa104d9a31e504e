"""Edit distances between token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from parolumi.functions.text import let

#: Distinct tokens for which there are code points.
MOST_TOKENS = 0x10FFFF - 0x10000


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two arrays of tokens.

    Each distinct token of the pair becomes one code point from U+10000 on, where no
    surrogates lie, then the built-in string distance does the work. A pair of more than
    ``MOST_TOKENS`` distinct tokens, whose distance nobody could wait for, is an error.
    """

    def distance(sides: Column) -> Column:
        code = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.lit(0xFFFF) + F.array_position(sides["v"], t)), 8, F.lit("0"))), "UTF-32")
        spelt = lambda arr: F.array_join(F.transform(arr, code), "")
        known = F.levenshtein(spelt(sides["a"]), spelt(sides["b"]))
        return F.when(F.size(sides["v"]) <= MOST_TOKENS, known).otherwise(F.raise_error(F.lit("too many distinct tokens for a distance")).cast("int"))

    both = F.struct(a.alias("a"), b.alias("b"))
    return let(both, lambda x: let(F.struct(x["a"].alias("a"), x["b"].alias("b"), F.array_distinct(F.concat(x["a"], x["b"])).alias("v")), distance))


def infix_distances(refs: list[np.ndarray], hyps: list[np.ndarray], cells: int = 1_000_000) -> np.ndarray:
    """Least edits that turn each reference into some part of its hypothesis.

    Sequences are arrays of numbers. Pairs of like length are worked on side by side, a
    row of the table for all of them at a time, in blocks of at most ``cells`` places
    (one pair may exceed them).
    """
    out = np.zeros(len(refs), np.int64)
    m, n = np.array([len(r) for r in refs], np.int64), np.array([len(h) for h in hyps], np.int64)
    order = np.lexsort((-m, n))
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (n[order[end]] + 1) * (end + 1 - begin) <= cells:
            end += 1
        some = order[begin:end][np.argsort(-m[order[begin:end]], kind="stable")]
        out[some] = _block([refs[i] for i in some], [hyps[i] for i in some], m[some], n[some])
        begin = end
    return out


def _block(refs: list[np.ndarray], hyps: list[np.ndarray], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distances of pairs in falling order of the references' lengths."""
    wide, long = int(n.max()), int(m.max())
    h, r = np.full((len(m), wide), -2, np.int32), np.full((len(m), long), -1, np.int32)
    h[np.arange(wide) < n[:, None]] = np.concatenate(hyps) if n.sum() else 0
    r[np.arange(long) < m[:, None]] = np.concatenate(refs) if m.sum() else 0
    along = np.arange(wide + 1, dtype=np.int32)
    row = np.zeros((len(m), wide + 1), np.int32)
    for k in range(long):
        live = int(np.searchsorted(-m, -k, side="left"))  # references longer than k stand first
        old = row[:live]
        new = old + 1
        np.minimum(new[:, 1:], old[:, :-1] + (h[:live] != r[:live, k, None]), out=new[:, 1:])
        # insertions run along the row: a running minimum of value minus place
        new -= along
        np.minimum.accumulate(new, axis=1, out=new)
        row[:live] = new + along
    return np.where(along <= n[:, None], row, np.iinfo(np.int32).max).min(1)


def letters_of(texts: pd.Series) -> list[np.ndarray]:
    """Code points of each text; null has none."""
    return [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32) for t in texts]


def numbered(*sides: pd.Series) -> list[list[np.ndarray]]:
    """White-space separated words as numbers, equal for equal words."""
    number: dict[str, int] = {}
    return [[np.array([number.setdefault(w, len(number)) for w in (t or "").split()], np.int32) for t in side] for side in sides]


@pandas_udf(T.StructType([T.StructField("words", T.IntegerType()), T.StructField("letters", T.IntegerType())]))
def infix_edits(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Infix distances of two texts by words and by letters without white space; null
    counts as empty. Texts are sent as they are: arrays of letters would cost more than the work."""
    for ref, hyp in pairs:
        rw, hw = numbered(ref, hyp)
        bare = lambda side: letters_of(side.map(lambda t: "".join((t or "").split())))
        yield pd.DataFrame({"words": infix_distances(rw, hw).astype("int32"), "letters": infix_distances(bare(ref), bare(hyp)).astype("int32")})
