"""Whether a text's last words can end a sentence, judged by all other texts.

Every sentence with a final mark is read word by word; the hashes of its windows of
one and of two words are counted over the corpus: how often the window occurs and
how often the sentence ends with it.  A text without a final mark whose last window
always goes on elsewhere is the beginning of something longer, so it breaks off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: Asides at the end that are not speech: bracketed remarks, note signs, pictures.
_ASIDE = re.compile(r"(?:\s|\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|[♪♫♬🎵🎶]|[\U0001F000-\U0001FAFF☀-➿\ufe0f\u200d])+$")
_FINAL = re.compile(r"[։.!?:؟۔][»”\"')\]]*$")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.)[»”\"')\]]*$")
_OPEN = re.compile(r"[,،՝;«(\[–—-]$|[�]")
_SPLIT = re.compile(r"(?<=[։.!?…:؟۔])[»”\"')\]]*\s+|\n+")
_WORD = re.compile(r"[^\W_]+(?:['’\u200c-][^\W_]+)*")
_MARKS = re.compile("[՚-՞\u00ad\u200b\u200d\u2060\ufeff]")

TAIL_SCHEMA = "state string, words int, last string, key1 bigint, key2 bigint"


def words_of(text: str) -> list[str]:
    return _WORD.findall(_MARKS.sub("", text.lower()))


def _hash(order: int, words: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(words), seed=order) - (1 << 63)


def keys_of(words: list[str]) -> tuple[int, int]:
    """Hashes of the windows of one and of two words that end with the last word; a
    sentence's first word stands for both."""
    return _hash(1, words[-1:]), _hash(2, words[-2:])


def tail_of(text: str) -> tuple:
    """(state, words, last word, keys) of a text's end.

    state is blank (no words), final (ends with a mark), ellipsis, open (ends in a
    comma, an opening quote, a broken character) or bare (ends with a word).
    """
    body = _ASIDE.sub("", text)
    parts = [p for p in _SPLIT.split(body) if p and not p.isspace()]
    words = words_of(parts[-1]) if parts else []
    if not words:
        everything = words_of(body)
        return ("final" if everything else "blank", 0, None, None, None)
    state = "open" if _OPEN.search(body) else "ellipsis" if _ELLIPSIS.search(body) else "final" if _FINAL.search(body) else "bare"
    return (state, len(words), words[-1], *keys_of(words))


def window_counts(values: DataFrame, value: str = "value") -> DataFrame:
    """(key, n, ends) over all sentences of all values that have a final mark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            number: dict[str, int] = {}
            ids: list[int] = []
            starts, lasts = [], []
            for t in f["value"]:
                for s in _SPLIT.split(_ASIDE.sub("", t)):
                    s = s.strip() if s else ""
                    if _FINAL.search(s) and not _ELLIPSIS.search(s) and (words := words_of(s)):
                        starts.append(len(ids))
                        ids += [number.setdefault(w, len(number) + 1) for w in words]
                        lasts.append(len(ids) - 1)
            if not ids:
                continue
            one = np.array(ids, dtype=np.int64)
            ends = np.zeros(len(one), bool)
            ends[lasts] = True
            before = np.concatenate([[0], one[:-1]])
            before[starts] = 0
            names = [""] + list(number)
            for order, window in ((1, one), (2, (before << 32) | one)):
                seen, which, n = np.unique(window, return_inverse=True, return_counts=True)
                split = [[names[x] for x in (w >> 32, w & 0xFFFFFFFF) if x] for w in seen.tolist()]
                yield pd.DataFrame({"key": [_hash(order, w) for w in split], "n": n, "ends": np.bincount(which, ends, len(seen)).astype("int64")})

    counted = values.select(F.col(value).alias("value")).where("value is not null").mapInPandas(run, "key bigint, n bigint, ends bigint")
    return counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


def with_tails(values: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """``key`` columns, size (characters), bytes and TAIL_SCHEMA of every non-null value; the
    values themselves are not carried on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = [("state", object), ("words", "int32"), ("last", object), ("key1", "Int64"), ("key2", "Int64")]
        for f in frames:
            cols = list(zip(*[tail_of(t) for t in f["value"]])) or [()] * len(kinds)
            tails = pd.DataFrame({name: pd.array(list(c), dtype=kind) for (name, kind), c in zip(kinds, cols)})
            yield pd.concat([f.drop(columns="value").reset_index(drop=True), tails], axis=1)

    kept = values.where(F.col(value).isNotNull()).select(*key, F.length(value).alias("size"), F.octet_length(value).alias("bytes"), F.col(value).alias("value"))
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in kept.schema if c.name != "value")
    return kept.mapInPandas(run, f"{schema}, {TAIL_SCHEMA}")


def with_evidence(tails: DataFrame, counts: DataFrame, key: list[str]) -> DataFrame:
    """Adds how often each window of the tail occurs (n1, n2) and ends a sentence (e1,
    e2); 0 where it never does. Only tails that need it are looked up."""
    doubtful = tails.where(F.col("state").isin("bare", "ellipsis"))
    asked = doubtful.select(*key, F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.col(f"key{i}").alias("key")) for i in (1, 2)])).alias("k")).select(*key, "k.o", "k.key")
    of = lambda i, c: F.max(F.when(F.col("o") == i, F.col(c)))
    found = asked.join(counts, "key").groupBy(*key).agg(*[of(i, c).alias(f"{c[0]}{i}") for i in (1, 2) for c in ("n", "ends")])
    return tails.join(found, key, "left").fillna(0, subset=["n1", "e1", "n2", "e2"])


def breaks_off(min_seen: int = 3, rare: float = 0.02) -> Column:
    """Whether a tail with evidence breaks off.

    The two last words decide if they were seen ``min_seen`` times, else the last one;
    they can end a sentence if at least ``rare`` of their occurrences do.
    """
    usual = F.when(F.col("n2") >= min_seen, F.col("e2") >= F.col("n2") * rare).otherwise((F.col("n1") > 0) & (F.col("e1") >= F.col("n1") * rare))
    return F.when(F.col("state") == "open", True).when(F.col("state").isin("bare", "ellipsis"), ~usual).otherwise(False)
