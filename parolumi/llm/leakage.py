"""Evaluation texts leaking into training text, found with suffix arrays.

The corpus is cut into shards (runs of whole documents inside a partition).
Each shard gets a word-level suffix array, in which every suffix of every held-out
item is binary-searched as a whole: that gives the places that share ``seed_words``
words in a row or more with it, and how many.  Matches on one diagonal (same shift
between item and document) are then read again word by word, so that single replaced
words inside a passage count as part of it.

The array holds the suffixes that can answer a search: those that begin with
``seed_words`` words in a row which some item has too.  All others would never
be reached by a search for ``seed_words`` or more words, so nothing is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from parolumi.session import spread

#: Marks that Armenian writes inside a word and joiners: removed, not word breaks.
_INSIDE = re.compile("[՚-՞\u00ad\u200b-\u200d\u2060\ufeff\u0300-\u036f]")
_WORD = re.compile(r"[^\W_]+")

MATCH_SCHEMA = (
    "doc_id bigint, item_id bigint, item_words int, passage_words int, matched_words int, "
    "longest_verbatim int, doc_word int, item_word int"
)


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation; null and blank give no words."""
    return _WORD.findall(_INSIDE.sub("", text.lower())) if text else []


class ItemIndex:
    """The words of a block of items as numbers, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], seed_words: int, min_share: float = 0.5, min_equal: float = 0.8):
        split = [(i, w) for i, t in items if (w := words_of(t))]
        self.vocab = {w: n for n, w in enumerate(sorted({x for _, w in split for x in w}), 1)}
        self.ids = np.array([i for i, _ in split], dtype=np.int64)
        self.size = np.array([len(w) for _, w in split], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1].astype(np.int64)
        flat: list[int] = []
        for _, w in split:
            flat += [self.vocab[x] for x in w]
            flat.append(0)
        self.base = len(self.vocab) + 1
        # as many words in one number as fit; shorter items are sought by fewer words
        fit = int(62 / np.log2(max(self.base, 2)))
        self.seed = max(1, min(seed_words, fit, int(self.size.min()) if len(split) else seed_words))
        while self.seed > 1 and any(fewest_seeds(w, self.seed, min_share, min_equal) < 1 for w in set(self.size.tolist())):
            self.seed -= 1
        #: For each item, how many seeds any of its passages has at least.
        self.sure = np.array([fewest_seeds(w, self.seed, min_share, min_equal) for w in self.size.tolist()], dtype=np.int64)
        self.text = np.array(flat + [0] * self.seed, dtype=np.int64)
        self.longest = int(self.size.max()) if len(split) else 0
        grams, whole = packed(self.text, self.seed, self.base)
        self.at = np.flatnonzero(whole)
        self.gram = grams[self.at]
        self.known = np.unique(self.gram)
        self.item_of = np.searchsorted(self.first, self.at, side="right") - 1


@lru_cache(100_000)
def fewest_seeds(words: int, n: int, min_share: float, min_equal: float) -> int:
    """How many runs of ``n`` equal words a passage of an item of ``words`` words has at
    least, its replaced words being spread so that they break as many as they can."""
    fewest = words
    for span in range(max(1, ceil(min_share * words - 1e-9)), words + 1):
        replaced = min(span - ceil(min_equal * span - 1e-9), (span - 1) // 2)
        fewest = min(fewest, max(0, span - replaced - (n - 1) * (replaced + 1)))
    return fewest


def packed(a: np.ndarray, n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the next ``n`` words as one number, and whether all are words."""
    m = len(a) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    key, whole = np.zeros(m, np.int64), np.ones(m, bool)
    for k in range(n):
        part = a[k : k + m]
        key = key * base + part
        whole &= part > 0
    return key, whole


def suffix_array(a: np.ndarray, at: np.ndarray, n: int, base: int, depth: int) -> np.ndarray:
    """The suffixes that start at ``at``, in order of their first ``depth`` words.

    Sorts by blocks of ``n`` words; a further block is looked at only where the
    blocks before it are equal.
    """
    padded = np.concatenate([a, np.zeros(depth + 2 * n, np.int64)])
    gram, _ = packed(padded, n, base)
    order = at[np.argsort(gram[at], kind="stable")]
    same = np.concatenate([[False], gram[order[1:]] == gram[order[:-1]]]) if len(order) else np.zeros(0, bool)
    off = n
    while off < depth and same.any():
        tied = same.copy()
        tied[:-1] |= same[1:]
        where = np.flatnonzero(tied)
        group = np.cumsum(~same)[where]
        part = order[where]
        nxt = gram[part + off]
        perm = np.lexsort((nxt, group))
        order[where] = part[perm]
        nxt, group = nxt[perm], group[perm]
        again = np.concatenate([[False], (nxt[1:] == nxt[:-1]) & (group[1:] == group[:-1])])
        same = np.zeros(len(order), bool)
        same[where] = again
        off += n
    return order


class Matches:
    """Where the suffixes of the items stand in a shard's suffix array.

    Each whole item suffix is binary-searched, block of ``n`` words by block: ``lo`` and ``hi``
    of level t bound the places that share its first (t + 1) * n words. The levels end
    where no place shares more; what places share beyond the last block is compared word by word.
    """

    def __init__(self, tokens: np.ndarray, index: ItemIndex, here: np.ndarray):
        self.tokens, self.index = tokens, index
        n, base = index.seed, index.base
        self.array = suffix_array(tokens, here, n, base, index.longest)
        self.padded = np.concatenate([tokens, np.zeros(index.longest + 2 * n, np.int64)])
        grams, _ = packed(self.padded, n, base)
        of_items, whole = packed(np.concatenate([index.text, np.zeros(index.longest + 2 * n, np.int64)]), n, base)
        lo = np.searchsorted(grams[self.array], index.gram, "left")
        hi = np.searchsorted(grams[self.array], index.gram, "right")
        self.suffix = np.flatnonzero(hi > lo)
        self.levels = [(lo[self.suffix], hi[self.suffix])]
        level = 0
        while True:
            level += 1
            at = index.at[self.suffix] + level * n
            lo, hi = self.levels[-1]
            open_ = np.flatnonzero((hi > lo) & whole[at])
            if not len(open_):
                break
            new_lo, new_hi = hi.copy(), hi.copy()
            for side, into in (("left", new_lo), ("right", new_hi)):
                into[open_] = self._bisect(grams, of_items[at[open_]], lo[open_], hi[open_], level * n, side)
            self.levels.append((new_lo, new_hi))

    def _bisect(self, grams: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray, off: int, side: str) -> np.ndarray:
        """``searchsorted`` of each key in its own range of the array, by the words from ``off`` on."""
        lo, hi = lo.copy(), hi.copy()
        while (lo < hi).any():
            mid = (lo + hi) // 2
            value = grams[self.array[np.minimum(mid, len(self.array) - 1)] + off]
            right = (lo < hi) & ((value < key) if side == "left" else (value <= key))
            left = (lo < hi) & ~right
            lo[right] = mid[right] + 1
            hi[left] = mid[left]
        return lo

    def longest(self) -> np.ndarray:
        """For each searched suffix the words of its longest match, in whole blocks."""
        return sum((hi > lo).astype(np.int64) for lo, hi in self.levels) * self.index.seed

    def runs(self, block: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, shift, seeds) of the matches that cannot be made longer to the left, about
        ``block`` places at a time: seeds is the number of runs of ``n`` words in the match. A
        match inside a longer one on the same diagonal is not reported again."""
        index, n = self.index, self.index.seed
        lo, hi = self.levels[0]
        size = hi - lo
        before = np.concatenate([[0], self.tokens])
        before_items = np.concatenate([[0], index.text])
        bounds = np.unique(np.concatenate([np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), block)), [len(size)]]))
        for begin, end in zip(bounds[:-1], bounds[1:]):
            many = size[begin:end]
            which = np.repeat(np.arange(begin, end), many)
            rank = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[begin:end], many)
            place, start = self.array[rank], index.at[self.suffix[which]]
            first = before_items[start] == 0
            new = np.flatnonzero(first | (before[place] != before_items[start]))
            which, rank, place, start = which[new], rank[new], place[new], start[new]
            words = np.zeros(len(which), np.int64)
            for a, b in self.levels:
                words += n * ((rank >= a[which]) & (rank < b[which]))
            for _ in range(n - 1):
                x = index.text[np.minimum(start + words, len(index.text) - 1)]
                words += (x > 0) & (x == self.padded[place + words])
            item = index.item_of[self.suffix[which]]
            yield item, place - (start - index.first[item]), words - n + 1


def summed(pair: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different (item, shift), in order, with the sum of their seeds."""
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    pair, seeds = pair[order], seeds[order]
    new = np.concatenate([[True], (pair[1:] != pair[:-1]).any(1)]) if len(pair) else np.zeros(0, bool)
    return pair[new], np.add.reduceat(seeds, np.flatnonzero(new)) if len(pair) else seeds


def search_shard(tokens: np.ndarray, index: ItemIndex, min_seeds: int, min_equal: float = 0.8) -> pd.DataFrame:
    """Every (position, item) of the shard with a passage, best passage first."""
    n, base = index.seed, index.base
    grams, whole = packed(tokens, n, base)
    here = np.flatnonzero(whole)
    slot = np.searchsorted(index.known, grams[here])
    slot[slot == len(index.known)] = 0
    here = here[index.known[slot] == grams[here]]
    if not len(here):
        return pd.DataFrame()
    pair, seeds = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    # diagonals are counted block by block, so what is held are different ones only
    for item, shift, n_seeds in Matches(tokens, index, here).runs():
        some, count = summed(np.stack([item, shift], 1), n_seeds)
        pair, seeds = summed(np.concatenate([pair, some]), np.concatenate([seeds, count]))
    enough = seeds >= np.minimum(min_seeds, index.sure[pair[:, 0]])
    return read_diagonals(tokens, index, pair[enough], min_equal)


def read_diagonals(tokens: np.ndarray, index: ItemIndex, pair: np.ndarray, min_equal: float) -> pd.DataFrame:
    """Reads items against the shard along diagonals and keeps each one's longest
    passage: equal words in order, where no two words in a row differ and
    ``min_equal`` of the words are equal."""
    out = []
    pad = index.longest + 1
    wide = np.concatenate([np.zeros(pad, np.int64), tokens, np.zeros(pad, np.int64)])
    for at in range(0, len(pair), 200_000):
        item, shift = pair[at : at + 200_000].T
        m = len(item)
        first, size = index.first[item], index.size[item]
        start, last, run, best, best_start, best_hits, hits, longest = (np.zeros(m, np.int64) for _ in range(8))
        last[:] = -9
        for k in range(index.longest):
            same = (k < size) & (wide[np.minimum(shift + k + pad, len(wide) - 1)] == index.text[np.minimum(first + k, len(index.text) - 1)])
            fresh = same & (k - last > 2)
            start[fresh] = k
            hits[fresh] = 0
            hits += same
            run = np.where(same, run + 1, 0)
            longest = np.maximum(longest, run)
            last[same] = k
            span = k - start + 1
            better = same & (span > best) & (hits >= min_equal * span - 1e-9)
            best[better], best_start[better], best_hits[better] = span[better], start[better], hits[better]
        out.append(pd.DataFrame({"item": item, "at": shift + best_start, "from": best_start, "words": size, "span": best, "hits": best_hits, "longest": longest}))
    return pd.concat(out) if out else pd.DataFrame()


def leaks(
    corpus: DataFrame,
    items: DataFrame,
    corpus_id: str = "doc_id",
    corpus_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_share: float = 0.5,
    min_equal: float = 0.8,
    seed_words: int = 3,
    min_seeds: int = 3,
    shard_words: int = 1_000_000,
    block_words: int = 2_000_000,
) -> DataFrame:
    """Documents that hold at least ``min_share`` of an item's words as one passage.

    One row per document and item with the passage's length, its equal words,
    its longest verbatim run and where it begins in document and item (in
    words). Case, punctuation and the amount of white space don't count; single
    words may be replaced, as long as ``min_equal`` of the passage is equal.
    ``seed_words`` words in a row must be equal ``min_seeds`` times for a place to
    be read (fewer, and fewer words, where a passage of an item may have fewer). Items are the query set: they are sent to the
    executors in blocks of at most ``block_words`` words (one item may exceed
    it), each block against all documents. The corpus is not shuffled, unless it is so small
    that it is spread over all cores (``session.spread``).

    Null or blank texts, items without words and empty tables match nothing;
    rows with a null id are left out; repeated rows count once; columns other
    than the named ones are ignored.
    """
    spark = corpus.sparkSession
    wanted = (
        items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"))
        .where("i is not null and t is not null")
        .distinct()
        .withColumn("n", F.size(F.split("t", r"\s+")))
    )
    texts = corpus.select(F.col(corpus_id).cast("bigint").alias("doc_id"), F.col(corpus_text).alias("text")).where(
        "doc_id is not null and text is not null"
    )
    texts = spread(texts)
    total = wanted.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    parts = []
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).select("i", "t").collect()
        index = spark.sparkContext.broadcast(ItemIndex([(r.i, r.t) for r in rows], seed_words, min_share, min_equal))
        parts.append(texts.mapInPandas(_searcher(index, min_share, min_equal, min_seeds, shard_words), MATCH_SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _searcher(index, min_share: float, min_equal: float, min_seeds: int, shard_words: int):
    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: ItemIndex = index.value
        if not len(own.ids):
            return
        get = own.vocab.get
        docs: list[int] = []
        starts: list[int] = []
        flat: list[int] = []

        def flush() -> pd.DataFrame:
            found = search_shard(np.array(flat + [0] * own.seed, dtype=np.int64), own, min_seeds, min_equal)
            if not len(found):
                return found
            found = found[found["span"] >= np.maximum(1, min_share * found["words"])]
            doc = np.searchsorted(starts, found["at"].to_numpy(), side="right") - 1
            return (
                pd.DataFrame(
                    {
                        "doc_id": np.array(docs, dtype=np.int64)[doc],
                        "item_id": own.ids[found["item"]],
                        "item_words": found["words"].to_numpy("int32"),
                        "passage_words": found["span"].to_numpy("int32"),
                        "matched_words": found["hits"].to_numpy("int32"),
                        "longest_verbatim": found["longest"].to_numpy("int32"),
                        "doc_word": (found["at"].to_numpy() - np.array(starts)[doc]).astype("int32"),
                        "item_word": found["from"].to_numpy("int32"),
                    }
                )
                .sort_values(["passage_words", "matched_words", "doc_word"], ascending=[False, False, True])
                .drop_duplicates(["doc_id", "item_id"])
            )

        for frame in frames:
            for doc, text in zip(frame["doc_id"], frame["text"]):
                docs.append(doc)
                starts.append(len(flat))
                flat += [get(w, 0) for w in words_of(text)]
                # two, so that no passage goes on in the next document
                flat += [0, 0]
                if len(flat) >= shard_words:
                    if len(found := flush()):
                        yield found
                    docs, starts, flat = [], [], []
        if docs and len(found := flush()):
            yield found

    return search


def without_leaks(corpus: DataFrame, found: DataFrame, corpus_id: str = "doc_id") -> DataFrame:
    """``corpus`` without the documents of ``found`` (doc_id); rows with a null id stay."""
    return corpus.join(found.select(F.col("doc_id").alias(corpus_id)).distinct(), corpus_id, "left_anti")
