"""Documents packed into containers of fixed capacity.

Documents are dealt into cells of bounded size. In a cell they are placed best-fit,
longest first; then a local search moves documents, exchanges one for one and two for
one between underfull containers, each step raising the sum of squared fills, until
containers run empty. Containers that are still underfull are opened again and their
documents dealt into fewer cells, so what remains unused does not grow with the number
of cells.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from parolumi.session import spread, written

#: Where the public tokenizers' vocabulary files lie; a parameter of the operators.
TOKENIZER_DIR = os.environ.get("PAROLUMI_TOKENIZERS", "/opt/tokenizers")

# The splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, tokens) of every document under a public byte-level vocabulary; null
    and empty texts have 0 tokens; rows with a null id are left out."""
    path = os.path.join(folder, vocabulary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "tokens": [len(coder.encode_ordinary(t)) if t else 0 for t in f["text"]]})

    kept = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    return spread(kept).mapInPandas(run, "doc_id bigint, tokens bigint")


class Bins:
    """Containers of one cell: item sizes, the container of each item, fills."""

    def __init__(self, size: np.ndarray, capacity: int):
        self.size, self.capacity = size.astype(np.int64), capacity
        self.bin = np.full(len(size), -1, np.int64)
        self.fill = np.zeros(0, np.int64)
        self.members: list[list[int]] = []
        self._best_fit()

    def _best_fit(self) -> None:
        """Longest first, each into the fullest container that has room."""
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        # bit r of ``some`` tells that a container with r tokens of room exists
        some, fill = 0, []
        for i in np.argsort(-self.size, kind="stable").tolist():
            s = int(self.size[i])
            fitting = some >> s
            if fitting:
                r = s + (fitting & -fitting).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    some &= ~(1 << r)
                self.members[b].append(i)
                fill[b] += s
            else:
                b, r = len(fill), self.capacity
                fill.append(s)
                self.members.append([i])
            self.bin[i] = b
            left = r - s
            room[left].append(b)
            some |= 1 << left
        self.fill = np.array(fill, dtype=np.int64)

    def least(self) -> int:
        """No packing has fewer containers."""
        return int(-(-self.size.sum() // self.capacity))

    def used(self) -> int:
        return int((self.fill > 0).sum())

    def shift(self, items: list[int], source: int, target: int) -> None:
        for i in items:
            self.members[source].remove(i)
            self.members[target].append(i)
            self.bin[i] = target
            self.fill[source] -= self.size[i]
            self.fill[target] += self.size[i]

    def search(self, max_tries: int = 4000, crowded: int = 12) -> None:
        """Swap-based local search until no step helps, the least number of containers
        is reached, ``max_tries`` emptiest containers were tried or more than 40 of them
        in a row could not be improved.

        Pairs are not formed inside containers of more than ``crowded`` items. A step
        takes ``d`` tokens from a container filled ``a`` to one filled ``b`` and raises the
        sum of squares by 2d(b - a + d).
        """
        tries, stuck = 0, set()
        while self.used() > self.least() and tries < max_tries:
            open_ = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
            order = open_[np.argsort(self.fill[open_], kind="stable")]
            donor = next((int(b) for b in order if int(b) not in stuck), None)
            if donor is None:
                break
            tries += 1
            if self._step(donor, crowded):
                stuck.clear()
            else:
                stuck.add(donor)
                if len(stuck) > 40:
                    break

    def _step(self, a: int, crowded: int) -> bool:
        """The best move or exchange that takes tokens out of container ``a``."""
        mine = sorted(self.members[a], key=lambda i: (-self.size[i], i))
        groups = [[i] for i in mine]
        if len(mine) <= crowded:
            groups += [[x, y] for n, x in enumerate(mine) for y in mine[n + 1 :]]
        fill_a = int(self.fill[a])
        slack = self.capacity - self.fill
        usable = (slack > 0) & (self.fill > 0)
        usable[a] = False
        if not usable.any():
            return False
        singles = np.flatnonzero(usable[self.bin])
        pairs = self._pairs(usable, crowded)
        best: tuple[int, list[int], list[int], int] | None = None
        for g in groups:
            s = int(self.size[g].sum())
            # a move: no item comes back
            target = np.flatnonzero(usable & (slack >= s))
            if len(target):
                b = int(target[np.argmin(slack[target])])
                best = self._better(best, s, s, b, g, [], fill_a)
            for back, sizes, bins in ((singles[:, None], self.size[singles], self.bin[singles]), pairs):
                if len(g) == 2 and back.shape[1] == 2 or not len(sizes):
                    continue
                d = s - sizes
                gain = np.where((d > 0) & (d <= slack[bins]), d * (self.fill[bins] - fill_a + d), 0)
                k = int(gain.argmax())
                if gain[k] > 0:
                    best = self._better(best, s, int(d[k]), int(bins[k]), g, back[k].tolist(), fill_a)
        if best is None:
            return False
        _, out, back, b = best
        self.shift(out, a, b)
        self.shift(back, b, a)
        return True

    def _better(self, best, s: int, d: int, b: int, out: list[int], back: list[int], fill_a: int):
        gain = d * (int(self.fill[b]) - fill_a + d)
        return (gain, out, back, b) if gain > 0 and (best is None or gain > best[0]) else best

    def _pairs(self, usable: np.ndarray, crowded: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [(x, y, b) for b in np.flatnonzero(usable).tolist() if 2 <= len(self.members[b]) <= crowded for n, x in enumerate(self.members[b]) for y in self.members[b][n + 1 :]]
        if not rows:
            return np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        p = np.array(rows, dtype=np.int64)
        return p[:, :2], self.size[p[:, 0]] + self.size[p[:, 1]], p[:, 2]


def _pack_cells(items: DataFrame, capacity: int, cells: int, turn: int) -> DataFrame:
    """items (doc_id, part, tokens) → with container and container_tokens, cell by cell."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins = Bins(frame["tokens"].to_numpy(), capacity)
        bins.search()
        cell = int(frame["cell"].iloc[0])
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "part": frame["part"],
                "tokens": frame["tokens"],
                "container": [f"{turn}-{cell}-{b}" for b in bins.bin],
                "container_tokens": bins.fill[bins.bin],
            }
        )

    dealt = items.withColumn("cell", F.pmod(F.xxhash64("doc_id", "part", F.lit(turn)), F.lit(cells)))
    # cells are few bytes and much work: as many tasks as cells
    return dealt.repartition(cells, "cell").groupBy("cell").applyInPandas(pack, "doc_id bigint, part bigint, tokens bigint, container string, container_tokens bigint")


def packed(sizes: DataFrame, capacity: int, cell_items: int = 10_000, full: float = 0.998, max_turns: int = 4) -> DataFrame:
    """The container of every document of ``sizes`` (doc_id, tokens).

    Columns: doc_id, part (0 for whole documents; parts of longer ones from 0), tokens (of
    the part), container, container_tokens, unused (of the container). A document is
    split only if it exceeds the capacity: into full containers and one rest. Documents
    of 0 tokens need no room: their container is null and their unused 0. Repeated ids
    are packed once for each row, as parts 0, 1, ... of that id.

    A cell has ``cell_items`` items on average. After a turn, containers filled to
    ``full`` are closed; the rest is dealt anew into cells, at most ``max_turns`` times or
    until one cell held all of it.
    """
    spark = sizes.sparkSession
    rows = sizes.where("doc_id is not null").select("doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))
    rows = rows.withColumn("twin", F.row_number().over(W.partitionBy("doc_id", "tokens").orderBy("tokens")) - 1)
    pieces = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("bigint")
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    parts = parts.withColumn("tokens", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("part") * capacity))
    parts = parts.withColumn("part", F.when(F.col("twin") > 0, F.col("part") + F.col("twin") * (pieces + 1)).otherwise(F.col("part"))).select("doc_id", "part", "tokens")
    parts = written(parts, "packing-parts")
    whole = parts.where(f"tokens = {capacity}").select("doc_id", "part", "tokens", F.format_string("w-%d-%d", "doc_id", "part").alias("container"), F.col("tokens").alias("container_tokens"))
    none = parts.where("tokens = 0").select("doc_id", "part", "tokens", F.lit(None).cast("string").alias("container"), F.lit(capacity).cast("bigint").alias("container_tokens"))
    done = [whole, none]
    rest = parts.where(f"tokens > 0 and tokens < {capacity}")
    for turn in range(1, max_turns + 1):
        left = rest.count()
        if not left:
            break
        cells = max(1, -(-left // cell_items))
        out = written(_pack_cells(rest, capacity, cells, turn), "packing-turn")
        if cells == 1 or turn == max_turns:
            done.append(out)
            break
        closed = F.col("container_tokens") >= int(capacity * full)
        done.append(out.where(closed))
        rest = out.where(~closed).select("doc_id", "part", "tokens")
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.withColumn("unused", F.lit(capacity) - F.col("container_tokens"))


def summary(packing: DataFrame, capacity: int) -> DataFrame:
    """Containers, tokens, unused tokens and the least possible number of containers."""
    boxes = packing.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("held"))
    return boxes.agg(F.count("*").alias("containers"), F.coalesce(F.sum("held"), F.lit(0)).alias("tokens")).select(
        F.lit(capacity).alias("capacity"),
        "containers",
        "tokens",
        (F.col("containers") * capacity - F.col("tokens")).alias("unused"),
        F.ceil(F.col("tokens") / capacity).cast("bigint").alias("least_containers"),
    )
