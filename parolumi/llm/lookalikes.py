"""Text that looks the same but is written with other characters.

The words of all values form a vocabulary with counts.  Words with suspicious
characters are looked up in tries of the clean words by a weighted edit automaton for
which look-alike letters and ignorable characters cost nothing; the clean word
reached at the least cost is the canonical spelling.  Words that reach none are put
right by table.  The vocabulary is spread by a folded form under which all words at
no cost from each other are equal, so a trie holds every word that its queries can
reach, whatever the number of partitions, and only such words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parolumi.session import written

# Letters that look alike, one class a line; scripts Latin, Cyrillic, Greek, Armenian.
LOOKALIKES = """
aаα
cсϲ
dԁ
eеҽ
gցɡ
hһհ
iіι
jјյ
kкκ
lӏ
nոп
oоοօ
pрρ
qզԛգ
sѕ
uսυ
vνѵ
wԝա
xхχ
yуγ
fք
AАΑ
BВΒ
CСϹ
EЕΕ
FϜ
GԌ
HНΗ
IІΙӀ
JЈ
KКΚ
LԼ
MМΜ
NΝ
OОΟՕ
PРΡ
QԚ
SЅՏ
TТΤ
UՍ
VѴ
WԜ
XХΧ
YҮΥ
ZΖ
""".split()

#: Class of each letter: its first member.
CLASS_OF = {x: line[0] for line in LOOKALIKES for x in line}

#: Further characters nobody sees, beside those of category Cf.
_UNSEEN = "\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180e\u3164\uffa0\ufe00-\ufe0f"
_FORMS = "\uff01-\uff5e\uff61-\uffdc\ufb00-\ufb06\ufb13-\ufb17\ufb1d-\ufdff\ufe70-\ufefc"
_SCRIPTS = ["Latin", "Armenian", "Cyrillic", "Greek"]
_MIX = "|".join(f"\\p{{Is{a}}}[{''.join(f'\\p{{Is{b}}}' for b in _SCRIPTS if b != a)}]" for a in _SCRIPTS)

#: For Spark: characters or neighbours that can make a case; a space other than the plain one; a word.
SUSPICIOUS = f"[{_FORMS}{_UNSEEN}\\p{{Cf}}\\p{{M}}]|{_MIX}"
ODD_SPACE = "[\\p{Z}&&[^ ]]"
WORD = f"([\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Cf}}\\p{{So}}\\p{{Sk}}{_UNSEEN}]+)"


@lru_cache(100_000)
def script(ch: str) -> str:
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "").split(" ")
    return next((n for n in name if n in ("LATIN", "ARMENIAN", "CYRILLIC", "GREEK", "ARABIC")), name[0])


@lru_cache(100_000)
def unseen(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ch in "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0" or 0xFE00 <= ord(ch) <= 0xFE0F or 0x180B <= ord(ch) <= 0x180E


@lru_cache(100_000)
def plain_form(ch: str) -> str:
    """The letters or digits a full-width, half-width or ligature form stands for, else itself."""
    n = ord(ch)
    if 0xFF01 <= n <= 0xFFDC or 0xFB00 <= n <= 0xFB17 or 0xFB1D <= n <= 0xFDFF or 0xFE70 <= n <= 0xFEFC:
        flat = unicodedata.normalize("NFKC", ch)
        return flat if any(x.isalnum() for x in flat) else ch
    return ch


def _pictorial(ch: str) -> bool:
    return bool(ch) and (unicodedata.category(ch) in ("So", "Sk") or 0xFE00 <= ord(ch) <= 0xFE0F or 0x1F3FB <= ord(ch) <= 0x1F3FF)


def needed(word: str, i: int) -> bool:
    """Whether the invisible character at ``i`` belongs there: the non-joiner and the
    joiner between Persian letters, joiners and selectors inside an emoji."""
    ch, before, after = word[i], word[i - 1 : i] if i else "", word[i + 1 : i + 2]
    if ch in "\u200c\u200d" and before and after and script(before) == "ARABIC" and script(after) == "ARABIC":
        return True
    if ch == "\u200d":
        return _pictorial(before) and _pictorial(after)
    return 0xFE00 <= ord(ch) <= 0xFE0F and (_pictorial(before) or before.isdigit() or before in "#*")


def without_marks(word: str) -> tuple[str, list[str]]:
    """The word with plain forms, composed letters and no needless invisible
    characters, and the kinds of what was changed."""
    kinds = []
    seen = "".join(c for i, c in enumerate(word) if not unseen(c) or needed(word, i))
    if seen != word:
        kinds.append("invisible")
    flat = "".join(map(plain_form, seen))
    if flat != seen:
        kinds.append("form")
    composed = unicodedata.normalize("NFC", flat)
    if len(composed) < len(flat):
        kinds.append("combining")
        flat = composed
    return flat, kinds


@lru_cache(100_000)
def alike(ch: str, target: str) -> str:
    """The letter of script ``target`` that looks like ``ch``, or ''."""
    return next((x for line in LOOKALIKES if ch in line for x in line if script(x) == target), "")


def by_table(word: str) -> str:
    """``word`` with foreign look-alikes replaced by letters of the script that all
    its letters can be read in (of several, the one most letters have)."""
    counts: dict[str, int] = {}
    for c in word:
        if s := script(c):
            counts[s] = counts.get(s, 0) + 1
    if len(counts) < 2:
        return word
    for target in sorted(counts, key=lambda s: (-counts[s], s)):
        if all(not script(c) or script(c) == target or alike(c, target) for c in word):
            return "".join(c if not script(c) or script(c) == target else alike(c, target) for c in word)
    return word


def folded(word: str) -> str:
    """Equal for all words at no cost from each other."""
    flat = unicodedata.normalize("NFC", "".join(map(plain_form, (c for c in word if not unseen(c)))))
    return "".join(CLASS_OF.get(c, c) for c in flat)


#: Costs of the automaton's steps; a word is reached below a cost of 1.
FREE, STRANGE = 0.0, 0.6


def strange_places(word: str) -> list[int]:
    """Places inside ``word``, in which one script has most letters, of letters of another
    script that the table has no look-alike for in it."""
    scripts = [script(c) for c in word]
    named = [s for s in scripts if s]
    if len(set(named)) < 2:
        return []
    main = max(sorted(set(named)), key=named.count)
    return [i for i, s in enumerate(scripts) if 0 < i < len(word) - 1 and s and s != main and not alike(word[i], main)]


class Trie:
    """Clean words with their counts, and the weighted edit automaton over them."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.words = 0

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = (word, count)
        self.words += 1

    def reach(self, word: str) -> list[tuple[float, str, int, tuple[str, ...]]]:
        """(cost, word, count, kinds of steps) of every clean word reached below a cost of 1.

        A state is a node with its cost and the kinds of steps that led to it. At no cost
        an ignorable character is passed over, a letter leads to the child that equals it,
        looks like it or is its plain form, and a letter with the mark behind it to the
        letter composed of both. A letter of another script without look-alike leads, for
        STRANGE, to any letter of the word's script. All other edits cost 1 and more, so
        they are not followed.
        """
        strange = set(strange_places(word))
        # at each place of the word: node (by identity) to the cheapest way there
        ways: list[dict[int, tuple]] = [{} for _ in range(len(word) + 2)]
        ways[0][id(self.root)] = (FREE, (), self.root)

        def go(at: int, node: dict, cost: float, kinds: tuple, kind: str | None = None) -> None:
            kinds = kinds if kind is None or kind in kinds else (*kinds, kind)
            held = ways[at].get(id(node))
            if cost < 1 and (held is None or (cost, len(kinds)) < (held[0], len(held[1]))):
                ways[at][id(node)] = (cost, kinds, node)

        for i, c in enumerate(word):
            for cost, kinds, node in ways[i].values():
                if unseen(c) and not needed(word, i):
                    go(i + 1, node, cost, kinds, "invisible")
                flat = plain_form(c)
                for child, alike_too in _walk(node, flat):
                    go(i + 1, child, cost, kinds, "look-alike" if alike_too else "form" if flat != c else None)
                if i + 1 < len(word) and unicodedata.combining(word[i + 1]):
                    one = unicodedata.normalize("NFC", flat + word[i + 1])
                    if len(one) == 1:
                        for child, alike_too in _walk(node, one):
                            go(i + 2, child, cost, (*kinds, "look-alike") if alike_too else kinds, "combining")
                if i in strange:
                    for y, child in node.items():
                        if y and script(y) and script(y) != script(c):
                            go(i + 1, child, cost + STRANGE, kinds, "look-alike")
        return [(cost, *node[""], kinds) for cost, kinds, node in ways[len(word)].values() if "" in node]


def _walk(node: dict, letters: str) -> list[tuple[dict, bool]]:
    """Nodes behind ``letters`` or their look-alikes, and whether a look-alike was taken."""
    states = [(node, False)]
    for x in letters:
        kin = CLASS_OF.get(x)
        states = [(child, took or y != x) for n, took in states for y, child in n.items() if y and (y == x or (kin is not None and CLASS_OF.get(y) == kin and script(y) != script(x)))]
    return states


def spell(trie: Trie, word: str) -> tuple[str, list[str], bool]:
    """(canonical spelling, kinds of change, found in the trie) of a suspicious word.

    The automaton decides: the clean word reached at the least cost, of equally cheap ones
    the most frequent. A word that reaches none is put right by table.
    """
    found = [(cost, -count, w, kinds) for cost, w, count, kinds in trie.reach(word) if w != word]
    if found:
        _, _, best, kinds = min(found)
        return best, sorted(kinds), True
    flat, kinds = without_marks(word)
    fixed = by_table(flat)
    if fixed != flat:
        kinds = [*kinds, "look-alike"]
    return (fixed, sorted(kinds), False) if kinds else (word, [], False)


def keys_of(word: str) -> list[str]:
    """The keys under which clean words reached by ``word`` stand: its folded form, and, where
    it has a strange letter, that form with a gap (U+0000) in its place."""
    places = strange_places(word)
    return [folded(word), *(folded(word[:i]) + "\0" + folded(word[i + 1 :]) for i in places[:1] if len(places) == 1)]


def canonical_words(values: DataFrame, value: str = "value", trie_words: int = 50_000) -> DataFrame:
    """(word, canonical, kinds, in_vocabulary) of every word that has to change.

    Of the clean words only those go into tries that share a key with a suspicious one
    (a join); a task's tries are built one after the other, of whole keys and about
    ``trie_words`` words each, so memory does not grow with the vocabulary.
    """
    words = (
        values.select(F.explode(F.regexp_extract_all(F.col(value), F.lit(WORD), F.lit(1))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .withColumn("odd", F.col("word").rlike(SUSPICIOUS))
    )
    words = written(words, "vocabulary")

    def with_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(keys=[keys_of(w) for w in f["word"]])

    def with_folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(key=[folded(w) for w in f["word"]])

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, odd, last = Trie(), [], None

        def answers() -> pd.DataFrame:
            rows = [(w, *spell(trie, w)) for w in odd]
            return pd.DataFrame([r for r in rows if r[2]], columns=["word", "canonical", "kinds", "in_vocabulary"])

        for f in frames:
            for key, w, n, o in zip(f["key"], f["word"], f["n"], f["odd"]):
                if key != last and trie.words + len(odd) >= trie_words:
                    yield answers()
                    trie, odd = Trie(), []
                last = key
                if o:
                    odd.append(w)
                else:
                    trie.add(w, n)
        yield answers()

    odd = words.where("odd").mapInPandas(with_keys, "word string, n bigint, odd boolean, keys array<string>").select("word", "n", "odd", F.explode("keys").alias("key"))
    odd = written(odd, "odd-words")
    clean = words.where("not odd").mapInPandas(with_folded, "word string, n bigint, odd boolean, key string")
    asked = odd.select("key").distinct()
    plain = clean.join(asked.where("not contains(key, char(0))"), "key", "left_semi")
    # words that fit a gap: the gaps asked for, by length and place, are few
    gaps = asked.where("contains(key, char(0))").select(F.length("key").alias("size"), F.expr("locate(char(0), key)").alias("at")).distinct()
    gapped = clean.join(gaps, F.length("key") == F.col("size")).withColumn("key", F.expr("concat(substr(key, 1, at - 1), char(0), substr(key, at + 1))")).select("word", "n", "odd", "key").join(asked, "key", "left_semi")
    met = odd.select("key", "word", "n", "odd").unionByName(plain.select("key", "word", "n", "odd")).unionByName(gapped.select("key", "word", "n", "odd"))
    ordered = met.repartition("key").sortWithinPartitions("key")
    said = ordered.mapInPandas(look_up, "word string, canonical string, kinds array<string>, in_vocabulary boolean")
    # a word with a strange letter was looked up under two keys: what the trie says goes first
    return said.groupBy("word").agg(F.max_by(F.struct("canonical", "kinds", "in_vocabulary"), F.struct("in_vocabulary", "canonical")).alias("s")).select("word", "s.*")


def changed_values(values: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Values that have to change: key columns, value, words (map of word to
    canonical spelling), kinds (what was found), odd_space.

    Null values are left out and rows equal in key and value count once. Empty tables
    give empty results. Letters of two scripts in one word are look-alikes only if
    the whole word can be read in one script.
    """
    kept = values.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("value"))
    canon = canonical_words(kept)
    some = kept.where(F.col("value").rlike(SUSPICIOUS)).distinct()
    named = some.select(*key, "value", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(WORD), F.lit(1)))).alias("word"))
    hits = (
        named.where(F.col("word").rlike(SUSPICIOUS))
        .join(canon, "word")
        .groupBy(*key, "value")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "canonical"))).alias("words"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"))
    )
    spaced = kept.where(F.col("value").rlike(ODD_SPACE)).distinct().select(*key, "value", F.lit(None).cast("map<string,string>").alias("words"), F.array(F.lit("space")).alias("kinds"))
    return (
        hits.unionByName(spaced)
        .groupBy(*key, "value")
        .agg(F.max_by("words", F.col("words").isNotNull()).alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))
    )


def rewritten(changed: DataFrame) -> DataFrame:
    """``changed_values`` with the column normal: the value in its one consistent form."""
    spaces = re.compile("[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for v, words in zip(f["value"], f["words"]):
                table = dict(words) if words is not None else {}
                for w in sorted(table, key=len, reverse=True):
                    v = re.sub("(?<![^\\W_])" + re.escape(w) + "(?![^\\W_])", lambda _, to=table[w]: to, v) if w[:1].isalnum() else v.replace(w, table[w])
                out.append(spaces.sub(" ", v))
            yield f.assign(normal=out)

    return changed.mapInPandas(run, ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in changed.schema) + ", normal string")
