"""Defective pairs of a text and its translation.

Rules look at each pair (stand-ins, copies, language).  Refusals are replies that recur
over unlike sources, and what a machine learnt from them takes for one (``replies``).
A translation breaks off if, in sorted order, its neighbour goes on where it ends
(``prefixes``), if the windows it shares with all other translations always go on
(``tails``), if it covers too little of the word glosses, or if it ends at a length at
which translations pile up (``truncation.limits``).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from parolumi.llm import prefixes, replies, tails, truncation
from parolumi.session import written

# What stands for "no text".
STAND_INS = {
    "n/a", "na", "nan", "null", "none", "nil", "empty", "undefined", "no output", "no text", "no translation", "not available", "untranslated", "tbd", "todo",
    "нет", "нет перевода", "нет текста", "без перевода", "перевод отсутствует", "пусто", "չկա", "թարգմանություն չկա", "aucune", "vide", "pas de traduction",
}

_LETTER = re.compile(r"[^\W\d_]")
_RUSSIAN = re.compile("[а-яё]", re.IGNORECASE)
_UNRUSSIAN = re.compile("[іїєґўѓќљњћђџјәғқңөұүһ]", re.IGNORECASE)
_PUNCT = re.compile(r"[\W_]+")


def is_blank(text: str | None) -> bool:
    """Null, without letters and digits, or a stand-in for no text."""
    if not text:
        return True
    bare = _PUNCT.sub(" ", text).strip().lower()
    return not bare or bare in STAND_INS or text.strip().strip("()[]{}<>\"'«» .").lower() in STAND_INS


def is_russian(text: str) -> bool:
    """At least half of the letters are Russian, and none belongs to another Cyrillic alphabet only."""
    letters = len(_LETTER.findall(text))
    if not letters:
        return True
    strange = len(_UNRUSSIAN.findall(text))
    return len(_RUSSIAN.findall(text)) * 2 >= letters and strange * 20 < letters


def overlap(a: list[str], b: list[str]) -> float:
    """Share of the longer list's words that both have."""
    return sum((Counter(a) & Counter(b)).values()) / max(1, len(a), len(b))


def coverage(parts: list[str], whole: list[str]) -> float:
    """Share of ``parts`` that stand in ``whole``."""
    return sum((Counter(parts) & Counter(whole)).values()) / max(1, len(parts))


def explanation_defect(text: str | None, explanation: str | None, copied: float = 0.8) -> str | None:
    """empty, copied, wrong_language or None; whether it refuses or breaks off is not judged here."""
    if is_blank(explanation):
        return "empty"
    said = tails.words_of(explanation)
    source = tails.words_of(text) if text else []
    if source and overlap(source, said) >= copied and not is_russian(text):
        return "copied"
    return None if is_russian(explanation) else "wrong_language"


#: A gloss of so many words may be a reply about the request.
LONG_GLOSS = 4


class Gloss:
    """What the rules ask about a gloss; glosses recur, so workers keep them."""

    __slots__ = ("blank", "long", "words", "lettered", "russian", "bare")

    def __init__(self, text: str | None):
        self.blank = is_blank(text)
        words = () if self.blank else tuple(tails.words_of(text))
        self.long = len(words) >= LONG_GLOSS
        self.words = () if self.long else words
        self.lettered = not self.blank and bool(_LETTER.search(text))
        self.russian = self.blank or is_russian(text)
        self.bare = "" if self.blank else _PUNCT.sub("", text.lower())


@lru_cache(100_000)
def gloss(text: str | None) -> Gloss:
    return Gloss(text)


@lru_cache(100_000)
def spoken_form(word: str | None) -> tuple[str, bool]:
    """A word in lower case without punctuation, and whether it has letters."""
    return (_PUNCT.sub("", word.lower()), bool(_LETTER.search(word))) if word else ("", False)


def words_defect(text: str | None, words: list[tuple[str | None, str | None]], missing: float = 1 / 3, copied: float = 0.5, foreign: float = 0.5) -> str | None:
    """empty, truncated, copied, wrong_language or None."""
    pairs = [(spoken_form(w)[0], gloss(g)) for w, g in words]
    told = [(w, g) for w, g in pairs if not g.blank]
    if not told:
        return "empty"
    expected = sum(1 for t in (text or "").split() if _PUNCT.sub("", t))
    spoken = sum(1 for w, _ in pairs if w)
    if expected and (expected - spoken) / expected >= missing:
        return "truncated"
    lettered = [(w, g) for w, g in told if g.lettered]
    # a Russian word within the text is its own gloss by right
    same = sum(1 for w, g in lettered if w and w == g.bare and not is_russian(w))
    if same >= copied * len(words):
        return "copied"
    other = sum(1 for w, g in lettered if w != g.bare and not g.russian)
    return "wrong_language" if lettered and other >= foreign * len(lettered) else None


def judged(segments: DataFrame, key: list[str], faithful: float = 0.5) -> DataFrame:
    """The rule-based defects of each segment, the end of its translation and its replies.

    ``segments`` has the key columns, text, explanation, word_texts and glosses (arrays
    of strings in step; null counts as empty). reply is a translation of three words or
    more; it is faithful if it covers that share of the glosses, else ``source`` has the
    text's words. long_glosses are glosses of LONG_GLOSS words or more with their word.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text, said, ws, gs in zip(f["text"], f["explanation"], f["word_texts"], f["glosses"]):
                words = list(zip(ws, gs)) if ws is not None and gs is not None else []
                two = words_defect(text, words)
                # numbers and signs are often left out of a translation
                flat = [x for w, g in words if spoken_form(w)[1] for x in gloss(g).words] if two in (None, "truncated") else []
                one = explanation_defect(text, said)
                spoken = tails.words_of(said) if one in (None, "wrong_language") else []
                covered = coverage(flat, spoken) if flat else None
                true = covered is not None and covered >= faithful
                state, key1, key2, size = None, None, None, (None, None)
                if one is None:
                    state, _, _, key1, key2 = tails.tail_of(said)
                    if state in ("final", "blank"):
                        state = None
                    else:
                        size = (len(said), len(said.encode()))
                reply = said if len(spoken) >= 3 else None
                source = sorted(set(tails.words_of(text or ""))) if reply and not true else None
                long = [{"reply": g, "word": spoken_form(w)[0]} for w, g in words if gloss(g).long]
                rows.append((one, two, covered if two is None else None, state, key1, key2, *size, reply, true if reply else None, source, long or None))
            kinds = [("on_explanation", object), ("on_words", object), ("covered", "Float64"), ("state", object), ("key1", "Int64"), ("key2", "Int64"), ("size", "Int32"), ("bytes", "Int32"), ("reply", object), ("faithful", object), ("source", object), ("long_glosses", object)]
            cols = list(zip(*rows)) or [()] * len(kinds)
            found = pd.DataFrame({name: pd.array(list(c), dtype=kind) if kind is not object else pd.Series(list(c), dtype=object) for (name, kind), c in zip(kinds, cols)})
            yield pd.concat([f[key].reset_index(drop=True), found], axis=1)

    types = dict(segments.dtypes)
    names = ", ".join(f"`{k}` {types[k]}" for k in key)
    kept = segments.select(*key, "text", "explanation", "word_texts", "glosses")
    return kept.mapInPandas(
        run,
        f"{names}, on_explanation string, on_words string, covered double, state string, key1 bigint, key2 bigint, size int, bytes int, "
        "reply string, faithful boolean, source array<string>, long_glosses array<struct<reply:string,word:string>>",
    )


def defects(segments: DataFrame, key: list[str], least_covered: float = 0.7, fully_covered: float = 0.9) -> DataFrame:
    """One row (key, field_name, defect) per defective pair.

    A translation is truncated if its end breaks off (``tails``), or lacks its final
    mark and covers less than ``least_covered`` of the glosses of the segment's words, or
    lacks it, covers less than ``fully_covered`` and is the beginning of another translation,
    or ends with a word at a length at which translations are cut. A refusal goes before
    what the rules say, except for empty and copied ones.
    Rows equal in everything but delivery count once; rows with a null in the key are left
    out; an empty table gives no rows.
    """
    own = segments.dropna(subset=key)
    counts = tails.window_counts(own, "explanation")
    rows = written(judged(own, key), "judged-pairs")
    by_reply = rows.select("reply", "source", "faithful").where("reply is not null")
    by_gloss = rows.select(F.explode("long_glosses").alias("g")).select("g.reply", F.array("g.word").alias("source"), F.lit(False).alias("faithful"))
    refusing = replies.refusing(by_reply.unionByName(by_gloss)).select(F.xxhash64("reply").alias("reply_hash"), F.lit(True).alias("refuses"))
    asked = rows.select(*key, F.explode(F.array_union(F.array(F.struct(F.lit("explanation").alias("field_name"), F.xxhash64("reply").alias("reply_hash"))), F.transform(F.coalesce("long_glosses", F.array().cast("array<struct<reply:string,word:string>>")), lambda g: F.struct(F.lit("words").alias("field_name"), F.xxhash64(g["reply"]).alias("reply_hash"))))).alias("r"), "reply", "faithful").where("r.field_name = 'words' or (reply is not null and not faithful)")
    refused = written(asked.select(*key, "r.*").join(refusing, "reply_hash").select(*key, "field_name", F.lit("refusal").alias("defect")).distinct(), "refused")

    doubtful = rows.where("state is not null").select(*key, "state", "covered", "key1", "key2", "size", "bytes", F.xxhash64("reply").alias("reply_hash"))
    doubtful = tails.with_evidence(doubtful, counts, key)
    said = own.where("explanation is not null").select(F.lit("explanation").alias("field"), F.col("explanation").alias("value"))
    for unit, measure in (("size", F.length), ("bytes", F.octet_length)):
        lim = truncation.limits(said, "field", measure=measure).select(F.col("limit_size").alias(unit), F.lit(True).alias(f"{unit}_limit"))
        doubtful = doubtful.join(lim, unit, "left")
    more = F.substr(F.col("longer"), F.length("value") + 1).rlike(r"[\p{L}\p{N}]")
    goes_on = prefixes.shortened(rows, "reply").where(more).select(F.xxhash64("value").alias("reply_hash"), F.lit(True).alias("goes_on"))
    doubtful = doubtful.join(goes_on, "reply_hash", "left")
    bare = F.col("state") == "bare"
    at_limit = bare & F.coalesce("size_limit", "bytes_limit", F.lit(False))
    begun = bare & F.coalesce("goes_on", F.lit(False)) & (F.coalesce("covered", F.lit(0.0)) < fully_covered)
    cut = doubtful.where(tails.breaks_off() | (F.col("covered") < least_covered) | begun | at_limit)
    cut = cut.select(*key, F.lit("explanation").alias("field_name"), F.lit("truncated").alias("defect"))

    field = lambda name, defect: F.struct(F.lit(name).alias("field_name"), defect.alias("defect"))
    by_rule = rows.select(*key, F.explode(F.array(field("explanation", F.col("on_explanation")), field("words", F.col("on_words")))).alias("d")).select(*key, "d.*").where("defect is not null")
    first = F.when(F.col("defect").isin("empty"), 0).when(F.col("defect") == "refusal", 1).otherwise(2)
    every = by_rule.unionByName(cut).unionByName(refused).distinct()
    return every.withColumn("place", first).groupBy(*key, "field_name").agg(F.min(F.struct("place", "defect")).alias("d")).select(*key, "field_name", "d.defect")
