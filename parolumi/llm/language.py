"""Languages of documents and of stretches inside them.

Hierarchical discrimination: linear one-versus-rest machines choose the language
family of a stretch, then one-versus-one linear support vector machines choose
among the closely related languages of that family.  Features are character
n-grams inside words, so a language counts in whatever letters it is written.
Scores are linear, hence a stretch's score is the mean of its words' scores and
each distinct word has to be scored once per worker only.

Training uses the labels themselves, wrong ones included: after a first fit the
sentences that contradict their document's label are left out and the machines
are fitted again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from parolumi.session import bounded_sample, spread

# Languages told apart, by family.
FAMILIES = {
    "armenian": ["hy"],
    "slavic": ["ru"],
    "western": ["en", "fr"],
    "iranian": ["fa"],
}

# Notations of languages in labels, beside ISO 639-1 codes with or without region.
NOTATIONS = {
    "hy": ["hye", "arm", "armenian", "հայերեն", "армянский"],
    "ru": ["rus", "russian", "русский", "ռուսերեն"],
    "en": ["eng", "english", "английский", "անգլերեն"],
    "fr": ["fra", "fre", "french", "français", "французский", "ֆրանսերեն"],
    "fa": ["fas", "per", "pes", "persian", "farsi", "فارسی", "персидский", "պարսկերեն"],
}

# Labels that say the language is not known.
UNKNOWN = ["", "und", "unk", "unknown", "n/a", "na", "none", "null", "nan", "?", "-", "other", "mis", "zxx", "mul", "xx", "undefined", "undetermined", "not known"]

LANGUAGES = [x for members in FAMILIES.values() for x in members]

_WORD = re.compile(r"[^\W\d_]+(?:['’\u200c][^\W\d_]+)*")
_MARKS = re.compile("[՚-՞\u00ad\u200b\u200d\u2060\ufeff]")
_STOP = re.compile(r"[։.!?…؟۔]|\w:(?:\s|$)")
_END = re.compile(r"(?<=[։.!?…:؟۔])[»\"')\]]*\s+|\n+")

WIDTH = 1 << 15


def label_language(label: Column) -> Column:
    """The language a label names: a code of LANGUAGES, the label's own primary
    tag when it names another language, null when it is null, blank or says the
    language is not known."""
    low = F.lower(F.trim(label))
    primary = F.regexp_extract(low, r"^([^-_\s(]+)", 1)
    named = F.lit(None).cast("string")
    for code, names in NOTATIONS.items():
        named = F.when(low.isin([code, *names]) | primary.isin([code, *names]), code).otherwise(named)
    return F.when(label.isNull() | low.isin(UNKNOWN), F.lit(None)).otherwise(F.coalesce(named, low))


def sentences_of(text: str) -> list[str]:
    return [s for s in _END.split(text) if s and not s.isspace()]


def words_of(text: str) -> list[str]:
    return _WORD.findall(_MARKS.sub("", text.lower()))


def grams(word: str) -> np.ndarray:
    w = f"^{word}$"
    found = {w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)} - {"^", "$"}
    found.add(w)
    return np.fromiter((zlib.crc32(g.encode()) & (WIDTH - 1) for g in found), dtype=np.int64)


def fit_svm(rows: "Bags", y: np.ndarray, weight: np.ndarray, steps: int = 90, reg: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, both classes weighing the same,
    by accelerated gradient descent over all rows."""
    pos = y > 0
    weight = np.where(pos, weight / max(1e-9, 2 * weight[pos].sum()), weight / max(1e-9, 2 * weight[~pos].sum()))
    w, b = np.zeros(WIDTH), 0.0
    vw, vb = w.copy(), b
    rate = 0.5 / rows.bound
    for t in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (rows.score(vw) + vb))
        g = -2 * weight * y * slack
        w2, b2 = vw - rate * (rows.gradient(g) + reg * vw), vb - rate * g.sum()
        m = (t - 1) / (t + 2)
        vw, vb = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, b


def stratum_weights(bags: list[list[str]], y: np.ndarray) -> np.ndarray:
    """Weights by which sentences of one language in one script count as the
    square root of their number: a language in unusual letters is heard, while the
    few wrong labels of a script don't outweigh its right ones."""
    strata = [(x, script_of(b)) for b, x in zip(bags, y)]
    number: dict[tuple, int] = {}
    for s in strata:
        number[s] = number.get(s, 0) + 1
    return np.array([number[s] ** -0.5 for s in strata])


def script_of(words: list[str]) -> int:
    """A number for the script of most letters: their block of 256 code points,
    the Latin blocks taken as one."""
    blocks: dict[int, int] = {}
    for w in words:
        b = ord(w[0]) >> 8
        b = 0 if b < 3 else b
        blocks[b] = blocks.get(b, 0) + len(w)
    return max(blocks, key=lambda b: (blocks[b], -b)) if blocks else -1


class Bags:
    """Sentences as mean n-gram vectors, kept by way of their words."""

    def __init__(self, sentences: list[list[str]], cache: dict[str, np.ndarray] | None = None):
        cache = {} if cache is None else cache
        number: dict[str, int] = {}
        ids = [number.setdefault(w, len(number)) for s in sentences for w in s]
        self.word = np.array(ids, dtype=np.int64)
        self.count = np.array([len(s) for s in sentences])
        self.row = np.repeat(np.arange(len(sentences)), self.count)
        feats = [cache.setdefault(w, None) if cache.get(w) is not None else cache.__setitem__(w, grams(w)) or cache[w] for w in number]
        self.feat = np.concatenate(feats) if feats else np.zeros(0, np.int64)
        size = np.array([len(f) for f in feats], dtype=np.int64)
        self.of = np.repeat(np.arange(len(feats)), size)
        self.scale = 1 / np.sqrt(np.maximum(1, size))
        self.bound = 1.0

    def score(self, w: np.ndarray) -> np.ndarray:
        words = np.bincount(self.of, w[self.feat], len(self.scale)) * self.scale
        return np.bincount(self.row, words[self.word], len(self.count)) / np.maximum(1, self.count)

    def gradient(self, g: np.ndarray) -> np.ndarray:
        words = np.bincount(self.word, (g / np.maximum(1, self.count))[self.row], len(self.scale)) * self.scale
        return np.bincount(self.feat, words[self.of], WIDTH)


class Model:
    """Family machines and pair machines over one feature space."""

    #: Distinct words whose scores a worker keeps; beyond it scores are made anew.
    KEPT_WORDS = 300_000

    def __init__(self, families: list[str], members: dict[str, list[str]], pairs: list[tuple[str, str]], weights: np.ndarray, bias: np.ndarray, slope: float = 4.0):
        self.families, self.members, self.pairs = families, members, pairs
        self.weights, self.bias, self.slope = weights.astype(np.float32), bias, slope
        self.forget()

    #: Whether the last column is no language's but a further machine's (``with_machine``).
    further = False

    def with_machine(self, weights: np.ndarray, bias: float) -> "Model":
        """This model with one machine more over the same features, whose score of each sentence
        ``Sentences.further`` gives."""
        more = Model(self.families, self.members, self.pairs, np.column_stack([self.weights, weights]), np.append(self.bias, bias), self.slope)
        more.further = True
        return more

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((1024, self.weights.shape[1]), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("number", "rows")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def numbers(self, words: list[str]) -> list[int]:
        """Numbers of words, whose scores stand in ``rows`` at them until ``forget``."""
        get = self.number.get
        out = []
        for w in words:
            n = get(w)
            if n is None:
                n = self.number[w] = len(self.number)
                if n == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                f = grams(w)
                self.rows[n] = self.weights[f].sum(0) / np.sqrt(max(1, len(f)))
            out.append(n)
        return out

    def matrix(self, words: list[str]) -> np.ndarray:
        if len(self.number) > self.KEPT_WORDS:
            self.forget()
        at = self.numbers(words)
        return self.rows[at]

    def decide(self, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and confidence for rows of mean word scores."""
        s = means + self.bias
        k = len(self.families)
        fam = s[:, :k]
        best = fam.argmax(1)
        top = fam[np.arange(len(fam)), best]
        second = np.partition(fam, -2, axis=1)[:, -2] if k > 1 else top - 1
        sure = 1 / (1 + np.exp(-self.slope * (top - second)))
        lang = np.array([self.members[f][0] for f in self.families], dtype=object)[best]
        for f, members in self.members.items():
            if len(members) < 2:
                continue
            here = best == self.families.index(f)
            votes = np.zeros((len(s), len(members)))
            for n, (a, b) in enumerate(self.pairs):
                if a in members and b in members:
                    x = s[:, k + n]
                    votes[:, members.index(a)] += np.where(x > 0, 1 + x / 1e3, x / 1e3)
                    votes[:, members.index(b)] += np.where(x > 0, -x / 1e3, 1 - x / 1e3)
                    sure = np.where(here, sure / (1 + np.exp(-self.slope * np.abs(x))), sure)
            lang[here] = np.array(members, dtype=object)[votes.argmax(1)][here]
        return lang, sure


    def word_scores(self, means: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages, and each one's score for rows of word scores: its family's, less
        what speaks for its relatives."""
        s = means + self.bias
        langs = [x for f in self.families for x in self.members[f]]
        out = np.stack([s[:, k] for k, f in enumerate(self.families) for _ in self.members[f]], 1)
        for n, (a, b) in enumerate(self.pairs):
            x = s[:, len(self.families) + n]
            out[:, langs.index(a)] += np.minimum(0, x)
            out[:, langs.index(b)] += np.minimum(0, -x)
        return langs, out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = 4000, max_sentences: int = 12_000, longest: int = 50_000) -> Model:
    """Fits the machines on the driver.

    The sample is bounded: the ``sample_docs`` labelled documents with the lowest
    hash of their id among those of ``longest`` characters at most, of whose sentences
    ``max_sentences`` at most are taken at even steps. Languages of which no labelled sentence is there are not told apart.
    """
    code = label_language(F.col(lang))
    labelled = docs.select(F.col(doc_id).alias("i"), code.alias("y"), F.col(text).alias("t")).where(F.col("i").isNotNull() & (F.length("t") <= longest) & F.col("y").isin(LANGUAGES))
    rows = sorted(bounded_sample(labelled, "i", sample_docs).select("i", "y", "t").collect())
    bags, truth = [], []
    for r in rows:
        for s in sentences_of(r.t):
            if len(w := words_of(s)) >= 3:
                bags.append(w)
                truth.append(r.y)
    step = max(1, -(-len(bags) // max_sentences))
    return fit(bags[::step], truth[::step])


def fit(bags: list[list[str]], truth: list[str], rounds: int = 2) -> Model:
    """Machines from tokenised sentences and their (partly wrong) languages."""
    cache: dict[str, np.ndarray] = {}
    present = set(truth)
    members = {f: [x for x in langs if x in present] for f, langs in FAMILIES.items()}
    members = {f: m for f, m in members.items() if m} or {"armenian": ["hy"]}
    families = list(members)
    pairs = [p for m in members.values() for p in combinations(m, 2)]
    family_of = {x: f for f, m in members.items() for x in m}
    model = Model(families, members, pairs, np.zeros((WIDTH, len(families) + len(pairs))), np.zeros(len(families) + len(pairs)))
    kept = list(range(len(bags)))
    for n in range(rounds + 1):
        if not kept:
            break
        rows = Bags([bags[i] for i in kept], cache)
        y = np.array([truth[i] for i in kept], dtype=object)
        fam = np.array([family_of[x] for x in y], dtype=object)
        weight = stratum_weights([bags[i] for i in kept], y)
        cols, bias = [], []
        for f in families:
            w, b = fit_svm(rows, np.where(fam == f, 1.0, -1.0), weight)
            cols.append(w), bias.append(b)
        for a, b_ in pairs:
            of_two = np.isin(y, [a, b_])
            at = [i for i, x in zip(kept, of_two) if x]
            w, b = fit_svm(Bags([bags[i] for i in at], cache), np.where(y[of_two] == a, 1.0, -1.0), weight[of_two])
            cols.append(w), bias.append(b)
        model = Model(families, members, pairs, np.stack(cols, 1), np.array(bias))
        if n < rounds:
            every = Bags(bags, cache)
            means = np.stack([every.score(model.weights[:, k].astype(float)) for k in range(len(bias))], 1)
            said, _ = model.decide(means)
            kept = [i for i in range(len(bags)) if said[i] == truth[i]]
    return model


class Sentences:
    """The sentences of some texts as arrays: text number, words, letters, commas,
    language, confidence, and whether it is a piece of a longer one or the text has no
    sentence marks at all (its length says nothing then).

    A sentence of more than ``long_sentence`` words (text without punctuation) is
    taken in pieces of ``piece`` words. Where the language of ``window`` words around
    changes inside it, the pieces end there, unless fewer than five words remain. A
    shorter one in a text without sentence marks is divided at the ``borders`` of
    languages only, as it may be several sentences, of three words at least.
    """

    def __init__(self, model: Model, texts: list[str | None], long_sentence: int = 40, piece: int = 15, window: int = 7):
        if len(model.number) > model.KEPT_WORDS:
            model.forget()
        text, count, commas, ids, size, unmarked = [], [], [], [], [], []
        for i, t in enumerate(texts):
            bare = not (t and _STOP.search(t))
            for s in sentences_of(t) if t else ():
                words = words_of(s)
                if words:
                    text.append(i)
                    count.append(len(words))
                    unmarked.append(bare)
                    commas.append(s.count(",") + s.count("،") + s.count("՝"))
                    ids += model.numbers(words)
                    size += map(len, words)
        n = np.array(count, dtype=np.int64)
        m = model.rows[ids] if ids else np.zeros((0, len(model.bias)), np.float32)
        starts, first = [], 0
        owner: list[int] = []
        for k, c in enumerate(count):
            if c <= long_sentence and unmarked[k]:
                cuts = self._changes(model, m[first : first + c])
                starts += [first + x for x in cuts]
                owner += [k] * len(cuts)
            elif c <= long_sentence:
                starts.append(first)
                owner.append(k)
            else:
                cuts = self._cuts(model, m[first : first + c], piece, window)
                starts += [first + x for x in cuts]
                owner += [k] * len(cuts)
            first += c
        self.owner = np.array(owner, dtype=np.int64)
        at = np.array(starts, dtype=np.int64)
        self.text = np.array(text, dtype=np.int64)[self.owner] if len(at) else at
        self.words = np.diff(np.append(at, first))
        self.piece = (self.words < n[self.owner]) | np.array(unmarked)[self.owner] if len(at) else np.zeros(0, bool)
        self.commas = np.array(commas, dtype=np.int64)[self.owner] if len(at) else at
        if len(at):
            self.letters = np.add.reduceat(np.array(size, dtype=np.int64), at)
            means = np.add.reduceat(m, at, axis=0) / self.words[:, None]
            self.lang, self.sure = model.decide(means)
        else:
            means = np.zeros((0, len(model.bias)))
            self.letters, self.lang, self.sure = at, np.zeros(0, object), np.zeros(0)
        self.further = means[:, -1] + model.bias[-1] if model.further else np.zeros(len(means))

    @staticmethod
    def _changes(model: Model, m: np.ndarray, least: int = 3, price: float = 3.0) -> list[int]:
        if len(m) < 2 * least:
            return [0]
        c = np.concatenate([np.zeros((1, m.shape[1])), np.cumsum(m, 0, dtype=np.float64)])
        lang, _ = model.decide((c[least:] - c[:-least]) / least)
        return borders(model.word_scores(m)[1], least, price, False, False) if (lang != lang[0]).any() else [0]

    @staticmethod
    def _cuts(model: Model, m: np.ndarray, piece: int, window: int) -> list[int]:
        c = np.concatenate([np.zeros((1, m.shape[1])), np.cumsum(m, 0, dtype=np.float64)])
        at = np.arange(len(m))
        lo, hi = np.maximum(0, at - window // 2), np.minimum(len(m), at + window // 2 + 1)
        lang, _ = model.decide((c[hi] - c[lo]) / (hi - lo)[:, None])
        cuts = [0]
        for x in (np.flatnonzero(lang[1:] != lang[:-1]) + 1).tolist():
            if x - cuts[-1] >= 5 and len(m) - x >= 5:
                cuts.append(x)
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(m)]):
            parts = max(1, (b - a) // piece)
            out += [a + (b - a) * k // parts for k in range(parts)]
        return out


def in_slices(texts: pd.Series, letters: int = 2_000_000) -> Iterator[tuple[int, list]]:
    """(first, texts) of successive slices of about ``letters`` letters, one text at least."""
    slice_, first, size = [], 0, 0
    for i, t in enumerate(texts):
        slice_.append(t)
        size += len(t) if t else 0
        if size >= letters:
            yield first, slice_
            slice_, first, size = [], i + 1, 0
    if slice_:
        yield first, slice_


def _summary(lang: list[str], sure: list[float], letters: list[int], min_share: float) -> tuple:
    if not lang:
        return (None, None, None, None, None, False, [], [])
    total = sum(letters)
    by: dict[str, int] = {}
    for x, n in zip(lang, letters):
        by[x] = by.get(x, 0) + n
    order = sorted(by, key=lambda x: (-by[x], x))
    one, two = order[0], order[1] if len(order) > 1 else None
    confidence = sum(p * n for x, p, n in zip(lang, sure, letters) if x == one) / by[one]
    joined: list[list] = []
    for x, n in zip(lang, letters):
        if joined and joined[-1][0] == x:
            joined[-1][1] += n
        else:
            joined.append([x, n])
    second = by[two] / total if two else None
    return (one, confidence, by[one] / total, two, second, bool(two) and by[two] >= min_share * total, [x for x, _ in joined], [n for _, n in joined])


def document_languages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_share: float = 1 / 6) -> DataFrame:
    """Language, confidence and mixture of every document.

    Columns: doc_id, label_lang (what the label names, null when it names none),
    detected (language of most of the text), confidence (mean confidence of its
    sentences, weighted by letters), share (its share of the
    letters), second and second_share (the next language with whole sentences),
    mixed (second_share >= min_share), stretch_langs and stretch_letters (successive sentences of
    one language joined). Null, empty and wordless texts get nulls and mixed =
    false. Rows with a null id are kept; repeated rows give repeated rows.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = told.value
        for f in frames:
            rows: list[tuple] = []
            for _, texts in in_slices(f["text"]):
                got = Sentences(m, texts)
                bounds = np.searchsorted(got.text, np.arange(len(texts) + 1))
                for a, b in zip(bounds[:-1], bounds[1:]):
                    rows.append(_summary(got.lang[a:b].tolist(), got.sure[a:b].tolist(), got.letters[a:b].tolist(), min_share))
            out = pd.DataFrame(rows, columns=["detected", "confidence", "share", "second", "second_share", "mixed", "stretch_langs", "stretch_letters"])
            out.insert(0, "label_lang", f["label_lang"].to_numpy())
            out.insert(0, "doc_id", f["doc_id"].to_numpy())
            yield out

    kept = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), label_language(F.col(lang)).alias("label_lang"), F.col(text).alias("text"))
    return spread(kept).mapInPandas(
        run,
        "doc_id bigint, label_lang string, detected string, confidence double, share double, second string, second_share double, mixed boolean, stretch_langs array<string>, stretch_letters array<int>",
    )


def borders(scores: np.ndarray, least: int, price: float, begun: bool, goes_on: bool) -> list[int]:
    """First words of the stretches into which words with ``scores`` (words by
    languages) are best divided, every change of language costing ``price``.

    A stretch has ``least`` words; the first may have fewer if it continues words before
    (``begun``), the last if it goes on in words behind (``goes_on``).
    """
    total = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, 0)])
    n, k = scores.shape
    best = np.full((n + 1, k), -np.inf)  # of the words so far, the last stretch being in this language and long enough
    came = np.zeros((n + 1, k), np.int64)  # where that stretch began
    before = np.zeros((n + 1, k), np.int64)  # the language of the stretch before it
    for j in range(1, n + 1):
        if j >= (1 if begun else least):
            best[j] = total[j]
        stay = best[j - 1] + scores[j - 1]
        take = (came[j - 1] > 0) & (stay > best[j])
        best[j], came[j], before[j] = np.where(take, stay, best[j]), np.where(take, came[j - 1], 0), np.where(take, before[j - 1], 0)
        for size in range(1 if goes_on and j == n else least, least + 1):
            i = j - size
            if i < 1:
                continue
            top = best[i].argmax()
            other = np.full(k, best[i][top])
            which = np.full(k, top)
            if k > 1:
                rest = np.where(np.arange(k) == top, -np.inf, best[i])
                other[top], which[top] = rest.max(), rest.argmax()
            new = other + total[j] - total[i] - price
            take = new > best[j]
            best[j], came[j], before[j] = np.where(take, new, best[j]), np.where(take, i, came[j]), np.where(take, which, before[j])
    starts, j, x = [], n, int(best[n].argmax())
    while came[j][x] > 0:
        starts.append(int(came[j][x]))
        j, x = starts[-1], int(before[j][x])
    return [0, *reversed(starts)]


def word_runs(model: Model, words: list[str | None], min_run: int = 3, price: float = 2.0) -> list[tuple[str, int, int, float]]:
    """(language, first, last + 1, confidence) of the stretches of a word list.

    Successive words in one script make a run. Where windows of ``min_run`` words of a run
    are not all of the run's language, it is divided at the ``borders`` of languages.
    Stretches of fewer than ``min_run`` words, numbers and words without letters go with
    their neighbours.
    """
    tokens, places = [], []
    for i, w in enumerate(words):
        for t in words_of(w) if w else ():
            tokens.append(t)
            places.append(i)
    if not tokens:
        return []
    runs: list[list] = []  # script, first token, last token + 1
    for k, t in enumerate(tokens):
        s = script_of([t])
        if runs and runs[-1][0] == s:
            runs[-1][2] = k + 1
        else:
            runs.append([s, k, k + 1])
    m = model.matrix(tokens)
    parts = np.array([(a, b) for _, a, b in runs])
    windows = np.array([(a, a + min_run) for _, first, end in runs if end - first > min_run for a in range(first, end - min_run + 1)], dtype=np.int64).reshape(-1, 2)
    c = np.concatenate([np.zeros((1, m.shape[1])), np.cumsum(m, 0, dtype=np.float64)])
    mean = lambda x: (c[x[:, 1]] - c[x[:, 0]]) / (x[:, 1] - x[:, 0])[:, None]
    lang, sure = model.decide(mean(np.concatenate([parts, windows])))
    strange = windows[lang[len(parts) :] != lang[: len(parts)][np.searchsorted(parts[:, 0], windows[:, 0], "right") - 1], 0]
    if len(strange):
        divided: list[tuple[int, int]] = []
        for a, b in parts.tolist():
            starts = [0]
            if np.searchsorted(strange, a) < np.searchsorted(strange, b):
                starts = borders(model.word_scores(m[a:b])[1], min_run, price, a > 0, b < len(tokens))
            divided += [(a + x, a + y) for x, y in zip(starts, [*starts[1:], b - a])]
        if len(divided) > len(parts):
            parts = np.array(divided)
            lang, sure = model.decide(mean(parts))
    joined: list[list] = []  # language, first word, last word + 1, confidence, words
    for (a, b), x, p in zip(parts.tolist(), lang, sure):
        first, last = places[a], places[b - 1] + 1
        if joined and joined[-1][0] == x:
            j = joined[-1]
            j[3] = (j[3] * j[4] + p * (b - a)) / (j[4] + b - a)
            j[2], j[4] = last, j[4] + b - a
        else:
            joined.append([str(x), first, last, float(p), b - a])
    long = [j for j in joined if len({p for p in places if j[1] <= p < j[2]}) >= min_run]
    if not long:
        return []
    out: list[list] = []
    for j in long:
        if out and out[-1][0] == j[0]:
            out[-1][2] = j[2]
        else:
            out.append(j[:4])
    return [(x, a, b, p) for x, a, b, p in out]


def segment_languages(segments: DataFrame, model: Model, key: list[str], words: Column, min_confidence: float = 0.8) -> DataFrame:
    """The stretches of segments' word lists that last for three or more words.

    ``words`` is an array of strings; stretches below ``min_confidence`` are left out. One row per segment and stretch: the key
    columns, lang, confidence, first_word, last_word, words (the stretch's number of
    words), total_words, main_lang (language of most words in stretches). Segments
    without words, or with no stretch of three words, give no row; repeated rows
    give repeated rows.
    """
    told = segments.sparkSession.sparkContext.broadcast(model)
    kept = segments.select(*key, words.alias("words"))
    schema = kept.drop("words").schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = told.value
        for f in frames:
            at, rows = [], []
            for i, ws in enumerate(f["words"]):
                if ws is None or not len(ws):
                    continue
                found = [r for r in word_runs(m, list(ws)) if r[3] >= min_confidence]
                if not found:
                    continue
                by: dict[str, int] = {}
                for x, a, b, _ in found:
                    by[x] = by.get(x, 0) + b - a
                main = min(by, key=lambda x: (-by[x], x))
                for x, a, b, p in found:
                    at.append(i)
                    rows.append((x, p, a, b - 1, b - a, len(ws), main))
            out = f.drop(columns="words").iloc[at].reset_index(drop=True)
            more = pd.DataFrame(rows, columns=["lang", "confidence", "first_word", "last_word", "words", "total_words", "main_lang"])
            yield pd.concat([out, more], axis=1)

    return spread(kept).mapInPandas(run, f"{schema}, lang string, confidence double, first_word int, last_word int, words int, total_words int, main_lang string")


def issues(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, issue, lang) of ``document_languages``: missing, wrong, mixed."""
    cases = F.array(
        F.when(F.col("label_lang").isNull(), F.struct(F.lit("missing").alias("issue"), F.col("detected").alias("lang"))),
        F.when(F.col("label_lang") != F.col("detected"), F.struct(F.lit("wrong").alias("issue"), F.col("detected").alias("lang"))),
        F.when(F.col("mixed"), F.struct(F.lit("mixed").alias("issue"), F.col("detected").alias("lang"))),
        F.when(F.col("mixed"), F.struct(F.lit("mixed").alias("issue"), F.col("second").alias("lang"))),
    )
    return (
        documents.where("detected is not null")
        .select("doc_id", F.explode(F.filter(cases, lambda c: c.isNotNull())).alias("c"))
        .select("doc_id", "c.issue", "c.lang")
    )
