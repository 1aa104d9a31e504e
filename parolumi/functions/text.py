"""Text functions as column expressions: normalisers, n-grams, scripts, loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Marks the normalisers know.
WER_MARKS = "[։՝՜՞՛'’,.\\-—«»…:;!?]"
QUALITY_MARKS = "[։՝՜՛'’,.\\-—«»…:;!?]"
FORM_MARKS = "[։՝՜՞,.\\s]+"
TRAILING_MARKS = "[։,.\\s]+$"

# Letters counted as Armenian and as other scripts.
ARMENIAN = "[԰-֏]"
OTHER_SCRIPTS = "[A-Za-zЀ-ӿ؀-ۿऀ-ॿ]"
ANY_LETTER = "[A-Za-zЀ-ӿ԰-֏؀-ۿऀ-ॿ]"

_SPACES = "(?U)\\s+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once: inside a lambda an outer expression
    would be computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """White-space separated words; null and blank give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES), lambda w: w != "")


def _marks_to_spaces(text: Column, marks: str) -> Column:
    return F.replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), marks, " "), F.lit("եւ"), F.lit("և"))


def wer_norm(text: Column) -> Column:
    """For error rates: lower case, marks as spaces, the two-letter conjunction as one letter."""
    return _marks_to_spaces(text, WER_MARKS)


def quality_norm(text: Column) -> Column:
    """As ``wer_norm``, but the question mark over a vowel stays."""
    return _marks_to_spaces(text, QUALITY_MARKS)


def form_norm(text: Column) -> Column:
    """Key of a word form: marks and spaces deleted, case kept."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), FORM_MARKS, "")


def gloss_norm(text: Column) -> Column:
    """As ``form_norm``, in lower case."""
    return F.lower(form_norm(text))


def profile_norm(text: Column) -> Column:
    """Only trailing marks and spaces deleted."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), TRAILING_MARKS, ""))


def script_share(text: Column) -> Column:
    """Armenian letters in percent of all letters of known scripts; null without any."""
    a = F.regexp_count(text, F.lit(ARMENIAN)).cast("double")
    o = F.regexp_count(text, F.lit(OTHER_SCRIPTS)).cast("double")
    return F.when(a + o > 0, 100.0 * a / (a + o))


def has_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def has_cyrillic(text: Column) -> Column:
    return text.rlike("[А-Яа-яЁё]")


def has_digit(text: Column) -> Column:
    return text.rlike("\\p{Nd}")


def word_grams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by a separator that no text holds."""
    none = F.array().cast("array<string>")
    return let(tokens, lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - n + 1)), lambda i: F.array_join(F.slice(t, i, n), "\x1f"))).otherwise(none))


def char_grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters of the text without white space."""
    none = F.array().cast("array<string>")
    bare = F.regexp_replace(text, _SPACES, "")
    return let(bare, lambda s: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - n + 1)), lambda i: F.substring(s, i, F.lit(n)))).otherwise(none))


def top_count(items: Column) -> Column:
    """How often the most frequent element occurs; 0 for an empty array."""
    runs = F.aggregate(
        F.array_sort(items),
        F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda a, x: F.struct(
            x.alias("last"),
            F.when((a["run"] > 0) & (a["last"] == x), a["run"] + 1).otherwise(1).alias("run"),
            F.greatest(a["best"], F.when((a["run"] > 0) & (a["last"] == x), a["run"] + 1).otherwise(1)).alias("best"),
        ),
        lambda a: a["best"],
    )
    return F.when(F.size(items) > 0, runs).otherwise(0)


def is_loop(text: Column, least_words: int = 20, least_repeats: int = 15, least_share: float = 0.6) -> Column:
    """Whether one run of five words fills the text: ``least_repeats`` times or more and
    more than ``least_share`` of the words. Runs are counted only in texts that are long
    enough and have so few distinct runs that one could repeat so often."""

    def judged(w: Column) -> Column:
        def repeats(grams: Column) -> Column:
            spare = F.size(grams) - F.size(F.array_distinct(grams))
            return F.when(spare >= least_repeats - 1, let(top_count(grams), lambda c: (c >= least_repeats) & (c * 5.0 / F.size(w) > least_share))).otherwise(False)

        return F.when(F.size(w) >= least_words, let(word_grams(w, 5), repeats)).otherwise(False)

    return let(words(text), judged)


def degenerate(text: Column, seconds: Column) -> Column:
    """Why a transcript is unusable: 'wrong script', 'impossible rate', 'loop', else null."""
    letters = F.regexp_count(text, F.lit(ANY_LETTER)).cast("double")
    own = F.regexp_count(text, F.lit(ARMENIAN)).cast("double")
    rate = F.try_divide(F.size(words(text)).cast("double"), seconds)
    return (
        F.when((letters >= 5) & (own < 0.5 * letters), "wrong script")
        .when((seconds > 3) & (rate > 6.0), "impossible rate")
        .when(is_loop(text), "loop")
    )


def detokenized(tokens: Column) -> Column:
    """Words joined by spaces, no space before closing marks."""
    return F.trim(F.regexp_replace(F.array_join(tokens, " "), "\\s+([։?!.,…])", "$1"))


def first_json(text: Column) -> Column:
    """The widest {...} of a reply, or null."""
    return F.nullif(F.regexp_extract(text, "(?s)\\{.*\\}", 0), F.lit(""))


def digest_order(seed: str, *key: Column) -> Column:
    """A reproducible shuffle: order by this."""
    return F.md5(F.concat_ws("::", F.lit(seed), *key))


def draw(seed: str, *key: Column) -> Column:
    """A reproducible number in [0, 1)."""
    return F.conv(F.substring(digest_order(seed, *key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def clip_name(stem: Column) -> tuple[Column, Column]:
    """Category and clip of a name 'category__clip', divided at the first '__'; nulls for others."""
    part = lambda i: F.nullif(F.regexp_extract(stem, "^(.*?)__(.*)$", i), F.lit(""))
    return part(1), part(2)


def splat(left: dict[str, Column], right: dict[str, Column]) -> list[Column]:
    """Columns of two records laid over each other: of a name in both, the right one's value
    where there is one."""
    return [(F.coalesce(right[name], left[name]) if name in left and name in right else (right.get(name) if name in right else left[name])).alias(name) for name in {**left, **right}]
