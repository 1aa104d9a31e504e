"""Deterministic stand-ins for human and model judgements, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parolumi.functions import text as X

# What a stratum adds to the chance of an error.
STRATUM_RISK = {"A_colloquial": 0.18, "D_codeswitch": 0.22, "B_polysemy": 0.10, "C_lowconf": 0.15, "E_control": 0.0}


def error_risk(logprob: Column, stratum: Column) -> Column:
    """Chance of an error: a base, growing with low confidence, plus the stratum's, at most 0.85."""
    extra = F.lit(0.0)
    for name, add in STRATUM_RISK.items():
        extra = F.when(stratum == name, add).otherwise(extra)
    return F.least(F.lit(0.85), F.lit(0.06) + F.least(F.lit(0.5), F.greatest(F.lit(0.0), -F.coalesce(logprob, F.lit(0.0))) * 0.35) + extra)


def word_labels(items: DataFrame, seed: str = "7") -> DataFrame:
    """(id, verdict, correction, mistranscribed) drawn for gold words by id."""
    u, m = X.draw(seed, F.col("id")), X.draw(seed + "m", F.col("id"))
    p = error_risk(F.col("logprob"), F.col("stratum"))
    verdict = F.when(u < p * 0.6, "wrong").when(u < p, "acceptable").when(u > 0.985, "unsure").otherwise("correct")
    return items.select("id", verdict.alias("verdict"), F.when(verdict.isin("wrong", "acceptable"), F.concat(F.lit("fix:"), F.coalesce("gloss", F.lit("")))).otherwise("").alias("correction"), ((F.coalesce("logprob", F.lit(0.0)) < -0.6) & (m < 0.5)).alias("mistranscribed"))


def gloss_judge(word: Column) -> Column:
    """The offline judge of glosses: by the length of the word."""
    n = F.length(word)
    return F.when(n % 7 == 0, "wrong").when(n % 5 == 0, "acceptable").otherwise("correct")


def note_judge(note: Column) -> Column:
    """The offline judge of notes: by the length of the note."""
    n = F.length(note)
    return F.when(n % 9 == 0, "wrong").when(n % 5 == 0, "partial").otherwise("correct")


def glosses_match(gold: Column, candidate: Column) -> Column:
    return F.lower(F.trim(gold)) == F.lower(F.trim(candidate))


def gold_meaning(verdict: Column, gloss: Column, correction: Column, fall_back: bool = False) -> Column:
    """The right meaning: the gloss if judged correct, else the correction; where that is
    blank null, or with ``fall_back`` the gloss."""
    fixed = F.nullif(F.trim(F.coalesce(correction, F.lit(""))), F.lit(""))
    return F.when(verdict == "correct", gloss).otherwise(F.coalesce(fixed, gloss) if fall_back else fixed)


def judged(labels: DataFrame) -> DataFrame:
    """Labels with a verdict other than 'unsure', with strict and lenient error flags."""
    return labels.where(F.col("verdict").isNotNull() & (F.col("verdict") != "unsure")).withColumns({"strict_error": F.col("verdict").isin("wrong", "acceptable").cast("int"), "lenient_error": (F.col("verdict") == "wrong").cast("int")})


def failure_bucket(word: Column, mistranscribed: Column, stratum: Column, note: Column) -> Column:
    """Where a gloss error comes from; the first rule that holds."""
    return (
        F.when(mistranscribed, "ASR-propagated")
        .when(X.has_latin(word) | X.has_cyrillic(word) | X.has_digit(word), "code-switch/NER")
        .when(stratum == "B_polysemy", "wrong-sense (polysemy)")
        .when((stratum == "A_colloquial") | (F.coalesce(note, F.lit("")) != ""), "colloquial/slang")
        .otherwise("translation/other")
    )


# Words by which a note's claim is told, in order of precedence.
CLAIMS = [
    ("derivation", "сокращени|уменьшительн| от [ա-ֆ]|корн|суффикс|приставк|образова|буквальн"),
    ("grammar", "накл|(^|[^а-яё0-9_])л\\.([а-яё0-9_])|лицо|времен|прич|глагол|падеж|числ|спряжени|вспомог|связк|повелит|сослагат|будущ|прош|настоящ|дееприч"),
    ("register", "разг|сленг|диалект|просторечи|вульгар|жаргон|фамильярн|груб"),
]


def claim_type(note: Column) -> Column:
    low = F.lower(F.coalesce(note, F.lit("")))
    out = F.lit("other")
    for name, pattern in reversed(CLAIMS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out
