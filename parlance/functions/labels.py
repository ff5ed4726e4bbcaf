"""Emotion label domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal those of published annotations, in their order.
RAW = ["anger", "disgust", "excitement", "fear", "frustration", "happiness", "joy", "neutral", "other", "sadness", "surprise", "unknown"]
MAPPED = ["angry", "disgusted", "excited", "fearful", "frustrated", "joyful", "neutral", "sad", "surprised"]
SHOWN = ["joyful", "sad", "neutral", "angry", "excited", "surprised", "frustrated", "fearful", "disgusted"]
MELD = ["joyful", "sad", "neutral", "angry", "surprised", "fearful", "disgusted"]
IEMOCAP = ["joyful", "sad", "neutral", "angry", "excited", "frustrated"]
RAW_TO_MAPPED = {
    "anger": "angry", "disgust": "disgusted", "excitement": "excited", "fear": "fearful", "frustration": "frustrated", "happiness": "joyful",
    "joy": "joyful", "neutral": "neutral", "other": "unknown", "sadness": "sad", "surprise": "surprised", "unknown": "unknown",
}
CODES = {
    "ang": "anger", "hap": "happiness", "sad": "sadness", "neu": "neutral", "exc": "excitement", "fru": "frustration",
    "fea": "fear", "sur": "surprise", "dis": "disgust", "oth": "other", "xxx": "unknown",
}
HINT_PREFIX = {
    "default": "reaction of potential listeners: ", "alt1": "mental state or behavior: ",
    "alt2": "speaker's intention or reason: ", "default-no-audio": "speaker's intention or reason: ",
}
TRUE, FALSE = ["y", "yes", "t", "true", "on", "1"], ["n", "no", "f", "false", "off", "0"]


def literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def lookup(d: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Value of a key; null, or the default, on a miss."""
    got = F.try_element_at(literal_map(d), key)
    return got if default is None else F.coalesce(got, default)


def label_id(label: Column, labels: list[str] = MAPPED) -> Column:
    """0-based position in the ordered domain, null for others."""
    p = F.array_position(F.array(*[F.lit(x) for x in labels]), label)
    return F.when(p > 0, (p - 1).cast("int"))


def valid_labels(corpus: str | None) -> list[str]:
    """Labels of a corpus in presentation order."""
    if corpus is None or corpus.lower() == "both":
        return SHOWN
    return {"meld": MELD, "iemocap": IEMOCAP}[corpus.lower()]


def to_bool(text: Column) -> Column:
    """Truth of its spellings in any case; any other text fails."""
    t = F.lower(text)
    return F.when(t.isin(TRUE), True).when(t.isin(FALSE), False).otherwise(F.raise_error(F.concat(F.lit("invalid truth value "), text)).cast("boolean"))
