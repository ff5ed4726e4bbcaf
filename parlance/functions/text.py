"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_controls(text: Column) -> Column:
    """Six C1 controls: one becomes an apostrophe, two become blanks, three vanish."""
    return F.translate(text, "\x92\x97\x85\x91\x93\x94", "'  ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"^\n+|\n+$", "")


def anonymize(text: Column, names: Column) -> Column:
    """Replace whole-word names, ignoring case, one after the other in the order of ``names``.

    ``names``: array of struct<name, alias>. Later names see what earlier ones made of the text.
    """
    pattern = lambda n: F.concat(F.lit(r"(?iU)\b\Q"), n["name"], F.lit(r"\E\b"))
    return F.aggregate(names, text, lambda acc, n: F.regexp_replace(acc, pattern(n), n["alias"]))


def audio_phrase(rate: Column, pitch: Column, intensity: Column) -> Column:
    return F.concat(rate, F.lit(" speech rate, "), pitch, F.lit(" pitch, and "), intensity, F.lit(" intensity"))


def pack(blocks: Column, wanted: Column) -> Column:
    """Demonstrations as one text: numbered, parted by a blank line and stripped, or joined by lines if only one was wanted."""
    numbered = F.transform(blocks, lambda x, i: F.concat(F.lit("Demonstration "), (i + 1).cast("string"), F.lit(":\n"), x))
    return F.when(wanted <= 1, F.array_join(blocks, "\n")).otherwise(strip(F.array_join(numbered, "\n\n")))


def key(prefix: Column, dialog: Column, turn: Column) -> Column:
    return F.concat_ws("_", prefix, dialog.cast("string"), turn.cast("string"))


def key_dialog(idx: Column) -> Column:
    """All but the last part of a key, with the corpus letter."""
    return F.regexp_extract(idx, "^(.*)_[^_]*$", 1)


def key_turn(idx: Column) -> Column:
    return F.substring_index(idx, "_", -1).try_cast("int")


def first_label(text: Column, labels: list[str], missing: str = "NoValidEmotionFound") -> Column:
    """The label mentioned first, in any case; no label is the beginning of another."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(text), "(" + "|".join(labels) + ")", 1), F.lit("")), F.lit(missing))


def single_label(text: Column, labels: list[str]) -> Column:
    """The only label mentioned; texts with several or none are told apart."""
    hit = F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: F.lower(text).contains(x))
    return F.when(F.size(hit) == 1, hit[0]).when(F.size(hit) > 1, "MultipleValidEmotionsFound").otherwise("NoValidEmotionFound")


def dialog_type(dialog: Column) -> Column:
    return F.when(dialog.contains("impro"), "impro").when(dialog.contains("script"), "script").otherwise("")


def template(text: str, **slots: Column) -> Column:
    """A text with ``{slot}`` places as one concatenation; values are never scanned for places again.

    A place without slot fails when the query is built; unused slots are ignored; null values read as empty.
    """
    import re

    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\{(\w+)\}", text):
        parts += [F.lit(text[at : m.start()]), F.coalesce(slots[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(text[at:]))
