"""Prompts: template families and their choice, demonstrations and their options, data sets of records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import labels as L
from parlance.functions import text as X
from parlance.operators import dialogue as D
from parlance.operators import retrieval as R

_EXAMPLES = {"plain": "Solved cases:\n{demonstrations}\n\n", "tagged": "<cases>\n{demonstrations}\n</cases>\n", "headed": "# Solved cases\n{demonstrations}\n\n", "ruled": "CASES\n{demonstrations}\n\n"}
_VOICE = {"plain": " The voice: {audio_features}.", "tagged": "  <voice>{audio_features}</voice>\n", "headed": "- Voice: {audio_features}\n", "ruled": "Voice: {audio_features}\n"}
_HINT = {"plain": " Known about the speaker: {hint}.", "tagged": "  <known>{hint}</known>\n", "headed": "- Known: {hint}\n", "ruled": "Known: {hint}\n"}
_BODY = {
    "plain": "You tell how speakers feel.\n\n{{examples}}Dialogue:\n---\n{history}\n---\n\nHow does {speaker_id} feel when saying \"{utterance}\"?{{voice}}{{hint}} Choose from {candidate_emotions}.\n{{close}}",
    "tagged": "<task>Name the speaker's feeling.</task>\n{{examples}}<dialogue>\n{history}\n</dialogue>\n<turn>\n  <speaker>{speaker_id}</speaker>\n  <text>{utterance}</text>\n{{voice}}{{hint}}</turn>\n<choices>{candidate_emotions}</choices>\n{{close}}\n<answer>",
    "headed": "You read feelings in dialogues.\n\n{{examples}}# Dialogue\n{history}\n\n# Turn\n- Speaker: {speaker_id}\n- Text: {utterance}\n{{voice}}{{hint}}\n# Choices\n{candidate_emotions}\n\n{{close}}",
    "ruled": "RULES\n1. Exactly one of: {candidate_emotions}\n2. The turn counts first, then the dialogue, then the voice.\n\n{{examples}}DIALOGUE\n{history}\n\nTURN\nSpeaker: {speaker_id}\nText: {utterance}\n{{voice}}{{hint}}\n{{close}}",
}
_CLOSE = {False: "Answer with the feeling only:", True: "Answer with the feeling only and give no reason:"}
#: Models that have a style of their own.
STYLE_OF = {"gemini": "tagged", "claude": "headed", "gpt5": "ruled"}
#: What a characteristics prompt asks for; the last one is asked without the voice.
ASKED = {"default": "how people who hear it would react", "alt1": "the state of mind or the conduct behind it", "alt2": "what the speaker intends or has as a reason", "default-no-audio": "how people who hear it would react"}


def recognition(style: str = "plain", examples: bool = True, voice: bool = True, hint: bool = False, strict: bool = False) -> str:
    """A template for recognising emotions; ``strict`` is the older wording that forbids an explanation."""
    parts = {"examples": _EXAMPLES[style] if examples else "", "voice": _VOICE[style] if voice else "", "hint": _HINT[style] if hint else "", "close": _CLOSE[strict]}
    text = _BODY[style]
    for name, part in parts.items():
        text = text.replace("{{" + name + "}}", part)
    return text


def characteristics(kind: str) -> str:
    """A template that asks for a description of a turn in ten words at most."""
    voice = "" if kind == "default-no-audio" else " The voice: {audio_features}."
    return f"You reason by common sense.\n\nDialogue:\n---\n{{history}}\n---\n\n{{speaker_id}} says \"{{utterance}}\".{voice} Describe {ASKED[kind]}.\nTen words at most:\n"


def choose(adapter: str | None, use_audio: bool, use_rag: bool) -> str:
    """The template of a model: one styled for it if its path names it, else by what is to be shown. No path is a base model."""
    for model, style in STYLE_OF.items():
        if adapter and model in adapter.lower():
            return recognition(style)
    return recognition("plain", use_rag, use_audio)


@dataclass(frozen=True)
class Options:
    """How demonstrations are chosen and shown.

    ``kind``: single turns, or flow / hybrid windows of ``window`` turns. ``level``: 0 any corpus; 1 that of the target;
    2 also only lines whose label is one of the corpus. ``detailed``: a label on every line, else on the last turn only.
    """

    history: int = 20
    top_n: int = 2
    kind: str = "hybrid"
    window: int = 7
    detailed: bool = True
    level: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}{'V2' if self.detailed and self.kind != 'single' else ''}_n{self.top_n}_m{self.window if self.kind != 'single' else 1}"


def examples(cache: DataFrame, targets: DataFrame, shown: DataFrame, o: Options) -> DataFrame:
    """(row_id, demo_idx, no): for every target the first examples of its cached neighbours, one a dialogue.

    ``cache``: target_key, key, rank; ``targets``: row_id, target_key, dialog_id, source; ``shown``: key, demo_idx,
    demo_dialog, demo_source, demo_row. A target's own dialogue can take one place at most, so the first ``top_n`` + 1
    dialogues of a key and of a neighbour list are enough, per corpus where the corpus counts.
    """
    by = ["demo_source"] if o.level > 0 else []
    one = R.first_per_group(shown.withColumn("__g", F.concat_ws("\x1f", "key", *by)), "__g", "demo_dialog", "demo_row", o.top_n + 1).drop("new_rank", "__g")
    near = cache.join(one, "key").withColumn("__at", F.struct("rank", "demo_row")).withColumn("__g", F.concat_ws("\x1f", "target_key", *by))
    near = R.first_per_group(near, "__g", "demo_dialog", "__at", o.top_n + 1).drop("new_rank", "__g")
    cand = targets.join(near, "target_key").filter(F.col("demo_dialog") != F.col("dialog_id"))
    if o.level > 0:
        cand = cand.filter(F.col("demo_source") == F.col("source"))
    return R.first_per_group(cand, "row_id", "demo_dialog", "__at", o.top_n).select("row_id", "demo_idx", F.col("new_rank").alias("no"))


def example_text(o: Options) -> Column:
    """The text of a turn as an example, over a frame of turns with speaker, utterance, label, source."""
    if o.kind == "single":
        return F.concat(F.lit("< "), "utterance", F.lit(" : "), "label", F.lit(" >"))
    line = F.concat("speaker", F.lit(" : "), "utterance")
    if not o.detailed:
        return F.concat(F.lit("< "), D.lines(["dialog_id"], "turn_idx", line, o.window - 1), F.lit("\nLast utterance label is: "), F.col("label"), F.lit(" >"))
    line = F.concat(line, F.lit(" :-> "), "label")
    if o.level == 2:
        valid = F.when(F.col("source") == "meld", F.col("label").isin(L.MELD)).otherwise(F.col("label").isin(L.IEMOCAP))
        line = F.when(valid, line)
    return F.concat(F.lit("<\n"), D.lines(["dialog_id"], "turn_idx", line, o.window - 1), F.lit("\n>"))


def demonstrations(picked: DataFrame, turns: DataFrame, o: Options) -> DataFrame:
    """(row_id, demonstrations) of picked examples, in their order."""
    texts = turns.select(F.col("idx").alias("demo_idx"), example_text(o).alias("demo"))
    g = picked.join(texts, "demo_idx").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("no", "demo"))).alias("a"))
    return g.select("row_id", X.pack(F.transform("a", lambda x: x["demo"]), F.lit(1 if o.kind == "single" else o.top_n)).alias("demonstrations"))


def records(turns: DataFrame, voice: DataFrame, demos: DataFrame, o: Options) -> DataFrame:
    """(idx, split, input, target) of all target turns; missing levels of the voice read medium."""
    line = F.concat("speaker", F.lit(": "), "utterance")
    ctx = turns.withColumn("history", D.history(["dialog_id"], "turn_idx", line, o.history)).filter("erc_target")
    full = ctx.join(voice.select("row_id", "rate_level", "pitch_level", "intensity_level").na.fill("medium"), "row_id").join(demos, "row_id", "left")
    fields = F.struct("history", "utterance", X.audio_phrase(F.col("rate_level"), F.col("pitch_level"), F.col("intensity_level")).alias("audio_features"), F.col("speaker").alias("speaker_id"), F.coalesce("demonstrations", F.lit("")).alias("demonstrations"))
    return full.select("idx", "split", fields.alias("input"), F.col("label").alias("target"))


def characteristics_set(answers: DataFrame, rows: DataFrame, key: str, answer_key: str, cover: bool = True) -> DataFrame:
    """Answers about rows in which no column is null. ``cover`` fails unless every row has one answer at least."""
    if cover and not rows.select(key).join(answers.select(F.col(answer_key).alias(key)), key, "left_anti").isEmpty():
        raise ValueError("there are rows without an answer")
    empty = sum((F.col(f"`{c}`").isNull().cast("int") for c in rows.columns), F.lit(0))
    whole = rows.filter(empty == 0).select(F.col(key).alias("__k")).distinct()
    return answers.join(whole, F.col(answer_key) == F.col("__k"), "left_semi")
