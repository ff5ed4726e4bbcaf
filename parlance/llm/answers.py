"""Problem 1: defective prompt and response pairs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm import endings, language
from parlance.operators.prefix import hash_key
from parlance.runtime import cut_lineage

#: Whole answers that are only place holders (compared without marks, in lower case).
PLACEHOLDERS = ["", "null", "none", "nil", "nan", "n a", "na", "eos", "s", "pad", "undefined", "empty", "no answer", "no output", "no response", "tbd", "todo", "output", "answer", "response"]
#: An answer copies its inputs if so many of its words stand in them in runs of COPY_GRAM words.
COPY_SHARE, COPY_GRAM = 0.7, 4
#: Answers and prompts of which the language model's own sample is drawn, by hash order.
POOL = 2_000
_NOT = r"(?:can ?not|can't|cant|won't|will not|do not|don't|unable to|not able to|not allowed to|not permitted to|not comfortable|declin(?:e|ing) to|refus(?:e|ing) to|rather not)"
_VERB = r"(?:answer|respond|reply|help|assist|provide|comment|speculat|infer|judg|describ|discuss|determin|assess|generat|complet|comply|fulfil|engag|identif|do (?:this|that|so)|say\b|give (?:an?|any|you)\b|share)"
_TASK = r"(?:(?:answer|respond to|reply to|comment on|speculate (?:on|about)|help (?:you )?with|assist (?:you )?with|discuss|complete|fulfil|comply with|engage with|infer)\s+(?:this|that|these|your|the|any|such|it|what|anything|private)\b|(?:provide|give|generate|offer)\s+(?:an?|any|the|this|that)?\s*(?:answer|response|reply|output|opinion|information|analysis|description|advice)|speculate\b|(?:answer|respond|comply|assist|comment)\s*[.!?]*$)"
_SORRY = r"^\W*(?:(?:i'm|i am|we're|we are) (?:\w+ ){0,2}(?:sorry|afraid)|sorry|(?:my |our )?apologies|i apologi[sz]e|we apologi[sz]e|regrettably|unfortunately|i regret)\b"
_MACHINE = r"\bas an? (?:\w+ )?(?:ai|assistant|language model|model|chatbot)\b"
#: Ways of declining: as a machine, after an apology, of the task itself, or in the passive.
_REFUSALS = re.compile("|".join([
    rf"{_SORRY}[^.!?]{{0,60}}\b{_NOT}\b[^.!?]{{0,20}}\b{_VERB}",
    rf"{_SORRY}[^.!?]{{0,40}}\bdeclin",
    rf"{_MACHINE}[^.!?]{{0,80}}(?:\b{_NOT}|\bnot possible\b|\bdeclin|\bimpossible\b)",
    rf"\b(?:i|we|i'm|i am|i'd|we're|we are)\b[^.!?]{{0,20}}\b{_NOT} (?:\w+ ){{0,2}}{_TASK}",
    r"\b(?:i|we) (?:must|have to|need to|will) (?:\w+ )?decline\b",
    r"\bnot (?:something|a topic|a thing) (?:i|we) (?:\w+ )?(?:can|could|may|will)\b",
    r"\b(?:not possible|impossible|not (?:enough|sufficient) [^.!?]{0,30}) for me to (?:respond|answer|comment|say|judge|help|assist|provide|give|describe|infer)\b",
    r"\bagainst (?:my|our|the) (?:guideline|polic|rule|principle)",
    r"\b(?:request|prompt|question|answer|response|output)\b[^.!?]{0,20}\b(?:was |is |been |were )?(?:refused|denied|declined|blocked|withheld|rejected)\b(?: by (?:policy|the (?:policy|filter|system)))",
    r"^\W*(?:request|prompt|question|answer|response|output) (?:was |is |has been )?(?:refused|denied|declined|blocked|withheld|rejected)\b",
    r"\bno (?:response|answer|output|reply)\b[^.!?]{0,20}\b(?:can|could|will|may) be (?:given|generated|provided|produced|offered)\b",
    r"\bplease try (?:another|again|a different)\b",
]))
_QUOTED = re.compile(r"[\"“„«»][^\"“”„«»]*[\"”“«»]")
_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ](?=\w)")
_WORD = re.compile(r"[^\W_]+")


def refuses(text: str | None) -> bool:
    """Whether a text declines the task, outside quotes; that somebody else declines something does not count, nor do
    ordinary first-person denials."""
    if not text:
        return False
    t = _QUOTED.sub(" ", re.sub("[’ʼ‘]", "'", text.lower()))
    return bool(_REFUSALS.search(re.sub(r"\s+", " ", t)))


def is_empty(text: str | None) -> bool:
    return " ".join(_WORD.findall((text or "").lower())) in PLACEHOLDERS


def copies(answer: str | None, inputs: str | None) -> bool:
    """Whether an answer consists of its inputs' words: COPY_SHARE of its distinct runs of COPY_GRAM words stand in them.

    Shorter answers than a run must stand in the inputs as a whole.
    """
    a, b = (_WORD.findall(_APOSTROPHE.sub("", (x or "").lower())) for x in (answer, inputs))
    if not a or not b:
        return False
    runs = lambda w: set(zip(*[w[i:] for i in range(min(COPY_GRAM, len(a)))]))
    own = runs(a)
    if len(a) < COPY_GRAM:
        return own <= runs(b)
    return len(own & runs(b)) >= COPY_SHARE * len(own)


def find(prompts: DataFrame, answers: DataFrame, key: str, inputs: str, answer_id: str, output: str, labelled: DataFrame, text_col: str, lang_col: str, labelled_id: str, expected: str = "en") -> DataFrame:
    """Every answer with its defect, the first that applies, else null.

    ``empty`` (null, no letter or digit, or a place holder), ``copies_input`` (made of runs of words of its own inputs,
    ``inputs`` being a struct of strings; null fields are skipped), ``refusal``, ``other_language``, ``truncated``
    (end-of-text likelihoods, see endings; the model is counted over all answers and prompts).

    Languages: character n-gram naive Bayes fitted on a bounded sample of ``labelled`` texts; then once more with a
    bounded sample of prompts and of answers that the first model puts into ``expected``. An answer's margin is its
    log-odds per character of ``expected`` against the likeliest other class. Two curves are fitted to the margins, one
    for answers in ``expected`` and one for others; how likely the second is depends on the language of the prompt, whose
    posterior is compared: its share is fitted apart for answers whose prompt is in ``expected`` and for those whose
    prompt is not (or absent). The answer is in another language if the second curve is the likelier
    (``language.split_points``). An answer without letters is in no language, so not in ``expected``.

    Answers without prompt are checked for all but copying. Several answers and repeated deliveries are rows of their
    own. Null keys match nothing. Prompts delivered twice count once. Extra columns are not carried; ids may be null.
    Empty tables give an empty result; without labelled texts every answer with letters is in another language.
    """
    fields = [f.name for f in prompts.schema[inputs].dataType.fields]
    text = F.concat_ws("\n", *[F.col(f"`{inputs}`.`{f}`").cast("string") for f in fields])
    p = cut_lineage(prompts.select(F.col(key).alias("__k"), text.alias("__in")).filter("__k is not null").groupBy("__k").agg(F.max("__in").alias("__in")))
    a = answers.select(F.col(key).alias("__k"), F.col(answer_id).alias("__id"), F.col(output).alias("__out"))
    # a bounded number of answers and prompts, the first by hash, shows the first model how this table writes
    drawn = lambda df, c: df.orderBy(hash_key(1, F.col(c)), c).limit(POOL)
    own = drawn(a.filter("__out is not null"), "__out").join(p, "__k", "left")
    first = language.fit(labelled, labelled_id, text_col, lang_col)
    own = own.filter(~_signs("__out", "__in").getField("empty") & ~_signs("__out", "__in").getField("copy") & (language.classify(first, F.col("__out"), F.col("__in"), expected).getField("lang") == expected))
    model = language.fit(labelled, labelled_id, text_col, lang_col, more={expected: [drawn(p, "__in").select("__in"), cut_lineage(own.select("__out"))]})
    p = p.withColumn("__pl", language.classify(model, F.col("__in"), F.lit(""), expected))
    step = a.join(p.hint("merge"), "__k", "left").withColumn("__h", F.xxhash64("__out", F.lit(3)))
    step = step.withColumn("__s", _signs("__out", "__in")).withColumn("__rl", language.classify(model, F.col("__out"), F.col("__in"), expected))
    step = cut_lineage(step.drop("__in"))
    step = step.withColumn("__same", F.coalesce(F.col("__pl.lang") == expected, F.lit(False)))
    # at most 601 bins a class
    bins = step.filter("not (__s.empty or __s.copy or __s.refuse) and __rl.margin is not null").groupBy("__same", F.round(F.least(F.greatest("__rl.margin", F.lit(-3.0)), F.lit(3.0)), 2).alias("x")).count().collect()
    least = language.split_points([(r["__same"], r["x"], r["count"]) for r in bins])
    foreign = ~F.coalesce(F.col("__rl.margin") >= F.when(F.col("__same"), F.lit(least[True])).otherwise(F.lit(least[False])), F.lit(False))
    sound = step.filter(~(F.col("__s.empty") | F.col("__s.copy") | F.col("__s.refuse")) & ~foreign)
    # the end model reads sound answers as well as the prompts' lines, whole
    lines = p.select(F.explode(F.split("__in", "\n")).alias("t"), F.lit(None).cast("long").alias("h")).unionByName(sound.select(F.col("__out").alias("t"), F.col("__h").alias("h")))
    sc = cut_lineage(endings.scores(endings.fit(lines, "t", "h")).select(F.col("id").alias("__h"), "log_odds", F.lit(expected).alias("__g")))
    limit = endings.thresholds(sound.select("__h").join(sc.hint("merge"), "__h"), "__g").first()  # one group
    out = step.join(sc.select("__h", "log_odds").hint("merge"), "__h", "left")
    defect = (
        F.when(F.col("__s.empty"), "empty").when(F.col("__s.copy"), "copies_input").when(F.col("__s.refuse"), "refusal")
        .when(foreign, "other_language").when(F.col("log_odds") > F.lit(float(limit[1]) if limit else 0.0), "truncated")
    )
    lang = F.col("__rl.lang")
    return out.select(F.col("__id").alias(answer_id), F.col("__k").alias(key), defect.alias("defect"), lang.alias("lang"), F.col("__rl.posterior").alias("lang_posterior"), F.col("__rl.margin").alias("lang_margin"), F.col("__pl.lang").alias("prompt_lang"), (lang != F.col("__pl.lang")).alias("lang_differs"), "log_odds")


def _signs(answer: str, inputs: str) -> Column:
    """struct<empty, copy, refuse> of answers beside their inputs."""

    @F.pandas_udf("empty boolean, copy boolean, refuse boolean")
    def run(s: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(is_empty(t), copies(t, i), refuses(t)) for t, i in zip(s, n)], columns=["empty", "copy", "refuse"])

    return run(answer, inputs)
