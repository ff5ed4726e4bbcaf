"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.vocabulary import VOCABULARY, encoder


def count_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text as bigint; 0 for a null or empty one. The whole text is read."""

    @F.pandas_udf("bigint")
    def n_tokens(s: pd.Series) -> pd.Series:
        enc = encoder(vocabulary)
        return pd.Series([0 if not t else len(enc.encode_ordinary(t)) for t in s], dtype="int64")

    return n_tokens(text)
