"""Token ids by a public vocabulary file, whose path is a parameter."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("PARLANCE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published pre-tokenisation pattern of the byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, object] = {}


def encoder(vocabulary: str):
    """The tokenizer, read once per Python worker."""
    if vocabulary not in _LOADED:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[vocabulary] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[vocabulary]


def end_id(vocabulary: str = VOCABULARY) -> int:
    """The id of the end of a text: the one behind the vocabulary's last."""
    return encoder(vocabulary).max_token_value + 1


def encode(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Ids of a whole text; none for a null or empty one."""

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        enc = encoder(vocabulary)
        return pd.Series([enc.encode_ordinary(t) if t else [] for t in s])

    return ids(text)


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of ids; those beyond the vocabulary (end, padding) are left out; null for a null array."""

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        enc = encoder(vocabulary)
        return pd.Series([None if a is None else enc.decode([int(i) for i in a if 0 <= i <= enc.max_token_value]) for a in s], dtype=object)

    return text(ids)
