"""Interfaces of models and signal processing, run in Arrow batches; stubs are deterministic."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class TextGenerator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Echo:
    """Answers with the last word of the prompt."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [(p.split() or [""])[-1].strip(".,!?").lower() for p in prompts]


class AudioFeatureExtractor(Protocol):
    def extract(self, content: bytes) -> dict[str, float | None]: ...


class WaveLength:
    """Reads only sizes of RIFF files: seconds and sample rate; no acoustic measure."""

    def extract(self, content: bytes) -> dict[str, float | None]:
        if len(content) < 44 or content[:4] != b"RIFF":
            return {"rate_hz": None, "seconds": None}
        rate, per_s = int.from_bytes(content[24:28], "little"), int.from_bytes(content[28:32], "little")
        return {"rate_hz": float(rate), "seconds": round((len(content) - 44) / per_s, 4) if per_s else None}


def generate(prompt: Column, model: TextGenerator, batch: int = 16) -> Column:
    """Answers of a generator loaded once per worker, ``batch`` prompts at a time; errors become ERROR texts."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list[str] = []
            values = [v if v is not None else "" for v in s]
            for i in range(0, len(values), batch):
                try:
                    out += model.generate(values[i : i + batch])
                except Exception as e:  # noqa: BLE001
                    out += [f"ERROR: {e}"] * len(values[i : i + batch])
            yield pd.Series(out)

    return run(prompt)


def features(files: DataFrame, model: AudioFeatureExtractor) -> DataFrame:
    """(path, rate_hz, seconds) of a binaryFile listing; unreadable files give nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [model.extract(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "rate_hz": [r["rate_hz"] for r in rows], "seconds": [r["seconds"] for r in rows]})

    return files.select("path", "content").mapInPandas(run, "path string, rate_hz double, seconds double")


def token_ids(text: Column, size: int = 50_000) -> Column:
    """White-space tokens as ids by hash: a stand-in for a tokenizer, in SQL."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))


def masked(prompt: Column, full: Column, longest: int) -> Column:
    """struct<input_ids, attention_mask, labels>: the prompt's part of the labels is -100."""
    ids = F.slice(full, 1, longest)
    n = F.least(F.size(prompt), F.lit(longest), F.size(ids))
    labels = F.concat(F.array_repeat(F.lit(-100), n), F.slice(ids, n + 1, F.lit(longest)))
    return F.struct(ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), labels.alias("labels"))


def padded(ids: Column, width: Column, pad: int = 0, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(fill, ids) if left else F.concat(ids, fill)
