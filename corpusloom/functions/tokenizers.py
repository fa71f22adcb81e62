"""Subword tokens of a given sentencepiece model; models are read by path and never trained here."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=2)
def _model(path: str):
    """One for each worker process and file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Subwords:
    """Texts, tokens and ids of a model. A list of tokens takes the place of the model's ids; what it lacks is its <unk>."""

    def __init__(self, path: str, tokens: Sequence[str] | None = None, unknown: str = "<unk>"):
        self.path, self.listed = path, None if tokens is None else list(tokens)
        self.at = None if tokens is None else {t: i for i, t in enumerate(tokens)}
        self.unknown = None if tokens is None else self.at[unknown]

    def __len__(self) -> int:
        return len(self.listed) if self.listed is not None else _model(self.path).get_piece_size()

    def tokens(self, text: Column) -> Column:
        path = self.path
        return F.pandas_udf(lambda s: pd.Series([_model(path).encode(t or "", out_type=str) for t in s]), "array<string>")(text)

    def ids(self, text: Column) -> Column:
        path, at, unknown = self.path, self.at, self.unknown
        if at is None:
            return F.pandas_udf(lambda s: pd.Series([_model(path).encode(t or "") for t in s]), "array<long>")(text)
        return F.pandas_udf(lambda s: pd.Series([[at.get(p, unknown) for p in _model(path).encode(t or "", out_type=str)] for t in s]), "array<long>")(text)

    def text(self, ids: Column) -> Column:
        path, listed = self.path, self.listed
        if listed is None:
            return F.pandas_udf(lambda s: pd.Series([_model(path).decode([int(i) for i in x]) for x in s]), "string")(ids)
        return F.pandas_udf(lambda s: pd.Series([_model(path).decode_pieces([listed[i] for i in x]) for x in s]), "string")(ids)
