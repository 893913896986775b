"""Sizes in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(folder: str = FOLDER, ranks: str = RANKS):
    """The encoding whose vocabulary and split pattern lie in ``folder``."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers_pattern", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(os.path.join(folder, ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=module.PATTERN, mergeable_ranks=table, special_tokens={})


def token_count(text: Column | str, folder: str = FOLDER, ranks: str = RANKS) -> Column:
    """The number of tokens of a whole text; 0 for null and empty."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(folder, ranks).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def sizes(df: DataFrame, key: str, text: str, *keep: str, folder: str = FOLDER) -> DataFrame:
    """``key``, the kept columns and ``n_tokens``."""
    return df.select(key, *keep, token_count(text, folder).alias("n_tokens"))
