"""Byte-pair encoding of a column with a public vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import spread

END_OF_TEXT = 50256
#: Where vocabulary files are looked for unless a path is given.
VOCABULARIES = os.environ.get("TOKENLOOM_VOCABULARIES", "/opt/tokenizers")
# fixed values: the word pattern of the byte-level vocabularies
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encodings by name: rank file and how words are cut. `register_encoding` adds more.
_ENCODINGS: dict[str, tuple[str, str]] = {"byte_bpe_50k": ("byte_bpe_50k.tiktoken", PATTERN)}
_LOADED: dict[str, object] = {}


def register_encoding(name: str, rank_file: str, pattern: str) -> None:
    _ENCODINGS[name] = (rank_file, pattern)


def max_token(name: str) -> int:
    """The largest id of an encoding, its end mark included."""
    return max(max(_ranks(name).values()), END_OF_TEXT)


def _ranks(name: str) -> dict[bytes, int]:
    if name not in _ENCODINGS:
        raise ValueError(f"unknown encoding {name!r}; there are {', '.join(sorted(_ENCODINGS))}")
    rows = (line.split() for line in Path(VOCABULARIES, _ENCODINGS[name][0]).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in rows}


def encode_text(rows: DataFrame, text: str = "text", encoding: str = "byte_bpe_50k", append_eot: bool = False) -> DataFrame:
    """`rows` with `ids` and `len`, in whole Arrow batches; a worker builds the encoder once.

    Marks in a text are ordinary text. Null texts give null ids and len 0, with or without the
    end mark; empty texts give the empty list, or the end mark alone.
    """
    spark: SparkSession = rows.sparkSession
    ranks = spark.sparkContext.broadcast(_ranks(encoding))
    pattern = _ENCODINGS[encoding][1]

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        if encoding not in _LOADED:
            _LOADED[encoding] = tiktoken.Encoding(encoding, pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        tail = [END_OF_TEXT] if append_eot else []
        for texts in batches:
            found = iter(_LOADED[encoding].encode_ordinary_batch([t for t in texts if t is not None], num_threads=1))
            yield pd.Series([None if t is None else next(found) + tail for t in texts], dtype=object)

    out = spread(rows).withColumn("ids", run(F.col(text)))
    return out.withColumn("len", F.coalesce(F.when(F.col("ids").isNotNull(), F.size("ids")), F.lit(0)))


def append_end(ids: str | Column) -> Column:
    return F.array_append(ids, F.lit(END_OF_TEXT))
