"""Encoding texts with a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern. The distinct words of a batch that are
not known yet form a trie, walked depth first. Each node, a prefix, keeps one state: the last
token of its encoding. It is the one token ending there that may follow the last token of the
prefix before it, so a prefix common to many words is encoded once, and a word's tokens are
read back from the states on its path.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.bpe import PATTERN, VOCABULARIES
from .spans import slices, texts_of
from ..session import spread

#: Words whose tokens a worker keeps; beyond it starts anew.
CACHE_WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    out = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def _halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token of several bytes the two tokens whose merge makes it."""
    out = {}
    for token, rank in ranks.items():
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: min(ranks.get(parts[i] + parts[i + 1], rank), rank))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        out[rank] = (ranks[parts[0]], ranks[parts[1]])
    return out


class Encoder:
    """Encodes words with merges ranked by token id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.halves = _halves(ranks)
        self.merged = {pair: token for token, pair in self.halves.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        sizes: list[set[int]] = [set() for _ in range(256)]
        for token in ranks:
            sizes[token[-1]].add(len(token))
        self.sizes = [sorted(x, reverse=True) for x in sizes]  # of the tokens that end with each byte
        self.pattern = pattern
        self._ready()

    def _ready(self) -> None:
        self.words = regex.compile(self.pattern).findall
        self.follow: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "follow", "known")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes together are encoded as just these two.

        They are unless some merge across their border comes before the merge that completes
        one of its sides. The sides are undone one merge at a time, the latest first, and the
        pair at the border is looked up after each.
        """
        known = self.follow.get((left, right))
        if known is not None:
            return known
        a, b = left, right
        ceiling = 1 << 62  # merges from here on are undone, so that one across the border must come earlier
        answer = None
        while answer is None:
            across = self.merged.get((a, b))
            if across is not None and across < ceiling:
                answer = False
                break
            # undo the later of the merges that made a and b; at the same rank the left one goes first
            undo_a, undo_b = self.halves.get(a), self.halves.get(b)
            if undo_a is None and undo_b is None:
                answer = True
            elif undo_b is None or undo_a is not None and a > b:
                ceiling, a = a, undo_a[1]
            else:
                # a merge across the border of equal rank stands to the left and would be made first
                ceiling, b = b + 1, undo_b[0]
        if len(self.follow) > 2_000_000:
            self.follow.clear()
        self.follow[left, right] = answer
        return answer

    def learn(self, words: Iterable[str]) -> None:
        """Walk the trie of `words` and keep their tokens."""
        path = b""
        last: list[int] = []  # last token of each prefix of `path`, the longest at the end
        get, size, may = self.ranks.get, self.size, self.may_follow
        for raw, word in sorted((w.encode(), w) for w in words):
            # ordered words visit the trie depth first; what the path shares with the word stays
            depth = len(os.path.commonprefix((path, raw)))
            del last[depth:]
            path = raw
            for end in range(depth + 1, len(raw) + 1):
                for length in self.sizes[raw[end - 1]]:
                    start = end - length
                    if start < 0:
                        continue
                    token = get(raw[start:end])
                    if token is not None and (start == 0 or may(last[start - 1], token)):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token for byte {raw[end - 1]:#x}")
            out, end = [], len(raw)
            while end:
                out.append(last[end - 1])
                end -= size[out[-1]]
            self.known[word] = tuple(reversed(out))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, and where each text's begin (one entry more than texts)."""
        cut = [self.words(t) if t else () for t in texts]
        new = set(chain.from_iterable(cut)) - self.known.keys()
        if new:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
                new = set(chain.from_iterable(cut))
            self.learn(new)
        get = self.known.__getitem__
        ids = [np.fromiter(chain.from_iterable(map(get, words)), np.int32) for words in cut]
        offs = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=offs[1:])
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), offs


def load_encoder(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The encoder of a `.tiktoken` rank file (by default byte_bpe_50k) for the workers.

    The file is read on the driver only; its tables have one entry per token of the vocabulary.
    """
    return spark.sparkContext.broadcast(Encoder(read_ranks(path or os.path.join(VOCABULARIES, "byte_bpe_50k.tiktoken"))))


def _slices(batch: pa.RecordBatch, encoder: Encoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    column = batch.column("text")
    for i, j, part in slices(texts_of(column)):
        ids, offs = encoder.encode_batch(column.slice(i, j - i).to_pylist())
        yield i, j, ids, offs, ~part.valid


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens.

    `docs` has doc_id and text. A null text gives null, an empty one the empty list; marks such
    as an end mark written in a text are ordinary text. Each row gives one row, so repeated rows
    stay repeated; other columns are ignored.
    """
    encoder = load_encoder(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, ids, offs, null in _slices(batch, encoder.value):
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists], ["doc_id", "ids"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each row; null for a null text."""
    encoder = load_encoder(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, offs, null in _slices(batch, encoder.value):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offs), mask=null)], ["doc_id", "n_tokens"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n_tokens long")
