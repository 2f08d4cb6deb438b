"""Scoring of blocks and perplexity.

A scorer is an object with `score(x, y) -> nll`: two integer arrays (blocks, length) give the
negative log likelihood of every target. Wide logits stay inside it; blocks leave with one sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.checkpoint import Checkpoint, load_checkpoint

IGNORED = -1


class Scorer(Protocol):
    def score(self, x: np.ndarray, y: np.ndarray) -> np.ndarray: ...


class Uniform:
    def __init__(self, vocab_size: int):
        self.vocab_size = vocab_size

    def score(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.full(y.shape, np.log(self.vocab_size))


class Unigram:
    """Add-one estimate over counts by token id, one slot more for tokens never seen."""

    def __init__(self, counts: dict[int, int]):
        self.total = sum(counts.values()) + len(counts) + 1
        self.nll = np.full(max(counts, default=0) + 1, np.log(self.total))
        for token, n in counts.items():
            self.nll[token] = np.log(self.total) - np.log(n + 1)

    def score(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.full(y.shape, np.log(self.total))
        known = (y >= 0) & (y < len(self.nll))
        out[known] = self.nll[y[known]]
        return out


class Logits:
    """A model that maps ids to logits (blocks, length, vocabulary); its width is checked."""

    def __init__(self, model: Callable[[np.ndarray], np.ndarray], vocab_size: int = 50257):
        self.model, self.vocab_size = model, vocab_size

    def score(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.asarray(self.model(x), np.float64)
        if z.shape[-1] != self.vocab_size:
            raise ValueError(f"the model gives {z.shape[-1]} logits, expected {self.vocab_size}")
        top = z.max(-1, keepdims=True)
        whole = np.log(np.exp(z - top).sum(-1)) + top[..., 0]
        return whole - np.take_along_axis(z, np.maximum(y, 0)[..., None], -1)[..., 0]


_LOADED: dict[tuple[str, str], Scorer] = {}


class FromCheckpoint:
    """A scorer built from a checkpoint where it is used.

    Only the place `folder/file` under `root` and the way to `build` a scorer travel to the workers;
    a worker reads the file at its first block and keeps the scorer of the last checkpoint it read.
    """

    def __init__(self, root: str, path: str, build: Callable[[Checkpoint], Scorer]):
        self.root, self.path, self.build = root, path, build

    def score(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = (self.root, self.path)
        if key not in _LOADED:
            made = self.build(load_checkpoint(*key))
            _LOADED.clear()
            _LOADED[key] = made
        return _LOADED[key].score(x, y)


class TiedEmbedding:
    """A model whose one table (vocabulary, width) is embedding and head at once."""

    def __init__(self, table: np.ndarray):
        self.table = table.astype(np.float64)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        return self.table[ids] @ self.table.T


def tied_embedding(saved: Checkpoint) -> Logits:
    """The scorer of a checkpoint that holds the table `tokens` of a `TiedEmbedding`."""
    table = saved.model_state["tokens"]
    return Logits(TiedEmbedding(table), len(table))


_REGISTRY: dict[str, Callable[..., Scorer]] = {"uniform": Uniform, "unigram": Unigram, "checkpoint": FromCheckpoint}


def register_scorer(name: str, make: Callable[..., Scorer]) -> None:
    _REGISTRY[name] = make


def create_scorer(name: str, *args, **kwargs) -> Scorer:
    if name not in _REGISTRY:
        raise ValueError(f"no scorer {name!r} is registered; there are {', '.join(sorted(_REGISTRY))}")
    return _REGISTRY[name](*args, **kwargs)


def score_blocks(blocks: DataFrame, scorer: Scorer, batch: int = 8) -> DataFrame:
    """(block_id, nll, n_targets): summed over a block's targets other than -1. Blocks have one length."""
    shared = blocks.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            nll, n = [], []
            for k in range(0, rows.num_rows, batch):
                part = rows.slice(k, batch)
                x, y = (part.column(c).flatten().to_numpy().reshape(part.num_rows, -1) for c in "xy")
                counted = y != IGNORED
                nll += (shared.value.score(x, y) * counted).sum(1).tolist()
                n += counted.sum(1).tolist()
            yield pa.RecordBatch.from_arrays([rows.column("block_id"), pa.array(nll, pa.float64()), pa.array(n, pa.int64())], ["block_id", "nll", "n_targets"])

    return blocks.select("block_id", "x", "y").mapInArrow(run, "block_id long, nll double, n_targets long")


def perplexity(scored: DataFrame, nll: str = "nll", n: str = "n_targets") -> DataFrame:
    """(total_tokens, avg_loss_nats, perplexity), weighted by tokens; null for no tokens."""
    total = scored.agg(F.sum(nll).alias("s"), F.sum(n).cast("long").alias("total_tokens"))
    mean = F.when(F.col("total_tokens") > 0, F.col("s") / F.col("total_tokens"))
    return total.select("total_tokens", mean.alias("avg_loss_nats"), F.exp(mean).alias("perplexity"))


def softmax_nll(logits: Column, target: Column) -> Column:
    """Cross-entropy of one small logit array in plain expressions."""
    z = F.transform(logits, lambda v: v.cast("double"))
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.ln(total) + top - F.element_at(z, target.cast("int") + 1)
