"""Repetition inside a record, and cutoffs for it whose false rejections are bounded.

The share of repeated words and the shares of repeated sentences and lines are computed for
every record. A case is what the definition says (`is_case`), whatever the labels. Which share
is flagged as too large is decided per stratum by risk control: on all labelled records, counted where
they lie, cutoffs are tried from the largest to smaller ones as long as the exact binomial
test rejects "more than `ALPHA` of the records labelled acceptable are turned away"; the level is
split over all strata and measures tested (Bonferroni), and the fixed order of the cutoffs needs no
further correction. No cutoff goes below `CASE_SHARE`, from where on repetition counts at all. A
stratum in which labels show that so low a cutoff turns away too many keeps a higher one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .spans import U64, Pieces, lines, mix64, sentences, shingles, slices, texts_of, words
from ..session import spread

RUN = 5
MIN_WORDS = 20
CASE_SHARE = 0.30
MEASURES = ("rep_share", "dup_sentence_share", "dup_line_share")
#: Cutoffs in the order they are tried, down to the share from where on repetition counts.
GRID = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, CASE_SHARE)
#: Labels of records that should not be turned away.
GOOD = ("prose",)
#: Largest share of good records that may be turned away, and the risk that more are.
ALPHA, DELTA = 0.10, 0.05
#: Fewest good records of a stratum. With so many a cutoff that turns away 4 percent of them is
#: certified with probability 0.99; smaller strata are pooled.
MIN_GOOD = 400
POOLED = "(pooled)"
#: Stratum of records without one.
NONE = "(none)"


def _again(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where the same value stands earlier in the same row."""
    with np.errstate(over="ignore"):
        key = mix64(value + row.astype(U64) * U64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def repeated_words(w: Pieces, run: int = RUN) -> np.ndarray:
    """True for each word that lies in a run of `run` words that began earlier in its row too."""
    at, h = shingles(w, run)
    at = at[_again(w.row[at], h)]
    edge = np.zeros(len(w.row) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + run, -1)
    return np.cumsum(edge[:-1]) > 0


def _dup_share(p: Pieces, rows: int) -> np.ndarray:
    size = (p.end - p.start).astype(float)
    total = np.bincount(p.row, size, rows)
    return np.bincount(p.row, size * _again(p.row, p.hash), rows) / np.maximum(total, 1)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, part in slices(texts_of(batch.column("text"))):
            n = j - i
            w = words(part)
            count = w.counts(n)
            rep = np.bincount(w.row, repeated_words(w), n).astype(np.int64)
            null = ~part.valid
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("rec_id").slice(i, n),
                    batch.column("source").slice(i, n),
                    pa.array(count.astype(np.int32), mask=null),
                    pa.array(rep.astype(np.int32), mask=null),
                    pa.array(rep / np.maximum(count, 1), mask=null),
                    pa.array(_dup_share(sentences(part), n), mask=null),
                    pa.array(_dup_share(lines(part), n), mask=null),
                ],
                ["rec_id", "source", "n_words", "n_repeated", *MEASURES],
            )


def repetition_stats(records: DataFrame) -> DataFrame:
    """(rec_id, source, n_words, n_repeated, rep_share, dup_sentence_share, dup_line_share).

    `records` has rec_id, source and text. `rep_share` is the share of words in runs of five
    that equal a run beginning earlier; the others are shares of characters in sentences and
    lines that stand earlier already. A null text gives nulls, an empty one zeros. One row per
    rec_id; rows of a null rec_id are left out.
    """
    rows = records.select(F.col("rec_id").cast("long").alias("rec_id"), F.col("source").cast("string").alias("source"), "text").where("rec_id is not null")
    schema = "rec_id long, source string, n_words int, n_repeated int, " + ", ".join(f"{m} double" for m in MEASURES)
    return spread(rows).mapInArrow(_stats, schema).dropDuplicates(["rec_id"])


def is_case() -> Column:
    """The definition of too much repetition: at least 20 words, 30 percent of them repeated."""
    return (F.col("n_words") >= MIN_WORDS) & (F.col("n_repeated") * 10 >= F.col("n_words") * 3)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed in logs.

    Logs of terms fall by at least 2 d^2 / n at a distance d from the largest; beyond 6 sqrt(n) all
    terms together are less than a double resolves.
    """
    if n == 0:
        return 1.0
    mode, reach = min(k, int((n + 1) * p)), 6 * math.isqrt(n) + 6
    first, last = max(mode - reach, 0), min(mode + reach, k)
    i = np.arange(first, last)
    start = math.lgamma(n + 1) - math.lgamma(first + 1) - math.lgamma(n - first + 1) + first * math.log(p) + (n - first) * math.log1p(-p)
    logs = start + np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + math.log(p) - math.log1p(-p))])
    top = float(logs.max())
    return min(1.0, math.exp(top) * math.fsum(np.exp(logs - top)))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a rate seen `k` times in `n`."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if binomial_tail(k, n, mid) > delta:
            lo = mid
        else:
            hi = mid
    return hi


class Cutoff(NamedTuple):
    stratum: str
    measure: str
    cutoff: float
    n_good: int
    n_rejected: int
    upper: float
    certified: bool


def risk_controlled_cutoffs(
    holdout: pd.DataFrame,
    measures: Sequence[str] = MEASURES,
    grid: Sequence[float] = GRID,
    alpha: float = ALPHA,
    delta: float = DELTA,
    least: int = MIN_GOOD,
) -> list[Cutoff]:
    """Cutoffs per stratum and measure from rows (stratum, good, measures...).

    With confidence 1 - `delta` over all of them, at most `alpha` of the good records of a
    stratum reach its cutoff. Strata of fewer than `least` good rows are pooled. Where not even the
    first cutoff can be certified it is returned with `certified` false; a pool of fewer than `least`
    rows says nothing, and its cutoff is the last of the grid, not certified. Null strata count as
    "(none)"; null measures never reach a cutoff.
    """
    good = holdout[holdout["good"].astype(bool)]
    names = good["stratum"].fillna(NONE).astype(str)
    names = names.where(names.map(names.value_counts()) >= least, POOLED)
    counts = {}
    for stratum, rows in good.groupby(names):
        counts[stratum] = len(rows), [[int((rows[m].to_numpy(float) >= cutoff).sum()) for cutoff in grid] for m in measures]
    return _cutoffs_of_counts(counts, measures, grid, alpha, delta, least)


def _cutoffs_of_counts(counts: Mapping[str, tuple[int, Sequence[Sequence[int]]]], measures: Sequence[str], grid: Sequence[float], alpha: float, delta: float, least: int) -> list[Cutoff]:
    """Cutoffs from each stratum's good rows and how many of them reach each cutoff, by measure."""
    counts = {POOLED: (0, [[0] * len(grid)] * len(measures)), **counts}
    level = delta / (len(counts) * len(measures))
    out = []
    for stratum in sorted(counts):
        n, reached = counts[stratum]
        for measure, reach in zip(measures, reached):
            best, certified = 0 if n >= least else len(grid) - 1, False
            for i, k in enumerate(reach if n >= least else ()):
                if binomial_tail(k, n, alpha) > level:
                    break
                best, certified = i, True
            k = reach[best]
            out.append(Cutoff(stratum, measure, grid[best], n, k, upper_bound(k, n, level), certified))
    return out


def choose_cutoffs(
    stats: DataFrame,
    labels: DataFrame,
    good: Sequence[str] = GOOD,
    measures: Sequence[str] = MEASURES,
    grid: Sequence[float] = GRID,
    alpha: float = ALPHA,
    delta: float = DELTA,
    least: int = MIN_GOOD,
) -> list[Cutoff]:
    """`risk_controlled_cutoffs` from all inspected records of `labels` (rec_id, label).

    A record is good if all its labels are among `good`; null labels say nothing. Good records are
    counted by stratum and cutoff where they lie; one row for each stratum of at least `least` of them
    and one for the pool reach the driver.
    """
    chosen = labels.where("label is not null and rec_id is not null").groupBy("rec_id").agg(F.every(F.col("label").isin(*good)).alias("good")).where("good")
    rows = stats.where("n_words is not null").join(chosen, "rec_id", "left_semi").withColumn("stratum", F.coalesce("source", F.lit(NONE)))
    names = [[f"{m}_{i}" for i in range(len(grid))] for m in measures]
    each = rows.groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col(m) >= cutoff).alias(k) for m, ks in zip(measures, names) for cutoff, k in zip(grid, ks)])
    pooled = F.when(F.col("n") >= least, F.col("stratum")).otherwise(POOLED).alias("stratum")
    summed = each.groupBy(pooled).agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for ks in names for k in ks])
    counts = {r["stratum"]: (r["n"], [[r[k] for k in ks] for ks in names]) for r in summed.collect()}
    return _cutoffs_of_counts(counts, measures, grid, alpha, delta, least)


def flag_repetition(stats: DataFrame, cutoffs: Sequence[Cutoff]) -> DataFrame:
    """`stats` with `flag_` and the measure's name, true where the measure reaches its stratum's
    cutoff in a record of at least 20 words, and `flagged`, true where any does; null for null texts."""
    spark = stats.sparkSession
    by: dict[str, dict[str, float]] = {}
    for c in cutoffs:
        by.setdefault(c.stratum, {})[c.measure] = c.cutoff
    rest = by[POOLED]
    table = spark.createDataFrame([(s, *(v[m] for m in MEASURES)) for s, v in sorted(by.items())], "stratum string, " + ", ".join(f"cut_{m} double" for m in MEASURES))
    rows = stats.withColumn("stratum", F.coalesce("source", F.lit(NONE))).join(F.broadcast(table), "stratum", "left")
    for m in MEASURES:
        rows = rows.withColumn(f"flag_{m}", (F.col("n_words") >= MIN_WORDS) & (F.col(m) >= F.coalesce(f"cut_{m}", F.lit(rest[m]))))
    flags = [f"flag_{m}" for m in MEASURES]
    return rows.withColumn("flagged", F.col(flags[0]) | F.col(flags[1]) | F.col(flags[2])).select(*stats.columns, *flags, "flagged")
