"""Per-record text statistics, and which records are not natural prose.

A Gaussian mixture is fitted by expectation-maximization to the standardized statistics of
all records; inspected examples name its components prose, list, table or junk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .spans import Pieces, Texts, bounds, lines, shingles, slices, texts_of, words
from ..session import spread, stage_table
from .repetition import RUN

MIN_CHARS = 40
CLASSES = ("prose", "list", "table", "junk")
#: Most inspected rows that are collected to start the mixture and to name its components.
LABELLED_ROWS = 20_000
#: Words on either side that decide whether a word stands in running prose, and the share of
#: common words among them that running prose has at least.
REACH, DENSITY = 8, 0.2

# fixed values: the published English stop words of the Snowball stemmer, without contractions
COMMON = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing would should could ought "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very"
).split()

STATS = ("n_chars", "n_words", "mean_word_len", "symbol_share", "digit_share", "punct_line_share", "common_share", "nonprose_share")
#: What the mixture sees, in this order.
FEATURES = ("log_words", "mean_word_len", "symbol_share", "digit_share", "punct_line_share", "common_share", "mostly_nonprose")
#: The statistics these are made of.
RAW = ("n_words", *FEATURES[1:-1], "nonprose_share")
#: How steeply `mostly_nonprose` turns from -1 to 1 where half of a text is outside running prose.
STEEP = 3.0

_CLASS = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 white space, 4 other ASCII, 5 beyond ASCII
_CLASS[:128] = 4
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[128:] = 5
_ENDS = np.frombuffer(b".!?;:,\"')", np.uint8)


def _common_hashes() -> np.ndarray:
    return np.sort(words(texts_of(pa.array(COMMON))).hash)


def _is_common(w: Pieces, known: np.ndarray) -> np.ndarray:
    if not len(w.row):
        return np.zeros(0, bool)
    return known[np.minimum(np.searchsorted(known, w.hash), len(known) - 1)] == w.hash


def _is_running(t: Texts, w: Pieces, common: np.ndarray) -> np.ndarray:
    """Words that speak for running prose: common ones, but a lone letter only between spaces, and none
    that a full stop and a number follow ("No. 7"); and a word of three letters or more that repeats
    one of the three before it, so that prose that stammers stays prose."""
    running = common.copy()
    if not len(w.row):
        return running
    size = w.end - w.start
    lone = np.flatnonzero(common & (size == 1))
    last = len(t.buf) - 1
    free = ((w.start[lone] == t.offs[w.row[lone]]) | (_CLASS[t.buf[np.maximum(w.start[lone] - 1, 0)]] == 3)) & (
        (w.end[lone] == t.offs[w.row[lone] + 1]) | (_CLASS[t.buf[np.minimum(w.end[lone], last)]] == 3)
    )
    running[lone[~free]] = False
    numbered = (w.row[1:] == w.row[:-1]) & (t.buf[w.end[:-1]] == 46) & (_CLASS[t.buf[w.start[1:]]] == 2)
    running[:-1][numbered] = False
    lettered = (size >= 3) & (_CLASS[t.buf[w.start]] == 1)
    for back in (1, 2, 3):
        running[back:] |= (w.hash[back:] == w.hash[:-back]) & (w.row[back:] == w.row[:-back]) & lettered[back:]
    return running


def _first_places(w: Pieces) -> np.ndarray:
    """For each word its place where the run of `RUN` words that repeats there stood first; a word
    in no such run is in its first place."""
    at, h = shingles(w, RUN)
    order = np.lexsort((at, h, w.row[at]))
    row, h = w.row[at[order]], h[order]
    head = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])) if len(at) else np.zeros(0, bool)
    origin = at[order][np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
    run, origin = at[order][~head], origin[~head]
    place = np.arange(len(w.row))
    for k in range(RUN):
        np.minimum.at(place, run + k, origin + k)
    while True:  # a first occurrence may hold words of a run that stood earlier still
        further = place[place]
        if (further == place).all():
            return place
        place = further


def text_statistics(t: Texts, known: np.ndarray) -> dict[str, np.ndarray]:
    n = len(t.valid)
    size = np.diff(t.offs)
    row = np.repeat(np.arange(n), size)
    kind = _CLASS[t.buf]
    first = (t.buf & 0xC0) != 0x80  # a code point begins here
    points = np.bincount(row, first, n)
    of = lambda mask: np.bincount(row, mask, n) / np.maximum(points, 1)
    w = words(t)
    count = w.counts(n)
    width = w.end - w.start
    common = _is_common(w, known)

    # running prose: enough common words within reach, in the same text
    upto = np.concatenate([[0], np.cumsum(_is_running(t, w, common))])
    begin = bounds(w.row, n)
    at = np.arange(len(w.row))
    lo, hi = np.maximum(at - REACH, begin[w.row]), np.minimum(at + REACH + 1, begin[w.row + 1])
    running = upto[hi] - upto[lo] >= DENSITY * (hi - lo)
    # each word owns the bytes up to the next word, a text's first word those before it as well
    own = np.append(w.start[1:], 0)
    tail = np.append(w.row[1:] != w.row[:-1], True) if len(at) else np.zeros(0, bool)
    own = np.where(tail, t.offs[w.row + 1], own[: len(at)])
    start = np.where(np.append(True, tail[:-1]) if len(at) else tail, t.offs[w.row], w.start)
    owned = own - start
    # repeated prose is prose, a repeated table is a table, also where it first stands beside prose:
    # what repeats takes the verdict of its first place unless no common word is within reach here
    first_at = _first_places(w)
    running = np.where((first_at == at) | (upto[hi] > upto[lo]), running[first_at], False)
    foreign = np.where(running, np.maximum(owned - width - 6, 0), owned)
    nonprose = np.where(count > 0, np.bincount(w.row, foreign, n) / np.maximum(size, 1), np.where(size > 0, 1.0, 0.0))

    ln = lines(t)
    ended = np.isin(t.buf[ln.end - 1], _ENDS) if len(ln.row) else np.zeros(0, bool)
    return {
        "n_chars": points.astype(np.int64),
        "n_words": count,
        "mean_word_len": np.bincount(w.row, width, n) / np.maximum(count, 1),
        "symbol_share": of((kind == 4) | ((kind == 5) & first)),
        "digit_share": of(kind == 2),
        "punct_line_share": np.bincount(ln.row, ended, n) / np.maximum(ln.counts(n), 1),
        "common_share": np.bincount(w.row, common, n) / np.maximum(count, 1),
        "nonprose_share": nonprose,
    }


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _common_hashes()
    for batch in batches:
        for i, j, part in slices(texts_of(batch.column("text"))):
            s = text_statistics(part, known)
            null = ~part.valid
            cols = [pa.array(s[k].astype(np.int32) if k.startswith("n_") else s[k], mask=null) for k in STATS]
            yield pa.RecordBatch.from_arrays([batch.column("rec_id").slice(i, j - i), *cols], ["rec_id", *STATS])


def quality_stats(records: DataFrame) -> DataFrame:
    """(rec_id, n_chars, n_words, mean_word_len, symbol_share, digit_share, punct_line_share,
    common_share, nonprose_share) of `records` (rec_id, text).

    Shares are of code points, lines that are not blank or words; symbols are what is no ASCII letter, digit or
    white space; `nonprose_share` is of bytes; runs of words that
    repeat earlier ones count as what they were there, if common words are near. A null text gives nulls, an empty one zeros. One
    row per rec_id; rows of a null rec_id are left out; other columns are ignored.
    """
    rows = records.select(F.col("rec_id").cast("long").alias("rec_id"), "text").where("rec_id is not null")
    schema = "rec_id long, " + ", ".join(f"{k} {'int' if k.startswith('n_') else 'double'}" for k in STATS)
    return spread(rows).mapInArrow(_stats, schema).dropDuplicates(["rec_id"])


# ---------------------------------------------------------------- the mixture


class Mixture:
    """Weights, means and full covariances of Gaussian components over standardized features."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, cov: np.ndarray, floor: float = 0.02):
        self.weight, self.mean, self.cov, self.floor = weight, mean, cov, floor

    def prepared(self) -> list[tuple[float, np.ndarray, np.ndarray]]:
        out = []
        for p, m, c in zip(self.weight, self.mean, self.cov):
            low = np.linalg.cholesky(c + self.floor * np.eye(len(m)))
            out.append((float(np.log(max(p, 1e-12)) - np.log(np.diag(low)).sum()), m, np.linalg.inv(low)))
        return out

    @staticmethod
    def posterior(x: np.ndarray, prepared: list) -> tuple[np.ndarray, np.ndarray]:
        """Responsibilities and log likelihood (up to a constant) of each row."""
        log = np.stack([a - 0.5 * (((x - m) @ inv.T) ** 2).sum(1) for a, m, inv in prepared], 1)
        top = log.max(1, keepdims=True)
        e = np.exp(log - top)
        total = e.sum(1, keepdims=True)
        return e / total, (top + np.log(total))[:, 0]


def _features(batch: pa.RecordBatch, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    column = lambda c: np.asarray(batch.column(c), float)
    cols = [np.log1p(column("n_words")) if f == "log_words" else np.tanh(STEEP * (column("nonprose_share") - 0.5)) if f == "mostly_nonprose" else column(f) for f in FEATURES]
    return np.clip((np.stack(cols, 1) - centre) / scale, -6, 6)


def standardization(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature over all records that have a text."""
    made = {"log_words": F.log1p("n_words"), "mostly_nonprose": F.tanh(STEEP * (F.col("nonprose_share") - 0.5))}
    col = {f: made.get(f, F.col(f)) for f in FEATURES}
    row = stats.where("n_words is not null").agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(col.values())], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(col.values())]).first()
    k = len(FEATURES)
    centre = np.array([row[i] or 0.0 for i in range(k)])
    scale = np.array([row[k + i] or 0.0 for i in range(k)])
    return centre, np.where(scale > 1e-9, scale, 1.0)


def _spread_out(x: np.ndarray, k: int) -> np.ndarray:
    """Up to `k` rows far from one another, the first nearest the mean; then Lloyd steps."""
    picked = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    near = ((x - x[picked[0]]) ** 2).sum(1)
    while len(picked) < k and near.max() > 1e-6:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
    means = x[picked]
    for _ in range(8):
        own = ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.stack([x[own == i].mean(0) if (own == i).any() else means[i] for i in range(len(means))])
    return means


def start_mixture(x: np.ndarray, label: np.ndarray, per_class: int = 4) -> Mixture:
    """Components that begin at the inspected examples, `per_class` for each class that has any."""
    means = [_spread_out(x[label == c], per_class) for c in CLASSES if (label == c).any()]
    mean = np.concatenate(means) if means else np.zeros((1, len(FEATURES)))
    k, d = mean.shape
    return Mixture(np.full(k, 1 / k), mean, np.stack([np.eye(d) * 0.3] * k))


def fit_mixture(stats: DataFrame, mixture: Mixture, centre: np.ndarray, scale: np.ndarray, steps: int = 100, tol: float = 1e-3) -> Mixture:
    """Expectation-maximization over all records of `stats` that have a text, until a step raises the
    mean log likelihood by less than `tol`, or for `steps`.

    Each step is one pass: tasks reduce their rows to the components' sums, which are added up
    entry by entry, as decimals and so in any order alike; one row for each entry reaches the driver.
    """
    k, d = mixture.mean.shape
    rows = stats.where("n_words is not null").select(*RAW)
    before = -np.inf
    for _ in range(steps):
        prepared = mixture.prepared()

        def sums(batches: Iterator[pa.RecordBatch], prepared=prepared) -> Iterator[pa.RecordBatch]:
            total, second, like = np.zeros((k, 1 + d)), np.zeros((k, d, d)), 0.0
            n = 0
            for batch in batches:
                x = _features(batch, centre, scale)
                r, ll = Mixture.posterior(x, prepared)
                total[:, 0] += r.sum(0)
                total[:, 1:] += r.T @ x
                for i in range(k):
                    second[i] += (x * r[:, i : i + 1]).T @ x
                like += float(ll.sum())
                n += len(x)
            if n:
                flat = np.concatenate([total.ravel(), second.ravel(), [like, n]])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["entry", "s"])

        parts = rows.mapInArrow(sums, "entry int, s double").groupBy("entry").agg(F.sum(F.col("s").cast("decimal(38,9)")).cast("double").alias("s")).collect()
        if not parts:
            return mixture
        flat = np.array([r["s"] for r in sorted(parts)])
        total, second = flat[: k * (1 + d)].reshape(k, 1 + d), flat[k * (1 + d) : -2].reshape(k, d, d)
        like, n = flat[-2], flat[-1]
        held = np.maximum(total[:, 0], 1e-9)
        mean = total[:, 1:] / held[:, None]
        cov = second / held[:, None, None] - mean[:, :, None] * mean[:, None, :]
        alive = total[:, 0] > d  # a component that lost its records keeps its place
        mixture = Mixture(np.maximum(total[:, 0], 0.5) / n, np.where(alive[:, None], mean, mixture.mean), np.where(alive[:, None, None], cov, mixture.cov))
        if like / n - before < tol:
            break
        before = like / n
    return mixture


def name_components(mixture: Mixture, x: np.ndarray, label: np.ndarray) -> list[str]:
    """The class whose inspected examples a component holds most of, each class weighing by the square
    root of its examples, so that neither many examples of prose nor a few wrong labels name a
    component; the class of the example nearest to its mean where it holds none."""
    r, _ = Mixture.posterior(x, mixture.prepared())
    votes = np.stack([r[label == c].sum(0) / np.sqrt(max((label == c).sum(), 1)) for c in CLASSES])
    nearest = np.array([CLASSES.index(label[int(((x - m) ** 2).sum(1).argmin())]) for m in mixture.mean])
    return [CLASSES[int(v.argmax())] if v.sum() > 0.02 else CLASSES[int(near)] for v, near in zip(votes.T, nearest)]


def classify(records: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS) -> DataFrame:
    """The statistics of `quality_stats` with `kind` and `nonprose_odds`, the posterior mass of
    components not named prose.

    `labels` has rec_id and label; null and unknown labels are ignored, and of more than `bound`
    those with the smallest hashes of their ids are taken. Without any label, or for a null
    text, `kind` and `nonprose_odds` are null.
    """
    stats = stage_table(quality_stats(records), "quality")
    centre, scale = standardization(stats)
    chosen = labels.where(F.col("label").isin(*CLASSES)).groupBy("rec_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("rec_id"), "rec_id").limit(bound)
    seen = stats.where("n_words is not null").join(F.broadcast(chosen), "rec_id").orderBy("rec_id").toPandas()
    out = "rec_id long, " + ", ".join(f"{c} {t}" for c, t in stats.dtypes if c != "rec_id") + ", kind string, nonprose_odds double"
    if not len(seen):
        return stats.selectExpr("*", "cast(null as string) kind", "cast(null as double) nonprose_odds")
    x = _features(pa.RecordBatch.from_pandas(pd.DataFrame(seen[list(RAW)])), centre, scale)
    label = seen["label"].to_numpy()
    mixture = fit_mixture(stats, start_mixture(x, label), centre, scale)
    names = name_components(mixture, x, label)
    prepared = mixture.prepared()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null = np.asarray(batch.column("n_words").is_null())
            f = np.nan_to_num(_features(batch, centre, scale))
            r, _ = Mixture.posterior(f, prepared)
            odds = r[:, [i for i, c in enumerate(names) if c != "prose"]].sum(1)
            mass = np.stack([r[:, [i for i, c in enumerate(names) if c == k]].sum(1) for k in CLASSES], 1)
            kind = np.array(CLASSES, object)[mass.argmax(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind, pa.string(), mask=null), pa.array(odds, mask=null)], [*batch.schema.names, "kind", "nonprose_odds"])

    return stats.mapInArrow(assign, out)
