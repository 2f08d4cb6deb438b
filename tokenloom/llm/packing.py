"""Filling containers of fixed capacity with texts of varying length.

Only the histogram of lengths, which has at most one entry per length up to the capacity,
reaches the driver. Combinations of at most `DEPTH` lengths that fill a container, or all of it but
a window, are the columns of a non-negative least squares problem against the histogram. They
are enumerated where the problem asks for them: of each depth and for each length the filling
whose lengths have most left to explain, round by round, until the solution explains the
histogram. A share of the solution is rounded to repeat counts that the histogram can pay for, and
what is left is packed greedily, longest first, again on counts. The plan, a list of patterns
with repeat counts, then tells from a piece's length and its rank among pieces of that length
which container it is in.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .spans import U64, mix64
from ..session import stage_table

CAPACITY = 1024
#: Most lengths of one filling.
DEPTH = 8
#: Fillings taken up in a round, the most promising ones.
ROUND = 40
#: Shares of the solution that are tried; the one that needs fewest containers is kept, of equals the largest.
SHARES = (0.9, 0.75, 0.6)
#: Pieces of one bucket that are ranked together.
BUCKET = 1_000_000


class Pattern(NamedTuple):
    sizes: tuple[int, ...]  # ascending
    times: int


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Indices of the first of equal rows, by a hash of each; in order."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(rows), U64)
        for k in range(rows.shape[1]):
            h = mix64(h + rows[:, k].astype(U64))
    return np.sort(np.unique(h, return_index=True)[1])


def fillings(value: np.ndarray, lengths: np.ndarray, capacity: int, depth: int = DEPTH) -> np.ndarray:
    """Rows of up to `depth` of `lengths`, ascending and padded with 0 in front: for each length and
    each number of lengths, the rest of the filling that is worth most by `value`. Of the window, a
    64th of the capacity, as little is left empty as the length allows."""
    window = capacity // 64
    lengths = np.unique(lengths)
    worth = value[lengths].astype(np.float32)
    never = np.full(capacity + 1, -1e18, np.float32)
    before = np.arange(capacity + 1)[:, None] - lengths + capacity + 1
    best, pick = [np.append(np.float32(0), never[1:])], [np.zeros(capacity + 1, np.int64)]
    every = np.arange(capacity + 1)
    for _ in range(depth - 1):  # most worth of so many lengths that sum to each total, and the last of them
        gain = np.take(np.concatenate([never, best[-1]]), before)
        gain += worth
        top = gain.argmax(1)
        best.append(gain[every, top])
        pick.append(lengths[top])
    out = []
    done = np.zeros(len(lengths), bool)
    for waste in range(window + 1):
        rest = capacity - waste - lengths
        there = np.stack([~done & (rest >= 0) & (b[np.maximum(rest, 0)] > -1e17) for b in best])
        for d, fits in enumerate(there):
            total = rest[fits]
            rows = np.zeros((len(total), depth), np.int64)
            rows[:, 0] = lengths[fits]
            for e in range(d, 0, -1):
                rows[:, e] = pick[e][total]
                total = total - rows[:, e]
            out.append(np.sort(rows, 1))
        done |= there.any(0)
    rows = np.concatenate(out)
    return rows[_distinct(rows)]


def non_negative_least_squares(columns: np.ndarray, target: np.ndarray, start: np.ndarray | None = None, steps: int = 2000, tol: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(x, target - A x) for x >= 0 that minimises the remainder, by accelerated projected gradients.

    Column j of A counts the lengths in row j of `columns`; A is never built. Momentum starts anew
    where it points uphill. Ends once the remainder is below `tol` of the target, or falls by less
    than `tol` of itself in 50 steps, or after `steps`.
    """
    n, size = len(columns), len(target)
    x = np.zeros(n) if start is None else start
    if not n:
        return x, target.astype(float)
    used = (columns > 0).astype(float)
    norm = np.sqrt(used.sum(1))
    flat = columns.ravel()
    product = lambda z: np.bincount(flat, (used * (z / norm)[:, None]).ravel(), size)
    back = lambda r: (r[columns] * used).sum(1) / norm
    v = np.ones(n)
    for _ in range(25):
        v = back(product(v))
        bound = float(np.linalg.norm(v))
        v /= bound
    whole = max(float(np.linalg.norm(target)), 1e-12)
    z = y = x * norm
    t, before = 1.0, np.inf
    for step in range(1, steps + 1):
        new = np.maximum(y - back(product(y) - target) / (bound * 1.02), 0)
        if ((y - new) * (new - z)).sum() > 0:
            t = 1.0
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - z)
        z, t = new, s
        if step % 50 == 0:
            left = float(np.linalg.norm(target - product(z)))
            if left < tol * whole or before - left < tol * left:
                break
            before = left
    return z / norm, target - product(z)


def solve_fillings(count: np.ndarray, capacity: int, rounds: int = 400, tol: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(columns, x): fillings and how often each is wanted, so that they explain `count` but for a
    share of `tol`, or as far as fillings that help are found."""
    target = count.astype(float)
    columns, x, left = np.zeros((0, DEPTH), np.int64), np.zeros(0), target
    lengths = np.flatnonzero(count)
    before = np.inf
    for turn in range(rounds):
        rest = float(np.abs(left).sum())
        if rest <= tol * target.sum() or turn % 20 == 19 and rest > 0.98 * before:
            break
        before = rest if turn % 20 == 19 else before
        new = fillings(left, lengths, capacity)
        worth = left[new].sum(1, where=new > 0)
        new, worth = new[worth > 1e-9], worth[worth > 1e-9]
        new = new[np.argsort(-worth / np.sqrt((new > 0).sum(1)), kind="stable")]
        # different ones: one for each longest length and number of lengths
        new = new[np.sort(np.unique(new[:, -1] * (DEPTH + 1) + (new > 0).sum(1), return_index=True)[1])][:ROUND]
        both = np.concatenate([columns, new])
        keep = _distinct(both)
        if len(keep) == len(columns):
            break
        x = np.append(x, np.zeros(len(both) - len(x)))[keep]
        columns = both[keep]
        x, left = non_negative_least_squares(columns, target, x, steps=10)
    return columns, non_negative_least_squares(columns, target, x)[0]


def _rounded(columns: np.ndarray, x: np.ndarray, left: np.ndarray, share: float) -> list[Pattern]:
    """Whole repeat counts of a share of the solution, as far as `left` pays for them; it is reduced.
    What a filling lacks to a whole number is carried to the next, which is alike in its longest lengths."""
    spare = left - np.ceil(left * share).astype(np.int64)  # of each length so many are left to the greedy part
    left -= spare
    out, carried = [], 0.0
    for j in np.lexsort(columns.T).tolist():
        if x[j] <= 1e-9:
            continue
        carried += x[j] * share
        if carried < 1:
            continue
        own, count = np.unique(columns[j][columns[j] > 0], return_counts=True)
        n = min(int(carried), int((left[own] // count).min()))
        if n > 0:
            left[own] -= count * n
            carried -= n
            out.append(Pattern(tuple(columns[j][columns[j] > 0].tolist()), n))
        carried = min(carried, 3.0)
    left += spare
    return out


def _greedy(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Packs counts `left`: the longest piece first, then an exact rest if one or two pieces
    give it, else the longest that fits. A pattern repeats as often as its lengths last."""
    out = []
    while left.any():
        sizes = [int(np.flatnonzero(left)[-1])]
        room = capacity - sizes[0]
        spare = left.copy()
        spare[sizes[0]] -= 1
        while room:
            fits = np.flatnonzero(spare[: room + 1])
            if not len(fits):
                break
            if fits[-1] == room:
                pick = [room]
            else:
                rest = room - fits
                two = fits[(rest >= fits) & (spare[rest] > (rest == fits))]
                pick = [int(two[0]), room - int(two[0])] if len(two) else [int(fits[-1])]
            for p in pick:
                spare[p] -= 1
                room -= p
                sizes.append(p)
        own, count = np.unique(sizes, return_counts=True)
        times = int((left[own] // count).min())
        left[own] -= count * times
        out.append(Pattern(tuple(sorted(sizes)), times))
    return out


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up `histogram` (pieces by length, 1 to `capacity`) exactly."""
    count = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        if not 1 <= size <= capacity:
            raise ValueError(f"a piece of {size} does not fit a container of {capacity}")
        count[size] = n
    columns, x = solve_fillings(count, capacity)
    plan: list[Pattern] | None = None
    for share in SHARES:
        left = count.copy()
        new = _rounded(columns, x, left, share)
        new += _greedy(left, capacity)
        if plan is None or sum(p.times for p in new) < sum(p.times for p in plan):
            plan = new
    return plan or []


def _lookup(plan: list[Pattern]) -> tuple[np.ndarray, ...]:
    """Rank ranges by length: key (length << 44 | first rank), first container, pieces a container."""
    given: dict[int, int] = {}
    rows = []
    container = 0
    for pattern in plan:
        own, count = np.unique(pattern.sizes, return_counts=True)
        for size, c in zip(own.tolist(), count.tolist()):
            first = given.get(size, 0)
            rows.append((size << 44 | first, first, container, c))
            given[size] = first + c * pattern.times
        container += pattern.times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 4


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, n_tokens, container) for rows (doc_id, n_tokens).

    A document longer than `capacity` is cut into pieces of `capacity` and a rest, numbered from
    0; any other is one piece and never split. Container numbers are consecutive from 0. A
    document without tokens (empty, blank to nothing, or null text) takes no room: one row with
    n_tokens 0 and a null container. Repeated rows are packed each.
    """
    rows = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"))
    full = F.floor(F.col("n") / capacity).cast("int")
    rest = F.when(F.col("n") % capacity > 0, 1).otherwise(0)
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(full + rest, F.lit(1)) - 1)))
    size = F.least(F.col("n") - F.col("piece").cast("long") * capacity, F.lit(capacity)).cast("int")
    pieces = pieces.select("doc_id", "piece", size.alias("n_tokens"))
    pieces = stage_table(pieces, "pieces")
    some = pieces.where("n_tokens > 0")
    counted = dict(map(tuple, some.groupBy("n_tokens").count().collect()))  # at most one row per length
    key, first, base, per = _lookup(plan_packing(counted, capacity))

    # ranks within a length: pieces are spread over buckets, so that no length is one task's work
    buckets = max(1, -(-sum(counted.values()) // BUCKET))
    some = some.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = some.groupBy("n_tokens", "bucket").count()
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("n_tokens", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")
    ranked = some.withColumn("place", F.row_number().over(order)).join(counts, ["n_tokens", "bucket"])
    ranked = ranked.select("doc_id", "piece", "n_tokens", (F.col("place") - 1 + F.col("base")).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("n_tokens").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            at = np.searchsorted(key, size << 44 | rank, "right") - 1
            container = base[at] + (rank - first[at]) // per[at]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("piece"), batch.column("n_tokens"), pa.array(container)], ["doc_id", "piece", "n_tokens", "container"])

    placed = ranked.mapInArrow(assign, "doc_id long, piece int, n_tokens int, container long")
    return placed.unionByName(pieces.where("n_tokens <= 0").withColumn("container", F.lit(None).cast("long")))


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(pieces, containers, tokens, fewest_containers, fill_share) of a result of `pack`."""
    used = packed.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"), F.max("n_tokens").alias("m"))
    total = used.agg(F.sum("pieces").alias("pieces"), F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    fewest = F.ceil(F.col("tokens") / capacity)
    return total.select("pieces", "containers", "tokens", "fullest", fewest.alias("fewest_containers"), (F.col("tokens") / (F.col("containers") * capacity)).alias("fill_share"))
