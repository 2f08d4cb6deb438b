"""Groups of near-duplicate records, by ball hashing that meets in the middle.

A record's fingerprint is a set: the `SIZE` smallest hashes of its distinct word runs, under
each of `TABLES` hash functions. The distance of two fingerprints is the number of insertions
and deletions between them. A fingerprint emits every variant within half the radius, that is
every subset of `KEEP` elements; two fingerprints within the radius share elements enough to
have a variant in common, the point in the middle between them. Variants are shuffled, records
that collide become candidate pairs, pairs are deduplicated and verified on the whole sets, and
verified links are closed to groups.

Worst are links where one set contains the other: at a similarity of 0.5 each of the smallest 5
of a large set is in the smaller one with probability 0.5, so 4 of 5 are common with probability
0.19, and 54 tables leave 1.4 links in 100,000 unseen; 9 runs in 18 have 4 in common with
probability 0.147, which leaves 19. Simulated, edits on both sides at 0.5 leave 7 in 100 million.

A variant that very many texts share, as those of a boilerplate do, is combined in the tasks that
emit it: its texts are compared with one of them there, and only that one goes to the variant's task.
Texts of such a variant that this leaves in different components are compared in rounds with members of the
largest component as long as that joins them; what is left is found exactly by a prefix filter
on the texts' rarest runs, so all pairs of a large group are never formed.

Links with a set of at most `EXACT` runs are never missed: it and all sets that can be alike to it
emit single runs besides, the first ones in one order of hashes, so many that alike sets must
share one (prefix filter).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .spans import U64, Texts, bounds, distinct_per_row, mix64, shingles, slices, texts_of, words
from .graph import connected_components
from ..session import shuffle_width, spread, stage_table

RUN = 3
MIN_WORDS = 20
SIZE, KEEP, TABLES = 5, 4, 54
#: Links with a set of at most so many runs are found exactly. At 0.5 the other set has at most 16
#: runs, fewer than any text of `MIN_WORDS` that doesn't repeat itself, so common runs stay rare here.
EXACT = 8
#: Up to this many texts of one variant, all their pairs are candidates.
SMALL = 32
#: Rounds that compare the texts of large groups with their largest component go on while each leaves
#: less than this share of those outside.
PROGRESS = 0.5
#: Most record ids that are sent to all tasks, so that texts that are no candidates aren't shuffled.
SENT_IDS = 4_000_000
#: Variants that a task packs before it hands them on.
PACK = 2_000_000
_GOLD = U64(0x9E3779B97F4A7C15)


def _signatures(part: Texts) -> tuple[np.ndarray, np.ndarray, object]:
    """A hash of each row's word sequence, its number of words, and the words."""
    n = len(part.valid)
    w = words(part)
    count = w.counts(n)
    begin = bounds(w.row, n)
    with np.errstate(over="ignore"):
        place = (np.arange(len(w.row)) - begin[w.row]).astype(U64) if len(w.row) else np.zeros(0, U64)
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(w.hash + place * _GOLD), dtype=U64)])
        sig = mix64(sums[begin[1:]] - sums[begin[:-1]] + count.astype(U64))
    return sig, count, w


def _sets(w, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (row, hash) of the rows marked in `keep`."""
    at, h = shingles(w, RUN)
    row = w.row[at]
    some = keep[row]
    return distinct_per_row(row[some], h[some])


def _fingerprints(row: np.ndarray, value: np.ndarray, n: int, table: int) -> np.ndarray:
    """The smallest `SIZE` hashes of each row, ascending; short sets are filled with common values."""
    with np.errstate(over="ignore"):
        key = mix64(value + U64(table + 1) * _GOLD)
    # hashes are uniform: all but the smallest few of a long row need not be sorted
    count = np.bincount(row, minlength=n)
    low = np.where(count > 4 * SIZE, U64(0xFFFFFFFFFFFFFFFF) // np.maximum(count, 1).astype(U64) * U64(4 * SIZE), U64(0xFFFFFFFFFFFFFFFF))
    some = key <= low[row]
    some |= (np.bincount(row[some], minlength=n) < np.minimum(count, SIZE))[row]
    row, key = row[some], key[some]
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    rank = np.arange(len(row)) - bounds(row, n)[row]
    out = np.broadcast_to(mix64(np.arange(SIZE).astype(U64) + U64(1)), (n, SIZE)).copy()
    some = rank < SIZE
    out[row[some], rank[some]] = key[some]
    return out


_SUBSETS = np.array(list(itertools.combinations(range(SIZE), KEEP)))


def _variants(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Every row's variants: subsets of its fingerprints of `KEEP` elements."""
    parts = []
    for table in range(TABLES):
        f = np.sort(_fingerprints(row, value, n, table), 1)
        with np.errstate(over="ignore"):
            h = np.full((n, len(_SUBSETS)), table + 1, U64)
            for j in range(KEEP):
                h = mix64(h * _GOLD + f[:, _SUBSETS[:, j]])
        parts.append(h)
    return np.concatenate(parts, 1)


def _prefixes(row: np.ndarray, value: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, variant): single runs of small sets. Two sets alike by `threshold`, one of them of at
    most `EXACT` runs, have one in common."""
    count = np.bincount(row, minlength=n)
    some = (count <= EXACT / threshold)[row]
    with np.errstate(over="ignore"):
        row, key = row[some], mix64(value[some] + U64(TABLES + 1) * _GOLD)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    shared = np.ceil(threshold * count - 1e-9).astype(np.int64)  # at least so many of a set's runs are in an alike one
    some = np.arange(len(row)) - bounds(row, n)[row] <= (count - shared)[row]
    return row[some], key[some]


VARIANTS, STAR, MARKS, MEMBERS = range(4)


def _pack(variant: np.ndarray, sig: np.ndarray) -> bytes:
    own, at = np.unique(sig, return_inverse=True)
    return b"".join([np.array([VARIANTS, len(own), len(variant)], np.int64).tobytes(), own.tobytes(), (variant >> U64(32)).astype(np.uint32).tobytes(), (variant >> U64(16)).astype(np.uint16).tobytes(), at.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes()])


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    _, n, m = np.frombuffer(raw, np.int64, 3).tolist()
    at = 24 + 8 * n
    own = np.frombuffer(raw, U64, n, 24)
    hi = np.frombuffer(raw, np.uint32, m, at)
    lo = np.frombuffer(raw, np.uint16, m, at + 4 * m)
    place = np.frombuffer(raw, np.uint16 if n <= 1 << 16 else np.uint32, m, at + 6 * m)
    return hi.astype(U64) << U64(16) | lo, own[place]


def _pack_rows(kind: int, *columns: np.ndarray) -> bytes:
    return np.array([kind, len(columns), len(columns[0])], np.int64).tobytes() + b"".join(c.view(np.int64).tobytes() for c in columns)


def _unpack_rows(raw: bytes) -> np.ndarray:
    _, k, n = np.frombuffer(raw, np.int64, 3).tolist()
    return np.frombuffer(raw, np.int64, k * n, 24).reshape(k, n)


def _cuts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and their sizes."""
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return edge, np.diff(np.append(edge, len(key)))


def _by_target(target: np.ndarray, make, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(target, kind="stable")
    edge, size = _cuts(target[order])
    for a, n in zip(edge.tolist(), size.tolist()):
        own = order[a : a + n]
        yield int(target[own[0]]), make(*[c[own] for c in columns])


def _flush(variant: np.ndarray, sig: np.ndarray, targets: int, small: int) -> Iterator[tuple[int, bytes]]:
    """Blobs of a task's variants by target. Texts beyond `small` of one variant are dealt to all
    targets as a star around the first, which alone goes to the variant's target."""
    variant = variant >> U64(16)
    variant, sig = distinct_per_row(variant, sig)
    edge, size = _cuts(variant)
    crowded = np.repeat(size > small, size)
    if crowded.any():
        centre = np.repeat(sig[edge], size)[crowded]
        yield from _by_target((sig[crowded] % U64(targets)).astype(np.int64), lambda *c: _pack_rows(STAR, *c), variant[crowded], sig[crowded], centre)
        marks = variant[edge[size > small]]
        yield from _by_target((marks % U64(targets)).astype(np.int64), lambda *c: _pack_rows(MARKS, *c), marks)
        go = ~crowded
        go[edge] = True
        variant, sig = variant[go], sig[go]
    yield from _by_target((variant % U64(targets)).astype(np.int64), _pack, variant << U64(16), sig)


def _emit_variants(targets: int, threshold: float, small: int):
    """(target, blob): the variants of the texts, and each record's signature and number of words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        seen: set[int] = set()

        def batch_of(blobs: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
            target, blob = zip(*blobs)
            return pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), pa.array(blob, pa.binary())], ["target", "blob"])

        for batch in batches:
            for i, j, part in slices(texts_of(batch.column("text"))):
                sig, count, w = _signatures(part)
                rec = batch.column("rec_id").slice(i, j - i).to_numpy()
                yield batch_of(_by_target((sig % U64(targets)).astype(np.int64), lambda *c: _pack_rows(MEMBERS, *c), rec, sig, count.astype(np.int64)))
                # one row for each text of this task: copies are combined before the shuffle
                keep = count >= MIN_WORDS
                for r in np.flatnonzero(keep).tolist():
                    keep[r] = int(sig[r]) not in seen
                    seen.add(int(sig[r]))
                if not keep.any():
                    continue
                row, value = _sets(w, keep)
                row, sig, n = (np.cumsum(keep) - 1)[row], sig[keep], int(keep.sum())
                v = _variants(row, value, n)
                few, single = _prefixes(row, value, n, threshold)
                held += [(v.ravel(), np.repeat(sig, v.shape[1])), (single, sig[few])]
                size += v.size + single.size
                if size >= PACK:
                    yield batch_of(_flush(np.concatenate([v for v, _ in held]), np.concatenate([s for _, s in held]), targets, small))
                    held, size, seen = [], 0, set()
        if held:
            yield batch_of(_flush(np.concatenate([v for v, _ in held]), np.concatenate([s for _, s in held]), targets, small))

    return emit


def _pairs_within(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within runs [start, start + size), for all runs of one size at a time."""
    left, right = [], []
    for n in np.unique(size):
        i, j = np.triu_indices(int(n), 1)
        s = start[size == n]
        left.append((s[:, None] + i).ravel())
        right.append((s[:, None] + j).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_COLLIDED = "kind byte, x long, y long, n int"
PAIR, LARGE, MEMBER = range(3)


def _collide(small: int):
    """Of one partition of variants: candidate pairs (PAIR, a, b); members of large groups (LARGE,
    variant, signature); records (MEMBER, rec_id, signature, words). A partition holds whole groups
    but for texts that were dealt out as stars."""

    def rows(kind: int, x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(x), np.int32) if n is None else n
        for k in range(0, len(x), 1 << 16):
            cut = slice(k, k + (1 << 16))
            cols = [pa.array(x[cut].view(np.int64)), pa.array(y[cut].view(np.int64)), pa.array(n[cut].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int8)), *cols], ["kind", "x", "y", "n"])

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks, stars = [], [], []
        for batch in batches:
            for blob in batch.column("blob"):
                raw = blob.as_py()
                kind = int(np.frombuffer(raw, np.int64, 1)[0])
                if kind == VARIANTS:
                    held.append(_unpack(raw))
                elif kind == MARKS:
                    marks.append(_unpack_rows(raw)[0].view(U64))
                elif kind == STAR:
                    variant, sig, centre = _unpack_rows(raw)
                    yield from rows(LARGE, variant, sig)
                    stars.append(np.stack([sig, centre]))
                else:
                    rec, sig, count = _unpack_rows(raw)
                    yield from rows(MEMBER, rec, sig, count)
        if held:
            variant, sig = distinct_per_row(np.concatenate([v for v, _ in held]), np.concatenate([s for _, s in held]))
            edge, size = _cuts(variant)
            few = (size > 1) & (size <= small)
            i, j = _pairs_within(edge[few], size[few])
            many = size > small
            inside = np.repeat(many, size)
            centre = np.repeat(sig[edge], size)[inside]
            stars += [np.stack([sig[i], sig[j]]).view(np.int64), np.stack([sig[inside], centre]).view(np.int64)]
            marked = many | (np.isin(variant[edge], np.concatenate(marks)) if marks else False)
            some = np.repeat(marked, size)
            yield from rows(LARGE, variant[some], sig[some])
        if stars:
            both = np.concatenate(stars, 1)
            a, b = distinct_per_row(both.min(0), both.max(0))
            yield from rows(PAIR, a[a != b], b[a != b])

    return collide


def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, members): the sorted distinct shingles of each asked text, 40 bits of each hash."""
    for batch in batches:
        for i, j, part in slices(texts_of(batch.column("text"))):
            sig, _, w = _signatures(part)
            keep = sig.view(np.int64) == batch.column("sig").slice(i, j - i).to_numpy()  # a rec_id may come with another text
            row, value = _sets(w, keep)
            row, value = distinct_per_row(row, value >> U64(24))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(keep))[keep])]) * 5
            raw = value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            blobs = pa.Array.from_buffers(pa.large_binary(), int(keep.sum()), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), blobs], ["sig", "members"])


def _open_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All members of the sets of a column, and where each set's begin."""
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]].reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    return wide.view("<u8")[:, 0].astype(U64), (offs - offs[0]) // 5


def _alike(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = np.cumsum(np.asarray(pc.binary_length(batch.column("set_a")), np.int64))
            k = 0
            while k < batch.num_rows:  # some megabytes of members at a time
                stop = max(k + 1, int(np.searchsorted(weight, (weight[k - 1] if k else 0) + (8 << 20))))
                part = batch.slice(k, stop - k)
                (p, at_p), (q, at_q) = _open_sets(part.column("set_a")), _open_sets(part.column("set_b"))
                n = part.num_rows
                of_p, of_q = np.repeat(np.arange(n, dtype=U64), np.diff(at_p)), np.repeat(np.arange(n, dtype=U64), np.diff(at_q))
                p, q = of_p << U64(40) | p, of_q << U64(40) | q  # ordered: sets are sorted
                there = p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q if len(p) else np.zeros(len(q), bool)
                both = np.bincount(of_q[there].astype(np.int64), minlength=n)
                keep = both >= threshold * (np.diff(at_p) + np.diff(at_q) - both)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))
                k = stop

    return verify


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of candidate pairs (a, b) of signatures those at least `threshold` alike, on whole sets."""
    joined = pairs.join(sets.select(F.col("sig").alias("a"), F.col("members").alias("set_a")), "a").join(sets.select(F.col("sig").alias("b"), F.col("members").alias("set_b")), "b")
    return stage_table(joined.mapInArrow(_alike(threshold), "a long, b long"), "links")


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            value, at = _open_sets(part.column("members"))
            size = np.diff(at)
            owner = pa.array(np.repeat(np.arange(len(size)), size))
            yield pa.RecordBatch.from_arrays([part.column("sig").take(owner), pa.array(value.view(np.int64)), pa.array(np.repeat(size, size).astype(np.int32))], ["sig", "run", "size"])


def _pairs_by_rare_runs(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) of `members` (sig, component, outside) in different components, one of
    them outside; no alike pair is missing.

    Runs are ordered by how many members have them, the rarest first. Of two alike sets the
    smaller has a run in common with the larger among its first |x| - ceil(2t / (1 + t) |x|) + 1,
    and the larger among its first |y| - ceil(t |y|) + 1. What most members share comes last and
    makes no pairs.
    """
    runs = stage_table(sets.join(members.select("sig"), "sig", "left_semi").mapInArrow(_runs_of, "sig long, run long, size int"), "runs")
    often = runs.groupBy("run").agg(F.count("*").alias("often")).where("often > 1")  # a run of one member makes no pair
    order = Window.partitionBy("sig").orderBy("often", "run")
    alone = F.col("size") - F.count("*").over(Window.partitionBy("sig"))  # left out runs come first
    ranked = runs.join(often, "run").withColumn("rank", F.row_number().over(order) + alone)
    size = F.col("size")
    ranked = ranked.withColumn("short", size - F.ceil(size * (2 * threshold / (1 + threshold)) - 1e-9) + 1).withColumn("long", size - F.ceil(size * threshold - 1e-9) + 1)
    ranked = stage_table(ranked.where("rank <= long").join(members, "sig"), "ranked")
    x = ranked.where("rank <= short").select("run", F.col("sig").alias("x"), F.col("size").alias("size_x"), F.col("component").alias("cx"), F.col("outside").alias("ox"))
    y = ranked.select("run", F.col("sig").alias("y"), F.col("size").alias("size_y"), F.col("component").alias("cy"), F.col("outside").alias("oy"))
    met = x.join(y, "run").where(f"cx != cy and (ox or oy) and size_x <= size_y and size_x >= size_y * {threshold} - 1e-9")
    return stage_table(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "rare")


def _with_links(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links (a, b) between nodes, which are few beside the groups."""
    of = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b")
    between = stage_table(between.distinct(), "between")
    if not between.take(1):
        return groups
    joined = stage_table(connected_components(between), "joined")
    moved = groups.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    new = joined.join(groups.select("node"), "node", "left_anti").select("node", "component")
    return stage_table(moved.select("node", F.coalesce("to", "component").alias("component")).unionByName(new), "groups")


def _join_large(large: DataFrame, groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Components after the members of large groups (variant, sig) have been joined.

    Each round compares the members outside a group's largest component with one member of it,
    another in every round and group. When rounds no longer help, the rest is found by rare runs.
    """
    if not large.take(1):
        return groups
    before = None
    turn = 0
    while True:
        tagged = large.join(groups.withColumnRenamed("node", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        open_ = tagged.groupBy("variant").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("variant")
        tagged = stage_table(tagged.join(open_, "variant", "left_semi"), "large")
        largest = tagged.groupBy("variant", "component").count().groupBy("variant").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
        tagged = tagged.join(largest, "variant").withColumn("outside", F.col("component") != F.col("largest"))
        left = tagged.where("outside").select("sig").distinct().count()
        if not left:
            return groups
        if before is not None and left > PROGRESS * before:
            members = tagged.groupBy("sig").agg(F.first("component").alias("component"), F.max("outside").alias("outside"))
            more = _pairs_by_rare_runs(stage_table(members, "members"), sets, threshold)
            return _with_links(groups, _verified(more, sets, threshold))
        centre = tagged.where("not outside").groupBy("variant").agg(F.max_by("sig", F.xxhash64("sig", "variant", F.lit(turn))).alias("q"))
        more = tagged.where("outside").join(centre, "variant").select(F.least("sig", "q").alias("a"), F.greatest("sig", "q").alias("b"))
        groups = _with_links(groups, _verified(stage_table(more.distinct(), "more"), sets, threshold))
        before, turn = left, turn + 1


def near_duplicate_classes(records: DataFrame, threshold: float = 0.5, small: int = SMALL) -> DataFrame:
    """(rec_id, class_id, n_words): one row per record with a text; alike records share a class.

    `records` has rec_id and text. Two records of at least 20 words each are alike if their
    distinct runs of three words overlap by `threshold` or more (shared over found in either);
    classes are closed under chains and named by their smallest record. Shorter records, and texts
    alike to none, are classes of their own; equal word sequences of 20 words or more always share one. Null
    texts and null ids are left out, rows of one rec_id count once, other columns are ignored.

    The texts are read once for their variants and once for the sets of those that collide. `small`
    decides how groups of texts of one variant are compared, not what is found.
    """
    spark = records.sparkSession
    rows = spread(records.select(F.col("rec_id").cast("long").alias("rec_id"), "text").where("rec_id is not null and text is not null"))
    # 270 variants of about 9 bytes for each text; a partition of them should stay near 64 MB
    targets = max(shuffle_width(spark), records.count() * TABLES * len(_SUBSETS) * 9 // (64 << 20))
    variants = rows.mapInArrow(_emit_variants(targets, threshold, small), "target int, blob binary")
    found = stage_table(variants.repartitionById(targets, F.col("target")).select("blob").mapInArrow(_collide(small), _COLLIDED), "candidates")
    members = found.where(f"kind = {MEMBER}").groupBy(F.col("x").alias("rec_id")).agg(F.min(F.struct(F.col("y").alias("sig"), F.col("n").alias("n_words"))).alias("m")).select("rec_id", "m.*")
    members = stage_table(members, "records")
    pairs = stage_table(found.where(f"kind = {PAIR}").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
    large = found.where(f"kind = {LARGE}").select(F.col("x").alias("variant"), F.col("y").alias("sig")).distinct()

    # one record for each text that collides; only their texts are read for their sets
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    asked = members.join(ends, "sig", "left_semi").groupBy("sig").agg(F.min("rec_id").alias("rec_id"))
    asked = stage_table(asked, "asked")
    if asked.count() <= SENT_IDS:
        asked = F.broadcast(asked)
    sets = stage_table(rows.join(asked, "rec_id").select("sig", "text").mapInArrow(_emit_sets, "sig long, members binary").dropDuplicates(["sig"]), "sets")
    groups = stage_table(connected_components(_verified(pairs, sets, threshold)), "groups")
    groups = _join_large(large, groups, sets, threshold)
    classes = members.join(groups.withColumnRenamed("node", "sig"), "sig", "left")
    own = F.when(F.col("n_words") >= MIN_WORDS, F.coalesce("component", "sig"))
    classes = stage_table(classes.select("rec_id", own.alias("class"), "n_words"), "classes")
    names = classes.where("class is not null").groupBy("class").agg(F.min("rec_id").alias("class_id"))
    return classes.join(names, "class", "left").select("rec_id", F.coalesce("class_id", "rec_id").alias("class_id"), "n_words")


def pairs_of_classes(classes: DataFrame) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b, of records of at least 20 words in one class."""
    rows = stage_table(classes.where(f"n_words >= {MIN_WORDS}").select("rec_id", "class_id"), "classes")
    shared = rows.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id")
    rows = rows.join(shared, "class_id", "left_semi")
    left, right = rows.withColumnRenamed("rec_id", "rec_a"), rows.withColumnRenamed("rec_id", "rec_b")
    return left.join(right, "class_id").where("rec_a < rec_b").select("rec_a", "rec_b")
