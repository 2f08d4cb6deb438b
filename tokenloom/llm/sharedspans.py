"""Long exact spans shared between documents, by relative Lempel-Ziv parsing.

Winnowing picks anchors (hashes of `GRAM` characters) so densely that every stretch of `SPAN`
characters holds one, at a place that only the stretch itself decides. Documents without a
common anchor therefore share no such stretch, and a reference block need only hold the
surroundings of its anchors in the documents that have them.

The surroundings are factored greedily against their block, which is indexed by its sorted
suffixes: from left to right, each factor is the longest stretch from there on that stands in
another document. Factors of `SPAN` characters or more are shared. A shared stretch of which a factor
covers only the beginning goes on into the next factor, or for fewer characters than the shortest
factor into what no factor covers; so the windows of `SPAN` characters across such a limit are
looked up as well, where the two sides together are long enough. Nothing else can be missed: from
any place inside a shared stretch the longest factor reaches its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .spans import U64, Texts, _powers, bounds, mix64, slices, texts_of
from ..session import scan_tasks, shuffle_width, spread, stage_table

SPAN = 150
GRAM = 50
#: Contexts that are factored together; an anchor's are never parted.
BLOCK = 2_000
#: Different contexts of one anchor in one task beyond which the anchor is crowded: its windows
#: are shuffled singly, so that no task holds all contexts of a frequent anchor.
CROWD = 64
#: The same for all contexts of an anchor.
CROWD_TOTAL = 4_000
#: Anchors that a task packs before it hands them on.
PACK = 1_000_000
#: Most document ids that are sent to all tasks, so that the texts of other documents aren't
#: shuffled for the join with what is wanted of them; with more, they are.
SENT_IDS = 4_000_000
_LOW = U64((1 << 28) - 1)


class _Points:
    """Code points of consecutive rows, with prefix sums that give the hash of any stretch."""

    def __init__(self, part: Texts):
        first = np.concatenate([[0], np.cumsum((part.buf & 0xC0) != 0x80)])
        self.offs = first[part.offs]
        raw = part.buf.tobytes()
        self.codes = np.frombuffer(raw if len(raw) == self.offs[-1] else raw.decode("utf-8").encode("utf-32-le"), np.uint8 if len(raw) == self.offs[-1] else np.uint32)
        self.up, self.down = _powers(len(self.codes) + 1)
        self.sums = np.zeros(len(self.codes) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum((self.codes.astype(U64) + U64(1)) * self.up[: len(self.codes)], out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(U64))

    def row_hash(self) -> np.ndarray:
        return self.hash(self.offs[:-1], self.offs[1:])


def _sliding(x: np.ndarray, w: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """`pick` over every run of `w` entries, from prefix and suffix scans of blocks of `w`."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, fill, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - w + 1], ahead[w - 1 : n])


def _anchors(p: _Points, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of the winnowed grams: in every `span` characters the one whose hash
    is smallest, the last of equals."""
    none = np.zeros(0, np.int64)
    n = len(p.codes) - gram + 1
    width = span - gram + 1
    if n < width:
        return none, none, np.zeros(0, U64)
    at = np.arange(n)
    h = p.hash(at, at + gram)
    key = h & ~_LOW | (_LOW - (at.astype(U64) & _LOW))
    left = np.repeat(p.offs[1:], np.diff(p.offs))[:n] - at  # characters to the row's end
    key[left < gram] = U64(0xFFFFFFFFFFFFFFFF)
    least = _sliding(key, width, np.minimum, 0xFFFFFFFFFFFFFFFF)
    least[left[: len(least)] < span] = 0  # the stretch would leave its row
    reach = np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)])
    chosen = np.flatnonzero((_sliding(reach, width, np.maximum, 0) == key) & (left >= gram))
    return np.searchsorted(p.offs, chosen, "right") - 1, chosen, h[chosen]


ROWS, MARKS, EQUAL, ASKED, TEXT = range(5)
_FIELDS = {ROWS: 6, MARKS: 1, EQUAL: 3, ASKED: 4, TEXT: 3}
_SETTLED = "kind byte, tid long, start long, stop long, anchor long"


def _narrow(h: np.ndarray) -> list[np.ndarray]:
    """The upper 48 bits of hashes, as 32 and 16 bits."""
    return [(h >> U64(32)).astype(np.uint32), (h >> U64(16)).astype(np.uint16)]


def _wide(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return hi.astype(U64) << U64(16) | lo


def _freeze(kind: int, *arrays: np.ndarray) -> bytes:
    return np.array([kind, len(arrays)], np.int64).tobytes() + b"".join(np.array([len(x), ord(x.dtype.char)], np.int64).tobytes() + x.tobytes() for x in arrays)


def _thaw(raw: bytes) -> tuple[int, list[np.ndarray]]:
    kind, k = np.frombuffer(raw, np.int64, 2).tolist()
    out, at = [], 16
    for _ in range(k):
        n, code = np.frombuffer(raw, np.int64, 2, at).tolist()
        out.append(np.frombuffer(raw, np.dtype(chr(code)), n, at + 16))
        at += 16 + out[-1].nbytes
    return kind, out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate([[True], new, [True]]))


def _by_target(target: np.ndarray, targets: int, kind: int, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blobs of the rows of each target."""
    order = np.argsort(target, kind="stable")
    cut = _groups(target[order])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = order[a:b]
        yield int(target[own[0]]), _freeze(kind, *[x[own] for x in arrays])


def _rows_by_target(target: np.ndarray, targets: int, anchor: np.ndarray, context: np.ndarray, tid: np.ndarray, at: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The same for anchor rows, 17 bytes each, texts numbered within a blob."""
    order = np.argsort(target, kind="stable")
    cut = _groups(target[order])
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        own = order[a:b]
        names, place = np.unique(tid[own], return_inverse=True)
        small = lambda x: x.astype(np.min_scalar_type(int(x.max())))
        yield int(target[own[0]]), _freeze(ROWS, *_narrow(anchor[own]), *_narrow(context[own]), names, small(place), small(at[own]), small(right[own]))


def _contexts(anchor: np.ndarray, context: np.ndarray, tid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows ordered by anchor, context and text: whether two texts have the row's context, whether
    it is the first row of the first or last such text, its anchor's contexts, and its anchor's number."""
    cut = _groups(anchor, context)
    size = np.diff(cut)
    shared = np.repeat(tid[cut[:-1]] != tid[cut[1:] - 1], size)
    text = _groups(anchor, context, tid)[:-1]
    ends = np.zeros(len(anchor), bool)
    first, last = np.isin(text, cut[:-1]), np.append(np.isin(text[1:], cut[:-1]), True) if len(text) else np.zeros(0, bool)
    ends[text[first | last]] = True
    edge = _groups(anchor)
    number = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    per = np.bincount(number[cut[:-1]], minlength=len(edge) - 1) if len(anchor) else np.zeros(0, np.int64)
    return shared, ends, per[number], number


def _emit_anchors(span: int, gram: int, targets: int, crowd: int, pack: int):
    """(target, blob): the anchors of the texts for the task that settles them.

    Copies within a task give their anchors once. Where two texts of a task have an anchor in equal
    surroundings, these are settled here and only two rows go on, so that a frequent passage costs
    each task two rows.
    """

    def flush(held: list[list[np.ndarray]]) -> Iterator[tuple[int, bytes]]:
        anchor, context, tid, at, right = (np.concatenate(x) for x in zip(*held))
        anchor, context = anchor & ~U64(0xFFFF), context & ~U64(0xFFFF)
        order = np.lexsort((at, tid, context, anchor))
        anchor, context, tid, at, right = anchor[order], context[order], tid[order], at[order], right[order]
        shared, ends, per, _ = _contexts(anchor, context, tid)
        start, stop = np.maximum(at + gram - span, 0), at + right
        if shared.any():  # equal surroundings in two texts, as far as they reach
            yield from _by_target((tid[shared] % U64(targets)).astype(np.int64), targets, EQUAL, tid[shared], start[shared], stop[shared])
        go = ~shared | ends
        crowded = go & (per > crowd)
        if crowded.any():
            yield from _by_target((tid[crowded] % U64(targets)).astype(np.int64), targets, ASKED, tid[crowded], start[crowded], stop[crowded], anchor[crowded])
            names = np.unique(anchor[crowded])
            yield from _by_target((names >> U64(16)).astype(np.int64) % targets, targets, MARKS, names)
        go &= ~crowded
        yield from _rows_by_target((anchor[go] >> U64(16)).astype(np.int64) % targets, targets, anchor[go], context[go], tid[go], at[go], right[go])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        seen: set[int] = set()

        def batch_of(blobs: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
            target, blob = zip(*blobs)
            return pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), pa.array(blob, pa.binary())], ["target", "blob"])

        for batch in batches:
            for i, j, part in slices(texts_of(batch.column("text"))):
                p = _Points(part)
                text = p.row_hash()
                doc = batch.column("doc_id").slice(i, j - i).to_numpy()
                yield batch_of(_by_target((text % U64(targets)).astype(np.int64), targets, TEXT, text, doc, np.diff(p.offs)))
                row, at, h = _anchors(p, span, gram)
                fresh = np.array([not (t in seen or seen.add(t)) for t in text.tolist()])
                keep = fresh[row] if len(row) else np.zeros(0, bool)
                row, at, h = row[keep], at[keep], h[keep]
                start = np.maximum(at + gram - span, p.offs[row])
                stop = np.minimum(at + span, p.offs[row + 1])
                with np.errstate(over="ignore"):
                    context = mix64(p.hash(start, stop) + (at - start).astype(U64))
                held.append([h, context, text[row], at - p.offs[row], stop - at])
                size += len(row)
                if size >= pack:
                    yield batch_of(flush(held))
                    held, size, seen = [], 0, set()
        if size:
            yield batch_of(flush(held))

    return emit


def _settled(kind: int, tid: np.ndarray, start: np.ndarray, stop: np.ndarray, anchor: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    anchor = np.zeros(len(tid), U64) if anchor is None else anchor
    for k in range(0, len(tid), 1 << 16):
        cut = slice(k, k + (1 << 16))
        cols = [pa.array(tid[cut].view(np.int64)), pa.array(start[cut].astype(np.int64)), pa.array(stop[cut].astype(np.int64)), pa.array(anchor[cut].view(np.int64))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int8)), *cols], ["kind", "tid", "start", "stop", "anchor"])


CROWDED = 5


def _settle(span: int, gram: int, block: int):
    """Of one partition of anchors: stretches that are equal in two texts (EQUAL), and contexts that
    must be factored (ASKED, or CROWDED for windows). What needs no settling passes through."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks = [], []
        for batch in batches:
            for raw in batch.column("blob"):
                kind, x = _thaw(raw.as_py())
                if kind == ROWS:
                    held.append((_wide(x[0], x[1]) << U64(16), _wide(x[2], x[3]), x[4][x[5]], x[6].astype(np.int64), x[7].astype(np.int64)))
                elif kind == MARKS:
                    marks.append(x[0])
                else:
                    yield from _settled(CROWDED if kind == ASKED else kind, *x)
        if not held:
            return
        anchor, context, tid, at, right = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((at, tid, context, anchor))
        anchor, context, tid, at, right = anchor[order], context[order], tid[order], at[order], right[order]
        shared, ends, per, number = _contexts(anchor, context, tid)
        start, stop = np.maximum(at + gram - span, 0), at + right
        yield from _settled(EQUAL, tid[shared], start[shared], stop[shared])
        edge = _groups(anchor)[:-1]
        marked = np.isin(anchor[edge], np.concatenate(marks)) if marks else np.zeros(len(edge), bool)
        two = np.minimum.reduceat(tid, edge) != np.maximum.reduceat(tid, edge)
        crowded = (marked | (per[edge] > block))[number]
        asked = (~shared | ends) & (two & (per[edge] > 1) | marked)[number]
        for kind, some in ((ASKED, asked & ~crowded), (CROWDED, asked & crowded)):
            yield from _settled(kind, tid[some], start[some], stop[some], anchor[some])

    return settle


def _emit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, anchor, tid, start, body) of the wanted contexts of each text."""
    for batch in batches:
        for i, j, part in slices(texts_of(batch.column("text"))):
            p = _Points(part)
            wanted = batch.column("wanted").slice(i, j - i)
            row = np.repeat(np.arange(j - i), np.asarray(wanted.value_lengths(), np.int64))
            kind, anchor, start, stop = (np.asarray(x) for x in wanted.flatten().flatten())
            tid = batch.column("tid").slice(i, j - i).to_numpy()
            mine = (p.row_hash().view(np.int64) == tid)[row]  # a doc_id may come with another text too
            row, kind, anchor, start, stop = row[mine], kind[mine], anchor[mine], start[mine], stop[mine]
            first = np.append(np.flatnonzero((part.buf & 0xC0) != 0x80), len(part.buf))
            a, b = first[p.offs[row] + start], first[p.offs[row] + stop]
            ends = np.concatenate([[0], np.cumsum(b - a)])
            raw = part.buf[np.arange(ends[-1]) + np.repeat(a - ends[:-1], b - a)]
            body = pa.Array.from_buffers(pa.large_string(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int8)), pa.array(anchor), pa.array(tid[row]), pa.array(start.astype(np.int32)), body], ["kind", "anchor", "tid", "start", "body"])


# ---------------------------------------------------------------- factoring


class Reference:
    """The contexts of a block, indexed by their sorted suffixes.

    Suffixes are ordered by doubling: ranks of the first k characters and of the k after them give
    ranks of the first 2k. Next to a suffix, past those of its own text, stands the one of another
    text that agrees with it longest.
    """

    def __init__(self, body: pa.Array, tid: np.ndarray, least: int):
        self.p = p = _Points(texts_of(body))
        self.tid, self.least = tid, least
        n = len(p.codes)
        size = np.diff(p.offs)
        self.end = np.repeat(p.offs[1:], size)
        place = np.arange(n)
        there = np.bincount(p.codes) > 0 if n else np.zeros(1, bool)
        rank = np.cumsum(there)[p.codes].astype(np.int64)  # from 1; 0 stands for a context's end
        width, k = int(rank.max(initial=0)).bit_length(), 1
        self.same = rank
        while True:
            if k == least:
                self.same = rank
            if k >= size.max(initial=0) and k >= least:
                break
            times = max(1, min(62 // max(width, 1), least // k if k < least else 2, 8))
            times = 1 << (times.bit_length() - 1) if times > 1 else 2
            key = rank.copy()
            for step in range(1, times):
                after = place + step * k
                inside = after < self.end
                key = key << width | np.where(inside, rank[np.minimum(after, n - 1)], 0)
            rank = np.unique(key, return_inverse=True)[1] + 1
            width, k = int(rank.max(initial=0)).bit_length(), k * times
        self.order = np.argsort(rank, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = place
        owner = np.repeat(tid, size)[self.order]
        cut = _groups(owner)
        self.before = np.repeat(cut[:-1] - 1, np.diff(cut))
        self.after = np.repeat(cut[1:], np.diff(cut))
        # places whose first `least` characters stand in another text too, and the next of them
        cut = _groups(self.same[self.order])
        live = np.zeros(n, bool)
        if n:
            two = np.minimum.reduceat(owner, cut[:-1]) != np.maximum.reduceat(owner, cut[:-1])
            live[self.order] = np.repeat(two, np.diff(cut))
            live &= self.end - place >= least
        ahead = np.where(live, place, n)
        self.live = np.append(np.minimum.accumulate(ahead[::-1])[::-1], n)

    def _neighbours(self, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(self.order)
        for side in (self.before, self.after):
            k = side[self.rank[at]]
            yield np.flatnonzero((k >= 0) & (k < n)), self.order[np.clip(k, 0, max(n - 1, 0))]

    def longest(self, at: np.ndarray) -> np.ndarray:
        """How many characters from each place on stand in another text."""
        out = np.zeros(len(at), np.int64)
        for some, other in self._neighbours(at):
            x, y = at[some], other[some]
            low, high = np.zeros(len(x), np.int64), np.minimum(self.end[x] - x, self.end[y] - y)
            while (low < high).any():
                mid = (low + high + 1) // 2
                agree = self.p.hash(x, x + mid) == self.p.hash(y, y + mid)
                low, high = np.where(agree, mid, low), np.where(agree, high, mid - 1)
            out[some] = np.maximum(out[some], low)
        return out

    def agrees(self, at: np.ndarray, span: int) -> np.ndarray:
        """Whether `span` characters from each place on stand in another text."""
        out = np.zeros(len(at), bool)
        for some, other in self._neighbours(at):
            x, y = at[some], other[some]
            fits = (self.end[x] - x >= span) & (self.end[y] - y >= span)
            some, x, y = some[fits], x[fits], y[fits]
            out[some] |= self.p.hash(x, x + span) == self.p.hash(y, y + span)
        return out


def greedy_factors(ref: Reference) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, begin, end) of the factors of every context, of at least `ref.least` characters;
    all contexts are walked at once, a factor a turn."""
    rows = np.arange(len(ref.tid))
    at, stop = ref.p.offs[:-1].copy(), ref.p.offs[1:]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(rows):
        at = ref.live[at]  # what stands nowhere else is skipped
        on = at < stop
        rows, at, stop = rows[on], at[on], stop[on]
        end = at + ref.longest(at)
        out.append((rows, at, end))
        at = end
    row, begin, end = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    order = np.argsort(begin, kind="stable")
    return row[order], begin[order], end[order]


def windows_across(ref: Reference, row: np.ndarray, begin: np.ndarray, end: np.ndarray, span: int) -> np.ndarray:
    """Starts of shared windows of `span` characters that cross a factor's end."""
    reach = np.minimum(end + ref.least - 1, ref.p.offs[row + 1])
    if len(row):
        joins = np.append(begin[1:] == end[:-1], False) & np.append(row[1:] == row[:-1], False)
        reach = np.where(joins, np.append(end[1:], 0), reach)
    first = np.maximum(begin, end - span + 1)
    count = np.maximum(np.minimum(end - 1, reach - span) - first + 1, 0)
    start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return start[ref.agrees(start, span)]


def _factor_block(tid: np.ndarray, start: np.ndarray, body: pa.Array, span: int) -> pa.RecordBatch:
    """Stretches (tid, start, stop) of contexts that another text has too."""
    ref = Reference(body, tid, 1 << (max(span // 2, 1).bit_length() - 1))
    row, begin, end = greedy_factors(ref)
    cross = windows_across(ref, row, begin, end, span)
    long = end - begin >= span
    a, b = np.concatenate([begin[long], cross]), np.concatenate([end[long], cross + span])
    own = np.concatenate([row[long], np.searchsorted(ref.p.offs, cross, "right") - 1])
    shift = start[own] - ref.p.offs[own]
    return pa.RecordBatch.from_arrays([pa.array(tid[own]), pa.array(a + shift, pa.int64()), pa.array(b + shift, pa.int64())], ["tid", "start", "stop"])


def _factor(span: int):
    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block(table: pa.Table) -> pa.RecordBatch:
            return _factor_block(table.column("tid").to_numpy(), table.column("start").to_numpy().astype(np.int64), table.column("body").combine_chunks(), span)

        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(k, BLOCK))
                size += held[-1].num_rows
                if size < BLOCK:
                    continue
                table = pa.Table.from_batches(held)
                anchor = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1]))  # rows are ordered by anchor
                if cut:
                    yield block(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = table.num_rows - cut
        if size:
            yield block(pa.Table.from_batches(held))

    return factor


def _emit_windows(span: int):
    """Every window of the contexts: its hash, text and start."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                p = _Points(texts_of(part.column("body")))
                count = np.maximum(np.diff(p.offs) - span + 1, 0)
                row = np.repeat(np.arange(len(count)), count)
                off = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                h = p.hash(p.offs[row] + off, p.offs[row] + off + span)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("tid").take(pa.array(row)), pa.array(part.column("start").to_numpy().astype(np.int64)[row] + off)], ["window", "tid", "start"])

    return emit


def _joined(spans: DataFrame) -> DataFrame:
    """Touching or overlapping spans (tid, start, stop) made one."""
    order = Window.partitionBy("tid").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("fresh", F.when(before >= F.col("start"), 0).otherwise(1))
    rows = rows.withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("tid", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("part")


def shared_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, block: int = CROWD_TOTAL, crowd: int = CROWD, pack: int = PACK) -> DataFrame:
    """(doc_id, span_start, span_end, n_chars): the longest stretches of shared characters.

    `docs` has doc_id and text. A character is shared if it lies in at least `span` successive
    characters that occur verbatim in the text of another document; positions count code
    points from 0. Null, empty and shorter texts share nothing. Documents of equal text share
    all of it if it is long enough; they are handled as one text, so many copies cost no more.
    Rows of one doc_id count as one document; null ids are left out; other columns are ignored.

    An anchor with more than `crowd` different contexts in one task or `block` in all is crowded;
    the way its contexts are compared differs, not the result.

    The texts are read once for their anchors, of which some 20 bytes each are shuffled, and once
    for the contexts that must be factored.
    """
    spark = docs.sparkSession
    scan = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where((F.col("doc_id").isNotNull()) & (F.length("text") >= span))
    targets = max(shuffle_width(spark), scan_tasks(scan))
    long = spread(scan)
    anchors = long.mapInArrow(_emit_anchors(span, gram, targets, crowd, pack), "target int, blob binary")
    found = stage_table(anchors.repartitionById(targets, F.col("target")).select("blob").mapInArrow(_settle(span, gram, block), _SETTLED), "settled")
    texts = found.where(f"kind = {TEXT}").groupBy(F.col("start").alias("doc_id")).agg(F.min(F.struct("tid", "stop")).alias("t")).select("doc_id", "t.tid", F.col("t.stop").alias("n_chars"))
    texts = stage_table(texts, "texts")
    one = texts.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n_chars").alias("n_chars"))
    whole = one.where("copies > 1").select("tid", F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("stop"))
    equal = found.where(f"kind = {EQUAL}").select("tid", "start", "stop")

    asked = found.where(f"kind in ({ASKED}, {CROWDED})").groupBy("tid").agg(F.collect_list(F.struct("kind", "anchor", "start", "stop")).alias("wanted"))
    asked = stage_table(asked.join(one.select("tid", "doc_id"), "tid"), "asked")
    if asked.count() <= SENT_IDS:
        long = long.join(F.broadcast(asked.select("doc_id")), "doc_id", "left_semi")
    bodies = stage_table(long.join(asked, "doc_id").select("tid", "text", "wanted").mapInArrow(_emit_contexts, "kind byte, anchor long, tid long, start int, body string"), "bodies")
    quiet = bodies.where(f"kind = {ASKED}").drop("kind")
    factors = quiet.repartition(shuffle_width(spark), "anchor").sortWithinPartitions("anchor").mapInArrow(_factor(span), "tid long, start long, stop long")
    windows = bodies.where(f"kind = {CROWDED}").mapInArrow(_emit_windows(span), "window long, tid long, start long")
    both = windows.groupBy("window").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo != hi").select("window")
    crossed = windows.join(both, "window").select("tid", "start", (F.col("start") + span).alias("stop"))
    spans = _joined(whole.unionByName(equal).unionByName(factors).unionByName(crossed))
    return texts.join(spans, "tid").select("doc_id", F.col("start").alias("span_start"), F.col("stop").alias("span_end"), "n_chars")


def shared_coverage(docs: DataFrame, **how: int) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) for every document.

    A null text gives null n_chars and share and 0 shared characters, an empty one share 0.
    """
    found = shared_spans(docs, **how).groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n_chars")).dropDuplicates(["doc_id"])
    shared = F.coalesce("shared", F.lit(0))
    return rows.join(found, "doc_id", "left").select("doc_id", "n_chars", shared.cast("long").alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).when(F.col("n_chars") == 0, 0.0).alias("shared_share"))
