"""Evaluation passages inside training records.

Method: the n-grams of the evaluation items form a hash set that every task holds; tasks scan
the word windows of the training records against it, verify each hit word by word, and report
the items, the places and, on request, the texts without them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .content import fill_content, joined_content, vocabulary
from .spans import Pieces, Texts, shingles, slices, texts_of, words
from ..session import spread, stage_table

GRAM = 13
#: Bytes of item text in one block; the hash set of a block takes about six times that.
BLOCK_BYTES = 16 << 20

SPAN = "array<struct<start:int,stop:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


class GramIndex:
    """The n-grams of some items, sorted by hash, with the words to verify against."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        self.n = n
        grams: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        place: list[np.ndarray] = []
        self.items: list[tuple[int, list[bytes]]] = []
        for i, (item, text) in enumerate(zip(ids, texts)):
            raw = texts_of(pa.array([text], pa.string()))
            w = words(raw)
            self.items.append((item, _words(raw, w, 0, len(w.row))))
            at, h = shingles(w, n)
            grams.append(h)
            owner.append(np.full(len(at), i, np.int64))
            place.append(at)
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.owner = np.concatenate(owner)[order] if grams else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if grams else np.zeros(0, np.int64)
        # one bit for each value of the hash's low bits: most windows end here
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, texts: Texts) -> Iterator[tuple[int, int, int, int]]:
        """(row, item index, first byte, last byte) of each verified window."""
        w = words(texts)
        at, h = shingles(w, self.n)
        some = np.flatnonzero(self.bits[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at, h = at[some], h[some]
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        for k in np.flatnonzero(hi > lo).tolist():
            first = int(at[k])
            mine = _words(texts, w, first, first + self.n)
            for j in range(int(lo[k]), int(hi[k])):
                owner, place = int(self.owner[j]), int(self.place[j])
                if self.items[owner][1][place : place + self.n] == mine:
                    yield int(w.row[first]), owner, int(w.start[first]), int(w.end[first + self.n - 1])


def _words(texts: Texts, w: Pieces, a: int, b: int) -> list[bytes]:
    raw = texts.buf
    return [raw[s:e].tobytes().lower() for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist())]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _points(texts: Texts, row: int, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Byte ranges of a slice as code points of the row's text."""
    first = int(texts.offs[row])
    upto = np.concatenate([[0], np.cumsum((texts.buf[first : texts.offs[row + 1]] & 0xC0) != 0x80)])
    return [{"start": int(upto[a - first]), "stop": int(upto[b - first])} for a, b in spans]


def leaked_passages(
    records: DataFrame,
    items: DataFrame,
    vocab: DataFrame | None = None,
    *,
    n: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(rec_id, item_id, n_windows, spans) for each record and item that share `n` successive words.

    `records` has rec_id and text and, with `vocab`, ids, which stand in where text is null;
    `items` has item_id and text. Words are runs of a-z0-9 after A-Z became a-z. Spans are
    merged code point ranges of the record's content. Other columns are ignored. Null texts,
    null ids and items of fewer than `n` words give nothing; rows of one rec_id give one row;
    items with equal text are reported each.

    The items' hash set is sent to the workers only up to `block_bytes` of item text; more
    items are taken in blocks of that size, each scanned over all records.
    """
    spark = records.sparkSession
    pieces = None
    records = records.select("rec_id", "text", *(["ids"] if vocab is not None else []))
    if vocab is not None:
        pieces = vocabulary(vocab)
        if pieces is None:
            records = joined_content(records, vocab, "rec_id").select("rec_id", "text")
    records = spread(records.where("rec_id is not null"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").dropDuplicates()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    found = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        index = spark.sparkContext.broadcast(GramIndex([r[0] for r in rows], [r[1] for r in rows], n))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            grams = index.value
            for batch in batches:
                column = batch.column("text")
                if pieces is not None:
                    column = fill_content(column, batch.column("ids"), pieces.value)
                keys = batch.column("rec_id")
                recs, its, counts, spans = [], [], [], []
                for i, _, part in slices(texts_of(column)):
                    by: dict[tuple[int, int], list[tuple[int, int]]] = {}
                    for row, owner, a, b in grams.hits(part):
                        by.setdefault((row, grams.items[owner][0]), []).append((a, b))
                    for (row, item), places in by.items():
                        recs.append(i + row)
                        its.append(item)
                        counts.append(len(set(places)))
                        spans.append(_points(part, row, _merged(places)))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(recs, pa.int64())).cast(pa.int64()), pa.array(its, pa.int64()), pa.array(counts, pa.int32()), pa.array(spans, _SPANS)],
                    ["rec_id", "item_id", "n_windows", "spans"],
                )

        part = records.mapInArrow(scan, f"rec_id long, item_id long, n_windows int, spans {SPAN}")
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["rec_id", "item_id"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, text, removed_share): each text without its spans, which are sorted by start."""
    for batch in batches:
        column = batch.column("text")
        for i, j, part in slices(texts_of(column)):
            n = j - i
            row = np.repeat(np.arange(n), np.diff(part.offs))
            lead = (part.buf & 0xC0) != 0x80
            place = np.cumsum(lead) - 1  # code point of each byte, counted over the slice
            first = np.concatenate([[0], np.cumsum(lead)])[part.offs]
            spans = batch.column("spans").slice(i, n)
            owner = np.repeat(np.arange(n), np.asarray(spans.value_lengths().fill_null(0), np.int64))
            start, stop = (np.asarray(x, np.int64) for x in spans.flatten().flatten())
            edge = np.zeros(int(first[-1]) + 1, np.int64)
            np.add.at(edge, first[owner] + start, 1)
            np.add.at(edge, first[owner] + stop, -1)
            gone = np.cumsum(edge)[:-1] > 0
            keep = ~gone[place] if len(place) else np.zeros(0, bool)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=n))]).astype(np.int64)
            text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends), pa.py_buffer(part.buf[keep])]).cast(pa.string())
            size = np.diff(first)
            left = np.bincount(row[keep & lead], minlength=n) if len(row) else np.zeros(n)
            share = np.where(size > 0, 1 - left / np.maximum(size, 1), 0.0)
            text = pc.if_else(pa.array(part.valid), text, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("rec_id").slice(i, n), text, pa.array(share)], ["rec_id", "text", "removed_share"])


def without_passages(records: DataFrame, passages: DataFrame, vocab: DataFrame | None = None, max_share: float = 0.5) -> DataFrame:
    """(rec_id, text, removed_share) of the records' content, leaked spans cut out.

    The content is the same as in `leaked_passages`: the text or, with `vocab`, what the ids stand for where
    the text is null; spans found there are cut there. A record of which more than `max_share` of
    the characters would go is dropped. Records without a leak keep their content; without
    content the text stays null with share 0. Rows of one rec_id count once, null ids are left out.
    `passages` is the result of `leaked_passages` over the same records.
    """
    spans = passages.groupBy("rec_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    spans = stage_table(spans, "spans")  # so that its size is known before it is joined
    rows = _content(records.select("rec_id", "text", *(["ids"] if vocab is not None else [])), vocab)
    rows = rows.where("rec_id is not null").dropDuplicates(["rec_id"]).join(spans, "rec_id", "left")
    cut = rows.select(F.col("rec_id").cast("long").alias("rec_id"), "text", "spans").mapInArrow(_cut, "rec_id long, text string, removed_share double")
    return cut.where(F.col("removed_share") <= max_share)


def _content(records: DataFrame, vocab: DataFrame | None) -> DataFrame:
    """(rec_id, text) with the text filled from the ids."""
    if vocab is None:
        return records
    pieces = vocabulary(vocab)
    if pieces is None:
        return joined_content(records, vocab, "rec_id").select("rec_id", "text")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), fill_content(batch.column("text"), batch.column("ids"), pieces.value)], ["rec_id", "text"])

    return spread(records.select(F.col("rec_id").cast("long").alias("rec_id"), "text", "ids")).mapInArrow(fill, "rec_id long, text string")
