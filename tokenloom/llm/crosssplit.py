"""Records of evaluation splits that stand, exactly or almost, in the training split.

The evaluation records, lower-cased and cut into words, are dealt to shards of bounded size. A
shard's passages, the runs of three words of its records, go into one Aho-Corasick automaton
over words. Every training record is scanned by the automata; a match is an interval of its words
that equals an interval of evaluation words, verified by the passages' 64-bit hashes. The matches
of a training record are merged per evaluation record into the intervals that are covered there,
and the distinct passages met say whether the two are alike.

Passages are of three words because likeness counts runs of three words wherever they stand: two
records can be wholly alike without four successive words in common, so longer ones would lose pairs.
A pair is counted out only once it has met `need` of the evaluation record's rarest passages, a
little over 1 - `threshold` of them; any alike training record meets so many. No pair is lost, and
a phrase that stands in most records makes no pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .content import fill_content, joined_content, vocabulary
from .spans import U64, Pieces, Texts, bounds, distinct_per_row, mix64, shingles, slices, texts_of, words
from ..session import spread, stage_table

RUN = 3
MIN_WORDS = 20
#: Words of evaluation records in one shard; its automaton takes some 250 MB in each worker.
SHARD_WORDS = 1_500_000
#: Words of evaluation records whose shards are sent to the workers at once, some 25 bytes each; the
#: training records are read once for each such wave.
WAVE_WORDS = 6_000_000
#: Words of training records that a task holds while its shards' automata go over them.
HELD_WORDS = 4_000_000


def _codes(hashes: np.ndarray) -> np.ndarray:
    """A code point for each word: 20 bits of its hash, above the surrogates."""
    return ((hashes >> U64(44)) + U64(0xE000)).astype(np.uint32)


def _pieces(lists: list[np.ndarray]) -> Pieces:
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    h = np.concatenate(lists) if lists else np.zeros(0, U64)
    return Pieces(row, row, row, h)


class Shard:
    """Evaluation texts, their distinct passages, and who has which."""

    def __init__(self, sigs: list[int], texts: list[np.ndarray], threshold: float):
        self.sigs = np.array(sigs, np.int64)
        self.name = uuid.uuid4().hex
        self.n_words = np.array([len(x) for x in texts], np.int64)
        w = _pieces(texts)
        at, h = shingles(w, RUN)
        code = _codes(w.hash).astype(U64)
        key = code[at] << U64(42) | code[at + 1] << U64(21) | code[at + 2]
        # passages by hash; two that are written alike in code points are one pattern
        self.hash, first, passage, common = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        self.pattern = np.unique(key[first])
        # the passage at each word of each text
        self.passage = passage
        self.text_cut = bounds(w.row[at], len(texts))
        # the distinct passages of each text, the rarest of the shard first, and owners of the rare ones
        row = w.row[at]
        pairs = np.unique(row.astype(np.int64) * max(len(self.hash), 1) + passage)
        row, passage = pairs // max(len(self.hash), 1), pairs % max(len(self.hash), 1)
        self.size = np.bincount(row, minlength=len(texts))
        order = np.lexsort((self.hash[passage], common[passage], row))
        row, passage = row[order], passage[order]
        spare = np.floor(self.size * (1 - threshold) + 1e-9).astype(np.int64)  # passages an alike record may lack
        taken = np.minimum(spare + 1 + self.size // 8, self.size)
        self.need = taken - spare
        rare = np.arange(len(row)) - bounds(row, len(texts))[row] < taken[row]
        by = np.argsort(passage[rare], kind="stable")
        self.owner = row[rare][by]
        self.owner_cut = np.searchsorted(passage[rare][by], np.arange(len(self.hash) + 1))

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        mask = U64((1 << 21) - 1)
        points = np.stack([self.pattern >> U64(42), self.pattern >> U64(21) & mask, self.pattern & mask], 1).astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        for i in range(len(self.pattern)):
            out.add_word(text[RUN * i : RUN * (i + 1)], i)
        out.make_automaton()
        return out

    def verified(self, h: np.ndarray) -> np.ndarray:
        """The passage of each match by the hash of its words, -1 where they only look like one."""
        k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[k] == h, k, -1)


def _spread_out(cut: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of each of the groups: which of `group` an entry is for, and its place."""
    size = cut[group + 1] - cut[group]
    entry = np.repeat(np.arange(len(group)), size)
    return entry, np.arange(len(entry)) - np.repeat(np.cumsum(size) - size, size) + cut[group][entry]


def _covered(pair: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """How many words the intervals [start, start + `RUN`) of each pair cover once merged."""
    order = np.lexsort((start, pair))
    pair, start = pair[order], start[order]
    gap = np.append(start[1:] - start[:-1], RUN)
    gap[np.append(pair[1:] != pair[:-1], True)] = RUN
    return np.bincount(pair, np.minimum(gap, RUN), n).astype(np.int64)


class Line:
    """Training records as code points of their words, with the passages at each word."""

    def __init__(self, ids: np.ndarray, part: Texts):
        w = words(part)
        cut = bounds(w.row, len(part.valid))
        keep = np.flatnonzero(np.diff(cut) >= MIN_WORDS)
        self.ids = ids[keep]
        mine = np.isin(w.row, keep)
        row, h = np.searchsorted(keep, w.row[mine]), w.hash[mine]
        self.words = len(h)
        at, self.run = shingles(Pieces(row, row, row, h), RUN)
        self.at = at
        self.row = row[at]
        # a lone separator keeps matches inside their record
        code = np.insert(_codes(h), bounds(row, len(keep))[1:], 1) if len(keep) else np.zeros(0, np.uint32)
        self.text = code.astype("<u4").tobytes().decode("utf-32-le")
        self.runs = np.bincount(distinct_per_row(self.row, self.run)[0], minlength=len(keep))

    def matches(self, find, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """(record, passage) of every verified match of the shard's automaton."""
        first = np.fromiter((end for end, _ in find(self.text)), np.int64) - (RUN - 1)  # in the text, which has one separator more for each record before
        places = self.at + self.row
        k = np.searchsorted(places, first)
        passage = shard.verified(self.run[k]) if len(k) else np.zeros(0, np.int64)
        good = passage >= 0
        return self.row[k[good]], passage[good]

    def overlaps(self, find, shard: Shard, threshold: float) -> list[np.ndarray]:
        """(train_id, sig, shared_runs, runs, covered_words, eval_words) of the alike pairs."""
        row, passage = self.matches(find, shard)
        n, many = len(shard.size), len(shard.hash)
        met_there = np.unique(row * many + passage)  # distinct passages of each record
        row, passage = met_there // many, met_there % many
        entry, place = _spread_out(shard.owner_cut, passage)
        pair, met = np.unique(row[entry] * n + shard.owner[place], return_counts=True)
        pair = pair[met >= shard.need[pair % n]] if len(pair) else pair
        if not len(pair):
            return [np.zeros(0, np.int64)] * 6
        record, text = pair // n, pair % n
        # the intervals of the pairs' evaluation texts that were met, merged
        entry, place = _spread_out(shard.text_cut, text)
        key = record[entry] * many + shard.passage[place]
        there = met_there[np.minimum(np.searchsorted(met_there, key), len(met_there) - 1)] == key
        entry, place = entry[there], place[there]
        covered = _covered(entry, place - shard.text_cut[text[entry]], len(pair))
        shared = np.bincount(np.unique(entry * many + shard.passage[place]) // many, minlength=len(pair))
        either = self.runs[record] + shard.size[text] - shared
        alike = shared >= threshold * either
        return [x[alike] for x in (self.ids[record], shard.sigs[text], shared, either, covered, shard.n_words[text])]


def _evaluation(pieces: Broadcast | None):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = fill_content(batch.column("text"), batch.column("ids"), pieces.value) if pieces else batch.column("text")
            for i, j, part in slices(texts_of(column)):
                w = words(part)
                cut = bounds(w.row, j - i)
                keep = np.flatnonzero(np.diff(cut) >= MIN_WORDS)
                lists = [w.hash[cut[r] : cut[r + 1]] for r in keep.tolist()]
                sig = [int(mix64(np.array([np.bitwise_xor.reduce(mix64(x + np.arange(len(x)).astype(U64) * U64(0x9E3779B97F4A7C15)))]))[0].view(np.int64)) for x in lists]
                at = pa.array(keep + i)
                yield pa.RecordBatch.from_arrays([batch.column("web_id").take(at), pa.array(sig, pa.int64()), pa.array([len(x) for x in lists], pa.int32()), pa.array([x.tobytes() for x in lists], pa.binary())], ["web_id", "sig", "n_words", "words"])

    return emit


_BUILT: dict[str, ahocorasick.Automaton] = {}


def _automaton(shard: Shard) -> ahocorasick.Automaton:
    """The shard's automaton; a worker keeps the last one it built."""
    if shard.name not in _BUILT:
        _BUILT.clear()
        _BUILT[shard.name] = shard.automaton()
    return _BUILT[shard.name]


_FOUND = "train_id long, sig long, shared_runs long, runs long, covered_words long, eval_words long"


def _scan(wave: list[Broadcast], pieces: Broadcast | None, threshold: float, held_words: int):
    """Alike pairs of training records and the shards of a wave. A task reads its records once and
    holds so many of them that building each shard's automaton pays."""
    names = [c.split(" ")[0] for c in _FOUND.split(", ")]

    def over(lines: list[Line]) -> Iterator[pa.RecordBatch]:
        for shard in wave:
            index = shard.value
            if len(index.pattern):
                find = _automaton(index).iter
                for line in lines:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in line.overlaps(find, index, threshold)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[Line] = []
        for batch in batches:
            column = fill_content(batch.column("text"), batch.column("ids"), pieces.value) if pieces else batch.column("text")
            ids = batch.column("web_id").to_numpy()
            for i, j, part in slices(texts_of(column)):
                lines.append(Line(ids[i:j], part))
                if sum(x.words for x in lines) >= held_words:
                    yield from over(lines)
                    lines = []
        if lines:
            yield from over(lines)

    return scan


def cross_split_overlaps(
    records: DataFrame,
    vocab: DataFrame | None = None,
    *,
    evaluation: tuple[str, ...] = ("val", "test"),
    threshold: float = 0.5,
    shard_words: int = SHARD_WORDS,
    wave_words: int = WAVE_WORDS,
    held_words: int = HELD_WORDS,
) -> DataFrame:
    """(train_id, eval_id, shared_runs, runs, covered_words, eval_words), one row per alike pair of
    a training and an evaluation record.

    `records` has web_id, split, text and, with `vocab`, ids, which stand in where text is null.
    Two records of at least 20 words are alike if of the distinct runs of three words found in
    either at least `threshold` are found in both; `covered_words` counts the words of the
    evaluation record that lie in shared runs. Records without content, of fewer words, of a null
    id or of another or null split give nothing; rows of one web_id count once. Evaluation records
    of equal words are looked for once and reported each.

    The training records are read once per `wave_words` words of evaluation text, whatever the
    number of shards of `shard_words` in it; each shard's automaton goes over all of them.
    """
    spark = records.sparkSession
    rows = records.select(F.col("web_id").cast("long").alias("web_id"), "split", "text", *(["ids"] if vocab is not None else [])).where("web_id is not null")
    pieces = None
    if vocab is not None:
        pieces = vocabulary(vocab)
        if pieces is None:
            rows = joined_content(rows, vocab, "web_id").select("web_id", "split", "text")
    columns = [c for c in rows.columns if c != "split"]
    wanted = rows.where(F.col("split").isin(*evaluation)).select(*columns)
    held = spread(wanted).mapInArrow(_evaluation(pieces), "web_id long, sig long, n_words int, words binary").dropDuplicates(["web_id"])
    held = stage_table(held, "evaluation")
    train = spread(rows.where("split = 'train'").select(*columns))
    once = held.groupBy("sig", "n_words").agg(F.first("words").alias("words"))
    total = held.select("sig", "n_words").distinct().agg(F.sum("n_words")).first()[0] or 0
    waves = -(-total // wave_words) or 1
    shards = -(-total // (waves * shard_words)) or 1
    number = F.pmod(F.xxhash64("sig", "n_words"), F.lit(waves * shards))
    once = stage_table(once.withColumn("shard", number), "shards") if waves > 1 else once.withColumn("shard", number)
    found = None
    for k in range(waves):
        texts = once.where(F.floor(F.col("shard") / shards) == k).orderBy("shard", "sig", "n_words").toPandas()  # a wave of bounded size
        wave = [spark.sparkContext.broadcast(Shard(t["sig"].tolist(), [np.frombuffer(x, U64) for x in t["words"]], threshold)) for _, t in texts.groupby("shard")]
        part = train.mapInArrow(_scan(wave, pieces, threshold, held_words), _FOUND)
        found = part if found is None else found.unionByName(part)
    own = held.select("sig", F.col("n_words").cast("long").alias("eval_words"), F.col("web_id").alias("eval_id"))
    pairs = found.dropDuplicates(["train_id", "sig", "eval_words"]).join(own, ["sig", "eval_words"])
    return pairs.select("train_id", "eval_id", "shared_runs", "runs", "covered_words", "eval_words")


def overlap_report(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(split, source, n_pairs, n_records): pairs and distinct evaluation records per evaluation
    split and source; a null source is a group of its own."""
    where = records.where("web_id is not null and split is not null").select(F.col("web_id").alias("eval_id"), "split", "source").dropDuplicates(["eval_id"])
    return pairs.join(where, "eval_id").groupBy("split", "source").agg(F.count("*").alias("n_pairs"), F.countDistinct("eval_id").alias("n_records"))
