import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from tokenloom.llm.spans import texts_of, words
from tokenloom.llm import crosssplit, sharedspans

LOW = {i: i + 32 for i in range(65, 91)}


# ---------------------------------------------------------------- shared spans
def brute_spans(docs, n):
    docs = {d: t for d, t in docs if d is not None and t is not None}
    where = {}
    for d, t in docs.items():
        for k in range(len(t) - n + 1):
            where.setdefault(t[k : k + n], set()).add(d)
    out = set()
    for d, t in docs.items():
        cur = None
        for k in range(len(t) - n + 1):
            if len(where[t[k : k + n]]) > 1:
                if cur and k <= cur[1]:
                    cur[1] = k + n
                else:
                    if cur:
                        out.add((d, *cur))
                    cur = [k, k + n]
        if cur:
            out.add((d, *cur))
    return out


def span_docs():
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdefghij é木🙂\n") for _ in range(n))
    passages = [text(rnd.randint(25, 300)) for _ in range(12)]
    docs = []
    for i in range(60):
        parts = [text(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p) // 2)
            parts += [p[a : a + rnd.randint(10, 400)], text(rnd.randint(0, 40))]
        docs.append((i, "".join(parts)))
    run = "z" * 700
    docs += [(100, run), (101, "x" + run[:200] + "y"), (102, docs[3][1]), (103, docs[3][1]), (104, docs[3][1] + "!"), (105, None), (106, ""), (107, "short"), (108, passages[0] * 3), (None, passages[0])]
    return docs


@pytest.mark.parametrize("span, gram, block, crowd, pack", [(30, 10, 20_000, 64, 10**6), (30, 10, 0, 64, 200), (30, 30, 3, 2, 10**6), (60, 7, 20_000, 1, 50), (30, 10, 20_000, 0, 100)])
def test_spans_match_brute_force(spark, span, gram, block, crowd, pack):
    docs = span_docs()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs + docs[:5]], "doc_id long, text string, span_start int, tid int")
    got = sharedspans.shared_spans(df, span, gram, block, crowd, pack).collect()
    assert sorted((r.doc_id, r.span_start, r.span_end) for r in got) == sorted(brute_spans(docs, span))


def other_text(rows, least):
    """For each place of each text the longest stretch from there that stands in another."""
    return [[max([n for n in range(least, len(t) - k + 1) if any(t[k : k + n] in u for j, u in enumerate(rows) if j != i)], default=0) for k in range(len(t))] for i, t in enumerate(rows)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé🙂", min_size=1, max_size=40), min_size=1, max_size=5))
def test_factors_are_greedy_and_longest(rows):
    ref = sharedspans.Reference(pa.array(rows, pa.string()), np.arange(len(rows)), 4)
    want, best = [], other_text(rows, 4)
    for i, t in enumerate(rows):
        k = 0
        while k < len(t):
            if best[i][k]:
                want.append((i, k, k + best[i][k]))
            k += best[i][k] or 1
    row, begin, end = sharedspans.greedy_factors(ref)
    assert [(r, b - ref.p.offs[r], e - ref.p.offs[r]) for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist())] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=60), min_size=1, max_size=4))
def test_factors_and_their_limits_give_every_shared_window(rows):
    got = sharedspans._factor_block(np.arange(len(rows)), np.zeros(len(rows), np.int64), pa.array(rows, pa.string()), 12)
    mine = {(t, k) for t, a, b in zip(*(c.to_pylist() for c in got.columns)) for k in range(a, b)}
    best = other_text(rows, 12)
    assert mine == {(i, k + j) for i, b in enumerate(best) for k, n in enumerate(b) if n for j in range(12)}


def test_the_parse_decides_the_rows(spark, monkeypatch):
    docs = pa.array(["xx" + "abcdefghijklmnop", "yy" + "abcdefghij", "zz" + "efghijklmnop"], pa.string())
    block = lambda: {(t, a, b) for t, a, b in zip(*(c.to_pylist() for c in sharedspans._factor_block(np.arange(3), np.zeros(3, np.int64), docs, 12).columns))}
    whole = block()
    assert (0, 6, 18) in whole  # begins inside a factor of ten characters and is found across its end
    monkeypatch.setattr(sharedspans, "windows_across", lambda *a: np.zeros(0, np.int64))
    assert (0, 6, 18) not in block()
    monkeypatch.setattr(sharedspans, "greedy_factors", lambda ref: (np.zeros(0, np.int64),) * 3)
    assert not block() and (2, 2, 14) in whole


def test_coverage_has_every_document(spark):
    docs = span_docs()
    df = spark.createDataFrame([(d, t) for d, t in docs], "doc_id long, text string")
    got = {r.doc_id: r for r in sharedspans.shared_coverage(df, span=30, gram=10).collect()}
    assert set(got) == {d for d, _ in docs if d is not None}
    assert got[102].shared_share == 1.0 and got[105].n_chars is None and got[105].shared_chars == 0 and got[106].shared_share == 0.0
    assert sharedspans.shared_spans(df.limit(0)).count() == 0


def test_copies_of_a_long_text(spark):
    t = "".join(random.Random(1).choices("abcdefgh ", k=200_000))
    df = spark.createDataFrame([(i, t) for i in range(30)] + [(99, "q" + t[1000:1400])], "doc_id long, text string")
    got = {r.doc_id: (r.span_start, r.span_end) for r in sharedspans.shared_spans(df).collect()}
    assert got == {i: (0, 200_000) for i in range(30)} | {99: (1, 401)}


# ---------------------------------------------------------------- cross-split
def runs(text):
    w = re.findall("[a-z0-9]+", text.translate(LOW))
    return set(zip(w, w[1:], w[2:])), len(w)


def split_data():
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(900)]
    rows, n = [], 0
    for _ in range(40):
        base = rnd.choices(vocab, k=rnd.choice([20, 45, 160]))
        for _ in range(rnd.randint(1, 4)):
            own = list(base)
            for _ in range(len(own) // rnd.choice([10, 14, 40])):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            rows.append((n, rnd.choice(["train", "train", "val", "test", None]), " ".join(own), None))
            n += 1
    common = "this phrase stands in nearly every record of the whole table "
    rows = [(a, s, common + t if a % 2 else t, i) for a, s, t, i in rows]
    rows += [(900, "train", None, [0, 1, 50256]), (901, "val", None, [1, 0]), (902, "val", None, None), (903, "test", "", None), (904, "train", "a b c", None), (None, "val", rows[0][2], None)]
    rows += [(910 + i, "val", "copy " * 3 + common * 2, None) for i in range(5)] + [(920 + i, "train", common * 2 + "copy", None) for i in range(4)]
    pieces = [(0, " ".join(vocab[:30])), (1, " " + " ".join(vocab[30:60]) + " "), (50256, "<end>")]
    return rows, pieces


def brute_overlaps(rows, pieces):
    p = dict(pieces) | {50256: ""}
    sets = {}
    for w, s, t, ids in rows:
        if w is not None and (t is not None or ids is not None):
            r, n = runs(t if t is not None else "".join(p[i] for i in ids))
            if n >= 20:
                sets[w] = (s, r)
    out = set()
    for (a, (s, x)), (b, (z, y)) in itertools.product(sets.items(), repeat=2):
        if s == "train" and z in ("val", "test") and 2 * len(x & y) >= len(x | y):
            out.add((a, b))
    return out


@pytest.mark.parametrize("shard, wave, held", [(1_500_000, 6_000_000, 4_000_000), (400, 6_000_000, 300), (400, 1500, 1)])
def test_overlaps_match_brute_force(spark, shard, wave, held):
    rows, pieces = split_data()
    df = spark.createDataFrame([(*r, "s", 1) for r in rows + rows[:30]], "web_id long, split string, text string, ids array<int>, source string, train_id int")
    voc = spark.createDataFrame(pieces, "token_id int, piece string")
    pairs = crosssplit.cross_split_overlaps(df, voc, shard_words=shard, wave_words=wave, held_words=held).cache()
    want = brute_overlaps(rows, pieces)
    assert {(r.train_id, r.eval_id) for r in pairs.collect()} == want and pairs.count() == len(want) > 25
    assert all(r.covered_words <= r.eval_words and r.shared_runs <= r.runs for r in pairs.collect())
    report = crosssplit.overlap_report(pairs, df).collect()
    assert sum(r.n_pairs for r in report) == len(want)


def covered_by_hand(train, text):
    have, w = runs(train)[0], re.findall("[a-z0-9]+", text.translate(LOW))
    inside = {k + j for k in range(len(w) - 2) if tuple(w[k : k + 3]) in have for j in range(3)}
    return len(inside), len(w)


def test_coverage_is_that_of_merged_intervals(spark):
    rows, _ = split_data()
    text = {w: t for w, _, t, _ in rows}
    df = spark.createDataFrame([r[:3] for r in rows], "web_id long, split string, text string")
    pairs = crosssplit.cross_split_overlaps(df).collect()
    assert len(pairs) > 25
    for r in pairs:
        a, b = runs(text[r.train_id])[0], runs(text[r.eval_id])[0]
        assert (r.shared_runs, r.runs) == (len(a & b), len(a | b))
        assert (r.covered_words, r.eval_words) == covered_by_hand(text[r.train_id], text[r.eval_id])


def test_fifty_shards_read_the_training_records_once(spark, tmp_path):
    rows = [(i, "val" if i % 2 else "train", " ".join(f"w{(i // 2 * 7 + k) % 997}" for k in range(40))) for i in range(200)]
    spark.createDataFrame(rows, "web_id long, split string, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    pairs = crosssplit.cross_split_overlaps(df, shard_words=80)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    got = {(r.train_id, r.eval_id) for r in pairs.collect()}
    assert got == brute_overlaps([(*r, None) for r in rows], []) and len(got) >= 100


def test_the_automaton_decides_the_pairs():
    text = " ".join(f"w{k}" for k in range(40))
    line = crosssplit.Line(np.array([1]), texts_of(pa.array([text])))
    shard = crosssplit.Shard([7], [words(texts_of(pa.array([text + " more"]))).hash], 0.5)
    assert [x.tolist() for x in line.overlaps(shard.automaton().iter, shard, 0.5)] == [[1], [7], [38], [39], [40], [41]]
    assert not len(line.overlaps(lambda text: iter(()), shard, 0.5)[0])


def test_no_evaluation_or_no_training_records(spark):
    df = spark.createDataFrame([(1, "train", "a " * 30)], "web_id long, split string, text string")
    assert crosssplit.cross_split_overlaps(df).count() == 0
    assert crosssplit.cross_split_overlaps(df.limit(0)).count() == 0
