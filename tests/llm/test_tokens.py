import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tokenloom.llm import packing, tokenization

tiktoken = pytest.importorskip("tiktoken")
RANKS = tokenization.read_ranks(tokenization.VOCABULARIES + "/byte_bpe_50k.tiktoken")
OWN = tokenization.Encoder(RANKS)
PEER = tiktoken.Encoding("peer", pat_str=tokenization.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="aeinrst -'d\n\r\t", max_size=60), st.none()), max_size=6))
def test_encoding_equals_the_public_tokenizer(texts):
    ids, offs = OWN.encode_batch(texts)
    for i, t in enumerate(texts):
        assert ids[offs[i] : offs[i + 1]].tolist() == (PEER.encode_ordinary(t) if t else [])


def test_random_token_strings():
    rnd = random.Random(1)
    tokens = list(RANKS)
    texts = [b"".join(rnd.choices(tokens, k=rnd.randint(1, 8))).decode("utf-8", "ignore") for _ in range(5000)]
    texts += ["-" * 3000, " " * 2000, "a" * 2500, "<|endoftext|>"]
    ids, offs = OWN.encode_batch(texts)
    assert all(ids[offs[i] : offs[i + 1]].tolist() == PEER.encode_ordinary(t) for i, t in enumerate(texts))


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokenization, "CACHE_WORDS", 3)
    e = tokenization.Encoder({k: v for k, v in RANKS.items()})
    for t in ("one two three four five", "five six one", "two"):
        assert e.encode_batch([t])[0].tolist() == PEER.encode_ordinary(t)


def test_nulls_empties_and_repeated_rows(spark):
    rows = [(1, "Hello world", 5), (2, "", 5), (3, None, 5), (1, "Hello world", 5), (None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in tokenization.encode(df).collect()), key=repr)
    assert got == sorted([(1, [15496, 995]), (2, []), (3, None), (1, [15496, 995]), (None, [87])], key=repr)
    counts = {r.doc_id: r.n_tokens for r in tokenization.token_counts(df).collect()}
    assert counts[1] == 2 and counts[2] == 0 and counts[3] is None
    assert tokenization.encode(df.limit(0)).count() == 0


# ---------------------------------------------------------------- packing
def used(plan):
    out = {}
    for p in plan:
        for s in p.sizes:
            out[s] = out.get(s, 0) + p.times
    return out


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_piece_once_and_no_container_overflows(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.choice([7, 64, 1024]))
    sizes = np.clip(rng.lognormal(np.log(cap / 4), 0.8, 4000).astype(int), 1, cap)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    plan = packing.plan_packing(histogram, cap)
    assert used(plan) == histogram
    assert all(sum(p.sizes) <= cap and p.times > 0 for p in plan)
    fewest = -(-sum(s * n for s, n in histogram.items()) // cap)
    assert sum(p.times for p in plan) <= fewest * 1.02 + 1


def test_plan_limits():
    assert packing.plan_packing({}, 10) == []
    assert sum(p.times for p in packing.plan_packing({6: 5}, 10)) == 5
    assert used(packing.plan_packing({10: 3}, 10)) == {10: 3} and {p.sizes for p in packing.plan_packing({10: 3}, 10)} == {(10,)}
    with pytest.raises(ValueError):
        packing.plan_packing({11: 1}, 10)


def test_fillings_fill_the_window():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 129, 40))
    value = rng.random(129)
    columns = packing.fillings(value, lengths, 128, 5)
    total = columns.sum(1)
    assert ((total <= 128) & (total >= 126)).all() and len(np.unique(columns, axis=0)) == len(columns)
    assert np.isin(columns[columns > 0], lengths).all() and {2, 3, 4, 5} <= set((columns > 0).sum(1))
    best = {}  # of each number of lengths the filling worth most is found for each first one
    for k in (2, 3):
        for c in itertools.combinations_with_replacement(lengths.tolist(), k):
            if sum(c) == 128:
                for a in set(c):
                    best[k, a] = max(best.get((k, a), 0), sum(value[list(c)]))
    got = {}
    for c in columns:
        for a in set(c[c > 0].tolist()):
            got[(c > 0).sum(), a] = max(got.get(((c > 0).sum(), a), 0), value[c[c > 0]].sum())
    assert best and all(got[key] == pytest.approx(v, rel=1e-5) for key, v in best.items())


def test_least_squares_finds_an_exact_solution():
    columns = packing.fillings(np.ones(13), np.arange(1, 13), 12, 4)
    x = np.random.default_rng(1).integers(0, 9, len(columns)).astype(float)
    target = np.bincount(columns.ravel(), ((columns > 0) * x[:, None]).ravel(), 13)
    got, left = packing.non_negative_least_squares(columns, target, steps=5000, tol=1e-9)
    assert (got >= 0).all()
    assert np.bincount(columns.ravel(), ((columns > 0) * got[:, None]).ravel(), 13) == pytest.approx(target, abs=1e-3)
    assert left == pytest.approx(np.zeros(13), abs=1e-3)


def test_least_squares_places_most_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = np.clip(rng.lognormal(np.log(150), 0.9, 20_000).astype(int), 1, 1024)
    histogram = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    left_over = []
    greedy = packing._greedy
    monkeypatch.setattr(packing, "_greedy", lambda left, cap: left_over.append(int(left.sum())) or greedy(left, cap))
    plan = packing.plan_packing(histogram)
    fewest = -(-sum(s * n for s, n in histogram.items()) // 1024)
    assert used(plan) == histogram and sum(p.times for p in plan) <= fewest * 1.002 + 1
    assert max(left_over) < 0.5 * len(sizes) and min(left_over) < 0.2 * len(sizes)
    monkeypatch.setattr(packing, "non_negative_least_squares", lambda columns, target, *a, **k: (np.zeros(len(columns)), target))
    assert packing.plan_packing(histogram) != plan and left_over[-1] == len(sizes)


@pytest.mark.parametrize("bucket", [1_000_000, 50])
def test_every_piece_gets_one_container(spark, monkeypatch, bucket):
    monkeypatch.setattr(packing, "BUCKET", bucket)
    rnd = random.Random(1)
    rows = [(i, rnd.choice([None, 0, 1, 5, 9, 10, 11, 20, 37])) for i in range(400)]
    got = packing.pack(spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, n_tokens long, container int"), 10).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    fill = {}
    for d, n in rows:
        parts = sorted(by[d], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(max(1, -(-(n or 0) // 10))))
        assert sum(r.n_tokens for r in parts) == (n or 0)
        assert all(r.n_tokens == 10 for r in parts[:-1])
        for r in parts:
            assert (r.container is None) == (not n)
            if n:
                fill[r.container] = fill.get(r.container, 0) + r.n_tokens
    assert max(fill.values()) <= 10 and sorted(fill) == list(range(len(fill)))
    report = packing.packing_report(packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 10), 10).first()
    assert report.containers == len(fill) and report.fullest <= 10


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
