import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import bpe, scalars
from tokenloom.operators import blocks, positions, runs, scoring, splits, vocab
from tokenloom.session import stage_table
from tokenloom.sources import checkpoint, corpus, tokenbin


# ---------------------------------------------------------------- splits
@pytest.mark.parametrize(
    "names, val, test, want",
    [
        ("train val", "val", None, ("train", "val", None, False)),
        ("train dev test", "dev", None, ("train", "dev", None, False)),  # a named val takes no implicit test
        ("train dev test", "dev", "test", ("train", "dev", "test", False)),
        ("train validation test", None, None, ("train", "validation", "test", False)),
        ("train val validation", None, None, ("train", "validation", None, False)),
        ("train val", "missing", None, ("train", "val", None, False)),
        ("train test", None, None, ("train", "train", "test", True)),
        ("train held", None, "held", ("train", "train", "held", True)),
        ("train", None, None, ("train", "train", None, True)),
        ("data", None, None, ("data", "data", None, True)),
    ],
)
def test_split_branches(names, val, test, want):
    assert corpus.resolve_splits(names.split(), "train", val, test) == want


def test_splits_that_cannot_be_told():
    with pytest.raises(ValueError, match="name them"):
        corpus.resolve_splits(["a", "b"])
    with pytest.raises(ValueError, match="name them"):
        corpus.resolve_splits([])


def test_fraction_split_is_exact_disjoint_and_stable(spark):
    rows = spark.range(1001).withColumnRenamed("id", "doc_id")
    a = dict(splits.fraction_split(rows, val_size=0.1).collect())
    b = dict(splits.fraction_split(rows.repartition(7).unionByName(rows), val_size=0.1).collect())
    assert a == b and len(a) == 1001
    assert sum(v == "val" for v in a.values()) == math.ceil(1001 * 0.1)
    assert splits.fraction_split(rows.limit(0)).count() == 0


def test_apply_plan_cuts_train_and_keeps_test(spark):
    rows = spark.createDataFrame([(i, "train" if i < 20 else "test" if i < 25 else None, "x") for i in range(30)], "doc_id long, split string, text string")
    out = splits.apply_plan(rows, corpus.resolve_splits(["train", "test"]), val_size=0.1)
    assert dict(map(tuple, out.groupBy("split").count().collect())) == {"train": 18, "val": 2, "test": 5}


def test_head_tail_by_code_points(spark):
    rows = spark.createDataFrame([(1, "0123456789"), (2, "é木🙂x"), (3, ""), (4, None)], "doc_id int, text string")
    got = {r.doc_id: (r["head"], r["tail"]) for r in splits.head_tail(rows).collect()}
    assert got == {1: ("012345678", "9"), 2: ("é木🙂", "x"), 3: ("", ""), 4: (None, None)}


def test_missing_column_names_the_split(spark):
    with pytest.raises(ValueError, match="'train' has no column 'text'; it has id"):
        corpus.require_column(spark.range(1), "text", "train")


def test_text_corpus_translates_line_ends(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a\r\nb\rc\n")
    assert corpus.read_text_corpus(spark, str(tmp_path)).first()["text"] == "a\nb\nc\n"
    spark.createDataFrame([("x",)], "body string").write.json(str(tmp_path / "j"))
    assert corpus.read_corpus(spark, str(tmp_path / "j"), "json", "body").columns == ["text"]


# ---------------------------------------------------------------- positions
def test_offsets_ranks_and_shards_match_lists(spark):
    sizes = [(i * 7 % 101, i % 5) for i in range(101)]
    rows = spark.createDataFrame(sizes, "k int, n int")
    want, total = {}, 0
    for k, n in sorted(sizes):
        want[k], total = total, total + n
    assert {r.k: r.start for r in positions.running_offsets(rows, "k", "n").collect()} == want
    shards = {r.k: r.shard for r in positions.contiguous_shards(rows, "k", 7).collect()}
    assert [shards[k] for k in range(101)] == [i for i in range(7) for _ in range(15 if i < 3 else 14)]
    few = {r.k: r.shard for r in positions.contiguous_shards(rows.where("k < 3"), "k", 7).collect()}
    assert few == {0: 0, 1: 1, 2: 2}
    assert sorted(r["rank"] for r in positions.hash_rank(rows, "k", 1).collect()) == list(range(1, 102))


# ---------------------------------------------------------------- vocabulary
def test_vocabulary_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "héé\r\n🙂"), (2, ""), (3, None), (4, "áz")], "doc_id int, text string")
    v = vocab.char_vocabulary(rows)
    chars = sorted(set("héé\r\n🙂áz"))
    assert [(r.ch, r.id) for r in v.orderBy("id").collect()] == [(c, i) for i, c in enumerate(chars)]
    back = {r.doc_id: (r.ids, r.decoded) for r in vocab.char_decode(vocab.char_encode(rows, v), v).collect()}
    assert back[1] == ([chars.index(c) for c in "héé\r\n🙂"], "héé\r\n🙂")
    assert back[2] == ([], "") and back[3] == (None, None) and back[4][1] == "áz"
    other = spark.createDataFrame([("q",)], "text string")
    with pytest.raises(Exception, match="not in the vocabulary"):
        vocab.char_encode(other, v).collect()
    assert vocab.char_encode(other, v, strict=False).first()["ids"] == [None]
    vocab.save_vocabulary(v, str(tmp_path))
    assert vocab.load_vocabulary(spark, str(tmp_path)).count() == len(chars)


# ---------------------------------------------------------------- blocks
def stream(spark, arrays):
    return blocks.placed_stream(spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "doc_id long, ids array<int>"))


@pytest.mark.parametrize("lengths", [[4], [5], [0, 23, 0], [3, 1, 9, 2, 17], [1] * 9])
def test_blocks_and_windows_match_lists(spark, lengths):
    b = 4
    flat = list(range(sum(lengths)))
    arrays, at = [], 0
    for n in lengths:
        arrays.append(flat[at : at + n])
        at += n
    placed = stream(spark, [*arrays, None])
    got = sorted((r.block_id, r.x, r.y) for r in blocks.pack_blocks(placed, b).collect())
    assert got == [(j, flat[j * b : j * b + b], flat[j * b + 1 : j * b + b + 1]) for j in range((len(flat) - 1) // b)]
    pairs = {(r.x, r.y): r.n for r in blocks.next_token_counts(placed).collect()}
    assert pairs == {(i, i + 1): 1 for i in range(len(flat) - 1)}
    if len(flat) > b:
        starts = blocks.sample_starts(spark, 3, 4, len(flat), b)
        rows = blocks.windows_at(placed, starts, b).collect()
        assert len(rows) == 12
        assert all(r.x == flat[r.start : r.start + b] and r.y == flat[r.start + 1 : r.start + b + 1] for r in rows)


def test_full_batches_limits(spark):
    exact = blocks.pack_blocks(stream(spark, [list(range(4 * 2 + 1))]), 4)
    assert blocks.full_batches(exact, 4, 2).count() == 2
    with pytest.raises(Exception, match="need at least 9 tokens"):
        blocks.full_batches(blocks.pack_blocks(stream(spark, [list(range(8))]), 4), 4, 2).collect()
    with pytest.raises(Exception, match="need at least 9 tokens"):
        blocks.full_batches(blocks.pack_blocks(stream(spark, [[1]]), 4), 4, 2).collect()
    ragged = blocks.pack_blocks(stream(spark, [list(range(13))]), 4)
    assert blocks.full_batches(ragged, 4, 2).count() == 2
    assert blocks.full_batches(ragged, 4, 2, full_coverage=True).count() == 3


def test_sampler_needs_a_window_and_depends_on_rank(spark):
    with pytest.raises(ValueError):
        blocks.sample_starts(spark, 1, 1, 1024)
    a = [r.start for r in blocks.sample_starts(spark, 2, 8, 10_000, rank=0).orderBy("step", "slot").collect()]
    b = [r.start for r in blocks.sample_starts(spark, 2, 8, 10_000, rank=1).orderBy("step", "slot").collect()]
    assert a != b and all(0 <= x < 10_000 - 1024 for x in a + b)


# ---------------------------------------------------------------- token files
def test_token_file_round_trip(spark, tmp_path):
    tokenbin.register(spark)
    ids = [0, 32767, 32768, 50256, 65535] * 40
    path = str(tmp_path / "a.bin")
    spark.createDataFrame(list(enumerate(ids)), "pos long, token_id long").repartition(5).write.format("tokenbin").option("dtype", "uint16").mode("append").save(path)
    assert np.fromfile(path, "<u2").tolist() == ids
    rows = spark.read.format("tokenbin").option("chunk", 33).load(path).orderBy("pos").collect()
    assert [r.token_id for r in rows] == ids
    part = spark.read.format("tokenbin").option("start", 3).option("stop", 7).load(path).orderBy("pos").collect()
    assert [(r.pos, r.token_id) for r in part] == list(enumerate(ids))[3:7]
    assert json.load(open(path + ".json")) == {"dtype": "uint16", "tokens": 200}
    with pytest.raises(Exception, match="holds uint16"):
        spark.read.format("tokenbin").option("dtype", "uint32").load(path).count()
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([(0, 65536)], "pos long, token_id long").write.format("tokenbin").mode("append").save(str(tmp_path / "b.bin"))
    with pytest.raises(Exception, match="places"):
        spark.createDataFrame([(1, 5)], "pos long, token_id long").write.format("tokenbin").mode("append").save(str(tmp_path / "c.bin"))
    assert not os.path.exists(tmp_path / "c.bin")


def test_token_file_takes_arrays(spark, tmp_path):
    tokenbin.register(spark)
    arrays = [[5, 6], [], [7], None, [8, 9, 65535], [1] * 50]
    placed = blocks.placed_stream(spark.createDataFrame([(i, a) for i, a in enumerate(arrays)] * 2, "doc_id long, ids array<int>"), distinct=True)
    path = str(tmp_path / "a.bin")
    placed.select("start", "ids").repartition(3).write.format("tokenbin").mode("append").save(path)
    assert np.fromfile(path, "<u2").tolist() == [t for a in arrays for t in a or []]
    for bad, message in (([(0, [1, 70_000])], "does not fit"), ([(0, [1, None])], "does not fit"), ([(1, [5])], "places"), ([(0, [5, 6]), (1, [7])], "places")):
        with pytest.raises(Exception, match=message):
            spark.createDataFrame(bad, "start long, ids array<int>").write.format("tokenbin").mode("append").save(str(tmp_path / "b.bin"))
    spark.createDataFrame([], "start long, ids array<int>").write.format("tokenbin").mode("append").save(str(tmp_path / "c.bin"))
    assert os.path.getsize(tmp_path / "c.bin") == 0


def test_dtype_choice(spark):
    values = [None, 0, 65535, 65536, 2**32 - 1, 2**32]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "m long").select(scalars.dtype_choice(F.col("m"))).collect()]
    assert got == [tokenbin.dtype_for(v) for v in values] == ["uint32", "uint16", "uint16", "uint32", "uint32", "uint64"]


# ---------------------------------------------------------------- encoding and content
def test_bpe_projection(spark):
    rows = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id int, text string")
    got = {r.doc_id: (r.ids, r.len) for r in bpe.encode_text(rows).collect()}
    assert got[1] == ([15496, 995], 2) and got[2] == ([], 0) and got[3] == (None, 0) and got[4][1] == 7
    ended = {r.doc_id: r.ids for r in bpe.encode_text(rows, append_eot=True).collect()}
    assert ended[1] == [15496, 995, 50256] and ended[2] == [50256] and ended[3] is None
    with pytest.raises(ValueError, match="unknown encoding"):
        bpe.encode_text(rows, encoding="none")
    assert bpe.max_token("byte_bpe_50k") == 50256


# ---------------------------------------------------------------- scoring
def test_perplexity_of_simple_scorers(spark):
    b = blocks.pack_blocks(stream(spark, [list(range(33))]), 4)
    for parts in (1, 3):
        out = scoring.perplexity(scoring.score_blocks(b.repartition(parts), scoring.create_scorer("uniform", 77))).first()
        assert out.total_tokens == 32 and out.perplexity == pytest.approx(77)
    assert scoring.perplexity(scoring.score_blocks(b.limit(0), scoring.Uniform(5))).first().perplexity is None
    with pytest.raises(ValueError, match="registered"):
        scoring.create_scorer("none")


def test_logit_scorer_agrees_with_the_expression(spark):
    rng = np.random.default_rng(1)
    table = rng.normal(size=(11, 11))
    x, y = rng.integers(0, 11, (2, 5)), rng.integers(0, 11, (2, 5))
    nll = scoring.Logits(lambda ids: table[ids], 11).score(x, y)
    rows = spark.createDataFrame([(table[a].tolist(), int(b)) for a, b in zip(x.ravel(), y.ravel())], "z array<double>, t int")
    got = [r[0] for r in rows.select(scoring.softmax_nll(F.col("z"), F.col("t"))).collect()]
    assert nll.ravel() == pytest.approx(got)
    with pytest.raises(ValueError, match="gives 11 logits"):
        scoring.Logits(lambda ids: table[ids], 12).score(x, y)
    ignored = spark.createDataFrame([(0, [1, 2], [2, -1])], "block_id long, x array<int>, y array<int>")
    assert scoring.score_blocks(ignored, scoring.Uniform(10)).first().n_targets == 1


def saved_model():
    table = np.random.default_rng(2).normal(size=(11, 3)).astype(np.float32)
    return checkpoint.Checkpoint({"vocab_size": 11}, {"betas": [0.9, 0.95]}, {"tokens": table}, {"tokens.m": table * 0})


def test_checkpoints_are_saved_read_and_scored(spark, tmp_path):
    saved = saved_model()
    path = checkpoint.save_checkpoint(str(tmp_path), "run", saved, 7.5, "Tied", "A B")
    assert path == "run/007.5000val_loss_Tied_AB.pt" and os.listdir(tmp_path / "run") == [path[4:]]
    back = checkpoint.load_checkpoint(str(tmp_path), path)
    assert back.model_config == saved.model_config and back.optimizer_config == saved.optimizer_config
    assert (back.model_state["tokens"] == saved.model_state["tokens"]).all() and list(back.optimizer_state) == ["tokens.m"]
    assert checkpoint.save_checkpoint(str(tmp_path), "run", saved, 7.5, "Tied") == "run/007.5000val_loss_Tied_N-A.pt"
    for bad in ("x.pt", "a/b/c", "../x", "/x"):
        with pytest.raises(ValueError, match="not folder/file"):
            checkpoint.load_checkpoint(str(tmp_path), bad)
    rows = spark.createDataFrame([(i, [i % 11, 3], [3, (i * 7) % 11]) for i in range(20)], "block_id long, x array<int>, y array<int>")
    far = scoring.create_scorer("checkpoint", str(tmp_path), path, scoring.tied_embedding)
    near = scoring.tied_embedding(saved)
    got = [scoring.perplexity(scoring.score_blocks(rows.repartition(4), s)).first().perplexity for s in (far, near)]
    assert got[0] == pytest.approx(got[1])


def test_batches_are_stacked_in_block_order(spark):
    kept = blocks.full_batches(blocks.pack_blocks(stream(spark, [list(range(41))]), 4), 4, 3)
    got = {r.batch_id: (r.xs, r.ys) for r in blocks.stack_batches(kept.repartition(5)).collect()}
    assert sorted(got) == [0, 1, 2]
    assert got[1] == ([list(range(a, a + 4)) for a in (12, 16, 20)], [list(range(a + 1, a + 5)) for a in (12, 16, 20)])
    assert blocks.stack_batches(kept.limit(0)).count() == 0


# ---------------------------------------------------------------- runs
LOG = "run_id string, iter long, split string, loss double, lr double, dt_ms double, mfu double, logged_at timestamp"


def log_rows(spark, values, split="val"):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("r", i, split, v, 1e-3, 10.0, v, t) for i, v in values], LOG)


def test_best_losses_with_resets(spark):
    values = [(0, 9.0), (50, 5.0), (250, 6.0), (300, 5.5), (350, None), (400, float("nan"))]
    got = runs.best_losses(log_rows(spark, values + values[:2])).first()
    assert (got.best_so_far, got.kept_best) == (5.0, 5.5)
    assert runs.best_losses(log_rows(spark, [])).count() == 0


def test_running_utilisation(spark):
    values = [(i * 50, 0.1 * i) for i in range(8)]
    want, m = [], -1.0
    for k, (_, v) in enumerate(values):
        m = -1.0 if k < 5 else v if m == -1.0 else 0.9 * m + 0.1 * v
        want.append(m)
    got = [r.running_mfu for r in runs.mfu_average(log_rows(spark, values, "train")).orderBy("iter").collect()]
    assert got == pytest.approx(want)


def test_running_utilisation_of_many_runs_and_a_full_one(spark):
    from pyspark.sql import functions as F

    rnd = np.random.default_rng(3)
    runs_ = {f"r{k}": np.where(rnd.random(n) < 0.2, -1.0, rnd.random(n)) for k, n in enumerate((1, 4, 5, 6, 63, 64, 65, 300))}
    rows = [(r, i, "train", 1.0, 1e-3, 10.0, float(v), None) for r, vs in runs_.items() for i, v in enumerate(vs)]
    got = {}
    for r in runs.mfu_average(spark.createDataFrame(rows, LOG)).orderBy("run_id", "iter").collect():
        got.setdefault(r.run_id, []).append(r.running_mfu)
    for name, vs in runs_.items():
        want, m = [], -1.0
        for k, v in enumerate(vs):
            m = -1.0 if k < 5 else v if m == -1.0 else 0.9 * m + 0.1 * v
            want.append(m)
        assert got[name] == pytest.approx(want)
    full = spark.range(600_001).select(F.lit("r").alias("run_id"), F.col("id").alias("iter"), F.lit("train").alias("split"), F.lit(1.0).alias("loss"), F.lit(0.1).alias("lr"), F.lit(1.0).alias("dt_ms"), F.lit(0.5).alias("mfu"), F.lit(None).cast("timestamp").alias("logged_at"))
    with runs.stopwatch() as took:
        assert runs.mfu_average(full).where("running_mfu between 0.4999999 and 0.5000001").count() == 600_001 - 5
    assert took["seconds"] < 60


def test_steps_times_and_tokens(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([("r", i, s, 1.0, 0.1, 1.0, 0.5, t + dt.timedelta(seconds=i * 2 + k)) for i in (0, 3, 7) for k, s in enumerate(("train", "val"))] + [("q", None, "val", 1.0, 0.1, 1.0, 0.5, None)], LOG)
    got = {r.iter: (r.seconds, r.elapsed) for r in runs.step_times(log).collect()}
    assert got == {0: (None, 0.0), 3: (6.0, 6.0), 7: (8.0, 14.0)}
    assert {r.run_id: r.tokens for r in runs.tokens_seen(log.unionByName(log), 10).collect()} == {"r": 30, "q": 0}
    steps = runs.training_steps(spark, 1.0, 500)
    assert steps.count() == 501 and steps.agg(F.max("iter")).first()[0] == 500 and steps.where("saves").count() == 2 and steps.where("evaluates").count() == 11
    past = runs.training_steps(spark, 1.0, 20, warmup=5, decay=10, floor=0.25).where("iter > 10")
    assert past.count() == 10 and past.where("lr = 0.25").count() == 10


def test_tables_that_grow_by_appends(spark, tmp_path):
    path = str(tmp_path / "m")
    runs.append_metrics(log_rows(spark, [(1, 2.0)]), path)
    runs.append_metrics(spark.createDataFrame([("r", 2, 1.5)], "run_id string, iter int, loss float"), path)
    got = {r.iter: r for r in spark.read.parquet(path).collect()}
    assert got[1].loss == 2.0 and got[2].loss == 1.5 and got[2].lr is None and got[2].logged_at is not None
    with pytest.raises(ValueError, match="columns other are not"):
        runs.append_metrics(spark.createDataFrame([(1,)], "other int"), path)
    runs.append_checkpoints(spark.createDataFrame([(1, "f/a.pt", 2.5)], "ckpt_id long, path string, val_loss double"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).first().saved_at is not None


def test_schedule_and_names(spark):
    its = [0, 199, 200, 300_000, 600_000, 600_001]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in its], "i long").select(scalars.learning_rate(F.col("i"), 6e-4)).collect()]
    want = [6e-4 / 201, 6e-4 * 200 / 201, 6e-4, 6e-5 + 0.5 * (1 + math.cos(math.pi * (300_000 - 200) / 599_800)) * 5.4e-4, 6e-5, 6e-5]
    assert got == pytest.approx(want)
    row = spark.createDataFrame([(5.5, "M", "a b c"), (5.5, "M", None)], "l double, m string, a string")
    assert [r[0] for r in row.select(scalars.checkpoint_name(F.col("l"), F.col("m"), F.col("a"))).collect()] == ["005.5000val_loss_M_abc.pt", "005.5000val_loss_M_N/A.pt"]
    with pytest.raises(Exception, match="not folder/file"):
        spark.createDataFrame([("a/b/c",)], "p string").select(scalars.folder_and_file(F.col("p"))).collect()


def test_retention_puts_unknown_losses_last(spark):
    rows = spark.createDataFrame([(1, "b", 2.0), (2, "a", 2.0), (3, "c", None), (4, "d", 1.0)], "ckpt_id long, path string, val_loss double")
    got = {r.ckpt_id: (r.place, r.retained) for r in runs.retention(rows, 2).collect()}
    assert got == {4: (1, True), 2: (2, True), 1: (3, False), 3: (4, False)}


def test_configs_groups_and_states(spark, tmp_path):
    assert runs.ordered_config('{"author": "x", "b": 1, "a": 2}') == ([1, 2], {"author": "x"})
    assert runs.ordered_config('{"b": 1}') == ([1], {"author": "N/A"})
    assert runs.tokens_per_iteration(16, 1, 12, 1024) == 196_608
    with pytest.raises(ValueError):
        runs.tokens_per_iteration(16, 3, 12, 1024)
    p = spark.createDataFrame([("w", [10, 20], True, None), ("b", [20], True, None), ("f", [5], False, None), ("t", [10, 20], True, "w")], "name string, shape array<bigint>, requires_grad boolean, tied_to string")
    assert tuple(runs.parameter_groups(p, 224).first()) == (225, 220, 200, 20, True)
    assert tuple(runs.parameter_groups(p.limit(0)).first()) == (0, 0, 0, 0, False)
    assert tuple(runs.parameter_groups(p.withColumn("k", F.lit(1)), 226, "k").first()) == (1, 225, 220, 200, 20, False)
    assert runs.start_state(False, "f/c.pt", {}, {"model_config": {"a": 1}, "iter": 7}) == {"config": {"a": 1}, "iter": 7, "resumed": "f/c.pt"}
    with pytest.raises(ValueError):
        runs.start_state(False, None, {}, None)
    (tmp_path / "x.pt").write_bytes(b"abc")
    assert runs.checkpoint_folder(spark, str(tmp_path)).first()["bytes"] == 3


def test_streamed_losses(spark, tmp_path):
    from tokenloom.streaming import read_log_stream, windowed_losses

    rows = log_rows(spark, [(0, 2.0), (50, 4.0), (50, 4.0), (100, float("nan"))])
    rows.coalesce(1).write.parquet(str(tmp_path / "log"))
    q = windowed_losses(read_log_stream(spark, str(tmp_path / "log"), LOG)).writeStream.outputMode("complete").format("memory").queryName("losses").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("losses").first()
    assert got.mean_loss == 3.0 and got.n == 2


def test_staged_tables_are_read_back(spark):
    df = spark.range(5)
    assert sorted(stage_table(df, "t").collect()) == df.collect()
