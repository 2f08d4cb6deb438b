"""Analytics of training runs and checkpoints."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalars import checkpoint_name, learning_rate

EVAL_EVERY, CHECKPOINT_EVERY, MAX_ITERS = 50, 250, 600_000


def clean_log(log: DataFrame) -> DataFrame:
    """One row per (run_id, iter, split): the latest logged, of equals the smallest loss; NaN losses become null."""
    loss = F.when(~F.isnan("loss"), F.col("loss"))
    return log.groupBy("run_id", "iter", "split").agg(*[F.max_by(c, F.struct("logged_at", -F.coalesce(loss, F.lit(1e300)))).alias(c) for c in ("lr", "dt_ms", "mfu")], F.max_by(loss, F.struct("logged_at", -F.coalesce(loss, F.lit(1e300)))).alias("loss"))


def loss_estimate(log: DataFrame) -> DataFrame:
    """(run_id, split, mean_loss, n): arithmetic mean of the losses that are numbers."""
    return clean_log(log).groupBy("run_id", "split").agg(F.avg("loss").alias("mean_loss"), F.count("loss").alias("n"))


def best_losses(log: DataFrame, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """(run_id, best_so_far, kept_best): the true minimum of the val losses, and the value that a
    loop keeps which also overwrites it, better or not, at each `every`-th iteration.

    The kept value is the least loss from the last such iteration on, no fold over the run.
    """
    val = clean_log(log).where("split = 'val' and loss is not null")
    last = val.groupBy("run_id").agg(F.max(F.when(F.col("iter") % every == 0, F.col("iter"))).alias("reset"))
    since = val.join(last, "run_id")
    return since.groupBy("run_id").agg(F.min("loss").alias("best_so_far"), F.min(F.when(F.col("iter") >= F.coalesce("reset", F.lit(0)), F.col("loss"))).alias("kept_best"))


def _exponential_mean(keep: float, skip: int, width: int = 64):
    """The mean of each run of a partition ordered by run and step, in blocks of `width` rows.

    Within a block the mean is a matrix product plus the fading mean before it; a run's state is
    carried from batch to batch.
    """
    place = np.arange(width)
    weight = np.where(place[:, None] >= place, (1 - keep) * keep ** np.maximum(place[:, None] - place, 0), 0.0)
    fade = keep ** (place + 1.0)

    def smooth(v: np.ndarray, mean: float) -> np.ndarray:
        out = np.empty(len(v))
        for a in range(0, len(v), width):
            n = min(width, len(v) - a)
            out[a : a + n] = weight[:n, :n] @ v[a : a + n] + fade[:n] * mean
            mean = out[a + n - 1]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, seen, mean = None, 0, -1.0
        for batch in batches:
            runs, value = batch.column("run_id").to_numpy(zero_copy_only=False), np.asarray(batch.column("mfu"), float)
            edge = np.append(np.flatnonzero(np.append(True, runs[1:] != runs[:-1])), len(runs)) if len(runs) else [0]
            out = np.full(len(runs), -1.0)
            for a, b in zip(edge[:-1], edge[1:]):
                if runs[a] != name or seen == 0:
                    name, seen, mean = runs[a], 0, -1.0
                first = a + max(0, skip - seen)  # rows before it only warm up
                if first < b:
                    while first < b and mean == -1.0:
                        mean = out[first] = value[first]
                        first += 1
                    if first < b:
                        out[first:b] = smooth(value[first:b], mean)
                        mean = float(out[b - 1])
                seen += b - a
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("iter"), pa.array(out)], ["run_id", "iter", "running_mfu"])

    return run


def mfu_average(log: DataFrame, keep: float = 0.9, skip: int = 5) -> DataFrame:
    """(run_id, iter, running_mfu): the exponential mean of the utilisation of a run's train rows.

    -1 for its first `skip` rows; then the first value, then keep * old + (1 - keep) * new. Runs
    are sorted by step and passed through once, so the work is linear and no run is held whole.
    """
    rows = clean_log(log).where("split = 'train' and mfu is not null").select("run_id", "iter", "mfu")
    ordered = rows.repartition("run_id").sortWithinPartitions("run_id", "iter")
    return ordered.mapInArrow(_exponential_mean(keep, skip), "run_id string, iter long, running_mfu double")


def evaluation_points(log: DataFrame, every: int = EVAL_EVERY) -> DataFrame:
    """Log rows of evaluation iterations."""
    return log.where(F.col("iter") % every == 0)


def retention(registry: DataFrame, keep: int = 50, *by: str) -> DataFrame:
    """(ckpt_id, by..., place, retained): the `keep` checkpoints of lowest loss stay, ties by path,
    unknown losses last."""
    order = Window.partitionBy(*by).orderBy(F.col("val_loss").asc_nulls_last(), "path", "ckpt_id")
    return registry.withColumn("place", F.row_number().over(order)).select("ckpt_id", *by, "place", (F.col("place") <= keep).alias("retained"))


def checkpoint_names(registry: DataFrame) -> DataFrame:
    """(ckpt_id, file_name); null where the loss is unknown."""
    name = checkpoint_name(F.col("val_loss"), F.col("model_name"), F.col("author"))
    return registry.select("ckpt_id", F.when(F.col("val_loss").isNotNull(), name).alias("file_name"))


def training_steps(spark: SparkSession, peak: float, max_iters: int = MAX_ITERS, **schedule: float) -> DataFrame:
    """(iter, lr, evaluates, saves) of steps 0 to `max_iters`, both included, as a loop that stops
    when its counter exceeds `max_iters` runs them."""
    it = F.col("id")
    saves = (it % CHECKPOINT_EVERY == 0) & (it > 0)
    return spark.range(0, max_iters + 1).select(it.alias("iter"), learning_rate(it, peak, **schedule).alias("lr"), (it % EVAL_EVERY == 0).alias("evaluates"), saves.alias("saves"))


def tokens_seen(log: DataFrame, per_iteration: int) -> DataFrame:
    """(run_id, n_iters, tokens): distinct iterations of a run, each of `per_iteration` tokens."""
    return log.groupBy("run_id").agg(F.count_distinct("iter").alias("n_iters")).withColumn("tokens", F.col("n_iters") * per_iteration)


def step_times(log: DataFrame) -> DataFrame:
    """(run_id, iter, seconds, elapsed): time since the run's previous logged step and since its first.

    A step is logged when its first row arrives; the first has no previous one.
    """
    steps = log.where("logged_at is not null").groupBy("run_id", "iter").agg(F.min("logged_at").alias("at"))
    order = Window.partitionBy("run_id").orderBy("iter")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    seconds = (micros(F.col("at")) - micros(F.lag("at").over(order))) / 1e6
    elapsed = (micros(F.col("at")) - micros(F.first("at").over(order))) / 1e6
    return steps.select("run_id", "iter", seconds.alias("seconds"), elapsed.alias("elapsed"))


@contextmanager
def stopwatch() -> Iterator[dict[str, float]]:
    """A dict whose `seconds` holds the elapsed time once the block is left."""
    out: dict[str, float] = {}
    began = time.perf_counter()
    try:
        yield out
    finally:
        out["seconds"] = time.perf_counter() - began


METRICS = "run_id string, iter long, split string, loss double, lr double, dt_ms double, mfu double, logged_at timestamp"
REGISTRY = "ckpt_id long, run_id string, path string, val_loss double, model_name string, author string, saved_at timestamp"


def append_metrics(rows: DataFrame, path: str) -> None:
    """Append log rows (a subset of the columns of `METRICS`, others null) to a metrics table.

    A row without a time gets the time of the append. Unknown columns raise before any job runs.
    """
    _append(rows, path, METRICS, "logged_at")


def append_checkpoints(rows: DataFrame, path: str) -> None:
    """Append saved checkpoints (a subset of the columns of `REGISTRY`, others null) to a registry table."""
    _append(rows, path, REGISTRY, "saved_at")


def _append(rows: DataFrame, path: str, schema: str, when: str) -> None:
    columns = [c.split(" ") for c in schema.split(", ")]
    unknown = set(rows.columns) - {c for c, _ in columns}
    if unknown:
        raise ValueError(f"columns {', '.join(sorted(unknown))} are not in ({schema})")
    value = {c: F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t) for c, t in columns}
    value[when] = F.coalesce(value[when], F.current_timestamp())
    rows.select(*[v.alias(c) for c, v in value.items()]).write.mode("append").parquet(path)


def parameter_groups(params: DataFrame, limit: int = 100_000_000, *by: str) -> DataFrame:
    """Totals over (by..., name, shape, requires_grad, tied_to): a tied tensor counts once; trainable
    tensors of two dimensions or more decay. `over_limit` reports, it does not stop."""
    numel = F.aggregate(F.col("shape"), F.lit(1).cast("bigint"), lambda a, b: a * b)
    one = params.where("tied_to is null").withColumn("numel", numel)
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("numel"))), F.lit(0))
    grad, wide = F.col("requires_grad"), F.size("shape") >= 2
    return one.groupBy(*by).agg(F.coalesce(F.sum("numel"), F.lit(0)).alias("total"), some(grad).alias("trainable"), some(grad & wide).alias("decayed"), some(grad & ~wide).alias("not_decayed")).withColumn("over_limit", F.col("total") > limit)


def decoder_parameters(vocab: int, width: int, layers: int, block: int) -> list[tuple[str, list[int], bool, str | None]]:
    """Names and shapes of a decoder with tied head, for `parameter_groups`."""
    out: list[tuple[str, list[int], bool, str | None]] = [("tokens", [vocab, width], True, None), ("places", [block, width], True, None)]
    for i in range(layers):
        for name, shape in (("attention.in.weight", [3 * width, width]), ("attention.in.bias", [3 * width]), ("attention.out.weight", [width, width]), ("attention.out.bias", [width]), ("mlp.in.weight", [4 * width, width]), ("mlp.in.bias", [4 * width]), ("mlp.out.weight", [width, 4 * width]), ("mlp.out.bias", [width]), ("norm1.weight", [width]), ("norm1.bias", [width]), ("norm2.weight", [width]), ("norm2.bias", [width])):
            out.append((f"layers.{i}.{name}", shape, True, None))
    return out + [("norm.weight", [width], True, None), ("norm.bias", [width], True, None), ("head.weight", [vocab, width], True, "tokens")]


def ordered_config(text: str, named: tuple[str, ...] = ("author",)) -> tuple[list[Any], dict[str, Any]]:
    """Values of a JSON object in file order, the `named` keys taken out ("N/A" if missing)."""
    pairs = json.loads(text, object_pairs_hook=list)
    own = dict(pairs)
    return [v for k, v in pairs if k not in named], {k: own.get(k, "N/A") for k in named}


def tokens_per_iteration(accumulation: int, world: int, batch: int, block: int) -> int:
    """Tokens of one optimizer step; the accumulation is shared among `world` processes."""
    if accumulation % world:
        raise ValueError(f"{accumulation} accumulation steps do not divide among {world} processes")
    return accumulation // world * world * batch * block


def checkpoint_folder(spark, folder: str) -> DataFrame:
    """(path, modified, bytes) of the files of a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def start_state(from_scratch: bool, resume: str | None, config: dict[str, Any], saved: dict[str, Any] | None) -> dict[str, Any]:
    """Where a run starts: from its own config, or from a checkpoint's with the step made explicit.

    A resumed run takes the saved config and continues at its saved step (0 if none was saved).
    """
    if from_scratch:
        return {"config": dict(config), "iter": 0, "resumed": None}
    if not resume or saved is None:
        raise ValueError("name a checkpoint to resume from, or start from scratch")
    if len(resume.split("/")) != 2:
        raise ValueError(f"not folder/file: {resume}")
    return {"config": dict(saved.get("model_config", {})), "iter": int(saved.get("iter", 0)), "resumed": resume}
