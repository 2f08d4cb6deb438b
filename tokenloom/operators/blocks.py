"""Fixed-length input and target blocks over a token stream.

A stream is a table (key, ids) read in the order of the unique `key`; its arrays follow one
another without a gap, so blocks cross document limits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .positions import running_offsets

BLOCK, BATCH = 1024, 8


def placed_stream(rows: DataFrame, key: str = "doc_id", ids: str = "ids", distinct: bool = False) -> DataFrame:
    """(key, ids, start): each array with its place in the stream; null and empty ones are left out.

    The arrays travel with their keys through the one shuffle that orders them. Keys are unique,
    or with `distinct` one row of each key is taken.
    """
    rows = rows.where(F.col(key).isNotNull() & (F.size(ids) > 0)).select(key, F.col(ids).alias("ids"))
    return running_offsets(rows, key, F.size("ids"), carry=("ids",), distinct=distinct).drop("size")


def pack_blocks(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block_id, x, y) for the (N - 1) div block full blocks of a stream of N tokens.

    x holds the block's tokens, y the same shifted by one, so the last y is the first token of
    the next block. Arrays are cut where blocks begin and gathered per block; tokens are never
    rows of their own. A block gathers at most block + 1 tokens.
    """
    n = F.broadcast(placed.agg(F.max(F.col("start") + F.size("ids")).alias("n")))  # one row
    stop = F.col("start") + F.size("ids") - 1
    # a token at p belongs to block p div block, and as a last target to the one before
    first = F.greatest(F.floor((F.col("start") - 1) / block), F.lit(0))
    parts = placed.select("start", "ids", F.explode(F.sequence(first.cast("long"), F.floor(stop / block).cast("long"))).alias("block_id"))
    lo = F.greatest(F.col("block_id") * block - F.col("start"), F.lit(0))
    hi = F.least(F.col("block_id") * block + block + 1 - F.col("start"), F.size("ids").cast("long"))
    parts = parts.where(hi > lo).select("block_id", F.struct((F.col("start") + lo).alias("at"), F.slice("ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part")).alias("p"))
    whole = parts.groupBy("block_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"])).alias("t"))
    whole = whole.join(n).where(F.col("block_id") < F.floor((F.col("n") - 1) / block))
    return whole.select("block_id", F.slice("t", 1, block).alias("x"), F.slice("t", 2, block).alias("y"))


def full_batches(blocks: DataFrame, block: int = BLOCK, batch: int = BATCH, full_coverage: bool = False) -> DataFrame:
    """`blocks` with `batch_id`, without the last incomplete batch unless `full_coverage`.

    Raises ValueError if there is no full batch, naming the tokens needed. The blocks are counted
    at once, so write them first if they are costly to make.
    """
    n = blocks.count()
    if n < batch:
        raise ValueError(f"data too small: need at least {block * batch + 1} tokens")
    limit = n if full_coverage else n // batch * batch
    return blocks.where(F.col("block_id") < limit).select(*blocks.columns, F.floor(F.col("block_id") / batch).alias("batch_id"))


def stack_batches(batches: DataFrame) -> DataFrame:
    """(batch_id, xs, ys): the blocks of each batch as rows of one matrix, in block order.

    A batch holds at most `batch` blocks by the way `full_batches` numbers them.
    """
    rows = batches.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("block_id", "x", "y"))).alias("r"))
    return rows.select("batch_id", F.transform("r", lambda b: b["x"]).alias("xs"), F.transform("r", lambda b: b["y"]).alias("ys"))


def sample_starts(spark, steps: int, batch: int, n_tokens: int, block: int = BLOCK, seed: int = 1337, rank: int = 0) -> DataFrame:
    """(step, slot, start): window starts drawn evenly, with replacement, from [0, n - block).

    A draw is a hash of seed + rank, step and slot, so it depends on nothing else.
    """
    if n_tokens <= block:
        raise ValueError(f"{n_tokens} tokens hold no window of {block} and its target")
    slots = spark.range(steps * batch).select(F.floor(F.col("id") / batch).alias("step"), (F.col("id") % batch).alias("slot"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed + rank), "step", "slot")), 1, 12), 16, 10).cast("long")
    return slots.select("step", "slot", (drawn % F.lit(n_tokens - block)).alias("start"))


def windows_at(placed: DataFrame, starts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(step, slot, start, x, y) for window starts of a stream.

    Starts and arrays meet on the 4096-token cells they touch, an equality join, not on ranges.
    """
    cell = 4096
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / cell).cast("long"), F.floor(b / cell).cast("long"))).alias("cell")
    want = starts.select("step", "slot", F.col("start").alias("w"), cells(F.col("start"), F.col("start") + block))
    have = placed.select("start", "ids", cells(F.col("start"), F.col("start") + F.size("ids") - 1))
    lo = F.greatest(F.col("w"), F.col("start"), F.col("cell") * cell)
    hi = F.least(F.col("w") + block + 1, F.col("start") + F.size("ids"), (F.col("cell") + 1) * cell)
    met = want.join(have, "cell").where(hi > lo)
    part = F.struct(lo.alias("at"), F.slice("ids", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    whole = met.select("step", "slot", "w", part.alias("p")).groupBy("step", "slot", "w").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"])).alias("t"))
    return whole.select("step", "slot", F.col("w").alias("start"), F.slice("t", 1, block).alias("x"), F.slice("t", 2, block).alias("y"))


def next_token_counts(placed: DataFrame) -> DataFrame:
    """(x, y, n): how often token y follows x in the stream, across document limits too.

    A document's last token meets the first of the document that starts where it stops.
    """
    size = F.size("ids")
    inside = placed.where(size > 1).select(F.explode(F.arrays_zip(F.slice("ids", F.lit(1), size - 1).alias("x"), F.slice("ids", F.lit(2), size - 1).alias("y"))).alias("p")).select("p.x", "p.y")
    ends = placed.select(F.element_at("ids", -1).alias("x"), (F.col("start") + size).alias("at"))
    begins = placed.select(F.element_at("ids", 1).alias("y"), F.col("start").alias("at"))
    return inside.unionByName(ends.join(begins, "at").select("x", "y")).groupBy("x", "y").agg(F.count("*").alias("n"))


def causal_mask(spark, size: int) -> DataFrame:
    """(i, masked): for each place of a window the later places it must not see."""
    return spark.range(size).select(F.col("id").alias("i"), F.when(F.col("id") + 1 < size, F.sequence(F.col("id") + 1, F.lit(size - 1).cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("masked"))
