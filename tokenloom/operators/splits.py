"""Cutting a corpus into train and val."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.corpus import SplitPlan
from .positions import hash_rank

# fixed values: share and seed of the published web corpus
VAL_SIZE, SEED = 0.0005, 2357


def fraction_split(rows: DataFrame, key: str = "doc_id", val_size: float = VAL_SIZE, seed: int = SEED) -> DataFrame:
    """(key, split): the ceil(n * val_size) keys that come first in hash order are val, the rest train.

    Deterministic, disjoint, exhaustive and exact in size, whatever the partitioning. Null keys
    are left out; repeated keys count once.
    """
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    n = F.broadcast(keys.agg(F.count("*").alias("n")))  # one row
    ranked = hash_rank(keys, key, seed).join(n)
    return ranked.select(key, F.when(F.col("rank") <= F.ceil(F.col("n") * F.lit(val_size)), "val").otherwise("train").alias("split"))


def apply_plan(rows: DataFrame, plan: SplitPlan, key: str = "doc_id", val_size: float = VAL_SIZE, seed: int = SEED) -> DataFrame:
    """`rows` with `split` renamed to train, val and test as `plan` says; other splits are dropped."""
    own = {plan.train: "train"} | ({} if plan.cut else {plan.val: "val"}) | ({plan.test: "test"} if plan.test else {})
    name = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[F.col("split")]
    kept = rows.where(F.col("split").isin(*own)).withColumn("split", name)
    if not plan.cut:
        return kept
    cut = fraction_split(kept.where("split = 'train'"), key, val_size, seed).withColumnRenamed("split", "cut")
    return kept.join(cut, key, "left").withColumn("split", F.when(F.col("split") == "train", F.col("cut")).otherwise(F.col("split"))).drop("cut")


def head_chars(text: str | Column, share: float = 0.9) -> Column:
    """How many code points of a text are its head: the whole part of `share` times its length."""
    return F.floor(F.length(text) * F.lit(share)).cast("int")


def head_tail(rows: DataFrame, text: str = "text", share: float = 0.9) -> DataFrame:
    """`rows` with head and tail: the first `share` of the code points, and the rest; null for null texts."""
    n = head_chars(text, share)
    return rows.withColumn("head", F.substring(F.col(text), F.lit(1), n)).withColumn("tail", F.substring(F.col(text), n + 1, F.length(text)))
