"""The training-data queries by name, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import read_table, stage_table
from . import crosssplit, leakage, naturalness, neardup, packing, repetition, sharedspans, tokenization
from .sql import SQL as SQL


def p4_passages(spark: SparkSession, d: str) -> DataFrame:
    records = read_table(spark, d, "general_purpose_prepare").where("split = 'train'")
    return leakage.leaked_passages(records, read_table(spark, d, "heldout_items"), read_table(spark, d, "token_vocab"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_passages(spark, d).select("rec_id", "item_id")


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with the records that contain it and the windows they share."""
    return p4_passages(spark, d).groupBy("item_id").agg(F.count("*").alias("n_records"), F.sum("n_windows").alias("n_windows"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """Training records without the leaked passages; those of which more than half would go are left out."""
    records = read_table(spark, d, "general_purpose_prepare").where("split = 'train'")
    return leakage.without_passages(records, p4_passages(spark, d), read_table(spark, d, "token_vocab")).withColumn("removed_share", F.round("removed_share", 9))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_classes(read_table(spark, d, "general_purpose_prepare"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs_of_classes(p1_classes(spark, d))


def _repetition(spark: SparkSession, d: str) -> tuple[DataFrame, list[repetition.Cutoff]]:
    stats = stage_table(repetition.repetition_stats(read_table(spark, d, "general_purpose_prepare")), "repetition")
    return stats, repetition.choose_cutoffs(stats, read_table(spark, d, "quality_labels"))


def p2_flagged(spark: SparkSession, d: str) -> DataFrame:
    """Every record's shares, which of them reach their stratum's cutoffs, and whether it is a case by definition."""
    return repetition.flag_repetition(*_repetition(spark, d)).withColumn("is_case", repetition.is_case())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """All cases of the definition; no cutoff chosen from labels adds or removes one."""
    return repetition.repetition_stats(read_table(spark, d, "general_purpose_prepare")).where(repetition.is_case()).select("rec_id")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """Words, repeated words and their share of every record with a text."""
    return repetition.repetition_stats(read_table(spark, d, "general_purpose_prepare")).where("n_words is not null").select("rec_id", "n_words", "n_repeated", F.round("rep_share", 9).alias("rep_share"))


def p2_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    cutoffs = _repetition(spark, d)[1]
    return spark.createDataFrame(cutoffs, "stratum string, measure string, cutoff double, n_good int, n_rejected int, upper double, certified boolean")


def p3_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = naturalness.quality_stats(read_table(spark, d, "general_purpose_prepare"))
    return stats.select("rec_id", *[F.round(k, 9).alias(k) if t == "double" else F.col(k).cast("long").alias(k) for k, t in stats.dtypes if k not in ("rec_id", "nonprose_share")])


def p3_kinds(spark: SparkSession, d: str) -> DataFrame:
    return naturalness.classify(read_table(spark, d, "general_purpose_prepare"), read_table(spark, d, "quality_labels"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of some length that the mixture gives to components of lists, tables or junk, confirmed by
    more than half of their characters lying outside running prose."""
    return p3_kinds(spark, d).where((F.col("n_chars") >= naturalness.MIN_CHARS) & (F.col("kind") != "prose") & (F.col("nonprose_share") > 0.5)).select("rec_id")


def p5_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.cross_split_overlaps(read_table(spark, d, "owt_prepare"), read_table(spark, d, "token_vocab"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p5_overlaps(spark, d)
    return pairs.select(F.least("train_id", "eval_id").alias("web_a"), F.greatest("train_id", "eval_id").alias("web_b"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.overlap_report(p5_overlaps(spark, d), read_table(spark, d, "owt_prepare"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenization.encode(read_table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokenization.token_counts(read_table(spark, d, "documents")))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.shared_spans(read_table(spark, d, "documents")).drop("n_chars")


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.shared_coverage(read_table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_shares, p2_flagged, p2_cutoffs, p3_found, p3_stats, p3_kinds, p4_found, p4_items, p4_clean, p5_found, p5_overlaps, p5_report, p6_ids, p7_containers, p7_report, p8_found, p8_coverage)}
