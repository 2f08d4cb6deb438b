"""Character vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def characters(text: str) -> Column:
    """A text's code points."""
    return F.split(F.col(text), "")


def char_counts(rows: DataFrame, text: str = "text", *by: str) -> DataFrame:
    """(by..., ch, n): how often each code point occurs; combined before the shuffle."""
    return rows.where(F.length(text) > 0).select(*by, F.explode(characters(text)).alias("ch")).groupBy(*by, "ch").agg(F.count("*").alias("n"))


def char_vocabulary(rows: DataFrame, text: str = "text") -> DataFrame:
    """(ch, id): the distinct code points, numbered from 0 in code point order.

    At most 1,114,112 rows, so that the final numbering in one task is bounded.
    """
    there = rows.where(F.length(text) > 0).select(F.explode(F.array_distinct(characters(text))).alias("ch")).distinct()
    return there.select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).alias("id"))


def dense_array(rows: DataFrame, index: str, value: str, name: str) -> DataFrame:
    """One row: an array with `value` at each `index` from 0 to the largest, null where there is none."""
    spark = rows.sparkSession
    top = rows.agg(F.max(index)).first()[0]
    every = spark.range(0, (top if top is not None else -1) + 1, 1, 1).select(F.col("id").alias("i"))
    filled = every.join(rows.select(F.col(index).cast("long").alias("i"), F.col(value).alias("v")), "i", "left")
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias(name))


def _codes(vocab: DataFrame) -> DataFrame:
    return dense_array(vocab.select(F.ascii("ch").alias("c"), F.col("id").cast("int").alias("id")), "c", "id", "codes")


def char_encode(rows: DataFrame, vocab: DataFrame, text: str = "text", strict: bool = True) -> DataFrame:
    """`rows` with `ids`. An unknown character raises if `strict`, else gives null; null texts give
    null and empty ones the empty list. The vocabulary, one bounded row, is sent to all tasks."""
    code = lambda c: F.get("codes", F.ascii(c))
    one = (lambda c: F.coalesce(code(c), F.raise_error(F.concat(F.lit("character not in the vocabulary: "), c)).cast("int"))) if strict else code
    out = rows.join(F.broadcast(_codes(vocab)))
    ids = F.when(F.length(text) == 0, F.array().cast("array<int>")).otherwise(F.transform(characters(text), one))
    return out.withColumn("ids", ids).drop("codes")


def char_decode(rows: DataFrame, vocab: DataFrame, ids: str = "ids") -> DataFrame:
    """`rows` with `decoded`, the characters of `ids` joined."""
    out = rows.join(F.broadcast(dense_array(vocab, "id", "ch", "chars")))
    return out.withColumn("decoded", F.array_join(F.transform(F.col(ids), lambda i: F.get("chars", i)), "")).drop("chars")


def save_vocabulary(vocab: DataFrame, folder: str) -> None:
    """(ch, id) as Parquet and, beside it, its size as JSON; nothing that runs code when read."""
    vocab.coalesce(1).write.mode("overwrite").parquet(f"{folder}/vocab.parquet")
    vocab.agg(F.count("*").alias("vocab_size")).coalesce(1).write.mode("overwrite").json(f"{folder}/meta.json")


def load_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/vocab.parquet")
