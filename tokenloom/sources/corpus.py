"""Corpora and their splits."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one string, line ends of every kind read as a line feed."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return rows.select("path", newlines(F.col("value")).alias("text"))


def newlines(text):
    """CR LF and CR become LF, as a file opened in text mode reads."""
    return F.regexp_replace(text, "\r\n?", "\n")


def read_corpus(spark: SparkSession, path: str, form: str = "parquet", text_column: str = "text", **options: str) -> DataFrame:
    """A corpus in any file format Spark reads, its text column checked and named text."""
    df = spark.read.format(form).options(**options).load(path)
    require_column(df, text_column, path)
    return df.withColumnRenamed(text_column, "text") if text_column != "text" else df


def require_column(df: DataFrame, column: str, split: str) -> None:
    """Raise before any job runs, naming the split and what it has instead."""
    if column not in df.columns:
        raise ValueError(f"split {split!r} has no column {column!r}; it has {', '.join(df.columns)}")


class SplitPlan(NamedTuple):
    """Which source split feeds train, val and test; `cut` if val is cut from train by hash."""

    train: str
    val: str
    test: str | None
    cut: bool


def resolve_splits(names: Iterable[str], train: str = "train", val: str | None = None, test: str | None = None) -> SplitPlan:
    """Decide the splits of a corpus from the names it comes with.

    Train and a named val that exist are taken as they are, with test only if it is named too.
    Else a val called validation or val is taken, else train is cut, in both cases with the named
    test or one called test. A lone split of any other name is cut as well. A named val that is
    missing is passed over in silence. Anything else raises.
    """
    there = set(names)
    named = test if test and test in there else None
    if train in there:
        if val and val in there:
            return SplitPlan(train, val, named, False)
        loose = named or ("test" if "test" in there else None)
        for other in ("validation", "val"):
            if other in there:
                return SplitPlan(train, other, loose, False)
        return SplitPlan(train, train, loose, True)
    if len(there) == 1:
        only = next(iter(there))
        return SplitPlan(only, only, None, True)
    raise ValueError(f"no train and val splits can be told from {sorted(there)}; name them")
