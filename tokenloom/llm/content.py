"""The content of a record: its text or, where that is missing, the text its ids stand for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

#: Largest vocabulary that is sent to the workers; a larger one is joined.
MAX_PIECES = 1 << 20
END_MARK = 50256


def vocabulary(vocab: DataFrame, id_col: str = "token_id", piece_col: str = "piece") -> Broadcast | None:
    """Pieces by id for the workers, or None if the vocabulary exceeds `MAX_PIECES` rows."""
    rows = vocab.select(id_col, piece_col).where(F.col(id_col).isNotNull()).limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        return None
    return vocab.sparkSession.sparkContext.broadcast({r[0]: r[1] or "" for r in rows if r[0] != END_MARK})


def fill_content(text: pa.Array, ids: pa.Array, pieces: dict[int, str]) -> pa.Array:
    """`text` with its nulls replaced by the joined pieces of `ids`; null where both are null.

    The end mark and ids without a piece stand for nothing.
    """
    if text.null_count == 0:
        return text
    wanted = np.flatnonzero(np.asarray(text.is_null()) & np.asarray(ids.is_valid()))
    if not len(wanted):
        return text
    made: list[str | None] = [None] * len(text)
    get = pieces.get
    for i, one in zip(wanted.tolist(), ids.take(pa.array(wanted)).to_pylist()):
        made[i] = "".join([get(t, "") for t in one if t is not None])
    return pc.coalesce(text, pa.array(made, text.type))


def joined_content(records: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """`records` with `text` filled by a join with a vocabulary too large to send around."""
    bare = records.where(F.col("text").isNull() & F.col("ids").isNotNull()).select(key, "ids").dropDuplicates([key])
    tokens = bare.select(key, F.posexplode("ids").alias("pos", "token_id")).join(
        vocab.select("token_id", "piece").where(F.col("token_id") != END_MARK), "token_id", "left"
    )
    made = tokens.groupBy(key).agg(
        F.concat_ws("", F.expr("transform(array_sort(collect_list(struct(pos, coalesce(piece, '') AS piece))), x -> x.piece)")).alias("made")
    )
    empty = bare.where(F.size("ids") == 0).select(key, F.lit("").alias("made"))
    return records.join(made.unionByName(empty), key, "left").withColumn("text", F.coalesce("text", "made")).drop("made")
