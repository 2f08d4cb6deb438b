"""Flat binary token files: headerless little-endian unsigned integers, with a manifest beside.

`spark.read.format("tokenbin")` gives (pos, token_id) and reads byte ranges in parallel;
`df.write.format("tokenbin")` takes arrays (start, ids), or single tokens (pos, token_id), and
writes every token at its place, so tasks need not agree on an order. Folders must be shared by
all executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

WIDTHS = {"uint16": 2, "uint32": 4, "uint64": 8}
#: Tokens read by one task.
CHUNK = 8 << 20


def dtype_for(max_token: int | None) -> str:
    """The narrowest unsigned type for ids up to `max_token`; uint32 where that is unknown."""
    if max_token is None:
        return "uint32"
    return "uint16" if max_token < 1 << 16 else "uint32" if max_token < 1 << 32 else "uint64"


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def read_manifest(path: str) -> dict:
    with open(_local(path) + ".json", encoding="utf-8") as f:
        return json.load(f)


@dataclass
class _Range(InputPartition):
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = _local(options["path"])
        self.dtype = options.get("dtype")
        if os.path.exists(self.path + ".json"):
            made = read_manifest(self.path)["dtype"]
            if self.dtype and self.dtype != made:
                raise ValueError(f"{self.path} holds {made}, not {self.dtype}")
            self.dtype = made
        self.dtype = self.dtype or "uint16"
        if self.dtype not in WIDTHS:
            raise ValueError(f"unknown token type {self.dtype}")
        size = os.path.getsize(self.path)
        if size % WIDTHS[self.dtype]:
            raise ValueError(f"{self.path} of {size} bytes is not whole {self.dtype} tokens")
        n = size // WIDTHS[self.dtype]
        self.start = max(0, int(options.get("start", 0)))
        self.stop = min(n, int(options.get("stop", n)))
        self.chunk = int(options.get("chunk", CHUNK))

    def partitions(self) -> list[_Range]:
        return [_Range(a, min(a + self.chunk, self.stop)) for a in range(self.start, self.stop, self.chunk)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        width, step = WIDTHS[self.dtype], 1 << 18
        with open(self.path, "rb") as f:
            for a in range(partition.start, partition.stop, step):
                b = min(a + step, partition.stop)
                f.seek(a * width)
                ids = np.frombuffer(f.read((b - a) * width), np.dtype(self.dtype).newbyteorder("<"))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(ids.astype(np.int64))], ["pos", "token_id"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool, arrays: bool):
        self.path = _local(options["path"])
        self.dtype = options.get("dtype", "uint16")
        self.part = self.path + ".part"
        self.arrays = arrays
        if self.dtype not in WIDTHS:
            raise ValueError(f"unknown token type {self.dtype}")
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")

    def _pieces(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens in the order of their places, and where stretches without a gap begin, in both."""
        if self.arrays:
            batch = batch.sort_by("start")
            size = np.asarray(batch.column("ids").value_lengths().fill_null(0), np.int64)
            ids, start = batch.column("ids").flatten(), np.asarray(batch.column("start"), np.int64)
            some = size > 0
            size, start = size[some], start[some]
            cut = np.flatnonzero(np.append(True, start[1:] != (start + size)[:-1])) if len(start) else start
            return ids.to_numpy(zero_copy_only=False), (np.cumsum(size) - size)[cut], start[cut]
        pos = batch.column("pos").to_numpy(zero_copy_only=False)
        order = np.argsort(pos, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(pos[order]) != 1)) if len(pos) else order
        return batch.column("token_id").to_numpy(zero_copy_only=False)[order], cut, pos[order][cut]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        width, top = WIDTHS[self.dtype], np.iinfo(self.dtype).max
        fd = os.open(self.part, os.O_WRONLY | os.O_CREAT, 0o644)
        n, last = 0, -1
        try:
            for batch in iterator:
                ids, cut, at = self._pieces(batch)
                if len(ids) == 0:
                    continue
                if ids.dtype.kind not in "iu" or ids.min() < 0 or ids.max() > top:
                    raise ValueError(f"a token id does not fit {self.dtype}")
                raw = ids.astype(np.dtype(self.dtype).newbyteorder("<"))
                for a, b, pos in zip(cut.tolist(), [*cut[1:].tolist(), len(raw)], at.tolist()):
                    os.pwrite(fd, raw[a:b].tobytes(), pos * width)
                    last = max(last, pos + b - a - 1)
                n += len(raw)
        finally:
            os.close(fd)
        message = WriterCommitMessage()
        message.tokens, message.last = n, last
        return message

    def commit(self, messages: list) -> None:
        n, last = sum(m.tokens for m in messages if m), max([m.last for m in messages if m], default=-1)
        if n != last + 1:
            self.abort(messages)
            raise ValueError(f"{n} tokens for {last + 1} places")
        with open(self.part, "ab"):  # an empty stream is an empty file
            pass
        os.replace(self.part, self.path)
        with open(self.path + ".json", "w", encoding="utf-8") as f:
            json.dump({"dtype": self.dtype, "tokens": n}, f)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class TokenBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenbin"

    def schema(self) -> str:
        return "pos long, token_id long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite, "ids" in schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenBin)
