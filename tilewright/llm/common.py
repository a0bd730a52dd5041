"""Helpers the training-data operators share: table reading, words, bounded memories of Python workers."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import drop_kept, keep, new_folder, shared_dir  # noqa: F401

#: What separates words in every contract of this subpackage: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_count(text):
    """Number of words of a text column; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def parts(batches, column: int, most: int = 1 << 20):
    """The rows of Arrow batches, few at a time: about `most` bytes in the given column, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        used = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(used, (used[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, end - at)
            at = end


class Memo(dict):
    """make(key) by key, in a bounded number of bytes: two generations of half of `most`, the older forgotten when the newer is full.
    Keys of more than `longest` characters are never kept."""

    def __init__(self, make, most: int = 32 << 20, longest: int = 48):
        super().__init__()
        self.make, self.half, self.longest, self.used, self.old = make, most // 2, longest, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if self.used > self.half:
                self.old, self.used = dict(self), 0
                self.clear()
            self[key] = value
            self.used += 200 + len(key) + (len(value) if isinstance(value, bytes) else 0)
        return value

    def forget(self) -> None:
        self.clear()
        self.old, self.used = {}, 0


_holder: list = [None, None]


@contextmanager
def worker(owner: str, forget=lambda: None):
    """Around what an operator does in a task of a Python worker. A worker serves several operators; what another one
    kept there is forgotten, and memory that the task has freed goes back to the system."""
    if _holder[0] not in (None, owner):
        _holder[1]()
    _holder[:] = owner, forget
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
