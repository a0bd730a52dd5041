"""From tiles to the directories of an archive: running offsets, id deltas, leaves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..storage import keep


def with_offsets(tiles: DataFrame, id_col: str = "tile_id", length_col: str = "length") -> DataFrame:
    """Adds row (from 0) and offset: the sum of lengths of all smaller ids.

    Tiles are dealt by range of ids; what comes before a part is added to the sums within it. Only one row a part meets in one task.
    """
    dealt = keep(tiles.repartitionByRange(id_col).withColumn("part", F.spark_partition_id()), "dealt")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum(length_col).alias("s")).select("part", F.coalesce(F.sum("n").over(before), zero).alias("n"), F.coalesce(F.sum("s").over(before), zero).alias("s"))
    own = Window.partitionBy("part").orderBy(id_col)
    inner = dealt.withColumn("i", F.row_number().over(own) - 1).withColumn("o", F.coalesce(F.sum(length_col).over(own.rowsBetween(Window.unboundedPreceding, -1)), zero))
    return inner.join(parts, "part").select(*tiles.columns, (F.col("n") + F.col("i")).cast("long").alias("row"), (F.col("s") + F.col("o")).cast("long").alias("offset"))


def directory_columns(entries: DataFrame, leaf_entries: int) -> DataFrame:
    """entries: tile_id, length, row, offset. Adds leaf, and what a directory stores: delta, run_length, offset_code.

    Deltas and the coding of following offsets begin anew in each leaf, so a leaf is all that a task needs together.
    """
    e = entries.withColumn("leaf", F.floor(F.col("row") / leaf_entries).cast("long")).withColumn("run_length", F.lit(1))
    w = Window.partitionBy("leaf").orderBy("tile_id")
    follows = F.lag("offset").over(w) + F.lag("length").over(w) == F.col("offset")
    return e.withColumns({"delta": F.col("tile_id") - F.coalesce(F.lag("tile_id").over(w), F.lit(0).cast("long")), "offset_code": F.when(follows, F.lit(0).cast("long")).otherwise(F.col("offset") + 1)})


def leaf_sizes(columns: DataFrame) -> DataFrame:
    """leaf, first_id, entries, bytes."""
    row = sum((codec.varint_bytes(c) for c in ("run_length", "length", "offset_code")), codec.varint_bytes("delta"))
    g = columns.groupBy("leaf").agg(F.min("tile_id").alias("first_id"), F.count("*").alias("entries"), F.sum(row).alias("bytes"))
    return g.withColumn("bytes", F.col("bytes") + codec.varint_bytes("entries"))


def leaf_pointers(sizes: DataFrame) -> DataFrame:
    """Root entries: tile_id, offset (within the leaves), length, run_length 0. One row per leaf."""
    before = Window.orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("leaf", F.col("first_id").alias("tile_id"), F.coalesce(F.sum("bytes").over(before), F.lit(0).cast("long")).alias("offset"), F.col("bytes").alias("length"), F.lit(0).alias("run_length"))


def directories(entries: DataFrame) -> tuple[bytes, DataFrame | None]:
    """The root, and (leaf, bytes) of the leaves; none if all entries fit into the root. Leaves hold codec.LEAF_ENTRIES entries,
    doubled until the root fits. Leaves are encoded where they lie."""
    n = entries.count()
    row = ["tile_id", "offset", "length", "run_length"]
    if n <= codec.ROOT_LIMIT // 4:  # an entry has four bytes at least
        root = codec.encode_directory([tuple(r) for r in entries.withColumn("run_length", F.lit(1)).select(*row).orderBy("tile_id").collect()])
        if len(root) <= codec.ROOT_LIMIT:
            return root, None

    def encode(table: pa.Table) -> pa.Table:
        t = table.sort_by("tile_id")
        raw = codec.encode_directory(list(zip(*(t.column(c).to_pylist() for c in row), strict=True)))
        return pa.table({"leaf": [t.column("leaf")[0].as_py()], "first_id": [t.column("tile_id")[0].as_py()], "raw": pa.array([raw], pa.binary())})

    size = codec.LEAF_ENTRIES
    while True:
        e = entries.select("tile_id", "offset", F.col("length").cast("long").alias("length"), F.lit(1).alias("run_length"), F.floor(F.col("row") / size).cast("long").alias("leaf"))
        leaves = keep(e.groupBy("leaf").applyInArrow(encode, "leaf long, first_id long, raw binary"), "leaves")
        if -(-n // size) <= codec.ROOT_LIMIT // 4:
            pointers, at = [], 0
            for r in leaves.select("first_id", F.length("raw").alias("n")).orderBy("leaf").collect():
                pointers.append((r.first_id, at, r.n, 0))
                at += r.n
            root = codec.encode_directory(pointers)
            if len(root) <= codec.ROOT_LIMIT:
                return root, leaves
        size *= 2
