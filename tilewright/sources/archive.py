"""Reading tile archives: headers, metadata, entries and tiles.

`headers` works on rows of any store Spark reads (the binaryFile source). The data source "pmtiles" reads by ranges: a
partition per leaf directory, each reading its leaf and tiles only, from a path all executors see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import codec, text


def headers(files: DataFrame, content: str = "content") -> DataFrame:
    """A row per archive: path (if there), the header's fields, names of type and compressions, and metadata: its text if it is stored plain,
    else null. Rows that are no archives raise."""
    c = F.col(content)
    good = F.when(codec.is_archive(c), c).otherwise(F.raise_error(F.lit("not a tile archive of version 3")).cast("binary"))
    d = files.withColumn(content, good)
    h = d.select(*(x for x in files.columns if x != content), content, *(v.alias(k) for k, v in codec.header_columns(content).items()))
    meta = F.decode(F.substring(F.col(content), (F.col("metadata_offset") + 1).cast("int"), F.col("metadata_length").cast("int")), "UTF-8")
    return h.withColumns({
        "tile_type_name": text.tile_type_name("tile_type"), "internal_compression_name": text.compression_name("internal_compression"), "tile_compression_name": text.compression_name("tile_compression"),
        "metadata": F.when(F.col("internal_compression") == 1, meta),
    }).drop(content)


def open_header(path: str) -> codec.Header:
    with open(path, "rb") as f:
        return codec.Header.unpack(f.read(codec.HEADER_BYTES))


class _Leaf(InputPartition):
    def __init__(self, offset: int | None, length: int):
        self.offset, self.length = offset, length


class _Reader(DataSourceReader):
    def __init__(self, path: str, mode: str):
        if mode not in ("entries", "tiles"):
            raise ValueError("mode must be entries or tiles")
        self.path, self.mode = path, mode

    def partitions(self):
        h = open_header(self.path)
        if h.internal_compression != 1:
            raise ValueError("compressed directories are not supported")
        return [_Leaf(None, 0), *(_Leaf(h.leaf_offset + o, n) for _, o, n, run in self._root(h) if run == 0)]

    def _root(self, h):
        with open(self.path, "rb") as f:
            f.seek(h.root_offset)
            return codec.decode_directory(f.read(h.root_length))

    def read(self, partition):
        h = open_header(self.path)
        with open(self.path, "rb") as f:
            if partition.offset is None:
                rows = [r for r in self._root(h) if r[3]]
            else:
                f.seek(partition.offset)
                rows = codec.decode_directory(f.read(partition.length))
            for tile, offset, length, run in rows:
                if self.mode == "entries":
                    yield tile, offset, length, run
                    continue
                f.seek(h.data_offset + offset)
                data = f.read(length)
                for i in range(run):
                    yield tile + i, data


class ArchiveSource(DataSource):
    """spark.read.format("pmtiles").option("mode", "entries" or "tiles").load(path)"""

    @classmethod
    def name(cls):
        return "pmtiles"

    def schema(self):
        return "tile_id long, data binary" if self.options.get("mode", "entries") == "tiles" else "tile_id long, offset long, length long, run_length int"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("mode", "entries"))


def read_archive(spark: SparkSession, path: str, mode: str = "entries") -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("pmtiles").option("mode", mode).load(path)
